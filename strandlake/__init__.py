"""strandlake: probe design and specificity screening as Spark dataflows."""
