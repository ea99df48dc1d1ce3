"""DataFrame-to-DataFrame operators of probe design and screening."""
