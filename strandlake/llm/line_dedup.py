"""Site-relative line deduplication with DataFrame functions only.

A line is boilerplate on a host if the share of the host's other pages that hold it, seen from a page that does, exceeds a ratio. (Counted
with the page itself, every line of a host with few pages would exceed it.) Pages are counted once per line. A host can have at most
(mean distinct lines a page) / ratio such lines, and so many more as a page has, so the table of boilerplate is small; Spark broadcasts it if it fits
its own threshold and otherwise joins by host, splitting large hosts. A host's lines lie in BUCKETS by hash, so that a page's line is looked for in one of them.

Edge cases: a null text stays null and holds no lines; a null host is a host of its own; blank lines (empty, or of
blanks, tabs and carriage returns only) are never counted and never dropped; a line's end is the line feed, so a carriage return before it belongs to the line; line order is kept; repeated rows count as pages; a host of one page keeps everything; a page of boilerplate
only becomes the empty text; an empty table gives no rows; a very long text is split into its lines by one task, which holds them twice; other columns
pass through whatever their names; `n_lines` and `n_dropped` replace input columns of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare


BUCKETS = 256
_INK = r"[^\x09-\x0D\x20]"


def _blank(line: Column) -> Column:
    return ~F.rlike(line, F.lit(_INK))


def _key(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _bucket(key: Column) -> Column:
    return F.pmod(key["a"], F.lit(BUCKETS)).cast("int")


def boilerplate(docs: DataFrame, ratio: float, text: str = "text", host: str = "source") -> DataFrame:
    """One row per host with boilerplate: host, bad (BUCKETS arrays of line keys)."""
    pages = docs.select(F.coalesce(F.col(host), F.lit("\0")).alias("host"), F.col(text).alias("body"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.split("body", "\n", -1))).alias("line")).where(~_blank(F.col("line")))
    counts = lines.groupBy("host", _key(F.col("line")).alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    bad = counts.join(totals, "host").where(F.col("n") - 1 > F.lit(ratio) * (F.col("pages") - 1))
    bad = bad.groupBy("host", _bucket(F.col("key")).alias("b")).agg(F.collect_list("key").alias("keys"))
    bad = bad.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("b", "keys"))).alias("m"))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return bad.select("host", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), none)).alias("bad"))


def drop_boilerplate(docs: DataFrame, ratio: float = 0.05, text: str = "text", host: str = "source") -> DataFrame:
    """docs with boilerplate lines cut from the text, and n_lines and n_dropped besides."""
    prepare(docs.sparkSession)
    bad = materialise(boilerplate(docs, ratio, text, host), "boilerplate")
    # the input's columns stay in one struct, where no name of ours meets theirs
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("body"), F.coalesce(F.col(host), F.lit("\0")).alias("host"))
    lines = F.split("body", "\n", -1)
    # the inner lambda binds a row's boilerplate and lines once
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.get(F.col("bad"), _bucket(_key(x))), _key(x)))
    rows = rows.join(bad, "host", "left").withColumn("kept", F.when(F.col("bad").isNull(), lines).otherwise(kept))
    n = F.when(F.col("body").isNull(), 0).otherwise(F.size(lines))
    n_kept = F.when(F.col("body").isNull(), 0).otherwise(F.size("kept"))
    own = [F.array_join("kept", "\n").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*own, n.alias("n_lines"), (n - n_kept).alias("n_dropped"))


#: DuckDB SQL of the query: site = source, the production parameters.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
l AS (SELECT DISTINCT r, host, unnest(lines) AS line FROM d),
bad AS (SELECT l.host, line FROM l JOIN totals USING (host) WHERE regexp_matches(line, '[^\x09-\x0D\x20]') GROUP BY l.host, line, pages
        HAVING count(*) > 1 AND count(*) - 1 > 0.05 * (pages - 1)),
pos AS (SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
kept AS (SELECT pos.r, array_to_string(list(pos.line ORDER BY i) FILTER (bad.line IS NULL), chr(10)) AS text,
                count(*) AS n_lines, count(bad.line) AS n_dropped
         FROM pos LEFT JOIN bad ON pos.host = bad.host AND pos.line = bad.line GROUP BY pos.r)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped,
       CASE WHEN d.lines IS NOT NULL THEN sha256(coalesce(text, '')) END AS text_sha256
FROM d LEFT JOIN kept USING (r)
"""
