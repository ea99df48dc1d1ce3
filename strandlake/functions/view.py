"""How a gapped alignment is shown: both sequences with their columns, from the probe, its CIGAR and MD."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tags import cigar_ops


def gapped_view(seq: Column, cigar: Column, md: Column) -> Column:
    """(sequence, target_sequence): mismatches and inserted bases in lower case; '-' opposite a gap; deleted target bases in lower case. Null where a tag is missing."""
    ops = F.array_join(F.transform(cigar_ops(cigar), lambda x: F.repeat(x["op"], x["n"])), "")  # a letter for each column
    items = F.regexp_extract_all(md, F.lit(r"(\d+|\^[A-Z]+|[A-Z])"), F.lit(1))
    # a sign for each target base: '=', a mismatched base, or a deleted one in lower case
    sign = lambda x: F.when(F.rlike(x, F.lit(r"^\d")), F.repeat(F.lit("="), F.coalesce(x.try_cast("int"), F.lit(0)))).otherwise(F.when(F.startswith(x, F.lit("^")), F.lower(F.substr(x, F.lit(2)))).otherwise(x))
    signs = F.array_join(F.transform(items, sign), "")

    def column(x: Column, acc: Column, i: Column) -> Column:
        op, base, mark = F.substr(x["ops"], i, F.lit(1)), F.substr(x["seq"], acc["q"] + 1, F.lit(1)), F.substr(x["signs"], acc["t"] + 1, F.lit(1))
        top = F.when(op == "D", "-").when((op == "I") | (mark != "="), F.lower(base)).otherwise(base)
        bottom = F.when(op == "I", "-").when(mark != "=", F.lower(mark)).otherwise(base)
        return F.struct((acc["q"] + (op != "D").cast("int")).alias("q"), (acc["t"] + (op != "I").cast("int")).alias("t"), F.concat(acc["top"], top).alias("top"), F.concat(acc["bottom"], bottom).alias("bottom"))

    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("t"), F.lit("").alias("top"), F.lit("").alias("bottom"))
    # in an array of one, so that both texts are made once for an alignment and not again for each column
    once = F.array(F.struct(ops.alias("ops"), signs.alias("signs"), seq.alias("seq")))
    shown = lambda x: F.aggregate(F.sequence(F.lit(1), F.length(x["ops"])), start, lambda acc, i: column(x, acc, i), lambda a: F.struct(a["top"].alias("sequence"), a["bottom"].alias("target_sequence")))
    both = F.get(F.transform(once, shown), F.lit(0))
    return F.when((F.length(seq) > 0) & (F.length(ops) > 0) & (F.length(md) > 0), both)
