"""The relations that the registered queries run on, in Spark and in DuckDB SQL.

The tables hold texts; their letters are read as bases (letter i of the alphabet is ACGT[i mod 4]), which gives both engines the same sequences:
documents are reference contigs, benchmark items are genes to tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import align, tiling

K, LENGTH, ERRORS = 16, tiling.LENGTH, 2


def spread(df: DataFrame) -> DataFrame:
    """A table that comes as fewer splits than there are cores is dealt out; otherwise its own splits stay."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig (with a version), doc_id, genome, grp, seq."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text").where("text IS NOT NULL"))
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), (F.col("doc_id") % 3).cast("string"))
    return d.select(name.alias("contig"), "doc_id", F.col("source").alias("genome"), F.col("lang").alias("grp"), S.to_dna(F.col("text")).alias("seq"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    return b.select(F.concat(F.lit("g"), F.col("item_id").cast("string")).alias("gene_id"), S.to_dna(F.col("text")).alias("seq"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tile(genes(spark, sf_dir), LENGTH)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).where(tiling.passes())


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """probe_id, job, start, end, seq: every candidate, as it is and with one and two bases changed; those at odd places reverse-complemented."""
    w = candidates(spark, sf_dir)
    one = S.rotate(F.col("seq"), 10)
    forms = F.array(*[F.struct(F.lit(i).alias("m"), s.alias("s")) for i, s in enumerate((F.col("seq"), one, S.rotate(one, 25)))])
    w = w.select("gene_id", "start", "end", F.explode(forms).alias("f"))
    seq = F.when(F.col("start") % 2 == 1, S.revcomp(F.col("f.s"))).otherwise(F.col("f.s"))
    name = F.format_string("probe_%s_%s_%s|start=%s|end=%s|%s", "gene_id", "start", "f.m", "start", "end", "gene_id")
    return w.select(name.alias("probe_id"), F.col("gene_id").alias("job"), "start", "end", seq.alias("seq"))


def bulged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """probe_id, seq: every probe with one base left out of, and one doubled in, its middle."""
    p = probes(spark, sf_dir)
    short = p.select(F.concat("probe_id", F.lit("|del")).alias("probe_id"), F.concat(F.substring("seq", 1, 17), F.substr("seq", F.lit(19))).alias("seq"))
    return short.union(p.select(F.concat("probe_id", F.lit("|ins")).alias("probe_id"), F.concat(F.substring("seq", 1, 18), F.substr("seq", F.lit(18))).alias("seq")))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ungapped alignments of the probes, with their job."""
    found = align.align_ungapped(probes(spark, sf_dir), contigs(spark, sf_dir), ERRORS)
    return found.withColumn("job", F.element_at(F.split("probe_id", r"\|"), -1))


def gene_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcript, gene: four fifths of the contigs have a gene, half of those by their name without version."""
    c = contigs(spark, sf_dir).where("doc_id % 5 <> 0")
    name = F.when(F.col("doc_id") % 2 == 0, F.col("contig")).otherwise(F.substring_index("contig", ".", 1))
    return c.select(name.alias("transcript"), F.concat(F.lit("G"), (F.col("doc_id") % 97).cast("string")).alias("gene"))


def species_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """genome, species: each genome's first language; one genome is unknown."""
    d = table(spark, sf_dir, "documents").where("source <> 'src7'")
    return d.groupBy(F.col("source").alias("genome")).agg(F.min("lang").alias("species"))


# ------------------------------------------------------------------------------------------ SQL

_T = "translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC')"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def rc(x: str) -> str:
    return RC.format(x)


def gc(x: str) -> str:
    return f"((length({x}) - length(replace(replace({x}, 'G', ''), 'C', ''))) / length({x}) * 100)"


# Fixed values, as the SQL's own copy: nearest-neighbour enthalpies (kcal/mol) and entropies (cal/mol K) of Allawi and SantaLucia (1997), in tenths.
_H = "MAP {'AA': -79, 'AC': -84, 'AG': -78, 'AT': -72, 'CA': -85, 'CC': -80, 'CG': -106, 'CT': -78, 'GA': -82, 'GC': -98, 'GG': -80, 'GT': -84, 'TA': -72, 'TC': -82, 'TG': -85, 'TT': -79}"
_S = "MAP {'AA': -222, 'AC': -224, 'AG': -210, 'AT': -204, 'CA': -227, 'CC': -199, 'CG': -272, 'CT': -210, 'GA': -222, 'GC': -244, 'GG': -199, 'GT': -224, 'TA': -213, 'TC': -222, 'TG': -227, 'TT': -222}"


def tm(x: str) -> str:
    end = lambda i, weak, strong: f"(CASE WHEN substr({x}, {i}, 1) IN ('A', 'T') THEN {weak} ELSE {strong} END)"
    total = lambda m, weak, strong: f"(list_sum(list_transform(range(1, length({x})), lambda i: {m}[substr({x}, i, 2)])) + {end(1, weak, strong)} + {end(f'length({x})', weak, strong)})"
    return f"(1000 * ({total(_H, 23, 1)} / 10) / ({total(_S, 41, -28)} / 10 + 0.368 * (length({x}) - 1) * ln(0.390) + 1.987 * ln(1.25e-08)) - 273.15 - 32.5)"


def complexity(x: str) -> str:
    def term(b: str) -> str:
        p = f"((length({x}) - length(replace({x}, '{b}', ''))) / length({x}))"
        return f"(CASE WHEN {p} > 0 THEN {p} * log2({p}) ELSE 0 END)"

    return "((0.0 - " + " - ".join(map(term, "ACGT")) + ") / 2)"


def homopolymer(x: str) -> str:
    return f"regexp_matches({x}, 'A{{5}}|C{{5}}|G{{5}}|T{{5}}')"


def md(q: str = "seq", t: str = "target") -> str:
    at = f"list_filter(range(1, length({q}) + 1), lambda i: substr({q}, i, 1) <> substr({t}, i, 1))"
    parts = f"array_to_string(list_transform(range(1, len({at}) + 1), lambda j: CAST(({at})[j] - coalesce(({at})[j - 1], 0) - 1 AS VARCHAR) || substr({t}, ({at})[j], 1)), '')"
    return f"({parts} || CAST(length({q}) - coalesce(({at})[len({at})], 0) AS VARCHAR))"


CONTIGS = f"contigs AS (SELECT source || '_' || doc_id || '.' || (doc_id % 3) AS contig, doc_id, source AS genome, lang AS grp, {_T} AS seq FROM documents WHERE text IS NOT NULL)"
GENES = f"genes AS (SELECT 'g' || item_id AS gene_id, {_T} AS seq FROM benchmark WHERE text IS NOT NULL)"
WINDOWS = GENES + f""",
windows AS (SELECT gene_id, CAST(s AS INTEGER) AS "start", CAST(s + {LENGTH - 1} AS INTEGER) AS "end", substr(seq, s, {LENGTH}) AS seq
  FROM (SELECT gene_id, seq, unnest(range(1, length(seq) - {LENGTH - 2})) AS s FROM genes))"""
CANDIDATES = WINDOWS + f""",
candidates AS (SELECT * FROM windows WHERE {gc('seq')} BETWEEN 40 AND 80 AND NOT {homopolymer('seq')} AND {tm('seq')} BETWEEN 42 AND 47)"""
_ONE = "substr(seq, 1, 9) || translate(substr(seq, 10, 1), 'ACGT', 'CGTA') || substr(seq, 11)"
_TWO = "substr(seq, 1, 9) || translate(substr(seq, 10, 1), 'ACGT', 'CGTA') || substr(seq, 11, 14) || translate(substr(seq, 25, 1), 'ACGT', 'CGTA') || substr(seq, 26)"
PROBES = CANDIDATES + f""",
forms AS (SELECT gene_id, "start", "end", 0 AS m, seq AS s FROM candidates UNION ALL SELECT gene_id, "start", "end", 1, {_ONE} FROM candidates UNION ALL SELECT gene_id, "start", "end", 2, {_TWO} FROM candidates),
probes AS (SELECT 'probe_' || gene_id || '_' || "start" || '_' || m || '|start=' || "start" || '|end=' || "end" || '|' || gene_id AS probe_id, gene_id AS job, "start", "end",
  CASE WHEN "start" % 2 = 1 THEN {rc('s')} ELSE s END AS seq FROM forms)"""
SEED = LENGTH // (ERRORS + 1)
HITS = PROBES + ", " + CONTIGS + f""",
q AS (SELECT probe_id, job, 0 AS flag, seq FROM probes UNION ALL SELECT probe_id, job, 16, {rc('seq')} FROM probes),
seeds AS (SELECT probe_id, job, flag, seq, CAST(j * {SEED} AS INTEGER) AS off, substr(seq, CAST(j * {SEED} + 1 AS INTEGER), {SEED}) AS seed FROM q, range({ERRORS + 1}) t(j)),
ref AS (SELECT contig, p, substr(seq, p, {SEED}) AS seed FROM (SELECT contig, seq, unnest(range(1, length(seq) - {SEED - 2})) AS p FROM contigs)),
cand AS (SELECT DISTINCT probe_id, job, flag, seeds.seq, contig, p - off AS pos FROM ref JOIN seeds USING (seed) WHERE p > off),
hits AS (SELECT *, CAST(hamming(seq, target) AS INTEGER) AS nm FROM (SELECT probe_id, job, CAST(flag AS INTEGER) AS flag, contig AS rname, CAST(pos AS INTEGER) AS pos, cand.seq, substr(c.seq, pos, {LENGTH}) AS target
  FROM cand JOIN contigs c USING (contig)) WHERE length(target) = {LENGTH} AND hamming(seq, target) <= {ERRORS})"""
#: Gapped alignments by enumeration: no gap, one target base left out after base i of the probe, or base i of the probe without a target base; a gap that could move to the
#: probe's first base doesn't count. The least edits win, then no gap, then the shorter target; of overlapping hits those with more edits go.
_COST = {
    "none": "hamming(q, substr(t, 1, n))",
    "del": "list_min(list_transform(list_filter(range(1, n), lambda i: substr(q, 1, i) || substr(t, i + 1, 1) <> repeat(substr(q, 1, 1), i + 1) OR substr(t, 1, i) <> substr(q, 1, i)), "
    "lambda i: hamming(substr(q, 1, i), substr(t, 1, i)) + hamming(substr(q, i + 1), substr(t, i + 2, n - i)))) + 1",
    "ins": "list_min(list_transform(list_filter(range(2, n), lambda i: substr(q, 1, i) <> repeat(substr(q, 1, 1), i) OR substr(t, 1, i - 1) <> substr(q, 1, i - 1)), "
    "lambda i: hamming(substr(q, 1, i - 1), substr(t, 1, i - 1)) + hamming(substr(q, i + 1), substr(t, i, n - i)))) + 1",
}
_OVERLAP = "k.probe_id = h.probe_id AND k.flag = h.flag AND k.rname = h.rname AND k.pos < h.pos + h.used AND h.pos < k.pos + k.used"
GAPPED = PROBES + ", " + CONTIGS + f""",
bulged AS (SELECT probe_id || '|del' AS probe_id, substr(seq, 1, 17) || substr(seq, 19) AS seq FROM probes UNION ALL SELECT probe_id || '|ins', substr(seq, 1, 18) || substr(seq, 18) FROM probes),
q AS (SELECT DISTINCT probe_id, 0 AS flag, seq FROM bulged UNION ALL SELECT DISTINCT probe_id, 16, {rc('seq')} FROM bulged),
seeds AS (SELECT probe_id, flag, seq, CAST(j * 11 AS INTEGER) AS off, substr(seq, CAST(j * 11 + 1 AS INTEGER), 11) AS seed FROM q, range(3) t(j)),
ref AS (SELECT contig, p, substr(seq, p, 11) AS seed FROM (SELECT contig, seq, unnest(range(1, length(seq) - 9)) AS p FROM contigs)),
cand AS (SELECT DISTINCT probe_id, flag, seeds.seq, contig, p - off + s AS pos FROM ref JOIN seeds USING (seed), range(-1, 2) u(s) WHERE p - off + s > 0),
w AS (SELECT probe_id, flag, cand.seq AS q, contig, pos, length(cand.seq) AS n, substr(c.seq, pos, length(cand.seq) + 1) AS t FROM cand JOIN contigs c USING (contig)),
costs AS (SELECT *, CASE WHEN length(t) >= n THEN {_COST['none']} END AS c0, CASE WHEN length(t) > n THEN {_COST['del']} END AS cd, CASE WHEN length(t) >= n - 1 THEN {_COST['ins']} END AS ci FROM w WHERE length(t) >= n - 1),
best AS (SELECT *, least(c0, cd, ci) AS nm FROM costs),
found AS (SELECT probe_id, CAST(flag AS INTEGER) AS flag, contig AS rname, CAST(pos AS INTEGER) AS pos, CAST(nm AS INTEGER) AS nm, q, substr(t, 1, CASE WHEN nm = c0 THEN n WHEN nm = ci THEN n - 1 ELSE n + 1 END) AS target,
  CASE WHEN nm = c0 THEN n WHEN nm = ci THEN n - 1 ELSE n + 1 END AS used FROM best WHERE nm <= 2),
k0 AS (SELECT * FROM found WHERE nm = 0), k1 AS (SELECT * FROM k0 UNION ALL SELECT * FROM found h WHERE nm = 1 AND NOT EXISTS (SELECT 1 FROM k0 k WHERE {_OVERLAP})),
gapped AS (SELECT * FROM k1 UNION ALL SELECT * FROM found h WHERE nm = 2 AND NOT EXISTS (SELECT 1 FROM k1 k WHERE {_OVERLAP}))"""
#: The same with the place of each gap (the leftmost of the cheapest) and both lines without the gap's column.
_AT = {kind: _COST[kind].split("list_filter(", 1)[1].split(", lambda i: ", 1) for kind in ("del", "ins")}
_PLACE = {kind: (rng, *rest.rsplit("), lambda i: ", 1)) for kind, (rng, rest) in _AT.items()}
_FIRST = {kind: f"list_filter({rng}, lambda i: ({allowed}) AND {cost.rsplit('))', 1)[0]} + 1 = nm)[1]" for kind, (rng, allowed, cost) in _PLACE.items()}
PLACED = GAPPED.replace("AS nm, q, substr(t, 1,", "AS nm, q, t, n, c0, ci, substr(t, 1,") + f""",
places AS (SELECT *, CASE WHEN nm = c0 THEN 'none' WHEN nm = ci THEN 'ins' ELSE 'del' END AS kind, CAST(CASE WHEN nm = c0 THEN 0 WHEN nm = ci THEN {_FIRST['ins']} ELSE {_FIRST['del']} END AS INTEGER) AS gap FROM gapped),
lined AS (SELECT *, CASE kind WHEN 'ins' THEN substr(q, 1, gap - 1) || substr(q, gap + 1) ELSE q END AS qq,
  CASE kind WHEN 'del' THEN substr(t, 1, gap) || substr(t, gap + 2, n - gap) WHEN 'ins' THEN substr(t, 1, n - 1) ELSE substr(t, 1, n) END AS tt FROM places)"""
PLACED_CIGAR = "CASE kind WHEN 'none' THEN n || 'M' WHEN 'ins' THEN (gap - 1) || 'M1I' || (n - gap) || 'M' ELSE gap || 'M1D' || (n - gap) || 'M' END"
PLACED_MD = (
    f"regexp_replace(CASE kind WHEN 'del' THEN {md('substr(qq, 1, gap)', 'substr(tt, 1, gap)')} || '^' || substr(t, gap + 1, 1) || {md('substr(qq, gap + 1)', 'substr(tt, gap + 1)')} ELSE {md('qq', 'tt')} END, "
    r"'([A-Z])0$', '\1')"
)
_MARKED = "array_to_string(list_transform(range(1, length(qq) + 1), lambda i: CASE WHEN substr(qq, i, 1) <> substr(tt, i, 1) THEN lower(substr({0}, i, 1)) ELSE substr({0}, i, 1) END), '')"


def _lines(line: str, own: str, kind: str, gap_kind: str) -> str:
    """A marked line with the gap's column: a lower-case base where the line has it, else '-'."""
    marked = _MARKED.format(line)
    spliced = lambda cut, x: f"substr({marked}, 1, {cut}) || {x} || substr({marked}, {cut} + 1)"
    return f"CASE kind WHEN '{kind}' THEN {spliced('gap - 1' if kind == 'ins' else 'gap', own)} WHEN '{gap_kind}' THEN {spliced('gap - 1' if gap_kind == 'ins' else 'gap', chr(39) + '-' + chr(39))} ELSE {marked} END"


PLACED_SEQUENCE = _lines("qq", "lower(substr(q, gap, 1))", "ins", "del")
PLACED_TARGET = _lines("tt", "lower(substr(t, gap + 1, 1))", "del", "ins")
GENE_MAP = """gene_map AS (SELECT CASE WHEN doc_id % 2 = 0 THEN contig ELSE split_part(contig, '.', 1) END AS transcript, 'G' || (doc_id % 97) AS gene FROM contigs WHERE doc_id % 5 <> 0)"""
SPECIES_MAP = "species_map AS (SELECT source AS genome, min(lang) AS species FROM documents WHERE source <> 'src7' GROUP BY source)"
KMERS = CANDIDATES + f""",
kmers AS (SELECT gene_id, "start", CAST(i AS INTEGER) AS "at", substr(seq, i, {K}) AS kmer, least(substr(seq, i, {K}), {rc(f'substr(seq, i, {K})')}) AS ckmer
  FROM (SELECT *, unnest(range(1, length(seq) - {K - 2})) AS i FROM candidates))"""
#: The k-mers of the probes (reverse-complemented or not), and the probes that share none with any contig.
SCREEN = f"""pk AS (SELECT probe_id, least(k, {rc('k')}) AS ckmer FROM (SELECT probe_id, substr(seq, i, {K}) AS k FROM (SELECT probe_id, seq, unnest(range(1, length(seq) - {K - 2})) AS i FROM probes))),
rk AS (SELECT DISTINCT least(k, {rc('k')}) AS ckmer FROM (SELECT substr(seq, p, {K}) AS k FROM (SELECT seq, unnest(range(1, length(seq) - {K - 2})) AS p FROM contigs))),
screened AS (SELECT probe_id FROM probes WHERE probe_id NOT IN (SELECT probe_id FROM pk SEMI JOIN rk USING (ckmer)))"""
COUNTS = KMERS + ", " + CONTIGS + f""",
counts AS (SELECT genome, grp, ckmer, count(*) AS cnt FROM (SELECT genome, grp, least(k, {rc('k')}) AS ckmer FROM (SELECT genome, grp, substr(seq, p, {K}) AS k
  FROM (SELECT genome, grp, seq, unnest(range(1, length(seq) - {K - 2})) AS p FROM contigs))) WHERE ckmer IN (SELECT ckmer FROM kmers) GROUP BY ALL)"""
#: The k-mers and their counts for a query that has candidates and contigs already.
MORE_COUNTS = KMERS[len(CANDIDATES) :].lstrip(", ") + COUNTS[len(KMERS + ", " + CONTIGS) :]
