"""References in pieces, indexed FASTA, stored pages, regions and genome names at sizes that split."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import align, intervals, kmers
from strandlake.plans import design
from strandlake.sources import alignment_store, fasta, pieces, registry


def made(n, seed=1):
    r = random.Random(seed)
    return "".join(r.choice("ACGTN") for _ in range(n))


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


TEXT = "lost bases\nACGT\n>one first record\n" + "\n".join(made(60, i) for i in range(40)) + "\n>two\n>three\nacgtn\r\nAC GT\n\n>four\tx\n" + made(700, 99) + "\n>five\n" + "\n".join(made(7, i) for i in range(90)) + "\n>last"


def records(text):
    out = {}
    for part in text.split("\n>")[1:]:
        head, _, body = part.partition("\n")
        if body.split():
            out[head.split()[0]] = "".join(body.split()).upper()
    return out


@pytest.mark.parametrize("split", [50, 97, 700, 10**6])
@pytest.mark.parametrize("piece,overlap", [(64, 0), (64, 30), (33, 200), (10**6, 5)])
def test_pieces_of_records_over_splits(spark, tmp_path, small_splits, split, piece, overlap):
    (tmp_path / "a.fa").write_text(TEXT)
    (tmp_path / "b.fna").write_text(">b1\n" + made(300, 7) + "\n")
    small_splits(split)
    df = pieces.read(spark, str(tmp_path), overlap, piece)
    want = records(TEXT) | {"b1": made(300, 7)}
    got = {}
    for r in df.collect():
        whole = want[r.contig]
        assert r.seq == whole[r.at : r.at + r.own + overlap][: len(r.seq)] and len(r.seq) == min(r.own + overlap, len(whole) - r.at) and 0 < r.own <= piece + overlap
        assert r.file.endswith("b.fna" if r.contig == "b1" else "a.fa")
        got.setdefault(r.contig, []).append((r.at, r.own))
    assert set(got) == set(want)
    for name, parts in got.items():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) == len(want[name])


def test_one_long_record_runs_in_several_tasks(spark, tmp_path, small_splits):
    import numpy as np

    bases = np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(1).integers(0, 4, 20_000_000)].tobytes()
    with open(tmp_path / "chr.fa", "wb") as f:
        f.write(b">chr1 one record\n" + b"\n".join(bases[i : i + 80] for i in range(0, len(bases), 80)) + b"\n")
    small_splits(2 << 20)
    ref = pieces.contigs(spark, {"host": str(tmp_path)}, overlap=64)
    assert ref.rdd.getNumPartitions() >= 9
    tasks = ref.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("own").alias("n")).collect()
    assert len(tasks) >= 9 and sum(r.n for r in tasks) == len(bases)
    places = [0, 4_194_280, 9_999_990, 2 * 2**20 - 17, 19_999_964]
    probes = spark.createDataFrame([(f"p{a}", bases[a : a + 36].decode()) for a in places], "probe_id string, seq string")
    assert sorted((r.probe_id, r.pos - 1) for r in align.align_ungapped(probes, ref, 1).where("nm = 0 AND flag = 0").collect()) == sorted((f"p{a}", a) for a in places)
    whole = spark.createDataFrame([("chr1", "host", bases[:3_000_000].decode())], "contig string, grp string, seq string")
    words = kmers.explode_kmers(probes, 9)
    (tmp_path / "part").mkdir()
    (tmp_path / "part" / "x.fa").write_bytes(b">chr1\n" + b"\n".join(bases[i : i + 70] for i in range(0, 3_000_000, 70))[: 3_000_000 + 3_000_000 // 70] + b"\n")
    cut = pieces.contigs(spark, {"host": str(tmp_path / "part")}, overlap=64, piece=1 << 18)
    n = cut.agg(F.sum("own")).first()[0]
    whole = whole.withColumn("seq", F.substring("seq", 1, n))
    assert sorted(map(tuple, kmers.count_kmers(cut, words, 9).collect())) == sorted(map(tuple, kmers.count_kmers(whole, words, 9).collect()))


def test_fetch_equals_substr(spark, tmp_path):
    r = random.Random(3)
    recs = {f"rec{i}|é" if i % 3 else f"r{i}": made(r.choice((0, 1, 79, 80, 81, 160, 500)), i) for i in range(40)}
    df = spark.createDataFrame(list(recs.items()), "probe_id string, seq string")
    index = fasta.write_indexed(df, str(tmp_path / "x"), files=3)
    asked = [(n, r.randrange(-3, 500), r.randrange(0, 520)) for n in recs for _ in range(6)]
    got = fasta.fetch(index, spark.createDataFrame(asked, "name string, lo int, hi int"))
    want = sorted((n, a, b, recs[n][max(a - 1, 0) : max(b, 0)]) for n, a, b in asked)
    assert sorted(map(tuple, got.collect())) == want
    back = fasta.read(spark, str(tmp_path / "x" / "fasta" / "*"), "*")
    assert {x.header: x.seq for x in back.collect()} == {n: s for n, s in recs.items() if s}
    fai = {line.value.split("\t")[0]: line.value.split("\t")[1:] for line in spark.read.text(str(tmp_path / "x" / "fai")).collect()}
    assert fai["r0"][0] == str(len(recs["r0"])) and all(x[2:] == ["80", "81"] for x in fai.values())


def test_pages_read_few_parts(spark, tmp_path):
    rows = [(f"p{i % 5}" if i % 2 else "hot", f"c{i % 7}", i, 16 * (i % 2), i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "probe_id string, rname string, pos int, flag int, nm int")
    at = str(tmp_path / "store")
    alignment_store.write(df, at, files=8)
    every = sorted(rows, key=lambda x: (x[0], x[1], x[2], x[3]))
    assert alignment_store.total(spark, at) == 1000
    for number, size in ((1, 50), (7, 33), (20, 50), (21, 50), (31, 33)):
        got = alignment_store.page(spark, at, number, size)
        assert [tuple(r)[:5] for r in got.collect()] == every[(number - 1) * size : number * size]
        assert len({r.part for r in got.collect()}) <= 2 and len(got.inputFiles()) <= 2
    one = alignment_store.of_probe(spark, at, "p3")
    assert sorted(tuple(r)[:5] for r in one.collect()) == [x for x in every if x[0] == "p3"] and len(one.inputFiles()) < 8
    assert alignment_store.of_probe(spark, at, "zz").collect() == []
    with pytest.raises(ValueError):
        alignment_store.page(spark, at, 0, 5)


def test_regions_equal_comparison(spark):
    r = random.Random(8)
    feats = [(f"f{i}", r.choice("ab"), s, s + r.choice((0, 35, 255, 300, 70_000, 3_000_000))) for i in range(300) for s in [r.randrange(1, 5_000_000)]]
    regs = [(f"r{i}", r.choice("abz"), s, s + r.choice((-5, 0, 100, 20_000, 400_000))) for i in range(60) for s in [r.randrange(1, 5_000_000)]] + [("all", "a", 1, 2**30)]
    f = spark.createDataFrame(feats, "probe_id string, chrom string, start long, end long")
    got = intervals.in_regions(f, spark.createDataFrame(regs, "region string, chrom string, lo long, hi long"), "chrom")
    want = sorted((g, *x) for x in feats for g, c, lo, hi in regs if c == x[1] and lo <= hi and x[2] <= hi and x[3] >= lo)
    assert sorted((x.region, x.probe_id, x.chrom, x.start, x.end) for x in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_own_genome_with_underscores(spark):
    """A probe of genome AC_7 is judged by AC_7's contigs in the classes and in the k-mer screen alike."""
    a, b = made(200, 21).replace("N", "A"), made(200, 22).replace("N", "C")
    contigs = spark.createDataFrame([("AC_7_1", "g", a), ("AC_8_1", "g", b), ("AC_70_1", "g", made(90, 23))], "contig string, grp string, seq string")
    probes = spark.createDataFrame([("AC_7", a[10:46]), ("AC_8", a[60:96]), ("AC", b[50:86])], "probe_id string, seq string")
    last = probes.withColumn("line", F.when(F.col("probe_id") == "AC", 1).otherwise(0))
    for ref in (contigs, contigs.withColumn("genome", F.lit("AC"))):
        d = design.of_probes(last, ref, design.Options(gc=None, tm=None, is_microbiome=True))
        assert {r.probe_id: r.status for r in d.statuses.collect()} == {"AC_7": "safe", "AC_8": "high_risk", "AC": "safe"}
        assert {r.probe_id for r in d.safe.collect()} == {"AC_7"}  # AC_8_1 is AC_8's, so AC's probe lies on another genome
    d = design.of_probes(probes, contigs, design.Options(gc=None, tm=None, is_microbiome=True))
    assert {r.probe_id for r in d.safe.collect()} == {"AC"}  # the first of the names that fit takes the contigs


def test_has_genome():
    host = {"id": "h", "display_name": "H", "latin_binomial": "H h", "ncbi_tax_id": 1, "transcript_chunks_dir": "x"}
    assert not registry.Registry.build({"hosts": [host]}).hosts["h"].has_genome
    assert registry.Registry.build({"hosts": [host | {"genome_dir": "d", "genome_file_regex": ".*"}]}).hosts["h"].has_genome


def test_chunks_by_kind(spark, tmp_path):
    for name in ("a.fa", "b.fna", "c.fasta", "d.txt"):
        (tmp_path / name).write_text(f">{name}\nACGT\n")
    for read in (lambda kind: fasta.contigs(spark, {"g": str(tmp_path)}, kind=kind), lambda kind: pieces.contigs(spark, {"g": str(tmp_path)}, overlap=3, kind=kind)):
        assert {k: {r.contig for r in read(k).collect()} for k in ("host", "microbiome", None)} == {"host": {"a.fa"}, "microbiome": {"b.fna"}, None: {"a.fa", "b.fna", "c.fasta"}}
