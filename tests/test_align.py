"""The approximate joins against plain dynamic programming and enumeration."""

import random

import pytest

from pyspark.sql import functions as F

from strandlake.operators import align, gapped, kmers, report, scan

COMP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(COMP)[::-1]


def made(seed, letters="ACGT"):
    r = random.Random(seed)
    contigs = [(f"c{i}_1", "".join(r.choice(letters) for _ in range(r.choice((0, 5, 40, 120))))) for i in range(6)]
    probes = []
    for i in range(8):
        src = r.choice([s for _, s in contigs if len(s) >= 40])
        at = r.randrange(len(src) - 16)
        p = list(src[at : at + 16].replace("N", "A"))
        for _ in range(r.randrange(3)):
            p[r.randrange(16)] = r.choice("ACGT")
        p = "".join(p)
        probes.append((f"p{i}", rc(p) if r.random() < 0.5 else p))
    return contigs, probes


@pytest.mark.parametrize("seed,letters", [(1, "ACGT"), (2, "ACGTN"), (3, "AC")])
def test_ungapped_is_complete(spark, seed, letters):
    contigs, probes = made(seed, letters)
    want = set()
    for name, p in probes:
        for flag, q in ((0, p), (16, rc(p))):
            for c, s in contigs:
                for i in range(len(s) - 15):
                    nm = sum(a != b for a, b in zip(q, s[i : i + 16], strict=True))
                    if nm <= 2:
                        want.add((name, flag, c, i + 1, nm))
    got = align.align_ungapped(spark.createDataFrame(probes, "probe_id string, seq string"), spark.createDataFrame(contigs, "contig string, seq string"), 2, most=3).collect()
    assert sorted((r.probe_id, r.flag, r.rname, r.pos, r.nm) for r in got) == sorted(want)


def test_long_contigs_are_cut_without_loss(spark, monkeypatch):
    contigs, probes = made(5)
    frames = [spark.createDataFrame(probes, "probe_id string, seq string"), spark.createDataFrame([("c", "".join(s for _, s in contigs))], "contig string, seq string")]
    whole = align.align_ungapped(*frames, 2).collect()
    seeds = align.Seeds(sorted(probes), 2, 5)
    monkeypatch.setattr(scan, "PIECE", 64)

    class Held:
        value = seeds

    import pandas as pd

    parts = pd.concat(align._ungapped(Held, 2)(iter([align.reference(frames[1]).toPandas()])))
    assert sorted(zip(parts.probe_id, parts.flag, parts.pos, strict=True)) == sorted((r.probe_id, r.flag, r.pos) for r in whole)


def edits(q, s, e, b):
    """Fewest edits of q at the beginning of s: first and last column base against base, at most b gaps; by enumeration."""
    best = {}

    def go(i, j, cost, gaps, last):
        if cost > e or gaps > b or abs(i - j) > b:
            return
        if i == len(q):
            if last == "M":
                best[j] = min(best.get(j, 99), cost)
            return
        if j < len(s):
            go(i + 1, j + 1, cost + (q[i] != s[j] or s[j] == "N"), gaps, "M")
        if i:
            if j < len(s):
                go(i, j + 1, cost + 1, gaps + 1, "D")
            go(i + 1, j, cost + 1, gaps + 1, "I")

    go(0, 0, 0, 0, "")
    return min(best.values(), default=None)


@pytest.mark.parametrize("seed", range(6))
def test_gapped_costs_are_minimal(seed):
    r = random.Random(seed)
    for _ in range(40):
        letters = r.choice(("ACGT", "AC", "A"))
        s = "".join(r.choice(letters) for _ in range(30))
        q = list(s[4:18])
        for _ in range(r.randrange(3)):
            i = r.randrange(1, len(q) - 1)
            r.choice((lambda: q.pop(i), lambda: q.insert(i, r.choice(letters)), lambda: q.__setitem__(i, r.choice("ACGT"))))()
        q = "".join(q)
        codes, e, b = scan.encode(s.encode()), 2, 1
        import numpy as np

        starts = np.arange(len(s) - len(q) + b + 1)
        h = gapped.align(np.repeat(scan.encode(q.encode())[None], len(starts), 0), codes, starts, e, b)
        got = {i: (edits_, cigar, used) for i, edits_, cigar, used in zip(h.rows.tolist(), h.edits.tolist(), h.cigar, h.consumed.tolist(), strict=True)}
        for i in starts:
            want = edits(q, s[i:], e, b)
            if i in got:
                found, cigar, used = got[i]
                assert found == want
                import re

                ops = re.findall(r"(\d+)([MID])", cigar)
                assert sum(int(n) for n, o in ops if o in "MI") == len(q) and sum(int(n) for n, o in ops if o in "MD") == used
            elif want is not None:  # only an alignment whose leftmost form begins or ends with a gap, or spends other gaps, may be missing
                assert want > 0


def lines(*pairs):
    """Aligned columns as matrices, flush right; '-' is a gap."""
    import numpy as np

    width = max(len(q) for q, _ in pairs)
    code = lambda x: [gapped.NONE] * (width - len(x)) + ["ACGTN    -".index(c) - (c == "-") for c in x]
    return tuple(np.array([code(p[i]) for p in pairs], np.uint8) for i in (0, 1))


def test_leftmost_and_tags():
    top, bottom = lines(("CAA-G", "CAAAG"), ("CA-TGG", "CAATAG"), ("GAA-CC-T", "GAAACCCT"), ("ACGT", "ACGT"), ("TACG", "AACC"), ("CGAAAT", "CGA--T"), ("A-C", "TTC"))
    gapped.leftmost(top, bottom)
    shown = ["".join("ACGTN...-"[x] for x in row if x != gapped.NONE) for m in (top, bottom) for row in m]
    assert shown[:3] == ["C-AAG", "C-ATGG", "G-AA-CCT"] and shown[5] == "CGAAAT" and shown[12] == "CG--AT"
    assert gapped.cigars(top, bottom) == ["1M1D3M", "1M1D4M", "1M1D2M1D3M", "4M", "4M", "2M2I2M", "1M1D1M"]
    assert gapped.mds(top, bottom) == ["1^A3", "1^A2A1", "1^A2^C3", "4", "0A2C", "4", "0T0^T1"]


def test_seed_join_equals_broadcast(spark, monkeypatch):
    from collections import Counter

    from strandlake.sources import stage

    contigs, probes = made(11, "AACGT")
    probes += [("same", probes[0][1]), ("short", probes[1][1][:13]), ("poly", "A" * 16)]
    contigs += [("poly", "A" * 90 + "C" + "A" * 40), ("nothing", ""), ("low", contigs[2][1].lower())]
    p, ref = spark.createDataFrame(probes, "probe_id string, seq string"), spark.createDataFrame(contigs, "contig string, seq string")
    for bulges in (0, 1):
        run = lambda most: Counter(tuple(r) for r in align.align_gapped(p, ref, 2, bulges, most=most).collect())
        want = run(100)
        assert len(want) > 20 and run(0) == want
        with monkeypatch.context() as m:
            m.setattr(align, "SKETCH", 64)  # a full map lets all through
            assert run(0) == want
    rows = stage.keep(spark.createDataFrame([(1 if i % 3 else i, i) for i in range(4000)], "k long, i long"), "rows")
    table = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (5000, "d")], "k long, x string")
    assert sorted(map(tuple, stage.join_hot(rows, table, "k", 5).collect())) == sorted(map(tuple, rows.join(table, "k").collect()))


def test_dominance_in_bins_equals_greedy(spark):
    r = random.Random(4)
    rows = []
    for p in "ab":
        for _ in range(400):
            n = r.randrange(14, 19)
            rows.append((p, r.choice((0, 16)), "c", r.randrange(1, 1500), f"{n}M", r.randrange(4), "", "A" * 16, "A" * n))
    want = set()
    for key in {(x[0], x[1]) for x in rows}:
        kept = []
        for x in sorted((x for x in rows if x[:2] == key), key=lambda x: x[5]):
            if not any(k[5] < x[5] and k[3] < x[3] + len(x[8]) and x[3] < k[3] + len(k[8]) for k in kept):
                kept.append(x)
        want |= set(kept)
    df = spark.createDataFrame(rows, align.HITS)
    for width in (64, 1 << 16):
        got = [tuple(x) for x in align.suppress_overlaps(df, 3, width).collect()]
        assert set(got) == want and len(got) == sum(x in want for x in rows)


def test_suppression_is_by_kept_hits_only(spark):
    rows = [("p", 0, "c", 1, "5M", 0, "", "AAAAA", "AAAAA"), ("p", 0, "c", 4, "5M", 1, "", "AAAAA", "AAAAA"), ("p", 0, "c", 8, "5M", 2, "", "AAAAA", "AAAAA"), ("p", 16, "c", 4, "5M", 1, "", "AAAAA", "AAAAA")]
    got = align.suppress_overlaps(spark.createDataFrame(rows, align.HITS), 2).collect()
    assert sorted((r.flag, r.pos) for r in got) == [(0, 1), (0, 8), (16, 4)]


def test_dedup_and_cap_and_budget(spark):
    df = spark.createDataFrame([(0, "p", 0, "c", 1, "5M", 0, "5"), (1, "p", 0, "c", 1, "5M", 1, "4A0"), (2, "p", 0, "c", 9, "2M1I2M", 1, "4"), (3, "p", 0, "c", 20, "5M", 1, None)], "line int, probe_id string, flag int, rname string, pos int, cigar string, nm int, md string")
    assert sorted(r.line for r in align.dedup(df).collect()) == [0, 2, 3]
    assert sorted(r.line for r in align.within_budget(df, 1, 0).collect()) == [0, 1]
    assert [r.line for r in align.capped(df, 1).collect()] == [0] and align.capped(df, None).count() == 4


def test_kmer_counts(spark):
    contigs = spark.createDataFrame([("a", "g1", "ACGTNACGTA"), ("b", "g1", "TTTTACG"), ("c", "g2", "ac"), ("d", "g2", None)], "contig string, grp string, seq string")
    probes = spark.createDataFrame([("p", "ACGTACG")], "probe_id string, seq string")
    k = kmers.explode_kmers(probes, 4)
    want = {}
    for _, g, s in (("a", "g1", "ACGTNACGTA"), ("b", "g1", "TTTTACG")):
        for i in range(len(s) - 3):
            w = s[i : i + 4]
            if "N" not in w:
                want[(g, min(w, rc(w)))] = want.get((g, min(w, rc(w))), 0) + 1
    asked = {r.ckmer for r in k.collect()}
    got = {(r.grp, r.ckmer): r.cnt for r in kmers.count_kmers(contigs, k, 4, block=2).collect()}
    assert got == {x: n for x, n in want.items() if x[1] in asked}


def counted(contigs, k):
    want = {}
    for g, s in contigs:
        for i in range(len(s) - k + 1):
            w = s[i : i + k]
            if "N" not in w:
                want[g, min(w, rc(w))] = want.get((g, min(w, rc(w))), 0) + 1
    return want


def test_kmer_database_grows(spark, tmp_path):
    from strandlake.sources import kmer_store

    at = str(tmp_path / "db")
    rows = [("g1", "f1", "ACGTNACGTA" * 200), ("g2", "f1", "ACCCGGTTTA" * 3), ("g1", "f2", "TTTTTACGTAC"), ("g2", "f3", "AAAAAAAAAAA")]
    df = spark.createDataFrame(rows, "grp string, file string, seq string")
    wanted = spark.createDataFrame([(w,) for w in {x for k in (4, 5) for _, x in counted([(g, s) for g, _, s in rows], k)} | {"CCCCC"}], "ckmer string")
    got = lambda k, **o: {(r.grp, r.ckmer): r.cnt for r in kmer_store.lookup(spark, at, wanted.where(F.length("ckmer") == k), k, **o).collect()}
    assert got(5) == {}
    assert kmer_store.build(df.where("file = 'f1'"), [5, 4], at) == {5: 2, 4: 2}
    assert got(5) == counted([(g, s) for g, f, s in rows if f == "f1"], 5)
    assert kmer_store.build(df, [5], at) == {5: 2} and kmer_store.build(df, [5], at) == {5: 0}  # only what is new
    want = counted([(g, s) for g, _, s in rows], 5)
    assert got(5) == want and got(5, groups=["g2"]) == {x: n for x, n in want.items() if x[0] == "g2"}
    assert got(4) == counted([(g, s) for g, f, s in rows if f == "f1"], 4)
    plan = spark.read.parquet(f"{at}/counts").where("k = 5 AND code = 3")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(code), EqualTo(code,3)" in plan


@pytest.mark.parametrize("seed,letters,length", [(1, "ACGT", 24), (2, "ACGTN", 36), (3, "AC", 30), (4, "ACGT", 90)])
def test_only_alike_candidates_are_aligned(monkeypatch, seed, letters, length):
    """The scan aligns what the band's diagonals let through, not all that a seed proposes, and loses nothing, in one contig or several, in pieces or not."""
    import numpy as np
    import pandas as pd

    r = random.Random(seed)
    contigs = [(f"c{i}", "".join(r.choice(letters) for _ in range(r.choice((0, 3, length - 1, 200, 900))))) for i in range(30)]
    probes = []
    for i in range(40):
        src = r.choice([s for _, s in contigs if len(s) >= 200])
        at = r.randrange(len(src) - length)
        p = list(src[at : at + length].replace("N", "A"))
        for _ in range(r.randrange(3)):
            j = r.randrange(len(p))
            p[j : j + 1] = r.choice(([], [p[j], r.choice("ACGT")], [r.choice("ACGT")]))
        p = "".join(p)
        probes.append((f"p{i}", rc(p) if r.random() < 0.5 else p))
    whole = align.Seeds(probes, 2, min(min(len(p) for _, p in probes) // 3, 31))
    want = set()
    for c, s in contigs:
        if not s:
            continue
        codes = scan.encode(s.encode())
        for q, (name, flag, p) in enumerate(zip(whole.names, whole.flags, whole.seqs, strict=True)):
            start = np.arange(max(len(s) - len(p) + 2, 0))
            h = gapped.align(np.repeat(whole.matrix[q : q + 1, : len(p)], len(start), 0), codes, start, 2, 1)
            want |= {(name, flag, c, int(start[j]) + 1, cigar, int(nm), md, p, s[start[j] : start[j] + used]) for j, nm, cigar, md, used in zip(h.rows, h.edits, h.cigar, h.md, h.consumed, strict=True)}
    given, plain = [], gapped.align
    monkeypatch.setattr(gapped, "align", lambda queries, *a: given.append(len(queries)) or plain(queries, *a))

    class Held:
        value = whole

    frame = pd.DataFrame({"contig": [c for c, _ in contigs], "at": 0, "own": [len(s) for _, s in contigs], "seq": [s for _, s in contigs]})
    for base, piece in ((1 << 18, 1 << 20), (700, 1 << 20), (100, 128)):
        monkeypatch.setattr(align, "BASES", base)
        monkeypatch.setattr(align, "POSTS", 50)
        monkeypatch.setattr(scan, "PIECE", piece)
        given.clear()
        got = pd.concat(list(align._gapped(Held, 2, 1)(iter([frame]))))
        have = {tuple(x) for x in got.itertuples(index=False)}
        assert have == want and len(got) == len(want) and want
        assert letters == "AC" or sum(given) <= 2.5 * len(want) + 10


def test_view_reads_its_tags_once(spark):
    """CIGAR and MD are taken apart once for an alignment, not again for each of its columns."""
    from strandlake.functions.view import gapped_view

    df = spark.createDataFrame([("ACGTACG", "3M1I3M", "2A3"), ("ACGTACG", "2M1D5M", "2^C5"), ("ACG", None, "3")], "seq string, cigar string, md string")
    out = df.select(gapped_view(F.col("seq"), F.col("cigar"), F.col("md")).alias("v"))
    assert [r.v and tuple(r.v) for r in out.collect()] == [("ACgtACG", "ACa-ACG"), ("AC-GTACG", "ACcGTACG"), None]
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") <= 6


def test_counts_leave_a_task_in_parts(monkeypatch):
    """A batch's k-mers are never held all at once, however many sequences it has."""
    import pyarrow as pa

    from strandlake.sources import kmer_store

    r = random.Random(4)
    rows = [(r.choice(("g1", "g2", None)), "".join(r.choice("ACGTN") for _ in range(r.choice((0, 3, 50, 700))))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.string())], names=["grp", "seq"])
    for name, value in (("HELD", 5000), ("MERGED", 900), ("GIVEN", 400), ("STEP", 333)):
        monkeypatch.setattr(kmer_store, name, value)
    monkeypatch.setattr(scan, "PIECE", 1000)
    for k in (2, 7, 31):
        want = counted(rows, k)
        parts = list(kmers.counter(k, None, 1)(iter([batch])))
        assert max(p.num_rows for p in parts) <= 2000
        found = {}
        for p in parts:
            for g, c, n in zip(*(x.to_pylist() for x in p.columns), strict=True):
                found[g, scan.sequence_of(c, k)] = found.get((g, scan.sequence_of(c, k)), 0) + n
        assert found == want
        sent = pa.Table.from_batches(kmer_store._counted(k)(iter([batch.slice(0, 170), batch.slice(170)])))
        merged = list(kmer_store._merged(k)(iter(sent.sort_by([("grp", "ascending"), ("slice", "ascending")]).combine_chunks().to_batches(max_chunksize=7))))
        got = [x for p in merged for x in zip(*(c.to_pylist() for c in p.columns), strict=True)]
        assert {(g, scan.sequence_of(c, k)): n for g, c, n in got} == want and len(got) == len(want) and max(p.num_rows for p in merged) <= 400
        assert [x[:2] for x in got] == sorted((x[:2] for x in got), key=lambda x: (x[0] is None, x[0] or "", x[1]))


def test_packed_numbers():
    import numpy as np

    from strandlake.sources import kmer_store

    x = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 2**62 - 1, 5], np.int64)
    data, at = kmer_store.pack(x)
    back, begin = kmer_store.unpack(data)
    assert back.tolist() == x.tolist() and begin.tolist() == at[:-1].tolist()
    assert kmer_store.unpack(kmer_store.pack(x[:0])[0])[0].tolist() == []


def test_one_scan_gives_both(spark, monkeypatch):
    contigs, probes = made(7)
    ref = spark.createDataFrame([(c, f"g{i % 2}", s) for i, (c, s) in enumerate(contigs)], "contig string, grp string, seq string")
    p = spark.createDataFrame(probes, "probe_id string, seq string")
    words = kmers.explode_kmers(p, 5)
    want = sorted(map(tuple, align.align_ungapped(p, ref, 2).collect())), sorted(map(tuple, kmers.count_kmers(ref, words, 5).collect()))
    assert want[0] and want[1]
    for size in (align.PROBES, 3):  # in one scan, and apart
        monkeypatch.setattr(align, "PROBES", size)
        hits, counts = align.align_and_count(p, words, ref, 2, 5)
        assert (sorted(map(tuple, hits.collect())), sorted(map(tuple, counts.collect()))) == want


def test_wanted_kmers_beyond_the_block_are_joined(spark):
    contigs, probes = made(8)
    ref = spark.createDataFrame([(c, "g", s) for c, s in contigs], "contig string, grp string, seq string")
    words = kmers.explode_kmers(spark.createDataFrame(probes, "probe_id string, seq string"), 6)
    few, many = (sorted(map(tuple, kmers.count_kmers(ref, words, 6, block=b).collect())) for b in (10**6, 1))
    assert few == many and few


def test_off_target_hits(spark):
    hits = spark.createDataFrame([("j", "X_1|p", "T1.1", "G1"), ("j", "X_1|p", "T2", "G2"), ("j", "X_1|p", "T9.3", "G9"), ("k", "X_1|p", "X_7", "X_7")], "job string, probe_id string, rname string, gene_id string")
    sources = spark.createDataFrame([("j", "G2", ["T1.2"])], "job string, source_gene string, sources array<string>")
    assert sorted(r.rname for r in report.off_target(hits, sources).collect()) == ["T9.3", "X_7"]
    assert sorted(r.rname for r in report.off_target(hits.withColumn("probe_id", F.lit("X|p")), None, genome_self=True).collect()) == ["T1.1", "T2", "T9.3"]
