
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import ids as I
from strandlake.functions import seq as S
from strandlake.functions import tags
from strandlake.functions.structure import free_energies

GOLDEN = [("CGCGACAGCCGTACCGGCGTGTACATCGGAGTGATC", 49.20, 63.9, 0.971), ("CACGGACGCGCCGATCGCGGTCGTCGGACTGTCCTG", 53.06, 72.2, 0.922)]


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "s string").select(*cols).first()


def test_golden_metrics(spark):
    for seq, tm, gc, complexity in GOLDEN:
        s = F.col("s")
        r = one(spark, seq, S.tm_nn(s), S.gc_percent(s), S.complexity(s), S.homopolymer(s))
        assert (round(r[0], 2), round(r[1], 1), round(r[2], 3), r[3]) == (tm, gc, complexity, False)


def test_edges_of_scalars(spark):
    s = F.col("s")
    assert tuple(one(spark, "", S.gc_percent(s), S.complexity(s), S.tm_nn(s), S.gc_label(s))) == (0.0, 0.0, None, "")
    assert one(spark, "acgtnxACGT", S.revcomp(s))[0] == "ACGTNNACGT"
    assert one(spark, "ACGTN", S.tm_nn(s))[0] is None
    assert one(spark, None, S.revcomp(s), S.gc_percent(s))[0] is None
    assert one(spark, "ACGTA", S.windows(s, 6))[0] == []
    assert [tuple(x) for x in one(spark, "ACGTAC", S.windows(s, 4, 2))[0]] == [(1, "ACGT"), (3, "GTAC")]
    assert one(spark, "AAAAACG", S.homopolymer(s))[0] and not one(spark, "AAAACG", S.homopolymer(s))[0]
    assert one(spark, "G-C-AT", S.gc_label(s))[0] == "50.0%"


def test_identifiers(spark):
    s = F.col("s")
    assert one(spark, "AC_contig_1", I.same_genome(F.lit("AC"), s))[0] and not one(spark, "ACX_contig_1", I.same_genome(F.lit("AC"), s))[0]
    assert not one(spark, "x", I.same_genome(F.lit(""), s))[0]
    assert one(spark, "T1.2", I.strip_version(s))[0] == "T1"
    assert one(spark, "lcl|NM_1.2 (x;y)[z]", I.header_tokens(s))[0] == ["lcl", "NM_1.2", "x", "y", "z"]
    assert one(spark, "NM_1.2", I.token_candidates(s))[0] == ["NM_1.2", "NM_1", "NM", "1.2"]
    assert one(spark, "of mus  musculus, x", I.binomial(s, ["Homo sapiens", "Mus musculus"]))[0] == "mus  musculus"
    assert tuple(one(spark, "probe_3|start=4|end=39|g", I.field(s, "start"), I.field(s, "end"), I.base_id(s))) == (4, 39, "probe_3")
    assert I.range_of("42-47", 10, 100) == (42, 47) and I.range_of("45", 10, 100) == (45, 45)
    assert [one(spark, x, I.label(s, F.lit("t")))[0] for x in ("Unknown", None, "g")] == ["t", "t", "g"]


def test_tags(spark):
    s = F.col("s")
    assert [tuple(x) for x in one(spark, "2M1I17M", tags.cigar_ops(s))[0]] == [(2, "M"), (1, "I"), (17, "M")]
    assert one(spark, "2M1I17M3D", tags.bulges(s))[0] == 4
    assert [one(spark, m, tags.substitutions(s))[0] for m in ("28C1", "30", "14C6A14", "3^AC2T0")] == [1, 0, 2, 1]
    q, t = "ACGTACGT", "TCGTANGA"
    assert one(spark, q, tags.md_ungapped(s, F.lit(t)), tags.marked(s, F.lit(t)))[:] == ("0T4N1A0", "aCGTAcGt")
    assert one(spark, q, tags.target_of(s, F.lit("0T4N1A0")))[0] == "tCGTAnGa"


def test_structure():
    got = free_energies(["A" * 30, "GCGCGCTTTTGCGCGC", "ACGN" * 5, "GCGCGCTTTTGCGCGC"]).tolist()
    assert got[0] == 0.0 and got[1] < -5 and got[2] == 0.0 and got[1] == got[3]


@settings(max_examples=30, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=40))
def test_reverse_complement_codes(seq):
    from strandlake.operators import scan

    k = min(len(seq), 31)
    w, ok = scan.window_codes(scan.encode(seq.encode()), k)
    assert ok.all() and [scan.sequence_of(int(x), k) for x in w] == [seq[i : i + k] for i in range(len(seq) - k + 1)]
    comp = str.maketrans("ACGT", "TGCA")
    assert [scan.sequence_of(int(x), k) for x in scan.revcomp_codes(w, k)] == [seq[i : i + k].translate(comp)[::-1] for i in range(len(seq) - k + 1)]
