import json

import pytest
from pyspark.sql import functions as F

from strandlake.operators import annotate, classify, report, tiling
from strandlake.sources import annotation, fasta, registry, reports, sam


def test_fasta_faults():
    assert fasta.parse(">a b\nac\n\nGT\n>c\nN") == [("a b", "ACGT"), ("c", "N")]
    for text, fault in ((">\nA", "empty header"), (">a\n>b\nA", "no sequence"), (">a\nAXG", "line 2"), ("", "no sequences"), ("A", "before any header"), (">a\n", "no sequence"), (">a\nAUG", "letters")):
        with pytest.raises(ValueError, match=fault):
            fasta.parse(text)
    with pytest.raises(ValueError, match="fewer"):
        fasta.one_gene(">a\nACG", 36)


def test_fasta_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">AC_1 first\nacgt\nAC\n>AC_2\n\n>AC_3\r\nGG\r\n")
    (tmp_path / "y.txt").write_text(">no\nA\n")
    got = sorted((r.contig, r.genome, r.grp, r.seq) for r in fasta.contigs(spark, {"g": str(tmp_path)}).collect())
    assert got == [("AC_1", "AC", "g", "ACGTAC"), ("AC_3", "AC", "g", "GG")]
    fasta.write(spark.createDataFrame([("p2", "CC"), ("p1", "ACGTA")], "probe_id string, seq string"), str(tmp_path / "out"), order=["probe_id"], width=4)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    assert text == ">p1\nACGT\nA\n>p2\nCC\n"
    assert fasta.index_line("ref", 100) == "ref\t100\t5\t80\t81"


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.gtf").write_text('#x\n1\tx\texon\t1\t2\t.\t+\t.\ttranscript_id "T1.1"; gene_name "G1";\n1\tx\texon\t1\t2\t.\t+\t.\ttranscript_id "T1.1"; gene_name "G2";\n')
    assert [tuple(r) for r in annotation.gtf_genes(spark, str(tmp_path / "a.gtf")).collect()] == [("T1.1", "G2")]
    row = lambda t, a: f"1\tx\t{t}\t1\t2\t.\t+\t.\t{a}\n"
    (tmp_path / "a.gff3").write_text("##gff\n" + row("gene", "ID=gene:g1;Name=N1") + row("gene", "ID=gene:g2") + row("mRNA", "ID=transcript:t1;Parent=gene:g1") + row("mRNA", "ID=transcript:t2;Parent=gene:g2") + row("mRNA", "ID=t3;Parent=gene:g9") + row("exon", "ID=e;Parent=t1"))
    assert sorted(tuple(r) for r in annotation.gff3_genes(spark, str(tmp_path / "a.gff3")).collect()) == [("t1", "N1"), ("t2", "g2"), ("t3", "g9")]
    (tmp_path / "m.tsv").write_text("\t".join(f"c{i}" for i in range(15)) + "\n" + "\t".join(["MG1"] + ["x"] * 13 + ["d__B;s__Some species"]) + "\n")
    assert [tuple(r) for r in annotation.genome_species(spark, str(tmp_path / "m.tsv")).collect()] == [("MG1", "Some species")]
    (tmp_path / "r.tsv").write_text("acc\tsym\tsp\nNM_1\tA\thuman\nNM_1\tB\thuman\nNM_2\tC\nNM_4\t\n")
    (tmp_path / "s.tsv").write_text("#Acc\tsym\tsp\nNM_1\tD\thuman\nNM_3\tE\n")
    got = sorted(tuple(r) for r in annotation.refseq(spark, str(tmp_path / "[rs].tsv"), header="acc").collect())
    assert got == [("NM_1", "A", "human"), ("NM_2", "C", None), ("NM_3", "E", None)]
    assert annotation.latest_release(["g.v9.gtf", "g.v10.gtf", "x"], r"v(\d+)\.gtf") == 10 and annotation.latest_release([], "x") is None
    genes = lambda: annotation.gtf_genes(spark, str(tmp_path / "a.gtf"))
    assert annotation.cached_genes(spark, genes, 9, str(tmp_path / "cache")).count() == 1
    assert annotation.cached_genes(spark, lambda: 1 / 0, 9, str(tmp_path / "cache")).count() == 1


def test_sam_layouts(spark, tmp_path):
    tail = "255\t4M\t*\t0\t0\t{}\tIIII\tNM:i:1\tMD:Z:2A1"
    (tmp_path / "x.sam").write_text("@HD\n" + "p\t0\tT1.1\t7\t" + tail.format("ACGT") + "\np\t16\tT2\tGENE\t9\t" + tail.format("*") + "\tSP:Z:Some species\nshort\t0\n")
    got = sam.read(spark, str(tmp_path / "x.sam")).orderBy("line").collect()
    assert [(r.probe_id, r.rname, r.gene_id, r.pos, r.seq, r.nm, r.md, r.species) for r in got] == [("p", "T1.1", None, 7, "ACGT", 1, "2A1", None), ("p", "T2", "GENE", 9, "ACGT", 1, "2A1", "Some species")]
    lines = report.sam_lines(sam.read(spark, str(tmp_path / "x.sam")).where("gene_id IS NULL").drop("gene_id", "species"))
    sam.write(lines, str(tmp_path / "out"))
    again = sam.read(spark, str(tmp_path / "out")).collect()
    assert [(r.probe_id, r.pos, r.cigar, r.nm) for r in again] == [("p", 7, "4M", 1)]


def test_registry(spark):
    data = {"hosts": [{"id": "human", "display_name": "Human", "latin_binomial": "Homo sapiens", "ncbi_tax_id": 9606, "default": True, "transcript_id_prefixes": ["ENST"], "microbiomes": [{"id": "gut", "display_name": "Gut"}]}, {"id": "chicken", "display_name": "Chicken", "latin_binomial": "Gallus gallus", "ncbi_tax_id": 9031, "transcript_id_prefixes": ["ENSGALT", "ENS"]}]}
    r = registry.Registry.build(data)
    assert r.by_transcript("ENSGALT1").id == "chicken" and r.by_transcript("ENST1").id == "human" and r.by_transcript("X") is None
    assert r.by_binomial("homo SAPIENS").id == "human" and r.by_tax_id("9031").id == "chicken" and r.by_tax_id("x") is None
    assert r.host_of("gut").id == "human" and r.is_microbiome("gut") and not r.is_host("gut") and r.default_host().id == "human"
    json.dumps(r.to_dict())
    hits = spark.createDataFrame([("ENST1",), ("ENSGALT1",), ("ZZ",)], "rname string")
    assert {x.rname: x.host for x in annotate.host_of(hits, r.prefixes(spark), "rname", "host").collect()} == {"ENST1": "human", "ENSGALT1": "chicken", "ZZ": None}


def test_gff3_round_trip(spark, tmp_path):
    feats = spark.createDataFrame([("probe_2|x", 9, 44, "high_risk", 1, "mismatch"), ("probe_1|x", 3, 38, "safe", None, None)], "probe_id string, start int, end int, status string, mismatches int, reason string")
    reports.write_gff3(report.gff3_lines(feats, F.lit("ref")), str(tmp_path / "g"), "ref", 100)
    text = "".join(p.read_text() for p in sorted((tmp_path / "g").glob("part*"))).splitlines()
    assert text[:2] == ["##gff-version 3", "##sequence-region ref 1 100"] and text[2].split("\t")[3] == "3"
    got = reports.risks_of(reports.read_gff3(spark, str(tmp_path / "g"))).collect()
    assert sorted(tuple(r) for r in got) == [("probe_1", "safe", None, "Safe: No off-target alignments"), ("probe_2", "high_risk", 1, "High risk: 1 mismatch(es)")]
    reports.write_json(feats.select("probe_id"), str(tmp_path / "j"))
    assert reports.read_json(spark, str(tmp_path / "j"), "probe_id string").count() == 2
    reports.write_table(feats, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 2


def test_microbiome_classes(spark):
    rows = [("j", "p1|X_1", "X_1", "X_1", 0, "A"), ("j", "p2|X_1", "X_1", "X_1", 0, "A"), ("j", "p2|X_1", "Y_1", "Y_1", 2, "B"), ("j", "p3|X_1", "Y_1", "Y_1", 1, "B")]
    hits = spark.createDataFrame(rows, "job string, probe_id string, rname string, gene_id string, nm int, species string")
    got = {r.probe_id[:2]: (r.status, r.min_mismatches) for r in classify.classify(hits, is_microbiome=True).collect()}
    assert got == {"p1": ("safe", 0), "p2": ("high_risk", 0), "p3": ("high_risk", 1)}
    src = classify.infer_source(hits, is_microbiome=True)
    got = {r.probe_id[:2]: (r.status, r.min_mismatches) for r in classify.classify(hits, src, is_microbiome=True).collect()}
    assert got == {"p1": ("safe", 0), "p2": ("medium_risk", 2), "p3": ("high_risk", 1)}


def test_verdicts_and_checks(spark):
    found = spark.createDataFrame([("a", "human"), ("b", "human"), ("b", "mouse")], "gene_id string, species string")
    v = lambda **k: {r.gene_id: r.verdict for r in annotate.verdict(found, **k).collect()}
    assert v(wanted="human", hosts=("human", "mouse")) == {"a": "host_internal", "b": "block"}
    assert v(wanted="mouse", hosts=("human", "mouse"))["a"] == "block" and v(is_microbiome=True)["b"] == "allow" and v()["a"] == "block"
    tiling.check_lengths(20, 36, 14, 3, 1)
    for bad in ((10, 36, 14, 3, 1), (20, 36, 21, 3, 1), (20, 36, 14, 1, 2)):
        with pytest.raises(ValueError):
            tiling.check_lengths(*bad)


def test_streamed_probes(spark, tmp_path):
    from strandlake.streaming import probes as P

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">p1\nCGCGACAGCCGTACCGGCGTGTACATCGGAGTGATC\n>p2\nAAAAAACAGCCGTACCGGCGTGTACATCGGAGTGAT\n")
    counts = spark.createDataFrame([("g", "CGCGACAGCCGTACCG", 2)], "grp string, ckmer string, cnt long")
    seen = []
    stream = P.read_probes(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda df, _: seen.extend(P.screen(df, counts, 16, tm=None).collect()))
    stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.probe_id, r.hits) for r in seen] == [("p1", 1)]


def test_views_and_filters(spark):
    from strandlake.functions.view import gapped_view

    rows = [("ACGTACGT", "8M", "0T4N1A0"), ("ACGGT", "2M1I2M", "1T2"), ("ACGT", "2M2D2M", "2^TT1A"), ("ACGT", "2M1D2M", "1T0^C0A1"), (None, "4M", "4"), ("ACGT", "4M", None), ("ACGT", "", "4")]
    v = spark.createDataFrame(rows, "seq string, cigar string, md string").select(gapped_view(F.col("seq"), F.col("cigar"), F.col("md")).alias("v"))
    assert [tuple(r.v) if r.v else None for r in v.collect()] == [("aCGTAcGt", "tCGTAnGa"), ("AcgGT", "At-GT"), ("AC--Gt", "ACttGa"), ("Ac-gT", "AtcaT"), None, None, None]
    df = spark.createDataFrame([("p", 0, "c", 4, "2M1I2M", 2, "1T2", "ACGGT", "ATGT")], "probe_id string, flag int, rname string, pos int, cigar string, nm int, md string, seq string, target string")
    r = report.gapped_records(df).first()
    assert (r.sequence, r.target_sequence, r.substitutions, r.bulges, r.strand) == ("AcgGT", "At-GT", 1, 1, "+")
    m = spark.createDataFrame([(1, 45.26, 50.0), (2, 44.0, 60.0)], "i int, tm double, gc double")
    assert [x.i for x in report.metric_filter(m, tm="45.3").collect()] == [1] and [x.i for x in report.metric_filter(m, tm=(40.0, 50.0), gc=(55.0, 65.0)).collect()] == [2]
    assert report.identity_pct(36, 2) == 94
    assert annotation.check_host(["g.v9.fa"], ["a.fa"], r"v(\d+)") == 9
    for args in (([], ["a.fa"]), (["g.v9.fa"], ["x"])):
        with pytest.raises(ValueError):
            annotation.check_host(*args, r"v(\d+)")
