"""The pipeline's stages on a small corpus: each decision takes effect, and clean documents stay."""

import random

import brute


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        text = f"{say(40)}\nshared footer of the site"
        bad = i % 5 == 0
        if bad:
            text = " ".join([w + (" scumbag" if k % 6 == 0 else "") for k, w in enumerate(text.split(" "))])
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
        labels.append((i, 1, int(bad)))
    near = say(60).split()
    for i in range(6):
        w = list(near)
        w[i] = "changed"
        rows.append((500 + i, " ".join(w), "en", "s1", 0))
    rows += [(600, f"{say(30)} password = 'abcdefghij'", "en", "s0", 0), (601, None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    for name, _ in P.STAGES[:-1]:
        assert tuple(seen[name].columns) == P.COLUMNS
    ids = {n: {x.doc_id for x in d.collect()} for n, d in seen.items()}
    assert ids["toxicity"] == {i for i, *_ in rows if not (i < 300 and i % 5 == 0)}
    assert ids["line_dedup"] == ids["toxicity"]
    assert not any("footer" in (x.text or "") for x in seen["line_dedup"].collect())
    links = brute.jaccard_components([(x.doc_id, x.text) for x in seen["line_dedup"].collect()])
    assert ids["ngram_jaccard_join"] == {d for d, (_, c) in links.items() if d == c} and not ids["ngram_jaccard_join"] & {501, 502, 503, 504, 505}
    assert ids["secret_scans"] == ids["ngram_jaccard_join"] == ids["best_fit_packing"]
    clean = {x.doc_id: x for x in seen["secret_scans"].collect()}
    assert clean[600].text.endswith("[SECRET]'") and clean[600].n_chars == len(clean[600].text) and clean[601].text is None
    total = P.run(spark, str(tmp_path))
    assert {(x.doc_id, x.piece, x.ids_crc32) for x in total.collect()} == {(x.doc_id, x.piece, x.ids_crc32) for x in docs.collect()}
