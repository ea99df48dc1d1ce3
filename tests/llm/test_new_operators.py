"""Importance resampling, spelling variants and packing by differencing against plain re-statements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest

from strandlake.llm import differencing, entry, importance, spelling

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def lowered(text):
    return (text or "").encode().lower().decode()  # A-Z only


def sampled(rows, target, percent=5, least=20, buckets=10000):
    """doc_id, n_features, weight, score, rank by the definition."""

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)}
    out = []
    for d, text in rows:
        n, f = features(text)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in out)


def test_op11(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert Counter(map(tuple, entry.op11_importance_resampling(spark, sf).collect())) == sampled(rows, target)


@pytest.mark.parametrize("percent", [0, 30, 100])
def test_resample_odd_rows(spark, docs, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = spark.createDataFrame([(None,), ("",), ("All rights reserved a b",), ("x" * 300 + " y z",)], "text string")
    got = importance.resample(docs, target, percent=percent, least_words=3)
    assert Counter(map(tuple, got.collect())) == sampled(rows, [r.text for r in target.collect()], percent, 3)
    assert importance.resample(docs.where("false"), target).collect() == []
    assert {r.weight for r in importance.resample(docs.limit(1), target.where("false"), percent=percent).collect()} is not None


def test_features_of_long_words():
    texts = ["a " + "b" * 254 + " c", "é" * 200 + " x " + "y" * 256 + " z Q", "", "one", "one-two", "d" * 1000 + " " + "e" * 255]
    bucket, of, words = importance.features([t.encode() for t in texts], 1 << 20)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        assert words[i] == len(w)
        assert Counter(bucket[of == i].tolist()) == Counter(zlib.crc32(" ".join(w[j : j + n]).encode()) % (1 << 20) for n in (1, 2, 3) for j in range(len(w) - n + 1))


def test_cutoff(spark):
    r = random.Random(5)
    keys = [(r.choice([-3, 0, 0, 0, 7, 10**15]), r.randrange(40), i) for i in range(2000)]
    df = spark.createDataFrame(keys, "a long, b long, c long").repartition(7)
    for take in (1, 2, 777, 1999, 2000):
        key, rounds = importance.cutoff(df, take)
        assert key == sorted(keys)[take - 1]
        assert all(left <= 0.76 * n + 7 for n, left in rounds)  # each round discards a quarter
    assert importance.cutoff(df, 0)[0] is None
    with pytest.raises(ValueError):
        importance.cutoff(df, 2001)


def variants(counts, factor=5):
    """The rows by comparing all pairs of words."""

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(close[w]), counts.get(form[w])))
    return out


def counted(rows, least=6, often=5):
    c = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= least and n >= often}


def test_op12(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = entry.op12_spelling_variants(spark, sf).collect()
    assert len(got) == len(set(got)) > 100 and set(map(tuple, got)) == variants(counted(rows))


def test_variants_of_hard_words(spark):
    r = random.Random(3)
    words = {"".join(r.choice("abé") for _ in range(r.randrange(6, 9))): r.choice([5, 5, 6, 30, 31, 150, 800]) for _ in range(400)}
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaab": 700, "x" * 900: 5, "x" * 901: 25, "ab×÷ÿß": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    got = list(map(tuple, spelling.variant_groups(df).collect()))
    assert len(got) == len(words) and set(got) == variants(words)


def test_variants_odd_rows(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = spelling.spelling_variants(docs, letters=2, occurrences=1)
    assert set(map(tuple, got.collect())) == variants(counted(rows, 2, 1))
    assert spelling.spelling_variants(docs.where("false")).collect() == []


def check_packed(rows, got, capacity=2048, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    held, pieces = {}, {}
    for r in got:
        assert r.length > 0 and r.start >= 0
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= capacity
    ids_of = {}
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        ids_of.setdefault((d, len(ids)), []).append(ids)
    assert set(pieces) == set(ids_of)
    for k, rs in pieces.items():
        docs = ids_of[k]
        marks = Counter((a.start, a.length, a.ids_crc32) for a in rs)
        covered = Counter()
        for a in rs:
            assert any(zlib.crc32(np.array(ids[a.start : a.start + a.length], "<u4").tobytes()) == a.ids_crc32 for ids in docs)
            for i in range(a.start, a.start + a.length):
                covered[i] += 1
        assert set(covered) == set(range(k[1])) and set(covered.values()) == {len(docs)} and sum(marks.values()) == len(rs)
    return len(held), sum(k[1] * len(v) for k, v in ids_of.items())


def test_op13(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, tokens = check_packed(rows, entry.op13_differencing_packing(spark, sf).collect())
    assert n <= -(-tokens // 2048) + 1


def test_packing_odd_rows(spark, docs):
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(900, "<|endoftext|> it's  a\x0bb É́× '''S"), (901, "日本語 " * 900), (902, "x" * 5000)], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    check_packed(rows, differencing.pack(odd.withColumn("block", odd.doc_id), TOKENIZER).collect())
    check_packed(rows, differencing.pack(odd, TOKENIZER, capacity=64, windows=3).collect(), 64)
    assert differencing.pack(docs.where("false"), TOKENIZER).collect() == []


def test_difference():
    r = random.Random(2)
    for _ in range(40):
        sizes = sorted((r.randrange(1, 500) for _ in range(r.randrange(1, 90))), reverse=True)
        for k in (1, 2, 5, 16):
            parts = differencing.difference(sizes, k)
            assert len(parts) <= k and sorted(i for p in parts for i in p) == list(range(len(sizes)))
        parts = differencing.windows_of(sizes, 600)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes))) and all(sum(sizes[i] for i in p) <= 600 for p in parts)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in differencing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]  # the textbook's example
    assert differencing.difference([], 3) == []


def test_encoder_on_every_chunk(spark, sf):
    words = {w for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for w in (r.text or "").split()}
    e = differencing.Encoder(TOKENIZER)
    ids, edge = e.encode([w.encode() for w in words])
    for w, a, b in zip(words, edge, edge[1:]):
        assert ids[a:b].tolist() == e.tokenizer.encode(w, add_special_tokens=False).ids, w
