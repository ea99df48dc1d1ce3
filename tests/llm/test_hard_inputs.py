"""Inputs made to break hashes, bounds and line ends."""

import random

import brute
import pytest

from strandlake.llm import line_dedup, ngram_join, substring_dedup, vafile
from strandlake.llm.common import join_counted, materialise, shingle_hashes, word_names


def thue_morse(n, a="a", b="b"):
    """A word and its complement: polynomials over any odd base agree on them modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


@pytest.mark.parametrize("n", [16, 32, 64, 128, 1024, 4096])
def test_words_that_polynomials_confuse(spark, n):
    one, two = thue_morse(n)
    names, checks, _ = word_names([one.encode(), two.encode()])
    assert names[0] != names[1] and checks[0] != checks[1]
    rest = [f"w{i}" for i in range(34)]
    rows = [(1, " ".join([one, *rest])), (2, " ".join([two, *rest])), (3, " ".join([*rest[:17], one, *rest[17:]])), (4, " ".join([*rest[:17], one, *rest[17:]])), (5, one), (6, two), (7, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.drop_repeats(df, digest=True).collect()
    assert sorted(map(tuple, got)) == sorted(brute.drop_repeats(rows))
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 35, 4: 35, 5: 0, 6: 0, 7: 0}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()} == brute.jaccard_components(rows)


def test_arrangements_that_polynomials_confuse(spark):
    one, two = (x.replace("a", "left ").replace("b", "right ") for x in thue_morse(2048))
    rows = [(1, one), (2, two), (3, one[:6000]), (4, "x " + one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.drop_repeats(df, window=2048, digest=True).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 2048, 2: 0, 3: 0, 4: 2048}
    words = word_names([one.encode(), two.encode()])[0]
    assert len(set(shingle_hashes(words[:2048], 1024).tolist()) & set(shingle_hashes(words[2048:], 1024).tolist())) == len({one.split()[i : i + 1024].__str__() for i in range(1025)} & {two.split()[i : i + 1024].__str__() for i in range(1025)})


def test_a_false_symbol_proves_nothing(spark, monkeypatch):
    """Where symbols of different words share a name, the comparison of their words finds it, and windows are compared one by one."""
    import numpy as np

    honest = substring_dedup.compress

    def confused(names, checks, fresh, level):
        r = honest(names, checks, fresh, level)
        return r._replace(names=r.names & np.uint64(1), checks=r.checks & np.uint64(0))

    r = random.Random(6)
    say = lambda n: " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(n))
    passage = say(60)
    rows = [(i, f"{say(150)} {passage if i % 2 else ''} {say(90)}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    source = substring_dedup._next_rounds  # runs in workers: the patched rounds go with the function that is sent

    def patched(job, window):
        inner = source(job, window)

        def run(batches):
            substring_dedup.compress = confused
            try:
                yield from inner(batches)
            finally:
                substring_dedup.compress = honest

        return run

    monkeypatch.setattr(substring_dedup, "_next_rounds", patched)
    got = substring_dedup.drop_repeats(df, digest=True).collect()
    assert sorted(map(tuple, got)) == sorted(brute.drop_repeats(rows))


def test_join_counted_deals_hot_keys_out(spark):
    rows = [(1 if i % 3 else i, i) for i in range(3000)]
    df = materialise(spark.createDataFrame(rows, "k long, i long"), "rows")
    counts = materialise(df.groupBy("k").count().withColumnRenamed("count", "n").where("n > 1"), "counts")
    assert sorted(map(tuple, join_counted(df, counts, "k", 4).collect())) == sorted(r for r in rows if r[0] == 1)


def nearest(rows, queries, k=5):
    import math
    from fractions import Fraction

    lim = (1 << 63) - 1
    ints = {i: [math.floor(Fraction(x) * 256) for x in v] for i, v in rows}
    out = set()
    for q in queries:
        s = sorted((-max(min(sum(a * b for a, b in zip(ints[q], v)), lim), -lim - 1), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("big", [1e15, 1e16, 1e100, 1e200, 1e307, 1.7976931348623157e308, -1e307, 5e-324])
def test_finite_vectors_of_any_size(spark, big):
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(60)]
    rows[7] = (7, [big, 0.0, 0.5, -0.25, 0.0, big])
    rows[10] = (10, [-0.5, big, 0.0, 0.0, 1.0, -big])
    rows += [(70, [big]), (71, [2.0]), (72, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vafile.exact_top_k(df, df.where("vec_id % 5 = 0"))
    assert set(map(tuple, got.collect())) == nearest(rows, [i for i, _ in rows if i % 5 == 0])


def test_lines_that_end_in_carriage_returns(spark):
    rows = [(i, "s", f"own {i}\r\n\r\nfooter\r\n \t\r\n\t\n\x0b\nfooter") for i in range(6)] + [(9, "s", "alone"), (10, None, "\r\n\r\n"), (11, "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert got[0].text == "own 0\r\n\r\n \t\r\n\t\n\x0b" and (got[0].n_lines, got[0].n_dropped) == (7, 2)
    assert got[9].text == "alone" and got[10].text == "\r\n\r\n" and got[11].text is None


def test_word_names_tell_words_apart():
    r = random.Random(12)
    words = {bytes(r.choice(b"ab\xc3\xa9") for _ in range(r.choice((1, 2, 7, 8, 9, 15, 16, 17, 33, 63, 64, 65, 70)))) for _ in range(20_000)}
    words |= {b"a" * n for n in range(1, 90)} | {b"\0" * n for n in range(1, 90)} | {b"a" * n + b"\0" for n in range(20)}
    every = sorted(words)
    names, checks, at = word_names([b" ".join(every), b"", b" \n " + every[5] + b"\t", every[-1]])
    assert len(set(names.tolist())) == len(set(checks.tolist())) == len(every) and at.tolist() == [0, len(every), len(every), len(every) + 1, len(every) + 2]
    assert names[-2] == names[5] and checks[-2] == checks[5] and names[-1] == names[len(every) - 1]
    one = [word_names([w])[0][0] for w in every[:300]]
    assert one == names[:300].tolist()  # whatever stands around
