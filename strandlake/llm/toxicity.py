"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: case, homoglyphs, digit substitutions; whatever is no letter parts words. The lexicon holds whole words and word
beginnings, weighted by their log-odds in labelled texts (Spark counts them). One automaton finds all entries and the exception phrases; hits inside
an exception phrase don't count, and a word counts once, with its heaviest entry. A logistic curve over the
hits' weight, normalised by the text's length, gives the score; it is fitted out of fold, on lexicons from the other half.

The classifier is fitted on a bounded sample of labelled rows (`positives`, `negatives`: documented bounds); in the curve its rows
weigh as much as the classes have among all labelled texts, which Spark counts. Scoring covers every text as a whole. Labels, ids, language and source are not inputs of a score.

Edge cases: a null or empty text has no hits and gets the score of no hits; without labelled rows of both classes every score is
the smoothed share of positive labels; equal texts get equal scores; a document labelled more than once counts as toxic if
any label says so; a row without id is not held out; an empty table gives no rows; other columns are ignored. A very long text is folded and matched whole by one
task, in time and memory that grow with its length.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare

#: Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁԛԝһӏткмвнзиοαερνικτυχβγημωσ", "aeopcyxijsdqwhltkmbh3uoaepviktuxbynuwo", strict=True))
DIGITS = dict(zip("013457@$", "oieastas", strict=True))
#: Phrases in which lexicon words are harmless.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "class clown", "sore loser clause", "idiot proof", "pond scum", "soap scum")
PREFIXES = range(4, 9)
WHOLE = range(3, 25)


class Folding(dict):
    """A translation table that learns each character when it first occurs."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        if unicodedata.category(c) in ("Mn", "Me", "Cf"):  # accents on their own, invisible signs
            self[code] = None
            return None
        if code > 127:  # letters without their accents, full-width and styled forms as plain ones
            c = unicodedata.normalize("NFKD", c)[0].lower()
        c = HOMOGLYPHS.get(c, c)
        c = DIGITS.get(c, c)
        self[code] = ord(c) if c.isalnum() else 32
        return self[code]


_FOLD = Folding()


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def entries(words: set[str]) -> set[str]:
    """Possible lexicon entries: ' word ' for a whole word, ' begin' for the beginning of one."""
    out = {f" {w} " for w in words if len(w) in WHOLE}
    for n in PREFIXES:
        out |= {" " + w[:n] for w in words if len(w) >= n}
    return out


@dataclass
class Model:
    lexicon: dict[str, float]
    curve: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def matcher(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in self.exceptions:
            key = " " + " ".join(fold(phrase).split()) + " "
            machine.add_word(key, (len(key), -1.0))
        for entry, weight in self.lexicon.items():
            if entry not in machine:
                machine.add_word(entry, (len(entry), weight))
        if len(machine):
            machine.make_automaton()
        return machine

    def measure(self, text: str, machine) -> tuple[float, int, int]:
        """Summed weight of hits, number of hits, number of words."""
        words = fold(text).split()
        if not words or not len(machine):
            return 0.0, 0, len(words)
        best: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (size, weight) in machine.iter(" " + " ".join(words) + " "):
            begin = end - size + 1
            if weight < 0:
                safe.append((begin, end))
            elif weight > best.get(begin, 0.0):
                best[begin] = weight
        for a, b in safe:
            for begin in [x for x in best if a <= x < b]:
                del best[begin]
        return sum(best.values()), len(best), len(words)

    def score(self, total: float, n_words: int) -> float:
        z = float(np.dot(self.curve, features(np.array([total]), np.array([n_words]))[0]))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def features(total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    n = np.maximum(n_words, 1)
    return np.stack([np.ones(len(n)), np.log1p(total), total / np.sqrt(n), np.log1p(100 * total / n)], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rate: float | None = None) -> tuple[float, ...]:
    """Logistic regression by Newton steps; rate: the positives' share that the rows are weighted to."""
    w = np.zeros(x.shape[1])
    share = np.ones(len(y))
    if rate is not None and 0 < y.sum() < len(y):
        share = np.where(y > 0, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    w[0] = math.log(((share * y).sum() + 0.5) / ((share * (1 - y)).sum() + 0.5))
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (share * (p - y)) + penalty @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def _count(batches):
    """Entries' document counts of a task: entry, half, toxic, n. A task holds a bounded part of the bounded sample."""
    counts: Counter = Counter()
    for batch in batches:
        for text, half, toxic in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts.update((e, half, toxic) for e in entries(set(fold(text or "").split())))
            if len(counts) > 500_000:
                yield _rows(counts)
                counts.clear()
    yield _rows(counts)


def _rows(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays([*cols, pa.array(list(counts.values()), pa.int64())], names=["entry", "half", "toxic", "n"])


def _measure(model: Model):
    def run(batches):
        machine = model.matcher()
        for batch in batches:
            found = [model.measure(t or "", machine) for t in batch.column(1).to_pylist()]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["key", "total", "n_hits", "n_words"])

    return run


def fit(docs: DataFrame, labels: DataFrame, positives: int = 3000, negatives: int = 6000, label: str = "toxic", key: str = "doc_id", text: str = "text", exceptions=EXCEPTIONS) -> Model:
    """Learn from rows of labels (those with a null label or key are skipped). The lexicon grows with the bounded sample only."""
    prepare(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("toxic"))
    some = [known.where(F.col("toxic") == v).orderBy(F.xxhash64("key"), "key").limit(n) for v, n in ((1, positives), (0, negatives))]
    sample = F.broadcast(some[0].union(some[1]))  # at most positives + negatives rows
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(sample, "key").dropDuplicates(["text"])
    rows = materialise(rows.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), "toxic"), "labelled")
    every = dict(known.groupBy("toxic").agg(F.count("*")).collect())
    rate = None
    if every.get(1, 0) > positives or every.get(0, 0) > negatives:  # the sample has another share of positives than all labelled texts
        texts = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text")).join(known, "key").groupBy("text").agg(F.max("toxic").alias("toxic"))
        rate = texts.agg(F.avg("toxic")).first()[0]
    sizes = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    p, n = (sum(v for (_, t), v in sizes.items() if t == side) for side in (1, 0))
    prior = (math.log((p + 0.5) / (n + 0.5)), 0.0, 0.0, 0.0)
    if not p or not n:
        return Model({}, prior, exceptions)
    counts = rows.mapInArrow(_count, "entry string, half int, toxic int, n long")
    part = lambda half, toxic: F.coalesce(F.sum(F.when((F.col("half") == half) & (F.col("toxic") == toxic), F.col("n"))), F.lit(0)).alias(f"c{half}{toxic}")
    table = counts.groupBy("entry").agg(*[part(h, t) for h in (0, 1) for t in (0, 1)])
    pos, neg = F.col("c01") + F.col("c11"), F.col("c00") + F.col("c10")
    odds = F.log((pos + 0.5) / (p + 1.0)) - F.log((neg + 0.5) / (n + 1.0))
    least = 4 if p >= 100 else 3
    table = table.where((pos >= least) & (odds > 2)).collect()

    def lexicon(halves: tuple[int, ...]) -> dict[str, float]:
        a = sum(sizes.get((h, 1), 0) for h in halves)
        b = sum(sizes.get((h, 0), 0) for h in halves)
        support = max(4.0, 0.02 * a)
        out = {}
        for r in table:
            x, y = (sum(r[f"c{h}{t}"] for h in halves) for t in (1, 0))
            w = math.log((x + 0.5) / (a + 1)) - math.log((y + 0.5) / (b + 1))
            if x >= 2 and w > 2:
                out[r["entry"]] = round(w * min(1.0, x / support), 4)
        return out

    xs, ys = [], []
    for half in (0, 1):  # each half is measured with what the other one taught
        other = Model(lexicon((1 - half,)), prior, exceptions)
        got = rows.where(F.col("half") == half).select("toxic", "text").mapInArrow(_measure(other), "key int, total double, n_hits long, n_words long").collect()
        if got:
            xs.append(features(np.array([r["total"] for r in got]), np.array([r["n_words"] for r in got])))
            ys.append(np.array([r["key"] for r in got], float))
    return Model(lexicon((0, 1)), fit_curve(np.concatenate(xs), np.concatenate(ys), rate=rate), exceptions)


def _scores(model: Model, threshold: float):
    def run(batches):
        machine = model.matcher()
        for batch in batches:
            found = [model.measure(t or "", machine) for t in batch.column(1).to_pylist()]
            scores = [model.score(f[0], f[2]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([f[1] for f in found], pa.int64())],
                names=["doc_id", "score", "predicted", "n_hits"],
            )

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits for each row of docs."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = rows.mapInArrow(_scores(model, threshold), "doc_id long, score double, predicted int, n_hits long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_hits")


def _clean(model: Model, threshold: float, at: int):
    def run(batches):
        machine = model.matcher()
        for batch in batches:
            keep = []
            for t in batch.column(at).to_pylist():
                total, _, n = model.measure(t or "", machine)
                keep.append(model.score(total, n) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't predict toxic."""
    prepare(docs.sparkSession)
    return docs.mapInArrow(_clean(model, threshold, docs.columns.index(text)), docs.schema)
