"""Spelling variants grouped by permuterm rotations.

A word w, marked with its end, has as many rotations as characters and end. Two words that differ in one code point have rotations that agree but for the last character:
the rotation that begins behind the edited place reads over the end and up to it. So each word gives, for each of its places, the rotation without the character there; and,
for words that lack one character of another, each of its whole rotations. Sorted by these prefixes, near words lie together: a group holds the words that fit one prefix
with one more character, and at most one word that is the prefix itself.

1. Words are counted where documents are read, a table for each task, and summed by Spark.
2. All rotations are sorted by prefix; a scan of each group tells its members how many neighbours they have in it and which is the most frequent. No pairs are made: a group's two most
   frequent members are the best neighbour of all others.
3. Of the places in a run of one character, only the first counts as the lacking one; so every pair of near words meets in exactly one group, and counts add up.
4. Each word with a far more frequent neighbour follows it, and pointers are doubled until no word moves.

Edge cases: a null or empty text has no words; a null id stands as the empty one; rows that repeat an id count each; ties in frequency go to the lesser word in code-point order; an empty table gives
no rows; other columns are ignored. A text is read whole, however long: one task holds it and its words at a time; a task's table of words is emptied into the shuffle when it is large.
A very long word gives as many rotations as it has characters; the alphabet bounds a group (every member but one differs in the one character).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare, release, utf8

#: Distinct words that a task holds before it sends their counts on.
TABLE = 300_000
#: The end of a word in its rotations; no word holds it.
END = "$"


def _runs(least: int) -> re.Pattern[bytes]:
    """Runs of at least so many letters: a-z and U+00C0..U+00FF, whose UTF-8 is C3 and one byte more."""
    return re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % least)


def _counts(least: int, drop_one_in: int):
    """word, n: a task's words, summed as far as its table goes."""
    runs = _runs(least)

    def run(batches):
        table: Counter[bytes] = Counter()

        def flush():
            words, n = [w.decode() for w in table], list(table.values())
            table.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                start = zlib.crc32(b"%d:" % doc if doc is not None else b":")
                for word, n in Counter(runs.findall(text.lower())).items():  # of bytes: A-Z only
                    h = zlib.crc32(word, start)
                    if h % drop_one_in == 0:
                        letters = word.decode()
                        i = h % len(letters)
                        word = (letters[:i] + letters[i + 1 :]).encode()
                    table[word] += n
                if len(table) > TABLE:
                    yield flush()
        if table:
            yield flush()

    return run


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = 6, occurrences: int = 5, drop_one_in: int = 199) -> DataFrame:
    """word, n: the words of enough letters and occurrences. One in `drop_one_in` (document, word) loses a letter, by a keyed checksum."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_counts(letters, drop_one_in), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= occurrences) & (F.char_length("word") >= letters))


def rotations(words: DataFrame) -> DataFrame:
    """prefix, word, n, whole, edge: for each place of a word, the rotation that ends before it (edge: the place begins a run of its character), and each whole rotation."""
    w = F.col("word")
    size = F.char_length(w)

    def rotated(i: Column, skipped: int) -> Column:
        """What follows the first i characters (but `skipped` of them), the end, and those i characters."""
        return F.concat(F.substr(w, i + 1 + skipped), F.lit(END), F.substr(w, F.lit(1), i))

    def at(i: Column) -> Column:
        return F.substr(w, i, F.lit(1))

    places = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(rotated(i, 1).alias("prefix"), F.lit(False).alias("whole"), ((i == 0) | (at(i + 1) != at(i))).alias("edge")))
    wholes = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(rotated(i, 0).alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("edge")))
    return words.select("word", "n", F.explode(F.concat(places, wholes)).alias("r")).select("r.prefix", "word", "n", "r.whole", "r.edge")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, near_n, near: how many words are at one edit from each word that has any, and the most frequent of them."""
    group = Window.partitionBy("prefix")
    ranked = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("n", "word")
    one_more, lacking = ~F.col("whole"), F.col("edge")
    pick = lambda which, k: F.nth_value(F.when(which, me), k, ignoreNulls=True).over(ranked)
    groups = rotations(words).withColumn("members", F.count("*").over(group)).where("members > 1")
    groups = groups.withColumns({
        "longs": F.count(F.when(one_more, 1)).over(group), "edges": F.count(F.when(lacking, 1)).over(group), "wholes": F.count(F.when(F.col("whole"), 1)).over(group),
        "first": pick(one_more, 1), "second": pick(one_more, 2), "first_edge": pick(lacking, 1), "short": pick(F.col("whole"), 1),
    })
    other = F.when(F.col("first.word") == F.col("word"), F.col("second")).otherwise(F.col("first"))
    count = F.when(F.col("whole"), F.col("edges")).otherwise(F.col("longs") - 1 + F.when(lacking, F.col("wholes")).otherwise(0))
    short = F.when(lacking, F.col("short"))
    better = lambda a, b: F.when(b.isNull() | (a["n"] > b["n"]) | ((a["n"] == b["n"]) & (a["word"] < b["word"])), a).otherwise(b)
    best = F.when(F.col("whole"), F.col("first_edge")).when(other.isNull(), short).otherwise(better(other, short))
    found = groups.select("word", count.alias("c"), best.alias("best")).where("c > 0")
    least = F.struct((-F.col("best.n")).alias("minus"), F.col("best.word").alias("word"))  # words compare by bytes of UTF-8, which is code-point order
    out = found.groupBy("word").agg(F.sum("c").alias("n_near"), F.min(least).alias("b"))
    return out.select("word", "n_near", (-F.col("b.minus")).alias("near_n"), F.col("b.word").alias("near"))


def variant_groups(words: DataFrame, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n. A word's form is its most frequent neighbour, if that is at least `factor` times as frequent; its root is where forms lead."""
    near = neighbours(words)
    joined = words.join(near, "word", "left")
    has = F.col("near_n") >= factor * F.col("n")
    out = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")), "forms")
    links = materialise(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # each turn doubles the distance; frequencies rise `factor`-fold along it, so there are few
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialise(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        release(links)
        links = moved.select("word", "root")
        links.stage = moved.stage
        if moved.where("moved").isEmpty():
            break
    roots = out.join(links, "word", "left")
    return roots.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = 6, occurrences: int = 5, factor: int = 5, drop_one_in: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n over all documents."""
    prepare(docs.sparkSession)
    return variant_groups(materialise(word_counts(docs, key, text, letters, occurrences, drop_one_in), "words"), factor)
