"""Exact removal of repeated word windows, found by recompression.

Each round of recompression replaces maximal runs of one symbol and then pairs (a, b) with a on the left and
b on the right side of a partition of the symbols. A new symbol is named by what it replaces, so all
documents name equal passages alike, except near their ends; a name has 128 bits, mixed from those of the words it stands for.

1. Where a document is read, its words and the first rounds' symbols are named. A window determines some of them whatever is around it; its anchor is the widest of
   those at the last of ANCHOR rounds that has any (the words are round 0, so there always is one), and equal windows have equal anchors at equal places.
2. Spark counts anchors over all documents; a window whose anchor occurs once is unique.
3. Further rounds are Spark jobs over all documents: symbols are counted by name; one that occurs once can't lie in a repeat, nor can any wider symbol with
   it, so documents keep only the sequences of shared symbols, which the next job replaces. A shared symbol at least as wide as the window reveals
   that all windows in it repeat.
4. Before anything is removed, the words of all occurrences of each such symbol are compared, by a BLAKE2b digest of the words as they stand. All other windows with a shared anchor are counted by
   names of 128 bits of their own, where of windows in a wide shared symbol only those of one occurrence are sent, for others to find.

Edge cases: a null or empty text has no words; a document shorter than a window keeps everything; a window repeated
within one document counts; rows that repeat an id and text count as two documents; one document's result
depends on the input only, not on what is cut elsewhere; an empty table gives no rows; other columns are ignored. A very long text is held
whole by one task, with some 60 bytes of arrays a word.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, join_counted, materialise, mix, prepare, release, utf8, word_digests, word_names

#: Rounds that look for anchors, and rounds where a document is read.
ANCHOR, FIRST = 3, 9
#: Rounds of replacement in each Spark job after that.
STEP = 3
#: The jobs end when so small a part of the first symbols is left in sequences; their windows are counted one by one, so no result depends on it.
REST = 0.01
_U = np.uint64


class Round(NamedTuple):
    """The symbols after a round, where each begins among the round's input, and what the round decided about its input."""

    names: np.ndarray
    checks: np.ndarray
    begin: np.ndarray
    run_of: np.ndarray
    right: np.ndarray
    pair_of: np.ndarray


def compress(names: np.ndarray, checks: np.ndarray, fresh: np.ndarray, level: int) -> Round:
    """One round over sequences of symbols; fresh: the symbol begins a sequence."""
    head = fresh.copy()
    head[1:] |= (names[1:] != names[:-1]) | (checks[1:] != checks[:-1])
    run_of = np.cumsum(head) - 1
    heads = np.flatnonzero(head)
    count = np.diff(np.append(heads, len(names))).astype(_U)

    def run(x, factor):
        return np.where(count > 1, mix(x[heads] * _U(factor) + count), x[heads])

    runs, run_checks, run_fresh = run(names, 0xA24BAED4963EE407), run(checks, 0x9FB21C651E98DF25), fresh[heads]
    right = (mix(runs + _U(level * 0x9FB21C651E98DF25 & (1 << 64) - 1)) & _U(1)).astype(bool)
    second = np.zeros(len(runs), bool)
    second[1:] = right[1:] & ~right[:-1] & ~run_fresh[1:]
    firsts = np.flatnonzero(~second)
    has = np.append(second, False)[firsts + 1]

    def pair(x, factor):
        out = x[firsts]
        out[has] = mix(mix(out[has] * _U(factor)) + x[firsts[has] + 1] + _U(level))
        return out

    return Round(pair(runs, 0xC6A4A7935BD1E995), pair(run_checks, 0xD6E8FEB86659FD93), heads[firsts], run_of, right, np.cumsum(~second) - 1)


class First(NamedTuple):
    """Symbols after the first rounds, and runs of windows of one document that have the same anchor occurrence: anchor, document, first start, count."""

    names: np.ndarray
    checks: np.ndarray
    begin: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    count: np.ndarray


def first_rounds(names: np.ndarray, checks: np.ndarray, at: np.ndarray, window: int) -> First:
    """For documents at names[at[i]:at[i + 1]]."""
    starts_of = np.maximum(np.diff(at) - window + 1, 0)
    n, words = int(starts_of.sum()), len(names)
    doc = np.repeat(np.arange(len(starts_of)), starts_of)
    place = np.arange(n) - np.repeat(np.cumsum(starts_of) - starts_of, starts_of)
    lo = place + at[doc]  # symbols lo..hi-1 are those that the window determines
    hi = lo + window
    begin, fresh = np.arange(words), np.zeros(words + 1, bool)
    fresh[at] = True  # the symbol begins a document
    fresh = fresh[:words]
    open_, where, anchor = np.arange(n), np.zeros(n, np.int64), np.zeros(n, _U)

    def settle(which, lo, hi, level):
        """The widest symbol of lo..hi-1 (then by hash, then the leftmost) becomes the anchor."""
        width = np.diff(np.append(begin, words))
        key = (_U(63) - np.minimum(width, 63).astype(_U) << _U(58)) | (mix(names) >> _U(36) << _U(30)) | np.arange(len(names), dtype=_U)
        size = hi - lo
        best = np.full(len(which), np.iinfo(_U).max, _U)
        step, table = 1, key
        while True:
            own = np.flatnonzero((size >= step) & (size < 2 * step))
            best[own] = np.minimum(table[lo[own]], table[hi[own] - step])
            if 2 * step > size.max():
                break
            table = np.minimum(table[:-step], table[step:])
            step *= 2
        at_symbol = (best & _U((1 << 30) - 1)).astype(np.int64)
        where[which] = begin[at_symbol]
        anchor[which] = mix(names[at_symbol] + _U(level))

    for level in range(1, FIRST + 1):
        if not len(names):
            break
        r = compress(names, checks, fresh, level)
        if len(open_):  # a window's outer runs may go on outside, its outer symbols may be paired outside
            a, b = r.run_of[lo] + 1, r.run_of[hi - 1]
            ok = (a < b) & (level <= ANCHOR)
            a, b = np.where(ok, a, 0), np.where(ok, b, 1)
            a, b = a + r.right[a], b - ~r.right[b - 1]
            ok &= a < b
            if not ok.all():
                settle(open_[~ok], lo[~ok], hi[~ok], level - 1)
            lo, hi, open_ = r.pair_of[a[ok]], r.pair_of[b[ok] - 1] + 1, open_[ok]
        names, checks, begin, fresh = r.names, r.checks, begin[r.begin], fresh[r.begin]
    new = np.ones(n, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (where[1:] != where[:-1]) | (anchor[1:] != anchor[:-1])
    heads = np.flatnonzero(new)
    return First(names, checks, begin, anchor[heads], doc[heads], place[heads], np.diff(np.append(heads, n)))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


SYMBOLS = "d long, h long, name array<long>, check array<long>, begin array<int>, width array<int>"
READ = SYMBOLS + ", anchor array<long>, place array<int>, count array<int>"


def _symbols(window: int):
    """The sequence of symbols and the anchors of each document that has a window."""

    def run(batches):
        for batch in batches:
            ids, prints, texts = batch.column(0), batch.column(1), utf8(batch.column(2))
            for begin, end in chunks(texts):
                words, checks, at = word_names(texts[begin:end])
                f = first_rounds(words, checks, at, window)
                long = np.flatnonzero(np.diff(at) >= window)

                def by_doc(edge, *columns, long=long):
                    take = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in long]) if len(long) else np.zeros(0, np.int64)
                    offsets = np.concatenate(([0], np.cumsum(np.diff(edge)[long])))
                    return [_lists(x[take], offsets) for x in columns]

                edge = np.searchsorted(f.begin, at)
                width = np.diff(np.append(f.begin, len(words))).astype(np.int32)
                place = (f.begin - np.repeat(at[:-1], np.diff(edge))).astype(np.int32)
                symbols = by_doc(edge, f.names.view(np.int64), f.checks.view(np.int64), place, width)
                anchors = by_doc(np.searchsorted(f.doc, np.arange(end - begin + 1)), f.anchor.view(np.int64), f.place.astype(np.int32), f.count.astype(np.int32))
                rows = pa.array(long + begin)
                yield pa.RecordBatch.from_arrays([ids.take(rows), prints.take(rows), *symbols, *anchors], names=[x.split()[0] for x in READ.split(", ")])

    return run


def _next_rounds(job: int, window: int):
    """STEP rounds over the shared symbols of each document. A gap between two symbols ends a sequence; sequences that can't make a new symbol as wide as a window are done."""

    def run(batches):
        for batch in batches:
            lists = [batch.column(i) for i in range(2, 6)]
            offsets = lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py()
            names, checks, begin, width = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            if not len(names):
                continue
            names, checks, stop = names.view(_U), checks.view(_U), begin + width
            fresh = np.ones(len(names), bool)
            fresh[1:] = begin[1:] != stop[:-1]
            fresh[offsets[:-1][offsets[:-1] < len(names)]] = True
            parts = np.ones(len(names), np.int64)  # input symbols in each symbol
            for level in range(STEP):
                r = compress(names, checks, fresh, FIRST + job * STEP + level)
                last = np.append(r.begin[1:], len(names)) - 1
                names, checks, begin, stop, fresh = r.names, r.checks, begin[r.begin], stop[last], fresh[r.begin]
                parts = np.add.reduceat(parts, r.begin)
            heads = np.flatnonzero(fresh)
            tails = np.append(heads[1:], len(names)) - 1
            old = (heads == tails) & (parts[heads] == 1)
            keep = np.flatnonzero(np.repeat(~old & (stop[tails] - begin[heads] >= window), tails - heads + 1))
            edge = np.searchsorted(keep, np.searchsorted(np.cumsum(parts) - parts, offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(_lists(x[keep], edge) for x in (names.view(np.int64), checks.view(np.int64), begin, stop - begin))], names=["d", "h", "name", "check", "begin", "width"])

    return run


def window_names(words: np.ndarray, width: int) -> np.ndarray:
    """128 bits of each run of `width` words, from the words' own: runs of 2, 4, 8, ... words are made of two halves each, and put together."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros((0, 2), _U)
    out = []
    for lane, (p, q) in enumerate(((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA24BAED4963EE407))):

        def both(a: np.ndarray, b: np.ndarray, p=_U(p), q=_U(q)) -> np.ndarray:
            x = a * p
            x ^= x >> _U(31)
            x += b
            x *= q
            x ^= x >> _U(29)
            return x

        run, size, done, total = np.ascontiguousarray(words[:, lane]), 1, 0, None
        while True:
            if width & size:
                part = run[done : done + n]
                total, done = part if total is None else both(total, part), done + size
            if done == width:
                break
            run = both(run[:-size], run[size:])
            size *= 2
        out.append(mix(total))
    return np.stack(out, 1)


def _covered(spans: list, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows that lie in a wide shared symbol, and of those, the ones that this occurrence sends for all others."""
    sure, send = np.zeros(n, bool), np.zeros(n, bool)
    for s in sorted(spans, key=lambda s: s["level"]):  # a wider symbol decides for the narrower ones in it
        part = slice(s["begin"], s["begin"] + s["width"] - window + 1)
        sure[part] = True
        send[part] = s["sends"]
    return sure, send


WINDOWS = "d long, h long, first int, sure boolean, names array<long>, checks array<long>, shared array<struct<name: long, check: long, seen: binary>>"
_SHARED = pa.list_(pa.struct([("name", pa.int64()), ("check", pa.int64()), ("seen", pa.binary())]))


def _windows(window: int):
    """The windows that may repeat: first start and names of each run of them; sure: in a shared symbol. And the digest of the words of each shared symbol's occurrence."""

    def run(batches):
        for batch in batches:
            ids, prints, texts, marks, spans = batch.column(0), batch.column(1), utf8(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for begin, end in chunks(texts):
                words, at = word_digests(texts[begin:end])
                rows, firsts, sures, lists, shared = [], [], [], [], []
                spelled: list[bytes] = []
                for i in range(end - begin):
                    own = words[at[i] : at[i + 1]]
                    count = max(len(own) - window + 1, 0)
                    may = np.zeros(count + 1, np.int64)
                    for m in marks[begin + i] or []:
                        may[m["place"]] += 1
                        may[m["place"] + m["count"]] -= 1
                    wide = spans[begin + i] or []
                    if wide:
                        spelled = texts[begin + i].split()
                    proofs = [{"name": s["name"], "check": s["check"], "seen": hashlib.blake2b(b" ".join(spelled[s["begin"] : s["begin"] + s["width"]]), digest_size=16).digest()} for s in wide]
                    sure, send = _covered(wide, count, window)
                    out = np.where(sure, np.where(send, 2, 0), np.cumsum(may[:-1]) > 0)
                    if out.any():
                        names = window_names(own, window).view(np.int64)
                        cuts = np.flatnonzero(np.diff(out)) + 1
                        for a, b in zip([0, *cuts], [*cuts, count], strict=True):
                            if out[a]:
                                rows.append(begin + i)
                                firsts.append(a)
                                sures.append(bool(out[a] == 2))
                                lists.append(names[a:b])
                                shared.append(None)
                    if proofs:
                        rows.append(begin + i)
                        firsts.append(None)
                        sures.append(None)
                        lists.append(np.zeros((0, 2), np.int64))
                        shared.append(proofs)
                if rows:
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
                    take, both = pa.array(rows, pa.int64()), np.concatenate(lists)
                    columns = [ids.take(take), prints.take(take), pa.array(firsts, pa.int32()), pa.array(sures, pa.bool_()), _lists(both[:, 0], offsets), _lists(both[:, 1], offsets), pa.array(shared, _SHARED)]
                    yield pa.RecordBatch.from_arrays(columns, names=["d", "h", "first", "sure", "names", "checks", "shared"])

    return run


def _cut(window: int, digest: bool):
    def run(batches):
        for batch in batches:
            ids, texts, marks, spans = batch.column(0), utf8(batch.column(1)), batch.column(2), batch.column(3).to_pylist()
            totals, removed, kept = [], [], []
            for i, text in enumerate(texts):
                words = text.split()
                gone = 0
                if marks[i].is_valid or spans[i]:
                    edge = np.zeros(len(words) + 1, np.int32)
                    if marks[i].is_valid:
                        starts = marks[i].values.to_numpy()
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + window, -1)
                    for s in spans[i] or []:
                        edge[s["begin"]] += 1
                        edge[s["begin"] + s["width"]] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    gone = int(covered.sum())
                    rest = [words[j] for j in np.flatnonzero(~covered)]
                else:
                    rest = words
                totals.append(len(words))
                removed.append(gone)
                out = b" ".join(rest)
                kept.append(hashlib.sha256(out).hexdigest() if digest else out.decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def drop_repeats(docs: DataFrame, window: int = 35, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by a space; with digest: their SHA-256)."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # a row is named by its id and a hash of its text
    docs = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h"), "doc_id", "text")
    row = ["d", "h"]
    read = materialise(docs.select("d", "h", "text").mapInArrow(_symbols(window), READ), "symbols")

    anchors = read.select("d", "h", F.explode(F.arrays_zip("anchor", "place", "count")).alias("a")).select("d", "h", "a.*")
    often = materialise(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchor-counts")
    again = materialise(join_counted(anchors, often, "anchor").select("d", "h", "place", "count"), "anchors")
    release(often)
    marks = materialise(again.groupBy(*row).agg(F.collect_list(F.struct("place", "count")).alias("marks")), "marks")
    release(again)

    symbols, found, job = read, [], 0
    left = first = symbols.agg(F.coalesce(F.sum(F.size("name")), F.lit(0))).first()[0]
    while left > REST * first:
        each = symbols.select("d", "h", F.explode(F.arrays_zip("name", "check", "begin", "width")).alias("s")).select("d", "h", "s.*")
        sender = F.min(F.when(F.col("width") >= window, F.struct("d", "h", "begin")))
        counts = each.groupBy("name", "check").agg(F.count("*").alias("n"), sender.alias("sender")).where("n > 1").drop("n")
        shared = materialise(each.join(counts, ["name", "check"]), "shared")
        release(symbols)
        sends = F.struct("d", "h", "begin") == F.col("sender")
        found.append(materialise(shared.where(F.col("width") >= window).select("d", "h", "begin", "width", "name", "check", F.lit(job).alias("level"), sends.alias("sends")), "spans"))
        per = shared.groupBy(*row).agg(F.array_sort(F.collect_set(F.struct("begin", "width", "name", "check"))).alias("s"))
        per = per.select("d", "h", F.col("s.name").alias("name"), F.col("s.check").alias("check"), F.col("s.begin").alias("begin"), F.col("s.width").alias("width"))
        job += 1
        symbols = materialise(per.mapInArrow(_next_rounds(job, window), SYMBOLS), "symbols")
        release(shared)
        left = symbols.agg(F.coalesce(F.sum(F.size("name")), F.lit(0))).first()[0]
    release(symbols)
    wide = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "d long, h long, begin int, width int, name long, check long, level int, sends boolean")
    while True:
        proved = materialise(wide.groupBy(*row).agg(F.collect_set(F.struct("begin", "width", "level", "sends", "name", "check")).alias("spans")), "proved")
        seen = docs.select("d", "h", "text").join(marks, row).join(proved, row, "left").select("d", "h", "text", "marks", "spans")
        windows = materialise(seen.mapInArrow(_windows(window), WINDOWS), "windows")
        # occurrences of one symbol must be of the same words; a symbol for which they aren't proves nothing, and its windows are compared one by one
        each = windows.where("shared IS NOT NULL").select(F.explode("shared").alias("s")).select("s.*")
        false = materialise(each.groupBy("name", "check").agg(F.min("seen").alias("a"), F.max("seen").alias("b")).where("a <> b").select("name", "check"), "false-symbols")
        if false.isEmpty():
            break
        wide = wide.join(false, ["name", "check"], "left_anti")
        release(windows, proved)
    release(*found)
    release(marks)
    each = windows.where("shared IS NULL").select("d", "h", "first", "sure", F.posexplode(F.arrays_zip("names", "checks")).alias("i", "w"))
    each = each.select("d", "h", (F.col("first") + F.col("i")).alias("start"), "sure", F.col("w.names").alias("name"), F.col("w.checks").alias("check"))
    counts = each.groupBy("name", "check").agg(F.sum(F.when(F.col("sure"), 2).otherwise(1)).alias("n")).where("n > 1").select("name", "check")
    again = materialise(each.where("NOT sure").drop("sure").join(counts, ["name", "check"]).select("d", "h", "start"), "repeats")
    release(windows)
    starts = materialise(again.groupBy(*row).agg(F.collect_set("start").alias("starts")), "starts")
    release(again)
    cut = docs.join(starts, row, "left").join(proved, row, "left").select("doc_id", "text", "starts", "spans")
    return cut.mapInArrow(_cut(window, digest), "doc_id long, n_words long, n_removed long, kept string")
