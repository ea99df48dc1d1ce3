"""Packing of token sequences by bin completion.

Documents become pieces of at most `capacity` tokens; only longer ones are cut, so a document has at most one
piece below the capacity. How many bins are needed depends only on how many pieces there are of each
length: a histogram of at most `capacity` entries, which Spark counts and the driver solves. The solution says
how many bins hold which lengths; Spark numbers the pieces of each length without gaps and joins them to
their places. Both tables on the driver are bounded by the capacity, whatever the input.

The solver builds bins around the largest piece left, tries all undominated fillings of its gap in
order of waste, prunes by the waste that the incumbent allows and by a lower bound of the rest, and starts with best-fit decreasing
as the incumbent.

Edge cases: a null or empty text is the end token alone; repeated rows are packed each; ties among equal lengths
go by id; an empty table gives no rows; other columns are ignored. A text is encoded whole, however long: its ids and some 20 times its bytes are held by one task at a time; one that the faster
engine can't take (such as a very long run of white space) is encoded by the tokenizer itself.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare

#: With at most so many lengths left, the search compares how many fillings each has.
FEW = 100
_LOG = logging.getLogger(__name__)

Plan = list[tuple[tuple[int, ...], int]]  # lengths of one bin, how many such bins


def best_fit_decreasing(lengths: Counter, capacity: int) -> Plan:
    """Best fit on a histogram: equal pieces are placed together."""
    bins: dict[tuple[int, ...], int] = {}
    by_gap: dict[int, list[tuple[int, ...]]] = {}
    gaps: list[int] = []

    def add(filling: tuple[int, ...], n: int, gap: int) -> None:
        if filling in bins:
            bins[filling] += n
            return
        bins[filling] = n
        if gap not in by_gap or not by_gap[gap]:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append(filling)

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                per = capacity // length
                if left >= per:
                    add((length,) * per, left // per, capacity - per * length)
                    left %= per
                else:
                    add((length,) * left, 1, capacity - left * length)
                    left = 0
                continue
            gap = gaps[i]
            filling = by_gap[gap][-1]
            n = min(left, bins[filling])
            bins[filling] -= n
            if not bins[filling]:
                del bins[filling]
                by_gap[gap].pop()
                if not by_gap[gap]:
                    gaps.pop(i)
            add(filling + (length,), n, gap - length)
            left -= n
    return list(bins.items())


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: for each size a, pieces above capacity - a stand alone, those above half of it open bins, and those of a..half fill what is left;
    and of pieces above capacity / (j + 1), no bin holds more than j."""
    sizes = np.arange(capacity + 1)
    half = capacity // 2
    many, much = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * sizes)[::-1])[::-1]  # pieces of at least i, and their tokens
    alone = np.append(many[1:], 0)[capacity - np.arange(half + 1)]  # pieces above capacity - a
    alone_much = np.append(much[1:], 0)[capacity - np.arange(half + 1)]
    large, large_much = many[half + 1] - alone, much[half + 1] - alone_much
    small = much[: half + 1] - much[half + 1]
    rest = np.maximum(small - (large * capacity - large_much), 0)
    j = np.arange(1, capacity + 1)
    per_bin = -(-many[capacity // (j + 1) + 1] // j)
    return int(max((alone + large + -(-rest // capacity)).max(), per_bin.max()))


def _dominated(filling: tuple[int, ...], at_hand: int, waste: int) -> bool:
    """Whether a piece at hand (a bit for each length) could take the place of some of the filling's pieces, none included, that are no longer than it."""
    sums, several = 1, 0  # sums of subsets; of those of two pieces or more
    for k in filling:
        several |= (several << k) | ((sums & ~1) << k)
        sums |= sums << k
    reach, width = 0, 0  # sums moved up by 1..waste
    step = sums << 1
    while width < waste:
        more = min(width or 1, waste - width)
        step = sums << 1 if not width else reach << more
        reach |= step
        width += more
    return bool(at_hand & (reach | several))


def fillings(counts: np.ndarray, gap: int, most: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated ways to fill a gap from the lengths left with a waste of at most `most`, least waste first. None: a step without one."""
    sizes = [int(k) for k in np.flatnonzero(counts[: gap + 1])[::-1]]
    have = [min(int(counts[k]), gap // k) for k in sizes]
    mask = (1 << gap + 1) - 1
    reach = [1]  # sums that the sizes from here on can make
    for k, n in zip(sizes[::-1], have[::-1], strict=True):
        sums, part = reach[-1], 1
        while n:  # n copies as 1, 2, 4, ... and a rest
            part = min(part, n)
            sums |= (sums << k * part) & mask
            n -= part
            part *= 2
        reach.append(sums)
    reach.reverse()

    def exact(i: int, rest: int) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield ()
            return
        while i < len(sizes) and reach[i] >> rest & 1:
            k = sizes[i]
            for n in range(min(have[i], rest // k), 0, -1):
                if reach[i + 1] >> rest - n * k & 1:
                    for more in exact(i + 1, rest - n * k):
                        yield (k,) * n + more
            i += 1

    at_hand = sum(1 << k for k in sizes)
    for waste in range(min(most, gap) + 1):
        if not reach[0] >> gap - waste & 1:
            continue
        for f in exact(0, gap - waste):
            left = at_hand
            for k in set(f):
                if f.count(k) == counts[k]:
                    left ^= 1 << k
            yield None if _dominated(f, left, waste) else f


class Solution(NamedTuple):
    plan: Plan
    bins: int
    bound: int  #: no packing has fewer bins; bins - bound is the most that could be gained


def bin_completion(lengths: dict[int, int], capacity: int, steps: int = 1_500_000) -> Solution:
    """Bins for a histogram of lengths (1..capacity).

    The search is complete: bins are built around the largest piece left (where at most FEW lengths are left, around the one with the fewest
    fillings), every undominated filling is tried, and each as often as it fits down to once. It ends when the lower bound is reached, when all is tried, or after `steps` fillings and lengths looked at; then `bins` may exceed the optimum by at
    most bins - bound. `steps` limits the driver's time, not the input: what is packed is always whole.
    """
    lengths = Counter({int(k): int(v) for k, v in lengths.items() if v > 0})
    if not lengths:
        return Solution([], 0, 0)
    if min(lengths) < 1 or max(lengths) > capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    best = best_fit_decreasing(lengths, capacity)
    best_bins = sum(n for _, n in best)
    total = sum(k * v for k, v in lengths.items())
    counts = np.zeros(capacity + 1, np.int64)
    for k, v in lengths.items():
        counts[k] = v
    bound = max(-(-total // capacity), lower_bound(counts, capacity))
    plan: Plan = []
    bins = waste = 0

    def ways(piece: int, spare: int) -> Iterator[tuple[int, ...] | None]:
        rest = counts.copy()
        rest[piece] -= 1
        return fillings(rest, capacity - piece, spare)

    class Node:
        """The bins of one piece: its fillings, the one at work, and how often it may still be taken. Below other nodes it only knows how many fillings it has had."""

        def __init__(self, again: int | None, tried: frozenset):
            nonlocal steps
            left = [int(k) for k in np.flatnonzero(counts)[::-1]]
            self.spare = (best_bins - 1) * capacity - total - waste
            self.piece, fewest = left[0] if again is None else again, FEW
            steps -= len(left)
            if again is None and len(left) <= FEW:
                for k in left:
                    n = sum(1 for _ in islice(ways(k, self.spare), fewest))
                    steps -= len(left) + n
                    if n < fewest:
                        self.piece, fewest = k, n
                    if not n:
                        break
            self.tried = tried  # fillings of this piece that an earlier node settled
            self.had, self.ways = 0, None
            self.filling: tuple[int, ...] = ()
            self.times = 0

        def next(self) -> tuple[int, ...] | bool | None:
            if self.ways is None:
                self.ways = islice(ways(self.piece, self.spare), self.had, None)
            self.had += 1
            return next(self.ways, False)

    def undo(node: Node) -> None:
        nonlocal bins, waste
        filling, n = plan.pop()
        for k in filling:
            counts[k] += n
        bins -= n
        waste -= n * (capacity - sum(filling))

    stack = [Node(None, frozenset())]
    placed = [False]
    while stack and best_bins > bound and steps > 0:
        node = stack[-1]
        if placed[-1]:
            undo(node)
            placed[-1] = False
        steps -= 10
        if not node.times:
            way = node.next()
            if way is False:
                stack.pop()
                placed.pop()
                continue
            if way is None or way in node.tried:
                continue
            node.filling = (node.piece, *way)
            node.times = min(int(counts[k]) // v for k, v in Counter(node.filling).items())
        lost = capacity - sum(node.filling)
        spare = (best_bins - 1) * capacity - total - waste  # more waste than a better solution can have
        n = min(node.times, spare // lost) if lost else node.times
        node.times = max(n - 1, 0)
        if spare < 0 or n < 1:
            node.times = 0
            continue
        for k in node.filling:
            counts[k] -= n
        plan.append((node.filling, n))
        bins += n
        waste += n * lost
        placed[-1] = True
        if not counts.any():
            if bins < best_bins:
                best, best_bins = list(plan), bins
        elif bins + lower_bound(counts, capacity) < best_bins:
            node.ways = None  # frees its tables; it finds its place again if the search comes back
            same = counts[node.piece] > 0
            stack.append(Node(node.piece, node.tried | {node.filling[1:]}) if same else Node(None, frozenset()))
            placed.append(False)
    return Solution(best, best_bins, bound)


def _tokens(path: str):
    """A function from a text to its token ids (little-endian uint32).

    The vocabulary and its merge order are read from the tokenizer's file; a second engine applies them, several times as fast, with the same
    ids. A text that holds a special token, or that the second engine refuses, goes to the tokenizer itself.
    """
    import json
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = [t["content"] for t in model["added_tokens"]]
    # byte-level vocabularies write each byte as a printable character: printable bytes as themselves, the others from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    engine = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if not any(s in text for s in special):
            try:
                return engine.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # its pattern has a limit on backtracking
                pass
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        encode = _tokens(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + int(end).to_bytes(4, "little")
                n = len(ids) // 4
                at = n % capacity or capacity if n > capacity else n
                cuts = [0, *range(at, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((doc, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def places(plan: Plan, offset: int = 0) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, after, per bin, first bin, place in the bin): the pieces of a length with these numbers go there."""
    used: Counter = Counter()
    rows, bin_id = [], offset
    for filling, n in plan:
        at = 0
        for length, per in sorted(Counter(filling).items(), reverse=True):
            rows.append((length, used[length], used[length] + per * n, per, bin_id, at))
            used[length] += per * n
            at += per * length
        bin_id += n
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text", blocks: int = 32) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = docs.mapInArrow(_pieces(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long")
    # the block spreads a length's pieces; it is fixed once the stage is written
    pieces = materialise(pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), "pieces")
    counts = materialise(pieces.groupBy("length", "block").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    solution = bin_completion(histogram, capacity)
    if solution.bins > solution.bound:
        _LOG.info("packed into %d sequences; the lower bound is %d", solution.bins, solution.bound)
    plan = spark.createDataFrame(places(solution.plan), "length long, lo long, hi long, per long, bin long, at long")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("row", F.row_number().over(own) - 1)
    numbered = numbered.join(F.broadcast(first), ["length", "block"]).withColumn("number", F.col("first") + F.col("row"))  # capacity x blocks rows at most
    placed = numbered.join(F.broadcast(plan), "length").where("number >= lo AND number < hi")  # a row for each length of each kind of bin
    spot = F.col("number") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(spot / F.col("per"))).alias("sequence_id"), (F.col("at") + F.pmod(spot, F.col("per")) * F.col("length")).alias("offset"),
    )
