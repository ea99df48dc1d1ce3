"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Documents become token ids once, and leave their task as pieces. Whole windows of a long document are sequences of their own; what is left of each document (less than a window)
forms a stream, which each task cuts every `windows` x (`capacity` - `slack`) tokens; what is left of the tasks' streams shares blocks of its own. A block is the unit of differencing: it holds less
than two blocks' tokens, whatever the documents are, so blocks pack side by side. The last part of a block is cut into pieces of falling sizes, because
documents alone (three or four to a window) leave windows some per cent apart.

Within a block, each piece begins as a partial partition: one window with the piece, the others empty. The two partitions with the greatest imbalances are merged,
fullest windows with emptiest, until one is left; it holds near-equal windows. There are as many windows as the block's tokens need; if one is over the
capacity, the differencing runs again with one window more.

Edge cases: a null or empty text is the end token alone; repeated rows are packed each; a null id stays null; ties go by length, id and start; an empty table gives no rows; other
columns are ignored. A text is encoded whole, however long: one task holds it, its words and its ids at a time.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, materialise, prepare, split_words, utf8

#: Pieces of falling sizes that end each block, and the share of the block that they have: small pieces level what large ones leave uneven.
FALLING, SHARE = (256, 128, 64, 32, 16, 8, 4, 2, 1), 0.15
#: Units whose ids an encoder holds, besides those of whole chunks.
UNITS = 500_000
#: Printable ASCII and U+00C0..U+00FF, which normalize to themselves in lower case.
_PLAIN = re.compile(rb"(?:[!-~]|\xc3[\x80-\xbf])+")
#: The tokenizer's own units of such text in lower case.
_UNITS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|(?:[!-/:-@\[-`{-~]|\xc3[\x97\xb7])+")
#: Byte-level vocabularies write each byte as a printable character: printable bytes as themselves, the others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Encoder:
    """Token ids of texts under a tokenizer whose tokens never span white space and whose normalizer treats what stands between white space on its own (the caller's choice).

    Each distinct chunk between ASCII white space is encoded once, plain ones unit by unit by the tokenizer's model, all others by the whole tokenizer; a text's ids are its chunks' ids.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = not any(s.isalpha() for s in self.special)  # no run of letters is a special token
        self.words = Words()
        self.units: dict[bytes, bytes] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _unit(self, unit: bytes) -> bytes:
        shown = unit.decode("latin-1")
        found = self.units[unit] = array("I", [t.id for t in self.model.tokenize(shown if unit.isascii() else shown.translate(_BYTES))]).tobytes()
        return found

    def _chunk(self, chunk: bytes) -> bytes:
        """The chunk's ids, four bytes each."""
        known = self.units
        if chunk.isalpha() and self.letters:  # of bytes: A-Z and a-z only
            word = chunk.lower()
            return known[word] if word in known else self._unit(word)
        if _PLAIN.fullmatch(chunk):
            word = chunk.decode().lower().encode()
            if not any(s in word for s in self.special):
                return b"".join([known[u] if u in known else self._unit(u) for u in _UNITS.findall(word)])
        return array("I", self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()

    def _learn(self, fresh: list[bytes]) -> None:
        n = len(self.words)
        if n > len(self.first):
            grow = max(n, 2 * len(self.first)) - len(self.first)
            self.first, self.count = (np.append(x, np.zeros(grow, np.int64)) for x in (self.first, self.count))
        found = list(map(self._chunk, fresh))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        total = int(sizes.sum())
        if self.used + total > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids) + total, np.uint32))
        self.ids[self.used : self.used + total] = np.frombuffer(b"".join(found), np.uint32)
        self.first[n - len(fresh) : n] = self.used + np.cumsum(sizes) - sizes
        self.count[n - len(fresh) : n] = sizes
        self.used += total
        if len(self.units) > UNITS:
            self.units.clear()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids in one array, and where each text's begin (one more entry)."""
        words, at = split_words(texts)
        index, fresh = self.words.index(words)
        if fresh:
            self._learn(fresh)
        n = self.count[index]
        edge = np.concatenate(([0], np.cumsum(n)))
        out = self.ids[np.repeat(self.first[index] - edge[:-1], n) + np.arange(edge[-1])]
        if self.words.full():
            self.words, self.used = Words(), 0
        return out, edge[at]


_ENCODERS: dict[str, Encoder] = {}


def next_cut(place: int, size: int) -> int:
    """Where a block of `size` tokens is cut next after `place`: not before its last pieces begin, which are as many of each of the falling sizes."""
    each = int(size * SHARE) // sum(FALLING)
    begin = size - each * sum(FALLING)
    if place < begin:
        return begin
    for piece in FALLING:
        if place < begin + each * piece:
            return place + piece - (place - begin) % piece
        begin += each * piece
    return size


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, block long, whole long, tail boolean"


class _Block:
    """The rests of documents that make up the block at work, and the pieces of those that are done."""

    def __init__(self, task: int, size: int):
        self.task, self.size = task, size
        self.number, self.room = 0, size
        self.held: list[tuple] = []  # document, its tokens, start, ids
        self.rows: list[tuple] = []

    def add(self, doc: int | None, n: int, start: int, ids: np.ndarray) -> None:
        while len(ids):
            part, ids = ids[: self.room], ids[self.room :]
            self.held.append((doc, n, start, part))
            start += len(part)
            self.room -= len(part)
            if not self.room:
                self.close(False)

    def close(self, tail: bool) -> None:
        size, place = self.size - self.room, 0
        for doc, n, start, ids in self.held:
            a = 0
            while a < len(ids):
                b = min(len(ids), next_cut(place, size) - place + a)
                self.rows.append((doc, start + a, b - a, zlib.crc32(ids[a:b].tobytes()), n, self.task, self.number, None, tail))
                place, a = place + b - a, b
        self.held, self.room = [], self.size
        self.number += 1


def _pieces(path: str, capacity: int, end: int, block: int):
    """Whole windows (whole is the window's number in the task) and the pieces of each rest (block is the block's number in the task; tail: the task's last block, which isn't full)."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
        kinds = (*(pa.int64(),) * 5, pa.int32(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    def run(batches):
        from pyspark import TaskContext

        encoder = _ENCODERS[path] if path in _ENCODERS else _ENCODERS.setdefault(path, Encoder(path))
        last = np.array([end], "<u4")
        stream = _Block(TaskContext.get().partitionId(), block)
        whole = 0
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for begin, stop in chunks(texts):
                flat, edge = encoder.encode(texts[begin:stop])
                for i in range(stop - begin):
                    ids, doc = np.append(flat[edge[i] : edge[i + 1]], last), ids_of[begin + i]
                    n = len(ids)
                    full = n - n % capacity
                    for a in range(0, full, capacity):
                        stream.rows.append((doc, a, capacity, zlib.crc32(ids[a : a + capacity].tobytes()), n, stream.task, None, whole, False))
                        whole += 1
                    stream.add(doc, n, full, ids[full:].copy())  # nothing holds the rest of a long document
                yield batch_of(stream.rows)
                stream.rows = []
        stream.close(True)
        yield batch_of(stream.rows)

    return run


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """The items (by number) of each of `windows` near-equal parts: partial partitions with the greatest imbalances are merged, fullest parts with emptiest.

    A partial partition is its parts' sums above its least one, greatest first, and a node for what each part holds; parts that hold nothing are left out.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    heap: list[tuple[int, int, list[tuple[int, int]]]] = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    joined: list[tuple[int, int]] = []  # what nodes beyond the items hold
    n = len(sizes)
    while len(heap) > 1:
        _, tie, a = heapq.heappop(heap)
        _, _, b = heap[0]
        over = len(a) + len(b) - windows
        if over > 0:  # the least of the one meet the greatest of the other
            b = b[::-1]
            first = n + len(joined)
            joined.extend((x[1], y[1]) for x, y in zip(a[-over:], b, strict=False))
            merged = a[:-over] + [(x[0] + y[0], first + i) for i, (x, y) in enumerate(zip(a[-over:], b, strict=False))] + b[over:]
        else:
            merged = a + b
        merged.sort(reverse=True)
        if over >= 0 and merged[-1][0]:
            least = merged[-1][0]
            merged = [(x - least, node) for x, node in merged]
        heapq.heapreplace(heap, (-merged[0][0], tie, merged))
    out = []
    for _, root in heap[0][2] if heap else []:
        items, left = [], [root]
        while left:
            node = left.pop()
            if node < n:
                items.append(node)
            else:
                left.extend(joined[node - n])
        out.append(items)
    return out


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts within the capacity: as many as the sizes need, and one more as long as one is over it."""
    count = max(-(-sum(sizes) // capacity), 1)
    while True:
        parts = difference(sizes, count)
        if all(sum(sizes[i] for i in part) <= capacity for part in parts):
            return parts
        count += 1


def _pack_block(capacity: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = rows.column("length").to_pylist()
        number, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for w, part in enumerate(windows_of(sizes, capacity)):
            at = 0
            for i in sorted(part):
                number[i], offset[i] = w, at
                at += sizes[i]
        sequence = key[0].as_py() * (1 << 24) + number  # a block has fewer tokens, and so fewer windows
        return rows.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, key: str = "doc_id", text: str = "text", windows: int = 64, slack: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of each document."""
    spark = docs.sparkSession
    block = windows * (capacity - slack)
    if not 0 < block < 1 << 23:
        raise ValueError("a block must hold from 1 to 2**23 - 1 tokens")
    prepare(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = materialise(docs.mapInArrow(_pieces(tokenizer, capacity, end, block), PIECES), "pieces")
    full = F.max(F.when(~F.col("tail"), F.col("block") + 1))
    per = pieces.groupBy("task").agg(F.coalesce(full, F.lit(0)).alias("blocks"), F.coalesce(F.max("whole") + 1, F.lit(0)).alias("wholes"), F.coalesce(F.sum(F.when(F.col("tail"), F.col("length"))), F.lit(0)).alias("rest"))
    firsts, a, b, held = [], 0, 0, 0
    for r in sorted(per.collect(), key=lambda r: r["task"]):  # a row for each task of the scan
        firsts.append([r["task"], a, b, held // block])  # tails share blocks: each begins in the one that those before it have filled so far
        a, b, held = a + r["blocks"], b + r["wholes"], held + r["rest"]
    firsts = spark.createDataFrame([(t, x, y, a + z) for t, x, y, z in firsts], "task int, first_block long, first_whole long, tail_block long")
    placed = pieces.join(F.broadcast(firsts), "task")
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    whole = placed.where("whole IS NOT NULL").select(*columns, (-F.col("whole") - F.col("first_whole") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    blocks = placed.where("block IS NOT NULL").select(*columns, F.when(F.col("tail"), F.col("tail_block")).otherwise(F.col("first_block") + F.col("block")).alias("block"))
    packed = blocks.groupBy("block").applyInArrow(_pack_block(capacity), ", ".join(f"{c} long" for c in (*columns, "sequence_id", "offset")))
    return whole.union(packed)
