"""SentencePiece-style encoding with seeded merge-dropout, and its lossless decoding.

A unit (a word with the spaces before it, or a line break) starts as characters. The agenda holds the adjacent pairs whose union is a
piece, best score first, leftmost among equals. A candidate is skipped if the keyed hash of (seed, text's checksum, number of the unit in the
text, unit, place, merge) falls below the dropout rate: every occurrence of a unit has draws of its own.
Encoding is a pure function of seed and text, so retried tasks give the same ids.
A table holds what each unit becomes without skips, and the candidates on that way: if an occurrence's draws skip none of them, as most do,
that is its outcome. The other occurrences are worked out anew, each by its own draws, thousands at a time, one candidate of each after another, with numpy.
With rate 0 the ids are those of the library's own encoder. Characters that are no piece become byte pieces.

Edge cases: a null text is the empty text, with no ids; the piece of the space mark (U+2581) in a text is written as bytes, so that decoding is exact;
rows are encoded each, equal texts alike; an empty table gives no rows; other columns are ignored. A very long text is encoded whole by one task, with some 200 bytes a unit; a unit of more
than 40 characters, or with a character that is no piece, by itself, the longer ones with a heap as their agenda.
"""

from __future__ import annotations

import re
import zlib
from heapq import heappop, heappush
from itertools import islice, pairwise
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

MARK = "▁"
UNIT = re.compile(r" *[^ \n]+|\n| +")
TABLE = 500_000  # units held; a fuller table is begun anew
SHORT = 40  # up to so many characters a plain list is the faster agenda
BATCH = 4096  # units that are merged side by side
BLOCK = 1 << 18  # units whose candidates are drawn, or pieces that are decoded, at once
NEVER = 1 << 62


class Pool:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type):
        self.values, self.used = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> int:
        """Where the added values begin."""
        begin, self.used = self.used, self.used + len(values)
        while self.used > len(self.values):
            self.values = np.concatenate((self.values, np.zeros_like(self.values)))
        self.values[begin : self.used] = values
        return begin


class Units(dict):
    """Numbers of units, in the order in which they were first asked for."""

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        return number


def _runs(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of an array, one run after another."""
    return np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Codec:
    def __init__(self, path: str, rate: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.seed, self.limit = seed, int(rate * 4294967296)
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.rank: dict[str, int] = {}  # of each piece as a merge: the lowest goes first
        self.bytes_of: list[bytes] = []
        scores: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            body = b""
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                body = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                scores[piece] = model.get_score(i)
                body = piece.replace(MARK, " ").encode()
            self.bytes_of.append(body)
        order = {x: i for i, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: order[x] for piece, x in scores.items()}
        self.none = len(self.bytes_of)  # stands where no symbol is
        lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        self.body, self.body_end, self.body_size = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.cumsum(lengths), lengths
        # merges of two symbols by their numbers, as (rank, room for a place, piece) in one number: a hash table with linear probing
        merges = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    merges[left << 20 | right] = self.rank[piece] << 26 | i
        pairs, values = np.array(list(merges), np.int64), np.array(list(merges.values()), np.int64)
        slots = 1 << max(10, (4 * len(pairs)).bit_length())
        self.slot_pair, self.slot_merge = np.full(slots, -1, np.int64), np.full(slots, NEVER, np.int64)
        at = self._slot(pairs)
        while len(pairs):
            free = self.slot_pair[at] < 0
            self.slot_pair[at[free]] = pairs[free]  # of several at one slot, one stays
            held = self.slot_pair[at] == pairs
            self.slot_merge[at[held]] = values[held]
            pairs, values, at = pairs[~held], values[~held], (at[~held] + 1) & (slots - 1)
        self.id_of_char = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.id_of_char[ord(piece)] = i
        self.id_of_char[ord(" ")] = self.ids.get(MARK, -1)
        self.id_of_char[ord(MARK)] = -1  # a mark in the text becomes bytes
        single = {c for piece in self.ids for c in piece}
        self.alone = all(c in self.ids for c in single)  # else a character that is no piece may be part of one
        self.forget()

    def key(self, unit: str, at: int, text: int = 0) -> int:
        """Key of the draws of a text's unit number `at`; text: the text's checksum."""
        return int(self._keys(np.array([zlib.crc32(unit.encode("utf-8", "surrogatepass"))], np.uint64), np.array([at], np.uint64), np.array([text], np.uint64))[0])

    def _keys(self, units: np.ndarray, at: np.ndarray, texts: np.ndarray) -> np.ndarray:
        x = units | texts << np.uint64(32)
        with np.errstate(over="ignore"):
            for y in (at + np.uint64((self.seed * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF), np.uint64(0)):
                x = (x ^ y) * np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(32)
        return x & np.uint64(0xFFFFFFFF)

    def skipped(self, key: int, at: int, rank: int) -> bool:
        """Keyed hash of a candidate: the unit's key, the place of its left character and the merge."""
        x = ((key ^ (at * 0x9E3779B1)) + rank * 0x85EBCA6B) & 0xFFFFFFFF
        x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
        x = ((x ^ (x >> 12)) * 0x297A2D39) & 0xFFFFFFFF
        return (x ^ (x >> 15)) < self.limit

    def merge_short(self, symbols: list[str], key: int) -> list[str]:
        """The agenda as a list of the adjacent pairs' ranks."""
        rank = self.rank
        pairs = [rank.get(a + b, NEVER) if a and b else NEVER for a, b in zip(symbols, symbols[1:], strict=False)]
        places = list(range(len(symbols)))
        while pairs:
            r = min(pairs)
            if r == NEVER:
                break
            i = pairs.index(r)
            if self.limit and self.skipped(key, places[i], r):
                pairs[i] = NEVER  # until one of its symbols changes
                continue
            symbols[i] += symbols[i + 1]
            del symbols[i + 1], places[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank.get(symbols[i] + symbols[i + 1], NEVER) if symbols[i + 1] else NEVER
            if i:
                pairs[i - 1] = rank.get(symbols[i - 1] + symbols[i], NEVER) if symbols[i - 1] else NEVER
        return symbols

    def merge_long(self, symbols: list[str], key: int) -> list[str]:
        """The agenda as a heap, for long units: the same merges."""
        rank, n = self.rank, len(symbols)
        after, before, dead = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        agenda = []

        def propose(i: int, j: int) -> None:
            if i >= 0 and j < n and symbols[i] and symbols[j] and (r := rank.get(symbols[i] + symbols[j])) is not None:
                heappush(agenda, (r, i, symbols[i] + symbols[j]))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            r, i, piece = heappop(agenda)
            j = after[i]
            if dead[i] or j >= n or symbols[i] + symbols[j] != piece or self.limit and self.skipped(key, i, r):
                continue
            symbols[i], dead[j] = piece, True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            propose(i, after[i])
            propose(before[i], i)
        return [s for s, gone in zip(symbols, dead, strict=True) if not gone]

    def encode_unit(self, unit: str, key: int = 0) -> bytes:
        symbols = [MARK if c == " " else ("" if c == MARK else c) for c in unit]  # the mark itself becomes bytes
        merged = self.merge_short(symbols, key) if len(symbols) <= SHORT else self.merge_long(symbols, key)
        out: list[int] = []
        for s in merged:
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in (s or MARK).encode()]
        return pack(f"<{len(out)}I", *out)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * 0x1E3779B97F4A7C15 >> 40) & (len(self.slot_pair) - 1)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merges of two arrays of symbols (NEVER where there is none)."""
        pair = left << 20 | right
        at = self._slot(pair)
        held, found = self.slot_pair[at], self.slot_merge[at]
        other = np.flatnonzero(held != pair)
        found[other] = NEVER
        other = other[held[other] >= 0]
        while len(other):
            at[other] = slot = (at[other] + 1) & (len(self.slot_pair) - 1)
            held, same = self.slot_pair[slot], self.slot_pair[slot] == pair[other]
            found[other[same]] = self.slot_merge[slot[same]]
            other = other[(held >= 0) & ~same]
        return found

    def _skipped(self, keys: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """skipped() of many candidates, all in 32 bits."""
        x = (keys ^ (at * np.uint32(0x9E3779B1))) + rank * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        x *= np.uint32(0x297A2D39)
        x ^= x >> np.uint32(15)
        return x <= np.uint32(self.limit - 1)

    def _merge(self, symbols: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merges columns of symbols side by side: the ids of all, how many each has; the candidates of all (without keys, which skip some), how many each has."""
        size, n = symbols.shape
        symbol = np.full((size + 1) * n, self.none, np.int64)  # the last row stands for what is outside
        symbol[: size * n] = symbols.ravel()
        after = np.arange(n, (size + 2) * n)
        before = np.arange(-n, size * n)
        before[:n] += (size + 1) * n
        place = np.repeat(np.arange(size + 1) << 20, n)
        agenda = np.full((size + 1) * n, NEVER, np.int64)
        agenda[: (size - 1) * n] = self._look_up(symbol[: (size - 1) * n], symbol[n : size * n]) | place[: (size - 1) * n]
        left = agenda.reshape(size + 1, n)[:size]
        taken = []
        while True:
            best = left.min(0)  # the leftmost of the best
            rows = np.flatnonzero(best < NEVER)
            if not len(rows):
                break
            if keys is None:
                taken.append(best)
            best = best[rows]
            spot = best >> 20 & 63
            at = spot * n + rows
            if keys is not None:
                skip = self._skipped(keys[rows], spot.astype(np.uint32), (best >> 26).astype(np.uint32))
                agenda[at[skip]] = NEVER  # until one of its symbols changes
                at, best = at[~skip], best[~skip]
            made = best & 0xFFFFF
            gone, prior = after[at], before[at]
            then = after[gone]
            symbol[at], symbol[gone] = made, self.none
            after[at], before[then] = then, at
            agenda[gone] = NEVER
            found = self._look_up(np.concatenate((made, symbol[prior])), np.concatenate((symbol[then], made)))
            agenda[at], agenda[prior] = found[: len(at)] | place[at], found[len(at) :] | place[prior]
        out = np.ascontiguousarray(symbol[: size * n].reshape(size, n).T)
        there = out != self.none
        way = np.array(taken, np.int64).reshape(-1, n).T
        real = way < NEVER
        return out[there], there.sum(1), way[real], real.sum(1)

    def _merged(self, begin: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None):
        """_merge() of units by the places of their symbols, those of like sizes together: (which units, its results) of each batch."""
        order = np.argsort(sizes, kind="stable")
        ordered = sizes[order]
        i = 0
        while i < len(order):
            j = min(i + BATCH, int(np.searchsorted(ordered, ordered[i] * 5 // 4 + 1, "right")))
            some, width = order[i:j], int(ordered[j - 1])
            spread = np.arange(width)[:, None]
            at = np.minimum(begin[some] + spread, self.symbols.used - 1)
            yield some, self._merge(np.where(spread < sizes[some], self.symbols.values[at], self.none), None if keys is None else keys[some])
            i = j

    def forget(self) -> None:
        """Empty the table: of each unit its checksum, symbols, and ids and candidates without skips."""
        self.units = Units()
        self.known = 0  # units whose columns are filled
        self.crc = Pool(np.uint64)
        self.own = Pool(np.bool_)  # encoded on its own
        self.symbols, self.symbols_at, self.symbols_n = Pool(np.int32), Pool(np.int64), Pool(np.int64)
        self.out, self.out_at, self.out_n = Pool(np.uint32), Pool(np.int64), Pool(np.int64)
        self.places, self.ranks, self.drawn_at, self.drawn_n = Pool(np.uint32), Pool(np.uint32), Pool(np.int64), Pool(np.int64)

    def learn(self) -> None:
        """Fill the columns of the units that were asked for since."""
        units = list(islice(reversed(self.units), len(self.units) - self.known))[::-1]
        n, self.known = len(units), len(self.units)
        self.crc.add(np.array([zlib.crc32(u.encode("utf-8", "surrogatepass")) for u in units], np.uint64))
        sizes = np.fromiter(map(len, units), np.int64, n)
        symbols = self.id_of_char[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        own = sizes > SHORT
        own[np.repeat(np.arange(n), sizes)[symbols < 0]] = True
        if not self.alone:
            own |= sizes > 0
        self.symbols_at.add(self.symbols.add(symbols) + np.cumsum(sizes) - sizes)
        self.symbols_n.add(sizes)
        out_at, out_n, drawn_at, drawn_n = (np.zeros(n, np.int64) for _ in range(4))
        for i in np.flatnonzero(own if not self.limit else own & (sizes == 1)).tolist():  # without draws, or with nothing to draw
            ids = np.frombuffer(self.encode_unit(units[i]), "<u4")
            out_at[i], out_n[i], own[i] = self.out.add(ids), len(ids), False
            sizes[i] = 0
        plain = np.flatnonzero(~own & (sizes > 0))
        begin = self.symbols_at.values[self.symbols_at.used - n :]
        for some, (ids, counts, way, drawn) in self._merged(begin[plain], sizes[plain], None):
            which = plain[some]
            out_at[which], out_n[which] = self.out.add(ids) + np.cumsum(counts) - counts, counts
            if self.limit:
                self.places.add(way >> 20 & 63)
                drawn_at[which], drawn_n[which] = self.ranks.add(way >> 26) + np.cumsum(drawn) - drawn, drawn
        for column, values in ((self.own, own), (self.out_at, out_at), (self.out_n, out_n), (self.drawn_at, drawn_at), (self.drawn_n, drawn_n)):
            column.add(values)

    def with_skips(self, node: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which occurrences skip a candidate of their units' way without skips."""
        found = np.zeros(len(node), bool)
        for i in range(0, len(node), BLOCK):
            some = node[i : i + BLOCK]
            counts = self.drawn_n.values[some]
            at = _runs(self.drawn_at.values[some], counts)
            skip = self._skipped(np.repeat(keys[i : i + BLOCK], counts), self.places.values[at], self.ranks.values[at])
            found[np.repeat(np.arange(i, i + len(some)), counts)[skip]] = True
        return np.flatnonzero(found)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        every: list[str] = []
        sizes = []
        for text in texts:
            text_ = " " + text
            if not text:
                units = []
            elif "  " in text_ or "\0" in text_:
                units = UNIT.findall(text_)
            else:  # the same units, and empty ones
                units = text_.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            every += units
            sizes.append(len(units))
        if len(self.units) > TABLE:
            self.forget()
        node = np.fromiter(map(self.units.__getitem__, every), np.int64, len(every))
        if len(self.units) > self.known:
            self.learn()
        begin, counts, parts = self.out_at.values[node], self.out_n.values[node], [self.out.values[: self.out.used]]
        end = self.out.used
        ends = np.cumsum(sizes, dtype=np.int64)
        if self.limit and len(node):
            checks = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
            at = np.arange(len(node)) - np.repeat(ends - sizes, sizes)
            keys = self._keys(self.crc.values[node], at.astype(np.uint64), np.repeat(checks, sizes)).astype(np.uint32)
            anew = self.with_skips(node, keys)
            for some, (ids, n, _, _) in self._merged(self.symbols_at.values[node[anew]], self.symbols_n.values[node[anew]], keys[anew]):
                begin[anew[some]], counts[anew[some]] = end + np.cumsum(n) - n, n
                parts.append(ids.astype(np.uint32))
                end += len(ids)
            for i in np.flatnonzero(self.own.values[node]).tolist():
                ids = np.frombuffer(self.encode_unit(every[i], int(keys[i])), "<u4")
                begin[i], counts[i] = end, len(ids)
                parts.append(ids)
                end += len(ids)
        blob = np.concatenate(parts)[_runs(begin, counts)].astype("<u4").tobytes()
        cuts = (4 * np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], ends))]).tolist()
        return [blob[a:b] for a, b in pairwise(cuts)]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode_many(self, texts: list[bytes]) -> list[str]:
        """The texts of ids."""
        ids = np.frombuffer(b"".join(texts), "<u4")
        sizes = self.body_size[ids]
        begin = self.body_end[ids] - sizes
        blob = b"".join(self.body[_runs(begin[i : i + BLOCK], sizes[i : i + BLOCK])].tobytes() for i in range(0, len(ids), BLOCK))
        ends = np.cumsum([len(x) // 4 for x in texts], dtype=np.int64)
        cuts = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends))].tolist()
        return [blob[a + 1 : b].decode() for a, b in pairwise(cuts)]  # without the space before the text

    def decode(self, ids: bytes) -> str:
        return self.decode_many([ids])[0]


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, rate: float, seed: int) -> Codec:
    """One codec for each Python worker, kept between its tasks."""
    key = (path, rate, seed)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, rate, seed)
    return _CODECS[key]


def encoded(c: Codec, texts: list[str | None]):
    """(texts, ids) about a million characters at a time; one long text stays whole."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size > 1_000_000:
            yield part, c.encode_many(part)
            part, size = [], 0
    yield part, c.encode_many(part)


def _encode(path: str, rate: float, seed: int):
    def run(batches):
        c = codec(path, rate, seed)
        for batch in batches:
            found = [np.frombuffer(ids, "<i4") for _, part in encoded(c, batch.column(1).to_pylist()) for ids in part]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        c = codec(path, 0.0, 0)
        for batch in batches:
            texts = [c.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _digest(path: str, rate: float, seed: int):
    def run(batches):
        c = codec(path, rate, seed)
        for batch in batches:
            rows = []
            for texts, found in encoded(c, batch.column(1).to_pylist()):
                rows += [(len(ids) // 4, zlib.crc32(ids), back == text) for text, ids, back in zip(texts, found, c.decode_many(found), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True))], names=["doc_id", "n_ids", "ids_crc32", "lossless"])

    return run


def encode(docs: DataFrame, path: str, rate: float = 0.1, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) for each row of docs."""
    prepare(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encode(path, rate, seed), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text for each row of (doc_id, ids)."""
    prepare(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, rate: float = 0.1, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 and whether decoding gives the text back."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_digest(path, rate, seed), "doc_id long, n_ids long, ids_crc32 long, lossless boolean")
