"""Fully sensitive approximate joins of probes with a reference: ungapped (Hamming) and gapped (banded edits).

Pigeonhole: with at most e errors, one of e + 1 disjoint seeds of a probe is intact. Either way the reference is scanned once:

* Few probes (PROBES, whose size is checked): a scan looks the reference's windows up in the seeds of both strands of all probes, forms candidate starts, removes repeats and verifies
  each candidate once; only hits leave the task.
* More: seeds are a stored table in buckets by code. The scan sends the windows that a bit map of all seeds lets through, with the bases around them; they meet their seeds in a join,
  whose most frequent codes are dealt over several tasks, and are verified where they meet. The driver sees counts and the bit map only.

The reference is a table of whole contigs (contig, seq) or of pieces of them (contig, at, own, seq; see sources/pieces.py), which must overlap by the longest probe and the gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions import tags
from ..sources import stage
from . import gapped, kmers, scan

#: Probes whose seeds are broadcast.
PROBES = 200_000
#: Bits of the map of seeds beyond that (8 MB). Where it is full it lets all windows through, and the join does the work.
SKETCH = 1 << 26
#: Tasks that a frequent seed is dealt to.
SALTS = 32
#: Codes, by their last bits, that the seeds may hold: a scan looks only these up.
SIEVE = 1 << 22
#: Places of probes that a scan weighs at once, and bases of the contigs that it takes together.
POSTS, BASES = 1 << 18, 1 << 18
HITS = "probe_id string, flag int, rname string, pos int, cigar string, nm int, md string, seq string, target string"


class Seeds:
    """Both strands of a block of probes, and where their seeds occur."""

    def __init__(self, probes: list[tuple[str, str]], errors: int, width: int):
        comp = str.maketrans("ACGT", "TGCA")
        self.names: list[str] = []
        self.flags: list[int] = []
        self.seqs: list[str] = []
        for name, seq in probes:
            for flag, s in ((0, seq), (16, seq.translate(comp)[::-1])):
                self.names.append(name)
                self.flags.append(flag)
                self.seqs.append(s)
        self.width = width
        self.lengths = np.array([len(s) for s in self.seqs], np.int64)
        longest = int(self.lengths.max(initial=0))
        self.matrix = np.full((len(self.seqs), longest), 5, np.uint8)
        inside = np.arange(longest) < self.lengths[:, None]
        self.matrix[inside] = scan.encode("".join(self.seqs).encode())
        found = []
        for at in range(0, min((errors + 1) * width, longest - width + 1), width):
            part = self.matrix[:, at : at + width].astype(np.int64)
            q = np.flatnonzero((part <= 3).all(1))
            found.append(np.stack([part[q] @ (1 << 2 * np.arange(width - 1, -1, -1)), q, np.full(len(q), at)], 1))
        rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        self.table, self.first = np.unique(rows[:, 0], return_index=True)
        self.last = np.append(self.first[1:], len(rows)) if len(self.first) else self.first
        self.query, self.offset = rows[:, 1], rows[:, 2]
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[self.table & (SIEVE - 1)] = True
        head = self.matrix[:, :64].astype(np.uint64)
        place = np.arange(head.shape[1], dtype=np.uint64)
        self.planes = [np.bitwise_or.reduce((x << place), axis=1, initial=0).astype(np.uint64) for x in (head & 1, head >> 1 & 1, (head > 3).astype(np.uint64))]

    def _places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a window is a seed, and which."""
        w, ok = scan.window_codes(codes, self.width)
        place = np.flatnonzero(ok & self.sieve[w & (SIEVE - 1)])
        seed = scan.found_in(w[place], self.table)
        return place[seed >= 0], seed[seed >= 0]

    def _posts(self, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, start) of each probe with the seeds."""
        n = self.last[seed] - self.first[seed]
        post = np.repeat(self.first[seed], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.query[post], np.repeat(place, n) - self.offset[post]

    def candidates(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (query, start) that a seed proposes."""
        query, start = self._posts(*self._places(codes))
        keep = (start >= 0) & (start + self.lengths[query] <= len(codes))
        both = np.unique(query[keep] * (len(codes) + 1) + start[keep])
        return both // (len(codes) + 1), both % (len(codes) + 1)

    def alike(self, windows: list[np.ndarray], query: np.ndarray, start: np.ndarray, errors: int, band: int) -> np.ndarray:
        """Which candidates may align within so many errors: at most `errors` bases of the probe differ from the base on every diagonal of the band (as any base without a match is an error).

        windows: `planes` of codes with 2 * band bases or more before them, which start counts. Of a long probe, the first bases decide.
        """
        size = np.minimum(self.lengths[query], 64 - 2 * band).astype(np.uint64)
        mine = [x[query] for x in self.planes]
        low, high, bad = (x[start - band] for x in windows)
        out = (np.uint64(1) << size) - np.uint64(1)
        for shift in range(2 * band + 1):
            d = np.uint64(shift)
            out &= (low >> d ^ mine[0]) | (high >> d ^ mine[1]) | (bad >> d) | mine[2]
        return np.bitwise_count(out) <= errors

    def near(self, codes: np.ndarray, errors: int, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (query, start), start up to `band` beside what a seed proposes, that may align within the errors and the band."""
        lead = 3 * band
        windows = planes(codes, lead)
        place, seed = self._places(codes)
        n = np.cumsum(self.last[seed] - self.first[seed])
        edges = np.unique(np.concatenate(([0], np.searchsorted(n, np.arange(POSTS, n[-1], POSTS)) if len(n) else [], [len(n)])).astype(np.int64))
        found = [np.zeros(0, np.int64)]
        for a, b in zip(edges, edges[1:], strict=False):
            query, start = self._posts(place[a:b], seed[a:b])
            keep = start >= -band
            query, start = query[keep], start[keep]
            keep = self.alike(windows, query, start + lead, errors, 2 * band)  # for all places beside it at once
            found.append(query[keep] * (len(codes) + lead) + start[keep] + band)
        both = np.unique((np.unique(np.concatenate(found))[:, None] + np.arange(-band, band + 1)).ravel())
        query, start = both // (len(codes) + lead), both % (len(codes) + lead) - band
        keep = (start >= 0) & (start < len(codes))
        query, start = query[keep], start[keep]
        keep = self.alike(windows, query, start + lead, errors, band)
        return query[keep], start[keep]


def planes(codes: np.ndarray, lead: int) -> list[np.ndarray]:
    """Of each place, with `lead` more before the first: the low bits of the 64 bases from there, their high bits, and which are no bases."""
    x = np.concatenate((np.full(lead, gapped.NONE, np.uint8), codes, np.full(64, gapped.NONE, np.uint8)))
    out = []
    for bits in (x & 1, x >> 1 & 1, x > 3):
        run, width = bits.astype(np.uint64), 1
        while width < 64:
            run[:-width] |= run[width:] << np.uint64(width)
            width *= 2
        out.append(run)
    return out


def reference(contigs: DataFrame, *more: str) -> DataFrame:
    """contig, more..., at, own, seq of whole contigs or of pieces: matches that begin in the first `own` bases are the row's."""
    pieces = "own" in contigs.columns
    at, own = (F.col("at").cast("long"), F.col("own").cast("long")) if pieces else (F.lit(0).cast("long"), F.length("seq").cast("long"))
    return contigs.select("contig", *more, at.alias("at"), own.alias("own"), "seq")


def _contigs(frames: Iterator[pd.DataFrame], overlap: int):
    """The reference in pieces: name, the row's bytes, the row's place in the contig, the piece's in the row, its codes, and how many of its first bases are its own."""
    for frame in frames:
        for name, at, own, seq in zip(frame["contig"], frame["at"], frame["own"], frame["seq"], strict=True):
            if seq:
                text = seq.upper().encode()
                codes = scan.encode(text)
                for offset, part in scan.pieces(codes, overlap):
                    mine = own - offset if offset + len(part) == len(codes) else min(own - offset, scan.PIECE)  # the next piece has the others
                    if mine > 0:
                        yield name, text, int(at), offset, part, int(mine)


def _ungapped(seeds, errors: int):
    def run(frames: Iterator[pd.DataFrame]):
        s = seeds.value
        longest = s.matrix.shape[1]
        rows: list[tuple] = []
        for name, text, at, offset, codes, own in _contigs(frames, max(longest - 1, 0)):
            query, start = s.candidates(codes)
            query, start = query[start < own], start[start < own]
            for i in range(0, len(query), 50_000):
                q, b = query[i : i + 50_000], start[i : i + 50_000]
                column = np.arange(longest)
                place = np.minimum(b[:, None] + column, len(codes) - 1)
                inside = column < s.lengths[q][:, None]
                wrong = ((codes[place] != s.matrix[q]) | (codes[place] > 3)) & inside
                nm = wrong.sum(1)
                for j in np.flatnonzero(nm <= errors):
                    k, begin = q[j], int(b[j]) + offset
                    n = int(s.lengths[k])
                    rows.append((s.names[k], s.flags[k], name, at + begin + 1, f"{n}M", int(nm[j]), None, s.seqs[k], text[begin : begin + n].decode()))
            if len(rows) > 10_000:
                yield pd.DataFrame(rows, columns=COLUMNS)
                rows = []
        yield pd.DataFrame(rows, columns=COLUMNS)

    return run


def _together(pieces: Iterator[tuple], size: int, between: int):
    """Pieces of the reference, some at a time: they, their codes in one array with as many places without a base behind each, and where each begins in it."""
    held: list[tuple] = []
    begin = [0]
    gap = np.full(between, gapped.NONE, np.uint8)

    def joined():
        return held, np.concatenate([x for piece in held for x in (piece[4], gap)]), np.array(begin[:-1], np.int64)

    for piece in pieces:
        held.append(piece)
        begin.append(begin[-1] + len(piece[4]) + between)
        if begin[-1] >= size:
            yield joined()
            held, begin = [], [0]
    if held:
        yield joined()


def _gapped(seeds, errors: int, bulges: int):
    def run(frames: Iterator[pd.DataFrame]):
        s = seeds.value
        longest = s.matrix.shape[1]
        rows: list[tuple] = []
        for held, codes, begins in _together(_contigs(frames, longest + 2 * bulges), BASES, longest + 2 * bulges):
            ends = begins + np.array([len(piece[4]) for piece in held], np.int64)
            owned = begins + np.array([piece[5] for piece in held], np.int64)
            query, start = s.near(codes, errors, bulges)
            which = np.searchsorted(begins, start, side="right") - 1
            keep = (start < owned[which]) & (start + s.lengths[query] - bulges <= ends[which])
            query, start, which = query[keep], start[keep], which[keep]
            for n in np.unique(s.lengths[query]):
                of = np.flatnonzero(s.lengths[query] == n)
                for i in range(0, len(of), 20_000):
                    q, b, c = (x[of[i : i + 20_000]] for x in (query, start, which))
                    hits = gapped.align(s.matrix[q, :n], codes, b, errors, bulges)
                    for j, nm, cigar, md, used in zip(hits.rows.tolist(), hits.edits.tolist(), hits.cigar, hits.md, hits.consumed.tolist(), strict=True):
                        k, (name, text, at, offset, _, _) = q[j], held[c[j]]
                        begin = int(b[j] - begins[c[j]]) + offset
                        rows.append((s.names[k], s.flags[k], name, at + begin + 1, cigar, nm, md, s.seqs[k], text[begin : begin + used].decode()))
            if len(rows) > 10_000:
                yield pd.DataFrame(rows, columns=COLUMNS)
                rows = []
        yield pd.DataFrame(rows, columns=COLUMNS)

    return run


COLUMNS = [c.split()[0] for c in HITS.split(", ")]
_HITS = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32()}[c.split()[1]]) for c in HITS.split(", ")])


WINDOWS = "code long, contig string, at long, own long, place int, before int, around string"
_BITS = 1 << 19  # bits of one row of the map, while it is put together


def _bit(codes: np.ndarray, size: int) -> np.ndarray:
    """A code's place in a map of `size` bits, a power of two."""
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _map_parts(size: int):
    """The parts of the map that a task's codes set."""

    def run(batches):
        bits, width = np.zeros(size, bool), min(_BITS, size)
        for batch in batches:
            bits[_bit(batch.column(0).to_numpy(zero_copy_only=False), size)] = True
        parts = [(i, np.packbits(bits[i * width : (i + 1) * width]).tobytes()) for i in range(size // width) if bits[i * width : (i + 1) * width].any()]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["part", "bits"])

    return run


def _either(batches):
    """Parts of the map, put together."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bits = np.frombuffer(bits, np.uint8)
            found[i] = found[i] | bits if i in found else bits
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["part", "bits"])


def _sketched(seeds, width: int, before: int, after: int):
    """The windows that the map lets through, with the bases around them."""

    def run(batches):
        bits = seeds.value
        size = 8 * len(bits)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for name, at, own, seq in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                text = (seq or "").upper()
                codes = scan.encode(text.encode())
                for offset, part in scan.pieces(codes, width - 1):
                    w, ok = scan.window_codes(part, width)
                    bit = _bit(w, size)
                    place = np.flatnonzero(ok & (bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool))
                    if offset + len(part) < len(codes):
                        place = place[place < scan.PIECE]
                    code, place = w[place], place + offset
                    rows[0].extend(code.tolist())
                    for p in place.tolist():
                        left = min(p, before)
                        for column, x in zip(rows[1:], (name, at, own, p, left, text[p - left : p + after]), strict=True):
                            column.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[c.split()[0] for c in WINDOWS.split(", ")])

    return run


def _verified(errors: int, bulges: int):
    """Hits among seeds that met a window."""

    def run(batches):
        for batch in batches:
            probe, flag, seq, offset, contig, at, own, place, before, around = (x.to_pylist() for x in batch.columns)
            length = np.fromiter(map(len, seq), np.int64, len(seq))
            shifts = np.arange(-bulges, bulges + 1)
            start = (np.array(place, np.int64) - np.array(offset, np.int64))[:, None] + shifts  # in the row of the reference
            here = (np.array(before, np.int64) - np.array(offset, np.int64))[:, None] + shifts  # in the bases around
            mine = (start >= 0) & (start < np.array(own, np.int64)[:, None]) & (here >= 0) if len(seq) else np.zeros((0, len(shifts)), bool)
            rows: list[tuple] = []
            for n in np.unique(length):
                i, k = np.nonzero(mine & (length == n)[:, None])
                span = int(n) + bulges
                texts = [around[x][b : b + span] for x, b in zip(i.tolist(), here[i, k].tolist(), strict=True)]
                fits = np.fromiter((len(t) >= n - bulges for t in texts), bool, len(texts))
                i, k, texts = i[fits], k[fits], [t for t, f in zip(texts, fits, strict=True) if f]
                if not texts:
                    continue
                codes = scan.encode("".join(t.ljust(span, "-") for t in texts).encode()).reshape(len(texts), span)
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                codes = np.where(np.arange(span) < size[:, None], codes, gapped.NONE)
                query = scan.encode("".join(seq[x] for x in i.tolist()).encode()).reshape(len(texts), int(n))
                if bulges:
                    h = gapped.align(query, codes.ravel(), np.arange(len(texts)) * span, errors, bulges)
                    found = zip(h.rows.tolist(), h.edits.tolist(), h.cigar, h.md, h.consumed.tolist(), strict=True)
                else:
                    nm = ((codes != query) | (codes > 3)).sum(1)
                    found = ((j, int(nm[j]), f"{n}M", None, int(n)) for j in np.flatnonzero((nm <= errors) & (size == n)).tolist())
                for j, edits, cigar, md, used in found:
                    x = i[j]
                    rows.append((probe[x], flag[x], contig[x], at[x] + int(start[x, k[j]]) + 1, cigar, edits, md, seq[x], texts[j][:used]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HITS, strict=True)], schema=_HITS)

    return run


def _few(probes: DataFrame, errors: int, most: int) -> tuple[DataFrame, list | None, int]:
    """The distinct probes, all of them if they are at most so many, and the width of their seeds: as wide as the shortest probe allows."""
    wanted = probes.select("probe_id", "seq").distinct()
    r = wanted.agg(F.count("*").alias("n"), F.min(F.length("seq")).alias("shortest")).first()
    width = min((r["shortest"] or errors + 1) // (errors + 1), 31)
    if r["n"] and width < 1:
        raise ValueError("the shortest probe is too short for this many errors")
    few = sorted((p["probe_id"], p["seq"]) for p in wanted.collect()) if r["n"] <= most else None
    return wanted, few, max(width, 1)


def seed_index(probes: DataFrame, errors: int, width: int) -> DataFrame:
    """code, offset, probe_id, flag, seq: the seeds of both strands of each probe, stored in buckets by code."""
    both = probes.select("probe_id", F.lit(0).alias("flag"), "seq").union(probes.select("probe_id", F.lit(16), S.revcomp(F.col("seq"))))
    offset = F.explode(F.sequence(F.lit(0), F.lit(errors * width), F.lit(width)))
    seeds = both.withColumn("offset", offset).withColumn("seed", F.substr("seq", F.col("offset") + 1, F.lit(width)))
    seeds = seeds.where((F.length("seed") == width) & ~F.rlike("seed", F.lit("[^ACGT]")))
    return stage.bucketed(seeds.select(kmers.code(F.col("seed"), width).alias("code"), "offset", "probe_id", "flag", "seq"), "seed-index", "code")


def _joined(probes: DataFrame, ref: DataFrame, errors: int, bulges: int, width: int) -> DataFrame:
    """Hits of any number of probes: one scan of the reference, one join with the stored seeds."""
    spark = probes.sparkSession
    index = seed_index(probes, errors, width)
    longest = probes.agg(F.max(F.length("seq"))).first()[0] or width
    size = SKETCH
    parts = index.select("code").mapInArrow(_map_parts(size), "part int, bits binary").repartition("part").mapInArrow(_either, "part int, bits binary").collect()
    bits, step = np.zeros(size // 8, np.uint8), min(_BITS, size) // 8
    for p in parts:  # SKETCH / _BITS rows at most
        bits[p["part"] * step : (p["part"] + 1) * step] = np.frombuffer(p["bits"], np.uint8)
    scanned = ref.mapInArrow(_sketched(spark.sparkContext.broadcast(bits), width, errors * width + bulges, longest + 2 * bulges), WINDOWS)
    windows = stage.keep(scanned, "windows")
    met = stage.join_hot(windows, index, "code", SALTS)
    hits = met.select("probe_id", "flag", "seq", "offset", "contig", "at", "own", "place", "before", "around").mapInArrow(_verified(errors, bulges), HITS)
    return hits.dropDuplicates(["probe_id", "flag", "rname", "pos", "seq"])  # a place that several seeds propose


def _aligned(probes: DataFrame, contigs: DataFrame, errors: int, bulges: int, most: int) -> DataFrame:
    wanted, few, width = _few(probes, errors, most)
    ref = reference(contigs)
    if few is None:
        return _joined(wanted, ref, errors, bulges, width)
    seeds = probes.sparkSession.sparkContext.broadcast(Seeds(few, errors, width))
    return ref.mapInPandas(_gapped(seeds, errors, bulges) if bulges else _ungapped(seeds, errors), HITS)


def align_ungapped(probes: DataFrame, contigs: DataFrame, errors: int, most: int = PROBES) -> DataFrame:
    """All places of the contigs within `errors` substitutions of a probe or its reverse complement.

    probes: probe_id, seq. contigs: contig, seq, whole or in pieces. N in the reference is a mismatch. The probes are counted when this is called; more than `most` are joined.
    """
    return _aligned(probes, contigs, errors, 0, most).withColumn("md", tags.md_ungapped(F.col("seq"), F.col("target")))


def align_gapped(probes: DataFrame, contigs: DataFrame, errors: int, bulges: int, most: int = PROBES) -> DataFrame:
    """As align_ungapped with up to `bulges` single-base insertions or deletions among the errors; dominated overlaps are dropped."""
    if not bulges:
        return align_ungapped(probes, contigs, errors, most)
    return suppress_overlaps(_aligned(probes, contigs, errors, bulges, most), errors)


_FUSED = pa.schema([*_HITS, ("grp", pa.string()), ("code", pa.int64()), ("n", pa.int64())])


def _fused(seeds, errors: int, k: int, table):
    hits_of, counts_of = _ungapped(seeds, errors), kmers.counter(k, table, 1)

    def row(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in _FUSED], schema=_FUSED)

    def run(batches):
        for batch in batches:  # contig, grp, at, own, seq
            for hits in hits_of(iter([batch.to_pandas()])):
                yield row(len(hits), **{c: pa.array(hits[c].tolist(), _FUSED.field(c).type) for c in COLUMNS})
            own = [(s or "")[: n + k - 1] for s, n in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            for part in counts_of(iter([pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.string())], names=["grp", "seq"])])):
                yield row(part.num_rows, grp=part.column(0), code=part.column(1), n=part.column(2))

    return run


def align_and_count(probes: DataFrame, words: DataFrame, contigs: DataFrame, errors: int, k: int) -> tuple[DataFrame, DataFrame]:
    """align_ungapped of probes and count_kmers of words (column ckmer) by group, from one scan of the contigs; what the scan finds is written as a stage.

    Where the probes or the k-mers are too many for one broadcast, they are scanned for apart.
    """
    _, few, width = _few(probes, errors, PROBES)
    codes = kmers.wanted_codes(words, k)
    if few is None or codes is None:
        return align_ungapped(probes, contigs, errors), kmers.count_kmers(contigs, words, k)
    context = contigs.sparkSession.sparkContext
    seeds, table = context.broadcast(Seeds(few, errors, width)), context.broadcast(codes)
    found = stage.keep(reference(contigs, "grp").mapInArrow(_fused(seeds, errors, k, table), HITS + ", grp string, code long, n long"), "fused-scan")
    hits = found.where("code IS NULL").select(*COLUMNS).withColumn("md", tags.md_ungapped(F.col("seq"), F.col("target")))
    return hits, kmers.summed(found.where("code IS NOT NULL").select("grp", "code", "n"), words, k, ("grp",))


def suppress_overlaps(hits: DataFrame, errors: int, width: int = 1 << 16) -> DataFrame:
    """Drop hits that overlap a kept hit of the same probe, strand and contig with strictly fewer edits.

    A dropped hit suppresses nothing, so hits are settled by their number of edits. Whether a hit stays is decided by hits of fewer edits that overlap it, which are decided in turn by
    such as overlap them: at most `errors` steps of a hit's length away. So hits are settled in bins of `width` bases, each with the hits so far around it, and
    every hit is taken from its own bin; however many hits a probe has on a contig, one shuffle deals them out. In a bin, at each level, the furthest end of the kept hits before a hit and
    the nearest begin of those after it tell whether one overlaps it.
    """
    far = F.lit(errors) * (F.length("seq") + errors)  # no hit is longer than its probe and the gaps
    bin_of = lambda x: F.floor(x / width)
    begin, end = F.col("pos"), F.col("pos") + F.length("target")
    out = hits.withColumns({"_b": begin, "_e": end, "_kept": F.col("nm") == 0, "_own": bin_of(begin)})
    out = out.withColumn("_bin", F.explode(F.sequence(bin_of(begin - far), bin_of(end + far))))
    own = Window.partitionBy("probe_id", "flag", "rname", "_bin")
    before = own.orderBy("_b", "_e", "nm").rowsBetween(Window.unboundedPreceding, -1)
    after = own.orderBy(F.desc("_b"), F.desc("_e"), F.desc("nm")).rowsBetween(Window.unboundedPreceding, -1)
    for level in range(1, errors + 1):
        ends, begins = F.max(F.when(F.col("_kept"), F.col("_e"))).over(before), F.min(F.when(F.col("_kept"), F.col("_b"))).over(after)
        out = out.withColumns({"_before": ends, "_after": begins})
        free = F.coalesce(F.col("_before") <= F.col("_b"), F.lit(True)) & F.coalesce(F.col("_after") >= F.col("_e"), F.lit(True))
        out = out.withColumn("_kept", F.col("_kept") | ((F.col("nm") == level) & free))
    return out.where("_kept AND _bin = _own").select(*hits.columns)


def dedup(hits: DataFrame, order: str = "line") -> DataFrame:
    """One hit for each (probe, contig, place, strand): the first by `order`."""
    w = Window.partitionBy("probe_id", "rname", "pos", F.col("flag").bitwiseAND(16)).orderBy(order)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def within_budget(hits: DataFrame, errors: int, bulges: int) -> DataFrame:
    """Hits whose substitutions and bulges, recomputed from the tags, keep the budget; hits without MD go."""
    subs, gaps = tags.substitutions(F.col("md")), tags.bulges(F.col("cigar"))
    return hits.where(F.col("md").isNotNull() & (subs + gaps <= errors) & (gaps <= bulges))


def capped(hits: DataFrame, cap: int | None) -> DataFrame:
    """At most `cap` hits for each probe, where a cap is asked for."""
    if cap is None:
        return hits
    w = Window.partitionBy("probe_id").orderBy("nm", "rname", "pos", "flag")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
