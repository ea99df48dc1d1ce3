"""Content-addressed media payloads in tar shards, with metadata columns from header-only range reads.

A payload is stored under its digest as an 8-bit grey PNG in a tar shard in the shared folder.
Rows carry the digest, shard, offset and length of the stored form, one place for each digest: a task stores a payload once, and of the copies that
several tasks stored at the same time, the index names one (moving all payloads by digest first would cost more disk than it saves).
`header_columns` fills columns from the image headers alone, a range of 33 bytes each; `media_columns` reads members whole and computes features.

A shard's name is drawn anew by each attempt of a task, and only the shards of attempts that succeeded are in
the index, so lost executors and retried tasks leave no broken rows.

Edge cases: a null text is the empty text, whose payload is one unit of padding; equal texts share payload, stored
form and features; rows without id keep a null id; an empty table gives no rows; other columns are ignored. A very long text is held by one task
as text, payload, image rows and image, about four times its bytes.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare, stage_path, utf8

WIDTH = 24  # samples in an image row; a unit is a square
HEADER = 33  # bytes of a PNG's signature and image header


def payload_of(text: bytes, unit: int) -> bytes:
    return text + b"\xff" * (unit - len(text) if len(text) < unit else -len(text) % unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 4) -> bytes:
    """8-bit grey samples, WIDTH in a row, no filter."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">IIB", head[16:25])


def decode_png(data: bytes) -> bytes:
    width, height, depth = read_header(data[:HEADER])
    at, body = HEADER, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if depth != 8 or rows[:, 0].any():
        raise ValueError("only unfiltered 8-bit images are stored")
    return rows[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Mean, deviation and a 4-bin histogram of the samples, as whole numbers."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x >> 6, minlength=4)
    total, squares = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    n = len(x)
    return f"mean={total * 1000 // n};var={(squares * n - total * total) // (n * n)};hist={'-'.join(map(str, counts))}"


def _filesystem(uri: str):
    """The folder's file system and path, as the executors see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _store(folder: str, unit: int, shard_bytes: int):
    def run(batches):
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        seen: dict[bytes, tuple[str, int, int]] = {}
        tar: tarfile.TarFile | None = None
        out = None
        name = ""
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                body = payload_of(text, unit)
                digest = hashlib.sha256(body).digest()
                if digest not in seen:
                    if tar is None or tar.offset >= shard_bytes:
                        if tar is not None:
                            tar.close()
                            out.close()
                        name = f"shard-{uuid.uuid4().hex}.tar"
                        out = files.open_output_stream(f"{root}/{name}")
                        tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT)
                    if len(seen) >= 100_000:  # a table of places, not a cap: what leaves it is only stored again
                        seen.clear()
                    media = encode_png(body)
                    member = tarfile.TarInfo(digest.hex() + ".png")
                    member.size = len(media)
                    at = tar.offset + 512
                    tar.addfile(member, io.BytesIO(media))
                    seen[digest] = (name, at, len(media))
                rows.append((doc, len(text), digest, *seen[digest]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, INDEX.types, strict=True)], schema=INDEX)
        if tar is not None:
            tar.close()
            out.close()

    return run


INDEX = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
SPARK_INDEX = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"
HEADS = "digest binary, shard string, offset long, length long, width int, height int, payload_bytes long"
READ = "digest binary, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _ranges(folder: str):
    """A reader of ranges of shards that keeps the last shard open."""
    files, root = _filesystem(folder)
    name, source = "", None

    def read(shard: str, at: int, length: int) -> bytes:
        nonlocal name, source
        if shard != name:
            name, source = shard, files.open_input_file(f"{root}/{shard}")
        return source.read_at(length, at)

    return read


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _heads(folder: str):
    def run(batches):
        read = _ranges(folder)
        for batch in batches:
            rows = []
            for digest, shard, at, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                width, height, depth = read_header(read(shard, at, HEADER))
                rows.append((digest, shard, at, length, width, height, width * height * depth // 8))
            yield _batch(rows, HEADS)

    return run


def _read(folder: str):
    def run(batches):
        read = _ranges(folder)
        for batch in batches:
            rows = []
            for digest, shard, at, length, width, height, size in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                media = read(shard, at, length)
                samples = decode_png(media)
                sha = hashlib.sha256(samples)
                if sha.digest() != digest or size != len(samples):
                    raise ValueError(f"{shard} at {at} does not hold what its digest says")
                rows.append((digest, width, height, size, sha.hexdigest(), zlib.crc32(samples[-32:]), length, hashlib.sha256(media).hexdigest(), feature_of(samples)))
            yield _batch(rows, READ)

    return run


def _places(index: DataFrame) -> DataFrame:
    """A row for each digest, those of one stretch of a shard together."""
    places = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p"))
    return places.select("digest", "p.shard", "p.offset", "p.length").repartition("shard", F.floor(F.col("offset") / (8 << 20))).sortWithinPartitions("shard", "offset")


def store_media(docs: DataFrame, unit: int = WIDTH * WIDTH, key: str = "doc_id", text: str = "text", shard_bytes: int = 256 << 20) -> tuple[DataFrame, str]:
    """The index (doc_id, n_bytes, digest, shard, offset, length), one row per row of docs, and the shards' folder."""
    spark = docs.sparkSession
    prepare(spark)
    folder = stage_path(spark, "media")
    if "://" not in folder:
        folder = "file://" + folder if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialise(rows.mapInArrow(_store(folder, unit, shard_bytes), SPARK_INDEX), "media-index"), folder


def header_columns(index: DataFrame, folder: str) -> DataFrame:
    """index with place, width, height and payload size of each stored payload, from its header alone: 33 bytes are read, whatever its length."""
    return index.select("doc_id", "n_bytes", "digest").join(_places(index).mapInArrow(_heads(folder), HEADS), "digest")


def media_columns(index: DataFrame, folder: str) -> DataFrame:
    """index with what is read back of each stored payload: size, digests, checksum and features."""
    read = _places(index).mapInArrow(_heads(folder), HEADS).mapInArrow(_read(folder), READ)
    return index.select("doc_id", "n_bytes", "digest").join(read, "digest")
