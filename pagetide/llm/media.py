"""Media columns: content-addressed payloads in tar shards, rows that carry digest, shard, offset and length.

A text's UTF-8 bytes, padded to 64, become the samples of an 8-bit greyscale PNG, 64 wide. Every task appends each
distinct payload that it meets once to its own tar shard in the shared folder; where several tasks stored the same
digest, all rows point to one of the copies, so a payload that a third of the rows hold is kept once a task at most and
no text is shuffled. Readers fetch ranges only: a first pass reads the headers (tar block and image header) and fills the
metadata columns, a second the stored bytes that are wanted. Each pass adds its columns to the rows that it gets, so that
both follow one another in a task, and digests are shuffled as their 32 bytes, not as hex digits.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import materialize, new_path
from pagetide.llm.storage import Store

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a member that hold all metadata: a tar block, then signature and IHDR chunk.
HEADER_BYTES = 512 + 33
#: Stored bytes that one reading task is meant to get.
READ_BYTES = 64 << 20


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(payload: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return payload + bytes(-len(payload) % WIDTH if payload else WIDTH)


def to_png(payload: bytes, level: int = 1) -> bytes:
    """Padded payload -> PNG of 64 x n 8-bit grey samples, rows unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    w, h, depth = struct.unpack(">IIB", head[16:25])
    return w, h, depth


def from_png(blob: bytes) -> bytes:
    """The samples of a PNG made by to_png."""
    w, h, _ = png_header(blob[:33])
    at, parts = 33, []
    while at < len(blob):
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        if kind == b"IDAT":
            parts.append(blob[at + 8 : at + 8 + size])
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, w + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows are not used here")
    return raw[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A ustar header block of a plain file; all other fields fixed, so that equal payloads give equal bytes."""
    field = bytearray(512)
    field[0 : len(name)] = name.encode()
    field[100:108] = b"0000644\0"
    field[108:116] = field[116:124] = b"0000000\0"
    field[124:136] = f"{size:011o}\0".encode() if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    field[136:148] = b"00000000000\0"
    field[148:156] = b" " * 8
    field[156:157] = b"0"
    field[257:265] = b"ustar\00000"
    field[148:156] = f"{sum(field):06o}\0 ".encode()
    return bytes(field)


def store_payloads(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write tar shards below `root`; (id, n_bytes, digest, shard, offset, length), one row per row of docs.

    digest is the SHA-256 of the padded payload and the member's name; offset and length are those of the stored form
    inside the shard. Null texts count as empty. The result must be materialized once, as each run writes new shards.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, shard, out, end = Store(root), f"shard-{uuid.uuid4().hex}.tar", None, 0
        known: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            n, digests, at, size = [], [], [], []
            for body in batch.column(1):
                body = body.as_py()
                payload = pad(body)
                key = hashlib.sha256(payload).digest()
                if key not in known:
                    if out is None:
                        out = store.create(shard)
                    blob = to_png(payload)
                    out.write(tar_header(key.hex() + ".png", len(blob)))
                    out.write(blob)
                    out.write(bytes(-len(blob) % 512))
                    known[key] = (end + 512, len(blob))
                    end += 512 + len(blob) + -len(blob) % 512
                n.append(len(body))
                digests.append(key.hex())
                at.append(known[key][0])
                size.append(known[key][1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array([shard] * len(n), pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int64())],
                names=["id", "n_bytes", "digest", "shard", "offset", "length"],
            )
        if out is not None:
            out.write(bytes(1024))
            out.close()

    fields = [("n_bytes", T.LongType()), ("digest", T.StringType()), ("shard", T.StringType()), ("offset", T.LongType()), ("length", T.LongType())]
    return src.mapInArrow(run, T.StructType([T.StructField("id", src.schema["id"].dataType), *[T.StructField(a, b) for a, b in fields]]))


def _ranges(refs: DataFrame, root: str, first: int, read, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """The columns of `refs` and those that `read(member bytes)` gives for a range of each referenced member, in the order of the rows."""
    taken = refs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, name, f = Store(root), None, None
        for batch in batches:
            rows = []
            for shard, at, size in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if shard != name:
                    if f is not None:
                        f.close()
                    name, f = shard, store.open(shard)
                f.seek(at - 512)
                rows.append(read(f.read(min(first, 512 + size) if first else 512 + size)))
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in zip(*rows, strict=True)]], names=[*taken, *[n for n, _ in fields]])
        if f is not None:
            f.close()

    return refs.mapInArrow(run, T.StructType([*refs.schema.fields, *[T.StructField(n, t) for n, t in fields]]))


def read_headers(refs: DataFrame, root: str) -> DataFrame:
    """refs (shard, offset, length and others) with name, media_bytes, width, height, depth from the first 545 bytes of each member."""

    def read(head: bytes) -> tuple:
        w, h, depth = png_header(head[512:545])
        large = head[124] & 0x80
        return head[:100].rstrip(b"\0").decode(), int.from_bytes(head[125:136], "big") if large else int(head[124:135], 8), w, h, depth

    return _ranges(refs, root, HEADER_BYTES, read, [("name", T.StringType()), *[(n, T.LongType()) for n in ("media_bytes", "width", "height", "depth")]])


def read_features(refs: DataFrame, root: str) -> DataFrame:
    """refs (shard, offset, length and others) with payload_sha256, tail_crc32, media_sha256, feature from the stored bytes of each member.

    Both hashes are binary. feature: mean and standard deviation of the samples, and eight counts of the samples by their three high bits.
    """

    def read(member: bytes) -> tuple:
        blob = member[512:]
        payload = from_png(blob)
        samples = np.frombuffer(payload, np.uint8)
        bins = np.bincount(samples >> 5, minlength=8)
        feature = f"{samples.mean():.4f};{samples.std():.4f};" + ",".join(map(str, bins.tolist()))
        return hashlib.sha256(payload).digest(), zlib.crc32(payload[-64:]), hashlib.sha256(blob).digest(), feature

    return _ranges(refs, root, 0, read, [("payload_sha256", T.BinaryType()), ("tail_crc32", T.LongType()), ("media_sha256", T.BinaryType()), ("feature", T.StringType())])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as media rows: id, n_bytes, digest, shard, offset, length, and the columns of read_headers and read_features.

    Equal texts have equal values in all columns but the id. Null and empty texts are 64 bytes 0; repeated rows and null
    ids keep their rows; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    root = new_path(spark, "media")
    rows = materialize(store_payloads(docs, root, id_col, text_col).withColumn("digest", F.unhex("digest")), "media-rows")
    place = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")
    tasks = max(spark.sparkContext.defaultParallelism * 2, (rows.agg(F.sum("length")).first()[0] or 0) // READ_BYTES)
    place = place.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
    made = read_features(read_headers(place, root).drop("name"), root)
    found = rows.select("id", "n_bytes", "digest").join(made, "digest")
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("digest", "payload_sha256", "media_sha256")})
