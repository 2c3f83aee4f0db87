"""WARC archives as a Spark data source: format "warc".

Files are WARC 1.1, records uncompressed with the HTTP body gzip-encoded, so that a reader parses a record's headers first
and seeks past a payload it doesn't want. Reading plans one partition a file, takes predicates on the record type and on
header columns (they are checked on the headers alone, and a record that fails one is never decoded), and leaves payloads
alone where the requested schema has no payload column. Writing rolls files over at a size and commits a list of the
files of the tasks that succeeded; readers see no others.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from pagetide.llm.common import materialize, new_path
from pagetide.llm.storage import Store

SCHEMA = "page_id long, record_type string, target_uri string, refers_to long, payload_digest string, payload binary"
#: Column of SCHEMA -> header.
HEADERS = {"page_id": "X-Page-Id", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "X-Refers-To-Page-Id", "payload_digest": "WARC-Payload-Digest"}
FILE_BYTES = 64 << 20
#: Payloads of fewer bytes are always stored.
REVISIT_BYTES = 100
#: Repeated digests are broadcast up to this many rows, joined by shuffle beyond.
BROADCAST_ROWS = 200_000
_COMMITTED = "committed-"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict, date: str) -> bytes:
    """One record; a revisit has HTTP headers and no body."""
    revisit = row["record_type"] == "revisit"
    body = b"" if revisit else zlib.compress(row["payload"] or b"", 6, wbits=31)
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += "\r\n" if revisit else f"Content-Encoding: gzip\r\nContent-Length: {len(body)}\r\n\r\n"
    block = http.encode() + body
    lines = ["WARC/1.1", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response"]
    for column, header in HEADERS.items():
        if row.get(column) is not None:
            value = f"sha256:{row[column]}" if column == "payload_digest" else _clean(str(row[column]))
            lines.append(f"{header}: {value}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def payload_of(block: bytes) -> bytes:
    """The decoded body of an HTTP block."""
    head, _, body = block.partition(b"\r\n\r\n")
    return zlib.decompress(body, wbits=31) if b"content-encoding: gzip" in head.lower() else body


class FilePartition(InputPartition):
    def __init__(self, name: str, size: int) -> None:
        self.name, self.size = name, size


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[tuple[str, pa.DataType]]) -> None:
        self.path, self.columns, self.wanted = path, columns, []

    def pushFilters(self, filters):  # noqa: N802
        """Take equality and membership tests on header columns; Spark keeps the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted.append((f.attribute[0], values))
            else:
                yield f

    def partitions(self):
        store = Store(self.path)
        files = store.names()
        committed = set()
        for name, _ in files:
            if name.startswith(_COMMITTED):
                with store.open(name) as f:
                    committed |= set(json.loads(f.read().decode()))
        return [FilePartition(n, s) for n, s in files if n in committed] or [FilePartition("", 0)]

    def read(self, partition: FilePartition):
        if not partition.name:
            return
        names = [n for n, _ in self.columns]
        schema = pa.schema(self.columns)
        rows, held = [], 0
        with Store(self.path).open(partition.name) as f:
            for fields, at, size in headers(f, partition.size):
                if any(fields.get(c) not in values for c, values in self.wanted):
                    continue
                if "payload" in names:
                    if fields.get("record_type") != "revisit":
                        f.seek(at)
                        fields["payload"] = payload_of(f.read(size))
                        held += len(fields["payload"])
                rows.append([fields.get(n) for n in names])
                if held >= 4 << 20 or len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def headers(f, size: int) -> Iterator[tuple[dict, int, int]]:
    """Of each record of an open file: header columns, and place and size of its block, which isn't read."""
    column = {h.lower(): c for c, h in HEADERS.items()}
    at = 0
    while at < size:
        f.seek(at)
        head = b""
        while b"\r\n\r\n" not in head:
            more = f.read(1024)
            if not more:
                raise ValueError("a record breaks off")
            head += more
        text = head[: head.index(b"\r\n\r\n")]
        lines = text.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields, length = {}, 0
        for line in lines[1:]:
            name, _, value = line.partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "content-length":
                length = int(value)
            elif name in column:
                c = column[name]
                fields[c] = int(value) if c in ("page_id", "refers_to") else value.removeprefix("sha256:") if c == "payload_digest" else value
        start = at + len(text) + 4
        yield fields, start, length
        at = start + length + 4


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int, date: str) -> None:
        self.path, self.file_bytes, self.date = path, file_bytes, date

    def write(self, iterator) -> Written:
        store, files, out, size = Store(self.path), [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                data = record(batch.slice(i, 1).to_pylist()[0], self.date)
                if out is not None and size + len(data) > self.file_bytes:
                    out.close()
                    out = None
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc")
                    out, size = store.create(files[-1]), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        with Store(self.path).create(f"{_COMMITTED}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m is not None for n in m.files]).encode())

    def abort(self, messages) -> None:
        """Files of a failed job are on no list, so no reader sees them."""


class WarcSource(DataSource):
    """Options: path; file_bytes and date when writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return WarcReader(self.options["path"], [(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)), self.options.get("date", "1970-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html) -> rows to archive (SCHEMA).

    Of rows with equal payloads of at least `least` bytes, that with the smallest page_id is a response and the others are
    revisits of it; rows that share the smallest id are all responses, a null id is the smallest only among nulls. Null
    html is an empty payload. Only digests that repeat are joined back; the html stays where it is while they are few.
    """
    payload = F.encode(F.coalesce(F.col("`html`"), F.lit("")), "UTF-8")
    src = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").alias("target_uri"), payload.alias("payload"))
    src = src.withColumn("payload_digest", F.sha2("payload", 256))
    large = src.where(F.length("payload") >= least)
    first = materialize(large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-repeats")
    repeats = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    joined = src.join(repeats, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, F.col("first")).alias("refers_to"),
        "payload_digest",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    register(pages.sparkSession)
    records(pages, least).write.format("warc").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The archives below `path`; leave `payload` out of the schema to have no payload decoded."""
    register(spark)
    return spark.read.format("warc").schema(schema).option("path", path).load()


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages and read them back: page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are those of the payload as read; a revisit takes the size from the response it names.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    responses = read(spark, path).where("record_type = 'response'")
    responses = responses.select("page_id", "target_uri", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    responses = materialize(responses, "warc-responses")
    revisits = read(spark, path, "page_id long, record_type string, target_uri string, refers_to long, payload_digest string").where("record_type = 'revisit'")
    size = responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = revisits.join(size, "payload_digest", "left")
    return responses.unionByName(revisits.select(*responses.columns))


