"""Readers of target lists, sheets, raw files and encoded documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.operators.targets import FIELDS

# Encodings that documents may have, and byte order marks.
ENCODINGS = (
    "ascii", "big5", "cp932", "cp1252", "euc_jp", "euc_kr", "gb18030", "gbk", "iso2022_jp", "iso8859-1", "shift_jis",
    "utf-16", "utf-16-be", "utf-16-le", "utf-32", "utf-32-be", "utf-32-le", "utf-8", "utf-8-sig",
)
BOMS = (("0000FEFF", "utf-32"), ("FFFE0000", "utf-32"), ("EFBBBF", "utf-8-sig"), ("FFFE", "utf-16"), ("FEFF", "utf-16"))
#: Encodings that Spark decodes itself.
NATIVE = {"utf-8": "UTF-8", "utf-16": "UTF-16", "utf-16-be": "UTF-16BE", "utf-16-le": "UTF-16LE", "utf-32": "UTF-32", "ascii": "US-ASCII", "iso8859-1": "ISO-8859-1"}


def header_problem(names: list[str]) -> str | None:
    """Why a target list's header is refused, None if it isn't."""
    if len(names) != len(set(names)):
        return "repeated column names"
    if not {"name", "url"} <= set(names):
        return "no name or url column"
    if set(names) - set(FIELDS):
        return "unknown columns"
    return None


MAX_TARGET_BYTES = 1 << 20


def scan_targets(spark: SparkSession, path: str, strict: bool = True, most_bytes: int = MAX_TARGET_BYTES) -> DataFrame:
    """A target list (CSV, quoted commas and line breaks, any column order) as all text columns; a bad header raises ValueError.

    The header is read on its own, as Spark renames repeated names silently; short rows are filled with blanks. A row
    with more cells than the header, or a list larger than `most_bytes`, raises ValueError, too; with strict=False a column
    `problem` marks such rows and there is no limit of size.
    """
    options = {"multiLine": True, "escape": '"', "encoding": "UTF-8"}
    head = spark.read.options(**options, header=False).csv(path).limit(1).first()
    names = [(c or "").strip().lstrip("\ufeff") for c in head] if head else []
    if problem := header_problem(names):
        raise ValueError(problem)
    # Cells past the header make a row malformed, which Spark then keeps whole in a column of its own.
    kept = spark.read.options(**options, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__whole").schema(", ".join(f"`{n}` string" for n in names) + ", __whole string").csv(path)
    surplus = F.col("__whole").isNotNull() & F.from_csv("__whole", ", ".join(f"c{i} string" for i in range(len(names) + 1)), {"escape": '"'})[f"c{len(names)}"].isNotNull()
    have = [F.coalesce(F.col(n), F.lit("")).alias(n) if n in names else F.lit("").alias(n) for n in FIELDS]
    rows = kept.select(*have, F.when(surplus, "surplus cells").alias("problem"))
    if not strict:
        return rows
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size > most_bytes:
        raise ValueError("the list is too large")
    # The name is read along, as Spark refuses to read malformed rows alone.
    if rows.agg(F.max(F.when(F.col("problem").isNotNull(), F.concat(F.lit("in "), "name")))).first()[0] is not None:
        raise ValueError("surplus cells")
    return rows.drop("problem")


def project_sheet(sheets: DataFrame, key: str, column: str = "values") -> DataFrame:
    """Sheet values (JSON array of arrays, header first) -> key, row, FIELDS; unknown columns and blank rows are left out.

    A non-blank cell past the header gives the row an `error`.
    """
    parsed = sheets.select(key, F.from_json(column, "array<array<string>>").alias("v"))
    rows = parsed.select(key, F.get("v", F.lit(0)).alias("head"), F.posexplode(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))).alias("row", "cells"))
    spill = F.exists(F.slice("cells", F.size("head") + 1, F.greatest(F.size("cells") - F.size("head"), F.lit(0))), lambda c: F.trim(c) != "")

    def cell(name: str) -> Column:
        at = F.array_position("head", name)
        return F.when(at > 0, F.coalesce(F.get("cells", (at - 1).cast("int")), F.lit(""))).otherwise("").alias(name)

    out = rows.where(F.trim(F.array_join("cells", "")) != "")
    return out.select(key, "row", *[cell(n) for n in FIELDS], F.when(spill, "cell past the header").alias("error"))


def verified_intake(files: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(path, content), expected(path, size, sha256) -> (accepted, rejected): size and digest computed from the content."""
    real = files.select("path", "content", F.octet_length("content").cast("long").alias("real_size"), F.sha2("content", 256).alias("real_sha256"))
    joined = real.join(expected, "path", "left")
    fine = F.coalesce((F.col("real_size") == F.col("size")) & (F.col("real_sha256") == F.col("sha256")), F.lit(False))
    reason = F.when(F.col("size").isNull(), "not expected").when(F.col("real_size") != F.col("size"), "size").otherwise("digest")
    return joined.where(fine).select("path", "content", "size", "sha256"), joined.where(~fine).select("path", reason.alias("reason"))


def choose_encoding(body: Column, charset: Column) -> Column:
    """BOM, then the header's charset, then what the document declares in its first 4096 bytes, then utf-8; null if not allowed."""
    start = F.hex(F.substring(body, 1, 4))
    bom = F.lit(None).cast("string")
    for mark, name in reversed(BOMS):
        bom = F.when(start.startswith(mark), name).otherwise(bom)
    head = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")
    meta = F.regexp_extract(head, r"(?i)<meta\b[^>]*\bcharset\s*=\s*[\"']?\s*([A-Za-z][A-Za-z0-9._:-]{0,63})", 1)
    xml = F.regexp_extract(head, r"(?i)<\?xml\b[^>]*\bencoding\s*=\s*[\"']([A-Za-z][A-Za-z0-9._:-]{0,63})[\"']", 1)
    named = F.lower(F.coalesce(bom, charset, F.nullif(xml, F.lit("")), F.nullif(meta, F.lit("")), F.lit("utf-8")))
    same = {"utf8": "utf-8", "latin-1": "iso8859-1", "iso-8859-1": "iso8859-1", "us-ascii": "ascii", "windows-1252": "cp1252", "utf-16be": "utf-16-be", "utf-16le": "utf-16-le", "shift-jis": "shift_jis", "euc-jp": "euc_jp", "euc-kr": "euc_kr", "iso-2022-jp": "iso2022_jp"}
    known = F.create_map(*[F.lit(x) for pair in (same | {e: e for e in ENCODINGS}).items() for x in pair])
    return F.try_element_at(known, named)


def decode_documents(documents: DataFrame, key: str) -> DataFrame:
    """documents(key, body binary, charset) -> key, encoding, text; null text where the encoding isn't allowed or the bytes aren't valid in it."""

    @F.pandas_udf("string")
    def strict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(body, encoding):
            if body is None or encoding is None:
                return None
            try:
                return bytes(body).decode(encoding)
            except (UnicodeDecodeError, LookupError):
                return None

        for bodies, names in batches:
            yield pd.Series([one(b, n) for b, n in zip(bodies, names, strict=True)], dtype=object)

    chosen = documents.select(key, "body", choose_encoding(F.col("body"), F.col("charset")).alias("encoding"))
    own = F.try_validate_utf8(F.col("body").cast("string"))
    text = F.when(F.col("encoding") == "utf-8", own).when(F.col("encoding") == "utf-8-sig", F.try_validate_utf8(F.substring("body", 4, 1 << 30).cast("string")))
    # Only bodies of other encodings go through Python.
    other = F.when(~F.col("encoding").isin("utf-8", "utf-8-sig"), F.col("body"))
    return chosen.withColumn("text", F.coalesce(text, strict(other, F.col("encoding")))).select(key, "encoding", "text")
