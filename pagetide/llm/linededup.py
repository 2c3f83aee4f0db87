"""Removal of repeated runs of lines by a suffix array over line ids.

The corpus is a sequence of line ids; ranks of its suffixes by their first 1, 2, 4, ... lines come from prefix doubling, each
round a join of every rank with the rank as far behind it and a distributed sort of the pairs. Suffixes that no other
shares that prefix with drop out, so rounds shrink. A run of L lines at a place is named by the ranks of its first and its
last 2^k lines (2^k <= L < 2^(k+1)): places with one name are one longest-common-prefix interval of depth L. In an interval
all places but the first are later copies, and their lines go.

Which runs: a line goes if and only if it lies in a run of lines of its document, of at least `min_words` words, that also
starts at an earlier place. It is enough to look at runs that fall below `min_words` without their first or without their last line,
two a line on average: any longer run is a union of such, at the same places in both copies. So the doubling ends at the depth
of these, and no run is missed or cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import fresh, materialize, release, slices, string_buffers
from pagetide.llm.quality import lines_of
from pagetide.llm.words import Pieces, split

MIN_WORDS = 50
#: Bits of a place that number the line inside its document.
LINE_BITS = 28


def candidate_lengths(words: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the least and the greatest length of the runs to look at from there; 0, -1 where none has the words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.concatenate([[0], np.cumsum(words)])
    last = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, n)[np.searchsorted(np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, n), np.arange(n), side="right")]
    stop = np.searchsorted(run, run[:-1] + min_words, side="left")
    stop = np.maximum(stop, np.arange(n) + 1)
    enough = stop <= last
    least = np.where(enough, stop - np.arange(n), 0)
    nxt = np.append(stop[1:], n + 1)
    most = np.where(np.arange(n) + 1 < last, np.minimum(nxt, last), last) - np.arange(n)
    return least, np.where(enough, np.maximum(least, most), -1)


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """docs(id, key, text) -> (id, key, i, a, b, least, most): the lines, their 128-bit ids, the lengths of runs from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                off, data = string_buffers(part.column("text"))
                starts, ends, doc = lines_of(data, off)
                pieces = Pieces(data)
                w, _, _ = split(data, off)
                mark = np.zeros(len(data) + 1, np.int64)
                mark[w + 1] = 1
                total = np.cumsum(mark)
                least, most = candidate_lengths(total[ends] - total[starts], doc, min_words)
                first = np.searchsorted(doc, np.arange(part.num_rows))
                a, b = pieces.hashes(starts, ends, 1), pieces.hashes(starts, ends, 2)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(take), part.column("key").take(take), pa.array(np.arange(len(doc)) - first[doc]), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(least), pa.array(most)],
                    names=["id", "key", "i", "a", "b", "least", "most"],
                )

    fields = [T.StructField("id", docs.schema["id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("key", "i", "a", "b", "least", "most")]
    return docs.select("id", "key", "text").mapInArrow(run, T.StructType(fields))


def ranked(keys: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows -> the same with `rank`, their number from 1 in the order of `columns`: a distributed sort, then offsets."""
    dealt = keys.repartitionByRange(*columns).sortWithinPartitions(*columns)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "sorted")
    offsets, at = [], 0
    for part, size in sorted((r["part"], r["size"]) for r in dealt.groupBy("part").agg(F.count("*").alias("size")).collect()):
        offsets.append((part, at + 1))
        at += size
    if not offsets:
        return dealt.select(*columns, F.lit(0).cast("long").alias("rank"))
    table = keys.sparkSession.createDataFrame(offsets, "part int, first long")
    return dealt.join(F.broadcast(table), "part").select(*columns, (F.col("n") + F.col("first")).alias("rank"))


def _repeated(rows: DataFrame, *columns: str) -> DataFrame:
    """The ranks of values that occur at two places at least."""
    return ranked(rows.groupBy(*columns).agg(F.count("*").alias("c")).where("c > 1").drop("c"), *columns)


def prefix_ranks(first: DataFrame, depth: int) -> list[DataFrame]:
    """ranks (place, rank) by one line -> ranks by 1, 2, 4, ... up to `depth` lines, each only of places that share their prefix."""
    out, step = [first], 1
    while 2 * step <= depth:
        now = out[-1]
        behind = now.select((F.col("place") - step).alias("place"), F.col("rank").alias("second"))
        pairs = materialize(now.join(behind, "place").select("place", F.col("rank").alias("front"), "second"), "rank-pairs")
        names = _repeated(pairs, "front", "second")
        out.append(materialize(pairs.join(names, ["front", "second"]).select("place", "rank"), "ranks"))
        release(pairs)
        step *= 2
        if out[-1].isEmpty():
            break
    return out


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(id, key, text) -> (id, key, i, length): runs of lines that also start at an earlier place; places are in order of id, key, line."""
    lines = materialize(line_table(docs, min_words), "lines")
    ids = _repeated(lines, "a", "b")
    live = lines.join(ids, ["a", "b"]).select("id", "key", "i", "least", "most", "rank")
    owners = ranked(live.select("id", "key").distinct(), "id", "key").select(F.col("id").alias("owner_id"), F.col("key").alias("owner_key"), F.col("rank").alias("doc"))
    owned = live.join(owners, live["id"].eqNullSafe(owners["owner_id"]) & (live["key"] == owners["owner_key"]))
    owned = materialize(owned.select("id", "key", "i", "least", "most", "rank", (F.shiftleft("doc", LINE_BITS) + F.col("i")).alias("place")), "live-lines")
    depth = owned.agg(F.max("most")).first()[0] or 0
    if depth < 1:
        return owned.select("id", "key", "i", F.lit(0).alias("length")).limit(0)
    ranks = prefix_ranks(owned.select("place", "rank"), depth)
    runs = owned.where("most >= least AND least > 0").select("id", "key", "i", "place", F.explode(F.sequence("least", "most")).alias("length"))
    named = None
    for k, by in enumerate(ranks):
        size = 1 << k
        here = runs.where((F.col("length") >= size) & (F.col("length") < 2 * size))
        head = by.withColumnRenamed("rank", "head")
        tail = by.select(F.col("place").alias("end"), F.col("rank").alias("tail"))
        found = here.join(head, "place").withColumn("end", F.col("place") + F.col("length") - size).join(tail, "end").select("id", "key", "i", "place", "length", "head", "tail")
        named = found if named is None else named.union(found)
    named = materialize(named, "runs")
    for table in (lines, owned, *ranks[1:]):
        release(table)
    # A run has one first place and a place one run of each length, so what isn't first is found by place: no join has a hot run as its key.
    first = named.groupBy("length", "head", "tail").agg(F.min("place").alias("place")).select("place", "length")
    return named.join(first.hint("merge"), ["place", "length"], "left_anti").select("id", "key", "i", "length")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", n_lines_col: str = "n_lines", deleted_col: str = "deleted") -> DataFrame:
    """docs with the later copies of repeated runs of lines taken out of the text, plus n_lines int and deleted array<long> (line numbers from 0).

    Lines end at \\n alone. Rows with the same id and text are one document and stay alike; among documents of one id the
    hash of the text decides which is earlier, a null id comes first; a null text stays null with no line; other columns
    stay as they are; an empty table gives an empty one. The names of the two new columns can be chosen; a column of docs that has
    one of these names is replaced.
    """
    key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), key.alias("key"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
    # Equal rows are one document: which of them is read makes no difference, so one is.
    runs = later_copies(src.dropDuplicates(["id", "key"]) if _has_twins(src) else src, min_words)
    gone = F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("i"), F.col("i") + F.col("length") - 1))))
    gone = materialize(runs.groupBy("id", "key").agg(gone.alias("gone")), "deleted-lines")
    # The document's row goes through the join as one column, so that no name can clash. By shuffle at every size: the deletions grow with the documents.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("row_id"), key.alias("row_key"))
    joined = rows.join(gone.hint("merge"), F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key")), "left")
    kept = [c for c in docs.columns if c not in (n_lines_col, deleted_col)]
    flat = joined.select(*[F.col("row").getField(c).alias(c) for c in kept], F.coalesce("gone", F.array().cast("array<bigint>")).alias(fresh(kept, "gone")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index(text_col)
        for batch in batches:
            for part in slices(batch, text_col):
                texts, cut = part.column(at), part.column(len(kept))
                off, data = string_buffers(texts)
                starts, ends, doc = lines_of(data, off)
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                sizes = np.asarray(pc.list_value_length(cut)).astype(np.int64)
                owner = np.repeat(np.arange(part.num_rows), sizes)
                stay = np.ones(len(doc), bool)
                stay[first[owner] + np.asarray(cut.flatten())] = False
                numbers = np.arange(len(doc)) - first[doc]
                new, bounds = gather_lines(data, starts, ends, doc, stay, part.num_rows)
                text = pa.Array.from_buffers(pa.string(), part.num_rows, [pa.array(np.asarray(texts.is_valid())).buffers()[1], pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(new)])
                lost = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(numbers[~stay]))
                n_lines = np.where(np.asarray(texts.is_valid()), np.diff(first), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[text if i == at else part.column(i) for i in range(len(kept))], pa.array(n_lines), lost], names=[*kept, n_lines_col, deleted_col])

    out = [T.StructField(c, docs.schema[c].dataType) for c in kept] + [T.StructField(n_lines_col, T.IntegerType()), T.StructField(deleted_col, T.ArrayType(T.LongType()))]
    return flat.mapInArrow(run, T.StructType(out))


def gather_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, stay: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The lines that stay, joined by \\n inside each text, laid end to end, and the texts' offsets."""
    starts, ends, doc = starts[stay], ends[stay], doc[stay]
    # Each line with the \\n in front of it, but for a text's first.
    lead = np.zeros(len(doc), np.int64)
    lead[1:] = doc[1:] == doc[:-1]
    size = ends - starts + lead
    upto = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(upto[-1]) + np.repeat(starts - lead - upto[:-1], size)
    new = data[np.maximum(index, 0)]
    new[upto[:-1][lead == 1]] = 10
    return new, upto[np.searchsorted(doc, np.arange(n_docs + 1))]


def _has_twins(src: DataFrame) -> bool:
    return not src.groupBy("id", "key").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
