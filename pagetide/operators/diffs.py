"""Line diffs as rows: each pair of texts compared exactly, whatever its size; hunks by windows.

A diff has as few lines as any. Pairs of few lines are compared with one table of bits, longer ones by their equal pairs of lines if
there are few of these, or else in halves, so that memory grows with the lines and not with their pairs.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions.batches import by_pieces

CONTEXT = 3
#: Pairs of lines up to which two texts, or parts of them, are compared with one table; longer ones are cut where a longest common subsequence passes.
MAX_PAIRS = 4_000_000
#: Bytes of the bit masks of lines that a comparison keeps; others are made again.
MASK_BYTES = 16 << 20
_SCRIPT = "array<struct<op:string,line:string>>"


def rising(places: Sequence[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    tops: list[int] = []
    ends: list[int] = []
    before = array("q")
    for i, x in enumerate(places):
        k = bisect_left(tops, x)
        before.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(x)
            ends.append(i)
        else:
            tops[k], ends[k] = x, i
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def common(old: Sequence[str], new: Sequence[str], most_pairs: int = MAX_PAIRS) -> list[tuple[int, int]]:
    """Places (in old, in new) of a longest common subsequence: equal beginnings first, then equal ends, then what is between.

    `most_pairs` bounds the memory, not the work: a longest one is found for texts of any size.
    """
    short = min(len(old), len(new))
    head = next((i for i in range(short) if old[i] != new[i]), short)
    tail = next((i for i in range(short - head) if old[-1 - i] != new[-1 - i]), short - head)
    n, m = len(old) - tail, len(new) - tail
    a, b = old[head:n], new[head:m]
    few = len(a) * len(b) <= max(most_pairs, len(a) + len(b))
    middle = [] if not a or not b else _by_rows(a, b) if few else _by_parts(a, b, most_pairs)
    return [(i, i) for i in range(head)] + [(head + i, head + j) for i, j in middle] + [(n + i, m + i) for i in range(tail)]


def _by_rows(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """`common` by a table of bits, all of whose rows are kept.

    A bit of the row of b[j] is 0 where one more line of a raises the length that is common with b[:j+1]; a row comes
    from the one before by an addition of long integers.
    """
    places: dict[str, int] = {}
    for i, line in enumerate(a):
        places[line] = places.get(line, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    rows = [full]
    for line in b:
        hit = row & places.get(line, 0)
        row = (row + hit | row - hit) & full
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[j] >> i - 1 & 1:
            i -= 1
        elif rows[j - 1] >> i - 1 & 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        else:
            j -= 1
    return out[::-1]


def _by_parts(a: Sequence[str], b: Sequence[str], most_pairs: int) -> list[tuple[int, int]]:
    """`common` of what is too long for one table: without the lines of one side alone; by the pairs of equal lines if these are few; or else in halves."""
    lines_a, lines_b = set(a), set(b)
    from_a, from_b = [i for i, x in enumerate(a) if x in lines_b], [j for j, x in enumerate(b) if x in lines_a]
    if len(from_a) < len(a) or len(from_b) < len(b):
        return [(from_a[i], from_b[j]) for i, j in common([a[i] for i in from_a], [b[j] for j in from_b], most_pairs)]
    places: dict[str, list[int]] = {}
    for j in reversed(range(len(b))):
        places.setdefault(b[j], []).append(j)
    # An equal pair costs about as much as the bits of 4,096 pairs.
    if sum(len(places[x]) for x in a) <= min(most_pairs, len(a) * len(b) >> 12):
        in_a, in_b = array("q"), array("q")
        for i, x in enumerate(a):
            in_a.extend([i] * len(places[x]))
            in_b.extend(places[x])
        return [(in_a[k], in_b[k]) for k in rising(in_b)]
    half = len(b) // 2
    at = int(np.argmax(_lengths(a, b[:half]) + _lengths(a[::-1], b[half:][::-1])[::-1]))
    return common(a[:at], b[:half], most_pairs) + [(at + i, half + j) for i, j in common(a[at:], b[half:], most_pairs)]


def _lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Lengths that a[:i] has in common with b, for i from 0 to len(a), by the rows of `_by_rows`, of which the last one is kept."""
    size = len(a) + 7 >> 3
    places: dict[str, list[int]] = {}
    for i, line in enumerate(a):
        places.setdefault(line, []).append(i)

    @lru_cache(max(1, MASK_BYTES // size))
    def mask(line: str) -> int:
        at, held = np.array(places.get(line, ()), np.int64), np.zeros(size, np.uint8)
        np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return int.from_bytes(held.tobytes(), "little")

    full = row = (1 << len(a)) - 1
    for line in b:
        hit = row & mask(line)
        row = (row + hit | row - hit) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(size, "little"), np.uint8), count=len(a), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def script(old: Sequence[str], new: Sequence[str], most_pairs: int = MAX_PAIRS) -> list[tuple[str, str]]:
    """(op, line) in order; what goes stands before what comes at the same place."""
    out, i, j = [], 0, 0
    for a, b in [*common(old, new, most_pairs), (len(old), len(new))]:
        out += [("-", x) for x in old[i:a]] + [("+", x) for x in new[j:b]]
        if a < len(old):
            out.append((" ", old[a]))
        i, j = a + 1, b + 1
    return out


def _rising():
    """`rising` of a column of places."""

    def rises_piece(places: pa.Array) -> pa.Array:
        return pa.array([rising(p) for p in places.to_pylist()], pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def rises(places: pa.Array) -> pa.Array:
        return by_pieces(rises_piece, places)

    return rises


def _compared(most_pairs: int):
    def compare_piece(old: pa.Array, new: pa.Array) -> pa.Array:
        ops, lines, sizes = [], [], [0]
        for o, n in zip(old.to_pylist(), new.to_pylist(), strict=True):
            edits = script(o, n, most_pairs)
            ops += [op for op, _ in edits]
            lines += [x for _, x in edits]
            sizes.append(len(ops))
        flat = pa.StructArray.from_arrays([pa.array(ops, pa.string()), pa.array(lines, pa.string())], ["op", "line"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)

    @F.arrow_udf(_SCRIPT)
    def compared(old: pa.Array, new: pa.Array) -> pa.Array:
        return by_pieces(compare_piece, old, new)

    return compared


def _lines(c: Column) -> Column:
    """All lines, empty ones too; nothing comes behind a last line break."""
    parts = F.split(F.coalesce(c, F.lit("")), "\n", -1)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def edit_script(pair: DataFrame, key: str, most_pairs: int = MAX_PAIRS) -> DataFrame:
    """pair(key, old_text, new_text) -> (key, gap, nth, op, line) of every line of both texts, in order of (gap, nth); op: ' ', '-' or '+'.

    Every pair is compared exactly, as one gap; `most_pairs` bounds what a comparison holds at a time (`common`). Null texts count as
    empty; keys must be distinct and not null. A task holds the lines of one pair at a time.
    """
    sides = pair.select(key, _lines(F.col("old_text")).alias("old"), _lines(F.col("new_text")).alias("new"))
    edits = sides.select(key, F.posexplode(_compared(most_pairs)("old", "new")).alias("nth", "e"))
    return edits.select(key, F.lit(0).alias("gap"), "nth", "e.op", "e.line")


def _span(first: Column, size: Column) -> Column:
    return F.concat(first.cast("string"), F.when(size == 1, "").otherwise(F.concat(F.lit(","), size.cast("string"))))


def hunks(edits: DataFrame, key: str, context: int = CONTEXT) -> tuple[DataFrame, DataFrame]:
    """(hunks(key, hunk, old_start, old_lines, new_start, new_lines), rows(key, hunk, seq, op, line)) of an edit script: lines within `context` of a change.

    Starts count from 1; a side without a line in the hunk has the number of the line before.
    """
    order = Window.partitionBy(key).orderBy("gap", "nth")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = edits.select(
        key, "op", "line", F.row_number().over(order).alias("seq"), F.max((F.col("op") != " ").cast("int")).over(order.rowsBetween(-context, context)).alias("near"),
        F.count_if(F.col("op") != "+").over(so_far).alias("old_no"), F.count_if(F.col("op") != "-").over(so_far).alias("new_no"),
    ).where("near = 1")
    by_seq = Window.partitionBy(key).orderBy("seq")
    opens = F.coalesce((F.col("seq") - F.lag("seq").over(by_seq) > 1).cast("int"), F.lit(1))
    rows = numbered.withColumn("opens", opens).withColumn("hunk", F.sum("opens").over(by_seq.rowsBetween(Window.unboundedPreceding, 0)))
    n_old, n_new = F.count_if(F.col("op") != "+"), F.count_if(F.col("op") != "-")
    start = lambda n, c, other: F.when(n == 0, F.max(c)).otherwise(F.min(F.when(F.col("op") != other, F.col(c))))
    heads = rows.groupBy(key, "hunk").agg(start(n_old, "old_no", "+").alias("old_start"), n_old.alias("old_lines"), start(n_new, "new_no", "-").alias("new_start"), n_new.alias("new_lines"))
    return heads, rows.select(key, "hunk", "seq", "op", "line")


def rendered(heads: DataFrame, rows: DataFrame, key: str, most_lines: int | None) -> DataFrame:
    """(key, text, n_lines): a unified diff's first `most_lines` lines, or all with None, and how many it has in all; no more lines than these are gathered."""
    title = F.concat(F.lit("@@ -"), _span(F.col("old_start"), F.col("old_lines")), F.lit(" +"), _span(F.col("new_start"), F.col("new_lines")), F.lit(" @@"))
    all_lines = heads.select(key, "hunk", F.lit(0).alias("seq"), title.alias("out")).union(rows.select(key, "hunk", "seq", F.concat("op", "line")))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("hunk", "seq")) + 2
    fits = F.lit(True) if most_lines is None else F.col("nth") <= most_lines
    shown = all_lines.withColumn("nth", nth).groupBy(key).agg(F.array_sort(F.collect_list(F.when(fits, F.struct("nth", "out")))).alias("a"), F.max("nth").alias("n_lines"))
    whole = F.concat(F.array(F.lit("--- previous"), F.lit("+++ current")), F.transform("a", lambda x: x["out"]))
    return shown.select(key, F.array_join(whole if most_lines is None else F.slice(whole, 1, most_lines), "\n").alias("text"), "n_lines")
