"""Words of a whole slice of texts at once, as numpy arrays over its UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a piece that are read eight at a time, for all pieces at once; longer pieces are hashed and compared one by one.
_SHORT = 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def _eights(raw: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The up to eight bytes at each place as one number; `raw` has eight bytes to spare."""
    view = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    return view[at] & _MASK[np.minimum(left, 8)]


class Pieces:
    """Pieces of an array of small numbers, hashed and compared by their bytes."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.scale = symbols.itemsize
        self.raw = np.concatenate([np.ascontiguousarray(symbols).view(np.uint8), np.zeros(8, np.uint8)])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes: chained over the bytes eight at a time, XXH3 for pieces of over 32 bytes."""
        at, size = starts * self.scale, (ends - starts) * self.scale
        h = mix(size.astype(np.uint64) * _STEP + np.uint64(seed * 0x632BE59BD9B4E019 + 0x27D4EB2F165667C5 & 0xFFFFFFFFFFFFFFFF))
        rows = np.flatnonzero((size > 0) & (size <= _SHORT))
        for done in range(0, _SHORT, 8):
            if not len(rows):
                break
            chunk = _eights(self.raw, at[rows] + done, size[rows] - done)
            h[rows] = mix((h[rows] ^ chunk) * _STEP)
            rows = rows[size[rows] > done + 8]
        long = np.flatnonzero(size > _SHORT)
        if len(long):
            import xxhash

            raw, digest = memoryview(self.raw), xxhash.xxh3_64_intdigest
            h[long] ^= np.fromiter((digest(raw[a : a + n], seed) for a, n in zip(at[long].tolist(), size[long].tolist(), strict=True)), np.uint64, len(long))
        return mix(h * _STEP)

    def equal(self, starts: np.ndarray, ends: np.ndarray, other: Pieces, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
        """Whether each piece has the bytes of the other array's piece in the same row."""
        a, b, size = starts * self.scale, other_starts * other.scale, (ends - starts) * self.scale
        same = size == (other_ends - other_starts) * other.scale
        rows = np.flatnonzero(same & (size > 0) & (size <= _SHORT))
        for done in range(0, _SHORT, 8):
            if not len(rows):
                break
            left = size[rows] - done
            ok = _eights(self.raw, a[rows] + done, left) == _eights(other.raw, b[rows] + done, left)
            same[rows[~ok]] = False
            rows = rows[ok & (left > 8)]
        long = np.flatnonzero(same & (size > _SHORT))
        if len(long):
            x, y = memoryview(self.raw), memoryview(other.raw)
            for i, p, q, n in zip(long.tolist(), a[long].tolist(), b[long].tolist(), size[long].tolist(), strict=True):
                same[i] = x[p : p + n] == y[q : q + n]
        return same

    def distinct(self, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of each different piece, and for every row the number of its piece; hashes only find the groups, bytes decide."""
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        odd = np.flatnonzero(~self.equal(starts, ends, self, starts[first[back]], ends[first[back]]))
        if len(odd):
            more: dict[bytes, int] = {}
            for i in odd.tolist():
                piece = self.raw[starts[i] * self.scale : ends[i] * self.scale].tobytes()
                back[i] = more.setdefault(piece, len(first) + len(more))
            first = np.append(first, [odd[back[odd] == k][0] for k in range(len(first), len(first) + len(more))])
        return first, back


class Hasher:
    """64-bit hashes of pieces of an array of small numbers."""

    def __init__(self, seed: int = 0) -> None:
        self.seed = seed

    def __call__(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return Pieces(symbols).hashes(starts, ends, self.seed)


#: Letters, digits and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def split(data: np.ndarray, off: np.ndarray, members: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the words `[^\\x20\\x09-\\x0D]+` (or runs of the given bytes) of texts laid end to end."""
    solid = ~SPACE[data] if members is None else members[data]
    begin, fin = solid.copy(), solid.copy()
    if len(data):
        begin[1:] &= ~solid[:-1]
        fin[:-1] &= ~solid[1:]
        full = off[1:] > off[:-1]
        first, last = off[:-1][full], off[1:][full] - 1
        begin[first] |= solid[first]
        fin[last] |= solid[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(fin) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces laid end to end, and their offsets."""
    off = np.concatenate([[0], np.cumsum(ends - starts)])
    index = np.arange(off[-1]) + np.repeat(starts - off[:-1], ends - starts)
    return data[index], off


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces as an Arrow string array."""
    raw, off = gather(data, starts, ends)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(raw)])


def summed(counts: Iterator[tuple[pa.Array, np.ndarray]], most_rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """(words, counts) of many slices -> batches (word, n) with the counts of equal words added up, at most about `most_rows` held at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def merged() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
        held.clear()
        pa.default_memory_pool().release_unused()
        return pa.RecordBatch.from_arrays([table.column("word").combine_chunks(), table.column("n_sum").combine_chunks()], names=["word", "n"])

    for words, n in counts:
        held.append(pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64))], names=["word", "n"]))
        rows += len(words)
        if rows >= most_rows:
            one = merged()
            held, rows = [one], one.num_rows
            if 2 * rows >= most_rows:
                yield one
                held, rows = [], 0
    if rows:
        yield merged()


class Table:
    """A bounded table of pieces, looked up by whole arrays: by hash, then by bytes; -1 where there is none."""

    def __init__(self, state: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.keys, self.order, symbols, self.off = state
        self.pieces = Pieces(symbols)

    @staticmethod
    def state(symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What to broadcast for a table of these pieces, laid end to end."""
        keys = Pieces(symbols).hashes(off[:-1], off[1:])
        order = np.argsort(keys, kind="stable").astype(np.int32)
        return keys[order], order, symbols, off

    def find(self, pieces: Pieces, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        row = np.where(self.keys[at] == h, self.order[at], -1).astype(np.int64)
        hit = np.flatnonzero(row >= 0)
        found = row[hit]
        row[hit[~pieces.equal(starts[hit], ends[hit], self.pieces, self.off[found], self.off[found + 1])]] = -1
        return row


#: Words longer than this are never in a head, and a head has at most so many bytes of words.
HEAD_WORD_BYTES = 1 << 10
HEAD_BYTES = 16 << 20


def most_frequent(counts, size: int, word: str = "word", column: str = "n"):
    """At most `size` rows, of HEAD_BYTES of words, with the largest counts: whole classes of counts (16 to an octave) from the
    top, so that no sort of all rows is needed and every partition drops its own share."""
    from pyspark.sql import functions as F

    level = F.floor(F.log2(column) * 16).cast("int")
    short = counts.where(F.octet_length(word) <= HEAD_WORD_BYTES)
    classes = short.groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.sum(F.octet_length(word)).alias("bytes")).collect()
    rows, size_left, least = size, HEAD_BYTES, None
    for r in sorted(classes, key=lambda r: -r["level"]):
        rows -= r["rows"]
        size_left -= r["bytes"]
        if rows < 0 or size_left < 0:
            break
        least = r["level"]
    return short.where(level >= least) if least is not None else short.limit(0)
