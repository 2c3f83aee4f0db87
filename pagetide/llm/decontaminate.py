"""Benchmark decontamination by CGK embedding and bit-sampling LSH over words.

The CGK walk reads a window word by word and stays on a word or goes on by a random bit of (step, word); what it reads at
each step, a blank behind the window's n words, is the embedding, and two windows a few edits apart fall into step
again, so that most of their steps agree.
Each table of the LSH samples some steps of one walk; windows that agree in all steps of a table are candidates, whose
edit distance to the item is then computed in full. Several walks and tables, and several windows an item, reach the recall.

Windows are item-sized: their sampled steps lie inside a length of the geometric series just below the item's. They start at anchors,
words picked by their own hash, in items and documents alike, so that an edit elsewhere doesn't shift them; an item that
has few anchors names more of its words, which then are anchors in all documents. An item too short for any edit is
looked up by the hash of its words at every word. All windows of all documents are searched against all items, which are
broadcast in blocks of bounded size, one pass a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import slices, string_buffers
from pagetide.llm.words import ALNUM, LOWER, Hasher, mix, split

#: Edits (words inserted, deleted or replaced) allowed, as a share of the item's words.
MAX_EDITS = 0.2
WALKS = 2
TABLES = 4
SAMPLES = 5
#: Steps that are sampled, as a multiple of the window's length: a walk of 3n steps has read nearly all words by then, and the
#: blanks behind them are the same for all windows, so that a table that sampled them would tell nothing apart.
REACH = 1.8
#: One word in so many is an anchor.
ANCHOR = 4
LEAST_STARTS = 3
#: Window lengths. An item has windows of the length just below its own (of the last, if it is longer still) and, as walks
#: drift apart over many insertions or deletions, of PART words at most; both kinds are looked up.
LENGTHS = (2, 3, 4, 6, 8, 11, 16, 23, 32, 45, 64)
PART = 16
#: Bytes of item texts in one broadcast block.
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 20


def plan(seed: int = 17) -> list[list[np.ndarray]]:
    """Sampled steps, by window length and table (walk = table // TABLES), in order."""
    rng = np.random.default_rng(seed)
    out = []
    for length in LENGTHS:
        steps = max(SAMPLES, int(REACH * length))
        out.append([np.sort(rng.choice(steps, SAMPLES, replace=False)) for _ in range(WALKS * TABLES)])
    return out


def embed_keys(words: np.ndarray, starts: np.ndarray, classes: list[int]) -> dict[int, list[np.ndarray]]:
    """Keys of the windows at `starts`, by window class and table; `words` are word hashes, continued by 0."""
    samples = plan()
    steps = max(int(samples[c][t][-1]) for c in classes for t in range(WALKS * TABLES)) + 1
    padded = np.concatenate([words, np.zeros(steps + 1, np.uint64)])
    keys = {c: [np.full(len(starts), np.uint64(c * 64 + t + 1)) for t in range(WALKS * TABLES)] for c in classes}
    for walk in range(WALKS):
        at = starts.astype(np.int64).copy()
        wanted: dict[int, list[tuple[int, int]]] = {}
        for c in classes:
            for t in range(walk * TABLES, (walk + 1) * TABLES):
                for j in samples[c][t].tolist():
                    wanted.setdefault(j, []).append((c, t))
        bits = None
        for j in range(steps):
            if j % 63 == 0:
                bits = mix(padded + np.uint64((walk * 131 + j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
            if j in wanted:
                read = padded[at]
                for c, t in wanted[j]:
                    inside = np.where(at < starts + LENGTHS[c], read, np.uint64(0))
                    keys[c][t] = (keys[c][t] ^ inside) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1)
            at += bits[at] >> (j % 63) & 1
    return {c: [mix(k) for k in tables] for c, tables in keys.items()}


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between the item and any stretch of the text, and where that ends and begins (the first such end)."""
    n = np.arange(len(text) + 1)
    row, begin = np.zeros(len(text) + 1, np.int64), n.copy()
    for k, w in enumerate(item, 1):
        swap = row[:-1] + (text != w)
        drop = row + 1
        best, from_ = drop, begin.copy()
        better = swap <= drop[1:]
        best[1:][better] = swap[better]
        from_[1:][better] = begin[:-1][better]
        best[0], from_[0] = k, 0
        slack = best - n
        low = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == low, n, 0))
        row, begin = low + n, from_[source]
    end = int(row.argmin())
    return int(row[end]), int(begin[end]), end


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words that begin with each word."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = mix((out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15))
    return out


def index_items(texts: list[str], max_edits: float = MAX_EDITS) -> dict:
    """What documents are searched with: word hashes of each item, window keys, words that are anchors, whole hashes of items that allow no edit."""
    hasher, words, windows, extra = Hasher(), [], [], set()
    exact: dict[int, list[tuple[int, int]]] = {}
    for i, text in enumerate(texts):
        data = LOWER[np.frombuffer(text.encode(), np.uint8)] if text else np.zeros(0, np.uint8)
        a, b, _ = split(data, np.array([0, len(data)]), ALNUM)
        h = hasher(data, a, b)
        words.append(h)
        if int(max_edits * len(h)) < 1:
            if len(h):
                exact.setdefault(len(h), []).append((int(sequence_hashes(h, len(h))[0]), i))
            windows.append([])
            continue
        fit = [c for c, size in enumerate(LENGTHS) if size <= max(0.75 * len(h), LENGTHS[0])]
        kinds = []
        for c in {fit[-1], max(k for k in fit if LENGTHS[k] <= max(PART, LENGTHS[0]))}:
            room = max(1, len(h) - LENGTHS[c] + 1)
            own = np.flatnonzero(h[:room] % np.uint64(ANCHOR) == 0)
            if len(own) < LEAST_STARTS:
                more = np.unique(np.linspace(0, room - 1, LEAST_STARTS).astype(np.int64))
                extra.update(h[more].tolist())
                own = np.unique(np.concatenate([own, more]))
            kinds.append((c, own))
        windows.append(kinds)
    key, item, place = [], [], []
    for i, (h, kinds) in enumerate(zip(words, windows, strict=True)):
        for c, s in kinds:
            for k in embed_keys(h, s, [c])[c]:
                key.append(k)
                item.append(np.full(len(s), i))
                place.append(s)
    key, item, place = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((key, np.uint64), (item, np.int64), (place, np.int64)))
    order = np.argsort(key, kind="stable")
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[(key >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    short = {n: tuple(np.array(x, t) for x, t in zip(zip(*sorted(rows), strict=True), (np.uint64, np.int64), strict=True)) for n, rows in exact.items()}
    return {"exact": short, "words": words, "key": key[order], "item": item[order], "place": place[order], "seen": seen, "classes": sorted({c for kinds in windows for c, _ in kinds}), "extra": np.array(sorted(extra), np.uint64)}


def search(index: dict, h: np.ndarray, bounds: np.ndarray, doc: np.ndarray, max_edits: float) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, edits, first word, word after the last), the best of each pair, of texts given as word hashes."""
    at, item, place = [], [], []
    for n, (keys, numbers) in index["exact"].items():
        own = sequence_hashes(h, n)
        lo, hi = np.searchsorted(keys, own, side="left"), np.searchsorted(keys, own, side="right")
        here = np.repeat(np.arange(len(own)), hi - lo)
        at.append(here)
        item.append(numbers[np.arange(len(here)) + np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo)])
        place.append(np.zeros(len(here), np.int64))
    anchor = h % np.uint64(ANCHOR) == 0
    if len(index["extra"]):
        extra = index["extra"]
        anchor |= extra[np.minimum(np.searchsorted(extra, h), len(extra) - 1)] == h
    starts = np.flatnonzero(anchor)
    for tables in (embed_keys(h, starts, index["classes"]) if index["classes"] and len(starts) else {}).values():
        for keys in tables:
            hit = np.flatnonzero(index["seen"][(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(index["key"], keys[hit], side="left"), np.searchsorted(index["key"], keys[hit], side="right")
            n = hi - lo
            rows = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
            at.append(np.repeat(starts[hit], n))
            item.append(index["item"][rows])
            place.append(index["place"][rows])
    if not sum(map(len, at)):
        return []
    at, item, place = np.concatenate(at), np.concatenate(item), np.concatenate(place)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    found = np.unique(np.stack([doc[at], item, at - place], axis=1), axis=0)
    # Places of a pair that lie within its edits of each other are one stretch, searched once.
    slack = np.array([int(max_edits * len(w)) for w in index["words"]], np.int64)[found[:, 1]]
    cuts = np.flatnonzero(np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1) | (found[1:, 2] - found[:-1, 2] > slack[1:])]))
    for low, high in zip(cuts.tolist(), np.append(cuts[1:], len(found)).tolist(), strict=True):
        d, i, begin = found[low].tolist()
        end = int(found[high - 1, 2])
        words = index["words"][i]
        n, first, last = len(words), int(bounds[d]), int(bounds[d + 1])
        allowed = int(slack[low])
        if best.get((d, i), (1,))[0] == 0:
            continue
        same = next((b for b in found[low:high, 2].tolist() if first <= b and b + n <= last and np.array_equal(h[b : b + n], words)), None)
        if same is not None:
            got = (0, same - first, same - first + n)
        else:
            lo, hi = max(first, begin - allowed), min(last, end + n + allowed)
            # Each of the item's words that the stretch lacks is an edit.
            if hi - lo < n - allowed or n - np.isin(words, h[lo:hi]).sum() > allowed:
                continue
            edits, a, b = edit_distance(words, h[lo:hi])
            if edits > allowed:
                continue
            got = (edits, lo + a - first, lo + b - first)
        best[(d, i)] = min(best.get((d, i), got), got)
    return [(d, i, *got) for (d, i), got in best.items()]


def _blocks(items: DataFrame, item_col: str, item_text: str, max_edits: float) -> Iterator:
    """The items' ids and indexes, broadcast block by block."""
    sc = items.sparkSession.sparkContext
    want = items.select(F.col(f"`{item_col}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    size = want.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(size) // BLOCK_BYTES))
    for k in range(n_blocks):
        block = want.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k) if n_blocks > 1 else want
        found = block.toArrow()
        yield sc.broadcast((found.column("item_id").combine_chunks(), index_items(found.column("text").to_pylist(), max_edits)))


def _hits(ix: dict, hasher: Hasher, texts: pa.Array, max_edits: float) -> list[tuple[int, int, int, int, int]]:
    off, data = string_buffers(texts)
    data = LOWER[data]
    starts, ends, doc = split(data, off, ALNUM)
    return search(ix, hasher(data, starts, ends), np.searchsorted(doc, np.arange(len(off))), doc, max_edits)


def contaminated(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, edits, n_words, first_word, end_word): documents that hold a stretch within max_edits of an item's words.

    Words are runs of letters and digits, lower-cased (A-Z); first_word and end_word number the document's words. One row for
    each document row and item, the stretch with the fewest edits. Null and blank texts and items match nothing; an item
    of fewer than 1 / max_edits words must occur exactly and is always found where it does; ids may have any type; repeated rows and items each give their rows; empty tables give
    an empty one.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    id_field = items.schema[item_col].dataType
    out = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("item_id", id_field)] + [T.StructField(c, T.LongType()) for c in ("edits", "n_words", "first_word", "end_word")])

    def searcher(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, (ids, ix) = Hasher(), index.value
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = _hits(ix, hasher, part.column("text"), max_edits)
                    if rows:
                        d, i, edits, a, b = map(list, zip(*rows, strict=True))
                        cols = [part.column("id").take(pa.array(d)), ids.take(pa.array(i)), pa.array(edits, pa.int64()), pa.array([len(ix["words"][k]) for k in i], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, names=out.names)

        return run

    found = None
    for index in _blocks(items, item_col, item_text, max_edits):
        rows = src.mapInArrow(searcher(index), out)
        found = rows if found is None else found.union(rows)
    return found


def keep_clean(docs: DataFrame, items: DataFrame, max_edits: float = MAX_EDITS, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that hold no stretch within max_edits of an item's words.

    Null and blank texts and items match nothing; repeated rows stay or go together; empty tables give an empty one or,
    without items, docs as it is.
    """

    def cleaner(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, (_, ix) = Hasher(), index.value
            for batch in batches:
                for part in slices(batch, text_col):
                    clean = np.ones(part.num_rows, bool)
                    clean[[r[0] for r in _hits(ix, hasher, part.column(text_col), max_edits)]] = False
                    yield part.filter(pa.array(clean))

        return run

    for index in _blocks(items, item_col, item_text, max_edits):
        docs = docs.mapInArrow(cleaner(index), docs.schema)
    return docs
