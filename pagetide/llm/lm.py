"""Language-model scoring with a log-frequency Bloom filter of n-gram counts.

The filter holds the bigrams of the whole training text, named by a hash of both words, and the words outside the head
(below), each once for every power of two up to its count, 1 included; a reader probes the levels until one is absent.
It is cut into segments of at most `segment_bytes`, each broadcast for one pass over the texts, so that it grows with
the corpus and no broadcast does.

A token's probability backs off by membership: `weight` * count of the bigram / count of the word before, where the
filter holds the bigram; else (1 - weight) * the word's own probability, and that alone where the word before is
unknown. So the logarithm of a text's probability is its base score plus a gain for each bigram found, in which only
the counts of the bigram and of the word before count: these lie in one segment, and gains of segments add up. The counts of the
`head` most frequent words are broadcast exactly; the base takes the exact counts of the other words by a shuffled join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import materialize, release, slices, string_buffers
from pagetide.llm.words import LOWER, Pieces, Table, mix, most_frequent, split, strings, summed

#: The token that closes a text; no word can equal it, as words hold no line break.
END = "\n"
_END_HASH = np.uint64(0xA0761D6478BD642F)
#: Words whose counts are broadcast.
HEAD_WORDS = 1 << 18
#: An entry sets HASHES bits of one 64-bit field.
BITS_PER_ENTRY = 12
HASHES = 5
#: Fields of a slice, which one task builds, and slices of a group, which no segment cuts.
SLICE_FIELDS = 1 << 15
GROUP_SLICES = 16
SEGMENT_BYTES = 64 << 20
#: Probability that the bigrams seen after a known word hold.
WEIGHT = 0.6
#: Bits of a name that choose its segment.
_PLACE_BITS = 24
_FLUSH = 1 << 20
#: One bigram in so many, by hash, tells how many entries the filter is made for.
SHARE = 64

_PAIRS_OF_BITS = (np.uint64(1) << (np.arange(4096, dtype=np.uint64) & np.uint64(63))) | (np.uint64(1) << (np.arange(4096, dtype=np.uint64) >> np.uint64(6)))


def _words(part: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Pieces, np.ndarray]:
    """Lower-cased bytes of a slice; starts, ends, text numbers, bytes and hashes of its words."""
    off, data = string_buffers(part.column(column))
    data = LOWER[data]
    starts, ends, doc = split(data, off)
    pieces = Pieces(data)
    return data, starts, ends, doc, pieces, pieces.hashes(starts, ends)


def counts(texts: DataFrame) -> DataFrame:
    """(text string) -> (word, pair, n long): words with their counts, the closing token of every text counted as the word END; and, without a word, one bigram of SHARE with its count, from which the filter's size is estimated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_seen, pairs = 0, [np.zeros(0, np.uint64)]

        def found() -> Iterator[tuple[pa.Array, np.ndarray]]:
            nonlocal ends_seen
            for batch in batches:
                ends_seen += batch.num_rows
                for part in slices(batch, "text"):
                    data, starts, ends, doc, pieces, h = _words(part, "text")
                    now, before, _ = _sequence(doc, h, part.num_rows, _END_HASH)
                    name = _pair_ids(before, now, np.zeros(len(now), bool))
                    pairs.append(name[name % np.uint64(SHARE) == 0])
                    first, back = pieces.distinct(starts, ends, h)
                    yield strings(data, starts[first], ends[first]), np.bincount(back, minlength=len(first))

        def rows(word: pa.Array, pair: pa.Array, n: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([word, pair, n], names=["word", "pair", "n"])

        for batch in summed(found()):
            yield rows(batch.column("word"), pa.nulls(batch.num_rows, pa.int64()), batch.column("n"))
            if sum(map(len, pairs)) >= _FLUSH:
                name, n = np.unique(np.concatenate(pairs), return_counts=True)
                pairs[:] = [np.zeros(0, np.uint64)]
                yield rows(pa.nulls(len(name), pa.string()), pa.array(name.view(np.int64)), pa.array(n.astype(np.int64)))
        if ends_seen:
            name, n = np.unique(np.concatenate(pairs), return_counts=True)
            yield rows(pa.nulls(len(name), pa.string()), pa.array(name.view(np.int64)), pa.array(n.astype(np.int64)))
            yield rows(pa.array([END]), pa.nulls(1, pa.int64()), pa.array([ends_seen], pa.int64()))

    return texts.select("text").mapInArrow(run, "word string, pair long, n long").groupBy("word", "pair").agg(F.sum("n").alias("n"))


def _head(counts: DataFrame, size: int) -> tuple[tuple, np.ndarray]:
    """A table of the most frequent words, END aside, and their counts."""
    top = most_frequent(counts.where(F.col("word") != END), size).toArrow()
    off, data = string_buffers(top.column("word"))
    return Table.state(data.copy(), off), np.asarray(top.column("n")).astype(np.int64)


def _sequence(doc: np.ndarray, values: np.ndarray, n_docs: int, closing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the words of a slice with END's after each text: each token's, that of the token before (END's at the start of a text), its text."""
    at = np.arange(len(values)) + doc
    seq = np.full(len(values) + n_docs, closing, values.dtype)
    seq[at] = values
    owner = np.empty(len(seq), np.int64)
    owner[at] = doc
    owner[np.searchsorted(doc, np.arange(n_docs), side="right") + np.arange(n_docs)] = np.arange(n_docs)
    before = np.concatenate([np.full(1, closing, values.dtype), seq[:-1]]) if len(seq) else seq
    return seq, before, owner


def _placed(name: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Names whose upper bits are those of `place`."""
    low = np.uint64((1 << 64 - _PLACE_BITS) - 1)
    return (place & ~low) | (name & low)


def _word_ids(h: np.ndarray) -> np.ndarray:
    """Names of words in the filter."""
    return _placed(mix(h + np.uint64(0x8EBC6AF09C88C6E3)), mix(h * np.uint64(0xD6E8FEB86659FD93)))


def _pair_ids(before: np.ndarray, now: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Names of bigrams in the filter: a hash of both words; after a word outside the head in that word's segment, else anywhere."""
    pair = mix((mix(before) ^ now) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(rare, _placed(pair, mix(before * np.uint64(0xD6E8FEB86659FD93))), pair)


def bigrams(texts: DataFrame, head, layout: Layout) -> DataFrame:
    """(text string) -> (place long, name long, n long): all bigrams, END before and after each text, with counts that are still to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kept, size = Table(head.value), [], 0

        def flush() -> pa.RecordBatch:
            names, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(layout.place(names)), pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], names=["place", "name", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                _, starts, ends, doc, pieces, h = _words(part, "text")
                now, before, _ = _sequence(doc, h, part.num_rows, _END_HASH)
                _, row, _ = _sequence(doc, table.find(pieces, starts, ends, h), part.num_rows, 0)
                kept.append(_pair_ids(before, now, row < 0))
                size += len(kept[-1])
                if size >= _FLUSH:
                    yield flush()
                    kept, size = [], 0
        if size:
            yield flush()

    return texts.select("text").mapInArrow(run, "place long, name long, n long")


def rare_words(words: DataFrame, head, layout: Layout) -> DataFrame:
    """(word, n) -> (place long, name long, n long) of the words outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(head.value)
        for b in batches:
            off, data = string_buffers(b.column(0))
            pieces = Pieces(data)
            h = pieces.hashes(off[:-1], off[1:])
            rare = table.find(pieces, off[:-1], off[1:], h) < 0
            name = _word_ids(h[rare])
            yield pa.RecordBatch.from_arrays([pa.array(layout.place(name)), pa.array(name.view(np.int64)), b.column(1).filter(pa.array(rare))], names=["place", "name", "n"])

    return words.where(F.col("word") != END).select("word", "n").mapInArrow(run, "place long, name long, n long")


class Layout:
    """Where in the filter an entry lies: in a group of slices by the upper bits of its name, in a slice of the group by a hash. It follows from the number of entries alone."""

    def __init__(self, entries: int) -> None:
        n_slices = max(1, -(-entries * BITS_PER_ENTRY // (SLICE_FIELDS * 64)))
        self.groups = -(-n_slices // GROUP_SLICES)
        self.slices = -(-n_slices // self.groups)

    def group(self, name: np.ndarray) -> np.ndarray:
        return ((name >> np.uint64(64 - _PLACE_BITS)) * np.uint64(self.groups) >> np.uint64(_PLACE_BITS)).astype(np.int64)

    def place(self, name: np.ndarray) -> np.ndarray:
        """Number of the slice in the whole filter."""
        return self.group(name) * self.slices + (mix(name + np.uint64(0x27D4EB2F165667C5)) % np.uint64(self.slices)).astype(np.int64)


def _bits(name: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the field inside its slice and the bits there."""
    x = mix(name * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
    low = np.uint64(4095)
    bits = _PAIRS_OF_BITS[(x & low).astype(np.int64)] | _PAIRS_OF_BITS[(x >> np.uint64(12) & low).astype(np.int64)] | (np.uint64(1) << (x >> np.uint64(24) & np.uint64(63)))
    return (x >> np.uint64(40)).astype(np.int64) % SLICE_FIELDS, bits


def filter_slices(entries: DataFrame, layout: Layout) -> DataFrame:
    """(place, name, n) -> (place long, fields binary): the filter's slices; equal names are added up in the task that builds their slice, so that entries are shuffled once."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.asarray(c) for c in b.columns] for b in batches]
        if not held:
            return
        place, name, n = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        order = np.lexsort((name, place))
        place, name, n = place[order], name[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (place[1:] != place[:-1])])[: len(name)])
        place, name, top = place[first], name[first].view(np.uint64), np.log2(np.add.reduceat(n, first) if len(n) else n).astype(np.int64)
        for k in np.unique(place).tolist():
            lo, hi = np.searchsorted(place, k, side="left"), np.searchsorted(place, k, side="right")
            fields = np.zeros(SLICE_FIELDS, np.uint64)
            for level in range(int(top[lo:hi].max()) + 1):
                np.bitwise_or.at(fields, *_bits(name[lo:hi][top[lo:hi] >= level], level))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([fields.tobytes()], pa.binary())], names=["place", "fields"])

    # About one slice a task: its rows are bounded by the size of a slice.
    return entries.repartition(max(layout.groups * layout.slices, 1), "place").mapInArrow(fill, "place long, fields binary")


def probe(segment: np.ndarray, first: int, layout: Layout, name: np.ndarray) -> np.ndarray:
    """Quantised counts of n-grams of a segment that begins with slice `first`: the largest power of two whose level, and all below it, are in the filter."""
    out = np.zeros(len(name))
    at = np.arange(len(name))
    base = (layout.place(name) - first) * SLICE_FIELDS
    level = -1
    while len(at):
        level += 1
        field, bits = _bits(name[at], level)
        at = at[(segment[base[at] + field] & bits) == bits]
        out[at] = 2.0**level
    return out


def score_texts(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_words: int = HEAD_WORDS,
    weight: float = WEIGHT,
    segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """(id, train boolean, n_tokens, n_known, train_tokens long, base_score, score double), one row per row of docs.

    `train` picks the rows that counts are taken from. The base is the add-0.1 word model with exact counts; the score adds
    for each token after a known word log10(weight * filter count / count of the word before) - its base if the bigram is found, else
    log10(1 - weight). Null and empty texts hold the closing token alone; repeated rows and null ids keep their rows;
    without training rows every token is unknown; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counted = materialize(counts(src.where("train")), "lm-words")
    words = counted.where("word IS NOT NULL").select("word", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V")).first()
    n_all, n_words = int(total["N"]), int(total["V"])
    closing = words.where(F.col("word") == END).first()
    n_end = int(closing["n"]) if closing else 0
    state, head_n = _head(words, head_words)
    head, all_n, n_head = sc.broadcast(state), sc.broadcast(np.append(head_n, n_end)), len(head_n)
    levels = F.sum(F.floor(F.log2("n")) + 1)
    size = counted.groupBy(F.col("word").isNull().alias("is_pair")).agg(levels.alias("k")).collect()
    layout = Layout(sum(int(r["k"]) * (SHARE if r["is_pair"] else 1) for r in size))
    entries = bigrams(src.where("train"), head, layout).union(rare_words(words, head, layout))
    fields = materialize(filter_slices(entries, layout), "lm-filter")
    per_pass = max(1, segment_bytes // (layout.slices * SLICE_FIELDS * 8))
    starts_of = range(0, layout.groups, per_pass)

    def log_p(c):
        return np.log10((c + 0.1) / (n_all + 0.1 * (n_words + 1)))

    def scorer(segment, group: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, seg, n = Table(head.value), segment.value, all_n.value
            for batch in batches:
                for part in slices(batch, "text"):
                    data, starts, ends, doc, pieces, h = _words(part, "text")
                    n_docs = part.num_rows
                    row = table.find(pieces, starts, ends, h)
                    now_h, before_h, owner = _sequence(doc, h, n_docs, _END_HASH)
                    now, before, _ = _sequence(doc, row, n_docs, n_head)
                    word_at, _, _ = _sequence(doc, np.arange(len(row)), n_docs, -1)
                    pair = _pair_ids(before_h, now_h, before < 0)
                    if len(starts_of) > 1:
                        where = layout.group(pair)
                        mine = np.flatnonzero((where >= group) & (where < group + per_pass))
                        pair, now, before, before_h, owner, word_at = (x[mine] for x in (pair, now, before, before_h, owner, word_at))
                    c = probe(seg, group * layout.slices, layout, pair)
                    context = n[before].astype(float)
                    rare = np.flatnonzero(before < 0)
                    context[rare] = probe(seg, group * layout.slices, layout, _word_ids(before_h[rare]))
                    known, hit = context > 0, (c > 0) & (context > 0)
                    gain = np.where(known & ~hit, np.log10(1 - weight), 0.0)
                    gain[hit] = np.log10(weight * np.minimum(c[hit] / context[hit], 1))
                    # What is taken back is the base: of head words here, of others where their counts are joined.
                    back = np.flatnonzero(hit & (now >= 0))
                    gain[back] -= log_p(n[now[back]])
                    late = word_at[hit & (now < 0)]
                    times = np.zeros(len(row), np.int32)
                    times[late] = 1
                    listed = np.flatnonzero(row < 0) if group == 0 else np.sort(late)
                    sizes = np.bincount(doc[listed], minlength=n_docs)
                    words = pa.StructArray.from_arrays([strings(data, starts[listed], ends[listed]), pa.array(np.full(len(listed), int(group == 0), np.int32)), pa.array(times[listed])], names=["word", "times", "hits"])
                    cols = [part.column("rid"), pa.array(np.bincount(owner, gain, n_docs).astype(float)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), words)]
                    names = ["rid", "gain", "rare"]
                    if group == 0:
                        here = row >= 0
                        base = np.bincount(doc[here], log_p(n[row[here]]), n_docs) + log_p(n_end)
                        n_known = np.bincount(doc[here], minlength=n_docs) + (n_end > 0)
                        cols += [part.column("id"), part.column("train"), pa.array(np.bincount(doc, minlength=n_docs) + 1), pa.array(n_known.astype(np.int64)), pa.array(base)]
                        names += ["id", "train", "n_tokens", "n_known", "base"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

        return run

    rare_type = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("times", T.IntegerType()), T.StructField("hits", T.IntegerType())]))
    some = [T.StructField("rid", T.LongType()), T.StructField("gain", T.DoubleType()), T.StructField("rare", rare_type)]
    rest = [T.StructField("id", src.schema["id"].dataType), T.StructField("train", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType())]
    rows = src.withColumn("rid", F.monotonically_increasing_id())
    if len(starts_of) > 1:
        # Row numbers follow from how Spark splits the files, which the cores of the moment decide: all passes read those written here.
        rows = materialize(rows, "lm-texts")
    passes = []
    for group in starts_of:
        first, last = group * layout.slices, min(group + per_pass, layout.groups) * layout.slices
        field = np.zeros((last - first) * SLICE_FIELDS, np.uint64)
        for r in fields.where((F.col("place") >= first) & (F.col("place") < last)).toLocalIterator():
            at = (r["place"] - first) * SLICE_FIELDS
            field[at : at + SLICE_FIELDS] = np.frombuffer(r["fields"], np.uint64)
        segment = sc.broadcast(field)
        passes.append(materialize(rows.mapInArrow(scorer(segment, group), T.StructType(some if group else some + rest)), "lm-scores"))
        segment.unpersist()
    if len(starts_of) > 1:
        release(rows)
    every = passes[0].select("rid", "gain", "rare")
    for p in passes[1:]:
        every = every.union(p)
    rare = every.select("rid", F.inline("rare")).groupBy("rid", "word").agg(F.sum("times").alias("times"), F.sum("hits").alias("hits")).join(words, "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    logp = F.log10((c + F.lit(0.1)) / F.lit(n_all + 0.1 * (n_words + 1)))
    late = rare.groupBy("rid").agg(F.sum(F.col("times") * logp).alias("rare_base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("hits") * logp).alias("rare_hits"))
    zero = F.lit(0.0)
    out = passes[0].drop("rare").join(late, "rid", "left")
    gain = F.col("gain")
    if passes[1:]:
        more = every.where("gain <> 0").select("rid", F.col("gain").alias("more")).groupBy("rid").agg(F.sum("more").alias("more"))
        out, gain = out.join(more, "rid", "left"), F.coalesce("more", zero)
    base = F.col("base") + F.coalesce("rare_base", zero)
    return out.select(
        "id",
        "train",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + gain - F.coalesce("rare_hits", zero)).alias("score"),
    )
