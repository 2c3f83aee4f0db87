"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay
code (23, 12, 7). Of at most three differing bits, at most one segment can hold two or more, so two segments always
differ by one bit or none. A word one bit off lies at most four bits from the other word's nearest codeword: a
fingerprint is stored under the nearest codewords of each pair of segments (three keys) and looked up under all
codewords within four bits (one or six a segment). No link can be missed; the distance of each candidate is verified.

The pipeline's groups of texts with similar shingle sets, below, come from the same keys over fingerprints of these sets, then from
MinHash bands for pairs that three bits don't reach; exact Jaccard similarity decides both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetide.llm.common import materialize, only, release, slices, string_buffers
from pagetide.llm.components import connected_components
from pagetide.llm.words import LOWER, Hasher, mix, split

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the generator of the Golay code.
GENERATOR = 0xAE3
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fingerprints stored under one key that one task compares; a larger key is split into blocks, and each pair of blocks is a group.
BLOCK = 2048
#: Split keys are broadcast up to this many rows, joined by shuffle beyond.
BROADCAST_ROWS = 200_000
_PAIRS_AT_ONCE = 1 << 21


def _mod_g(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the nearest error pattern, the patterns within four bits (six columns), how many of those there are."""
    near = np.zeros((2048, 6), np.int64)
    count = np.zeros(2048, np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for s, e in zip(_mod_g(patterns).tolist(), patterns.tolist(), strict=True):
            near[s, count[s]] = e
            count[s] += 1
    return near[:, 0].copy(), near, count


def fingerprint(text: bytes, width: int, digest, seed: int = 42) -> int:
    """SimHash of one text's word shingles; bits set in over half the hashes are 1."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        stops = ends[at + width - 1 : to + width - 1] if len(words) >= width else [len(joined)]
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:to], stops, strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the 64-bit SimHash of the whole text; null and blank texts give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", width, digest) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(run, "id long, fp long")


def _keys(nodes: DataFrame, probe: bool, columns: tuple[str, ...] = ("fp",), carry: bool = False) -> DataFrame:
    """(key long, fp long): the stored keys of each node (its first column), or those it is looked up under, for each fingerprint column; with `carry`, that fingerprint as `bits`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, near, count = golay_tables()
        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                part = whole.slice(lo, 8192)
                node = np.asarray(part.column(0)).astype(np.int64)
                for nth in range(len(columns)):
                    bits = np.asarray(part.column(nth + 1)).astype(np.int64).view(np.uint64)
                    index, valid = [], []
                    for first, size in SEGMENTS:
                        word = (bits >> np.uint64(first) & np.uint64((1 << size) - 1)).astype(np.int64)
                        syn = _mod_g(word)
                        if probe:
                            index.append((word[:, None] ^ near[syn]) >> 11)
                            valid.append(np.arange(6)[None, :] < count[syn][:, None])
                        else:
                            index.append((word ^ leader[syn])[:, None] >> 11)
                            valid.append(np.ones((len(word), 1), bool))
                    for p, (a, b) in enumerate(PAIRS):
                        key = (nth * len(PAIRS) + p << 24) | (index[a][:, :, None] << 12) | index[b][:, None, :]
                        row, i, j = np.nonzero(valid[a][:, :, None] & valid[b][:, None, :])
                        out = [pa.array(key[row, i, j]), pa.array(node[row]), *([pa.array(bits.view(np.int64)[row])] if carry else [])]
                        yield pa.RecordBatch.from_arrays(out, names=["key", "fp", "bits"][: len(out)])

    own = nodes.columns[0]
    return nodes.select(F.col(own).alias("node"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, "key long, fp long" + ", bits long" * carry)


def _local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one batch -> one link from each node to the smallest node of its component there."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _partners(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links of each u one, picked by chance, so that no node is picked by a whole group."""
    order = np.lexsort((_luck(u, v), u))
    u, v = u[order], v[order]
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    return u[first], v[first]


def _luck(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (mix((u ^ v).view(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _link(most_bits: int, chosen=_local_roots):
    """Compare, in each key's rows, each looked-up fingerprint with the stored ones before it; only the stored ones are held. `chosen` thins out the links that are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            k = np.concatenate([held_k, np.asarray(batch.column(0))])
            side = np.concatenate([np.zeros(len(held_k), np.int8), np.asarray(batch.column(1)).astype(np.int8)])
            fp = np.concatenate([held_f, np.asarray(batch.column(2))])
            if not len(k):
                continue
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            stored = np.add.reduceat((side == 0).astype(np.int64), first)
            last = first[-1]
            held_k, held_f = k[last : last + stored[-1]], fp[last : last + stored[-1]]
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
            rows = np.flatnonzero((side == 1) & (stored[group] > 0))
            many = stored[group[rows]]
            upto = np.concatenate([[0], np.cumsum(many)])
            us, vs = [], []
            at = 0
            while at < len(rows):
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + _PAIRS_AT_ONCE, side="right")) - 1)
                n = many[at:to]
                x = np.repeat(rows[at:to], n)
                y = np.repeat(first[group[rows[at:to]]], n) + np.arange(upto[to] - upto[at]) - np.repeat(upto[at:to] - upto[at], n)
                d = np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64))
                ok = (d > 0) & (d <= most_bits)
                if ok.any():
                    u, v = chosen(fp[x[ok]], fp[y[ok]])
                    us.append(u)
                    vs.append(v)
                at = to
            if us:
                u, v = chosen(np.concatenate(us), np.concatenate(vs))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def _candidates(nodes: DataFrame, columns: tuple[str, ...], block: int, carry: bool = False) -> DataFrame:
    """(k long, side byte, fp long, with `carry` bits long): stored (0) and looked-up (1) nodes by key, sorted by k and side inside partitions.

    A key with over `block` stored nodes is split into blocks of both sides, and each pair of blocks is a group of its own.
    """
    stored, probed = _keys(nodes, False, columns, carry), _keys(nodes, True, columns, carry)
    rest = ["fp", "bits"] if carry else ["fp"]
    large = materialize(stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "golay-large")
    n_large = large.count()
    if n_large:
        large = large.select("key", F.ceil(F.col("n") / block).cast("int").alias("b"))
        large = F.broadcast(large) if n_large <= BROADCAST_ROWS else large

        def dealt(rows: DataFrame, side: int) -> DataFrame:
            rows = rows.join(large, "key", "left").withColumn("b", F.coalesce("b", F.lit(1)))
            own = F.pmod(F.xxhash64("fp"), F.col("b").cast("long"))
            other = F.explode(F.sequence(F.lit(0), F.col("b") - 1))
            rows = rows.withColumn("own", own).withColumn("other", other)
            bx, by = ("other", "own") if side == 0 else ("own", "other")
            k = F.col("key") * (1 << 32) + F.col(bx) * (1 << 16) + F.col(by)
            return rows.select(k.alias("k"), F.lit(side).cast("byte").alias("side"), *rest)
    else:

        def dealt(rows: DataFrame, side: int) -> DataFrame:
            return rows.select(F.col("key").alias("k"), F.lit(side).cast("byte").alias("side"), *rest)

    return dealt(stored, 0).union(dealt(probed, 1)).repartition("k").sortWithinPartitions("k", "side")


def golay_links(nodes: DataFrame, most_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (u, v) with the same connected components as all pairs within `most_bits`.

    Links of one group of candidates come out as a spanning forest, so a dense group of copies gives as many rows as it
    has members, not their square. `most_bits` may be 0 to 3.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("the Golay keys cover at most three differing bits")
    return _candidates(nodes.select("fp"), ("fp",), block).mapInArrow(_link(most_bits), "u long, v long").distinct()


def golay_pairs(nodes: DataFrame, most_bits: int = 3, block: int = BLOCK) -> DataFrame:
    """nodes(node long, fp long) -> pairs (u, v), u > v, of nodes whose fingerprints differ by at most `most_bits`: as many as nodes, twice at most.

    Each fingerprint comes with one of those near it, by its smallest nodes; nodes of one fingerprint form chains, 64 at most,
    and the first node of a chain comes with the smallest of all.
    """
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fp-heads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _link(most_bits, _partners)(batches):
            u, v = (np.asarray(c) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_luck(u, v))], names=["u", "v", "luck"])

    near = _candidates(heads.select("fp"), ("fp",), block).mapInArrow(run, "u long, v long, luck long")
    near = near.groupBy("u").agg(F.min_by("v", F.struct("luck", "v")).alias("v"))
    end = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_node")).hint("merge")
    between = near.join(end("u"), "u").join(end("v"), "v").select(F.col("u_node").alias("a"), F.col("v_node").alias("b"))
    chain = Window.partitionBy("fp", F.pmod(F.xxhash64("node"), F.lit(64))).orderBy("node")
    chained = nodes.select("fp", "node", F.lag("node").over(chain).alias("before")).join(heads.hint("merge"), "fp")
    within = chained.select(F.col("node").alias("a"), F.coalesce("before", "head").alias("b")).where("a <> b")
    return between.union(within).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, most_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, fp, component), component the smallest id reachable over links of at most `most_bits` bits.

    Null and blank texts have fingerprint 0 and are linked like any other; repeated rows keep their own rows; a null id
    keeps its row and never names a component unless the whole component has no other id; an empty table gives an empty
    one. Only fingerprints travel, never texts.
    """
    fps = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")), "fp-nodes")
    roots = connected_components(golay_links(nodes, most_bits))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = materialize(placed, "fp-roots")
    least = placed.groupBy("root").agg(F.min("rep").alias("component"))
    by_fp = placed.join(least, "root").select("fp", "component")
    return only(fps, "id", "fp").join(by_fp, "fp").select("id", "fp", "component")


#: MinHash bands that candidates come from, and values of a band. A pair shares a band with probability
#: 1 - (1 - J^ROWS)^BANDS whatever the kind of edit: all but 3.2 in a million pairs at similarity 0.8, fewer above.
BANDS = 24
ROWS = 4
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SHIFTS = mix(_FACTORS + np.uint64(0xC2B2AE3D27D4EB4F))


def _shingle_sets(part: pa.RecordBatch, width: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text of a slice: its distinct word shingles as sorted hashes laid end to end, their offsets, and a hash of the set; a text without a word has one shingle, 0."""
    off, data = string_buffers(part.column("text"))
    data = LOWER[data]
    starts, ends, doc = split(data, off)
    h = hasher(data, starts, ends)
    bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        words = h[a:b]
        shingle = np.zeros(max(1, len(words) - width + 1), np.uint64)
        for i in range(min(width, len(words))):
            shingle = mix(shingle + words[i : i + len(shingle)] * np.uint64(2 * i + 3))
        sets.append(np.unique(shingle))
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
    total = np.add.reduceat(mix(flat + np.uint64(0x632BE59BD9B4E019)), at[:-1])
    return flat, at, mix(total + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _set_fingerprints(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each shingle set: bits that are set in over half of its hashes."""
    half, out = np.diff(at), np.zeros(len(at) - 1, np.uint64)
    for b in range(64):
        ones = np.add.reduceat(flat >> np.uint64(b) & np.uint64(1), at[:-1]).astype(np.int64)
        out |= (2 * ones > half).astype(np.uint64) << np.uint64(b)
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return src.withColumn("key", F.xxhash64("text"))


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, node, fp long, bands binary, signature binary): hashes of a text and of its shingle set, that set's SimHash, hashes of its MinHash bands, and a byte of each MinHash value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, "text"):
                flat, at, node = _shingle_sets(part, width, hasher)
                least = np.empty((part.num_rows, BANDS * ROWS), np.uint64)
                for k in range(BANDS * ROWS):
                    least[:, k] = np.minimum.reduceat(flat * _FACTORS[k] + _SHIFTS[k], at[:-1])
                bands = np.zeros((part.num_rows, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + least[:, k::ROWS])
                signs = (mix(least) >> np.uint64(56)).astype(np.uint8)
                cols = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (bands, signs)]
                fp = pa.array(_set_fingerprints(flat, at).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(node.view(np.int64)), fp, *cols], names=["id", "key", "node", "fp", "bands", "signature"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "id long, key long, node long, fp long, bands binary, signature binary")


def _band_rows(nodes: DataFrame) -> DataFrame:
    """(k long, node long), a row a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, raw = string_buffers(batch.column(1))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(raw.view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), BANDS))], names=["k", "node"])

    return nodes.select("node", "bands").mapInArrow(run, "k long, node long")


def band_groups(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(k, node, signature) of the nodes that share a band; a band of over `block` nodes is dealt into blocks, each pair of which is a group."""
    rows = materialize(_band_rows(nodes), "bands")
    # By shuffle at every size: bands and nodes grow with the input.
    many = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").hint("merge")
    b = F.ceil(F.col("n") / block).cast("int")
    dealt = rows.join(many, "k").withColumn("own", F.pmod(F.xxhash64("node"), b.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), b - 1)))
    dealt = dealt.select(F.xxhash64("k", F.least("own", "other"), F.greatest("own", "other")).alias("k"), "node")
    return dealt.join(nodes.select("node", "signature").hint("merge"), "node").select("k", "node", "signature")


def least_equal(similarity: float) -> int:
    """Equal signature bytes from which a pair is verified: five deviations less than expected at the similarity."""
    n = BANDS * ROWS
    return int(n * similarity - 5 * math.sqrt(n * similarity * (1 - similarity)))


def _grouped(batches: Iterator[pa.RecordBatch], width: int, pairs):
    """Rows (k, node, root, size, sign) sorted by k -> the pairs (u > v) that pairs(node, root, size, sign) names in each group."""
    rest = [np.zeros(0, np.int64)] * 4 + [np.zeros((0, width), np.uint8)]

    def groups(k, *columns):
        cuts = np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            root = columns[1][a:b]
            if b - a > 1 and not (root == root[0]).all():
                x, y = pairs(*[c[a:b] for c in columns])
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        _, raw = string_buffers(batch.column(4))
        new = [np.asarray(batch.column(i)).astype(np.int64) for i in range(4)] + [raw.reshape(-1, width)]
        rows = [np.concatenate(x) for x in zip(rest, new, strict=True)]
        cut = int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1 if rows[0][0] != rows[0][-1] else 0
        if cut:
            yield from groups(*[x[:cut] for x in rows])
        rest = [x[cut:] for x in rows]
    if len(rest[0]):
        yield from groups(*rest)


def _first_pairs(least: int):
    """For each node of a group one of the likeliest before it, and the node that is likest to all, if `least` signature bytes are equal."""

    def of_group(node, root, size, sign):
        order = np.argsort(node, kind="stable")
        node, sign = node[order], sign[order]
        n = len(node)
        some = np.arange(0, n, -(-n // 64))
        alike = np.zeros(n, np.int64)
        each = max(1, (1 << 15) // n)
        for lo in range(0, len(some), each):
            alike += (sign[some[lo : lo + each], None, :] == sign[None]).sum(axis=(0, 2))
        hub = int(alike.argmax())
        near = np.flatnonzero((sign == sign[hub]).sum(axis=1) >= least)
        near = near[near != hub]
        us, vs = [node[near]], [np.full(len(near), node[hub])]
        for lo in range(0, n, each):
            hi = min(n, lo + each)
            same = (sign[lo:hi, None, :] == sign[None, :hi]).sum(axis=2, dtype=np.int64)
            ok = (same >= least) & (node[lo:hi, None] > node[None, :hi])
            # Nearly equal ones by chance, so that no node is picked by a whole group.
            luck = (mix((node[lo:hi, None] ^ node[None, :hi]).view(np.uint64)) >> np.uint64(48)).astype(np.int64)
            rank = np.where(ok, np.minimum(same, BANDS * ROWS * 9 // 10) << 16 | luck, -1)
            x = np.flatnonzero(ok.any(axis=1))
            us.append(node[lo:hi][x])
            vs.append(node[:hi][rank[x].argmax(axis=1)])
        return np.concatenate(us), np.concatenate(vs)

    return lambda batches: _grouped(batches, BANDS * ROWS, of_group)


#: Values of a fine signature: the least shingle hash of each of so many classes of hashes, a byte each, 0 where a class is empty.
CLASSES = 1024
#: Deviations below the similarity down to which a fine signature lets a pair pass; 3.4 in a million lie beyond.
DEVIATIONS = 4.5


def fine_signatures(sets: DataFrame) -> DataFrame:
    """(node, shingles) -> (node, size long, sign binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, signs = [], []
            for raw in batch.column(1):
                h = np.sort(mix(np.frombuffer(raw.as_buffer(), np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                group = (h >> np.uint64(54)).astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                sign = np.zeros(CLASSES, np.uint8)
                sign[group[first]] = (mix(h[first]) >> np.uint64(56)).astype(np.uint8) | 1
                sizes.append(len(h))
                signs.append(sign.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())], names=["node", "size", "sign"])

    return sets.mapInArrow(run, "node long, size long, sign binary")


def _fine_pairs(similarity: float, every: bool):
    """Pairs between different roots of a group that may have the similarity, by fine signatures: all, or for each node outside the largest root the likeliest.

    Equal classes are a sample, without repeats, of the union of both sets, so their number deviates less the more of the union they are.
    """

    def of_group(node, root, size, sign):
        roots, number, times = np.unique(root, return_inverse=True, return_counts=True)
        main = number == times.argmax()
        us, vs = [], []
        own = np.flatnonzero(~main)
        each = max(1, (1 << 14) // len(node))
        full = sign != 0
        for lo in range(0, len(own), each):
            x = own[lo : lo + each]
            n = (full[x, None, :] | full[None]).sum(axis=2)
            equal = ((sign[x, None, :] == sign[None]) & full[None]).sum(axis=2)
            union = np.maximum((size[x, None] + size[None]) / (1 + similarity), n)
            bound = n * similarity - DEVIATIONS * np.sqrt(n * similarity * (1 - similarity) * (1 - n / union)) - 1
            ok = (equal >= bound) & (root[x, None] != root[None])
            if every:
                i, y = np.nonzero(ok & (main[None] | (node[x, None] > node[None])))
            else:
                i = np.flatnonzero(ok.any(axis=1))
                y = np.where(ok[i], equal[i] / n[i], -1).argmax(axis=1)
            us.append(node[x[i]])
            vs.append(node[y])
        return np.concatenate(us), np.concatenate(vs)

    return lambda batches: _grouped(batches, CLASSES, of_group)


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles binary) of the texts named by wanted(id, key), one row a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, "text"):
                flat, at, node = _shingle_sets(part, width, hasher)
                sets = [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(sets, pa.binary())], names=["node", "shingles"])

    src = _texts(docs, id_col, text_col)
    none = F.lit(-(1 << 63))
    wanted = wanted.select(F.coalesce("id", none).alias("w_id"), F.col("key").alias("w_key")).hint("merge")
    found = src.join(wanted, (F.coalesce("id", none) == F.col("w_id")) & (F.col("key") == F.col("w_key")), "left_semi")
    return found.dropDuplicates(["id", "key"]).select("text").mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose shingle sets have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok[i] = both >= similarity * (len(a) + len(b) - both) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(ok))

    def side(end: str) -> DataFrame:
        return sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set")).hint("merge")

    return pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "u_set", "v_set").mapInArrow(run, "u long, v long")


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, key, group): documents whose sets of `width`-word shingles are similar, grouped over all such links; key is the hash of the text.

    The Golay keys of the sets' fingerprints find candidates first, and the exact Jaccard similarity of the two shingle sets
    decides. Sets of similarity 0.8 differ by ten bits of 64 on average, which no key of three errors reaches, so bands of MinHash
    values find the rest, in groups that the first links leave apart. One round verifies for each node of a band two pairs,
    picked by a byte of each MinHash value; a second one, for each node outside its band's largest group, the likeliest
    pair by fine signatures; a third one all pairs whose ends aren't in one group yet and whose fine signatures allow the
    similarity. So a dense group of copies doesn't cost the square of its size and no link is left out. Texts without a word form one group; a text shorter than a shingle is one shingle.
    Null ids and repeated rows keep their rows; an empty table gives an empty one.
    """
    rows = materialize(sketches(docs, width, id_col, text_col), "sketches")
    first = F.min(F.struct("id", "key")).alias("rep")
    nodes = materialize(rows.groupBy("node").agg(first, F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "sketch-nodes")
    tried = materialize(golay_pairs(nodes.select("node", "fp"), block=block), "pairs-tried")
    shared = materialize(band_groups(nodes, block), "band-groups")
    named = shared.select("node").union(tried.select("u")).union(tried.select("v"))
    wanted = named.distinct().join(nodes.select("node", "rep.*").hint("merge"), "node")
    sets = materialize(shingle_sets(docs, wanted, width, id_col, text_col), "shingle-sets")

    def picked(groups: DataFrame, pairs) -> DataFrame:
        groups = groups.select("k", "node", "root", "size", "sign").repartition("k").sortWithinPartitions("k")
        return groups.mapInArrow(pairs, "u long, v long").distinct()

    roots = materialize(connected_components(verified(tried, sets, similarity)), "pair-roots")
    for step in ("first", "likeliest", "every"):
        rooted = shared.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        # By shuffle at every size: bands, nodes and pairs grow with the input.
        torn = rooted.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("k")
        torn = materialize(rooted.join(torn.hint("merge"), "k"), "torn-groups")
        if step == "first":
            more = picked(torn.select("k", "node", "root", F.lit(0).cast("long").alias("size"), F.col("signature").alias("sign")), _first_pairs(least_equal(similarity)))
        else:
            fine = fine_signatures(sets.join(torn.select("node").distinct().hint("merge"), "node", "left_semi"))
            more = picked(torn.drop("signature").join(fine.hint("merge"), "node"), _fine_pairs(similarity, step == "every"))
        more = more.join(tried.hint("merge"), ["u", "v"], "left_anti")
        more = materialize(more, "pairs-tried")
        tried = tried.union(more)
        found = materialize(verified(more, sets, similarity), "pairs-linked")
        # The groups so far stand for the links that made them; a step without a new link leaves them as they are.
        if not found.isEmpty():
            roots = materialize(connected_components(found.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))), "pair-roots")
    roots = roots.withColumnRenamed("root", "group")
    for table in (shared, sets):
        release(table)
    return rows.select("id", "key", "node").join(roots, "node", "left").select("id", "key", F.coalesce("group", "node").alias("group"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of similar_groups: the one with the smallest id (null last), then the smallest text hash.

    Null and empty texts count as texts without a word, which form one group; of rows with one id and text one stays;
    columns stay as they are, whatever their names; an empty table gives an empty one.
    """
    groups = materialize(similar_groups(docs, width, similarity, id_col, text_col), "similar-groups")
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    first = groups.groupBy("group").agg(F.min(rank).alias("f")).select("f.id", "f.key")
    twins = groups.groupBy("id", "key").agg(F.count("*").alias("n")).where("n > 1")
    key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    # The document's row goes through the join as one column, so that no name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("row_id"), key.alias("row_key"))
    # By shuffle at every size: the documents to keep grow with the input.
    kept = rows.join(first.hint("merge"), F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key")), "left_semi")
    if not twins.isEmpty():
        kept = kept.dropDuplicates(["row_id", "row_key"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
