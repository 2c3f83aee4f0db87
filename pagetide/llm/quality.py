"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad; its features are the shares of letters, capitals, digits, symbols, repeated words and
the like in the line and in its two neighbours, and where it stands. The field is fitted by its likelihood on a bounded
sample of labelled documents, whose label holds for all their lines. A document's score is the mean of its lines'
marginal probabilities of being good, by forward and backward passes, weighted by the lines' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import slices, string_buffers
from pagetide.llm.words import Hasher, split

#: The sample that the field is fitted on: at most so many labelled documents, those with the smallest hash of the id, and so
#: many bytes of their whole texts; a text that would pass the bytes is left out of the fit.
FIT_DOCS = 4096
FIT_BYTES = 64 << 20
#: Longer documents are fitted in pieces of so many lines.
FIT_LINES = 128
STEPS = 300
PENALTY = 1e-5
_SYMBOLS = b"#$%&*|!<>{}[]\\/=+_~^@`"
_STOPS = b".,;:?'\"-()"


def _class(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_CLASSES = [
    _class([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]),
    _class(range(0x41, 0x5B)),
    _class(range(0x30, 0x3A)),
    _class(_SYMBOLS),
    _class(b"!"),
    _class(b"|"),
    _class(_STOPS),
    _class(range(0x80, 0x100)),
]


def lines_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the lines of texts laid end to end; every text has one at least."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(off, breaks, side="right") - 1
    doc = np.concatenate([np.arange(len(off) - 1), owner])
    starts = np.concatenate([off[:-1], breaks + 1])
    order = np.lexsort((starts, doc))
    doc, starts = doc[order], starts[order]
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    ends = np.where(last, off[doc + 1], np.append(starts[1:], 0) - 1) if len(doc) else starts
    return starts, ends, doc


def features(data: np.ndarray, off: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, lengths and text numbers of all lines."""
    starts, ends, doc = lines_of(data, off)
    size = (ends - starts).astype(float)

    def total(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (run[ends] - run[starts]).astype(float)

    letter, upper, digit, symbol, shout, pipe, stop, foreign = (total(c[data]) for c in _CLASSES)
    w_start, w_end, _ = split(data, off)
    h = hasher(data, w_start, w_end)
    mark = np.zeros(len(data), bool)
    mark[w_start] = True
    words = np.maximum(total(mark), 1)
    again = np.zeros(len(data), bool)
    if len(h):
        again[w_start[1:][h[1:] == h[:-1]]] = True
    per_char, per_letter = 1 / np.maximum(size, 1), 1 / np.maximum(letter, 1)
    own = np.stack(
        [
            np.log1p(size) / 8,
            letter * per_char,
            upper * per_letter,
            digit * per_char,
            np.minimum(5 * symbol * per_char, 2),
            np.minimum(shout / words, 2),
            np.minimum(pipe / words, 2),
            total(again) / words,
            np.minimum(stop / words, 2),
            np.minimum(size / words / 20, 2),
            foreign * per_letter,
        ],
        axis=1,
    )
    n = len(doc)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])[:n]
    last = np.concatenate([doc[1:] != doc[:-1], [True]])[-n:] if n else first
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][~first[1:]] = own[:-1][~first[1:]]
    after[:-1][~last[:-1]] = own[1:][~last[:-1]]
    return np.concatenate([np.ones((n, 1)), own, before, after, first[:, None], last[:, None]], axis=1), size, doc


class Chains:
    """Chains of lines of several texts, all stepped through together; longest first, so that those alive are the first k."""

    def __init__(self, doc: np.ndarray) -> None:
        self.n = len(doc)
        cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if self.n else np.zeros(0, np.int64)
        length = np.diff(np.append(cut, self.n))
        order = np.argsort(-length, kind="stable")
        self.first, length = cut[order], length[order]
        self.alive = [int(k) for k in np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")]

    def marginals(self, score: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Probability that each line is good, expected counts of label pairs, and the log of the partition sum."""
        local = np.stack([np.ones(self.n), np.exp(np.clip(score, -30, 30))], axis=1)
        m = np.exp(trans)
        forward, total = [], 0.0
        for t, k in enumerate(self.alive):
            a = local[self.first[:k] + t] * (forward[-1][:k] @ m if t else 1.0)
            z = a.sum(axis=1, keepdims=True)
            total += np.log(z).sum()
            forward.append(a / z)
        good, pairs = np.zeros(self.n), np.zeros((2, 2))
        back = np.zeros((0, 2))
        for t in range(len(self.alive) - 1, -1, -1):
            k = self.alive[t]
            here = np.ones((k, 2))
            if len(back):
                nxt = back * local[self.first[: len(back)] + t + 1]
                joint = forward[t][: len(back), :, None] * m[None] * nxt[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                here[: len(back)] = nxt @ m.T
                here[: len(back)] /= here[: len(back)].sum(axis=1, keepdims=True)
            p = forward[t] * here
            good[self.first[:k] + t] = p[:, 1] / p.sum(axis=1)
            back = here
        return good, pairs, total


def fit_field(x: np.ndarray, doc: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of label pairs that make the lines' labels likeliest, by Adam on all chains."""
    nth = np.arange(len(doc)) - np.maximum.accumulate(np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), np.arange(len(doc)), 0))
    chains = Chains(doc * (len(doc) + 1) + nth // FIT_LINES)
    piece = doc * (len(doc) + 1) + nth // FIT_LINES
    same = piece[1:] == piece[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][same], label[1:][same]), 1)
    w = np.zeros(x.shape[1] + 4)
    m = v = np.zeros_like(w)
    n = max(1, len(doc))
    for step in range(1, STEPS + 1):
        good, pairs, _ = chains.marginals(x @ w[:-4], w[-4:].reshape(2, 2))
        g = np.concatenate([x.T @ (good - label), (pairs - seen).ravel()]) / n + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-4], w[-4:].reshape(2, 2)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS, fit_bytes: int = FIT_BYTES) -> dict:
    """Fit on at most `fit_docs` labelled documents of `fit_bytes` in all; without labels of both kinds the field is flat and scores are the share of label 1.

    Null ids and labels other than 0 and 1 teach nothing; null texts count as empty; a label of an unknown id is passed
    over; of repeated labels and rows each counts.
    """
    chosen = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(fit_docs)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    joined = src.join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64("text"))
    # Sizes come first, so that the driver never holds more text than the bound.
    left, fits = fit_bytes, []
    for r in joined.select("id", "y", "h", F.octet_length("text").alias("size")).orderBy(F.xxhash64("id"), "id", "h").limit(fit_docs).collect():
        if r["size"] <= left:
            left -= r["size"]
            fits.append((r["id"], r["h"]))
    fitting = docs.sparkSession.createDataFrame(fits, T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("h", T.LongType())])).distinct()
    rows = joined.join(F.broadcast(fitting), ["id", "h"], "left_semi").orderBy(F.xxhash64("id"), "id", "text").limit(fit_docs).select("id", "y", "text").toArrow()
    y = np.asarray(rows.column("y")).astype(np.int64)
    if len(set(y.tolist())) < 2:
        return {"weights": None, "share": float(y.mean()) if len(y) else 0.5}
    hasher, parts, docs_before = Hasher(), [], 0
    for batch in rows.to_batches():
        for part in slices(batch, "text"):  # so that the driver holds the bytes' arrays of one slice only
            off, data = string_buffers(part.column("text"))
            x, _, doc = features(data, off, hasher)
            parts.append((x, doc + docs_before))
            docs_before += part.num_rows
    x, doc = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    weights, trans = fit_field(x, doc, y[doc])
    return {"weights": weights, "trans": trans}


def _scores(m: dict, hasher: Hasher, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, number of lines and of bad lines of texts laid end to end."""
    n = len(off) - 1
    x, size, doc = features(data, off, hasher)
    good = np.full(len(doc), m["share"]) if m["weights"] is None else Chains(doc).marginals(x @ m["weights"], m["trans"])[0]
    weight = np.maximum(size, 1)
    score = np.clip(np.bincount(doc, weight * good, n) / np.bincount(doc, weight, n), 0, 1)
    return score, np.bincount(doc, minlength=n), np.bincount(doc, good < 0.5, n).astype(np.int64)


def keep_good(docs: DataFrame, model: dict, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores `threshold` at least."""
    state = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in slices(batch, text_col):
                off, data = string_buffers(part.column(text_col))
                yield part.filter(pa.array(_scores(state.value, hasher, off, data)[0] >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score_texts(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_lines, bad_lines), one row per row of docs.

    Null and empty texts are one line of length 0, scored as such; a line of length 0 weighs as one of length 1; repeated
    rows and null ids keep their rows; an empty table gives an empty one.
    """
    state = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = state.value, Hasher()
        for batch in batches:
            for part in slices(batch, "text"):
                off, data = string_buffers(part.column("text"))
                score, n_lines, bad = _scores(m, hasher, off, data)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(score), pa.array(n_lines), pa.array(bad)], names=["id", "score", "n_lines", "bad_lines"])

    out = [T.StructField("id", src.schema["id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_lines", T.LongType()), T.StructField("bad_lines", T.LongType())]
    return src.mapInArrow(run, T.StructType(out))
