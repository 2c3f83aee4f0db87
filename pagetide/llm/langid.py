"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text; a document is parsed greedily into the longest phrases that occur
in that text, and the language that needs the fewest phrases wins, after each count is turned into bits a letter
(phrases * log2(length of the labelled text) / letters) so that unequal amounts of labelled text don't matter.

Texts are lower-cased and every run of non-letters counts as one blank. Parsing runs over whole texts, for all blocks of
`BLOCK` symbols and all languages of a slice at once: an automaton is an integer table, a step is one look-up, and what
happens where a phrase ends is written into the table beforehand. A block is first parsed as if a phrase began with it;
blocks that another phrase reaches into are parsed again from the state in which the block before ends, until all states
agree, so that the count is that of one parse of the whole text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import slices, string_buffers

#: The sample that is learnt from: of each label at most so many distinct texts, those with the smallest hash, and so many of their letters.
DOCS_PER_LANGUAGE = 64
CHARS_PER_LANGUAGE = 1 << 14
#: Labels that can be learnt; more are refused.
MAX_LABELS = 256
#: Bytes of the broadcast parse table: with many labels or letters each label has fewer of its letters in it.
TABLE_BYTES = 64 << 20
#: Letters told apart, the most frequent ones of the sample; all others are one.
MAX_LETTERS = 4095
BLOCK = 256
#: Rounds in which all blocks with a new state are parsed at once; what is left after them goes block by block.
_ROUNDS = 4
UNDECIDED = "und"
_STRETCH = 24


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def _letters(text: str) -> str:
    """Lower case, with one blank for every run of non-letters."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Model:
    """Languages, the symbol of each code point, and one parse table for all automata.

    table[state * width + symbol] = next state's first cell * 4 + phrases that end in this step (0, 1 or 2: where a phrase
    ends and the symbol begins none, it is a phrase of its own).
    """

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        often = Counter(c for s in samples.values() for c in s if c != " ")
        alphabet = sorted(c for c, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:MAX_LETTERS])
        room = TABLE_BYTES // max(1, 8 * (len(alphabet) + 2) * len(samples))
        samples = {k: s[: max(1, room)] for k, s in samples.items()}
        number = {" ": 0} | {c: i + 1 for i, c in enumerate(alphabet)}
        self.unknown = len(number)
        self.width = self.unknown + 1
        self.symbol = np.zeros(0x110000, np.uint16)
        every = np.array([chr(i).isalpha() for i in range(0x110000)])
        self.symbol[every] = self.unknown
        for c, i in number.items():
            self.symbol[ord(c)] = i
        for i in np.flatnonzero(every[:0x20000]).tolist():
            low = chr(i).lower()
            if len(low) == 1 and low in number:
                self.symbol[i] = number[low]
        tables, self.roots, self.log_size, base = [], [], [], 0
        for lang in self.languages:
            step = suffix_automaton([number.get(c, self.unknown) for c in samples[lang]])
            cells = np.zeros((len(step), self.width), np.int64)
            root = step[0]
            for c in range(self.width):
                cells[:, c] = ((base + root[c]) * self.width << 2) | 1 if c in root else (base * self.width << 2) | 2
            cells[0, :] -= 1
            for s, out in enumerate(step):
                for c, to in out.items():
                    cells[s, c] = (base + to) * self.width << 2
            tables.append(cells.ravel())
            self.roots.append(base * self.width)
            self.log_size.append(math.log2(max(2, len(samples[lang]))))
            base += len(step)
        self.table = np.concatenate(tables).astype(np.int64 if base * self.width >= 1 << 28 else np.int32) if tables else np.zeros(0, np.int32)

    @classmethod
    def load(cls, state: dict) -> Model:
        """A model from the vars() of another."""
        out = cls.__new__(cls)
        vars(out).update(state)
        return out

    def _parse(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks parsed from the cells given: the cells in which they end, and the phrases that ended in them."""
        order = np.argsort(-length, kind="stable")
        at, size, cell = start[order], length[order], cell[order]
        count = np.zeros(len(order), np.int32)
        alive = np.searchsorted(-size, -np.arange(BLOCK), side="left")
        for t in range(int(size[0]) if len(size) else 0):
            k = alive[t]
            got = self.table.take(cell[:k] + symbols[at[:k] + t].astype(self.table.dtype))
            count[:k] += got & 3
            cell[:k] = got >> 2
        ends, counts = np.empty_like(cell), np.empty_like(count)
        ends[order], counts[order] = cell, count
        return ends, counts

    def phrases(self, symbols: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases of each text (columns) for each language (rows) in the greedy parse of the whole text; texts are laid end to end."""
        size, n_lang = np.diff(off), len(self.languages)
        if not n_lang:
            return np.zeros((0, len(size)))
        blocks = -(-size // BLOCK)
        n = int(blocks.sum())
        doc = np.repeat(np.arange(len(size)), blocks)
        nth = np.arange(n) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = off[:-1][doc] + nth * BLOCK
        length = np.minimum(BLOCK, off[1:][doc] - start)
        roots = np.repeat(np.array(self.roots, self.table.dtype), n)
        start, length, nth, doc = (np.tile(x, n_lang) for x in (start, length, nth, doc))
        entry = roots.copy()
        ends, count = self._parse(symbols, start, length, entry)

        def stale(rows: np.ndarray) -> np.ndarray:
            rows = rows[nth[rows] > 0]
            return rows[ends[rows - 1] != entry[rows]]

        todo = stale(np.arange(n * n_lang))
        rounds = 0
        while len(todo):
            # After some rounds only the first such block of each text goes on, whose state is final: no block is parsed again and again.
            if rounds >= _ROUNDS:
                text = todo - nth[todo]
                todo = todo[np.concatenate([[True], text[1:] != text[:-1]])]
            entry[todo] = ends[todo - 1]
            ends[todo], count[todo] = self._parse(symbols, start[todo], length[todo], entry[todo])
            if rounds >= _ROUNDS:
                after = todo[(todo + 1 < n * n_lang)] + 1
                left = np.setdiff1d(pending, todo, assume_unique=True)
                pending = np.union1d(left, stale(after))
            else:
                pending = stale(np.arange(n * n_lang))
            todo, rounds = pending, rounds + 1
        last = np.append(nth[1:] == 0, True) if len(nth) else np.zeros(0, bool)
        count = count + (last & (ends != roots))
        return np.stack([np.bincount(doc[:n], c, len(size)) for c in count.reshape(n_lang, n)])

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of texts given as UTF-8 laid end to end."""
        text = data.tobytes().decode("utf-8", "replace")
        cp_off = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
        if len(text) != cp_off[-1] or "\ufffd" in text:  # perhaps bytes that are no UTF-8: each text on its own
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            text, cp_off = "".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sym = self.symbol[cp]
        blank = sym == 0
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        keep[cp_off[:-1][cp_off[:-1] < len(cp)]] |= blank[cp_off[:-1][cp_off[:-1] < len(cp)]]
        kept = np.concatenate([[0], np.cumsum(keep)])[cp_off]
        sym = sym[keep]
        letters = np.concatenate([[0], np.cumsum(sym != 0)])
        letters = letters[kept[1:]] - letters[kept[:-1]]
        if not self.languages:
            return [UNDECIDED] * (len(off) - 1), np.zeros(len(off) - 1)
        size = np.maximum(np.diff(kept), 1)
        bits = self.phrases(sym, kept) * np.array(self.log_size)[:, None] / size
        best = bits.argmin(axis=0)
        gap = bits - bits.min(axis=0)
        score = 1 / np.exp2(-np.minimum(gap * _STRETCH, 500)).sum(axis=0)
        score[letters == 0] = 0
        return [self.languages[b] if k else UNDECIDED for b, k in zip(best.tolist(), letters.tolist(), strict=True)], score


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", docs: int = DOCS_PER_LANGUAGE, chars: int = CHARS_PER_LANGUAGE) -> Model:
    """Learn from a bounded sample: of each label whole texts in the order of their hashes, at most `docs` distinct ones, until `chars` letters are reached.

    Null texts and labels teach nothing. Over MAX_LABELS labels raise ValueError.
    """
    src = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
    src = src.withColumn("h", F.xxhash64("text"))
    counts = src.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    if not counts:
        return Model({})
    # The share of all hashes below which twice the texts wanted are expected; where that names too few, all hashes count.
    bounds = [(r["label"], min((1 << 63) - 1, -(1 << 63) + int(min(1.0, 2.5 * docs / max(1, r["n"])) * (1 << 64)))) for r in counts]
    bound = F.broadcast(labelled.sparkSession.createDataFrame(bounds, "label string, bound long"))

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text = [_letters(t)[: chars + 1] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("h"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["label", "h", "letters", "size"])

    near = src.withColumn("label", F.col("label").cast("string")).join(bound, "label").where("h <= bound").select("label", "h", "text")
    sample = near.mapInArrow(letters, "label string, h long, letters string, size long")
    sizes = sample.groupBy("label", "h").agg(F.max("size").alias("size")).collect()
    wanted, taken = [], {}
    for r in sorted(sizes, key=lambda r: (r["label"], r["h"])):
        n, had = taken.get(r["label"], (0, 0))
        if n < docs and had <= chars:
            wanted.append((r["label"], r["h"]))
            taken[r["label"]] = (n + 1, had + r["size"] + 1)
    chosen = F.broadcast(labelled.sparkSession.createDataFrame(wanted, "label string, h long")) if wanted else None
    rows = sample.join(chosen, ["label", "h"]).groupBy("label", "h").agg(F.min("letters").alias("letters")).collect() if wanted else []
    samples: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["label"], r["h"])):
        samples[r["label"]] = (samples.get(r["label"], "") + " " + r["letters"])[: chars + 1]
    return Model({k: s.strip() for k, s in samples.items() if s.strip()})


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, lang_pred, score), one row per row of docs; the model learns from the rows that `train` picks.

    A null text or one without a letter is `und` with score 0, as is every text where no row is labelled; ties go to the
    first label in order; repeated rows and null ids keep their rows; bytes that are no UTF-8 count as no letters; an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    state = spark.sparkContext.broadcast(vars(fit(docs.where(train), text_col, label_col)))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.load(state.value)
        for batch in batches:
            for part in slices(batch, "text"):
                off, data = string_buffers(part.column("text"))
                lang, score = m.predict(data, off)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang, pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    return src.mapInArrow(run, T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
