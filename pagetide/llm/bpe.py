"""BPE encoding and decoding over a distinct-word table.

Texts are normalised and cut into words as the tokenizer's own pre-tokenizer does, by array operations over whole
slices. Spark counts the distinct words and encodes each of them once. The ids of the `head` most frequent words are
broadcast (a bounded table); the other words are joined with the table of encoded words, each once a slice of texts, and
the lists that come out are written by the slices' partitions. The texts themselves never move: they are read again where they are, a
slice beside its list. There ids go to the words' positions; decoding joins ids with the id-to-piece table, which is as
small as the vocabulary file.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import materialize, new_path, release, repeatable, slices, string_buffers
from pagetide.llm.storage import Store
from pagetide.llm.words import Pieces, Table, most_frequent, summed

HEAD_WORDS = 1 << 20
SLICE_BYTES = 1 << 18
#: Words whose code points are made at a time when a table of words is built.
PIECE_ROWS = 1 << 16
#: Partitions of the texts whose lists share a folder, and bytes of a row group there.
FOLDER_PARTS = 8
GROUP_BYTES = 1 << 20
_OTHER, _SPACE, _LETTER, _NUMBER = range(4)


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import sys

    if "/opt/tokenizers" not in sys.path and "/opt" not in sys.path:
        sys.path.append("/opt")
    try:
        import public_tokenizers
    except ImportError:
        import importlib.util

        spec = importlib.util.spec_from_file_location("public_tokenizers", "/opt/tokenizers/__init__.py")
        public_tokenizers = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(public_tokenizers)
    return public_tokenizers.path(name)


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if a < 0xD800 and b >= 0xE000:
                out[a:0xD800] = kind
                out[0xE000 : b + 1] = kind
            else:
                out[a : b + 1] = kind
    return out


def normalise(text: str) -> str:
    """NFC, then lower case character by character (no final sigma)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def cut(cp: np.ndarray, off: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the words of normalised texts laid end to end (code points).

    The pattern is `'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`: runs of letters, single numbers, runs
    of others; an apostrophe that starts such a run and stands before a letter is a run of its own, so a contraction is
    exactly a run of one apostrophe with the listed letters after it.
    """
    n = len(cp)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    kind = classes[cp]
    begin = np.ones(n, bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    begin[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    k = kind[starts]
    doc = np.searchsorted(off, starts, side="right") - 1
    quote = np.flatnonzero((cp[starts] == 0x27) & (ends - starts == 1))
    quote = quote[quote + 1 < len(starts)]
    quote = quote[(k[quote + 1] == _LETTER) & (doc[quote + 1] == doc[quote])]
    if len(quote):
        padded = np.concatenate([cp, [0, 0]])
        at, length = starts[quote + 1], ends[quote + 1] - starts[quote + 1]
        a, b = padded[at], np.where(length > 1, padded[at + 1], 0)
        two = ((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C))
        one = np.isin(a, [0x73, 0x74, 0x6D, 0x64])
        taken = np.where(one, 1, np.where(two, 2, 0))
        ends[quote] += taken
        starts[quote + 1] += taken
    keep = (k != _SPACE) & (ends > starts)
    return starts[keep], ends[keep], doc[keep]


class Words:
    """Cuts slices of texts into words; made once a task."""

    def __init__(self, specials: list[str]) -> None:
        self.classes, self.specials = char_classes(), specials

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, str]]]:
        """Code points; start, end and text number of each word; (words before it, text number, string) of each special token."""
        sections, owner, special = [], [], []
        for i, t in enumerate(texts):
            for s, is_special in _sections(t or "", self.specials):
                if is_special:
                    special.append((len(sections), i, s))
                else:
                    sections.append(normalise(s))
                    owner.append(i)
        off = np.concatenate([[0], np.cumsum([len(s) for s in sections], dtype=np.int64)])
        cp = np.frombuffer("".join(sections).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts, ends, section = cut(cp, off, self.classes)
        before = np.searchsorted(section, [k for k, _, _ in special])
        return cp, starts, ends, np.asarray(owner, np.int64)[section], [(int(n), i, s) for n, (_, i, s) in zip(before, special, strict=True)]


def _pieces(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    text = cp.tobytes().decode("utf-32-le")
    return pa.array([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.string())


def word_counts(texts: DataFrame, specials: list[str]) -> DataFrame:
    """(text) -> (word, n): occurrences of each distinct word of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(specials)

        def found() -> Iterator[tuple[pa.Array, np.ndarray]]:
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    cp, starts, ends, _, _ = words(part.column("text").to_pylist())
                    pieces = Pieces(cp)
                    first, back = pieces.distinct(starts, ends, pieces.hashes(starts, ends))
                    yield _pieces(cp, starts[first], ends[first]), np.bincount(back, minlength=len(first))

        yield from summed(found())

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _sections(text: str, specials: list[str]) -> list[tuple[str, bool]]:
    """The text cut at the special tokens' strings, leftmost first."""
    if "<|" not in text or not any(s in text for s in specials):
        return [(text, False)]
    import regex

    return [(s, s in specials) for s in regex.split("(" + "|".join(map(regex.escape, specials)) + ")", text) if s]


class Encoder:
    """Ids of single words, from the tokenizer file."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __call__(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


def encode_words(words: DataFrame, spec) -> DataFrame:
    """(word, n) -> (word, n, ids array<int>): each row encoded once; `spec` is the broadcast tokenizer file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(spec.value)
        for batch in batches:
            for part in slices(batch, "word", SLICE_BYTES):
                ids = encode(part.column("word").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, ids array<int>")


class Ids:
    """Ids of a bounded table of words, found by hash and by code points."""

    def __init__(self, state: tuple) -> None:
        keys, order, utf8, off, self.flat, ids_off = state
        self.table = Table((keys, order, _code_points(utf8, int(off[-1])), off.astype(np.int64)))
        self.off = ids_off.astype(np.int64)

    @staticmethod
    def state(words: pa.Array, lists: pa.Array) -> tuple:
        """What to broadcast for these words and their ids: words stay UTF-8 on the way, and the driver makes no string for each."""
        off = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(words)), dtype=np.int64)])
        keys = np.empty(len(words), np.uint64)
        for at in range(0, len(words), PIECE_ROWS):
            part, own = words.slice(at, PIECE_ROWS), off[at : at + PIECE_ROWS + 1] - off[at]
            keys[at : at + PIECE_ROWS] = Pieces(_code_points(string_buffers(part)[1], int(own[-1]))).hashes(own[:-1], own[1:])
        order = np.argsort(keys, kind="stable").astype(np.int32)
        size = np.asarray(pc.list_value_length(lists)).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
        flat = np.asarray(lists.flatten()).astype(np.uint32) if len(lists) else np.zeros(0, np.uint32)
        ids_off = np.concatenate([[0], np.cumsum(size)])
        return keys[order], order, string_buffers(words)[1].copy(), _narrow(off), flat, _narrow(ids_off)


def _narrow(off: np.ndarray) -> np.ndarray:
    return off.astype(np.int32) if off[-1] < 1 << 31 else off


def _code_points(utf8: np.ndarray, n: int) -> np.ndarray:
    """The n code points of UTF-8 bytes, decoded a megabyte at a time."""
    out, at, decode = np.empty(n, np.uint32), 0, codecs.getincrementaldecoder("utf-8")().decode
    for lo in range(0, len(utf8), 1 << 20):
        part = np.frombuffer(decode(utf8[lo : lo + (1 << 20)].tobytes()).encode("utf-32-le"), np.uint32)
        out[at : at + len(part)] = part
        at += len(part)
    return out


def _head(top: DataFrame) -> tuple:
    """What to broadcast for these rows (word, ids); the collected table is gone when it is sent."""
    rows = top.select("word", "ids").toArrow()
    words, lists = (c.combine_chunks() for c in rows.columns)
    return Ids.state(words, lists)


def _take(flat: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = off[rows + 1] - off[rows]
    out = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(out[-1]) + np.repeat(off[rows] - out[:-1], size)], out


def _seal(texts: pa.Array) -> int:
    """A hash of a slice's texts, by which it is known again."""
    import xxhash

    off, raw = string_buffers(texts)
    h = xxhash.xxh3_64(off.tobytes())
    h.update(raw.tobytes())
    return h.intdigest() >> 1


def rare_words(src: DataFrame, specials: list[str], head) -> DataFrame:
    """(id, text, part) -> (part, slice, seal, word): the words outside the head, each once a slice of a partition's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, number = Words(specials), Ids(head.value), -1
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                number += 1
                cp, starts, ends, _, _ = words(rows.column("text").to_pylist())
                pieces = Pieces(cp)
                h = pieces.hashes(starts, ends)
                rare = np.flatnonzero(known.table.find(pieces, starts, ends, h) < 0)
                first, _ = pieces.distinct(starts[rare], ends[rare], h[rare])
                n = len(first)
                if n:
                    fixed = [pa.array(np.full(n, v)) for v in (rows.column("part")[0].as_py(), number, _seal(rows.column("text")))]
                    yield pa.RecordBatch.from_arrays([*fixed, _pieces(cp, starts[rare[first]], ends[rare[first]])], names=["part", "slice", "seal", "word"])

    return src.mapInArrow(run, "part long, slice long, seal long, word string")


class Lists:
    """The encoded rare words of one partition's slices, as write_lists() left them."""

    def __init__(self, root: str, part: int) -> None:
        import pyarrow.parquet as pq

        store, found = Store(f"{root}/folder={part // FOLDER_PARTS}"), []
        for name, _ in store.names():
            if name.endswith(".parquet"):
                with store.open(name) as f:
                    file = pq.ParquetFile(f)
                    at = file.schema_arrow.get_field_index("part")
                    for k in range(file.num_row_groups):
                        span = file.metadata.row_group(k).column(at).statistics
                        if span is None or not span.has_min_max or span.min <= part <= span.max:
                            rows = file.read_row_group(k, use_threads=False)
                            found.append(rows.filter(pc.equal(rows.column("part"), part)))
        self.rows = pa.concat_tables(found).combine_chunks() if found else None
        self.places = {n: i for i, n in enumerate(self.rows.column("slice").to_pylist())} if found else {}

    def of(self, number: int, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(words, lists of ids) of a slice."""
        if number not in self.places:
            return pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
        row = self.rows.slice(self.places[number], 1)
        if row.column("seal")[0].as_py() != _seal(texts):
            raise RuntimeError("the texts were read in another order than before; give encode_and_decode() a table")
        rare = row.column("rare").combine_chunks().flatten()
        return rare.field("word"), rare.field("ids")


def write_lists(rare: DataFrame, encoded: DataFrame) -> str:
    """Join rare words with their ids, by shuffle at every size, and write one list a slice below folders of FOLDER_PARTS partitions each.

    A word in very many slices is a row for each of them, which AQE's skew join splits.
    """
    path = new_path(rare.sparkSession, "bpe-lists")
    found = rare.join(encoded.select("word", "ids").hint("merge"), "word").withColumn("folder", F.floor(F.col("part") / FOLDER_PARTS))
    lists = found.repartition("folder", "part").groupBy("folder", "part", "slice").agg(F.first("seal").alias("seal"), F.collect_list(F.struct("word", "ids")).alias("rare"))
    lists.sortWithinPartitions("folder", "part", "slice").write.option("parquet.block.size", GROUP_BYTES).partitionBy("folder").parquet(path)
    return path


def encode_and_decode(
    docs: DataFrame,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_words: int = HEAD_WORDS,
    with_ids: bool = True,
) -> DataFrame:
    """docs plus n_tokens long, ids array<int>, decoded string (or, with with_ids=False, only ids_sha256, decoded_sha256).

    Ids equal those of the tokenizers library without special tokens added, `decoded` its decode with special tokens
    kept. Null and empty texts give no ids; repeated rows and null ids keep their rows; the strings of special tokens
    in a text are these tokens; an empty table gives an empty one. Columns of docs other than the id and the text are
    dropped, so clashing names do no harm.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    spec_text = open(vocabulary or public_vocabulary(), encoding="utf-8").read()
    from tokenizers import Tokenizer

    specials = [t["content"] for t in json.loads(spec_text)["added_tokens"]]
    tokenizer = Tokenizer.from_str(spec_text)
    size = tokenizer.get_vocab_size()
    pieces_of_ids = [(tokenizer.id_to_token(i) or "").encode() for i in range(size)]
    vocab = sc.broadcast((np.frombuffer(b"".join(pieces_of_ids), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces_of_ids])])))
    special_ids = {s: tokenizer.token_to_id(s) for s in specials}
    del tokenizer, pieces_of_ids  # the driver needs them no more

    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # The texts are read several times and their slices must be the same each time.
    src = (src if repeatable(src) else materialize(src, "bpe-texts")).select("id", "text", F.spark_partition_id().cast("long").alias("part"))
    counts = materialize(word_counts(src, specials), "bpe-words")
    encoded = materialize(encode_words(counts, sc.broadcast(spec_text)), "bpe-encoded")
    release(counts)
    head = sc.broadcast(_head(most_frequent(encoded, head_words)))
    pa.default_memory_pool().release_unused()
    lists = write_lists(rare_words(src, specials, head), encoded)
    release(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(specials), Ids(head.value)
        piece_bytes, p_off = vocab.value
        special_rows = {s: len(known.off) - 1 + i for i, s in enumerate(special_ids)}
        fixed_ids = np.concatenate([known.flat, np.array(list(special_ids.values()), np.uint32)])
        fixed_off = np.concatenate([known.off, known.off[-1] + 1 + np.arange(len(special_ids))])
        own, number = None, -1
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                number += 1
                own = own or Lists(lists, part.column("part")[0].as_py())
                texts = part.column("text").to_pylist()
                cp, starts, ends, doc, special = words(texts)
                pieces = Pieces(cp)
                h = pieces.hashes(starts, ends)
                row = known.table.find(pieces, starts, ends, h)
                more = Ids(Ids.state(*own.of(number, part.column("text"))))
                rare = np.flatnonzero(row < 0)
                there = more.table.find(pieces, starts[rare], ends[rare], h[rare])
                if (there < 0).any():
                    raise RuntimeError("a word of a text is missing from the table of encoded words")
                row[rare] = len(fixed_off) - 1 + there
                all_ids = np.concatenate([fixed_ids, more.flat])
                all_off = np.concatenate([fixed_off, fixed_off[-1] + more.off[1:]])
                if special:
                    at = [n for n, _, _ in special]
                    row = np.insert(row, at, [special_rows[s] for _, _, s in special])
                    doc = np.insert(doc, at, [i for _, i, _ in special])
                ids, word_off = _take(all_ids, all_off, row)
                bounds = word_off[np.searchsorted(doc, np.arange(len(texts) + 1))]
                text_bytes, tok_off = _take(piece_bytes, p_off, ids.astype(np.int64))
                # One space after each piece but a text's last.
                spaced = np.full(len(text_bytes) + len(ids), 0x20, np.uint8)
                spaced[np.arange(len(text_bytes)) + np.repeat(np.arange(len(ids)), np.diff(tok_off))] = text_bytes
                s_off = tok_off + np.arange(len(tok_off))
                le = ids.astype("<u4")
                spans = [(int(a), int(b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                decoded = [spaced[s_off[a] : s_off[b] - 1].tobytes() if b > a else b"" for a, b in spans]
                n = pa.array([b - a for a, b in spans], pa.int64())
                if with_ids:
                    cols = [part.column("id"), n, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(decoded, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids", "decoded"])
                else:
                    digest = [hashlib.sha256(le[a:b].tobytes()).hexdigest() for a, b in spans]
                    cols = [part.column("id"), n, pa.array(digest, pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [T.StructField("id", src.schema["id"].dataType), T.StructField("n_tokens", T.LongType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    else:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return src.mapInArrow(run, T.StructType(fields))
