import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagetide.llm import bpe, decontaminate, lm
from pagetide.llm.common import repeatable
from pagetide.llm.words import ALNUM, LOWER, Hasher, Pieces, most_frequent, split
from tests.llm.conftest import thue_morse

NASTY = ["", None, "it's 'sx ''s we'll they'LL 're x'd!'s 've", "ΑΣ Σ İstanbul ﬁ Å<|endoftext|>y <|startoftext|>  12 ½ ٣a", "a b​c d\x1c e\x85f", "中文 日本語'm 🙂🙂 'lla", "<|endoftext|>", "'", "x" * 5000, "é ẛ̣"]

NASTY += thue_morse(2048, "a", "b")


@pytest.mark.parametrize("head", [0, 1000])
def test_bpe_equals_the_library(spark, head):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(bpe.public_vocabulary())
    df = spark.createDataFrame(list(enumerate(NASTY)), "doc_id long, text string")
    for r in bpe.encode_and_decode(df, head_words=head).collect():
        ids = tk.encode(NASTY[r["id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == tk.decode(ids, skip_special_tokens=False)


def test_bpe_reads_texts_where_they_are(spark, tmp_path, monkeypatch):
    """Files of several partitions are read again slice by slice; what is done with the result moves no slice number."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "SLICE_BYTES", 2000)
    rows = [(i, f"word{i % 7} some{i * i} {NASTY[i % len(NASTY)] or ''} it's common " * (1 + i % 5)) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert repeatable(docs.select("doc_id", F.upper("text"))) and not repeatable(docs.distinct()) and not repeatable(spark.createDataFrame(rows, "doc_id long, text string"))
    tk = Tokenizer.from_file(bpe.public_vocabulary())
    want = {i: tk.encode(t, add_special_tokens=False).ids for i, t in rows}
    out = bpe.encode_and_decode(docs, head_words=5)
    for df in (out, out.coalesce(1), out.union(out).distinct(), bpe.encode_and_decode(docs.orderBy("text"), head_words=5)):
        got = {r["id"]: r["ids"] for r in df.collect()}
        assert got == want


def test_bpe_odd_documents(spark, odd_docs):
    out = bpe.encode_and_decode(odd_docs, with_ids=False).collect()
    assert len(out) == odd_docs.count() and {r["n_tokens"] for r in out if r["id"] in (1, 2, 5)} == {0}
    assert len({r["ids_sha256"] for r in out if r["id"] in (8, 9)}) == 2
    assert {r["decoded_sha256"] for r in out if r["id"] == 1} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode_and_decode(odd_docs.limit(0)).count() == 0


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


@pytest.mark.parametrize("head,segment", [(1 << 18, 64 << 20), (3, 64 << 20), (50, 1)])
def test_lm_base_is_exact_and_scores_are_probabilities(spark, head, segment):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words, 25, p=np.arange(30, 0, -1) / 465))) for i in range(60)] + [(71, thue_morse(2048, "a", "b")[0]), (80, thue_morse(2048, "a", "b")[1]), (100, None), (101, ""), (102, "New words HERE w0 w1")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["id"]: r for r in lm.score_texts(df, F.col("doc_id") % 10 != 0, head_words=head, segment_bytes=segment).collect()}
    c = Counter(w for i, t in docs if i % 10 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in docs:
        ws = tokens(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert got[i]["base_score"] == pytest.approx(base) and got[i]["score"] <= 1e-9
    assert len(got) == len(docs)


def head_of(c, size):
    """The words whose counts are exact: whole classes of counts, the closing token always."""
    out, classes = {"\n"}, {}
    for w, k in c.items():
        if w != "\n":
            classes.setdefault(math.floor(math.log2(k) * 16), []).append(w)
    for level in sorted(classes, reverse=True):
        size -= len(classes[level])
        if size < 0:
            break
        out.update(classes[level])
    return out


def backed_off(c, pairs, text, head=1 << 18):
    """log10 of a text's probability; counts of pairs, and of context words outside the head, are powers of two."""
    head = head_of(c, head)
    n, v, want, ws = sum(c.values()), len(c), 0.0, tokens(text)
    for h, w in zip(["\n", *ws[:-1]], ws, strict=True):
        p = (c[w] + 0.1) / (n + 0.1 * (v + 1))
        if c[h] and pairs[h, w]:
            p = lm.WEIGHT * min(1, 2 ** int(math.log2(pairs[h, w])) / (c[h] if h in head else 2 ** int(math.log2(c[h]))))
        elif c[h]:
            p *= 1 - lm.WEIGHT
        want += math.log10(p)
    return want


def counted(texts):
    c, pairs = Counter(), Counter()
    for t in texts:
        ws = tokens(t)
        c.update(ws)
        pairs.update(zip(["\n", *ws[:-1]], ws, strict=True))
    return c, pairs


def test_lm_score_backs_off(spark):
    docs = [(i, "a b a b a c") for i in range(1, 9)] + [(10, "a b q")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["id"]: r for r in lm.score_texts(df, F.col("doc_id") < 9).collect()}
    assert got[10]["score"] == pytest.approx(backed_off(*counted(t for i, t in docs if i < 9), "a b q"))


@pytest.mark.parametrize("head,segment", [(1 << 18, 64 << 20), (0, 64 << 20), (4, 64 << 20), (4, 1 << 18)])
def test_lm_scores_every_bigram_at_any_head(spark, head, segment, monkeypatch):
    """Bigrams seen once and those of words outside the head count as all others do; more segments give the same."""
    monkeypatch.setattr(lm, "GROUP_SLICES", 1)
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choice(words, 12, p=np.arange(200, 0, -1) / 20100))) for i in range(60)] + [(60, "new w0 new newer w1"), (70, "w0 w1 w2"), (80, "")]
    if segment < 64 << 20:
        docs += [(1001 + i, " ".join(f"z{rng.integers(1 << 40)}" for _ in range(3000))) for i in range(100) if (1001 + i) % 10]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["id"]: r for r in lm.score_texts(df, F.col("doc_id") % 10 != 0, head_words=head, segment_bytes=segment).collect()}
    c, pairs = counted(t for i, t in docs if i % 10)
    off = [abs(got[i]["score"] - backed_off(c, pairs, t, head)) > 1e-6 for i, t in docs if i < 1000]
    # A Bloom filter may find a bigram that isn't there, one in a hundred at its size.
    assert np.mean(off) <= (0.05 if segment == 64 << 20 else 0.25)


def test_lm_segments_agree_when_files_are_split_anew(spark, tmp_path, monkeypatch):
    """Row numbers hold over the passes even if Spark deals the files to other tasks in between, as it does when cores come or go."""
    rng = np.random.default_rng(13)
    docs = [(i, " ".join(f"w{x}" for x in rng.zipf(1.2, 1500) % 100_000 if x < 1 << 40)) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(16).write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    train = F.col("doc_id") % 10 != 0
    monkeypatch.setattr(lm, "GROUP_SLICES", 1)
    whole = {r["id"]: r["score"] for r in lm.score_texts(df, train).collect()}
    plain = lm.materialize
    passes = []

    def then_split_anew(out, name):
        done = plain(out, name)
        if name == "lm-scores":
            spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        passes.append(name)
        return done

    monkeypatch.setattr(lm, "materialize", then_split_anew)
    try:
        cut = {r["id"]: r["score"] for r in lm.score_texts(df, train, segment_bytes=1 << 18).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert passes.count("lm-scores") > 1 and cut == pytest.approx(whole)


def test_lm_odd_documents(spark, odd_docs):
    for train in (True, False):
        out = lm.score_texts(odd_docs, F.lit(train)).collect()
        assert len(out) == odd_docs.count() and all(np.isfinite(r["score"]) for r in out)
    assert lm.score_texts(odd_docs.limit(0), F.lit(True)).count() == 0


def test_most_frequent_is_bounded(spark):
    df = spark.createDataFrame([(f"w{i}", 100 - i) for i in range(100)], "word string, n long")
    got = [r["n"] for r in most_frequent(df, 30).collect()]
    assert 0 < len(got) <= 30 and min(got) == 101 - len(got)


def brute_distance(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def test_edit_distance_matches_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 8)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 12)).astype(np.uint64)
        e, s, t = decontaminate.edit_distance(a, b)
        assert e == brute_distance(a.tolist(), b.tolist()) and 0 <= s <= t <= len(b)


def edited(rng, vocab, words, share, kind):
    words = list(words)
    for _ in range(int(share * len(words))):
        k = rng.choice(["replace", "insert", "delete"]) if kind == "mixed" else kind
        at = rng.integers(len(words))
        if k == "replace":
            words[at] = str(rng.choice(vocab))
        elif k == "insert":
            words.insert(at, str(rng.choice(vocab)))
        else:
            words.pop(at)
    return words


@pytest.mark.parametrize("sizes", [(8, 20), (20, 60), (100, 160)])
def test_decontamination_recall(spark, sizes):
    """Items hidden with 5, 10 and 20 % of edits of each kind; pages without any are left alone."""
    rng = np.random.default_rng(10)
    vocab = np.array([f"v{i}" for i in range(4000)])
    items = [(k, " ".join(rng.choice(vocab, rng.integers(*sizes)))) for k in range(40)]
    docs, cases = [], [(share, kind) for share in (0.05, 0.1, 0.2) for kind in ("replace", "insert", "delete", "mixed")]
    for c, (share, kind) in enumerate(cases):
        for k, text in items:
            host, cut = rng.choice(vocab, 60).tolist(), int(rng.integers(60))
            docs.append((c * 100 + k, " ".join(host[:cut] + edited(rng, vocab, text.split(), share, kind) + host[cut:]).upper()))
    docs += [(5000 + k, " ".join(rng.choice(vocab, 300))) for k in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([*items, (900, None), (901, "")], "item_id int, text string")
    got = {(r["id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    for c, (share, _) in enumerate(cases):
        caught = sum((c * 100 + k, k) in got for k, _ in items)
        assert caught >= {0.05: 39, 0.1: 38, 0.2: 35}[share]
    assert all(i < 5000 for i, _ in got)
    assert {r["doc_id"] for r in decontaminate.keep_clean(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_decontamination_against_brute_force(spark):
    """Every pair found is one within the edits, nearly all such pairs are found, and items that allow no edit are all found."""
    rng = np.random.default_rng(14)
    vocab = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocab, n))) for k, n in enumerate([1, 2, 3, 4, 4, 3, 2, 6, 9, 14, 20, 25])]
    docs = [(i, " ".join(edited(rng, vocab, items[i % 12][1].split(), 0.15, "mixed") + rng.choice(vocab, 30).tolist())) for i in range(60)]
    words = lambda t: t.split()
    want = {(i, k): brute_distance(words(q), words(t)) for i, t in docs for k, q in items}
    want = {key: e for key, e in want.items() if e <= int(0.2 * len(words(items[key[1]][1])))}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["id"], r["item_id"]): r["edits"] for r in decontaminate.contaminated(d, b).collect()}
    assert set(got) <= set(want) and all(got[x] >= want[x] for x in got)
    assert len(got) >= 0.9 * len(want) and {x for x in want if x[1] < 7} <= set(got)


def test_decontamination_odd_documents(spark, odd_docs):
    items = spark.createDataFrame([(1, "a b c"), (2, None), (3, "consectetur lorem IPSUM dolor sit amet")], "item_id long, text string")
    got = decontaminate.contaminated(odd_docs, items).collect()
    assert {(r["id"], r["item_id"]) for r in got} == {(3, 1), (None, 1), (7, 1), (4, 3)}
    assert decontaminate.keep_clean(odd_docs, items).columns == odd_docs.columns
    assert decontaminate.contaminated(odd_docs.limit(0), items).count() == decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0


def test_words_and_hashes():
    raw = ["Ab  c\n", "", "é d", " "]
    b = [r.encode() for r in raw]
    off = np.concatenate([[0], np.cumsum([len(x) for x in b])])
    data = LOWER[np.frombuffer(b"".join(b), np.uint8)]
    s, e, d = split(data, off)
    got = [(int(k), bytes(data[x:y]).decode()) for x, y, k in zip(s, e, d, strict=True)]
    assert got == [(i, w) for i, r in enumerate(raw) for w in re.findall(r"[^\x20\x09-\x0D]+", r.lower())]
    h = Hasher()(data, s, e)
    assert len(set(h.tolist())) == len({w for _, w in got})
    assert len(split(data, off, ALNUM)[0]) == 4 and zlib.crc32(b"") == 0


def test_pieces_are_told_apart_by_bytes_even_where_hashes_collide():
    raw = ["a", "ab", *thue_morse(2048, "a", "b"), "a" * 40, "a", "a" * 41, *thue_morse(2048, "a", "b"), "ab"]
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    pieces = Pieces(data)
    h = pieces.hashes(off[:-1], off[1:])
    assert len(set(h.tolist())) == len(set(raw))
    for hashes in (h, np.zeros(len(raw), np.uint64)):
        first, back = pieces.distinct(off[:-1], off[1:], hashes)
        assert len(first) == len(set(raw)) and [raw[first[b]] for b in back] == raw


def test_a_head_of_words_makes_no_string_for_each_word():
    """What the driver's Python holds of a head follows its bytes; lookups give each word's own ids."""
    import tracemalloc

    texts = ["é😀", "", "x" * 5000, *[f"word{i}" for i in range(200_000)]]
    words, lists = pa.array(texts), pa.array([[i, 7][: 1 + i % 2] for i in range(len(texts))], pa.list_(pa.int32()))
    tracemalloc.start()
    state = bpe.Ids.state(words, lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(texts)
    cp = np.frombuffer("".join([*texts, "none"]).encode("utf-32-le"), np.uint32)
    off = np.concatenate([[0], np.cumsum([len(t) for t in [*texts, "none"]])])
    pieces, ids = Pieces(cp), bpe.Ids(state)
    row = ids.table.find(pieces, off[:-1], off[1:], pieces.hashes(off[:-1], off[1:]))
    assert row.tolist() == [*range(len(texts)), -1]
    assert all(ids.flat[ids.off[i] : ids.off[i + 1]].tolist() == [i, 7][: 1 + i % 2] for i in (0, 1, 2, 3, 70_000, 200_002))
