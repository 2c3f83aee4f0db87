import random
import zlib

import numpy as np
import pytest

from pagetide.llm import queries, spelling
from pagetide.llm.fmindex import Index


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words, times=5):
    """{word: (form, root, n, n_near, form_n)} by comparing all pairs."""
    out = {}
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if one_apart(w, v)]
        m, v = min(near) if near else (0, None)
        out[w] = (v if v and -m >= times * n else None, n, len(near), -m if v and -m >= times * n else None)
    for w in list(out):
        root = w
        while out[root][0]:
            root = out[root][0]
        f, n, k, fn = out[w][:4]
        out[w] = (f, n, k, fn, root)
    return {w: (f, root, n, k, fn) for w, (f, n, k, fn, root) in out.items()}


def some_words(seed, letters, sizes, n):
    rng = random.Random(seed)
    words = {}
    while len(words) < n:
        words["".join(rng.choice(letters) for _ in range(rng.choice(sizes)))] = 5 ** rng.randrange(1, 7) + rng.randrange(3)
    return words


def found(spark, words, **k):
    rows = spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), **k).collect()
    assert len(rows) == len(words)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize(("letters", "sizes", "n"), [("ab", range(1, 9), 300), ("aé", [6, 7, 8, 9], 400), ("abcÿ", [6, 7], 500), ("abcdefgh", [3, 4], 600)])
def test_groups_equal_all_pairs(spark, letters, sizes, n):
    words = some_words(n, letters, list(sizes), n)
    assert found(spark, words) == brute(words)


def test_hot_half_is_split_and_loses_nothing(spark):
    """One beginning for all words: its half is dealt over many shards."""
    words = {"common" + w: n for w, n in some_words(7, "abcd", [5, 6], 400).items()}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    rows = spelling.near_words(df, shard_rows=64, half_rows=20).collect()
    want = brute(words)
    assert len(rows) == len(words) and {r["word"]: (r["n"], r["n_near"]) for r in rows} == {w: (v[2], v[3]) for w, v in want.items()}
    best = {w: min([(-m, v) for v, m in words.items() if one_apart(w, v)], default=(None, None))[1] for w in words}
    assert {r["word"]: r["near"] for r in rows} == best


def test_long_words_empty_table_nulls(spark):
    long = "ab" * 700
    words = {long: 5, long + "c": 25, long[:900] + "x" + long[900:]: 30, "a": 7, "b": 40, "": 3}
    assert found(spark, words) == brute(words)
    assert spelling.variant_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.variant_groups(spark.createDataFrame([(None, 3), ("abc", 9)], "word string, n long")).count() == 1
    with pytest.raises(ValueError):
        spelling.variant_groups(spark.createDataFrame([], "word string, n long"), times=1)


def test_chains_of_forms(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdxg": 125, "abzdxg": 625, "qbzdxg": 3125, "lonely": 9}
    got = found(spark, words)
    assert got == brute(words) and {got[w][1] for w in words} == {"qbzdxg", "lonely"}


def test_intervals_stay_in_step():
    """Both intervals of a pattern that grows on either side hold as many suffixes as the pattern has places."""
    words = sorted(some_words(3, "abc", [3, 4, 5], 60))
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    symbols = np.array([ord(c) - 96 for w in words for c in w])
    index = Index(symbols, off, np.argsort([w[::-1] for w in words], kind="stable"), 4)
    rng = random.Random(1)
    for _ in range(200):
        f, text = index.everything(1), ""
        for _ in range(rng.randrange(1, 5)):
            c, left = rng.randrange(1, 4), rng.random() < 0.5
            f, text = index.extend(f, np.array([c]), left), chr(96 + c) + text if left else text + chr(96 + c)
            places = sum(w[i : i + len(text)] == text for w in words for i in range(len(w)))
            assert int(f.size[0]) == places
            if not places:
                break


def test_runs_of_whole_texts(spark, odd_docs):
    runs = spelling.letter_runs(odd_docs)
    assert runs.where("id IS NULL").count() == 3 and runs.where("id = 4").count() == 6 * 20_000
    docs = spark.createDataFrame([(1, "ÀB×c1déf_GH\tİi ﬁ"), (2, None)], "doc_id long, text string")
    assert sorted(r["run"] for r in spelling.letter_runs(docs).collect()) == sorted(["Àb×c", "déf", "gh", "i"])


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    stems = some_words(2, "abcd", [6, 7], 40)
    rows = [(i, " ".join(rng.choice(list(stems)) for _ in range(120))) for i in range(60)]
    spark.createDataFrame(rows + [(None, "Abcdab abcdab"), (61, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {}
    for i, t in [*rows, (None, "abcdab abcdab")]:
        for w in t.split():
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w
            counts[w] = counts.get(w, 0) + 1
    want = brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in queries.op11_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == want
