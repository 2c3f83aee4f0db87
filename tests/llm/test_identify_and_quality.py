import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetide.llm import langid, quality
from pagetide.llm.words import Hasher


def test_automaton_accepts_exactly_the_substrings():
    text = [1, 2, 1, 1, 2, 3, 1, 2]
    step = langid.suffix_automaton(text)
    subs = {tuple(text[a:b]) for a in range(len(text)) for b in range(a, len(text) + 1)}

    def accepted(s):
        at = 0
        for c in s:
            if c not in step[at]:
                return False
            at = step[at][c]
        return True

    import itertools

    for n in range(4):
        for s in itertools.product((1, 2, 3), repeat=n):
            assert accepted(s) == (s in subs)


def greedy_phrases(text, sample):
    at, n = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at, n = at + k, n + 1
    return n


def test_phrases_match_greedy_parsing():
    samples = {"a": "the cat sat on the mat", "b": "le chat est sur la table"}
    m = langid.Model(samples)
    text = "the chat sat zq on la mat"
    sym = m.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    got = m.phrases(sym, np.array([0, len(text)]))
    assert got[:, 0].tolist() == [greedy_phrases(text, samples[k]) for k in m.languages]


def test_phrases_go_on_over_the_ends_of_blocks():
    """Random texts, periodic ones that never fall into step, and empty ones, of up to eight blocks, against the greedy parse."""
    rng = np.random.default_rng(5)
    samples = {"a": "".join(rng.choice(list("abc "), 400)), "b": "a" * 7 + "b" * 5, "c": "ab" * 50}
    m = langid.Model(samples)
    texts = ["".join(rng.choice(list("abcz "), rng.integers(0, 2000))) for _ in range(20)]
    texts += ["a" * 2500, "ab" * 1200, "", "aab" * 700, "a" * langid.BLOCK, "b" * (langid.BLOCK + 1), "abc" * 40]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    sym = m.symbol[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    got = m.phrases(sym, off)
    assert got.tolist() == [[greedy_phrases(t, samples[k]) for t in texts] for k in m.languages]


def test_the_sample_is_of_whole_texts_and_labels_are_bounded(spark, monkeypatch):
    """Letters behind a long head of digits are learnt; bytes that are no UTF-8 don't stop a prediction."""
    rows = [(i + 100, "0" * 5000 + (" the cat and the dog" if i % 2 else " der hund und die katze") * 20, ("en", "de")[i % 2 == 0]) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    test = spark.createDataFrame([(1, "the dog and the cat"), (2, "die katze und der hund")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    broken = test.withColumn("text", F.concat(F.unhex(F.lit("FF20C3")), F.encode("text", "UTF-8")).cast("string")).withColumn("doc_id", F.col("doc_id") + 10)
    got = {r["id"]: r["lang_pred"] for r in langid.identify(df.union(test).union(broken), F.col("lang").isNotNull()).collect()}
    assert [got[k] for k in (1, 2, 11, 12)] == ["en", "de", "en", "de"]
    monkeypatch.setattr(langid, "MAX_LABELS", 1)
    with pytest.raises(ValueError, match="labels"):
        langid.fit(df)


def test_identify_odd_documents(spark, odd_docs):
    got = langid.identify(odd_docs, F.lit(True)).collect()
    assert len(got) == odd_docs.count()
    by = {(r["id"], r["score"] > 0): r["lang_pred"] for r in got}
    assert by[(1, False)] == by[(2, False)] == by[(5, False)] == "und" and by[(4, True)] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify(odd_docs, F.lit(False)).collect()} == {"und"}
    assert langid.identify(odd_docs.limit(0), F.lit(True)).count() == 0


def test_held_out_languages(spark):
    words = {"en": "the and of to in that is was for with", "de": "der die und das nicht ist ein mit von zu", "fr": "le la les et des une dans pour que est"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 12)), lang) for i in range(90) for lang in [list(words)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, F.col("doc_id") < 45)
    wrong = got.join(df.withColumnRenamed("doc_id", "id"), "id").where("id >= 45 AND lang_pred <> lang").count()
    assert wrong == 0


def test_marginals_match_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    doc = np.array([0, 0, 0, 1, 2, 2])
    score, trans = rng.normal(size=6), rng.normal(size=(2, 2))
    good, pairs, total = quality.Chains(doc).marginals(score, trans)
    want, want_pairs, log_z = np.zeros(6), np.zeros((2, 2)), 0.0
    for d in range(3):
        at = np.flatnonzero(doc == d)
        z, acc, pp = 0.0, np.zeros(len(at)), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(score[i] * v for i, v in zip(at, y, strict=True)) + sum(trans[a, b] for a, b in zip(y[:-1], y[1:], strict=True)))
            z += w
            acc += w * np.array(y)
            for a, b in zip(y[:-1], y[1:], strict=True):
                pp[a, b] += w
        want[at], want_pairs, log_z = acc / z, want_pairs + pp / z, log_z + np.log(z)
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


def test_lines_and_features():
    raw = [b"ab\n\ncd", b"", b"x\n"]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    s, e, d = quality.lines_of(data, off)
    assert [(int(k), bytes(data[a:b])) for a, b, k in zip(s, e, d, strict=True)] == [(0, b"ab"), (0, b""), (0, b"cd"), (1, b""), (2, b"x"), (2, b"")]
    x, size, _ = quality.features(data, off, Hasher())
    assert x.shape[0] == len(s) and size.tolist() == [2, 0, 2, 0, 1, 0]


def test_quality_learns_junk_and_scores_odd_documents(spark, odd_docs):
    rng = np.random.default_rng(3)
    good = lambda: "\n".join(" ".join(rng.choice("some plain words that make a text".split(), 9)) + "." for _ in range(3))
    bad = lambda: "\n".join(" ".join(w.upper() + "!!" for w in rng.choice("some plain words".split(), 9)) for _ in range(3))
    docs = spark.createDataFrame([(i, good() if i % 3 else bad()) for i in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["id"]: r["score"] for r in quality.score_texts(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(60, 90))
    assert {r["doc_id"] for r in quality.keep_good(docs, model, 0.5).collect()} == {i for i in range(90) if i % 3}
    odd = quality.score_texts(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score_texts(docs.limit(0), model).count() == 0
    # A long text of the wrong label is passed over where it would not fit; the rest is learnt all the same.
    huge = docs.union(spark.createDataFrame([(1000, good() * 3000)], "doc_id long, text string"))
    small = quality.fit(huge, labels.union(spark.createDataFrame([(1000, 0)], "doc_id long, quality int")), fit_bytes=100_000)
    assert all((r["score"] >= 0.5) == (r["id"] % 3 > 0) for r in quality.score_texts(docs, small).collect())
    flat = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_texts(odd_docs, flat).collect()} == {0.5}
