import collections
import functools
import re

import pytest

from pagetide.llm import queries, rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    count = lambda chars: sum(text.count(c) for c in chars)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": count("#*$%&|<>"), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit), "n_upper": count(rules.UPPER), "n_marks": text.count("!"), "n_ends": count(".!?…"), "n_alpha_words": sum(any(c.isalpha() for c in w) for w in words),
    }


TEXTS = [
    None, "", " \n\t\x0b\f\r ", "a", "a b", "a b c", "a b c a b c", "x x x x", "x x x", "a b c d a b c e\n\n\na b c\r\na b c", "é é b c 𝒳 é é b c", "#$ | <> ** && %%",
    "line one\nline one\n \n \nline one\r\nline one\r", "UPPER CASE! AND MORE! " * 30, "one two three four. " * 12, "w " * 3000 + "end.", " ".join(f"word{i % 997}" for i in range(5000)),
]


def test_measures_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in rules.evaluate(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert {k: found[i][k] for k in rules.MEASURES} == brute(t), repr(t)[:80]


def test_bits_are_the_rules(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ledger = rules.evaluate(docs)
    for r in rules.RULES:
        assert ledger.where(f"(failures >> {r.bit} & 1 = 1) <> ({r.failed})").count() == 0, r.name
    assert len({r.bit for r in rules.RULES}) == len({r.name for r in rules.RULES}) == len(rules.RULES)
    with pytest.raises(ValueError):
        rules.mask(["no_such_rule"])


def test_policies_and_ablations_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "doc_id long, text string").repartition(4)
    ledger = rules.evaluate(docs)
    masks = [r["failures"] for r in ledger.select("failures").collect()]
    for r in rules.policy_totals(ledger).collect():
        own = rules.mask(rules.POLICIES[r["version"]])
        hits = [m & own for m in masks]
        assert (r["docs"], r["kept"]) == (len(masks), sum(h == 0 for h in hits))
        assert r["failed_any"] == hits[0] | functools.reduce(lambda a, b: a | b, hits)
        assert r["failed_all"] == functools.reduce(lambda a, b: a & b, hits)
    own = rules.mask(rules.POLICIES["v2"])
    got = {r["rule"]: r for r in rules.ablations(ledger, "v2").collect()}
    assert set(got) == set(rules.POLICIES["v2"])
    for r in rules.RULES:
        bit = 1 << r.bit
        want = (sum(m & bit > 0 for m in masks), sum(m & own == bit for m in masks), sum(m & own & ~bit == 0 for m in masks))
        assert (got[r.name]["failed"], got[r.name]["failed_alone"], got[r.name]["kept_without"]) == want
    kept = rules.apply_policy(ledger, "base").where("kept").count()
    assert kept == sum(m & rules.mask(rules.POLICIES["base"]) == 0 for m in masks)


def test_odd_rows_and_empty_table(spark, odd_docs):
    found = rules.apply_policy(rules.evaluate(odd_docs), "v2")
    assert found.count() == odd_docs.count() and set(odd_docs.columns) - {"n_lines"} <= set(found.columns)
    assert rules.evaluate(odd_docs.limit(0)).count() == 0
    assert rules.ablations(rules.evaluate(odd_docs.limit(0)), "v2").count() == 0
    clash = spark.createDataFrame([(1, "a b c", "z", "y")], "doc_id long, text string, FAILURES string, measured string")
    row = rules.evaluate(clash).collect()[0]
    assert row["measured"] == "y" and row["failures"] & 1


def test_clean_documents_stay_and_junk_goes(spark):
    d = "/root/testdata/sf0.01"
    found = queries.op12_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed")
    assert found.where("quality = 1 AND NOT kept").count() == 0
    assert found.where("quality = 0 AND kept").count() == 0


def test_main_path_is_native(spark):
    plan = queries.op12_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
