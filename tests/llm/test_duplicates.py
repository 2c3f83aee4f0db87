import random
import tempfile

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagetide.llm import common, components, linededup, simhash


def roots_of(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    df = spark.createDataFrame(links + [(None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == roots_of([x for x in links if x[0] != x[1]], nodes)
    assert components.connected_components(df.limit(0)).count() == 0


def test_golay_code_is_perfect():
    leader, near, count = simhash.golay_tables()
    assert count.min() == 1 and set(count.tolist()) == {1, 6}
    words = np.random.default_rng(5).integers(0, 1 << 23, 2000)
    codeword = words ^ leader[simhash._mod_g(words)]
    assert not simhash._mod_g(codeword).any() and (np.bitwise_count(words ^ codeword) <= 3).all()


@pytest.mark.parametrize("block", [3, 2048])
def test_no_link_within_three_bits_is_lost(spark, block):
    rng = np.random.default_rng(6)
    base = rng.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base[:20]:
        for _ in range(8):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(int(np.array(x & (1 << 64) - 1, np.uint64).view(np.int64)))
    fps |= {0, -1}
    nodes = sorted(fps)
    f = np.array(nodes, np.int64)
    want = roots_of([(nodes[i], nodes[j]) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count((f ^ f[i]).view(np.uint64)) <= 3) if i != j], nodes)
    df = spark.createDataFrame([(n,) for n in nodes], "fp long")
    got = {r["node"]: r["root"] for r in components.connected_components(simhash.golay_links(df, 3, block)).collect()}
    assert {n: got.get(n, n) for n in nodes} == want


def test_fingerprint_is_sparks_xxhash64(spark):
    text = "One two  THREE\tfour five"
    words = text.lower().split()
    shingles = [" ".join(words[i : i + 3]) for i in range(3)]
    h = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert simhash.fingerprint(text.encode(), 3, xxhash.xxh64_intdigest) == want


def test_near_duplicates_odd_documents(spark, odd_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {(r["id"], r["fp"]): r["component"] for r in got}
    assert by[(1, 0)] == by[(2, 0)] == by[(5, 0)] == 1
    assert {r["component"] for r in got if r["id"] in (3, 7)} == {3}
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_keep_one_of_each_group(spark, odd_docs):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    rows, kept = [], set()
    for g in range(12):
        words = [rng.choice(vocab) for _ in range(200)]
        kept.add(g * 10)
        for c in range(4):
            copy = list(words)
            for _ in range(c):
                copy[rng.randrange(200)] = rng.choice(vocab)
            rows.append((g * 10 + c, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept
    odd = simhash.keep_one(odd_docs)
    assert odd.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in odd.collect()) == [1, 3, 4, 6, 8, 9]


def five_word_sets(texts):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return out


@pytest.mark.parametrize("block", [7, 2048])
def test_similar_groups_are_those_of_exact_jaccard(spark, block):
    """Block edits (text appended, cut off) and scattered ones between 0.68 and 0.92, against all pairs."""
    rng = random.Random(11)
    texts = []
    for g in range(150):
        size = rng.choice([60, 104, 184])
        base = [f"g{g}w{i}" for i in range(size)]
        texts.append(base)
        for j in (0.8, 0.85, 0.9, 0.75):
            texts.append(base + [f"g{g}j{j}n{i}" for i in range(round((size - 4) * (1 / j - 1)))])
        texts.append(base[: 4 + round((size - 4) * rng.uniform(0.7, 0.9))])
        edited = list(base)
        for i in rng.sample(range(size), 2):
            edited[i] = f"g{g}e{i}"
        texts.append(edited)
    # One large loose group: a template with its own words in each text, most pairs below 0.8.
    template = [f"t{i}" for i in range(90)]
    texts += [template[: 45 + k % 3] + [f"own{k}n{i}" for i in range(rng.choice([1, 4, 8]))] + template[45:] for k in range(30)]
    # A large group of copies of one text that is there, each with its own edits: likest to that text, pairs of copies below 0.8.
    star = [f"s{i}" for i in range(150)]
    texts.append(star)
    for k in range(120):
        copy = list(star)
        for i in rng.sample(range(150), rng.choice([1, 2, 3, 4])):
            copy[i] = f"s{k}e{i}"
        texts.append(copy)
    texts = [" ".join(t) for t in texts]
    sets = five_word_sets(texts)
    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    near = {(a, b) for at in by.values() for a in at for b in at if a < b}
    want = roots_of([(a, b) for a, b in near if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])], range(len(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first, got = {}, {}
    for r in sorted(simhash.similar_groups(docs, block=block).collect()):
        got[r["id"]] = first.setdefault(r["group"], r["id"])
    assert got == want


def test_golay_keys_find_the_pairs_within_three_bits(spark, monkeypatch):
    """Without a band, pairs of at least 0.8 whose sets' fingerprints differ by three bits are still one group; so are sets of one fingerprint."""
    rng = random.Random(5)
    texts = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(400)]
        edited = list(base)
        edited[rng.randrange(400)] = "other"
        texts += [" ".join(base), " ".join(edited)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(simhash.sketches(docs, 5, "doc_id", "text").select("id", "fp", "node").collect())
    sets = five_word_sets(texts)
    near = [a for a in range(0, 120, 2) if ((rows[a]["fp"] ^ rows[a + 1]["fp"]) & (1 << 64) - 1).bit_count() <= 3 and 5 * len(sets[a] & sets[a + 1]) >= 4 * len(sets[a] | sets[a + 1])]
    assert 10 < len(near) < 60 and any(rows[a]["fp"] == rows[a + 1]["fp"] for a in near)
    monkeypatch.setattr(simhash, "band_groups", lambda nodes, block: nodes.select(nodes["node"].alias("k"), "node", "signature").limit(0))
    groups = {r["id"]: r["group"] for r in simhash.similar_groups(docs).collect()}
    assert [a for a in range(0, 120, 2) if groups[a] == groups[a + 1]] == near
    assert len(set(groups.values())) == 120 - len(near)


def test_set_fingerprints_are_majorities_of_bits():
    flat, at = np.array([1, 3, 7, 2**63, 2**63 + 1], np.uint64), np.array([0, 3, 5])
    assert simhash._set_fingerprints(flat, at).tolist() == [3, 2**63]


def test_texts_below_the_similarity_stay(spark):
    """Pairs at exactly 0.8 lose one text, pairs at 0.7 to 0.79 none."""
    rows, kept = [], set()
    for g in range(200):
        extra = 25 if g % 2 else 27 + g % 16
        base = [f"g{g}w{i}" for i in range(104)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base + [f"g{g}n{i}" for i in range(extra)]))]
        kept |= {2 * g} if g % 2 else {2 * g, 2 * g + 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept


def brute_lines(docs, least):
    seq = [(i, k, line, len(line.encode().split())) for i, t in sorted(docs) for k, line in enumerate(t.split("\n"))]
    first, gone = {}, set()
    for s in range(len(seq)):
        run, words = [], 0
        for e in range(s, len(seq)):
            if seq[e][0] != seq[s][0]:
                break
            run.append(seq[e][2])
            words += seq[e][3]
            key = "\n".join(run)
            if key in first:
                if words >= least:
                    gone |= {seq[x][:2] for x in range(s, e + 1)}
            else:
                first[key] = s
    return gone


@pytest.mark.parametrize("least", [1, 4, 9])
def test_line_dedup_matches_brute_force(spark, least):
    rng = random.Random(least)
    docs = [(i, "\n".join(rng.choice(["a", "b", "", "a b", "c d e"]) for _ in range(rng.randint(1, 14)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = linededup.dedup_lines(df, least).collect()
    assert {(r["doc_id"], x) for r in out for x in r["deleted"]} == brute_lines(docs, least)
    texts = dict(docs)
    assert all(r["text"] == "\n".join(x for k, x in enumerate(texts[r["doc_id"]].split("\n")) if k not in r["deleted"]) for r in out)


def test_line_dedup_odd_documents(spark, odd_docs):
    out = linededup.dedup_lines(odd_docs, 3).collect()
    assert len(out) == odd_docs.count()
    by = sorted((r["doc_id"] or 0, r["n_lines"], tuple(r["deleted"])) for r in out)
    # A null id comes first, so its text is the first copy; equal rows are one document.
    assert by.count((3, 1, (0,))) == 2 and (7, 1, (0,)) in by and (0, 1, ()) in by and (1, 0, ()) in by
    assert linededup.dedup_lines(odd_docs.limit(0)).count() == 0
    # Lines that weak hashes confuse both stay; columns of other names are untouched, those of the two names replaced.
    texts = {r["doc_id"]: r for r in linededup.dedup_lines(odd_docs, 1).collect()}
    assert len(texts[8]["text"]) == len(texts[9]["text"]) == 2048 and texts[8]["gone"] == "k"


def test_line_dedup_is_linear_in_the_lines_of_a_text(spark):
    many = "\n".join(f"line {i} with some words" for i in range(60_000))
    df = spark.createDataFrame([(1, many), (2, many + "\nlast")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
    assert got[1]["deleted"] == [] and got[2]["deleted"] == list(range(60_000)) and got[2]["text"] == "last"


def test_components_are_found_again_only_for_new_links(spark, monkeypatch):
    """Steps that bring no new link don't search for components, and later searches get groups, not all links so far."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base), " ".join(base[:150] + ["other"] + base[151:]), *[" ".join(rng.choice(base) for _ in range(50)) for _ in range(5)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    calls, search = [], simhash.connected_components

    def counted(links):
        calls.append(links.count())
        return search(links)

    monkeypatch.setattr(simhash, "connected_components", counted)
    groups = {r["id"]: r["group"] for r in simhash.similar_groups(docs).collect()}
    assert groups[0] == groups[1] and len(set(groups.values())) == 6
    assert len(calls) <= 2


def test_a_round_of_stars_reads_the_links_few_times(spark):
    """What a round plans and shuffles is the driver's to hold: each star reads its links twice (large: from both ends), and nothing is broadcast."""
    path = tempfile.mkdtemp() + "/links"
    spark.createDataFrame([(i + 1, i) for i in range(50)] + [(60, k) for k in range(51, 60)], "u long, v long").write.parquet(path)
    links = spark.read.parquet(path)
    plan = components._star(components._star(links, True), False).distinct()
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") <= 8 and "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    assert len(plan.collect()) == plan.distinct().count()


def test_materialize_collects_the_driver_s_garbage(spark, tmp_path):
    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = beans()
    common.materialize(spark.range(3), "three")
    assert beans() > before
