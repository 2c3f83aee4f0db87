import hashlib
import random
import zlib

import numpy as np
import pytest

from pagetide.llm import queries, trie


def brute(convs):
    """{conv_id: [(role, text), ...]} -> the nodes' rows."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        rows.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def rows_of(convs, rng=None):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    if rng:
        rng.shuffle(rows)
    return rows


def nodes_of(spark, convs, **k):
    """All conversations must have a turn here."""
    turns = spark.createDataFrame(rows_of(convs, random.Random(1)), "conv_id long, turn long, role string, text string").repartition(4)
    return sorted((tuple(r) for r in trie.prefix_nodes(trie.turn_lists(turns), **k).collect()), key=str)


def some(seed, n, letters="ab", most=6):
    rng = random.Random(seed)
    return {c: [(rng.choice(["user", "bot"]), rng.choice(letters) * rng.randrange(3)) for _ in range(rng.randrange(1, most))] for c in rng.sample(range(-50, 5000), n)}


@pytest.mark.parametrize("shard_turns", [1 << 17, 200, 30, 1])
@pytest.mark.parametrize(("seed", "n", "letters", "most"), [(1, 120, "ab", 6), (2, 80, "a", 12), (3, 60, "abcdefgh", 4)])
def test_nodes_equal_brute_force(spark, shard_turns, seed, n, letters, most):
    """Shards of few sequences, down to one: most nodes are shared then."""
    convs = some(seed, n, letters, most)
    assert nodes_of(spark, convs, shard_turns=shard_turns) == brute(convs)


def test_chain_of_prefixes_over_shards(spark):
    """Each conversation goes on where another ends, so the last sequence of a shard goes on in the next."""
    convs = {c: [("user", "x")] * (c % 9 + 1) for c in range(40)}
    assert nodes_of(spark, convs, shard_turns=4, broadcast_rows=0) == brute(convs)


def test_copies_and_common_first_turn(spark):
    convs = {c: [("user", "hello"), ("bot", "hi")] for c in range(300)} | {c: [("user", "hello"), ("bot", f"{c % 37}"), ("user", "é𝒳")] for c in range(300, 500)}
    assert nodes_of(spark, convs, shard_turns=40) == brute(convs)


def test_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "END_IDS", 16)
    convs = {c: [("user", "same")] for c in [*range(-40, 200, 3), 10**12]}
    assert nodes_of(spark, convs) == brute(convs)


def test_double_array_holds_every_child():
    rng = np.random.default_rng(5)
    parent, label = [-1], [0]
    seen = set()
    for _ in range(400):
        p, t = int(rng.integers(len(parent))), int(rng.integers(50))
        if (p, t) not in seen:
            seen.add((p, t))
            parent.append(p)
            label.append(t)
    array = trie.DoubleArray.packed(np.array(parent), np.array(label))
    assert len(set(array.slot.tolist())) == len(parent)
    for p in range(len(parent)):
        kids = {label[k]: k for k in range(1, len(parent)) if parent[k] == p}
        to = array.step(np.full(50, array.slot[p]), np.arange(50))
        assert {t: int(s) for t, s in enumerate(to) if s >= 0} == {t: int(array.slot[k]) for t, k in kids.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    return out


def test_query_equals_brute_force_with_odd_rows(spark, tmp_path):
    convs = some(9, 150, "abc", 8)
    convs |= {c: some(10 + c, 1, "abc", 9).popitem()[1] for c in range(0, 5000, 100) if c % 300}
    schema = "conv_id long, turn long, role string, text string, shard string, path string, name string"
    rows = [(*r, "x", "y", "z") for r in rows_of(convs, random.Random(3))]
    # Null turns come first, null roles and texts are empty, repeated rows are turns, rows without an id are nobody's.
    odd = {7001: [("", ""), ("user", "b")], 7002: [("user", "d"), ("user", "d")], 7003: [("bot", "long " * 50_000)]}
    rows += [(7001, 0, "user", "b", *"xyz"), (7001, None, None, None, *"xyz"), (7002, 1, "user", "d", *"xyz"), (7002, 1, "user", "d", *"xyz"), (7003, 5, "bot", "long " * 50_000, *"xyz"), (None, 0, "user", "b", *"xyz")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in queries.op13_conversation_trie(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rebuilt(convs | odd))


def test_empty_table_has_no_nodes(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_conversation_trie(spark, str(tmp_path)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    lists = spark.createDataFrame([(3, []), (2, []), (5, [(0, "ab" * 16, 4)])], "conv_id long, turns array<struct<turn long, name string, size int>>")
    got = {r["depth"]: r for r in trie.prefix_nodes(lists).collect()}
    assert (got[0]["conv_id"], got[0]["n_convs"], got[0]["n_leaves"], got[0]["ends_sha256"]) == (2, 3, 1, hashlib.sha256(b"2,3").hexdigest()) and got[1]["parent_conv_id"] == 2
    only = trie.prefix_nodes(lists.where("conv_id < 5")).collect()
    assert [(r["depth"], r["n_leaves"], r["n_children"]) for r in only] == [(0, 1, 0)]
