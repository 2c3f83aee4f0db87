"""Prefix tries of conversations: shards of neighbouring turn sequences as double arrays, shared upper nodes summed over shards.

A turn is named by 128 bits of SHA-256 over role and text, a sequence by its turns' names laid end to end. Equal sequences are
counted first; then ranges of sequences in order are the shards, however many of them begin alike. A node is shared by two
shards only if it lies on the last path of one and the first path of the next, and all that is asked of a node is a sum or
a least value over shards, once each node has one shard that counts it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import materialize, release

TURN_BYTES = 16
#: Turns that a shard has on average.
SHARD_TURNS = 1 << 17
#: Rows of shared nodes that may be broadcast, some 100 bytes each.
BROADCAST_ROWS = 100_000
#: Ids of one sequence's conversations that one row holds at most.
END_IDS = 1 << 16


def turn_name(role: Column, text: Column) -> Column:
    """Hex digits of TURN_BYTES of SHA-256 over role and text; the role's length keeps the two apart."""
    return F.substring(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256), 1, 2 * TURN_BYTES)


def turn_lists(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id long, turns array<struct<turn, name, size>>): a conversation's turns in order, null first, ties by name; size in code points.

    Null roles and texts count as empty; repeated rows are turns of their own; rows without an id belong to no conversation.
    A conversation is one row of 20-odd bytes a turn, texts aside.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), turn_name(role, text).alias("name"), F.char_length(text).alias("size"))
    rows = turns.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def spliced(lists: DataFrame, source: Column, head: Column, most: int) -> DataFrame:
    """(conv_id, turns): the first `head` (at most `most`) turns of the conversation `source`, none if it is absent, then the own turns behind the first `head`."""
    heads = lists.select(F.col("conv_id").alias("from"), F.slice("turns", 1, most).alias("front"))
    rows = lists.select("conv_id", "turns", source.alias("from"), head.cast("int").alias("head")).join(heads, "from", "left")
    front = F.when(F.col("front").isNull(), F.array().cast(lists.schema["turns"].dataType)).otherwise(F.slice("front", F.lit(1), F.col("head")))
    return rows.select("conv_id", F.concat(front, F.slice("turns", F.col("head") + 1, F.size("turns"))).alias("turns"))


def _ends(members: DataFrame) -> DataFrame:
    """(key, conv_id), distinct -> (key, ends_sha256): SHA-256 over each key's ids in order, comma-joined.

    Ids are joined to texts of bounded size first; those of one key are then hashed one after the other as a stream, so that a
    key of any number of ids takes little memory.
    """
    part = F.floor(F.col("conv_id") / END_IDS)
    texts = members.groupBy("key", part.alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("ends_sha256", pa.string())]))
        key, h = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done.append({"key": key, "ends_sha256": h.hexdigest()})
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            if done:
                yield made(done)
        if key is not None:
            yield made([{"key": key, "ends_sha256": h.hexdigest()}])

    return texts.repartition("key").sortWithinPartitions("key", "part").select("key", "ids").mapInArrow(run, "key string, ends_sha256 string")


@dataclass
class DoubleArray:
    """BASE and CHECK over nodes' slots: the child of slot s by turn id t is slot BASE[s] + t, if CHECK there is s."""

    base: np.ndarray
    check: np.ndarray
    slot: np.ndarray

    @staticmethod
    def packed(parent: np.ndarray, label: np.ndarray) -> DoubleArray:
        """Of nodes in preorder: node k > 0 hangs on parent[k] by turn id label[k] >= 0.

        Nodes of several children are placed first, each where the first free room for all of them is found within a few
        tries, or behind the end; only children then fill the gaps, all at once, as they fit anywhere.
        """
        n = len(parent)
        order = 1 + np.lexsort((label[1:], parent[1:]))
        owner, first, size = np.unique(parent[order], return_index=True, return_counts=True)
        base, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        place[0] = 0
        width = int(label.max()) + 1 if n > 1 else 1
        used = np.zeros(2 * n + width + 2, bool)
        used[0] = True
        free, end = 1, 1
        for k in np.flatnonzero(size > 1)[np.argsort(-size[size > 1], kind="stable")].tolist():
            kids = order[first[k] : first[k] + size[k]]
            reach = label[kids] - label[kids[0]]
            at, tries = free, 0
            while used[at + reach].any() and at < end:
                tries += 1
                at = end if tries >= 16 else at + 1
            while used[at + reach].any():
                at += 1
            place[kids], base[owner[k]] = at + reach, at - label[kids[0]]
            used[place[kids]] = True
            end = max(end, int(place[kids[-1]]) + 1)
            if end + width + n >= len(used):
                used = np.concatenate([used, np.zeros(len(used), bool)])
            while used[free]:
                free += 1
        alone = order[first[size == 1]]
        room = np.flatnonzero(~used[: end + len(alone) + 1])[: len(alone)]
        place[alone], base[parent[alone]] = room, room - label[alone]
        check = np.full(int(place.max()) + 1, -1, np.int64)
        check[place[1:]] = place[parent[1:]]
        by_slot = np.zeros(len(check), np.int64)
        by_slot[place] = base
        return DoubleArray(by_slot, check, place)

    def step(self, slot: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The children's slots; -1 where there is no such child."""
        to = self.base[slot] + label
        inside = (to >= 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == slot) & (to != 0), to, -1)


NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node string, parent string, parent_conv_id long, state string"


def _shard(rows: pa.Table) -> pa.Table:
    """The nodes of one shard: rows (path, sizes, n, least, ends_sha256, before, behind); the last two, the same in all rows, are how many
    turns the first sequence has in common with the shard before, and the last one with the shard behind; -1 without such a shard.

    `state`: `done`, `parent` (only the parent's least id is missing), or `shared` (sums over this shard).
    """
    rows = rows.sort_by("path").combine_chunks()
    one = lambda c: rows.column(c).combine_chunks() if isinstance(rows.column(c), pa.ChunkedArray) else rows.column(c)
    paths = one("path").to_pylist()
    depth = np.array([len(p) // TURN_BYTES for p in paths], np.int64)
    names = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, TURN_BYTES // 8)
    off = np.concatenate([[0], np.cumsum(depth)])
    labels = np.unique(names, axis=0, return_inverse=True)[1].reshape(-1) if len(names) else np.zeros(0, np.int64)
    sizes = np.asarray(one("sizes").flatten()).astype(np.int64)
    with_before, with_behind = one("before")[0].as_py(), one("behind")[0].as_py()
    # Turns that each sequence has in common with the one before it.
    common = np.zeros(len(paths), np.int64)
    live, d = np.arange(1, len(paths)), 0
    while len(live):
        live = live[(depth[live] > d) & (depth[live - 1] > d)]
        live = live[labels[off[live] + d] == labels[off[live - 1] + d]]
        d += 1
        common[live] = d
    # New nodes, in preorder: each sequence's turns behind its common ones; the root is node 0.
    fresh = np.arange(off[-1]) - np.repeat(off[:-1], depth) >= np.repeat(common, depth)
    seq = np.repeat(np.arange(len(paths)), depth)[fresh]
    level = np.concatenate([[0], (np.arange(off[-1]) - np.repeat(off[:-1], depth))[fresh] + 1])
    label = np.concatenate([[0], labels[fresh]])
    size = np.concatenate([[0], sizes[fresh]])
    new_names = names[fresh]
    first_seq = np.concatenate([[0], seq])
    # A node's parent is the last node before it that is one level up.
    parent = np.full(len(level), -1, np.int64)
    at = np.arange(len(level))
    chained = np.flatnonzero((level[1:] == level[:-1] + 1)) + 1
    parent[chained] = chained - 1
    loose = np.setdiff1d(at[1:], chained)
    by_level = np.lexsort((at, level))
    starts = np.searchsorted(level[by_level], np.arange(level.max() + 2))
    for lv in np.unique(level[loose]).tolist() if len(loose) else []:
        mine = loose[level[loose] == lv]
        above = by_level[starts[lv - 1] : starts[lv]]
        parent[mine] = above[np.searchsorted(above, mine) - 1]
    trie = DoubleArray.packed(parent, label)
    # All sequences walk the double array at once, a turn at a time.
    node_at = np.full(len(trie.check), -1, np.int64)
    node_at[trie.slot] = at
    weight, least = np.asarray(one("n")), np.asarray(one("least"))
    n_convs, lowest, end_node = np.zeros(len(at), np.int64), np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(paths), np.int64)
    live, slot, d = np.arange(len(paths)), np.zeros(len(paths), np.int64), 0
    while len(live):
        node = node_at[slot]
        n_convs += np.bincount(node, weight[live], minlength=len(at)).astype(np.int64)
        np.minimum.at(lowest, node, least[live])
        over = depth[live] == d
        end_node[live[over]] = node[over]
        live, slot = live[~over], slot[~over]
        slot = trie.step(slot, labels[off[live] + d])
        if (slot < 0).any():
            raise RuntimeError("a sequence leaves the trie")
        d += 1
    on_first, on_last = first_seq == 0, np.zeros(len(at), bool)
    here = int(end_node[-1])
    while here >= 0:
        on_last[here] = True
        here = int(parent[here])
    on_first[0] = True
    taken = on_first & (level <= with_before)  # counted by an earlier shard
    shared = taken | (on_last & (level <= with_behind))
    kids = np.bincount(parent[1:][~taken[1:]], minlength=len(at))
    childless = np.bincount(parent[1:], minlength=len(at)) == 0
    # The last sequence may go on in the next shard; a first one that goes on was counted before, if it ended there.
    childless &= ~(on_last & (level == len(paths[-1]) // TURN_BYTES) & (with_behind == level))
    childless &= ~taken
    cost = n_convs * size - np.where(taken, 0, size)
    # A subtree is a range of the preorder: up to the next node that isn't deeper.
    last = np.full(len(at), len(at), np.int64)
    stack: list[int] = []
    for k, lv in enumerate(level.tolist()):
        while stack and level[stack[-1]] >= lv:
            last[stack.pop()] = k
        stack.append(k)
    over = lambda x: (total := np.concatenate([[0], np.cumsum(x)]))[last] - total[at]
    leaves, saved = over(childless.astype(np.int64)), over(cost)
    ends = np.full(len(at), None, object)
    ends[end_node] = np.array(one("ends_sha256").to_pylist(), object)
    # Names of nodes that other shards or their children have to find: a chain of hashes along the path.
    named = shared.copy()
    chain: dict[int, bytes] = {0: b"root"}
    for k in np.flatnonzero(named).tolist():
        if k:
            chain[k] = hashlib.blake2b(chain[int(parent[k])] + new_names[k - 1].tobytes(), digest_size=TURN_BYTES).digest()
    hung = np.concatenate([[False], shared[parent[1:]]])
    state = np.where(shared, "shared", np.where(hung, "parent", "done"))
    name = [chain[k].hex() if s else None for k, s in enumerate(shared.tolist())]
    above = [chain[p].hex() if h else None for p, h in zip(parent.tolist(), hung.tolist(), strict=True)]
    up = np.where(hung | (parent < 0), 0, lowest[np.maximum(parent, 0)])
    return pa.table({
        "conv_id": lowest, "depth": level, "n_convs": n_convs, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": pa.array(ends.tolist(), pa.string()),
        "node": pa.array(name, pa.string()), "parent": pa.array(above, pa.string()), "parent_conv_id": pa.array(up, mask=hung | (parent < 0)), "state": pa.array(state.tolist(), pa.string()),
    })


def _common(a: str, b: str) -> Column:
    """How many first turns two paths share; -1 if one is null."""
    turn = lambda c, i: F.substring(F.col(c), i * TURN_BYTES + 1, F.lit(TURN_BYTES))
    n = (F.least(F.length(a), F.length(b)) / TURN_BYTES).cast("int")
    same = F.transform(F.sequence(F.lit(0), n), lambda i: (i < n) & (turn(a, i) == turn(b, i)))
    return F.when(F.isnull(a) | F.isnull(b), -1).otherwise(F.array_position(same, False).cast("int") - 1)


def prefix_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """conversations(conv_id, turns array<struct<turn, name, size>>) -> a row for each distinct sequence of first turns, the empty one included.

    conv_id, the smallest member; depth; parent_conv_id, null for the root; n_convs; n_children; n_leaves, childless nodes of
    the subtree; saved_tokens, summed over the subtree: (n_convs - 1) x code points of the node's last turn; ends_sha256 over the
    ids of conversations that end there, in order, comma-joined. Conversations without turns end at the root; an
    empty table gives an empty one, without a root.
    """
    spark = conversations.sparkSession
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["name"]), ""))
    rows = materialize(conversations.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes")).withColumn("key", F.sha2("path", 256)), "conversations")
    alike = rows.groupBy("key").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    distinct = materialize(alike.join(_ends(rows.select("key", "conv_id")), "key").drop("key"), "sequences")
    release(rows)
    total = distinct.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = max(1, -(-total // shard_turns))
    dealt = distinct.repartitionByRange(parts, "path") if parts > 1 else distinct.coalesce(1)
    shards = materialize(dealt.withColumn("shard", F.spark_partition_id()), "shards")
    release(distinct)
    # A row of three numbers a shard: what its outermost sequences have in common with its neighbours'.
    order = Window.orderBy("shard")
    bounds = shards.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    bounds = bounds.select("shard", "low", "high", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("behind"))
    bounds = bounds.select("shard", _common("before", "low").alias("before"), _common("high", "behind").alias("behind"))
    rows = shards.join(F.broadcast(bounds), "shard").select("shard", "path", "sizes", "n", "least", "ends_sha256", "before", "behind")
    nodes = materialize(rows.groupBy("shard").applyInArrow(_shard, NODE), "nodes")
    release(shards)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = nodes.where("state = 'shared'").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.first("parent").alias("parent"))
    merged = materialize(merged, "shared-nodes")
    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("up"))
    above = F.broadcast(above) if merged.count() <= broadcast_rows else above.hint("merge")
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    hung = merged.select(*columns, "parent").unionByName(nodes.where("state = 'parent'").select(*columns, "parent")).join(above, "parent", "left").withColumnRenamed("up", "parent_conv_id")
    whole = nodes.where("state = 'done'").select(*columns, "parent_conv_id").unionByName(hung.select(*columns, "parent_conv_id"))
    nothing = F.lit(hashlib.sha256().hexdigest())
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
