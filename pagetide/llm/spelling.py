"""Spelling variants: words that differ by one letter, found in sharded FM-indexes, and the frequent form that each stands for.

Two words one error apart agree in the first or in the second half of either. So a word is indexed under its possible halves and
searched under its own two, and equal halves meet in one shard: no word is compared with all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import materialize, release
from pagetide.llm.fmindex import Index, one_error
from pagetide.llm.words import Pieces

RUN = "([A-Za-z\\u00C0-\\u00FF]+)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Index rows that a shard has on average, and rows of one half beyond which the half is split over several shards.
SHARD_ROWS = 1 << 15
HALF_ROWS = 1 << 15
#: Queries that one pass of a search holds.
BLOCK = 1 << 13


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): maximal runs of Latin letters of whole texts, A-Z lower-cased; null texts have none, null ids stay."""
    found = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(RUN), 1)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(found).alias("run")).withColumn("run", F.translate("run", UPPER, UPPER.lower()))


def without_letter(run: Column, at: Column) -> Column:
    """A run without its code point number `at`, from 0."""
    return F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))


def vocabulary(runs: DataFrame, run: Column, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): distinct words of at least `shortest` code points that occur `least` times or more; summed before the shuffle."""
    words = runs.select(run.alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(words)), dtype=np.int64)])
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32), off


def _search(rows: pa.Table) -> pa.Table:
    """One shard: rows (shard, word, n, part, second, salt, salts); an index row has no `second`. Per query: its near words in this shard."""
    rows = rows.combine_chunks()
    given = pc.is_null(rows.column("second"))
    stored = rows.filter(given).group_by("word", use_threads=False).aggregate([("n", "max"), ("part", "max")]).sort_by("word")
    asked = rows.filter(pc.invert(given)).combine_chunks()
    one = lambda t, c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
    words, queries = one(stored, "word"), one(asked, "word")
    n_near, best_n, best = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64), np.full(len(queries), -1, np.int64)
    if len(words) and len(queries):
        own, off = _points(words)
        sought, q_off = _points(queries)
        letters = np.unique(np.concatenate([own, sought]))
        own, sought = np.searchsorted(letters, own) + 1, np.searchsorted(letters, sought) + 1
        by_end = np.asarray(pc.sort_indices(pa.array([w[::-1] for w in words.to_pylist()], pa.string()))).astype(np.int64)
        index = Index(own, off, by_end, len(letters) + 1)
        count, part = np.asarray(one(stored, "n_max")), np.asarray(one(stored, "part_max"))
        second, salt, salts = (np.asarray(one(asked, c)) for c in ("second", "salt", "salts"))
        a, b = Pieces(own.astype(np.uint32)), Pieces(sought.astype(np.uint32))
        for left in (False, True):
            side = np.flatnonzero(second == left)
            for k in range(0, len(side), BLOCK):
                mine = side[k : k + BLOCK]
                q, w = one_error(index, sought, q_off[mine], q_off[mine + 1], left)
                q = mine[q]
                ok = part[w] % salts[q] == salt[q]
                if left:
                    # What also keeps the first half is found from there.
                    half = (q_off[q] + q_off[q + 1]) // 2 - q_off[q]
                    ok &= ~((off[w + 1] - off[w] >= half) & a.equal(off[w], off[w] + half, b, q_off[q], q_off[q] + half))
                q, w = q[ok], w[ok]
                n_near += np.bincount(q, minlength=len(n_near))
                order = np.lexsort((w, -count[w], q))
                top = order[np.flatnonzero(np.diff(q[order], prepend=-1))]
                best_n[q[top]], best[q[top]] = count[w[top]], w[top]
    none = pa.array(best < 0)
    forms = words.take(pa.array(np.where(best < 0, 0, best), mask=best < 0)) if len(words) else pa.nulls(len(queries), pa.string())
    return pa.table({"word": queries, "n": one(asked, "n"), "n_near": pa.array(n_near), "near_n": pa.array(best_n, mask=np.asarray(none)), "near": forms})


def near_words(words: DataFrame, shortest: int = 1, shard_rows: int = SHARD_ROWS, half_rows: int = HALF_ROWS) -> DataFrame:
    """words(word, n), distinct and not null -> (word, n, n_near long, near_n long, near string).

    n_near: how many of the words differ by exactly one inserted, deleted or replaced code point; near: of them the one of
    largest n, of those the smallest in code-point order; null without any. `shortest` may name the length of the shortest word.
    A half that very many words share is split by the words' hashes, and its queries go to each of its shards.
    """
    spark = words.sparkSession
    length = F.char_length("word")
    first = lambda n: F.floor(n / 2).cast("int")
    lengths = [F.greatest(length - 1, F.lit(shortest)), length, length + 1]
    key = lambda second, half: F.struct(F.lit(second).alias("second"), half.alias("half"))
    ends = lambda size: F.when(size > 0, F.right("word", size)).otherwise("")
    keys = F.array_distinct(F.array(*[key(False, F.substr("word", F.lit(1), first(n))) for n in lengths], *[key(True, ends(n - first(n))) for n in lengths]))
    own = F.array(key(False, F.substr("word", F.lit(1), first(length))), key(True, ends(length - first(length))))
    part = F.pmod(F.xxhash64("word"), F.lit(1 << 20))
    stored = words.select("word", "n", part.alias("part"), F.explode(keys).alias("key"))
    asked = words.select("word", "n", F.explode(own).alias("key"))
    # At most one half in `half_rows` index rows is this frequent, so the list is as short as its square is for the rows of a shard.
    halves = stored.groupBy("key").agg(F.count("*").alias("rows"))
    total, hot = halves.agg(F.sum("rows")).first()[0] or 0, halves.where(F.col("rows") > half_rows)
    salts = F.coalesce(F.ceil(F.col("rows") / half_rows).cast("long"), F.lit(1).cast("long"))
    hot = F.broadcast(spark.createDataFrame(hot.collect(), hot.schema))
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-total // shard_rows)) if total > 1 << 12 else 1
    at = F.pmod(F.xxhash64("key.second", "key.half", "salt"), F.lit(shards)).alias("shard")
    null = F.lit(None)
    index = stored.join(hot, "key", "left").withColumn("salts", salts).withColumn("salt", F.pmod("part", "salts"))
    index = index.select(at, "word", "n", "part", null.cast("boolean").alias("second"), null.cast("long").alias("salt"), null.cast("long").alias("salts"))
    query = asked.join(hot, "key", "left").withColumn("salts", salts).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    query = query.select(at, "word", "n", null.cast("long").alias("part"), F.col("key.second").alias("second"), "salt", "salts")
    found = index.union(query).groupBy("shard").applyInArrow(_search, "word string, n long, n_near long, near_n long, near string")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("minus"), "near")))
    sums = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return sums.select("word", "n", "n_near", (-F.col("best.minus")).alias("near_n"), F.col("best.near").alias("near"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, form) without cycles -> (word, root): where following the forms ends. Paths halve in each round (pointer jumping)."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = materialize(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        release(now)
        if then.where("moved").isEmpty():
            return then.select("word", "root")
        now = then.select("word", "root")


def variant_groups(words: DataFrame, shortest: int = 1, times: int = 5) -> DataFrame:
    """words(word, n) -> (word, form, root, n, n_near, form_n).

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that n is at least `times` the
    word's; `root` is where the forms lead, the word itself if nowhere. n grows along forms, so there are no cycles. Words
    are distinct; null ones are left out; an empty table gives an empty one.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent, or forms could go in circles")
    clear = F.col("near_n") >= times * F.col("n")
    near = materialize(near_words(words.where("word IS NOT NULL"), shortest).select("word", F.when(clear, F.col("near")).alias("form"), "n", "n_near", F.when(clear, F.col("near_n")).alias("form_n")), "near-words")
    roots = last_forms(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
