"""Comparison of current texts with accepted ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.functions.text import line_count, lines, utf8_prefix
from pagetide.operators import diffs

MAX_DIFF_LINES = 200
MAX_DIFF_BYTES = 65_536
MAX_DIFF_PAIRS = 4_000_000


def same_but_for_link_order(current: Column, previous: Column) -> Column:
    """Equal texts once link markers, trailing on both sides, count as a set; or trailing on one side only, with equal words and links placed elsewhere."""
    both = H.markers_trail(current) & H.markers_trail(previous)
    words = lambda t: F.filter(F.split(H.without_markers(t), r"\s+"), lambda w: w != "")
    one = (H.markers_trail(current) != H.markers_trail(previous)) & (F.size(H.link_markers(current)) > 0) & (H.link_markers(current) == H.link_markers(previous)) & (words(current) == words(previous))
    return ((both | one) & (H.comparison_view(current) == H.comparison_view(previous))) | (current == previous)


def change_status(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """current, previous(key, text, sha256) -> key, status, sha256, previous_sha256.

    `baseline` without an accepted text, `unchanged` if digests agree or only the order of trailing link markers differs,
    else `changed`. Digests are joined first; texts only for the rows whose digests differ.
    """
    old = previous.select(key, F.col("sha256").alias("previous_sha256"))
    joined = current.select(key, "sha256").join(old, key, "left")
    order_only = differing(current, previous, key).where(same_but_for_link_order(F.col("new_text"), F.col("old_text"))).select(key, F.lit(True).alias("order_only"))
    status = F.when(F.col("previous_sha256").isNull(), "baseline").when((F.col("sha256") == F.col("previous_sha256")) | F.col("order_only"), "unchanged").otherwise("changed")
    return joined.join(order_only, key, "left").select(key, status.alias("status"), "sha256", F.coalesce("previous_sha256", F.lit("")).alias("previous_sha256"))


def differing(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """(key, new_text, old_text) of the rows in both tables whose digests differ; other texts aren't moved."""
    keys = current.select(key, "sha256").join(previous.select(key, F.col("sha256").alias("old")), key).where("sha256 <> old").select(key)
    return keys.join(current.select(key, F.col("text").alias("new_text")), key).join(previous.select(key, F.col("text").alias("old_text")), key)


def line_delta(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """(key, line, change, times): lines added and removed, as multisets, of rows in both tables whose texts differ.

    Digests are joined first, texts only where they differ; then one shuffle, in which both sides' lines are summed with signs by (key, line).
    """
    pair = differing(current, previous, key)
    each = pair.select(key, F.explode(F.concat(F.transform(lines(F.col("new_text")), lambda x: F.struct(x.alias("line"), F.lit(1).alias("n"))), F.transform(lines(F.col("old_text")), lambda x: F.struct(x.alias("line"), F.lit(-1).alias("n"))))).alias("e"))
    sums = each.groupBy(key, F.col("e.line").alias("line")).agg(F.sum("e.n").alias("n")).where("n <> 0")
    return sums.select(key, "line", F.when(F.col("n") > 0, "added").otherwise("removed").alias("change"), F.abs("n").alias("times"))


def bounded_line_delta(delta: DataFrame, key: str, most_lines: int = MAX_DIFF_LINES, most_bytes: int = MAX_DIFF_BYTES) -> DataFrame:
    """The first lines of each row's delta (removed before added, then by line) within both bounds: key, lines_kept, bytes_kept, truncated."""
    order = Window.partitionBy(key).orderBy(F.col("change").desc(), "line")
    sized = delta.withColumn("size", F.octet_length("line") + 2).withColumn("n", F.row_number().over(order)).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("n") <= most_lines) & (F.col("upto") <= most_bytes)
    return sized.groupBy(key).agg(F.count_if(fits).alias("lines_kept"), F.coalesce(F.sum(F.when(fits, F.col("size"))), F.lit(0)).alias("bytes_kept"), (F.count_if(~fits) > 0).alias("truncated"))


def link_set_compare(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """(key, links, old_links, same_set, same_text): link identities of both texts as sets."""
    pair = current.select(key, F.col("text").alias("t")).join(previous.select(key, F.col("text").alias("o")), key)
    a, b = H.link_markers(F.col("t")), H.link_markers(F.col("o"))
    return pair.select(key, F.size(a).alias("links"), F.size(b).alias("old_links"), (a == b).alias("same_set"), same_but_for_link_order(F.col("t"), F.col("o")).alias("same_text"))


def marker_placement(texts: DataFrame, key: str) -> DataFrame:
    """(key, identity, place): words before each link marker, other markers aside. Row-local: no window over all lines of a page is needed."""
    # Texts between the markers, in order, and the words they add up to.
    gaps = F.split("text", r"\[a:href:sha256:[0-9a-f]{64}\]", -1)
    words = F.transform(gaps, lambda g: F.size(F.filter(F.split(g, r"\s+"), lambda w: w != "")))
    before = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.aggregate(F.slice(words, 1, i), F.lit(0), lambda a, x: a + x))
    ids = F.regexp_extract_all("text", F.lit(r"\[a:href:sha256:([0-9a-f]{64})\]"), 1)
    return texts.where(F.col("text").contains("[a:href:sha256:")).select(key, F.explode(F.arrays_zip(ids.alias("identity"), before.alias("place"))).alias("m")).where("m.identity IS NOT NULL").select(key, "m.identity", "m.place")


def revision_history(texts: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, status): each text against the one before it."""
    w = Window.partitionBy(key).orderBy(order)
    seen = texts.withColumn("sha256", F.sha2("text", 256)).withColumn("old", F.lag("sha256").over(w))
    status = F.when(F.col("old").isNull(), "baseline").when(F.col("old") == F.col("sha256"), "unchanged").otherwise("changed")
    return seen.select(key, order, status.alias("status"), "sha256")


def _diff(pair: DataFrame, key: str, most_lines: int | None, most_bytes: int | None, most_pairs: int | None) -> DataFrame:
    """(key, diff, truncated) of pair(key, new_text, old_text)."""
    prefix = lambda t: t if most_bytes is None else utf8_prefix(t, most_bytes)
    costly = F.lit(False) if most_pairs is None else line_count(F.col("new_text")).cast("long") * line_count(F.col("old_text")) > most_pairs
    heads, rows = diffs.hunks(diffs.edit_script(pair.where(~costly), key), key)
    cut = prefix(F.col("text"))
    beyond = F.lit(False) if most_lines is None else F.col("n_lines") > most_lines
    shown = diffs.rendered(heads, rows, key, most_lines).select(key, cut.alias("diff"), (beyond | (cut != F.col("text"))).alias("truncated"))
    if most_pairs is None:
        return shown
    notice = F.array(F.lit("--- previous"), F.lit("+++ current"), F.lit("@@ diff omitted: complexity limit exceeded @@"))
    notice = F.array_join(notice if most_lines is None else F.slice(notice, 1, most_lines), "\n")
    return shown.union(pair.where(costly).select(key, prefix(notice), F.lit(True)))


def unified_diff(current: DataFrame, previous: DataFrame, key: str, most_lines: int | None = MAX_DIFF_LINES, most_bytes: int | None = MAX_DIFF_BYTES, most_pairs: int | None = MAX_DIFF_PAIRS) -> DataFrame:
    """(key, diff, truncated): unified diff with three lines of context, for rows whose texts differ, within both bounds; None for a bound gives all.

    Texts of more than `most_pairs` pairs of lines have a notice in place of a diff; with None every pair is compared, and exactly.
    """
    return _diff(differing(current, previous, key), key, most_lines, most_bytes, most_pairs)


def change_record(current: DataFrame, previous: DataFrame, key: str, most_lines: int | None = MAX_DIFF_LINES, most_bytes: int | None = MAX_DIFF_BYTES, most_pairs: int | None = MAX_DIFF_PAIRS) -> DataFrame:
    """change_status with (diff, diff_truncated): empty and false unless the text has changed. Where link markers count as a set, the diff is one of the texts' comparison views. Bounds as in `unified_diff`."""
    status = change_status(current, previous, key)
    changed = status.where("status = 'changed'").select(key)
    new, old = F.col("new_text"), F.col("old_text")
    trail = H.markers_trail(new), H.markers_trail(old)
    words = lambda t: F.filter(F.split(H.without_markers(t), r"\s+"), lambda w: w != "")
    as_set = (trail[0] & trail[1]) | ((trail[0] != trail[1]) & (F.size(H.link_markers(new)) > 0) & (H.link_markers(new) == H.link_markers(old)) & (words(new) == words(old)))
    view = lambda t: F.when(as_set, H.comparison_view(t)).otherwise(t)
    pair = differing(current, previous, key).join(changed, key, "left_semi").select(key, view(new).alias("new_text"), view(old).alias("old_text"))
    diff = _diff(pair, key, most_lines, most_bytes, most_pairs).withColumnRenamed("truncated", "diff_truncated")
    return status.join(diff, key, "left").withColumns({"diff": F.coalesce("diff", F.lit("")), "diff_truncated": F.coalesce("diff_truncated", F.lit(False))})
