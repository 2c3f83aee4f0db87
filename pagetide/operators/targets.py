"""Watched targets: row rules and grouping of interests by URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import urls
from pagetide.functions.text import strip

FIELDS = ("name", "url", "publisher", "category", "keywords", "priority", "enabled")
# Cells that only repeat the one above.
DITTO = ('"', "〃", "同上", "同左")


def enabled_flag(c: Column) -> Column:
    """Blank is true; true and false in any case; anything else null."""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(t.isin("", "true"), True).when(t == "false", False)


def row_errors(rows: DataFrame) -> DataFrame:
    """rows(row_no, FIELDS as text) -> row_no, error (null if valid); wholly blank rows are left out, disabled rows are checked too."""
    cells = {f: strip(F.coalesce(F.col(f), F.lit(""))) for f in FIELDS}
    filled = rows.where(F.concat(*cells.values()) != "")
    error = F.lit(None).cast("string")
    flag = enabled_flag(F.col("enabled"))
    priority = cells["priority"]
    rules = [(flag.isNull(), "enabled"), ((priority != "") & ~priority.rlike("^0*[1-9][0-9]*$"), "priority")]
    rules.append((urls.url_problem(cells["url"]).isNotNull(), urls.url_problem(cells["url"])))
    rules.append((cells["name"] == "", "name is blank"))
    rules += [(cells[f].isin(*DITTO), f"{f}: ditto") for f in ("keywords", "category", "publisher", "url", "name")]
    for broken, message in rules:
        error = F.when(broken, message if isinstance(message, Column) else F.lit(message)).otherwise(error)
    return filled.select("row_no", error.alias("error"))


def interests(rows: DataFrame) -> DataFrame:
    """Valid rows in their types: row_no, name, url, publisher, category, keywords, priority_text, priority, enabled."""
    digits = F.regexp_replace(strip(F.coalesce(F.col("priority"), F.lit(""))), "^0+", "")
    text = F.when(digits != "", digits)
    plain = [strip(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in FIELDS[:5]]
    return rows.select("row_no", *plain, text.alias("priority_text"), text.try_cast("decimal(38,0)").alias("priority"), enabled_flag(F.col("enabled")).alias("enabled"))


def group_targets(rows: DataFrame) -> DataFrame:
    """Interests -> one row for each exact URL: target_id, url, name, enabled, first_row, interests (all rows, in order).

    The name is that of the first enabled row, else of the first. Interests of one URL are a configuration's, so the
    array is small.
    """
    first = F.coalesce(F.min_by("name", F.when(F.col("enabled"), F.col("row_no"))), F.min_by("name", "row_no"))
    fields = [c for c in rows.columns if c not in ("url",)]
    listed = F.array_sort(F.collect_list(F.struct("row_no", *[c for c in fields if c != "row_no"])))
    return rows.groupBy("url").agg(F.min("row_no").alias("first_row"), first.alias("name"), F.bool_or("enabled").alias("enabled"), listed.alias("interests")).withColumn("target_id", urls.target_id(F.col("url")))


def enabled_interests(c: Column) -> Column:
    return F.filter(c, lambda i: i["enabled"])


def duplicates(rows: DataFrame, *columns: str) -> DataFrame:
    """Values that occur more than once, with their count."""
    return rows.groupBy(*columns).agg(F.count("*").alias("times")).where("times > 1")


def first_interest(rows: DataFrame) -> DataFrame:
    """The row that names each URL: enabled ones first, then in order."""
    w = Window.partitionBy("url").orderBy(F.col("enabled").desc(), "row_no")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
