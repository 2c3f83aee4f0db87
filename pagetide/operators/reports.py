"""Run reports and their delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<!-- target:", "<!-- /target:"


def upsert_sections(sections: DataFrame, fresh: DataFrame) -> DataFrame:
    """sections(run_id, target_id, seq, section): a fresh one takes the place of the old, or comes at the end."""
    place = sections.select("run_id", "target_id", F.col("seq").alias("had"))
    joined = fresh.join(place, ["run_id", "target_id"], "left").withColumn("seq", F.coalesce("had", "seq")).drop("had")
    return sections.join(fresh.select("run_id", "target_id"), ["run_id", "target_id"], "left_anti").unionByName(joined.select(*sections.columns))


def reserved_marker(section: str = "section"):
    """Whether a section holds a marker of ours, which is refused."""
    return F.col(section).contains(START) | F.col(section).contains(END)


def run_reports(sections: DataFrame, title: str = "# Updates") -> DataFrame:
    """(run_id, report, n_sections, sha256): one text a run, sections in order between their markers. A run's sections are few: one a target with a material change."""
    body = F.concat(F.lit(START + " "), F.col("target_id"), F.lit(" -->\n"), F.col("section"), F.lit("\n" + END + " "), F.col("target_id"), F.lit(" -->"))
    rows = sections.where(~reserved_marker()).select("run_id", F.struct("seq", "target_id", body.alias("body")).alias("s"))
    texts = rows.groupBy("run_id").agg(F.array_sort(F.collect_list("s")).alias("all"))
    report = F.concat(F.lit(title + "\n\n"), F.array_join(F.transform("all", lambda s: s["body"]), "\n\n"), F.lit("\n"))
    return texts.select("run_id", report.alias("report"), F.size("all").alias("n_sections")).withColumn("sha256", F.sha2("report", 256))


_BLANKS = " \t\n\x0b\f\r"


def _merged(state: Column, fresh: Column) -> Column:
    """State (text, problem) after one more section (target_id, section)."""
    text = state["text"]
    opens, closes = F.concat(F.lit(START + " "), fresh["target_id"], F.lit(" -->")), F.concat(F.lit(END + " "), fresh["target_id"], F.lit(" -->"))
    find = lambda mark, start: F.call_function("locate", mark, text, start)
    a, b = find(opens, F.lit(1)), find(closes, F.lit(1))
    inside = F.substr(text, a + F.char_length(opens), b - a - F.char_length(opens))
    problem = (
        F.when(F.contains(fresh["section"], F.lit(START)) | F.contains(fresh["section"], F.lit(END)), "reserved marker")
        .when(((a == 0) != (b == 0)) | (b < a), "half section")
        .when((a > 0) & ((find(opens, a + 1) > 0) | (find(closes, b + 1) > 0)), "repeated section")
        .when((a > 0) & (F.contains(inside, F.lit(START)) | F.contains(inside, F.lit(END))), "nested section")
    )
    block = F.concat(opens, F.lit("\n"), F.btrim(fresh["section"], F.lit(_BLANKS)), F.lit("\n"), closes)
    replaced = F.concat(F.substr(text, F.lit(1), a - 1), block, F.substr(text, b + F.char_length(closes)))
    added = F.concat(F.rtrim(text, F.lit(_BLANKS)), F.lit("\n\n"), block, F.lit("\n"))
    return F.struct(F.when(problem.isNotNull() | state["problem"].isNotNull(), text).when(a > 0, replaced).otherwise(added).alias("text"), F.coalesce(state["problem"], problem).alias("problem"))


def merge_sections(stored: DataFrame, fresh: DataFrame, title: str = "# Updates") -> DataFrame:
    """stored(run_id, report), fresh(run_id, target_id, seq, section) -> (run_id, report, problem) of every run of either.

    A fresh section takes the place of what stands between its target's markers in the stored text, or comes at the end; all else
    stays byte for byte. With half, repeated or nested markers of that target, or a marker in the section, the stored text
    stays as it is, and `problem` says why. A run without a stored text begins with the title. Runs of `stored` must be
    distinct; a run's fresh sections are few, one a target.
    """
    each = fresh.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "target_id", "section"))).alias("fresh"))
    both = stored.select("run_id", "report").join(each, "run_id", "full_outer")
    begin = F.struct(F.coalesce("report", F.lit(title)).alias("text"), F.lit(None).cast("string").alias("problem"))
    done = both.select("run_id", "report", F.aggregate(F.coalesce("fresh", F.array().cast("array<struct<seq:bigint,target_id:string,section:string>>")), begin, _merged).alias("s"))
    return done.select("run_id", F.when(F.col("s.problem").isNull(), F.col("s.text")).otherwise(F.col("report")).alias("report"), "s.problem")


def delivery_plan(reports: DataFrame, ledger: DataFrame) -> DataFrame:
    """(run_id, state): `undelivered`, `delivered`, `changed` after delivery, or `missing` though delivered."""
    both = reports.select("run_id", "sha256").join(ledger.select("run_id", F.col("sha256").alias("sent")), "run_id", "full_outer")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("sent").isNull(), "undelivered").when(F.col("sent") == F.col("sha256"), "delivered").otherwise("changed")
    return both.select("run_id", state.alias("state"))


def completed_runs(reports: DataFrame, pending: DataFrame) -> DataFrame:
    """Runs with a report and no open review left."""
    return reports.select("run_id").distinct().join(pending.select("run_id"), "run_id", "left_anti")
