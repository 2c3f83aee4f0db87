"""Quality rules as a ledger of bit masks: every rule is evaluated once, policies and ablations only read the masks.

All of it is built-in expressions over a document's own row: no shuffle but the ablation's sums over distinct masks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import fresh

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENDS = ".!?…"
#: What evaluate() measures, all of it whole numbers, so that a rule is exact.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_ends", "n_alpha_words")


@dataclass(frozen=True)
class Rule:
    """A rule's bit in the ledger, for good: a number is never used for another rule. `failed` is SQL over the measures."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "word_length", "word_chars < 3 * n_words OR word_chars > 10 * n_words"),
    Rule(3, "symbols", "10 * n_symbols > n_words"),
    Rule(4, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(5, "capitals", "10 * n_upper > 3 * word_chars"),
    Rule(6, "exclamations", "4 * n_marks > n_words"),
    Rule(7, "sentence_ends", "200 * n_ends < n_words"),
    Rule(8, "letters", "10 * n_alpha_words < 7 * n_words"),
)
#: Rules that a version of the policy asks for. Versions are only ever added, so that an old verdict can be computed again.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "word_length", "symbols", "repeated_lines"),
    "v2": tuple(r.name for r in RULES),
}


def mask(rules: Sequence[str], known: Sequence[Rule] = RULES) -> int:
    """The bits of the named rules; an unknown name is an error."""
    bits = {r.name: r.bit for r in known}
    if missing := [n for n in rules if n not in bits]:
        raise ValueError(f"no such rule: {', '.join(missing)}")
    return sum(1 << bits[n] for n in set(rules))


def _without(c: Column, characters: str) -> Column:
    return F.translate(c, characters, "")


def _repeated(words: Column) -> Column:
    """Words that lie in a window of three that the array holds twice or more.

    Windows are compared by 64-bit hashes in sorted order: equal ones stand side by side, so that no table of windows and
    no shuffle is needed (a text of a million words confuses two windows with a chance of 3 in 10^8). A word counts once,
    in however many such windows it lies.
    """
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("i")))

    def twice(a: Column) -> Column:
        h = lambda k: F.get(a, k)["h"]
        near = lambda s, k: (h(k - 1) == s["h"]) | (h(k + 1) == s["h"])
        return F.sort_array(F.transform(F.filter(a, lambda s, k: F.coalesce(near(s, k), F.lit(False))), lambda s: s["i"]))

    def covered(p: Column) -> Column:
        # Starts in order: each adds what reaches beyond the one before.
        step = lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["at"])).alias("n"), x.alias("at"))
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), step, lambda s: s["n"])

    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return F.when(F.size(words) > 3, let(let(F.sort_array(windows), twice), covered)).otherwise(0)


def measured(text: Column) -> Column:
    """A struct of MEASURES, long each, of a whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    bare = F.btrim(t, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\x09-\\x0D]+"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    found = lambda characters: F.char_length(t) - F.char_length(_without(t, characters))

    def of(s: Column) -> Column:
        w, ls = s["w"], s["l"]
        values = {
            "n_words": F.size(w),
            "word_chars": F.char_length(_without(t, BLANKS)),
            "n_symbols": found(SYMBOLS),
            "n_lines": F.size(ls),
            "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
            "n_repeat_words": _repeated(w),
            "n_upper": found(UPPER),
            "n_marks": found("!"),
            "n_ends": found(ENDS),
            "n_alpha_words": F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    return let(F.struct(words.alias("w"), lines.alias("l")), of)


def evaluate(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, failures_col: str = "failures") -> DataFrame:
    """The ledger: docs plus the MEASURES and `failures`, a long whose bit k is set if the rule of bit k fails.

    Each rule is evaluated once, over numbers measured in one pass over the whole text. Null and blank texts have no word
    and fail `few_words` alone; repeated rows and null ids keep their rows; columns of docs that clash with a measure are
    replaced by it, others stay; an empty table gives an empty one.
    """
    taken = {m.lower() for m in (*MEASURES, failures_col)}
    own = [c for c in docs.columns if c.lower() not in taken]
    m = fresh(own, "measured")
    rows = docs.select(*[F.col(f"`{c}`") for c in own], measured(F.col(f"`{text_col}`")).alias(m))
    rows = rows.select(*[F.col(f"`{c}`") for c in own], *[F.col(f"{m}.{k}").alias(k) for k in MEASURES])
    bits = [F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(0).cast("long") for r in rules]
    both = bits[0]
    for b in bits[1:]:
        both = both.bitwiseOR(b)
    return rows.withColumn(failures_col, both)


def fails(failures: Column, rules: int) -> Column:
    """Whether any rule of a mask fails."""
    return failures.bitwiseAND(F.lit(rules).cast("long")) != 0


def apply_policy(ledger: DataFrame, version: str, policies: Mapping[str, Sequence[str]] = POLICIES, kept_col: str = "kept") -> DataFrame:
    """The ledger plus `kept`: none of the policy's rules fails. No text is read again."""
    return ledger.withColumn(kept_col, ~fails(F.col("failures"), mask(policies[version])))


def _masks(ledger: DataFrame) -> DataFrame:
    """(failures, docs): documents of each mask. At most two to the number of rules rows, summed before the shuffle."""
    return ledger.groupBy("failures").agg(F.count("*").alias("docs"))


def policy_totals(ledger: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """(version, docs, kept, failed_any, failed_all): per policy; the last two are the bits of its rules that fail somewhere, and everywhere."""
    each = _masks(ledger).select("failures", "docs", F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.lit(mask(r)).cast("long").alias("mask")) for v, r in policies.items()])).alias("p"))
    hit = F.col("failures").bitwiseAND(F.col("p.mask"))
    return each.groupBy(F.col("p.version").alias("version")).agg(
        F.sum("docs").alias("docs"), F.sum(F.when(hit == 0, F.col("docs")).otherwise(0)).alias("kept"), F.bit_or(hit).alias("failed_any"), F.bit_and(hit).alias("failed_all")
    )


def ablations(ledger: DataFrame, version: str, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(rule, failed, failed_alone, kept_without): per rule of a policy, the documents that fail it, those that fail no other rule
    of the policy, and those that the policy would keep without it."""
    whole = mask(policies[version], rules)
    own = [r for r in rules if whole >> r.bit & 1]
    each = _masks(ledger).select(F.col("failures").bitwiseAND(F.lit(whole).cast("long")).alias("f"), "docs", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in own])).alias("r"))
    some = lambda when: F.sum(F.when(when, F.col("docs")).otherwise(0))
    bit = F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        some(F.col("f").bitwiseAND(bit) != 0).alias("failed"), some(F.col("f") == bit).alias("failed_alone"), some(F.col("f").bitwiseAND(F.bitwise_not(bit)) == 0).alias("kept_without")
    )
