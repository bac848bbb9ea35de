"""Quality rules with a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule, so a policy, a versioned set of rules, is a mask applied to the stored bits, and
an ablation (what would be kept without a rule) is a sum over the distinct bit patterns. No
row is shuffled to evaluate the rules; ablations shuffle one row per pattern and task.

Defined cases: null and empty texts have no words and fail the rule on few words only. Rules
that compare with a count never divide. Repeated rows and null ids keep their rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import WORD, let, words

WINDOW = 5

# Rules by bit: a document fails if the condition over its measurements holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "shouting": "2 * n_upper > word_chars",
}
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, Sequence[str]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}


def mask(rules: Sequence[str]) -> int:
    places = list(RULES)
    return sum(1 << places.index(r) for r in rules)


def _repeat_words(parts: Column) -> Column:
    """Words inside windows that occur twice or more; equal windows are equal word by word."""
    last = F.greatest(F.size(parts) - WINDOW, F.lit(0))
    windows = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(parts, i + 1, WINDOW), " ")
    )

    def places(found: Column) -> Column:
        ordered = F.sort_array(
            F.transform(found, lambda w, i: F.struct(w.alias("window"), i.alias("at")))
        )

        def twice(rows: Column) -> Column:
            def same(k: Column) -> Column:
                return F.get(rows, k)["window"] == F.get(rows, k + 1)["window"]

            repeated = F.filter(
                F.transform(
                    rows,
                    lambda r, k: F.when(
                        F.coalesce(same(k), F.lit(False)) | F.coalesce(same(k - 1), F.lit(False)),
                        r["at"],
                    ),
                ),
                lambda at: at.isNotNull(),
            )
            return F.sort_array(repeated)

        return let(ordered, twice)

    def covered(at: Column) -> Column:
        state = F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            at,
            state,
            lambda s, x: F.struct(
                (s["words"] + F.least(F.lit(WINDOW), x - s["last"])).alias("words"),
                x.alias("last"),
            ),
            lambda s: s["words"],
        )

    def count(found: Column) -> Column:
        distinct = F.size(F.array_distinct(found)) == F.size(found)
        return F.when(distinct, 0).otherwise(covered(places(found)))

    return F.when(F.size(parts) <= WINDOW, 0).otherwise(let(windows, count))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_upper``, which replace columns of those names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    spare = "_words"
    while spare in docs.columns:
        spare += "_"
    cut = docs.withColumn(spare, words(F.col("text")))
    parts = F.col(spare)
    measures = {
        "n_words": F.size(parts),
        "word_chars": F.length(F.array_join(parts, "")),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        "n_lines": let(lines, F.size),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": let(parts, _repeat_words),
        "n_upper": F.length(F.regexp_replace(text, r"[^A-Z]+", "")),
    }
    return cut.withColumns({k: v.cast("bigint") for k, v in measures.items()}).drop(spare)


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with measurements and ``failures``, bit i set if rule i fails."""
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(0).cast("bigint"))
    return measured(docs).withColumn("failures", bits)


def keeps(policy: Sequence[str]) -> Column:
    """Does a ledger row pass every rule of the policy?"""
    return F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0


def ablations(
    rows: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES
) -> DataFrame:
    """Per policy and rule: documents, those kept, failed by the rule, kept without the rule.

    Counts come from the distinct bit patterns, of which there are at most 2^rules.
    """
    patterns = rows.groupBy("failures").count()
    cases = [
        F.struct(
            F.lit(name).alias("policy"),
            F.lit(rule).alias("rule"),
            F.lit(mask(chosen)).cast("bigint").alias("all"),
            F.lit(mask([rule])).cast("bigint").alias("own"),
        )
        for name, chosen in policies.items()
        for rule in chosen
    ]
    failed = F.col("failures").bitwiseAND(F.col("all"))
    others = failed.bitwiseAND(F.bitwise_not(F.col("own")))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("count")).otherwise(0))

    return (
        patterns.select("failures", "count", F.inline(F.array(*cases)))
        .groupBy("policy", "rule")
        .agg(
            F.sum("count").alias("n_docs"),
            total(failed == 0).alias("n_kept"),
            total(failed.bitwiseAND(F.col("own")) != 0).alias("n_failed"),
            total(others == 0).alias("n_kept_without"),
        )
    )


def quality_digest(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """One row per document: measurements, the base verdict and the policy's verdict."""
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~keeps(BASE)).alias("base_failed"),
        keeps(sorted({*BASE, *POLICIES[policy]})).alias("kept"),
        "failures",
    )
