"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations are bit operations.

``ledger`` stores per document the measurements and one ``long`` whose bit *k* says that rule *k* failed.
``apply_policy`` turns the bits into a verdict for any versioned policy without touching the texts again, and
``ablation`` counts, from the distinct masks alone, what each rule of a policy removes by itself.

Only DataFrame functions are used. Every expression looks at one row, so there is no shuffle but that of the
ablation counts (at most one row per distinct mask and task).

Defined cases: a NULL or blank text has no words and fails ``few_words``; repeated rows and repeated or NULL ids are
rows of their own; no rows give no rows; columns of the input that share a name with a measurement are not read and
do not appear in the result (only the id and the text are taken).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowndate.llm.frames import BLANKS, let, words_of

WINDOW = 8


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a ``window``-word window found twice or more in the text, the first included.

    Windows are compared by a 64-bit hash first; only texts with two equal hashes sort them, and neighbours with
    equal hashes are then compared word by word.
    """

    def starts(hashes: Column) -> Column:
        return let(
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda by_hash: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            by_hash,
                            lambda x, k: F.struct(
                                x["i"].alias("i"),
                                (same(x, F.get(by_hash, k - 1)) | same(x, F.get(by_hash, k + 1))).alias("twice"),
                            ),
                        ),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(
            F.when(
                x["h"] == y["h"],
                F.slice(words, x["i"] + 1, window) == F.slice(words, y["i"] + 1, window),
            ),
            F.lit(False),
        )

    def covered(at: Column) -> Column:
        """Length of the union of the intervals [p, p + window) for sorted starts p."""
        return F.aggregate(
            F.transform(at, lambda p, k: F.least(F.coalesce(F.get(at, k + 1) - p, F.lit(window)), F.lit(window))),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        )

    hashes = F.when(
        F.size(words) > window,
        F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.xxhash64(F.slice(words, i, window))),
    )
    return F.coalesce(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(starts(h), covered))),
        F.lit(0).cast("long"),
    )


@dataclass(frozen=True)
class Rule:
    """``fails`` gets a function that turns the name of a measurement into its Column."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: In bit order; a rule keeps its place for ever, new rules go to the end.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda m: m("n_words") < 20),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("repeated_lines", lambda m: 10 * m("n_dup_lines") > 3 * m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
    Rule("shouting", lambda m: 2 * m("n_upper") > m("n_letters")),
    Rule("exclamations", lambda m: 2 * m("n_exclaims") > m("n_words")),
    Rule("no_letters", lambda m: 2 * m("n_letters") < m("word_chars")),
)

#: Versioned policies: the rules that reject.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "gopher-1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length"),
    "full-1": tuple(r.name for r in RULES),
}


def mask_of(names: tuple[str, ...]) -> int:
    bits = {r.name: 1 << k for k, r in enumerate(RULES)}
    return sum({bits[n] for n in names})


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, measurements (long) and ``failed_bits``."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    split = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).select(
        F.col(id_col),
        text.alias("__text"),
        words_of(F.col("__text")).alias("__words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANKS}]")).alias("__lines"),
    )
    words, lines, text = F.col("__words"), F.col("__lines"), F.col("__text")
    letters = F.regexp_replace(text, "[^\\p{L}]+", "")
    measures = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
        "n_letters": F.length(letters),
        "n_upper": F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")),
        "n_exclaims": F.length(F.regexp_replace(text, "[^!]+", "")),
    }
    measured = split.select(F.col(id_col), *[m.cast("long").alias(name) for name, m in measures.items()])
    bits = [
        F.when(F.coalesce(rule.fails(F.col), F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        for k, rule in enumerate(RULES)
    ]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failed_bits", total)


def apply_policy(ledger_rows: DataFrame, policy: str) -> Column:
    """True where no rule of the policy failed."""
    return ledger_rows["failed_bits"].bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablation(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: rows it fails, rows that only it fails, and rows kept without it.

    Rows are first counted per distinct mask (at most 2^rules groups, summed on the map side).
    """
    mask = F.lit(mask_of(POLICIES[policy])).cast("long")
    masks = ledger_rows.groupBy(F.col("failed_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit"))
        for k, r in enumerate(RULES) if r.name in POLICIES[policy]
    ])
    each = masks.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    count_if = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        count_if(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count_if(F.col("bits") == F.col("bit")).alias("n_only_here"),
        count_if(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )
