"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a Boolean column that is true when a row fails. A small sample tells what
each rule costs (seconds to evaluate it) and how often it rejects; rules run in the order
of rejections per second inside one CASE, which Spark leaves at the first hit. The order
decides only how much is computed, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import trimmed, words

#: Fixed value: the symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 400
#: Up to so many repeated windows are looked up one by one; more are found by a sort.
FEW = 64


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def _bind(value: Column, use) -> Column:
    """Evaluate `value` once and hand it to `use` (a lambda variable is not recomputed)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _window_hashes(ws: Column) -> Column:
    n = F.size(ws)
    windows = F.arrays_zip(
        F.slice(ws, 1, n - 2).alias("a"), F.slice(ws, 2, n - 2).alias("b"), F.slice(ws, 3, n - 2).alias("c")
    )
    return F.when(n > 3, F.transform(windows, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<long>"))


def _covered(starts: Column) -> Column:
    """Words under windows at these ordered starts: three each, less what two share."""
    shared = F.transform(
        starts, lambda p, i: F.greatest(F.lit(0), F.coalesce(p + 3 - F.get(starts, i + 1), F.lit(0)))
    )
    return (3 * F.size(starts) - F.aggregate(shared, F.lit(0), lambda a, x: a + x)).cast("long")


def _repeated_starts(hashes: Column, twice: Column) -> Column:
    """Starts of the windows whose hash is in `twice`, in order."""
    looked_up = F.array_compact(
        F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i))
    )

    def neighbours(ordered: Column) -> Column:
        again = F.filter(
            ordered,
            lambda x, i: F.coalesce(x["h"] == F.get(ordered, i - 1)["h"], F.lit(False))
            | F.coalesce(x["h"] == F.get(ordered, i + 1)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(again, lambda x: x["p"]))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(twice) <= FEW, looked_up).otherwise(_bind(pairs, neighbours))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Null texts count as empty. A column of one of these names in the input is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(trimmed(x)) > 0)
    measured = docs.withColumns(
        {
            "_words": words(body),
            "n_symbols": F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_dup_lines": _bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        }
    )
    # One projection after the other: each array is made once, in generated code.
    measured = measured.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "_hashes": _window_hashes(F.col("_words")),
        }
    ).withColumn("_ordered", F.sort_array("_hashes"))
    twice = F.filter("_ordered", lambda h, i: F.coalesce(h == F.get(F.col("_ordered"), i - 1), F.lit(False)))
    repeats = _bind(
        twice,
        lambda t: F.when(F.size(t) == 0, F.lit(0).cast("long")).otherwise(
            _bind(_repeated_starts(F.col("_hashes"), t), _covered)
        ),
    )
    return measured.withColumn("n_repeat_words", repeats).drop("_words", "_hashes", "_ordered")


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)


def default_rules(text: str = "text") -> list[Rule]:
    """Rules on top of the base ones, over the measured columns and the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.col("n_words")
    return [
        Rule("short_words", F.col("word_chars") < 2 * n),
        Rule("long_words", F.col("word_chars") > 15 * n),
        Rule("symbols", 100 * F.col("n_symbols") > 10 * n),
        Rule("repeated_lines", 2 * F.col("n_dup_lines") > F.size(F.split(body, "\n"))),
        Rule("digits", 10 * F.regexp_count(body, F.lit("[0-9]")) > 3 * F.col("word_chars")),
        Rule("ellipses", 10 * F.regexp_count(body, F.lit(r"\.\.\.")) > 3 * n),
    ]


def order_rules(sample: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on at most `rows` rows, best first.

    An empty sample leaves the given order.
    """
    few = sample.limit(rows).cache()
    try:
        total = few.count()
        if not total:
            return rules
        gain = []
        for k, rule in enumerate(rules):
            started = time.perf_counter()
            rejected = few.agg(F.count_if(F.coalesce(rule.fails, F.lit(False)))).first()[0]
            seconds = max(time.perf_counter() - started, 1e-4)
            gain.append((-rejected / total / seconds, k, rule))
        return [rule for _, _, rule in sorted(gain, key=lambda x: x[:2])]
    finally:
        few.unpersist()


def cascade(rules: list[Rule], first: Column) -> Column:
    """False where `first` or any rule fails; later rules are not evaluated after a hit."""
    verdict = F.when(first, F.lit(False))
    for rule in rules:
        verdict = verdict.when(F.coalesce(rule.fails, F.lit(False)), F.lit(False))
    return verdict.otherwise(F.lit(True))


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The documents with their measures, `base_failed` and `kept`.

    Null text: no words, so it fails. Empty table: empty result. Repeated rows and ties:
    each row is judged alone. Other columns pass through; columns of the result's names
    are replaced.
    """
    measured = measures(docs, text)
    ordered = order_rules(measured, rules if rules is not None else default_rules(text))
    return measured.withColumn("base_failed", base_failed()).withColumn(
        "kept", cascade(ordered, F.col("base_failed"))
    )
