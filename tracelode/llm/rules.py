"""Operator 8: quality rules by weak supervision, in DataFrame and SQL functions only.

Each rule votes good or bad, or abstains, on numbers of one text.  Votes are tallied by pattern (at
most 3 to the number of rules, whatever the corpus), and expectation-maximisation over that small
table estimates how often each rule is right on good and on bad texts.  A document is kept if its
posterior probability of being good reaches one half and it does not fail the base rules.

Repeated windows are found inside the row: where the 64-bit hashes of a text's 3-word windows are not all
distinct, they are sorted with their places, equal neighbours are repeats, and the words that they cover
are counted.

Scale: one pass over the texts without any shuffle; the numbers (a few longs a document) are written
once to the shared folder, because both the tally and the verdict read them.

Defined results: null and empty texts have no words and fail the base rules; repeated rows repeat;
an empty table gives no rows; extra columns are left behind.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import narrow, written

ITERATIONS = 15
#: A rule's estimated accuracy stays in this range: better than chance, never certain.
ACCURACY = (0.55, 0.98)

#: Rule: (name, condition of a bad vote, condition of a good vote); neither: it abstains.
RULES = (
    ("length", "n_words < 50", "n_words >= 100"),
    ("word_length", "n_words > 0 AND (word_chars < 2.5 * n_words OR word_chars > 14 * n_words)", "word_chars BETWEEN 3 * n_words AND 11 * n_words AND n_words > 0"),
    ("symbols", "n_symbols > 0.3 * n_words", "n_symbols < 0.05 * n_words"),
    ("same_lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.05 * n_lines AND n_lines > 0"),
    ("repeats", "n_repeat_words > 0.4 * n_words", "n_repeat_words <= 0.15 * n_words AND n_words > 0"),
    ("capitals", "n_capitals > 0.4 * word_chars", "n_capitals < 0.15 * word_chars"),
    ("same_words", "n_distinct_words < 0.2 * n_words AND n_words >= 50 AND n_words < 2000", "n_distinct_words > 0.4 * n_words"),
    ("marks", "n_bars + n_bangs > 0.2 * n_words", "n_bars + n_bangs < 0.05 * n_words"),
)

_SPACES = "[\\\\x20\\\\x09-\\\\x0D]+"
_WINDOWS = "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
_SORTED = "sort_array(transform(g, (h, i) -> struct(h AS h, i AS i)))"
_STARTS = "transform(filter(s, (x, k) -> get(s, k - 1).h <=> x.h OR get(s, k + 1).h <=> x.h), x -> x.i)"
_COVERED = "CAST(size(array_distinct(concat(d, transform(d, x -> x + 1), transform(d, x -> x + 2)))) AS LONG)"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once for each row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _measures() -> str:
    """One struct of all numbers of a text, from its words ``w`` and its non-empty lines ``l``."""
    counted = _let("s", _SORTED, _let("d", _STARTS, _COVERED))
    repeats = f"IF(size(w) < 4, 0L, {_let('g', _WINDOWS, f'IF(size(array_distinct(g)) = size(g), 0L, {counted})')})"
    return f"""named_struct(
        'n_words', CAST(size(w) AS LONG),
        'word_chars', CAST(char_length(array_join(w, '')) AS LONG),
        'n_repeat_words', {repeats},
        'n_distinct_words', CAST(size(array_distinct(w)) AS LONG))"""


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, numbers that the rules use) of each whole text."""
    words = f"filter(split(text, '{_SPACES}'), x -> x <> '')"
    lines = "filter(split(text, '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    return (
        narrow(docs, id_col, text_col)
        .selectExpr(
            "doc_id",
            f"{_let('w', words, _measures())} AS m",
            f"{_let('l', lines, 'named_struct("n_lines", CAST(size(l) AS LONG), "n_dup_lines", CAST(size(l) - size(array_distinct(l)) AS LONG))')} AS k",
            "CAST(regexp_count(text, '[#*$%&|<>]') AS LONG) AS n_symbols",
            "CAST(regexp_count(text, '[A-Z]') AS LONG) AS n_capitals",
            "CAST(regexp_count(text, '[|]') AS LONG) AS n_bars",
            "CAST(regexp_count(text, '!') AS LONG) AS n_bangs",
        )
        .select("doc_id", "m.*", "k.*", "n_symbols", "n_capitals", "n_bars", "n_bangs")
    )


def votes() -> list[Column]:
    """A column for each rule: 1 good, -1 bad, 0 abstains."""
    return [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END").alias(f"vote_{name}") for name, bad, good in RULES]


@dataclass
class Accuracies:
    """Share of good documents, and of each rule the share of right votes on good and on bad ones."""

    good: float
    on_good: list[float]
    on_bad: list[float]

    def posterior(self) -> Column:
        """P(good) by the votes, as a column.

        The numbers stand in one array literal, so every step of the estimation runs the same compiled code.
        """
        k, numbers = len(RULES), [math.log(self.good / (1 - self.good))]
        numbers += [math.log(a / (1 - b)) for a, b in zip(self.on_good, self.on_bad)]
        numbers += [math.log((1 - a) / b) for a, b in zip(self.on_good, self.on_bad)]
        weights = F.array(*map(F.lit, numbers))
        z = weights[0]
        for i, (name, _, _) in enumerate(RULES):
            vote = F.col(f"vote_{name}")
            z = z + F.when(vote == 1, weights[1 + i]).when(vote == -1, weights[1 + k + i]).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def estimate(patterns: DataFrame, iterations: int = ITERATIONS) -> Accuracies:
    """Expectation-maximisation on (vote columns, n): each step is one aggregate of the pattern table.

    Without any document the starting values stay.
    """
    names = [f"vote_{name}" for name, _, _ in RULES]
    low, high = ACCURACY
    model = Accuracies(0.8, [0.8] * len(names), [0.8] * len(names))
    for _ in range(iterations):
        p = model.posterior()
        n = F.col("n")
        sums = [F.sum(n * p).alias("good"), F.sum(n).alias("all")]
        for k, v in enumerate(names):
            sums += [
                F.sum(F.when(F.col(v) == 1, n * p)).alias(f"gg{k}"),
                F.sum(F.when(F.col(v) != 0, n * p)).alias(f"g{k}"),
                F.sum(F.when(F.col(v) == -1, n * (1 - p))).alias(f"bb{k}"),
                F.sum(F.when(F.col(v) != 0, n * (1 - p))).alias(f"b{k}"),
            ]
        row = patterns.agg(*sums).first()
        if not row["all"]:
            return model

        def share(x: float | None, y: float | None) -> float:
            return min(max(((x or 0.0) + 8.0) / ((y or 0.0) + 10.0), low), high)  # 10 votes of 0.8 stand behind each rule

        before = model
        model = Accuracies(
            min(max(row["good"] / row["all"], 0.05), 0.95),
            [share(row[f"gg{k}"], row[f"g{k}"]) for k in range(len(names))],
            [share(row[f"bb{k}"], row[f"b{k}"]) for k in range(len(names))],
        )
        if max(abs(x - y) for x, y in zip([model.good, *model.on_good, *model.on_bad], [before.good, *before.on_good, *before.on_bad])) < 1e-4:
            break
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbers, votes, ``quality_probability``, ``base_failed`` and ``kept`` of each document."""
    numbers = written(measures(docs, id_col, text_col), "rules-numbers")
    voted = numbers.select("*", *votes())
    patterns = written(voted.groupBy(*[f"vote_{name}" for name, _, _ in RULES]).agg(F.count("*").alias("n")), "rules-patterns")
    model = estimate(patterns)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("quality_probability", model.posterior()).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality_probability") >= 0.5))
