"""Quality rules as learned decision lists.

Per-document statistics are built-in column functions. Sequential covering
learns ordered rules from labelled statistics: each rule grows one threshold
at a time by information gain, is pruned on held-out rows, and is kept only
while it is precise there. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silolens.llm.common import fresh
from silolens.session import small

#: Most labelled rows that a list is fitted on, taken in order of a hash of the id.
FIT_ROWS = 20_000
#: A rule stays while it covers so many bad rows and so large a part of what it covers is bad, in both halves.
LEAST_COVER, LEAST_PRECISION = 8, 0.95
MOST_RULES, MOST_CONDITIONS, CUTS = 12, 4, 64

LEAST_WORDS, MOST_REPEATED = 10, 20
SPACES = r"[\\x20\\x09-\\x0D]+"
#: What a condition may test, from the statistics' columns.
FEATURES = {
    "words": "cast(n_words AS double)",
    "word_length": "word_chars / n_words",
    "symbols": "n_symbols / n_words",
    "repeated_lines": "cast(n_dup_lines AS double)",
    "repeated_words": "n_repeat_words / n_words",
}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with the columns of ``STATISTICS`` and ``base_failed``; null text has no words.

    Columns of ``rows`` with those names are replaced.
    """
    keep = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in (*STATISTICS, "base_failed") and c != text_col]
    had = {c.lower() for c in rows.columns}
    w, g2, g5, t = (_free(had, n) for n in ("words", "pairs", "fives", "body"))
    lines = f"filter(split({t}, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    step = rows.select(*keep, F.col(text_col), F.coalesce(F.col(text_col), F.lit("")).alias(t))
    step = step.withColumn(w, F.expr(f"array_remove(split({t}, '{SPACES}', -1), '')"))
    step = step.selectExpr(
        *[f"`{c}`" for c in step.columns if c not in (w, t)], f"cast(size({w}) AS long) AS n_words", f"cast(char_length(array_join({w}, '')) AS long) AS word_chars",
        f"cast(regexp_count({t}, '[#*$%&|<>]') AS long) AS n_symbols",
        f"CASE WHEN locate('\\n', {t}) = 0 THEN 0L ELSE aggregate(array({lines}), 0L, (z, l) -> cast(size(l) - size(array_distinct(l)) AS long)) END AS n_dup_lines",
        f"transform({w}, x -> xxhash64(x)) AS {w}")
    step = step.withColumn(g2, F.expr(f"zip_with(slice({w}, 1, greatest(size({w}) - 1, 0)), slice({w}, 2, greatest(size({w}) - 1, 0)), (a, b) -> xxhash64(a, b))"))
    # five words: the pair at i, the pair at i + 2 and the word at i + 4
    four = f"zip_with(slice({g2}, 1, size({w}) - 4), slice({g2}, 3, size({w}) - 4), (a, b) -> xxhash64(a, b))"
    step = step.withColumn(g5, F.expr(f"CASE WHEN size({w}) > 5 THEN zip_with({four}, slice({w}, 5, size({w}) - 4), (a, b) -> xxhash64(a, b)) ELSE array() END"))
    order = f"array_sort(zip_with({g5}, sequence(0, size({g5}) - 1), (g, i) -> struct(g, i)))"
    twice = (
        f"aggregate(array({order}), array(0), (z, s) -> filter(transform(sequence(0, size(s) - 1), k -> "
        "CASE WHEN (k > 0 AND s[k].g = s[greatest(k - 1, 0)].g) OR (k < size(s) - 1 AND s[k].g = s[least(k + 1, size(s) - 1)].g) THEN s[k].i END), i -> i IS NOT NULL))"
    )
    covered = f"aggregate(array_sort({twice}), struct(-5 AS last, 0L AS total), (z, p) -> struct(p AS last, z.total + least(5, p - z.last) AS total), z -> z.total)"
    repeated = f"CASE WHEN size(array_distinct({g5})) = size({g5}) THEN 0L ELSE {covered} END"
    # a generator of one row: conditions on the statistics are tested above it and never evaluate them again
    made = F.inline(F.array(F.struct(*[F.col(c) for c in STATISTICS[:-1]], F.expr(repeated).alias("n_repeat_words"))))
    return step.select(*keep, F.col(text_col), made).withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"))


def _free(taken: set[str], name: str) -> str:
    while name in taken:
        name = f"_{name}"
    return name


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.value!r}D"

    def holds(self, row: Sequence[float]) -> bool:
        return (row[_PLACE[self.feature]] > self.value) == self.above


_PLACE = {f: i for i, f in enumerate(FEATURES)}
Rule = tuple[Condition, ...]
Labelled = list[tuple[tuple[float, ...], bool]]


def _matches(rule: Rule, rows: Labelled) -> Labelled:
    return [r for r in rows if all(c.holds(r[0]) for c in rule)]


def _precision(rule: Rule, rows: Labelled) -> tuple[int, float]:
    """Bad rows covered, and the part of the covered that is bad."""
    met = _matches(rule, rows)
    bad = sum(b for _, b in met)
    return bad, bad / len(met) if met else 0.0


def _best_condition(rows: Labelled) -> tuple[float, Condition] | None:
    """The threshold with the most information gain; cut points are quantiles of the rows still covered."""
    bad = sum(b for _, b in rows)
    if bad in (0, len(rows)):
        return None
    start = math.log2(bad / len(rows))
    best = None
    for feature, place in _PLACE.items():
        values = sorted(r[place] for r, _ in rows)
        # half-way between neighbouring values, so that a cut leaves room on both sides
        distinct = sorted({values[i * (len(values) - 1) // CUTS] for i in range(CUTS + 1)} | {values[-1]})
        cuts = [(a + _next(values, a)) / 2 for a in distinct[:-1]]
        counts = [[0, 0] for _ in range(len(cuts) + 1)]
        for r, b in rows:
            counts[_bin(cuts, r[place])][b] += 1
        low_good = low_bad = 0
        for cut, (good_here, bad_here) in zip(cuts, counts):
            low_good, low_bad = low_good + good_here, low_bad + bad_here
            for above, p, n in ((False, low_bad, low_good), (True, bad - low_bad, len(rows) - bad - low_good)):
                if p:
                    gain = p * (math.log2(p / (p + n)) - start)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, Condition(feature, above, cut))
    return best


def _next(values: list[float], a: float) -> float:
    return values[min(bisect_right(values, a), len(values) - 1)]


def _bin(cuts: list[float], value: float) -> int:
    """Cuts below the value: a row equal to a cut lies under it."""
    lo, hi = 0, len(cuts)
    while lo < hi:
        mid = (lo + hi) // 2
        if cuts[mid] < value:
            lo = mid + 1
        else:
            hi = mid
    return lo


def learn(grow: Labelled, prune: Labelled) -> list[Rule]:
    """Rules for bad rows in order, each learned on what the earlier ones leave."""
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        rule: Rule = ()
        covered = grow
        while len(rule) < MOST_CONDITIONS and (found := _best_condition(covered)) and found[0] > 1e-6:
            rule += (found[1],)
            covered = _matches(rule, grow)
        if not rule:
            break

        def worth(r: Rule) -> float:
            met = _matches(r, prune)
            bad = sum(b for _, b in met)
            return (2 * bad - len(met)) / len(met) if met else -1.0

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)  # on ties the shorter rule
        sides = [_precision(rule, rows) for rows in (grow, prune)]
        if any(n < LEAST_COVER or p < LEAST_PRECISION for n, p in sides):
            break
        rules.append(rule)
        grow, prune = ([r for r in rows if not all(c.holds(r[0]) for c in rule)] for rows in (grow, prune))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered expression: false at the first rule that holds, true if none does."""
    whens = " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN false" for rule in rules)
    return F.expr(f"CASE WHEN base_failed THEN false {whens} ELSE true END")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Learn a list from at most ``FIT_ROWS`` labelled rows that pass the base rules (label 0: bad).

    Rows without an id or label are left out, as are labels without a document.
    Too few labelled rows, or only one class, give an empty list: then the base
    rules decide alone. Three quarters of the rows grow rules, one prunes them.
    """
    order = F.xxhash64("_id")
    chosen = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label")).where("_id IS NOT NULL AND _label IS NOT NULL")
    chosen = chosen.orderBy(order, "_id", "_label").limit(FIT_ROWS)
    slim = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).alias("text"))
    met = slim.join(small(chosen), F.col("_doc") == F.col("_id")).select("_id", "_label", "text")
    rows = statistics(met).where("NOT base_failed").selectExpr("_id", "_label", *[f"{e} AS {f}" for f, e in FEATURES.items()])
    rows = rows.orderBy(order, "_id", "_label", *FEATURES).limit(FIT_ROWS).collect()
    data = [(tuple(r[f] for f in FEATURES), r["_label"] == 0) for r in rows]
    return learn([r for i, r in enumerate(data) if i % 4], [r for i, r in enumerate(data) if i % 4 == 0])


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed`` and ``kept``: a projection, row by row.

    Null and empty texts have no words and fail the base rules. Repeated rows
    are judged alike; an empty table stays empty.
    """
    return statistics(docs, text_col).withColumn("kept", verdict(rules))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only, whatever those are called."""
    row = fresh(docs, "row")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(text_col).alias("text"))
    return judge(held, rules).where("kept").select(f"{row}.*")
