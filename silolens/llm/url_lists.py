"""URL filters by a temporal list join.

Dated list entries (pattern, day, action) become validity intervals; an as-of
join evaluates each capture against the entries that were active on the day it
was fetched. A pattern is a host and covers its subdomains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silolens.llm.common import fresh, stored
from silolens.session import small


#: Scheme, user information up to the last @ of the authority, then a bracketed address or a name before the port.
HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:\[\]@]+)"


def host(url: str) -> Column:
    """Lower-case host of an address without the dot of the root; an address in brackets keeps them. Null if there is none."""
    found = F.regexp_replace(F.regexp_extract(F.col(f"`{url}`"), HOST_PATTERN, 1), "[.]$", "")
    return F.nullif(F.lower(found), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, since, until``: when each pattern is listed; an open end is null.

    ``entries`` are ``pattern, day, action`` with the actions add and remove. Of
    several entries of a pattern on one day a removal wins, so a pattern has one
    state a day and its window at most one row a day. Rows with a null are
    ignored, repeated ones change nothing; adding what is listed, or removing
    what is not, does not start or end anything.
    """
    states = entries.where("pattern IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    states = states.groupBy(F.lower("pattern").alias("pattern"), "day").agg(F.bool_and(F.col("action") == "add").alias("listed"))
    over = "OVER (PARTITION BY pattern ORDER BY day)"
    changes = states.withColumn("was", F.expr(f"lag(listed, 1, false) {over}")).where("listed <> was")
    return changes.withColumn("until", F.expr(f"lead(day) {over}")).where("listed").selectExpr("pattern", "day AS since", "until")


def active(visits: DataFrame, listed: DataFrame) -> DataFrame:
    """``host, day, pattern, since``: for each distinct visit the longest pattern active that day, if any.

    Intervals are laid out by month, visits meet those of their month: a host
    that holds a third of all visits spreads over the months it was seen in, and
    each day of it is one row. Parents of a host are looked up to the number of
    labels of the deepest pattern.
    """
    span = visits.agg(F.max("day")).first()[0]
    deepest = listed.agg(F.max(F.size(F.split("pattern", r"\.")))).first()[0]
    if span is None or deepest is None:
        return visits.selectExpr("host", "day", "host AS pattern", "day AS since").where("false")
    months = listed.where(F.col("since") <= F.lit(span)).withColumn(
        "month", F.explode(F.sequence(F.trunc("since", "month"), F.trunc(F.least(F.coalesce("until", F.lit(span)), F.lit(span)), "month"), F.expr("interval 1 month"))))
    labels = F.split("host", r"\.")
    parents = F.expr(f"transform(sequence(1, least(size(l), {deepest})), i -> array_join(slice(l, -i, i), '.'))")
    asked = visits.withColumn("l", labels).withColumn("pattern", F.explode(F.array_union(F.array("host"), parents))).drop("l").withColumn("month", F.trunc("day", "month"))
    met = asked.join(small(months), ["pattern", "month"]).where("day >= since AND (until IS NULL OR day < until)")
    best = met.groupBy("host", "day").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since")).alias("best"))
    return best.select("host", "day", "best.pattern", "best.since")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """``captures`` with ``host, blocked, pattern, listed_since``.

    An address without a host, or a capture without a day, is not blocked. Every
    row keeps its other columns; those four names must be free. Repeated rows
    are judged alike, an empty list blocks nothing, an empty table stays empty.
    """
    if {"host", "blocked", "pattern", "listed_since"} & {c.lower() for c in captures.columns}:
        raise ValueError("host, blocked, pattern and listed_since are names of the result")
    seen = captures.withColumn("host", host(url_col))
    visits = stored(seen.where(f"host IS NOT NULL AND `{day_col}` IS NOT NULL").select("host", F.to_date(f"`{day_col}`").alias("day")).distinct(), "visits")
    verdicts = stored(active(visits, stored(intervals(entries), "intervals")), "verdicts")
    key, day = fresh(seen, "verdict_host"), fresh(seen, "verdict_day")
    found = verdicts.selectExpr(f"host AS {key}", f"day AS {day}", "pattern", "since AS listed_since")
    met = seen.join(small(found), (F.col("host") == F.col(key)) & (F.to_date(f"`{day_col}`") == F.col(day)), "left").drop(key, day)
    return met.withColumn("blocked", F.col("pattern").isNotNull())


def keep_allowed(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """The rows of ``captures`` that are not blocked, with their own columns."""
    return judge(captures, entries, url_col, day_col).where("NOT blocked").select(*[F.col(f"`{c}`") for c in captures.columns])
