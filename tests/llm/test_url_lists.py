"""The temporal join against a day-by-day replay of the list."""

import datetime as dt
import random

import pytest

from silolens.llm import url_lists

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def entries(spark, rows):
    return spark.createDataFrame([(p, None if d is None else day(d), a) for p, d, a in rows], "pattern string, day date, action string")


def captures(spark, rows):
    return spark.createDataFrame([(i, u, None if d is None else day(d), "x") for i, (u, d) in enumerate(rows)], "page_id long, url string, fetched date, since string")


def replay(rows, host, when):
    """The longest pattern whose last change up to the day put it on the list."""
    active = {}
    for p in {r[0] for r in rows if r[0]}:
        days = {}
        for q, d, a in rows:
            if q == p and d is not None and d <= when and a in ("add", "remove"):
                days.setdefault(d, []).append(a)
        if days and "remove" not in days[max(days)]:
            active[p.lower()] = True
    names = [p for p in active if host == p or host.endswith("." + p)]
    return max(names, key=len, default=None)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_replay(spark, seed):
    rng = random.Random(seed)
    patterns = ["a.example.com", "example.com", "b.org", "x.b.org", "Net.net"]
    listed = [(rng.choice(patterns), rng.randint(0, 120), rng.choice(["add", "remove"])) for _ in range(60)]
    hosts = ["a.example.com", "z.a.example.com", "example.com", "notexample.com", "b.org", "y.x.b.org", "net.net", "other.net"]
    seen = [(f"https://{rng.choice(hosts)}/p?q=1", rng.randint(-5, 130)) for _ in range(200)]
    got = {r.page_id: r for r in url_lists.judge(captures(spark, seen), entries(spark, listed)).collect()}
    for i, (url, when) in enumerate(seen):
        want = replay(listed, url.split("/")[2], when)
        assert (got[i].blocked, got[i].pattern) == (want is not None, want), (url, when)
        assert want is None or got[i].listed_since <= day(when)


def test_deep_hosts(spark):
    parent = ".".join(f"l{i}" for i in range(11)) + ".org"
    deep = ".".join(f"d{i}" for i in range(115)) + "." + parent
    found = url_lists.judge(captures(spark, [(f"http://{deep}/", 3), (f"http://x.{parent}/", 3), (f"http://{parent[1:]}/", 3)]), entries(spark, [(parent, 1, "add")]))
    assert [r.pattern for r in found.orderBy("page_id").collect()] == [parent, parent, None]


def test_hosts(spark):
    urls = ["http://[2001:DB8::1]:80/", "http://u@[::1]/x", "http://example.com./", "http://a@b@example.com/p@q", "http://h.com:80?x=@y", "http://[::1", "HTTP://User:pw@Example.COM:80/x", "https://h", "ftp://h?x", "no address", "", None, "//h/x", "https:///x"]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in frame.select(url_lists.host("url")).collect()] == [
        "[2001:db8::1]", "[::1]", "example.com", "example.com", "h.com", None, "example.com", "h", "h", None, None, None, None, None]


def test_odd_and_empty_tables(spark):
    listed = entries(spark, [("h.com", 1, "add"), ("h.com", 1, "add"), (None, 1, "add"), ("i.com", None, "add"), ("j.com", 1, "other"), ("k.com", 2, "remove")])
    seen = captures(spark, [("http://h.com/", 5), ("http://h.com/", 5), ("http://h.com/", None), (None, 5), ("", 5), ("http://k.com/" + "x" * 100000, 5), ("http://h.com/", 0)])
    out = url_lists.judge(seen, listed)
    assert [r.blocked for r in out.orderBy("page_id").collect()] == [True, True, False, False, False, False, False]
    assert url_lists.keep_allowed(seen, listed).schema == seen.schema and url_lists.keep_allowed(seen, listed).count() == 5
    assert url_lists.judge(seen, listed.where("false")).where("blocked").count() == 0
    assert url_lists.judge(seen.where("false"), listed).count() == 0
    with pytest.raises(ValueError):
        url_lists.judge(seen.withColumnRenamed("since", "host"), listed)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
