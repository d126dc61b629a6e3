"""Secret scan against the stated patterns, and the verdicts of owners."""

import random
import re

from silolens.llm import credentials
from tests.llm.helpers import docs, odd_docs

LIVE = "Ab3dE6gH9jK2mN5pQ8sT"
COPIED = "wJalrXUtnFEMI0K7MDENGbPx"
HEXES = "deadbeef0123456789abcdef01234567"


def plain(text):
    """The stated patterns, written out: leftmost matches, failing ones dropped."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


TEXTS = [
    f"é password = \"{LIVE}\" and again token: {LIVE}", f"api_key='{COPIED}'", f"x APIKEY:{COPIED} y", f"Secret={COPIED}", "token=short", "token=secret: abcdefghij",
    "AKIAABCDEFGHIJKL12 AKIAAKIASHORT AKIA0", HEXES + "g" + HEXES[:31], f"passwd  ==  {HEXES}", "toKen=abcdefghijk ſecret=abcdefghijk", "", None, "password = aaaaaaaaaaaaaaaaaaaa",
    "token = \"" + HEXES, "PASSWORD:\tno", "secret" * 50 + "=" + "z" * 5000,
]


def frame(spark):
    return docs(spark, TEXTS)


def test_base_spans(spark):
    got = {r.doc_id: r for r in credentials.scan(frame(spark)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert [(s.start, s.kind, s.stop) for s in got[i].base] == plain(text)


def test_owners_decide(spark):
    got = {r.doc_id: r for r in credentials.scan(frame(spark)).collect()}
    live = [TEXTS[0][s.start : s.stop] for s in got[0].live]
    assert live == [LIVE, LIVE] and got[0].n_live == 2
    assert [(got[i].n_copied, got[i].n_live) for i in (1, 2)] == [(1, 0)] * 2
    same = docs(spark, [f"password = {COPIED}"] * 6)  # three named owners and the missing one
    assert {(r.n_copied, r.n_live) for r in credentials.scan(same).collect()} == {(1, 0)}
    weak = credentials.scan(docs(spark, ["password = aaaaaaaaaaaaaaaaaaaa"])).first()
    assert (weak.n_live, weak.n_unclear, len(weak.base)) == (0, 1, 1)


def test_redaction_masks_live_values_only(spark):
    frame = docs(spark, [TEXTS[0], f"password = {COPIED}", f"password = {COPIED}", f"password = {COPIED}", None, "plain"])
    out = {r.doc_id: r for r in credentials.redact(frame).collect()}
    assert out[0].text == TEXTS[0].replace(LIVE, "*" * len(LIVE))
    assert out[1].text == f"password = {COPIED}" and out[4].text is None and out[5].text == "plain"
    assert credentials.redact(frame).schema == frame.schema


def owned(spark, rows):
    return spark.createDataFrame([(i, f"token={value}", owner, repo) for i, (value, owner, repo) in enumerate(rows)], "doc_id long, text string, source string, repo string")


def test_repositories_decide_beside_owners(spark):
    many = owned(spark, [(COPIED, "a", f"r{i}") for i in range(credentials.COPIED_REPOS)])
    assert {(r.n_copied, r.n_live) for r in credentials.scan(many, repo_col="repo").collect()} == {(1, 0)}
    assert credentials.redact(many, repo_col="repo").where("instr(text, '*') > 0").count() == 0
    few = many.where("doc_id > 0")
    assert {(r.n_copied, r.n_live) for r in credentials.scan(few, repo_col="repo").collect()} == {(0, 1)}
    assert {(r.n_copied, r.n_live) for r in credentials.scan(many).collect()} == {(0, 1)}  # one owner, no repositories known


def test_two_owners_short_values_and_letters(spark):
    rows = [(LIVE, "a", None), (LIVE, "b", None), ("x7Kq2mZp", "a", None), ("hT5-vR9w.Lq3", "b", None), ("wJalrXUtnFEMIqKbPxRfiCY", "a", None)]
    plain_words = [("something", "a", None), ("getAccessToken", "a", None), ("config.session", "b", None), ("aaaaaaa1", "b", None)]
    frame = owned(spark, rows + plain_words)
    got = [(r.n_copied, r.n_live, r.n_unclear) for r in credentials.scan(frame).orderBy("doc_id").collect()]
    assert got == [(0, 1, 0)] * len(rows) + [(0, 0, 1)] * len(plain_words)
    texts = [r.text for r in credentials.redact(frame).orderBy("doc_id").collect()]
    assert texts == ["token=" + "*" * len(v) for v, _, _ in rows] + [f"token={v}" for v, _, _ in plain_words]


def test_odd_and_empty_tables(spark):
    frame = odd_docs(spark)
    assert credentials.scan(frame).count() == frame.count() == credentials.redact(frame).count()
    assert credentials.scan(frame.where("false")).count() == 0 == credentials.redact(frame.where("false")).count()


def test_verdicts_equal_plain_counts(spark):
    """Values by distinct owners and (owner, repository) pairs, nulls and repeats included, against sets."""
    rng = random.Random(6)
    values = [f"v{k}" for k in range(60)]
    rows = []
    for value in values:
        owners, repos = rng.choice([1, 1, 2, 3, 6]), rng.choice([1, 1, 2, 9, 14])
        for _ in range(rng.randint(1, 60)):
            owner = rng.choice([None, *range(owners)]) if rng.random() < 0.3 else rng.randrange(owners)
            rows.append((value.encode(), value[-1] in "13579", None if owner is None else f"o{owner}", rng.choice([None, f"r{rng.randrange(repos)}"])))
    frame = spark.createDataFrame(rows, "vhash binary, random boolean, owner string, repo string")
    got = {bytes(r.vhash).decode(): (r.n_found, r.n_repos, r.n_owners, r.verdict) for r in credentials.ownership(frame).collect()}
    want = {}
    for value in values:
        mine = [r for r in rows if r[0] == value.encode()]
        owners, repos = {o for *_, o, _ in mine}, {(o, p) for *_, o, p in mine}
        copied = len(owners) >= credentials.COPIED_OWNERS or len(repos) >= credentials.COPIED_REPOS
        want[value] = (len(mine), len(repos), len(owners), "copied" if copied else "live" if mine[0][1] else "unclear")
    assert got == want and {v[3] for v in want.values()} == {"copied", "live", "unclear"}
