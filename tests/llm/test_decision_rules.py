"""Statistics against plain counts, learned lists on labels that follow a known rule, and planted rows."""

import random
import re
from collections import Counter

import pytest

from silolens.llm import decision_rules as dr
from tests.llm.helpers import docs, odd_docs, sentence, texts

EXTRA = ["a b c d e a b c d e", "x " * 40, "l one\nl two\nl one\n\n \nl one", "#*$%&|<> " * 30, "é " * 12 + "é é", "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 z w2 w3 w4 w5 w6", "a b c d e", "\x0b\x0c\r\n words\there"]


def plain(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    fives = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts, marked = Counter(fives), set()
    for k, five in enumerate(fives):
        if counts[five] > 1:
            marked.update(range(k, k + 5))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), n < 10 or 100 * len(marked) > 20 * n


def test_statistics(spark):
    found = [*texts(), *EXTRA]
    rows = {r.doc_id: r for r in dr.statistics(docs(spark, found)).collect()}
    for i, text in enumerate(found):
        assert tuple(rows[i][c] for c in (*dr.STATISTICS, "base_failed")) == plain(text), text


def labelled(spark, n=600, seed=11):
    """Bad texts hold many symbols, or are long-worded with repeated lines."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = sentence(rng, rng.randint(20, 120))
        bad = rng.random() < 0.3
        if bad and i % 2:
            text = " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in text.split())
        elif bad:
            text = " ".join("z" * 15 + w for w in text.split())
        rows.append(text)
        labels.append((i, 0 if bad else 1))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_learned_list(spark):
    frame, labels = labelled(spark)
    rules = dr.fit(frame.where("doc_id < 400"), labels)
    assert 1 <= len(rules) <= dr.MOST_RULES
    judged = dr.judge(frame.where("doc_id >= 400"), rules).join(labels, "doc_id").where("NOT base_failed").collect()
    wrong = [r for r in judged if r.kept != (r.quality == 1)]
    assert len(wrong) <= 0.03 * len(judged)
    assert not any(r.quality == 1 and not r.kept for r in judged)


def test_rules_are_ordered_expressions(spark):
    frame, labels = labelled(spark, 300)
    rules = dr.fit(frame, labels)
    rows = dr.judge(frame, rules).collect()
    for r in rows:
        values = (float(r.n_words), r.word_chars / r.n_words, r.n_symbols / r.n_words, float(r.n_dup_lines), r.n_repeat_words / r.n_words)
        assert r.kept == (not r.base_failed and not any(all(c.holds(values) for c in rule) for rule in rules))
    plan = dr.judge(frame, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("label", [0, 1, None])
def test_one_class_or_none_gives_no_rules(spark, label):
    frame, labels = labelled(spark, 60)
    assert dr.fit(frame, labels.withColumn("quality", dr.F.lit(label).cast("int"))) == []
    assert dr.fit(frame, labels.where("false")) == [] == dr.fit(frame.where("false"), labels)


def test_odd_and_empty_tables(spark):
    frame = odd_docs(spark)
    assert dr.judge(frame, []).count() == frame.count()
    kept = dr.keep_good(frame, [])
    assert kept.schema == frame.schema
    want = [r for r in frame.collect() if not plain(r.text)[-1]]
    assert Counter(kept.collect()) == Counter(want)
    assert dr.judge(frame.where("false"), []).count() == 0 == dr.keep_good(frame.where("false"), []).count()
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (99, 0)], "doc_id long, quality int")
    assert dr.fit(frame, labels) == []
