"""Small tables for the pipeline's operators."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, `start` string, n_words string, _id string, words string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(n))


def texts(seed=1):
    """Copies, near copies, shared passages, repeats inside a text, empty, missing and long texts."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(30, 200)) for _ in range(20)]
    passage = sentence(rng, 40)
    long_ = " ".join(sentence(rng, 500) for _ in range(8))
    near = [base[0].replace(base[0].split()[k], "changed", 1) for k in (3, 9, 20)]
    out = [*base, base[0], base[1], *near, base[2] + " " + passage, passage + " " + base[3], base[4] + passage + base[5], passage + " " + passage, "Ünïcode ß " * 40, "aaaa" * 100]
    return [*out, long_, long_[500:3000], "", None, " \n\t ", "one", "one two", "ONE two", "x" * 99, "x" * 100, "x" * 101, "a\n\nb  c\n"]


def docs(spark, found=None, ids=None):
    found = texts() if found is None else found
    ids = list(range(len(found))) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 7 else None, None if t is None else len(t), "fp", "0", "n", "i", "w") for k, (i, t) in enumerate(zip(ids, found))]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def odd_docs(spark):
    """``docs`` with null ids, an id that stands for two texts, and rows that repeat throughout."""
    found = texts()
    ids = list(range(len(found)))
    found += [found[0], found[7], found[8], found[8], None, found[12], found[12]]
    ids += [0, 7, 3, None, None, None, None]
    return docs(spark, found, ids)


def reachable(n, pairs):
    """Smallest index reachable from each index."""
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]
