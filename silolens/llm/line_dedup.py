"""Line deduplication: range-partitioned hashes, first occurrences by secondary sort, run-length keep bitmaps.

Every line long enough becomes a pair of 64-bit hashes of its key with the
document and position it stands at: no text leaves the scan. These rows are
partitioned by ranges of (hash, salt) and sorted by hash, document and
position, so that the first occurrence and the change from one document to the
next are read off neighbouring rows. The salt is a hash of the document: a line
that a third of all documents hold is sorted in as many parts as there are
partitions, and only one sum a part meets again under the hash.

Lines to drop are found by joining the stored hashes with the repeated keys.
Keys with more than 1/``HOT_SHARE`` of all lines are at most ``HOT_SHARE`` and
are broadcast; every other key is small and joins by shuffle, at every size of
the table. Per document the dropped positions become a keep bitmap, run-length
coded, which meets its text again by the document's id. All of it is column
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silolens.llm.common import fresh, stored

MIN_CHARS = 40
MIN_DOCS = 5
#: A key with more than this share of all lines is hot, so at most as many keys are.
HOT_SHARE = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' \\t\\n\\u000B\\f\\r'"  # [\x20\x09-\x0D] as a SQL literal


def folded(text: str) -> Column:
    """``text`` (a column's SQL) with A-Z in lower case and all other characters as they are."""
    # lower() touches A-Z alone where every character is one byte
    return F.expr(f"CASE WHEN octet_length({text}) = char_length({text}) THEN lower({text}) ELSE translate({text}, '{UPPER}', '{LOWER}') END")


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc, row, pos, lines): each line whose key has ``min_chars`` code points.

    ``row`` is a hash of the text: it tells rows apart that share an id. A null
    text is one empty line, which no positive ``min_chars`` keeps.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    split = rows.select("doc", F.xxhash64("text").alias("row"), F.split(folded("text"), "\n", -1).alias("found"))
    long = F.expr(
        f"filter(transform(found, (line, i) -> struct(i AS pos, btrim(line, {BLANKS}) AS key)), s -> char_length(s.key) >= {int(min_chars)})")
    each = split.select("doc", "row", F.size("found").alias("lines"), F.explode(long).alias("s"))
    return each.select(F.xxhash64("s.key").alias("h1"), F.xxhash64(F.lit(1), "s.key").alias("h2"), "doc", "row", "s.pos", "lines")


def repeated_keys(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, keeper, docs): keys of ``min_docs`` documents or more, with the largest id that holds each."""
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = hashes.select("h1", "h2", F.pmod(F.xxhash64("doc"), F.lit(parts)).alias("salt"), "doc", "row", "pos")
    laid = salted.repartitionByRange(parts, "h1", "salt")
    group = Window.partitionBy("h1", "salt", "h2").orderBy(F.col("doc").desc_nulls_last(), "row", "pos")
    # Rows stream in order: a document is new where the row before holds another, the first row holds the largest id.
    new = (F.row_number().over(group) == 1) | ~F.lag("doc").over(group).eqNullSafe(F.col("doc"))
    firsts = laid.withColumn("new", new).where("new")
    found = firsts.groupBy("h1", "h2").agg(F.max("doc").alias("keeper"), F.count("*").alias("docs"))
    return found.where(F.col("docs") >= min_docs)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                 min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, row, n_lines, keep): the keep bitmap of each text that loses a line.

    ``keep`` is run-length coded: the lengths of alternating runs, kept lines
    first. Lines whose key (blanks stripped, A-Z in lower case) has ``min_chars``
    code points and stands in ``min_docs`` documents are dropped except in the
    largest id that holds the key, which keeps all of them. Rows of one id are
    one document, rows without an id together one that is smaller than all
    others; rows that repeat have one bitmap.
    """
    hashes = stored(line_hashes(docs, id_col, text_col, min_chars), "line_hashes")
    keys = stored(repeated_keys(hashes, min_docs), "repeated_lines")
    hot = F.col("docs") > hashes.count() / HOT_SHARE
    pairs = ["h1", "h2"]
    met = hashes.join(F.broadcast(keys.where(hot)), pairs).unionByName(hashes.join(keys.where(~hot).hint("merge"), pairs))
    gone = met.where(~F.col("doc").eqNullSafe(F.col("keeper")))
    placed = gone.groupBy("doc", "row").agg(F.max("lines").alias("n_lines"), F.array_sort(F.collect_set("pos")).alias("at"))
    # Where a run of dropped lines starts, and the first line past it, both in order.
    starts = placed.withColumn("next", F.expr("transform(at, x -> x + 1)"))
    edges = starts.select("doc", "row", "n_lines", F.expr("flatten(zip_with(array_except(at, next), array_except(next, at), (a, b) -> array(a, b)))").alias("edges"))
    return edges.select("doc", "row", "n_lines", F.expr("zip_with(concat(edges, array(n_lines)), concat(array(0), edges), (b, a) -> b - a)").alias("keep"))


def apply_keep(text: str, keep: str) -> Column:
    """The lines of ``text`` that a keep bitmap keeps, joined by line breaks (both are columns' SQL)."""
    mask = f"flatten(transform({keep}, (n, i) -> array_repeat(i % 2 = 0, n)))"
    return F.expr(f"array_join(zip_with(split({text}, '\\n', -1), {mask}, (line, kept) -> CASE WHEN kept THEN line END), '\\n')")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
          min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row of ``docs`` with ``n_lines``, ``n_dropped`` and ``keep`` (null where nothing is dropped).

    Columns of ``docs`` with those names are replaced. An empty table gives an
    empty one. Use :func:`apply_keep` for the text.
    """
    taken = {"n_lines", "n_dropped", "keep"}
    held = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])
    left, right = fresh(held, "_doc"), fresh(held, "_row")
    marks = stored(keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), "keep_bitmaps")
    marks = marks.select(F.col("doc").alias(left), F.col("row").alias(right), "keep").hint("merge")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    on = marks[left].eqNullSafe(held[f"`{id_col}`"]) & (marks[right] == F.xxhash64(text))
    total = F.size(F.split(text, "\n", -1)).cast("long")
    dropped = F.expr("aggregate(transform(coalesce(keep, array()), (n, i) -> IF(i % 2 = 1, n, 0)), 0L, (t, n) -> t + n)")
    return held.join(marks, on, "left").drop(left, right).withColumns({"n_lines": total, "n_dropped": dropped})
