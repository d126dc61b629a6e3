"""The pipeline's queries over the given tables: one per operator, with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silolens.llm import align, credentials, decision_rules, fixity, hyperplanes, line_blocks, line_dedup, lpf, packing, pieces, search, simhash, url_lists
from silolens.llm.common import stored, table
from silolens.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


OP2_SQL = f"""
WITH each AS (
    SELECT page_id AS record_id, coalesce(strlen(cast(page_id AS varchar)) || ':' || cast(page_id AS varchar), '-') || coalesce(strlen(url) || ':' || url, '-') || coalesce(strlen(html) || ':' || html, '-') AS body FROM pages),
hashed AS (
    SELECT record_id, sha256(body) AS digest, sha256(body || '#') AS damaged, strlen(body) AS size, count(*) AS copies FROM each GROUP BY ALL),
files AS (SELECT greatest(1, cast(ceil(sum(size * copies) / {fixity.FILE_BYTES}.0) AS bigint)) AS n FROM hashed),
placed AS (
    SELECT *, cast('0x' || substr(digest, 1, 12) AS bigint) % n AS file FROM hashed, files),
laid AS (
    SELECT *, coalesce(sum(size * copies) OVER (PARTITION BY file ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM placed),
leaves AS (
    SELECT 'a' AS side, file, start, size * copies AS size, digest FROM laid
    UNION ALL
    SELECT 'b', file, start, size * copies, CASE WHEN substr(digest, 63) = '0a' THEN damaged ELSE digest END FROM laid WHERE substr(digest, 62) <> 'fff'),
n0 AS (
    SELECT side, file, start // {fixity.RANGE_BYTES} AS node, sha256(string_agg(start || ':' || size || ':' || digest, ',' ORDER BY start, size, digest)) AS digest FROM leaves GROUP BY ALL),
n1 AS (SELECT side, file, node // {fixity.FANOUT} AS node, sha256(string_agg(n0.node || ':' || digest, ',' ORDER BY n0.node)) AS digest FROM n0 GROUP BY side, file, n0.node // {fixity.FANOUT}),
n2 AS (SELECT side, file, node // {fixity.FANOUT} AS node, sha256(string_agg(n1.node || ':' || digest, ',' ORDER BY n1.node)) AS digest FROM n1 GROUP BY side, file, n1.node // {fixity.FANOUT}),
roots AS (SELECT side, file, sha256(string_agg(node || ':' || digest, ',' ORDER BY node)) AS digest FROM n2 GROUP BY ALL)
SELECT l.record_id, l.file, l.start, l.size * l.copies AS size, l.digest AS expected,
       CASE WHEN substr(l.digest, 62) <> 'fff' THEN l.damaged END AS found,
       CASE WHEN substr(l.digest, 62) = 'fff' THEN 'missing' ELSE 'altered' END AS status, a.digest AS expected_root, b.digest AS found_root
FROM laid l JOIN roots a ON a.file = l.file AND a.side = 'a' LEFT JOIN roots b ON b.file = l.file AND b.side = 'b'
WHERE substr(l.digest, 62) = 'fff' OR substr(l.digest, 63) = '0a'
"""


@query("op2_fixity", OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as archived records against a replica with damaged and lost records, chosen by their digests."""
    held = stored(fixity.laid_out(fixity.records(table(spark, sf, "pages"), "page_id", ["url", "html"])), "records")
    primary = held.selectExpr("file", "start", "size * copies AS size", "digest")
    replica = held.where("substring(digest, 62) <> 'fff'").selectExpr("file", "start", "size * copies AS size", "CASE WHEN substring(digest, 63) = '0a' THEN damaged ELSE digest END AS digest")
    trees = fixity.tree(primary), fixity.tree(replica)
    found = fixity.audit(primary, replica, trees=trees)
    roots = [side[-1].selectExpr("file", f"digest AS {name}") for side, name in zip(trees, ("expected_root", "found_root"))]
    known = held.selectExpr("record_id", "digest AS expected")
    return found.join(known, "expected", "left").join(roots[0], "file", "left").join(roots[1], "file", "left").select(
        "record_id", "file", "start", "size", "expected", "found", "status", "expected_root", "found_root")


def _joined(spans: str) -> str:
    """Spans in order as ``kind:start:end``, joined by commas."""
    kinds = ", ".join(f"'{k}'" for k in credentials.KINDS)
    return f"array_join(transform({spans}, s -> concat_ws(':', element_at(array({kinds}), s.kind + 1), s.start, s.stop)), ',')"


@query("op3_credentials")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = credentials.scan(table(spark, sf, "documents"))
    counts = [f"cast(size(filter(base, s -> s.kind = {i})) AS long) AS n_{k}" for i, k in enumerate(credentials.KINDS[:3])]
    return found.selectExpr(
        "doc_id", *counts, f"sha2({_joined('base')}, 256) AS base_sha256", f"{_joined('array_sort(concat(base, live))')} AS spans",
        "n_copied AS n_copied_examples", "n_live AS n_live_credentials", "n_unclear")


@query("op4_simhash")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0') AS fingerprint", "component_id")


@query("op5_hyperplanes")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return hyperplanes.near_duplicates(table(spark, sf, "embeddings"))


@query("op6_pieces")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(table(spark, sf, "documents"), model), model)
    return back.selectExpr("doc_id", "cast(size(ids) AS long) AS n_ids", "ids_crc32", "decoded <=> coalesce(text, '') AS same_text", "sha2(decoded, 256) AS decoded_sha256")


@query("op7_line_blocks")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return line_blocks.extract(table(spark, sf, "pages"))


@query("op8_suffix_array")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = lpf.dedup(table(spark, sf, "documents").select("doc_id", "text"))
    removed = "aggregate(spans, 0L, (t, s) -> t + s.stop - s.start)"
    return found.selectExpr("doc_id", "n_bytes", f"{removed} AS n_removed", "cast(size(spans) AS long) AS n_spans", "sha2(kept, 256) AS kept_sha256")


@query("op9_decision_rules")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rules = decision_rules.fit(docs, table(spark, sf, "labels"))
    return decision_rules.judge(docs, rules).select("doc_id", *decision_rules.STATISTICS, "base_failed", "kept")


#: The list is made from the hosts of the pages: added, removed and added again on days that follow from their hashes.
LISTED_HOSTS = "substring(md5(host), 1, 1) < '8'"
OP10_SQL = f"""
WITH seen AS (
    SELECT page_id, url, nullif(lower(regexp_replace(regexp_extract(url, '{url_lists.HOST_PATTERN}', 1), '[.]$', '')), '') AS host,
           date '2024-01-01' + cast(page_id % 365 AS integer) AS fetched FROM pages),
hosts AS (SELECT DISTINCT host, regexp_replace(host, '^(www|m|blog)[.]', '') AS pattern FROM seen WHERE host IS NOT NULL AND substr(md5(host), 1, 1) < '8'),
days AS (
    SELECT pattern, date '2023-12-01' + cast(cast('0x' || substr(md5(host), 2, 2) AS integer) AS integer) AS d1,
           30 + cast('0x' || substr(md5(host), 4, 2) AS integer) AS gap, 20 + cast('0x' || substr(md5(host), 6, 2) AS integer) AS again FROM hosts),
entries AS (
    SELECT pattern, d1 AS day, true AS listed FROM days
    UNION ALL SELECT pattern, d1 + cast(gap AS integer), false FROM days
    UNION ALL SELECT pattern, d1 + cast(gap + again AS integer), true FROM days),
states AS (SELECT pattern, day, bool_and(listed) AS listed FROM entries GROUP BY ALL),
latest AS (
    SELECT s.page_id, s.host, s.url, s.fetched, p.pattern, max(e.day) AS day FROM seen s
    JOIN (SELECT DISTINCT pattern FROM states) p ON s.host = p.pattern OR ends_with(s.host, '.' || p.pattern)
    JOIN states e ON e.pattern = p.pattern AND e.day <= s.fetched GROUP BY ALL),
hit AS (SELECT a.page_id, a.url, a.pattern, a.day FROM latest a JOIN states e ON e.pattern = a.pattern AND e.day = a.day AND e.listed),
since AS (
    SELECT h.page_id, h.url, h.pattern, (SELECT min(e.day) FROM states e WHERE e.pattern = h.pattern AND e.day <= h.day AND e.listed
        AND NOT EXISTS (SELECT 1 FROM states r WHERE r.pattern = h.pattern AND NOT r.listed AND r.day BETWEEN e.day AND h.day)) AS since FROM hit h),
best AS (SELECT page_id, url, max(struct_pack(n := length(pattern), pattern := pattern, since := since)) AS b FROM since GROUP BY ALL)
SELECT s.page_id, s.host, cast(s.fetched AS varchar) AS fetched, b.b IS NOT NULL AS blocked, b.b.pattern AS pattern, cast(b.b.since AS varchar) AS listed_since
FROM seen s LEFT JOIN best b ON b.page_id = s.page_id AND b.url = s.url
"""


@query("op10_url_lists", OP10_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").selectExpr("page_id", "url", "date_add(date '2024-01-01', cast(page_id % 365 AS int)) AS fetched")
    hosts = pages.select(url_lists.host("url").alias("host")).where("host IS NOT NULL").distinct().where(LISTED_HOSTS)
    number = "cast(conv(substring(md5(host), {}, 2), 16, 10) AS int)"
    first = f"date_add(date '2023-12-01', {number.format(2)})"
    days = hosts.selectExpr("regexp_replace(host, '^(www|m|blog)[.]', '') AS pattern", f"{first} AS d1", f"30 + {number.format(4)} AS gap", f"20 + {number.format(6)} AS again")
    entries = days.selectExpr("pattern", "inline(array(struct(d1 AS day, 'add' AS action), struct(date_add(d1, gap) AS day, 'remove' AS action), struct(date_add(d1, gap + again) AS day, 'add' AS action)))")
    found = url_lists.judge(pages, entries)
    return found.selectExpr("page_id", "host", "cast(fetched AS string) AS fetched", "blocked", "pattern", "cast(listed_since AS string) AS listed_since")


@query("op11_alignment")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    files = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    return align.align(table(spark, sf, "documents"), *files)


OP12_SQL = f"""
WITH each AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM each),
repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id <> r.keeper AS dropped FROM keyed k LEFT JOIN repeated r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, cast(count(*) FILTER (dropped) AS bigint) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM judged GROUP BY doc_id
"""


@query("op12_line_dedup", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf, "documents").select("doc_id", "text"))
    kept = F.when(F.col("keep").isNull(), F.coalesce("text", F.lit(""))).otherwise(line_dedup.apply_keep("text", "keep"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{line_dedup.UPPER}', '{line_dedup.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
asked AS (
    SELECT item_id, term, count(*) AS repeats FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{line_dedup.UPPER}', '{line_dedup.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, cast(sum(n) AS bigint) AS n_terms FROM size),
scale AS (SELECT doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM size, corpus),
weight AS (SELECT term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS bigint) AS w FROM held, corpus WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
scores AS (
    SELECT a.item_id, h.doc_id, cast(sum(a.repeats * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * s.m))) AS bigint) AS score
    FROM asked a JOIN weight w ON w.term = a.term JOIN held h ON h.term = a.term JOIN scale s ON s.doc_id = h.doc_id GROUP BY ALL),
ranked AS (SELECT *, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS integer) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op13_lexical_search", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    blocks = stored(search.index(docs), "blocks")
    return search.search(docs, table(spark, sf, "benchmark"), blocks)
