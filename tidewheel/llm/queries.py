"""Named queries opN_* and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import align, decontaminate, hard_negatives, licenses, line_dedup, near_dups, packing, quality, repeats, secrets_scan, shared_files, token_files, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT_WORDS = rf"regexp_extract_all({_LOWER.format('coalesce(text, {0})')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace("{0}", "''")

# ------------------------------------------------------------------ op2
_DECONTAMINATE = f"""WITH
d AS (SELECT doc_id, {_TEXT_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TEXT_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT *, least(len(w), 10) AS k, unnest(range(1, CAST(len(w) - least(len(w), 10) + 2 AS BIGINT))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT d.*, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT DISTINCT doc_id, i, dw.k, g, item FROM dw JOIN bw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op2_decontaminate", _DECONTAMINATE)
def op2(spark, sf):
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


# ------------------------------------------------------------------ op4
@query("op4_licenses")
def op4(spark, sf):
    return licenses.scan(table(spark, sf, "documents"), licenses.template_frame(spark))


# ------------------------------------------------------------------ op10
#: fixed: verdict, host, path
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_URLS = f"""WITH
r(verdict, host, path) AS (VALUES {_RULE_ROWS}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/]*')")} AS host, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM u)
SELECT p.page_id, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, coalesce(max_by(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
GROUP BY 1, 2, 3"""


@query("op10_url_filter", _URLS)
def op10(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"), url_filter.rule_frame(spark, URL_RULES))


# ------------------------------------------------------------------ op3
@query("op3_token_files")
def op3(spark, sf):
    return token_files.digest(table(spark, sf, "documents"))


# ------------------------------------------------------------------ op1, op6, op8
@query("op1_packing")
def op1(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query("op6_quality")
def op6(spark, sf):
    return quality.judge(table(spark, sf, "documents"))


@query("op8_secrets")
def op8(spark, sf):
    return secrets_scan.scan(table(spark, sf, "documents"))


# ------------------------------------------------------------------ op7, op9
_WARC = """WITH
p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS keeper FROM d),
b AS (SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(0, 5), lambda j:
        CAST((((instr('0123456789abcdef', substr(hex, CAST((5 * i + j) // 4 + 1 AS BIGINT), 1)) - 1) >> CAST(3 - (5 * i + j) % 4 AS INTEGER)) & 1) AS BIGINT) << CAST(4 - j AS INTEGER))) AS BIGINT) + 1, 1)) AS digits FROM k)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(digits, '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM b"""


@query("op7_warc", _WARC)
def op7(spark, sf):
    index = warc.write(table(spark, sf, "pages"), shared_files.folder(spark, "warc"))
    return warc.read(index)


@query("op9_repeats")
def op9(spark, sf):
    found = repeats.remove(table(spark, sf, "documents")).drop("kept")
    return found.withColumn("repeated", F.col("n_removed") > 0)


# ------------------------------------------------------------------ op5
@query("op5_near_dups")
def op5(spark, sf):
    return near_dups.classes(table(spark, sf, "documents"))


# ------------------------------------------------------------------ op11
_NEGATIVES = """WITH
e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS place
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 10"""


@query("op11_hard_negatives", _NEGATIVES)
def op11(spark, sf):
    number = F.col("vec_id")
    label = F.when(number % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(table(spark, sf, "embeddings"), number % 100 == 0, label)


# ------------------------------------------------------------------ op12
_LINES = f"""WITH
l AS (SELECT doc_id, i, t[i] AS line, {_LOWER.format("trim(t[i], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))")} AS key
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents), LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)),
k AS (SELECT key, min(doc_id) AS keeper FROM l WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT doc_id, i, line, coalesce(doc_id <> keeper, false) AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY 1"""


@query("op12_line_dedup", _LINES)
def op12(spark, sf):
    cleaned = line_dedup.clean(table(spark, sf, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


# ------------------------------------------------------------------ op13
@query("op13_token_alignment")
def op13(spark, sf):
    return align.score(table(spark, sf, "documents"))
