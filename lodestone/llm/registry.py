"""The queries of the training-data operators, with production parameters, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import ann, bpe, decontaminate, langid, secrets, sharding, simhash, suffixdedup, toxicity, urlfilter
from lodestone.llm.common import id_fold, table

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.interleaved_shards(docs, 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The table of CRC-32 by its rule, a reduction over each text's bytes, and the two rankings.
OP1_SQL = """
WITH RECURSIVE bits AS (SELECT i AS n, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
a AS (SELECT doc_id, source, CAST(length(h) // 2 + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2),
    lambda i: CAST(concat('0x', substr(h, i, 2)) AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc),
b AS (SELECT *, md5(concat_ws(':', 'lodestone', doc_id, text_crc32, size, row_number() OVER (PARTITION BY doc_id, source, text_crc32, size))) AS key FROM a),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key, doc_id) - 1) / (2.0::double * count(*) OVER (PARTITION BY source)) AS f FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, key, doc_id) - 1 AS pos, count(*) OVER () AS n FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(((pos + 1) * 16 - 1) // n AS INT) AS shard, CAST(pos - ((pos + 1) * 16 - 1) // n * n // 16 AS BIGINT) AS slot,
  CAST(NULL AS INT) AS grown_shard FROM p
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(id_fold("doc_id", 5) != 0))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        (id_fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("sentences").alias("n_offending"),
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(id_fold("doc_id", 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents"), 400, digests=True)


#: All windows of 400 bytes (800 hexadecimal digits) counted by their digest, and gaps and islands over the repeated ones.
#: The characters of what is left are UTF-8 sequences; other bytes are halves of cut characters.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM d, unnest(range(0, length(h) // 2 - 399)) u(i)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS n FROM w) WHERE n > 1),
g AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 1 ELSE 0 END AS cut FROM s),
k AS (SELECT r, i, sum(cut) OVER (PARTITION BY r ORDER BY i) AS span FROM g),
a AS (SELECT r, span, min(i) AS b, max(i) + 400 AS e FROM k GROUP BY r, span),
x AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS before FROM a),
y AS (SELECT r, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS head
  FROM x JOIN d USING (r) GROUP BY r),
z AS (SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN h ELSE concat(head, substr(h, 2 * last + 1)) END AS kept FROM d LEFT JOIN y USING (r))
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256, n_bytes - n_removed AS n_kept,
  decode(unhex(array_to_string(list_filter(regexp_extract_all(kept, '[0-7].|C[2-9A-F][89AB].|D.[89AB].|E0[AB].[89AB].|E[1-9A-CEF][89AB].[89AB].|ED[89].[89AB].|'
    || 'F0[9AB].[89AB].[89AB].|F[1-3][89AB].[89AB].[89AB].|F48.[89AB].[89AB].|..'), lambda c: length(c) > 2 OR c < '8'), ''))) AS text FROM z
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = F.when(F.col("toxic").isNull() & F.col("quality").isNull(), None).otherwise(
        ((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)).cast("int")
    )
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


OP8_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), l AS (
  SELECT doc_id AS page_id, CASE WHEN toxic IS NULL AND quality IS NULL THEN NULL
    ELSE CAST(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 AS INT) END AS bad FROM labels
), h AS (
  SELECT host, array_to_string(string_split(host, '.')[(CASE WHEN regexp_matches(host, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z]{2}$') THEN -3 ELSE -2 END):], '.') AS domain,
    array_to_string(string_split(host, '.')[(CASE WHEN regexp_matches(host, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z]{2}$') THEN -2 ELSE -1 END):], '.') AS suffix,
    count(bad) AS n, coalesce(sum(bad), 0) AS k FROM p LEFT JOIN l USING (page_id) GROUP BY host
), g AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 1.0::double) / (sum(n) + 2) ELSE 0.5 END AS m FROM h
), s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(g.m) AS m FROM h, g GROUP BY suffix
), s1 AS (SELECT coalesce(1 / least(0.5, greatest(1e-4, (sum(n * pow(k / n::double - m, 2) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0)::double)) - 1, 100.0) AS s
  FROM s0 WHERE n > 0 AND m > 0 AND m < 1
), s2 AS (SELECT suffix, (k + s * m) / (n + s) AS m FROM s0, s1
), d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(s2.m) AS m FROM h JOIN s2 USING (suffix) GROUP BY domain
), d1 AS (SELECT coalesce(1 / least(0.5, greatest(1e-4, (sum(n * pow(k / n::double - m, 2) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0)::double)) - 1, 100.0) AS s
  FROM d0 WHERE n > 0 AND m > 0 AND m < 1
), d2 AS (SELECT domain, (k + s * m) / (n + s) AS m FROM d0, d1
), e0 AS (SELECT host, n, k, d2.m AS m FROM h JOIN d2 USING (domain)
), e1 AS (SELECT coalesce(1 / least(0.5, greatest(1e-4, (sum(n * pow(k / n::double - m, 2) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0)::double)) - 1, 100.0) AS s
  FROM e0 WHERE n > 0 AND m > 0 AND m < 1
), e2 AS (SELECT host, n + s AS w, (k + s * m) / (n + s) AS mu FROM e0, e1
), e AS (SELECT host, mu - 1.645::double * sqrt(mu * (1 - mu) / (w + 1)) AS bound FROM e2
), r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict, round(bound, 6) AS posterior_bound
FROM r LEFT JOIN e USING (host)
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.tokenize(table(spark, sf_dir, "documents"), path, digests=True)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_secret_scan": op2_secret_scan,
        "op3_toxicity": op3_toxicity,
        "op4_language": op4_language,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_decontaminate": op6_decontaminate,
        "op7_neighbours": op7_neighbours,
        "op8_url_filter": op8_url_filter,
        "op9_bpe": op9_bpe,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op5_suffix_dedup": OP5_SQL, "op8_url_filter": OP8_SQL}
