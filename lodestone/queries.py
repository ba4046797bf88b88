"""The engine's queries over the driver's tables, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import model
from lodestone.functions import clock, derive
from lodestone.functions import text as tx
from lodestone.operators import catalogue, postings, tree, usage
from lodestone.plans import ranking
from lodestone.plans.compiler import compile_detailed
from lodestone.plans.engine import Engine, Table, order_by, types_present
from lodestone.plans.query import SearchQuery, Sort
from lodestone.sources import recorded, views
from lodestone.sources.scratch import shared_dir
from lodestone.sources.views import NOW_MS, entities, entities_sql, source
from lodestone.streaming import journal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def engine(rows: DataFrame, **options) -> Engine:
    return Engine([Table("table", rows)], now=NOW_MS, **options)


# Filters (P1-P15): the DSL on one side, a WHERE clause on the other.

DAY = 86_400_000
PREDICATES: dict[str, tuple[str, str]] = {
    "p1_type": ("type:file,service", "entity_type IN ('file', 'service')"),
    "p2_ext": ("ext:.EN", "lower(extension) = 'en'"),
    "p2_ext_pair": ("ext:en,.EN", "lower(extension) = 'en' AND lower(extension) = 'en'"),
    "p2_ext_disjoint": ("ext:en,fr", "lower(extension) = 'en' AND lower(extension) = 'fr'"),
    "p3_path": ('path:"src1"', "contains(lpath, 'src1')"),
    "p4_drive": ("drive:d", "(entity_type IN ('file', 'directory') AND upper(drive) = 'D') OR regexp_matches(path, '^[Dd]:')"),
    "p5_name": ("name:Red", "contains(lname, 'red')"),
    "p5_prefix": ("prefix:doc-1", "starts_with(lname, 'doc-1')"),
    "p6_modified_within": ("modified:<7d", f"entity_type IN ('file', 'directory', 'process') AND modified >= {NOW_MS - 7 * DAY}"),
    "p6_modified_older": ("modified:>2w", f"entity_type IN ('file', 'directory', 'process') AND modified < {NOW_MS - 14 * DAY}"),
    "p6_modified_after": ("modified:>=2024-01-20", "entity_type IN ('file', 'directory', 'process') AND modified >= epoch_ms(TIMESTAMP '2024-01-20')"),
    "p6_modified_before": ("modified:<=2024/01/05", "entity_type IN ('file', 'directory', 'process') AND modified <= epoch_ms(TIMESTAMP '2024-01-05')"),
    "p6_created": ("created:<30d", f"entity_type IN ('file', 'directory') AND created >= {NOW_MS - 30 * DAY}"),
    "p7_size": ("size:>2kb", "entity_type = 'file' AND size > 2048"),
    "p7_size_default": ("size:4kb", "entity_type = 'file' AND size >= 4096"),
    "p8_state": ("state:pending", "entity_type = 'service' AND (contains(svc_state, 'pending') OR contains(svc_start_type, 'pending'))"),
    "p8_state_words": ("state:running", "(entity_type = 'service' AND (contains(svc_state, 'running') OR contains(svc_start_type, 'running'))) OR entity_type = 'process'"),
    "p8_state_hidden": ("state:hidden", "entity_type = 'window' AND NOT visible"),
    "p9_pid": ("pid:42", "entity_type IN ('process', 'window') AND pid = 42"),
    "p10_user": ("user:nation_7", "entity_type = 'process' AND contains(lower(username), 'nation_7')"),
    "p11_visible": ("visible:yes", "entity_type = 'window' AND visible"),
    "p12_text": ("type:file doc- src3", "entity_type = 'file' AND (contains(lname, 'doc-') OR contains(lname, 'src3')) AND contains(lpath, 'doc-') AND contains(lpath, 'src3')"),
    "p13_combined": ("type:file ext:de path:src size:<3kb modified:<20d", f"entity_type = 'file' AND lower(extension) = 'de' AND contains(lpath, 'src') AND size < 3072 AND modified >= {NOW_MS - 20 * DAY}"),
}


def _filtered(line: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = compile_detailed(line).query
        return engine(entities(spark, sf_dir)).candidates(query).select("id", "entity_type", "name")

    return run


for _name, (_line, _where) in PREDICATES.items():
    register(_name, _filtered(_line), f"{entities_sql()} SELECT id, entity_type, name FROM e WHERE coalesce({_where}, false)")


# Scoring (K1-K14). The needle is in names, so that no fuzzy match takes part; K5 is tested in Python.

RECENCY_SQL = f"""CASE WHEN modified IS NULL THEN 0.0::double WHEN greatest({NOW_MS} - modified, 0) / 3600000.0::double <= 1 THEN 1.0
  ELSE greatest(0.0::double, least(1.0::double, 1.0::double - ln(1.0::double + greatest({NOW_MS} - modified, 0) / 3600000.0::double) / ln(8761.0::double))) END"""
PREFERENCE_SQL = """CASE entity_type WHEN 'file' THEN 4 WHEN 'directory' THEN 3 WHEN 'process' THEN 5 WHEN 'application' THEN 8
  WHEN 'service' THEN 2 WHEN 'window' THEN 2 END"""


def field_sql(column: str, needle: str) -> str:
    """Points of a word without separators in a column, null if it is not there."""
    token = r"list_contains(list_filter(regexp_split_to_array(" + column + r", '[\s\-_/\\.,;:()\[\]{}''\"+&|=@#]+'), lambda t: t <> ''), '" + needle + "')"
    return f"""(CASE WHEN {column} = '{needle}' THEN 100.0::double WHEN starts_with({column}, '{needle}') THEN 60.0
      WHEN contains({column}, '{needle}') THEN greatest(1.0::double, 40.0::double - (strpos({column}, '{needle}') - 1)::double / length({column}) * 40 * 0.25) END
      + CASE WHEN {column} <> '{needle}' AND {token} THEN 30 ELSE 0 END)"""


def fuzzy_sql(needle: str) -> str:
    """z: the leftmost subsequence of a needle of letters in names, and its points, step by step."""
    steps = ["q0 AS (SELECT id, collect_ord, name, lower(name) AS low, 0 AS at0 FROM e)"]
    for i, c in enumerate(needle, 1):
        found = f"strpos(substr(low, at{i - 1} + 1), '{c}')"
        steps.append(f"q{i} AS (SELECT *, at{i - 1} + {found} AS at{i} FROM q{i - 1} WHERE {found} > 0)")
    n, gaps, heads = len(needle), [], []
    for i in range(1, n + 1):
        if i > 1:
            gaps.append(f"CASE WHEN at{i} = at{i - 1} + 1 THEN 8 ELSE -least(24, 3 * (at{i} - at{i - 1} - 1)) END")
        before, own = f"substr(name, at{i} - 1, 1)", f"substr(name, at{i}, 1)"
        heads.append(
            f"CASE WHEN at{i} = 1 THEN 12 WHEN regexp_matches({before}, '[\\s\\-_/\\\\.,;:()\\[\\]{{}}''\"+&|=@#]') THEN 10 "
            f"WHEN {own} <> lower({own}) AND {before} <> upper({before}) THEN 6 ELSE 0 END"
        )
    whole = f"(100 * {n}) // (at{n} - at1 + 1) // 4 - least(24, 2 * (at1 - 1)) - least(16, (length(name) - {n}) // 8)"
    points = " + ".join([str(12 * n), *gaps, *heads, whole])
    where = " || ', ' || ".join(f"CAST(at{i} - 1 AS VARCHAR)" for i in range(1, n + 1))
    last = f"SELECT id, collect_ord, CAST(greatest(0, least(200, {points})) AS BIGINT) AS score, '[' || {where} || ']' AS positions FROM q{n}"
    return f", {', '.join(steps)}, z AS ({last})"


def _scored(line: str, views_: tuple[str, ...]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = compile_detailed(line).query
        rows = engine(entities(spark, sf_dir, *views_)).scored(query)
        return rows.select("id", "matched_field", F.round("score", 4).alias("score"))

    return run


def _total(points: str) -> str:
    return f"round({points} + 5 * ({RECENCY_SQL}) + ({PREFERENCE_SQL}), 4) AS score"


register(
    "k2_k4_name_match",
    _scored("type:file en", ("e_file",)),
    f"{entities_sql('e_file')} SELECT id, 'name' AS matched_field, {_total(field_sql('lname', 'en'))} FROM e WHERE contains(lname, 'en')",
)
register(
    "k2_exact_match",
    _scored("type:directory nation_1", ("e_dir",)),
    f"{entities_sql('e_dir')} SELECT id, 'name' AS matched_field, {_total(field_sql('lname', 'nation_1'))} FROM e WHERE contains(lname, 'nation_1')",
)
register(
    "k3_prefix_match",
    _scored("type:file doc", ("e_file",)),
    f"{entities_sql('e_file')} SELECT id, 'name' AS matched_field, {_total(field_sql('lname', 'doc'))} FROM e WHERE contains(lname, 'doc')",
)
register(
    "k7_path_discount",
    _scored("type:file fr 9", ("e_file",)),
    f"""{entities_sql("e_file")}, p AS (SELECT *, {field_sql("lname", "fr")} AS n1, {field_sql("lpath", "fr")} AS p1,
      {field_sql("lname", "9")} AS n2, {field_sql("lpath", "9")} AS p2 FROM e
      WHERE (contains(lname, 'fr') OR contains(lname, '9')) AND contains(lpath, 'fr') AND contains(lpath, '9'))
    SELECT id, 'name' AS matched_field, {_total("coalesce(n1, p1 * 0.5) + coalesce(n2, p2 * 0.5)")} FROM p WHERE n1 IS NOT NULL
    """,
)
# Words of two letters and more that a name lacks may still match it loosely: "fr" does not, without an f and an r.
register(
    "k10_k11_recency_preference",
    _scored("type:file,directory,process,application,service,window", ()),
    f"{entities_sql()} SELECT id, 'none' AS matched_field, {_total('CASE WHEN entity_type = ' + chr(39) + 'window' + chr(39) + ' AND trim(name) = ' + chr(39) * 2 + ' THEN -25 ELSE 0 END')} FROM e WHERE NOT (entity_type = 'window' AND trim(name) = '')",
)


def k9_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = usage.usage_of(views.usage_log(spark, sf_dir))
    ranker = ranking.heuristic(NOW_MS, usage=used)
    rows = engine(entities(spark, sf_dir, "e_file"), ranker=ranker).scored(SearchQuery(types=("file",)))
    return rows.select("id", F.round("score", 4).alias("score"))


USAGE_SQL = """u AS (SELECT e.id AS entity_id, arg_max('purchase', ts) AS query, count(*) AS selection_count, max(epoch_us(ts) // 1000) AS last_selected_ms
  FROM events JOIN e ON user_id = file_id WHERE event_type = 'purchase' GROUP BY e.id ORDER BY last_selected_ms DESC, entity_id LIMIT 2048)"""
register(
    "k9_usage_boost",
    k9_usage,
    f"""{entities_sql("e_file")}, {USAGE_SQL}, m AS (SELECT max(selection_count) AS most FROM u),
    b AS (SELECT entity_id, ln(1 + selection_count) / ln(1 + most) * pow(0.5, greatest({NOW_MS} - last_selected_ms, 0) / 86400000.0::double / 30) AS boost FROM u, m)
    SELECT id, round(coalesce(boost, 0) * 8 + 5 * ({RECENCY_SQL}) + 4, 4) AS score FROM e LEFT JOIN b ON id = entity_id""",
)


def k14_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(entities(spark, sf_dir, "e_dir")).scored(compile_detailed("type:directory nation_1").query)
    return rows.select("id", ranking.explained(F.col("components")).alias("why"))


register(
    "k14_explain",
    k14_explain,
    f"""{entities_sql("e_dir")} SELECT id, concat('name ', printf('%+.1f', {field_sql("lname", "nation_1")}), ', recency ', printf('%+.1f', 5 * ({RECENCY_SQL})), ', entity_preference +3.0') AS why
      FROM e WHERE contains(lname, 'nation_1')""",
)


def k16_without_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranker = ranking.heuristic(NOW_MS, ranking.Weights().without_fuzzy())
    rows = engine(entities(spark, sf_dir, "e_app"), ranker=ranker).scored(compile_detailed("type:application bl").query)
    return rows.select("id", "collect_ord", "matched_field", F.round("score", 4).alias("score"))


register(
    "k16_without_fuzzy",
    k16_without_fuzzy,
    f"""{entities_sql("e_app")}{fuzzy_sql("bl")}, n AS (SELECT e.*, coalesce({field_sql("lname", "bl")}, score / 20.0::double) AS in_name, {field_sql("lpath", "bl")} AS in_path
      FROM e LEFT JOIN z USING (id, collect_ord)) SELECT id, collect_ord, CASE WHEN in_name IS NOT NULL THEN 'name' ELSE 'path' END AS matched_field,
      {_total("coalesce(in_name, 0.5 * in_path)")} FROM n WHERE in_name IS NOT NULL OR in_path IS NOT NULL""",
)


def k15_keep_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(entities(spark, sf_dir, "e_file"), ranker=ranking.keep_all(NOW_MS)).scored(SearchQuery())
    return rows.select("id", F.round("score", 4).alias("score"))


register(
    "k15_keep_all",
    k15_keep_all,
    f"{entities_sql('e_file')} SELECT id, round(30 - least(30, greatest({NOW_MS} - modified, 0) / 3600000.0::double), 4) AS score FROM e",
)


def k5_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entities(spark, sf_dir, "e_app", "e_win").withColumn("m", tx.fuzzy(F.col("name"), "ble"))
    return rows.where("m IS NOT NULL").select("id", "collect_ord", F.col("m.score").alias("score"), F.col("m.positions").cast("string").alias("positions"))


register("k5_fuzzy", k5_fuzzy, entities_sql("e_app", "e_win") + fuzzy_sql("ble") + " SELECT * FROM z")


# Phrases and the query language (Q1-Q17): what lines compile to, canonically.

LINES = {
    "latest docx": ("type:file ext:docx sort:modified-desc", "natural-language"),
    "最近的 docx": ("type:file ext:docx sort:modified-desc", "natural-language"),
    "running perl processes": ("type:process perl", "natural-language"),
    "show me Blender": ("blender", "natural-language"),
    "yesterday changed kotlin files": ("type:file ext:kt modified:<24h", "natural-language"),
    "昨天更改的 kotlin 文件": ("type:file ext:kt modified:<24h", "natural-language"),
    "last 12 days lua files": ("type:file ext:lua modified:<12d", "natural-language"),
    "this week ruby files": ("type:file ext:rb modified:<7d", "natural-language"),
    "please find all folders for holiday": ("type:directory holiday", "natural-language"),
    "open the app calculator": ("type:application calculator", "natural-language"),
    "kind:file extension:ZIP,toml size:>=2mb": ("type:file ext:ZIP ext:toml size:>=2mb", "dsl"),
    "type:process state:running user:Me": ("type:process state:running user:Me", "dsl"),
    "downtime": ("downtime", "plain-text"),
}


def q8_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(line, (c := compile_detailed(line)).query.to_dsl(), c.source) for line in LINES]
    return spark.createDataFrame(rows, "line string, compiled string, source string")


def _values(rows: list[tuple[str, ...]], names: str) -> str:
    listed = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {listed}) v({names})"


register("q8_compiled_lines", q8_compiled, _values([(k, *v) for k, v in LINES.items()], "line, compiled, source"))

# Order and limit.

SORTS = {
    "o2_sort_name": ("name-asc", "lower(coalesce(nullif(svc_display_name, ''), name)) ASC NULLS FIRST"),
    "o2_sort_path": ("path-desc", "coalesce(lpath, '') DESC"),
    "o2_sort_modified": ("modified-desc", "modified DESC NULLS LAST"),
    "o2_sort_created": ("created-asc", "created ASC NULLS FIRST"),
    "o2_sort_size": ("size-desc", "coalesce(CASE WHEN entity_type = 'file' THEN size END, 0) DESC"),
    "o2_sort_pid": ("pid-asc", "coalesce(CASE WHEN entity_type IN ('process', 'window') THEN pid END, 4294967295) ASC"),
    "o2_sort_memory": ("memory-desc", "coalesce(CASE WHEN entity_type = 'process' THEN memory_bytes END, 0) DESC"),
    "o1_sort_relevance": ("relevance-desc", None),
}


def _sorted(order: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = SearchQuery(sort=Sort.parse(order))
        top = engine(entities(spark, sf_dir)).search(query, limit=200)
        # The rank of at most 2,000 rows, which the limit has brought together.
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order_by(query.sort)))).select("rank", "id")

    return run


for _name, (_order, _by) in SORTS.items():
    _by = _by or f"round(5 * ({RECENCY_SQL}) + ({PREFERENCE_SQL}), 9) DESC"
    _all = f"{_by}, provider_ord, collect_ord, id"
    register(_name, _sorted(_order), f"{entities_sql()} SELECT row_number() OVER (ORDER BY {_all}) AS rank, id FROM e WHERE NOT (entity_type = 'window' AND trim(name) = '') ORDER BY {_all} LIMIT 200")


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: text, filters, order and limit."""
    query = compile_detailed("type:file ext:en doc-1 sort:size-desc").query
    top = engine(entities(spark, sf_dir, "e_file")).search(query)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order_by(query.sort))))
    return top.select("rank", "id", "name", "path", "size", F.round("score", 4).alias("score"))


register(
    "search_files",
    search,
    f"""{entities_sql("e_file")} SELECT row_number() OVER (ORDER BY size DESC, collect_ord, id) AS rank, id, name, path, size,
      {_total(field_sql("lname", "doc-1"))} FROM e WHERE extension = 'en' AND contains(lname, 'doc-1') ORDER BY size DESC, collect_ord, id LIMIT 50""",
)


def o3_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole result, with highlights and metadata as text."""
    query = compile_detailed("type:file en sort:name-asc limit:100").query
    rows = engine(entities(spark, sf_dir, "e_file")).results(query)
    return rows.select("id", "subtitle", "matched_field", tx.marked(F.col("name"), F.col("match_ranges")).alias("marked"), F.map_keys("metadata").cast("string").alias("keys"))


register(
    "o5_results_highlight",
    o3_results,
    f"""{entities_sql("e_file")} SELECT id, path AS subtitle, 'name' AS matched_field,
      concat(substr(name, 1, strpos(lname, 'en') - 1), '[', substr(name, strpos(lname, 'en'), 2), ']', substr(name, strpos(lname, 'en') + 2)) AS marked,
      '[entity_type, path, size_bytes, extension, modified_unix_ms, created_unix_ms, drive, file_id]' AS keys
      FROM e WHERE contains(lname, 'en') ORDER BY lname, collect_ord LIMIT 100""",
)
register(
    "o6_recent",
    lambda spark, d: usage.recent(usage.usage_of(views.usage_log(spark, d)), 25),
    f"{entities_sql('e_file')}, {USAGE_SQL} SELECT * FROM u ORDER BY last_selected_ms DESC, entity_id LIMIT 25",
)

# Derived columns.


def d_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    return e.select("id", derive.label().alias("label"), "display_name", derive.subtitle().alias("subtitle"), "extension", "drive")


register(
    "d1_d3_identity",
    d_columns,
    f"""{entities_sql()} SELECT id, CASE entity_type WHEN 'file' THEN 'File' WHEN 'directory' THEN 'Folder' WHEN 'process' THEN 'Process'
      WHEN 'application' THEN 'Application' WHEN 'service' THEN 'Service' ELSE 'Window' END AS label,
      coalesce(nullif(svc_display_name, ''), name) AS display_name,
      CASE entity_type WHEN 'file' THEN path WHEN 'directory' THEN path
        WHEN 'process' THEN concat_ws(' · ', concat('PID ', pid), CASE WHEN memory_bytes > 0 THEN concat(CAST(round_even(memory_bytes / 1048576.0::double, 0) AS BIGINT), ' MB') END, path)
        WHEN 'application' THEN concat_ws(' · ', app_source, target) WHEN 'service' THEN concat_ws(' · ', svc_state, svc_start_type, path)
        ELSE concat('PID ', pid) END AS subtitle,
      CASE WHEN entity_type = 'file' THEN extension WHEN entity_type IN ('process', 'application') THEN 'exe' END AS extension,
      CASE WHEN entity_type IN ('file', 'directory') THEN drive WHEN entity_type IN ('process', 'application', 'service') THEN upper(substr(path, 1, 1)) END AS drive FROM e""",
)


def d4_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.explode(derive.metadata()).alias("key", "value")
    return entities(spark, sf_dir, "e_file", "e_proc", "e_svc").select("id", pairs)


register(
    "d4_metadata",
    d4_metadata,
    entities_sql("e_file", "e_proc", "e_svc") + " SELECT id, k AS key, v AS value FROM (" + " UNION ALL ".join(
        f"SELECT id, '{key}' AS k, CAST({c} AS VARCHAR) AS v FROM e WHERE entity_type = '{kind}'"
        for kind in ("file", "process", "service") for key, c in {"entity_type": "entity_type", **derive.METADATA[kind]}.items()
    ) + ") WHERE v IS NOT NULL",
)
register(
    "d5_d9_paths",
    lambda spark, d: entities(spark, d, "e_app", "e_proc").select(
        "id",
        "collect_ord",
        derive.extension_of(F.col("path")).alias("ext"),
        derive.drive_of(F.col("path")).alias("drv"),
        derive.file_name_of(F.concat("path", F.lit("\\"))).alias("file_name"),
        derive.prettify(derive.file_name_of(F.col("path"))).alias("pretty"),
    ),
    entities_sql("e_app", "e_proc")
    + r""" SELECT id, collect_ord, regexp_extract(path, '\.([^.\\]+)$', 1) AS ext, upper(substr(path, 1, 1)) AS drv, regexp_extract(path, '([^\\]*)$', 1) AS file_name,
      array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_extract(path, '([^\\]*)$', 1), '\.exe$', ''), '[\s\-_.]+'), lambda w: w <> ''),
        lambda w: concat(upper(w[1]), substr(w, 2))), ' ') AS pretty FROM e""",
)
register(
    "d13_formats",
    lambda spark, d: entities(spark, d, "e_file").select(
        "id", clock.human_size(F.col("size") * 1000).alias("human"), clock.exact_size(F.col("size") * 1024).alias("exact"),
        clock.age_text(F.col("modified"), NOW_MS).alias("age"), clock.instant_text(F.col("modified")).alias("instant"),
        clock.days_of(F.col("modified")).alias("days"),
    ),
    f"""{entities_sql("e_file")} SELECT id, CASE WHEN size * 1000 >= 1073741824 THEN printf('%.1f GB', size * 1000 / 1073741824.0::double)
      WHEN size * 1000 >= 1048576 THEN printf('%.1f MB', size * 1000 / 1048576.0::double)
      WHEN size * 1000 >= 1024 THEN printf('%.1f KB', size * 1000 / 1024.0::double) ELSE concat(size * 1000, ' B') END AS human,
      CASE WHEN size = 0 THEN '0b' WHEN size % 1048576 = 0 THEN concat(size // 1048576, 'gb') WHEN size % 1024 = 0 THEN concat(size // 1024, 'mb') ELSE concat(size, 'kb') END AS exact,
      CASE WHEN ({NOW_MS} - modified) // 60000 < 1 THEN 'just now' WHEN ({NOW_MS} - modified) // 60000 < 60 THEN concat(({NOW_MS} - modified) // 60000, 'm ago')
        WHEN ({NOW_MS} - modified) // 60000 < 1440 THEN concat(({NOW_MS} - modified) // 3600000, 'h ago')
        WHEN ({NOW_MS} - modified) // 60000 < 43200 THEN concat(({NOW_MS} - modified) // 86400000, 'd ago')
        ELSE strftime(make_timestamp(modified * 1000), '%Y-%m-%d') END AS age,
      strftime(make_timestamp(modified * 1000), '%Y-%m-%d %H:%M:%S') AS instant, modified // 86400000 AS days FROM e""",
)

# Text functions.

register(
    "f3_tokens",
    lambda spark, d: entities(spark, d, "e_file", "e_app").select("id", "collect_ord", F.array_join(tx.tokens_of(F.col("path")), "|").alias("tokens")),
    entities_sql("e_file", "e_app")
    + r""" SELECT id, collect_ord, array_to_string(list_filter(regexp_split_to_array(lower(path), '[\s\-_/\\.,;:()\[\]{}''"+&|=@#]+'), lambda t: t <> ''), '|') AS tokens FROM e""",
)
register(
    "f7_f8_substring",
    lambda spark, d: entities(spark, d).select(
        "id", "collect_ord", tx.substring_range(F.col("name"), "En")["start"].alias("s"), tx.substring_score(F.col("name"), "en").alias("points")
    ).where("s IS NOT NULL"),
    f"""{entities_sql()} SELECT id, collect_ord, CAST(strpos(lname, 'en') - 1 AS INT) AS s,
      CAST(100 - least(60, (strpos(lname, 'en') - 1) * 40 // length(lname)) AS INT) AS points FROM e WHERE contains(lname, 'en')""",
)
register(
    "f22_f25_scalars",
    lambda spark, d: source(spark, d, "events").select(
        "event_id", clock.filetime_ms(F.col("event_id") * 10_000_019 + 132_000_000_000_000_000).alias("ms"),
        tx.volume_id(F.concat(F.lit(" \\\\?\\Volume{"), "event_type", F.lit("}\\ "))).alias("volume"),
    ),
    r"""SELECT event_id, (event_id * 10000019 + 132000000000000000 - 116444736000000000) // 10000 AS ms,
      concat('\\?\volume{', lower(event_type), '}') AS volume FROM events""",
)
register(
    "f24_trigrams",
    lambda spark, d: views.bench_files(spark, d).select(F.explode(tx.trigrams(F.col("lname"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")),
    f"""WITH b AS ({views.bench_files_sql()}), g AS (SELECT unnest(list_distinct(list_transform(range(1, length(lname) - 1), lambda i: substr(lname, i, 3)))) AS gram FROM b)
      SELECT gram, count(*) AS df FROM g GROUP BY gram""",
)

# Joins (J1-J8).


def path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root, regions below it, nations below these, and customers below their nations; with an orphan and a cycle."""
    region, nation, customer = (source(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    rows = spark.sql("SELECT 1L AS id, CAST(NULL AS BIGINT) AS parent_id, 'E:\\\\' AS name UNION ALL SELECT 2L, 999999999L, 'orphan' UNION ALL SELECT 3L, 4L, 'a' UNION ALL SELECT 4L, 3L, 'b'")
    for more in (
        region.selectExpr("100L + r_regionkey AS id", "1L AS parent_id", "r_name AS name"),
        nation.selectExpr("200L + n_nationkey AS id", "100L + n_regionkey AS parent_id", "n_name AS name"),
        customer.selectExpr("1000L + c_custkey AS id", "200L + c_nationkey AS parent_id", "c_name AS name"),
    ):
        rows = rows.union(more)
    return rows


TREE_SQL = r"""t AS (SELECT 1::BIGINT AS id, NULL::BIGINT AS parent_id, 'E:\' AS name UNION ALL SELECT 2, 999999999, 'orphan' UNION ALL SELECT 3, 4, 'a' UNION ALL SELECT 4, 3, 'b'
  UNION ALL SELECT 100 + r_regionkey, 1, r_name FROM region UNION ALL SELECT 200 + n_nationkey, 100 + n_regionkey, n_name FROM nation
  UNION ALL SELECT 1000 + c_custkey, 200 + c_nationkey, c_name FROM customer)"""
register(
    "j1_paths",
    lambda spark, d: tree.paths(path_tree(spark, d)),
    rf"""WITH RECURSIVE {TREE_SQL}, w AS (SELECT id, name AS path, 0 AS depth FROM t WHERE parent_id IS NULL
      UNION ALL SELECT t.id, concat(rtrim(w.path, '\'), '\', t.name), w.depth + 1 FROM t JOIN w ON t.parent_id = w.id) SELECT id, path, depth FROM w""",
)
register(
    "a15_consistency",
    lambda spark, d: tree.consistency(path_tree(spark, d).withColumn("is_deleted", F.lit(False))).select("id", "name"),
    f"WITH {TREE_SQL} SELECT id, name FROM t WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM t)",
)


def j4_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = entities(spark, sf_dir, "e_win").where("trim(name) <> ''").select("id", "pid")
    images = entities(spark, sf_dir, "e_proc").select("pid", F.col("name").alias("process_name"))
    return windows.join(images, "pid", "left").select("id", "pid", "process_name")


register(
    "j4_window_processes",
    j4_windows,
    f"{entities_sql('e_win', 'e_proc')} SELECT w.id, w.pid, p.name AS process_name FROM e w LEFT JOIN e p ON w.pid = p.pid AND p.entity_type = 'process' WHERE w.entity_type = 'window' AND trim(w.name) <> ''",
)

# Aggregates (A1-A14) and the catalogue.

register(
    "a1_statistics",
    lambda spark, d: tree.statistics(
        entities(spark, d, "e_file", "e_dir").select((F.col("entity_type") == "directory").alias("is_dir"), (F.col("collect_ord") % 7 == 0).alias("is_deleted"))
    ),
    f"""{entities_sql("e_file", "e_dir")} SELECT count(*) FILTER (entity_type = 'file' AND collect_ord % 7 <> 0) AS file_count,
      count(*) FILTER (entity_type = 'directory' AND collect_ord % 7 <> 0) AS directory_count, count(*) FILTER (collect_ord % 7 = 0) AS deleted_count FROM e""",
)
register(
    "a2_per_drive",
    lambda spark, d: entities(spark, d).where("drive IS NOT NULL").groupBy("drive").agg(F.count("*").alias("n")),
    f"{entities_sql()} SELECT upper(substr(path, 1, 1)) AS drive, count(*) AS n FROM e WHERE path IS NOT NULL GROUP BY 1",
)
register(
    "a3_per_source",
    lambda spark, d: catalogue.per_source(catalogue.deduplicated(entities(spark, d, "e_app"))),
    f"""{entities_sql("e_app")}, k AS (SELECT *, row_number() OVER (PARTITION BY lower(target) ORDER BY
      list_position(['app-paths', 'start-menu', 'windows-apps', 'path'], app_source), collect_ord) AS r FROM e) SELECT app_source, count(*) AS n FROM k WHERE r = 1 GROUP BY 1""",
)
register(
    "a4_catalogue",
    lambda spark, d: catalogue.deduplicated(entities(spark, d, "e_app")).select("name", "target", "app_source", "collect_ord"),
    f"""{entities_sql("e_app")}, k AS (SELECT *, row_number() OVER (PARTITION BY lower(target) ORDER BY
      list_position(['app-paths', 'start-menu', 'windows-apps', 'path'], app_source), collect_ord) AS r FROM e) SELECT name, target, app_source, collect_ord FROM k WHERE r = 1""",
)
register(
    "a7_usage_eviction",
    lambda spark, d: usage.usage_of(views.usage_log(spark, d), capacity=40),
    f"{entities_sql('e_file')}, {USAGE_SQL.replace('2048', '40')} SELECT * FROM u",
)
register(
    "o7_catalogue_order",
    lambda spark, d: catalogue.in_order(catalogue.deduplicated(entities(spark, d, "e_app"))).limit(300).withColumn("position", F.row_number().over(Window.orderBy(F.lower("name"), "target"))).select("position", "name", "target"),
    f"""{entities_sql("e_app")}, k AS (SELECT *, row_number() OVER (PARTITION BY lower(target) ORDER BY
      list_position(['app-paths', 'start-menu', 'windows-apps', 'path'], app_source), collect_ord) AS r FROM e)
      SELECT row_number() OVER (ORDER BY lower(name), target) AS position, name, target FROM k WHERE r = 1 ORDER BY lower(name), target LIMIT 300""",
)
register(
    "a6_usage",
    lambda spark, d: usage.usage_of(views.usage_log(spark, d)),
    f"{entities_sql('e_file')}, {USAGE_SQL} SELECT * FROM u",
)
register(
    "a9_posting_statistics",
    lambda spark, d: postings.Postings.build(views.bench_files(spark, d)).statistics(),
    f"""WITH b AS ({views.bench_files_sql()}), g AS (SELECT record_id, unnest(list_distinct(list_transform(range(1, length(lpath) - 1), lambda i: substr(lpath, i, 3)))) AS gram FROM b),
      s AS (SELECT gram, count(*) AS df, count(*) > greatest(512, (SELECT count(*) FROM b) // 50) AS dropped FROM g GROUP BY gram),
      t AS (SELECT (SELECT count(DISTINCT extension) FROM b) AS extensions, (SELECT count(DISTINCT substr(lname, 1, 24)) FROM b) AS prefixes,
      count(*) FILTER (NOT dropped) AS grams, count(*) FILTER (dropped) AS dropped_grams,
      CAST(coalesce(sum(df) FILTER (NOT dropped), 0) AS BIGINT) AS postings, CAST(sum(strlen(gram)) AS BIGINT) AS keys FROM s)
      SELECT * EXCLUDE (keys), 8 * (2 * (SELECT count(*) FROM b) + postings) + keys AS bytes FROM t""",
)
def a13_types_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = SearchQuery(sort=Sort.parse("name-desc"))
    top = engine(entities(spark, sf_dir)).search(query, limit=2000)
    return types_present(top.withColumn("rank", F.row_number().over(Window.orderBy(*order_by(query.sort)))))


register(
    "a13_types_present",
    a13_types_present,
    f"""{entities_sql()}, r AS (SELECT entity_type, row_number() OVER (ORDER BY lower(coalesce(nullif(svc_display_name, ''), name)) DESC NULLS LAST, provider_ord, collect_ord, id) AS rank
      FROM e WHERE NOT (entity_type = 'window' AND trim(name) = '') QUALIFY rank <= 2000)
      SELECT row_number() OVER (ORDER BY min(rank)) AS position, entity_type FROM r GROUP BY entity_type""",
)

# Set operations and the planner.

register(
    "u1_union",
    lambda spark, d: entities(spark, d).select("id", "entity_type", "provider_ord", "collect_ord"),
    f"{entities_sql()} SELECT id, entity_type, provider_ord, collect_ord FROM e",
)


_INDEXES: dict[tuple[str, str], postings.Postings] = {}


def stored_postings(spark: SparkSession, sf_dir: str) -> postings.Postings:
    """The indexes of the bench table, built and written once in a session."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _INDEXES:
        path = f"{shared_dir(spark)}/lodestone/postings-{uuid.uuid4().hex}"
        postings.Postings.build(views.bench_files(spark, sf_dir)).save(path)
        _INDEXES[at] = postings.Postings.load(spark, path)
    return _INDEXES[at]


def bench_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bench table as entities."""
    rows = views.bench_files(spark, sf_dir)
    raw = rows.select("name", F.col("lpath").alias("path"), "extension", "size", F.col("record_id").alias("file_id"), F.col("record_id").alias("collect_ord"))
    return model.entities(raw, "file")


def planned_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine over the bench table and its stored indexes."""
    return Engine([postings.Indexed("files", bench_entities(spark, sf_dir), stored_postings(spark, sf_dir))], now=NOW_MS)


def _planned(line: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = planned_engine(spark, sf_dir).candidates(compile_detailed(line).query)
        return found.select(F.col("file_id").alias("record_id"), "name")

    return run


#: A line for each way to plan, and what it keeps. Text is to be in the name, and so in the path.
PLANNED = {
    "s4_planned_extension": ("ext:pdf ra", "extension = 'pdf' AND contains(lname, 'ra')"),
    "s4_planned_prefix": ("prefix:qua", "starts_with(lname, 'qua')"),
    "s4_planned_trigram": ("cedar-123", "contains(lname, 'cedar-123')"),
    "s4_planned_nothing": ("zzqxjw", "contains(lname, 'zzqxjw')"),
    "s4_planned_linear": ("cedar", "contains(lname, 'cedar')"),
    "u2_planned_extension_and_path": (r"ext:pdf path:a\cedar", r"extension = 'pdf' AND contains(lpath, 'a\cedar')"),
    "u3_planned_intersection": ("prefix:cedar-1 path:-123 cedar-12", "starts_with(lname, 'cedar-1') AND contains(lpath, '-123') AND contains(lname, 'cedar-12')"),
}
for _name, (_line, _where) in PLANNED.items():
    register(_name, _planned(_line), f"WITH b AS ({views.bench_files_sql()}) SELECT record_id, name FROM b WHERE {_where}")
register(
    "u4_posting_union",
    lambda spark, d: stored_postings(spark, d).lookup_any(["pdf", ".ZIP", "none"]),
    f"WITH b AS ({views.bench_files_sql()}) SELECT DISTINCT record_id FROM b WHERE extension IN ('pdf', 'zip')",
)
register(
    "u5_posting_difference",
    lambda spark, d: stored_postings(spark, d).without(views.bench_files(spark, d).where("record_id % 3 = 0")).extension.groupBy("key").agg(F.count("*").alias("n")),
    f"WITH b AS ({views.bench_files_sql()}) SELECT extension AS key, count(*) AS n FROM b WHERE record_id % 3 <> 0 GROUP BY 1",
)


def r11_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trigram index after some records have got other names: how often each of its grams is kept."""
    files = views.bench_files(spark, sf_dir)
    renamed = files.where("record_id % 100 = 0").withColumn("lpath", F.concat(F.lit("c:\\new\\"), "lname"))
    after = stored_postings(spark, sf_dir).updated(renamed)
    return after.trigram.where(F.col("key").isin("new", "w\\c", "c:\\", "123")).groupBy("key").agg(F.count("*").alias("n"))


register(
    "r11_updated_postings",
    r11_updated,
    rf"""WITH b AS ({views.bench_files_sql()}), g AS (SELECT unnest(list_distinct(list_transform(range(1, length(lpath) - 1), lambda i: substr(lpath, i, 3)))) AS gram FROM b),
      s AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > greatest(512, (SELECT count(*) FROM b) // 50)),
      n AS (SELECT CASE WHEN record_id % 100 = 0 THEN concat('c:\new\', lname) ELSE lpath END AS p FROM b),
      h AS (SELECT unnest(list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)))) AS key FROM n)
      SELECT key, count(*) AS n FROM h WHERE key IN ('new', 'w\c', 'c:\', '123') AND key NOT IN (SELECT gram FROM s) GROUP BY key""",
)
register(
    "w1_candidate_cap",
    lambda spark, d: views.bench_files(spark, d).where(F.col("lname").contains("ar")).orderBy("record_id").limit(4000).select("record_id", "name"),
    f"WITH b AS ({views.bench_files_sql()}) SELECT record_id, name FROM b WHERE contains(lname, 'ar') ORDER BY record_id LIMIT 4000",
)

# Change data capture.


def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table before the log: drive C, a directory for each nation, and the documents, of which some are tombstones."""
    root = spark.sql("SELECT 1000001L AS file_id, CAST(NULL AS BIGINT) AS parent_id, 'C:\\\\' AS name, 'C' AS drive, true AS is_dir, true AS is_root, 0L AS size, 0L AS modified_ms, false AS is_deleted")
    dirs = source(spark, sf_dir, "nation").selectExpr(
        "CAST(2000000 + n_nationkey AS BIGINT) AS file_id", "1000001L AS parent_id", "n_name AS name", "'C' AS drive", "true AS is_dir", "false AS is_root", "0L AS size", "0L AS modified_ms", "false AS is_deleted"
    )
    docs = source(spark, sf_dir, "documents").selectExpr(
        "doc_id + 1 AS file_id", "2000000 + doc_id % 25 AS parent_id", "concat('doc-', doc_id) AS name", "'C' AS drive", "false AS is_dir", "false AS is_root",
        "n_chars AS size", "CAST(1700000000000 AS BIGINT) AS modified_ms", "doc_id % 11 = 0 AS is_deleted"
    )
    return root.union(dirs).union(docs)


CDC_SQL = rf"""f AS (SELECT 1000001 AS file_id, NULL AS parent_id, 'C:\' AS name, 'C' AS drive, true AS is_dir, true AS is_root, 0 AS size, 0 AS modified_ms, false AS is_deleted
  UNION ALL SELECT 2000000 + n_nationkey, 1000001, n_name, 'C', true, false, 0, 0, false FROM nation
  UNION ALL SELECT doc_id + 1, 2000000 + doc_id % 25, concat('doc-', doc_id), 'C', false, false, n_chars, 1700000000000, doc_id % 11 = 0 FROM documents),
m AS ({views.mutations_sql()}),
p AS (SELECT m.*, coalesce(d.file_id, CASE WHEN upper(m.drive) = 'C' THEN 1000001 END) AS parent_id FROM m LEFT JOIN f d ON m.parent_file_id = d.file_id AND d.is_dir),
k AS (SELECT p.*, coalesce(last_value(CASE WHEN op = 'create' THEN true WHEN op = 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY p.file_id ORDER BY usn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f.file_id IS NOT NULL) AS alive FROM p LEFT JOIN f ON p.file_id = f.file_id AND NOT f.is_deleted WHERE op <> 'create' OR p.parent_id IS NOT NULL),
x AS (SELECT *, count(*) FILTER (op = 'create') OVER (PARTITION BY file_id ORDER BY usn) AS life FROM k WHERE alive <> (op = 'create'))"""
register(
    "r2_apply_batch",
    lambda spark, d: journal.apply_batch(file_table(spark, d), views.mutations(spark, d)),
    f"""WITH {CDC_SQL}, l AS (SELECT file_id, life, arg_max(name, CASE WHEN op IN ('create', 'rename') THEN usn END) AS name,
      arg_max(size, CASE WHEN op = 'create' THEN usn END) AS born_size, arg_max(size, CASE WHEN op = 'metadata' AND size IS NOT NULL THEN usn END) AS size,
      arg_max(modified_ms, CASE WHEN op IN ('create', 'metadata') AND coalesce(modified_ms, 0) <> 0 THEN usn END) AS modified_ms,
      arg_max(parent_id, CASE WHEN op = 'create' THEN usn END) AS parent_id, upper(arg_max(drive, CASE WHEN op = 'create' THEN usn END)) AS drive,
      coalesce(arg_max(is_directory, CASE WHEN op = 'create' THEN usn END), false) AS is_dir, bool_or(op = 'delete') AS gone FROM x GROUP BY file_id, life)
    SELECT f.file_id, f.parent_id, coalesce(CASE WHEN NOT is_deleted THEN l.name END, f.name) AS name, f.drive, f.is_dir, f.is_root,
      coalesce(CASE WHEN NOT is_deleted AND NOT f.is_dir THEN l.size END, f.size) AS size,
      coalesce(CASE WHEN NOT is_deleted THEN l.modified_ms END, f.modified_ms) AS modified_ms, is_deleted OR coalesce(gone, false) AS is_deleted
    FROM f LEFT JOIN l ON f.file_id = l.file_id AND life = 0
    UNION ALL SELECT file_id, parent_id, name, drive, is_dir, false, CASE WHEN is_dir THEN 0 ELSE coalesce(size, born_size, 0) END, coalesce(modified_ms, 0), gone FROM l WHERE life > 0""",
)
register(
    "j6_parents",
    lambda spark, d: journal.happening(file_table(spark, d), views.mutations(spark, d)).where("op = 'create'").select("usn", "file_id", "parent_id", "name"),
    f"WITH {CDC_SQL} SELECT usn, file_id, parent_id, name FROM x WHERE op = 'create'",
)
register(
    "a10_apply_report",
    lambda spark, d: journal.report(file_table(spark, d), views.mutations(spark, d)),
    f"""WITH {CDC_SQL} SELECT m.op, (SELECT count(*) FROM x WHERE x.op = m.op) AS applied, count(*) - (SELECT count(*) FROM x WHERE x.op = m.op) AS skipped FROM m GROUP BY m.op""",
)
register(
    "r1_operations",
    lambda spark, d: source(spark, d, "events").select("event_id", journal.operation((F.col("event_id") * 2654435761) % 65536).alias("op")),
    """WITH r AS (SELECT event_id, CAST((event_id * 2654435761) % 65536 AS BIGINT) AS b FROM events) SELECT event_id, CASE WHEN b & 512 <> 0 THEN 'delete'
      WHEN b & 256 <> 0 THEN 'create' WHEN b & 8192 <> 0 THEN 'rename' WHEN b & 7 <> 0 THEN 'metadata' END AS op FROM r""",
)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of four journals, of which one is recreated now and then, one rolls over, and one is applied late."""
    return source(spark, sf_dir, "events").selectExpr(
        "concat('vol-', user_id % 4) AS volume_id", "event_id AS seq", "CASE WHEN user_id % 4 = 1 THEN event_id DIV 3000 ELSE 7 END AS journal_id",
        "CASE WHEN user_id % 4 = 2 THEN event_id * 9 - 40 ELSE 0 END AS first_usn",
        "CASE WHEN user_id % 4 = 3 AND event_id % 50 = 0 THEN event_id ELSE event_id * 9 END AS next_usn",
        "CASE WHEN user_id % 4 = 0 THEN event_id * 9 - 5 * (event_id % 3) WHEN user_id % 4 = 3 AND event_id % 50 = 0 THEN event_id ELSE event_id * 9 END AS applied_usn",
        "event_id % 1000 AS entries",
    )


READINGS_SQL = """r AS (SELECT concat('vol-', user_id % 4) AS volume_id, event_id AS seq, CASE WHEN user_id % 4 = 1 THEN event_id // 3000 ELSE 7 END AS journal_id,
  CASE WHEN user_id % 4 = 2 THEN event_id * 9 - 40 ELSE 0 END AS first_usn, CASE WHEN user_id % 4 = 3 AND event_id % 50 = 0 THEN event_id ELSE event_id * 9 END AS next_usn,
  CASE WHEN user_id % 4 = 0 THEN event_id * 9 - 5 * (event_id % 3) WHEN user_id % 4 = 3 AND event_id % 50 = 0 THEN event_id ELSE event_id * 9 END AS applied_usn, event_id % 1000 AS entries FROM events),
w AS (SELECT *, lag(applied_usn) OVER (PARTITION BY volume_id ORDER BY seq) AS was, lag(journal_id) OVER (PARTITION BY volume_id ORDER BY seq) AS was_id FROM r),
d AS (SELECT volume_id, seq, CASE WHEN was IS NULL THEN 'new-volume' WHEN was_id <> journal_id THEN 'journal-recreated' WHEN was < first_usn THEN 'journal-rolled-over'
  WHEN was > next_usn THEN 'cursor-ahead' ELSE '' END AS reason, was, next_usn, applied_usn, entries FROM w),
g AS (SELECT volume_id, seq, CASE WHEN reason <> '' THEN 'rebuild' WHEN was = next_usn THEN 'up-to-date' ELSE 'incremental' END AS decision, reason,
  CASE WHEN reason <> '' THEN 0 ELSE was END AS from_usn, CASE WHEN reason <> '' THEN 0 ELSE next_usn END AS to_usn,
  CASE WHEN applied_usn >= next_usn THEN 'healthy' ELSE 'catching-up' END AS status, greatest(0, next_usn - applied_usn) AS lag FROM d),
t AS (SELECT volume_id, count(*) AS readings, count(*) FILTER (decision = 'rebuild') AS rebuilds, arg_max(to_usn, seq) AS last_to, arg_max(status, seq) AS status,
  arg_max(lag, seq) AS lag, bool_and(status = 'healthy') AS all_healthy, CAST(coalesce(sum(to_usn - from_usn) FILTER (decision = 'incremental'), 0) AS BIGINT) AS mutations FROM g GROUP BY 1)"""
register("r3_decisions", lambda spark, d: journal.decisions(readings(spark, d)), f"WITH {READINGS_SQL} SELECT * FROM g")
register(
    "r12_changes",
    lambda spark, d: journal.changes(journal.decisions(readings(spark, d)), 9000),
    f"WITH {READINGS_SQL} SELECT * FROM g WHERE decision = 'incremental' AND to_usn > 9000 ORDER BY to_usn, volume_id LIMIT 500",
)
register(
    "r7_a11_journal_totals",
    lambda spark, d: journal.totals(journal.decisions(readings(spark, d))),
    f"WITH {READINGS_SQL} SELECT * FROM t",
)
register(
    "a11_registry",
    lambda spark, d: journal.registry(journal.totals(journal.decisions(readings(spark, d))), journal.entries(readings(spark, d))).withColumn("degraded", F.array_join("degraded", ",")),
    f"""WITH {READINGS_SQL}, n AS (SELECT volume_id, arg_max(entries, seq) AS entries FROM r GROUP BY 1) SELECT CAST(sum(entries) AS BIGINT) AS total_entries, bool_and(status = 'healthy') AS all_healthy,
      coalesce(string_agg(volume_id, ',' ORDER BY volume_id) FILTER (status <> 'healthy'), '') AS degraded FROM t JOIN n USING (volume_id)""",
)
register(
    "a12_supervisor",
    lambda spark, d: journal.supervisor(journal.totals(journal.decisions(readings(spark, d)))).withColumn("degraded", F.array_join("degraded", ",")),
    f"""WITH {READINGS_SQL} SELECT count(*) AS workers, count(*) > 0 AND bool_and(status = 'healthy') AS all_healthy,
      coalesce(string_agg(volume_id, ',' ORDER BY volume_id) FILTER (status <> 'healthy'), '') AS degraded, CAST(sum(mutations) AS BIGINT) AS total_mutations FROM t""",
)


def r3_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cursors' decisions from a stream of the same readings, kept in each volume's state."""
    import pandas as pd

    def per_volume(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, out = journal.fold_volume(key[0], None, rows)
        return pd.DataFrame(out, columns=journal.DECIDED)

    return readings(spark, sf_dir).groupBy("volume_id").applyInPandas(per_volume, journal.DECISIONS)


register("r3_decisions_folded", r3_stream, f"WITH {READINGS_SQL} SELECT * FROM g")

# Sources over recorded snapshots.


def s17_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services and their configuration, asked with a word: the configuration of others is not there."""
    raw = entities(spark, sf_dir, "e_svc").select("name", "svc_display_name", "svc_state", "pid", "collect_ord", "svc_start_type", "path")
    listed, config = raw.drop("svc_start_type", "path"), raw.select("name", "svc_start_type", F.lit("LocalSystem").alias("account"), "path")
    rows = recorded.services(listed, config).collect(compile_detailed("type:service svc1").query)
    return rows.select("id", "svc_state", "svc_start_type", "account", "path")


register(
    "s17_s18_services",
    s17_services,
    f"""{entities_sql("e_svc")}, h AS (SELECT *, contains(lname, 'svc1') OR contains(lower(coalesce(svc_display_name, '')), 'svc1') AS wanted FROM e)
      SELECT id, svc_state, CASE WHEN wanted THEN svc_start_type END AS svc_start_type, CASE WHEN wanted THEN 'LocalSystem' END AS account, CASE WHEN wanted THEN path END AS path FROM h""",
)


def s20_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as registered programs and as shortcuts in a menu, some too deep."""
    part = source(spark, sf_dir, "part")
    registered = part.where("p_partkey % 3 = 0").selectExpr(
        "concat(replace(p_name, ' ', '-'), '.exe') AS key", "CASE WHEN p_partkey % 9 = 0 THEN ' ' ELSE concat('C:\\\\bin\\\\', replace(p_name, ' ', '-'), '.exe') END AS target",
        "'C:\\\\bin' AS working_dir", "p_partkey AS collect_ord",
    )
    walked = part.selectExpr("concat('C:\\\\menu\\\\', repeat('x\\\\', CAST(p_partkey % 8 AS INT)), replace(p_name, ' ', '_'), '.LNK') AS path", "concat(replace(p_name, ' ', '_'), '.LNK') AS name", "false AS is_dir").distinct()
    apps = recorded.applications([recorded.app_paths(registered), recorded.start_menu(walked, "C:\\menu")]).collect(SearchQuery())
    return apps.select("name", "target", "app_source", "working_dir")


register(
    "s20_s21_catalogue",
    s20_catalogue,
    r"""WITH w AS (SELECT DISTINCT p_name, p_partkey % 8 AS depth FROM part), a AS (
      SELECT DISTINCT p_name, concat('C:\bin\', replace(p_name, ' ', '-'), '.exe') AS target, 'app-paths' AS app_source, 'C:\bin' AS working_dir FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 9 <> 0
      UNION ALL SELECT p_name, concat('C:\menu\', repeat('x\', CAST(depth AS INT)), replace(p_name, ' ', '_'), '.LNK'), 'start-menu',
        concat('C:\menu', repeat('\x', CAST(depth AS INT))) FROM w WHERE depth <= 5)
      SELECT array_to_string(list_transform(string_split(p_name, ' '), lambda t: concat(upper(t[1]), substr(t, 2))), ' ') AS name, target, app_source, working_dir FROM a""",
)


def s9_enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = path_tree(spark, sf_dir).where("id < 200 OR id >= 1000 OR id % 2 = 0")
    records = graph.selectExpr("id AS frn", "parent_id AS parent_frn", "name", "IF(id < 1000, 16, 32) AS attributes", "CAST(id * 1000 AS BIGINT) AS modified")
    return recorded.enumerated(records, "e").select("id", "entity_type", "path", "modified", "size")


register(
    "s9_enumerated",
    s9_enumerated,
    rf"""WITH RECURSIVE {TREE_SQL}, k AS (SELECT * FROM t WHERE id < 200 OR id >= 1000 OR id % 2 = 0), w AS (SELECT id, name AS path, 0 AS depth FROM k WHERE parent_id IS NULL
      UNION ALL SELECT k.id, concat(rtrim(w.path, '\'), '\', k.name), w.depth + 1 FROM k JOIN w ON k.parent_id = w.id)
      SELECT concat(CASE WHEN id < 1000 THEN 'dir:' ELSE 'file:' END, lower(path)) AS id, CASE WHEN id < 1000 THEN 'directory' ELSE 'file' END AS entity_type, path, id * 1000 AS modified, CAST(NULL AS BIGINT) AS size
      FROM w WHERE depth > 0""",
)
