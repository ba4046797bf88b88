"""Entities from the driver's tables: the same expressions in Spark and in DuckDB.

Each view is (table, {column: expression}); an expression is valid in both engines. Backslashes are chr(92).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone import model

#: 2024-02-01 UTC, the clock of the queries.
NOW_MS = 1_706_745_600_000

_DOC = "concat('doc-', doc_id, '.', lang)"
_MODIFIED = "1704067200000 + ((doc_id * 7919) % 43200) * 60000"
_STATE = ("running", "stopped", "start-pending", "stop-pending", "paused", "pause-pending", "continue-pending", "unknown")
_START = ("auto", "manual", "disabled", "boot", "system", "unknown")
_STEMS = ("atlas", "basil", "cedar", "delta", "ember", "fjord", "grove", "heron", "iris", "jade", "kiln", "lotus", "maple", "nova",
          "onyx", "pearl", "quartz", "raven", "sable", "tulip")
_EXTS = ("doc", "xls", "jpg", "mp3", "html", "css", "sql", "pdf", "zip", "ini", "bat", "iso")


def _pick(key: str, words) -> str:
    """The word with the number that the expression gives."""
    return "CASE " + " ".join(f"WHEN {key} = {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


VIEWS: dict[str, tuple[str, str, dict[str, str]]] = {
    "e_file": ("documents", "file", {
        "name": _DOC, "extension": "lang", "drive": "'C'",
        "path": f"concat('C:', chr(92), source, chr(92), lang, chr(92), {_DOC})",
        "size": "n_chars", "modified": _MODIFIED, "created": f"{_MODIFIED} - (doc_id % 1000) * 3600000",
        "file_id": "doc_id", "collect_ord": "doc_id",
    }),
    "e_dir": ("nation", "directory", {
        "name": "n_name", "path": "concat('E:', chr(92), 'region-', n_regionkey, chr(92), n_name)", "drive": "'E'",
        "modified": "1704067200000 + n_nationkey * CAST(86400000 AS BIGINT)", "file_id": "n_nationkey", "collect_ord": "n_nationkey",
    }),
    "e_proc": ("customer", "process", {
        "name": "concat(lower(c_mktsegment), '-', c_custkey, '.exe')",
        "path": "concat('D:', chr(92), 'bin', chr(92), lower(c_mktsegment), chr(92), lower(c_mktsegment), '-', c_custkey, '.exe')",
        "modified": "1704067200000 + c_custkey * 60000", "pid": "c_custkey",
        "memory_bytes": "CAST(floor(abs(c_acctbal) * 1024) AS BIGINT)", "thread_count": "CAST(c_custkey % 64 AS INT)",
        "username": "concat('CORP', chr(92), 'nation_', c_nationkey)", "collect_ord": "c_custkey",
    }),
    "e_app": ("part", "application", {
        "name": "p_name", "app_source": _pick("p_partkey % 4", ("app-paths", "start-menu", "windows-apps", "path")),
        "target": "concat('C:', chr(92), 'Program Files', chr(92), p_brand, chr(92), replace(p_name, ' ', '-'), '.exe')",
        "path": "concat('C:', chr(92), 'Program Files', chr(92), p_brand, chr(92), replace(p_name, ' ', '-'), '.exe')",
        "collect_ord": "p_partkey",
    }),
    "e_svc": ("supplier", "service", {
        "name": "concat('svc', s_suppkey)", "svc_display_name": "CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END",
        "svc_state": _pick("s_suppkey % 8", _STATE), "svc_start_type": _pick("s_suppkey % 6", _START),
        "path": "concat('C:', chr(92), 'svc', chr(92), 'svc', s_suppkey, '.exe')", "pid": "s_suppkey", "collect_ord": "s_suppkey",
    }),
    "e_win": ("pages", "window", {
        "name": "regexp_extract(html, '<title>([^<]*)</title>', 1)", "hwnd": "page_id", "pid": "page_id % 200",
        "visible": "page_id % 3 <> 0", "collect_ord": "page_id",
    }),
}

BENCH_FILE = {
    "record_id": "l_orderkey * 8 + l_linenumber",
    "stem": _pick("l_partkey % 20", _STEMS),
    "extension": _pick("l_suppkey % 12", _EXTS),
    "size": "CAST(floor(l_extendedprice) AS BIGINT) * 100",
}
M_LOG = {
    "usn": "event_id", "volume_id": "concat('vol-', user_id % 4)", "file_id": "user_id + 1",
    "parent_file_id": "CASE WHEN event_id % 4 = 3 THEN 0 ELSE 2000000 + event_id % 30 END",
    "drive": "CASE WHEN event_id % 5 = 0 THEN 'Z' ELSE 'c' END", "is_directory": "event_id % 6 = 0",
    "op": "CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'rename' WHEN 'view' THEN 'metadata' END",
    "name": "concat('file-', user_id, '-', event_id, '.txt')",
    "size": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 10 END",
    "modified_ms": "CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1704067200000 + event_id END",
}


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def entities(spark: SparkSession, sf_dir: str, *views: str) -> DataFrame:
    """The union of some of the views, all of them by default."""
    parts = []
    for v in views or VIEWS:
        table, kind, exprs = VIEWS[v]
        raw = source(spark, sf_dir, table).selectExpr(*(f"{e} AS {c}" for c, e in exprs.items()))
        parts.append(model.entities(raw, kind))
    return model.union(parts)


def bench_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file table of lineitem's size: record_id, name, lname, lpath, extension, size."""
    raw = source(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_returnflag", *(f"{e} AS {c}" for c, e in BENCH_FILE.items())
    )
    return raw.selectExpr(
        "record_id", "concat(stem, '-', l_orderkey, '-', l_linenumber, '.', extension) AS name",
        "concat(stem, '-', l_orderkey, '-', l_linenumber, '.', extension) AS lname",
        "concat('c:', chr(92), lower(l_returnflag), chr(92), stem, chr(92), stem, '-', l_orderkey, '-', l_linenumber, '.', extension) AS lpath",
        "extension", "size",
    )


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = source(spark, sf_dir, "events").selectExpr(*(f"{e} AS {c}" for c, e in M_LOG.items()))
    return raw.where("op IS NOT NULL")


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as selections of documents."""
    events = source(spark, sf_dir, "events").where("event_type = 'purchase'")
    files = entities(spark, sf_dir, "e_file").selectExpr("id AS entity_id", "file_id")
    return events.join(files, events["user_id"] == files["file_id"]).selectExpr(
        "entity_id", "event_type AS query", "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01', ts) AS ts_ms"
    )


# The same views as SQL text for DuckDB.

_KEYS = {"e_file": "path", "e_dir": "path", "e_proc": "pid", "e_app": "target", "e_svc": "name", "e_win": "hwnd"}
_PREFIX = {"e_file": "file:", "e_dir": "dir:", "e_proc": "process:", "e_app": "app:", "e_svc": "service:", "e_win": "window:"}


def entities_sql(*views: str) -> str:
    """A WITH clause that defines ``e``: the union of some of the views."""
    parts = []
    for v in views or VIEWS:
        table, kind, exprs = VIEWS[v]
        raw = f"SELECT {', '.join(f'{e} AS {c}' for c, e in exprs.items())} FROM {table}"
        cols = [f"'{kind}' AS entity_type"] + [
            f"CAST({c if c in exprs else 'NULL'} AS {t}) AS {c}" for c, t in model.COLUMNS.items() if c != "entity_type"
        ]
        parts.append(
            f"SELECT *, concat('{_PREFIX[v]}', lower(CAST({_KEYS[v]} AS VARCHAR))) AS id, "
            f"lower(name) AS lname, lower(path) AS lpath, {model.PROVIDER_ORDER[kind]} AS provider_ord FROM (SELECT {', '.join(cols)} FROM ({raw}))"
        )
    return "WITH e AS (" + " UNION ALL ".join(parts) + ")"


def mutations_sql() -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in M_LOG.items())} FROM events WHERE event_type <> 'purchase'"


def bench_files_sql() -> str:
    raw = f"SELECT l_orderkey, l_linenumber, l_returnflag, {', '.join(f'{e} AS {c}' for c, e in BENCH_FILE.items())} FROM lineitem"
    return (
        "SELECT record_id, concat(stem, '-', l_orderkey, '-', l_linenumber, '.', extension) AS name, "
        "concat(stem, '-', l_orderkey, '-', l_linenumber, '.', extension) AS lname, "
        "concat('c:', chr(92), lower(l_returnflag), chr(92), stem, chr(92), stem, '-', l_orderkey, '-', l_linenumber, '.', extension) AS lpath, "
        f"extension, size FROM ({raw})"
    )
