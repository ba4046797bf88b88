"""python -m lodestone TABLES QUERY...: searches the entities of a folder of tables. Exit 0: found, 1: nothing, 2: an error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lodestone.plans.compiler import compile_detailed
from lodestone.plans.engine import Table
from lodestone.plans.query import QueryError, Sort, parse_type
from lodestone.service import TOOL_FIELDS, SearchService


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("tables")
    parser.add_argument("query", nargs="+")
    parser.add_argument("--types", default="")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--sort")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--compile", action="store_true", help="print the canonical query and stop")
    parser.add_argument("--explain", action="store_true")
    args = parser.parse_args(argv)
    line = " ".join(args.query)
    if args.compile:
        print(compile_detailed(line).query.to_dsl())
        return 0
    types = tuple(filter(None, map(parse_type, filter(None, args.types.split(",")))))
    sort = Sort.parse(args.sort) if args.sort else None
    if (args.sort and not sort) or (args.types and not types):
        print("error: unknown sort or type", file=sys.stderr)
        return 2
    from lodestone.sources.views import NOW_MS, entities

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    service = SearchService(spark, [Table("tables", entities(spark, args.tables))], now=NOW_MS)
    try:
        if args.explain:
            print(service.explain(line))
            return 0
        got = service.search(line, types or None, args.limit, sort)
    except QueryError as e:
        print(f"error: {e.hint}\n       code: {e.code}", file=sys.stderr)
        return 2
    if args.json:
        rows = [{k: r[k] for k in TOOL_FIELDS} for r in got.results]
        print(json.dumps({"query": got.query, "compiled": got.compiled, "total": got.total, "truncated": got.truncated, "results": rows}, ensure_ascii=False))
    else:
        for r in got.results:
            print(f"{r['score']:7.1f}  {r['entity_type']:<11}  {r['display_name']}  {r['subtitle']}")
    return 0 if got.results else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
