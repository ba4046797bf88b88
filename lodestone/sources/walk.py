"""A data source that walks folders: one partition a root, excluded folders pruned with all below them.

    spark.dataSource.register(WalkSource)
    spark.read.format("walk").option("roots", "/srv/a;/srv/b").load()
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Names, and parts of paths, of folders that are left out.
EXCLUDED_NAMES = ("$recycle.bin", "system volume information", "winsxs", "installer", "softwaredistribution", "windows.old",
                  "node_modules", ".git", ".svn", ".hg", "__pycache__", ".gradle", ".nuget", ".npm", "temp", "cache")
EXCLUDED_PARTS = ("\\appdata\\local\\temp", "\\.cargo\\registry", "\\.rustup\\toolchains", "\\windows\\servicing")
LEAST_ENTRIES, MOST_ENTRIES, ENTRIES = 1_000, 20_000_000, 1_000_000

SCHEMA = "path string, name string, is_dir boolean, size bigint, modified bigint, created bigint, truncated boolean"


def excluded(name: str, path: str, names: tuple[str, ...] = EXCLUDED_NAMES, parts: tuple[str, ...] = EXCLUDED_PARTS) -> bool:
    low = path.lower().replace("/", "\\")
    return name.lower() in names or any(p in low for p in parts)


def walk(root: str, most: int = ENTRIES, names: tuple[str, ...] = EXCLUDED_NAMES, follow: bool = False) -> Iterator[tuple]:
    """Rows of all below root, by path within a folder; links are not followed. The last row tells if entries were left."""
    n, stack = 0, [root]
    while stack:
        folder = stack.pop()
        try:
            found = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for entry in found:
            is_dir = entry.is_dir(follow_symlinks=follow)
            if is_dir and excluded(entry.name, entry.path, names):
                continue
            if n == most:
                yield None, None, None, None, None, None, True
                return
            try:
                stat = entry.stat(follow_symlinks=follow)
            except OSError:
                continue
            n += 1
            yield (entry.path, entry.name, is_dir, 0 if is_dir else stat.st_size,
                   int(stat.st_mtime * 1000) or None, int(stat.st_ctime * 1000) or None, False)
            if is_dir:
                stack.append(entry.path)


class WalkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options.get("roots", options.get("path", "")).split(";") if r]
        self.most = max(1, min(MOST_ENTRIES, int(options.get("maxentries", ENTRIES))))
        self.names = tuple(options["exclude"].lower().split(";")) if "exclude" in options else EXCLUDED_NAMES

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.roots]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from walk(partition.value, self.most, self.names)


class WalkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WalkReader(self.options)
