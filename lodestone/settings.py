"""Settings in a JSON file: what cannot be read is the default, and values out of range are brought into it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from lodestone.plans.query import DEFAULT_LIMIT, MOST_RESULTS
from lodestone.sources.walk import ENTRIES, LEAST_ENTRIES, MOST_ENTRIES

# The file's spelling of each setting.
KEYS = {"result_limit": "resultLimit", "fuzzy_matching": "fuzzyMatching", "usage_ranking": "usageRanking", "index_backend": "indexBackend",
        "indexed_drives": "indexedDrives", "max_index_entries": "maxIndexEntries", "include_directories": "includeDirectories"}
BACKENDS = ("auto", "scan", "journal")


@dataclass(frozen=True)
class Settings:
    result_limit: int = DEFAULT_LIMIT
    fuzzy_matching: bool = True
    usage_ranking: bool = True
    index_backend: str = "auto"
    indexed_drives: tuple[str, ...] = ()
    max_index_entries: int = ENTRIES
    include_directories: bool = True

    def normalised(self) -> Settings:
        drives = {d.upper() for d in self.indexed_drives if len(d) == 1 and d.isascii() and d.isalpha()}
        return replace(
            self,
            result_limit=max(1, min(MOST_RESULTS, self.result_limit)),
            max_index_entries=max(LEAST_ENTRIES, min(MOST_ENTRIES, self.max_index_entries)),
            indexed_drives=tuple(sorted(drives)),
            index_backend=self.index_backend if self.index_backend in BACKENDS else "auto",
        )

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        try:
            given = json.loads(Path(path).read_text())
            values = {f.name: given[KEYS[f.name]] for f in fields(cls) if KEYS[f.name] in given}
            if not all(isinstance(v, (list if f == "indexed_drives" else type(getattr(cls, f)))) for f, v in values.items()):
                return cls()
        except (OSError, ValueError, TypeError):
            return cls()
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}).normalised()

    def save(self, path: str | Path) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps({KEYS[k]: v for k, v in asdict(self).items()}, indent=2))


def choose_backend(wanted: str, journal_ready: bool) -> tuple[str, list[str]]:
    """scan or journal, and warnings: auto takes the journal where it can be read, journal fails where it cannot."""
    if wanted == "scan" or (wanted == "auto" and not journal_ready):
        return "scan", ["the journal cannot be read, so folders are walked"] if wanted == "auto" else []
    if not journal_ready:
        raise ValueError("the journal cannot be read")
    return "journal", []
