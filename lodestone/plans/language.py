"""Phrases, in English and Chinese, that compile to queries. Rules only; both languages give the same query."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lodestone.functions.clock import DAY_MS, format_duration
from lodestone.plans.query import Filter, SearchQuery, Sort, TimeBound

# The phrases that are understood, the extensions, and the languages that stand for one.
INTENTS = {
    "service": ("服务", "services", "service", "svc"),
    "process": ("正在运行", "正在执行", "运行中的", "运行中", "进程中", "进程的", "进程", "currently running", "processes",
                "process", "running", "live"),
    "window": ("窗口", "视窗", "title bar", "window"),
    "application": ("应用程序", "应用", "软件", "程序", "applications", "application", "apps", "app", "programs", "program"),
    "directory": ("文件夹", "资料夹", "目录", "folders", "folder", "directories", "directory", "dirs"),
}
FILE = ("文件", "档案", "files", "file")
RECENT = ("最近修改的", "最近更新的", "最近的", "最新的", "刚刚", "最近", "最新", "recently modified", "recently changed",
          "most recent", "recently", "recent", "latest", "newest")
MODIFIED = ("修改过的", "修改的", "修改", "更改过的", "更改的", "更改", "编辑过", "编辑", "更新过", "更新的", "更新", "modified",
            "changed", "edited", "updated", "touched")
TODAY = ("今天", "今日", "today")
YESTERDAY = ("昨天", "昨日", "yesterday")
THIS_WEEK = ("本周", "这周", "这个星期", "过去一周", "最近一周", "最近七天", "this week", "past week", "last week",
             "past 7 days", "last 7 days")
FILLERS = ("帮我找一下", "帮我找", "帮我", "我想找", "我想要", "我要", "请找", "查找", "搜索", "显示", "列出", "找到", "找一下",
           "找", "一下", "所有", "全部", "这个", "那个", "please find", "please", "look for", "search for", "where is",
           "show me", "show", "list", "find", "search", "open", "launch", "all", "the", "for", "me")
EXTENSIONS = ("7z", "bat", "bmp", "cpp", "cs", "css", "csv", "dart", "dll", "doc", "docx", "exe", "gif", "go", "hpp",
              "html", "ico", "ini", "java", "jpeg", "jpg", "js", "json", "jsx", "kt", "log", "lua", "md", "mkv",
              "mov", "mp3", "mp4", "pdf", "php", "png", "ppt", "pptx", "ps1", "py", "rar", "rb", "rs", "sh", "sql",
              "svg", "swift", "tar", "toml", "ts", "tsx", "txt", "vue", "wav", "webp", "xls", "xlsx", "xml", "yaml",
              "yml", "zip")
LANGUAGES = {
    "visual basic": "vb", "typescript": "ts", "javascript": "js", "powershell": "ps1", "markdown": "md", "golang": "go",
    "python": "py", "rust": "rs", "java": "java", "kotlin": "kt", "ruby": "rb", "yaml": "yml", "csharp": "cs", "c#": "cs",
    "c++": "cpp", "shell": "sh", "bash": "sh", "json": "json", "toml": "toml", "html": "html", "css": "css", "sql": "sql",
    "php": "php", "perl": "pl", "scala": "scala", "elixir": "ex", "haskell": "hs", "lua": "lua", "dart": "dart", "matlab": "m",
}
PAST = ("过去", "最近", "past", "last")
NOT_A_SERVICE = "服务器"
MOST_DAYS, WEEK = 3650, 7

_SPAN = r"\s*([0-9]+)\s*(天|日|days?|d)"


@dataclass(frozen=True)
class Compiled:
    query: SearchQuery
    matched: bool
    notes: tuple[str, ...]


def _free(before: str, after: str, phrase: str) -> bool:
    """Whether a phrase stands free between two characters: phrases that are not ASCII always do."""
    return not phrase.isascii() or not any(c.isascii() and c.isalnum() for c in (before[-1:], after[:1]))


def has(text: str, phrases: tuple[str, ...]) -> bool:
    return any(
        _free(text[: m.start()], text[m.end() :], p) for p in phrases for m in re.finditer(re.escape(p), text)
    )


def without(text: str, phrase: str) -> str:
    """The text with a space for each free occurrence. What is before the last occurrence, free or not, bounds none."""
    out, at = [], 0
    for m in re.finditer(re.escape(phrase), text):
        free = _free(text[at : m.start()], text[m.end() :], phrase)
        out.append(text[at : m.start()] + " " if free else text[at : m.end()])
        at = m.end()
    return "".join([*out, text[at:]])


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9+]+", text.lower())


def singular(word: str) -> str:
    if word.endswith("ies") and len(word) >= 5:
        return word[:-3] + "y"
    if word.endswith("es") and word[:-2] in EXTENSIONS:
        return word[:-2]
    return word[:-1] if word.endswith("s") and len(word) >= 3 else word


def extension_in(text: str, about_files: bool) -> str | None:
    """An extension that is named; a language's, if the query is about files."""
    singulars = [singular(w) for w in words(text)]
    named = next((w for w in singulars if w in EXTENSIONS), None)
    if named or not about_files:
        return named
    in_turn = [
        *(n for n in LANGUAGES if " " in n and n in text),
        *(w for w in singulars if w in LANGUAGES),
        *(n for n in LANGUAGES if " " not in n and not n.isalnum() and n in text),
    ]
    return LANGUAGES[in_turn[0]] if in_turn else None


def past_days(text: str) -> int | None:
    """N of past N days, by the first place of each marker in turn."""
    for marker in PAST:
        at = text.find(marker)
        m = re.compile(_SPAN).match(text, at + len(marker)) if at >= 0 else None
        if m and 0 < int(m[1]) <= MOST_DAYS:
            return int(m[1])
    return None


def without_past_days(text: str) -> str:
    for marker in PAST:
        at = text.find(marker)
        m = re.compile(_SPAN).match(text, at + len(marker)) if at >= 0 else None
        if m:
            text = f"{text[:at]} {text[m.end() :]}"
    return text


def compile_phrase(line: str) -> Compiled:
    low = line.strip().lower()
    if not low:
        return Compiled(SearchQuery(), False, ())
    notes: list[str] = []
    intents = [t for t, phrases in INTENTS.items() if has(low, phrases) and not (t == "service" and NOT_A_SERVICE in low)]
    types = intents[:1]
    notes += [f"intent: {'folder' if t == 'directory' else t}" for t in types]
    recent = has(low, RECENT)
    about_files = has(low, FILE) or has(low, INTENTS["directory"])

    filters: list[Filter] = []
    ext = extension_in(low, about_files)
    if ext:
        filters.append(Filter("ext", ext))
        notes.append(f"extension: {ext}")
    days = 1 if has(low, TODAY + YESTERDAY) else WEEK if has(low, THIS_WEEK) else past_days(low)
    if days is None and recent and has(low, MODIFIED):
        days = WEEK
    if days:
        filters.append(Filter("modified", TimeBound("within", days * DAY_MS)))
        notes.append(f"time: modified within {format_duration(days * DAY_MS)}")
    if not types and (ext or recent or about_files):
        types = ["file"]
        notes.append("intent: file")
    if recent:
        notes.append("sort: modified-desc")

    rest = without_past_days(low)
    for group in (*INTENTS.values(), FILE, RECENT, MODIFIED, TODAY, YESTERDAY, THIS_WEEK, FILLERS, ("的", "了")):
        for phrase in group:
            rest = without(rest, phrase)
    if ext:
        # Taking a word out keeps only the words of letters and digits.
        rest = " ".join(w for w in words(rest) if w not in (ext, ext + "s"))
        name = next((n for n, e in LANGUAGES.items() if e == ext), None)
        if name:
            rest = " ".join(w for w in words(without(rest, name)) if w not in name.split())
    text = " ".join(rest.split())
    matched = bool(types or filters or recent or text != " ".join(low.split()))
    sort = Sort("modified", "desc") if recent else None
    return Compiled(SearchQuery(text or None, tuple(types), tuple(filters), sort), matched, tuple(notes))
