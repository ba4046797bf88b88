"""Secret scans: fixed patterns, and novelty measured with dictionary-primed zstandard.

The patterns (assign, access, hex) always report. Beside them, a candidate is a run of secret-like characters in sensitive
context: one of ``WORDS`` stands within ``REACH`` code points before or after it, or in it (what follows the word is the
candidate then). Its novelty is the bytes that it adds to the compressed size of the window it stands in, by a zstandard
compressor primed with a dictionary of code words, of the text before and after the window and of the identifiers there;
what is on trial is cut out of all. A known word, an identifier or a string that also stands outside sensitive context
costs next to nothing, an unknown word of the usual letters about half of its bytes; a string that costs ``LEAST_NEW``
bytes, and ``NOVEL`` for each of its own, is reported as ``novel``. Candidates that overlap a pattern's span are not
reported twice.

Windows have ``AROUND`` code points, and as many on either side make the dictionary; each window that holds candidates has
one, and texts take time in proportion to their length.

Defined results: a null or empty text has no spans; whole texts are scanned, however long; positions are code points,
ends exclusive. Only the columns named are read, so others may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make a context sensitive, and how far they reach.
WORDS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer",
         "authorization", "private key", "access key", "signature")
REACH = 64
CONTEXT = re.compile("|".join(map(re.escape, WORDS)), re.IGNORECASE | re.ASCII)
#: Runs of secret-like characters; what an edge of a run may have that is not its own.
RUN = re.compile(r"[A-Za-z0-9+/_.\-]+={0,2}")
EDGE_BEFORE, EDGE_AFTER = "+/_.-=", "+/_.-"
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,}")
#: Code points of a window of surroundings, and the novelty, in bytes for each byte and in all, that is reported.
AROUND, NOVEL, LEAST_NEW, LEVEL = 1024, 0.8, 10, 12
CODE_WORDS = (
    "import from return def class self None True False public static void private protected final string int float "
    "double boolean const let var function async await export default module require include define struct typedef "
    "namespace template typename virtual override interface implements extends package throws catch finally while "
    "for if else elif switch case break continue lambda yield with assert raise except try print println printf "
    "config settings environment variable value key name user username password passwd secret token api_key apikey "
    "access_key secret_key client_id client_secret authorization bearer credential connection string database host "
    "port localhost example test sample placeholder changeme your_password your_token your_api_key redacted none "
    "null undefined https http www com org net json xml yaml html utf-8 base64 sha256 md5 application content-type"
)

#: Plain words that are not in the dictionary: what letters cost where a window has few.
PREFACE = (
    "the quick answers of many people about their own work often depend on how much time they have had to think it over "
    "before someone asks them again and nobody likes being asked twice so a good listener waits"
)


class Surroundings:
    """A window and the dictionary of what is around it; measures what strings add to it."""

    def __init__(self, window: str, around: str):
        names = " ".join(dict.fromkeys(IDENTIFIER.findall(around)))
        raw = f"{around} {names} {CODE_WORDS}".encode("utf-8", "replace")
        primed = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_dict_id=False).compress
        # The window is compressed with the string, so that its letters, not just its words, are what is usual. Text without
        # repeats makes the letters of a short window usual, too.
        self.window = f"{PREFACE} {window} ".encode("utf-8", "replace")
        self.before = len(self.compress(self.window))

    def added(self, own: str) -> int:
        """Marginal compressed bytes of a string."""
        return len(self.compress(self.window + own.encode("utf-8", "replace"))) - self.before


_HEX_DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))


def may_have_hex(text: str) -> bool:
    """False only if no run of 24 hexadecimal digits is there: such a run covers an aligned block of 12 bytes."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return bool(_HEX_DIGIT[raw[: len(raw) // 12 * 12]].reshape(-1, 12).all(axis=1).any())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind's number, end) of the fixed patterns."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if may_have_hex(text):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs in sensitive context, by start; one pass over the text's words and runs."""
    words = [m.span() for m in CONTEXT.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    found = []
    for m in RUN.finditer(text):
        start, end = m.span()
        # The last word that begins before the run's end: in the run, before it, or none.
        last = bisect_left(starts, end) - 1
        if last >= 0 and ends[last] > start:
            start, near = min(ends[last], end), True
        else:
            near = last >= 0 and start - ends[last] <= REACH
        own = text[start:end]
        start += len(own) - len(own.lstrip(EDGE_BEFORE))
        end -= len(own) - len(own.rstrip(EDGE_AFTER))
        near = near or (last + 1 < len(words) and starts[last + 1] - end <= REACH)
        if near and end - start >= LEAST_NEW:
            found.append((start, end))
    return found


def without(text: str, spans: list[tuple[int, int]], begin: int, end: int) -> str:
    """text[begin:end] without what of the spans, which are in order, is in it."""
    out, at = [], begin
    for a, b in spans:
        out.append(text[at : max(at, min(a, end))])
        at = max(at, min(b, end))
    return " ".join(x for x in [*out, text[at:end]] if x)


def novel_spans(text: str, base: list[tuple[int, int, int]], novel: float = NOVEL) -> list[tuple[int, int, int]]:
    """Spans of candidates in sensitive context whose novelty is at least ``novel`` for each byte."""
    low = text.lower()
    if not any(w in low for w in WORDS):
        return []
    runs = candidates(text)
    taken: list[list[int]] = []
    for start, _, end in base:
        if taken and start <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], end)
        else:
            taken.append([start, end])
    tried = sorted([*runs, *map(tuple, taken)])
    found, at, first = [], 0, 0
    window, around = -1, None
    for start, end in runs:
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end:
            continue
        if start // AROUND != window:
            window = start // AROUND
            edges = [min(len(text), max(0, (window + k) * AROUND)) for k in (-1, 0, 1, 2)]
            while first < len(tried) and tried[first][1] <= edges[0]:
                first += 1
            cut = tried[first : bisect_left(tried, (edges[3],))]
            before, own, after = (without(text, cut, a, b) for a, b in zip(edges, edges[1:]))
            around = Surroundings(own, f"{before} {after}")
        own = text[start:end]
        size = len(own.encode("utf-8", "replace"))
        # A string has no more news than bytes; what a frame costs beyond that is the encoder's.
        new = min(size, around.added(own))
        if new >= LEAST_NEW and new >= novel * size:
            found.append((start, 3, end))
    return found


def scan(text: str | None) -> list[tuple[int, str, int]]:
    """All spans of a text as (start, kind, end), by start and then by kind as in KINDS."""
    text = text or ""
    base = base_spans(text)
    return [(s, KINDS[k], e) for s, k, e in sorted(base + novel_spans(text, base))]


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by ``[kind]``, of the first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: the id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans (kind:start:end, joined)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = scan(text.as_py())
                said = [(k, f"{k}:{s}:{e}") for s, k, e in spans]
                n = [sum(k == kind for k, _ in said) for kind in KINDS]
                digest = hashlib.sha256(",".join(x for k, x in said if k != "novel").encode()).hexdigest()
                rows.append((*n, digest, ",".join(x for _, x in said)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *made], [id_col, "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(
        run,
        f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string",
    )


def redact_secrets(df: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """df with each secret in the text replaced by its kind in brackets, and size_col, if there, by the new length.

    Null texts stay null. All columns stay, in their order.
    """
    names = df.columns
    at, size_at = names.index(text_col), names.index(size_col) if size_col in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, cols = [], [], batch.columns
            old = cols[size_at].to_pylist() if size_at >= 0 else []
            for i, text in enumerate(cols[at]):
                text = text.as_py()
                spans = scan(text)
                texts.append(redact(text, spans) if spans else text)
                if size_at >= 0:
                    sizes.append(len(texts[-1]) if spans else old[i])
            cols = list(cols)
            cols[at] = pa.array(texts, pa.string())
            if size_at >= 0:
                cols[size_at] = pa.array(sizes, cols[size_at].type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return df.mapInArrow(run, df.schema)
