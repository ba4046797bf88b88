"""Requests and answers of the search service as plain data, and frames to send them in.

A frame is a length of four bytes, a mark, a version, and the body as JSON; bodies have a greatest size.
"""

from __future__ import annotations

import json
import struct
from typing import BinaryIO

from lodestone.plans.query import parse_type
from lodestone.service import TOOL_FIELDS, SearchService
from lodestone.streaming import journal

VERSION, MARK, MOST_BYTES = 1, b"LDST", 8 << 20
HEADER = "<I4sH"


class FrameError(ValueError):
    pass


def frame(body: dict) -> bytes:
    raw = json.dumps(body, ensure_ascii=False).encode()
    if len(raw) > MOST_BYTES:
        raise FrameError("the body is too large")
    return struct.pack(HEADER, len(raw), MARK, VERSION) + raw


def read_frame(stream: BinaryIO) -> dict | None:
    """The next body, None at the end of the stream."""
    head = stream.read(struct.calcsize(HEADER))
    if not head:
        return None
    if len(head) < struct.calcsize(HEADER):
        raise FrameError("the stream ends in a frame")
    size, mark, version = struct.unpack(HEADER, head)
    if mark != MARK or version != VERSION:
        raise FrameError("not a frame of this version")
    if size > MOST_BYTES:
        raise FrameError("the body is too large")
    raw = stream.read(size)
    if len(raw) < size:
        raise FrameError("the stream ends in a frame")
    try:
        body = json.loads(raw)
    except ValueError as e:
        raise FrameError("the body is not JSON") from e
    if not isinstance(body, dict):
        raise FrameError("the body is not an object")
    return body


def _error(code: str, message: str) -> dict:
    return {"kind": "error", "code": code, "message": message}


def handle(service: SearchService, request: dict, decided=None) -> dict:
    """The answer to a request: hello, search, index-status, rebuild-volume or changes. decided: the journal's decisions."""
    kind = request.get("kind")
    if kind == "hello":
        if request.get("protocol_version") != VERSION:
            return _error("protocol-mismatch", f"this service speaks version {VERSION}")
        return {"kind": "hello", "protocol_version": VERSION, "providers": [p.name for p in service.providers]}
    if kind == "search":
        if not isinstance(request.get("query"), str):
            return _error("invalid-query", "query is a string")
        types = tuple(t for raw in request.get("types", ()) if (t := parse_type(str(raw))))
        got = service.search(request["query"], types or None, request.get("limit"))
        rows = [{k: r[k] for k in TOOL_FIELDS} for r in got.results]
        return {"kind": "search", "compiled": got.compiled, "total": got.total, "truncated": got.truncated, "warnings": got.warnings, "results": rows}
    if kind == "index-status":
        return {"kind": "index-status", "providers": [r.asDict() for r in service.status().collect()]}
    if kind == "rebuild-volume":
        try:
            return {"kind": "rebuild-volume", "entries": service.rebuild()}
        except ValueError as e:
            return _error("no-index", str(e))
    if kind == "changes":
        if decided is None:
            return _error("no-journal", "this service follows no journal")
        limit = max(1, min(500, int(request.get("limit", 500))))
        rows = journal.changes(decided, int(request.get("since_usn", 0)), limit).collect()
        return {"kind": "changes", "changes": [r.asDict() for r in rows]}
    return _error("unknown-request", "requests are hello, search, index-status, rebuild-volume and changes")


def serve(service: SearchService, requests: BinaryIO, answers: BinaryIO, decided=None) -> int:
    """Answers frames until the requests end; how many there were. A broken frame gets an error and ends it."""
    n = 0
    while True:
        try:
            request = read_frame(requests)
        except FrameError as e:
            answers.write(frame(_error("bad-frame", str(e))))
            return n
        if request is None:
            return n
        answers.write(frame(handle(service, request, decided)))
        n += 1
