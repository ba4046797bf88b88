"""Binary journal buffers: a cursor of 8 bytes, then records of version 2. A broken record ends its buffer."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The layout of a record. Length, file and parent number, usn, time, reason, attributes, name's size and place.
HEADER = "<I4xQQqqI8xIHH"
FIRST, EPOCH_TICKS = 8, 116_444_736_000_000_000
DIRECTORY = 0x10

SCHEMA = "volume_id string, file_id long, parent_file_id long, usn long, modified_ms long, reason long, is_dir boolean, name string"


def parse(buffer: bytes) -> Iterator[tuple]:
    """file_id, parent_file_id, usn, modified_ms, reason, is_dir, name of each whole record."""
    at, header = FIRST, struct.calcsize(HEADER)
    while at + header <= len(buffer):
        length, file_id, parent, usn, ticks, reason, attributes, size, place = struct.unpack_from(HEADER, buffer, at)
        name = buffer[at + place : at + place + size]
        if length < header or len(name) < size or size % 2:
            return
        modified = (ticks - EPOCH_TICKS) // 10_000 if ticks else 0
        yield (_signed(file_id), _signed(parent), usn, modified, reason, bool(attributes & DIRECTORY), name.decode("utf-16-le", "replace"))
        at += length
        if at > len(buffer):
            return


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def decode(buffers: DataFrame) -> DataFrame:
    """buffers(volume_id, bytes) -> a row for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("volume_id", pa.string()), ("file_id", pa.int64()), ("parent_file_id", pa.int64()), ("usn", pa.int64()),
                            ("modified_ms", pa.int64()), ("reason", pa.int64()), ("is_dir", pa.bool_()), ("name", pa.string())])
        for batch in batches:
            rows = [(v, *r) for v, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in parse(b or b"")]
            cols = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return buffers.select("volume_id", "bytes").mapInArrow(run, SCHEMA)
