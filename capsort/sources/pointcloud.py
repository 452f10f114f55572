"""PLY point clouds: 16-byte little-endian records, written in parts that a commit joins."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("a", "u1")])
CHUNK = 65_536


def header(n: int) -> str:
    colours = "".join(f"property uchar {c}\n" for c in ("red", "green", "blue", "alpha"))
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n" + "".join(f"property float {c}\n" for c in "xyz") + colours + "end_header\n"


def body(table: pa.Table | pa.RecordBatch) -> bytes:
    out = np.zeros(table.num_rows, RECORD)
    for name in RECORD.names:
        out[name] = table.column(name).to_numpy(zero_copy_only=False)
    return out.tobytes()


def packed(points: DataFrame) -> DataFrame:
    """(chunk) binary rows of at most CHUNK points each; distributed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([body(batch.slice(at, CHUNK))], pa.binary())], ["chunk"])

    return points.select(*RECORD.names).mapInArrow(run, "chunk binary")


def write(points: DataFrame, path: str) -> int:
    """One file: header, then chunks streamed to the driver one at a time; returns the number of points."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    n = points.count()
    with open(path + ".part", "wb") as f:
        f.write(header(n).encode())
        for row in packed(points).toLocalIterator():
            f.write(row.chunk)
    os.replace(path + ".part", path)
    return n


def read(data: bytes) -> np.ndarray:
    end = data.index(b"end_header\n") + len(b"end_header\n")
    return np.frombuffer(data[end:], RECORD)
