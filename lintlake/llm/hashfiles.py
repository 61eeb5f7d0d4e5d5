"""Sorted hash arrays in the shared folder: written by Spark tasks, memory-mapped by workers.

A set is cut by the leading bits of its 64-bit keys into shards; a shard is one file of sorted keys and one
file for each value column. Nothing passes through the driver but the number of keys of each shard. In a
folder that is not a mounted file system the arrays are read shard by shard instead of being mapped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.plans.lineage import scratch_path


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def write_array(uri: str, array: np.ndarray) -> None:
    """Write one array whole or not at all, so that a retried task may write it again."""
    import os

    path = _local(uri)
    part = f"{uri}.{uuid.uuid4().hex}"
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        array.tofile(_local(part))
        os.replace(_local(part), path)
        return
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(part)
    system.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(where) as out:
        out.write(array.tobytes())
    system.move(where, fs.FileSystem.from_uri(uri)[1])


@lru_cache(maxsize=4096)
def _mapped(path: str, dtype: str) -> np.ndarray:
    return np.memmap(path, dtype, "r")


def read_array(uri: str, dtype: str) -> np.ndarray:
    path = _local(uri)
    if path is not None:
        return _mapped(path, dtype)
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(uri)
    with system.open_input_file(where) as source:
        return np.frombuffer(source.read(), dtype)


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


@dataclass
class HashFiles:
    uri: str
    bits: int
    sizes: dict[int, int]
    values: dict[str, str] = field(default_factory=dict)
    total: int = 0  # of what the reduction summed, if anything

    def count(self) -> int:
        return sum(self.sizes.values())

    def find(self, keys: np.ndarray, *names: str) -> tuple[np.ndarray, ...]:
        """Whether each key is there, and its values (0 where it is not)."""
        asked, back = np.unique(keys, return_inverse=True)
        there = np.zeros(len(asked), bool)
        got = [np.zeros(len(asked), self.values[n]) for n in names]
        shards = shard_of(asked, self.bits)
        bounds = np.searchsorted(shards, np.arange((1 << self.bits) + 1))
        for p in np.flatnonzero(np.diff(bounds)):
            if not self.sizes.get(int(p)):
                continue
            a, b = bounds[p], bounds[p + 1]
            have = read_array(f"{self.uri}/keys-{p}", "<u8")
            at = np.minimum(np.searchsorted(have, asked[a:b]), len(have) - 1)
            ok = have[at] == asked[a:b]
            there[a:b] = ok
            for n, out in zip(names, got):
                out[a:b][ok] = read_array(f"{self.uri}/{n}-{p}", self.values[n])[at[ok]]
        return (there[back], *(g[back] for g in got))


def pack(keys: np.ndarray, bits: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows ``(p, blob...)``: sorted keys and their columns, one row for each shard that has any.

    The first blob holds the keys as unsigned 64-bit integers.
    """
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    columns = [c[order] for c in columns]
    bounds = np.searchsorted(shard_of(keys, bits), np.arange((1 << bits) + 1))
    full = np.flatnonzero(np.diff(bounds))
    blobs = [
        pa.array([x[bounds[p] : bounds[p + 1]].tobytes() for p in full], pa.binary()) for x in (keys, *columns)
    ]
    yield pa.RecordBatch.from_arrays(
        [pa.array(full.astype(np.int32)), *blobs], ["p", *(f"b{k}" for k in range(len(blobs)))]
    )


def unpack(table: pa.Table, *dtypes: str) -> list[np.ndarray]:
    """The concatenated arrays of a shard's rows."""
    return [
        np.frombuffer(b"".join(table.column(f"b{k}").to_pylist()), d) for k, d in enumerate(dtypes)
    ]


def build(packed: DataFrame, bits: int, make, label: str, values: dict[str, str] | None = None) -> HashFiles:
    """Bring the packed rows of each shard together, let ``make(table) -> (keys, {name: values})`` reduce them, write.

    ``make`` may return a third item, a whole number, which is summed over the shards.
    """
    values = values or {}
    uri = scratch_path(packed.sparkSession, label)

    def reduce(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        keys, columns, *extra = make(table)
        if len(keys):
            write_array(f"{uri}/keys-{p}", keys.astype("<u8"))
            for name, kind in values.items():
                write_array(f"{uri}/{name}-{p}", columns[name].astype(kind))
        return pa.table({"p": pa.array([p], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "x": pa.array([int(extra[0]) if extra else 0], pa.int64())})

    rows = packed.groupBy("p").applyInArrow(reduce, "p int, n long, x long").collect()
    return HashFiles(uri, bits, {r.p: r.n for r in rows}, values, sum(r.x for r in rows))


def distinct_files(keys: DataFrame, bits: int, label: str) -> HashFiles:
    """The distinct non-null longs of a one-column frame as sorted files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pack(np.unique(batch.column(0).to_numpy().view(np.uint64)), bits)

    named = keys.select(F.col(keys.columns[0]).cast("long").alias("k")).where("k is not null")
    packed = named.mapInArrow(run, "p int, b0 binary")
    return build(packed, bits, lambda t: (np.unique(unpack(t, "<u8")[0]), {}), label)


def bits_for(df: DataFrame, per_partition: int = 4) -> int:
    """Shard bits so that shards number a few times the input's partitions, within bounds."""
    return int(min(16, max(3, np.ceil(np.log2(max(1, df.rdd.getNumPartitions() * per_partition))))))
