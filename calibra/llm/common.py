"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_one_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables between jobs: the session's spark.checkpoint.dir.

    A folder of our own is made only where none is named and all runs on one machine (tests,
    notebooks); on a cluster that is an error."""
    sc = spark.sparkContext
    if named := sc._conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not _on_one_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="calibra-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while (name := "_" + name).lower() in taken:
            pass
        out.append(name)
        taken.add(name.lower())
    return out


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def binary_array(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary column whose row i is the bytes of data[starts[i]:starts[i+1]]."""
    offsets = (starts.astype(np.int64) * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def run_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the length at the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    cuts = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return np.concatenate([[0], cuts, [len(sorted_keys)]]).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for each pair."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(starts, np.int64) - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total, dtype=np.int64) + shift


class UnionFind:
    """Disjoint sets over 0..n-1; the smaller root stays."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        parent = self.parent
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        return True


def batches_of(rows: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterable[pa.RecordBatch]:
    """The same rows in slices whose texts hold about most_bytes at most (one row at least)."""
    for batch in rows:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes, dtype=np.int64), 0
        while begin < batch.num_rows:
            before = int(ends[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


def joined_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with a newline after each, start of each text)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])[:-1]


def encoded_runs(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(start of each run of marked bytes, code of its content, the different contents)."""
    edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))]).dictionary_encode()
    return starts, runs.indices.to_numpy(), runs.dictionary
