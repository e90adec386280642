"""What several operators share: written tables, hashing of word windows, and rows packed by bucket."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

U = np.uint64

# Functions of this package travel to the executors by value, so that they needn't have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where it is unset, a new local one, but not on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="dieframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() cuts at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U, count=len(words))


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (murmur's finaliser), so that every bit depends on all."""
    h = h + U(salt)
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def rolling(h: np.ndarray, width: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each window of width words; order matters."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * U(seed | 1) + h[k : k + n]
        return mix(out, seed)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized(batches: Iterator[pa.RecordBatch], column: int, rows: int = 512, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of up to `rows` rows whose texts have together `most` bytes, or of one longer text."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(size, before + most, "right"))))
            yield batch.slice(at, end - at)
            at = end


def release() -> None:
    """Gives freed memory back to the machine. Worker processes live on from task to task and stage to stage, and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable) -> Callable:
    """A function over a task's batches that releases memory when it is through."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def released_group(run: Callable) -> Callable:
    """The same for a function over one group's table (or two)."""

    def one(*tables: pa.Table) -> pa.Table:
        out = run(*tables)
        release()
        return out

    return (lambda a: one(a)) if run.__code__.co_argcount == 1 else (lambda a, b: one(a, b))


def by_value(spark: SparkSession, value: object) -> Broadcast:
    """Broadcasts a pickle that holds the classes it needs, for executors without this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def pack(bucket: np.ndarray, owner: np.ndarray, values: dict[str, np.ndarray], of_owner: dict[str, np.ndarray] | None = None) -> dict[str, list]:
    """One row per bucket: the owners in it, how many values each has, and the values' bytes.

    owner is grouped (equal owners stand together); values are arrays of one fixed-size item per element.
    of_owner has what all elements of an owner share; it is kept once an owner.
    Rows of a few bytes each would cost more in row headers than in content; this keeps the same hash
    shuffle at a fraction of its bytes.
    """
    order = np.argsort(bucket, kind="stable")
    bucket, owner = bucket[order], owner[order]
    new = np.empty(len(bucket), bool)
    if len(bucket):
        new[0] = True
        new[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    count = np.diff(np.append(run, len(bucket))).astype(np.int32)
    first = np.flatnonzero(np.append(True, bucket[run][1:] != bucket[run][:-1])) if len(run) else np.empty(0, int)
    edge = np.append(first, len(run))
    item = np.append(run, len(bucket))
    owners = owner[run].astype(np.int64)
    values = {k: np.ascontiguousarray(v[order]) for k, v in values.items()}
    shared = {k: v[order][run] for k, v in (of_owner or {}).items()}
    out: dict[str, list] = {"bucket": bucket[run][first].astype(np.int32).tolist(), "owner": [], "n": []} | {k: [] for k in [*values, *shared]}
    for a, b in zip(edge[:-1], edge[1:]):
        out["owner"].append(owners[a:b].tobytes())
        out["n"].append(count[a:b].tobytes())
        for k, v in values.items():
            out[k].append(v[item[a] : item[b]].tobytes())
        for k, v in shared.items():
            out[k].append(v[a:b].tobytes())
    return out


def batch_of(rows: dict[str, list], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[k], kind) for k, kind in kinds.items()], names=[*kinds])


def packed_batch(rows: dict[str, list], *values: str) -> pa.RecordBatch:
    return batch_of(rows, bucket=pa.int32(), owner=pa.binary(), n=pa.binary(), **dict.fromkeys(values, pa.binary()))


def joined(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def unpack(t: pa.Table, kinds: dict[str, object]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The owner of each element, and the elements' values."""
    owner = np.repeat(joined(t["owner"], np.int64), joined(t["n"], np.int32))
    return owner, {k: joined(t[k], kind) for k, kind in kinds.items()}


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
