"""Small pieces shared by the operators: Arrow batches in and out, checkpoints, label splits."""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are Python objects at one time inside a task.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as SQL text and DataFrame functions read it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def spare(columns: list[str]) -> str:
    """A prefix that no column's name begins with, for columns of an operator's own."""
    out = "__"
    while any(c.lower().startswith(out) for c in columns):
        out += "_"
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Short pieces of the incoming batches, so that few texts are Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Without one a temporary folder is
    set if all of Spark runs on this machine; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='colloquy-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, without its lineage. The garbage collection
    lets Spark delete the shuffle files that only the lineage needed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    _written.append((spark, path))
    if len(_written) == 1:
        atexit.register(_forget)
    for paths in getattr(_open, "scopes", ()):
        paths.append(path)
    return out


def cut_alone(make: Callable[[], DataFrame]) -> DataFrame:
    """cut(make()); all else that make wrote on its way with cut is deleted, so make must keep none of it for later."""
    scopes = _open.scopes = getattr(_open, "scopes", [])
    scopes.append(paths := [])
    try:
        out = cut(make())
    finally:
        scopes.pop()
    for path in paths:
        if path != out._written_at:
            _delete(out.sparkSession, path)
    return out


def collect_garbage(spark: SparkSession) -> None:
    """After a large shuffle that was cut off: Spark deletes its files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Deletes what cut(df) wrote; nothing may read it after."""
    _delete(df.sparkSession, df._written_at)


_written: list[tuple[SparkSession, str]] = []
#: In each thread: what was written in each cut_alone that has not ended.
_open = threading.local()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _forget() -> None:
    """At the end of the program, while its session still lives."""
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is None:
                return
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: nothing can be deleted through it
            return


def crc_mod(doc_id: int | None, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n if doc_id is not None else -1


def held_out_column(id_col: str, n: int, remainder: int):
    """True where crc32(id as text) mod n is the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n == remainder, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of unsigned 64-bit values (two multiply-and-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets, one more than lengths."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
