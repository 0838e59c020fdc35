"""Shared helpers: tables, fresh column names, and lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no input column (in any case) has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests, bench) may have none: it then gets a scratch
    folder once.  On a cluster a missing setting is an error, because a
    machine-local folder would not be seen by the other executors."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: a
    lineage cut that survives the loss of any executor.  The schema is passed
    on, so an empty result is readable too."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files that no table refers to any
    more: it follows the driver's garbage collection, which may be far away.  The
    driver's heap gives back what it holds no longer, too."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def give_back() -> None:
    """Hand memory that a finished partition no longer holds back to the system:
    Python workers are used again, and the next stage's should not stand on top."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this kind of C library
        pass


def frugal(run):
    """``run`` (batches to batches), whose memory goes with its partition."""
    def whole(batches):
        yield from run(batches)
        give_back()
    return whole


class Remembered:
    """Bytes by text, made once while they fit in about ``most`` bytes; then all
    are forgotten and those in use made again."""

    def __init__(self, most: int, overhead: int = 200):
        self.most, self.overhead, self.size = most, overhead, 0
        self.values: dict[str, bytes] = {}

    def all(self, keys: list[str], make) -> Iterable[bytes]:
        """The values of ``keys``; ``make`` gives those of a set of new ones."""
        new = set(keys)
        if self.size > self.most:
            self.values, self.size = {}, 0
        if new := list(new.difference(self.values)):
            made = make(new)
            self.size += sum(map(len, made.values())) + sum(map(len, made)) + self.overhead * len(made)
            self.values.update(made)
        return map(self.values.__getitem__, keys)


def text_blocks(texts: pa.Array, limit: int = 1 << 20):
    """Cut an Arrow string array into runs ``(lo, hi)`` of at most ``limit``
    bytes (one text at least), so that temporary arrays stay small."""
    import numpy as np

    if len(texts) == 0:
        return
    sizes = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32,
                          count=len(texts) + texts.offset + 1)[texts.offset:]
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(sizes, sizes[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi
        lo = hi


def text_bytes(texts: pa.Array):
    """``(bytes, offsets)`` of an Arrow string array, nulls as empty texts."""
    import numpy as np
    import pyarrow.compute as pc

    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind, count=len(texts) + texts.offset + 1)[texts.offset:].astype(np.int64)
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]
