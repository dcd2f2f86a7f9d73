"""Small helpers the text operators share: written intermediate tables, word hashes, Arrow columns."""

from __future__ import annotations

import ctypes
import gc
import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayline.session import checkpoint_dir


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet in the shared checkpoint folder, and read back.

    Lineage ends there and every executor can read the files again after a loss. The folder
    is removed when the driver's JVM ends.
    """
    spark = frame.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/assayline-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(frame.schema).parquet(folder)


def shared(spark: SparkSession, value):
    """A broadcast of any value, classes of this folder among them; ``shared_value`` reads it in a task.

    Broadcasts are pickled by reference, so they travel as bytes that hold their classes too.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared_value(broadcast):
    return cloudpickle.loads(broadcast.value)


def lean(function):
    """The function for ``mapInArrow``, which gives unused memory back to the system when a task ends.

    Python workers are used again by the next stage; what one stage took would otherwise stay with them beside what the next takes.
    """
    def run(batches):
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: nothing to ask for

    return run


def keep_memory() -> None:
    """Freed arrays of up to 32 MB stay with the worker until its task ends (see ``lean``), instead of being mapped anew each time."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass  # another C library: nothing to ask for


def text_key(text: Column) -> Column:
    """64-bit hash of a text; tells rows apart that share an id, or have none, but not a text (null: -1)."""
    return F.when(text.isNull(), F.lit(-1)).otherwise(F.xxhash64(text))


def short_text_key(text: Column) -> Column:
    """``text_key`` in 32 bits (CRC32), where it travels with every anchor: two different texts of one id, or without an id, are taken
    for one with a chance of 2**-32 a pair."""
    return F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(-1))


def remainder(identifier: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(identifier.cast("string"), F.lit("")), "UTF-8")) % modulus


class Memo(dict):
    """A bounded memory of a function's results: emptied when it holds more than ``limit`` keys."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def hash64(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little")


def word_hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    """64-bit hashes of words."""
    memo.trim()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes (mod 2**64) of all windows of ``width`` values, by doubling; scrambled."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    block, size, done, result = values, 1, 0, None
    while True:
        if width & size:
            # put this block after what is already covered
            part = block[done:]
            if result is None:
                result = part
            else:
                n = min(len(result), len(part))
                result = result[:n] * np.uint64(pow(base, size, 1 << 64)) + part[:n]
            done += size
        size *= 2
        if size > width:
            break
        half = size // 2
        block = block[: len(block) - half] * np.uint64(pow(base, half, 1 << 64)) + block[half:]
    return mixed(result[: len(values) - width + 1])


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the bit-equal bigint column."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def texts(batch: pa.RecordBatch, name: str | int = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def portions(batches, name: str | int = "text", limit: int = 4 << 20):
    """The batches in slices of at most ``limit`` bytes of a string column each (or one longer row)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array per row."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    if flat.dtype == np.uint64:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))
