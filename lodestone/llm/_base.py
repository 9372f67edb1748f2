"""What the training-data operators share: scratch tables, text batches, word hashes, bit filters."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into words at once.
CHUNK_BYTES = 2 << 20
#: Rows of text that go to a Python worker at once, where the session leaves Spark's default: buffers of that many whole texts
#: are held by the JVM and by the worker.
BATCH_ROWS = 4000
#: Words whose hash a worker remembers; the memory is emptied when it is full.
MEMO_WORDS = 400_000
#: How scratch tables are written. The local file system starts a process for each file's permissions and, with checksum files,
#: for three more; until it runs its own program such a process has all the memory of the JVM that started it. Nothing reads
#: success markers, and Parquet has checksums of its own. Other file systems ignore the names of the local one.
WRITTEN = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of this machine only where none is configured."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that its executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Written tables that cut lineage. A lost executor costs a read, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.options(**WRITTEN).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables. Shuffle files of the plans that wrote them go when the driver collects its garbage, which it is
        asked to do."""
        for name in names:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        gc.collect()  # of objects that stand for plans
        self.spark._jvm.System.gc()
        pa.default_memory_pool().release_unused()


def text_chunks(batches, max_bytes: int = CHUNK_BYTES):
    """(rows, their texts as UTF-8 bytes) in pieces of bounded size; a null text is empty."""
    for batch in batches:
        texts = batch.column("text")
        if not pa.types.is_binary(texts.type):
            texts = texts.cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
            yield batch.slice(at, to - at), [x or b"" for x in texts.slice(at, to - at).to_pylist()]
            at = to


#: Tables of random 64-bit numbers by place in a word and byte (tabulation hashing), and odd factors for words longer than
#: the tables, by how often they wrap.
_PLACES = 32
_RNG = np.random.default_rng(0x10DE57)
_TABLE = _RNG.integers(0, 1 << 64, _PLACES * 256, dtype=np.uint64, endpoint=False)
_WRAP = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64, endpoint=False) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def hashed_words(texts: list[bytes], lower: bool = False) -> list[np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of each UTF-8 text, with A-Z as a-z if lower."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    inside = np.flatnonzero(~space)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    if not len(inside):
        return [np.zeros(0, np.uint64) for _ in texts]
    first = np.empty(len(inside), bool)
    first[0] = True
    np.not_equal(inside[1:], inside[:-1] + 1, out=first[1:])
    starts = np.flatnonzero(first)
    size = np.diff(starts, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(starts, size)
    if size.max() <= _PLACES:
        value = _TABLE[(place << 8) + data[inside]]
    else:
        value = _TABLE[((place % _PLACES) << 8) + data[inside]] * np.where(place < _PLACES, np.uint64(1), _WRAP[place // _PLACES % 64] + (place // _PLACES // 64).astype(np.uint64) * np.uint64(2))
    found = mix(np.add.reduceat(value, starts) + size.astype(np.uint64))
    return np.split(found, np.searchsorted(inside[starts], ends[:-1]))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size words, order included."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at, done, out = 1, 0, None
    # doubling: hash of 2^k words from two hashes of 2^(k-1), joined as the binary digits of size ask
    level, width = mix(words + _STEP), 1
    while True:
        if size & width:
            part = level[done : done + n]
            out = part if out is None else mix(out * np.uint64(0xD1342543DE82EF95) + part + np.uint64(width))
            done += width
        if done == size:
            return out
        level = mix(level[:-width] * np.uint64(0xAF251AF3B0F025B5) + level[width:] + np.uint64(at))
        width, at = 2 * width, at + 1


#: Bits of a value that give way to its place where leftmost minima are sought, and values that are looked through at once.
_PLACE = np.uint64((1 << 26) - 1)
_AT_ONCE = 1 << 26


def leftmost_minima(values: np.ndarray, width: int, at_once: int = _AT_ONCE) -> np.ndarray:
    """Where the least value (its upper 38 bits) of each stretch of width values is, the leftmost of equals."""
    if len(values) > at_once:  # pieces that overlap, so that each stretch lies in one
        starts = range(0, len(values) - width + 1, at_once - width + 1)
        return np.concatenate([leftmost_minima(values[a : a + at_once], width, at_once) + a for a in starts])
    low = (values & ~_PLACE) | np.arange(len(values), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    return (low & _PLACE).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class BitFilter:
    """A Bloom filter of bounded size over 64-bit hashes. A wrong hit costs work, never a wrong result, so that a full
    filter is only slow. Its bits are gathered natively and at most max_bits of them reach the driver."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    @classmethod
    def build(cls, keys: DataFrame, column: str, n: int, max_bits: int = 1 << 27) -> BitFilter:
        size = 1 << 12
        while size < min(max_bits, 16 * n):
            size *= 2
        h = F.col(column)
        at = F.explode(F.array(*(F.expr(f"{e} & {size - 1}L") for e in (f"`{column}`", f"shiftrightunsigned(`{column}`, 32)"))))
        rows = (
            keys.where(h.isNotNull()).select(at.alias("at"))
            .groupBy(F.shiftright("at", 6).alias("slot"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("word"))
            .toArrow()  # as rows of Python the words of a large filter would take the driver's memory
        )
        bits = np.zeros(size // 64, np.int64)
        bits[rows["slot"].to_numpy()] = rows["word"].to_numpy()
        return cls(bits.view(np.uint64))

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for shift in (0, 32):
            at = (hashes >> np.uint64(shift)) & self.mask
            found &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return found


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
