"""Shared helpers: tables kept in the shared folder, Arrow batches cut to a byte bound, row numbers without one big
window, vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import checkpoint_dir

#: Arrow batches sent to Python hold at most this many rows and bytes, so that memory does not follow text length.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session (a smaller setting of the session stays)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key, None) or most)
        digits = "".join(c for c in now if c.isdigit())
        if not digits or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps read files instead of repeating the work,
    and every step sees the same rows even if executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The column of ``with_row``.
ROW = "__row"


def with_row(df: DataFrame) -> DataFrame:
    """``df`` stored once, each row with a number of its own in ``ROW``, so that equal rows can be told apart."""
    return stored(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text",
                 most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` text bytes (a single longer text makes its own batch)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        got = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        sizes[:] = got.fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def keep_rows(docs: DataFrame, keep, most: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` for whose texts ``keep`` (list of texts -> array of booleans) says so, all columns as they
    are; rows pass through Python in Arrow batches and are not shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, most=most):
            yield batch.filter(pa.array(np.asarray(keep(batch.column("text").to_pylist()), bool)))
    prepare(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def partitions_for(df: DataFrame, each: int = 64 << 20) -> int:
    """The session's shuffle partitions, or more where the optimizer's size of ``df`` asks for it (files: their bytes), so
    that a partition's share does not grow with the data. No job runs; without an estimate the session's number stays."""
    spark = df.sparkSession
    have = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(have, -(-size // each)) if size < 1 << 60 else have


def query_blocks(queries: DataFrame, most: int = BATCH_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the distinct ids of ``queries`` (vec_id, vector), each with its smallest vector, in blocks of
    about ``most`` bytes and one vector length. The blocks are dealt and written by tasks; the driver reads one at a
    time, when it is asked for."""
    spark = queries.sparkSession
    asked = (queries.where("vec_id is not null").groupBy("vec_id").agg(F.min("vector").alias("vector"))
             .withColumn("dim", F.size("vector")))
    asked = stored(asked, "queries")
    total = asked.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where("dim > 0")
    blocks = F.ceil(F.col("n") * F.col("dim") * 8 / F.lit(most))
    dealt = asked.join(total, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    path = scratch(spark, "query-blocks")
    dealt.repartition("dim", "block").select("dim", "block", "vec_id", "vector").write.partitionBy("dim", "block").parquet(path)
    schema = T.StructType([asked.schema["vec_id"], asked.schema["vector"], T.StructField("dim", T.IntegerType()),
                           T.StructField("block", T.IntegerType())])
    written = spark.read.schema(schema).parquet(path)
    for dim, block in sorted(tuple(r) for r in written.select("dim", "block").distinct().collect()):
        own = written.where((F.col("dim") == dim) & (F.col("block") == block)).select("vec_id", "vector").toArrow()
        vectors = own.column("vector").combine_chunks()
        yield own.column("vec_id").to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def gathered(spark: SparkSession, blocks: Iterator, candidates, schema: str) -> DataFrame:
    """The rows of ``candidates(broadcast block)`` for all ``blocks``, each written before its broadcast is destroyed and
    the next block is read."""
    path = scratch(spark, "candidates")
    spark.createDataFrame([], schema).write.parquet(path)
    for block in blocks:
        sent = spark.sparkContext.broadcast(block)
        candidates(sent).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(schema).parquet(path)


def held_out(column: str, modulus: int, remainder: int):
    """Whether crc32 of the id written as text leaves ``remainder``."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def numbered(df: DataFrame, keys: list[str], order: str, name: str, buckets: int | None = None) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within each value of ``keys``. Rows of a key are dealt into hash buckets of
    ``order`` (a column of distinct values), counted per bucket, and numbered inside their bucket after the rows of
    earlier buckets; no task holds a whole key."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(n)).cast("int"))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order)
    local = dealt.withColumn("_at", F.row_number().over(inner) - 1)
    return (local.join(offsets, [*keys, "_bucket"])
            .withColumn(name, (F.col("_before") + F.col("_at")).cast("long"))
            .drop("_bucket", "_at", "_before"))


# --- words of many texts as 64-bit keys, without a Python loop over words ------------------------------------------

#: Odd multiplier of the polynomial word hash (arithmetic modulo 2**64), and the mixing constants of its last step.
HASH_BASE = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_2)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(HASH_BASE, -1, 1 << 64)
        both = []
        for base in (HASH_BASE, inverse):
            out = np.ones(size, np.uint64)
            step, have = base, 1
            while have < size:
                out[have:2 * have] = out[:have] * np.uint64(step)
                step, have = step * step & (2 ** 64 - 1), 2 * have
            both.append(out)
        _powers[size] = (both[0], both[1])
    return _powers[size]


#: Bytes hashed at a time (a longer word is hashed whole).
HASH_CHUNK = 1 << 20


def word_keys(raw: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit keys of the words in a byte array; ``is_word`` marks the byte values words are made
    of. Equal words have equal keys, wherever they stand; different words differ but for 64-bit collisions."""
    starts, keys, at = [], [], 0
    while at < len(raw):
        to = min(len(raw), at + HASH_CHUNK)
        if to < len(raw):
            gaps = np.flatnonzero(~is_word[raw[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:  # one long word: up to its end
                rest = np.flatnonzero(~is_word[raw[to:]])
                to = to + int(rest[0]) if len(rest) else len(raw)
        s, k = _word_keys(raw[at:to], is_word)
        starts.append(s + at)
        keys.append(k)
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(keys)


def _word_keys(raw: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = is_word[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    keys = (total[ends] - total[starts]) * inverse[starts]
    return starts, mix64(keys + (ends - starts).astype(np.uint64) * np.uint64(MIX_2))
