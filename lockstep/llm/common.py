"""Helpers that the text operators share: tables, intermediate storage, text normalisation."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir; a local one only where that is unset
    and all executors are in this machine's driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lockstep-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)

    atexit.register(lambda: _quiet(drop))
    return path


def _quiet(call) -> None:
    try:
        call()
    except Exception:  # noqa: BLE001  the driver is ending; nothing is left to clean with
        pass


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: it is computed once, and lost executors cost only their tasks."""
    return stored_at(df, label)[0]


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.  lower() does that for ASCII-only texts, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


KEY_BUCKETS, HOT_SHARE, SALTS = 1 << 16, 1000, 16


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """left joined with right on keys, which are unique in right.  The rows of left are counted by a hash of their keys, in
    KEY_BUCKETS buckets; those of buckets with more than 1 in HOT_SHARE of all rows (of which there are fewer than
    HOT_SHARE) are dealt over SALTS tasks by a hash of `spread`, and meet copies of right's rows there.  left must be cheap
    to read twice."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
    counts = left.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most KEY_BUCKETS rows
    total = sum(r.n for r in counts)
    hot = [r.bucket for r in counts if r.n * HOT_SHARE > total and r.n > SALTS]
    if not hot:
        return left.join(right, keys)
    dealt = F.when(bucket.isin(hot), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(bucket.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("_salt", dealt).join(right.withColumn("_salt", F.explode(copies)), [*keys, "_salt"]).drop("_salt")


def packed(df: DataFrame) -> DataFrame:
    """One struct column `row`, so that no column of df can clash with a name that an operator uses."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


ROWS, BYTES = 500, 4 << 20  # that a Python worker takes up at once


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most `rows` and about `size` bytes (or one row), whatever the batches that Spark sends.  What a
    worker has put aside goes back to the system at the end of the task, since workers are used again."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Memo:
    """What was learned of words, for a worker's life: at most twice `limit` bytes, in two generations, of which the older
    one goes."""

    def __init__(self, limit: int):
        self.limit, self.size = limit, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        """Starts a new generation if this one is full."""
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0

    def missing(self, words: set[str]) -> set[str]:
        """Those of the words that are not known; all others can be looked up in `new` until the next turn."""
        words = words - self.new.keys()
        known = words & self.old.keys()
        self.put((w, self.old[w]) for w in known)
        return words - known

    def put(self, pairs) -> None:
        new, before = self.new, len(self.new)
        for word, data in pairs:
            new[word] = data
            self.size += len(word) + len(data)
        self.size += 150 * (len(new) - before)  # the objects and their entry
