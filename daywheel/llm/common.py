"""Helpers shared by the operators: checked broadcasts, shared folders, packed columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20

#: ASCII white space: the separators of `[^\x20\x09-\x0D]+`.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the context's checkpoint folder; a local one in local mode only."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = "file://" + tempfile.gettempdir() + "/daywheel-shared"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that fresh_path named, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage so that a lost executor costs no recomputation.

    A checkpoint hands on the estimated size of its plan, which joins multiply: over the rounds of an iteration that
    becomes a number of millions of digits, and planning takes minutes. So the rows are taken up without the estimate.
    """
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def tidy() -> None:
    """Give freed memory of this Python process back to the system, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now rather than at some later garbage collection."""
    tidy()
    spark.sparkContext._jvm.System.gc()


def fewer(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """df of about `rows` rows in no more partitions than these are worth: every task of a shuffle leaves files, however few its rows."""
    return df.coalesce(max(1, -(-rows // per_task)))


def row_bytes(df: DataFrame) -> Column:
    """The bytes of a row as its columns say: texts and arrays by their real lengths, other values 16 each."""

    def width(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = 16 + F.octet_length(c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            size = 16 + F.aggregate(c, F.lit(0).cast("bigint"), lambda total, x: total + width(x, kind.elementType).cast("bigint"))
        elif isinstance(kind, T.ArrayType):
            size = 16 + 8 * F.size(c)
        elif isinstance(kind, T.StructType):
            size = sum((width(c[f.name], f.dataType) for f in kind.fields), F.lit(16))
        else:
            size = F.lit(16)
        return F.greatest(size, F.lit(16))  # null: 16

    return sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("bigint")


def small_side(df: DataFrame, width: int | Column | None = None) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if its size is under BROADCAST_BYTES, else df as it is. df should be cut() before.

    width: the bytes of each row, where all columns are numbers; None measures every row (row_bytes).
    """
    size = F.count("*") * width if isinstance(width, int) else F.sum(row_bytes(df) if width is None else width)
    small = (df.agg(size.alias("size")).first()["size"] or 0) <= BROADCAST_BYTES
    return (F.broadcast(df) if small else df), small


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 32) -> DataFrame:
    """left join on a null-safe key for a right side too large to broadcast: hot keys of left are dealt over `salts` tasks.

    Columns of the join's own start with `__sj_`.
    """
    left = left.withColumn("__sj_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = right.withColumnRenamed(key, "__sj_key").withColumn("__sj_deal", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = left[key].eqNullSafe(right["__sj_key"]) & (left["__sj_salt"] == right["__sj_deal"])
    return left.join(right, on, "left").drop("__sj_salt", "__sj_deal", "__sj_key")


#: Rows of an Arrow batch of texts: at 10,000 rows a batch of long texts would take hundreds of MB on both sides.
TEXT_ROWS = 512


def text_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to TEXT_ROWS rows from now on in this session, unless it asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once per row (an expression that is only named would be copied into every use)."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in text; null: 0."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WORD_SPLIT))).cast("long")
