"""Shared pieces of the corpus operators: word patterns, tables in the shared folder, small SQL helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.sources.store import cut, intermediate, noted, shared_dir, sweep  # noqa: F401  (for the operators)

#: Fixed values of the operator contract: a word is a maximal run outside these separators.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def kept(df: DataFrame) -> DataFrame:
    """A small frame that is read more than once: held by the executors, recomputed where one is lost."""
    return df.persist()


def tidy_driver(spark: SparkSession) -> None:
    """Between the many jobs of an operator: plans that nobody refers to go, with their shuffle files and
    broadcasts, and the driver's heap and native memory shrink to what is left."""
    gc.collect()
    release()
    try:
        shrink_jvm(spark)
    except Py4JError:  # another virtual machine than HotSpot
        spark._jvm.System.gc()


def shrink_jvm(spark: SparkSession) -> None:
    """Collect the garbage of the driver's JVM and return the memory that is free then. By its usual settings
    G1 keeps up to 70 % of the heap free; they are lowered for this one collection and put back."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    beans, class_of = jvm.java.lang.management.ManagementFactory, jvm.java.lang.Class.forName

    def array(kind, *values):
        out = new_array(kind, len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    def call(kind, target, name, types, *values):  # by the public interface: the classes behind it are not exported
        method = class_of(kind).getMethod(name, array(jvm.java.lang.Class, *map(class_of, types)))
        return method.invoke(target, array(jvm.java.lang.Object, *values))

    text, diagnostic = "java.lang.String", "com.sun.management.HotSpotDiagnosticMXBean"
    bean = beans.getPlatformMXBean(class_of(diagnostic))
    read = lambda name: call("com.sun.management.VMOption", call(diagnostic, bean, "getVMOption", [text], name), "getValue", [])
    write = lambda name, value: call(diagnostic, bean, "setVMOption", [text, text], name, value)
    usual = [(name, read(name)) for name in ("MaxHeapFreeRatio", "MinHeapFreeRatio")]
    try:
        write("MinHeapFreeRatio", str(min(10, int(usual[1][1]))))  # the lesser one first: neither may pass the other
        write("MaxHeapFreeRatio", str(min(20, int(usual[0][1]))))
        jvm.System.gc()
    finally:
        for name, value in usual:
            write(name, value)
    call(
        "javax.management.MBeanServer", beans.getPlatformMBeanServer(), "invoke", ["javax.management.ObjectName", text, "[Ljava.lang.Object;", "[Ljava.lang.String;"],
        jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", None, None,
    )


def settled(df: DataFrame, name: str, rows_a_file: int = 500_000) -> DataFrame:
    """``cut`` for frames of small rows: computed at full width, written in as few files as its size asks for."""
    held = df.persist()
    spark, path = df.sparkSession, intermediate(df.sparkSession, name)
    held.coalesce(held.count() // rows_a_file + 1).write.parquet(path)
    held.unpersist()
    tidy_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def buckets_for(docs: DataFrame, text_col: str = "text", each: int = 32 << 20) -> int:
    """Groups to deal a table's texts into: about ``each`` bytes of text a group, at least one a shuffle partition."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return max(shuffle_partitions(docs.sparkSession), -(-total // each))


def row_key(df: DataFrame) -> Column:
    """64-bit hash of all columns of a row, nulls told from values; for rows whose ids repeat or are null."""
    names = [F.col(f"`{c}`") for c in df.columns]
    return F.xxhash64(*names, F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in names]))


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the frame does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, whatever the optimiser collapses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, counted without building them: starts of runs of non-separators."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def release() -> None:
    """Give freed memory back: a Python worker outlives its task and waits beside the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(task: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over Arrow batches that gives its memory back at the end."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def tidied(table: pa.Table) -> pa.Table:
    """The result of a group's work, after giving back what the work took."""
    release()
    return table
