"""Byte-level text helpers and bounded samples shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F


BATCH_ROWS = 2048


def lean(spark: SparkSession) -> None:
    """Keeps Arrow batches small: what a Python worker holds follows from them, not from its partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader (the path may be in any store Spark knows)."""
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Gives a Python worker's free memory back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def utf8(values: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string column, without making Python strings."""
    return values.cast(pa.large_binary()).to_pylist()


def remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo `modulus`; the held-out rule of the scoring queries."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column.cast("string").cast("binary")) % F.lit(modulus)


def class_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    classes: Iterable | None,
    per_class: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = 20_000,
) -> tuple[list[tuple[str | None, object]], dict[object, int]]:
    """At most `per_class` labelled texts of each class, and how many labelled rows each class has.

    The rows are those least by a hash of their id (of documents that share an id, those least by a
    hash of their text), so the choice does not depend on partitioning. Ids under a hash threshold,
    about four times as many as wanted, are sorted on the driver; only the chosen ones (a number fixed
    by `per_class`) are broadcast; no text is shuffled. An id that is labelled twice takes its larger
    label; ids that several documents share give at most twice as many texts as were asked for.
    classes=None takes all classes there are; `most` bounds the rows of all classes together.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    counts = {r["_class"]: r["n"] for r in known.groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = sorted(counts) if classes is None else [c for c in classes if c in counts]
    per_class = min(per_class, max(1, most // max(1, len(wanted))))
    some = F.lit(False)
    for c in wanted:  # thins out what is sorted, four times the rows needed
        share = min(1.0, 4 * per_class / counts[c])
        some = some | ((F.col(label) == F.lit(c)) & (F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(1 << 24)) <= int(share * (1 << 24))))
    thin = known.where(some).groupBy(id_col).agg(F.max(label).alias("_class")).withColumn("_order", F.xxhash64(id_col, F.lit(17)))
    found, taken = [], dict.fromkeys(wanted, 0)
    for i, c, _ in sorted(map(tuple, thin.collect()), key=lambda r: (r[2], r[0])):
        if taken[c] < per_class:
            taken[c] += 1
            found.append((i, c))
    fields = [T.StructField(id_col, labels.schema[id_col].dataType), T.StructField("_class", labels.schema[label].dataType)]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(found, T.StructType(fields)))
    texts = docs.select(id_col, text_col).join(chosen, id_col).select(id_col, text_col, "_class")
    # sorted in a task; the driver gets batches of bytes, where collect() would merge the rows of every partition in its heap
    taken = texts.orderBy(id_col, F.xxhash64(text_col)).limit(2 * per_class * max(1, len(wanted))).toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in taken.columns), strict=True), key=lambda r: (r[0], r[1] or ""))
    return [(r[1], r[2]) for r in rows], counts
