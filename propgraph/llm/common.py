"""Small helpers that the operators share: reading tables, the shared folder, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch.  Texts are a few kB on average and up to some hundred kB, so this bounds a batch to some tens of MB.
BATCH_ROWS = 256


_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """What the operators need of a session: small Arrow batches, as rows hold whole texts, and this package on the workers' path."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="propgraph-")) / "propgraph-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))  # the driver serves it to every executor, later ones too
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, on a local master only) a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="propgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared folder, which outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet into the shared folder and read again, and where."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: column pruning still works on what is kept."""
    return stored_at(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete what `stored_at` wrote, once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Words of 64 bits that a sieve of ids may have, whatever their number: a broadcast of a few MB.
SIEVE_WORDS = 1 << 17


def _sieved(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """df plus `flag`: false where the key is not among ids for sure.  ids: one column."""
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(SIEVE_WORDS * 64))
    spots = ids.select(place(F.col(ids.columns[0])).alias("spot"))
    bit = F.expr("shiftleft(1L, cast(spot & 63 AS int))")
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    spot, word, bits = (unused(df, x) for x in ("spot", "word", "bits"))
    words = words.select(F.col("word").alias(word), F.col("bits").alias(bits))
    at = df.withColumn(spot, place(df[f"`{key}`"])).withColumn(word, F.shiftright(spot, 6))
    hit = F.coalesce(F.expr(f"(`{bits}` & shiftleft(1L, cast(`{spot}` & 63 AS int))) <> 0"), F.lit(False)) & df[f"`{key}`"].isNotNull()
    return at.join(F.broadcast(words), word, "left").select(*(df[f"`{c}`"] for c in df.columns), hit.alias(flag))


def among(df: DataFrame, ids: DataFrame, key: str, change: Callable[[DataFrame], DataFrame], changed_key: str) -> DataFrame:
    """change(df) of the rows whose key is in ids.  A sieve of bounded size takes out most others before anything is changed or shuffled."""
    flag = unused(df, "maybe")
    rows = change(_sieved(df, ids, key, flag).where(flag).drop(flag))
    return rows.join(ids.withColumnRenamed(ids.columns[0], changed_key), changed_key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df's rows whose key is not in ids; those of null key stay.  Only rows that a sieve of bounded size holds back are shuffled."""
    flag = unused(df, "maybe")
    told = _sieved(df, ids, key, flag)
    rest = told.where(flag).drop(flag)
    gone = ids.select(F.col(ids.columns[0]).alias(unused(df, "gone")))
    return told.where(~F.col(flag)).drop(flag).unionByName(rest.join(gone, rest[f"`{key}`"] == gone[gone.columns[0]], "left_anti"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}_{k}" for k in range(1, len(taken) + 2))) if x not in taken)


def whole_text(col: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def rebatched(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in order, `rows` or a little more at a time: for narrow rows, as batches are made for whole texts."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(b.num_rows for b in some) >= rows:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some = []
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()
