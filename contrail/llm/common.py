"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of whole texts that Python handles at a time.
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``sf_dir``, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once: a plain reference inside a lambda is computed for every element."""
    return F.transform(F.array(value), body)[0]


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small. The registered queries call this for their session; operators change no
    setting, and give the same for batches of any size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def bounded_batches(spark: SparkSession, size: str = "32m") -> None:
    """Bound Arrow batches by their bytes also: for queries over rows of some hundred kilobytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def with_small_batches(query):
    """``query(spark, ...)`` under :func:`small_batches`."""

    @wraps(query)
    def run(spark: SparkSession, *rest):
        small_batches(spark)
        return query(spark, *rest)

    return run


def slices(batches, rows: int = ARROW_ROWS):
    """Batches (pandas or Arrow) in parts of at most ``rows`` rows, whatever the session's batch size is."""
    for b in batches:
        for i in range(0, len(b), rows):
            yield b.iloc[i : i + rows].reset_index(drop=True) if hasattr(b, "iloc") else b.slice(i, rows)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name below ``spark.checkpoint.dir``, which driver and executors share.

    A session on one machine that names none gets a folder in /tmp; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir("/tmp/checkpoints/contrail")
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return f"{base.rstrip('/')}/contrail-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/contrail-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def held_out(doc_id: str | Column) -> Column:
    """True for rows that training must not see: crc32 of the id as text is a multiple of 5 (a null id counts as '')."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % 5 == 0


def uniform(*cols: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(rows: DataFrame, by: str, key: str, bound: int, seed: int = 0) -> DataFrame:
    """About ``bound`` rows of each value of ``by`` (all if there are fewer), chosen by a hash of ``key``.

    Only the values of ``by`` (classes, languages) and their counts reach the driver.
    """
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(by) == F.lit(value)) & (uniform(key, seed=seed) < min(1.0, bound / n)))
    return rows.where(keep)


_KEPT: dict = {}


def kept(name: object, make):
    """What ``make()`` gives, kept by a Python worker for its later tasks; a few such objects at most."""
    if name not in _KEPT:
        if len(_KEPT) >= 4:
            _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]
