"""Small helpers that the corpus operators share: shared storage, lineage cuts, text expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the upper-case and lower-case letters that "lower-case A-Z" means.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what separates words (space, tab, line feed, vertical tab, form feed, carriage return).
WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode (tests) a new one if it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = known.rsplit("/", 1)[0] if known else "file://" + tempfile.mkdtemp(prefix="epochlake-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _folder_of_run(spark: SparkSession) -> str:
    """This application's own folder in the shared one; deleted when its JVM ends."""
    uri = f"{shared_folder(spark)}/epochlake-{spark.sparkContext.applicationId}"
    if uri not in _FOLDERS:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _FOLDERS.add(uri)
    return uri


_FOLDERS: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it goes when the application ends, or by ``discard``."""
    return f"{_folder_of_run(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, uri: str) -> None:
    """Delete what stands at a path of ``fresh_path`` once nothing reads it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def refuse_columns(given: list[str], taken: list[str]) -> None:
    """Raise if columns of the input have names that the result adds (in any case)."""
    clash = sorted({c.lower() for c in given} & {c.lower() for c in taken})
    if clash:
        raise ValueError(f"the result adds columns named {clash}; rename them in the input")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold at most ``rows`` rows, so that whole texts pass to Python in small pieces."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
