"""Helpers shared by the corpus operators: tables, scratch storage, text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage.
SPACE = r"\x20\x09-\x0D"
#: A column that operators add beside the caller's for a while.
OWN = "_orrery_own"
#: Texts in a batch that goes to Python.
TEXTS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a temporary folder
    serves a local session; on a cluster its absence is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="orrery-")
    return _local[sc.applicationId]


def prepare(spark: SparkSession) -> SparkSession:
    """Set up a session for long texts; the queries and the pipeline's stages call it for
    the session they are given, the operators never change a session's settings.

    Texts go to Python in batches of few rows, as Spark's Arrow writer and the worker both
    hold a batch. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXTS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(TEXTS))
    return spark


def trim() -> None:
    """Give memory that arrays have left back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def saved(df: DataFrame, name: str, *spent: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that no
    lost executor can make it be computed again. ``spent`` are tables that ``saved``
    made and that nothing reads any more once this one is written; they are deleted."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    for one in spent:
        discard(one)
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``saved`` wrote; only for tables that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id written in decimal; null ids have none."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def ranges(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of positions whose sizes come to about ``most`` together."""
    start, total = 0, 0
    for k, size in enumerate(sizes):
        total += size
        if total >= most:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def text_chunks(texts: list, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch whose texts hold about ``most`` characters together, so that
    memory is bounded by that and the longest text, not by the batch."""
    return ranges([len((t["text"] if isinstance(t, dict) else t) or "") for t in texts], most)


def map_texts(df: DataFrame, keep: list[str], made: str, work: Callable, text: str = "text") -> DataFrame:
    """``keep`` columns as they are (ids stay exact) beside the columns ``made``.

    ``work(texts)`` returns the arrays of ``made``, one entry a text; or, for any number
    of rows a text, a pair of the texts' positions and those arrays."""
    names = [*keep, *(x.split()[0] for x in made.split(", "))]
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in text_chunks(texts):
                got = work(texts[a:b])
                cut = [batch.column(k).slice(a, b - a) for k in keep]
                if isinstance(got, tuple):
                    rows, got = pa.array(got[0], pa.int64()), got[1]
                    cut = [x.take(rows) for x in cut]
                yield pa.RecordBatch.from_arrays([*cut, *(pa.array(x) for x in got)], names=names)
        trim()

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
