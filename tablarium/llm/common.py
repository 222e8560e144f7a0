"""Helpers shared by the training-text operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablarium.functions.text import no_spans, place

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of a batch that goes to Python.
ARROW_ROWS = 1000
#: Most rows that broadcast_if_small() sends to every executor; above, the join shuffles.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir. Where that is unset, a temporary one in local mode; else an error."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _path(spark: SparkSession, path: str):
    """The file system of path, and path, as Hadoop objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts lineage and survives lost executors.

    The table is deleted by discard(), or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() has returned and nothing reads any more.

    The driver's garbage is collected too, since Spark deletes the shuffle files of plans that are no longer referenced.
    """
    for t in tables:
        fs, p = _path(t.sparkSession, t._written)
        fs.delete(p, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def fresh(name: str, *others: str) -> str:
    """name, with underscores after it until no other name is like it."""
    taken = {o.lower() for o in others}
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df, which should be cheap to count, has at most max_rows rows. Else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow() in batches of ARROW_ROWS rows: texts are large, and a batch is held by the JVM and by Python.

    Lowers the session's spark.sql.execution.arrow.maxRecordsPerBatch if it is larger.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= ARROW_ROWS:
        df.sparkSession.conf.set(name, str(ARROW_ROWS))

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(released, schema)


def parts(texts: pa.Array, size: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Slices [s, e) of about `size` bytes of text; a longer text is alone."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(total)) + 1).tolist(), len(texts)]
    return zip(edges, edges[1:])


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay, unlike with lower()."""
    return F.translate(text, UPPER, LOWER)


def regex_spans(text: Column, pattern: str, gate: str | None = None) -> Column:
    """array<struct<s int, e int, m string>>: leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between the matches, by split(), give the offsets. pattern must not match the empty string.
    gate: a cheaper regex that finds something wherever pattern does.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(gate or pattern), place(found, F.split(text, pattern, -1))).otherwise(no_spans())


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of structs with s, kind and e."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))
