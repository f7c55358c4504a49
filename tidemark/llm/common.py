"""Shared plumbing: Arrow mapping over documents, table access, checkpoints."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(ddl: str | StructType) -> StructType:
    return ddl if isinstance(ddl, StructType) else _parse_datatype_string(ddl)


#: Rows and bytes handed to Python-side work at once; bounds what is alive in a worker.
SLICE_ROWS = 512
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


#: Partitions of a shuffle at most; beyond, partitions grow, are sorted with spills and streamed.
MOST_PARTS = 20_000


def parts(amount: int, each: int) -> int:
    """Partitions for an amount of rows or bytes of which a task is meant to take ``each``."""
    return int(min(MOST_PARTS, 1 + amount // each))


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that they need not have it installed."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    if sc.applicationId not in _SHIPPED and package.is_dir():
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = Path(folder) / f"{package.name}.zip"
        with zipfile.ZipFile(path, "w") as out:
            for f in sorted(package.rglob("*.py")):
                out.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


def _release() -> None:
    """Give freed memory back: a Python worker lives on through many tasks of many stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def arrow_map(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow with batches bounded in bytes, so that long texts do not pile up on either side.

    Where the session has no bound on Arrow batches it gets BATCH_BYTES; a bound that is set, in whatever
    unit, stays as it is. Results do not depend on it.
    """
    shipped(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(task, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches into parts of up to ``rows`` rows and SLICE_BYTES bytes, one row at least."""

    def halves(part):
        if part.num_rows > 1 and part.nbytes > SLICE_BYTES:
            half = part.num_rows // 2
            yield from halves(part.slice(0, half))
            yield from halves(part.slice(half))
        else:
            yield part

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from halves(batch.slice(at, rows))


def map_docs(
    docs: DataFrame,
    columns: list,
    fn: Callable[..., dict],
    ddl: str,
) -> DataFrame:
    """Narrow map: ``fn`` gets one Python list per column and returns a dict of output columns.

    Only ``columns`` leave the JVM, so other columns (clashing names included) are pruned at the scan.
    """
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = fn(*(c.to_pylist() for c in part.columns))
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, type=f.type) for f in arrow], schema=arrow
            )

    return arrow_map(docs.select(*columns), run, schema)


def rewrite_docs(docs: DataFrame, text_col: str, change: Callable[[list], list]) -> DataFrame:
    """Same rows and columns with ``text_col`` replaced by ``change`` of it; no shuffle."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            cols = list(part.columns)
            cols[at] = pa.array(change(cols[at].to_pylist()), cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return arrow_map(docs, run, docs.schema)


_LEAVING: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder for a table under the shared folder that the cluster names in spark.checkpoint.dir.

    All tables of an application lie in one folder, which the driver's JVM deletes when it ends. Where the
    setting is missing, a local master takes /tmp/checkpoints; a cluster has no shared folder then and raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    app = spark.sparkContext.applicationId
    top = f"{base.rstrip('/')}/tables/{app}"
    if top not in _LEAVING:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _LEAVING.add(top)
    return f"{top}/{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None, by: str | None = None) -> DataFrame:
    """Cut lineage: write the rows once as a table in the shared folder and read them back.

    Survives lost executors like checkpoint(), without computing a map-only plan twice. ``by`` names a
    column of few values that splits the table into folders, so that a filter on it reads its own alone.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by saved() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(id_col: str, modulus: int, remainder: int):
    """crc32 of the id as text; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))
