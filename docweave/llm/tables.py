"""Tables between stages: written where every executor can read them, broadcast only when small."""

from __future__ import annotations

import atexit
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast or sent to the driver at once; keys and counts take at most 40 bytes.
MAX_BROADCAST_ROWS = 1_000_000
#: Bytes of text that executor-side code looks at in one go; arrays over them take 50 times as much.
CHUNK_BYTES = 1_000_000

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of this session's own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def _remove(path: str) -> None:
    spark = _made.pop(path, None)
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the session has ended; the folder is the cluster's to clear
        pass


@atexit.register
def _remove_all() -> None:
    for path in list(_made):
        _remove(path)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """The same rows, written as Parquet into the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables made by cut() that no later plan reads."""
    for df in tables:
        for path in list(_made):
            if any(path.rpartition("/")[2] in f for f in df.inputFiles()[:1]):
                _remove(path)


def made() -> set[str]:
    """The tables that cut() has written and nothing has deleted."""
    return set(_made)


def release_since(before: set[str], *kept: DataFrame) -> None:
    """Delete the tables made since, but for those that are kept."""
    files = [f for df in kept for f in df.inputFiles()[:1]]
    for path in made() - before:
        if not any(path.rpartition("/")[2] in f for f in files):
            _remove(path)


def small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether a written table has few enough rows to be broadcast."""
    return df.limit(limit + 1).count() <= limit


def sized(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a table whose counted rows allow it; beyond, Spark shuffles both sides."""
    return F.broadcast(df) if small(df, limit) else df


def whole_id(docs: DataFrame, name: str):
    """A column of whole numbers as bigint; ids of other types have no order that results could follow."""
    kind = docs.schema[name].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise ValueError(f"{name} must be a column of whole numbers, not {kind}")
    return F.col(f"`{name}`").cast("bigint")


def chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK_BYTES):
    """Slices of a batch whose text column holds about ``most`` bytes each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        held = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, held + most, side="right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def trim() -> None:
    """Hand memory that a Python worker no longer uses back to the system: Spark keeps workers for later stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    release_heap = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release_heap:
        release_heap(0)


def map_text(df: DataFrame, text: str, keep: list[str], fields: str, work, also: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of every row, then those that ``work`` makes of the whole texts.

    ``work`` gets a string array and returns one Arrow array or list for each of ``fields`` (a
    DDL string); ``also`` names columns that it gets beside the texts. A result replaces a kept
    column of the same name.
    """
    from pyspark.sql import types as T

    made = T._parse_datatype_string(fields) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(fields)
    new = {f.name.lower() for f in made}
    keep = [c for c in keep if c.lower() not in new]
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in also])
    schema = T.StructType([*kept.schema.fields[: len(keep)], *made.fields])
    kept = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])  # mapInArrow takes dots in names for fields
    n, cut_at = len(keep), CHUNK_BYTES

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in chunks(batch, n, cut_at):
                out = work(*part.columns[n:])
                columns = [*part.columns[:n], *(x if isinstance(x, pa.Array) else pa.array(x, arrow.field(n + i).type) for i, x in enumerate(out))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                del out, columns
        trim()

    return kept.mapInArrow(run, schema)


def rewritten(df: DataFrame, text: str, change, by: str) -> DataFrame:
    """All rows with the texts that ``change(text, row[by])`` makes."""
    work = lambda texts, found: [[change(t, f) for t, f in zip(texts.to_pylist(), found.to_pylist(), strict=True)]]
    out = map_text(df, text, [c for c in df.columns if c != text], f"`{text}` string", work, also=(by,))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
