"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The white space of every word and line rule here: bytes.split() and bytes.strip() use the same set.
SPACE = "[\\x20\\x09-\\x0D]"


def released(batches: Iterator) -> Iterator:
    """The batches; behind the last, what the worker's allocators keep of them goes back to the system, as workers live on for other tasks."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names starting with those wanted that clash with none taken, whatever their case."""
    used, out = {x.lower() for x in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def q(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names: only(df, id="doc_id")."""
    return df.select(*[q(v).alias(k) for k, v in columns.items()])


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="attriq-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def with_python(df: DataFrame, schema: str, fn: Callable[[Iterator[tuple]], Iterator[dict[str, list]]], *cols: Column) -> DataFrame:
    """df with the columns of schema, made from cols by Arrow batches; other columns stay in the JVM.

    fn gets, for each batch, a tuple of lists (one per col) and yields {column: list} of the same length.
    Columns of df with the new names are replaced.
    """
    kind = StructType.fromDDL(schema)
    new = [f.name for f in kind]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in new}]
    (at,) = fresh([*df.columns, *new], "made")

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        return released(pd.DataFrame({n: pd.Series(out[n], dtype=object) for n in new}) for out in fn(tuple(s.tolist() for s in x) for x in batches))

    def run_one(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run((s,) for s in batches)

    udf = F.pandas_udf(run if len(cols) > 1 else run_one, kind)
    return df.withColumn(at, udf(*cols)).select(*map(q, kept), *[q(at).getField(n).alias(n) for n in new])


def map_arrow(df: DataFrame, schema: str, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict]], rows: int = 512) -> DataFrame:
    """df through fn, which gets {column: list} of at most `rows` rows and yields {column: list, array or Arrow array}."""
    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = to_arrow_schema(kind)

        def pieces() -> Iterator[dict[str, list]]:
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    part = b.slice(at, rows)
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}

        return released(pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in to], schema=to) for out in fn(pieces()))

    return df.mapInArrow(run, kind)


def with_arrow(df: DataFrame, schema: str, fn: Callable[[Iterator[tuple]], Iterator[dict[str, list]]], *cols: Column, rows: int = 256) -> DataFrame:
    """As with_python, for outputs as large as the texts: Python objects exist for `rows` rows at a time only.

    The other columns pass through Python as Arrow arrays and aren't unpacked.
    """
    kind = StructType.fromDDL(schema)
    new = [f.name for f in kind]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in new}]
    names = fresh([*df.columns, *new], *[f"input{i}" for i in range(len(cols))])
    ready = df.select(*map(q, kept), *[c.alias(n) for c, n in zip(cols, names, strict=True)])
    out_kind = StructType([*df.select(*map(q, kept)).schema, *kind])
    passed, given = len(kept), len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = to_arrow_schema(kind)
        current: list[pa.RecordBatch] = []

        def pieces() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    part = b.slice(at, rows)
                    current[:] = [part]
                    yield tuple(part.column(passed + i).to_pylist() for i in range(given))

        def made() -> Iterator[pa.RecordBatch]:
            for out in fn(pieces()):
                arrays = [*current[0].columns[:passed], *[pa.array(out[f.name], f.type) for f in to]]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *new])

        return released(made())

    return ready.mapInArrow(run, out_kind)
