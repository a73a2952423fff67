"""Writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attriq.operators.metrics import stratified_gate
from attriq.operators.sets import submission, upsert
from attriq.sources import exists


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


# Names of a decision row's columns in files, in order.
RESULT_COLUMNS = {
    "record_id": "unass_record", "predicted": "predicted_author_id", "confidence": "confidence", "reasoning": "reasoning", "truth": "ground_truth_author_id", "num_candidates": "num_candidates", "subtype": "subtype",
    "strategy": "strategy", "top1_title_sim": "top1_title_sim", "top1_coauthor_count": "top1_coauthor_count", "top1_org_sim": "top1_org_sim", "top1_venue_sim": "top1_venue_sim", "estimated_prompt_tokens": "estimated_prompt_tokens",
}


def write_results(decisions: DataFrame, path: str) -> None:
    """Decision rows as quoted CSV under the names that files have."""
    write_csv(decisions.select(*[F.col(k).alias(v) for k, v in RESULT_COLUMNS.items()]), path)


def write_grid(cells: DataFrame, path: str) -> None:
    """The threshold grid: theta_a, theta_b, weighted_f1, in order."""
    out = cells.select((F.col("ia") / 100).alias("theta_a"), (F.col("ib") / 100).alias("theta_b"), F.round("wf1", 6).alias("weighted_f1"))
    out.orderBy("theta_a", "theta_b").coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a thousand rows at most


def write_stratified(arbitrated: DataFrame, path: str) -> None:
    """Accuracy of each subtype before and after the gate, largest first: subtype, n, acc_llm_only, acc_gated."""
    stratified_gate(arbitrated).orderBy(F.col("n").desc(), "subtype").coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # one row a subtype


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_store(path: str):
    """A foreachBatch sink: each batch is a partition of its own, so one that runs again after a failure replaces what it left."""

    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return save


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _move(spark: SparkSession, source: str, target: str) -> None:
    """An atomic rename that fails if the target is there."""
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(_path(spark, source), _path(spark, target), spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a table's published versions, oldest first."""
    files, folder = _files(spark, path), f"{path.rstrip('/')}/_versions"
    if not files.exists(_path(spark, folder)):
        return []
    return sorted(int(x.getPath().getName()) for x in files.listStatus(_path(spark, folder)) if x.getPath().getName().isdigit())


def last_version(spark: SparkSession, path: str) -> int | None:
    """The number of the table's last version; None if it has none."""
    found = _versions(spark, path)
    return found[-1] if found else None


def _pointed(spark: SparkSession, path: str, version: int) -> str:
    (row,) = spark.read.text(f"{path.rstrip('/')}/_versions/{version:012d}", wholetext=True).collect()
    return f"{path.rstrip('/')}/{row['value'].strip()}"


def replace(df: DataFrame, path: str) -> int:
    """Publishes df as the table's next version, whose number is returned; df may read the version before.

    The rows are written to a folder that nobody reads; then a pointer file that names the folder is moved
    to the next number. That move is atomic: before it readers see the old table, after it the new one, and
    of two writers of one number the second fails. Old versions stay for who reads them; see `drop_old`.
    """
    spark, name = df.sparkSession, f"_data-{uuid.uuid4().hex}"
    found = _versions(spark, path)
    number, root = (found[-1] + 1 if found else 0), path.rstrip("/")
    df.write.parquet(f"{root}/{name}")
    out = _files(spark, path).create(_path(spark, draft := f"{root}/_drafts/{uuid.uuid4().hex}"), True)
    out.write(bytearray(name.encode()))
    out.close()
    files = _files(spark, path)
    files.mkdirs(_path(spark, f"{root}/_versions"))
    _move(spark, draft, f"{root}/_versions/{number:012d}")
    return number


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table that path holds: its last version (or the one asked for), or, if it has none, the plain folder.

    A plain folder that `remove_records` was about to swap when it was lost is put in its place first.
    """
    if found := _versions(spark, path):
        return spark.read.parquet(_pointed(spark, path, found[-1] if version is None else version))
    _recover(spark, path)
    return spark.read.parquet(path)


def drop_old(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes all versions but the last `keep`, and what lost writers left; returns how many. Nobody may read or write them then."""
    files, root, found = _files(spark, path), path.rstrip("/"), _versions(spark, path)
    gone, held = found[: max(0, len(found) - max(keep, 1))], {_pointed(spark, path, n) for n in found[-max(keep, 1) :]}
    for n in gone:
        files.delete(_path(spark, f"{root}/_versions/{n:012d}"), False)
    for x in files.listStatus(_path(spark, root)):
        if (name := x.getPath().getName()).startswith("_data-") and f"{root}/{name}" not in held:
            files.delete(x.getPath(), True)
    return len(gone)


def upsert_table(spark: SparkSession, path: str, rows: DataFrame, key: str = "key", value: str = "vec") -> int:
    """The next version of a table of vectors: new rows win, a null value deletes; see `replace`."""
    return replace(upsert(current(spark, path), rows, key, value) if _versions(spark, path) else upsert(rows.limit(0), rows, key, value), path)


def _recover(spark: SparkSession, path: str) -> None:
    """Ends or undoes a swap that was cut short: a next table that is whole goes in, else the old one comes back."""
    files, root = _files(spark, path), path.rstrip("/")
    there = lambda p: files.exists(_path(spark, p))
    if not there(root):
        if there(f"{root}.next/_SUCCESS"):
            _move(spark, f"{root}.next", root)
        elif there(f"{root}.old"):
            _move(spark, f"{root}.old", root)
    files.delete(_path(spark, f"{root}.old"), True)
    files.delete(_path(spark, f"{root}.next"), True)


def remove_records(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """The table without the ids. A table of versions gets a next one.

    A plain folder is written anew beside it and swapped; whatever step is lost, `current` or the next call
    finds either the old table or the new one.
    """
    if _versions(spark, path):
        replace(current(spark, path).join(ids.select("record_id"), "record_id", "left_anti"), path)
        return
    _recover(spark, path)
    root = path.rstrip("/")
    spark.read.parquet(root).join(ids.select("record_id"), "record_id", "left_anti").write.parquet(f"{root}.next")
    _move(spark, root, f"{root}.old")
    _move(spark, f"{root}.next", root)
    _files(spark, root).delete(_path(spark, f"{root}.old"), True)


def write_if_absent(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """A stage table: written unless it is there."""
    if force or not exists(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_submission(decisions: DataFrame, path: str) -> None:
    submission(decisions).select(F.to_json(F.create_map("aid", "pubs")).alias("value")).write.mode("overwrite").text(path)
