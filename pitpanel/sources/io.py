"""Readers and sinks: typed CSV, folds in one scan, snapshots, prediction and report tables, manifests, guarded histories."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reports import aligned, checks, digest


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files of one call, below ``spark.checkpoint.dir``; where that is unset, a private one in local mode and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: files need a folder that all executors share")
        own = tempfile.mkdtemp(prefix="pitpanel-")
        atexit.register(shutil.rmtree, own, True)
        shared = f"file://{own}"
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    return path


def kept(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` written to a scratch folder and read back: what is read several times is computed once, and a lost executor costs nothing.

    With ``by`` (few values each) a filter on these columns reads the files of its own rows alone.
    """
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    made.kept_at = path
    return made


def release(*tables: DataFrame) -> None:
    """Deletes the files of tables that :func:`kept` made and nothing reads any more; others are left as they are."""
    for t in tables:
        if path := vars(t).get("kept_at"):
            held = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            held.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(held, True)


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the job that wrote them is done, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header (gzip by its ending), with a stated schema, empty cells as null; only ``columns`` are parsed."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def fill_text(df: DataFrame, value: str = "") -> DataFrame:
    """Missing text becomes ``value``; numbers stay null."""
    return df.na.fill(value, [c for c, t in df.dtypes if t == "string"])


def read_folds(spark: SparkSession, path: str, folds: Sequence[int] | None = None) -> DataFrame:
    """A table written by :func:`write_predictions`; folds that are not asked for are not read."""
    df = spark.read.parquet(path)
    return df.filter(F.col("fold").isin(*folds)) if folds is not None else df


def write_predictions(df: DataFrame, path: str, keys: Sequence[str] = ("fold",), files: int | None = None, by: str = "row_id", deal: bool = True, mode: str = "overwrite") -> None:
    """Parquet in a folder for each of ``keys``; rows of a key go to ``files`` tasks (by default as many as a shuffle has partitions), so none writes a fold alone.

    Without ``deal`` rows are written by the tasks that make them, for tables whose keys lie in many tasks anyway.
    """
    if not deal:
        return df.write.mode(mode).partitionBy(*keys).parquet(path)
    files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(by), F.lit(files))
    df.repartition(*keys, part).write.mode(mode).partitionBy(*keys).parquet(path)


def save_features(df: DataFrame, path: str, key: str = "row_id") -> None:
    """Features, target and record columns in one table, in files by ranges of the key: nothing is aligned by position."""
    df.repartitionByRange(key).write.mode("overwrite").parquet(path)


def load_features(spark: SparkSession, path: str, columns: Sequence[str], key: str = "row_id", label: str = "label", targets: DataFrame | None = None) -> DataFrame:
    """A table that :func:`save_features` wrote; refused if columns lack, keys repeat or are null, labels are not 0 and 1, or (with ``targets``) it has other records or labels than these."""
    df = spark.read.parquet(path)
    if missing := [c for c in (key, label, *columns) if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    found = checks(df, key, label)
    if targets is not None:
        found = found.unionByName(aligned(df, targets, key, label, columns))
    if bad := [r["check"] for r in found.filter("not ok").collect()]:  # six rows at most
        raise ValueError(f"the table fails: {', '.join(sorted(bad))}")
    return df


def write_report(df: DataFrame, path: str, digits: int = 6) -> None:
    """A small table as CSV with a header, doubles rounded."""
    rows = df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str, label: str = "label", **facts: object) -> None:
    """One JSON row: counts, rate, and what the caller states (a rule, a seed)."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("positives"), F.avg(label).alias("rate"))
    one.select("*", *[F.lit(v).alias(k) for k, v in facts.items()]).write.mode("overwrite").json(path)


class GuardedSnapshot:
    """A derived table that is reused only while its inputs are the same.

    Beside the table lies a manifest with the fingerprints of the inputs and of
    the table. ``load`` builds what is missing and refuses what does not match; ``by`` as in ``kept``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table, self.manifest = spark, f"{path}/table", f"{path}/manifest"

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.manifest + "/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    @staticmethod
    def _print(df: DataFrame) -> tuple[int, str | None]:
        r = digest(df).first()
        return r["n"], r["digest"]

    def load(self, build, inputs: Sequence[DataFrame], force: bool = False, by: Sequence[str] = ()) -> DataFrame:
        prints = [str(self._print(df)) for df in inputs]
        if force or not self._exists():
            build().write.mode("overwrite").partitionBy(*by).parquet(self.table)
            made = self.spark.read.parquet(self.table)
            row = [(prints, str(self._print(made)))]
            self.spark.createDataFrame(row, "inputs array<string>, content string").write.mode("overwrite").parquet(self.manifest)
            return made
        held = self.spark.read.parquet(self.manifest).first()
        made = self.spark.read.parquet(self.table)
        if held["inputs"] != prints:
            raise ValueError("the snapshot was built from other inputs")
        if held["content"] != str(self._print(made)):
            raise ValueError("the snapshot's content has changed")
        return made
