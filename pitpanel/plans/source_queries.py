"""Queries that write tables with the sinks, read them back and return what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import metrics as M
from ..operators import reports as R
from ..operators import splits
from ..sources import io
from ..sources.fixtures import PANEL, SCORED, panel, scored_long
from .panel_queries import _ENTITY, _sql_any, rounded
from .registry import query
from .scored_queries import _topk

_SCHEMA = "row_id long, entity long, side string, period int, ym_index int, label int, amount double"


def _csv(spark, d, **options):
    path = io.scratch(spark, "csv")
    panel(spark, d).write.options(header=True, **options).csv(path)
    return path


@query(f"WITH {PANEL} SELECT row_id, entity, side, period, ym_index, label, round(amount, 6) AS amount FROM panel")
def csv_scan(spark, d):
    """The panel as typed CSV."""
    return rounded(io.read_csv(spark, _csv(spark, d), _SCHEMA))


@query(f"WITH {PANEL} SELECT row_id, label FROM panel")
def gzip_projection(spark, d):
    """Two columns of the panel as compressed CSV; the others are not parsed."""
    return io.read_csv(spark, _csv(spark, d, compression="gzip"), _SCHEMA, ["row_id", "label"])


_SOME = f"{_ENTITY}, s AS (SELECT row_id, entity, CAST(fold AS INT) AS fold FROM g)"


@query(f"WITH {PANEL}{_SOME} SELECT * FROM s WHERE fold IN (2, 4)")
def folds_scan(spark, d):
    """Two folds of a table that lies in a folder for each fold; the other folders are not read."""
    path = io.scratch(spark, "folds")
    io.write_predictions(splits.grouped(panel(spark, d)).select("row_id", "entity", "fold"), path)
    return io.read_folds(spark, path, [2, 4]).select("row_id", "entity", F.col("fold").cast("int").alias("fold"))


@query(f"WITH {SCORED} SELECT row_id, fold, model, y, p FROM long")
def prediction_sink(spark, d):
    """Scores written by model and fold and read back."""
    path = io.scratch(spark, "predictions")
    io.write_predictions(scored_long(spark, d).select("row_id", "fold", "model", "y", "p"), path, ["model", "fold"])
    return io.read_folds(spark, path).select("row_id", F.col("fold").cast("int").alias("fold"), "model", "y", "p")


@query(f"WITH {PANEL}, h AS (SELECT t.row_id, t.label, {_sql_any()} FROM panel t LEFT JOIN panel s ON s.entity = t.entity AND s.period < t.period GROUP BY ALL) SELECT * FROM h")
def feature_snapshot(spark, d):
    """Histories and labels saved as one table and loaded through its checks."""
    p, path = panel(spark, d), io.scratch(spark, "features")
    io.save_features(H.fold_history(p, p, blocks=("any",)).select("row_id", "label", *H.ANY), path)
    return rounded(io.load_features(spark, path, H.ANY))


@query(f"WITH {SCORED}, {_topk('model')}")
def report_sink(spark, d):
    """A report table as rounded CSV."""
    path = io.scratch(spark, "report")
    io.write_report(M.topk(scored_long(spark, d), ["model"]), path)
    return io.read_csv(spark, path, "model string, k int, n long, positives long, rate double, lift double, recall double, base_rate double")


@query(f"WITH {PANEL} SELECT count(*) AS \"rows\", CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate, 'strictly earlier periods' AS rule, CAST(42 AS BIGINT) AS seed FROM panel")
def manifest_sink(spark, d):
    """Counts, rate, rule and seed of a run as JSON."""
    path = io.scratch(spark, "manifest")
    io.write_manifest(panel(spark, d), path, rule="strictly earlier periods", seed=42)
    return rounded(spark.read.schema("rows long, positives long, rate double, rule string, seed long").json(path))


@query(f"WITH {PANEL} SELECT step, n, digest, refused FROM (SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(entity || '|' || row_id), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM panel), (VALUES ('built', false), ('reused', false), ('other input', true)) v(step, refused)")
def guarded_snapshot(spark, d):
    """A snapshot built, reused, and refused for an input that has a row less; the table's fingerprint each time."""
    p = panel(spark, d).select("row_id", "entity")
    held = io.GuardedSnapshot(spark, io.scratch(spark, "guarded"))
    parts = []
    for step, inputs in (("built", p), ("reused", p), ("other input", p.filter(F.col("row_id") != p.agg(F.max("row_id")).first()[0]))):
        try:
            made, refused = held.load(lambda: p, [inputs]), False
        except ValueError:
            made, refused = spark.read.parquet(held.table), True
        parts.append(R.fingerprint(made, ["entity", "row_id"]).select(F.lit(step).alias("step"), "n", "digest", F.lit(refused).alias("refused")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
