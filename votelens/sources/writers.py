"""Writers for label records, vote stores, manifests, path lists, predictions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.operators.labels import gap_fill
from votelens.operators.trust import concept_arrays
from votelens.sources.readers import read_labels


def write_labels(records: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Nested label records, partitioned by split. JSON lines or Parquet; file counts follow the cluster's
    partitioning, not the number of records."""
    out = records.select("image", "name", "split", "label", "center", "decision", "frame_trust", "suspicion", "verified", "concepts")
    out.write.mode(mode).partitionBy("split").format(fmt).save(path)


def write_run_manifest(records: DataFrame, path: str, run_id: str, experts: list[str], data_path: str) -> None:
    """Write the records, then a one-row run manifest with the counts of what was written."""
    write_labels(records, data_path)
    stored = read_labels(records.sparkSession, data_path)
    n_sup = F.size(F.map_filter("concepts", lambda k, v: v["supervise"]))
    counts = stored.agg(F.count(F.lit(1)).alias("curated"), F.coalesce(F.sum(n_sup), F.lit(0)).alias("supervised_cells"),
                        *[F.count(F.when(F.col("decision") == d, 1)).alias(d) for d in V.DECISIONS])
    counts.select(F.lit(run_id).alias("run_id"), F.lit(",".join(experts)).alias("experts"), "*").write.mode("overwrite").json(path)


def foundation_manifest(records: DataFrame) -> DataFrame:
    """Records with only their supervised cells, as value and trust."""
    sup = F.map_filter("concepts", lambda k, v: v["supervise"])
    slim = F.transform_values(sup, lambda k, v: F.struct(v["value"].alias("c"), v["trust"].alias("trust")))
    return records.select("path", "label", "center", "decision", "frame_trust", "suspicion", "verified", slim.alias("supervise"))


def write_foundation_manifest(records: DataFrame, path: str) -> None:
    foundation_manifest(records).write.mode("overwrite").json(path)


def write_concept_targets(records: DataFrame, path: str, listing: DataFrame | None = None) -> None:
    """Value, trust and supervise arrays in vocabulary order, for listed images only."""
    d = concept_arrays(records)
    if listing is not None:
        d = d.join(listing.select("path").distinct(), "path", "left_semi")
    d.select("path", "name", "center", "label", "value", "trust", "supervise").write.mode("overwrite").parquet(path)


def write_path_list(paths: DataFrame, path: str, listing: DataFrame | None = None) -> None:
    d = paths.join(listing.select("path").distinct(), "path", "left_semi") if listing is not None else paths
    d.select("path").write.mode("overwrite").text(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """name, score, label at full double precision: shortened scores create ties."""
    predictions.select("name", "score", "label").write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def append_votes(new: DataFrame, stored: DataFrame, path: str) -> DataFrame:
    """Append records whose (frame, expert, anchor set) has no non-empty result yet; returns what was written."""
    todo = gap_fill(new, stored.withColumn("n_votes", F.size("votes")), ["path", "expert", "anchor_sig"])
    todo.write.mode("append").partitionBy("expert").json(path)
    return todo
