"""Streaming queries: files derived from the tables, drained with an available-now trigger."""

from pyspark.sql import functions as F

from votelens.functions.scalars import hash_byte
from votelens.operators import trust as TR
from votelens.plans import sqlviews as S
from votelens.plans.registry import query
from votelens.session import scratch_path
from votelens.streaming import monitor as M


def label_files(i):
    """Label records as JSON files, a few of them cut off."""
    path = scratch_path(i.spark, "arriving")
    rec = i.records
    text = F.to_json(F.struct("image", "name", "split", "label", "center", "decision", "frame_trust", "suspicion", "verified", "concepts"))
    rec = rec.select("name", text.alias("value"))
    cut = F.when(hash_byte("trunc", "name") < 5, F.expr("substring(value, 1, 30)")).otherwise(F.col("value"))
    rec.select(cut.alias("value")).repartition(6).write.text(path)
    return path


@query("stream_label_monitor", f"""SELECT decision, frames, mean_trust, CASE WHEN mean_trust >= 0.75 THEN 'high' WHEN mean_trust >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM (
  SELECT decision, count(*) AS frames, {S.m4('frame_trust')} AS mean_trust FROM curated WHERE {S.h('trunc', 'name')} >= 5 GROUP BY decision)""", "curated", r="mean_trust")
def stream_label_monitor(i):
    out = scratch_path(i.spark, "monitor")
    M.monitor(M.label_stream(i.spark, label_files(i), 2), out, scratch_path(i.spark, "state")).awaitTermination()
    d = i.spark.read.parquet(out)
    last = d.agg(F.max("epoch").alias("epoch"))
    return d.join(F.broadcast(last), "epoch").drop("epoch")  # one row


@query("stream_bad_records", f"SELECT count(*) AS bad FROM frames WHERE {S.h('trunc', 'name')} < 5", "frames")
def stream_bad_records(i):
    out = scratch_path(i.spark, "quarantine")
    M.quarantine(M.label_stream(i.spark, label_files(i)), out, scratch_path(i.spark, "state")).awaitTermination()
    return i.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("bad"))


@query("stream_curate", "SELECT * FROM curated", "curated", r="frame_trust suspicion")
def stream_curate(i):
    src, out = scratch_path(i.spark, "votes"), scratch_path(i.spark, "curated")
    i.votes.write.json(src)
    M.stream_curate(i.spark, src, i.frames, out, scratch_path(i.spark, "state")).awaitTermination()
    return M.latest_curated(i.spark, out)
