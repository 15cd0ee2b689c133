"""Structured Streaming over arriving label and vote files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from votelens.functions.scalars import units4
from votelens.operators import trust as TR
from votelens.operators import votes as VO
from votelens.sources.readers import BAD, LABEL_SCHEMA

VOTE_ROWS = "path string, expert string, lens int, concept string, raw string"


def label_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New label files as they arrive; the source's checkpoint is the set of files already seen."""
    r = (spark.readStream.schema(f"{LABEL_SCHEMA}, {BAD} string").option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", BAD))
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.json(path)


def running_counts(labels: DataFrame) -> DataFrame:
    """Running frames and mean trust per decision with its trust band. State is two counters per decision."""
    good = labels.filter(F.col(BAD).isNull())
    g = good.groupBy(F.coalesce("decision", F.lit("?")).alias("decision")).agg(
        F.count(F.lit(1)).alias("frames"),
        (F.sum(units4(F.coalesce("frame_trust", F.lit(0.0)))) / F.count(F.lit(1)) / 10000.0).alias("mean_trust"))
    return g.withColumn("band", TR.trust_band(F.col("mean_trust")))


def monitor(labels: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A running table per batch (one row per decision) in its own folder of ``out``; the largest epoch is the latest."""
    def save(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    return (running_counts(labels).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(save).start())


def quarantine(labels: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Unparsable records to their own folder."""
    bad = labels.select(F.col(BAD).alias("record"), F.col("_metadata.file_path").alias("file"), "name").filter(F.col("record").isNotNull())
    return (bad.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


# What is kept of a frame between batches: the concepts seen from each voter (a bit for each of the vocabulary's 35), and four sums
# for each concept it has votes on.
SEEN = "voter array<string>, seen array<long>, concept array<string>, n array<long>, k array<long>, s array<double>, q array<double>"
SUMS = "path string, concept string, n long, k long, s double, q double"


def add_votes(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adds a frame's new votes to its sums; a vote (expert, lens, concept) that was seen before counts once.

    Returns the sums of all the frame's concepts, so that its decision needs nothing but this row's state. The state is
    bounded by the annotators of one frame and the 35 concepts."""
    seen, sums = {}, {}
    if state.exists:
        kept = state.get
        seen = dict(zip(kept[0], kept[1]))
        sums = {c: list(four) for c, *four in zip(*kept[2:])}
    for part in parts:
        for voter, bit, concept, value, mask in zip(*(part[c].tolist() for c in ("voter", "bit", "concept", "value", "mask"))):
            before = seen.get(voter, 0)
            if before & bit:
                continue
            seen[voter] = before | bit
            four = sums.setdefault(concept, [0, 0, 0.0, 0.0])
            four[0] += 1
            if mask == 1:
                four[1] += 1
                four[2] += value
                four[3] += value * value
    names = sorted(sums)
    columns = [[sums[c][j] for c in names] for j in range(4)]
    voters = sorted(seen)
    state.update((voters, [seen[v] for v in voters], names, *columns))
    n, k, s, q = columns
    yield pd.DataFrame({"path": key[0], "concept": names, "n": n, "k": k, "s": s, "q": q})


def running_sums(votes: DataFrame) -> DataFrame:
    """(path, concept, n, k, s, q) of every frame that a batch touches, from keyed state. Votes without a path, or on an
    unknown concept, are left out; a missing expert or lens is a value of its own."""
    nv = VO.normalize_votes(votes.filter(F.col("path").isNotNull()))
    voter = F.to_json(F.struct("expert", "lens"))
    bit = F.expr("shiftleft(1L, ord)")  # of the concept, below 2**35
    return VO.with_vocabulary(nv, "ord").select("path", voter.alias("voter"), bit.alias("bit"), "concept", "value", "mask").groupBy("path").applyInPandasWithState(
        add_votes, SUMS, SEEN, "update", GroupStateTimeout.NoTimeout)


def stream_curate(spark: SparkSession, votes_path: str, frames: DataFrame, out: str, checkpoint: str,
                  files_per_trigger: int | None = None) -> StreamingQuery:
    """Votes in, curated rows out. Votes of a frame may arrive over several batches: the stream's state holds the sums of
    each frame and the votes seen, so a batch reads its own votes, the states it touches and ``frames``, and no earlier
    vote. Sums of a vote's value are whole quarters, so their order cannot show. A batch rewrites only its own folder, so
    a replayed batch changes nothing; :func:`latest_curated` gives the current row per frame."""
    r = spark.readStream.schema(VOTE_ROWS).option("recursiveFileLookup", True)
    v = (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).json(votes_path)

    def curate(batch: DataFrame, epoch: int) -> None:
        cells = VO.cells_of_sums(VO.with_vocabulary(batch, "kind"), ["path"])
        TR.curate_frames(frames, TR.cell_trust(cells)).write.mode("overwrite").parquet(f"{out}/curated/epoch={epoch}")

    return (running_sums(v).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(curate).start())


def latest_curated(spark: SparkSession, out: str) -> DataFrame:
    d = spark.read.parquet(f"{out}/curated")
    cols = [c for c in d.columns if c not in ("path", "epoch")]
    g = d.groupBy("path").agg(F.max_by(F.struct(*cols), "epoch").alias("_r"))
    return g.select("path", *[F.col(f"_r.{c}").alias(c) for c in cols])
