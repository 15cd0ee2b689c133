"""Input views over the given tables: the same rows in Spark here and in SQL in ``plans/sqlviews.py``.

Every view is linear in the table it reads and touches only the columns it needs (document texts are
never scanned). Ids become frame names, languages become acquisition centers, sources become folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.functions.scalars import hash_byte


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    label = F.coalesce(F.col("toxic"), F.lit(-1)).cast("int")
    return docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("out/"), F.col("source"), F.lit("/images/"), F.col("doc_id").cast("string"),
                 F.lit(".jpg")).alias("path"),
        F.col("doc_id").cast("string").alias("name"),
        F.col("source").alias("dir"),
        F.when(F.col("lang") == "en", "center_1").otherwise("center_2").alias("center"),
        label.alias("label"),
        F.when(label < 0, "unlabeled").when(hash_byte("split", "doc_id") < 192, "train").otherwise("val")
        .alias("split"))


def raw_votes(spark: SparkSession, sf_dir: str, alt: bool = False, labelled: bool = False) -> DataFrame:
    """Long annotator votes (path, expert, lens, concept, raw). ``alt`` is a re-extraction in which a
    quarter of the cells was read differently. With ``labelled`` all votes of the paths that hold a labelled frame, for
    readers that join the cells to labelled frames: the votes of the other paths would only be dropped there."""
    vocab = F.array(*[F.struct(F.lit(r[0]).alias("concept"), F.lit(len(r[5])).alias("_n")) for r in V.vocabulary_rows()])
    panel = F.array(*[F.struct(F.lit(e).alias("expert"), F.lit(i).alias("lens"))
                      for e in V.EXPERT_ORDER for i in range(V.EXPERT_VOTES[e])])
    # Spread the frames by path before they fan out into votes: the later aggregations by (path, concept) and by
    # path keep this partitioning, so the votes themselves are never shuffled.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    f = frames(spark, sf_dir).select("path", "name", "label").repartition(n, "path")
    if labelled:  # the rows of a path are in one partition already
        f = f.withColumn("_any", F.max(F.col("label").isin(0, 1)).over(Window.partitionBy("path"))).filter("_any").drop("_any")
    cells = f.select("*", F.explode(vocab).alias("_c")).select("*", "_c.*").drop("_c")
    own = hash_byte("b", "name", "concept")
    if alt:
        own = F.when(hash_byte("altcell", "name", "concept") < 64, hash_byte("b2", "name", "concept")).otherwise(own)
    cells = (cells.withColumn("_base", own).withColumn("_lift", hash_byte("t", "name", "concept"))
             .select("*", F.explode(panel).alias("_p")).select("*", "_p.expert", "_p.lens"))
    hv = hash_byte("v", "name", "expert", "lens", "concept")
    n = F.col("_n")
    idx = F.when(F.col("_hv") < 64, F.col("_hv") % n).otherwise(F.col("_base") % n)
    lifted = (F.when(F.col("kind") == "ordinal", F.least(F.lit(4), F.col("_i") + 2).cast("string"))
              .when(F.col("kind") == "binary", "yes")
              .otherwise(F.coalesce(F.get("abnormal", F.lit(0)), F.get("allowed", F.col("_i")))))
    cells = cells.withColumn("_hv", hv).withColumn("_i", idx)
    dim = F.broadcast(V.vocabulary(spark).select("concept", "kind", "allowed", "abnormal"))  # 35 rows
    cells = cells.join(dim, "concept")
    raw = (F.when(F.col("_hv") < 32, V.NA)
           .when((F.col("label") == 1) & (F.col("_lift") < 128), lifted)
           .otherwise(F.get("allowed", F.col("_i"))))
    return cells.select("path", "expert", "lens", "concept", raw.alias("raw"))


def _score(value: Column, positive: Column) -> Column:
    v = F.when(positive, value * 3.0).otherwise(value)
    return v / (v + F.lit(50.0))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    pos = F.col("event_type") == "error"
    return e.select(F.col("event_id").cast("string").alias("name"), _score(F.col("value"), pos).alias("score"),
                    pos.cast("int").alias("label"), _center().alias("center"),
                    F.col("user_id").cast("string").alias("source"))


def _center() -> Column:
    return F.concat(F.lit("center_"), (F.col("user_id") % 2 + 1).cast("string"))


def scored_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About one percent positives: an event is positive if it is an error in the lowest 5 % of a hash."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    pos = (F.col("event_type") == "error") & (hash_byte("rare", "event_id") < 13)
    score_a = _score(F.col("value"), pos)
    score_b = (score_a + hash_byte("b", "event_id") / F.lit(256.0)) / F.lit(2.0)
    return e.select(F.col("event_id").cast("string").alias("name"), score_a.alias("score"),
                    pos.cast("int").alias("label"), _center().alias("center"),
                    F.col("user_id").cast("string").alias("source"), score_b.alias("score_b"))


def scored_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_discount", "l_returnflag", "l_linestatus")
    return li.select(F.col("l_discount").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
                     F.col("l_linestatus").alias("center"))


def grades(cells: DataFrame, salt: str = "g1") -> DataFrame:
    """Independent re-grades of cells as text, about every 16th unparsable."""
    h = hash_byte(salt, "path", "concept")
    sign = F.when(hash_byte(salt + "s", "path", "concept") < 128, 1.0).otherwise(-1.0)
    raw = F.when(h < 16, "n/a").otherwise((F.col("c") + sign * h / F.lit(300.0)).cast("string"))
    return cells.select("path", "concept", raw.alias("raw"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return e.select((F.col("user_id") % 8).cast("int").alias("level"), (F.col("event_type") != "error").alias("ok"),
                    F.col("value").alias("latency"))


def epoch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training log per run and epoch, averaged from events (run = event type, epoch = user mod 12)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return (e.groupBy(F.col("event_type").alias("run"), (F.col("user_id") % 12).cast("int").alias("epoch"))
            .agg((F.sum("value") / F.count("value") / 50.0).alias("train_loss"),
                 (F.max("value") / 300.0).alias("val_loss"),
                 F.when(F.min(F.col("event_id")) % 3 != 0, F.min("value")).alias("auprc"),
                 F.max("value").alias("ppv90")))


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "props")
    body = F.when(hash_byte("tc", "event_id") < 50, F.regexp_replace("props", r"\}$", ", }")).otherwise(F.col("props"))
    text = (F.when(hash_byte("pr", "event_id") < 36, F.lit("I cannot read this frame."))
            .when(hash_byte("fe", "event_id") < 85, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .otherwise(body))
    return e.select(F.col("event_id").cast("string").alias("name"), text.alias("content"))


def embedding_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("feats"),
                    (F.col("label") == 0).cast("int").alias("label"),
                    F.concat(F.lit("center_"), (F.col("vec_id") % 2 + 1).cast("string")).alias("center"))


def stage_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage outputs (path, stage, concept, cell text): draft, refine and confirm passes of one reading."""
    v = raw_votes(spark, sf_dir).filter(F.col("expert") == "flash3")
    stage = F.element_at(F.array(F.lit("draft"), F.lit("refine"), F.lit("confirm")), F.col("lens") + 1)
    conf = hash_byte("conf", "path", "stage", "concept") / F.lit(256.0)
    form = hash_byte("form", "path", "stage", "concept")
    v = v.withColumn("stage", stage).withColumn("_conf", conf).withColumn("_form", form)
    v = v.filter((F.col("stage") == "draft")
                 | ((F.col("stage") == "refine") & F.col("concept").isin(V.DISCRIMINATIVE) & (F.col("_form") < 200))
                 | ((F.col("stage") == "confirm") & F.col("concept").isin(V.ROBUST_CORE)))
    cell = (F.when(F.col("_form") < 16, F.lit(None).cast("string"))
            .when(F.col("_form") < 128, F.col("raw"))
            .when(F.col("_form") < 140, F.concat(F.lit('{"v": "'), F.col("raw"), F.lit('", "conf": "high"}')))
            .otherwise(F.concat(F.lit('{"v": "'), F.col("raw"), F.lit('", "conf": '), F.col("_conf").cast("string"),
                                F.lit("}"))))
    return v.select("path", "stage", "concept", cell.alias("cell"))
