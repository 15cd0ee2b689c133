"""Source and sink queries: each writes data derived from the tables to the shared folder and reads it back."""

from pyspark.sql import functions as F

from votelens.functions.scalars import hash_byte
from votelens.operators import trust as TR
from votelens.plans import sqlviews as S
from votelens.plans.registry import query
from votelens.session import scratch_path
from votelens.sources import readers as RD
from votelens.sources import writers as WR


def records(i):
    return i.records


def written_labels(i):
    path = scratch_path(i.spark, "labels")
    WR.write_labels(records(i), path)
    return path


@query("read_labels", "SELECT name, split, label, center, decision, frame_trust, suspicion, verified, 35 AS n_concepts FROM curated WHERE label >= 0", "curated", r="frame_trust suspicion")
def read_labels(i):
    d = RD.read_labels(i.spark, written_labels(i), labeled_only=True)
    return d.select("name", "split", "label", "center", "decision", "frame_trust", "suspicion", "verified", F.size("concepts").alias("n_concepts"))


@query("write_labels", "SELECT split, count(*) AS n, count(*) FILTER (decision = 'ABSTAIN') AS abstain FROM curated GROUP BY split", "curated")
def write_labels(i):
    d = i.spark.read.json(written_labels(i))
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("decision") == "ABSTAIN", 1)).alias("abstain"))


@query("read_labels_bad_records", f"SELECT {S.h('trunc', 'name')} < 5 AS bad, count(*) AS n FROM curated GROUP BY 1", "curated")
def read_labels_bad_records(i):
    path = scratch_path(i.spark, "labels_bad")
    text = F.to_json(F.struct("image", "name", "split", "label", "center", "decision", "frame_trust", "suspicion", "verified"))
    cut = F.when(hash_byte("trunc", "name") < 5, F.expr("substring(value, 1, 20)")).otherwise(F.col("value"))
    i.curated.withColumn("image", F.col("path")).select("name", text.alias("value")).select(cut.alias("value")).write.text(path)
    d = RD.read_labels(i.spark, path, keep_bad=True)
    # every record has a name or is corrupt; Spark reads the corrupt column only together with another one
    return d.groupBy(F.col(RD.BAD).isNotNull().alias("bad")).agg(F.count(F.coalesce("name", RD.BAD)).alias("n"))


@query("read_frames_csv", f"SELECT path, label, center FROM frames WHERE label >= 0 AND {S.h('aug', 'path')} < 180", "frames")
def read_frames_csv(i):
    path = scratch_path(i.spark, "frames")
    aug = F.when(hash_byte("aug", "path") < 180, "orig").otherwise("flip")
    f = i.frames.filter("label >= 0").select("path", "label", "center", F.lit("x").alias("class"), F.col("path").alias("source_path"), aug.alias("aug"))
    f.write.option("header", True).csv(path)
    return RD.read_frames_csv(i.spark, path).select("path", "label", "center")


def vote_records(i):
    v = i.votes.groupBy("path", "expert", "lens").agg(F.map_from_entries(F.collect_list(F.struct("concept", "raw"))).alias("_v"))
    g = v.groupBy("path", "expert").agg(F.transform(F.array_sort(F.collect_list(F.struct("lens", F.to_json("_v").alias("j")))),
                                                    lambda s: F.from_json(s["j"], "map<string,string>")).alias("votes"))
    return g.select("path", "expert", F.lit("a,b").alias("anchor_sig"), F.lit("single").alias("strategy"), "votes")


@query("read_votes", "SELECT expert, lens, concept, count(*) AS n, count(DISTINCT raw) AS n_values FROM votes GROUP BY 1, 2, 3", "votes")
def read_votes(i):
    path = scratch_path(i.spark, "votes")
    vote_records(i).write.partitionBy("expert").json(path)
    d = RD.read_votes(i.spark, path)
    return d.groupBy("expert", "lens", "concept").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("raw").alias("n_values"))


_ST = S.h("stored", "name")


@query("append_votes", f"SELECT f.path, e.expert FROM frames f, (VALUES ('proagent'), ('flash3')) e(expert) WHERE NOT ({_ST} < 100 AND e.expert = 'proagent')", "frames")
def append_votes(i):
    stored_path, out = scratch_path(i.spark, "store"), scratch_path(i.spark, "append")
    vr = vote_records(i)
    names = i.frames.filter(hash_byte("stored", "name") < 100).select("path")
    vr.join(names, "path", "left_semi").filter("expert = 'proagent'").write.parquet(stored_path)
    WR.append_votes(vr, i.spark.read.parquet(stored_path), out)
    return RD.read_votes(i.spark, out).select("path", "expert").distinct()


@query("read_scores", "SELECT name, score, label, center, source FROM scored", "scored", r="score")
def read_scores(i):
    path = scratch_path(i.spark, "scores")
    i.scored.write.option("header", True).csv(path)
    return RD.read_scores(i.spark, path).select("name", "score", "label", "center", "source")


@query("write_predictions", "SELECT name, score, label, 0 AS lost_digits FROM scored", "scored", r="score")
def write_predictions(i):
    path = scratch_path(i.spark, "preds")
    WR.write_predictions(i.scored, path)
    back = i.spark.read.schema("name string, score double, label int").option("header", True).csv(path)
    j = back.join(i.scored.select("name", F.col("score").alias("_s")), "name")
    return j.select("name", "score", "label", (F.col("score") != F.col("_s")).cast("int").alias("lost_digits"))


@query("read_embeddings", "SELECT name, len(feats) AS dims, label, center, NULL::varchar AS source FROM embedding_pools", "embedding_pools")
def read_embeddings(i):
    path = scratch_path(i.spark, "emb")
    i.embedding_pools.write.parquet(path)
    return RD.read_embeddings(i.spark, path).select("name", F.size("feats").cast("long").alias("dims"), "label", "center", "source")


@query("read_path_list", f"SELECT path FROM frames WHERE {S.h('pl', 'name')} < 128", "frames")
def read_path_list(i):
    path = scratch_path(i.spark, "paths")
    line = F.when(hash_byte("pl", "name") < 128, F.concat(F.lit("  "), "path", F.lit(" "))).otherwise(F.lit("   "))
    i.frames.select(line.alias("value")).write.text(path)
    return RD.read_path_list(i.spark, path)


@query("write_path_list", f"SELECT path FROM frames WHERE label < 0 AND {S.h('noimg', 'name')} >= 12", "frames")
def write_path_list(i):
    path = scratch_path(i.spark, "picked")
    WR.write_path_list(i.frames.filter("label < 0"), path, i.frames.filter(hash_byte("noimg", "name") >= 12))
    return RD.read_path_list(i.spark, path)


@query("read_anchors", "SELECT path, CASE WHEN label = 1 THEN 'neo' ELSE 'ndbe' END AS kind, center, false AS hard FROM frames WHERE label >= 0", "frames")
def read_anchors(i):
    path = scratch_path(i.spark, "anchors")
    i.frames.filter("label >= 0").select("path", F.when(F.col("label") == 1, "neo").otherwise("ndbe").alias("cls"), "center").write.json(path)
    return RD.read_anchors(i.spark, path)


def file_tree(i):
    """One small file per folder and kind, the way a label store looks on disk."""
    root = scratch_path(i.spark, "tree")
    d = i.frames.select("dir", F.when(hash_byte("kind", "dir") < 170, "labels").otherwise("images").alias("kind"), "name")
    d.repartition("dir").write.partitionBy("dir", "kind").json(root)
    return root


@query("list_files", f"SELECT DISTINCT 'dir=' || dir || '/kind=' || CASE WHEN {S.h('kind', 'dir')} < 170 THEN 'labels' ELSE 'images' END AS folder, -1 AS label FROM frames", "frames")
def list_files(i):
    d = RD.list_files(i.spark, file_tree(i), "*.json")
    return d.select(F.regexp_extract("path", r"(dir=[^/]+/kind=[^/]+)/", 1).alias("folder"), "label").distinct()


@query("discover_datasets", f"SELECT DISTINCT 'dir=' || dir AS dataset FROM frames WHERE {S.h('kind', 'dir')} < 170", "frames")
def discover_datasets(i):
    d = RD.list_files(i.spark, file_tree(i), "*.json").withColumn("path", F.regexp_replace("path", "kind=", ""))
    return RD.discover_datasets(d)


@query("build_label_csv", f"SELECT path, center, CASE WHEN label = 1 THEN 'neo' ELSE 'ndbe' END AS class, label FROM frames WHERE label >= 0 AND {S.h('noimg', 'name')} >= 12", "frames")
def build_label_csv(i):
    labels = i.frames.select("label", "center", F.concat(F.lit("/x/out/"), "dir", F.lit("/labels/"), "name", F.lit(".json")).alias("file"))
    return RD.build_label_csv(labels, i.frames.filter(hash_byte("noimg", "name") >= 12))


@query("write_run_manifest", """SELECT 'r1' AS run_id, count(*) AS curated, count(*) FILTER (decision = 'ABSTAIN') AS abstain,
  (SELECT count(*) FROM trusted WHERE supervise) AS supervised_cells FROM curated""", "curated trusted")
def write_run_manifest(i):
    man, data = scratch_path(i.spark, "manifest"), scratch_path(i.spark, "run")
    WR.write_run_manifest(records(i), man, "r1", ["proagent", "flash3"], data)
    return i.spark.read.json(man).select("run_id", "curated", F.col("ABSTAIN").alias("abstain"), "supervised_cells")


@query("write_foundation_manifest", """SELECT path, decision, count(*) FILTER (supervise)::int AS n_sup, coalesce(sum(trust) FILTER (supervise), 0.0) AS trust_sum
  FROM curated JOIN trusted USING (path) GROUP BY 1, 2""", "curated trusted", r="trust_sum")
def write_foundation_manifest(i):
    path = scratch_path(i.spark, "foundation")
    WR.write_foundation_manifest(records(i), path)
    d = i.spark.read.schema("path string, decision string, supervise map<string,struct<c:double,trust:double>>").json(path)
    total = F.aggregate(F.map_values("supervise"), F.lit(0.0), lambda a, v: a + v["trust"])
    return d.select("path", "decision", F.coalesce(F.size("supervise"), F.lit(0)).alias("n_sup"), F.coalesce(total, F.lit(0.0)).alias("trust_sum"))


@query("write_concept_targets", f"""SELECT path, name, center, label, sum(value) AS v, sum(trust) AS t, count(*) FILTER (supervise)::double AS s
  FROM curated JOIN trusted USING (path) WHERE {S.h('noimg', 'name')} >= 12 GROUP BY 1, 2, 3, 4""", "curated trusted", r="v t s")
def write_concept_targets(i):
    path = scratch_path(i.spark, "targets")
    WR.write_concept_targets(records(i), path, i.frames.filter(hash_byte("noimg", "name") >= 12))
    total = lambda c, n: F.aggregate(c, F.lit(0.0), lambda a, v: a + v).alias(n)
    return i.spark.read.parquet(path).select("path", "name", "center", "label", total("value", "v"), total("trust", "t"), total("supervise", "s"))


@query("write_report", "SELECT decision, count(*) AS n FROM curated GROUP BY decision", "curated")
def write_report(i):
    path = scratch_path(i.spark, "report")
    WR.write_report(i.curated.groupBy("decision").agg(F.count(F.lit(1)).alias("n")), path)
    return i.spark.read.schema("decision string, n long").json(path)


@query("concat_shards", "SELECT name, -1 AS label, center FROM embedding_pools", "embedding_pools")
def concat_shards(i):
    root = scratch_path(i.spark, "shards")
    d = i.embedding_pools
    half = hash_byte("shard", "name") < 128
    d.filter(half).select("name", "feats", "center").write.parquet(f"{root}/shard=0")
    d.filter(~half).select("name", "feats", "center").write.parquet(f"{root}/shard=1")
    return RD.concat_shards(i.spark, root).select("name", "label", "center")


@query("stored_votes_by_model", "SELECT expert, count(DISTINCT path) AS frames FROM votes GROUP BY expert", "votes")
def stored_votes_by_model(i):
    path = scratch_path(i.spark, "mvotes")
    i.votes.write.partitionBy("expert").parquet(path)
    return i.spark.read.parquet(path).groupBy("expert").agg(F.count_distinct("path").alias("frames"))
