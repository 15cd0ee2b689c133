"""Readers for label stores, vote stores, score tables, frame lists and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_SCHEMA = ("image string, name string, split string, label int, center string, decision string, frame_trust double, "
                "suspicion double, verified boolean, concepts map<string,struct<value:double,trust:double,supervise:boolean>>")
VOTE_SCHEMA = ("path string, expert string, anchor_sig string, strategy string, votes array<map<string,string>>, "
               "meta array<struct<stages:array<string>,confidence:map<string,double>,masked:array<string>>>")
FRAME_SCHEMA = "path string, label int, center string, class string, source_path string, aug string"
ANCHOR_SCHEMA = "path string, kind string, cls string, center string, hard boolean"
BAD = "_corrupt"


def _json(spark: SparkSession, schema: str, path: str, multi_line: bool, recursive: bool = False) -> DataFrame:
    """JSON records. A store partitioned by key=value folders gives these columns back; ``recursive`` reads plain nested
    folders instead, whose names are no columns."""
    return (spark.read.schema(f"{schema}, {BAD} string").option("multiLine", multi_line).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BAD).option("recursiveFileLookup", recursive).json(path))


def read_labels(spark: SparkSession, path: str, labeled_only: bool = False, multi_line: bool = False,
                keep_bad: bool = False, recursive: bool = False) -> DataFrame:
    """Label records: one JSON per line, or one (pretty-printed) JSON per file with ``multi_line``. Bad records are
    skipped unless ``keep_bad``; suspicion stays NULL where it is missing. ``recursive`` is for plain nested folders."""
    d = _json(spark, LABEL_SCHEMA, path, multi_line, recursive).withColumn("file", F.col("_metadata.file_path"))
    if not keep_bad:
        d = d.filter(F.col(BAD).isNull()).drop(BAD)
    return d.filter(F.col("label") >= 0) if labeled_only else d


def read_frames_csv(spark: SparkSession, path: str, originals: bool = True, schema: str = FRAME_SCHEMA) -> DataFrame:
    d = spark.read.schema(schema).option("header", True).csv(path)
    return keep_originals(d) if originals else d


def keep_originals(df: DataFrame) -> DataFrame:
    return df.filter(F.col("aug").isNull() | F.col("aug").isin("", "orig"))


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Recursive file listing; contents are never read because only the path column is selected."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
            .load(root).select("path", "length", F.lit(-1).alias("label")))


def read_votes(spark: SparkSession, path: str) -> DataFrame:
    """Long votes (path, expert, lens, concept, raw); records without votes count as missing."""
    d = _json(spark, VOTE_SCHEMA, path, False).filter(F.col(BAD).isNull() & (F.size("votes") > 0))
    d = d.select("path", "expert", F.posexplode("votes").alias("lens", "_v"))
    return d.select("path", "expert", "lens", F.explode("_v").alias("concept", "raw"))


def read_scores(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    schema = "name string, score double, label int, center string, source string"
    if fmt == "csv":
        return spark.read.schema(schema).option("header", True).csv(path)
    return with_columns(spark.read.parquet(path), schema)


def with_columns(df: DataFrame, schema: str) -> DataFrame:
    """Select the named columns, NULL where the file lacks one."""
    cols: list[Column] = []
    for part in schema.split(", "):
        name, kind = part.split(" ", 1)
        cols.append(F.col(name).cast(kind).alias(name) if name in df.columns else F.lit(None).cast(kind).alias(name))
    return df.select(*cols)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return with_columns(spark.read.parquet(path), "name string, feats array<float>, label int, center string, source string, "
                                                  "aug string, pool_names array<string>")


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-blank lines. A missing file fails at once (Spark raises PATH_NOT_FOUND)."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter(F.col("path") != "")


def discover_datasets(files: DataFrame) -> DataFrame:
    """Folders that have a labels/ child, from a file listing."""
    folder = F.regexp_extract("path", r"^(?:.*/)?([^/]+)/labels/[^/]+$", 1)
    return files.select(folder.alias("dataset")).filter(F.col("dataset") != "").distinct()


def path_parts(df: DataFrame, file: str = "file", root: str = "out") -> DataFrame:
    """Folder, stem and sibling image path of label files .../<dir>/labels/<stem>.json."""
    parts = F.split(file, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    d = df.withColumn("dir", F.element_at(parts, -3)).withColumn("stem", stem)
    return d.withColumn("img_path", F.concat(F.lit(root + "/"), "dir", F.lit("/images/"), "stem", F.lit(".jpg")))


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema(ANCHOR_SCHEMA).json(path)
    return d.select("path", F.coalesce("kind", "cls").alias("kind"), F.coalesce("center", F.lit("")).alias("center"),
                    F.coalesce("hard", F.lit(False)).alias("hard"))


def build_label_csv(labels: DataFrame, listing: DataFrame, root: str = "out") -> DataFrame:
    """Training rows from labelled records whose image is listed."""
    d = path_parts(labels.filter(F.col("label") >= 0), root=root).select(
        F.col("img_path").alias("path"), "center", F.when(F.col("label") == 1, "neo").otherwise("ndbe").alias("class"), "label")
    return d.join(listing.select("path").distinct(), "path", "left_semi")


def concat_shards(spark: SparkSession, path: str) -> DataFrame:
    """All shard files of a folder as one frame, label -1."""
    d = spark.read.option("mergeSchema", True).parquet(path)
    return d.withColumn("label", F.lit(-1))
