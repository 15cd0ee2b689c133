"""Query registry: name -> (Spark callable, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votelens import vocabulary as V
from votelens.functions.scalars import half_up, hash_byte
from votelens.operators import mining, trust, votes
from votelens.plans import sqlviews as S
from votelens.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Report precision: doubles at six decimals, so the order of a float sum cannot show."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        cols.append(half_up(c, digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c)
    return df.select(*cols)


def query(name: str, sql: str | None = None, uses: str = "", extra: dict[str, str] | None = None, r: str = ""):
    """Register a query. ``uses`` names SQL views, ``r`` the double columns the SQL side rounds."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return rounded(fn(Inputs(spark, sf_dir)))
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = S.with_views(S.rounded(sql, r), *uses.split(), extra=extra)
        return fn
    return wrap


class Inputs:
    """The views of one scale folder, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        build = getattr(views, name, None)
        if build is None or name.startswith("_"):
            raise AttributeError(name)
        df = build(self.spark, self.sf_dir)
        self.__dict__[name] = df
        return df

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.sf_dir, name)

    @property
    def votes(self) -> DataFrame:
        return self.raw_votes

    @property
    def votes_alt(self) -> DataFrame:
        return views.raw_votes(self.spark, self.sf_dir, alt=True)

    @property
    def cells(self) -> DataFrame:
        return votes.aggregate_votes(self.votes)

    @property
    def cells_alt(self) -> DataFrame:
        return votes.aggregate_votes(self.votes_alt)

    @property
    def cross_alt(self) -> DataFrame:
        half = hash_byte("xa", "path") < 128
        return self.cells_alt.filter(F.col("concept").isin(V.ROBUST_CORE) & half).select("path", "concept", F.col("c").alias("c_alt"))

    @property
    def trusted(self) -> DataFrame:
        return trust.cell_trust(self.cells)

    @property
    def curated(self) -> DataFrame:
        return trust.curate_frames(self.frames, self.trusted)

    @property
    def records(self) -> DataFrame:
        return trust.curated_records(self.frames, self.trusted)

    @property
    def profile(self) -> DataFrame:
        """Persisted, for mining reads it more than once; a lost executor's blocks are computed again."""
        return mining.frame_profile(self.frames, self.trusted).persist()

    @property
    def trusted_x(self) -> DataFrame:
        return trust.cell_trust(self.cells, self.cross_alt)

    @property
    def curated_x(self) -> DataFrame:
        return trust.curate_frames(self.frames, self.trusted_x)

    @property
    def lab(self) -> DataFrame:
        return self.frames.filter(F.col("label").isin(0, 1)).select("path", "label", "center", "split")

    def labelled_cells(self, alt: bool = False) -> DataFrame:
        """Cells of the paths that hold a labelled frame: votes of other paths are never built."""
        return votes.aggregate_votes(views.raw_votes(self.spark, self.sf_dir, alt, labelled=True))

    @property
    def lcells(self) -> DataFrame:
        return self.labelled_cells().join(self.lab, "path")

    @property
    def lcells_alt(self) -> DataFrame:
        return self.labelled_cells(alt=True).join(self.lab, "path")

    @property
    def ltrusted(self) -> DataFrame:
        return trust.cell_trust(self.labelled_cells())

    @property
    def model_cells(self) -> DataFrame:
        """Cells of three annotator models; one of them misses some frames."""
        own = votes.aggregate_votes(self.votes.withColumnRenamed("expert", "model"), ("model", "path"))
        alt = votes.aggregate_votes(self.votes_alt.filter(F.col("expert") == "flash3"))
        alt = alt.filter(hash_byte("miss", "path") >= 20).withColumn("model", F.lit("flash35"))
        return own.unionByName(alt)
