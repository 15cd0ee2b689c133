"""Votes to cells: normalisation, stage merging, masking and (value, reliability, coverage) aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.functions.scalars import clip, is_not_assessable

CELL_SCHEMA = "struct<v:string,conf:string,why:string>"


def with_vocabulary(df: DataFrame, *cols: str) -> DataFrame:
    """Join the fixed 35-row concept dimension."""
    dim = F.broadcast(V.vocabulary(df.sparkSession).select("concept", *cols))
    return df.join(dim, "concept")


def _truthy(raw: Column) -> Column:
    return F.lower(F.trim(raw)).isin("yes", "true", "1")


def normalize_votes(votes: DataFrame) -> DataFrame:
    """Raw text to a number in [0, 1] with an assessable flag. Ordinals scale by 4 and clamp, binaries read
    yes/true/1, categoricals are 1 in the abnormal direction; unreadable ordinals and NA spellings mask."""
    d = with_vocabulary(votes, "kind", "abnormal")
    raw = F.col("raw")
    num = F.trim(raw).try_cast("double")
    num = F.when(~F.isnan(num), num)
    value = (F.when(F.col("kind") == "ordinal", clip(num / 4.0, 0.0, 1.0))
             .when(F.col("kind") == "binary", _truthy(raw).cast("double"))
             .otherwise(F.array_contains("abnormal", raw).cast("double")))
    assessable = ~is_not_assessable(raw) & ((F.col("kind") != "ordinal") | num.isNotNull())
    keep = [c for c in votes.columns if c not in ("raw", "concept")]
    return d.select(*keep, "concept", "kind", F.when(assessable, value).otherwise(0.0).alias("value"),
                    assessable.cast("int").alias("mask"))


def abnormal_direction(votes: DataFrame, out: str = "abnormal_dir") -> DataFrame:
    """Tri-state direction of a reading: true, false, or NULL where it cannot be assessed."""
    d = with_vocabulary(votes, "kind", "abnormal")
    return d.select(*votes.columns, direction(F.col("raw"), F.col("kind"), F.col("abnormal")).alias(out))


def direction(raw: Column, kind: Column, abnormal: Column) -> Column:
    num = raw.try_cast("double")
    return (F.when(is_not_assessable(raw), F.lit(None).cast("boolean"))
            .when(kind == "ordinal", num >= 2.0)
            .when(kind == "binary", _truthy(raw))
            .otherwise(F.array_contains(abnormal, raw)))


def _cell_measures(prefix: str = "", keep: Column | None = None) -> list[Column]:
    """Sums from which value, reliability and coverage follow; ``keep`` restricts the votes used."""
    on = (F.col("mask") == 1) if keep is None else (F.col("mask") == 1) & keep
    all_ = F.lit(True) if keep is None else keep
    return [F.count(F.when(all_, 1)).alias(f"{prefix}n"), F.count(F.when(on, 1)).alias(f"{prefix}k"),
            F.sum(F.when(on, F.col("value"))).alias(f"{prefix}s"),
            F.sum(F.when(on, F.col("value") * F.col("value"))).alias(f"{prefix}q")]


def _cell_columns(prefix: str = "") -> list[Column]:
    n, k, s, q = (F.col(prefix + x) for x in "nksq")
    mean = s / k
    spread = F.sqrt(F.greatest(q / k - mean * mean, F.lit(0.0)))  # population std
    rel = (F.when(k == 0, 0.0).when(F.col("kind") == "ordinal", F.greatest(F.lit(0.0), 1.0 - 2.0 * spread))
           .otherwise(F.abs(2.0 * mean - 1.0)))
    return [F.when(k > 0, mean).otherwise(0.0).alias("c"), rel.alias("r"), (k / n).alias("m"), n.alias("n_votes")]


def aggregate_normalized(nv: DataFrame, by: list[str]) -> DataFrame:
    """Cells from normalised votes. Three sums per cell, so partial aggregation runs before the shuffle."""
    return cells_of_sums(nv.groupBy(*by, "concept", "kind").agg(*_cell_measures()), by)


def cells_of_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """Cells from votes (n), assessable votes (k) and the sums of their values (s) and squares (q) per concept and kind."""
    return sums.select(*by, "concept", *_cell_columns())


def aggregate_votes(votes: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """(value c, reliability r, assessable share m, n_votes) per frame and concept."""
    return aggregate_normalized(normalize_votes(votes), list(by))


def aggregate_by_config(votes: DataFrame, configs: dict[str, Column]) -> DataFrame:
    """Cells for several vote subsets at once: one scan and one shuffle, each subset a set of conditional sums."""
    nv = normalize_votes(votes)
    aggs = [m for i, keep in enumerate(configs.values()) for m in _cell_measures(f"_{i}", keep)]
    g = nv.groupBy("path", "concept", "kind").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(label).alias("config"), *[F.col(f"_{i}{x}").alias(x) for x in "nksq"])
                     for i, label in enumerate(configs)])
    g = g.select("path", "concept", "kind", F.explode(rows).alias("_r")).select("path", "concept", "kind", "_r.*")
    return g.filter(F.col("n") > 0).select("config", "path", "concept", *_cell_columns())


def truncate_votes(votes: DataFrame, default: int = 3, per_expert: dict[str, int] | None = None) -> DataFrame:
    """Keep the first n votes per expert (lens < n); experts may override n."""
    limit = F.lit(default)
    for expert, n in (per_expert or {}).items():
        limit = F.when(F.col("expert") == expert, n).otherwise(limit)
    return votes.filter(F.col("lens") < limit)


def request_plan(frames: DataFrame, experts: dict[str, int], base_temp: float = 0.4, lenses: int = 5) -> DataFrame:
    """Work items: one row per frame, expert and seed, with its lens and sampling temperature."""
    items = F.array(*[F.struct(F.lit(e).alias("expert"), F.lit(s).alias("seed"))
                      for e, n in experts.items() for s in range(1, n + 1)])
    d = frames.select("path", F.explode(items).alias("_i")).select("path", "_i.*")
    return d.select("path", "expert", "seed", F.pmod(F.col("seed") - 1, F.lit(lenses)).alias("lens"),
                    (F.lit(base_temp) + 0.1 * F.pmod(F.col("seed") - 1, F.lit(3))).alias("temperature"))


def vote_key(items: DataFrame, anchors: DataFrame, strategy: str = "single", version: str = "v4",
             quality: bool = True) -> DataFrame:
    """Content key of one stored reading: 16 hex digits over frame file, expert namespace and anchor files."""
    suffix = f".{strategy}" + (f".{version}" if strategy == "multistage" else (".q" if quality else ""))
    files = anchors.select("pos", F.element_at(F.split("path", "/"), -1).alias("_f"))  # a handful of anchor rows
    sig = files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_f"))), lambda s: s["_f"]),
                                 ",").alias("anchor_sig"))
    d = items.crossJoin(F.broadcast(sig))  # one row: the signature of the fixed few-shot set
    key = F.substring(F.sha1(F.concat_ws("|", F.element_at(F.split("path", "/"), -1),
                                         F.concat(F.col("expert"), F.lit(suffix)), F.col("anchor_sig"))), 1, 16)
    return d.select("path", "expert", "anchor_sig", key.alias("vote_key"))


def normalize_cell(cells: DataFrame) -> DataFrame:
    """A stage entry, bare value or {v, conf, why} object, to (v, conf, why) with conf in [0, 1]."""
    parsed = F.from_json("cell", CELL_SCHEMA)
    d = cells.withColumn("_p", F.when(F.col("cell").startswith("{"), parsed))
    has_v = F.col("_p.v").isNotNull()
    conf = F.coalesce(F.col("_p.conf").try_cast("double"), F.lit(1.0))
    keep = [c for c in cells.columns if c != "cell"]
    return d.select(*keep,
                    F.when(F.col("cell").isNull(), V.NA).when(has_v, F.col("_p.v")).otherwise(F.col("cell")).alias("v"),
                    F.when(F.col("cell").isNull(), 0.0).when(has_v, clip(conf, 0.0, 1.0)).otherwise(1.0).alias("conf"),
                    F.coalesce(F.col("_p.why"), F.lit("")).alias("why"))


def merge_stage_readings(readings: DataFrame) -> DataFrame:
    """Draft values, overridden by the refine pass for discriminative concepts; morphology becomes not
    assessable unless the draft shows a lesion or a border of grade two or more."""
    r = normalize_cell(readings)
    pick = lambda stage, c: F.max(F.when(F.col("stage") == stage, F.col(c)))  # one row per (path, stage, concept)
    has = lambda stage: F.max((F.col("stage") == stage).cast("int")) == 1
    g = r.filter(F.col("stage").isin("draft", "refine")).groupBy("path", "concept").agg(
        pick("draft", "v").alias("dv"), pick("draft", "conf").alias("dc"),
        pick("refine", "v").alias("rv"), pick("refine", "conf").alias("rc"), has("refine").alias("_ref"))
    w = Window.partitionBy("path")  # 35 rows per frame
    lesion = F.max(F.when(F.col("concept") == "lesion_present", _truthy(F.col("dv")).cast("int"))).over(w)
    border = F.max(F.when(F.col("concept") == "demarcation", (F.col("dv").try_cast("double") >= 2).cast("int"))).over(w)
    shown = (F.coalesce(lesion, F.lit(0)) == 1) | (F.coalesce(border, F.lit(0)) == 1)
    g = g.withColumn("_shown", shown)
    refined = F.col("_ref") & F.col("concept").isin(V.DISCRIMINATIVE)
    gone = F.col("concept").isin(V.MORPHOLOGY) & ~F.col("_shown")
    return g.select("path", "concept",
                    F.when(gone, V.NA).when(refined, F.col("rv")).otherwise(F.col("dv")).alias("v"),
                    F.when(gone, 1.0).when(refined, F.col("rc")).otherwise(F.col("dc")).alias("conf"))


def mask_low_confidence(draft: DataFrame, confirm: DataFrame) -> DataFrame:
    """Mask cells below the confidence floor of their concept, and cells whose confirmation reads the
    opposite direction. Returns (path, concept, v, conf, masked)."""
    d = with_vocabulary(draft, "kind", "abnormal", "conf_floor")
    c = confirm.select("path", "concept", F.col("v").alias("cv"))
    j = d.join(c, ["path", "concept"], "left")
    dd = direction(F.col("v"), F.col("kind"), F.col("abnormal"))
    cd = direction(F.col("cv"), F.col("kind"), F.col("abnormal"))
    opposed = F.col("cv").isNotNull() & F.coalesce(dd != cd, F.lit(False))
    masked = (F.col("conf") < F.col("conf_floor")) | opposed
    return j.select("path", "concept", F.when(masked, V.NA).otherwise(F.col("v")).alias("v"), "conf",
                    masked.alias("masked"))


def vote_record(masked: DataFrame) -> DataFrame:
    """One row per frame: vote map, confidence map and sorted list of masked concepts (at most 35 entries)."""
    return masked.groupBy("path").agg(
        F.map_from_entries(F.collect_list(F.struct("concept", "v"))).alias("vote"),
        F.map_from_entries(F.collect_list(F.struct("concept", "conf"))).alias("confidence"),
        F.array_sort(F.collect_list(F.when(F.col("masked"), F.col("concept")))).alias("masked"))


def repair_json(df: DataFrame, col: str = "content", schema: str = "struct<k:int>") -> DataFrame:
    """Tolerant parse: drop code fences, take the outermost braces, retry without trailing commas."""
    bare = F.regexp_replace(F.col(col), r"```(?:json)?", "")
    obj = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    fixed = F.regexp_replace(obj, r",\s*([}\]])", "$1")
    first = F.try_parse_json(obj)
    second = F.try_parse_json(fixed)
    text = F.when(obj == "", F.lit(None)).when(first.isNotNull(), obj).when(second.isNotNull(), fixed)
    d = df.withColumn("json", text)
    return d.withColumn("parsed", F.from_json("json", schema))


def crop_box(df: DataFrame, margin: float = 0.15, min_px: int = 8, whole: float = 0.95) -> DataFrame:
    """Pixel crop of a normalised box (x0, y0, x1, y1) on a w x h image; NULL where the box is unusable."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    dx, dy = x1 - x0, y1 - y0
    valid = (x0 >= 0) & (x0 < x1) & (x1 <= 1) & (y0 >= 0) & (y0 < y1) & (y1 <= 1) & ~((dx > whole) & (dy > whole))
    edge = lambda v, size: F.floor(clip(v, 0.0, 1.0) * F.col(size)).cast("int")
    d = df.select("*", edge(x0 - dx * margin, "w").alias("bx0"), edge(y0 - dy * margin, "h").alias("by0"),
                  edge(x1 + dx * margin, "w").alias("bx1"), edge(y1 + dy * margin, "h").alias("by1"))
    ok = F.coalesce(valid & (F.col("bx1") - F.col("bx0") >= min_px) & (F.col("by1") - F.col("by0") >= min_px),
                    F.lit(False))
    return d.select(*df.columns, ok.alias("usable"), *[F.when(ok, F.col(b)).alias(b) for b in ("bx0", "by0", "bx1", "by1")])


def modal_value(votes: DataFrame, concept: str = "modality", default: str = "unknown") -> DataFrame:
    """Most common raw value of one concept per frame; ties go to the alphabetically first value."""
    v = votes.filter((F.col("concept") == concept) & F.col("raw").isNotNull() & (F.col("raw") != ""))
    g = v.groupBy("path", "raw").agg(F.count(F.lit(1)).alias("n"))
    best = g.groupBy("path").agg(F.min_by("raw", F.struct(-F.col("n"), F.col("raw"))).alias(concept))
    return votes.select("path").distinct().join(best, "path", "left").select(
        "path", F.coalesce(F.col(concept), F.lit(default)).alias(concept))


def raw_value_domain(votes: DataFrame) -> DataFrame:
    """Conformance per concept: votes outside the allowed raw values (NA spellings count as allowed)."""
    d = with_vocabulary(votes, "allowed", "kind")
    bad = ~(is_not_assessable(F.col("raw")) | F.array_contains("allowed", F.col("raw")))
    return d.groupBy("concept", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(is_not_assessable(F.col("raw")), 1)).alias("n_na"),
        F.count(F.when(bad, 1)).alias("n_outside"),
        (F.count(F.when(bad, 1)) * 100.0 / F.count(F.lit(1))).alias("pct_outside"))
