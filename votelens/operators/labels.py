"""Label-store operators: validation, profiles, set checks, joins by name, feature assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.functions.ordering import exact_quantiles
from votelens.functions.scalars import mean4, safe_div
from votelens.operators.votes import with_vocabulary

# Required keys of a label record and the JSON types each may have.
REQUIRED = [("image", ["STRING"]), ("name", ["STRING"]), ("split", ["STRING"]), ("label", ["INT"]),
            ("center", ["STRING"]), ("decision", ["STRING"]), ("frame_trust", ["INT", "REAL"]),
            ("suspicion", ["INT", "REAL"]), ("verified", ["BOOLEAN"]), ("concepts", ["OBJECT"])]
SUBKEYS = [("value", ["INT", "REAL"]), ("trust", ["INT", "REAL"]), ("supervise", ["BOOLEAN"])]


def _kind(schema: Column) -> Column:
    """Kind named by the schema text of a variant: STRING, INT, REAL, BOOLEAN, OBJECT, ARRAY or NULL ('' if absent)."""
    head = F.regexp_extract(schema, "^[A-Z]+", 0)
    return (F.when(schema.isNull(), "").when(head == "BIGINT", "INT").when(head.isin("DECIMAL", "DOUBLE", "FLOAT"), "REAL")
            .when(head == "VOID", "NULL").otherwise(head))


def _field(schema: Column, name: str) -> Column:
    """Schema text of one field of a flat object schema, NULL when the field is absent."""
    found = F.regexp_extract(schema, rf"[<, ]{name}: ([A-Z]+)", 1)
    return F.when(found != "", found)


def validate_labels(raw: DataFrame, images: DataFrame | None = None, text: str = "value") -> DataFrame:
    """One row per problem of each record (id, problem). A clean record yields no row.

    Records stay text until a tolerant parse, so a broken one becomes a finding instead of a failed read. Each
    key and each concept cell is typed once; all checks read that type.
    """
    keep = [c for c in raw.columns if c != text]
    d = raw.withColumn("_v", F.try_parse_json(text))
    d = d.withColumn("_top", _kind(F.schema_of_variant("_v")))
    typed = F.struct(*[_kind(F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant"))).alias(k) for k, _ in REQUIRED])
    cells = F.from_json(F.get_json_object(F.col(text), "$.concepts"), "map<string,variant>")
    cell_types = F.transform(F.map_entries(cells), lambda e: F.struct(e["key"].alias("k"), F.schema_of_variant(e["value"]).alias("s")))
    ok = F.col("_top") == "OBJECT"
    d = d.select(*keep, "_top", typed.alias("_kinds"), F.when(ok, cell_types).alias("_cells"),
                 F.try_variant_get("_v", "$.decision", "string").alias("_decision"),
                 F.try_variant_get("_v", "$.image", "string").alias("_image"))
    if images is None:
        lost = F.lit(False)
    else:
        d = d.join(images.select(F.col("image").alias("_image"), F.lit(1).alias("_hit")).distinct(), "_image", "left")
        lost = F.col("_image").isNotNull() & F.col("_hit").isNull()
    checks = [F.when(lost, F.concat(F.lit("image not found "), F.col("_image"))),
              F.when(F.col("_top") == "", F.lit("invalid JSON")),
              F.when(~ok & (F.col("_top") != ""), F.lit("top level is not an object"))]
    for key, kinds in REQUIRED:
        k = F.col(f"_kinds.{key}")
        checks.append(F.when(ok & (k == ""), F.lit(f"missing key {key}")).when(ok & ~k.isin(*kinds), F.lit(f"wrong type {key}")))
    checks.append(F.when((F.col("_kinds.decision") == "STRING") & ~F.col("_decision").isin(*V.DECISIONS), F.lit("unknown decision")))
    known = F.array(*[F.lit(n) for n in V.NAMES])
    names = F.transform("_cells", lambda c: c["k"])
    missing = F.transform(F.array_except(known, names), lambda n: F.concat(F.lit("missing concept "), n))
    extra = F.transform(F.array_except(names, known), lambda n: F.concat(F.lit("unknown concept "), n))

    def cell_problems(c: Column) -> Column:
        obj = c["s"].startswith("OBJECT")
        found = [F.when(~obj, F.concat(F.lit("concept is not an object "), c["k"]))]
        for sub, kinds in SUBKEYS:
            k = _kind(_field(c["s"], sub))
            found.append(F.when(obj & (k == ""), F.concat(F.lit(f"missing {sub} in "), c["k"])).when(
                obj & ~k.isin(*kinds), F.concat(F.lit(f"wrong type {sub} in "), c["k"])))
        return F.array(*found)

    empty = F.array().cast("array<string>")
    problems = F.filter(F.concat(F.array(*checks), F.coalesce(missing, empty), F.coalesce(extra, empty),
                                 F.coalesce(F.flatten(F.transform("_cells", cell_problems)), empty)), lambda p: p.isNotNull())
    return d.select(*keep, F.explode(problems).alias("problem"))


def missing_and_orphan(images: DataFrame, labels: DataFrame, strict: bool = False, invalid: DataFrame | None = None) -> DataFrame:
    """Per folder: images without a label, labels without an image, and whether the folder passes. With ``invalid``
    (dir, name of records with problems) a folder that holds one fails and their number is reported."""
    i = images.select("dir", "name", F.lit(1).alias("_img"))
    l = labels.select("dir", "name", F.lit(1).alias("_lab"))
    j = i.join(l, ["dir", "name"], "full")
    g = j.groupBy("dir").agg(F.count("_img").alias("images"), F.count("_lab").alias("labels"),
                             F.count(F.when(F.col("_lab").isNull(), 1)).alias("missing_labels"),
                             F.count(F.when(F.col("_img").isNull(), 1)).alias("orphan_labels"))
    ok = F.col("orphan_labels") == 0
    if invalid is not None:
        bad = invalid.select("dir", "name").distinct().groupBy("dir").agg(F.count(F.lit(1)).alias("invalid_labels"))
        g = g.join(bad, "dir", "left").withColumn("invalid_labels", F.coalesce("invalid_labels", F.lit(0).cast("long")))
        ok = ok & (F.col("invalid_labels") == 0)
    return g.withColumn("ok", ok & (F.col("missing_labels") == 0) if strict else ok)


def assemble(features: DataFrame, records: DataFrame) -> DataFrame:
    """Features left-joined to their label arrays by name; the latest duplicate wins, absent records zero-fill."""
    zeros = F.array_repeat(F.lit(0.0), len(V.NAMES))
    cols = [c for c in records.columns if c not in ("name", "version")]
    last = records.groupBy("name").agg(F.max_by(F.struct(*cols), F.col("version")).alias("_r")) \
        if "version" in records.columns else records.select("name", F.struct(*cols).alias("_r"))
    j = features.join(last, "name", "left")
    return j.select(*features.columns, F.col("_r").isNotNull().alias("has_concept"),
                    *[F.coalesce(F.col(f"_r.{c}"), zeros).alias(f"c_{c}") for c in ("value", "trust", "supervise")],
                    F.col("_r.suspicion").alias("suspicion"), F.coalesce(F.col("_r.decision"), F.lit("")).alias("decision"))


def lookup_with_default(paths: DataFrame, manifest: DataFrame) -> DataFrame:
    m = manifest.select("path", "decision", "suspicion")
    return paths.join(m, "path", "left").select(*paths.columns, F.coalesce("decision", F.lit("?")).alias("decision"),
                                                F.coalesce("suspicion", F.lit(0.0)).alias("suspicion"))


def attach_center(predictions: DataFrame, frames: DataFrame) -> DataFrame:
    """Predictions joined to centers through the file stem of the frame path."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    c = frames.select(stem.alias("name"), "center")
    return predictions.join(c, "name", "left").select(*predictions.columns, F.coalesce("center", F.lit("")).alias("center"))


def alignment_report(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    """How two row sets line up by name; `aligned` is false as soon as one row has no partner."""
    a = left.groupBy(key).agg(F.lit(1).alias("_l"))
    b = right.groupBy(key).agg(F.lit(1).alias("_r"))
    j = a.join(b, key, "full")
    g = j.agg(F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("matched"),
              F.count(F.when(F.col("_r").isNull(), 1)).alias("missing_right"),
              F.count(F.when(F.col("_l").isNull(), 1)).alias("missing_left"))
    return g.withColumn("aligned", (F.col("missing_right") == 0) & (F.col("missing_left") == 0))


def align_by_name(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    """Inner alignment that refuses to continue when a left row is missing on the right.

    The check rides along as a left join whose gap raises at run time, so no separate counting job is needed."""
    r = right.withColumn("_hit", F.lit(True))
    j = left.join(r, key, "left")
    guard = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("no partner for "), F.col(key))).cast("boolean"))
    return j.filter(F.coalesce(guard, F.lit(True))).drop("_hit")


def gap_fill(work: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Work items without a stored, non-empty result."""
    done = stored.filter(F.col("n_votes") > 0).select(*keys).distinct()
    return work.join(done, keys, "left_anti")


def complete_frames(stored: DataFrame, experts: list[str]) -> DataFrame:
    """Frames for which every expert has a stored reading."""
    n = stored.filter(F.col("expert").isin(experts)).groupBy("path").agg(F.count_distinct("expert").alias("n"))
    return n.filter(F.col("n") == len(experts)).select("path")


def existing_only(df: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    return df.join(listing.select(key).distinct(), key, "left_semi")


def preflight_paths(df: DataFrame, listing: DataFrame, every: int) -> DataFrame:
    """Check that all labelled paths and a hash-chosen 1/every of the others exist; `ok` is the verdict."""
    pick = (F.col("label") >= 0) | (F.pmod(F.conv(F.substring(F.md5("path"), 1, 8), 16, 10).cast("long"),
                                           F.lit(every)) == 0)
    chosen = df.filter(pick).join(listing.select("path", F.lit(1).alias("_hit")).distinct(), "path", "left")
    g = chosen.agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(F.col("_hit").isNull(), 1)).alias("missing"),
                   F.min(F.when(F.col("_hit").isNull(), F.col("path"))).alias("example"))
    return g.withColumn("ok", F.col("missing") == 0)


def union_dedup(*sources: DataFrame, key: str = "path") -> DataFrame:
    """Union in priority order; the first source that has a key wins."""
    tagged = None
    for i, s in enumerate(sources):
        t = s.withColumn("_prio", F.lit(i))
        tagged = t if tagged is None else tagged.unionByName(t)
    cols = [c for c in sources[0].columns if c != key]
    g = tagged.groupBy(key).agg(F.min_by(F.struct(*cols), F.col("_prio")).alias("_r"))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def concept_profile(trusted: DataFrame) -> DataFrame:
    """Per concept: % supervised, mean trust and value, % above 0 and 0.5, 90th percentile of value.

    Values carry four decimals in [0, 1], so the count-based percentile buffer holds at most 10,001 entries."""
    pct = lambda cond: F.count(F.when(cond, 1)) * 100.0 / F.count(F.lit(1))
    return trusted.groupBy("concept").agg(
        F.count(F.lit(1)).alias("n"), pct(F.col("supervise")).alias("pct_supervised"), mean4("trust").alias("mean_trust"),
        mean4("value").alias("mean_value"), pct(F.col("value") > 0).alias("pct_gt0"),
        pct(F.col("value") > 0.5).alias("pct_gt05"), F.percentile("value", 0.9).alias("p90"))


def suspicion_profile(curated: DataFrame) -> DataFrame:
    """Mean, percentiles and share above 0.5 of stored suspicion (four decimals, so the buffer is bounded)."""
    n = F.count("suspicion")
    return curated.agg(n.alias("n"), mean4("suspicion").alias("mean"),
                       F.percentile("suspicion", 0.5).alias("p50"), F.percentile("suspicion", 0.9).alias("p90"),
                       F.percentile("suspicion", 0.99).alias("p99"),
                       (F.count(F.when(F.col("suspicion") > 0.5, 1)) / n).alias("frac_gt05"))


def dedup_by_source(scored: DataFrame, policy: str = "mean") -> DataFrame:
    """One row per source. Every branch is an algebraic aggregate, so a hot source combines map-side."""
    first = lambda c: F.min_by(c, "name")
    score = {"mean": F.sum("score") / F.count("score"), "max": F.max("score"), "orig": first("score")}[policy]
    return scored.groupBy("source").agg(score.alias("score"), first("label").alias("label"),
                                        first("center").alias("center"), F.count(F.lit(1)).alias("copies"))


def center_composition(frames: DataFrame) -> DataFrame:
    g = frames.filter(F.col("label").isin(0, 1)).groupBy("center").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))
    neg = F.col("n") - F.col("positives")
    return g.select("center", "n", "positives", (F.col("positives") / F.col("n")).alias("prevalence"),
                    safe_div(neg, F.sum(neg).over(Window.partitionBy())).alias("neg_fraction"))  # one row per center


def priors_and_posw(trusted: DataFrame, cap: float = 10.0) -> DataFrame:
    """Base rate of each concept among supervised cells and its capped positive weight."""
    s = F.col("supervise").cast("double")
    g = trusted.groupBy("concept").agg(F.sum(s).alias("n_supervised"), F.sum(s * F.col("value")).alias("_sv"))
    p = F.col("_sv") / (F.col("n_supervised") + 1e-6)
    return g.select("concept", "n_supervised", p.alias("prior"),
                    F.least(F.greatest((1.0 - p) / F.least(F.greatest(p, F.lit(1e-3)), F.lit(1.0)), F.lit(1.0)),
                            F.lit(float(cap))).alias("pos_weight"))


def route_concepts(trusted: DataFrame, context_route: str = "detach", discrim: str = "curated9") -> DataFrame:
    """Head of each concept (MAIN, CENTER, AUX, DROP) with its weight; concepts constant among supervised
    cells are dropped."""
    on = F.col("supervise")
    n = F.count(F.when(on, 1))
    s = F.sum(F.when(on, F.col("value")))
    q = F.sum(F.when(on, F.col("value") * F.col("value")))
    g = with_vocabulary(trusted.drop("core"), "role").groupBy("concept", "role").agg(n.alias("n"), s.alias("s"), q.alias("q"))
    var = F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    std = F.when(F.col("n") > 0, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0)
    main = F.col("concept").isin(V.CURATED9) if discrim == "curated9" else (F.col("role") == "discriminative")
    scene = F.col("concept").isin(V.SCENE_QUALITY)
    acq = F.col("concept").isin(V.ACQ_QUALITY)
    contested = F.col("concept").isin(V.ALIVE_CONTEXT) | acq
    lane = {"detach": "AUX", "main": "MAIN", "grl": "CENTER", "drop": "DROP"}[context_route]
    alive = F.col("std") > 1e-4
    head = (F.when(~alive, "DROP").when(main | scene, "MAIN").when(F.col("role") == "center_cue", "CENTER")
            .when(contested, lane).otherwise("DROP"))
    weight = (F.when(~alive, 0.0).when(main, 1.0).when(scene, 0.3).when(F.col("role") == "center_cue", 1.0)
              .when(contested & acq & F.lit(lane in ("AUX", "MAIN")), 0.3)
              .when(contested & F.lit(lane != "DROP"), 1.0).otherwise(0.0))
    return g.withColumn("std", std).select("concept", "std", head.alias("head"), weight.alias("weight"))


def reliability_coverage(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean reliability and coverage of the core and of the discriminative concepts."""
    d = with_vocabulary(cells, "core", "role")
    groups = F.array(F.when(F.col("core"), "core"), F.when(F.col("role") == "discriminative", "discriminative"))
    d = d.withColumn("grp", F.explode(F.filter(groups, lambda g: g.isNotNull())))
    return d.groupBy(*by, "grp").agg((F.sum("r") / F.count("r")).alias("reliability"),
                                     (F.sum("m") / F.count("m")).alias("coverage"))


def cell_matrix(cells: DataFrame, frames: DataFrame) -> DataFrame:
    """One row per frame with c/r/m columns per concept; the pivot values are the fixed vocabulary."""
    p = cells.groupBy("path").pivot("concept", V.NAMES).agg(F.first("c").alias("c"), F.first("r").alias("r"),
                                                            F.first("m").alias("m"))
    return p.join(frames.select("path", "label", "center"), "path")


def call_cost(stored: DataFrame) -> DataFrame:
    """Model calls per strategy: one per vote for single readings, one per stage (three for the chunk stage)
    for staged readings."""
    stage_calls = F.aggregate(
        F.flatten(F.transform("meta", lambda m: m["stages"])), F.lit(0),
        lambda acc, s: acc + F.when(s == "chunks", 3).otherwise(1))
    calls = F.when(F.col("strategy") == "single", F.size("votes")).otherwise(stage_calls)
    g = stored.groupBy("strategy").agg(F.sum(calls).alias("calls"), F.count_distinct("path").alias("frames"))
    return g.withColumn("calls_per_frame", F.col("calls") / F.col("frames"))


def throughput_profile(log: DataFrame, seconds: str = "latency") -> DataFrame:
    """Per concurrency level: requests, errors, calls per minute, index percentiles of latency, plateau flag."""
    g = log.groupBy("level").agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("ok"), 1)).alias("ok"),
                                 F.sum(seconds).alias("_secs"))
    g = g.withColumn("err_pct", (F.col("requests") - F.col("ok")) * 100.0 / F.col("requests"))
    rate = F.col("requests") * 60.0 * F.greatest(F.col("level"), F.lit(1)) / F.col("_secs")
    g = g.withColumn("calls_per_min", rate)
    p50 = index_percentile(log, ["level"], seconds, 0.5).withColumnRenamed("q", "p50")
    p95 = index_percentile(log, ["level"], seconds, 0.95).withColumnRenamed("q", "p95")
    prev = F.lag("calls_per_min").over(Window.orderBy("level"))  # one row per level
    flag = (F.when(F.col("err_pct") > 5.0, "errors").when(F.col("calls_per_min") < prev * 1.05, "plateau")
            .otherwise(""))
    g = g.withColumn("flag", flag).withColumn("peak", F.max("calls_per_min").over(Window.partitionBy()))
    return g.join(p50, "level").join(p95, "level").select("level", "requests", "ok", "err_pct", "calls_per_min", "p50",
                                                          "p95", "flag", "peak")


def index_percentile(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The element at index floor(q * (n - 1)) of the sorted values, without sorting a group in one task."""
    from votelens.functions.ordering import prefix_sums
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    c = prefix_sums(counts, by, "_v", ["n"], descending=False)
    at = F.floor(F.lit(q) * (F.col("tot_n") - 1))
    return c.groupBy(*by).agg(F.min(F.when(F.col("cum_n") > at, F.col("_v"))).alias("q"))


def nuisance_audit(values: DataFrame) -> DataFrame:
    """|corr(concept, label)| and |mean difference between the two centers| over labelled frames, per concept."""
    n, x, y = F.count(F.lit(1)), F.col("value"), F.col("label").cast("double")
    sums = dict(sx=F.sum(x), sy=F.sum(y), sxx=F.sum(x * x), syy=F.sum(y * y), sxy=F.sum(x * y))
    one = F.col("center") == "center_1"
    g = values.groupBy("concept").agg(n.alias("n"), *[v.alias(k) for k, v in sums.items()],
                                      (F.sum(F.when(one, x)) / F.count(F.when(one, 1))).alias("_m1"),
                                      (F.sum(F.when(~one, x)) / F.count(F.when(~one, 1))).alias("_m2"))
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    corr = F.when((vx > 1e-9) & (vy > 1e-9), F.abs(cov / F.sqrt(vx * vy)))
    return g.select("concept", "n", corr.alias("corr_label"), F.abs(F.col("_m1") - F.col("_m2")).alias("center_shift"))
