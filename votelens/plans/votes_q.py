"""Vote, trust and curation queries."""

from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.functions import scalars as X
from votelens.functions.scalars import hash_byte
from votelens.operators import labels as L
from votelens.operators import trust as TR
from votelens.operators import votes as VO
from votelens.plans import sqlviews as S
from votelens.plans.registry import query


@query("normalize_votes", "SELECT path, expert, lens, concept, kind, value, mask FROM nvotes", "nvotes", r="value")
def normalize_votes(i):
    return VO.normalize_votes(i.votes)


@query("is_not_assessable", """SELECT concept, count(*) AS n, count(*) FILTER (coalesce(lower(trim(raw)), '') IN ('not_assessable', 'na', '')) AS n_na
  FROM votes GROUP BY concept""", "votes")
def is_not_assessable(i):
    return i.votes.groupBy("concept").agg(F.count(F.lit(1)).alias("n"),
                                          F.count(F.when(X.is_not_assessable(F.col("raw")), 1)).alias("n_na"))


def direction_sql(raw, c="c"):
    return f"""CASE WHEN coalesce(lower(trim({raw})), '') IN ('not_assessable', 'na', '') THEN NULL
      WHEN {c}.kind = 'ordinal' THEN try_cast({raw} as double) >= 2.0
      WHEN {c}.kind = 'binary' THEN lower(trim({raw})) IN ('yes', 'true', '1') ELSE list_contains({c}.abnormal, {raw}) END"""


@query("abnormal_direction", f"""SELECT concept, d AS abnormal_dir, count(*) AS n FROM (
  SELECT concept, {direction_sql('raw')} AS d FROM votes v JOIN vocab c USING (concept)) GROUP BY 1, 2""", "votes vocab")
def abnormal_direction(i):
    return VO.abnormal_direction(i.votes).groupBy("concept", "abnormal_dir").agg(F.count(F.lit(1)).alias("n"))


@query("aggregate_votes", "SELECT path, concept, c, r, m, n_votes FROM cells", "cells", r="c r m")
def aggregate_votes(i):
    return i.cells


@query("cell_trust", "SELECT path, concept, core, value, trust, supervise, cross_read FROM trusted_x", "trusted_x", r="value trust")
def cell_trust(i):
    return i.trusted_x


@query("cross_anchor_join", """SELECT c.path, c.concept, c.c, x.c_alt, 1.0 - abs(c.c - x.c_alt) AS agreement FROM cells c
  LEFT JOIN cross_alt x USING (path, concept) WHERE concept IN (SELECT concept FROM vocab WHERE core)""", "cells cross_alt vocab",
       r="c c_alt agreement")
def cross_anchor_join(i):
    c = i.cells.filter(F.col("concept").isin(V.ROBUST_CORE)).select("path", "concept", "c")
    return c.join(i.cross_alt, ["path", "concept"], "left").withColumn("agreement", 1.0 - F.abs(F.col("c") - F.col("c_alt")))


@query("gate_weights", """SELECT concept, role, gate, legacy_gate, count(*) AS cells, count(*) FILTER (legacy_gate > 0) AS legacy_cells
  FROM cells JOIN vocab USING (concept) GROUP BY 1, 2, 3, 4""", "cells vocab")
def gate_weights(i):
    return TR.gate_weights(i.cells)


@query("legacy_gate_trust", "SELECT path, concept, value, trust, supervise FROM t", "cells",
       {"t": S.trusted_of("cells", gate="legacy_gate")}, "value trust")
def legacy_gate_trust(i):
    return TR.cell_trust(i.cells, legacy_gate=True).select("path", "concept", "value", "trust", "supervise")


@query("curate_frames", "SELECT * FROM curated", "curated", r="frame_trust suspicion")
def curate_frames(i):
    return i.curated


@query("curate_frames_verified", "SELECT * FROM curated_x", "curated_x", r="frame_trust suspicion")
def curate_frames_verified(i):
    return i.curated_x


@query("decide", """SELECT decision, label, count(*) AS n, min(frame_trust) AS min_trust, max(suspicion) AS max_suspicion
  FROM curated GROUP BY 1, 2""", "curated", r="min_trust max_suspicion")
def decide(i):
    return i.curated.groupBy("decision", "label").agg(F.count(F.lit(1)).alias("n"), F.min("frame_trust").alias("min_trust"),
                                                      F.max("suspicion").alias("max_suspicion"))


@query("decision_counts", f"""SELECT decision, count(*) AS frames, sum(cells)::bigint AS supervised_cells, {S.m4('frame_trust')} AS mean_trust
  FROM curated JOIN (SELECT path, count(*) FILTER (supervise) AS cells FROM trusted GROUP BY path) USING (path) GROUP BY decision""",
       "curated trusted", r="mean_trust")
def decision_counts(i):
    return TR.decision_counts(i.curated, i.trusted)


BAND_SQL = """SELECT CASE WHEN frame_trust >= 0.75 THEN 'high' WHEN frame_trust >= 0.5 THEN 'medium' ELSE 'low' END AS band,
  count(*) AS n FROM curated GROUP BY 1"""


@query("trust_band", BAND_SQL, "curated")
@query("expected_band", BAND_SQL, "curated")
def expected_band(i):
    return i.curated.groupBy(TR.trust_band(F.col("frame_trust")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("raw_value_domain", """SELECT concept, kind, count(*) AS n, count(*) FILTER (na) AS n_na,
  count(*) FILTER (NOT na AND NOT list_contains(allowed, raw)) AS n_outside,
  count(*) FILTER (NOT na AND NOT list_contains(allowed, raw)) * 100.0::double / count(*) AS pct_outside
  FROM (SELECT *, coalesce(lower(trim(raw)), '') IN ('not_assessable', 'na', '') AS na
        FROM (SELECT * REPLACE (CASE WHEN """ + S.h("typo", "path", "expert", "lens", "concept") + """ < 6 THEN raw || '?' ELSE raw END AS raw) FROM votes)
        JOIN vocab USING (concept)) GROUP BY concept, kind""", "votes vocab", r="pct_outside")
def raw_value_domain(i):
    typo = hash_byte("typo", "path", "expert", "lens", "concept") < 6
    return VO.raw_value_domain(i.votes.withColumn("raw", F.when(typo, F.concat("raw", F.lit("?"))).otherwise(F.col("raw"))))


@query("vocabulary", """SELECT tier, role, chunk, core, count(DISTINCT concept) AS concepts, count(*) AS cells, avg(m) AS coverage
  FROM cells JOIN vocab USING (concept) GROUP BY 1, 2, 3, 4""", "cells vocab", r="coverage")
def vocabulary(i):
    d = VO.with_vocabulary(i.cells, "tier", "role", "chunk", "core")
    return d.groupBy("tier", "role", "chunk", "core").agg(F.count_distinct("concept").alias("concepts"),
                                                          F.count(F.lit(1)).alias("cells"), F.avg("m").alias("coverage"))


@query("truncate_votes", """SELECT expert, lens, count(*) AS n FROM votes
  WHERE lens < CASE WHEN expert = 'proagent' THEN 1 ELSE 2 END GROUP BY 1, 2""", "votes")
def truncate_votes(i):
    return VO.truncate_votes(i.votes, 2, {"proagent": 1}).groupBy("expert", "lens").agg(F.count(F.lit(1)).alias("n"))


@query("request_plan", """SELECT path, expert, seed, (seed - 1) % 5 AS lens, 0.4::double + 0.1::double * ((seed - 1) % 3) AS temperature
  FROM frames, (VALUES ('proagent', 1), ('flash3', 1), ('flash3', 2), ('flash3', 3), ('flash3', 4), ('flash3', 5), ('flash3', 6)) t(expert, seed)""",
       "frames", r="temperature")
def request_plan(i):
    return VO.request_plan(i.frames, {"proagent": 1, "flash3": 6})


def anchors_of(i):
    """A fixed few-shot set: the five surest labelled frames of the curated store."""
    from pyspark.sql import Window
    a = i.curated.filter("label >= 0").orderBy(F.col("frame_trust").desc(), "path").limit(5)
    return a.withColumn("pos", F.row_number().over(Window.orderBy(F.col("frame_trust").desc(), "path")))


@query("vote_key", """SELECT f.path, e.expert, sig.s AS anchor_sig,
    substr(sha1(split_part(f.path, '/', -1) || '|' || e.expert || '.single.q|' || sig.s), 1, 16) AS vote_key
  FROM frames f, (VALUES ('proagent'), ('flash3')) e(expert),
    (SELECT string_agg(split_part(path, '/', -1), ',' ORDER BY frame_trust DESC, path) AS s FROM (
      SELECT * FROM curated WHERE label >= 0 ORDER BY frame_trust DESC, path LIMIT 5)) sig""", "frames curated")
def vote_key(i):
    items = i.frames.select("path", F.explode(F.array(F.lit("proagent"), F.lit("flash3"))).alias("expert"))
    return VO.vote_key(items, anchors_of(i))


READINGS = {
    "readings0": f"""SELECT path, stage, concept, raw, {S.h('conf', 'path', 'stage', 'concept')} / 256.0::double AS conf,
      {S.h('form', 'path', 'stage', 'concept')} AS form FROM (SELECT path, concept, raw,
        CASE lens WHEN 0 THEN 'draft' WHEN 1 THEN 'refine' ELSE 'confirm' END AS stage FROM votes WHERE expert = 'flash3')""",
    "readings": f"""SELECT path, stage, concept, CASE WHEN form < 16 THEN 'not_assessable' ELSE raw END AS v,
      CASE WHEN form < 16 THEN 0.0::double WHEN form < 140 THEN 1.0::double ELSE conf END AS conf FROM readings0
      WHERE stage = 'draft' OR (stage = 'refine' AND concept IN ({S.quoted(V.DISCRIMINATIVE)}) AND form < 200)
        OR (stage = 'confirm' AND concept IN ({S.quoted(V.ROBUST_CORE)}))""",
}
MERGED = READINGS | {
    "shown": """SELECT path, bool_or((concept = 'lesion_present' AND lower(trim(v)) IN ('yes', 'true', '1'))
      OR (concept = 'demarcation' AND coalesce(try_cast(v as double) >= 2, false))) AS shown FROM readings WHERE stage = 'draft' GROUP BY path""",
    "merged": f"""SELECT d.path, d.concept,
      CASE WHEN d.concept IN ({S.quoted(V.MORPHOLOGY)}) AND NOT s.shown THEN 'not_assessable' WHEN f.v IS NOT NULL THEN f.v ELSE d.v END AS v,
      CASE WHEN d.concept IN ({S.quoted(V.MORPHOLOGY)}) AND NOT s.shown THEN 1.0::double WHEN f.v IS NOT NULL THEN f.conf ELSE d.conf END AS conf
      FROM readings d JOIN shown s USING (path)
      LEFT JOIN readings f ON f.path = d.path AND f.concept = d.concept AND f.stage = 'refine' WHERE d.stage = 'draft'""",
}


@query("normalize_cell", "SELECT * FROM readings", "votes", READINGS, "conf")
def normalize_cell(i):
    return VO.normalize_cell(i.stage_readings).drop("why")


@query("merge_stage_readings", "SELECT * FROM merged", "votes", MERGED, "conf")
def merge_stage_readings(i):
    return VO.merge_stage_readings(i.stage_readings)


MASKED = MERGED | {"masked": f"""SELECT path, concept, v, conf, conf < conf_floor OR coalesce(dd <> cd, false) AS masked FROM (
    SELECT m.path, m.concept, m.v, m.conf, c.conf_floor, {direction_sql('m.v')} AS dd, {direction_sql('k.v')} AS cd
    FROM merged m JOIN vocab c USING (concept) LEFT JOIN readings k ON k.path = m.path AND k.concept = m.concept AND k.stage = 'confirm')"""}


@query("mask_low_confidence", "SELECT path, concept, CASE WHEN masked THEN 'not_assessable' ELSE v END AS v, conf, masked FROM masked",
       "votes vocab", MASKED, "conf")
def mask_low_confidence(i):
    r = i.stage_readings
    confirm = VO.normalize_cell(r.filter("stage = 'confirm'"))
    return VO.mask_low_confidence(VO.merge_stage_readings(r), confirm)


@query("vote_record", """SELECT path, count(*) AS n_vote, string_agg(concept, ',' ORDER BY concept) FILTER (masked) AS masked,
  sum(conf) AS conf_sum FROM masked GROUP BY path""", "votes vocab", MASKED, "conf_sum")
def vote_record(i):
    r = VO.vote_record(mask_low_confidence(i))
    total = F.aggregate(F.map_values("confidence"), F.lit(0.0), lambda a, b: a + b)
    names = F.when(F.size("masked") > 0, F.array_join("masked", ","))
    return r.select("path", F.size("vote").cast("long").alias("n_vote"), names.alias("masked"), total.alias("conf_sum"))


@query("repair_json", f"""SELECT cast(event_id as varchar) AS name, CASE WHEN {S.h('pr', 'event_id')} < 36 THEN NULL
  ELSE cast(json_extract(props, '$.k') as int) END AS k FROM events""")
def repair_json(i):
    return VO.repair_json(i.raw_json).select("name", F.col("parsed.k").alias("k"))


def _box(i):
    e = i.table("events").select("event_id")
    f = lambda s: hash_byte(s, "event_id") / F.lit(200.0)
    return e.select(F.col("event_id").cast("string").alias("name"), f("x0").alias("x0"), f("y0").alias("y0"), f("x1").alias("x1"),
                    f("y1").alias("y1"), (F.lit(64) + hash_byte("w", "event_id")).alias("w"), (F.lit(64) + hash_byte("hh", "event_id")).alias("h"))


_hb = lambda s: f"{S.h(s, 'event_id')} / 200.0::double AS {s}"


@query("crop_box", f"""SELECT name, coalesce(valid AND bx1 - bx0 >= 8 AND by1 - by0 >= 8, false) AS usable,
    CASE WHEN valid AND bx1 - bx0 >= 8 AND by1 - by0 >= 8 THEN bx0 END AS bx0, CASE WHEN valid AND bx1 - bx0 >= 8 AND by1 - by0 >= 8 THEN by0 END AS by0,
    CASE WHEN valid AND bx1 - bx0 >= 8 AND by1 - by0 >= 8 THEN bx1 END AS bx1, CASE WHEN valid AND bx1 - bx0 >= 8 AND by1 - by0 >= 8 THEN by1 END AS by1
  FROM (SELECT *, x0 >= 0 AND x0 < x1 AND x1 <= 1 AND y0 >= 0 AND y0 < y1 AND y1 <= 1 AND NOT (x1 - x0 > 0.95 AND y1 - y0 > 0.95) AS valid,
      cast(floor(greatest(0.0, least(1.0, x0 - (x1 - x0) * 0.15::double)) * w) as int) AS bx0, cast(floor(greatest(0.0, least(1.0, y0 - (y1 - y0) * 0.15::double)) * hgt) as int) AS by0,
      cast(floor(greatest(0.0, least(1.0, x1 + (x1 - x0) * 0.15::double)) * w) as int) AS bx1, cast(floor(greatest(0.0, least(1.0, y1 + (y1 - y0) * 0.15::double)) * hgt) as int) AS by1
    FROM (SELECT cast(event_id as varchar) AS name, {_hb('x0')}, {_hb('y0')}, {_hb('x1')}, {_hb('y1')}, 64 + {S.h('w', 'event_id')} AS w,
      64 + {S.h('hh', 'event_id')} AS hgt FROM events))""")
def crop_box(i):
    return VO.crop_box(_box(i)).select("name", "usable", "bx0", "by0", "bx1", "by1")


@query("modal_value", """SELECT f.path, coalesce(m.raw, 'unknown') AS modality FROM frames f LEFT JOIN (
  SELECT path, arg_min(raw, row(-n, raw)) AS raw FROM (SELECT path, raw, count(*) AS n FROM votes WHERE concept = 'modality' GROUP BY 1, 2)
  GROUP BY path) m USING (path)""", "frames votes")
def modal_value(i):
    return VO.modal_value(i.votes)


@query("concept_arrays", """SELECT path, string_agg(printf('%.4f', coalesce(value, 0)), ',' ORDER BY ord) AS value,
    string_agg(printf('%.4f', coalesce(trust, 0)), ',' ORDER BY ord) AS trust, string_agg(CASE WHEN supervise THEN '1' ELSE '0' END, ',' ORDER BY ord) AS supervise
  FROM (SELECT f.path, v.ord, t.value, t.trust, t.supervise FROM frames f CROSS JOIN vocab v LEFT JOIN trusted t ON t.path = f.path AND t.concept = v.concept)
  GROUP BY path""", "frames trusted vocab")
def concept_arrays(i):
    a = TR.concept_arrays(i.records.select("path", "concepts"))
    text = lambda c, f: F.array_join(F.transform(c, lambda x: F.format_string(f, x)), ",").alias(c)
    return a.select("path", text("value", "%.4f"), text("trust", "%.4f"), text("supervise", "%.0f"))


@query("cell_matrix", "SELECT path, label, center, " + ", ".join(
    f"max({x}) FILTER (concept = '{n}') AS {n}_{x}" for n in V.NAMES for x in "crm") + " FROM lcells GROUP BY 1, 2, 3", "lcells",
       r=" ".join(f"{n}_{x}" for n in V.NAMES for x in "crm"))
def cell_matrix(i):
    m = L.cell_matrix(i.cells, i.lab)
    return m.select("path", "label", "center", *[f"{n}_{x}" for n in V.NAMES for x in "crm"])


def stored_readings(i):
    """Stored vote records per (frame, strategy): single records list votes, staged ones list stages."""
    f = i.frames.select("path", "name")
    h = hash_byte("cost", "name")
    single = F.array_repeat(F.create_map(F.lit("modality"), F.lit("white_light")), (h % 4).cast("int"))
    stages = F.concat(F.array(F.lit("context"), F.lit("region"), F.lit("chunks")),
                      F.when(h % 3 == 0, F.array(F.lit("morphology"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("confirm")))
    meta = F.array_repeat(F.struct(stages.alias("stages")), 2)
    a = f.select("path", F.lit("single").alias("strategy"), single.alias("votes"), F.array_repeat(F.struct(F.array(F.lit("x")).alias("stages")), 0).alias("meta"))
    b = f.select("path", F.lit("multistage").alias("strategy"), F.array_repeat(F.create_map(F.lit("modality"), F.lit("white_light")), 2).alias("votes"), meta.alias("meta"))
    return a.unionByName(b)


@query("call_cost", f"""SELECT strategy, sum(calls)::bigint AS calls, count(*) AS frames, sum(calls)::double / count(*) AS calls_per_frame FROM (
  SELECT 'single' AS strategy, hh % 4 AS calls FROM (SELECT {S.h('cost', 'name')} AS hh FROM frames) UNION ALL
  SELECT 'multistage', 2 * (6 + CASE WHEN hh % 3 = 0 THEN 1 ELSE 0 END) FROM (SELECT {S.h('cost', 'name')} AS hh FROM frames)) GROUP BY strategy""",
       "frames", r="calls_per_frame")
def call_cost(i):
    return L.call_cost(stored_readings(i))


@query("gap_fill", f"""SELECT f.path, e.expert FROM frames f, (VALUES ('proagent'), ('flash3')) e(expert)
  WHERE NOT ({S.h('done', 'path', 'expert')} < 128 AND {S.h('done', 'path', 'expert')} % 8 > 0)""", "frames")
def gap_fill(i):
    work = VO.request_plan(i.frames, {"proagent": 1, "flash3": 1}).select("path", "expert")
    h = hash_byte("done", "path", "expert")
    stored = work.filter(h < 128).withColumn("n_votes", h % 8)
    return L.gap_fill(work, stored, ["path", "expert"])


@query("complete_frames", f"""SELECT path FROM frames WHERE {S.h('done', 'path', "'proagent'")} < 160 AND {S.h('done', 'path', "'flash3'")} < 160""", "frames")
def complete_frames(i):
    work = VO.request_plan(i.frames, {"proagent": 1, "flash3": 1}).select("path", "expert")
    return L.complete_frames(work.filter(hash_byte("done", "path", "expert") < 160), ["proagent", "flash3"])


@query("config_cross", """SELECT config, expert, count(*) AS n FROM votes, (VALUES ('1x1', 1, 1), ('1x2', 1, 2), ('2x2', 2, 2), ('2x3', 2, 3)) g(config, e, v)
  WHERE CASE expert WHEN 'proagent' THEN 1 ELSE 2 END <= e AND lens < v GROUP BY 1, 2""", "votes")
def config_cross(i):
    from votelens.operators.sweeps import grid
    rows = F.filter(F.array(*[F.when(keep, F.lit(c)) for c, keep in grid([(1, 1), (1, 2), (2, 2), (2, 3)], V.EXPERT_ORDER).items()]),
                    lambda c: c.isNotNull())
    return i.votes.select("expert", F.explode(rows).alias("config")).groupBy("config", "expert").agg(F.count(F.lit(1)).alias("n"))


