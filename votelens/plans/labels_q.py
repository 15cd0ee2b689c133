"""Label-store queries: validation, set checks, joins, profiles."""

from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.functions.scalars import hash_byte
from votelens.operators import evaluation as EV
from votelens.operators import labels as L
from votelens.operators import mining as M
from votelens.operators import trust as TR
from votelens.plans import sqlviews as S
from votelens.plans.registry import query


def damaged(i):
    """Label records as text with one kind of damage in some of them (chosen by a hash of the name)."""
    rec = i.records
    h = hash_byte("dmg", "name")
    concepts = F.when(h.between(30, 39), F.map_filter("concepts", lambda k, v: k != "demarcation")).when(
        h.between(40, 49), F.map_concat("concepts", F.map_from_arrays(F.array(F.lit("halo")), F.array(F.struct(
            F.lit(0.5).alias("value"), F.lit(0.5).alias("trust"), F.lit(True).alias("supervise")))))).otherwise(F.col("concepts"))
    text = F.to_json(F.struct("image", "name", "split", "label", F.when(~h.between(0, 9), F.col("center")).alias("center"),
                              F.when(h.between(20, 29), "MAYBE").otherwise(F.col("decision")).alias("decision"),
                              "frame_trust", "suspicion", "verified", concepts.alias("concepts")))
    text = F.when(h.between(10, 19), F.regexp_replace(text, '"label":-?[0-9]+', '"label":true')).when(
        h.between(50, 59), F.substring(text, 1, 40)).when(
        h.between(60, 69), F.regexp_replace(text, '"supervise":(true|false)', '"supervise":1')).otherwise(text)
    return rec.select("name", text.alias("value"))


_H = S.h("dmg", "name")


@query("validate_labels", f"""SELECT problem, count(*) AS n FROM (
  SELECT CASE WHEN d BETWEEN 0 AND 9 THEN 'missing key center' WHEN d BETWEEN 10 AND 19 THEN 'wrong type label' WHEN d BETWEEN 20 AND 29 THEN 'unknown decision'
    WHEN d BETWEEN 30 AND 39 THEN 'missing concept demarcation' WHEN d BETWEEN 40 AND 49 THEN 'unknown concept halo'
    WHEN d BETWEEN 50 AND 59 THEN 'invalid JSON' END AS problem FROM (SELECT {_H} AS d FROM frames) WHERE d <= 59
  UNION ALL SELECT 'wrong type supervise in ' || concept FROM frames CROSS JOIN vocab WHERE {_H} BETWEEN 60 AND 69
  UNION ALL SELECT 'image not found' FROM frames WHERE {_H} NOT BETWEEN 50 AND 59 AND {S.h('noimg', 'name')} < 12) GROUP BY problem""", "frames vocab")
def validate_labels(i):
    images = i.frames.filter(hash_byte("noimg", "name") >= 12).select(F.concat(F.lit("images/"), "name", F.lit(".jpg")).alias("image"))
    p = L.validate_labels(damaged(i), images)
    problem = F.when(F.col("problem").startswith("image not found"), "image not found").otherwise(F.col("problem"))
    return p.groupBy(problem.alias("problem")).agg(F.count(F.lit(1)).alias("n"))


_IMG, _LAB = S.h("noimg", "name") + " >= 12", S.h("nolab", "name") + " >= 20"


@query("missing_and_orphan", f"""SELECT dir, count(*) FILTER (img) AS images, count(*) FILTER (lb) AS labels, count(*) FILTER (img AND NOT lb) AS missing_labels,
  count(*) FILTER (lb AND NOT img) AS orphan_labels, count(*) FILTER (lb AND NOT img) = 0 AS ok FROM (SELECT dir, {_IMG} AS img, {_LAB} AS lb FROM frames)
  WHERE img OR lb GROUP BY dir""", "frames")
def missing_and_orphan(i):
    f = i.frames
    return L.missing_and_orphan(f.filter(hash_byte("noimg", "name") >= 12), f.filter(hash_byte("nolab", "name") >= 20))


@query("set_differences", f"""SELECT name, 'missing' AS side FROM frames WHERE {_IMG} AND NOT {_LAB} UNION ALL
  SELECT name, 'orphan' FROM frames WHERE {_LAB} AND NOT {_IMG}""", "frames")
def set_differences(i):
    img = i.frames.filter(hash_byte("noimg", "name") >= 12).select("name")
    lab = i.frames.filter(hash_byte("nolab", "name") >= 20).select("name")
    return img.exceptAll(lab).withColumn("side", F.lit("missing")).unionByName(lab.exceptAll(img).withColumn("side", F.lit("orphan")))


@query("assemble", f"""SELECT e.name, t.path IS NOT NULL AS has_concept, coalesce(t.v, 0.0) AS value_sum, coalesce(t.s, 0)::double AS supervised,
    c.suspicion, coalesce(c.decision, '') AS decision
  FROM embedding_pools e LEFT JOIN (SELECT * FROM curated WHERE {S.h('nolab', 'name')} >= 60) c USING (name)
  LEFT JOIN (SELECT path, sum(value) AS v, count(*) FILTER (supervise) AS s FROM trusted GROUP BY path) t USING (path)""",
       "embedding_pools curated trusted", r="value_sum supervised suspicion")
def assemble(i):
    rec = TR.concept_arrays(i.records).filter(hash_byte("nolab", "name") >= 60)
    rec = rec.select("name", "value", "trust", "supervise", "suspicion", "decision")
    twice = rec.withColumn("version", F.lit(2)).unionByName(rec.withColumn("version", F.lit(1)).withColumn("decision", F.lit("STALE")))
    a = L.assemble(i.embedding_pools, twice)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda x, y: x + y)
    return a.select("name", "has_concept", total("c_value").alias("value_sum"), total("c_supervise").alias("supervised"), "suspicion", "decision")


@query("lookup_with_default", f"""SELECT path, coalesce(decision, '?') AS decision, coalesce(suspicion, 0.0) AS suspicion FROM frames
  LEFT JOIN (SELECT path, decision, suspicion FROM curated WHERE {S.h('nolab', 'name')} >= 60) USING (path)""", "frames curated", r="suspicion")
def lookup_with_default(i):
    return L.lookup_with_default(i.frames.select("path"), i.curated.filter(hash_byte("nolab", "name") >= 60))


@query("attach_center", f"""SELECT name, suspicion AS score, CASE WHEN {S.h('nolab', 'name')} >= 60 THEN center ELSE '' END AS center FROM curated""", "curated", r="score")
def attach_center(i):
    c = i.curated
    return L.attach_center(c.select("name", F.col("suspicion").alias("score")), i.frames.filter(hash_byte("nolab", "name") >= 60))


@query("alignment_report", f"""SELECT count(*) FILTER (a AND b) AS matched, count(*) FILTER (a AND NOT b) AS missing_right, count(*) FILTER (b AND NOT a) AS missing_left,
  count(*) FILTER (a <> b) = 0 AS aligned FROM (SELECT {_IMG} AS a, {_LAB} AS b FROM frames)""", "frames")
def alignment_report(i):
    return L.alignment_report(i.frames.filter(hash_byte("noimg", "name") >= 12), i.frames.filter(hash_byte("nolab", "name") >= 20))


@query("align_by_name", "SELECT name, score, label, score_b FROM scored_rare", "scored_rare", r="score score_b")
def align_by_name(i):
    return L.align_by_name(i.scored_rare.select("name", "score", "label"), i.scored_rare.select("name", "score_b"))


@query("existing_only", f"SELECT path FROM frames WHERE {_IMG}", "frames")
def existing_only(i):
    return L.existing_only(i.frames.select("path"), i.frames.filter(hash_byte("noimg", "name") >= 12))


_MD = "cast('0x' || substr(md5(path), 1, 8) as bigint)"


@query("preflight_paths", f"""SELECT count(*) AS checked, count(*) FILTER (NOT img) AS missing, min(path) FILTER (NOT img) AS example, count(*) FILTER (NOT img) = 0 AS ok
  FROM (SELECT path, {_IMG} AS img FROM frames WHERE label >= 0 OR {_MD} % 20 = 0)""", "frames")
def preflight_paths(i):
    return L.preflight_paths(i.frames, i.frames.filter(hash_byte("noimg", "name") >= 12), 20)


@query("union_dedup", f"""SELECT path, CASE WHEN {S.h('split', 'name')} < 192 THEN 'first' ELSE 'second' END AS origin FROM frames""", "frames")
def union_dedup(i):
    a = i.frames.filter(hash_byte("split", "name") < 192).select("path", F.lit("first").alias("origin"))
    return L.union_dedup(a, i.frames.select("path", F.lit("second").alias("origin")))


@query("keep_originals", f"""SELECT path, aug FROM (SELECT path, CASE WHEN hh < 64 THEN NULL WHEN hh < 100 THEN '' WHEN hh < 180 THEN 'orig' ELSE 'flip' END AS aug
  FROM (SELECT path, {S.h('aug', 'path')} AS hh FROM frames)) WHERE aug IS NULL OR aug IN ('', 'orig')""", "frames")
def keep_originals(i):
    from votelens.sources.readers import keep_originals as keep
    h = hash_byte("aug", "path")
    aug = F.when(h < 64, F.lit(None)).when(h < 100, "").when(h < 180, "orig").otherwise("flip")
    return keep(i.frames.select("path", aug.alias("aug")))


@query("drop_abstain", "SELECT center, count(*) FILTER (decision <> 'ABSTAIN') AS kept, count(*) FILTER (decision = 'ABSTAIN') AS skipped FROM curated GROUP BY center", "curated")
def drop_abstain(i):
    ab = F.col("decision") == "ABSTAIN"
    return i.curated.groupBy("center").agg(F.count(F.when(~ab, 1)).alias("kept"), F.count(F.when(ab, 1)).alias("skipped"))


@query("holdout_filter", """SELECT 'center_1' AS holdout, path FROM frames WHERE label >= 0 AND center <> 'center_1'
  UNION ALL SELECT 'labeled', path FROM frames WHERE label < 0 UNION ALL SELECT 'none', path FROM frames""", "frames")
def holdout_filter(i):
    part = lambda h: M.holdout_filter(i.frames, h).select(F.lit(h).alias("holdout"), "path")
    return part("center_1").unionByName(part("labeled")).unionByName(part("none"))


@query("concept_profile", f"""SELECT concept, count(*) AS n, count(*) FILTER (supervise) * 100.0::double / count(*) AS pct_supervised, {S.m4('trust')} AS mean_trust,
  {S.m4('value')} AS mean_value, count(*) FILTER (value > 0) * 100.0::double / count(*) AS pct_gt0, count(*) FILTER (value > 0.5) * 100.0::double / count(*) AS pct_gt05,
  quantile_cont(value, 0.9) AS p90 FROM trusted GROUP BY concept""", "trusted", r="pct_supervised mean_trust mean_value pct_gt0 pct_gt05 p90")
def concept_profile(i):
    return L.concept_profile(i.trusted)


@query("suspicion_profile", f"""SELECT count(*) AS n, {S.m4('suspicion')} AS mean, quantile_cont(suspicion, 0.5) AS p50, quantile_cont(suspicion, 0.9) AS p90,
  quantile_cont(suspicion, 0.99) AS p99, count(*) FILTER (suspicion > 0.5)::double / count(*) AS frac_gt05 FROM curated""", "curated", r="mean p50 p90 p99 frac_gt05")
def suspicion_profile(i):
    return L.suspicion_profile(i.curated)


PRIORS = """SELECT concept, n_supervised, prior, least(greatest((1.0::double - prior) / least(greatest(prior, 1e-3::double), 1.0::double), 1.0::double), 10.0::double) AS pos_weight FROM (
  SELECT concept, n_supervised, sv / (n_supervised + 1e-6::double) AS prior FROM (SELECT concept, count(*) FILTER (supervise)::double AS n_supervised,
    coalesce(sum(value) FILTER (supervise), 0.0::double) AS sv FROM trusted GROUP BY concept))"""


@query("priors_and_posw", PRIORS, "trusted", r="n_supervised prior pos_weight")
def priors_and_posw(i):
    return L.priors_and_posw(i.trusted)


def route_sql(lane, weight):
    q = S.quoted
    return f"""SELECT concept, std, CASE WHEN std <= 1e-4 THEN 'DROP' WHEN concept IN ({q(V.CURATED9 + V.SCENE_QUALITY)}) THEN 'MAIN' WHEN role = 'center_cue' THEN 'CENTER'
      WHEN concept IN ({q(V.ALIVE_CONTEXT + V.ACQ_QUALITY)}) THEN '{lane}' ELSE 'DROP' END AS head,
      CASE WHEN std <= 1e-4 THEN 0.0 WHEN concept IN ({q(V.CURATED9)}) THEN 1.0 WHEN concept IN ({q(V.SCENE_QUALITY)}) THEN 0.3 WHEN role = 'center_cue' THEN 1.0
      WHEN concept IN ({q(V.ACQ_QUALITY)}) THEN {weight} WHEN concept IN ({q(V.ALIVE_CONTEXT)}) THEN 1.0 ELSE 0.0 END::double AS weight
      FROM (SELECT concept, role, coalesce(stddev_pop(value) FILTER (supervise), 0.0) AS std FROM trusted JOIN vocab USING (concept) GROUP BY 1, 2)"""


@query("route_concepts", route_sql("AUX", 0.3), "trusted vocab", r="std weight")
def route_concepts(i):
    return L.route_concepts(i.trusted)


@query("route_concepts_grl", route_sql("CENTER", 1.0), "trusted vocab", r="std weight")
def route_concepts_grl(i):
    return L.route_concepts(i.trusted, "grl")


@query("reliability_coverage", """SELECT grp, sum(r) / count(*) AS reliability, sum(m) / count(*) AS coverage FROM (
  SELECT 'core' AS grp, r, m FROM cells JOIN vocab USING (concept) WHERE core UNION ALL SELECT 'discriminative', r, m FROM cells JOIN vocab USING (concept)
  WHERE role = 'discriminative') GROUP BY grp""", "cells vocab", r="reliability coverage")
def reliability_coverage(i):
    return L.reliability_coverage(i.cells)


@query("throughput_profile", """WITH g AS (SELECT user_id % 8 AS level, count(*) AS requests, count(*) FILTER (event_type <> 'error') AS ok, sum(value) AS secs,
    list_sort(list(value)) AS v FROM events GROUP BY 1),
  p AS (SELECT level::int AS level, requests, ok, (requests - ok) * 100.0::double / requests AS err_pct, requests * 60.0::double * greatest(level, 1) / secs AS calls_per_min,
    v[1 + cast(floor(0.5 * (len(v) - 1)) as int)] AS p50, v[1 + cast(floor(0.95 * (len(v) - 1)) as int)] AS p95 FROM g)
  SELECT level, requests, ok, err_pct, calls_per_min, p50, p95, CASE WHEN err_pct > 5.0 THEN 'errors'
    WHEN calls_per_min < lag(calls_per_min) OVER (ORDER BY level) * 1.05 THEN 'plateau' ELSE '' END AS flag, max(calls_per_min) OVER () AS peak FROM p""",
       r="err_pct calls_per_min p50 p95 peak")
def throughput_profile(i):
    return L.throughput_profile(i.request_log)


NUIS = S.quoted(V.NUISANCE)


@query("nuisance_audit", f"""SELECT concept, count(*) AS n, CASE WHEN var_pop(value) > 1e-12 THEN abs(corr(value, label::double)) END AS corr_label,
  abs(avg(value) FILTER (center = 'center_1') - avg(value) FILTER (center <> 'center_1')) AS center_shift
  FROM trusted JOIN lab USING (path) WHERE concept IN ({NUIS}) GROUP BY concept""", "trusted lab", r="corr_label center_shift")
def nuisance_audit(i):
    return L.nuisance_audit(i.trusted.filter(F.col("concept").isin(V.NUISANCE)).join(i.lab, "path"))


LOG = """SELECT event_type AS run, (user_id % 12)::int AS epoch, sum(value) / count(value) / 50.0 AS train_loss, max(value) / 300.0 AS val_loss,
  CASE WHEN min(event_id) % 3 <> 0 THEN min(value) END AS auprc, max(value) AS ppv90 FROM events GROUP BY 1, 2"""


@query("select_checkpoint", f"""SELECT run, arg_max(epoch, row(coalesce(auprc, ppv90), -epoch)) AS best_epoch, max(coalesce(auprc, ppv90)) AS best_value,
  max(epoch) AS final_epoch, arg_max(coalesce(auprc, ppv90), epoch) AS final_value FROM ({LOG}) GROUP BY run""", r="best_value final_value")
def select_checkpoint(i):
    return EV.select_checkpoint(i.epoch_log)


@query("early_tail_summary", f"""SELECT run, (l - f) / greatest(n - 1, 1) AS slope, t - l AS gap, abs((l - f) / greatest(n - 1, 1)) < 0.01 AND abs(t - l) < 0.15 AS converged
  FROM (SELECT run, max(val_loss) FILTER (r = 1) AS l, max_by(val_loss, r) AS f, max(train_loss) FILTER (r = 1) AS t, max(r) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS r FROM ({LOG})) WHERE r <= 3 GROUP BY run)""", r="slope gap")
def early_tail_summary(i):
    return EV.early_tail_summary(i.epoch_log)


@query("pool_oof", "SELECT arm, n_pos + n_neg AS n, n_pos AS pos, auroc, auprc, fpr_incl AS fpr90, 0.9 / (0.9 + 100.0 * fpr_incl) AS implied_ppv FROM m",
       "scored_rare", {"oof": f"""SELECT 'a' AS arm, label, score FROM scored_rare UNION ALL SELECT 'b', label, score_b FROM scored_rare""",
                       "m": S.metrics_of(S.curve_of("oof", "arm"), "arm")}, "auroc auprc fpr90 implied_ppv")
def pool_oof(i):
    from votelens.operators.curves import stratified_folds
    s = stratified_folds(i.scored_rare, 5, ("label", "center"), "name")
    arm = lambda a, c: F.struct(F.lit(a).alias("arm"), F.col(c).alias("score"))
    oof = s.select("label", "fold", F.explode(F.array(arm("a", "score"), arm("b", "score_b"), arm("c", "score"))).alias("_a")).select("label", "fold", "_a.*")
    return EV.pool_oof(oof.filter("arm <> 'c' OR fold < 4"), 5, ["arm"])
