"""Pool mining, sampling and batch-plan queries."""

from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.functions.scalars import hash_byte, logit
from votelens.operators import labels as L
from votelens.operators import losses as LO
from votelens.operators import mining as M
from votelens.operators import sampling as SA
from votelens.operators import votes as VO
from votelens.plans import sqlviews as S
from votelens.plans.registry import query
from votelens.sources.readers import path_parts

q = S.quoted
_MODEL = S.h("mdl", "path")


def model_scores(i, curated=None):
    """Detector scores of the pool: stored suspicion blended with a hash."""
    return (i.curated if curated is None else curated).select("path", (F.col("suspicion") * 0.5 + hash_byte("mdl", "path") / F.lit(512.0)).alias("score"))


MS = f"SELECT path, suspicion * 0.5::double + {_MODEL} / 512.0::double AS score FROM curated"


@query("unlabeled_manifest", "SELECT name, dir, path, suspicion, decision, frame_trust, suspicion > 0.7 AS gt07, suspicion > 0.85 AS gt085 FROM curated WHERE label < 0", "curated", r="suspicion frame_trust")
def unlabeled_manifest(i):
    return M.unlabeled_manifest(i.curated)


@query("exclude_dirs", "SELECT path FROM curated WHERE dir NOT IN ('src1', 'src2')", "curated")
def exclude_dirs(i):
    return M.exclude_dirs(i.curated, ["src1", "src2"]).select("path")


@query("confident_negative_mask", "SELECT path, suspicion < 0.4 AND decision = 'CONFIDENT_NEGATIVE' AS conf_neg FROM curated WHERE label < 0", "curated")
def confident_negative_mask(i):
    return i.curated.filter("label < 0").select("path", SA.confident_negative(0.4).alias("conf_neg"))


@query("top_suspicious", "SELECT path, suspicion FROM curated WHERE label < 0 ORDER BY suspicion DESC, path LIMIT 50", "curated", r="suspicion")
def top_suspicious(i):
    return SA.top_suspicious(i.curated.filter("label < 0"), 50).select("path", "suspicion")


@query("skip_top_band", "SELECT path, suspicion FROM curated WHERE label < 0 ORDER BY suspicion DESC, path LIMIT 60 OFFSET 20", "curated", r="suspicion")
def skip_top_band(i):
    return SA.skip_top_band(i.curated.filter("label < 0"), 20, 60, "suspicion").select("path", "suspicion")


@query("bucket_lists", """SELECT 'hardneg' AS list, path FROM curated WHERE label < 0 AND decision = 'HARD_NEG_CANDIDATE' UNION ALL
  SELECT 'confneg', path FROM (SELECT path FROM curated WHERE label < 0 AND decision = 'CONFIDENT_NEGATIVE' ORDER BY md5(path || '|u0'), path LIMIT 40) UNION ALL
  SELECT 'suspicious', path FROM (SELECT path FROM curated WHERE label < 0 ORDER BY suspicion DESC, path LIMIT 30)""", "curated")
def bucket_lists(i):
    return M.bucket_lists(M.unlabeled_manifest(i.curated), 40, 30)


def score_sql(name, members):
    return f"""{S.rd(f"sum(CASE WHEN concept IN ({q(members)}) THEN value * trust ELSE 0.0 END) / greatest(sum(CASE WHEN concept IN ({q(members)}) THEN trust ELSE 0.0 END), 1e-6::double)", 9)} AS {name}"""


CS = f"SELECT path, {score_sql('surface', V.CONFOUNDERS)}, {score_sql('decisive', V.DECISIVE)} FROM trusted GROUP BY path"


@query("concept_score", "SELECT * FROM cs", "trusted", {"cs": CS}, "surface decisive")
def concept_score(i):
    return M.concept_score(i.trusted, surface=V.CONFOUNDERS, decisive=V.DECISIVE)


@query("confounded_tail_mine", """SELECT path, surface, decisive FROM cs JOIN frames USING (path) WHERE label < 0
  AND decisive < (SELECT quantile_cont(decisive, 0.5) FROM cs JOIN frames USING (path) WHERE label = 1) ORDER BY surface DESC, path LIMIT 100 OFFSET 10""", "trusted frames", {"cs": CS}, "surface decisive")
def confounded_tail_mine(i):
    return M.confounded_tail_mine(i.profile, 10, 100)


@query("model_fp_mine", "SELECT path, dir, score FROM curated JOIN ms USING (path) WHERE label < 0 AND decision = 'CONFIDENT_NEGATIVE' AND dir <> 'src3' ORDER BY score DESC, path LIMIT 80 OFFSET 5",
       "curated", {"ms": MS}, "score")
def model_fp_mine(i):
    c = i.curated
    return M.model_fp_mine(M.unlabeled_manifest(c), model_scores(i, c), 5, 80, ["src3"])


GATES = {"cs": CS, "ms": MS, "gated": """SELECT path, decisive, score, decisive >= (SELECT quantile_cont(decisive, 0.5) FROM cs JOIN frames USING (path) WHERE label = 1) AS a,
  decision IN ('HARD_NEG_CANDIDATE', 'ABSTAIN') AS c, suspicion >= 0.6 AS d, score >= 0.45 AS b FROM cs JOIN curated USING (path) JOIN ms USING (path) WHERE label < 0"""}
ARGS = dict(susp_min=0.6, model_min=0.45)


@query("pseudo_positive_mine", "SELECT path, decisive, score FROM gated WHERE a AND b AND c AND d ORDER BY score DESC, path LIMIT 40", "trusted frames curated", GATES, "decisive score")
def pseudo_positive_mine(i):
    p = i.profile
    return M.pseudo_positive_mine(p, model_scores(i, p), 40, **ARGS)


@query("gate_survivors", """SELECT count(*) AS unlabeled, count(*) FILTER (a) AS after_a, count(*) FILTER (a AND c) AS after_ac, count(*) FILTER (a AND c AND d) AS after_acd,
  count(*) FILTER (a AND b AND c AND d) AS after_acdb FROM gated""", "trusted frames curated", GATES)
def gate_survivors(i):
    p = i.profile
    return M.gate_survivors(p, model_scores(i, p), **ARGS)


@query("gate_redundancy", """SELECT gate, passing_others, passing_all, CASE WHEN passing_others > 0 THEN 1.0 - passing_all::double / passing_others END AS removed_share FROM (
  SELECT 'gate_a' AS gate, count(*) FILTER (b AND c AND d) AS passing_others, count(*) FILTER (a AND b AND c AND d) AS passing_all FROM gated UNION ALL
  SELECT 'gate_b', count(*) FILTER (a AND c AND d), count(*) FILTER (a AND b AND c AND d) FROM gated UNION ALL
  SELECT 'gate_c', count(*) FILTER (a AND b AND d), count(*) FILTER (a AND b AND c AND d) FROM gated UNION ALL
  SELECT 'gate_d', count(*) FILTER (a AND b AND c), count(*) FILTER (a AND b AND c AND d) FROM gated)""", "trusted frames curated", GATES, "removed_share")
def gate_redundancy(i):
    p = i.profile
    return M.gate_redundancy(p, model_scores(i, p), **ARGS)


MAIN = V.CURATED9


@query("ambiguous_pool", f"""SELECT path, decision, string_agg(printf('%.4f', value), ',' ORDER BY concept) AS value, count(*) FILTER (supervise)::double AS supervised
  FROM curated JOIN trusted USING (path) WHERE label < 0 AND decision IN ('HARD_NEG_CANDIDATE', 'ABSTAIN') AND concept IN ({q(MAIN)}) GROUP BY 1, 2""", "curated trusted")
def ambiguous_pool(i):
    p = M.ambiguous_pool(i.trusted, i.curated, sorted(MAIN))
    return p.select("path", "decision", F.array_join(F.transform("value", lambda x: F.format_string("%.4f", x)), ",").alias("value"),
                    F.aggregate("supervise", F.lit(0.0), lambda a, x: a + x).alias("supervised"))


@query("append_pools", """SELECT path, label::double AS target, center, 'labeled' AS origin FROM frames WHERE label >= 0 UNION ALL
  SELECT path, 0.0, '', 'negative' FROM (SELECT path FROM curated WHERE label < 0 AND decision = 'CONFIDENT_NEGATIVE') UNION ALL
  SELECT path, 0.85, '', 'pseudo' FROM (SELECT path FROM curated WHERE label < 0 ORDER BY suspicion DESC, path LIMIT 30)""", "frames curated")
def append_pools(i):
    pool = i.curated.filter("label < 0")
    return M.append_pools(i.frames.filter("label >= 0"), pool.filter("decision = 'CONFIDENT_NEGATIVE'"), SA.top_suspicious(pool, 30))


@query("case_control_sample", "SELECT path, label FROM frames WHERE label = 1 UNION ALL SELECT * FROM (SELECT path, label FROM frames WHERE label = 0 ORDER BY md5(path || '|u7'), path LIMIT 60)", "frames")
def case_control_sample(i):
    return SA.case_control_sample(i.frames.select("path", "label"), 60, 7)


@query("uniform_sample", "SELECT path FROM frames ORDER BY md5(path || '|u3'), path LIMIT 120", "frames")
def uniform_sample(i):
    return SA.uniform_sample(i.frames.select("path"), 120, 3)


CM = f"SELECT path, max(value) AS core_max FROM trusted WHERE concept IN ({q(V.CURATED9)}) GROUP BY path"


@query("stratified_holdout", """SELECT path, center, pos_like, row_number() OVER (PARTITION BY center, pos_like ORDER BY md5(path || '|h0'), path)
  <= greatest(1, floor(count(*) OVER (PARTITION BY center, pos_like) * 0.15::double)) AS holdout FROM (
    SELECT path, center, (core_max > 0.4)::int AS pos_like FROM frames JOIN cm USING (path))""", "frames trusted", {"cm": CM})
def stratified_holdout(i):
    return SA.stratified_holdout(i.frames, SA.core_max(i.trusted, V.CURATED9))


@query("stratified_subset", """SELECT path, dir, true AS pos_like FROM pos UNION ALL SELECT path, dir, false FROM (
  SELECT path, dir, row_number() OVER (ORDER BY i, dir) AS rn FROM (SELECT path, dir, row_number() OVER (PARTITION BY dir ORDER BY md5(path || '|s0'), path) AS i FROM d WHERE core_max <= 0.4))
  WHERE rn <= 200 - (SELECT count(*) FROM pos)""", "frames trusted",
       {"cm": CM, "d": "SELECT path, dir, core_max FROM frames JOIN cm USING (path) WHERE label < 0",
        "pos": "SELECT path, dir FROM d WHERE core_max > 0.4 ORDER BY md5(path || '|s0'), path LIMIT 100"})
def stratified_subset(i):
    return SA.stratified_subset(i.frames, SA.core_max(i.trusted, V.CURATED9), 200)


@query("pool_sample", """SELECT path, decision, suspicion, suspicion < 0.4 AND decision = 'CONFIDENT_NEGATIVE' AS conf_neg FROM (
  SELECT * FROM curated WHERE label < 0 AND decision IN ('CONFIDENT_NEGATIVE', 'HARD_NEG_CANDIDATE') AND """ + S.h("noimg", "name") + """ >= 60) ORDER BY md5(path || '|q0'), path LIMIT 100""", "curated", r="suspicion")
def pool_sample(i):
    listing = i.frames.filter(hash_byte("noimg", "name") >= 60)
    return SA.pool_sample(i.curated.filter("label < 0"), listing, 100, 0, ["CONFIDENT_NEGATIVE", "HARD_NEG_CANDIDATE"], 0.4)


SURE = {"sure": f"""SELECT path, label, center, {S.rd("agree * assess * CASE WHEN label = 1 THEN susp ELSE 1.0 - susp END * (1.0 - artifact)", 9)} AS sureness, {S.rd('susp', 9)} AS suspicion FROM (
  SELECT path, avg(r) FILTER (core) AS agree, avg(m) FILTER (core) AS assess, avg(c) FILTER (core) AS susp, avg(c) FILTER (concept IN ({q(V.QUALITY_CHECK)})) AS artifact
  FROM cells JOIN vocab USING (concept) GROUP BY path) JOIN lab USING (path)"""}


@query("sureness", "SELECT * FROM sure", "cells vocab lab", SURE, "sureness suspicion")
def sureness(i):
    return SA.sureness(i.cells, i.frames)


@query("select_anchors", """SELECT path, kind, center, hard FROM (
  SELECT * FROM (SELECT path, center, 'neo' AS kind, false AS hard, 0 AS o, sureness FROM sure WHERE label = 1 ORDER BY sureness DESC, path LIMIT 2) UNION ALL
  SELECT path, center, 'ndbe', true, 1, sureness FROM hard UNION ALL
  SELECT path, center, 'ndbe', false, 2, sureness FROM sure WHERE label = 0 AND path NOT IN (SELECT path FROM hard)) ORDER BY o, sureness DESC, path LIMIT 5""", "cells vocab lab",
       SURE | {"hard": "SELECT * FROM sure WHERE label = 0 AND sureness > (SELECT quantile_cont(sureness, 0.5) FROM sure WHERE label = 0) ORDER BY suspicion DESC, path LIMIT 1"})
def select_anchors(i):
    return SA.select_anchors(i.cells, i.frames)


CAND = SURE | {"cand": """SELECT s.*, coalesce(m.raw, 'unknown') AS modality FROM sure s LEFT JOIN (SELECT path, arg_min(raw, row(-n, raw)) AS raw FROM (
  SELECT path, raw, count(*) AS n FROM votes WHERE concept = 'modality' GROUP BY 1, 2) GROUP BY path) m USING (path)"""}


@query("diverse_pick", """SELECT label, path, center, modality, sureness, pick FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (r > 1)::int, sureness DESC, path) AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY label, center, modality ORDER BY sureness DESC, path) AS r FROM cand)) WHERE pick <= 6""", "cells vocab lab votes", CAND, "sureness")
def diverse_pick(i):
    c = SA.sureness(i.cells, i.frames).join(VO.modal_value(i.votes), "path")
    return SA.diverse_pick(c, 6).select("label", "path", "center", "modality", "sureness", "pick")


@query("diverse_pick_plain", """SELECT label, path, sureness, pick FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sureness DESC, path) AS pick FROM cand) WHERE pick <= 6""",
       "cells vocab lab votes", CAND, "sureness")
def diverse_pick_plain(i):
    c = SA.sureness(i.cells, i.frames).join(VO.modal_value(i.votes), "path")
    return SA.diverse_pick(c, 6, diverse=False).select("label", "path", "sureness", "pick")


BATCH = {
    "sz": "SELECT n, least(8, greatest(n, 1)) AS p, greatest(1, 32 - least(8, greatest(n, 1))) AS q FROM (SELECT count(*) AS n FROM scored_rare WHERE label = 1)",
    "neg": """SELECT name, score, label, i // sz.q AS batch, (i % sz.q + sz.p)::int AS slot FROM (SELECT name, score, label, row_number() OVER (ORDER BY md5(name || '|n0'), name) - 1 AS i
      FROM scored_rare WHERE label = 0), sz""",
    "pos": "SELECT name, score, label, row_number() OVER (ORDER BY md5(name || '|p0'), name) - 1 AS i FROM scored_rare WHERE label = 1",
    "slots": """SELECT batch, s.slot::int AS slot, n, s.slot * n // p AS a, (s.slot + 1) * n // p - s.slot * n // p AS w, cast('0x' || substr(md5(batch || '|d0'), 1, 12) as bigint) AS turn,
      cast('0x' || substr(md5(batch || '|' || s.slot || '|d0'), 1, 12) as bigint) AS own FROM (SELECT DISTINCT batch FROM neg), sz, range(8) s(slot) WHERE s.slot < p AND n > 0""",
    "batches": """SELECT batch, slot, name, score, label FROM neg UNION ALL
      SELECT batch, slot, name, score, label FROM slots JOIN pos ON i = (turn + a + own % w) % n""",
    "bl": "SELECT *, ln(greatest(1e-6, least(1.0 - 1e-6, score)) / (1.0 - greatest(1e-6, least(1.0 - 1e-6, score)))) AS logit FROM batches",
}


def batches(i):
    b = SA.balanced_batches(i.scored_rare.select("name", "label"), 8, 32)
    return b.join(i.scored_rare.select("name", "score"), "name").withColumn("logit", logit(F.col("score")))


@query("balanced_batches", "SELECT batch, slot, name, label FROM batches", "scored_rare", BATCH)
def balanced_batches(i):
    return SA.balanced_batches(i.scored_rare.select("name", "label"), 8, 32)


@query("positive_repetition", """SELECT count(DISTINCT batch) AS batches, count(*) FILTER (label > 0) AS draws, count(DISTINCT name) FILTER (label > 0) AS distinct_positives,
  count(*) FILTER (label > 0)::double / count(DISTINCT name) FILTER (label > 0) AS replay FROM batches""", "scored_rare", BATCH, "replay")
def positive_repetition(i):
    return M.positive_repetition(SA.balanced_batches(i.scored_rare.select("name", "label"), 8, 32))


SP = "(greatest({x}, 0.0) + ln(1.0 + exp(-abs({x}))))"


@query("rank_loss", f"""SELECT p.batch, avg({SP.format(x='1.0 - (p.logit - n.logit)')}) AS rank_loss, count(*)::int AS pairs FROM bl p JOIN bl n USING (batch) WHERE p.label > 0 AND n.label = 0 GROUP BY p.batch""",
       "scored_rare", BATCH, "rank_loss")
def rank_loss(i):
    return LO.rank_loss(batches(i))


@query("rank_loss_hardest", f"""SELECT p.batch, avg({SP.format(x='1.0 - (p.logit - n.logit)')}) AS rank_loss, count(*)::int AS pairs FROM bl p JOIN (
  SELECT *, row_number() OVER (PARTITION BY batch ORDER BY logit DESC) AS hard FROM bl WHERE label = 0) n USING (batch) WHERE p.label > 0 AND hard <= 5 GROUP BY p.batch""", "scored_rare", BATCH, "rank_loss")
def rank_loss_hardest(i):
    return LO.rank_loss(batches(i), k=5)


TAIL = f"""SELECT batch, bce, rank, pauc, bce + 0.5 * rank + 0.5 * pauc AS total FROM (
  SELECT batch, avg(CASE WHEN label = 1 THEN {SP.format(x='-logit')} ELSE {SP.format(x='logit')} END) AS bce FROM bl GROUP BY batch) JOIN (
  SELECT p.batch, avg({SP.format(x='1.0 - (p.logit - n.logit)')}) AS rank FROM bl p JOIN bl n USING (batch) WHERE p.label > 0 AND n.label = 0 GROUP BY p.batch) USING (batch) JOIN (
  SELECT n.batch, avg({SP.format(x='n.logit - t.t')}) AS pauc FROM bl n JOIN (SELECT batch, quantile_cont(logit, 0.2) AS t FROM bl WHERE label = 1 GROUP BY batch) t USING (batch)
  WHERE n.label = 0 GROUP BY n.batch) USING (batch)"""


@query("tail_objective", TAIL, "scored_rare", BATCH, "bce rank pauc total")
def tail_objective(i):
    return LO.tail_objective(batches(i))


@query("soft_pauc", f"""SELECT center, avg({SP.format(x='score - t')}) AS soft_pauc FROM scored_rare JOIN (SELECT center, quantile_cont(score, 0.2) AS t FROM scored_rare WHERE label = 1 GROUP BY center) USING (center)
  WHERE label = 0 GROUP BY center""", "scored_rare", r="soft_pauc")
def soft_pauc(i):
    return LO.soft_pauc(i.scored_rare.withColumn("target", F.col("label").cast("double")), ["center"], logit="score")


@query("pos_neg_pairs", """SELECT p.center, p.name AS pos_name, p.score AS pos_score, n.name AS neg_name, n.score AS neg_score, n.hardness, p.score - n.score AS margin
  FROM scored_rare p JOIN (SELECT *, row_number() OVER (PARTITION BY center ORDER BY score DESC, name)::int AS hardness FROM scored_rare WHERE label = 0) n USING (center)
  WHERE p.label = 1 AND hardness <= 4""", "scored_rare", r="pos_score neg_score margin")
def pos_neg_pairs(i):
    return LO.pos_neg_pairs(i.scored_rare, 4)


ROUTED = f"""SELECT concept, n_supervised, prior, least(greatest((1.0::double - prior) / least(greatest(prior, 1e-3::double), 1.0::double), 1.0::double), 10.0::double) AS pos_weight FROM (
  SELECT concept, n_supervised, sv / (n_supervised + 1e-6::double) AS prior FROM (SELECT concept, count(*) FILTER (supervise)::double AS n_supervised,
    coalesce(sum(value) FILTER (supervise), 0.0::double) AS sv FROM trusted GROUP BY concept))"""
_LG = S.h("lg", "path", "concept")


@query("masked_bce", f"""SELECT concept, sum(w * b) / (sum(w) + 1e-6) AS loss, count(*) AS cells FROM (
  SELECT concept, w, pw * t * {SP.format(x='-x')} + (1.0 - t) * {SP.format(x='x')} AS b FROM (
    SELECT concept, x, gate * (s * (0.5 + 0.5 * 2.0 * abs(value - 0.5)) + (1.0 - s) * 0.1) AS w, s * (0.9 * value + 0.1 * prior) + (1.0 - s) * prior AS t, s * pos_weight + (1.0 - s) AS pw FROM (
      SELECT concept, value, supervise::int::double AS s, gate, prior, pos_weight, {_LG} / 64.0::double - 2.0 AS x FROM trusted JOIN pri USING (concept) JOIN vocab USING (concept)))) GROUP BY concept""",
       "trusted vocab", {"pri": ROUTED}, "loss")
def masked_bce(i):
    t = VO.with_vocabulary(i.trusted.drop("core"), "gate").withColumnRenamed("gate", "weight")
    # one row for each of the 35 concepts that the vocabulary lets through
    t = t.join(F.broadcast(L.priors_and_posw(i.trusted)), "concept").withColumn("logit", hash_byte("lg", "path", "concept") / F.lit(64.0) - 2.0)
    return LO.masked_bce(t, ["concept"], certain_floor=0.5, smooth_eps=0.1, unc_w=0.1)


@query("path_parts", "SELECT name, dir, name AS stem, 'out/' || dir || '/images/' || name || '.jpg' AS img_path FROM frames", "frames")
def path_parts_q(i):
    d = i.frames.select("name", F.concat(F.lit("/store/out/"), "dir", F.lit("/labels/"), "name", F.lit(".json")).alias("file"))
    return path_parts(d).select("name", "dir", "stem", "img_path")


