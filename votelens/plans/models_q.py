"""Linear-head queries. Fits are iterative, so they are checked by row counts here and by analytic cases in tests."""

import numpy as np
from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.functions.scalars import hash_byte
from votelens.operators import models as M
from votelens.plans import sqlviews as S
from votelens.plans.registry import query
from votelens.session import cut_lineage

#: The reference's sizes (phase3/train.py).
WHITEN_DIM, DEBIAS_K, C_GRID = 256, 32, [0.01, 0.03, 0.1, 0.3, 1.0]
COEF = M.fixed_coefficients(64)
_C = "[" + ", ".join(f"{c}::double" for c in COEF) + "]"
_R = "[" + ", ".join(f"{c}::double" for c in reversed(COEF)) + "]"


def dot(w):
    return f"list_sum(list_transform(range(1, 65), lambda j: feats[j]::double * {w}[j]))"


def norm_sql(k):
    blk = f"feats[{16 * k + 1}:{16 * k + 16}]"
    return f"list_transform({blk}, lambda x: x::double / (sqrt(list_sum(list_transform({blk}, lambda y: y::double * y::double))) + 1e-6::double))"


@query("pool_l2_normalize", f"""SELECT name, list_sum(list_transform(v, lambda x: abs(x))) AS l1, v[1] AS x_first, v[64] AS x_last, len(v) AS dims FROM (
  SELECT name, list_concat(list_concat({norm_sql(0)}, {norm_sql(1)}), list_concat({norm_sql(2)}, {norm_sql(3)})) AS v FROM embedding_pools)""", "embedding_pools", r="l1 x_first x_last")
def pool_l2_normalize(i):
    d = M.pool_l2_normalize(i.embedding_pools, V.POOLS)
    return d.select("name", F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v)).alias("l1"), F.element_at("x", 1).alias("x_first"),
                    F.element_at("x", -1).alias("x_last"), F.size("x").cast("long").alias("dims"))


def tok(lo, hi, j, agg):
    return f"{agg}(list_transform(range({lo}, {hi}), lambda t: feats[t * 4 + {j} + 1]::double))"


@query("pool_tokens", "SELECT name, " + ", ".join(
    [f"feats[{j + 1}]::double AS cls_{j}, {tok(1, 5, j, 'list_avg')} AS reg_{j}, {tok(5, 16, j, 'list_avg')} AS patch_mean_{j}, {tok(5, 16, j, 'list_max')} AS patch_max_{j}" for j in range(4)]) +
       " FROM embedding_pools", "embedding_pools", r=" ".join(f"{p}_{j}" for j in range(4) for p in ("cls", "reg", "patch_mean", "patch_max")))
def pool_tokens(i):
    d = M.pool_tokens(i.embedding_pools, 4)
    pick = {"cls": "cls", "reg": "reg_mean", "patch_mean": "patch_mean", "patch_max": "patch_max"}
    return d.select("name", *[F.element_at(c, j + 1).cast("double").alias(f"{p}_{j}") for j in range(4) for p, c in pick.items()])


@query("score_ensemble", f"""SELECT name, 1.0 / (1.0 + exp(-(2.0 * p - 1.0))) AS score, p AS mean_prob FROM (
  SELECT name, (1.0 / (1.0 + exp(-({dot(_C)} + 0.1::double))) + 1.0 / (1.0 + exp(-({dot(_R)} - 0.2::double)))) / 2.0 AS p FROM embedding_pools)""", "embedding_pools", r="score mean_prob")
def score_ensemble(i):
    from votelens.functions.scalars import sigmoid
    from votelens.operators.evaluation import ensemble_mean
    e = i.embedding_pools
    a = M.linear_score(e, COEF, 0.1).select("name", "score")
    b = M.linear_score(e, COEF[::-1], -0.2).select("name", "score")
    m = ensemble_mean(a.unionByName(b), ["name"], "score", "mean_prob")
    return m.withColumn("score", sigmoid(2.0 * F.col("mean_prob") - 1.0)).select("name", "score", "mean_prob")


@query("batch_score", f"""SELECT name, (1.0 / (1.0 + exp(-{dot(_C)})) + 1.0 / (1.0 + exp(-{dot(_R)}))) / 2.0 AS score FROM embedding_pools
  WHERE {S.h('have', 'name')} >= 100""", "embedding_pools", r="score")
def batch_score(i):
    e = i.embedding_pools
    stored = e.filter(hash_byte("have", "name") < 100).select("name", F.lit(1).alias("n_votes"))
    return M.batch_score(e.select("name", "feats"), M.linear_reader(np.array(COEF), 0.0), "name string, score double", stored)


@query("feature_pipe")
def feature_pipe(i):
    e = i.embedding_pools
    pipe = M.fit_pipe(e, whiten_dim=WHITEN_DIM, debias_k=DEBIAS_K)
    return pipe.transform(e).select("name", F.size("x").alias("dims"), "x")


@query("center_debias")
def center_debias(i):
    e = i.embedding_pools
    pipe = M.fit_pipe(e, debias_k=DEBIAS_K)
    return M.center_auroc(pipe.transform(e))


@query("balanced_logistic")
def balanced_logistic(i):
    e = i.embedding_pools
    xy = M._xy(M.fit_pipe(e).transform(e))
    return M.positive_probability(M.balanced_logistic(xy, 1.0), xy).select("name", "label", "score")


@query("oof_scores")
def oof_scores(i):
    e = i.embedding_pools
    return M.oof_scores(M._xy(M.fit_pipe(e).transform(e)), 1.0).select("name", "label", "fold", "score")


@query("select_C")
def select_c(i):
    e = i.embedding_pools
    return M.select_c(M._xy(M.fit_pipe(e).transform(e)), C_GRID)


@query("loco_report")
def loco_report(i):
    return M.loco_report(M.loco_all(i.embedding_pools, 1.0))


@query("loco_leg")
def loco_leg(i):
    return M.loco_scores(i.embedding_pools, "center_1", "center_2", 1.0)


@query("center_auroc")
def center_auroc(i):
    e = i.embedding_pools
    return M.center_auroc(M.fit_pipe(e).transform(e))


@query("ship_ensemble")
def ship_ensemble(i):
    e = i.embedding_pools
    ens = M.ship_ensemble(e, [(V.POOLS, 1.0), (["cls", "patch_mean"], 0.3), (["reg_mean", "patch_max"], 1.0)])
    return ens.score(e).select("name", "label", "mean_prob", "score")


@query("concept_ceiling")
def concept_ceiling(i):
    v = M.value_maps(i.ltrusted, i.frames)
    return M.concept_ceiling(v, {"all": (V.NAMES, False), "trusted": (V.TRUSTED_DISCRIMINATIVE, False), "trusted x trust": (V.TRUSTED_DISCRIMINATIVE, True)})


@query("residualize")
def residualize(i):
    t = i.trusted.filter(F.col("concept").isin(V.NUISANCE))
    n = t.groupBy("path").pivot("concept", V.NUISANCE).agg(F.first("value"))
    f = i.frames.join(n, "path").select("name", *V.NUISANCE)
    e = cut_lineage(i.embedding_pools.join(f, "name"))  # both legs read it several times
    held = hash_byte("split", "name") >= 192  # the split of the frames, for unlabelled frames too
    parts = [M.residualize(e, V.NUISANCE, a, b, held) for a, b in M.LEGS]
    return parts[0].unionByName(parts[1])


@query("encoder_gate")
def encoder_gate(i):
    e = i.embedding_pools
    mirrored = e.withColumn("feats", F.transform("feats", lambda x: (x * x).cast("float")))
    return M.encoder_gate(e, mirrored)


@query("encoder_table")
def encoder_table(i):
    e = i.embedding_pools
    return M.encoder_table({"full": e, "squared": e.withColumn("feats", F.transform("feats", lambda x: (x * x).cast("float")))})
