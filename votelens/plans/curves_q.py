"""Score-curve queries."""

from pyspark.sql import functions as F

from votelens.functions import scalars as X
from votelens.operators import curves as C
from votelens.operators import labels as L
from votelens.operators import sampling
from votelens.plans import sqlviews as S
from votelens.plans.registry import query

ALL = "k thr fp ppv fpr_incl fpr_strict ppv_incl ppv_oracle thr_oracle auroc auprc"


def pick(cols, src="m"):
    return f"SELECT {cols} FROM {src}"


GROUPED = {"pooled": S.pooled_of("scored_rare")[1:-1], "m": S.metrics_of(S.curve_of("pooled", "center"), "center")}
TIES = {"pooled": S.pooled_of("scored_ties")[1:-1], "m": S.metrics_of(S.curve_of("pooled", "center"), "center")}


@query("group_report", pick("*"), "scored_rare", GROUPED, ALL)
def group_report(i):
    return C.group_report(i.scored_rare)


for _name, _cols in {
    "auroc": "n_pos n_neg auroc", "auprc": "n_pos n_neg auprc", "ppv_curvepoint": "k thr fp ppv",
    "ppv_oracle": "ppv_oracle thr_oracle", "fpr_at_recall": "thr fpr_incl", "fpr90_rowwise": "fp fpr_strict",
    "ppv_at_recall_inclusive": "thr ppv_incl",
}.items():
    _l = ["center", *_cols.split()]
    _r = " ".join(c for c in _cols.split() if c in ALL.split())
    query(_name, pick(", ".join(_l)), "scored_rare", GROUPED, _r)(
        lambda i, _l=_l: C.group_report(i.scored_rare).select(*_l))
    query(f"{_name}_ties", pick(", ".join(_l)), "scored_ties", TIES, _r)(
        lambda i, _l=_l: C.group_report(i.scored_ties).select(*_l))


@query("auroc_folded", "SELECT center, greatest(auroc, 1 - auroc) AS auroc FROM m", "scored_rare", GROUPED, "auroc")
def auroc_folded(i):
    return C.group_report(i.scored_rare).select("center", F.greatest("auroc", 1 - F.col("auroc")).alias("auroc"))


@query("confusion_at", """SELECT center, tp, fp, fn, tn, p AS precision, r AS recall,
  CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END AS f1, (tp + tn)::double / (tp + fp + fn + tn) AS accuracy
  FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp::double / (tp + fp) ELSE 0.0 END AS p,
        CASE WHEN tp + fn > 0 THEN tp::double / (tp + fn) ELSE 0.0 END AS r FROM (
    SELECT center, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
      count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn
    FROM scored_rare GROUP BY center))""", "scored_rare", r="precision recall f1 accuracy")
def confusion_at(i):
    return C.confusion_at(i.scored_rare, 0.5, ["center"])


@query("ppv_fixed", """SELECT center, tp::double / greatest(tp + fp, 1) AS ppv, tp::double / greatest(p, 1) AS recall FROM (
  SELECT center, count(*) FILTER (score >= 0.7 AND label = 1) AS tp, count(*) FILTER (score >= 0.7 AND label = 0) AS fp,
    count(*) FILTER (label = 1) AS p FROM scored_rare GROUP BY center)""", "scored_rare", r="ppv recall")
def ppv_fixed(i):
    return C.ppv_fixed(i.scored_rare, 0.7, ["center"])


PPV_SQL = """SELECT center, fpr_strict AS fpr, 0.9 / (0.9 + 100.0 * fpr_strict) AS ppv_challenge,
  0.009 * (1.0 / ppv - 1.0) AS fpr_back FROM m"""


@query("ppv_from_fpr", PPV_SQL, "scored_rare", GROUPED, "fpr ppv_challenge fpr_back")
def ppv_from_fpr(i):
    m = C.group_report(i.scored_rare)
    return m.select("center", F.col("fpr_strict").alias("fpr"), X.ppv_from_fpr(F.col("fpr_strict")).alias("ppv_challenge"),
                    X.fpr_from_ppv(F.col("ppv")).alias("fpr_back"))


@query("logit_sigmoid", """SELECT name, ln(q / (1.0 - q)) AS logit, 1.0 / (1.0 + exp(-ln(q / (1.0 - q)))) AS prob
  FROM (SELECT name, greatest(1e-6, least(1.0 - 1e-6, score)) AS q FROM scored)""", "scored", r="logit prob")
def logit_sigmoid(i):
    d = i.scored.select("name", X.logit(F.col("score")).alias("logit"))
    return d.withColumn("prob", X.sigmoid(F.col("logit")))


LEVELS = [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50]


def levels(vals):
    return "(VALUES " + ", ".join(f"({v}::double)" for v in vals) + ") t(thr)"


@query("triage_table", f"""SELECT center, thr, count(*) FILTER (score >= thr AND label = 1)::double / sum(label) AS recall,
  count(*) FILTER (score >= thr) * 100.0::double / count(*) AS escalate_pct,
  count(*) FILTER (score < thr AND label = 1) AS missed FROM scored_rare, {levels(LEVELS)} GROUP BY center, thr""",
       "scored_rare", r="recall escalate_pct")
def triage_table(i):
    return C.triage_table(i.scored_rare, LEVELS, ["center"])


CUTS = [0.5, 0.6, 0.7, 0.8, 0.9]


@query("suspicion_precision_table", f"""SELECT thr, count(*) FILTER (suspicion >= thr) AS n_flagged,
  count(*) FILTER (suspicion >= thr AND label = 1)::double / nullif(count(*) FILTER (suspicion >= thr), 0) AS precision,
  count(*) FILTER (suspicion >= thr AND label = 1)::double / sum(label) AS recall, sum(label)::double / count(*) AS base_rate
  FROM curated, {levels(CUTS)} WHERE label >= 0 GROUP BY thr""", "curated", r="precision recall base_rate")
def suspicion_precision_table(i):
    return C.suspicion_precision_table(i.curated.withColumnRenamed("suspicion", "score"), CUTS)


@query("threshold_lookup", """SELECT thr, count(*) FILTER (s.label = 0 AND s.score >= thr) AS neg_at_or_above,
  count(*) FILTER (s.label = 0 AND s.score > thr) AS neg_above
  FROM (SELECT DISTINCT score AS thr FROM scored_rare WHERE label = 1), scored_rare s GROUP BY thr""", "scored_rare", r="thr")
def threshold_lookup(i):
    s = i.scored_rare
    return C.threshold_lookup(s, s.filter("label = 1").select(F.col("score").alias("thr")).distinct())


@query("threshold_transfer", """SELECT a.center AS source, b.center AS target, a.thr,
  count(*) FILTER (s.score >= a.thr AND s.label = 1)::double / count(*) FILTER (s.score >= a.thr) AS ppv,
  count(*) FILTER (s.score >= a.thr AND s.label = 1)::double / sum(s.label) AS recall,
  count(*) FILTER (s.score >= a.thr AND s.label = 0)::double / count(*) FILTER (s.label = 0) AS fpr
  FROM m a JOIN m b ON a.center <> b.center JOIN scored_rare s ON s.center = b.center GROUP BY 1, 2, 3""", "scored_rare",
       {"m": S.metrics_of(S.curve_of("scored_rare", "center"), "center")}, "thr ppv recall fpr")
def threshold_transfer(i):
    return C.threshold_transfer(i.scored_rare)


@query("rank01", """SELECT name, center, (row_number() OVER (PARTITION BY center ORDER BY score, name) - 1)::double
  / greatest(count(*) OVER (PARTITION BY center) - 1, 1) AS rank01 FROM scored""", "scored", r="rank01")
def rank01(i):
    return C.rank01(i.scored, ["center"]).select("name", "center", "rank01")


@query("defloor", """SELECT s.name, s.center, s.score - q.f AS score FROM scored s JOIN (
  SELECT center, quantile_cont(score, 0.1) AS f FROM scored GROUP BY center) q USING (center)""", "scored", r="score")
def defloor(i):
    return C.defloor(i.scored).select("name", "center", "score")


@query("robust_z", """SELECT s.name, s.center, (s.score - q.m) / (q.c - q.a) AS z FROM scored s JOIN (
  SELECT center, quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.5) AS m, quantile_cont(score, 0.75) AS c
  FROM scored GROUP BY center) q USING (center)""", "scored", r="z")
def robust_z(i):
    return C.robust_z(i.scored).select("name", "center", "z")


WEIGHTS = [1.0, 0.8, 0.7, 0.6, 0.5, 0.3, 0.0]


@query("rank_fuse_sweep", "SELECT w, false AS defloored, fpr_strict, auroc FROM m1 UNION ALL SELECT w, true, fpr_strict, auroc FROM m2",
       "scored_rare", {
           "ranks": """SELECT *, (row_number() OVER (ORDER BY score, name) - 1)::double / (count(*) OVER () - 1) AS ra,
             (row_number() OVER (ORDER BY score_b, name) - 1)::double / (count(*) OVER () - 1) AS rb FROM scored_rare""",
           "fused": "SELECT label, center, w, w * ra + (1.0::double - w) * rb AS score FROM ranks, (VALUES " +
                    ", ".join(f"({w}::double)" for w in WEIGHTS) + ") t(w)",
           "floored": """SELECT label, w, score - quantile_cont(score, 0.1) OVER (PARTITION BY w, center) AS score FROM fused""",
           "m1": S.metrics_of(S.curve_of("fused", "w"), "w"), "m2": S.metrics_of(S.curve_of("floored", "w"), "w")},
       "fpr_strict auroc")
def rank_fuse_sweep(i):
    return C.rank_fuse_sweep(i.scored_rare, "score", "score_b", WEIGHTS, q=0.1)


@query("stratified_folds", """SELECT path, label, center, cast((row_number() OVER (PARTITION BY label, center ORDER BY path) - 1) % 5 as int) AS fold
  FROM frames WHERE label >= 0""", "frames")
def stratified_folds(i):
    return C.stratified_folds(i.frames.filter("label >= 0"), 5).select("path", "label", "center", "fold")


MEMBERS = {"a": "score", "b": "score_b", "mean": "(score + score_b) / 2.0::double"}
_RANK = ", ".join(f"rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0::double AS r_{k}" for k, m in MEMBERS.items())


@query("spearman_matrix", " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, corr(r_{x}, r_{y}) AS rho FROM ranked" for x, y in (("a", "b"), ("a", "mean"), ("b", "mean"))),
       "scored_rare", {"ranked": f"SELECT {_RANK} FROM scored_rare"}, "rho")
def spearman_matrix(i):
    d = i.scored_rare.select("name", F.col("score").alias("a"), F.col("score_b").alias("b"), ((F.col("score") + F.col("score_b")) / 2.0).alias("mean"))
    return C.spearman_matrix(d, ["a", "b", "mean"])


@query("ks_two_sample", """SELECT max(na) AS n_a, max(nb) AS n_b, max(abs(ca / na - cb / nb)) AS ks FROM (
  SELECT score, sum(sum(a)) OVER (ORDER BY score) AS ca, sum(sum(b)) OVER (ORDER BY score) AS cb,
    sum(sum(a)) OVER () AS na, sum(sum(b)) OVER () AS nb
  FROM (SELECT score, (center = 'center_1')::int::double AS a, (center <> 'center_1')::int::double AS b FROM scored_rare
        WHERE label = 0) GROUP BY score)""", "scored_rare", r="ks")
def ks_two_sample(i):
    return C.ks_two_sample(i.scored_rare.filter("label = 0"), "score", F.col("center") == "center_1")


@query("score_tail_profile", """SELECT center, quantile_cont(score, 0.1) FILTER (label = 0) AS neg_q10,
  quantile_cont(score, 0.5) FILTER (label = 0) AS neg_q50, quantile_cont(score, 0.95) FILTER (label = 0) AS neg_q95,
  quantile_cont(score, 0.99) FILTER (label = 0) AS neg_q99, quantile_cont(score, 0.1) FILTER (label = 1) AS pos_q10
  FROM scored_rare GROUP BY center""", "scored_rare", r="neg_q10 neg_q50 neg_q95 neg_q99 pos_q10")
def score_tail_profile(i):
    return C.score_tail_profile(i.scored_rare, ["center"])


@query("above_threshold_share", """SELECT decision, count(*) AS n, count(*) FILTER (suspicion >= thr) * 100.0::double / count(*) AS pct_above,
  quantile_cont(suspicion, 0.5) AS median_score FROM curated, m WHERE label < 0 GROUP BY decision""", "curated",
       {"m": S.metrics_of(S.curve_of("curated", "", "suspicion"))}, "pct_above median_score")
def above_threshold_share(i):
    c = i.curated.select("label", "decision", F.col("suspicion").alias("score")).persist()  # threshold, median and shares read it
    return C.above_threshold_share(c.filter("label >= 0"), c.filter("label < 0"), "decision")


for _policy, _expr in {"mean": "sum(score) / count(*)", "max": "max(score)", "orig": "min_by(score, name)"}.items():
    query(f"dedup_by_source_{_policy}", f"""SELECT source, {_expr} AS score, min_by(label, name) AS label,
      min_by(center, name) AS center, count(*) AS copies FROM scored GROUP BY source""", "scored", r="score")(
        lambda i, p=_policy: L.dedup_by_source(i.scored, p))


@query("center_composition", """SELECT center, n, p AS positives, p::double / n AS prevalence, (n - p)::double / sum(n - p) OVER () AS neg_fraction
  FROM (SELECT center, count(*) AS n, sum(label)::bigint AS p FROM scored GROUP BY center)""", "scored", r="prevalence neg_fraction")
def center_composition(i):
    return L.center_composition(i.scored)


@query("top_scores", "SELECT name, score FROM scored_rare ORDER BY score DESC, name LIMIT 100", "scored_rare", r="score")
def top_scores(i):
    return sampling.top_suspicious(i.scored_rare, 100, "score", "name").select("name", "score")


@query("ensemble_mean", """SELECT name, (score + score_b) / 2.0 AS score FROM scored_rare""", "scored_rare", r="score")
def ensemble_mean(i):
    views = F.explode(F.array(F.struct(F.lit("a").alias("view"), F.col("score").alias("p")),
                              F.struct(F.lit("b").alias("view"), F.col("score_b").alias("p"))))
    long = i.scored_rare.select("name", views.alias("_v")).select("name", "_v.p")
    from votelens.operators.evaluation import ensemble_mean as mean
    return mean(long, ["name"], "p", "score")
