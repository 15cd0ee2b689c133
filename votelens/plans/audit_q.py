"""Concept audit queries."""

from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.functions.scalars import hash_byte
from votelens.operators import audit as A
from votelens.operators import sampling as SA
from votelens.plans import sqlviews as S
from votelens.plans.registry import query
from votelens.sources import views

q = S.quoted


def auc(src, by, score="c", label="label"):
    return S.metrics_of(S.curve_of(src, by, score, label), by)


@query("concept_auroc", "SELECT concept, n_pos + n_neg AS n, n_pos, n_neg, auroc FROM m", "lcells", {"m": auc("lcells", "concept")}, "auroc")
def concept_auroc(i):
    return A.concept_auroc(i.lcells)


@query("auroc_assessable", "SELECT concept, n_pos + n_neg AS n, CASE WHEN n_pos + n_neg >= 10 THEN greatest(auroc, 1 - auroc) END AS auroc FROM m", "lcells",
       {"m": auc("(SELECT * FROM lcells WHERE m > 0)", "concept")}, "auroc")
def auroc_assessable(i):
    return A.auroc_assessable(i.lcells)


@query("within_center_auroc", """SELECT concept, min(auroc) AS within_min, count(*) AS centers FROM m WHERE n_pos + n_neg >= 10 AND auroc IS NOT NULL GROUP BY concept""",
       "lcells", {"m": auc("lcells", "concept, center")}, "within_min")
def within_center_auroc(i):
    return A.within_center_auroc(i.lcells)


LEAK = auc("(SELECT *, (center = 'center_2')::int AS is_c2 FROM lcells)", "concept", "c", "is_c2")


@query("center_leak", "SELECT concept, greatest(auroc, 1 - auroc) AS leak FROM m", "lcells", {"m": LEAK}, "leak")
def center_leak(i):
    return A.center_leak(i.lcells)


@query("orient", """SELECT concept, CASE WHEN auroc < 0.5 THEN -1.0::double ELSE 1.0::double END AS sign, sum(v.c * CASE WHEN auroc < 0.5 THEN -1.0::double ELSE 1.0::double END) AS oriented_sum, count(*) AS n
  FROM m JOIN (SELECT * FROM lcells WHERE split = 'val') v USING (concept) GROUP BY 1, 2""", "lcells",
       {"m": auc("(SELECT * FROM lcells WHERE split = 'train')", "concept")}, "oriented_sum")
def orient(i):
    lc = i.lcells
    o = A.orient(lc.filter("split = 'train'"), lc.filter("split = 'val'"))
    return o.groupBy("concept", "sign").agg(F.sum("c").alias("oriented_sum"), F.count(F.lit(1)).alias("n"))


MI = """SELECT concept, sum((n / nt) * ln((n * nt) / (nb * nl))) AS mi FROM (
  SELECT concept, n::double AS n, sum(n) OVER (PARTITION BY concept)::double AS nt, sum(n) OVER (PARTITION BY concept, bin)::double AS nb,
    sum(n) OVER (PARTITION BY concept, label)::double AS nl FROM (
    SELECT concept, least(floor(c * 8), 7) AS bin, label, count(*) AS n FROM lcells GROUP BY 1, 2, 3)) GROUP BY concept"""


@query("mutual_information", MI, "lcells", r="mi")
def mutual_information(i):
    return A.mutual_information(i.lcells)


def _psi(x):
    y, z = f"(({x})::double + 6.0::double)", f"(1.0::double / ((({x})::double + 6.0::double) * (({x})::double + 6.0::double)))"
    steps = " ".join(f"- 1.0::double / (({x})::double + {i})" for i in range(6))
    return (f"(ln({y}) - 0.5::double / {y} - {z} * (1 / 12.0::double - {z} * (1 / 120.0::double - {z} * (1 / 252.0::double - {z} / 240.0::double))) {steps})")


NEAREST_MI = f"""SELECT concept, count(*) AS cells, greatest(0.0::double, {_psi('count(*)')} + avg({_psi('least(3, n - 1)')} - {_psi('n')} - {_psi('m')})) AS mi FROM (
  SELECT concept, n, count(*) OVER (PARTITION BY concept ORDER BY pos RANGE BETWEEN r PRECEDING AND r FOLLOWING) AS m FROM (
    SELECT concept, n, pos, greatest(CASE WHEN n <= 3 THEN greatest(pos - first, last - pos) ELSE least(
        CASE WHEN a3 IS NOT NULL THEN a3 - pos END, CASE WHEN b1 IS NOT NULL AND a2 IS NOT NULL THEN greatest(pos - b1, a2 - pos) END,
        CASE WHEN b2 IS NOT NULL AND a1 IS NOT NULL THEN greatest(pos - b2, a1 - pos) END, CASE WHEN b3 IS NOT NULL THEN pos - b3 END) END, 1) - 1 AS r FROM (
      SELECT *, {', '.join(f'lag(pos, {j}) OVER w AS b{j}, lead(pos, {j}) OVER w AS a{j}' for j in (1, 2, 3))},
        count(*) OVER g AS n, min(pos) OVER g AS first, max(pos) OVER g AS last FROM (
        SELECT concept, label, path, cast(floor(c::double * 1000000.0::double + 0.5::double) as bigint) * 4294967296
          + cast('0x' || substr(md5(concat_ws('|', path, concept, 'mi')), 1, 8) as bigint) AS pos FROM lcells WHERE c IS NOT NULL)
      WINDOW w AS (PARTITION BY concept, label ORDER BY pos, path), g AS (PARTITION BY concept, label))
    WHERE n > 1)) GROUP BY concept"""


@query("nearest_mutual_information", NEAREST_MI, "lcells", r="mi")
def nearest_mutual_information(i):
    return A.nearest_mutual_information(i.lcells)


@query("ordered_report", f"SELECT concept, mi, auroc, rk FROM (SELECT m.concept, mi, auroc, row_number() OVER (ORDER BY {S.rd('mi', 9)} DESC, {S.rd('auroc', 9)} DESC, m.concept) AS rk "
       "FROM mi JOIN m USING (concept))", "lcells", {"mi": MI, "m": auc("lcells", "concept")}, "mi auroc")
def ordered_report(i):
    from pyspark.sql import Window
    from votelens.functions.scalars import half_up
    d = A.mutual_information(i.lcells).join(A.concept_auroc(i.lcells).select("concept", "auroc"), "concept")
    w = Window.orderBy(half_up(F.col("mi"), 9).desc(), half_up(F.col("auroc"), 9).desc(), "concept")  # 35 report rows
    return d.select("concept", "mi", "auroc", F.row_number().over(w).alias("rk"))


TL = "(SELECT t.concept, t.value, t.trust, t.supervise, l.label, l.center FROM trusted t JOIN lab l USING (path))"


@query("concept_audit", """SELECT concept, a.auroc AS auc_all, c1.auroc AS auc_c1, c2.auroc AS auc_c2, k.auroc AS auc_center, s.mean_trust, s.pct_supervised, s.mean_pos, s.mean_neg,
    coalesce(sign(c1.auroc - 0.5) = sign(c2.auroc - 0.5), false) AS sign_agree
  FROM a JOIN c1 USING (concept) JOIN c2 USING (concept) JOIN k USING (concept) JOIN (SELECT concept, sum(trust) / count(*) AS mean_trust,
    count(*) FILTER (supervise) * 100.0::double / count(*) AS pct_supervised, avg(value) FILTER (label = 1) AS mean_pos, avg(value) FILTER (label = 0) AS mean_neg FROM tl GROUP BY concept) s USING (concept)""",
       "trusted lab", {"tl": TL[1:-1], "a": auc("tl", "concept", "value"), "c1": auc("(SELECT * FROM tl WHERE center = 'center_1')", "concept", "value"),
                       "c2": auc("(SELECT * FROM tl WHERE center = 'center_2')", "concept", "value"),
                       "k": auc("(SELECT *, (center = 'center_2')::int AS is_c2 FROM tl)", "concept", "value", "is_c2")},
       "auc_all auc_c1 auc_c2 auc_center mean_trust pct_supervised mean_pos mean_neg")
def concept_audit(i):
    return A.concept_audit(i.trusted, i.frames)


def transfer(src, dst):
    return f"""SELECT t.concept, count(*) FILTER (t.value >= f.thr AND t.label = 1)::double / nullif(count(*) FILTER (t.value >= f.thr), 0) AS ppv
      FROM tl t JOIN {src} f USING (concept) WHERE t.center = '{dst}' GROUP BY 1"""


@query("concept_ppv", """SELECT concept, a.ppv_incl AS ppv_all, c1.ppv_incl AS ppv_c1, c2.ppv_incl AS ppv_c2, t12.ppv AS c1_to_c2, t21.ppv AS c2_to_c1
  FROM a JOIN c1 USING (concept) JOIN c2 USING (concept) LEFT JOIN t12 USING (concept) LEFT JOIN t21 USING (concept)""", "trusted lab",
       {"tl": TL[1:-1], "a": auc("tl", "concept", "value"), "c1": auc("(SELECT * FROM tl WHERE center = 'center_1')", "concept", "value"),
        "c2": auc("(SELECT * FROM tl WHERE center = 'center_2')", "concept", "value"), "t12": transfer("c1", "center_2"), "t21": transfer("c2", "center_1")},
       "ppv_all ppv_c1 ppv_c2 c1_to_c2 c2_to_c1")
def concept_ppv(i):
    return A.concept_ppv(i.trusted, i.frames)


CORE = V.ROBUST_CORE
STRATA = {
    "riskall": f"""SELECT path, label, {S.rd('0.4::double * unrel + 0.3::double * boundary + 0.3::double * look', 9)} AS risk FROM (
      SELECT path, label, sum(1.0 - r) / count(*) AS unrel, sum(CASE WHEN c >= 0.35 AND c <= 0.65 THEN 1.0 ELSE 0.0 END)::double / count(*) AS boundary,
        CASE WHEN label = 0 THEN sum(c) / count(*) ELSE 0.0 END AS look FROM cells JOIN frames USING (path) WHERE concept IN ({q(CORE)}) GROUP BY path, label)""",
    "risktop": "SELECT path, label, risk, 'risk' AS stratum FROM riskall ORDER BY risk DESC, path LIMIT 60",
    "strata": """SELECT * FROM risktop UNION ALL SELECT * FROM (SELECT path, label, risk, 'baseline' AS stratum FROM riskall WHERE path NOT IN (SELECT path FROM risktop)
      ORDER BY md5(path || '|b0'), path LIMIT 40)"""}


@query("risk_stratify", "SELECT path, label, risk, stratum FROM strata", "cells frames", STRATA, "risk")
def risk_stratify(i):
    return SA.risk_stratify(i.cells, i.frames, CORE, 100)


GRADED = """SELECT c.*, greatest(0.0, least(1.0, try_cast(g.raw as double))) AS grade FROM cells c JOIN g1 g USING (path, concept) WHERE try_cast(g.raw as double) IS NOT NULL"""


@query("grade_join", "SELECT path, concept, c, grade FROM graded", "cells", {"g1": S.grades_of("cells"), "graded": GRADED}, "c grade")
def grade_join(i):
    c = i.cells
    return A.grade_join(c, views.grades(c)).select("path", "concept", "c", "grade")


@query("faithfulness_stats", f"""SELECT stratum, concept, count(*) AS n, sum(abs(c - grade)) / count(*) AS mae, count(*) FILTER ((c >= 0.5) = (grade >= 0.5))::double / count(*) AS agree_at_half
  FROM graded JOIN strata USING (path) WHERE concept IN ({q(CORE)}) GROUP BY 1, 2""", "cells frames", STRATA | {"g1": S.grades_of("cells"), "graded": GRADED}, "mae agree_at_half")
def faithfulness_stats(i):
    c = i.cells
    s = SA.risk_stratify(c, i.frames, CORE, 100).select("path", "stratum")
    return A.faithfulness_stats(A.grade_join(c.filter(F.col("concept").isin(CORE)), views.grades(c)).join(s, "path"))


RECHECK = {
    "g1": S.grades_of("cells", "g1"), "g2": S.grades_of("cells", "g2"), "graded": GRADED,
    "p1": f"SELECT path, concept, c, grade AS pass1 FROM graded WHERE concept IN ({q(CORE)})",
    "p2": """SELECT p1.*, greatest(0.0, least(1.0, try_cast(g2.raw as double))) AS pass2 FROM p1 JOIN g2 USING (path, concept) WHERE try_cast(g2.raw as double) IS NOT NULL""",
    "verdicts": """SELECT path, concept, c, pass1, pass2, CASE WHEN (pass2 >= 0.5) = (pass1 >= 0.5) THEN 'STABLE_WRONG' ELSE 'AMBIGUOUS' END AS verdict
      FROM p2 WHERE (c >= 0.5) <> (pass1 >= 0.5)""",
    "fr": f"""SELECT path, n_flips, mae, {S.rd('n_flips + mae', 9)} AS severity, CASE lv WHEN 2 THEN 'STABLE_WRONG' WHEN 1 THEN 'AMBIGUOUS' ELSE 'NOISE' END AS frame_class FROM (
      SELECT path, count(*) FILTER ((c >= 0.5) <> (pass1 >= 0.5)) AS n_flips, sum(abs(c - pass1)) / count(*) AS mae FROM p1 GROUP BY path) LEFT JOIN (
      SELECT path, max(CASE verdict WHEN 'STABLE_WRONG' THEN 2 ELSE 1 END) AS lv FROM verdicts GROUP BY path) USING (path) WHERE n_flips >= 1""",
    "worst": "SELECT * FROM fr ORDER BY severity DESC, path LIMIT 50",
}


def _recheck(i):
    c = i.cells
    return c.filter(F.col("concept").isin(CORE)), views.grades(c, "g1"), views.grades(c, "g2")


@query("classify_recheck", "SELECT path, concept, c, pass1, pass2, verdict FROM verdicts", "cells", RECHECK, "c pass1 pass2")
def classify_recheck(i):
    return A.recheck_cells(*_recheck(i)).select("path", "concept", "c", "pass1", "pass2", "verdict")


@query("recheck_frames", "SELECT * FROM fr", "cells", RECHECK, "mae severity")
def recheck_frames(i):
    return A.recheck_frames(*_recheck(i))


@query("worst_failcases", "SELECT * FROM worst", "cells", RECHECK, "mae severity")
def worst_failcases(i):
    return A.worst_failcases(A.recheck_frames(*_recheck(i)), 50)


@query("concept_blame", "SELECT concept, count(*) FILTER (verdict = 'STABLE_WRONG') AS stable_wrong, count(*) AS flips FROM verdicts WHERE path IN (SELECT path FROM worst) GROUP BY concept",
       "cells", RECHECK)
def concept_blame(i):
    args = _recheck(i)
    return A.concept_blame(A.recheck_cells(*args), A.worst_failcases(A.recheck_frames(*args), 50))


PAIRS = f"""SELECT concept, a.model AS model_a, b.model AS model_b, count(*) AS n, count(*) FILTER ((a.c >= 0.5) = (b.c >= 0.5))::double / count(*) AS agreement
  FROM model_cells a JOIN model_cells b USING (path, concept) WHERE a.model < b.model AND concept IN ({q(CORE)})
    AND path IN (SELECT path FROM model_cells GROUP BY path HAVING count(DISTINCT model) = 3) GROUP BY 1, 2, 3"""


@query("pairwise_model_agreement", PAIRS, "model_cells", r="agreement")
def pairwise_model_agreement(i):
    return A.pairwise_model_agreement(i.model_cells, 3)


@query("shared_frames", "SELECT path FROM model_cells GROUP BY path HAVING count(DISTINCT model) = 3", "model_cells")
def shared_frames(i):
    return A.shared_frames(i.model_cells, 3)


@query("labeler_summary", f"""SELECT model, core_auroc, core_reliability, core_assessable, mean_agreement, core_auroc * core_reliability AS labeler_score,
    row_number() OVER (ORDER BY core_auroc * core_reliability DESC) = 1 AS best
  FROM (SELECT model, avg(greatest(auroc, 1 - auroc)) AS core_auroc FROM m GROUP BY model) JOIN (
    SELECT model, sum(r) / count(*) AS core_reliability, sum(m) / count(*) AS core_assessable FROM ml GROUP BY model) USING (model) JOIN (
    SELECT model, avg(agreement) AS mean_agreement FROM (SELECT model_a AS model, agreement FROM pairs UNION ALL SELECT model_b, agreement FROM pairs) GROUP BY model) USING (model)""",
       "model_cells lab", {"ml": f"SELECT c.*, l.label FROM model_cells c JOIN lab l USING (path) WHERE concept IN ({q(CORE)})", "m": auc("ml", "model, concept"),
                           "pairs": PAIRS.replace("FROM model_cells a JOIN model_cells b", "FROM ml a JOIN ml b").replace("FROM model_cells GROUP", "FROM ml GROUP")},
       "core_auroc core_reliability core_assessable mean_agreement labeler_score")
def labeler_summary(i):
    return A.labeler_summary(i.model_cells, i.frames, 3)


REEVAL = ("flash3", "proagent", "flash35")


def _against(m: str, base: str) -> str:
    core = lambda x: f"max(core) FILTER (model = '{x}')"
    return f"CASE WHEN {core(m)} AND NOT {core(base)} THEN 'rescued' WHEN NOT {core(m)} AND {core(base)} THEN 'dropped' ELSE 'same' END AS {m}_vs_{base}"


@query("feature_reeval", """SELECT concept, """ + ", ".join(f"max({c}) FILTER (model = '{m}') AS {m}_{c}" for m in REEVAL for c in ("agreement", "auroc", "core")) +
       ", " + ", ".join(_against(m, REEVAL[0]) for m in REEVAL[1:]) + """
  FROM (SELECT model, concept, greatest(auroc, 1 - auroc) AS auroc, agreement, agreement >= 0.6 AND mi > 1e-9 AS core FROM m
    JOIN (SELECT model, concept, sum(r) / count(*) AS agreement FROM ml GROUP BY 1, 2) USING (model, concept) JOIN (
    SELECT model, concept, sum((n / nt) * ln((n * nt) / (nb * nl))) AS mi FROM (
      SELECT model, concept, n::double AS n, sum(n) OVER (PARTITION BY model, concept)::double AS nt, sum(n) OVER (PARTITION BY model, concept, bin)::double AS nb,
        sum(n) OVER (PARTITION BY model, concept, label)::double AS nl FROM (SELECT model, concept, least(floor(c * 8), 7) AS bin, label, count(*) AS n FROM ml GROUP BY 1, 2, 3, 4))
      GROUP BY 1, 2) USING (model, concept)) GROUP BY concept""", "model_cells lab",
       {"ml": f"SELECT c.*, l.label FROM model_cells c JOIN lab l USING (path) WHERE concept IN ({q(V.DISCRIMINATIVE)})", "m": auc("ml", "model, concept")},
       " ".join(f"{m}_{c}" for m in REEVAL for c in ("agreement", "auroc")))
def feature_reeval(i):
    return A.feature_reeval(i.model_cells, i.frames, list(REEVAL), REEVAL[0])


_NOISE = "cast('0x' || substr(md5(path || '|' || concept || '|pred'), 1, 2) as int) / 512.0::double"


@query("macro_concept_auroc", "SELECT concept, n_pos + n_neg AS n, auroc, sum(auroc) OVER () / count(*) OVER () AS macro_auroc FROM m WHERE n_pos + n_neg > 10 AND auroc IS NOT NULL", "trusted",
       {"p": f"SELECT concept, (value > 0.5)::int AS label, value / 2.0 + {_NOISE} AS pred FROM trusted WHERE supervise", "m": auc("p", "concept", "pred")}, "auroc macro_auroc")
def macro_concept_auroc(i):
    return A.macro_concept_auroc(i.trusted.withColumn("pred", F.col("value") / 2.0 + hash_byte("pred", "path", "concept") / F.lit(512.0)))


@query("generalization_gap", """SELECT model || '/' || concept AS arm, max(auroc) FILTER (split = 'train') AS inside, max(auroc) FILTER (split = 'val') AS outside,
  max(auroc) FILTER (split = 'train') - max(auroc) FILTER (split = 'val') AS gap FROM m GROUP BY model, concept""", "model_cells lab",
       {"ml": "SELECT c.*, l.label, l.split FROM model_cells c JOIN lab l USING (path)", "m": auc("ml", "model, concept, split")}, "inside outside gap")
def generalization_gap(i):
    m = A.concept_auroc(i.model_cells.join(i.lab, "path"), ["model", "concept", "split"])
    return A.generalization_gap(m.select(F.concat_ws("/", "model", "concept").alias("arm"), F.col("split").alias("regime"), F.col("auroc").alias("metric")), "train", "val")
