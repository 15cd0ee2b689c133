"""Resampling queries. The draws are integer hashes, so the SQL side repeats them exactly."""

from pyspark.sql import functions as F

from votelens import vocabulary as V
from votelens.operators import audit as A
from votelens.operators import resample as R
from votelens.plans import sqlviews as S
from votelens.plans.registry import query

#: Replicates of the reference: 1000 where phase3/evaluate.py says B=1000, 2000 for its gate, mde and report and for BOOT of confirm.py.
REPS, REPS_WIDE = 1000, 2000
SEED = 12345
M32 = 4294967295


def mix(src: str, x: str, out: str) -> str:
    """Nested selects computing the 32-bit mixer of expression ``x`` as column ``out``."""
    q = f"SELECT *, {x} AS _m FROM {src}"
    for _ in range(2):
        q = f"SELECT * REPLACE (xor(_m, _m >> 16) AS _m) FROM ({q})"
        q = f"SELECT * REPLACE ((_m * 73244475) & {M32} AS _m) FROM ({q})"
    return f"SELECT * EXCLUDE (_m), xor(_m, _m >> 16) AS {out} FROM ({q})"


def indexed(src: str, rep: str, seed: int, *stratum: str) -> str:
    """Adds idx for rows (…, d, n) of ``src``: the draw index of (stratum, rep, d) in a pool of n."""
    joined = "concat_ws('|', " + ", ".join(stratum) + ")"
    half = lambda at: f"cast('0x' || substr(md5({joined}), {at}, 8) as bigint)" if stratum else "0::bigint"
    first = f"(({rep}) + {seed * 7919 + 1})::bigint & {M32}"
    q = mix(src, first, "_r0")
    q = mix(f"({q})", f"xor(_r0, {half(1)})", "_r")
    q = mix(f"({q})", f"xor({first}, 2654435769::bigint)", "_q0")
    q = mix(f"({q})", f"xor(_q0, {half(9)})", "_q")
    q = mix(f"({q})", f"(d::bigint) & {M32}", "_l")
    q = mix(f"({q})", "xor(xor(_r, _l), (d::bigint) >> 32)", "_b")
    q = mix(f"({q})", "xor(_b, _q)", "_e")
    return f"SELECT *, (_b * 2097152 + (_e & 2097151)) % n AS idx FROM ({q})"


def strat(reps: int) -> dict[str, str]:
    return STRAT | {"d0": STRAT["d0"].format(reps=reps)}


STRAT = {
    "tagged": "SELECT *, CASE WHEN label = 1 THEN '*' ELSE center END AS stratum FROM scored_rare",
    "pool": f"SELECT *, row_number() OVER (PARTITION BY label, stratum ORDER BY md5(name || '|pool{SEED}'), name) - 1 AS idx, count(*) OVER (PARTITION BY label, stratum) AS n FROM tagged",
    "plan": """SELECT label, stratum, n, CASE WHEN label = 1 THEN n ELSE round_even(round_even(P * (0.99::double / 0.01::double), 0) * (n::double / T), 0)::bigint END AS draws FROM (
      SELECT label, stratum, count(*) AS n, (SELECT count(*) FROM tagged WHERE label = 1) AS P, (SELECT count(*) FROM tagged WHERE label = 0) AS T FROM tagged GROUP BY 1, 2)""",
    "d0": "SELECT p.*, r.rep, d.d FROM plan p, range({reps}) r(rep), range((SELECT max(draws) FROM plan)) d(d) WHERE d.d < p.draws",
    "d1": indexed("d0", "rep", SEED, "label", "stratum"),
    "drawn": "SELECT d1.rep, d1.label, pool.score, pool.score_b FROM d1 JOIN pool ON pool.label = d1.label AND pool.stratum = d1.stratum AND pool.idx = d1.idx",
}
REP_M = S.metrics_of(S.curve_of("drawn", "rep"), "rep")


def summ(col, prefix):
    return (f"quantile_cont({col}, 0.5) AS {prefix}_median, quantile_cont({col}, 0.025) AS {prefix}_lo, quantile_cont({col}, 0.975) AS {prefix}_hi, "
            f"sum({col}) / count({col}) AS {prefix}_mean")


@query("bootstrap", f"""SELECT count(*) AS reps, max(n_pos) AS n_pos, max(n_neg) AS n_neg, quantile_cont(fpr_incl, 0.5) AS fpr_median, {summ('ppv', 'curve')}, {summ('ppv_oracle', 'oracle')},
  {summ('fixed', 'fixed')} FROM m JOIN fx USING (rep)""", "scored_rare",
       strat(REPS) | {"m": REP_M, "fx": "SELECT rep, coalesce(sum(label) FILTER (score >= 0.6)::double / nullif(count(*) FILTER (score >= 0.6), 0), 0.0) AS fixed FROM drawn GROUP BY rep"},
       "fpr_median curve_median curve_lo curve_hi curve_mean oracle_median oracle_lo oracle_hi oracle_mean fixed_median fixed_lo fixed_hi fixed_mean")
def bootstrap(i):
    return R.bootstrap(i.scored_rare, REPS, SEED, fixed_thr=0.6)


GC = {
    "gpool": f"""SELECT score, row_number() OVER (ORDER BY md5(name || '|gc{SEED}'), name) - 1 AS idx FROM scored_rare WHERE label = 1""",
    "gplan": "SELECT count(*) FILTER (label = 1) AS n, greatest(1, round_even(count(*) FILTER (label = 0) / 100.0::double, 0))::bigint AS draws FROM scored_rare",
    "g0": f"SELECT n, draws, r.rep, d.d FROM gplan, range({REPS}) r(rep), range((SELECT draws FROM gplan)) d(d)",
    "g1": indexed("g0", "rep", SEED),
    "g2": "SELECT g1.rep, g1.draws, gpool.score, row_number() OVER (PARTITION BY rep ORDER BY gpool.score DESC) AS k FROM g1 JOIN gpool USING (idx)",
    "g3": "SELECT rep, draws, min(k) AS k, max_by(score, -k) AS thr FROM g2 WHERE k::double / draws >= 0.9::double GROUP BY rep, draws",
    "gc": "SELECT rep, draws, k, count(*) FILTER (s.label = 0 AND s.score > thr) AS fp, k::double / (k + count(*) FILTER (s.label = 0 AND s.score > thr)) AS ppv FROM g3, scored_rare s GROUP BY 1, 2, 3",
}


@query("bootstrap_challenge", """SELECT count(*) AS reps, max(draws) AS n_draw, max(k)::double / max(draws) AS effective_recall, quantile_cont(ppv, 0.5) AS ppv_median,
  quantile_cont(ppv, 0.025) AS ppv_lo, quantile_cont(ppv, 0.975) AS ppv_hi FROM gc""", "scored_rare", GC, "effective_recall ppv_median ppv_lo ppv_hi")
def bootstrap_challenge(i):
    return R.bootstrap_challenge(i.scored_rare, REPS, SEED)


PAIR_SUM = """SELECT count(delta) AS reps, count(*) FILTER (delta > 0)::double / count(delta) AS p_gt0, quantile_cont(delta, 0.5) AS median_delta, sum(delta) / count(delta) AS mean_delta,
  quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM ({})"""
PR = "p_gt0 median_delta mean_delta lo hi"
MB = S.metrics_of(S.curve_of("drawn", "rep", "score_b"), "rep")
for _mode, _col in (("curve", "ppv"), ("auroc", "auroc"), ("auprc", "auprc")):
    query(f"paired_bootstrap_{_mode}", PAIR_SUM.format(f"SELECT rep, a.{_col} - b.{_col} AS delta FROM ma a JOIN mb b USING (rep)"), "scored_rare",
          strat(REPS) | {"ma": REP_M, "mb": MB}, PR)(lambda i, m=_mode: R.paired_bootstrap(i.scored_rare, "score", "score_b", REPS, SEED, m))
_FX = "sum(label) FILTER ({c} >= {t})::double / greatest(count(*) FILTER ({c} >= {t}), 1)"


@query("paired_bootstrap_fixed", PAIR_SUM.format(f"SELECT rep, coalesce({_FX.format(c='score', t=0.6)}, 0.0) - coalesce({_FX.format(c='score_b', t=0.55)}, 0.0) AS delta FROM drawn GROUP BY rep"),
       "scored_rare", strat(REPS), PR)
def paired_bootstrap_fixed(i):
    return R.paired_bootstrap(i.scored_rare, "score", "score_b", REPS, SEED, "fixed", thr_a=0.6, thr_b=0.55)


@query("gate", "SELECT *, CASE WHEN lo > 0 THEN 'PASS' WHEN hi < 0 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict FROM (" +
       PAIR_SUM.format("SELECT rep, a.auroc - b.auroc AS delta FROM ma a JOIN mb b USING (rep)") + ")", "scored_rare", strat(REPS_WIDE) | {"ma": REP_M, "mb": MB}, PR)
def gate(i):
    return R.gate(R.paired_bootstrap(i.scored_rare, "score", "score_b", REPS_WIDE, SEED, "auroc"))


@query("mde", "SELECT count(ppv) AS reps, quantile_cont(ppv, 0.5) AS median, stddev_pop(ppv) AS sd, 2.0 * stddev_pop(ppv) AS mde FROM m", "scored_rare", strat(REPS_WIDE) | {"m": REP_M}, "median sd mde")
def mde(i):
    return R.mde(i.scored_rare, "curve", REPS_WIDE, SEED)


@query("seed_summary", "SELECT count(auroc) AS n_seeds, sum(auroc) / count(auroc) AS mean, stddev_pop(auroc) AS sd FROM m", "scored_rare",
       {"seeds": "SELECT 0 AS seed, label, score FROM scored_rare UNION ALL SELECT 1, label, score_b FROM scored_rare UNION ALL SELECT 2, label, (score + score_b) / 2.0 FROM scored_rare",
        "m": S.metrics_of(S.curve_of("seeds", "seed"), "seed")}, "mean sd")
def seed_summary(i):
    arms = F.array(*[F.struct(F.lit(k).alias("seed"), c.alias("score")) for k, c in enumerate(
        (F.col("score"), F.col("score_b"), (F.col("score") + F.col("score_b")) / 2.0))])
    return R.seed_summary(i.scored_rare.select("label", F.explode(arms).alias("_a")).select("label", "_a.*"))


def iid(reps: int) -> dict[str, str]:
    return IID | {"i0": IID["i0"].format(reps=reps)}


IID = {
    "ipool": "SELECT *, row_number() OVER (ORDER BY md5(name || '|iid0'), name) - 1 AS idx, count(*) OVER () AS n FROM scored_rare",
    "i0": "SELECT c.n, r.rep, d.d FROM (SELECT count(*) AS n FROM scored_rare) c, range({reps}) r(rep), range((SELECT count(*) FROM scored_rare)) d(d)",
    "i1": indexed("i0", "rep", 0), "idrawn": "SELECT i1.rep, ipool.label, ipool.score FROM i1 JOIN ipool USING (idx)",
    "m": S.metrics_of(S.curve_of("idrawn", "rep"), "rep")}


@query("auroc_ci", "SELECT count(auroc) AS reps, sum(auroc) / count(auroc) AS auroc_mean, quantile_cont(auroc, 0.025) AS ci_lo, quantile_cont(auroc, 0.975) AS ci_hi FROM m", "scored_rare", iid(REPS_WIDE), "auroc_mean ci_lo ci_hi")
def auroc_ci(i):
    return R.auroc_ci(i.scored_rare, REPS_WIDE, 0)


@query("boot_ppv", "SELECT count(v) AS reps, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM (SELECT 0.9 / (0.9 + 100.0 * fpr_strict) AS v FROM m)", "scored_rare", iid(REPS), "median lo hi")
def boot_ppv(i):
    return R.boot_ppv(i.scored_rare, REPS, 0)


@query("report_full", """SELECT quantile_cont(m.ppv, 0.5) AS ppv90, quantile_cont(m.ppv, 0.025) AS ci_lo, quantile_cont(m.ppv, 0.975) AS ci_hi, any_value(g.p) AS ppv90_gc, any_value(g.l) AS gc_lo, any_value(g.h) AS gc_hi,
  any_value(b.fpr_incl) AS fpr90, any_value(b.auroc) AS auroc, any_value(b.auprc) AS auprc, any_value(b.n_pos + b.n_neg) AS n, any_value(b.n_pos) AS pos
  FROM m, base b, (SELECT quantile_cont(ppv, 0.5) AS p, quantile_cont(ppv, 0.025) AS l, quantile_cont(ppv, 0.975) AS h FROM gc) g""", "scored_rare",
       strat(REPS_WIDE) | GC | {"m": REP_M, "base": S.metrics_of(S.curve_of("scored_rare"))}, "ppv90 ci_lo ci_hi ppv90_gc gc_lo gc_hi fpr90 auroc auprc")
def report_full(i):
    return R.report_full(i.scored_rare, REPS_WIDE, SEED, challenge_reps=REPS)


GROUPS = {
    "rows0": "SELECT source AS name, min_by(score, name) AS score, min_by(label, name) AS label, min_by(center, name) AS center FROM scored GROUP BY source",
    "rows1": "SELECT *, 'POOLED' AS grp FROM rows0 UNION ALL SELECT *, center FROM rows0",
    "tagged": "SELECT *, CASE WHEN label = 1 THEN '*' ELSE center END AS stratum FROM rows1",
    "pool": f"SELECT *, row_number() OVER (PARTITION BY grp, label, stratum ORDER BY md5(name || '|pool{SEED}'), name) - 1 AS idx FROM tagged",
    "plan": """SELECT grp, label, stratum, n, CASE WHEN label = 1 THEN n ELSE round_even(round_even(P * (0.99::double / 0.01::double), 0) * (n::double / T), 0)::bigint END AS draws FROM (
      SELECT grp, label, stratum, count(*) AS n, sum(sum(label)) OVER (PARTITION BY grp) AS P, sum(sum(1 - label)) OVER (PARTITION BY grp) AS T FROM tagged GROUP BY 1, 2, 3)""",
    "d0": f"SELECT p.*, r.rep, d.d FROM plan p, range({REPS}) r(rep), range((SELECT max(draws)::bigint FROM plan)) d(d) WHERE d.d < p.draws",
    "d1": indexed("d0", "rep", SEED, "grp", "stratum", "label"),
    "drawn": "SELECT d1.grp, d1.rep, d1.label, pool.score FROM d1 JOIN pool ON pool.grp = d1.grp AND pool.label = d1.label AND pool.stratum = d1.stratum AND pool.idx = d1.idx",
    "m": S.metrics_of(S.curve_of("drawn", "grp, rep"), "grp, rep"), "point": S.metrics_of(S.curve_of("rows1", "grp"), "grp")}


@query("full_report", f"""SELECT p.grp AS "group", p.n_pos, p.n_neg, p.ppv, p.ppv_oracle, p.fpr_incl, b.* EXCLUDE (grp) FROM point p LEFT JOIN (SELECT grp, {summ('ppv', 'boot')} FROM m GROUP BY grp) b USING (grp)""",
       "scored", GROUPS, "ppv ppv_oracle fpr_incl boot_median boot_lo boot_hi boot_mean")
def full_report(i):
    return R.full_report(i.scored, "orig", REPS, SEED)


def confirm_inputs(i):
    """Labelled cells by split, persisted, for every gate and the bootstrap read them; a lost executor's blocks are computed again."""
    lc = i.lcells.filter(F.col("concept").isin(V.DISCRIMINATIVE)).drop("n_votes").persist()
    return lc.filter("split = 'train'"), lc.filter("split = 'val'")


_CAND = f"concept IN ({S.quoted(V.DISCRIMINATIVE)})"


def _auc(src, by, score="c", label="label"):
    return S.metrics_of(S.curve_of(src, by, score, label), by)


CONFIRM = {
    "tr": f"SELECT * FROM lcells WHERE {_CAND} AND split = 'train'", "va": f"SELECT * FROM lcells WHERE {_CAND} AND split = 'val'",
    "mt": _auc("tr", "concept"),
    "sgn": "SELECT concept, CASE WHEN auroc < 0.5 THEN -1.0::double ELSE 1.0::double END AS sign, CASE WHEN auroc < 0.5 THEN 1.0 - auroc ELSE auroc END AS auroc_train FROM mt",
    "ov": "SELECT va.* EXCLUDE (c), va.c * sign AS c FROM va JOIN sgn USING (concept)",
    "mi": """SELECT concept, sum((n / nt) * ln((n * nt) / (nb * nl))) AS mi FROM (
      SELECT concept, n::double AS n, sum(n) OVER (PARTITION BY concept)::double AS nt, sum(n) OVER (PARTITION BY concept, bin)::double AS nb, sum(n) OVER (PARTITION BY concept, label)::double AS nl FROM (
      SELECT concept, least(floor(c * 8), 7) AS bin, label, count(*) AS n FROM tr GROUP BY 1, 2, 3)) GROUP BY concept""",
    "mw": _auc("ov", "concept, center"), "wi": "SELECT concept, min(auroc) AS within_min FROM mw WHERE n_pos + n_neg >= 10 AND auroc IS NOT NULL GROUP BY concept",
    "ml": _auc("(SELECT *, (center = 'center_2')::int AS is_c2 FROM tr)", "concept", "c", "is_c2"), "lk": "SELECT concept, greatest(auroc, 1 - auroc) AS leak FROM ml",
    "rel": "SELECT concept, sum(r) / count(r) AS agree, sum(m) / count(m) AS assess FROM va GROUP BY concept",
    "cpool": "SELECT concept, label, c AS score, row_number() OVER (PARTITION BY concept ORDER BY md5(path || '|iid0'), path) - 1 AS idx FROM ov",
    "c0": f"SELECT s.concept, s.n, r.rep, d.d FROM (SELECT concept, count(*) AS n FROM ov GROUP BY concept) s, range({REPS_WIDE}) r(rep), range((SELECT count(*) FROM lab)) d(d) WHERE d.d < s.n",
    "c1": indexed("c0", "rep", 0), "cdrawn": "SELECT c1.concept, c1.rep, cpool.label, cpool.score FROM c1 JOIN cpool ON cpool.concept = c1.concept AND cpool.idx = c1.idx",
    "mc": S.metrics_of(S.curve_of("cdrawn", "concept, rep"), "concept, rep"),
    "ci": "SELECT concept, sum(auroc) / count(auroc) AS auroc_val, quantile_cont(auroc, 0.025) AS ci_lo, quantile_cont(auroc, 0.975) AS ci_hi FROM mc GROUP BY concept",
    "gates0": """SELECT concept, tier, role, agree, assess, mi, auroc_train, auroc_val, ci_lo, ci_hi, within_min, leak, ci_lo IS NULL OR ci_lo <= 0.5::double AS dead,
      list_filter([CASE WHEN agree < 0.6::double THEN 'agreement' END, CASE WHEN assess < 0.5::double THEN 'assessable' END, CASE WHEN leak >= 0.7::double THEN 'center_leak' END,
        CASE WHEN within_min < 0.55::double THEN 'within_center' END], lambda x: x IS NOT NULL) AS why
      FROM sgn JOIN vocab USING (concept) LEFT JOIN mi USING (concept) LEFT JOIN wi USING (concept) LEFT JOIN lk USING (concept) LEFT JOIN rel USING (concept) LEFT JOIN ci USING (concept)""",
    "gates": """SELECT * EXCLUDE (dead, why), CASE WHEN role <> 'discriminative' THEN 'n/a' WHEN dead THEN 'FAIL' WHEN len(why) = 0 THEN 'PASS' ELSE 'REVIEW' END AS status,
      CASE WHEN role <> 'discriminative' THEN '' WHEN dead THEN 'no held-out signal' ELSE array_to_string(why, '; ') END AS reasons FROM gates0"""}


@query("confirm_gates", "SELECT * FROM gates", "lcells lab vocab", CONFIRM, "agree assess mi auroc_train auroc_val ci_lo ci_hi within_min leak")
def confirm_gates(i):
    train, val = confirm_inputs(i)
    o = A.orient(train, val).select("concept", F.col("path").alias("name"), F.col("c").alias("score"), "label")
    ci = R.auroc_ci(o, REPS_WIDE, 0, ["concept"]).select("concept", F.col("auroc_mean").alias("auroc_val"), "ci_lo", "ci_hi")
    return A.confirm_gates(train, val, ci)


@query("confirm_summary", "SELECT status, count(*) AS n, string_agg(concept, ',' ORDER BY concept) AS concepts FROM gates WHERE status <> 'n/a' GROUP BY status", "lcells lab vocab", CONFIRM)
def confirm_summary(i):
    return A.confirm_summary(confirm_gates(i))
