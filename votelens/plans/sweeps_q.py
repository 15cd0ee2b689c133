"""Policy sweep queries."""

from votelens import vocabulary as V
from votelens.operators import sweeps as SW
from votelens.plans import sqlviews as S
from votelens.plans.registry import query

CONFIGS = [(1, 1), (2, 1), (2, 2), (2, 3)]
LOWS, HIGHS = [0.05, 0.08, 0.10, 0.12, 0.15], [0.55, 0.65, 0.75, 0.90]


def config_votes(configs):
    grid = ", ".join(f"('{e}x{v}', {e}, {v})" for e, v in configs)
    return f"""SELECT g.config, n.* FROM nvotes n JOIN (VALUES {grid}) g(config, e, v)
      ON CASE n.expert WHEN 'proagent' THEN 1 ELSE 2 END <= g.e AND n.lens < g.v WHERE n.path IN (SELECT path FROM lab)"""


def cfg_ctes(configs):
    trusted = S.trusted_of("ccells", by="config, path").replace("false AS cross_read", "false AS cross_read")
    return {"cvotes": config_votes(configs), "ccells": S.cells_of("cvotes", "config, path"), "ctrust": trusted,
            "clab": "SELECT c.*, l.label FROM ccells c JOIN lab l USING (path)",
            "csusp": f"""SELECT config, path, label, {S.r4('CASE WHEN st > 0 THEN sv::double / st / 10000.0::double ELSE 0.0::double END')} AS suspicion FROM (
              SELECT config, path, sum({S.u4('trust')}) FILTER (core) AS st, sum({S.u4('value')} * {S.u4('trust')}) FILTER (core) AS sv FROM ctrust GROUP BY 1, 2) JOIN lab USING (path)""",
            "ca": S.metrics_of(S.curve_of("(SELECT * FROM clab WHERE m > 0)", "config, concept", "c"), "config, concept"),
            "cs": S.metrics_of(S.curve_of("csusp", "config", "suspicion"), "config"),
            "cmeans": """SELECT config, avg(a) FILTER (core) AS core_auroc, avg(a) FILTER (role = 'discriminative') AS disc_auroc FROM (
              SELECT config, concept, CASE WHEN n_pos + n_neg >= 10 THEN greatest(auroc, 1 - auroc) END AS a FROM ca) JOIN vocab USING (concept) GROUP BY config"""}


@query("config_sweep", f"""SELECT config, core_auroc, disc_auroc, coverage, greatest(auroc, 1 - auroc) AS susp_auroc, n_pos + n_neg AS n FROM cmeans JOIN (
  SELECT config, sum(m) / count(*) AS coverage FROM clab WHERE concept IN ({S.quoted(V.ROBUST_CORE)}) GROUP BY config) USING (config) JOIN cs USING (config)""",
       "nvotes lab vocab", cfg_ctes(CONFIGS), "core_auroc disc_auroc coverage susp_auroc")
def config_sweep(i):
    return SW.config_sweep(i.votes, i.frames, CONFIGS, V.EXPERT_ORDER)


@query("vote_sweep", f"""SELECT replace(config, '2x', '')::int AS votes_per_model, core_auroc, disc_auroc, reliability, disc_auroc - max_by(disc_auroc, config) OVER () AS delta_disc
  FROM cmeans JOIN (SELECT config, sum(r) / count(*) AS reliability FROM clab WHERE concept IN ({S.quoted(V.DISCRIMINATIVE)}) GROUP BY config) USING (config)""",
       "nvotes lab vocab", cfg_ctes([(2, 1), (2, 2), (2, 3)]), "core_auroc disc_auroc reliability delta_disc")
def vote_sweep(i):
    return SW.vote_sweep(i.votes, i.frames, 3)


def vals(xs):
    return ", ".join(f"({x}::double)" for x in xs)


@query("escalation_band", """SELECT lo, hi, esc, auroc, avg_calls, escalate_pct, 6.0 / avg_calls AS speedup, auroc >= 0.6 AS meets_target,
    auroc >= 0.6 AND row_number() OVER (ORDER BY (auroc >= 0.6) DESC, avg_calls, esc, lo, hi) = 1 AS cheapest
  FROM (SELECT lo, hi, esc, greatest(auroc, 1 - auroc) AS auroc FROM m) JOIN (SELECT lo, hi, esc, avg(CASE WHEN e THEN calls ELSE 1 END) AS avg_calls, count(*) FILTER (e) * 100.0::double / count(*) AS escalate_pct
    FROM pol GROUP BY 1, 2, 3) USING (lo, hi, esc)""", "nvotes lab vocab", cfg_ctes([(1, 1), (2, 3), (2, 2)]) | {
        "wide": """SELECT path, label, max(suspicion) FILTER (config = '1x1') AS s1, max(suspicion) FILTER (config = '2x3') AS sf, max(suspicion) FILTER (config = '2x2') AS sh FROM csusp GROUP BY 1, 2""",
        "pol": f"""SELECT lo, hi, esc, calls, label, s1 >= lo AND s1 <= hi AS e, CASE WHEN s1 >= lo AND s1 <= hi THEN CASE esc WHEN 'full' THEN sf ELSE sh END ELSE s1 END AS score
          FROM wide, (VALUES {vals(LOWS)}) a(lo), (VALUES {vals(HIGHS)}) b(hi), (VALUES ('full', 6), ('half', 4)) c(esc, calls)""",
        "m": S.metrics_of(S.curve_of("pol", "lo, hi, esc"), "lo, hi, esc")}, "auroc avg_calls escalate_pct speedup")
def escalation_band(i):
    return SW.escalation_band(i.votes, i.frames, V.EXPERT_ORDER, LOWS, HIGHS, target=0.6)


def arm(name, src):
    return {f"all_{name}": S.metrics_of(S.curve_of(src, "concept", "c"), "concept"),
            f"ass_{name}": S.metrics_of(S.curve_of(f"(SELECT * FROM {src} WHERE m > 0)", "concept", "c"), "concept"),
            f"mean_{name}": f"SELECT concept, sum(m) / count(*) AS assess, sum(r) / count(*) AS rel FROM {src} GROUP BY concept"}


AB = arm("a", "lcells") | arm("b", "lcells_alt") | {"ab": """SELECT concept, greatest(x.auroc, 1 - x.auroc) AS auroc_a, CASE WHEN p.n_pos + p.n_neg >= 10 THEN greatest(p.auroc, 1 - p.auroc) END AS auroc_ass_a,
  m.assess AS assess_a, m.rel AS rel_a, greatest(y.auroc, 1 - y.auroc) AS auroc_b, CASE WHEN q.n_pos + q.n_neg >= 10 THEN greatest(q.auroc, 1 - q.auroc) END AS auroc_ass_b, n.assess AS assess_b, n.rel AS rel_b
  FROM all_a x JOIN all_b y USING (concept) LEFT JOIN ass_a p USING (concept) LEFT JOIN ass_b q USING (concept) JOIN mean_a m USING (concept) JOIN mean_b n USING (concept)"""}


@query("ab_compare", "SELECT *, auroc_b - auroc_a AS delta_auroc, auroc_ass_b - auroc_ass_a AS delta_ass FROM ab", "lcells lcells_alt", AB,
       "auroc_a auroc_ass_a assess_a rel_a auroc_b auroc_ass_b assess_b rel_b delta_auroc delta_ass")
def ab_compare(i):
    return SW.ab_compare(i.cells, i.cells_alt, i.frames)


@query("ab_group_means", """SELECT grp, avg(auroc_ass_a) AS mean_a, avg(auroc_ass_b) AS mean_b, avg(auroc_ass_b) - avg(auroc_ass_a) AS delta FROM (
  SELECT 'all' AS grp, * FROM ab UNION ALL SELECT 'core', ab.* FROM ab JOIN vocab v ON v.concept = ab.concept WHERE core UNION ALL
  SELECT 'discriminative', ab.* FROM ab JOIN vocab v ON v.concept = ab.concept WHERE role = 'discriminative') GROUP BY grp""", "lcells lcells_alt vocab", AB, "mean_a mean_b delta")
def ab_group_means(i):
    return SW.ab_group_means(SW.ab_compare(i.cells, i.cells_alt, i.frames))
