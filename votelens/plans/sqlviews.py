"""The input views of ``sources/views.py`` and the shared intermediate results, as SQL for the oracle engine."""

from __future__ import annotations

from votelens import vocabulary as V


def h(salt: str, *keys: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, '{salt}')), 1, 2) as int)"


def r4(x: str) -> str:
    return f"(floor(({x}) * 10000.0::double + 0.5::double) / 10000.0::double)"


def u4(x: str) -> str:
    """Whole 1e-4 units of a four-decimal value."""
    return f"cast(floor(({x}) * 10000.0::double + 0.5::double) as bigint)"


def m4(x: str) -> str:
    return f"sum({u4(x)})::double / count({x}) / 10000.0::double"


def rd(x: str, digits: int) -> str:
    s = f"{float(10 ** digits)!r}::double"
    return f"(floor(({x}) * {s} + 0.5::double) / {s})"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def lst(values) -> str:
    return f"[{quoted(values)}]::varchar[]"


def _vocab_values() -> str:
    rows = []
    for name, i, tier, role, kind, allowed, abnormal, core, chunk, gate, legacy, floor_ in V.vocabulary_rows():
        rows.append(f"('{name}', {i}, '{tier}', '{role}', '{kind}', {lst(allowed)}, {lst(abnormal)}, {str(core).lower()}, "
                    f"'{chunk}', {gate}::double, {legacy}::double, {floor_}::double)")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") t(concept, ord, tier, role, kind, allowed, abnormal, core, "
            "chunk, gate, legacy_gate, conf_floor)")


def _votes(alt: bool) -> str:
    own = h("b", "f.name", "c.concept")
    if alt:
        own = f"CASE WHEN {h('altcell', 'f.name', 'c.concept')} < 64 THEN {h('b2', 'f.name', 'c.concept')} ELSE {own} END"
    panel = ", ".join(f"('{e}', {i})" for e in V.EXPERT_ORDER for i in range(V.EXPERT_VOTES[e]))
    return f"""
    SELECT path, expert, lens, concept,
      CASE WHEN hv < 32 THEN 'not_assessable'
           WHEN label = 1 AND lift < 128 THEN
             CASE WHEN kind = 'ordinal' THEN cast(least(4, i + 2) as varchar)
                  WHEN kind = 'binary' THEN 'yes' ELSE coalesce(abnormal[1], allowed[i + 1]) END
           ELSE allowed[i + 1] END AS raw
    FROM (SELECT *, CASE WHEN hv < 64 THEN hv % len(allowed) ELSE base % len(allowed) END AS i
          FROM (SELECT f.path, f.label, p.expert, p.lens, c.concept, c.kind, c.allowed, c.abnormal, {own} AS base,
                       {h('t', 'f.name', 'c.concept')} AS lift,
                       {h('v', 'f.name', 'p.expert', 'p.lens', 'c.concept')} AS hv
                FROM frames f CROSS JOIN vocab c CROSS JOIN (VALUES {panel}) p(expert, lens)))"""


def _nvotes(src: str) -> str:
    """Normalised votes of the vote view ``src``."""
    return f"""
    SELECT path, expert, lens, concept, kind, CASE WHEN mask = 1 THEN v ELSE 0.0::double END AS value, mask
    FROM (SELECT s.path, s.expert, s.lens, s.concept, c.kind,
            CASE c.kind WHEN 'ordinal' THEN greatest(0.0::double, least(1.0::double, try_cast(trim(raw) as double) / 4.0))
                 WHEN 'binary' THEN CASE WHEN lower(trim(raw)) IN ('yes', 'true', '1') THEN 1.0::double ELSE 0.0::double END
                 ELSE CASE WHEN list_contains(c.abnormal, raw) THEN 1.0::double ELSE 0.0::double END END AS v,
            CASE WHEN coalesce(lower(trim(raw)), '') IN ('not_assessable', 'na', '') THEN 0
                 WHEN c.kind = 'ordinal' AND try_cast(trim(raw) as double) IS NULL THEN 0 ELSE 1 END AS mask
          FROM {src} s JOIN vocab c USING (concept))"""


def cells_of(src: str, by: str = "path", where: str = "true") -> str:
    """Cells aggregated from a normalised-vote view."""
    return f"""
    SELECT {by}, concept, CASE WHEN k > 0 THEN s / k ELSE 0.0::double END AS c,
      CASE WHEN k = 0 THEN 0.0::double
           WHEN kind = 'ordinal' THEN greatest(0.0::double, 1.0::double - 2.0::double * sqrt(greatest(q / k - (s / k) * (s / k), 0.0::double)))
           ELSE abs(2.0::double * (s / k) - 1.0::double) END AS r, k::double / n AS m, n AS n_votes
    FROM (SELECT {by}, concept, kind, count(*) AS n, count(*) FILTER (mask = 1) AS k,
            sum(value) FILTER (mask = 1) AS s, sum(value * value) FILTER (mask = 1) AS q
          FROM {src} WHERE {where} GROUP BY {by}, concept, kind)"""


def trusted_of(cells: str, factor: str = "1.0::double", gate: str = "gate", join: str = "", seen: str = "false",
               by: str = "path") -> str:
    return f"""
    SELECT {by}, concept, core, {r4('c')} AS value, {r4('t')} AS trust, t >= 0.55::double AS supervise, seen AS cross_read
    FROM (SELECT x.*, v.core, v.{gate} * x.m * x.r * ({factor}) AS t, {seen} AS seen
          FROM {cells} x JOIN vocab v USING (concept) {join} WHERE v.{gate} > 0)"""


def curated_of(trusted: str) -> str:
    ft = "CASE WHEN k > 0 THEN st::double / k / 10000.0::double ELSE 0.0::double END"
    su = "CASE WHEN st > 0 THEN sv::double / st / 10000.0::double ELSE 0.0::double END"
    return f"""
    SELECT path, name, dir, label, center, split,
      CASE WHEN ft < 0.5 THEN 'ABSTAIN' WHEN label = 1 THEN 'POSITIVE' WHEN label = 0 THEN 'TRUE_NEGATIVE'
           WHEN su >= 0.55::double THEN 'HARD_NEG_CANDIDATE' ELSE 'CONFIDENT_NEGATIVE' END AS decision,
      {r4('ft')} AS frame_trust, {r4('su')} AS suspicion, verified
    FROM (SELECT f.*, {ft} AS ft, {su} AS su, verified
          FROM frames f JOIN (SELECT path, count(*) FILTER (core) AS k, sum({u4('trust')}) FILTER (core) AS st,
            sum({u4('value')} * {u4('trust')}) FILTER (core) AS sv, bool_or(cross_read) AS verified FROM {trusted} GROUP BY path) USING (path))"""


def _score(pos: str) -> str:
    v = f"(CASE WHEN {pos} THEN value * 3.0::double ELSE value END)"
    return f"({v} / ({v} + 50.0::double))"


_CENTER = "'center_' || cast(user_id % 2 + 1 as varchar)"
_RARE = f"(event_type = 'error' AND {h('rare', 'event_id')} < 13)"


def grades_of(cells: str, salt: str = "g1") -> str:
    hg = h(salt, "path", "concept")
    sign = f"(CASE WHEN {h(salt + 's', 'path', 'concept')} < 128 THEN 1.0::double ELSE -1.0::double END)"
    return f"""SELECT path, concept, CASE WHEN {hg} < 16 THEN 'n/a'
      ELSE cast(c + {sign} * {hg} / 300.0::double as varchar) END AS raw FROM {cells}"""


def curve_of(src: str, by: str = "", score: str = "score", label: str = "label", weight: str = "1") -> str:
    """Per (group, score) counts with prefix counts from the top and group totals."""
    pre = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER ({part}) AS P, sum(neg) OVER ({part}) AS N
    FROM (SELECT {pre}{score} AS score, sum(CASE WHEN {label} = 1 THEN {weight} ELSE 0 END)::double AS pos,
      sum(CASE WHEN {label} = 0 THEN {weight} ELSE 0 END)::double AS neg FROM {src}
      WHERE {label} IN (0, 1) AND {score} IS NOT NULL GROUP BY {pre}{score})
    WINDOW w AS ({part} ORDER BY score DESC)"""


def metrics_of(curve: str, by: str = "", target: float = 0.9) -> str:
    """Every curve metric, straight from the definition: the first score whose recall reaches the target."""
    pre = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    t = f"{target}::double"
    # smallest k with k / P >= target, searched around the product
    k = (f"(CASE WHEN (floor({t} * P) - 1) / P >= {t} THEN floor({t} * P) - 1 WHEN floor({t} * P) / P >= {t} THEN floor({t} * P) "
         f"WHEN (floor({t} * P) + 1) / P >= {t} THEN floor({t} * P) + 1 ELSE floor({t} * P) + 2 END)")
    return f"""SELECT {pre}n_pos, n_neg, k, thr, fp,
      CASE WHEN n_pos > 0 THEN k / (k + fp) END AS ppv,
      CASE WHEN n_pos > 0 THEN fp_incl / greatest(n_neg, 1) END AS fpr_incl,
      CASE WHEN n_pos > 0 AND n_neg > 0 THEN fp / n_neg END AS fpr_strict,
      CASE WHEN n_pos > 0 THEN tp_incl / (tp_incl + fp_incl) END AS ppv_incl,
      CASE WHEN n_pos > 0 THEN ppv_oracle END AS ppv_oracle, CASE WHEN n_pos > 0 THEN thr_oracle END AS thr_oracle,
      CASE WHEN n_pos > 0 AND n_neg > 0 THEN u / (n_pos * n_neg) END AS auroc,
      CASE WHEN n_pos > 0 AND n_neg > 0 THEN ap / n_pos END AS auprc
    FROM (SELECT {pre}max(P) AS n_pos, max(N) AS n_neg, max(k) AS k, max(score) FILTER (cp >= k) AS thr,
        max_by(cn - neg, score) FILTER (cp >= k) AS fp, max_by(cn, score) FILTER (cp >= k) AS fp_incl,
        max_by(cp, score) FILTER (cp >= k) AS tp_incl, max(cp / (cp + cn)) FILTER (cp >= k) AS ppv_oracle,
        max_by(score, row(cp / (cp + cn), score)) FILTER (cp >= k) AS thr_oracle,
        sum(pos * (N - cn + neg / 2)) AS u, sum(CASE WHEN pos > 0 THEN pos * cp / (cp + cn) ELSE 0 END) AS ap
      FROM (SELECT *, CASE WHEN P > 0 THEN {k} END AS k FROM ({curve})) {grp})"""


def pooled_of(src: str, group: str = "center") -> str:
    """Rows repeated under POOLED."""
    return f"(SELECT * FROM {src} UNION ALL BY NAME SELECT * REPLACE ('POOLED' AS {group}) FROM {src})"


VIEWS: dict[str, tuple[str, list[str]]] = {
    "vocab": (_vocab_values(), []),
    "frames": (f"""SELECT 'out/' || source || '/images/' || cast(doc_id as varchar) || '.jpg' AS path,
        cast(doc_id as varchar) AS name, source AS dir, CASE WHEN lang = 'en' THEN 'center_1' ELSE 'center_2' END AS center,
        cast(coalesce(toxic, -1) as int) AS label,
        CASE WHEN coalesce(toxic, -1) < 0 THEN 'unlabeled' WHEN {h('split', 'doc_id')} < 192 THEN 'train' ELSE 'val' END AS split
        FROM documents LEFT JOIN labels USING (doc_id)""", []),
    "votes": (_votes(False), ["frames", "vocab"]),
    "votes_alt": (_votes(True), ["frames", "vocab"]),
    "nvotes": (_nvotes("votes"), ["votes"]),
    "nvotes_alt": (_nvotes("votes_alt"), ["votes_alt"]),
    "cells": (cells_of("nvotes"), ["nvotes"]),
    "cells_alt": (cells_of("nvotes_alt"), ["nvotes_alt"]),
    "cross_alt": (f"SELECT path, concept, c AS c_alt FROM cells_alt WHERE concept IN ({quoted(V.ROBUST_CORE)}) "
                  f"AND {h('xa', 'path')} < 128", ["cells_alt"]),
    "trusted": (trusted_of("cells"), ["cells"]),
    "curated": (curated_of("trusted"), ["trusted", "frames"]),
    "trusted_x": (trusted_of("cells", "CASE WHEN z.c_alt IS NOT NULL THEN 1.0::double - abs(x.c - z.c_alt) ELSE 1.0::double END",
                             join="LEFT JOIN cross_alt z ON z.path = x.path AND z.concept = x.concept",
                             seen="(z.c_alt IS NOT NULL)"), ["cells", "cross_alt"]),
    "curated_x": (curated_of("trusted_x"), ["trusted_x", "frames"]),
    "lab": ("SELECT path, label, center, split FROM frames WHERE label IN (0, 1)", ["frames"]),
    "lcells": ("SELECT c.*, l.label, l.center, l.split FROM cells c JOIN lab l USING (path)", ["cells", "lab"]),
    "lcells_alt": ("SELECT c.*, l.label, l.center, l.split FROM cells_alt c JOIN lab l USING (path)", ["cells_alt", "lab"]),
    "scored": (f"""SELECT cast(event_id as varchar) AS name, {_score("event_type = 'error'")} AS score,
        cast(event_type = 'error' as int) AS label, {_CENTER} AS center, cast(user_id as varchar) AS source FROM events""", []),
    "scored_rare": (f"""SELECT *, (score + hb / 256.0::double) / 2.0::double AS score_b FROM (
        SELECT cast(event_id as varchar) AS name, {_score(_RARE)} AS score, cast({_RARE} as int) AS label,
        {_CENTER} AS center, cast(user_id as varchar) AS source, {h('b', 'event_id')} AS hb FROM events)""", []),
    "scored_ties": ("""SELECT l_discount AS score, cast(l_returnflag = 'R' as int) AS label, l_linestatus AS center
        FROM lineitem""", []),
    "embedding_pools": ("""SELECT cast(vec_id as varchar) AS name, embedding AS feats, cast(label = 0 as int) AS label,
        'center_' || cast(vec_id % 2 + 1 as varchar) AS center FROM embeddings""", []),
    "model_cells": (" UNION ALL ".join([
        f"SELECT 'flash3' AS model, * FROM ({cells_of('nvotes', where=chr(34) + 'expert' + chr(34) + chr(61) + chr(39) + 'flash3' + chr(39))})",
        f"SELECT 'proagent' AS model, * FROM ({cells_of('nvotes', where=chr(34) + 'expert' + chr(34) + chr(61) + chr(39) + 'proagent' + chr(39))})",
        f"""SELECT 'flash35' AS model, * FROM ({cells_of('nvotes_alt', where=chr(34) + 'expert' + chr(34) + chr(61) + chr(39) + 'flash3' + chr(39))})
            WHERE {h('miss', 'path')} >= 20"""]), ["nvotes", "nvotes_alt"]),
}


def with_views(select: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``select`` with the needed views in dependency order, then with the extra CTEs."""
    order: list[str] = []

    def visit(v: str) -> None:
        if v in order:
            return
        for dep in VIEWS[v][1]:
            visit(dep)
        order.append(v)

    for v in views:
        visit(v)
    ctes = [f"{v} AS MATERIALIZED ({VIEWS[v][0]})" for v in order] + [f"{k} AS MATERIALIZED ({q})" for k, q in (extra or {}).items()]
    return f"WITH {', '.join(ctes)} {select}" if ctes else select


def rounded(sql: str, cols: str, digits: int = 6) -> str:
    """Outer select that rounds the named double columns."""
    if not cols:
        return sql
    rep = ", ".join(f"{rd(c, digits)} AS {c}" for c in cols.split())
    return f"SELECT * REPLACE ({rep}) FROM ({sql})"
