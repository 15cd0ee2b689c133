"""Hand-made edge rows for votes, cells, trust and decisions."""

import pytest
from pyspark.sql import functions as F

from votelens.operators import labels as L
from votelens.operators import trust as TR
from votelens.operators import votes as VO

VOTE = "path string, expert string, lens int, concept string, raw string"


def norm(spark, concept, raws):
    v = spark.createDataFrame([("p", "e", i, concept, r) for i, r in enumerate(raws)], VOTE)
    rows = VO.normalize_votes(v).orderBy("lens").collect()
    return [(r["value"], r["mask"]) for r in rows]


def test_normalize(spark):
    assert norm(spark, "demarcation", ["3", "9", "-1", "x", None, "NA", "nan"]) == [
        (.75, 1), (1, 1), (0, 1), (0, 0), (0, 0), (0, 0), (0, 0)]
    assert norm(spark, "nodularity", [" Yes ", "no", "1", ""]) == [(1, 1), (0, 1), (1, 1), (0, 0)]
    assert norm(spark, "blur", ["severe", "Severe"]) == [(1, 1), (0, 1)]


def cell(spark, concept, raws):
    v = spark.createDataFrame([("p", "e", i, concept, r) for i, r in enumerate(raws)], VOTE)
    r = VO.aggregate_votes(v).first()
    return r["c"], r["r"], r["m"]


def test_aggregate(spark):
    assert cell(spark, "demarcation", ["2", "2"]) == (.5, 1, 1)
    assert cell(spark, "demarcation", ["0", "4"]) == (.5, 0, 1)
    c, r, m = cell(spark, "nodularity", ["yes", "yes", "no"])
    assert (round(c, 9), round(r, 9), m) == (round(2 / 3, 9), round(1 / 3, 9), 1)
    assert cell(spark, "nodularity", ["na", None]) == (0, 0, 0)


def test_decide(spark):
    d = spark.createDataFrame([(1, .49, .9), (-1, .5, .55), (-1, .5, .5499), (1, .5, 0.), (0, .9, .9)], "label int, ft double, su double")
    got = [r[0] for r in d.select(TR.decide(F.col("label"), F.col("ft"), F.col("su"))).collect()]
    assert got == ["ABSTAIN", "HARD_NEG_CANDIDATE", "CONFIDENT_NEGATIVE", "POSITIVE", "TRUE_NEGATIVE"]


def test_trust_uses_unrounded_supervise_and_cross_reading(spark):
    cells = spark.createDataFrame([("p", "nodularity", .9, 1., .55, 4), ("q", "nodularity", .9, .7, 1., 4), ("p", "blood", .5, 1., 1., 4)],
                                  "path string, concept string, c double, r double, m double, n_votes long")
    cross = spark.createDataFrame([("q", "nodularity", .4)], "path string, concept string, c_alt double")
    t = {(r["path"], r["concept"]): r for r in TR.cell_trust(cells, cross).collect()}
    assert t["p", "nodularity"]["supervise"] and not t["p", "nodularity"]["cross_read"]
    assert t["q", "nodularity"]["trust"] == pytest.approx(.35) and t["q", "nodularity"]["cross_read"]
    assert t["p", "blood"]["trust"] == pytest.approx(.8)


def test_repair_json(spark):
    d = spark.createDataFrame([('```json\n{"k": 3, }\n```',), ("no object here",), ('text {"k": 4} tail',)], "content string")
    assert [r["parsed"]["k"] if r["parsed"] else None for r in VO.repair_json(d).collect()] == [3, None, 4]


def test_validator_one_problem_each(spark):
    names = [r[0] for r in __import__("votelens.vocabulary", fromlist=["x"]).vocabulary_rows()]
    import json
    base = {"image": "i.jpg", "name": "n", "split": "s", "label": 1, "center": "c", "decision": "ABSTAIN", "frame_trust": 0.5,
            "suspicion": 1, "verified": True, "concepts": {n: {"value": 0.5, "trust": 1, "supervise": False} for n in names}}
    def rec(**kw):
        d = json.loads(json.dumps(base)) | kw
        return json.dumps({k: v for k, v in d.items() if v is not None})
    bad = dict(base["concepts"], blur={"value": True, "trust": 1})
    rows = [("ok", rec()), ("missing", rec(center=None)), ("bool", rec(label=True)), ("dec", rec(decision="MAYBE")),
            ("unknown", rec(concepts=base["concepts"] | {"halo": base["concepts"]["blur"]})), ("cell", rec(concepts=bad)), ("cut", rec()[:30]), ("list", "[1]")]
    p = L.validate_labels(spark.createDataFrame(rows, "id string, value string")).collect()
    got = {}
    for r in p:
        got.setdefault(r["id"], []).append(r["problem"])
    assert got == {"missing": ["missing key center"], "bool": ["wrong type label"], "dec": ["unknown decision"], "unknown": ["unknown concept halo"],
                   "cell": ["wrong type value in blur", "missing supervise in blur"], "cut": ["invalid JSON"], "list": ["top level is not an object"]}


def test_align_refuses_missing(spark):
    a = spark.createDataFrame([("x",), ("y",)], "name string")
    b = spark.createDataFrame([("x", 1)], "name string, v int")
    with pytest.raises(Exception, match="no partner for y"):
        L.align_by_name(a, b).collect()


def test_crop_box(spark):
    d = spark.createDataFrame([(.2, .2, .6, .6, 100, 100), (0., 0., .99, .99, 100, 100), (.5, .5, .4, .6, 100, 100), (.5, .5, .52, .52, 100, 100)],
                              "x0 double, y0 double, x1 double, y1 double, w int, h int")
    rows = VO.crop_box(d).collect()
    assert [r["usable"] for r in rows] == [True, False, False, False]
    assert (rows[0]["bx0"], rows[0]["bx1"]) == (int((.2 - (.6 - .2) * .15) * 100), int((.6 + (.6 - .2) * .15) * 100))
