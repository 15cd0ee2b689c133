"""Queries that join cells to labelled frames build the votes of labelled paths only, all of them."""

import pytest

from votelens.operators import models as M
from votelens.operators import votes as VO
from votelens.plans import models_q
from votelens.plans.registry import Inputs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents 1 to 12: some repeated, some labelled twice or by null, one without an id; 5 and 6 have no label."""
    out = str(tmp_path_factory.mktemp("labelled"))
    docs = [(i, "en" if i % 2 else "de", "web") for i in [*range(1, 13), 1, 3, 5]] + [(None, "en", "web")]
    labels = [(i, i % 3 == 0) for i in (1, 2, 3, 4, 7, 8, 9, 10, 11)] + [(1, None), (12, None), (None, True)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(d, None if t is None else int(t)) for d, t in labels], "doc_id long, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


@pytest.fixture
def built(monkeypatch):
    seen, real = [], VO.aggregate_votes
    monkeypatch.setattr(VO, "aggregate_votes", lambda v, *a: (seen.append(v), real(v, *a))[1])
    return seen


def paths(df):
    return {r.path for r in df.select("path").distinct().collect()}


def test_ceiling_builds_votes_of_labelled_paths(spark, folder, built, monkeypatch):
    monkeypatch.setattr(M, "concept_ceiling", lambda values, subsets: values)
    i = Inputs(spark, folder)
    got = models_q.concept_ceiling(i)
    labelled = {r.path for r in i.frames.filter("label IN (0, 1) AND path IS NOT NULL").collect()}
    assert len(labelled) == 9 and paths(built[0]) - {None} == labelled
    rows = lambda df: sorted((r.name, r.label, r.center, sorted(r.value.items()), sorted(r.trust.items())) for r in df.collect())
    assert rows(got) == rows(M.value_maps(i.trusted, i.frames))


@pytest.mark.parametrize("name", ["lcells", "lcells_alt"])
def test_labelled_cells_equal_all_cells_joined(spark, folder, built, name):
    i = Inputs(spark, folder)
    got = getattr(i, name)
    assert paths(built[0]) - {None} == {r.path for r in i.lab.filter("path IS NOT NULL").collect()}
    want = getattr(i, name[1:]).join(i.lab, "path")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
