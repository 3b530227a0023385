"""Bytes are scored once on the way to the feature table, and a split that is read once is not stored."""

from busline.operators import prepare
from busline.plans import queries as q

SF = "/root/testdata/sf0.001"


def test_bytes_are_scored_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(prepare, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name))
    rows = q.features_all(spark, SF)
    plan = dict(plans)["features"]
    assert plan.count("MapInArrow") == 1 and rows.count() == q._all(spark, SF).count()


def test_split_read_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(q, "stored", lambda df, name: names.append(name) or real(df, name))
    assert q.minmax_stats(spark, SF).count() == 1 and names == []


real = prepare.stored
