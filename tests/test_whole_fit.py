"""Features and models take their byte models from all payloads that fit, not from the first of them."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from busline.operators import bytemodel, prepare
from busline.plans import models
from busline.plans import queries as q

SF = "/root/testdata/sf0.001"
PACKET = "pcap_file string, frame_no bigint, timestamp double, label int, attack_type string, is_sd boolean, someip_payload_hex string, transport_payload_hex string"


def test_all_payloads_are_counted(spark):
    rnd = random.Random(9)
    pick = lambda: rnd.choice([None, "", *(bytes(rnd.randrange(4) for _ in range(3)).hex() for _ in range(6))])
    rows = [(rnd.choice("ab"), i, i / 8, rnd.randrange(2), rnd.choice(["normal", "dos"]), rnd.choice([True, False, None]), pick(), pick()) for i in range(2000)]
    want = collections.Counter()
    for _, _, _, label, kind, sd, si, tu in rows:
        for name, fits, text in (("someip", kind == "normal" and not sd, si), ("someipsd", sd, si), ("tcpudp", kind == "normal" and not sd, tu)):
            if label == 0 and fits and text:
                want.update((name, p, b) for p, b in enumerate(bytes.fromhex(text)))
    packets = spark.createDataFrame(rows, PACKET).repartition(5)
    counts = lambda most: {tuple(r)[:3]: r.n for r in bytemodel.byte_counts(bytemodel.samples(packets, most)).collect()}
    assert counts(None) == want and counts(20) != want


def fails(*_):
    raise AssertionError("only the first payloads are looked for")


def test_features_are_fitted_on_all(spark, monkeypatch):
    monkeypatch.setattr(bytemodel, "first_rows", fails)
    assert q.features_all(spark, SF).count() == q._all(spark, SF).count()
    assert "LIMIT" not in q.ORACLES["features_all"] and all("LIMIT 50000" in q.ORACLES[n] for n in ("minmax_stats", "minmax_scaled", "byte_loglik", "byte_counts"))


@pytest.mark.parametrize("name, fit", [("gbt_predictions", "fit_binary"), ("importances", "fit_binary"), ("ovr_predictions", "fit_multi"), ("softmax_predictions", "fit_softmax"), ("softmax_importances", "fit_softmax")])
def test_models_are_fitted_on_features_of_all(spark, monkeypatch, name, fit):
    monkeypatch.setattr(bytemodel, "first_rows", fails)
    small, held = getattr(models, fit), []
    monkeypatch.setattr(models, fit, lambda train: held.append(train.count()) or small(train, 1, 1))
    rows = q.QUERIES[name](spark, SF)
    whole = q._all(spark, SF).count()
    assert held and abs(2 * held[0] - whole) <= 2 and rows.count() == (18 if "importances" in name else whole - held[0])


def test_registered_cuts_stay(spark, monkeypatch):
    """Queries whose SQL takes the first 50,000 payloads still do."""
    asked = []
    monkeypatch.setattr(prepare.bytemodel, "byte_features", lambda rows, most, **_: asked.append(most) or rows.select("*", *[F.lit(0.0).alias(f) for f in q.FEATURES[1:7]]))
    q.minmax_stats(spark, SF), q.minmax_scaled(spark, SF)
    assert asked == [50_000, 50_000]
