"""Command line, packet tables on disk, and tables between steps."""

import types

import pytest
from pyspark.ml.linalg import DenseVector, SparseVector
from pyspark.sql import functions as F

from busline import cli
from busline.functions.columns import bar
from busline.operators import prepare
from busline.plans import models
from busline.plans import queries as q
from busline.schema import FEATURES, PACKETS
from busline.sources import packets as sources
from busline.sources import pcap, store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def captures(spark, tmp_path_factory):
    """One file a capture, with a frame of another protocol after each fifth packet."""
    at = tmp_path_factory.mktemp("captures")
    for r in pcap.written_captures(sources.packets_raw(spark, SF), piece=1 << 40, other=5).collect():
        (at / r.pcap_file).write_bytes(r.content)
    return str(at)


def test_commands(spark, captures, tmp_path, capsys):
    with pytest.raises(SystemExit) as done:
        cli.main(["check", "--captures", captures])
    assert done.value.code == 0 and "7 of 7" in capsys.readouterr().out
    with pytest.raises(SystemExit) as done:
        cli.main(["check", "--captures", str(tmp_path)])
    assert done.value.code == 1 and "missing: benign_traffic.pcap" in capsys.readouterr().out
    for more in ([], ["--stream"]):
        cli.main(["parse", "--captures", captures, "--out", f"{tmp_path}/packets{len(more)}", *more])
        said = capsys.readouterr().out
        assert "dropped" in said and len([x for x in said.split("\n") if ".pcap" in x]) == 7
    one, two = (spark.read.parquet(f"{tmp_path}/packets{k}") for k in (0, 1))
    assert one.count() == q._all(spark, SF).count() and one.exceptAll(two).count() == 0
    cli.main(["parse", "--captures", captures, "--out", f"{tmp_path}/packets0"])
    assert "nothing to do" in capsys.readouterr().out
    sources.write_packets(sources.read_packets(spark, f"{tmp_path}/packets0"), f"{tmp_path}/csv", "csv")
    for kind, at in (("parquet", "packets0"), ("csv", "csv")):
        cli.main(["features", "--packets", f"{tmp_path}/{at}", "--kind", kind, "--out", f"{tmp_path}/{kind}-features", "--vectors", f"{tmp_path}/{kind}-vectors"])
    rounded = lambda kind: spark.read.parquet(f"{tmp_path}/{kind}-features").select("pcap_file", "frame_no", "label", *[F.round(f, 9) for f in FEATURES])
    assert rounded("parquet").exceptAll(rounded("csv")).count() == 0
    made = spark.read.parquet(f"{tmp_path}/parquet-vectors").first()
    assert isinstance(made.features, (DenseVector, SparseVector)) and made.features.size == 18 and made.class_id in range(4)
    cli.main(["train", "--features", f"{tmp_path}/parquet-features", "--models", f"{tmp_path}/models", "--rounds", "2", "--depth", "2"])
    first = capsys.readouterr().out
    cli.main(["evaluate", "--features", f"{tmp_path}/parquet-features", "--models", f"{tmp_path}/models"])
    second = capsys.readouterr().out
    assert spark.read.parquet(f"{tmp_path}/models/softmax").groupBy("class", "tree").count().count() == 8
    cli.main(["train", "--mode", "multi", "--multi", "rest", "--features", f"{tmp_path}/parquet-features", "--models", f"{tmp_path}/rest", "--rounds", "1", "--depth", "1"])
    assert "support" in capsys.readouterr().out
    assert "importance" in second and "recall" in second and second.count("|") > 20 and all(x in first for x in ("accuracy", "auc", "support"))
    whole = prepare.read_features(spark, f"{tmp_path}/parquet-features")
    test = whole.where("NOT is_train")
    loaded = models.load(f"{tmp_path}/models/binary")
    fresh = models.fit_binary(whole.where("is_train"), 2, 2)
    got, want = (models.predict_binary(m, test).select("pcap_file", "frame_no", "prediction").collect() for m in (loaded, fresh))
    assert sorted(map(str, got)) == sorted(map(str, want)) and models.importances(loaded, 12).count() == 12


def test_csv_values(spark, tmp_path):
    names = [f.name for f in PACKETS]
    values = [{"is_sd": "1", "someip_valid": "TRUE", "src_port": "7.0", "tcp_seq": "4294967295", "timestamp": "1.5", "label": "x"}, {"is_sd": "0", "someip_valid": "", "src_port": "", "src_ip": "s", "timestamp": "bad"}]
    (tmp_path / "p.csv").write_text("\n".join([",".join(names), *(",".join(v.get(n, "") for n in names) for v in values)]))
    one, two = sources.read_packets(spark, str(tmp_path / "p.csv"), "csv").orderBy(F.col("src_ip").asc_nulls_first()).collect()
    assert (one.is_sd, one.someip_valid, one.src_port, one.tcp_seq, one.timestamp, one.label, one.src_ip) == (True, True, 7, 4294967295, 1.5, None, None)
    assert (two.is_sd, two.someip_valid, two.src_port, two.timestamp, two.src_ip) == (False, None, None, None, "s")


def test_tables_between_steps(spark):
    with store.scratch(spark):
        kept = store.stored(spark.range(5), "five")
        path = kept.inputFiles()[0].rpartition("/")[0]
        assert kept.count() == 5 and store.exists(spark, path)
    assert not store.exists(spark, path)
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d: d)))


def test_bar(spark):
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "x double").select(bar(F.col("x"))).collect()] == ["", "#" * 20, "#" * 40]
