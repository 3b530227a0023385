"""Command line of the packet engine: captures to packets, packets to features, training and evaluation."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import Observation
from pyspark.sql import functions as F

from busline.operators import metrics, prepare
from busline.plans import models
from busline.schema import CAPTURES
from busline.session import local_session
from busline.sources import packets as sources
from busline.sources import pcap
from busline.sources.store import exists, scratch


#: Folder of captures, packets, features and models where no option names them.
DATA = os.environ.get("BUSLINE_DATA", "data")


def _parse(spark, a) -> None:
    if exists(spark, a.out):
        print(f"{a.out} exists, nothing to do")
        return
    with scratch(spark):
        scan, seen = pcap.stream_captures if a.stream else pcap.scan_captures, Observation("captures")
        rows = scan(spark, a.captures, a.strict, dropped=True, broken=True).observe(seen, *pcap.capture_counters())
        sources.write_packets(rows.where("transport IS NOT NULL").drop("broken", "broken_at"), a.out)
        counts, rejects = pcap.capture_report(seen.get)
        for found, schema in ((counts, "pcap_file string, read bigint, written bigint, dropped bigint, attacks bigint, share double"), (rejects, "pcap_file string, byte bigint, reason string")):
            spark.createDataFrame(found, schema).show(truncate=False)
        if rejects:
            spark.createDataFrame(rejects, "pcap_file string, byte bigint, reason string").coalesce(1).write.mode("overwrite").json(f"{a.out}-rejects")


def _check(spark, a) -> None:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").load(a.captures).select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("pcap_file"))
    missing = [r[0] for r in sources.captures(spark).select("pcap_file").join(found, "pcap_file", "left_anti").collect()]
    print(f"{len(CAPTURES) - len(missing)} of {len(CAPTURES)} captures", *missing, sep="\n  missing: ")
    raise SystemExit(1 if missing else 0)


def _features(spark, a) -> None:
    if not exists(spark, a.out):
        with scratch(spark):
            rows = prepare.split(prepare.features(sources.read_packets(spark, a.packets, a.kind)))
            prepare.minmax_scaled(rows).write.mode("ignore").partitionBy("is_train").parquet(a.out)
    rows = prepare.read_features(spark, a.out)
    if a.vectors:
        models.vectors(rows).write.mode("ignore").partitionBy("is_train").parquet(a.vectors)
    metrics.class_balance(rows).show()


def _report(spark, a, binary: bool) -> None:
    test = prepare.read_features(spark, a.features).where("NOT is_train")
    if not binary and exists(spark, f"{a.models}/softmax"):
        nodes = spark.read.parquet(f"{a.models}/softmax")
        for table in (metrics.multi_metrics(models.predict_softmax(nodes, test)), models.gain_importances(nodes, 10)):
            table.show(truncate=False)
    if not binary and not exists(spark, f"{a.models}/multi"):
        return
    model = models.load(f"{a.models}/{'binary' if binary else 'multi'}")
    if not binary:
        metrics.multi_metrics(models.predict_multi(model, test)).show()
        return
    rows = models.predict_binary(model, test).persist()
    for table in (metrics.confusion(rows), metrics.binary_metrics(rows), metrics.auc(rows), metrics.recall_by_type(rows), models.importances(model, 10)):
        table.show(truncate=False)


def _modes(mode: str) -> list[bool]:
    return [b for b, n in ((True, "binary"), (False, "multi")) if mode in (n, "both")]


def _train(spark, a) -> None:
    train = prepare.read_features(spark, a.features).where("is_train")
    for binary in _modes(a.mode):
        if not binary and a.multi == "softmax":
            models.fit_softmax(train, a.rounds, a.depth).coalesce(1).write.mode("overwrite").parquet(f"{a.models}/softmax")
            _report(spark, a, binary)
            continue
        fit = models.fit_binary if binary else models.fit_multi
        models.save(fit(train, a.rounds, a.depth), f"{a.models}/{'binary' if binary else 'multi'}")
        _report(spark, a, binary)


def _evaluate(spark, a) -> None:
    for binary in _modes(a.mode):
        _report(spark, a, binary)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="busline")
    sub = parser.add_subparsers(required=True)
    for name, run, options in (
        ("check", _check, ["--captures"]), ("parse", _parse, ["--captures", "--out"]), ("features", _features, ["--packets", "--out"]),
        ("train", _train, ["--features", "--models"]), ("evaluate", _evaluate, ["--features", "--models"]),
    ):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for o in options:
            p.add_argument(o, default=f"{DATA}/{o[2:]}" if o != "--out" else f"{DATA}/{'packets' if name == 'parse' else 'features'}")
        if name == "parse":
            p.add_argument("--strict", action="store_true")
            p.add_argument("--stream", action="store_true", help="read spans of large files from a path that executors can open")
        if name == "features":
            p.add_argument("--kind", choices=["parquet", "csv"], default="parquet")
            p.add_argument("--vectors", help="also write the scaled features as a table of vectors there")
        if name in ("train", "evaluate"):
            p.add_argument("--mode", choices=["binary", "multi", "both"], default="both")
        if name == "train":
            p.add_argument("--rounds", type=int, default=100)
            p.add_argument("--depth", type=int, default=6)
            p.add_argument("--multi", choices=["softmax", "rest"], default="softmax", help="classes in one model, or a model a class against the rest")
    a = parser.parse_args(argv)
    a.run(local_session(), a)


if __name__ == "__main__":
    main()
