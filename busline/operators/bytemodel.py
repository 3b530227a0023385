"""Byte distributions per payload position: fitting is an aggregation, scoring a lookup and a sum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busline.functions.columns import hex_digits
from busline.operators.windows import payload
from busline.schema import FEATURES, ORDER

ALPHA = 1.0
TINY = 1e-12
SAMPLE = 50_000
#: Fixed value: payload positions that the models know.
POSITIONS = 256
MODELS = ["someip", "someipsd", "tcpudp"]


#: Ever finer steps of the order of packets, each with few values within one of the step before.
_STEPS = [
    "pcap_file", "floor(timestamp / 86400)", "floor(timestamp / 3600)", "floor(timestamp)", "floor(timestamp * 1000)", "floor(timestamp * 1000000)", "floor(frame_no / 65536)",
]
#: Rows of a step that one task may order.
STEP_ROWS = 65_536


def first_rows(rows: DataFrame, wanted: dict[str, Column], most: int, step_rows: int = STEP_ROWS) -> dict[str, tuple[Column, Column | None, int]]:
    """For each name where the first `most` wanted rows in packet order stand: (before, within, left).

    Rows for which `before` holds belong to them; of those for which `within` holds (None: there are none) the first `left`
    do. Wanted rows are counted by ever finer steps of the order, all names in one pass, and only in the step that holds the last row
    asked for, until that has step_rows at most; so no task orders more, whatever the number of rows.
    """
    found = {name: (F.lit(False), F.lit(True), most) for name in wanted}
    open_names = list(wanted)
    for step in map(F.expr, _STEPS):
        if not open_names:
            break
        inside = {n: wanted[n] & found[n][1] for n in open_names}
        some = inside[open_names[0]]
        for n in open_names[1:]:
            some |= inside[n]
        counts = rows.where(some).groupBy(step.alias("__step")).agg(*[F.count(F.when(inside[n], 1)).alias(n) for n in open_names]).collect()  # as many rows as a step has values
        counts.sort(key=lambda r: (r[0] is not None, r[0]))
        still = []
        for n in open_names:
            before, within, left = found[n]
            for r in counts:
                if r[n] > left:
                    ahead = F.lit(False) if r[0] is None else F.coalesce(step < F.lit(r[0]), F.lit(True))  # nulls stand first
                    found[n] = before | (within & ahead), within & step.eqNullSafe(F.lit(r[0])) if left else None, left
                    if left and r[n] > step_rows:
                        still.append(n)
                    break
                left -= r[n]
            else:
                found[n] = before | within, None, 0
        open_names = still
    return found


def samples(packets: DataFrame, most: int | None = SAMPLE, step_rows: int = STEP_ROWS) -> DataFrame:
    """model, payload: the first `most` fitting payloads of each model in packet order, or all of them if most is None.

    The message and transport models take harmless packets of harmless captures that are not service discovery, the discovery model
    takes harmless packets of any capture. One pass takes what stands before the last steps of all three; of these alone rows are ordered. All payloads take
    one pass and no order.
    """
    sd = F.coalesce("is_sd", F.lit(False))
    benign = (F.col("label") == 0) & (F.col("attack_type") == "normal")
    column = {"someip": "someip_payload_hex", "someipsd": "someip_payload_hex", "tcpudp": "transport_payload_hex"}
    picked = {"someip": benign & ~sd, "someipsd": (F.col("label") == 0) & sd, "tcpudp": benign & ~sd}
    wanted = {n: F.coalesce(picked[n] & payload(column[n]).isNotNull(), F.lit(False)) for n in MODELS}
    cut = {n: (F.lit(True), None, 0) for n in MODELS} if most is None else first_rows(packets, wanted, most, step_rows)
    each = F.array(*[F.when(wanted[n] & cut[n][0], F.struct(F.lit(n).alias("model"), F.col(column[n]).alias("payload"))) for n in MODELS])
    out = packets.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("s")).select("s.model", "s.payload")
    for n, (_, within, left) in cut.items():
        if within is not None:
            out = out.unionByName(packets.where(wanted[n] & within).orderBy(*ORDER).limit(left).select(F.lit(n).alias("model"), F.col(column[n]).alias("payload")))
    return out


def cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hex payloads the row and the cell (position times 256 plus byte) of each byte up to POSITIONS, and each row's bytes.

    Null, empty and invalid text has no byte.
    """
    digit, offset, length, good = hex_digits(texts)
    size = np.where(good, length // 2, 0)
    used = np.minimum(size, POSITIONS)
    row = np.repeat(np.arange(len(size)), used)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(used) - used, used)
    at = offset[row] + 2 * pos
    return row, pos * 256 + (digit[at].astype(np.int64) << 4 | digit[at + 1]), size


def byte_counts(sampled: DataFrame) -> DataFrame:
    """model, pos, byte, n: at most 256 times 256 rows a model, summed in each task before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            model = np.array(batch.column(0).to_pylist(), object)
            for name in set(model.tolist()):
                _, cell, _ = cells(batch.column(1).filter(pa.array(model == name)))
                total[name] = total.get(name, 0) + np.bincount(cell, minlength=POSITIONS * 256)
        for name, n in total.items():
            cell = np.flatnonzero(n)
            columns = [pa.array([name] * len(cell), pa.string()), pa.array(cell >> 8, pa.int32()), pa.array(cell & 255, pa.int32()), pa.array(n[cell], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["model", "pos", "byte", "n"])

    counted = sampled.select("model", "payload").mapInArrow(run, "model string, pos int, byte int, n bigint")
    return counted.groupBy("model", "pos", "byte").agg(F.sum("n").alias("n"))


def byte_totals(counts: DataFrame) -> DataFrame:
    """model, pos, pos_total: payloads that reach the position."""
    return counts.groupBy("model", "pos").agg(F.sum("n").alias("pos_total"))


def log_probability(n: Column, total: Column) -> Column:
    """Smoothed log probability of a byte seen n times among total; unseen positions are uniform."""
    return F.log((F.coalesce(n, F.lit(0)) + F.lit(ALPHA)) / (F.coalesce(total, F.lit(0)) + F.lit(256 * ALPHA)) + F.lit(TINY))


def byte_logp(counts: DataFrame) -> DataFrame:
    """model, pos, byte, n, pos_total, logp of the bytes seen."""
    joined = counts.join(F.broadcast(byte_totals(counts)), ["model", "pos"])  # at most 256 rows a model
    return joined.withColumn("logp", log_probability(F.col("n"), F.col("pos_total")))


def model_tables(counts: DataFrame) -> np.ndarray:
    """The log probability of each model, position and byte, as an array (models, POSITIONS, 256).

    Fitted counts have at most 65,536 rows a model, so they may come to the driver and go to every task.
    """
    seen, total = np.zeros((len(MODELS), POSITIONS, 256)), np.zeros((len(MODELS), POSITIONS, 1))
    for model, pos, byte, n in counts.select("model", "pos", "byte", "n").collect():
        seen[MODELS.index(model), pos, byte] = n
        total[MODELS.index(model), pos] += n
    return np.log((seen + ALPHA) / (total + 256 * ALPHA) + TINY)


def scores(texts: pa.Array, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed log probabilities (models, rows) of hex payloads, and their bytes; 0 where a payload has none.

    A payload's first POSITIONS bytes count, as the tables say nothing about others.
    """
    row, cell, size = cells(texts)
    return np.stack([np.bincount(row, t.ravel()[cell], len(size)) for t in tables]).astype(np.float64), size


def byte_features(packets: DataFrame, most: int | None = SAMPLE, fit_on: DataFrame | None = None) -> DataFrame:
    """packets with f02 to f04, log likelihoods of their payloads, and f05 to f07, the same per byte with the sign changed.

    The models are fitted on fit_on (default: packets themselves), its first `most` fitting payloads or all, and are tables of fixed size; each batch of payloads is
    decoded once and looked up for all models, without a shuffle. Columns that have the name of a feature are replaced.
    """
    tables = model_tables(byte_counts(samples(packets if fit_on is None else fit_on, most)))
    kept = packets.select(*[c for c in packets.columns if c not in FEATURES[1:7]])
    columns = [kept.columns.index(c) for c in ("someip_payload_hex", "transport_payload_hex")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [scores(batch.column(columns[0]), tables[:2]), scores(batch.column(columns[1]), tables[2:])]
            total = np.concatenate([p[0] for p in parts])
            size = np.stack([parts[0][1], parts[0][1], parts[1][1]])
            per_byte = np.where(size > 0, -total / np.maximum(size, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, [*total, *per_byte])], names=[*batch.schema.names, *FEATURES[1:7]])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *(T.StructField(f, T.DoubleType()) for f in FEATURES[1:7])]))
