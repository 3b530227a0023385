"""Features of a packet from its history: per flow, per payload and per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busline.functions.columns import bit_distance, gap, ratio
from busline.operators import running
from busline.operators.running import SLICED, neighbour, numbered, running_sum, solid_keys
from busline.schema import FEATURES, FLOW, ORDER
from busline.sources.store import stored

#: Packets looked back on per flow, and per source.
RECENT = 5
SOURCE_WINDOW = 1000
#: Seconds of packets that one task orders, where these are not more than SLICE_ROWS; else they are cut further.
SLICE_SECONDS = 3600
SLICE_ROWS = running.SLICE_ROWS
SLICE = ["pcap_file", *SLICED]
#: Places of a source that one task orders.
PART = 65_536
#: Units of a second in which slices begin: a power of two, so that times of one second and more are told apart as their doubles are.
_UNITS = 1 << 30


def payload(name: str) -> Column:
    """A payload with empty text as null."""
    return F.nullif(F.col(name), F.lit(""))


def sliced(packets: DataFrame) -> DataFrame:
    """packets with the slices of their captures by time, unless they have them: an hour, or less where packets crowd."""
    if SLICED[0] in packets.columns:
        return packets
    return running.sliced(packets, ["pcap_file"], F.col("timestamp"), _UNITS, SLICE_SECONDS * _UNITS, F.col("frame_no"), SLICE_ROWS)


def _unsliced(made: DataFrame, packets: DataFrame) -> DataFrame:
    """made without the helping columns that packets haven't had."""
    return made.drop(*[c for c in made.columns if c.startswith("__") and c not in packets.columns])


#: Of features that look at the previous packet of a flow what they look at; f13 looks at more than one.
_BEFORE = {FEATURES[0]: "timestamp", FEATURES[9]: "tu", FEATURES[10]: "ip_len", FEATURES[11]: "transport_len", FEATURES[12]: "si"}


def flow_features(packets: DataFrame, recent: int = RECENT, names: list[str] | None = None) -> DataFrame:
    """packets with f01 and f08 to f13 (or those of them in names): differences to the previous packet of the flow, and the share of the flow's
    last `recent` payloads (nulls counting) that equal this one.

    f08 compares with the previous packet of the flow that is not service discovery, f09 with the previous one that is;
    a null payload is remembered as null. A flow may be a whole capture, so it is handled in slices of time: packets are shuffled
    by flow and slice, and what a slice must know of those before it (the last packets, the last payload of
    either kind) is carried over a table with one row a slice. Only what the names asked for look at is carried.
    """
    names = [f for f in [FEATURES[0], *FEATURES[7:13]] if names is None or f in names]
    seen, depth = [_BEFORE[f] for f in names if f in _BEFORE], recent if FEATURES[12] in names else 1
    kinds = [k for k, f in (("plain", FEATURES[7]), ("sd", FEATURES[8])) if f in names]
    sd, si, tu = F.coalesce("is_sd", F.lit(False)), payload("someip_payload_hex"), payload("transport_payload_hex")
    now = {"si": si, "tu": tu, "timestamp": F.col("timestamp"), "ip_len": F.col("ip_len"), "transport_len": F.col("transport_len")}
    marked = sliced(packets).withColumn("__now", F.struct(F.lit(True).alias("here"), *[now[c].alias(c) for c in seen]))
    marked = marked.withColumns({f"__{k}": F.when(sd if k == "sd" else ~sd, F.struct(si.alias("v"))) for k in kinds})
    marked, solid = solid_keys(marked, [*FLOW, *SLICED])
    flow, cells = solid[: len(FLOW)], solid[len(FLOW) :]
    inside = Window.partitionBy(*solid).orderBy("timestamp", "frame_no")
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda kind, w: F.last(f"__{kind}", ignorenulls=True).over(w)
    # Of each slice its last packets, newest first, and at the very last what came last of either kind.
    ends = marked.select(*solid, "__now", F.lead("__now", depth).over(inside).alias("__later"), F.lead("__now", 1).over(inside).alias("__next"), F.row_number().over(inside).alias("__rn"), *[last(k, prior.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__{k}") for k in kinds]).where("__later IS NULL")
    newest = F.transform(F.sort_array(F.collect_list(F.struct("__rn", "__now")), asc=False), lambda x: x["__now"])
    slices = ends.groupBy(*solid).agg(newest.alias("__newest"), *[F.first(F.when(F.col("__next").isNull(), F.col(f"__{k}")), ignorenulls=True).alias(f"__{k}") for k in kinds])
    across = Window.partitionBy(*flow).orderBy(*cells)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    held = F.slice(F.flatten(F.reverse(F.collect_list("__newest").over(across.rowsBetween(-depth, -1)))), 1, depth)
    carried = slices.select(*solid, held.alias("__held"), *[last(k, before).alias(f"__{k}_held") for k in kinds])
    rows = marked.withColumns({"__rn": F.row_number().over(inside), **{f"__{k}": last(k, prior) for k in kinds}, **{f"__now{k}": F.lag("__now", k).over(inside) for k in range(1, depth + 1)}})
    rows = rows.join(carried, solid)
    back = {k: F.coalesce(F.col(f"__now{k}"), F.get("__held", F.lit(k) - F.col("__rn"))) for k in range(1, depth + 1)}
    rows = rows.withColumns({f"__now{k}": back[k] for k in back} | {f"__{k}": F.coalesce(f"__{k}", f"__{k}_held")["v"] for k in kinds})
    one = F.col("__now1")
    made = {
        FEATURES[0]: lambda: gap(F.col("timestamp"), one["timestamp"]),
        FEATURES[7]: lambda: F.when(~sd, bit_distance(F.col("__plain"), si)).otherwise(F.lit(0.0)),
        FEATURES[8]: lambda: F.when(sd, bit_distance(F.col("__sd"), si)).otherwise(F.lit(0.0)),
        FEATURES[9]: lambda: bit_distance(one["tu"], tu),
        FEATURES[10]: lambda: gap(F.col("ip_len"), one["ip_len"]),
        FEATURES[11]: lambda: gap(F.col("transport_len"), one["transport_len"]),
        FEATURES[12]: lambda: F.when(si.isNull(), F.lit(0.0)).otherwise(ratio(sum((F.coalesce((F.col(f"__now{k}")["si"] == si).cast("int"), F.lit(0)) for k in back), F.lit(0)), F.least(F.lit(recent), F.col("__rn") - 1 + F.size("__held")))),
    }
    return _unsliced(rows.withColumns({f: made[f]() for f in names}), packets)


def duplicate_source(packets: DataFrame) -> DataFrame:
    """packets with f14: 1 when the payload was last seen, in any capture, from another source.

    A payload's packets are handled in slices of time; a packet without payload is a group of its own.
    """
    si = payload("someip_payload_hex")
    marked = sliced(packets).withColumn("__si", F.coalesce(si, F.concat(F.lit("-"), F.col("frame_no").cast("string"))))
    some = neighbour(marked, ["__si"], SLICE, ORDER, "src_ip", "__before")
    f14 = F.when(si.isNotNull() & (F.col("__before") != F.col("src_ip")), F.lit(1.0)).otherwise(F.lit(0.0))
    return _unsliced(some.withColumn("f14_duplicate_source", f14), packets)


def source_rate(packets: DataFrame, window: int = SOURCE_WINDOW) -> DataFrame:
    """packets with f17: packets a second over the source's last `window` packets; the number of packets where no time passed.

    Packets are numbered per source in slices of time, and each meets the first of its window by an equi-join on the
    number, so a source of any size is spread over many tasks. The numbered packets are stored, as both sides read them.
    """
    rows = stored(numbered(sliced(packets), ["src_ip"], SLICE, ORDER, "__n"), "numbered")
    begin = rows.select(F.col("src_ip").alias("__src"), F.col("__n").alias("__at"), F.col("timestamp").alias("__from"))
    at = F.greatest(F.col("__n") - (window - 1), F.lit(1))
    joined = rows.join(begin, (F.col("src_ip") == F.col("__src")) & (at == F.col("__at")), "left")
    count = F.least(F.col("__n"), F.lit(window)).cast("double")
    passed = F.col("timestamp") - F.col("__from")
    f17 = F.when(count < 2, F.lit(0.0)).when(passed > 0, (count - 1) / passed).otherwise(count)
    return _unsliced(joined.withColumn("f17_src_packet_rate", f17), packets)


def payload_diversity(packets: DataFrame, window: int = SOURCE_WINDOW) -> DataFrame:
    """packets with f18: distinct share of the source's last `window` payloads; a packet without payload has the share so far.

    A sweep: payloads are numbered per source; place j is the last of its payload for all window ends from j up to, not
    including, min(next place of the payload, j + window), so the distinct count at i is i less the places that ended up
    to i. Sums run in slices.
    """
    has = F.coalesce(payload("someip_payload_hex").isNotNull(), F.lit(False))
    rows = stored(running_sum(sliced(packets), ["src_ip"], SLICE, ORDER, has.cast("bigint"), "__nn"), "places")
    places = rows.where(has).select("src_ip", payload("someip_payload_hex").alias("__si"), "__nn")
    # A flood repeats one payload, so the next place of a payload is looked for in parts of a source's places, too.
    places = neighbour(places.withColumn("__part", F.floor(F.col("__nn") / PART)), ["src_ip", "__si"], ["__part"], ["__nn"], "__nn", "__next", before=False)
    places = places.withColumn("__end", F.least(F.coalesce("__next", F.col("__nn") + window), F.col("__nn") + window))
    ends = places.groupBy("src_ip", F.col("__end").alias("__nn")).agg(F.count("*").alias("__gone"))
    places = places.select("src_ip", "__nn").join(ends, ["src_ip", "__nn"], "left").withColumn("__part", F.floor(F.col("__nn") / PART))
    places = running_sum(places, ["src_ip"], ["__part"], ["__nn"], F.coalesce("__gone", F.lit(0)), "__ended")
    size = F.least(F.col("__nn"), F.lit(window))
    share = F.when(size > 1, (F.col("__nn") - F.col("__ended")) / size.cast("double")).otherwise(F.lit(0.0))
    shares = places.select("src_ip", "__nn", share.alias("__share"))
    joined = rows.join(shares, ["src_ip", "__nn"], "left")
    return _unsliced(joined.withColumn("f18_src_payload_diversity", F.coalesce("__share", F.lit(0.0))), packets)


def lengths(packets: DataFrame) -> DataFrame:
    """packets with f15 and f16: length of the message body and of the transport layer."""
    return packets.withColumns({
        "f15_someip_payload_length": F.coalesce(F.col("someip_payload_len").cast("double"), F.lit(0.0)),
        "f16_tcpudp_payload_length": F.coalesce(F.col("transport_len").cast("double"), F.lit(0.0)),
    })
