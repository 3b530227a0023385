"""Captures that are written in pieces."""

from busline.plans import queries as q
from busline.sources import pcap

SF = "/root/testdata/sf0.001"


def test_frame_numbers_run_on(spark):
    rows = q.sources.packets_raw(spark, SF)
    whole, pieces = (pcap.decode_captures(pcap.written_captures(rows, n)).orderBy("pcap_file", "frame_no").collect() for n in (1 << 40, 50))
    assert len(whole) == rows.count() and len({(r.pcap_file, r.frame_no) for r in pieces}) == len(pieces)
    assert pieces == whole
