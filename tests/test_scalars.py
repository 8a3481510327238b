"""Scalars and guards with literal inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aircensus.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (S.ml1_rsrp, 1600, -80), (S.ml1_rsrq, 160, -20), (S.ml1_rssi, 800, -60), (S.ftl_snr, 304, 10.4), (S.nr_sinr, 320, 0),
        (S.valid_earfcn, 70645, True), (S.valid_earfcn, 262143, True), (S.valid_earfcn, 0, False), (S.valid_earfcn, 262144, False),
        (S.valid_pci, 503, True), (S.valid_pci, 504, False), (S.valid_rsrp, -150, True), (S.valid_rsrp, -151, False), (S.valid_rsrp, -39, False),
        (S.valid_nr_pci, 1007, True), (S.valid_nr_pci, 1008, False), (S.ta_distance_m, 2, 156), (S.ta_distance_m, 1, 78), (S.ta_distance_m, 0, None),
        (S.rat_of_code, 0xB0C2, "LTE"), (S.rat_of_code, 0xB823, "NR"), (S.rat_of_code, 0x5134, "GSM"), (S.rat_of_code, 0x4127, "WCDMA"), (S.rat_of_code, 0x1000, "UNKNOWN"),
        (S.bw_from_index, 4, 15), (S.bw_from_index, 9, None), (S.bw_from_nrb, 75, 15), (S.bw_from_nrb, 42, 42),
    ],
)
def test_scalar(spark, fn, value, want):
    got = one(spark, fn(F.lit(value)))
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


@pytest.mark.parametrize(("word", "pci"), [(0x9600, 300), (0x0064, 100), (0x03F4, 500), (0x07FF, 15)])
def test_packed_pci(spark, word, pci):
    assert one(spark, S.unpack_pci(F.lit(word)))["pci"] == pci


def test_null_is_not_valid_and_hint_bands(spark):
    assert one(spark, S.valid_pci(F.lit(None).cast("int"))) is False
    assert one(spark, S.lte_band(F.lit(99), F.lit(20)))["name"] == "B20"
    assert one(spark, S.lte_band(F.lit(6275)))["ul_mhz"] == pytest.approx(844.5)
    assert one(spark, S.lte_band(F.lit(6275), F.lit(3)))["dl_mhz"] is None


def test_plmn(spark):
    assert one(spark, S.format_plmn(F.lit(262), F.lit(3))) == "262-03"
    assert one(spark, S.format_plmn(F.lit(310), F.lit(7), F.lit(3))) == "310-007"
    assert tuple(one(spark, S.parse_plmn(F.lit("26207")))) == (262, 7)
    assert one(spark, S.parse_plmn(F.lit("099-01"))) is None
    assert one(spark, S.operator_label(F.lit(""))) == "Unknown PLMN"
    assert tuple(one(spark, S.decode_plmn(F.unhex(F.lit("62F210"))))) == (262, 1)


def test_spans(spark):
    assert one(spark, S.format_span(F.lit("0"), F.lit("260000000000"))) == "seen 4m 20s"
    assert one(spark, S.format_span(F.lit("9"), F.lit("5"))) == ""
    assert one(spark, S.format_age(F.lit("9"), F.lit("5"))) == "—"
    assert one(spark, S.format_age(F.lit("2026-07-29 10:00:00"), F.lit("5"))) == "2026-07-29 10:00:00"
