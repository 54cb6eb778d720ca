"""Scalar expressions on hand-written edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names, rules, times, values
from tidemark.operators import registry

NAN, INF = float("nan"), float("inf")


def column(spark, kind, data, expression):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


def test_number_text(spark):
    cases = {
        -0.0: "-0", 1.0: "1", -1.5: "-1.5", 20.0: "20", 0.1: "0.1", 6.55: "6.55", 1e6: "1000000", 1e7: "10000000",
        12345678.5: "12345678.5", 1.5e10: "15000000000", 123456789012345.0: "123456789012345", 1e14: "100000000000000",
        1e15: "1E+15", 1e16: "1E+16", 1.25e17: "1.25E+17", -2.5e100: "-2.5E+100", 0.001: "0.001", 0.0001: "0.0001",
        0.00012: "0.00012", 1e-5: "1E-05", -1.5e-7: "-1.5E-07", 1e-100: "1E-100", 100.125: "100.125",
        9999999.0: "9999999", NAN: "NaN", INF: "Infinity", -INF: "-Infinity",
    }
    got = column(spark, "double", list(cases), values.number_text(F.col("v")))
    assert got == list(cases.values())
    assert column(spark, "double", [0.0, None], values.number_text(F.col("v"))) == ["0", None]


def test_display_value_prefers_the_number(spark):
    frame = spark.createDataFrame([(1.0, "x"), (None, "x"), (None, None)], "n double, t string")
    assert [r[0] for r in frame.select(values.display_value(F.col("n"), F.col("t"))).collect()] == ["1", "x", ""]


def test_csv_field_quotes_only_what_must_be(spark):
    data = ["plain", " lead", "a,b", 'say "x"', "two\nlines", "cr\r", ""]
    want = ["plain", " lead", '"a,b"', '"say ""x"""', '"two\nlines"', '"cr\r"', ""]
    assert column(spark, "string", data, values.csv_field(F.col("v"))) == want


def test_status_severity(spark):
    data = [0, 0x00A90000, 0x40000000, 0x408F0000, 0x80000000, 0x80AB0000, 0xC0000000]
    want = ["Good", "Good", "Uncertain", "Uncertain", "Bad", "Bad", "Bad"]
    assert column(spark, "long", data, values.status_quality(F.col("v"))) == want


def test_quality_codes_and_names(spark):
    assert column(spark, "string", ["Good", "Bad", "Uncertain", "?"], values.quality_code(F.col("v"))) == [0, 2, 1, 1]
    assert column(spark, "int", [0, 1, 2, 9], values.quality_name(F.col("v"))) == ["Good", "Uncertain", "Bad", "Uncertain"]


def test_normalising(spark):
    frame = spark.createDataFrame(
        [(0, 2.5, None, None), (1, None, True, None), (2, None, False, "false"), (3, None, None, "on"), (4, None, None, None)],
        "i int, n double, b boolean, t string",
    )
    n, b, t = F.col("n"), F.col("b"), F.col("t")
    got = frame.orderBy("i").select(
        values.numeric_value(n, b), values.text_value(n, b, t), values.type_name(n, b, t, F.lit("X"))
    ).collect()
    assert [tuple(r) for r in got] == [
        (2.5, None, "X"), (1.0, None, "X"), (0.0, None, "X"), (None, "on", "X"), (None, None, "Null")
    ]


def test_times(spark):
    ms = [0, 1704067200000, 1704067207179, 1706659199999]
    assert column(spark, "long", ms, times.iso_utc(F.col("v"))) == [times.ms_to_iso(m) for m in ms]
    assert column(spark, "long", ms, times.window_start(F.col("v"), times.HOUR_MS)) == [m // 3600000 * 3600000 for m in ms]
    at = dt.datetime(2024, 1, 1, 0, 0, 7, 179999)
    assert column(spark, "timestamp_ntz", [at], times.epoch_ms(F.col("v"))) == [1704067207179]  # floored
    assert times.last_elapsed_window(1706659200000, 6 * times.HOUR_MS) == 1706659200000 - 6 * times.HOUR_MS
    assert times.last_elapsed_window(1706659200000 - 1, 6 * times.HOUR_MS) == 1706659200000 - 12 * times.HOUR_MS


def test_tag_names(spark):
    data = [
        "ns=4;s=|var|P.Application.G.fb.X", "ns=4;s=a.Application.b.Application.c", "ns=4;s=a.application.b",
        "ns=4;i=77", "i=85", "ns=4;s=end.Application.",
    ]
    want = ["G.fb.X", "b.Application.c", "leaf", "leaf", "leaf", ""]
    assert column(spark, "string", data, names.tag_name(F.col("v"), F.lit("leaf"))) == want
    assert column(spark, "string", data, names.namespace_index(F.col("v"))) == [4, 4, 4, 4, 0, 4]


def test_tag_filter(spark):
    data = ["ns=4;s=|VAR|P.APPLICATION.x", "ns=4;s=|var|P.x", "ns=0;s=|var|.Application.", "ns=3;s=|var|.Application.", "junk"]
    assert column(spark, "string", data, registry.passes_tag_filter(F.col("v"))) == [True, False, False, False, False]
    any_namespace = registry.passes_tag_filter(F.col("v"), namespaces=[])
    assert column(spark, "string", data, any_namespace) == [True, False, False, True, False]


def test_folders(spark):
    got = column(spark, "string", ["a.b.c", "x", "a..c"], names.folder_prefixes(F.col("v")))
    assert got == [["", "a", "a.b"], [""], ["", "a", "a."]]
    assert column(spark, "string", ["a.b.c", "x"], names.folder_path(F.col("v"))) == ["a.b", ""]


def test_file_names(spark):
    assert column(spark, "string", ["a/b:c", "", "  ", "x<>|?*\\\"y", "tab\t"], names.file_name_part(F.col("v"))) == [
        "a_b_c", "Site", "Site", "x_______y", "tab_"
    ]
    start = F.lit(1704067200000)
    frame = spark.range(1).select(
        names.partition_file(F.lit("S"), start), names.rolling_csv_file(F.lit("S"), F.lit("P/1")),
        names.window_csv_file(F.lit("S"), F.lit("P"), start, start + 90_000_000),
    )
    assert tuple(frame.first()) == ("S-20240101T0000Z.parquet", "S-P_1.csv", "S-P-202401010000_202401020100.csv")


@pytest.mark.parametrize(
    ("name", "url", "policy", "error"),
    [
        ("P", "opc.tcp://h:4840", "None", None), ("P", "OPC.TCP://h", "basic256sha256", None),
        (" ", "x", "x", "Name is required."), (None, "x", "x", "Name is required."),
        ("P", "", "x", "Endpoint URL is required."),
        ("P", "http://h", "None", "Endpoint must be a valid opc.tcp:// URL (got 'http://h')."),
        ("P", "opc.tcp://", "None", "Endpoint must be a valid opc.tcp:// URL (got 'opc.tcp://')."),
        ("P", "opc.tcp://h:4840/path", "Weak", "Unknown security policy 'Weak'."),
        ("P", "opc.tcp://[::1]:4840", "None", None),
    ],
)
def test_plc_rules(spark, name, url, policy, error):
    frame = spark.createDataFrame([(name, url, policy)], "n string, u string, p string")
    assert frame.select(rules.plc_error(F.col("n"), F.col("u"), F.col("p"))).first()[0] == error


@pytest.mark.parametrize(
    ("mode", "minutes", "weekday", "day", "hours", "error"),
    [
        ("Daily", 0, 99, 99, 24, None), ("Daily", 0, 0, 0, 0, "Partition size must be at least 1 hour."),
        ("Daily", 0, 0, 0, 25, "Partition size (25 h) must be ≤ the upload period (24 h)."),
        ("Interval", 90, 0, 0, 2, "Partition size (2 h) must be ≤ the upload period (1.5 h)."),
        ("Interval", 0, 0, 0, 1, "Partition size (1 h) must be ≤ the upload period (0 h)."),
        ("Weekly", 0, 7, 0, 24, "Day of week must be 0 (Sunday) to 6 (Saturday)."), ("Weekly", 0, 6, 0, 168, None),
        ("Monthly", 0, 0, 29, 24, "Day of month must be 1 to 28."), ("Monthly", 0, 0, 28, 672, None),
    ],
)
def test_schedule_rules(spark, mode, minutes, weekday, day, hours, error):
    frame = spark.createDataFrame([(mode, minutes, weekday, day, hours)], "m string, i int, w int, d int, h int")
    got = frame.select(rules.schedule_error(*[F.col(c) for c in "miwdh"])).first()[0]
    assert got == error
