from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import labels, rules, text


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column).first()[0]


@pytest.mark.parametrize(
    "name,family",
    [
        ("Windows 11 Pro", "Windows"),
        ("Ubuntu 22.04", "Linux"),
        ("Red Hat 9", "Linux"),
        ("Windows Subsystem for Linux", "Windows"),
        ("Cisco NX", "Cisco"),
        ("Apple iOS 17", "Cisco"),
        ("macOS 13", "Other"),
        ("FreeBSD", "Other"),
        ("", None),
        (None, None),
    ],
)
def test_os_family(spark, name, family):
    assert one(spark, "n string", (name,), rules.os_family(F.col("n"))) == family
    rules.register_sql_functions(spark)
    assert spark.createDataFrame([(name,)], "n string").selectExpr("os_family(n)").first()[0] == family


@pytest.mark.parametrize(
    "host,ip,kind",
    [
        ("core-switch-srv", "10.0.0.9", "Router"),
        ("WIN-SRV01", "10.0.0.9", "Server"),
        ("hp-laserjet", "10.0.0.9", "Printer"),
        ("macbook", "10.0.0.1", "Laptop"),
        ("toaster", "10.0.0.1", "Unknown"),
        (None, "10.0.0.1", "Router"),
        ("", "10.0.0.254", "Router"),
        (None, "10.0.0.11", "Unknown"),
    ],
)
def test_device_type_basic(spark, host, ip, kind):
    rule = rules.device_type_basic(F.col("h"), F.col("ip"))
    assert one(spark, "h string, ip string", (host, ip), rule) == kind
    rules.register_sql_functions(spark)
    df = spark.createDataFrame([(host, ip)], "h string, ip string")
    assert df.selectExpr("device_type_basic(h, ip)").first()[0] == kind


@pytest.mark.parametrize(
    "ports,os,kind",
    [
        ("80,443,22", None, "Router"),
        ("80,443,22", "Cisco IOS", "Router"),
        ("80,443,22", "Ubuntu", "Server"),
        ("80,443,9100", None, "Printer"),
        ("631,http", "Ubuntu", "Printer"),
        ("22,8080", None, "Server"),
        ("3389", "Windows", "Laptop"),
        ("22", "Ubuntu", "Unknown"),
        ("http", None, "Unknown"),
        (None, None, "Unknown"),
    ],
)
def test_device_type_advanced(spark, ports, os, kind):
    rule = rules.device_type_advanced(F.lit("box"), F.lit("10.0.0.9"), rules.numeric_ports(F.col("p")), F.col("os"))
    assert one(spark, "p string, os string", (ports, os), rule) == kind


@pytest.mark.parametrize("pct,band", [(100.0, "good"), (90.0, "good"), (89.9, "fair"), (70.0, "fair"), (69.9, "poor"), (0.0, "poor")])
def test_uptime_band(spark, pct, band):
    assert one(spark, "p double", (pct,), rules.uptime_band(F.col("p"))) == band


@pytest.mark.parametrize("online,ms,value", [(True, 12, 12), (True, 0, 1), (True, None, 1), (False, 12, 0), (False, None, 0)])
def test_chart_value(spark, online, ms, value):
    assert one(spark, "o boolean, m int", (online, ms), rules.chart_value(F.col("o"), F.col("m"))) == value


@pytest.mark.parametrize(
    "seconds,shown", [(0, "0s"), (59, "59s"), (60, "1m"), (89, "1m"), (90, "2m"), (180, "3m"), (None, None)]
)
def test_duration_text(spark, seconds, shown):
    start = F.to_timestamp(F.lit("2024-05-01 10:00:00"))
    end = F.timestamp_add("SECOND", F.col("s"), start)
    assert one(spark, "s int", (seconds,), text.duration_text(start, end)) == shown


def test_labels_fall_back_to_the_code(spark):
    df = spark.createDataFrame([("LOGIN",), ("REBOOT",), (None,)], "a string")
    shown = df.select(labels.labelled(F.col("a"), labels.ACTION_LABELS)).collect()
    assert [r[0] for r in shown] == ["Login", "REBOOT", None]


def test_search_has_no_wildcards(spark):
    df = spark.createDataFrame([("100%",), ("1000",), (None,)], "a string")
    assert [r.a for r in df.filter(text.contains_text(["a"], "0%")).collect()] == ["100%"]
    assert df.filter(text.contains_text(["a"], "")).count() == 3


def test_address_forms(spark):
    df = spark.createDataFrame([("10.0.0.1",)], "a string")
    link = text.address_to_url(F.col("a"))
    assert df.select(link, text.address_from_url(link)).first() == ("10-0-0-1", "10.0.0.1")


def test_port_numbers_beyond_the_range_are_dropped(spark):
    row = spark.createDataFrame([("22,99999999999,http",), (None,)], "p string")
    assert [r[0] for r in row.select(rules.numeric_ports(F.col("p"))).collect()] == [[22], []]
