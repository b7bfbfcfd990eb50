from __future__ import annotations

import json

import fleet
from fleet import NOW, ago, tuples
from pyspark.sql import functions as F

from fleetlens.sources import constraints, exports, tables
from fleetlens.sources.schemas import HOST_SCAN, TABLES


def test_append_and_load(spark, tmp_path):
    path = str(tmp_path / "uptime")
    tables.append_table(fleet.uptime_log(spark), path, "uptime_log", NOW, by_day=True)
    tables.append_table(fleet.uptime_log(spark).limit(3), path, "uptime_log", NOW, by_day=True)
    loaded = tables.load_table(spark, path, "uptime_log")
    assert loaded.columns == TABLES["uptime_log"].names
    assert [f.dataType for f in loaded.schema] == [f.dataType for f in TABLES["uptime_log"]]
    assert loaded.count() == 75


def test_load_since_skips_the_folders_of_earlier_days(spark, tmp_path):
    path = str(tmp_path / "uptime")
    tables.append_table(fleet.uptime_log(spark), path, "uptime_log", NOW, by_day=True)
    recent = tables.load_table(spark, path, "uptime_log", since=ago(hours=2))
    assert recent.count() == 9
    recent.collect()
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_days_are_written_in_few_files(spark, tmp_path):
    """A day is one file here, although every task held rows of every day."""
    path = tmp_path / "uptime"
    tables.append_table(fleet.uptime_log(spark).repartition(16), str(path), "uptime_log", NOW, by_day=True)
    assert [len(list(day.glob("*.parquet"))) for day in path.glob("day=*")] == [1, 1]


def test_append_fills_defaults(spark, tmp_path):
    path = str(tmp_path / "alerts")
    bare = spark.createDataFrame([(1, 4, "offline", "m")], "id long, device_id long, alert_type string, message string")
    tables.append_table(bare, path, "alerts", NOW)
    assert tuples(tables.load_table(spark, path, "alerts")) == [(1, 4, "offline", "m", "warning", False, NOW)]


def test_load_csv(spark, tmp_path):
    path = str(tmp_path / "scans")
    fleet.scan_history(spark).write.option("header", True).csv(path)
    loaded = tables.load_table(spark, path, "scan_history", fmt="csv")
    assert sorted(tuples(loaded)) == sorted(tuples(fleet.scan_history(spark)))


def test_load_json_host_scan(spark, tmp_path):
    host = {
        "scan_id": 1,
        "seq": 1,
        "ip_address": "10.0.0.1",
        "state": "up",
        "addresses": {"mac": "AA"},
        "osmatch": [{"name": "Linux", "accuracy": 9}],
        "protocols": {"tcp": {"22": {"state": "open"}}},
    }
    (tmp_path / "hosts.json").write_text(json.dumps(host))
    loaded = tables.load_host_scan(spark, str(tmp_path / "hosts.json"))
    assert [f.dataType for f in loaded.schema] == [f.dataType for f in HOST_SCAN]
    assert loaded.select(F.expr("protocols['tcp'][22].state")).first()[0] == "open"


def test_fill_defaults(spark):
    rows = [(1, "r", None, None, None, None, None)]
    bare = spark.createDataFrame(rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES["scan_history"]))
    assert tuples(tables.fill_defaults(bare, "scan_history", NOW)) == [(1, "r", NOW, None, 0, "running", "manual")]


def test_table_counts(spark):
    found = tables.table_counts({"devices": fleet.devices(spark), "alerts": fleet.alerts(spark)})
    assert dict(tuples(found)) == {"devices": 13, "alerts": 4}


def broken(report):
    return {(r.rule, r.column_name): r.violations for r in report.collect() if r.violations}


def test_clean_tables_pass_the_audit(spark):
    parents = {"devices": fleet.devices(spark)}
    for name in ("devices", "alerts", "uptime_log", "scan_history"):
        report = constraints.audit_constraints(getattr(fleet, name)(spark), name, parents)
        assert broken(report) == {}
    assert {r.rule for r in report.collect()} == {"not_null", "allowed", "length", "unique"}


def test_audit_counts_violations(spark):
    loose = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES["alerts"])
    rows = [
        (1, 4, "offline", "m", "critical", False, NOW),
        (1, 99, "melted", None, "info", False, NOW),
        (1, 99, "offline", "x" * 501, "huge", None, NOW),
        (2, None, "offline", "m", "info", False, NOW),
    ]
    report = constraints.audit_constraints(spark.createDataFrame(rows, loose), "alerts", {"devices": fleet.devices(spark)})
    assert broken(report) == {
        ("unique", "id"): 2,
        ("foreign_key", "device_id"): 2,
        ("not_null", "device_id"): 1,
        ("not_null", "message"): 1,
        ("not_null", "is_read"): 1,
        ("allowed", "alert_type"): 1,
        ("allowed", "severity"): 1,
        ("length", "message"): 1,
    }


def test_csv_export(spark, tmp_path):
    path = str(tmp_path / "export")
    exports.export_inventory_csv(fleet.devices(spark).withColumn("secret", F.lit("x")), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == [c for c, _ in exports.EXPORT_COLUMNS]
    assert back.count() == 13
    assert back.filter("id = 1").first().last_seen == "2024-05-01 12:00:00"


def test_report_colours(spark):
    found = {r["ID"]: r.row_color for r in exports.inventory_report(fleet.devices(spark)).collect()}
    assert (found[1], found[4], found[13]) == ("d1fae5", "fee2e2", None)


def test_json_rows_keep_nulls_and_cut_fractions(spark):
    late = ago(microseconds=-999999)
    row = fleet.frame(spark, "scan_history", [(1, 'a"b', late, None, 0, "running", None)])
    found = json.loads(exports.to_json_rows(row).first()[0])
    assert found["started_at"] == "2024-05-01 12:00:00" and found["ip_range"] == 'a"b'
    assert found["finished_at"] is None and list(found) == TABLES["scan_history"].names


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    for by_day in (False, True):
        path = str(tmp_path / f"uptime-{by_day}")
        log = fleet.uptime_log(spark)
        for batch in (0, 1, 0, 1, 1):
            tables.append_table(log.filter(F.col("id") % 2 == batch), path, "uptime_log", NOW, by_day=by_day, batch=f"b{batch}")
        assert sorted(tuples(tables.load_table(spark, path, "uptime_log"))) == sorted(tuples(log))


def test_lines_that_are_no_host_are_kept_apart(spark, tmp_path):
    good = '{"ip_address": "10.0.0.1", "state": "up", "protocols": {"tcp": {"22": {"state": "open"}, "x": {"state": "open"}}}}'
    bad = ['{"ip_address": "10.0.0.2", "sta', "no json", '{"ip_address": "10.0.0.3", "seq": "many"}', "[1, 2]"]
    nameless = '{"state": "up"}'
    spark.createDataFrame([(line,) for line in [good, "", "  ", *bad, nameless]], "value string").coalesce(1).write.text(str(tmp_path / "scan"))
    hosts = tables.load_host_scan(spark, str(tmp_path / "scan")).collect()
    assert [(h.ip_address, h.state, list(h.protocols["tcp"])) for h in hosts] == [("10.0.0.1", "up", [22])]
    rejects = {r.line: r.reason for r in tables.host_scan_rejects(spark, str(tmp_path / "scan")).collect()}
    assert rejects == {**dict.fromkeys(bad, "not readable"), nameless: "no address"}


def test_exported_csv_is_read_back_in_order(spark, tmp_path):
    devices = fleet.devices(spark).withColumn("notes", F.expr("CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a \"b\", c' END"))
    path = str(tmp_path / "csv")
    exports.export_inventory_csv(devices, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        found = exports.load_inventory_csv(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    wanted = [tuple(r) for r in exports.inventory_export(devices).collect()]
    assert [tuple(r)[:-1] for r in sorted(found, key=lambda r: r.place)] == wanted
    assert sorted(r.place for r in found) == list(range(1, len(wanted) + 1))


def test_audit_reads_each_table_once(spark, tmp_path):
    devices, alerts = str(tmp_path / "devices"), str(tmp_path / "alerts")
    fleet.devices(spark).write.parquet(devices)
    fleet.alerts(spark).write.parquet(alerts)
    read = {"devices": spark.read.parquet(devices), "alerts": spark.read.parquet(alerts)}
    plan = constraints.audit_tables(read, {"devices": spark.read.parquet(devices)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3 and plan.count("Exchange hashpartitioning(number#") <= 3
