"""The fleet tables, derived from the given parquet tables.

The given data is a sales schema with an event stream. Its customers stand for devices, its events for
checks and audit rows, its orders for alerts, its line items for scans.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.ordering import time_and_id

# Fixed clocks in place of "now", one per source of time.
AS_OF_EVENTS = "2024-01-31 00:00:00"
AS_OF_ORDERS = "2001-08-02 00:00:00"

# Columns of the given tables that are read here.
GIVEN = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
                 o_orderdate timestamp_ntz, o_orderpriority string""",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
                   l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
                   l_shipdate timestamp_ntz""",
}


class Fleet:
    """The tables of one data directory. Frames are lazy; nothing is cached or written."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def source(self, name: str) -> DataFrame:
        return self.spark.read.schema(GIVEN[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def uptime_log(self) -> DataFrame:
        return checks_of(self.source("events"))

    @cached_property
    def devices(self) -> DataFrame:
        key = "c_custkey"
        newest = self.uptime_log.groupBy("device_id").agg(
            F.max("checked_at").alias("last_seen"), F.max_by("is_online", time_and_id()).alias("is_online")
        )
        first = self.source("orders").groupBy(F.col("o_custkey").alias("first_id")).agg(
            F.min("o_orderdate").alias("first_seen")
        )
        customer = self.source("customer")
        joined = customer.join(newest, F.col(key) == F.col("device_id"), "left").join(
            first, F.col(key) == F.col("first_id"), "left"
        )
        return joined.selectExpr(
            f"{key} AS id",
            f"concat_ws('.', '10', c_nationkey, {key} div 256, {key} % 256) AS ip_address",
            f"""CASE WHEN {key} % 11 = 0 OR {key} % 512 IN (1, 254) THEN NULL
                ELSE concat(element_at(array('gw-', 'WIN-SERVER', 'ubuntu-srv-', 'LAPTOP-HR-', 'printer-',
                                             'macbook-', 'nas-', 'host'), CAST({key} % 8 + 1 AS INT)), {key})
                END AS hostname""",
            """CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Router' WHEN 'MACHINERY' THEN 'Server'
               WHEN 'BUILDING' THEN 'Laptop' WHEN 'FURNITURE' THEN 'Printer' END AS device_type""",
            f"""element_at(array('Windows Server 2019', 'Ubuntu 22.04 LTS', 'Cisco IOS 15.2', 'macOS 13', 'Red Hat 9',
                                 'FreeBSD 14', NULL), CAST({key} % 7 + 1 AS INT)) AS os_name""",
            f"""element_at(array('Windows', 'Linux', 'Cisco', 'Other', 'Linux', 'Other', NULL),
                           CAST({key} % 7 + 1 AS INT)) AS os_family""",
            f"CASE WHEN {key} % 5 <> 0 THEN concat('AA:BB:CC:00:00:', 10 + {key} % 90) END AS mac_address",
            f"CASE WHEN {key} % 4 <> 0 THEN concat('owner_', {key} % 40) END AS owner",
            """element_at(array('IT', 'HR', 'Finance', 'Development', '', NULL), c_nationkey % 6 + 1) AS department""",
            """CASE WHEN last_seen IS NULL THEN 'unknown' WHEN is_online THEN 'online'
               ELSE 'offline' END AS status""",
            f"""element_at(array('80,443,22', '80,443,3389,8080', '22,8080', '3389', '9100,515', '22', '22,3000',
                                 '631,http', NULL), CAST({key} % 9 + 1 AS INT)) AS open_ports""",
            "last_seen",
            "first_seen",
            f"CASE WHEN {key} % 3 = 0 THEN concat('note ', {key}) END AS notes",
        )

    @cached_property
    def alerts(self) -> DataFrame:
        return alerts_of(self.source("orders"))

    @cached_property
    def scan_history(self) -> DataFrame:
        # The one-letter flag is compared by its code: a whole number stays in the hash aggregate.
        scans = self.source("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_suppkey").alias("supp"),
            F.min("l_shipdate").alias("started_at"),
            F.max("l_shipdate").alias("ended"),
            F.min(F.ascii("l_returnflag")).alias("flag"),
            F.min("l_quantity").alias("qty"),
        )
        return scans.selectExpr(
            "l_orderkey * 10 + l_linenumber AS id",
            "concat('10.', supp % 25, '.0.1-254') AS ip_range",
            "started_at",
            "CASE WHEN flag <> ascii('N') THEN ended + INTERVAL 4 MINUTE END AS finished_at",
            "CAST(qty AS INT) AS devices_found",
            "CASE flag WHEN ascii('N') THEN 'running' WHEN ascii('A') THEN 'completed' ELSE 'failed' END AS status",
            "CASE WHEN l_linenumber % 2 = 0 THEN 'scheduled' ELSE 'manual' END AS triggered_by",
        )

    @cached_property
    def audit_logs(self) -> DataFrame:
        return self.source("events").selectExpr(
            "event_id AS id",
            "user_id",
            "CASE WHEN user_id % 10 <> 0 THEN concat('user_', user_id) END AS username",
            """CASE event_type WHEN 'error' THEN 'LOGIN_FAILED' WHEN 'signup' THEN 'LOGIN'
               WHEN 'click' THEN 'DEVICE_EDIT' WHEN 'view' THEN 'VIEW_DEVICE' ELSE 'SCAN_START' END AS action""",
            "CASE WHEN event_type IN ('click', 'view') THEN 'device' END AS entity_type",
            "CASE WHEN event_type IN ('click', 'view') THEN user_id END AS entity_id",
            "props AS details",
            "concat('10.9.0.', user_id % 250) AS ip_address",
            "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status",
            "ts AS created_at",
        )

    @cached_property
    def users(self) -> DataFrame:
        people = self.source("events").groupBy("user_id").agg(
            F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("last_login"),
            F.min("ts").alias("created_at"),
        )
        return people.selectExpr(
            "user_id AS id",
            "concat('user_', user_id) AS username",
            "concat('user_', user_id, '@example.com') AS email",
            "CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'viewer' END AS role",
            "user_id % 7 <> 0 AS is_active",
            "last_login",
            "created_at",
        )

    @cached_property
    def sessions(self) -> DataFrame:
        logins = self.source("events").filter("event_type = 'signup'")
        return logins.selectExpr(
            "user_id",
            "concat('tok_', event_id) AS session_token",
            "ts + INTERVAL 8 HOUR AS expires_at",
            "concat('10.9.0.', user_id % 250) AS ip_address",
            "event_id % 5 <> 0 AS is_active",
        )

    @cached_property
    def scan_results(self) -> DataFrame:
        """A detailed scan of devices with a known OS, a quick scan of the routers, then new hosts."""
        devices = self.devices
        detailed = devices.filter("os_name IS NOT NULL").selectExpr(
            "1L AS scan_id",
            "1L AS seq",
            "ip_address",
            "concat('seen-', id) AS hostname",
            "'Server' AS device_type",
            "os_name",
            "os_family",
            "mac_address",
            "'online' AS status",
            "open_ports",
        )
        quick = devices.filter("device_type = 'Router'").selectExpr(
            "2L AS scan_id",
            "2L AS seq",
            "ip_address",
            "CAST(NULL AS STRING) AS hostname",
            "CAST(NULL AS STRING) AS device_type",
            "CAST(NULL AS STRING) AS os_name",
            "CAST(NULL AS STRING) AS os_family",
            "mac_address",
            "CAST(NULL AS STRING) AS status",
            "CAST(NULL AS STRING) AS open_ports",
        )
        new = self.source("supplier").selectExpr(
            "2L AS scan_id",
            "1L AS seq",
            "concat_ws('.', '172', '16', s_suppkey div 256, s_suppkey % 256) AS ip_address",
            "concat('new-', s_suppkey) AS hostname",
            "'Unknown' AS device_type",
            "CAST(NULL AS STRING) AS os_name",
            "CAST(NULL AS STRING) AS os_family",
            "CAST(NULL AS STRING) AS mac_address",
            "'online' AS status",
            "CAST(NULL AS STRING) AS open_ports",
        )
        return detailed.unionByName(quick).unionByName(new)

    @cached_property
    def device_edits(self) -> DataFrame:
        """Every device without an owner gets one; notes are cleared where none of the ports are known."""
        return self.devices.filter("owner IS NULL").selectExpr(
            "id",
            "'editor' AS owner",
            "CASE WHEN department = 'IT' THEN 'Operations' ELSE '' END AS department",
            "CASE WHEN open_ports IS NOT NULL THEN 'edited' END AS notes",
        )

    @cached_property
    def alert_acks(self) -> DataFrame:
        """Every informational alert is acknowledged."""
        return self.alerts.filter("severity = 'info'").select(F.col("id").alias("alert_id"))

    @cached_property
    def scan_outcomes(self) -> DataFrame:
        """Every running scan ends: manual ones complete, scheduled ones fail."""
        return self.scan_history.filter("status = 'running'").selectExpr(
            "id",
            "devices_found",
            "CASE WHEN triggered_by = 'manual' THEN 'completed' ELSE 'failed' END AS status",
        )

    @cached_property
    def host_scan(self) -> DataFrame:
        """Nested scan output, one row per device; one scan per second octet of the address."""
        port = "struct('open' AS state)"
        return self.devices.selectExpr(
            "CAST(split(ip_address, '[.]')[1] AS BIGINT) AS scan_id",
            "id AS seq",
            "ip_address",
            "CASE WHEN status = 'offline' THEN 'down' ELSE 'up' END AS state",
            "hostname",
            "CASE WHEN mac_address IS NOT NULL THEN map('mac', mac_address) ELSE map() END AS addresses",
            """CASE WHEN os_name IS NOT NULL THEN array(struct(os_name AS name, 98 AS accuracy),
                                                        struct('other' AS name, 50 AS accuracy))
               ELSE array() END AS osmatch""",
            f"""map('tcp', map_from_entries(transform(
                      filter(split(coalesce(open_ports, ''), ','), p -> p RLIKE '^[0-9]+$'),
                      p -> struct(CAST(p AS INT) AS port, {port} AS info))),
                    'udp', map(53, struct('closed' AS state))) AS protocols""",
        )


def checks_of(events: DataFrame) -> DataFrame:
    """Checks from events, batch or stream."""
    return events.selectExpr(
        "event_id AS id",
        "user_id AS device_id",
        "ts AS checked_at",
        "event_type <> 'error' AS is_online",
        "CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INT) END AS response_ms",
    )


def alerts_of(orders: DataFrame) -> DataFrame:
    """Alerts from orders, batch or stream."""
    return orders.selectExpr(
        "o_orderkey AS id",
        "o_custkey AS device_id",
        "CASE o_orderstatus WHEN 'F' THEN 'offline' WHEN 'O' THEN 'back_online' ELSE 'new_device' END AS alert_type",
        "concat('alert ', o_orderkey) AS message",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'warning'
           WHEN '3-MEDIUM' THEN 'warning' ELSE 'info' END AS severity""",
        "o_orderkey % 3 = 0 AS is_read",
        "o_orderdate AS created_at",
    )
