"""The registered queries as plain SQL over the given tables, written independently of the operators."""

from __future__ import annotations

import re

# The derived tables. Each may read the ones before it.
VIEWS = {
    "uptime_log": """
        SELECT event_id AS id, user_id AS device_id, ts AS checked_at, event_type <> 'error' AS is_online,
               CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INT) END AS response_ms
        FROM events""",
    "device_latest": """
        SELECT device_id, checked_at, is_online
        FROM (SELECT device_id, checked_at, is_online,
                     row_number() OVER (PARTITION BY device_id ORDER BY checked_at DESC, id DESC) AS rn
              FROM uptime_log) x
        WHERE rn = 1""",
    "device_first": """
        SELECT o_custkey AS device_id, min(o_orderdate) AS first_seen FROM orders GROUP BY o_custkey""",
    "devices": """
        SELECT c.c_custkey AS id,
               '10.' || CAST(c.c_nationkey AS STRING) || '.' || CAST(CAST(floor(c.c_custkey / 256.0) AS BIGINT) AS STRING)
                     || '.' || CAST(c.c_custkey % 256 AS STRING) AS ip_address,
               CASE WHEN c.c_custkey % 11 = 0 OR c.c_custkey % 512 IN (1, 254) THEN NULL ELSE
                    CASE c.c_custkey % 8 WHEN 0 THEN 'gw-' WHEN 1 THEN 'WIN-SERVER' WHEN 2 THEN 'ubuntu-srv-'
                         WHEN 3 THEN 'LAPTOP-HR-' WHEN 4 THEN 'printer-' WHEN 5 THEN 'macbook-'
                         WHEN 6 THEN 'nas-' ELSE 'host' END || CAST(c.c_custkey AS STRING) END AS hostname,
               CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Router' WHEN 'MACHINERY' THEN 'Server'
                    WHEN 'BUILDING' THEN 'Laptop' WHEN 'FURNITURE' THEN 'Printer' ELSE NULL END AS device_type,
               CASE c.c_custkey % 7 WHEN 0 THEN 'Windows Server 2019' WHEN 1 THEN 'Ubuntu 22.04 LTS'
                    WHEN 2 THEN 'Cisco IOS 15.2' WHEN 3 THEN 'macOS 13' WHEN 4 THEN 'Red Hat 9'
                    WHEN 5 THEN 'FreeBSD 14' ELSE NULL END AS os_name,
               CASE c.c_custkey % 7 WHEN 0 THEN 'Windows' WHEN 1 THEN 'Linux' WHEN 2 THEN 'Cisco'
                    WHEN 3 THEN 'Other' WHEN 4 THEN 'Linux' WHEN 5 THEN 'Other' ELSE NULL END AS os_family,
               CASE WHEN c.c_custkey % 5 = 0 THEN NULL
                    ELSE 'AA:BB:CC:00:00:' || CAST(10 + c.c_custkey % 90 AS STRING) END AS mac_address,
               CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE 'owner_' || CAST(c.c_custkey % 40 AS STRING) END AS owner,
               CASE c.c_nationkey % 6 WHEN 0 THEN 'IT' WHEN 1 THEN 'HR' WHEN 2 THEN 'Finance'
                    WHEN 3 THEN 'Development' WHEN 4 THEN '' ELSE NULL END AS department,
               CASE WHEN l.device_id IS NULL THEN 'unknown' WHEN l.is_online THEN 'online' ELSE 'offline' END AS status,
               CASE c.c_custkey % 9 WHEN 0 THEN '80,443,22' WHEN 1 THEN '80,443,3389,8080' WHEN 2 THEN '22,8080'
                    WHEN 3 THEN '3389' WHEN 4 THEN '9100,515' WHEN 5 THEN '22' WHEN 6 THEN '22,3000'
                    WHEN 7 THEN '631,http' ELSE NULL END AS open_ports,
               l.checked_at AS last_seen, f.first_seen AS first_seen,
               CASE WHEN c.c_custkey % 3 = 0 THEN 'note ' || CAST(c.c_custkey AS STRING) END AS notes
        FROM customer c
        LEFT JOIN device_latest l ON l.device_id = c.c_custkey
        LEFT JOIN device_first f ON f.device_id = c.c_custkey""",
    "alerts": """
        SELECT o_orderkey AS id, o_custkey AS device_id,
               CASE o_orderstatus WHEN 'F' THEN 'offline' WHEN 'O' THEN 'back_online' ELSE 'new_device' END AS alert_type,
               'alert ' || CAST(o_orderkey AS STRING) AS message,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'warning'
                    WHEN '3-MEDIUM' THEN 'warning' ELSE 'info' END AS severity,
               o_orderkey % 3 = 0 AS is_read, o_orderdate AS created_at
        FROM orders""",
    "scan_history": """
        SELECT l_orderkey * 10 + l_linenumber AS id,
               '10.' || CAST(min(l_suppkey) % 25 AS STRING) || '.0.1-254' AS ip_range,
               min(l_shipdate) AS started_at,
               CASE WHEN min(l_returnflag) = 'N' THEN NULL ELSE max(l_shipdate) + INTERVAL 4 MINUTE END AS finished_at,
               CAST(min(l_quantity) AS INT) AS devices_found,
               CASE min(l_returnflag) WHEN 'N' THEN 'running' WHEN 'A' THEN 'completed' ELSE 'failed' END AS status,
               CASE WHEN l_linenumber % 2 = 0 THEN 'scheduled' ELSE 'manual' END AS triggered_by
        FROM lineitem
        GROUP BY l_orderkey, l_linenumber""",
    "audit_logs": """
        SELECT event_id AS id, user_id,
               CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'user_' || CAST(user_id AS STRING) END AS username,
               CASE event_type WHEN 'error' THEN 'LOGIN_FAILED' WHEN 'signup' THEN 'LOGIN' WHEN 'click' THEN 'DEVICE_EDIT'
                    WHEN 'view' THEN 'VIEW_DEVICE' ELSE 'SCAN_START' END AS action,
               CASE WHEN event_type IN ('click', 'view') THEN 'device' END AS entity_type,
               CASE WHEN event_type IN ('click', 'view') THEN user_id END AS entity_id,
               props AS details, '10.9.0.' || CAST(user_id % 250 AS STRING) AS ip_address,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, ts AS created_at
        FROM events""",
    "users": """
        SELECT user_id AS id, 'user_' || CAST(user_id AS STRING) AS username,
               'user_' || CAST(user_id AS STRING) || '@example.com' AS email,
               CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'viewer' END AS role,
               user_id % 7 <> 0 AS is_active,
               min(CASE WHEN event_type = 'signup' THEN ts END) AS last_login, min(ts) AS created_at
        FROM events GROUP BY user_id""",
    "sessions": """
        SELECT user_id, 'tok_' || CAST(event_id AS STRING) AS session_token, ts + INTERVAL 8 HOUR AS expires_at,
               '10.9.0.' || CAST(user_id % 250 AS STRING) AS ip_address, event_id % 5 <> 0 AS is_active
        FROM events WHERE event_type = 'signup'""",
    "scan_results": """
        SELECT CAST(1 AS BIGINT) AS scan_id, CAST(1 AS BIGINT) AS seq, ip_address, 'seen-' || CAST(id AS STRING) AS hostname,
               'Server' AS device_type, os_name, os_family, mac_address, 'online' AS status, open_ports
        FROM devices WHERE os_name IS NOT NULL
        UNION ALL
        SELECT 2, 2, ip_address, NULL, NULL, NULL, NULL, mac_address, NULL, NULL
        FROM devices WHERE device_type = 'Router'
        UNION ALL
        SELECT 2, 1, '172.16.' || CAST(CAST(floor(s_suppkey / 256.0) AS BIGINT) AS STRING) || '.'
                     || CAST(s_suppkey % 256 AS STRING),
               'new-' || CAST(s_suppkey AS STRING), 'Unknown', NULL, NULL, NULL, 'online', NULL
        FROM supplier""",
    "last_results": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ip_address ORDER BY scan_id DESC, seq DESC) AS rn
                       FROM scan_results) x
        WHERE rn = 1""",
    "new_results": """
        SELECT r.*, (SELECT max(id) FROM devices) + row_number() OVER (ORDER BY r.ip_address) AS new_id
        FROM last_results r WHERE r.ip_address NOT IN (SELECT ip_address FROM devices)""",
    "device_edits": """
        SELECT id, 'editor' AS owner, CASE WHEN department = 'IT' THEN 'Operations' ELSE '' END AS department,
               CASE WHEN open_ports IS NOT NULL THEN 'edited' END AS notes
        FROM devices WHERE owner IS NULL""",
    "alert_acks": "SELECT id AS alert_id FROM alerts WHERE severity = 'info'",
    "flips": """
        SELECT device_id, id, checked_at, CASE WHEN is_online THEN 'back_online' ELSE 'offline' END AS alert_type
        FROM (SELECT *, lag(is_online) OVER (PARTITION BY device_id ORDER BY checked_at, id) AS was FROM uptime_log) x
        WHERE was IS NOT NULL AND was <> is_online""",
    "alert_rows": """
        SELECT f.device_id, f.alert_type,
               CASE WHEN f.alert_type = 'offline' AND d.device_type = 'Server'
                    THEN 'CRITICAL: Server ' || coalesce(d.hostname, d.ip_address) || ' (' || d.ip_address
                         || ') is not responding!'
                    ELSE coalesce(d.device_type, 'Device') || ' ' || coalesce(d.hostname, d.ip_address) || ' ('
                         || d.ip_address || ') is ' || CASE f.alert_type WHEN 'offline' THEN 'offline.'
                                                            ELSE 'back online.' END END AS message,
               CASE WHEN f.alert_type <> 'offline' THEN 'info' WHEN d.device_type = 'Server' THEN 'critical'
                    ELSE 'warning' END AS severity,
               false AS is_read, f.checked_at AS created_at
        FROM flips f JOIN devices d ON d.id = f.device_id""",
    "checks_24": """
        SELECT * FROM (SELECT u.*, d.ip_address, row_number() OVER (PARTITION BY u.device_id
                                                                    ORDER BY u.checked_at DESC, u.id DESC) AS check_no
                       FROM uptime_log u JOIN devices d ON d.id = u.device_id) x
        WHERE check_no <= 24""",
    "sums": """
        SELECT device_id, count(*) AS n, CAST(sum(CASE WHEN is_online THEN 1 ELSE 0 END) AS BIGINT) AS up,
               CAST(sum(response_ms) AS BIGINT) AS ms, count(response_ms) AS ms_n
        FROM uptime_log GROUP BY device_id""",
    "listing": """
        SELECT a.id, a.alert_type,
               CASE a.alert_type WHEN 'offline' THEN 'Offline' WHEN 'back_online' THEN 'Back Online'
                    WHEN 'new_device' THEN 'New Device' ELSE a.alert_type END AS type_label,
               a.message, a.severity, a.is_read, a.created_at, d.ip_address, d.hostname
        FROM alerts a JOIN devices d ON d.id = a.device_id""",
    "audit_listing": """
        SELECT id, username, action, entity_type, entity_id, details, ip_address, status, created_at,
               CASE action WHEN 'LOGIN' THEN 'Login' WHEN 'LOGIN_FAILED' THEN 'Login Failed' WHEN 'SCAN_START' THEN 'Scan'
                    WHEN 'DEVICE_EDIT' THEN 'Device Edit' WHEN 'VIEW_DEVICE' THEN 'View' ELSE action END AS action_label
        FROM audit_logs""",
    "open_port_list": """
        SELECT id, list_sort(list_transform(list_filter(string_split(coalesce(open_ports, ''), ','),
                                                        lambda p: regexp_full_match(p, '[0-9]+')),
                                            lambda p: CAST(p AS INT))) AS ports
        FROM devices""",
    "classified": """
        SELECT d.id, d.ip_address, d.hostname, d.os_name, d.mac_address, d.status, o.ports,
               CASE WHEN hostname IS NULL OR hostname = ''
                    THEN CASE WHEN ip_address LIKE '%.1' OR ip_address LIKE '%.254' THEN 'Router' ELSE 'Unknown' END
                    WHEN regexp_matches(lower(hostname), 'router|gateway|gw|cisco|switch') THEN 'Router'
                    WHEN regexp_matches(lower(hostname), 'srv|server|svr|dc|nas') THEN 'Server'
                    WHEN regexp_matches(lower(hostname), 'printer|print|hp|canon|epson') THEN 'Printer'
                    WHEN regexp_matches(lower(hostname), 'laptop|notebook|pc|desktop|win|mac') THEN 'Laptop'
                    ELSE 'Unknown' END AS basic,
               CASE WHEN os_name IS NULL OR os_name = '' THEN NULL
                    WHEN lower(os_name) LIKE '%windows%' THEN 'Windows'
                    WHEN regexp_matches(lower(os_name), 'linux|ubuntu|debian|centos|fedora|red hat') THEN 'Linux'
                    WHEN lower(os_name) LIKE '%cisco%' OR lower(os_name) LIKE '%ios%' THEN 'Cisco'
                    ELSE 'Other' END AS family
        FROM devices d JOIN open_port_list o ON o.id = d.id""",
    "typed": """
        SELECT *, CASE WHEN list_has_all(ports, [80, 443, 22]) AND (os_name IS NULL OR lower(os_name) LIKE '%cisco%')
                       THEN 'Router'
                       WHEN list_has_any(ports, [9100, 515, 631]) THEN 'Printer'
                       WHEN list_has_any(ports, [80, 443, 3306, 5432, 1433, 8080]) THEN 'Server'
                       WHEN list_contains(ports, 3389) THEN 'Laptop'
                       ELSE basic END AS advanced
        FROM classified""",
    "arrived": """
        SELECT *, checked_at + CASE WHEN response_ms >= 60 THEN INTERVAL 240 HOUR WHEN response_ms >= 30 THEN INTERVAL 30 MINUTE
                                    ELSE INTERVAL 0 HOUR END AS arrived_at
        FROM uptime_log""",
    "late_feed": """
        SELECT *, CAST(date_trunc('week', arrived_at) AS DATE) AS week FROM arrived
        UNION ALL
        SELECT *, CAST(date_trunc('week', arrived_at + INTERVAL 48 HOUR) AS DATE) FROM arrived WHERE NOT is_online""",
    "marks": """
        SELECT week, date_trunc('millisecond', max(newest) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING))
                     - INTERVAL 1 HOUR AS mark
        FROM (SELECT week, max(checked_at) AS newest FROM late_feed GROUP BY week) x""",
    "last_mark": """
        SELECT date_trunc('millisecond', max(checked_at)) - INTERVAL 1 HOUR AS mark FROM uptime_log""",
}

EVENTS_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
ORDERS_NOW = "TIMESTAMP '2001-08-02 00:00:00'"

# Rounding to a tenth of a percent is written in whole numbers: floor((2000 a + b) / 2b) tenths.
PCT = "CAST((2000 * {a} + {b}) // (2 * {b}) AS DOUBLE) / 10"


def pct(a: str, b: str) -> str:
    return PCT.format(a=a, b=b)


def _text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


DEVICE_FIELDS = (
    "id, ip_address, hostname, device_type, os_name, os_family, mac_address, owner, department, status, "
    "open_ports, last_seen, first_seen, notes"
)
EXPORT_FIELDS = (
    "id, ip_address, hostname, device_type, os_name, os_family, mac_address, owner, department, status, open_ports, "
    f"{_text('first_seen')} AS first_seen, {_text('last_seen')} AS last_seen, notes"
)


def _violations(table: str, rule: str, column: str, test: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{column}' AS column_name, count(*) AS violations "
        f"FROM {table} WHERE {test}"
    )


def _unique(table: str, column: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, 'unique' AS rule, '{column}' AS column_name, "
        f"count({column}) - count(DISTINCT {column}) AS violations FROM {table}"
    )


def _device_audit() -> str:
    required = ["id", "ip_address", "status", "first_seen"]
    allowed = {
        "status": "'online', 'offline', 'unknown'",
        "device_type": "'Server', 'Laptop', 'Router', 'Printer', 'Unknown'",
        "os_family": "'Windows', 'Linux', 'Cisco', 'Other'",
    }
    lengths = {
        "ip_address": 15, "hostname": 255, "device_type": 50, "os_name": 100, "os_family": 20, "mac_address": 17,
        "owner": 100, "department": 100, "status": 20, "open_ports": 500, "notes": 500,
    }
    parts = [_violations("devices", "not_null", c, f"{c} IS NULL") for c in required]
    parts += [_violations("devices", "allowed", c, f"{c} NOT IN ({v})") for c, v in allowed.items()]
    parts += [_violations("devices", "length", c, f"length({c}) > {n}") for c, n in lengths.items()]
    parts += [_unique("devices", c) for c in ("id", "ip_address")]
    return " UNION ALL ".join(parts)


def _alert_audit() -> str:
    parts = [
        _violations("alerts", "not_null", c, f"{c} IS NULL")
        for c in ("id", "device_id", "alert_type", "message", "severity", "is_read", "created_at")
    ]
    parts.append(_violations("alerts", "allowed", "alert_type", "alert_type NOT IN ('offline', 'back_online', 'new_device')"))
    parts.append(_violations("alerts", "allowed", "severity", "severity NOT IN ('info', 'warning', 'critical')"))
    parts += [
        _violations("alerts", "length", c, f"length({c}) > {n}")
        for c, n in (("alert_type", 50), ("message", 500), ("severity", 20))
    ]
    parts.append(_unique("alerts", "id"))
    parts.append(_orphans("alerts", "device_id", "SELECT id FROM devices WHERE status <> 'offline'"))
    return " UNION ALL ".join(parts)


def _orphans(table: str, column: str, parents: str) -> str:
    return _violations(table, "foreign_key", column, f"{column} NOT IN ({parents})")


def _other_audits() -> str:
    required = {
        "scan_history": ("id", "ip_range", "started_at", "devices_found", "status"),
        "uptime_log": ("id", "device_id", "checked_at", "is_online"),
        "users": ("id", "username", "role", "is_active", "created_at"),
        "sessions": ("user_id", "session_token", "expires_at", "is_active"),
        "audit_logs": ("id", "action", "status", "created_at"),
    }
    unique = [("scan_history", "id"), ("uptime_log", "id"), ("users", "id"), ("users", "username")]
    unique += [("sessions", "session_token"), ("audit_logs", "id")]
    parts = [_violations(t, "not_null", c, f"{c} IS NULL") for t, columns in required.items() for c in columns]
    parts.append(_violations("scan_history", "allowed", "status", "status NOT IN ('running', 'completed', 'failed')"))
    lengths = (("ip_range", 50), ("status", 20), ("triggered_by", 100))
    parts += [_violations("scan_history", "length", c, f"length({c}) > {n}") for c, n in lengths]
    parts += [_unique(t, c) for t, c in unique]
    parts.append(_orphans("uptime_log", "device_id", "SELECT id FROM devices WHERE status <> 'offline'"))
    parts.append(_orphans("sessions", "user_id", "SELECT id FROM users WHERE is_active"))
    return " UNION ALL ".join(parts)


def _windows(length_days: int) -> str:
    """Uptime per device and window."""
    return f"""
        WITH starts AS (
            SELECT u.*, date_trunc('day', checked_at) - to_days(CAST(k AS INT)) AS window_start
            FROM uptime_log u, range({length_days}) r(k)),
        per_window AS (
            SELECT device_id, window_start, window_start + to_days({length_days}) AS window_end, count(*) AS total_checks,
                   CAST(sum(CASE WHEN is_online THEN 1 ELSE 0 END) AS BIGINT) AS online_checks
            FROM starts GROUP BY device_id, window_start)
        SELECT *, {pct('online_checks', 'total_checks')} AS uptime_pct FROM per_window"""


QUERIES = {
    # Sources and sinks
    "load_table": "SELECT * FROM uptime_log",
    "load_since": "SELECT * FROM uptime_log WHERE checked_at >= TIMESTAMP '2024-01-24 00:00:00'",
    "load_csv": "SELECT * FROM alerts",
    "load_host_scan": """
        SELECT CAST(string_split(ip_address, '.')[2] AS BIGINT) AS scan_id, id AS seq, ip_address, hostname,
               advanced AS device_type, os_name, family AS os_family, mac_address, 'online' AS status,
               nullif(array_to_string(ports, ','), '') AS open_ports
        FROM typed WHERE status <> 'offline' AND hostname IS NOT NULL""",
    "host_scan_rejects": "SELECT ip_address, 'not readable' AS reason FROM devices WHERE hostname IS NULL",
    "append_repeated": """
        SELECT * FROM alerts
        UNION ALL
        SELECT (SELECT max(id) FROM alerts) + row_number() OVER (ORDER BY created_at, device_id, alert_type, message) AS id,
               device_id, alert_type, message, severity, is_read, created_at
        FROM alert_rows""",
    "export_csv": f"""
        SELECT {EXPORT_FIELDS},
               row_number() OVER (ORDER BY CASE devices.status WHEN 'online' THEN 1 WHEN 'offline' THEN 2 ELSE 3 END, ip_address)
                   AS place
        FROM devices""",
    "append_table": f"""
        SELECT (SELECT max(id) FROM alerts) + row_number() OVER (ORDER BY created_at, device_id, alert_type, message) AS id,
               device_id, alert_type, message, severity, is_read, created_at
        FROM alert_rows""",
    "audit_constraints": f"{_device_audit()} UNION ALL {_alert_audit()} UNION ALL {_other_audits()}",
    "fill_defaults": f"""
        SELECT * REPLACE (CASE WHEN status = 'online' THEN status ELSE 'unknown' END AS status,
                          CASE WHEN status = 'online' AND first_seen IS NOT NULL THEN first_seen ELSE {ORDERS_NOW} END
                              AS first_seen)
        FROM devices""",
    "inventory_export": f"SELECT {EXPORT_FIELDS} FROM devices",
    "inventory_report": f"""
        SELECT id AS "ID", ip_address AS "IP Address", hostname AS "Hostname", device_type AS "Device Type",
               os_name AS "Operating System", os_family AS "OS Family", mac_address AS "MAC Address", owner AS "Owner",
               department AS "Department", status AS "Status", open_ports AS "Open Ports",
               {_text('first_seen')} AS "First Seen", {_text('last_seen')} AS "Last Seen", notes AS "Notes",
               CASE status WHEN 'online' THEN 'd1fae5' WHEN 'offline' THEN 'fee2e2' END AS row_color
        FROM devices""",
    "json_rows": f"""
        SELECT CAST(json_object('id', id, 'username', username, 'action', action, 'entity_type', entity_type,
                                'entity_id', entity_id, 'details', details, 'ip_address', ip_address, 'status', status,
                                'created_at', {_text('created_at')}) AS VARCHAR) AS json
        FROM audit_logs""",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("devices", "scan_history", "alerts", "uptime_log")
    ),
    # Listings and lookups
    "device_listing": f"""
        SELECT {DEVICE_FIELDS}, CASE status WHEN 'online' THEN 1 WHEN 'offline' THEN 2 ELSE 3 END AS status_rank
        FROM devices""",
    "lookup_devices": f"SELECT {DEVICE_FIELDS} FROM devices WHERE ip_address IN (SELECT ip_address FROM scan_results)",
    "missing_devices": """
        SELECT DISTINCT ip_address FROM scan_results WHERE ip_address NOT IN (SELECT ip_address FROM devices)""",
    "search_inventory": f"""
        SELECT {DEVICE_FIELDS} FROM devices
        WHERE (status = 'Server' OR device_type = 'Server')
          AND lower(ip_address || '|' || coalesce(hostname, '') || '|' || coalesce(owner, '') || '|'
                    || coalesce(department, '')) LIKE '%srv%'""",
    "search_inventory_status": f"""
        SELECT {DEVICE_FIELDS} FROM devices
        WHERE status = 'online' AND (ip_address LIKE '%10.1%' OR lower(hostname) LIKE '%10.1%'
                                     OR lower(owner) LIKE '%10.1%' OR lower(department) LIKE '%10.1%')""",
    "alert_listing": "SELECT * FROM listing",
    "alert_listing_unread": "SELECT * FROM listing WHERE NOT is_read",
    "filter_alerts": "SELECT * FROM listing WHERE severity = 'critical'",
    "device_alerts": "SELECT * FROM listing WHERE ip_address IN (SELECT ip_address FROM devices WHERE status = 'offline')",
    "recent_alerts": "SELECT * FROM listing ORDER BY created_at DESC, id DESC LIMIT 5",
    "offline_devices": """
        SELECT ip_address, coalesce(hostname, 'Unknown') AS hostname, coalesce(device_type, '?') AS device_type, last_seen
        FROM devices WHERE status = 'offline'""",
    "search_audit": """
        SELECT * FROM audit_listing WHERE lower(username) LIKE '%ser\\_1%' ESCAPE '\\' AND action = 'LOGIN_FAILED'
        ORDER BY created_at DESC, id DESC LIMIT 200""",
    "filter_audit": """
        SELECT * FROM (SELECT * FROM audit_listing ORDER BY created_at DESC, id DESC LIMIT 200) x
        WHERE action = 'VIEW_DEVICE' AND (lower(username) LIKE '%"k": 4%' OR lower(details) LIKE '%"k": 4%')""",
    "filter_audit_all": """
        SELECT id, user_id, username, action, entity_type, entity_id, details, ip_address, status, created_at
        FROM audit_logs WHERE lower(username) LIKE '%er\\_7%' ESCAPE '\\' OR lower(details) LIKE '%er\\_7%' ESCAPE '\\'""",
    "recent_scans": """
        SELECT *, CASE status WHEN 'completed' THEN 'Completed' WHEN 'running' THEN 'Running' ELSE 'Failed' END AS status_label,
               CASE WHEN date_diff('second', started_at, finished_at) < 60
                    THEN CAST(date_diff('second', started_at, finished_at) AS VARCHAR) || 's'
                    ELSE CAST((date_diff('second', started_at, finished_at) + 30) // 60 AS VARCHAR) || 'm' END AS duration
        FROM scan_history ORDER BY started_at DESC, id DESC LIMIT 20""",
    "last_checks": """
        SELECT device_id, ip_address, check_no, checked_at, strftime(checked_at, '%H:%M') AS time_of_day, is_online,
               response_ms, CASE WHEN NOT is_online THEN 0 WHEN coalesce(response_ms, 0) = 0 THEN 1
                                 ELSE response_ms END AS chart_value
        FROM checks_24""",
    "user_directory": "SELECT id, username, email, role, is_active, last_login, created_at FROM users",
    "device_ports": """
        SELECT id, ip_address, trim(unnest(string_split(open_ports, ','))) AS port FROM devices""",
    "live_sessions": f"""
        SELECT s.user_id, s.session_token, s.expires_at, u.username, u.email, u.role
        FROM sessions s JOIN users u ON u.id = s.user_id
        WHERE s.is_active AND u.is_active AND s.expires_at >= {EVENTS_NOW} - INTERVAL 10 DAY""",
    # Counts and indicators
    "status_counts": """
        SELECT count(*) AS total, count(*) FILTER (status = 'online') AS online,
               count(*) FILTER (status = 'offline') AS offline, count(*) FILTER (status = 'unknown') AS unknown
        FROM devices""",
    "devices_by_type": """
        SELECT device_type, count(*) AS n_devices FROM devices WHERE device_type IS NOT NULL GROUP BY device_type""",
    "devices_by_os": """
        SELECT os_family, count(*) AS n_devices FROM devices WHERE os_family IS NOT NULL GROUP BY os_family""",
    "unread_alert_count": "SELECT count(*) AS unread_alerts FROM alerts WHERE NOT is_read",
    "dashboard_stats": """
        SELECT 'total' AS section, 'total' AS name, count(*) AS n FROM devices
        UNION ALL SELECT 'total', 'online', count(*) FROM devices WHERE status = 'online'
        UNION ALL SELECT 'total', 'offline', count(*) FROM devices WHERE status = 'offline'
        UNION ALL SELECT 'total', 'unknown', count(*) FROM devices WHERE status = 'unknown'
        UNION ALL SELECT 'by_type', device_type, count(*) FROM devices WHERE device_type IS NOT NULL GROUP BY device_type
        UNION ALL SELECT 'by_os', os_family, count(*) FROM devices WHERE os_family IS NOT NULL GROUP BY os_family
        UNION ALL SELECT 'alerts', 'unread', count(*) FROM alerts WHERE NOT is_read""",
    "period_kpi": f"""
        WITH per_device AS (
            SELECT device_id, (2000 * sum(CASE WHEN is_online THEN 1 ELSE 0 END) + count(*)) // (2 * count(*)) AS tenths
            FROM uptime_log WHERE checked_at >= {EVENTS_NOW} - INTERVAL 7 DAY GROUP BY device_id)
        SELECT coalesce((SELECT CAST((2 * sum(tenths) + count(*)) // (2 * count(*)) AS DOUBLE) / 10 FROM per_device), 0)
                 AS avg_uptime,
               (SELECT count(*) FROM devices) AS total_devices,
               (SELECT count(*) FROM alerts WHERE created_at >= {EVENTS_NOW} - INTERVAL 7 DAY) AS total_alerts,
               (SELECT count(*) FROM scan_history WHERE started_at >= {EVENTS_NOW} - INTERVAL 7 DAY) AS total_scans""",
    "period_kpi_orders": f"""
        WITH per_device AS (
            SELECT device_id, (2000 * sum(CASE WHEN is_online THEN 1 ELSE 0 END) + count(*)) // (2 * count(*)) AS tenths
            FROM uptime_log WHERE checked_at >= {ORDERS_NOW} - INTERVAL 90 DAY GROUP BY device_id)
        SELECT coalesce((SELECT CAST((2 * sum(tenths) + count(*)) // (2 * count(*)) AS DOUBLE) / 10 FROM per_device), 0)
                 AS avg_uptime,
               (SELECT count(*) FROM devices) AS total_devices,
               (SELECT count(*) FROM alerts WHERE created_at >= {ORDERS_NOW} - INTERVAL 90 DAY) AS total_alerts,
               (SELECT count(*) FROM scan_history WHERE started_at >= {ORDERS_NOW} - INTERVAL 90 DAY) AS total_scans""",
    "daily_activity": f"""
        WITH days AS (
            SELECT CAST(started_at AS DATE) AS day, 1 AS s, 0 AS a FROM scan_history
            WHERE started_at >= {ORDERS_NOW} - INTERVAL 90 DAY
            UNION ALL
            SELECT CAST(created_at AS DATE), 0, 1 FROM alerts WHERE created_at >= {ORDERS_NOW} - INTERVAL 90 DAY),
        daily AS (SELECT day, CAST(sum(s) AS BIGINT) AS scans, CAST(sum(a) AS BIGINT) AS alerts FROM days GROUP BY day)
        SELECT *, lag(alerts) OVER (ORDER BY day) AS prev_day_alerts FROM daily""",
    "department_share": f"""
        SELECT coalesce(x.department, 'Unassigned') AS department, total_devices, online, offline,
               {pct('total_devices', '(SELECT count(*) FROM devices)')} AS share_pct
        FROM (SELECT devices.department, count(*) AS total_devices, count(*) FILTER (status = 'online') AS online,
                     count(*) FILTER (status = 'offline') AS offline
              FROM devices GROUP BY devices.department) x""",
    "device_uptime": f"""
        SELECT d.id, d.ip_address, d.hostname, d.device_type, d.department, coalesce(s.n, 0) AS total_checks,
               coalesce(s.up, 0) AS online_checks, {pct('s.up', 's.n')} AS uptime_pct,
               CAST(s.ms AS DOUBLE) / s.ms_n AS avg_response_ms
        FROM devices d LEFT JOIN sums s ON s.device_id = d.id""",
    "uptime_ranking": f"""
        WITH scored AS (
            SELECT d.*, s.n, {pct('s.up', 's.n')} AS p, CAST((2 * s.ms + s.ms_n) // (2 * s.ms_n) AS DOUBLE) AS avg_ms
            FROM devices d JOIN sums s ON s.device_id = d.id)
        SELECT ip_address, coalesce(hostname, 'Unknown') AS hostname, device_type,
               coalesce(department, 'Unassigned') AS department, n AS total_checks, p AS uptime_pct, avg_ms,
               rank() OVER (ORDER BY p DESC) AS rank_uptime, ntile(4) OVER (ORDER BY p DESC, id) AS quartile,
               CASE WHEN p >= 90 THEN 'good' WHEN p >= 70 THEN 'fair' ELSE 'poor' END AS band
        FROM scored""",
    "alert_analysis": """
        SELECT alert_type, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical,
               count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos,
               count(*) FILTER (NOT is_read) AS unread, min(created_at) AS first_alert, max(created_at) AS last_alert,
               CASE alert_type WHEN 'offline' THEN 'Offline' WHEN 'back_online' THEN 'Back Online'
                    ELSE 'New Device' END AS type_label
        FROM alerts GROUP BY alert_type""",
    "device_growth": f"""
        WITH daily AS (SELECT CAST(first_seen AS DATE) AS discovered_on, count(*) AS new_devices
                       FROM devices WHERE first_seen IS NOT NULL GROUP BY 1),
        running AS (SELECT *, CAST(sum(new_devices) OVER (ORDER BY discovered_on) AS BIGINT) AS cumulative_total FROM daily),
        compared AS (SELECT *, lag(cumulative_total) OVER (ORDER BY discovered_on) AS earlier FROM running)
        SELECT discovered_on, new_devices, cumulative_total, {pct('new_devices', 'earlier')} AS growth_pct FROM compared""",
    "user_activity": """
        WITH per_user AS (
            SELECT audit_logs.username AS raw, action, count(*) AS n_actions, count(*) FILTER (status = 'failed') AS n_failed,
                   min(created_at) AS first_action, max(created_at) AS last_action
            FROM audit_logs GROUP BY audit_logs.username, action)
        SELECT coalesce(raw, 'anonymous') AS username, action, n_actions, n_failed, first_action, last_action,
               rank() OVER (PARTITION BY action ORDER BY n_actions DESC) AS rank_in_action
        FROM per_user""",
    "audit_headline": """
        SELECT count(*) AS total, count(*) FILTER (action = 'LOGIN') AS logins,
               count(*) FILTER (action = 'LOGIN_FAILED') AS failed_logins, count(*) FILTER (action = 'SCAN_START') AS scans
        FROM (SELECT * FROM audit_logs ORDER BY created_at DESC, id DESC LIMIT 200) x""",
    "recent_uptime_summary": """
        WITH per_device AS (
            SELECT device_id, count(*) AS n, CAST(sum(CASE WHEN is_online THEN 1 ELSE 0 END) AS BIGINT) AS up,
                   CAST(sum(nullif(response_ms, 0)) AS BIGINT) AS ms, count(nullif(response_ms, 0)) AS ms_n
            FROM checks_24 GROUP BY device_id)
        SELECT d.id AS device_id, d.ip_address, coalesce(n, 0) AS checks, coalesce((200 * up + n) // (2 * n), 0) AS uptime_pct,
               CASE WHEN ms_n > 0 THEN (2 * ms + ms_n) // (2 * ms_n) END AS avg_ms
        FROM devices d LEFT JOIN per_device p ON p.device_id = d.id""",
    "check_round_summary": """
        SELECT time_bucket(INTERVAL 300 SECOND, checked_at) AS round_start,
               time_bucket(INTERVAL 300 SECOND, checked_at) + INTERVAL 300 SECOND AS round_end,
               count(*) FILTER (is_online) AS online, count(*) FILTER (NOT is_online) AS offline
        FROM uptime_log GROUP BY 1, 2""",
    # Rules and scans
    "os_family": "SELECT id, os_name, family AS os_family FROM classified",
    "device_type_basic": "SELECT id, hostname, ip_address, basic AS device_type FROM classified",
    "typed_in_sql": "SELECT id, family AS os_family, basic AS device_type FROM classified",
    "device_type_advanced": "SELECT id, hostname, ip_address, advanced AS device_type FROM typed",
    "flatten_scan": """
        SELECT CAST(string_split(ip_address, '.')[2] AS BIGINT) AS scan_id, id AS seq, ip_address, hostname,
               advanced AS device_type, os_name, family AS os_family, mac_address, 'online' AS status,
               nullif(array_to_string(ports, ','), '') AS open_ports
        FROM typed WHERE status <> 'offline'""",
    "flatten_scan_quick": """
        SELECT CAST(string_split(ip_address, '.')[2] AS BIGINT) AS scan_id, id AS seq, ip_address, hostname,
               basic AS device_type, CAST(NULL AS VARCHAR) AS os_name, CAST(NULL AS VARCHAR) AS os_family, mac_address,
               'online' AS status, CAST(NULL AS VARCHAR) AS open_ports
        FROM typed WHERE status <> 'offline'""",
    "scan_summary": """
        SELECT CAST(c_nationkey AS BIGINT) AS scan_id, count(*) FILTER (d.status <> 'offline') AS devices_found
        FROM devices d JOIN customer c ON c.c_custkey = d.id GROUP BY 1""",
    # Alerts
    "status_flips": "SELECT * FROM flips",
    "alert_rows": "SELECT * FROM alert_rows",
    "notification_rows": """
        SELECT a.id AS alert_id,
               CASE a.alert_type WHEN 'offline' THEN 'ALERT: ' || coalesce(d.hostname, d.ip_address) || ' is OFFLINE'
                    ELSE coalesce(d.hostname, d.ip_address) || ' is back ONLINE' END AS subject,
               CASE a.alert_type WHEN 'offline' THEN 'OFFLINE' ELSE 'ONLINE' END AS status_text,
               CASE a.alert_type WHEN 'offline' THEN 'The device does not answer and was marked offline.'
                    ELSE 'The device answers again.' END AS sentence,
               coalesce(d.hostname, d.ip_address) AS device_name, d.ip_address, d.device_type, d.os_name, d.department,
               d.owner, a.created_at AS detected_at
        FROM alerts a JOIN devices d ON d.id = a.device_id WHERE a.alert_type <> 'new_device'""",
    "new_device_alerts": f"""
        SELECT new_id AS device_id, 'new_device' AS alert_type,
               'Unknown device found on the network: ' || ip_address || '. Please check!' AS message, 'info' AS severity,
               false AS is_read, {EVENTS_NOW} AS created_at
        FROM new_results""",
    # Table changes
    "upsert_devices": f"""
        SELECT d.id, d.ip_address,
               CASE WHEN r.rn = 1 THEN r.hostname ELSE d.hostname END AS hostname,
               CASE WHEN r.rn = 1 THEN coalesce(r.device_type, 'Unknown') ELSE d.device_type END AS device_type,
               CASE WHEN r.rn = 1 THEN r.os_name ELSE d.os_name END AS os_name,
               CASE WHEN r.rn = 1 THEN r.os_family ELSE d.os_family END AS os_family,
               CASE WHEN r.rn = 1 THEN r.mac_address ELSE d.mac_address END AS mac_address,
               d.owner, d.department,
               CASE WHEN r.rn = 1 THEN coalesce(r.status, 'online') ELSE d.status END AS status,
               CASE WHEN r.rn = 1 THEN r.open_ports ELSE d.open_ports END AS open_ports,
               CASE WHEN r.rn = 1 THEN {EVENTS_NOW} ELSE d.last_seen END AS last_seen, d.first_seen, d.notes
        FROM devices d LEFT JOIN last_results r ON r.ip_address = d.ip_address
        UNION ALL
        SELECT new_id, ip_address, hostname, coalesce(device_type, 'Unknown'), os_name, os_family, mac_address, NULL, NULL,
               coalesce(status, 'online'), open_ports, {EVENTS_NOW}, {EVENTS_NOW}, NULL
        FROM new_results""",
    "upsert_devices_keep_known": f"""
        SELECT d.id, d.ip_address, coalesce(r.hostname, d.hostname) AS hostname,
               CASE WHEN r.rn = 1 THEN coalesce(r.device_type, 'Unknown') ELSE d.device_type END AS device_type,
               coalesce(r.os_name, d.os_name) AS os_name, coalesce(r.os_family, d.os_family) AS os_family,
               coalesce(r.mac_address, d.mac_address) AS mac_address, d.owner, d.department,
               CASE WHEN r.rn = 1 THEN coalesce(r.status, 'online') ELSE d.status END AS status,
               coalesce(r.open_ports, d.open_ports) AS open_ports,
               CASE WHEN r.rn = 1 THEN {EVENTS_NOW} ELSE d.last_seen END AS last_seen, d.first_seen, d.notes
        FROM devices d LEFT JOIN last_results r ON r.ip_address = d.ip_address
        UNION ALL
        SELECT new_id, ip_address, hostname, coalesce(device_type, 'Unknown'), os_name, os_family, mac_address, NULL, NULL,
               coalesce(status, 'online'), open_ports, {EVENTS_NOW}, {EVENTS_NOW}, NULL
        FROM new_results""",
    "assign_ids": "SELECT new_id AS id, ip_address FROM new_results",
    "apply_status": """
        SELECT d.* REPLACE (
            CASE WHEN l.device_id IS NULL THEN d.status WHEN l.is_online THEN 'online' ELSE 'offline' END AS status,
            greatest(o.online_at, d.last_seen) AS last_seen)
        FROM devices d
        LEFT JOIN device_latest l ON l.device_id = d.id
        LEFT JOIN (SELECT device_id, max(checked_at) AS online_at FROM uptime_log WHERE is_online GROUP BY device_id) o
               ON o.device_id = d.id""",
    "apply_edits": """
        SELECT d.* REPLACE (CASE WHEN e.id IS NULL THEN d.owner ELSE e.owner END AS owner,
                            CASE WHEN e.id IS NULL THEN d.department ELSE e.department END AS department,
                            CASE WHEN e.id IS NULL THEN d.notes ELSE e.notes END AS notes)
        FROM devices d LEFT JOIN device_edits e ON e.id = d.id""",
    "mark_read": """
        SELECT a.* REPLACE (a.is_read OR a.id IN (SELECT alert_id FROM alert_acks) AS is_read) FROM alerts a""",
    "close_scans": f"""
        SELECT id, ip_range, started_at, CASE status WHEN 'running' THEN {ORDERS_NOW} ELSE finished_at END AS finished_at,
               CASE WHEN status = 'running' AND triggered_by <> 'manual' THEN 0 ELSE devices_found END AS devices_found,
               CASE WHEN status <> 'running' THEN status WHEN triggered_by = 'manual' THEN 'completed'
                    ELSE 'failed' END AS status,
               triggered_by
        FROM scan_history""",
    "open_scans": f"""
        SELECT (SELECT max(id) FROM scan_history) + row_number() OVER (ORDER BY s_suppkey) AS id,
               '10.' || CAST(s_suppkey % 256 AS VARCHAR) || '.0.1-254' AS ip_range, {ORDERS_NOW} AS started_at,
               CAST(NULL AS TIMESTAMP) AS finished_at, 0 AS devices_found, 'running' AS status, 'manual' AS triggered_by
        FROM supplier""",
    "edit_audit_rows": f"""
        SELECT CAST(1 AS BIGINT) AS user_id, 'user_1' AS username, 'DEVICE_EDIT' AS action, 'device' AS entity_type,
               id AS entity_id,
               'Owner: ' || CASE WHEN notes IS NULL THEN 'None' ELSE owner END || ', Dept: ' || department AS details,
               CAST(NULL AS VARCHAR) AS ip_address, 'success' AS status,
               {EVENTS_NOW} AS created_at
        FROM device_edits""",
    "scan_audit_rows": f"""
        SELECT CAST(10 AS BIGINT) AS user_id, CAST(NULL AS VARCHAR) AS username, 'SCAN_START' AS action,
               CAST(NULL AS VARCHAR) AS entity_type, CAST(NULL AS BIGINT) AS entity_id,
               CASE WHEN triggered_by = 'manual' THEN 'Detailed' ELSE 'Quick' END || ' scan: ' || ip_range AS details,
               CAST(NULL AS VARCHAR) AS ip_address, 'success' AS status, {ORDERS_NOW} AS created_at
        FROM scan_history""",
    "view_audit_rows": f"""
        SELECT CAST(1 AS BIGINT) AS user_id, 'user_1' AS username, 'VIEW_DEVICE' AS action, 'device' AS entity_type,
               CAST(NULL AS BIGINT) AS entity_id, 'Viewed device ' || ip_address AS details, ip_address,
               'success' AS status, {EVENTS_NOW} AS created_at
        FROM scan_results""",
    "export_audit_rows": f"""
        SELECT CAST(1 AS BIGINT) AS user_id, 'user_1' AS username, action, CAST(NULL AS VARCHAR) AS entity_type,
               CAST(NULL AS BIGINT) AS entity_id,
               'Exported devices: ' || CAST((SELECT count(*) FROM devices) AS VARCHAR) AS details,
               CAST(NULL AS VARCHAR) AS ip_address, 'success' AS status, {EVENTS_NOW} AS created_at
        FROM (VALUES ('EXPORT_EXCEL'), ('EXPORT_CSV')) forms(action)""",
    "login_audit_rows": f"""
        SELECT u.id AS user_id, a.username,
               CASE WHEN u.is_active AND a.action = 'LOGIN' THEN 'LOGIN' ELSE 'LOGIN_FAILED' END AS action,
               CAST(NULL AS VARCHAR) AS entity_type, CAST(NULL AS BIGINT) AS entity_id,
               CASE WHEN u.id IS NULL THEN 'Unknown user' WHEN NOT u.is_active THEN 'Inactive user'
                    WHEN a.action = 'LOGIN' THEN 'Logged in as ' || u.role ELSE 'Wrong password' END AS details,
               a.ip_address, CASE WHEN u.is_active AND a.action = 'LOGIN' THEN 'success' ELSE 'failed' END AS status,
               {EVENTS_NOW} AS created_at
        FROM audit_logs a LEFT JOIN users u ON u.username = a.username
        WHERE a.action IN ('LOGIN', 'LOGIN_FAILED')""",
    "logout_audit_rows": f"""
        SELECT user_id, username, 'LOGOUT' AS action, CAST(NULL AS VARCHAR) AS entity_type,
               CAST(NULL AS BIGINT) AS entity_id, 'Logged out' AS details, CAST(NULL AS VARCHAR) AS ip_address,
               'success' AS status, {EVENTS_NOW} AS created_at
        FROM sessions s JOIN users u ON u.id = s.user_id
        WHERE s.is_active AND u.is_active AND s.expires_at >= {EVENTS_NOW} - INTERVAL 10 DAY""",
    "revoke_sessions": f"""
        SELECT s.* REPLACE (s.is_active AND s.expires_at >= {EVENTS_NOW} - INTERVAL 10 DAY AND u.is_active AS is_active)
        FROM sessions s JOIN users u ON u.id = s.user_id""",
    "apply_last_login": """
        SELECT u.* REPLACE (greatest(u.last_login, l.at) AS last_login)
        FROM users u LEFT JOIN (SELECT user_id, max(created_at) AS at FROM audit_logs WHERE action = 'LOGIN'
                                GROUP BY user_id) l ON l.user_id = u.id""",
    "delete_devices": """
        SELECT 'devices' AS table_name, id FROM devices WHERE status <> 'offline'
        UNION ALL SELECT 'alerts', a.id FROM alerts a
                  WHERE a.device_id NOT IN (SELECT id FROM devices WHERE status = 'offline')
        UNION ALL SELECT 'uptime_log', u.id FROM uptime_log u
                  WHERE u.device_id NOT IN (SELECT id FROM devices WHERE status = 'offline')""",
    # Streams
    "stream_log": "SELECT * FROM uptime_log",
    "stream_flips": "SELECT * FROM flips",
    "stream_alerts": "SELECT * FROM alert_rows",
    "stream_status": """
        SELECT d.id, CASE WHEN l.device_id IS NULL THEN d.status WHEN l.is_online THEN 'online' ELSE 'offline' END AS status,
               greatest(o.online_at, d.last_seen) AS last_seen
        FROM devices d
        LEFT JOIN device_latest l ON l.device_id = d.id
        LEFT JOIN (SELECT device_id, max(checked_at) AS online_at FROM uptime_log WHERE is_online GROUP BY device_id) o
               ON o.device_id = d.id""",
    "stream_daily_uptime": _windows(1),
    "stream_sliding_uptime": _windows(7),
    "sliding_uptime": _windows(7),
    "stream_days_in_time": f"""
        WITH timely AS (
            SELECT DISTINCT id, device_id, checked_at, is_online FROM late_feed JOIN marks USING (week)
            WHERE mark IS NULL OR checked_at > mark),
        per_day AS (
            SELECT device_id, date_trunc('day', checked_at) AS window_start, count(*) AS total_checks,
                   CAST(sum(CASE WHEN is_online THEN 1 ELSE 0 END) AS BIGINT) AS online_checks
            FROM timely GROUP BY 1, 2)
        SELECT device_id, CAST(window_start AS TIMESTAMP) AS window_start,
               CAST(window_start + INTERVAL 1 DAY AS TIMESTAMP) AS window_end, total_checks, online_checks,
               {pct('online_checks', 'total_checks')} AS uptime_pct
        FROM per_day WHERE window_start + INTERVAL 1 DAY <= (SELECT mark FROM last_mark)""",
    "stream_late_checks": """
        SELECT week, count(*) AS n_checks, count(*) FILTER (checked_at <= mark) AS n_late
        FROM late_feed JOIN marks USING (week) GROUP BY week""",
    "stream_daily_alerts": """
        SELECT date_trunc('day', created_at) AS window_start, alert_type, severity, count(*) AS n_alerts
        FROM alerts
        GROUP BY 1, 2, 3""",
}

# The monitoring loop gives what the streams do; a ranking from stored sums what the ranking from checks does.
QUERIES |= {
    "monitor_flips": QUERIES["stream_flips"],
    "monitor_alerts": QUERIES["stream_alerts"],
    "monitor_status": QUERIES["stream_status"],
    "ranking_of_days": QUERIES["uptime_ranking"],
}


def _needed(sql: str) -> list[str]:
    """The derived tables a text reads, directly or not, in the order of definition."""
    todo, found = [sql], set()
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name in words & VIEWS.keys() - found:
            found.add(name)
            todo.append(VIEWS[name])
    return [v for v in VIEWS if v in found]


def full_sql(name: str) -> str:
    """A registered query as one statement over the given tables alone."""
    sql = QUERIES[name]
    views = _needed(sql)
    if not views:
        return sql
    with_clause = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
    return f"WITH {with_clause}\nSELECT * FROM (\n{sql}\n) AS result"
