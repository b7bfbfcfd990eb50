"""Fixed table schemas with the constraints and defaults that belong to them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


TEXT, LONG, INT, FLAG, TIME = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def _struct(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


DEVICES = _struct(
    ("id", LONG, False),
    ("ip_address", TEXT, False),
    ("hostname", TEXT, True),
    ("device_type", TEXT, True),
    ("os_name", TEXT, True),
    ("os_family", TEXT, True),
    ("mac_address", TEXT, True),
    ("owner", TEXT, True),
    ("department", TEXT, True),
    ("status", TEXT, False),
    ("open_ports", TEXT, True),
    ("last_seen", TIME, True),
    ("first_seen", TIME, False),
    ("notes", TEXT, True),
)
SCAN_HISTORY = _struct(
    ("id", LONG, False),
    ("ip_range", TEXT, False),
    ("started_at", TIME, False),
    ("finished_at", TIME, True),
    ("devices_found", INT, False),
    ("status", TEXT, False),
    ("triggered_by", TEXT, True),
)
ALERTS = _struct(
    ("id", LONG, False),
    ("device_id", LONG, False),
    ("alert_type", TEXT, False),
    ("message", TEXT, False),
    ("severity", TEXT, False),
    ("is_read", FLAG, False),
    ("created_at", TIME, False),
)
UPTIME_LOG = _struct(
    ("id", LONG, False),
    ("device_id", LONG, False),
    ("checked_at", TIME, False),
    ("is_online", FLAG, False),
    ("response_ms", INT, True),
)
USERS = _struct(
    ("id", LONG, False),
    ("username", TEXT, False),
    ("email", TEXT, True),
    ("role", TEXT, False),
    ("is_active", FLAG, False),
    ("last_login", TIME, True),
    ("created_at", TIME, False),
)
SESSIONS = _struct(
    ("user_id", LONG, False),
    ("session_token", TEXT, False),
    ("expires_at", TIME, False),
    ("ip_address", TEXT, True),
    ("is_active", FLAG, False),
)
AUDIT_LOGS = _struct(
    ("id", LONG, False),
    ("user_id", LONG, True),
    ("username", TEXT, True),
    ("action", TEXT, False),
    ("entity_type", TEXT, True),
    ("entity_id", LONG, True),
    ("details", TEXT, True),
    ("ip_address", TEXT, True),
    ("status", TEXT, False),
    ("created_at", TIME, False),
)
TABLES = {
    "devices": DEVICES,
    "scan_history": SCAN_HISTORY,
    "alerts": ALERTS,
    "uptime_log": UPTIME_LOG,
    "users": USERS,
    "sessions": SESSIONS,
    "audit_logs": AUDIT_LOGS,
}

# Inputs that reach the tables: nested scan output, flattened scan rows.
HOST_SCAN = _struct(
    ("scan_id", LONG, True),
    ("seq", LONG, True),
    ("ip_address", TEXT, False),
    ("state", TEXT, True),
    ("hostname", TEXT, True),
    ("addresses", T.MapType(TEXT, TEXT), True),
    ("osmatch", T.ArrayType(_struct(("name", TEXT, True), ("accuracy", INT, True))), True),
    ("protocols", T.MapType(TEXT, T.MapType(INT, _struct(("state", TEXT, True)))), True),
)
SCAN_RESULTS = _struct(
    ("scan_id", LONG, True),
    ("seq", LONG, True),
    ("ip_address", TEXT, False),
    ("hostname", TEXT, True),
    ("device_type", TEXT, True),
    ("os_name", TEXT, True),
    ("os_family", TEXT, True),
    ("mac_address", TEXT, True),
    ("status", TEXT, True),
    ("open_ports", TEXT, True),
)


@dataclass(frozen=True)
class Constraints:
    """What a database server would enforce on a table."""

    unique: tuple[str, ...] = ()
    foreign: tuple[tuple[str, str, str], ...] = ()  # column, parent table, parent column
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    max_length: dict[str, int] = field(default_factory=dict)


# Allowed codes and text lengths of the data model.
STATUSES = ("online", "offline", "unknown")
CONSTRAINTS = {
    "devices": Constraints(
        unique=("id", "ip_address"),
        allowed={
            "status": STATUSES,
            "device_type": ("Server", "Laptop", "Router", "Printer", "Unknown"),
            "os_family": ("Windows", "Linux", "Cisco", "Other"),
        },
        max_length={
            "ip_address": 15,
            "hostname": 255,
            "device_type": 50,
            "os_name": 100,
            "os_family": 20,
            "mac_address": 17,
            "owner": 100,
            "department": 100,
            "status": 20,
            "open_ports": 500,
            "notes": 500,
        },
    ),
    "scan_history": Constraints(
        unique=("id",),
        allowed={"status": ("running", "completed", "failed")},
        max_length={"ip_range": 50, "status": 20, "triggered_by": 100},
    ),
    "alerts": Constraints(
        unique=("id",),
        foreign=(("device_id", "devices", "id"),),
        allowed={
            "alert_type": ("offline", "back_online", "new_device"),
            "severity": ("info", "warning", "critical"),
        },
        max_length={"alert_type": 50, "message": 500, "severity": 20},
    ),
    "uptime_log": Constraints(unique=("id",), foreign=(("device_id", "devices", "id"),)),
    "users": Constraints(unique=("id", "username")),
    "sessions": Constraints(unique=("session_token",), foreign=(("user_id", "users", "id"),)),
    "audit_logs": Constraints(unique=("id",)),
}

# Defaults on insert. AS_OF stands for the moment of the insert.
AS_OF = object()
DEFAULTS = {
    "devices": {"status": "unknown", "first_seen": AS_OF},
    "scan_history": {"started_at": AS_OF, "devices_found": 0, "status": "running", "triggered_by": "manual"},
    "alerts": {"severity": "warning", "is_read": False, "created_at": AS_OF},
    "uptime_log": {"checked_at": AS_OF},
    "audit_logs": {"status": "success", "created_at": AS_OF},
}
