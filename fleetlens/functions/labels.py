"""Display labels of coded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels shown for coded columns.
ALERT_TYPE_LABELS = {
    "offline": "Offline",
    "back_online": "Back Online",
    "new_device": "New Device",
}
ACTION_LABELS = {
    "LOGIN": "Login",
    "LOGIN_FAILED": "Login Failed",
    "LOGOUT": "Logout",
    "SCAN_START": "Scan",
    "DEVICE_EDIT": "Device Edit",
    "EXPORT_EXCEL": "Export Excel",
    "EXPORT_CSV": "Export CSV",
    "VIEW_DEVICE": "View",
}
SCAN_STATUS_LABELS = {
    "completed": "Completed",
    "running": "Running",
    "failed": "Failed",
}
UNASSIGNED = "Unassigned"
ANONYMOUS = "anonymous"
UNKNOWN = "Unknown"


def labelled(column: Column, labels: dict[str, str]) -> Column:
    """The label of a code, or the code itself when it has none."""
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, column), column)
