"""Audit rows for what users do, made as batches.

Inputs may have ``client_ip``, the address of the client; without it the address is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.clock import AsOf, moment


def _audit_rows(
    df: DataFrame,
    action: Column,
    details: Column,
    as_of: AsOf,
    entity_type: str | None = None,
    entity_id: Column | None = None,
    status: Column | None = None,
) -> DataFrame:
    client = F.col("client_ip") if "client_ip" in df.columns else F.lit(None)
    return df.select(
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("username"),
        action.alias("action"),
        F.lit(entity_type).cast("string").alias("entity_type"),
        (F.lit(None) if entity_id is None else entity_id).cast("bigint").alias("entity_id"),
        details.alias("details"),
        client.cast("string").alias("ip_address"),
        (F.lit("success") if status is None else status).alias("status"),
        moment(as_of).alias("created_at"),
    )


def edit_audit_rows(edits: DataFrame, as_of: AsOf = None) -> DataFrame:
    """One row per device edit (id, owner, department, user_id, username). A missing value reads None."""
    shown = [F.coalesce(c, F.lit("None")) for c in ("owner", "department")]
    details = F.format_string("Owner: %s, Dept: %s", *shown)
    return _audit_rows(edits, F.lit("DEVICE_EDIT"), details, as_of, "device", F.col("id"))


def scan_audit_rows(requests: DataFrame, as_of: AsOf = None) -> DataFrame:
    """One row per requested scan (ip_range, detailed, user_id, username)."""
    kind = F.when(F.coalesce("detailed", F.lit(False)), "Detailed").otherwise("Quick")
    details = F.format_string("%s scan: %s", kind, F.trim("ip_range"))
    return _audit_rows(requests, F.lit("SCAN_START"), details, as_of)


def view_audit_rows(views: DataFrame, as_of: AsOf = None) -> DataFrame:
    """One row per viewed device page (address as it stands in links, user_id, username)."""
    details = F.concat(F.lit("Viewed device "), F.translate("address", "-", "."))
    return _audit_rows(views, F.lit("VIEW_DEVICE"), details, as_of, "device")


def export_audit_rows(exports: DataFrame, as_of: AsOf = None) -> DataFrame:
    """One row per export (form: excel or csv, n_rows, user_id, username)."""
    details = F.concat(F.lit("Exported devices: "), F.col("n_rows").cast("string"))
    return _audit_rows(exports, F.concat(F.lit("EXPORT_"), F.upper("form")), details, as_of)


def login_audit_rows(attempts: DataFrame, users: DataFrame, as_of: AsOf = None) -> DataFrame:
    """One row per login attempt (username, password_ok).

    An attempt fails, in this order, for an unknown user, an inactive one, or a wrong password; a NULL counts as
    wrong. Only an unknown user has no id.
    """
    known = users.select("username", F.col("id").alias("user_id"), F.col("is_active").alias("_active"), F.col("role").alias("_role"))
    found = attempts.join(known, "username", "left")
    failure = (
        F.when(F.col("user_id").isNull(), "Unknown user")
        .when(~F.col("_active"), "Inactive user")
        .when(~F.coalesce("password_ok", F.lit(False)), "Wrong password")
    )
    return _audit_rows(
        found,
        F.when(failure.isNull(), "LOGIN").otherwise("LOGIN_FAILED"),
        F.coalesce(failure, F.concat(F.lit("Logged in as "), F.col("_role"))),
        as_of,
        status=F.when(failure.isNull(), "success").otherwise("failed"),
    )


def logout_audit_rows(ended: DataFrame, as_of: AsOf = None) -> DataFrame:
    """One row per session that its user ended (user_id, username)."""
    return _audit_rows(ended, F.lit("LOGOUT"), F.lit("Logged out"), as_of)
