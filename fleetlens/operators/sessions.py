"""Sessions and logins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.clock import AsOf, moment, type_of


def live_sessions(sessions: DataFrame, users: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Sessions valid at a moment: not revoked, not expired (the last instant counts), user active."""
    now = moment(as_of, type_of(sessions, "expires_at"))
    valid = sessions.filter(F.col("is_active") & (F.col("expires_at") >= now))
    people = users.filter("is_active").select(F.col("id").alias("user_id"), "username", "email", "role")
    return valid.select("session_token", "user_id", "expires_at").join(people, "user_id")


def revoke_sessions(
    sessions: DataFrame, tokens: DataFrame | None = None, users: DataFrame | None = None
) -> DataFrame:
    """Sessions after logging out the given tokens and every session of the given user ids."""
    out = sessions
    for keys, column in ((tokens, "session_token"), (users, "user_id")):
        if keys is not None:
            revoked = keys.select(column).distinct().withColumn("_revoked", F.lit(True))
            out = out.join(revoked, column, "left").withColumn(
                "is_active", F.col("is_active") & F.col("_revoked").isNull()
            )
            out = out.drop("_revoked")
    return out.select(sessions.columns)


def apply_last_login(users: DataFrame, audit: DataFrame) -> DataFrame:
    """Users with ``last_login`` moved to their newest successful login, never backwards."""
    logins = (
        audit.filter((F.col("action") == "LOGIN") & (F.col("status") == "success"))
        .groupBy(F.col("user_id").alias("id"))
        .agg(F.max("created_at").alias("_login"))
    )
    moved = F.greatest("last_login", F.col("_login").cast(type_of(users, "last_login")))
    return users.join(logins, "id", "left").withColumn("last_login", moved).select(users.columns)
