"""Classification rules as column expressions, first match wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.text import is_blank

# Words looked for in the lower-cased OS name.
OS_FAMILY_WORDS = [
    ("Windows", ["windows"]),
    ("Linux", ["linux", "ubuntu", "debian", "centos", "fedora", "red hat"]),
    ("Cisco", ["cisco", "ios"]),
]
# Words looked for in the lower-cased hostname.
DEVICE_TYPE_WORDS = [
    ("Router", ["router", "gateway", "gw", "cisco", "switch"]),
    ("Server", ["srv", "server", "svr", "dc", "nas"]),
    ("Printer", ["printer", "print", "hp", "canon", "epson"]),
    ("Laptop", ["laptop", "notebook", "pc", "desktop", "win", "mac"]),
]
# Address endings of gateways, ports of each device type, uptime bands.
GATEWAY_ENDINGS = [".1", ".254"]
ROUTER_PORTS = [80, 443, 22]
PRINTER_PORTS = [9100, 515, 631]
SERVER_PORTS = [80, 443, 3306, 5432, 1433, 8080]
REMOTE_DESKTOP_PORT = 3389
GOOD_UPTIME, FAIR_UPTIME = 90, 70


def _by_words(text: Column, table: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """One regular expression per class instead of a chain of substring tests."""
    lowered = F.lower(text)
    branches = [(name, lowered.rlike("|".join(words))) for name, words in table]
    first, *rest = branches
    chain = reduce(lambda acc, b: acc.when(b[1], F.lit(b[0])), rest, F.when(first[1], F.lit(first[0])))
    return chain.otherwise(F.lit(otherwise))


def os_family(os_name: Column) -> Column:
    """Windows, Linux, Cisco or Other; NULL for a NULL or empty name."""
    return F.when(~is_blank(os_name), _by_words(os_name, OS_FAMILY_WORDS, "Other"))


def device_type_basic(hostname: Column, ip_address: Column) -> Column:
    """Type by hostname; without one, by the ending of the address."""
    ending = reduce(lambda a, b: a | b, [F.endswith(ip_address, F.lit(e)) for e in GATEWAY_ENDINGS])
    by_address = F.when(ending, F.lit("Router")).otherwise(F.lit("Unknown"))
    return F.when(is_blank(hostname), by_address).otherwise(
        _by_words(hostname, DEVICE_TYPE_WORDS, "Unknown")
    )


def numeric_ports(open_ports: Column) -> Column:
    """``'631,http'`` -> ``[631]``; NULL text gives an empty array, numbers that are no int are dropped."""
    tokens = F.split(F.coalesce(open_ports, F.lit("")), ",")
    digits = F.filter(tokens, lambda t: t.rlike("^[0-9]+$"))
    return F.filter(F.transform(digits, lambda t: t.try_cast("int")), lambda n: n.isNotNull())


def device_type_advanced(
    hostname: Column, ip_address: Column, ports: Column, os_name: Column
) -> Column:
    """Type by open ports (array of int) and OS, falling back to the hostname rule."""

    def any_of(numbers: list[int]) -> Column:
        return F.arrays_overlap(ports, F.array(*[F.lit(n) for n in numbers]))

    all_router = reduce(lambda a, b: a & b, [F.array_contains(ports, n) for n in ROUTER_PORTS])
    router_os = is_blank(os_name) | F.contains(F.lower(os_name), F.lit("cisco"))
    return (
        F.when(all_router & router_os, F.lit("Router"))
        .when(any_of(PRINTER_PORTS), F.lit("Printer"))
        .when(any_of(SERVER_PORTS), F.lit("Server"))
        .when(F.array_contains(ports, REMOTE_DESKTOP_PORT), F.lit("Laptop"))
        .otherwise(device_type_basic(hostname, ip_address))
    )


def uptime_band(percentage: Column) -> Column:
    return (
        F.when(percentage >= GOOD_UPTIME, F.lit("good"))
        .when(percentage >= FAIR_UPTIME, F.lit("fair"))
        .otherwise(F.lit("poor"))
    )


def chart_value(is_online: Column, response_ms: Column) -> Column:
    """Bar height of one check: the response, at least 1 when online, 0 when offline."""
    response = F.coalesce(F.nullif(response_ms, F.lit(0)), F.lit(1))
    return F.when(is_online, response).otherwise(F.lit(0))


def register_sql_functions(spark: SparkSession) -> None:
    """Offer the two text rules to SQL users as session functions (SQL bodies, no Python)."""

    def chain(text: str, table: list[tuple[str, list[str]]], otherwise: str) -> str:
        whens = " ".join(f"WHEN lower({text}) RLIKE '{'|'.join(words)}' THEN '{name}'" for name, words in table)
        return f"CASE {whens} ELSE '{otherwise}' END"

    endings = " OR ".join(f"endswith(ip, '{e}')" for e in GATEWAY_ENDINGS)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION os_family(os_name STRING) RETURNS STRING RETURN "
        f"CASE WHEN coalesce(os_name, '') = '' THEN NULL ELSE {chain('os_name', OS_FAMILY_WORDS, 'Other')} END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION device_type_basic(host STRING, ip STRING) RETURNS STRING RETURN "
        f"CASE WHEN coalesce(host, '') = '' THEN CASE WHEN {endings} THEN 'Router' ELSE 'Unknown' END "
        f"ELSE {chain('host', DEVICE_TYPE_WORDS, 'Unknown')} END"
    )
