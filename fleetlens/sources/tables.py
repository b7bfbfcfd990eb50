"""Loading, appending and default filling of the fixed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.clock import AsOf, moment
from fleetlens.sources.schemas import AS_OF, DEFAULTS, HOST_SCAN, TABLES

DAY = "day"
BATCH = "batch"
BROKEN = "_broken"
# The column that tells when a row of a table came about.
TIME_COLUMNS = {
    "scan_history": "started_at",
    "alerts": "created_at",
    "uptime_log": "checked_at",
    "audit_logs": "created_at",
}


def load_table(
    spark: SparkSession, path: str, name: str, fmt: str = "parquet", since: AsOf = None, **options
) -> DataFrame:
    """One of the seven tables with its fixed schema, from parquet, CSV, JSON or JDBC.

    ``since`` keeps rows from that moment on; a table stored by day then skips the folders of earlier
    days. For ``fmt="jdbc"`` the path is the connection URL; pass ``partitionColumn``, ``lowerBound``,
    ``upperBound`` and ``numPartitions`` to read in parallel.
    """
    rows = _read(spark, path, name, fmt, options)
    if since is not None:
        first = moment(since)
        rows = rows.filter(F.col(TIME_COLUMNS[name]) >= first)
        if DAY in rows.columns:
            rows = rows.filter(F.col(DAY) >= F.to_date(first))
    return rows.select(TABLES[name].names)


def _read(spark: SparkSession, path: str, name: str, fmt: str, options: dict) -> DataFrame:
    schema = TABLES[name]
    if fmt == "jdbc":
        rows = spark.read.format("jdbc").options(url=path, **{"dbtable": name, **options}).load()
        return rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    if fmt == "csv":
        options = {"header": True, **options}
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def load_host_scan(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Nested scan output: one row per host with its protocol -> port -> state maps.

    JSON comes as one object per line. Its objects have text keys, so port numbers are read as text and cast. Lines
    that are no host are left to ``host_scan_rejects``.
    """
    if fmt != "json":
        return spark.read.schema(HOST_SCAN).format(fmt).load(path)
    return _host_lines(spark, path).filter("reason IS NULL").select("host.*").drop(BROKEN).withColumn(
        "protocols", F.transform_values("protocols", lambda _, ports: _numbered(ports))
    )


def host_scan_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a JSON scan that give no host: (file, line, reason). The text is whole, to be mended and loaded."""
    return _host_lines(spark, path).filter("reason IS NOT NULL").select("file", "line", "reason")


def _host_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line that is not blank with what it says, and why it is no host."""
    as_text = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([T.StructField("state", T.StringType())])))
    fields = [T.StructField(f.name, as_text if f.name == "protocols" else f.dataType) for f in HOST_SCAN.fields]
    schema = T.StructType([*fields, T.StructField(BROKEN, T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    host = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    read = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), host.alias("host"))
    reason = F.when(F.col("host").isNull() | F.col(f"host.{BROKEN}").isNotNull(), "not readable").when(
        F.col("host.ip_address").isNull(), "no address"
    )
    return read.withColumn("reason", reason)


def _numbered(ports: Column) -> Column:
    known = F.map_filter(ports, lambda port, _: port.rlike("^[0-9]+$") & port.try_cast("int").isNotNull())
    return F.transform_keys(known, lambda port, _: port.cast("int"))


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table in their order and type; absent columns become NULL."""
    present = set(df.columns)
    return df.select(
        [
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].fields
        ]
    )


def append_table(
    df: DataFrame, path: str, name: str, as_of: AsOf = None, by_day: bool = False, batch: str | None = None
) -> None:
    """Append rows to a parquet table, filled with the table's defaults.

    ``by_day`` stores each day of the table's time column in a folder of its own, sorted by device
    where there is one. Rows are rebalanced by day first: Spark then writes files of an even size,
    several for a large day and few for small ones, instead of one file per task and day.

    ``batch`` names what is appended. Its rows are stored in folders of that name and replace those of the same batch
    (and day), so a batch that is appended again after a failure changes nothing. Name all batches of a table, or none.
    """
    rows = fill_defaults(conform(df, name), name, as_of)
    folders: list[str] = []
    if batch is not None:
        rows, folders = rows.withColumn(BATCH, F.lit(batch)), [BATCH]
    if by_day:
        folders = [*folders, DAY]
        order = [DAY, *[c for c in ("device_id",) if c in rows.columns]]
        rows = rows.withColumn(DAY, F.to_date(TIME_COLUMNS[name])).hint("rebalance", DAY).sortWithinPartitions(*order)
    writer = rows.write.partitionBy(*folders) if folders else rows.write
    if batch is not None:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode("append")
    writer.parquet(path)


def fill_defaults(df: DataFrame, name: str, as_of: AsOf = None) -> DataFrame:
    """Insert defaults in place of NULL. Columns the frame does not have stay absent."""
    filled = {}
    for column, value in DEFAULTS.get(name, {}).items():
        if column in df.columns:
            default = moment(as_of, df.schema[column].dataType) if value is AS_OF else F.lit(value)
            filled[column] = F.coalesce(F.col(column), default)
    return df.withColumns(filled) if filled else df


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table as (table_name, n_rows)."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def probe_schema() -> T.StructType:
    """Probe rows are availability rows that have not been stored yet."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in TABLES["uptime_log"].fields])
