"""Tables from databases, rows to files, and seeds for tests.

An engine reads any of them: ``Engine(spark, catalog=…, frames={"orders": jdbc(spark, url, "orders")})``. Spark pushes
filters, projections and limits down to the database; a partition column lets executors read ranges of it side by side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.errors import ConnectionError_, ValidationError
from quarryline.operators import write
from quarryline.plans.engine import Engine

#: Drivers by the kind of database in a URL; their jars are the session's matter.
DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mariadb": "org.mariadb.jdbc.Driver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "sqlite": "org.sqlite.JDBC",
    "derby": "org.apache.derby.jdbc.EmbeddedDriver",
}


def jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, partition: tuple[str, object, object, int] | None = None) -> DataFrame:
    """A table of a database. ``partition``: a column, its lowest and highest value, and how many ranges of it are read apart."""
    parts = url.split(":", 2)
    if len(parts) < 3 or parts[0] != "jdbc" or parts[1] not in DRIVERS:
        raise ValidationError(f"a database URL begins with jdbc: and one of {', '.join(DRIVERS)}")
    options = {"url": url, "dbtable": table, "driver": DRIVERS[parts[1]]} | (properties or {})
    if partition:
        options |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition), strict=True))
    try:
        return spark.read.format("jdbc").options(**options).load()
    except Exception as error:
        raise ConnectionError_(f"table {table} cannot be read") from error


def to_csv(rows: DataFrame, path: str, header: bool = True) -> None:
    """Rows as CSV files, a file a partition; nothing passes through the driver."""
    rows.write.mode("errorifexists").option("header", header).csv(path)


def seed(engine: Engine, rows: dict[str, list[dict]]) -> None:
    """Adds rows to tables, all or none; for tests."""
    with write.Staged(engine):
        for table, data in rows.items():
            engine.frames[table] = write.create_many(engine.table(table), data)[0]
