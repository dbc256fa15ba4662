"""Tables of many tenants: a folder per tenant, replaced one tenant at a time.

Every row carries its tenant in a partition column. Reading one tenant lists and reads that folder only; replacing a
tenant's rows overwrites that folder and leaves the others, by Spark's dynamic partition overwrite. Rows are rebalanced
by tenant before a write, so small tenants have few files and a tenant with a third of all rows is split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT = "default"


def tenant_of(user: Column, prefix: str = "user-") -> Column:
    """Tenant of a user id; rows without a user belong to the default tenant."""
    id = F.trim(user.cast("string"))
    return F.when(F.coalesce(id, F.lit("")) == "", DEFAULT).otherwise(F.concat(F.lit(prefix), id))


class TenantTable:
    def __init__(self, spark: SparkSession, path: str, column: str = "tenant"):
        self.spark, self.path, self.column = spark, path, column

    def _writer(self, rows: DataFrame):
        return rows.hint("rebalance", self.column).write.partitionBy(self.column)

    def append(self, rows: DataFrame) -> None:
        """Add rows of any tenants."""
        self._writer(rows).mode("append").parquet(self.path)

    def replace(self, rows: DataFrame) -> None:
        """Replace all rows of the tenants that occur in ``rows``; other tenants are untouched.

        ``rows`` must not be read from those tenants of this table: write them elsewhere first.
        """
        self._writer(rows).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def rows(self, tenant: str) -> DataFrame:
        """Rows of one tenant; no other tenant's files are opened."""
        everything = self.spark.read.parquet(self.path)
        return everything.filter(F.col(self.column) == tenant)

    def tenants(self) -> DataFrame:
        """(tenant, n) with row counts, from file footers."""
        return self.spark.read.parquet(self.path).groupBy(self.column).agg(F.count("*").alias("n"))
