"""Intermediate results as Parquet tables in the folder all executors share.

A written table cuts the lineage: what a lost executor held is read again, not worked out
again. The exchanges behind a table are dropped as soon as it is written, so the disk
holds those of one step at a time.
"""

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from growthgrain.session import shared_folder

DROP_EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Tables of one run of an operator, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = f"{name}-{uuid4().hex}"
        self.folder = f"{shared_folder(spark)}/{self.name}"

    def write(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """The rows of ``df``, written and to be read again; ``by`` names a column whose values
        are folders. A table of no rows has its columns all the same."""
        self._drop_exchanges(lambda: df.write.parquet(f"{self.folder}/{name}", partitionBy=by))
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def write_bucketed(self, name: str, df: DataFrame, by: str, n: int) -> DataFrame:
        """The same in ``n`` buckets by a column, so that groups of it need no exchange."""
        writer = df.write.format("parquet").option("path", f"{self.folder}/{name}")
        table = self._table(name)
        self._drop_exchanges(lambda: writer.bucketBy(n, by).sortBy(by).saveAsTable(table))
        return self.spark.read.table(table)

    def _table(self, name: str) -> str:
        return f"`{self.name}-{name}`".replace("-", "_")

    def _drop_exchanges(self, write: Callable[[], None]) -> None:
        before = self.spark.conf.get(DROP_EXCHANGES, None)
        self.spark.conf.set(DROP_EXCHANGES, "true")
        try:
            write()
        finally:
            if before is None:
                self.spark.conf.unset(DROP_EXCHANGES)
            else:
                self.spark.conf.set(DROP_EXCHANGES, before)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
