"""The shared Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """``tables.lineitem`` is the lazily read Parquet table of that name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def spread(self, name: str, *columns: str) -> DataFrame:
        """The table in at least as many partitions as there are cores, for work that is heavy per row.

        A table of many files has them anyway and is not shuffled; only a table that one or few
        tasks would read is dealt out first.
        """
        df = getattr(self, name)
        df = df.select(*columns) if columns else df
        cores = self.spark.sparkContext.defaultParallelism
        # a plain scan: asking for its partitions plans it and runs nothing
        return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))
