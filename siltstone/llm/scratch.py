"""Tables that an operator writes once and reads several times.

They live in the folder that the cluster names in ``spark.checkpoint.dir``, which every
executor can read, so a lost executor costs a re-read and never the rows.  Where that setting is
missing, a local master (tests, a laptop) uses a temporary folder and a cluster is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.shared import new_folder


class Scratch:
    """A folder of written tables; ``drop`` removes one that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = new_folder(spark, name)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
