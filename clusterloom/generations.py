"""Loop state as numbered generations in a folder, from which a loop can go on.

A generation is a folder of tables. Its facts are written last, and a generation counts
from when they are there: one that was being written when the driver was lost is written
anew. The folder is any that all executors share.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

FACTS = "facts"


class Generations:
    """Tables and facts of the rounds of one loop."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, number: int, name: str = "") -> str:
        return f"{self.folder}/{number:06d}/{name}"

    def numbers(self) -> list[int]:
        """The generations that are complete, ascending."""
        top = self._path(self.folder)
        if not self._files.exists(top):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(top)]
        return sorted(
            int(n) for n in names if n.isdigit() and self._files.exists(self._path(f"{self.folder}/{n}/{FACTS}/_SUCCESS"))
        )

    def write(self, number: int, name: str, df: DataFrame) -> DataFrame:
        """Writes a table of a generation and reads it back."""
        df.write.mode("overwrite").parquet(self._at(number, name))
        return self.spark.read.schema(df.schema).parquet(self._at(number, name))

    def read(self, number: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(number, name))

    def commit(self, number: int, facts: dict) -> None:
        """Makes a generation count, and removes those before its predecessor."""
        row = self.spark.createDataFrame([(json.dumps(facts),)], "facts string")
        row.coalesce(1).write.mode("overwrite").parquet(self._at(number, FACTS))
        for old in self.numbers():
            if old < number - 1:
                self._files.delete(self._path(self._at(old)), True)

    def facts(self, number: int) -> dict:
        return json.loads(self.read(number, FACTS).first()["facts"])
