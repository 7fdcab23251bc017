"""Tables in shared storage that grow by numbered parts, each written whole and seen only once its write is committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructType


class Parts:
    """A table under ``path`` with rows of ``schema`` and the number of the part they came in (column ``part``).

    What a broken run left behind carries no mark of success and is never read; the next part takes a number of its own. One run
    writes at a time; any number may read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if "part" in schema.names:
            raise ValueError("part is the table's own column")
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folders(self, inside: str = "") -> list[int]:
        pattern = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/part=*{inside}")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        names = [str(f.getPath()) for f in found or []]
        return sorted(int(n.split("part=")[-1].split("/")[0]) for n in names)

    def numbers(self) -> list[int]:
        """The parts whose writes are committed."""
        return self._folders("/_SUCCESS")

    def add(self, rows: DataFrame) -> int:
        """Write ``rows`` as the next part and return its number."""
        number = max(self._folders(), default=-1) + 1
        rows.select(*self.schema.names).write.parquet(f"{self.path}/part={number}")
        return number

    def read(self) -> DataFrame:
        """All committed rows; none, if there is no part yet."""
        schema = StructType([*self.schema.fields]).add("part", IntegerType())
        paths = [f"{self.path}/part={n}" for n in self.numbers()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths)
