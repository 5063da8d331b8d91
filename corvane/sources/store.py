"""The directory's tables as Parquet folders that change as a whole.

A table is a folder of versions. One pointer file says which version of each table holds; a change of several tables is
written beside, then the pointer is replaced by an overwriting rename, which is one step. Readers see the old or the new
state of all tables. Tables with versions but without a pointer are damaged, and reading them fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane import schemas

TABLES: Mapping[str, T.StructType] = {"companies": schemas.COMPANIES, "import_runs": schemas.IMPORT_RUNS, "import_issues": schemas.IMPORT_ISSUES, "review_rows": schemas.REVIEW_ROWS}


class Store:
    """Tables under a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, *steps: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *steps)))

    def _versions(self) -> dict[str, str]:
        """The version of each table that holds."""
        file = self._path("CURRENT")
        fs = file.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(file):
            return json.loads(self.spark.read.text(f"{self.path}/CURRENT").first().value)
        if any(fs.exists(self._path(name)) for name in TABLES) and not fs.exists(self._path("NEW")):
            raise FileNotFoundError(f"{self.path} has tables but no pointer to their versions")
        return {}

    def read(self, name: str) -> DataFrame:
        """The table as it is now; an empty one if it was never written."""
        version = self._versions().get(name)
        return self.spark.createDataFrame([], TABLES[name]) if version is None else self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/{version}")

    def stage(self, name: str, rows: DataFrame) -> tuple[str, str]:
        """Writes a new version that doesn't hold yet."""
        version = f"v-{uuid.uuid4().hex}"
        if not self._versions():  # a first import that stops before its commit leaves a store without a state
            mark = self._path("NEW")
            mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(mark, True).close()
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]]).write.parquet(f"{self.path}/{name}/{version}")
        return name, version

    def commit(self, *staged: tuple[str, str]) -> None:
        """Makes staged versions hold, all of them in one step."""
        jvm, file, beside = self.spark._jvm, self._path("CURRENT"), self._path(f"CURRENT.{uuid.uuid4().hex}")
        versions = self._versions() | dict(staged)
        fs = file.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps(versions).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(file.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(beside), context.makeQualified(file), options)
        fs.delete(self._path("NEW"), False)

    def write(self, **tables: DataFrame) -> None:
        """All tables staged, then all committed."""
        self.commit(*[self.stage(name, rows) for name, rows in tables.items()])

    def next_id(self, name: str) -> int:
        return (self.read(name).agg(F.max("id")).first()[0] or 0) + 1


def numbered(rows: DataFrame, order, first: int) -> DataFrame:
    """``rows`` with ids from ``first`` on that grow with the order; with gaps, as ids that are drawn in advance have."""
    return rows.orderBy(order).withColumn("id", F.lit(first) + F.monotonically_increasing_id())


def without_runs(store: Store, source_type: str) -> dict[str, DataFrame]:
    """The ledger and its children without the runs of a source: a replacement's state before it starts."""
    runs = store.read("import_runs").where(~F.col("source_type").eqNullSafe(source_type))
    kept = runs.select(F.col("id").alias("import_run_id"))
    return {"import_runs": runs} | {t: store.read(t).join(kept, "import_run_id", "left_semi") for t in ("import_issues", "review_rows")}
