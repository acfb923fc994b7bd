"""An index table on Parquet: every version in a folder of its own with its schema beside it, published by
the writer's success marker, so that readers see a whole version or the one before."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import sync


class IndexTable:
    """key: the id column. group: a column to partition by, so that a scope prunes folders."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", group: str | None = None) -> None:
        self.spark, self.path, self.key, self.group = spark, path.rstrip("/"), key, group

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self) -> list[str]:
        """Version folders that were written to the end, oldest first."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(n for n in names if n.startswith("v") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self, columns: Sequence[str] | None = None) -> DataFrame:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(self.path)
        fs, path = self._fs()
        stream = fs.open(path(f"{self.path}/schema-{versions[-1]}"))
        schema = StructType.fromJson(json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        stream.close()
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{versions[-1]}")
        return df.select(*columns) if columns else df

    def replace(self, df: DataFrame, keep: int = 2) -> None:
        """Writes a new version; the success marker of the writer publishes it. Older ones than keep go."""
        name = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        fs, path = self._fs()
        out = fs.create(path(f"{self.path}/schema-{name}"))
        out.write(bytearray(df.schema.json().encode()))
        out.close()
        writer = df.write.partitionBy(self.group) if self.group else df.write
        writer.parquet(f"{self.path}/{name}")
        for old in self._versions()[:-keep]:
            fs.delete(path(f"{self.path}/{old}"), True)
            fs.delete(path(f"{self.path}/schema-{old}"), False)

    def append(self, df: DataFrame) -> None:
        self.replace(self.read().unionByName(df, allowMissingColumns=True) if self.exists() else df)

    def upsert(self, df: DataFrame) -> None:
        self.replace(sync.upsert(self.read(), df, self.key) if self.exists() else df)

    def update(self, patch: DataFrame, columns: Sequence[str]) -> None:
        """Metadata only: vectors and texts aren't touched."""
        self.replace(sync.update_columns(self.read(), patch, self.key, columns))

    def delete(self, keys: DataFrame) -> None:
        self.replace(sync.delete_rows(self.read(), keys, self.key))

    def truncate(self) -> None:
        self.replace(self.read().limit(0))

    def ids(self, where: Column | None = None) -> DataFrame:
        rows = self.read()
        return (rows if where is None else rows.where(where)).select(self.key)

    def lookup(self, item) -> DataFrame:
        """The row of an item, or its first chunk's."""
        return self.read().where(F.col(self.key).isin(str(item), f"{item}#0"))

    def count(self) -> int:
        return self.read().count() if self.exists() else 0
