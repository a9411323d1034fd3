"""Patches as a Spark data source: spark.read.format("cube_patches"), one input partition a patch.

Options: patches (a JSON list of objects with patch_id), fetch ("module:function", see base.Fetch), channels ("name type,
…"), tries. Equality and IN filters on patch_id choose the partitions, so other patches are never fetched; this needs
spark.sql.python.filterPushdown.enabled.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType


class PatchPartition(InputPartition):
    def __init__(self, row: dict):
        super().__init__(row["patch_id"])
        self.row = row


class PatchReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.fetch, self.tries = schema, options["fetch"], int(options.get("tries", 5))
        self.rows = json.loads(options["patches"])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("patch_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.rows = [r for r in self.rows if r["patch_id"] in wanted]
            else:
                yield f

    def partitions(self) -> list[PatchPartition]:
        return [PatchPartition(r) for r in self.rows] or [PatchPartition({"patch_id": None})]

    def read(self, partition: PatchPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.row["patch_id"] is None:
            return
        module, name = self.fetch.split(":")
        fetch, target = getattr(importlib.import_module(module), name), to_arrow_schema(self.schema)
        for i in range(self.tries):
            try:
                table = fetch(partition.row)
                break
            except Exception:
                if i + 1 == self.tries:
                    raise
        table = table.append_column("patch_id", pa.array([partition.row["patch_id"]] * table.num_rows, pa.string()))
        yield from table.select(target.names).cast(target).to_batches()


class PatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cube_patches"

    def schema(self) -> str:
        return f"patch_id string, it int, iy int, ix int, {self.options['channels']}"

    def reader(self, schema: StructType) -> PatchReader:
        return PatchReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PatchSource)
