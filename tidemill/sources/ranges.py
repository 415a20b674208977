"""A custom source: Parquet files read in stretches of rows, each an input partition, with equalities handed to the reader."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType


class Stretch(InputPartition):
    def __init__(self, path: str, group: int, low: int, rows: int) -> None:
        self.path, self.group, self.low, self.rows = path, group, low, rows


def _opened(path: str) -> pq.ParquetFile:
    system, place = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return pq.ParquetFile(system.open_input_file(place))


def _files(path: str) -> list[str]:
    """The file itself, or the Parquet files of a folder."""
    system, place = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    if system.get_file_info(place).type != pafs.FileType.Directory:
        return [path]
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in system.get_file_info(pafs.FileSelector(place)) if x.base_name.endswith(".parquet"))


class StretchReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names, self.path, self.rows = schema.names, options["path"], max(1, int(options.get("rows", 1 << 20)))
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equalities of a column with a value are done here; Spark does what is given back."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.wanted.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _files(self.path):
            sizes = _opened(path).metadata
            for g in range(sizes.num_row_groups):
                out += [Stretch(path, g, low, self.rows) for low in range(0, sizes.row_group(g).num_rows, self.rows)]
        return out

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        """The rows of a stretch; Spark asks for None where there is no stretch at all."""
        if partition is None:
            return
        at = 0
        for batch in _opened(partition.path).iter_batches(min(self.rows, 1 << 16), row_groups=[partition.group], columns=self.names, use_threads=False):
            own = batch.slice(max(0, partition.low - at), max(0, min(len(batch), partition.low + partition.rows - at) - max(0, partition.low - at)))
            at += len(batch)
            for name, value in self.wanted:
                own = own.filter(pc.equal(own.column(name), value))
            if len(own):
                yield own.select(self.names)
            if at >= partition.low + partition.rows:
                break


class Stretches(DataSource):
    """spark.read.format("stretches").schema(...).option("path", p).option("rows", n).load() after register(spark)."""

    @classmethod
    def name(cls) -> str:
        return "stretches"

    def reader(self, schema: StructType) -> DataSourceReader:
        return StretchReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Stretches)
