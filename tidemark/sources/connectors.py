"""Sources and sinks: batches by contract and transport, bronze, quarantine, partition overwrite, ledgers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators.ingestion import row_hash

#: Column that holds lines which don't fit the declared schema.
CORRUPT = "_corrupt_record"
_FORMATS = {"sftp_drop": None, "s3_prefix": None, "file_watch": None, "api_pull": "pages_api", "db_replica": "jdbc"}


@dataclass(frozen=True)
class SourceContract:
    """What a feed is: transport, format, declared columns, options and the rules that its rows must pass."""

    source_id: str
    transport: str
    schema: str
    source_format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    rules: dict[str, str] = field(default_factory=dict)
    key: tuple[str, ...] = ()


def read_batch(spark: SparkSession, contract: SourceContract, path: str | None = None) -> DataFrame:
    """One engine for all sources; nothing is inferred. CSV and JSON lines that don't fit are kept, as text."""
    kind = _FORMATS.get(contract.transport) or contract.source_format
    schema, options = contract.schema, dict(contract.options)
    if kind in ("csv", "json"):
        schema, options = f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT} | options
    reader = spark.read.format(kind).options(**options)
    if kind != "jdbc":  # a database declares its own
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def drift(df: DataFrame, contract: SourceContract, spark: SparkSession) -> tuple[list[str], list[str]]:
    """Columns that a file lacks, and those that the contract doesn't know; neither is silently ignored."""
    declared = spark.createDataFrame([], contract.schema).columns
    return sorted(set(declared) - set(df.columns)), sorted(set(df.columns) - set(declared))


def stamp(df: DataFrame, batch_id: str, received_at: str, schema_version: int = 1) -> DataFrame:
    """Bronze rows: as landed, with batch, arrival, file, hash and version."""
    return df.withColumns(
        {
            "batch_id": F.lit(batch_id),
            "received_at": F.lit(received_at).cast("timestamp_ntz"),
            "source_file": F.input_file_name(),
            "row_hash": row_hash(*df.columns),
            "schema_version": F.lit(schema_version),
        }
    )


def split_quarantine(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all rules, and the others with the names of those they fail; a null verdict fails."""
    failed: Column = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    judged = df.withColumn("reasons", failed)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append-only tables: bronze, audit, ledgers."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: tuple[str, ...]) -> None:
    """Only the partitions that ``df`` has rows of are replaced: a late batch rewinds its own periods."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def new_batches(manifests: DataFrame, registry: DataFrame) -> DataFrame:
    """Manifests whose (source, batch) isn't registered; the same batch twice in one delivery counts once."""
    return manifests.join(registry.select("source_id", "batch_id"), ["source_id", "batch_id"], "left_anti").dropDuplicates(["source_id", "batch_id"])


def on_landing(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Calls ``handle`` with each landed micro-batch, until all files there are have been handled."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class PagesReader(DataSourceReader):
    """Pages of an API are partitions; a page is asked for in the task that reads it."""

    def __init__(self, options: dict[str, str]) -> None:
        self.pages, self.size = int(options.get("pages", "1")), int(options.get("page_size", "100"))

    def partitions(self) -> list[InputPartition]:
        return [_Page(k) for k in range(self.pages)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        # stands for the request: a deterministic page, as there is no network here
        for k in range(self.size):
            n = partition.number * self.size + k
            yield (n, f"sku-{n % 40}", float(10 + n % 90))


class PagesApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages_api"

    def schema(self) -> str:
        return "id bigint, sku string, price double"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(dict(self.options))
