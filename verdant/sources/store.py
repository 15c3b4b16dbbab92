"""The table store as Parquet, and JSON text columns as typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from verdant.schemas import TABLES

# Tables that grow with fields and time are laid out by a bucket of their main key, so that a lookup
# reads one folder and a field's rows stay together without one folder per field.
BUCKETED = {"acquisitions": "field_id", "pixels": "field_id", "index_values": "acquisition_id", "chunks": "document_id"}
BUCKETS = 64
ROWS_PER_FILE = 5_000_000

# Columns that jobs name by what they work on, and the tables by what they store.
JOB_NAMES = {"chunks": {"chunk_text": "text"}, "chat_messages": {"field_id": "conv_id"}, "chat_summaries": {"field_id": "conv_id"}}


def conform(df: DataFrame, name: str) -> DataFrame:
    """A job's rows with exactly the columns and types its table declares.

    Structs become maps where a map is declared, the three lists of an advice its one struct, and columns a
    job does not make are NULL.
    """
    if name not in TABLES:
        return df
    wanted = StructType.fromDDL(TABLES[name])
    columns = []
    for field in wanted.fields:
        source = field.name if field.name in df.columns else JOB_NAMES.get(name, {}).get(field.name)
        if source in df.columns:
            kind, value = df.schema[source].dataType, F.col(source)
            if isinstance(field.dataType, MapType) and isinstance(kind, StructType):
                value = F.from_json(F.to_json(value), field.dataType)
        elif isinstance(field.dataType, StructType) and set(field.dataType.names) <= set(df.columns):
            value = F.struct(*field.dataType.names)
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_table(df: DataFrame, folder: str, name: str, mode: str = "append", buckets: int = BUCKETS) -> None:
    rows, key = conform(df, name), BUCKETED.get(name)
    if key is None:
        rows.write.mode(mode).parquet(f"{folder}/{name}")
        return
    # rebalanced by size: small buckets share a writer, a large one is split over several
    spread = rows.withColumn("bucket", _bucket(F.col(key), buckets)).hint("rebalance", "bucket")
    spread.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("bucket").parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read
    declared = schema or TABLES.get(name)
    if declared:
        reader = reader.schema(declared + (", bucket INT" if name in BUCKETED else ""))
    return reader.parquet(f"{folder}/{name}")


def read_rows(spark: SparkSession, folder: str, name: str, keys: list[int], buckets: int = BUCKETS) -> DataFrame:
    """Rows of some values of a table's main key; only the folders of their buckets are read."""
    key = BUCKETED[name]
    kind = dict(read_table(spark, folder, name).dtypes)[key]
    own = [F.lit(k).cast(kind) for k in keys]
    return read_table(spark, folder, name).filter(F.col(key).isin(own) & F.col("bucket").isin([_bucket(k, buckets) for k in own]))


def decode_json_columns(df: DataFrame, **types: str) -> DataFrame:
    """A10: text column ``x_json`` → typed column ``x``; a column that is not text is left as it is."""
    kinds = dict(df.dtypes)
    for name, kind in types.items():
        source = f"{name}_json"
        if kinds.get(source) == "string":
            df = df.withColumn(name, F.from_json(source, kind)).drop(source)
    return df
