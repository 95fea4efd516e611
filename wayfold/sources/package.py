"""Writing the derived tables of a capture, one folder per table, split by site."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "json")


def write_package(tables: Mapping[str, DataFrame], path: str, *, origin: str = "origin", fmt: str = "parquet") -> dict[str, str]:
    """Writes every table, empty ones too; a table that fails costs only itself.

    Schemas go into ``_tables``, so an empty table can be read back too.
    Returns ``{table: "ok" | message}``. Tables with an origin column are
    partitioned by it, so reading one site prunes the rest.
    """
    outcome, shapes = {}, []
    for name, df in tables.items():
        try:
            shapes.append((name, df.schema.json()))
            # Rows of a site are brought together and large sites split again by size.
            keyed = origin in df.columns
            writer = (df.hint("rebalance", F.col(origin)) if keyed else df).write.mode("overwrite")
            (writer.partitionBy(origin) if keyed else writer).format(fmt).save(f"{path}/{name}")
            outcome[name] = "ok"
        except Exception as error:  # noqa: BLE001 - one bad table must not lose the others
            outcome[name] = str(error).splitlines()[0][:300]
    if shapes:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame(shapes, "table string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/_tables")
    return outcome


def read_package_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A table of a package with its declared schema, also when it holds no rows."""
    row = spark.read.schema("table string, schema string").json(f"{path}/_tables").filter(F.col("table") == name).first()
    return spark.read.schema(T.StructType.fromJson(json.loads(row["schema"]))).format(fmt).load(f"{path}/{name}")
