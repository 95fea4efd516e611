"""Reading capture logs and crawls. Schemas are declared; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import text
from ..schemas import TABLES


def read_capture_log(spark: SparkSession, path: str, table: str, fmt: str = "json") -> DataFrame:
    """One capture table. Lines that do not parse are kept in ``_corrupt_record``."""
    schema = TABLES[table]
    if fmt == "json":
        return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return spark.read.schema(schema).format(fmt).load(path)


def stream_capture_log(spark: SparkSession, path: str, table: str, fmt: str = "json") -> DataFrame:
    """The same table as a stream of files."""
    return spark.readStream.schema(TABLES[table]).format(fmt).load(path)


def read_pages(spark: SparkSession, path: str, *, fmt: str = "parquet", url: str = "url", html: str = "html") -> DataFrame:
    """A crawl table with ``url`` and ``html``; other columns are kept and pruned when unused."""
    return spark.read.format(fmt).load(path).withColumnsRenamed({url: "url", html: "html"})


def _empty(column: str, kind: str):
    return F.coalesce(F.col(column), F.array().cast(kind))


def complete_states(df: DataFrame) -> DataFrame:
    """Fields older state records lack, at their empty values."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    lists = {c: _empty(c, kinds[c]) for c in ("query_keys", "triggers", "headings", "errors", "notices", "steps", "buttons", "controls", "blocked_frames", "net_refs", "action_ids") if c in kinds}
    return df.withColumns({"route": F.coalesce("route", "pathname", F.lit("")), **lists})


def complete_net(df: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(c, F.lit(False))
    return df.withColumns({"response_size": F.coalesce("response_size", F.lit(-1)), "body_truncated": flag("body_truncated"), "is_download": flag("is_download"), "has_full_body": flag("has_full_body"), "state_id_inferred": flag("state_id_inferred")})


def complete_transitions(df: DataFrame) -> DataFrame:
    """Edges from before routes existed: a changed address is the closest they recorded."""
    return df.withColumns({"route_changed": F.coalesce("route_changed", "url_changed", F.lit(False)), "view_changed": F.coalesce("view_changed", F.lit(False)), "via_new_tab": F.coalesce("via_new_tab", F.lit(False))})


def bad_lines(df: DataFrame) -> DataFrame:
    return df.filter(text("_corrupt_record") != "").select("_corrupt_record")
