"""The given tables, read as they are, and the capture roles they play.

Pages are crawl results and calls. Events are a session log per user: views and
sign-ups are page states, clicks are actions, purchases are calls, errors are
pauses. Nothing is sampled; every row takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ACTIONS, NET, STATES
from ..session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose text is worked on row by row; one of fewer files than cores is dealt to all of them."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return spread(df, cores if len(df.inputFiles()) < cores else None)


#: Rows that one task works on in Python.
TASK_ROWS = 50_000


def dealt_table(spark: SparkSession, sf_dir: str, name: str, *by: str) -> DataFrame:
    """A table of short rows that each become a page or a body, dealt by its number of rows.

    A file of few bytes holds rows for hours of work, and one group of rows in it is one task. Rows
    that are alike in ``by`` come together.
    """
    df = table(spark, sf_dir, name)
    parts = max(spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(parts, *by)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a real timestamp; the file holds times without a zone, read as UTC."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _complete(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of a capture schema that the source does not have, as NULL."""
    schema = df.sparkSession.createDataFrame([], ddl).schema
    have = set(df.columns)
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def event_states(ev: DataFrame) -> DataFrame:
    kept = ev.filter(F.col("event_type").isin("view", "signup"))
    k = F.get_json_object("props", "$.k")
    return _complete(
        kept.select(
            F.col("user_id").cast("string").alias("session"), F.concat(F.lit("st_"), "event_id").alias("id"), F.col("event_id").alias("seq"),
            F.lit(1).alias("tab_id"), F.lit(0).alias("frame_id"), F.col("ts").alias("captured_at"), F.col("ts").alias("trigger_at"),
            F.when(F.col("event_type") == "signup", F.lit("load")).otherwise(F.concat(F.lit("change:"), k)).alias("trigger"),
            F.lit("https://shop.example.com").alias("origin"), F.concat(F.lit("https://shop.example.com/k/"), k).alias("url"), F.concat(F.lit("/k/"), k).alias("route"),
            F.concat(F.lit("/k/"), k).alias("pathname"), F.col("event_type").alias("signature"), F.concat(F.lit("Item "), k).alias("title"),
            F.array().cast("array<string>").alias("errors"), F.array(F.col("event_type")).alias("headings"),
        ),
        STATES,
    )


def event_actions(ev: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    kept = ev.filter(F.col("event_type") == "click")
    return _complete(
        kept.select(
            F.col("user_id").cast("string").alias("session"), F.concat(F.lit("act_"), "event_id").alias("id"), F.col("event_id").alias("seq"), F.lit(1).alias("tab_id"),
            F.lit(0).alias("frame_id"), F.lit("click").alias("kind"), F.concat(F.lit("change:"), k).alias("trigger"), F.col("ts").alias("at"),
            F.when(k.cast("int") % 2 == 0, "https://shop.example.com").otherwise("https://help.example.com").alias("origin"), F.concat(F.lit("Item "), k).alias("label"),
            F.lit(False).alias("danger"),
        ),
        ACTIONS,
    )


def event_calls(ev: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    kept = ev.filter(F.col("event_type") == "purchase")
    return _complete(
        kept.select(
            F.col("user_id").cast("string").alias("session"), F.concat(F.lit("net_"), "event_id").alias("id"), F.col("event_id").alias("seq"), F.lit(1).alias("tab_id"),
            F.lit(0).alias("frame_id"), F.lit("POST").alias("method"), F.concat(F.lit("https://shop.example.com/api/"), k).alias("url"),
            F.concat(F.lit("https://shop.example.com/k/"), k).alias("page_url"), F.col("ts").alias("started_at"), F.lit(False).alias("state_id_inferred"),
            F.lit(200).alias("status"), F.lit("application/json").alias("mime_type"), F.col("props").alias("response_body"), F.lit(False).alias("is_download"),
        ),
        NET,
    )


def event_pauses(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("event_type") == "error").select(F.col("user_id").cast("string").alias("session"), F.lit("paused").alias("type"), F.col("ts").alias("at"))
