"""Redaction over tables: learned values, labelled text, calls, leak audits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.exprs import squeeze, text
from ..functions.manypatterns import Values, replaced
from ..functions.pyrules import learn_from_json, scrub_json
from ..functions.redaction import hint_rule, label_rule, scrub_expr
from .ordered import previous_row

# ---- fixed values: what may be learned ---------------------------------------
LEARN_MIN = 4

#: Values of one automaton, and texts that run through it in one pile, about.
VALUES, TEXTS = 20_000, 5_000
_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("v", pa.string()), ("r", pa.string())]))


def learnable(value: Column) -> Column:
    """Values worth removing elsewhere: four characters, a letter, not a code word, not a placeholder."""
    v = squeeze(text(value))
    return (F.length(v) >= LEARN_MIN) & ~v.startswith("<") & v.rlike(r"\p{L}") & ~v.rlike(r"^[a-z0-9_-]+\z")


def learned_values(df: DataFrame, body: str, *, doc: Sequence[str] = ("session",), order: str = "seq", packs=("generic",), keep: int | None = None) -> DataFrame:
    """``(doc…, value, replacement)`` from JSON bodies; all of them, or the latest ``keep`` per document if asked."""
    found = df.select(*doc, order, F.explode(learn_from_json(F.col(body), packs)).alias("l")).select(*doc, order, "l.*")
    return latest_learned(found, doc=doc, order=order, keep=keep)


def latest_learned(found: DataFrame, *, doc: Sequence[str], order: str, keep: int | None = None) -> DataFrame:
    good = found.filter(learnable(F.col("value"))).withColumn("value", squeeze("value"))
    first = good.groupBy(*doc, F.lower("value").alias("__k")).agg(
        F.min_by(F.struct("value", "replacement"), F.struct(order, "replacement", "value")).alias("v"), F.min(order).alias("__at")
    )
    if keep is not None:
        # A small row_number limit is applied on the map side before any shuffle.
        recent = Window.partitionBy(*doc).orderBy(F.col("__at").desc(), "__k")
        first = first.withColumn("__n", F.row_number().over(recent)).filter(F.col("__n") <= keep)
    return first.select(*doc, "v.value", "v.replacement")


def occurrences(texts: DataFrame, learned: DataFrame, *, doc: Sequence[str]) -> DataFrame:
    """``(doc…, __h, spans)`` for ``texts`` (doc…, __h, __t) that hold learned values of their document.

    Values of a document are dealt into parts of ``VALUES``, each one automaton; its texts are dealt
    into piles of ``TEXTS``, and every pile runs once through each part. So neither the values nor the texts
    of a document have to fit one task.
    """
    keys = list(doc)
    parts = learned.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(VALUES)).cast("int").alias("__parts"))
    piles = texts.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(TEXTS)).cast("int").alias("__piles"))
    sizes = parts.join(piles, keys)
    values = learned.join(sizes, keys).withColumn("__part", F.pmod(F.xxhash64("value"), "__parts").cast("int")).withColumn("__pile", F.explode(F.sequence(F.lit(0), F.col("__piles") - 1)))
    asked = texts.join(sizes, keys).withColumn("__pile", F.pmod(F.xxhash64("__h"), "__piles").cast("int")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    run = F.to_json(F.struct(*keys, "__part", "__pile")).alias("__run")
    none = F.lit(None).cast("string")
    both = values.select(*keys, run, F.lit(0).alias("__side"), none.alias("__h"), F.col("value").alias("__t"), "replacement").unionByName(
        asked.select(*keys, run, F.lit(1).alias("__side"), "__h", "__t", none.alias("replacement"))
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, values = None, [], None
        for batch in batches:
            rows = batch.select(["__run", "__side", "__h", "__t", "replacement"]).to_pydict()
            found, which = [], []
            for i, (name, side, text_, replacement) in enumerate(zip(rows["__run"], rows["__side"], rows["__t"], rows["replacement"], strict=True)):
                if name != at:
                    at, known, values = name, [], None
                if side == 0:
                    known.append((text_, replacement))
                    continue
                if values is None:
                    values = Values(known)
                spans = values.find(text_)
                if spans:
                    found.append([{"s": s, "e": e, "v": v, "r": r} for s, e, v, r in spans])
                    which.append(i)
            if which:
                mine = batch.take(pa.array(which))
                columns = [mine.column(mine.schema.get_field_index(c)) for c in [*keys, "__h"]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _SPANS)], names=[*keys, "__h", "spans"])

    fields = T.StructType([*(texts.schema[c] for c in keys), T.StructField("__h", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("r", T.StringType())])))])
    hits = both.repartition("__run").sortWithinPartitions("__run", "__side").mapInArrow(look, fields)
    return hits.groupBy(*keys, "__h").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def scrub_learned(df: DataFrame, column: str, learned: DataFrame, *, doc: Sequence[str] = ("session",), packs=("generic",)) -> DataFrame:
    """Learned values removed everywhere in their document, longest first, then the pattern rules.

    A document may have any number of values and texts of any length: all values are
    looked for in one pass over each distinct text, in time linear in the text. Case and
    the width of white space do not matter.
    """
    shown = df.filter(F.length(column) >= LEARN_MIN).select(*doc, F.md5(column).alias("__h"), F.col(column).alias("__t")).dropDuplicates([*doc, "__h"])
    known = learned.select(*doc, "value", "replacement").filter(F.col("value").isNotNull() & F.col("replacement").isNotNull()).distinct()
    lists = occurrences(shown.join(known.select(*doc).distinct(), list(doc), "left_semi"), known, doc=doc)
    joined = df.withColumn("__h", F.md5(column)).join(lists, [*doc, "__h"], "left")

    @F.pandas_udf("string")
    def written(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else replaced(t, [(x["s"], x["e"], x["v"], x["r"]) for x in s]) for t, s in zip(texts, spans)], dtype="object")

    return joined.withColumn(column, scrub_expr(F.when(F.col("spans").isNull(), F.col(column)).otherwise(written(F.col(column), F.col("spans"))), packs)).select(*df.columns)


def scrub_labelled(nodes: DataFrame, *, doc: Sequence[str], packs=("generic",), value_max: int | None = None, hint_text_max: int | None = None) -> DataFrame:
    """Text nodes with values after a label, or in an element named for a person, replaced.

    Values and elements of any length, or of so many characters at most if asked.

    Returns the text nodes with ``scrubbed`` and ``replacement`` (NULL where the
    structure gave nothing away). A header cell never labels what follows.
    """
    texts = nodes.filter(F.col("tag") == "#text").withColumns({"__t": squeeze("text")})
    said = texts.filter(~F.col("__t").rlike(r"^[:\-–—|*]\z") & (F.col("__t") != "")).withColumn("__label", label_rule("__t", packs))
    header = nodes.filter((F.col("tag") == "th") | (F.col("attrs")["role"] == "columnheader")).select(*doc, F.col("idx").alias("__up"))
    in_header = said.filter(F.col("__label").isNotNull()).select(*doc, "idx", F.explode("path").alias("__up")).join(header, [*doc, "__up"], "left_semi").select(*doc, "idx").distinct().withColumn("__head", F.lit(True))
    armed = said.join(in_header, [*doc, "idx"], "left").withColumn("__arms", F.when(F.col("__head").isNull(), F.col("__label")))
    # A page is one document and bounded by its own size; chunking by position keeps even that small.
    after = previous_row(armed, by=doc, order=["idx"], payload=["__arms"], out="__prev", chunk=5000)
    value = F.when(F.col("__label").isNull() & (F.lit(True) if value_max is None else F.length("__t") <= value_max) & ~F.col("__t").startswith("<"), F.col("__prev.__arms"))
    hints = nodes.filter((F.col("tag") != "#text") & (F.lit(True) if hint_text_max is None else F.col("text_len") <= hint_text_max)).withColumn("__hint", hint_rule(F.col("attrs")["id"], F.col("attrs")["class"], packs)).filter(F.col("__hint").isNotNull())
    hinted = texts.select(*doc, "idx", F.explode("path").alias("__up")).join(hints.select(*doc, F.col("idx").alias("__up"), "__hint"), [*doc, "__up"]).groupBy(*doc, "idx").agg(F.max_by("__hint", "__up").alias("__hint"))
    out = texts.join(after.select(*doc, "idx", value.alias("__value")), [*doc, "idx"], "left").join(hinted, [*doc, "idx"], "left")
    replacement = F.coalesce("__hint", "__value")
    return out.withColumn("replacement", replacement).withColumn("scrubbed", F.coalesce("replacement", scrub_expr("text", packs))).drop("__t", "__value", "__hint")


def scrub_net(net: DataFrame, packs=("generic",)) -> DataFrame:
    """Calls as they may be kept: bodies walked, URL and header values scrubbed."""
    headers = lambda c: F.transform(c, lambda h: F.struct(h["name"].alias("name"), scrub_expr(h["value"], packs).alias("value")))
    return net.withColumns({
        "url": scrub_expr("url", packs), "page_url": scrub_expr("page_url", packs), "request_headers": headers("request_headers"), "response_headers": headers("response_headers"),
        "request_body": scrub_json("request_body", packs), "response_body": scrub_json("response_body", packs),
    })


def scrub_shape(nodes: DataFrame, *, by: Sequence[str], packs=("generic",)) -> DataFrame:
    """Shape rows with keys and enum values scrubbed; keys that meet get ``#2``, ``#3``."""
    from .records import unique_names

    clean = nodes.withColumns({"key": scrub_expr("key", packs), "values": F.transform("values", lambda v: scrub_expr(v, packs))})
    keyed = clean.filter(F.col("key").isNotNull())
    named = unique_names(keyed, base="key", order=["path"], by=[*by, "parent"], out="__key", chunk=1) if "path" not in by else keyed
    named = named.withColumn("key", F.regexp_replace("__key", r"_([0-9]+)\z", "#$1") if "__key" in named.columns else F.col("key")).drop("__key")
    return named.unionByName(clean.filter(F.col("key").isNull()))


def leak_audit(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], probes: Mapping[str, str], *, literal: bool = False) -> DataFrame:
    """``(source, column, probe, n_rows, n_hits)``: known secrets found in text columns.

    Probes are a short list named in code (patterns, or literals); each becomes
    one expression, so the tables are read once and nothing is paired up.
    """
    import re

    out = None
    for source, (df, columns) in tables.items():
        slim = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("t")) for c in columns])).alias("x")).select("x.*")
        hits = F.array(*[F.struct(F.lit(name).alias("probe"), F.regexp_count("t", F.lit(re.escape(p) if literal else p)).alias("n")) for name, p in probes.items()])
        part = slim.filter(F.col("t").isNotNull()).select("column", F.explode(hits).alias("h")).groupBy(F.lit(source).alias("source"), "column", F.col("h.probe").alias("probe")).agg(
            F.sum(F.when(F.col("h.n") > 0, 1).otherwise(0)).alias("n_rows"), F.sum("h.n").alias("n_hits"))
        out = part if out is None else out.unionByName(part)
    return out
