"""Shapes of JSON bodies in long form: one row per path.

A shape is never a nested object here. Merging two shapes, or two million, is a
``groupBy(owner, path)`` with map-side aggregation, so an endpoint with a third
of all calls is merged in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..functions.columns import unfold
from ..functions.names import format_of
from ..functions.exprs import at_most, first_of, strip
from ..session import cut_lineage


def shape_visits(
    df: DataFrame,
    *,
    body: str = "response_body",
    owner: Sequence[str] = ("id",),
    depth: int | None = None,
    keys: int | None = None,
    sample: int | None = None,
    nodes: int | None = None,
) -> DataFrame:
    """Every value of every body: ``(owner…, path, parent, key, type, len, text, n)``; equal ones next to each other as one row with their number."""
    read = S.ShapeVisits().eval
    slim = df.select(*owner, F.col(body).alias("__body"))
    return unfold(slim, "__body", lambda text: read(text, depth, keys, sample, nodes), S.VISIT_SCHEMA, count="n")


def body_shapes(df: DataFrame, *, body: str = "response_body", owner: Sequence[str] = ("id",), by: Sequence[str] | None = None) -> DataFrame:
    """``shape_nodes`` of ``shape_visits``, where nearly every body has an owner of its own.

    The nodes of such a body are known where it is read: nothing of it is written or sent. Bodies
    that share an owner go the way of all values. With ``by``, some of the owner's columns, nodes carry
    these alone, and equal ones that a task holds at one time are one row with their number as ``bodies``.
    """
    slim = df.select(*owner, F.col(body).alias("__body"))
    names = {c: f"__o_{i}" for i, c in enumerate(owner)}
    shared = cut_lineage(slim.groupBy(*owner).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1).select(*[F.col(c).alias(a) for c, a in names.items()]))
    if not shared.limit(1).count():
        return _nodes_of_lone(slim, owner, by)
    same = F.lit(True)
    for c, a in names.items():
        same = same & F.col(c).eqNullSafe(F.col(a))
    rest = shape_visits(slim.join(shared, same, "left_semi"), body="__body", owner=owner)
    others = shape_nodes(rest, owner=owner)
    if by is not None:
        others = others.drop(*[c for c in owner if c not in by]).withColumn("bodies", F.lit(1).cast("bigint"))
    return _nodes_of_lone(slim.join(shared, same, "left_anti"), owner, by).unionByName(others)


def _nodes_of_lone(slim: DataFrame, owner: Sequence[str], by: Sequence[str] | None) -> DataFrame:
    kept = owner if by is None else by
    n = unfold(slim.select(*kept, "__body"), "__body", S.BodyNodes().eval, S.NODE_SCHEMA, count=None if by is None else "bodies")
    formats = F.transform(F.filter("__texts", lambda t: strip(t) != ""), lambda t: format_of(t))
    lo, hi = F.array_min(formats), F.array_max(formats)
    n = n.withColumns({
        "format": F.when(F.col("type") == "string", F.when(lo == hi, lo).when(lo.isNotNull(), F.lit("text"))),
        "__values": F.when(F.col("__strings") >= S.ENUM_MIN_SEEN, F.array_sort(F.filter("__texts", lambda t: t != ""))),
    })
    n = n.withColumn("longest", F.array_max(F.transform("__values", lambda t: F.length(t))))
    enum = (F.col("type") == "string") & F.size("__values").between(1, S.ENUM_MAX_DISTINCT) & (F.col("longest") <= S.ENUM_VALUE_CHARS) & _enum_like()
    return n.select(
        *kept, "path", "parent", "key", "type", "nullable", "len", F.when(F.col("type") == "string", F.coalesce("format", F.lit("text"))).alias("format"),
        F.when(enum, F.col("__values")).alias("values"), "n", "n_objects", _ancestors(F.col("path")).alias("above"), "optional", *([] if by is None else ["bodies"]),
    )


def _enum_like() -> Column:
    """Free text and yes/no values may be enums; numbers only while they are short codes."""
    return F.col("format").isin("text", "boolean") | ((F.col("format") == "numeric") & (F.col("longest") <= S.ENUM_CODE_CHARS))


def _merge_format() -> Column:
    """One format when all agree, else text; NULL while only blanks were seen."""
    lo, hi = F.min("format"), F.max("format")
    return F.when(lo == hi, lo).when(lo.isNotNull(), F.lit("text"))


def _merge_type() -> Column:
    """The one real type seen; several make ``mixed``. Cut-off and null values say nothing."""
    real = F.when(~F.col("type").isin("null", "truncated"), F.col("type"))
    lo, hi = F.min(real), F.max(real)
    silent = F.when(F.max(F.when(F.col("type") == "null", 1)) == 1, F.lit("null")).otherwise("truncated")
    return F.when(lo.isNull(), silent).when(lo == hi, lo).otherwise("mixed")


def _drop_below_mixed(nodes: DataFrame, owner: Sequence[str]) -> DataFrame:
    """A position of several types has no fields; what lies under it goes."""
    mixed = nodes.filter(F.col("type") == "mixed").select(*owner, F.col("path").alias("__above"))
    under = (
        nodes.select(*owner, "path", F.explode("above").alias("__above"))
        .join(mixed, [*owner, "__above"], "left_semi")
        .select(*owner, "path")
        .distinct()
    )
    return nodes.join(under, [*owner, "path"], "left_anti")


def _ancestors(path: Column) -> Column:
    """Paths above ``path``, built from its steps (``.key``, ``[]``, ``["k"]``)."""
    steps = F.regexp_extract_all(path, F.lit(r"\.[A-Za-z_$][A-Za-z0-9_$]*|\[\]|\[\"(?:[^\"\\]|\\.)*\"\]"), F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0))),
        lambda n: F.concat(F.lit("$"), F.array_join(F.slice(steps, F.lit(1), n), "")),
    )


def shape_nodes(visits: DataFrame, *, owner: Sequence[str] = ("id",)) -> DataFrame:
    """One row per path of a body: type, nullable, length, format, enum values, optional.

    ``values`` is set only where the position was seen often enough, with few
    distinct short values of an enum-like format.
    """
    v = visits.withColumn(
        "format", F.when((F.col("type") == "string") & (strip("text") != ""), format_of("text"))
    ).withColumn("__choice", F.when((F.col("type") == "string") & (F.col("text") != "") & (F.length("text") <= S.ENUM_VALUE_CHARS), F.col("text")))
    # Bodies are read once: equal values of a position are counted first, and
    # everything else works on those counts. Distinct texts are counted as rows,
    # so a position with endless values never builds an endless set.
    pre = cut_lineage(
        v.groupBy(*owner, "path", "parent", "key", "type", "format", "__choice").agg(
            F.sum("n").alias("n"), F.max("len").alias("len"),
            F.max(F.when((F.col("type") == "string") & (F.length("text") > S.ENUM_VALUE_CHARS), 1).otherwise(0)).alias("__long"),
        )
    )
    some = lambda kind: F.sum(F.when(F.col("type") == kind, F.col("n")).otherwise(0))
    merged = pre.groupBy(*owner, "path").agg(
        F.min("parent").alias("parent"),
        F.min("key").alias("key"),
        _merge_type().alias("type"),
        F.coalesce(F.max(F.col("type") == "null"), F.lit(False)).alias("__null"),
        F.max("len").alias("len"),
        _merge_format().alias("format"),
        F.sum("n").alias("n"),
        some("string").alias("__strings"),
        some("object").alias("n_objects"),
        F.max("__long").alias("__long"),
        F.count("__choice").alias("__distinct"),
        F.max(F.length("__choice")).alias("longest"),
    )
    few = (
        pre.filter(F.col("__choice").isNotNull())
        .join(merged.filter(F.col("__distinct").between(1, S.ENUM_MAX_DISTINCT)).select(*owner, "path"), [*owner, "path"], "left_semi")
        .groupBy(*owner, "path")
        .agg(F.array_sort(F.collect_set("__choice")).alias("__values"))
    )
    whole = merged.join(few, [*owner, "path"], "left")
    enum = (
        (F.col("type") == "string") & (F.col("__strings") >= S.ENUM_MIN_SEEN) & (F.col("__long") == 0)
        & F.col("__values").isNotNull() & _enum_like()
    )
    nodes = cut_lineage(whole.select(
        *owner, "path", "parent", "key", "type",
        (F.col("__null") & (F.col("type") != "null")).alias("nullable"),
        F.when(F.col("type").isin("string", "array"), F.col("len")).alias("len"),
        F.when(F.col("type") == "string", F.coalesce("format", F.lit("text"))).alias("format"),
        F.when(enum, F.col("__values")).alias("values"),
        "n", "n_objects",
        _ancestors(F.col("path")).alias("above"),
    ))
    return _with_optional(_drop_below_mixed(nodes, owner), owner)


def _with_optional(nodes: DataFrame, owner: Sequence[str]) -> DataFrame:
    """A key is optional when fewer objects carry it than were seen at its parent."""
    objects = nodes.filter(F.col("type") == "object").select(*owner, F.col("path").alias("parent"), F.col("n_objects").alias("__of"))
    return (
        nodes.join(objects, [*owner, "parent"], "left")
        .withColumn("optional", F.col("key").isNotNull() & F.coalesce(F.col("n") < F.col("__of"), F.lit(False)))
        .drop("__of")
    )


def merge_shapes(nodes: DataFrame, *, by: Sequence[str], bodies: str | None = None) -> DataFrame:
    """Union of shapes per group, from per-body nodes; ``bodies`` names a column with the number of bodies that a row stands for.

    Keys missing on one side become optional, null makes a position nullable,
    different types make it mixed, and enum values survive only while every
    body had some and there are few in all.
    """
    # Equal nodes are counted first: bodies of one kind come to few rows, before anything is written or sent.
    times = F.lit(1) if bodies is None else F.col(bodies)
    nodes = cut_lineage(
        nodes.groupBy(*by, "path", "parent", "key", "type", "nullable", "format", "values", F.coalesce("optional", F.lit(False)).alias("optional")).agg(
            F.sum(times).alias("__bodies"), F.sum(times * F.col("n")).alias("n"), F.sum(times * F.col("n_objects")).alias("n_objects"), F.max("len").alias("len"),
        )
    )
    n_texts = F.sum(F.when(F.col("type") == "string", F.col("__bodies")).otherwise(0))
    merged = nodes.groupBy(*by, "path").agg(
        F.min("parent").alias("parent"),
        F.min("key").alias("key"),
        _merge_type().alias("type"),
        F.max(F.col("nullable") | (F.col("type") == "null")).alias("__null"),
        F.max("len").alias("len"),
        _merge_format().alias("format"),
        F.sum("n").alias("n"),
        F.sum("n_objects").alias("n_objects"),
        (n_texts == F.sum(F.when(F.col("values").isNotNull(), F.col("__bodies")).otherwise(0))).alias("__all_enum"),
        F.max("optional").alias("__optional"),
    )
    choices = (
        nodes.filter(F.col("values").isNotNull())
        .select(*by, "path", F.explode("values").alias("__v"))
        .distinct()
    )
    few = choices.groupBy(*by, "path").agg(F.count(F.lit(1)).alias("__d")).filter(F.col("__d") <= S.ENUM_MAX_DISTINCT)
    values = (
        choices.join(few, [*by, "path"], "left_semi")
        .groupBy(*by, "path")
        .agg(F.array_sort(F.collect_set("__v")).alias("__values"))
    )
    whole = cut_lineage(merged.join(values, [*by, "path"], "left").select(
        *by, "path", "parent", "key", "type",
        (F.col("__null") & (F.col("type") != "null")).alias("nullable"),
        F.when(F.col("type").isin("string", "array"), F.col("len")).alias("len"),
        F.when(F.col("type") == "string", F.coalesce("format", F.lit("text"))).alias("format"),
        F.when((F.col("type") == "string") & F.col("__all_enum"), F.col("__values")).alias("values"),
        "n", "n_objects", "__optional",
        _ancestors(F.col("path")).alias("above"),
    ))
    out = _with_optional(_drop_below_mixed(whole, by), by)
    return out.withColumn("optional", F.col("optional") | (F.col("key").isNotNull() & F.col("__optional"))).drop("__optional")


def list_paths(nodes: DataFrame, *, by: Sequence[str], limit: int | None = None, depth: int | None = None) -> DataFrame:
    """Arrays that look like row data: items are objects and there was more than one."""
    items = nodes.filter((F.col("type") == "object") & F.col("path").endswith("[]")).select(*by, F.col("parent").alias("path"))
    arrays = nodes.filter((F.col("type") == "array") & (F.col("len") > 1) & at_most(F.size("above") - 1, depth))
    found = arrays.join(items, [*by, "path"], "left_semi").select(*by, "path", "len")
    if limit is None:
        return found
    shortest = Window.partitionBy(*by).orderBy(F.length("path"), "path")
    return found.withColumn("__n", F.row_number().over(shortest)).filter(F.col("__n") <= limit).drop("__n")


def shape_at(nodes: DataFrame, path: str) -> DataFrame:
    """The part of a shape at ``path`` and below."""
    return nodes.filter((F.col("path") == path) | F.col("path").startswith(f"{path}.") | F.col("path").startswith(f"{path}["))


def row_fields(nodes: DataFrame, *, by: Sequence[str], limit: int | None = None) -> DataFrame:
    """``key?  type, nullable`` lines for the items of every list, ``limit`` each if asked."""
    word = (
        F.when((F.col("type") == "string") & F.col("values").isNotNull(), F.concat(F.lit("one of "), F.array_join(F.transform("values", lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")))
        .when((F.col("type") == "string") & (F.col("format") != "text"), F.concat(F.lit("string ("), F.col("format"), F.lit(")")))
        .otherwise(F.col("type"))
    )
    line = F.concat(
        F.lit("`"), F.col("key"), F.lit("`"), F.when(F.col("optional"), "?").otherwise(""), F.lit(" "), word,
        F.when(F.col("nullable"), ", nullable").otherwise(""),
    )
    fields = nodes.filter(F.col("key").isNotNull() & F.col("parent").endswith("[]"))
    listed = fields.groupBy(*by, F.col("parent").alias("item_path")).agg(
        F.array_sort(F.collect_list(F.struct("key", line.alias("line")))).alias("f")
    )
    shown = F.array_join(F.transform(first_of(F.col("f"), limit), lambda x: x["line"]), "; ")
    more = F.lit("") if limit is None else F.when(F.size("f") > limit, F.format_string("; … %d more", F.size("f") - limit)).otherwise("")
    return listed.select(*by, "item_path", F.size("f").alias("n_fields"), F.concat(shown, more).alias("fields"))


def leaf_paths(nodes: DataFrame, *, owner: Sequence[str], root: str = "$", depth: int | None = None) -> DataFrame:
    """Distinct leaf paths of each owner, value types left out; down to ``depth`` if asked."""
    level = F.when(F.col("path") == "$", 0).otherwise(F.size("above"))
    shown = nodes.filter((F.col("type") != "truncated") & at_most(level, depth))
    inner = nodes.filter(F.col("type") != "truncated").select(*owner, F.col("parent").alias("path")).distinct().withColumn("__has", F.lit(True))
    tagged = shown.join(inner, [*owner, "path"], "left").withColumn("__level", level)
    open_ = F.coalesce("__has", F.lit(False)) & F.col("type").isin("object", "array") & at_most(F.col("__level") + 1, depth)
    name = (
        F.when((F.col("type") == "object") & F.col("__has").isNull() & at_most(F.col("__level") + 1, depth), F.concat("path", F.lit("{}")))
        .when(F.col("type").isin("object", "array"), F.concat_ws(":", "path", "type"))
        .otherwise(F.col("path"))
    )
    leaf = F.regexp_replace(name, r"^\$", "\\" + root if root == "$" else root)
    return tagged.filter(~open_).select(*owner, leaf.alias("leaf")).distinct()


def shape_similarity(leaves: DataFrame, left: DataFrame, right_key: str, *, key: str) -> DataFrame:
    """Jaccard similarity for the pairs listed in ``left`` (``key``, ``right_key``).

    Common leaves come from one equi join on (pair, leaf); sizes are joined on.
    """
    sizes = leaves.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    a = left.join(leaves, key, "left").withColumnRenamed("leaf", "__leaf")
    b = leaves.select(F.col(key).alias(right_key), F.col("leaf").alias("__leaf"), F.lit(1).alias("__hit"))
    common = a.join(b, [right_key, "__leaf"], "left").groupBy(key, right_key).agg(F.sum(F.coalesce("__hit", F.lit(0))).alias("common"))
    sized = common.join(sizes.withColumnRenamed("n", "__na"), key, "left").join(
        sizes.select(F.col(key).alias(right_key), F.col("n").alias("__nb")), right_key, "left"
    )
    na, nb = F.coalesce("__na", F.lit(0)), F.coalesce("__nb", F.lit(0))
    return sized.select(
        key, right_key, F.when((na == 0) & (nb == 0), 1.0).otherwise(F.col("common") / (na + nb - F.col("common"))).alias("similarity")
    )


def enum_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Which text columns of a wide table hold enum-like values, and which values.

    Columns are first sized with a sketch; only those that can qualify are
    counted exactly.
    """
    rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    narrow = [c for c in columns if (rough[c] or 0) <= 4 * S.ENUM_MAX_DISTINCT]
    if not narrow:
        return df.sparkSession.createDataFrame([], "column string, n_seen long, n_distinct long, values string")
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in narrow])).alias("x")).select("x.*")
    counted = stacked.filter(F.col("value") != "").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("format", format_of("value"))
    few = counted.groupBy("column").agg(
        F.sum("n").alias("n_seen"), F.count(F.lit(1)).alias("n_distinct"), F.max(F.length("value")).alias("longest"), _merge_format().alias("format")
    ).filter((F.col("n_seen") >= S.ENUM_MIN_SEEN) & (F.col("n_distinct") <= S.ENUM_MAX_DISTINCT) & (F.col("longest") <= S.ENUM_VALUE_CHARS) & _enum_like())
    values = counted.join(few.select("column"), "column", "left_semi").groupBy("column").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"))
    return few.join(values, "column").select("column", "n_seen", "n_distinct", "values")
