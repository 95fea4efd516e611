"""Time joins: as-of in both directions, windows with slack, and keyed fallbacks.

None of these builds pairs. "The latest action at most fifteen seconds earlier"
is one running "last seen" scan over both sides laid out on one time line, so the
cost does not depend on how many rows fall into a window.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import scrub_url, trim_route, without_query
from .ordered import carry_last, chunk_width, order_number


def _micros(span: timedelta | int | None) -> int | None:
    if span is None:
        return None
    return int(span.total_seconds() * 1_000_000) if isinstance(span, timedelta) else int(span)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_cols: Sequence[str],
    right_tie: Sequence[str] = (),
    out: str = "match",
    direction: str = "backward",
    tolerance: timedelta | int | None = None,
    slack: timedelta | int = 0,
    strict: bool = False,
    chunk: timedelta | int | None = None,
) -> DataFrame:
    """Adds ``out``: the struct of the nearest right row, NULL when none qualifies.

    ``backward`` takes the latest right row at or before the left time,
    ``forward`` the first at or after it; ``strict`` leaves out equal times.
    ``slack`` lets the right row lie that far on the wrong side and
    ``tolerance`` bounds how far it may lie on the right side. Right rows at one
    time are told apart by ``right_tie`` (the larger wins backward, the smaller
    forward). Rows without a time or a key match nothing.
    """
    forward = direction == "forward"
    sign = -1 if forward else 1
    shift = _micros(slack) or 0
    width = chunk_width(chunk)
    names = list(left.columns)

    usable = F.col(left_ts).isNotNull()
    for k in by:
        usable = usable & F.col(k).isNotNull()
    l = left.withColumn("__us", order_number(left, left_ts))
    # A right row at the left row's own time must be met first, unless strict.
    met_first, met_last = (0, 1) if strict else (1, 0)
    side_left, side_right = (met_last, met_first) if forward else (met_first, met_last)
    lefts = l.filter(usable).select(
        *by,
        (F.col("__us") + F.lit(sign * shift)).alias("__t"),
        F.lit(side_left).alias("__side"),
        F.struct(*names).alias("__left"),
        F.lit(None).cast(_struct_type(right, right_cols)).alias("__right"),
        *[F.lit(None).cast(right.schema[c].dataType).alias(f"__tie{i}") for i, c in enumerate(right_tie)],
    )
    rights = (
        right.withColumn("__t", order_number(right, right_ts))
        .filter(F.col("__t").isNotNull())
        .select(
            *by,
            "__t",
            F.lit(side_right).alias("__side"),
            F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("__left"),
            F.struct(F.col("__t").alias("__at"), *right_cols).cast(_struct_type(right, right_cols)).alias("__right"),
            *[F.col(c).alias(f"__tie{i}") for i, c in enumerate(right_tie)],
        )
    )
    line = lefts.unionByName(rights)
    ties = [f"__tie{i}" for i in range(len(right_tie))]
    seen = carry_last(
        line,
        by=by,
        order=["__t", "__side", *ties],
        value=F.col("__right"),
        out="__seen",
        chunk=width,
        descending=forward,
    ).filter(F.col("__left").isNotNull())
    gap = (F.col("__t") - F.col("__seen.__at")) * sign
    limit = _micros(tolerance)
    ok = F.col("__seen").isNotNull() if limit is None else gap <= F.lit(limit + shift)
    matched = seen.select("__left.*", F.when(ok, F.struct(*[F.col(f"__seen.{c}").alias(c) for c in right_cols])).alias(out))
    unmatched = left.filter(~usable).withColumn(out, F.lit(None).cast(matched.schema[out].dataType))
    return matched.unionByName(unmatched)


def _struct_type(df: DataFrame, cols: Sequence[str]):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("__at", T.LongType())] + [T.StructField(c, df.schema[c].dataType) for c in cols])


def action_before_call(
    calls: DataFrame,
    actions: DataFrame,
    *,
    by: Sequence[str] = ("session", "tab_id"),
    call_ts: str = "started_at",
    action_ts: str = "at",
    action_id: str = "id",
    action_seq: str = "seq",
    tolerance: timedelta = timedelta(milliseconds=5000),
    chunk=None,
) -> DataFrame:
    """Last action in the tab at most ``tolerance`` before the call began."""
    out = asof_join(
        calls, actions, by=by, left_ts=call_ts, right_ts=action_ts, right_cols=[action_id], right_tie=[action_seq],
        out="__m", tolerance=tolerance, chunk=chunk,
    )
    return out.withColumn("action_id", F.col(f"__m.{action_id}")).drop("__m")


def next_state(
    calls: DataFrame,
    states: DataFrame,
    *,
    by: Sequence[str] = ("session", "tab_id", "frame_id"),
    call_ts: str = "started_at",
    state_ts: str = "captured_at",
    state_cols: Sequence[str] = ("id",),
    state_seq: str = "seq",
    out: str = "next_state",
    chunk=None,
) -> DataFrame:
    """First state captured at or after the call began, in its frame.

    Calls whose state was inferred from the top frame look there; callers set
    ``frame_id`` to 0 for those beforehand.
    """
    return asof_join(
        calls, states, by=by, left_ts=call_ts, right_ts=state_ts, right_cols=list(state_cols), right_tie=[state_seq],
        out=out, direction="forward", chunk=chunk,
    )


def state_on_screen(
    rows: DataFrame,
    states: DataFrame,
    *,
    tab: Sequence[str] = ("session", "tab_id"),
    frame: str = "frame_id",
    row_ts: str,
    state_ts: str = "captured_at",
    state_id: str = "id",
    state_seq: str = "seq",
    chunk=None,
) -> DataFrame:
    """Adds ``state_id_at_time`` and ``state_id_inferred``: own frame first, else the top frame."""
    own = asof_join(
        rows, states, by=[*tab, frame], left_ts=row_ts, right_ts=state_ts, right_cols=[state_id],
        right_tie=[state_seq], out="__own", chunk=chunk,
    )
    both = asof_join(
        own, states.filter(F.col(frame) == 0), by=tab, left_ts=row_ts, right_ts=state_ts, right_cols=[state_id],
        right_tie=[state_seq], out="__top", chunk=chunk,
    )
    own_id, top_id = F.col(f"__own.{state_id}"), F.col(f"__top.{state_id}")
    return both.withColumns(
        {
            "state_id_at_time": F.coalesce(own_id, top_id),
            "state_id_inferred": own_id.isNull() & top_id.isNotNull(),
        }
    ).drop("__own", "__top")


def window_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    prefer_by: Sequence[str] = (),
    prefer: Column | None = None,
    left_ts: str,
    right_ts: str,
    right_cols: Sequence[str],
    right_tie: Sequence[str] = (),
    before: timedelta | int,
    after: timedelta | int = 0,
    out: str = "match",
    chunk=None,
) -> DataFrame:
    """The latest right row from ``before`` earlier up to ``after`` later.

    Right rows that also agree on ``prefer_by``, or satisfy ``prefer``, win over
    the others whatever their time.
    """
    common = dict(
        left_ts=left_ts, right_ts=right_ts, right_cols=right_cols, right_tie=right_tie,
        tolerance=before, slack=after, chunk=chunk,
    )
    if not prefer_by and prefer is None:
        return asof_join(left, right, by=by, out=out, **common)
    favoured = right.filter(prefer) if prefer is not None else right
    first = asof_join(left, favoured, by=[*by, *prefer_by], out="__first", **common)
    both = asof_join(first, right, by=by, out="__any", **common)
    return both.withColumn(out, F.coalesce("__first", "__any")).drop("__first", "__any")


def action_before_download(downloads: DataFrame, actions: DataFrame, *, by=("session",), origin: str = "origin",
                           download_ts: str = "at", action_ts: str = "at", action_cols=("id",), action_seq: str = "seq",
                           before=timedelta(milliseconds=15000), after=timedelta(milliseconds=1000), chunk=None) -> DataFrame:
    """Which action a download followed; an action on its own origin wins."""
    return window_join(
        downloads, actions, by=by, prefer_by=[origin], left_ts=download_ts, right_ts=action_ts,
        right_cols=list(action_cols), right_tie=[action_seq], before=before, after=after, out="actor", chunk=chunk,
    )


def opener_of_tab(tabs: DataFrame, actions: DataFrame, *, by=("session", "tab_id"), tab_ts: str = "at",
                  action_ts: str = "at", action_cols=("id", "state_id_at_time"), action_seq: str = "seq",
                  before=timedelta(milliseconds=5000), after=timedelta(milliseconds=250), chunk=None) -> DataFrame:
    """Which action opened a tab: clicks win, then the latest."""
    return window_join(
        tabs, actions, by=by, prefer=F.col("kind") == "click", left_ts=tab_ts, right_ts=action_ts,
        right_cols=list(action_cols), right_tie=[action_seq], before=before, after=after, out="opener", chunk=chunk,
    )


def consume_hints(rows: DataFrame, hints: DataFrame, *, by=("session", "tab_id"), row_id: str = "id", row_ts: str = "at",
                  hint_id: str = "hint_id", hint_ts: str = "at", hint_cols=("hint_id",), hint_tie: Sequence[str] = ("hint_id",),
                  before=timedelta(milliseconds=15000), after=timedelta(milliseconds=1000), chunk=None) -> DataFrame:
    """Latest hint before each row; the first row to reach a hint uses it up."""
    keys = list(by)
    found = asof_join(
        rows, hints, by=by, left_ts=row_ts, right_ts=hint_ts, right_cols=list(hint_cols), right_tie=list(hint_tie),
        tolerance=before, slack=after, out="__hint", chunk=chunk,
    )
    owner = (
        found.filter(F.col("__hint").isNotNull())
        .groupBy(*keys, F.col(f"__hint.{hint_id}").alias("__hint_id"))
        .agg(F.min(F.struct(F.col(row_ts).alias("at"), F.col(row_id).alias("id"))).alias("__owner"))
        .select(*keys, F.col("__owner.id").alias(row_id), F.lit(True).alias("__owns"))
    )
    return (
        found.join(owner, [*keys, row_id], "left")
        .withColumn("hint", F.when(F.col("__owns"), F.col("__hint")))
        .drop("__hint", "__owns")
    )


def download_to_call(downloads: DataFrame, net: DataFrame, *, session: str = "session", url: str = "raw_url",
                     window=timedelta(milliseconds=15000), slack=timedelta(milliseconds=1000), chunk=None) -> DataFrame:
    """The call that fetched a file.

    For http the latest call to the same address, without its query or after
    scrubbing; for a blob the latest download-like call in the tab. Calls are
    brought down to one row per address before the join, so a popular address
    costs no more than a rare one.
    """
    last = F.max(F.struct("seq", F.col("id").alias("net_id")))
    plain = net.groupBy(F.col(session), without_query("url").alias("__plain")).agg(last.alias("__p"))
    scrubbed = (
        net.withColumn("__scrub", scrub_url("url"))
        .filter(F.col("__scrub").isNotNull())
        .groupBy(session, "__scrub")
        .agg(last.alias("__s"))
    )
    http = (
        downloads.filter(F.col("url_kind") == "http")
        .withColumns({"__plain": without_query(url), "__scrub": scrub_url(url)})
        .join(plain, [session, "__plain"], "left")
        .join(scrubbed, [session, "__scrub"], "left")
        .withColumn("net_id", F.greatest("__p", "__s")["net_id"])
        .drop("__plain", "__scrub", "__p", "__s")
    )
    other = downloads.filter(~F.col("url_kind").eqNullSafe("http"))
    blobs = asof_join(
        other, net.filter(F.col("is_download")), by=[session, "tab_id"], left_ts="at", right_ts="started_at",
        right_cols=["id"], right_tie=["seq"], tolerance=window, slack=slack, out="__m", chunk=chunk,
    )
    blobs = blobs.withColumn("net_id", F.when(F.col("url_kind") == "blob", F.col("__m.id"))).drop("__m")
    return http.unionByName(blobs)


def href_to_route(items: DataFrame, routes: DataFrame, *, by: Sequence[str] = (), href: str = "href", route: str = "route") -> DataFrame:
    """Links joined to the routes they open: equal but for a trailing slash, or by fragment.

    Two equi joins: on the trimmed text, and for bare fragments on every tail of
    the route that starts with ``#``. ``by`` keeps sites apart.
    """
    left = items.filter(F.col(href) != "").withColumn("__key", trim_route(href))
    r = routes.filter(F.col(route) != "").withColumn("__trim", trim_route(route))
    whole = r.withColumn("__key", F.col("__trim"))
    marks = F.split("__trim", "#", -1)
    tails = F.transform(
        F.sequence(F.lit(2), F.size(marks)),
        lambda i: F.concat(F.lit("#"), F.array_join(F.slice(marks, i, F.size(marks)), "#")),
    )
    tail = r.filter(F.col("__trim").contains("#") & ~F.col("__trim").startswith("#")).withColumn("__key", F.explode(tails))
    by_tail = tail.filter(F.length("__key") > 1)
    return left.join(whole.unionByName(by_tail).drop("__trim"), [*by, "__key"]).drop("__key")


def menu_item_of_action(actions: DataFrame, menu: DataFrame, *, by: Sequence[str] = ("origin",)) -> DataFrame:
    """``(by…, session, action_id, menu_id)``: by menu path; by selector only where the path names no known item."""
    from ..functions.urls import menu_id

    ids_of = list(dict.fromkeys([*by, "session"]))
    keyed = actions.withColumns({"__mid": menu_id(F.col("menu_path")), "__sel": F.col("selectors.primary")})
    ids = menu.select(*by, F.col("menu_id").alias("__mid")).distinct()
    by_path = keyed.filter(F.col("__mid") != "").join(ids, [*by, "__mid"]).select(*ids_of, F.col("id").alias("action_id"), F.col("__mid").alias("menu_id"))
    rest = keyed.join(ids, [*by, "__mid"], "left_anti").filter(F.coalesce("__sel", F.lit("")) != "")
    by_selector = rest.join(
        menu.filter(F.coalesce("selector", F.lit("")) != "").select(*by, F.col("selector").alias("__sel"), "menu_id"), [*by, "__sel"]
    ).select(*ids_of, F.col("id").alias("action_id"), "menu_id")
    return by_path.unionByName(by_selector)


def drop_across_pause(
    edges: DataFrame,
    timeline: DataFrame,
    *,
    by: Sequence[str] = ("session",),
    from_ts: str = "from_at",
    to_ts: str = "to_at",
    event_ts: str = "at",
    chunk=None,
) -> DataFrame:
    """Edges with no timeline event strictly between their two times.

    The last event before the end is enough to know. Times that are missing
    never make a gap.
    """
    marked = asof_join(
        edges, timeline.withColumn("__ev", F.col(event_ts)), by=by, left_ts=to_ts, right_ts="__ev", right_cols=["__ev"],
        out="__gap", strict=True, chunk=chunk,
    )
    crosses = F.col(from_ts).isNotNull() & (F.col("__gap.__ev") > F.col(from_ts))
    return marked.filter(~F.coalesce(crosses, F.lit(False))).drop("__gap")
