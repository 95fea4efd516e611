"""Personal data in whole texts, with built-in functions alone.

Regular expressions propose spans. Check sums confirm them: Luhn for cards, the
remainder by 97 for bank accounts; ranges and digit counts do the same for
addresses and phones. Words shortly before a span raise its score. The base kinds
(email, ip, card, phone) stay whatever their score; the kinds that this method adds
(iban, ssn) need ``KEEP``.

A place in the text is the length of all gaps and matches before it: the text split
by a pattern gives the gaps, so no step counts characters one by one.

Null text: empty. Empty text: no spans. Null ids, ties and repeated rows: every row
is judged for itself. Empty table: no rows. Extra columns are kept by ``redact`` and
dropped by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the kinds, in the order of the results. Each finds what its plain form finds:
#: runs are taken whole (``++``) and entered at their start alone, so long runs cost no more than short ones.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+(?![A-Za-z0-9])|(?:\x20[A-Z0-9]{4}(?![A-Za-z0-9]))++(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9]))?+)",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
}
KINDS = list(PATTERNS)
BASE = KINDS[:4]
#: What a text must hold for a kind to be looked for; cheaper than the pattern.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a confirmed span without context.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
#: Words that speak for a kind, and how far before the span they may begin.
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|pay", "phone": "phone|call|tel|mobile",
    "iban": "iban|account|bank", "ssn": "ssn|social|security",
}
NEAR = 40
#: Added by a context word, and the least score of added kinds.
RAISE, KEEP = 0.2, 0.5

_SPAN = "struct<start:bigint,kind_no:int,end:bigint,kind:string,score:double>"


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("double") <= 255, F.lit(False)))
    if kind == "card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        moved = F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))
        number = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(F.length(c) == 0, a).otherwise((a * F.when(number(c) > 9, 100).otherwise(10) + number(c)) % 97))
        return rest == 1
    return F.lit(True)


def _grouped_ibans(value: Column) -> Column:
    """Offsets and lengths of the account numbers in a run of groups of four: the longest confirmed one from each group that may begin one.

    Capitals that follow a number are taken with it when they pass the remainder too, one time in 97.
    """
    groups = F.split(value, " ")

    def longest(i: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(1), F.least(F.size(groups) - i + 1, F.lit(9))), lambda n: (
            F.length(F.array_join(F.slice(groups, i, n), "")).between(15, 34) & _confirmed("iban", F.array_join(F.slice(groups, i, n), ""))))
        return F.struct(((i - 1) * 5).alias("offset"), F.length(F.array_join(F.slice(groups, i, F.coalesce(F.array_max(sizes), F.lit(0))), " ")).alias("length"))

    heads = F.filter(F.sequence(F.lit(1), F.size(groups)), lambda i: F.element_at(groups, i).rlike("^[A-Z]{2}[0-9]{2}"))
    return F.filter(F.transform(heads, longest), lambda x: x["length"] > 0)


def _spans(kind: str, text: Column, found: Column) -> Column:
    """Confirmed spans of a kind from its matches."""
    gaps = F.split(text, PATTERNS[kind], -1)
    empty = F.array().cast(f"array<{_SPAN}>")

    def step(state: Column, i: Column) -> Column:
        value = F.element_at(found, i)
        start = state["at"] + F.length(F.element_at(state["gaps"], i))
        end = start + F.length(value)

        def span(a: Column, b: Column) -> Column:
            return F.struct(a.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), b.cast("long").alias("end"), F.lit(kind).alias("kind"), F.lit(SCORES[kind]).alias("score"))

        if kind == "iban":
            new = F.transform(_grouped_ibans(value), lambda x: span(start + x["offset"], start + x["offset"] + x["length"]))
        else:
            new = F.when(_confirmed(kind, value), F.array(span(start, end))).otherwise(empty)
        kept = F.concat(state["kept"], new)
        return F.struct(end.cast("long").alias("at"), state["gaps"].alias("gaps"), kept.alias("kept"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), gaps.alias("gaps"), empty.alias("kept"))
    all_ = F.aggregate(F.sequence(F.lit(1), F.size(found)), begin, step, lambda s: s["kept"])
    return F.when(F.size(found) > 0, all_).otherwise(empty)


def _scored(text: Column, kind: str, spans: Column) -> Column:
    def raised(s: Column) -> Column:
        from_ = F.greatest(s["start"] - NEAR, F.lit(0))
        before = F.lower(text.substr((from_ + 1).cast("int"), (s["start"] - from_).cast("int")))
        return s.withField("score", F.least(F.lit(1.0), s["score"] + F.when(before.rlike(CONTEXT[kind]), RAISE).otherwise(0.0)))

    return F.transform(spans, raised)


def with_spans(docs: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """``docs`` with an array of spans: start, kind_no, end, kind, score, sorted by start and kind.

    Names that begin with ``_pii_`` are taken.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    found = docs.select("*", whole.alias("_pii_text"))
    found = found.select("*", *[
        (F.when(F.contains("_pii_text", F.lit(NEEDS[k])), F.regexp_extract_all("_pii_text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none) if k in NEEDS else F.regexp_extract_all("_pii_text", F.lit(PATTERNS[k]), F.lit(0))).alias(f"_pii_{k}")
        for k in KINDS
    ])
    placed = found.select("*", *[_spans(k, F.col("_pii_text"), F.col(f"_pii_{k}")).alias(f"_pii_{k}_s") for k in KINDS])
    kept = [_scored(F.col("_pii_text"), k, F.col(f"_pii_{k}_s")) for k in KINDS]
    kept = [s if k in BASE else F.filter(s, lambda x: x["score"] >= KEEP) for k, s in zip(KINDS, kept)]
    every = F.array_sort(F.concat(*kept))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns if c != to], every.alias(to))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of each text."""
    return with_spans(docs.select("doc_id", "text")).select("doc_id", "spans")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span, or run of overlapping ones, written as the kind of its first in brackets; ``n_chars``, if there, follows."""
    marked = with_spans(docs, to="_pii_spans")
    text = F.col("text")

    def step(state: Column, s: Column) -> Column:
        more = F.concat(state["out"], text.substr((state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], more).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("_pii_spans", begin, step, lambda s: F.concat(s["out"], text.substr((s["at"] + 1).cast("int"), F.length(text))))
    out = marked.withColumn("text", F.when(F.size("_pii_spans") > 0, clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_pii_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, and spans as text."""
    def said(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = [of(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _sql_kind(kind: str, pattern: str, test: str) -> str:
    return f"""
  SELECT rid, '{kind}' AS kind, {KINDS.index(kind)} AS kind_no, at_ AS s, at_ + length(v) AS e, v, lower(substr(text, greatest(at_ - {NEAR}, 0) + 1, at_ - greatest(at_ - {NEAR}, 0))) AS near_
  FROM (SELECT rid, text, m[i] AS v, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS at_
    FROM (SELECT rid, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, text, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM t)))
  WHERE {test}"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN cast(reverse({_DIGITS})[i] AS INT) ELSE (2 * cast(reverse({_DIGITS})[i] AS INT)) // 10 + (2 * cast(reverse({_DIGITS})[i] AS INT)) % 10 END)) % 10 = 0"
_MOD97 = "list_reduce(list_prepend(0, list_transform(range(1, length(v) + 1), lambda i: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (substr(v, 5) || substr(v, 1, 4))[i]) - 1)), lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1"
_PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda p: coalesce(try_cast(p AS DOUBLE) <= 255, false))) = 4"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
    "iban": (r"[A-Za-z0-9]+", f"regexp_full_match(v, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND {_MOD97}"),
    "ssn": (r"[A-Za-z0-9-]+", f"regexp_full_match(v, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND regexp_matches(near_, '{CONTEXT['ssn']}')"),
}
#: The query in DuckDB, with the kinds' plain patterns.
ORACLE_SQL = f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(_sql_kind(k, *_PLAIN[k]) for k in KINDS)}),
a AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (kind_no < {len(BASE)}), '') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS spans FROM f GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN a USING (rid)"""
