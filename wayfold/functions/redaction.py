"""Redaction as column expressions: pattern rules, credentials, placeholders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packs as K
from . import patterns as P
from .exprs import as_col, let, replace_matches, squeeze, text


def _luhn_card(rule: K.TextRule, match: Column) -> Column:
    digits = F.regexp_replace(match, "[ -]", "")
    real = F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    return F.when(real, rule.replacement).otherwise(match)


def apply_rule(c: Column, rule: K.TextRule) -> Column:
    if rule.check == "luhn":
        return let(c, lambda t: replace_matches(t, rule.pattern, lambda m: _luhn_card(rule, m)))
    return F.regexp_replace(c, rule.pattern, rule.replacement)


def rule_hits(c: Column, rule: K.TextRule) -> Column:
    """How many times a rule replaces something in ``c``."""
    if rule.check == "luhn":
        digits = F.transform(F.regexp_extract_all(c, F.lit(rule.pattern), F.lit(0)), lambda m: F.regexp_replace(m, "[ -]", ""))
        real = F.filter(digits, lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))
        return F.size(real)
    return F.regexp_count(c, F.lit(rule.pattern))


def scrub_expr(c: Column | str, packs: Sequence[str] | None = ("generic",)) -> Column:
    """Every text rule of the packs, in order; the text itself where ``packs`` is None. NULL stays NULL."""
    out = as_col(c)
    if packs is None:
        return out
    for rule in K.text_rules(packs):
        out = apply_rule(out, rule)
    return out


def scrub_text(df: DataFrame, columns: Sequence[str], packs: Sequence[str] = ("generic",)) -> DataFrame:
    """Scrub text columns in place."""
    return df.withColumns({name: scrub_expr(name, packs) for name in columns})


def redaction_counts(df: DataFrame, column: str, packs: Sequence[str] = ("generic",)) -> DataFrame:
    """Adds one ``n_<rule>`` column per rule: hits after the earlier rules ran."""
    work = "__scrubbing"
    out = df.withColumn(work, F.coalesce(F.col(column), F.lit("")))
    for rule in K.text_rules(packs):
        name = "n_" + rule.name.replace("-", "_")
        out = out.withColumn(name, rule_hits(F.col(work), rule))
        # Text a rule does not touch is not searched a second time.
        out = out.withColumn(work, F.when(F.col(name) > 0, apply_rule(F.col(work), rule)).otherwise(F.col(work)))
    return out.drop(work)


def packs_for_origin(origin: Column | str, manual: Sequence[str] = ()) -> Column:
    """Packs in force for an origin: generic, those its host suffix turns on, manual ones."""
    host = F.regexp_replace(F.regexp_extract(text(origin), P.URL, 2), r":\d*\z", "")
    auto = [F.when(host.endswith(suffix), F.lit(name)) for suffix, name in K.packs_by_host()]
    return F.array_distinct(F.array_compact(F.array(F.lit("generic"), *auto, *[F.lit(m) for m in manual])))


def _only_where(packs: Column, name: str):
    rules = [r for p in K.active_packs((name,)) if p.name == name for r in p.rules]

    def choose(t: Column) -> Column:
        scrubbed = t
        for rule in rules:
            scrubbed = apply_rule(scrubbed, rule)
        return F.when(F.array_contains(packs, name), scrubbed).otherwise(t)

    return choose


def scrub_for_packs(c: Column | str, packs: Column, optional: Sequence[str] = ("india",)) -> Column:
    """Scrub with the packs named per row; each optional pack runs only where it is named."""
    out = scrub_expr(c, ("generic",))
    for name in optional:
        out = let(out, _only_where(packs, name))
    return out


def redact_value(value: Column | str) -> Column:
    """Length kept, content dropped: ``<n chars>``, empty for nothing."""
    v = text(value)
    return F.when(v == "", "").otherwise(F.format_string("<%d chars>", F.length(v)))


def is_credential(input_type: Column | str, *probes: Column | str) -> Column:
    """Password fields and controls whose id, name or label says credential."""
    hit = F.lower(text(input_type)) == "password"
    for p in probes:
        t = text(p)
        hit = hit | t.rlike(K.CREDENTIAL_NAME) | t.rlike(K.CREDENTIAL_CAMEL_PIN)
    return hit


def has_placeholder(c: Column | str) -> Column:
    """Text that holds a redaction placeholder such as ``<PAN>``."""
    return text(c).rlike(P.PLACEHOLDER)


def label_rule(label: Column | str, packs: Sequence[str] = ("generic",)) -> Column:
    """Replacement for the value after a label, NULL when the label names nothing personal."""
    t = F.regexp_replace(F.regexp_replace(squeeze(text(label)), r"[\s:*：]+\z", ""), r"^[\s*]+", "")
    out = F.lit(None).cast("string")
    for rule in reversed(K.label_rules(packs)):
        out = F.when(t.rlike(rule.pattern), rule.replacement).otherwise(out)
    return F.when((t != "") & (F.length(t) <= 60), out)


def hint_rule(element_id: Column | str, classes: Column | str, packs: Sequence[str] = ("generic",)) -> Column:
    """Replacement for what an element holds, judged by its id and classes."""
    probe = F.trim(F.concat_ws(" ", text(element_id), text(classes)))
    out = F.lit(None).cast("string")
    for rule in reversed(K.hint_rules(packs)):
        out = F.when(probe.rlike(rule.pattern), rule.replacement).otherwise(out)
    return F.when(probe != "", out)
