"""Names, labels and display text as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .exprs import SPACE, as_col, replace_matches, squeeze, strip, text
from .urls import split_extension

# ---- fixed values: words that cannot be identifiers in generated code -------
RESERVED_WORDS = (
    "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum",
    "export", "extends", "false", "finally", "for", "function", "if", "import", "in", "instanceof", "new", "null",
    "return", "super", "switch", "this", "throw", "true", "try", "typeof", "var", "void", "while", "with", "yield",
    "let", "static", "await", "async",
)


def slugify(c: Column | str, limit: int = 40) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")
    return F.regexp_replace(F.substring(s, 1, limit), r"-+\z", "")


def state_stem(seq: Column | str, title: Column | str, pathname: Column | str) -> Column:
    """``0007-step-two``: padded sequence and a slug of the title, else of the path."""
    source = F.when(strip(text(title)) != "", text(title)).otherwise(text(pathname))
    slug = F.coalesce(F.nullif(slugify(source), F.lit("")), F.nullif(slugify(pathname), F.lit("")), F.lit("page"))
    return F.concat(padded(seq, 4), F.lit("-"), slug)


def padded(n: Column | str, width: int) -> Column:
    """Zero-padded number that grows past ``width`` when it has to."""
    s = as_col(n).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def host_slug(origin: Column | str) -> Column:
    from .urls import origin_of

    host = F.regexp_replace(F.regexp_extract(origin_of(origin), P.URL, 2), "(?i)[^a-z0-9.-]+", "-")
    return F.coalesce(F.lower(host), F.nullif(slugify(origin), F.lit("")), F.lit("site"))


def identifier(c: Column | str) -> Column:
    """A name usable in code: camelCase, never a reserved word, never a leading digit."""
    words = F.filter(F.split(strip(F.regexp_replace(text(c), "[^A-Za-z0-9]+", " ")), " ", -1), lambda w: w != "")
    cased = F.transform(
        words,
        lambda w, i: F.when(i == 0, F.lower(w)).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
        ),
    )
    camel = F.array_join(cased, "")
    safe = F.when(camel.rlike("^[0-9]"), F.concat(F.lit("_"), camel)).when(camel == "", "_").otherwise(camel)
    return F.when(safe.isin(*RESERVED_WORDS), F.concat(F.lit("_"), safe)).otherwise(safe)


def name_shape(path: Column | str) -> Column:
    """A file name with the name taken out: ``A{2}9{4}.pdf``. Folders are dropped."""
    base = F.regexp_extract(text(path), r"([^\\/]*)\z", 1)
    part = split_extension(base)

    def run(m: Column) -> Column:
        return F.concat(F.when(m.rlike(r"^\p{N}"), "9").otherwise("A"), F.format_string("{%d}", F.length(m)))

    shape = replace_matches(part["stem"], r"[\p{L}\p{M}]+|\p{N}+", run)
    return F.concat(shape, F.coalesce(F.concat(F.lit("."), part["ext"]), F.lit("")))


def file_extension(path: Column | str) -> Column:
    return split_extension(F.regexp_extract(text(path), r"([^\\/]*)\z", 1))["ext"]


def truncate_body(c: Column | str, limit: int) -> Column:
    """Cut to ``limit`` characters and say how many went."""
    v = as_col(c)
    cut = F.concat(F.substring(v, 1, limit), F.format_string("…[+%d chars]", F.length(v) - limit))
    return F.when(F.length(v) > limit, cut).otherwise(v)


def format_of(c: Column | str) -> Column:
    """First matching value format; long text is just text."""
    v = text(c)
    s = strip(v)
    out = F.lit("text")
    for name, pattern in reversed(P.VALUE_FORMATS):
        out = F.when(s.rlike(pattern), name).otherwise(out)
    return F.when(F.length(v) > 300, "text").otherwise(out)


def word_pattern(words: Sequence[str]) -> str:
    """Whole words in any script, upper or lower case."""
    import re

    # Not re.escape: that would also escape blanks, which Java rejects nowhere but reads poorly.
    special = re.compile(r"[.*+?^${}()|\[\]\\]")
    alternatives = "|".join(special.sub(lambda m: "\\" + m.group(), w) for w in words if w.strip())
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{alternatives})(?![\p{{L}}\p{{N}}])" if alternatives else r"\z\A."


def is_danger(
    label: Column | str,
    submits_form: Column | str | None = None,
    words: Sequence[str] = P.DANGER_WORDS,
) -> Column:
    """Submits a form, or carries a danger word as a whole word."""
    submits = F.lit(False) if submits_form is None else F.coalesce(as_col(submits_form), F.lit(False))
    return submits | text(label).rlike(word_pattern(words))


def classify_id(element_id: Column | str) -> Column:
    """Why an element id looks generated, NULL when it looks authored."""
    i = text(element_id)
    return (
        F.when(i == "", "empty id")
        .when(i.rlike(P.GENERATED_ID_PREFIX), "id has a framework prefix")
        .when(i.rlike(P.UUID), "id is a UUID")
        .when(i.rlike(P.ID_HASH), "id looks like a hash")
        .when(i.rlike(P.ID_COUNTER), "id ends in a bare counter")
    )


def looks_random(element_id: Column | str) -> Column:
    """Eight or more letters and digits, with digits that are not merely trailing."""
    i = text(element_id)
    head = F.regexp_replace(i, r"[0-9]+\z", "")
    return i.rlike(r"^[A-Za-z0-9]{8,}\z") & head.rlike("[0-9]") & head.rlike("[A-Za-z]")


# ------------------------------------------------------------- display text


def cell(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.replace(text(c), F.lit("|"), F.lit("\\|")), f"{SPACE}+", " "))


def shorten(c: Column | str, limit: int) -> Column:
    v = text(c)
    return F.when(F.length(v) > limit, F.concat(F.substring(v, 1, limit - 1), F.lit("…"))).otherwise(v)


def quoted(c: Column | str, limit: int = 80) -> Column:
    return F.concat(F.lit('"'), F.replace(cell(shorten(c, limit)), F.lit('"'), F.lit("'")), F.lit('"'))


def code(c: Column | str) -> Column:
    """A code span; back-ticks in the text widen the fence."""
    t = strip(squeeze(text(c)))
    longest = F.array_max(F.transform(F.regexp_extract_all(t, F.lit("`+"), F.lit(0)), lambda m: F.length(m)))
    fence = F.repeat(F.lit("`"), F.coalesce(longest, F.lit(0)) + 1)
    pad = F.when(t.startswith("`") | t.endswith("`"), " ").otherwise("")
    return F.when(t == "", "``").otherwise(F.concat(fence, pad, t, pad, fence))


def human_bytes(n: Column | str) -> Column:
    v = as_col(n).cast("double")
    return (
        F.when(v.isNull() | (v < 0), "size unknown")
        .when(v < 1024, F.concat(v.cast("long").cast("string"), F.lit(" B")))
        .when(v < 1024 * 1024, F.concat(F.floor(v / 1024 + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", v / 1024 / 1024), F.lit(" MB")))
    )


def human_duration(ms: Column | str) -> Column:
    v = as_col(ms).cast("double")
    return (
        F.when(v < 60000, F.concat(F.greatest(F.lit(1), F.floor(v / 1000 + 0.5)).cast("string"), F.lit(" seconds")))
        .when(v < 3600000, F.concat(F.floor(v / 60000 + 0.5).cast("string"), F.lit(" minutes")))
        .otherwise(F.concat(F.format_string("%.1f", v / 3600000), F.lit(" hours")))
    )


def is_length_only(label: Column | str) -> Column:
    """A label of which only the length was kept."""
    return strip(text(label)).rlike(r"^<[0-9]+ chars>\z")


def action_phrase(a: Column) -> Column:
    """What the user did, in words. ``a`` is an action struct."""
    label = strip(text(a["label"]))
    menu = F.coalesce(a["menu_path"], F.array().cast("array<string>"))
    group, lst = text(a["view_group"]), text(a["list_selector"])
    paging = F.coalesce(a["pagination"], F.lit(False))
    role = text(a["pagination_role"])
    chosen, control = text(a["chosen"]), text(a["control_key"])
    primary = text(a["selectors"]["primary"])
    opens_item = (lst != "") & is_length_only(label) & ~paging & (group == "")
    where = F.array_compact(
        F.array(
            F.when(F.size(menu) > 0, F.concat(F.lit("menu: "), F.array_join(F.transform(menu, cell), " > "))),
            F.when(group != "", F.concat(F.lit("view group "), quoted(group, 40))),
            F.when(paging, F.concat(F.lit("pagination"), F.when(role != "", F.concat(F.lit(": "), role)).otherwise(""))),
            F.when((lst != "") & ~opens_item, F.concat(F.lit("inside list "), code(lst))),
            F.when(F.coalesce(a["download"], F.lit(False)), F.lit("download link")),
            F.when(text(a["target"]) == "_blank", F.lit("opens a new tab")),
            F.when(F.coalesce(a["danger"], F.lit(False)), F.lit("**flagged danger**")),
        )
    )
    tail = F.when(F.size(where) > 0, F.concat(F.lit(" ("), F.array_join(where, "; "), F.lit(")"))).otherwise("")
    what = F.when(control != "", code(control)).when(label != "", quoted(label)).otherwise("a control")
    changed = F.concat(F.lit("changing "), what, F.when(chosen != "", F.concat(F.lit(" to "), quoted(chosen))).otherwise(""), tail)
    item = F.concat(
        F.lit("opening an item of the list "), code(lst), F.lit(" (its text was withheld; "), label, F.lit(" is only its length)"), tail
    )
    target = (
        F.when((label != "") & ~is_length_only(label), quoted(label))
        .when(primary != "", code(primary))
        .otherwise("an unlabelled element")
    )
    return F.when(a["kind"] == "change", changed).when(opens_item, item).otherwise(F.concat(F.lit("clicking "), target, tail))
