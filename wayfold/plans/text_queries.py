"""Queries on text: redaction, leak audits, danger words, credentials, bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import packs as K
from ..functions import pyrules as Y
from ..functions import redaction as R
from ..operators import redact as X
from .tables import dealt_table, table, text_table

#: The first five generic rules use no look-around, so SQL can say them too.
TOKEN_RULES = 5
PROBES = {"email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "bearer": r"Bearer\s+[A-Za-z0-9._~+/=-]+", "hex_secret": r"[0-9a-f]{40}"}


def _tokens(c):
    for rule in K.text_rules(("generic",))[:TOKEN_RULES]:
        c = R.apply_rule(c, rule)
    return c


def scrub_tokens(spark, sf):
    d = text_table(spark, sf, "documents")
    return d.select("doc_id", F.md5(_tokens(F.col("text"))).alias("digest"), F.length(_tokens(F.col("text"))).alias("n_chars"))


def scrub_text(spark, sf):
    d = R.scrub_text(text_table(spark, sf, "documents"), ["text"], ("generic", "india"))
    return d.select("doc_id", "text", R.has_placeholder("text").alias("scrubbed"))


def redaction_counts(spark, sf):
    counted = R.redaction_counts(text_table(spark, sf, "documents"), "text", ("generic", "india"))
    names = [c for c in counted.columns if c.startswith("n_") and c != "n_chars"]
    return counted.groupBy("source").agg(*[F.sum(c).alias(c) for c in names])


def token_counts(spark, sf):
    counted = R.redaction_counts(text_table(spark, sf, "documents"), "text")
    names = ["n_jwt", "n_bearer", "n_secret_key", "n_google_key", "n_email"]
    return counted.groupBy("source").agg(*[F.sum(c).cast("bigint").alias(c) for c in names])


def placeholder_report(spark, sf):
    d = text_table(spark, sf, "documents")
    return d.select("lang", R.has_placeholder(_tokens(F.col("text"))).alias("hit")).groupBy("lang").agg(F.sum(F.col("hit").cast("int")).cast("bigint").alias("n_docs"))


def leak_audit(spark, sf):
    """Known secrets before and after the token rules."""
    d = text_table(spark, sf, "documents")
    audit = X.leak_audit({"raw": (d, ["text"]), "clean": (d.select(_tokens(F.col("text")).alias("text")), ["text"])}, PROBES)
    return audit.select("source", "probe", F.col("n_rows").cast("bigint").alias("n_rows"), F.col("n_hits").cast("bigint").alias("n_hits"))


def leak_audit_conversations(spark, sf):
    c = text_table(spark, sf, "conversations")
    audit = X.leak_audit({"conversations": (R.scrub_text(c, ["text"]), ["text"])}, PROBES)
    return audit.select("source", "probe", F.col("n_rows").cast("bigint").alias("n_rows"), F.col("n_hits").cast("bigint").alias("n_hits"))


def scrub_by_language(spark, sf):
    """Packs named per row: the India pack runs for English text only."""
    d = text_table(spark, sf, "documents")
    packs = F.when(F.col("lang") == "en", F.array(F.lit("generic"), F.lit("india"))).otherwise(F.array(F.lit("generic")))
    return d.select("doc_id", R.scrub_for_packs("text", packs).alias("text"))


def danger_words(spark, sf):
    c = text_table(spark, sf, "conversations")
    return c.select("role", N.is_danger("text", words=("que", "the", "pour", "und")).alias("hit")).groupBy("role").agg(F.sum(F.col("hit").cast("int")).alias("n_hits"), F.count(F.lit(1)).alias("n"))


def danger_words_ascii(spark, sf):
    """Whole-word hits where SQL can say them: words parted by blanks."""
    c = text_table(spark, sf, "conversations")
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), "[^a-z]+", " "), F.lit(" "))
    return c.select("role", N.is_danger(padded, words=("the", "and")).alias("hit")).groupBy("role").agg(F.sum(F.col("hit").cast("int")).cast("bigint").alias("n_hits"))


def credential_controls(spark, sf):
    c = table(spark, sf, "customer").select(F.explode(F.array(F.concat(F.lit("userPin"), "c_custkey"), F.concat(F.lit("pinCode"), "c_custkey"), F.concat(F.lit("Enter the OTP "), "c_custkey"), F.lit("address1"))).alias("label"))
    return c.groupBy(F.regexp_replace("label", "[0-9]+", "").alias("label"), R.is_credential(F.lit("text"), "label").alias("credential")).agg(F.count(F.lit(1)).alias("n"))


def scrub_bodies(spark, sf):
    """JSON bodies of customers, every other one cut before its end, read by key and pattern."""
    c = dealt_table(spark, sf, "customer")
    key = F.col("c_custkey")
    body = F.to_json(F.struct(
        F.col("c_name").alias("customerName"), key.alias("id"), F.concat(F.lit("write to user"), key.cast("string"), F.lit("@ex.org in "), F.col("c_mktsegment")).alias("remark"),
        (key + 1700000000).alias("createdOn"), F.concat(F.lit("statement "), key.cast("string"), F.lit(".PDF")).alias("attachment"), F.struct(F.col("c_mktsegment").alias("line")).alias("address")))
    return c.select("c_custkey", Y.scrub_json(F.when(key % 2 == 1, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)).alias("body"))


def learned_values(spark, sf):
    """Names given away by a key, removed from free text of the same document."""
    c = table(spark, sf, "customer").withColumn("doc", F.col("c_nationkey"))
    bodies = c.select("doc", F.col("c_custkey").alias("seq"), F.to_json(F.struct(F.concat(F.lit("Person "), "c_name").alias("fullName"))).alias("body"))
    learned = X.learned_values(bodies, "body", doc=["doc"], order="seq")
    notes = c.select("doc", "c_custkey", F.concat(F.lit("order for person "), "c_name", F.lit(".")).alias("note"))
    return X.scrub_learned(notes, "note", learned, doc=["doc"]).select("c_custkey", "note")


def sanitised_pages(spark, sf):
    p = text_table(spark, sf, "pages")
    clean = p.select("page_id", Y.sanitise_html("html").alias("html"))
    return clean.select("page_id", F.length("html").alias("n_chars"), F.col("html").contains("<!--").alias("has_comment"), F.col("html").contains("track(0)").alias("has_script"))


def sanitised_marks(spark, sf):
    """Comments and scripts are gone from every page."""
    return sanitised_pages(spark, sf).select("page_id", F.col("has_comment").cast("int").alias("has_comment"), F.col("has_script").cast("int").alias("has_script"))


QUERIES = {
    "scrub_tokens": scrub_tokens, "scrub_text": scrub_text, "redaction_counts": redaction_counts, "token_counts": token_counts, "placeholder_report": placeholder_report, "leak_audit": leak_audit,
    "leak_audit_conversations": leak_audit_conversations, "scrub_by_language": scrub_by_language, "danger_words": danger_words, "danger_words_ascii": danger_words_ascii,
    "credential_controls": credential_controls, "scrub_bodies": scrub_bodies, "learned_values": learned_values, "sanitised_pages": sanitised_pages, "sanitised_marks": sanitised_marks,
}

_RULES = [
    (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?", "<JWT>"), (r"Bearer[\s\p{Z}]+[A-Za-z0-9._~+/=-]+", "Bearer <TOKEN>"), (r"\bsk-[A-Za-z0-9]{16,}\b", "<TOKEN>"),
    (r"\bAIza[0-9A-Za-z_-]{20,}\b", "<TOKEN>"), (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<EMAIL>"),
]


def _sql_tokens(c: str, upto: int = 5) -> str:
    for pattern, replacement in _RULES[:upto]:
        c = f"regexp_replace({c}, '{pattern}', '{replacement}', 'g')"
    return c


_HITS = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_AUDIT = lambda src, rel, c: " UNION ALL ".join(
    f"SELECT '{src}' AS source, '{n}' AS probe, CAST(sum(CASE WHEN {_HITS(c, p)} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_rows, CAST(sum({_HITS(c, p)}) AS BIGINT) AS n_hits FROM {rel}" for n, p in PROBES.items())

ORACLE = {
    "scrub_tokens": f"SELECT doc_id, md5({_sql_tokens('text')}) AS digest, length({_sql_tokens('text')}) AS n_chars FROM documents",
    "token_counts": "SELECT source, " + ", ".join(f"CAST(sum({_HITS(_sql_tokens('text', i), _RULES[i][0])}) AS BIGINT) AS {n}" for i, n in enumerate(["n_jwt", "n_bearer", "n_secret_key", "n_google_key", "n_email"])) + " FROM documents GROUP BY 1",
    "placeholder_report": f"SELECT lang, CAST(sum(CASE WHEN regexp_matches({_sql_tokens('text')}, '<[A-Z][A-Z0-9_]*>') THEN 1 ELSE 0 END) AS BIGINT) AS n_docs FROM documents GROUP BY 1",
    "leak_audit": _AUDIT("raw", "documents", "text") + " UNION ALL " + _AUDIT("clean", "documents", _sql_tokens("text")),
    "danger_words_ascii": "SELECT role, CAST(sum(CASE WHEN regexp_matches(' ' || regexp_replace(lower(text), '[^a-z]+', ' ', 'g') || ' ', ' (the|and) ') THEN 1 ELSE 0 END) AS BIGINT) AS n_hits FROM conversations GROUP BY 1",
    "scrub_bodies": """SELECT c_custkey, '{"customerName":"<NAME>","id":' || c_custkey || ',"remark":"write to <EMAIL> in ' || c_mktsegment || '","createdOn":' || (c_custkey + 1700000000) || ',"attachment":"<FILE>.pdf","address":{"line":"' || CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment || '"}' ELSE '<ADDRESS>"}}' END AS body FROM customer""",
    "credential_controls": "SELECT label, label NOT IN ('pinCode', 'address') AS credential, count(*) AS n FROM (SELECT unnest(['userPin', 'pinCode', 'Enter the OTP ', 'address']) AS label FROM customer) GROUP BY ALL",
    # 1 500 names a nation at sf 0.1: each is learned, none is left in a note
    "learned_values": "SELECT c_custkey, 'order for <NAME>.' AS note FROM customer",
    "sanitised_marks": "SELECT page_id, 0 AS has_comment, 0 AS has_script FROM pages",
}
