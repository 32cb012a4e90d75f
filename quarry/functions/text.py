"""Scalar text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is an identifier that stands alone, or a run of ASCII letters and digits.
IDENTIFIER = r"cve-\d{4}-\d{4,}|cwe-\d+|t\d{4}(?:\.\d{3})?|(?:ta|[gsmc])\d{4}"
TOKEN = rf"((?<![a-z0-9])(?:{IDENTIFIER})(?![a-z0-9])|[a-z0-9]+)"
# Words that a question's phrasing adds.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "has", "have", "how", "in", "is", "it", "its", "of", "on", "or",
    "that", "the", "this", "to", "was", "what", "which", "who", "with",
)
# Technique and vulnerability ids, citation markers, Markdown targets.
TECHNIQUE = r"\bT\d{4}(?:\.\d{3})?\b"
CVE = r"(?i)CVE-\d{4}-\d{4,7}"
MARKER = r"\[(\d{1,2})\]"
MARKDOWN_URL = r"!?\[[^\]]*\]\((https?://[^)\s]+)\)"
# Title words that say nothing about a subject.
TOPIC_STOP_WORDS = ("with", "from", "that", "this", "into", "over", "their", "them", "using", "used", "have")


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind (trim() knows blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def search_tokens(text: Column) -> Column:
    """Tokens for lexical search: identifiers whole, the rest by runs of letters and digits, lower case, without stop words.

    Only A-Z are lowered, and before matching: other letters part tokens, whatever their lower case.
    """
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(1)), lambda t: ~t.isin(*STOP_WORDS))


def plain_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def technique_ids(text: Column) -> Column:
    """Identifiers of techniques, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({TECHNIQUE})"), F.lit(1)))


def mentioned_cves(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({CVE})"), F.lit(1)), F.upper))


def markdown_urls(text: Column) -> Column:
    """Targets of Markdown links and images, as a client that renders them would fetch them."""
    return F.regexp_extract_all(text, F.lit(MARKDOWN_URL), F.lit(1))


def host(url: Column) -> Column:
    """The host that an address leads to, lower case: after the last @ of what stands before the path (a backslash begins one), without a port."""
    return F.lower(F.regexp_extract(url, r"^[^:/?#\\]+://(?:[^/?#\\]*@)?(\[[^\]]*\]|[^/?#\\:@]*)", 1))


def section(heading: str, body: Column) -> Column:
    """A headed block, or nothing where the body is blank."""
    said = strip(F.coalesce(body, F.lit("")))
    return F.when(said != "", F.concat(F.lit(f"## {heading}\n"), said, F.lit("\n\n"))).otherwise("")


def topic_terms(title: Column, ref: Column) -> Column:
    """Content words of a title, without its leading reference, bracketed parts, short tokens and bare numbers."""
    rest = F.when((ref != "") & F.startswith(F.lower(title), F.lower(ref)), F.substring(title, F.length(ref) + 1, F.length(title))).otherwise(title)
    words = plain_tokens(F.regexp_replace(rest, r"\([^)]*\)", " "))
    return F.filter(words, lambda t: (F.length(t) >= 4) & ~t.isin(*TOPIC_STOP_WORDS) & t.rlike("[a-z]"))


def point_id(chunk_id: Column) -> Column:
    """Version 5 UUID of a chunk id in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(chunk_id, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
