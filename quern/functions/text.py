"""Text functions as column expressions: tokens, sizes, white space, identifiers, overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespaces of document and chunk identifiers.
DOCUMENT_NAMESPACE = "8b62f0a4-2d2f-4b87-9a7f-92f4edb8a8c3"
CHUNK_NAMESPACE = "c4a8e2b1-9d3f-4e5a-8b7c-1f2e3d4c5b6a"


def tokens(text: Column) -> Column:
    """Maximal runs of a-z and 0-9 in the lower-cased text, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def token_estimate(text: Column) -> Column:
    """A token for every four characters, one at least unless the text is empty."""
    size = F.length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size / 4).cast("int"))).cast("int")


def chars_for_tokens(count: Column) -> Column:
    return count * 4


def strip(text: Column) -> Column:
    """White space off both ends, line breaks included."""
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　"))


def normalize_whitespace(text: Column) -> Column:
    """Runs of blanks to one, three line breaks or more to two, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, " +", " "), "\n{3,}", "\n\n"))


def sha256_text(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    cut = lambda a, n: F.substring(digest, a, n)
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-"), variant, cut(18, 3), F.lit("-"), cut(21, 12))


def document_id(source: Column, external: Column, tenant: Column) -> Column:
    key = F.concat_ws(":", source, external, F.coalesce(F.when(tenant != "", tenant), F.lit("default")))
    return uuid5(DOCUMENT_NAMESPACE, key)


def chunk_id(document: Column, index: Column, digest: Column) -> Column:
    return uuid5(CHUNK_NAMESPACE, F.concat_ws(":", document, index.cast("string"), digest))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets (given as arrays without repeats); 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return ratio(both, F.size(a) + F.size(b) - both)


def coverage(of: Column, by: Column) -> Column:
    """Share of the first token set that the second holds."""
    return ratio(F.size(F.array_intersect(of, by)), F.size(of))


def first_header(text: Column) -> Column:
    """The text's opening heading without its marks, null if it does not open with one."""
    found = F.regexp_extract(text, r"^(#{1,6})\s+(.+?)(?:\n|$)", 2)
    return F.when(found != "", strip(found))


def starts_with_header(text: Column) -> Column:
    return F.ltrim(text).rlike(r"^\s*#{1,6}\s+")


def fences(text: Column) -> Column:
    """The fenced code blocks of a text."""
    return F.regexp_extract_all(text, F.lit(r"```[\s\S]*?```|~~~[\s\S]*?~~~"), F.lit(0))


def numbered_lists(text: Column) -> Column:
    """Contiguous blocks of numbered lines."""
    return F.regexp_extract_all(text, F.lit(r"(?:^|\n)((?:\d+\.\s+.+\n?)+)"), F.lit(1))


def bullet_lists(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?:^|\n)((?:[-*]\s+.+\n?)+)"), F.lit(1))


def in_ranges(position: Column, ranges: Column) -> Column:
    """Is the position inside one of an array of (start, end) structs?"""
    return F.exists(ranges, lambda r: (r["start"] <= position) & (position < r["end"]))


def split_keeping(text: Column, separator: str) -> Column:
    """Split before each separator, so that it stays with what follows; no empty parts."""
    quoted = "\\Q" + separator + "\\E"
    return F.filter(F.split(text, f"(?={quoted})"), lambda p: p != "")


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def structure(text: Column) -> Column:
    """Markdown statistics, and whether a text is structured enough to be cut by headings."""
    headers = F.regexp_count(text, F.lit(r"(?m)^#{1,6}\s+.+$"))
    code = F.aggregate(fences(text), F.lit(0), lambda n, b: n + F.length(b))
    items = F.regexp_count(text, F.lit(r"(?m)^[\s]*[-*]\s+.+$|^[\s]*\d+\.\s+.+$"))
    paragraphs = F.size(F.filter(F.split(text, r"\n\n+"), lambda p: strip(p) != ""))
    share = ratio(code, F.length(text))
    good = (headers >= 2) & (headers / F.greatest(paragraphs, F.lit(1)) > 0.1) & (share < 0.7)
    return F.struct(
        token_estimate(text).alias("total_tokens"), headers.alias("header_count"), F.size(fences(text)).alias("code_block_count"), share.alias("code_ratio"),
        items.alias("list_item_count"), paragraphs.alias("paragraph_count"), good.alias("is_well_structured"),
    )
