"""Extraction heuristics as column expressions: names, indications, evidence, safety, sections."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values
from .text import first_rule, let

ITEM = "array<struct<value:string,confidence:double,source:string,context:string>>"


def literals(pattern: str) -> list[str]:
    """Pieces of lower-case text of which every match of a pattern of `values` has one: the longest of each alternative."""
    p = re.sub(r"^\(\?i\)", "", pattern)
    whole = re.fullmatch(r"\\b\(([^()]*)\)\\b", p)
    if whole:
        p = whole[1]
    group = r"\((?:\\.|[^()\\])*\)"
    held = re.findall(group, p)
    out = []
    for part in re.sub(group, "\0", p).split("|"):
        pieces = re.findall(r"[a-z](?:[a-z -]*[a-z])?", re.sub(r".\?|\\.[+*]?", "\0", re.sub("\0\\?", "\0", part)))
        longest = max(pieces, key=len, default="")
        out += [longest] if len(longest) > 2 else re.findall(r"[a-z]+", held[0].replace("?:", "")) if part.startswith("\0") else [""]
    return out


def may_match(low: Column, *patterns: str) -> Column:
    """Whether the lower-cased text has a literal of the patterns. Far cheaper than a pattern, which few texts need then."""
    return reduce(Column.__or__, [F.contains(low, F.lit(x)) for p in patterns for x in literals(p)])


def all_matches(text: Column, patterns: list[str]) -> Column:
    """The first groups of all matches, pattern by pattern."""
    none = F.array().cast("array<string>")
    one = lambda low: lambda p: F.when(may_match(low, p), F.regexp_extract_all(text, F.lit(p), 1)).otherwise(none)
    return F.when(text.isNotNull(), let(F.lower(text), lambda low: F.flatten(F.array(*map(one(low), patterns)))))


def distinct_ignoring_case(found: Column, key) -> Column:
    """The first item of each lower-cased key, in order."""
    return let(found, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, 1, i), lambda y: F.lower(key(y)) == F.lower(key(x)))))


def binomials(text: Column) -> Column:
    """Names with confidence: full, abbreviated, then with variety; without case-insensitive repeats."""
    text = F.coalesce(text, F.lit(""))
    make = lambda p, c: F.transform(F.regexp_extract_all(text, F.lit(p), 1), lambda v: F.struct(v.alias("value"), F.lit(c).alias("confidence")))
    found = F.concat(make(values.BINOMIAL, 0.90), make(values.BINOMIAL_ABBREVIATED, 0.80), make(values.BINOMIAL_VARIETY, 0.95))
    return F.filter(found, lambda x, i: ~F.exists(F.slice(found, 1, i), lambda y: F.lower(y["value"]) == F.lower(x["value"])))


def primary_binomial(text: Column) -> Column:
    """The first name of the highest confidence, or null."""
    found = binomials(text)
    top = F.array_max(F.transform(found, lambda x: x["confidence"]))
    return F.get(F.filter(found, lambda x: x["confidence"] == top), 0)["value"]


def normalize_binomial(name: Column) -> Column:
    p = F.filter(F.split(name, r"\s+"), lambda x: x != "")
    genus, species = F.regexp_replace(F.get(p, 0), r"\.+$", ""), F.lower(F.get(p, 1))
    plain = F.concat_ws(" ", genus, species)
    full = F.concat_ws(" ", genus, species, F.get(p, 2), F.lower(F.get(p, 3)))
    return F.when(F.size(p) < 2, name).when((F.size(p) >= 4) & F.get(p, 2).isin("var.", "subsp."), full).otherwise(plain)


def clean_indication(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    t = F.regexp_replace(t, r"^[-\*\+•‣\d\.)\]]+\s*", "")
    return F.trim(F.substring(F.regexp_replace(t, r"[.;,]+$", ""), 1, 200))


def normalize_indication(text: Column) -> Column:
    """The name of the first rule that fits, or the cleaned text."""
    return F.coalesce(let(F.lower(text), lambda low: first_match(low, [(name, p) for p, name in values.NORMALIZATION_RULES])), clean_indication(text))


def first_match(low: Column, rules: list[tuple[str, str]]) -> Column:
    """The first name whose pattern the lower-cased text has, or null. Hand it a lambda variable, else each rule lowers the text again."""
    return F.coalesce(*[F.when(may_match(low, p) & F.rlike(low, F.lit(p)), name) for name, p in rules])


def indications(text: Column) -> Column:
    """What the lead-in patterns introduce: cleaned, without repeats, normalized."""
    raw = F.filter(F.transform(all_matches(text, values.INDICATION_PATTERNS), clean_indication), lambda x: x != "")
    return F.transform(distinct_ignoring_case(raw, lambda x: x), normalize_indication)


def bullet_indications(text: Column) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 1) for p in values.BULLET_PATTERNS]))
    raw = F.filter(F.transform(found, clean_indication), lambda x: F.length(x) >= 5)
    return F.transform(distinct_ignoring_case(raw, lambda x: x), normalize_indication)


def categorize(text: Column) -> Column:
    return first_rule(text, values.CATEGORY_RULES)


def evidence(text: Column) -> Column:
    """struct<level, confidence>"""
    found = lambda x: F.struct(F.coalesce(x, F.lit("traditional")).alias("level"), F.when(x.isNotNull(), 0.85).otherwise(0.50).alias("confidence"))
    return let(let(F.lower(F.coalesce(text, F.lit(""))), lambda low: first_match(low, values.EVIDENCE_PATTERNS)), found)


def severity(text: Column) -> Column:
    return first_rule(text, values.SEVERITY_RULES, "moderate")


def contraindications(text: Column) -> Column:
    """array<struct<value, severity>>; the severity is that of the whole match."""
    one = lambda p: F.zip_with(
        F.regexp_extract_all(text, F.lit(p), 1), F.regexp_extract_all(text, F.lit(p), 0), lambda v, m: F.struct(F.trim(v).alias("value"), severity(F.concat(m, F.lit(" "), v)).alias("severity"))
    )
    return F.flatten(F.array(*[one(p) for p in values.CONTRAINDICATION_PATTERNS]))


def interactions(text: Column) -> Column:
    return F.transform(all_matches(text, values.INTERACTION_PATTERNS), lambda x: F.trim(x))


def markdown_title(text: Column) -> Column:
    t = F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)
    return F.when(t != "", F.trim(t))


def text_title(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.get(lines, 0), 1, 100)


def document_binomials(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(values.DOCUMENT_BINOMIAL), 1))


def sections(text: Column) -> Column:
    """array<struct<name, content>>: a heading opens a section; of equal names the last stays; a heading without lines none.

    Lines, headings and sections are made once a text: an outer expression inside a lambda is evaluated again for each member. Equal names meet
    by sorting, and inner white space is passed once, so the time of a text grows with its length."""

    def made(lines: Column, heads: Column) -> Column:
        def one(i: Column, j: Column) -> Column:
            end = F.get(heads, j)
            name = F.when(i < 0, "_header").otherwise(F.lower(F.trim(F.regexp_replace(F.get(lines, F.greatest(i, F.lit(0))), r"^#+", ""))))
            body = F.slice(lines, i + 2, F.greatest(end - i - 1, F.lit(0)))
            return F.struct(name.alias("name"), F.when(end - i - 1 > 0, F.regexp_replace(F.array_join(body, "\n"), r"^\s+|(?<!\s)\s+$", "")).alias("content"))

        starts = F.concat(F.array(F.lit(-1)), F.slice(heads, 1, F.size(heads) - 1))
        return F.filter(F.transform(starts, one), lambda s: s["content"].isNotNull())

    def headings(lines: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: (i == F.size(lines)) | F.get(lines, i).startswith("#"))

    def last(found: Column) -> Column:
        named = F.sort_array(F.transform(found, lambda s, k: F.struct(s["name"].alias("name"), k.alias("k"))))
        ends = lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i + 1)["name"] != x["name"], F.lit(True)))
        kept = F.transform(F.sort_array(F.transform(let(named, ends), lambda x: x["k"])), lambda k: F.get(found, k))
        distinct = F.size(F.array_distinct(F.transform(found, lambda s: s["name"])))  # by hash
        return F.when(distinct == F.size(found), found).otherwise(kept)

    return F.when(text.isNotNull(), let(F.split(text, "\n"), lambda lines: let(headings(lines), lambda heads: let(made(lines, heads), last))))


def bullets(found: Column, headers: list[str], compat: bool, numbered: bool) -> Column:
    """struct<text, section> of the bullets in sections under one of the headers.

    A header must be the whole name, so "contraindications" is no indication section; compat also takes parts of names."""

    def hit(name: Column) -> Column:
        if not compat:
            return name.isin(*headers)
        out = F.lit(False)
        for h in headers:
            out = out | F.contains(name, F.lit(h))
        return out

    mark, strip = (r"^([-*+]|\d+\.)", r"^[-*+0-9. ]+") if numbered else (r"^[-*+]", r"^[-*+ ]+")

    def lines(s: Column) -> Column:
        rows = F.filter(F.transform(F.split(s["content"], "\n"), lambda x: F.trim(x)), lambda x: F.rlike(x, F.lit(mark)))
        kept = F.filter(F.transform(rows, lambda x: F.trim(F.regexp_replace(x, strip, ""))), lambda x: F.length(x) > 3)
        return F.transform(kept, lambda x: F.struct(x.alias("text"), s["name"].alias("section")))

    return F.flatten(F.transform(F.filter(found, lambda s: hit(s["name"])), lines))


def markdown_indications(text: Column, compat_headers: bool = False) -> Column:
    items = bullets(sections(text), values.INDICATION_HEADERS, compat_headers, True)
    return F.transform(items, lambda x: F.struct(x["text"].alias("text"), x["section"].alias("section"), first_rule(x["text"], values.DOCUMENT_CATEGORY_RULES).alias("category")))


def markdown_safety(text: Column, compat_headers: bool = True) -> Column:
    """Safety headings may be part of a longer name ("Safety Notes"): missing a warning is the worse error."""
    items = bullets(sections(text), values.SAFETY_HEADERS, compat_headers, False)
    return F.transform(items, lambda x: F.struct(x["text"].alias("text"), first_rule(x["text"], values.DOCUMENT_SEVERITY_RULES, "mild").alias("severity")))


def text_indications(text: Column) -> Column:
    def marked(x: Column) -> Column:
        hit = F.lit(False)
        for m in values.INDICATION_MARKERS:
            hit = hit | F.contains(F.lower(x), F.lit(m))
        return hit

    without = lambda p: lambda x: F.when(x.startswith(p), F.trim(F.substring(x, 2, 1 << 30))).otherwise(x)
    lines = F.transform(F.filter(F.split(text, "\n"), marked), lambda x: F.trim(x))
    for prefix in ("-", "*", "•", "‣"):
        lines = F.transform(lines, without(prefix))
    return F.filter(lines, lambda x: (F.length(x) > 10) & (F.length(x) < 200))


def sentences(text: Column) -> Column:
    """Sentences of over 10 characters, without citation numbers."""
    t = F.regexp_replace(F.regexp_replace(text, r"\(\d+[–\-]?\d*\)", ""), r"\n+", " ")
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: F.length(x) > 10)
