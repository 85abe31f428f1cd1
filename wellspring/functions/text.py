"""Text analysis as column expressions: tokens, n-grams, synonyms, similarity, hashed features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values
from .stemmer import stemmed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body` (a lambda variable is not re-evaluated)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(tokens: Column, name: str = "term") -> Column:
    """array<struct<name, n>>: the distinct tokens of a row in order, and how often each occurs. Counted inside the row, so nothing is shuffled."""

    def of(a: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda i, k: F.struct(F.get(a, i).alias(name), (F.coalesce(F.get(s, k + 1), F.size(a)) - i).alias("n"))))

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), of))


def words(text: Column, stopwords: list[str] | None = values.STOPWORDS) -> Column:
    """Lower-case words of letters, digits, underscore and inner apostrophes, without stop words."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s']", " ")
    clean = F.regexp_replace(clean, r"(?<!\S)'+|'+(?!\S)", "")  # outer apostrophes, in the whole text at once
    stop = [F.lit(s) for s in stopwords or []]
    return F.filter(F.split(clean, r"\s+"), lambda w: (w != "") & (~w.isin(*stop) if stop else F.lit(True)))


def bigrams(tokens: Column, joiner: str = "_") -> Column:
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(joiner), b))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def tokens(text: Column, stem: bool = True, with_bigrams: bool = True, stopwords: list[str] | None = values.STOPWORDS) -> Column:
    w = words(text, stopwords)
    w = stemmed(w) if stem else w
    return F.concat(w, bigrams(w)) if with_bigrams else w


def synonym_map(synonyms: dict[str, list[str]] = values.SYNONYMS) -> dict[str, list[str]]:
    """What each term adds: a canonical term its synonyms, a synonym its canonical term and that one's synonyms."""
    canonical = {v: k for k, vs in synonyms.items() for v in vs}
    out = {k: [k, *vs] for k, vs in synonyms.items()}
    for v, k in canonical.items():
        out[v] = list(dict.fromkeys([*out.get(v, []), k, *synonyms[k]]))
    return out


def expand_synonyms(tokens: Column, synonyms: dict[str, list[str]] = values.SYNONYMS) -> Column:
    """The distinct tokens and their synonyms. A map literal: the dictionary is a constant of the plan."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pairs = [f"{quoted(k)}, array({', '.join(map(quoted, vs))})" for k, vs in synonym_map(synonyms).items()]
    table = F.expr(f"map({', '.join(pairs)})")  # parsed in one call: a literal each is slow to build
    keys = [F.lit(k) for k in synonym_map(synonyms)]  # by hash: a map is searched from its start for each token
    added = lambda ts: F.flatten(F.transform(F.filter(ts, lambda t: t.isin(*keys)), lambda t: F.element_at(table, t)))
    return let(tokens, lambda ts: F.array_distinct(F.concat(ts, added(ts))))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def spaced(text: Column, inner: str = "") -> Column:
    """The words of `features` in one text, between single spaces: what parts them there is what is no letter, digit or underscore.
    With an apostrophe as `inner`, those of `words`, before outer apostrophes and stop words go."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{N}}_{inner}]+", " ")


def features(text: Column) -> Column:
    """Words and word pairs for hashing: no stop words, no stems."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return let(F.filter(F.split(clean, r"\s+"), lambda x: x != ""), lambda w: F.concat(w, bigrams(w, " ")))


def bucket(token: Column, buckets: int = values.HASH_BUCKETS) -> Column:
    """The first four bytes of the MD5 digest as a little-endian number, modulo the buckets."""
    h = F.md5(F.encode(token, "UTF-8"))
    little = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.conv(little, 16, 10).cast("long") % buckets


def first_rule(text: Column, rules: dict[str, list[str]], default: str | None = None) -> Column:
    """The first category with a keyword in the text."""
    low, out = F.lower(text), None
    for name, keywords in rules.items():
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(low, F.lit(k))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.lit(default).cast("string"))


def lookup(key: Column, table: dict, default) -> Column:
    """A small constant table as a map literal."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def evidence_multiplier(level: Column) -> Column:
    return lookup(level, values.EVIDENCE_MULTIPLIER, 1.0)


def evidence_priority(level: Column) -> Column:
    return lookup(level, values.EVIDENCE_PRIORITY, 0)


def short_name(name: Column) -> Column:
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.concat(F.substring(F.get(parts, 0), 1, 1), F.lit(". "), F.get(parts, 1))).otherwise(name)


def json_or_list(text: Column) -> Column:
    """A JSON list as strings; a scalar as a list of one; anything else as a list of the raw text; empty as no items."""
    parsed = F.from_json(text, "array<string>")
    scalar = F.try_parse_json(text).cast("string")
    return (
        F.when(text.isNull() | (text == ""), F.array().cast("array<string>"))
        .when(F.ltrim(text).startswith("[") & parsed.isNotNull(), parsed)
        .otherwise(F.array(F.coalesce(scalar, text)))
    )


def json_or_map(text: Column) -> Column:
    return F.coalesce(F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>")), F.create_map().cast("map<string,string>"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))
