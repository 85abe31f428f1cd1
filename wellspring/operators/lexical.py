"""Lexical search: an inverted index as tables, and BM25 or TF-IDF scoring of a table of queries.

Index. Each field of a row is a document of its own: postings (term, id, tf, field, length) with tf = 0.5 + 0.5 * count / largest
count, one idf for each term from the number of ids, and as length of an id that of its last indexed field.
Queries are rows, so a batch is one plan: terms join the postings, sums shuffle by (query, id), and ranks come from a
window per query after the sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values
from ..functions.stemmer import stemmed
from . import counted
from .relational import spread

#: Terms of a table of queries that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Terms of a table of queries that go to where a new index is counted.
PUSHED_TERMS = 10_000
#: Index terms that stand in for one term the index lacks.
MOST_NEAR = 3

FIELDS = (("normalized", "normalized_text", True), ("text", "indication_text", True), ("category", "category", False))


@dataclass
class Analysis:
    """How texts become terms."""

    stem: bool = True
    bigrams: bool = True
    synonyms: dict | None = field(default_factory=lambda: values.SYNONYMS)
    stopwords: list | None = field(default_factory=lambda: values.STOPWORDS)

    def with_words(self, df: DataFrame, text: Column, name: str) -> DataFrame:
        """df with an array of words. Stems are a column of their own: Python functions can't stand inside array functions."""
        df = df.withColumn(name, T.words(text, self.stopwords))
        return df.withColumn(name, stemmed(F.col(name))) if self.stem else df

    def rules(self, name: str, full: bool) -> counted.Rules:
        synonyms = T.synonym_map(self.synonyms) if full and self.synonyms else None
        return counted.Rules(name, tuple(self.stopwords or ()), self.stem, self.bigrams and full, synonyms)


@dataclass
class LexicalIndex:
    postings: DataFrame  # term, id, tf, field, length (of the id)
    terms: DataFrame  # term, df, idf, n_postings
    lengths: DataFrame  # id, length
    stats: DataFrame  # one row: n_docs, avg_length
    marks: DataFrame | None = None  # of a new index: term, d (ids that have the term; sums by block of rows)
    made: Callable | None = None  # of a new index: postings or marks of some terms

    def save(self, path: str) -> None:
        """Postings are clustered by term, so that a query's terms touch few files."""
        self.postings.repartition("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("terms", "lengths", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, length_mode: str = "fresh") -> LexicalIndex:
        """length_mode "zero" gives every id length 0, as a reloaded index of the older format has."""
        got = cls(*[spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "lengths", "stats")])
        if length_mode == "zero":
            none = F.lit(0).cast("long")
            got.lengths, got.postings = got.lengths.withColumn("length", none), got.postings.withColumn("length", none)
        return got

    def only(self, terms: list[str]) -> LexicalIndex:
        """The index with postings and marks of these terms: others are dropped where they are counted."""
        return replace(self, postings=self.made("postings", terms), marks=self.made("marks", terms))

    def idf_of(self, wanted: DataFrame) -> DataFrame:
        """term, idf of the wanted terms (distinct). A new index counts only these, in place of its whole vocabulary."""
        if self.marks is None:
            return self.terms.join(wanted, "term", "left_semi").select("term", "idf")
        few = self.marks.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("d").alias("df"))
        return few.crossJoin(F.broadcast(self.stats.select("n_docs"))).select("term", idf("n_docs", "df").alias("idf"))  # one row


def field_texts(items: DataFrame, analysis: Analysis, fields=FIELDS) -> tuple[DataFrame, list[counted.Rules]]:
    """id and the text of each field, null where a row has none; and the fields' rules. Rows without such fields are left out."""
    used = [(n, c, full) for n, c, full in fields if c in items.columns]
    df = spread(items.select("id", *[F.col(c).alias(f"text_{i}") for i, (_, c, _) in enumerate(used)]))
    names = [f"text_{i}" for i in range(len(used))]
    df = df.filter(reduce(Column.__or__, [F.col(x) != "" for x in names]))
    texts = [F.when(F.col(x) != "", T.spaced(F.col(x), "'")).alias(x) for x in names]
    return df.select("id", *texts), [analysis.rules(n, full) for n, _, full in used]


def build_index(items: DataFrame, analysis: Analysis | None = None, fields=FIELDS, stats: str = "field") -> LexicalIndex:
    """stats "field": each field counts as a document; "document": each id does.

    Ids are unique, as in every table of the store, so a row's terms are counted inside the row and postings need no shuffle;
    only the terms' document frequencies do, summed by block of rows first. Nothing is cached: each table counts the terms again,
    a block at a time, since cached rows are held 10,000 at once, with all their terms."""
    docs, rules = field_texts(items, analysis or Analysis(), fields)
    kind = f"id {items.schema['id'].dataType.simpleString()}"
    kinds = {"postings": f"term string, {kind}, tf double, field string, length long", "marks": "term string, d long, p long", "lengths": f"{kind}, n_fields long, length long"}

    def made(what: str, wanted: list[str] | None = None) -> DataFrame:
        return counted.mapped(docs, counted.indexed, kinds[what], rules, what, wanted)

    sizes, marks = made("lengths"), made("marks")
    n = F.sum("n_fields") if stats == "field" else F.count(F.lit(1))
    one = sizes.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n_docs"), F.sum("length").alias("total"))
    one = one.select("n_docs", F.when(F.col("n_docs") > 0, F.col("total") / F.col("n_docs")).otherwise(0.0).alias("avg_length"))
    terms = marks.groupBy("term").agg(F.sum("d").alias("df"), F.sum("p").alias("n_postings"))
    terms = terms.crossJoin(F.broadcast(one.select("n_docs"))).withColumn("idf", idf("n_docs", "df"))  # one row
    return LexicalIndex(made("postings"), terms.select("term", "df", "idf", "n_postings"), sizes.select("id", "length"), one, marks, made)


def idf(n_docs, df) -> Column:
    n_docs, df = (F.col(c) if isinstance(c, str) else c for c in (n_docs, df))
    return F.log((n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def bm25(tf, idf_, length, avg, k1: float = values.BM25_K1, b: float = values.BM25_B) -> Column:
    tf, idf_, length, avg = (F.col(c) if isinstance(c, str) else c for c in (tf, idf_, length, avg))
    scored = idf_ * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / avg))
    return F.when(avg == 0, tf * idf_).otherwise(scored)


def query_terms(queries: DataFrame, analysis: Analysis, strict_operators: bool = False) -> DataFrame:
    """query_id, term, n (how often it counts), required; phrases and excluded terms as arrays.

    As in the compatible grammar, `and` and `or` are stop words and `not x` only drops x from the terms; with
    strict_operators the words AND, OR, NOT and a trailing * mean what they say.
    """
    q = queries.select("query_id", F.coalesce("query", F.lit("")).alias("query"))
    phrases = F.regexp_extract_all("query", F.lit('"([^"]+)"'), 1)
    bare = F.regexp_replace("query", '"[^"]+"', "")
    kept = [w for w in (analysis.stopwords or []) if w not in ("and", "or")]
    q = replace(analysis, stopwords=kept if strict_operators else analysis.stopwords).with_words(q, bare, "parts")
    q, parts = analysis.with_words(q, F.col("query"), "whole"), F.col("parts")
    if strict_operators:
        marks = F.transform(parts, lambda w, i: F.struct(w.alias("w"), F.get(parts, i - 1).alias("before")))
        excluded = F.transform(F.filter(marks, lambda m: m["before"] == "not"), lambda m: m["w"])
        required = F.transform(F.filter(marks, lambda m: m["before"] == "and"), lambda m: m["w"])
        optional = F.transform(F.filter(marks, lambda m: ~m["w"].isin("and", "or", "not") & ~F.coalesce(m["before"].isin("and", "not"), F.lit(False))), lambda m: m["w"])
        base = F.concat(required, optional)
    else:
        marks = F.transform(parts, lambda w, i: F.struct(w.alias("w"), F.get(parts, i - 1).alias("before"), (i == F.size(parts) - 1).alias("last")))
        excluded = F.transform(F.filter(marks, lambda m: (m["before"] == "not") & (m["w"] != "not")), lambda m: m["w"])
        required = F.array().cast("array<string>")
        base = F.transform(F.filter(marks, lambda m: ~((m["w"] == "not") & ~m["last"]) & ~F.coalesce((m["before"] == "not"), F.lit(False))), lambda m: m["w"])
    base = T.expand_synonyms(base, analysis.synonyms) if analysis.synonyms else base
    whole = T.bigrams(F.col("whole")) if analysis.bigrams else F.array().cast("array<string>")
    return q.select("query_id", phrases.alias("phrases"), excluded.alias("excluded"), required.alias("required"), F.concat(base, whole).alias("terms"))


def fuzzy_terms(wanted: DataFrame, vocabulary: DataFrame, threshold: float, most: int = MOST_NEAR) -> DataFrame:
    """query_id, term, index_term: for terms the index lacks, its most similar terms (similarity, then term).

    Lengths bound the similarity, so terms meet only vocabulary of the lengths that can reach the threshold: an equi-join
    on length in place of a cross join.
    """
    missing = wanted.join(vocabulary.select(F.col("term").alias("known")), F.col("term") == F.col("known"), "left_anti").select("query_id", "term").distinct()
    n = F.length("term")
    reach = missing.withColumn("len", F.explode(F.sequence(F.ceil(n * threshold).cast("int"), F.floor(n / threshold).cast("int"))))
    vocab = vocabulary.select(F.col("term").alias("index_term"), F.length("term").alias("len"))
    near = reach.join(vocab, "len").withColumn("similarity", T.levenshtein_similarity(F.col("term"), F.col("index_term"))).filter(F.col("similarity") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id", "term").orderBy(F.desc("similarity"), "index_term"))
    return near.withColumn("r", rank).filter(F.col("r") <= most).select("query_id", "term", "index_term")


def query_table(spark: SparkSession, texts: list[str]) -> DataFrame:
    """query_id, query. Rows that come as Arrow are a relation of the plan, so the optimizer itself parses a few queries."""
    return spark.createDataFrame(pa.table({"query_id": pa.array(range(len(texts)), pa.int64()), "query": pa.array(texts, pa.string())}))


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of at most so many rows, by a count; beyond the limit Spark chooses the join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def scores(
    index: LexicalIndex, queries: DataFrame, items: DataFrame, analysis: Analysis | None = None, scoring: str = "bm25", fuzzy: float | None = None, strict_operators: bool = False
) -> DataFrame:
    """query_id, id, score, matched (terms): every row that a query touches."""
    parsed = query_terms(queries, analysis or Analysis(), strict_operators)
    wanted = parsed.select("query_id", "required", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_contains("required", F.col("term"))).alias("must")
    )
    probe = wanted.withColumn("index_term", F.col("term"))
    if fuzzy:
        near = fuzzy_terms(wanted, index.terms, fuzzy)
        probe = probe.join(near.withColumnRenamed("index_term", "near"), ["query_id", "term"], "left").withColumn("index_term", F.coalesce("near", "index_term")).drop("near")
    n = wanted.count()
    if index.made and not fuzzy and n <= PUSHED_TERMS:
        index = index.only([r.term for r in wanted.select("term").distinct().collect()])
    probe = small(probe, n * MOST_NEAR if fuzzy else n)  # the postings are then filtered where they are, without a shuffle
    hits = probe.join(index.postings.withColumnRenamed("term", "index_term"), "index_term")
    hits = hits.join(small(index.idf_of(small(wanted.select("term").distinct(), n)), n), "term", "left").crossJoin(F.broadcast(index.stats))  # one row
    hits = hits.withColumn("idf", F.coalesce("idf", idf(F.col("n_docs"), F.lit(0))))
    hits = hits if "length" in index.postings.columns else hits.join(index.lengths, "id")
    one = bm25("tf", "idf", "length", "avg_length") if scoring == "bm25" else F.col("tf") * F.col("idf")
    one = one * F.when(F.col("field") == "normalized", values.NORMALIZED_BOOST).otherwise(1.0) * F.when(F.col("must"), values.REQUIRED_BOOST).otherwise(1.0) * F.col("n")
    by_term = hits.groupBy("query_id", "id").agg(F.sum(one).alias("score"), F.collect_set("term").alias("matched"))
    phrase = parsed.select("query_id", F.explode("phrases").alias("phrase")).withColumn("phrase", F.lower("phrase"))
    texts = items.select("id", F.lower("indication_text").alias("t"), F.lower("normalized_text").alias("u"))
    found = texts.join(F.broadcast(phrase), F.contains("t", F.col("phrase")) | F.contains("u", F.col("phrase")))
    by_phrase = found.groupBy("query_id", "id").agg((F.count(F.lit(1)) * values.PHRASE_BOOST).alias("score")).withColumn("matched", F.array().cast("array<string>"))
    both = by_term.unionByName(by_phrase).groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.flatten(F.collect_list("matched")).alias("matched"))
    out = both.join(F.broadcast(parsed.select("query_id", "excluded")), "query_id")
    return out.filter(~F.arrays_overlap("matched", "excluded")).select("query_id", "id", "score", "matched")


def top(scored: DataFrame, limit: int, min_score: float = 0.0, digits: int | None = None) -> DataFrame:
    """Rank 1..limit of each query: score, then id. The window keeps `limit` rows of each map task's group before the shuffle."""
    s = F.round("score", digits) if digits is not None else F.col("score")
    ranked = scored.filter(F.col("score") >= min_score).withColumn("score", s)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= limit)


def search(
    index: LexicalIndex,
    queries: DataFrame,
    items: DataFrame,
    limit: int = 20,
    category: str | None = None,
    min_score: float = 0.0,
    category_pushdown: bool = False,
    digits: int | None = None,
    **params,
) -> DataFrame:
    """query_id, id, score, rank, match_type and the item's columns. The category applies after the limit, or before it if pushed down."""
    hits = scores(index, queries, items, **params)
    if category and category_pushdown:
        hits = hits.join(items.filter(F.col("category") == category).select("id"), "id", "left_semi")
    out = top(hits, limit, min_score, digits).select("query_id", "id", "score", "rank").join(items, "id").withColumn("match_type", F.lit("lexical"))
    return out.filter(F.col("category") == category) if category and not category_pushdown else out


def search_exact(items: DataFrame, query: str) -> DataFrame:
    q = query.lower()
    hit = items.filter((F.lower("indication_text") == q) | (F.lower("normalized_text") == q))
    return hit.withColumn("score", F.lit(1.0)).withColumn("match_type", F.lit("exact"))


def suggest(index: LexicalIndex, prefix: str, limit: int = 10) -> DataFrame:
    return index.terms.filter(F.col("term").startswith(prefix.lower())).orderBy(F.desc("n_postings"), "term").select("term", "n_postings").limit(limit)


def match_all(items: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Full-text match: words are all required, OR between groups, NOT before a word, "phrases" and prefixes with *."""
    import re

    parts = re.findall(r'"[^"]+"|\S+', query)
    starts = lambda prefix: lambda w: w.startswith(prefix)
    groups: list[list[Column]] = [[]]
    negate = False
    text = F.lower(F.concat_ws(" ", "indication_text", "normalized_text", "category"))
    have = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "), " ")
    for p in parts:
        if p == "OR":
            groups.append([])
        elif p == "NOT":
            negate = True
        elif p != "AND":
            word = p.strip('"').lower()
            if p.startswith('"') and " " in word:
                hit = F.contains(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "), F.lit(word))
            elif word.endswith("*"):
                hit = F.exists(have, starts(word[:-1]))
            else:
                hit = F.array_contains(have, word)
            groups[-1].append(~hit if negate else hit)
            negate = False
    keep = F.lit(False)
    for g in groups:
        every = F.lit(bool(g))
        for c in g:
            every = every & c
        keep = keep | every
    return items.filter(keep).orderBy("id").limit(limit)
