"""The registered queries over the benchmark tables, and the SQL of each for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import stemmer
from ..functions import text as T
from ..functions import values
from ..operators import chunks, fusion, lexical, relational, vector
from ..sources import benchdata as D
from ..sources.store import first_wins, last_wins
from . import ranking

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PLAIN = lexical.Analysis(stem=False)
NO_SYNONYMS = lexical.Analysis(stem=False, synonyms=None)
SYMPTOMS = ["cold ring", "hot blue widget"]
TEXT_QUERIES = ["the estion", "essh edat nden", "cióndo"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- SQL of text analysis and BM25


def sql_words(x: str) -> str:
    stop = ", ".join(f"'{s}'" for s in values.STOPWORDS)
    clean = f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s'']', ' ', 'g')"
    stripped = f"list_transform(string_split_regex({clean}, '\\s+'), lambda w: regexp_replace(w, '^''+|''+$', '', 'g'))"
    return f"list_filter({stripped}, lambda w: w <> '' AND NOT list_contains([{stop}], w))"


def sql_pairs(w: str, joiner: str = "_") -> str:
    return f"list_transform(range(1, greatest(len({w}), 1)), lambda i: {w}[i] || '{joiner}' || {w}[i + 1])"


def sql_synonyms() -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, vs in T.synonym_map().items() for v in vs if "'" not in k + v)
    return f"syn(term, more) AS (VALUES {rows})"


def sql_queries(texts: list[str]) -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts))
    return f"q(query_id, query) AS (VALUES {rows})"


def sql_scores(items: str, fields, texts: list[str], synonyms: bool, scoring: str = "bm25") -> str:
    """CTEs up to scored(query_id, id, score)."""
    parts = " UNION ALL ".join(f"SELECT id, '{n}' AS field, {i} AS ord, {str(full).lower()} AS long, {c} AS t FROM items WHERE {c} <> ''" for i, (n, c, full) in enumerate(fields))
    expand = "SELECT DISTINCT id, field, ord, term FROM (SELECT id, field, ord, term FROM spread WHERE long UNION ALL SELECT id, field, ord, more FROM spread JOIN syn USING (term) WHERE long)" if synonyms else "SELECT id, field, ord, term FROM spread WHERE long"
    qexpand = "SELECT DISTINCT query_id, term FROM (SELECT query_id, term FROM qw UNION ALL SELECT query_id, more FROM qw JOIN syn USING (term))" if synonyms else "SELECT query_id, term FROM qw"
    one = f"idf * (tf * {values.BM25_K1 + 1}) / (tf + {values.BM25_K1} * (1 - {values.BM25_B} + {values.BM25_B} * length / (total / n_docs)))" if scoring == "bm25" else "tf * idf"
    return f"""WITH items AS ({items}), {sql_synonyms()}, {sql_queries(texts)},
f AS ({parts}),
d AS (SELECT id, field, ord, long, {sql_words('t')} AS w FROM f),
dt AS (SELECT id, field, ord, long, CASE WHEN long THEN list_concat(w, {sql_pairs('w')}) ELSE w END AS tokens FROM d),
spread AS (SELECT id, field, ord, long, unnest(tokens) AS term FROM dt),
ex AS ({expand} UNION ALL SELECT id, field, ord, term FROM spread WHERE NOT long),
cnt AS (SELECT id, field, ord, term, count(*) AS n FROM ex GROUP BY ALL),
post AS (SELECT id, field, term, 0.5 + 0.5 * n / max(n) OVER (PARTITION BY id, field) AS tf FROM cnt),
sizes AS (SELECT dt.id, dt.ord, coalesce(sum(n), 0) AS size FROM dt LEFT JOIN cnt ON cnt.id = dt.id AND cnt.ord = dt.ord GROUP BY ALL),
lens AS (SELECT id, arg_max(size, ord)::BIGINT AS length FROM sizes GROUP BY id),
st AS (SELECT (SELECT count(*) FROM dt) AS n_docs, (SELECT sum(length) FROM lens) AS total),
terms AS (SELECT term, count(DISTINCT id) AS df, count(*) AS n_postings, ln(((SELECT n_docs FROM st) - count(DISTINCT id) + 0.5) / (count(DISTINCT id) + 0.5) + 1.0) AS idf FROM post GROUP BY term),
ql AS (SELECT query_id, {sql_words('query')} AS w FROM q),
qw AS (SELECT query_id, unnest(w) AS term FROM ql),
qt AS (SELECT query_id, term, count(*) AS n FROM ({qexpand} UNION ALL SELECT query_id, unnest({sql_pairs('w')}) FROM ql) GROUP BY ALL),
scored AS (SELECT query_id, post.id, sum(n * CASE WHEN field = 'normalized' THEN 1.2 ELSE 1.0 END * ({one})) AS score
 FROM qt JOIN post USING (term) JOIN terms USING (term) JOIN lens ON lens.id = post.id, st GROUP BY ALL)
"""


def sql_top(limit: int, source: str = "scored", digits: int = 6) -> str:
    return f"SELECT * FROM (SELECT query_id::BIGINT AS query_id, id, round(score, {digits}) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, {digits}) DESC, id) AS rank FROM {source}) WHERE rank <= {limit}"


PART_FIELDS = lexical.FIELDS
TEXT_FIELD = (("text", "text", True),)
DOCS_SQL = "SELECT doc_id AS id, text FROM documents"


def text_items(spark: SparkSession, sf: str) -> DataFrame:
    return D.read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def long_rank(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


def part_hits(spark: SparkSession, sf: str, limit: int = 50, scoring: str = "bm25", analysis=PLAIN, texts=SYMPTOMS) -> DataFrame:
    items = D.indications(spark, sf)
    got = lexical.scores(lexical.build_index(items, analysis), lexical.query_table(spark, texts), items, analysis, scoring)
    return long_rank(lexical.top(got, limit, digits=6).select("query_id", "id", "score", "rank"))


PARTS_SCORED = sql_scores(D.SQL["indications"], PART_FIELDS, SYMPTOMS, True)
PARTS_PLAIN = sql_scores(D.SQL["indications"], PART_FIELDS, SYMPTOMS, False)


@query(PARTS_SCORED + sql_top(50))
def search_bm25_parts(spark, sf):
    return part_hits(spark, sf)


@query(PARTS_PLAIN + sql_top(50))
def search_bm25_no_synonyms(spark, sf):
    return part_hits(spark, sf, analysis=NO_SYNONYMS)


@query(sql_scores(D.SQL["indications"], PART_FIELDS, SYMPTOMS, True, "tfidf") + sql_top(50))
def search_tfidf(spark, sf):
    return part_hits(spark, sf, scoring="tfidf")


@query(sql_scores(DOCS_SQL, TEXT_FIELD, TEXT_QUERIES, False) + sql_top(50))
def search_bm25_documents(spark, sf):
    items = text_items(spark, sf)
    index = lexical.build_index(items, NO_SYNONYMS, TEXT_FIELD)
    with_names = items.select("id", F.col("text").alias("indication_text"), F.lit(None).cast("string").alias("normalized_text"))
    got = lexical.scores(index, lexical.query_table(spark, TEXT_QUERIES), with_names, NO_SYNONYMS)
    return long_rank(lexical.top(got, 50, digits=6).select("query_id", "id", "score", "rank"))


@query()
def search_stemmed_documents(spark, sf):
    items, a = text_items(spark, sf), lexical.Analysis()
    index = lexical.build_index(items, a, TEXT_FIELD)
    with_names = items.select("id", F.col("text").alias("indication_text"), F.lit(None).cast("string").alias("normalized_text"))
    return long_rank(lexical.top(lexical.scores(index, lexical.query_table(spark, TEXT_QUERIES), with_names, a), 50, digits=6).select("query_id", "id", "score", "rank"))


PHRASE_SQL = PARTS_SCORED + f", phrase AS (SELECT 0 AS query_id, id, 5.0 AS score FROM items WHERE contains(lower(indication_text), 'old ring') OR contains(normalized_text, 'old ring')), both_ AS (SELECT query_id, id, sum(score) AS score FROM (SELECT * FROM scored UNION ALL SELECT * FROM phrase) GROUP BY ALL) {sql_top(50, 'both_')}"


@query(PHRASE_SQL.replace(sql_queries(SYMPTOMS), "q(query_id, query) AS (VALUES (0, ' blue'))").replace("unnest(" + sql_pairs("w") + ") FROM ql", "'old_ring' FROM ql UNION ALL SELECT query_id, 'ring_blue' FROM ql"))
def search_phrase(spark, sf):
    return part_hits(spark, sf, texts=['"old ring" blue'])


@query(f"SELECT id, indication_text, 1.0::DOUBLE AS score FROM ({D.SQL['indications']}) WHERE lower(indication_text) = 'cold ring' OR normalized_text = 'cold ring'")
def search_exact(spark, sf):
    return lexical.search_exact(D.indications(spark, sf), "Cold Ring").select("id", "indication_text", "score")


@query(f"SELECT id, indication_text FROM ({D.SQL['indications']}) WHERE list_contains(string_split(normalized_text, ' '), 'cold') AND list_contains(string_split(normalized_text, ' '), 'ring') ORDER BY id LIMIT 50")
def search_fts_and(spark, sf):
    return lexical.match_all(D.indications(spark, sf), "cold AND ring").select("id", "indication_text")


@query(f"SELECT id, indication_text FROM ({D.SQL['indications']}) WHERE (starts_with(normalized_text, 'co') AND NOT contains(normalized_text, 'ring')) OR contains(normalized_text, 'hot bolt') ORDER BY id LIMIT 50")
def search_fts_grammar(spark, sf):
    return lexical.match_all(D.indications(spark, sf), 'co* NOT ring OR "hot bolt"').select("id", "indication_text")


@query(PARTS_SCORED.replace(sql_queries(SYMPTOMS), sql_queries(["blue widget"])) + f"SELECT t.* FROM ({sql_top(50)}) t JOIN items USING (id) WHERE category = 'promo'")
def search_category_postlimit(spark, sf):
    items = D.indications(spark, sf)
    got = lexical.search(lexical.build_index(items, PLAIN), lexical.query_table(spark, ["blue widget"]), items, 50, "promo", digits=6, analysis=PLAIN)
    return long_rank(got.select("query_id", "id", "score", "rank"))


@query(PARTS_SCORED.replace(sql_queries(SYMPTOMS), sql_queries(["blue widget"])) + ", own AS (SELECT scored.* FROM scored JOIN items USING (id) WHERE category = 'promo') " + sql_top(50, "own"))
def search_category_pushdown(spark, sf):
    items = D.indications(spark, sf)
    got = lexical.search(lexical.build_index(items, PLAIN), lexical.query_table(spark, ["blue widget"]), items, 50, "promo", category_pushdown=True, digits=6, analysis=PLAIN)
    return long_rank(got.select("query_id", "id", "score", "rank"))


@query(PARTS_SCORED.replace(sql_queries(SYMPTOMS), sql_queries(["blue not widget"])).replace(f"qw AS (SELECT query_id, unnest(w) AS term FROM ql)", "qw AS (SELECT query_id, 'blue' AS term FROM ql)") + sql_top(50))
def search_not(spark, sf):
    return part_hits(spark, sf, texts=["blue not widget"])


@query(
    PARTS_PLAIN.replace(sql_queries(SYMPTOMS), sql_queries(["widgte"]))
    + f""", near AS (SELECT term, 1 - levenshtein('widgte', term) / greatest(length(term), 6) AS s FROM terms WHERE 1 - levenshtein('widgte', term) / greatest(length(term), 6) >= 0.6 ORDER BY s DESC, term LIMIT 3),
fz AS (SELECT 0 AS query_id, post.id, sum(CASE WHEN field = 'normalized' THEN 1.2 ELSE 1.0 END * (x.idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * length / (total / n_docs))))) AS score
 FROM near JOIN post USING (term) JOIN lens ON lens.id = post.id, st, (SELECT ln((n_docs + 0.5) / 0.5 + 1.0) AS idf FROM st) x GROUP BY ALL) """
    + sql_top(50, "fz")
)
def search_fuzzy(spark, sf):
    items = D.indications(spark, sf)
    got = lexical.search(lexical.build_index(items, NO_SYNONYMS), lexical.query_table(spark, ["widgte"]), items, 50, digits=6, analysis=NO_SYNONYMS, fuzzy=0.6)
    return long_rank(got.select("query_id", "id", "score", "rank"))


@query(PARTS_PLAIN + "SELECT term, n_postings FROM terms WHERE starts_with(term, 'co') ORDER BY n_postings DESC, term LIMIT 10")
def suggest_completions(spark, sf):
    return lexical.suggest(lexical.build_index(D.indications(spark, sf), NO_SYNONYMS), "co", 10)


@query(sql_scores(DOCS_SQL, TEXT_FIELD, TEXT_QUERIES, False) + "SELECT term, df, n_postings, round(idf, 6) AS idf FROM terms")
def term_df_idf(spark, sf):
    return lexical.build_index(text_items(spark, sf), NO_SYNONYMS, TEXT_FIELD).terms.select("term", "df", "n_postings", F.round("idf", 6).alias("idf"))


@query(PARTS_SCORED + "SELECT id, field, term, round(tf, 6) AS tf FROM post")
def index_postings(spark, sf):
    return lexical.build_index(D.indications(spark, sf), PLAIN).postings.select("id", "field", "term", F.round("tf", 6).alias("tf"))


@query(PARTS_SCORED + "SELECT n_docs, round(total / n_docs, 6) AS avg_length FROM st")
def index_stats(spark, sf):
    return lexical.build_index(D.indications(spark, sf), PLAIN).stats.select("n_docs", F.round("avg_length", 6).alias("avg_length"))


@query(sql_scores(DOCS_SQL, TEXT_FIELD, TEXT_QUERIES, False) + "SELECT id, length FROM lens")
def doc_lengths(spark, sf):
    return lexical.build_index(text_items(spark, sf), NO_SYNONYMS, TEXT_FIELD).lengths


@query(f"SELECT id, to_json(w)::VARCHAR AS words, to_json({sql_pairs('w')})::VARCHAR AS pairs FROM (SELECT doc_id AS id, {sql_words('text')} AS w FROM documents)")
def tokenize_bigrams(spark, sf):
    w = T.words(F.col("text"))
    got = relational.spread(text_items(spark, sf)).select("id", w.alias("w")).select("id", F.to_json("w").alias("words"), F.to_json(T.bigrams(F.col("w"))).alias("pairs"))
    return got


@query(f"WITH {sql_synonyms()}, w AS (SELECT p_partkey AS id, unnest({sql_words('p_name')}) AS term FROM part) SELECT DISTINCT id, term FROM (SELECT * FROM w UNION ALL SELECT id, more FROM w JOIN syn USING (term))")
def synonym_expand(spark, sf):
    return D.indications(spark, sf).select("id", F.explode(T.expand_synonyms(T.words(F.col("indication_text")))).alias("term"))


@query()
def stem_vocabulary(spark, sf):
    return stemmer.stemmed_vocabulary(relational.spread(text_items(spark, sf)).select(F.explode(T.words(F.col("text"))).alias("word")))


@query("SELECT a.n_name AS name_a, b.n_name AS name_b, levenshtein(a.n_name, b.n_name)::BIGINT AS distance, round(1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)), 6) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def levenshtein_similarity(spark, sf):
    a = D.read(spark, sf, "nation").select("n_regionkey", F.col("n_name").alias("name_a"))
    b = D.read(spark, sf, "nation").select("n_regionkey", F.col("n_name").alias("name_b"))
    return a.join(b, "n_regionkey").select(
        "name_a", "name_b", F.levenshtein("name_a", "name_b").cast("long").alias("distance"), F.round(T.levenshtein_similarity(F.col("name_a"), F.col("name_b")), 6).alias("similarity")
    )


# ---- hashing and vectors

FEATURES_SQL = "list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')"
HASHED_SQL = f"""WITH w AS (SELECT doc_id AS id, {FEATURES_SQL} AS w FROM documents),
t AS (SELECT id, unnest(list_concat(w, {sql_pairs('w', ' ')})) AS token FROM w),
b AS (SELECT id, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT % {values.HASH_BUCKETS} AS bucket FROM (SELECT id, md5(token) AS h FROM t)),
c AS (SELECT id, bucket, count(*) AS tf FROM b GROUP BY ALL)
"""


@query(HASHED_SQL + "SELECT id, bucket, tf, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)), 6) AS weight FROM c")
def hash_features(spark, sf):
    return vector.hashed_counts(text_items(spark, sf)).select("id", "bucket", "tf", F.round("weight", 6).alias("weight"))


@query()
def embed_projection(spark, sf):
    return vector.embed(D.indications(spark, sf), "indication_text").select("id", F.size("vector").alias("dim"), F.round(F.sqrt(T.cosine(F.col("vector"), F.col("vector"))), 2).alias("norm"))


def embeddings(spark, sf):
    return D.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def vector_queries(spark, sf, every: int):
    return embeddings(spark, sf).filter(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vector")


def vector_sql(where: str, extra: str = "", k: int = 20) -> str:
    dot = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
    return f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS id, round({dot}, 5) AS score FROM embeddings a, embeddings b WHERE {where})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s {extra}) WHERE rank <= {k}"""


@query(vector_sql("b.vec_id % 100 = 0"))
def search_vector_batch(spark, sf):
    return long_rank(vector.top_k(embeddings(spark, sf), vector_queries(spark, sf, 100), 20, -2.0, digits=5))


@query(vector_sql("b.vec_id % 100 = 0", "WHERE score >= 0.3"))
def search_vector_min_score(spark, sf):
    return long_rank(vector.top_k(embeddings(spark, sf), vector_queries(spark, sf, 100), 20, 0.3, digits=5))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT l_orderkey FROM lineitem)")
def incremental_anti(spark, sf):
    done = D.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    return embeddings(spark, sf).select("id").join(done, "id", "left_anti")


# ---- fusion of BM25 over all indications with cosine over all rows of `embeddings`, taken as the vectors of the ids they name;
# the *_searched queries below embed the indications' own texts instead, which SQL can't state

QUERY_VECTORS = 100  # query n is the vector of id 100 * (n + 1)
SIDES_SQL = f"""{PARTS_SCORED}, lex AS ({sql_top(50)}),
vs AS (SELECT query_id, a.vec_id AS id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 5) AS score FROM q JOIN embeddings b ON b.vec_id = {QUERY_VECTORS} * (query_id + 1), embeddings a),
near AS (SELECT * FROM vs WHERE score >= 0),
vec AS ({sql_top(50, 'near')}),
side AS (SELECT coalesce(lex.query_id, vec.query_id) AS query_id, coalesce(lex.id, vec.id) AS id, lex.rank AS lr, vec.rank AS vr, lex.score AS ls, vec.score AS vsc FROM lex FULL JOIN vec ON lex.query_id = vec.query_id AND lex.id = vec.id)
"""


def two_sides(spark, sf):
    own = spark.range(len(SYMPTOMS)).select(F.col("id").alias("query_id"), (QUERY_VECTORS * (F.col("id") + 1)).alias("vec_id"))
    queries = embeddings(spark, sf).join(F.broadcast(own), F.col("id") == F.col("vec_id")).select("query_id", "vector")  # a stated set of two queries
    return part_hits(spark, sf), vector.top_k(embeddings(spark, sf), queries, 50, digits=5)


def fused_sql(score: str, kind: str, order: str = "round(score, 6) DESC, coalesce(lr, 50 + vr), id") -> str:
    return f"{SIDES_SQL}, fz AS (SELECT *, {score} AS score, {kind} AS match_type FROM side) SELECT query_id, id, round(score, 6) AS score, match_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM fz) WHERE rank <= 20"


PRESENT = "CASE WHEN lr IS NOT NULL AND vr IS NOT NULL THEN 'hybrid' WHEN lr IS NOT NULL THEN 'lexical' ELSE 'vector' END"


@query(fused_sql("coalesce(1.0 / (60 + lr), 0) + coalesce(1.0 / (60 + vr), 0)", PRESENT))
def fuse_rrf(spark, sf):
    return long_rank(fusion.rrf(*two_sides(spark, sf), digits=6))


@query(fused_sql("CASE WHEN ls > 0 THEN 0.4 * ls ELSE 0 END + CASE WHEN vsc > 0 THEN 0.6 * vsc ELSE 0 END", "CASE WHEN ls > 0 AND vsc > 0 THEN 'hybrid' WHEN ls > 0 THEN 'lexical' ELSE 'vector' END"))
def fuse_weighted(spark, sf):
    return long_rank(fusion.weighted(*two_sides(spark, sf), digits=6))


@query(
    fused_sql(
        "CASE WHEN coalesce(2 * (lr - 1), 1e9) < coalesce(2 * (vr - 1) + 1, 1e9) THEN ls ELSE vsc END",
        "CASE WHEN coalesce(2 * (lr - 1), 1e9) < coalesce(2 * (vr - 1) + 1, 1e9) THEN 'lexical' ELSE 'vector' END",
        "least(coalesce(2 * (lr - 1), 1e9), coalesce(2 * (vr - 1) + 1, 1e9)), id",
    )
)
def fuse_interleave(spark, sf):
    return long_rank(fusion.interleave(*two_sides(spark, sf), digits=6))


def searched(spark, sf, method: str = "rrf", limit: int = 20) -> DataFrame:
    """The hybrid search of the engine over all indications: BM25, and cosine over embedded texts."""
    items = D.indications(spark, sf)
    text = vector.index_text(items["normalized_text"], items["indication_text"])
    vectors = vector.embed(items.select("id", text.alias("text")))
    engine = ranking.Engine(spark, D.botanicals(spark, sf), items, D.edges(spark, sf), lexical.build_index(items, PLAIN), vectors=vectors, analysis=PLAIN, fusion_method=method)
    return long_rank(engine.search(lexical.query_table(spark, SYMPTOMS), "hybrid", limit, digits=6))


@query()
def fuse_rrf_searched(spark, sf):
    return searched(spark, sf)


@query()
def fuse_weighted_searched(spark, sf):
    return searched(spark, sf, "weighted")


@query()
def fuse_interleave_searched(spark, sf):
    return searched(spark, sf, "interleave")


# ---- ranking of remedies


def repertorize_sql(evidence: bool = True, n: int = 20, retrieval: str | None = None, cases: str = "SELECT query_id AS case_id, query_id, 0 AS ord FROM q") -> str:
    mult = "CASE evidence_level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.EVIDENCE_MULTIPLIER.items()) + " ELSE 1.0 END" if evidence else "1.0"
    return f"""{retrieval or PARTS_SCORED + ', hits AS (' + sql_top(10) + ')'}, cs AS ({cases}),
edges AS ({D.SQL['edges']}), bot AS ({D.SQL['botanicals']}),
c AS (SELECT case_id, cs.ord, hits.rank AS hr, botanical_id, weight, weight * {mult} * (0.5 + 0.5 * hits.score) AS s FROM hits JOIN cs USING (query_id) JOIN edges ON indication_id = hits.id),
g AS (SELECT case_id, botanical_id, round(sum(s), 4) AS total_score, count(*) AS n_matches, min((ord, hr, -weight, botanical_id)) AS first FROM c GROUP BY ALL)
SELECT case_id::BIGINT AS case_id, botanical_id, latin_binomial, total_score, n_matches, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY total_score DESC, first) AS rank FROM g) JOIN bot ON bot.id = botanical_id WHERE rank <= {n}"""


def repertorized(spark, sf, hits, cases, evidence=True, n=20):
    scored = ranking.contributions(hits.join(F.broadcast(cases), "query_id"), D.edges(spark, sf), evidence)
    ranked = ranking.rank_remedies(scored, n, digits=4)
    b = D.botanicals(spark, sf).select(F.col("id").alias("botanical_id"), "latin_binomial")
    return long_rank(ranked.join(b, "botanical_id").select("case_id", "botanical_id", "latin_binomial", "total_score", "n_matches", "rank"))


def own_cases(spark):
    return spark.range(len(SYMPTOMS)).select(F.col("id").alias("query_id"), F.col("id").alias("case_id"), F.lit(0).alias("ord"))


ONE_CASE = "SELECT 0 AS case_id, query_id, query_id AS ord FROM q"


@query(repertorize_sql(cases=ONE_CASE))
def repertorize_lexical(spark, sf):
    """Flagship: two symptoms, ten rubrics each, remedies by weighted evidence."""
    cases = own_cases(spark).select("query_id", F.lit(0).cast("long").alias("case_id"), F.col("query_id").cast("int").alias("ord"))
    return repertorized(spark, sf, part_hits(spark, sf, 10), cases)


@query(repertorize_sql())
def repertorize_batch(spark, sf):
    return repertorized(spark, sf, part_hits(spark, sf, 10), own_cases(spark))


@query(repertorize_sql(evidence=False))
def repertorize_no_evidence(spark, sf):
    return repertorized(spark, sf, part_hits(spark, sf, 10), own_cases(spark), evidence=False)


@query(repertorize_sql(retrieval=f"{SIDES_SQL}, fz AS (SELECT *, coalesce(1.0 / (60 + lr), 0) + coalesce(1.0 / (60 + vr), 0) AS score FROM side), hits AS (SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, coalesce(lr, 50 + vr), id) AS rank FROM fz) WHERE rank <= 10)"))
def repertorize_hybrid(spark, sf):
    return repertorized(spark, sf, fusion.rrf(*two_sides(spark, sf), limit=10, digits=6), own_cases(spark))


@query()
def repertorize_hybrid_searched(spark, sf):
    return repertorized(spark, sf, searched(spark, sf, limit=10), own_cases(spark))


@query(
    f"WITH e AS ({D.SQL['edges']}), g AS (SELECT botanical_id, evidence_level, sum(weight) AS s FROM e GROUP BY ALL) SELECT botanical_id, arg_max(evidence_level, (round(s, 6), CASE evidence_level "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.EVIDENCE_MULTIPLIER.items())
    + " END, evidence_level)) AS primary_evidence FROM g GROUP BY botanical_id"
)
def primary_evidence(spark, sf):
    return relational.primary_evidence(D.edges(spark, sf).withColumn("score", F.col("weight")))


# ---- relational


@query(D.with_tables("edges", "botanicals") + "SELECT indication_id, botanical_id, latin_binomial, family, weight, evidence_level FROM edges JOIN botanicals b ON b.id = botanical_id")
def edges_by_indication(spark, sf):
    return relational.edges_of_indications(D.edges(spark, sf), D.botanicals(spark, sf)).select("indication_id", "botanical_id", "latin_binomial", "family", "weight", "evidence_level")


@query(D.with_tables("edges", "indications") + "SELECT botanical_id, indication_id, indication_text, category, weight FROM edges JOIN indications i ON i.id = indication_id")
def edges_by_botanical(spark, sf):
    return relational.edges_of_botanicals(D.edges(spark, sf), D.indications(spark, sf)).select("botanical_id", "indication_id", "indication_text", "category", "weight")


@query(D.with_tables("edges", "botanicals") + "SELECT indication_id, botanical_id, latin_binomial, evidence_level FROM edges JOIN botanicals b ON b.id = botanical_id WHERE evidence_level IN ('systematic_review', 'clinical_trial', 'clinical_observation')")
def min_evidence_filter(spark, sf):
    return relational.edges_of_indications(D.edges(spark, sf), D.botanicals(spark, sf), "clinical_observation").select("indication_id", "botanical_id", "latin_binomial", "evidence_level")


@query(
    D.with_tables("botanicals", "contraindications", "interactions")
    + ", c AS (SELECT botanical_id, count(*) AS n, bool_or(severity = 'absolute') AS x FROM contraindications GROUP BY 1), d AS (SELECT botanical_id, count(*) AS n, bool_or(interaction_severity = 'severe') AS x FROM interactions GROUP BY 1) SELECT b.id AS botanical_id, latin_binomial, coalesce(c.n, 0) AS n_contra, coalesce(d.n, 0) AS n_interactions, coalesce(c.x, false) OR coalesce(d.x, false) AS critical FROM botanicals b LEFT JOIN c ON c.botanical_id = b.id LEFT JOIN d ON d.botanical_id = b.id"
)
def safety_profile(spark, sf):
    return relational.safety_profiles(D.botanicals(spark, sf), D.contraindications(spark, sf), D.interactions(spark, sf))


NAMES = ["Supplier#000000001", "Supplier#000000002", "Supplier#000000003"]


@query(
    D.with_tables("edges", "botanicals", "indications")
    + f"SELECT indication_text, array_to_string(list_sort(list(DISTINCT latin_binomial)), ',') AS names FROM edges JOIN botanicals b ON b.id = botanical_id JOIN indications i ON i.id = indication_id WHERE latin_binomial IN ({', '.join(repr(n) for n in NAMES)}) GROUP BY 1 HAVING count(DISTINCT latin_binomial) > 1"
)
def compare_botanicals(spark, sf):
    return relational.compare(D.edges(spark, sf), D.botanicals(spark, sf), D.indications(spark, sf), NAMES).withColumn("names", F.array_join("names", ","))


@query("SELECT s_suppkey AS id, s_name AS latin_binomial FROM supplier WHERE s_name ILIKE '%uPPlier#0000000_1%' ORDER BY id LIMIT 50")
def botanical_like(spark, sf):
    return D.botanicals(spark, sf).filter(F.col("latin_binomial").ilike("%uPPlier#0000000_1%")).select("id", "latin_binomial").orderBy("id").limit(50)


@query(D.with_tables("indications") + "SELECT id, indication_text FROM indications WHERE category = 'promo' ORDER BY id LIMIT 100")
def by_category(spark, sf):
    return D.indications(spark, sf).filter("category = 'promo'").select("id", "indication_text").orderBy("id").limit(100)


@query(D.with_tables("indications") + "SELECT DISTINCT category FROM indications WHERE category IS NOT NULL")
def categories(spark, sf):
    return D.indications(spark, sf).filter("category IS NOT NULL").select("category").distinct()


@query(D.with_tables("raw_edges") + "SELECT DISTINCT evidence_level FROM raw_edges WHERE evidence_level <> ''")
def evidence_levels(spark, sf):
    return D.raw_edges(spark, sf).filter("evidence_level <> ''").select("evidence_level").distinct()


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {t}" for n, t in (("botanicals", "supplier"), ("indications", "part"), ("raw_edges", "lineitem"), ("docs", "documents"))))
def table_stats(spark, sf):
    return relational.table_counts({"botanicals": D.botanicals(spark, sf), "indications": D.indications(spark, sf), "raw_edges": D.raw_edges(spark, sf), "docs": D.read(spark, sf, "documents")})


@query("SELECT p_name, min(p_partkey) AS id FROM part GROUP BY p_name")
def dedupe_first_wins(spark, sf):
    p = D.read(spark, sf, "part").select("p_name", F.col("p_partkey").alias("id"))
    return first_wins(p, ["p_name"], ["id"])


@query(D.with_tables("edges") + "SELECT indication_id, botanical_id, weight, source_ref FROM edges")
def dedupe_last_wins(spark, sf):
    return last_wins(D.raw_edges(spark, sf), ["indication_id", "botanical_id", "preparation"], ["source_ref", "line", "weight", "evidence_level"]).select("indication_id", "botanical_id", "weight", "source_ref")


@query("SELECT p_partkey AS id, CASE WHEN len(string_split(p_name, ' ')) >= 2 THEN substr(p_name, 1, 1) || '. ' || string_split(p_name, ' ')[2] ELSE p_name END AS short_name FROM part")
def short_name(spark, sf):
    return D.indications(spark, sf).select("id", T.short_name(F.col("indication_text")).alias("short_name"))


@query(D.with_tables("raw_edges") + "SELECT source_ref, line, round(weight * CASE evidence_level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.EVIDENCE_MULTIPLIER.items()) + " ELSE 1.0 END, 4) AS total_score FROM raw_edges")
def evidence_score(spark, sf):
    return D.raw_edges(spark, sf).select("source_ref", "line", F.round(F.col("weight") * T.evidence_multiplier(F.col("evidence_level")), 4).alias("total_score"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_properties(spark, sf):
    return D.read(spark, sf, "events").select("event_id", F.element_at(T.json_or_map(F.col("props")), "k").alias("k"))


@query(
    repertorize_sql(cases=ONE_CASE).replace("SELECT case_id::BIGINT AS case_id, botanical_id, latin_binomial, total_score, n_matches, rank FROM", "SELECT rank, latin_binomial, printf('%.2f', total_score) AS score, n_matches FROM")
)
def export_csv_projection(spark, sf):
    return repertorize_lexical(spark, sf).select("rank", "latin_binomial", F.format_string("%.2f", "total_score").alias("score"), "n_matches")


@query(f"SELECT rank, to_json({{'rank': rank, 'botanical_id': botanical_id, 'latin_binomial': latin_binomial, 'total_score': total_score, 'n_matches': n_matches}})::VARCHAR AS row_json FROM ({repertorize_sql(cases=ONE_CASE)})")
def export_json_rows(spark, sf):
    return repertorize_lexical(spark, sf).select("rank", F.to_json(F.struct("rank", "botanical_id", "latin_binomial", "total_score", "n_matches")).alias("row_json"))


# ---- extraction

#: Cases for the tests: the tables hardly have such sentences.
SENTENCES = [
    "Traditionally used for anxiety and sleeplessness. Contraindicated in pregnancy and lactation.",
    "Indicated for head pain; a randomized controlled trial showed effect. May interact warfarin strongly.",
    "Treats low mood\nHelpful for joint pain.",
    "Avoid during breastfeeding. Use caution with sedatives. Fatal in large doses.",
    "Hypericum perforatum and H. perforatum, Hypericum perforatum var. angustifolium. See Figure 1 in the Appendix.",
    "Absolute contraindication. Laboratory study of cell culture.",
]


def rules_sql(x: str, rules: dict, default: str = "NULL") -> str:
    hits = " ".join("WHEN " + " OR ".join(f"contains(lower({x}), '{k}')" for k in ks) + f" THEN '{n}'" for n, ks in rules.items())
    return f"CASE {hits} ELSE {default} END"


# Word boundaries know ASCII only in the oracle's patterns: a digit stands for each other letter there.
ASCII = "regexp_replace({}, '[^\\x00-\\x7F]', '0', 'g')"


@query(f"SELECT doc_id, unnest(list_distinct(regexp_extract_all({ASCII.format('text')}, '{values.DOCUMENT_BINOMIAL}', 1))) AS name FROM documents")
def extract_binomials(spark, sf):
    return D.read(spark, sf, "documents").select("doc_id", F.explode(E.document_binomials(F.col("text"))).alias("name"))


@query(f"SELECT doc_id, {rules_sql('text', values.CATEGORY_RULES)} AS category FROM documents")
def categorize(spark, sf):
    return D.read(spark, sf, "documents").select("doc_id", E.categorize(F.col("text")).alias("category"))


EVIDENCE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{level}'" for level, p in values.EVIDENCE_PATTERNS) + " ELSE 'traditional' END"


@query()
def chunk_documents(spark, sf):
    return chunks.chunk(D.read(spark, sf, "documents"))


NAMES_SQL = f"list_distinct(regexp_extract_all({ASCII.format('text')}, '{values.DOCUMENT_BINOMIAL}', 1))"


@query(f"SELECT doc_id, name_a, unnest(terms) AS name_b FROM (SELECT doc_id, unnest({NAMES_SQL}) AS name_a, list_distinct(regexp_extract_all(text, '[a-z]{{9,}}')) AS terms FROM documents)")
def doc_pairs_edges(spark, sf):
    """Names x terms of each whole document: the edge rule of ingestion."""
    return document_pairs(D.read(spark, sf, "documents"))


def document_pairs(docs: DataFrame) -> DataFrame:
    """Both lists lie in the document's row, so pairs need no join; each is made once a document, not again for each name."""
    low = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{9,}"), 0))
    lists = F.struct(E.document_binomials(F.col("text")).alias("names"), low.alias("terms"))
    by_name = T.let(lists, lambda x: F.transform(x["names"], lambda n: F.struct(n.alias("name_a"), x["terms"].alias("terms"))))
    named = relational.exploded(docs, by_name, "doc_id").select("doc_id", "x.name_a", "x.terms")
    return relational.exploded(named, F.col("terms"), "doc_id", "name_a", name="name_b")


ASCII_LOW = f"lower({ASCII.format('text')})"


def sql_matches(patterns: list[str], x: str = "text") -> str:
    return " || ".join(f"regexp_extract_all({x}, '{p}', 1)" for p in patterns)


def sql_clean(x: str) -> str:
    spaced = f"trim(regexp_replace({x}, '[\\s\\x0B]+', ' ', 'g'))"
    marked = f"regexp_replace({spaced}, '^[-\\*\\+•‣\\d\\.)\\]]+[\\s\\x0B]*', '')"
    return f"trim(substr(regexp_replace({marked}, '[.;,]+$', ''), 1, 200))"


def sql_standard(x: str) -> str:
    low = f"lower({ASCII.format(x)})"
    return "CASE " + " ".join(f"WHEN regexp_matches({low}, '{p}') THEN '{n}'" for p, n in values.NORMALIZATION_RULES) + f" ELSE {sql_clean(x)} END"


#: A note for every row of part joins the documents, which hold hardly a trigger phrase.
NOTE = ["Traditionally used for ", "p_name", ". Contraindicated in ", "p_type", ". May interact ", "p_brand", " strongly; avoid.\n- Indicated for ", "p_type", "\n"]
NOTES_SQL = "(SELECT doc_id, text FROM documents UNION ALL SELECT -1 - p_partkey AS doc_id, " + " || ".join(x if x.startswith("p_") else "'" + x.replace("\n", "' || chr(10) || '") + "'" for x in NOTE) + " AS text FROM part)"


def noted(spark, sf) -> DataFrame:
    note = F.concat(*[F.col(x) if x.startswith("p_") else F.lit(x) for x in NOTE])
    notes = D.read(spark, sf, "part").select((-1 - F.col("p_partkey")).alias("doc_id"), note.alias("text"))
    return D.read(spark, sf, "documents").select("doc_id", "text").unionByName(notes)


def found_in(docs: DataFrame, found, name: str) -> DataFrame:
    return relational.exploded(docs, found(F.col("text")), "doc_id", name=name)


@query(
    f"WITH r AS (SELECT doc_id, list_filter(list_transform({sql_matches(values.INDICATION_PATTERNS)}, lambda x: {sql_clean('x')}), lambda x: x <> '') AS l FROM " + NOTES_SQL + "), "
    "u AS (SELECT doc_id, unnest(list_filter(l, lambda x, i: NOT list_contains(list_transform(l[1:i - 1], lambda y: lower(y)), lower(x)))) AS x FROM r) "
    f"SELECT doc_id, {sql_standard('x')} AS indication FROM u"
)
def extract_indications(spark, sf):
    return found_in(noted(spark, sf), E.indications, "indication")


@query(f"SELECT doc_id, trim(unnest({sql_matches(values.CONTRAINDICATION_PATTERNS)})) AS contraindication FROM " + NOTES_SQL)
def detect_contraindications(spark, sf):
    return found_in(noted(spark, sf), lambda t: F.transform(E.contraindications(t), lambda c: c["value"]), "contraindication")


@query(f"SELECT doc_id, trim(unnest({sql_matches(values.INTERACTION_PATTERNS)})) AS interaction FROM " + NOTES_SQL)
def detect_interactions(spark, sf):
    return found_in(noted(spark, sf), E.interactions, "interaction")


@query(f"SELECT doc_id, {rules_sql('text', values.SEVERITY_RULES, repr('moderate'))} AS severity FROM " + NOTES_SQL)
def detect_severity(spark, sf):
    return noted(spark, sf).select("doc_id", E.severity(F.col("text")).alias("severity"))


@query(f"SELECT doc_id, {EVIDENCE_SQL.replace('lower(text)', ASCII_LOW)} AS level FROM " + NOTES_SQL)
def detect_evidence(spark, sf):
    return noted(spark, sf).select("doc_id", E.evidence(F.col("text"))["level"].alias("level"))


@query(f"SELECT doc_id, {sql_standard('text')} AS standard FROM " + NOTES_SQL)
def normalize_indications(spark, sf):
    return noted(spark, sf).select("doc_id", E.normalize_indication(F.col("text")).alias("standard"))


MONOGRAPH = """# Chamomile

Intro line

## Indications
- Mild stomach pain
* Cough and cold
1. Insomnia
- no

## Contraindications
- Avoid in severe allergy
- Never use with alcohol

## Safety Notes
+ Use with caution
"""


def written(spark, sf) -> DataFrame:
    """id, t: a monograph in Markdown for every row of part, since no table holds Markdown."""
    p = [F.col(c).cast("string") for c in ("p_name", "p_type", "p_brand")]
    pieces = ["# ", p[0], "\n\nIntro of ", p[0], "\n\n## Indications\n- Mild ", p[0], " pain\n* ", p[1], "\n1. ", p[2], " cough\n- no\n\n## Contraindications\n- Avoid ", p[0], "\n- Never with ", p[1], "\n\n## Safety Notes\n+ Caution: ", p[2], "\n"]
    parts = relational.spread(D.read(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand"), "p_partkey")
    return parts.select(F.col("p_partkey").alias("id"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in pieces]).alias("t"))


def written_sql(rows: list[tuple[str, str]], columns: str, rules: str) -> str:
    """rows: (text of a bullet as SQL, name of its section)."""
    parts = " UNION ALL ".join(f"SELECT p_partkey AS id, {text} AS text, '{section}' AS section FROM part" for text, section in rows)
    return f"SELECT {columns}, {rules} FROM ({parts}) WHERE length(text) > 3"


@query("SELECT p_partkey AS id, p_name AS title, unnest([p_name, 'indications', 'contraindications', 'safety notes']) AS section, unnest([length('Intro of ' || p_name), length('- Mild ' || p_name || ' pain' || chr(10) || '* ' || p_type || chr(10) || '1. ' || p_brand || ' cough' || chr(10) || '- no'), length('- Avoid ' || p_name || chr(10) || '- Never with ' || p_type), length('+ Caution: ' || p_brand)])::INT AS size FROM part")
def markdown_sections(spark, sf):
    got = relational.exploded(written(spark, sf), E.sections(F.col("t")), "id", E.markdown_title(F.col("t")).alias("title"), name="s")
    return got.select("id", "title", F.col("s.name").alias("section"), F.length("s.content").alias("size"))


@query(written_sql([("'Mild ' || p_name || ' pain'", "indications"), ("p_type", "indications"), ("p_brand || ' cough'", "indications")], "id, text, section", f"{rules_sql('text', values.DOCUMENT_CATEGORY_RULES)} AS category"))
def markdown_indications(spark, sf):
    return relational.exploded(written(spark, sf), E.markdown_indications(F.col("t")), "id", name="i").select("id", "i.text", "i.section", "i.category")


@query(written_sql([("'Avoid ' || p_name", "c"), ("'Never with ' || p_type", "c"), ("'Caution: ' || p_brand", "s")], "id, text", f"{rules_sql('text', values.DOCUMENT_SEVERITY_RULES, repr('mild'))} AS severity"))
def markdown_safety(spark, sf):
    return relational.exploded(written(spark, sf), E.markdown_safety(F.col("t")), "id", name="i").select("id", "i.text", "i.severity")


SENTENCES_OF = "regexp_replace(regexp_replace(regexp_replace(text, '\\(\\d+[–\\-]?\\d*\\)', '', 'g'), '\\n+', ' ', 'g'), '([.!?])[\\s\\x0B]+', '\\1' || chr(1), 'g')"


@query(f"SELECT doc_id, unnest(list_filter(list_transform(string_split({SENTENCES_OF}, chr(1)), lambda x: trim(x)), lambda x: length(x) > 10)) AS sentence FROM documents")
def split_sentences(spark, sf):
    return found_in(D.read(spark, sf, "documents"), E.sentences, "sentence")


MARKED_SQL = " OR ".join(f"contains(lower(x), '{m}')" for m in values.INDICATION_MARKERS)


def sql_unmarked(x: str) -> str:
    for mark in ("-", "*", "•", "‣"):
        x = f"list_transform({x}, lambda x: CASE WHEN starts_with(x, '{mark}') THEN trim(substr(x, 2)) ELSE x END)"
    return x


@query(f"SELECT doc_id, unnest(list_filter({sql_unmarked(f'list_transform(list_filter(string_split(text, chr(10)), lambda x: {MARKED_SQL}), lambda x: trim(x))')}, lambda x: length(x) > 10 AND length(x) < 200)) AS line FROM " + NOTES_SQL)
def text_indications(spark, sf):
    return found_in(noted(spark, sf), E.text_indications, "line")


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS n_lines, substr(trim(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')[1]), 1, 100) AS title FROM documents")
def text_titles(spark, sf):
    t = F.col("text")
    return D.read(spark, sf, "documents").select("doc_id", F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n_lines"), E.text_title(t).alias("title"))
