"""Operators of the engine on small literal inputs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from wellspring.functions import extract as E
from wellspring.functions import monographs, stemmer
from wellspring.functions import text as T
from wellspring.operators import chunks, fusion, lexical, vector
from wellspring.plans import catalog, ingest, ranking
from wellspring.sources.store import Store, first_wins, last_wins

BOTANICALS = [(1, "Matricaria recutita", ["Chamomile"], "Asteraceae"), (2, "Hypericum perforatum", ["St. John's Wort"], "Hypericaceae"), (3, "Valeriana officinalis", ["Valerian"], "Caprifoliaceae")]
INDICATIONS = [(1, "Insomnia", "insomnia", "sleep"), (2, "Anxiety", "anxiety", "mental"), (3, "Depression", "depression", "mental"), (4, "Nervous tension", "nervous tension", "mental")]
EDGES = [(1, 1, 2.0, "clinical_trial"), (1, 2, 2.0, "clinical_trial"), (1, 4, 1.0, "traditional"), (2, 3, 3.0, "clinical_trial"), (2, 2, 1.5, "clinical_observation"), (3, 1, 2.5, "clinical_trial"), (3, 4, 1.0, "traditional")]


@pytest.fixture(scope="module")
def base(spark):
    b = spark.createDataFrame(BOTANICALS, "id long, latin_binomial string, common_names array<string>, family string")
    i = spark.createDataFrame(INDICATIONS, "id long, indication_text string, normalized_text string, category string")
    e = spark.createDataFrame(EDGES, "botanical_id long, indication_id long, weight double, evidence_level string").withColumn("preparation", F.lit(""))
    c = spark.createDataFrame([(2, "absolute")], "botanical_id long, severity string")
    d = spark.createDataFrame([(1, "mild"), (3, "severe")], "botanical_id long, interaction_severity string")
    vectors = vector.embed(i.select("id", F.col("normalized_text").alias("text"))).cache()
    return ranking.Engine(spark, b, i, e, lexical.build_index(i), c, d, vectors)


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "word, want",
    [("running", "run"), ("flies", "fli"), ("depression", "depress"), ("at", "at"), ("is", "is"), ("agreeing", "agr"), ("anxiety", "anxiety"), ("rational", "rate"), ("caresses", "caress"), ("hopping", "hop"), ("sky", "sky"), ("", "")],
)
def test_stems(word, want):
    assert stemmer.stem(word) == want


def test_stem_vocabulary_is_distinct(spark):
    got = stemmer.stemmed_vocabulary(spark.createDataFrame([("running",), ("running",), ("tests",)], "word string")).collect()
    assert {r.word: r.stem for r in got} == {"running": "run", "tests": "test"}


def test_scores_of_a_hand_computed_corpus(base):
    hits = base.search(base.queries(["insomnia"]), "lexical").collect()
    assert [(r.id, r.rank) for r in hits] == [(1, 1)] and abs(hits[0].score - 12.502277) < 1e-5
    ranked = base.repertorize(["insomnia"], mode="lexical").orderBy("rank").collect()
    assert [r.latin_binomial for r in ranked] == ["Valeriana officinalis", "Matricaria recutita"]
    assert abs(ranked[0].total_score - 42.194616) < 1e-5 and abs(ranked[1].total_score - 33.755693) < 1e-5
    assert [r.critical for r in ranked] == [True, False]


def test_reloaded_index(base, tmp_path):
    base.index.save(str(tmp_path))
    zero = lexical.LexicalIndex.load(base.spark, str(tmp_path), "zero")
    got = lexical.search(zero, base.queries(["insomnia"]), base.indications).first()
    assert abs(got.score - 43.189685) < 1e-5


def test_batch_equals_single_queries(base):
    texts = ["insomnia", "nervous anxiety", '"nervous tension"', "nothing here", "", "anxiety not depression"]
    for mode in ranking.MODES:
        whole = base.search(base.queries(texts), mode).collect()
        for n, t in enumerate(texts):
            single = base.search(base.queries([t]), mode).collect()
            assert [(r.id, round(r.score, 9)) for r in sorted(single, key=lambda r: r["rank"])] == [(r.id, round(r.score, 9)) for r in sorted(whole, key=lambda r: r["rank"]) if r.query_id == n]
    with pytest.raises(ValueError):
        base.search(base.queries(["x"]), "other")


def test_top_n_is_a_prefix_and_weight_counts(base):
    many = [r.botanical_id for r in base.repertorize("insomnia, anxiety").orderBy("rank").collect()]
    assert [r.botanical_id for r in base.repertorize(["insomnia", "anxiety"], top_n=2).orderBy("rank").collect()] == many[:2]
    plain = {r.botanical_id: r.total_score for r in base.repertorize(["anxiety"], mode="lexical", evidence_weight=False).collect()}
    assert plain[1] > plain[2]


def test_strict_operators(base):
    q = base.queries(["anxiety NOT nervous", "insomnia OR depression"])
    got = lexical.search(base.index, q, base.indications, strict_operators=True).collect()
    assert {(r.query_id, r.id) for r in got} == {(0, 2), (1, 1), (1, 3)}


def test_fusion(spark):
    kind = "query_id long, id long, score double, rank int"
    a = spark.createDataFrame([(0, 1, 9.0, 1), (0, 2, 8.0, 2)], kind)
    b = spark.createDataFrame([(0, 2, 0.9, 1), (0, 3, 0.8, 2)], kind)
    order = lambda df: [(r.id, r.match_type) for r in df.orderBy("rank").collect()]
    assert order(fusion.rrf(a, b)) == [(2, "hybrid"), (1, "lexical"), (3, "vector")]
    assert order(fusion.weighted(a, b)) == [(2, "hybrid"), (1, "lexical"), (3, "vector")]
    assert order(fusion.interleave(a, b)) == [(1, "lexical"), (2, "vector"), (3, "vector")]
    assert abs(fusion.rrf(a, b).filter("id = 1").first().score - 1 / 61) < 1e-12
    with pytest.raises(ValueError):
        fusion.fuse(a, b, "none")


def test_hash_buckets_and_embeddings(spark):
    for text, want in (("anxiety", 4963), ("anxiety stress", 9163), ("é", 1174)):
        assert one(spark, lambda c: T.bucket(c), text) == want
    items = spark.createDataFrame([(1, "anxiety and stress"), (2, "anxiety and worry"), (3, "botanical garden"), (4, "")], "id long, text string")
    v = {r.id: r.vector for r in vector.embed(items, dim=128).collect()}
    dot = lambda x, y: sum(a * b for a, b in zip(v[x], v[y]))
    assert len(v[1]) == 128 and abs(dot(1, 1) - 1) < 1e-2 and dot(1, 2) > dot(1, 3) and dot(4, 4) == 0
    have = vector.embed(items.filter("id < 3"))
    assert vector.incremental(have, items).count() == 4


def test_top_k_against_brute_force(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(300)] + [(300, None)]
    asked = [(q, [float(r.randint(-2, 2)) for _ in range(4)]) for q in range(9)] + [(9, [0.0] * 4)]
    vectors, queries = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3), spark.createDataFrame(asked, "query_id long, vector array<float>")
    want = []
    for q, x in asked[:9]:
        scored = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in rows[:300])
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(scored[:7]) if -s >= 1.0] if any(x) else []
    for block in (4096, 2):
        monkeypatch.setattr(vector, "QUERY_BLOCK", block)
        monkeypatch.setattr(vector, "ROW_BLOCK", 50)
        assert sorted(map(tuple, vector.top_k(vectors, queries, 7, 1.0, digits=5).select("query_id", "id", "score", "rank").collect())) == sorted(want)
    assert vector.top_k(vectors.filter("id < 0"), queries, 7).count() == 0 and vector.top_k(vectors, queries.filter("query_id > 8"), 7).count() == 0


def test_text_functions(spark):
    assert one(spark, lambda c: T.tokens(c, stem=False), "The chronic anxiety, disorder's") == ["chronic", "anxiety", "disorder's", "chronic_anxiety", "anxiety_disorder's"]
    assert {"sleeplessness", "sleep disorder", "insomnia"} <= set(one(spark, lambda c: T.expand_synonyms(F.array(c)), "insomnia"))
    assert [one(spark, T.short_name, x) for x in ("Hypericum perforatum", "Single")] == ["H. perforatum", "Single"]
    assert [one(spark, T.json_or_list, x) for x in ("", '["a","b"]', "5", "a, b")] == [[], ["a", "b"], ["5"], ["a, b"]]
    assert [one(spark, T.json_or_map, x) for x in ('{"a":"b"}', "[1]", "x")] == [{"a": "b"}, {}, {}]
    pairs = spark.createDataFrame([("headache", "headach"), ("", ""), ("anxiety", "botanical")], "a string, b string")
    s = [r[0] for r in pairs.select(T.levenshtein_similarity(F.col("a"), F.col("b"))).collect()]
    assert s[0] > 0.8 and s[1] == 1.0 and s[2] < 0.5


def test_extraction(spark):
    assert [x.value for x in one(spark, E.binomials, "Hypericum perforatum var. angustifolium, H. perforatum; Hypericum perforatum")] == ["Hypericum perforatum", "H. perforatum", "Hypericum perforatum var. angustifolium"]
    assert one(spark, E.primary_binomial, "Aa bb. Cc dd var. ee") == "Cc dd var. ee"
    assert one(spark, E.normalize_binomial, "Hypericum Perforatum var. Angustifolium") == "Hypericum perforatum var. angustifolium"
    assert "anxiety" in one(spark, E.indications, "Traditionally used for anxiety and depression.")
    assert [one(spark, E.normalize_indication, x) for x in ("sleeplessness", "head pain", "- Other thing.")] == ["insomnia", "headache", "Other thing"]
    assert [one(spark, E.categorize, x) for x in ("insomnia", "anxiety", "stomach pain", "none")] == ["sleep", "mental", "pain", None]
    assert one(spark, E.evidence, "Randomized controlled trial showed")["level"] == "clinical_trial"
    got = one(spark, E.contraindications, "Contraindicated in pregnancy and lactation.")
    assert [(x.value, x.severity) for x in got] == [("pregnancy and lactation", "moderate")]
    assert [one(spark, E.severity, x) for x in ("Absolute contraindication", "May cause mild nausea", "x")] == ["absolute", "moderate", "moderate"]
    assert one(spark, E.bullet_indications, "- joint pain\n2. low mood\n- abc") == ["joint pain", "depression"]
    assert one(spark, E.text_indications, "- Used for cold feet in winter\nnothing\n* treats x") == ["Used for cold feet in winter"]


def test_markdown_sections(spark):
    text = catalog.MONOGRAPH
    assert one(spark, E.markdown_title, text) == "Chamomile"
    names = [s.name for s in one(spark, E.sections, text)]
    assert names == ["chamomile", "indications", "contraindications", "safety notes"]
    items = [x.text for x in one(spark, E.markdown_indications, text)]
    assert items == ["Mild stomach pain", "Cough and cold", "Insomnia"]
    assert len(one(spark, lambda c: E.markdown_indications(c, True), text)) == 5
    assert [x.severity for x in one(spark, E.markdown_safety, text)] == ["severe", "absolute", "moderate"]


def test_chunks_cover_the_text(spark):
    r = random.Random(0)
    for size, overlap in ((500, 100), (50, 10), (20, 19), (5, 9)):
        text = "".join(r.choice(["word ", "This is a test. ", "x", "! "]) for _ in range(200))
        spans = list(chunks.chunk_spans(text, size, overlap))
        starts = [s for s, *_ in spans]
        assert starts == sorted(set(starts)) and [n for _, _, n, _ in spans] == list(range(len(spans)))
        assert all(e <= len(text) and text[s:e].strip() == t for s, e, _, t in spans)
    spans = list(chunks.chunk_spans("Word " * 50, 100, 20))
    assert spans[1][0] < spans[0][1]
    df = spark.createDataFrame([(1, "a. b"), (2, None), (3, "")], "doc_id long, text string")
    assert [(x.doc_id, x.chunk_text) for x in chunks.chunk(df).collect()] == [(1, "a. b")]


VOLUME = (
    "Preface\nIntroduction\nsome words\n12\n"
    "\nFlos Chamomillae\n\nDefinition\nThe dried heads of Matricaria recutita L. (Asteraceae).\nSynonyms\nChamomilla vulgaris, Anthemis nobile (1); xx\n"
    "Selected vernacular names\nKamille, Baboonij; C\nDescription\nHerb.\nMedicinal uses\nUses supported by clinical data\nTreatment of sleeplessness in adults (1–3). Of pain in children.\n"
    "Uses described in folk medicine, not supported by\nclinical data\nTreatment of every ailment known.\nPharmacology\nx\nContraindications\nAllergy to plants of this family. Short.\nWarnings\nNo warning at all here.\n"
    "Precautions\nDrug interactions\nNone reported so far anywhere.\nAdverse reactions\nRare cases of allergy seen.\nPosology\nThree grams daily.\n"
    "\nRadix Valerianae\n\nDefinition\nThe root of Valeriana officinalis L. (Valerianaceae).\nMedicinal uses\nUses supported by clinical data\nAs a mild sedative in adults.\nPosology\nTwo grams."
)


def test_monographs(spark):
    volumes = spark.createDataFrame([(1, VOLUME)], "volume int, content string")
    got = monographs.parse(monographs.split_volumes(volumes)).orderBy("title").collect()
    assert [(r.title, r.latin_binomial, r.family) for r in got] == [("Flos Chamomillae", "Matricaria recutita L.", "Asteraceae"), ("Radix Valerianae", "Valeriana officinalis L.", "Valerianaceae")]
    a = got[0]
    assert a.indications_clinical == ["Treatment of sleeplessness in adults .", "Of pain in children."]
    assert a.indications_folk == ["Treatment of every ailment known."] and a.posology == "Three grams daily."
    assert a.drug_interactions == ["Drug interactions"] and a.vernacular_names == ["Kamille", "Baboonij"] and a.synonyms == ["Chamomilla vulgaris", "Anthemis nobile"]
    assert monographs.edges(monographs.parse(monographs.split_volumes(volumes))).count() == 4


def test_dedupe_rules(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, None, 3), (4, None, 4)], "id int, k string, o int")
    assert {r.id for r in first_wins(df, ["k"], ["o"]).collect()} == {1, 3}
    assert {r.id for r in last_wins(df, ["k"], ["o"]).collect()} == {2, 3, 4}


def test_store_and_ingestion(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# Chamomile\nMatricaria recutita is used.\n\n## Indications\n- Stomach pain\n- Insomnia\n")
    (docs / "Book_Vol1.txt").write_text(VOLUME)
    store = Store(spark, str(tmp_path / "store"))
    store.initialise()
    store.initialise()
    assert store.get_meta("schema_version") == "1"
    assert ingest.ingest_documents(store, str(docs), "md") == {"documents": 1, "turned_away": 0, "edges": 4}  # a bullet reads like a name
    assert ingest.ingest_documents(store, str(docs), "md")["turned_away"] == 1
    assert store.read("docs").count() == 1 and store.read("edges").count() == 4 and store.read("chunks").count() == 1
    assert ingest.ingest_monographs(store, str(docs))["monographs"] == 2
    assert store.read("botanicals").count() == 4 and store.read("contraindications").count() == 1
    with pytest.raises(ValueError):
        ingest.read_files(spark, str(docs), "pdf")


def test_exports(base, tmp_path):
    ranked = base.repertorize(["insomnia"], mode="lexical").cache()
    import json

    assert json.loads(ranking.export_json(ranked, str(tmp_path / "x.json")))["total_results"] == 2
    ranking.export_csv(ranked, str(tmp_path / "csv"))
    row = base.spark.read.csv(str(tmp_path / "csv"), header=True).orderBy("Rank").first()
    assert row["Latin Binomial"] == "Valeriana officinalis" and row["Score"] == "42.19" and row["Safety Warning"] == "Yes" and row["Evidence"] == "clinical_trial"
    assert "## 1. Valeriana officinalis" in ranking.export_markdown(ranked, ["insomnia"]) and "Valeriana" in ranking.format_text(ranked)


def test_document_pairs_reach_the_whole_text(spark):
    import re

    r = random.Random(4)
    far = " ".join(r.choice(["Rosa canina", "Salvia viridis", "inflammation", "sleeplessness", "x", "ab. Cd"]) for _ in range(80))
    rows = [(1, "x " * 150 + "Rosa canina " + "y " * 3000 + "restlessness"), (2, far), (3, None), (4, ""), (5, "Rosa canina")]
    want = []
    for i, t in rows:
        names = dict.fromkeys(re.findall(r"\b([A-Z][a-z]+\s+[a-z]+(?:\s+var\.\s+[a-z]+)?)\b", t or ""))
        want += [(i, a, b) for a in names for b in dict.fromkeys(re.findall("[a-z]{9,}", t or ""))]
    got = catalog.document_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and (1, "Rosa canina", "restlessness") in want


def test_extraction_reads_every_document(spark, tmp_path):
    import duckdb

    texts = [t for t in catalog.SENTENCES] + ["Indicated for  1. Head pain.; used for ANXIETY, used for anxiety", "é" * 300, "", "- 3) plain  text;"] + ["Never use. Meta-analysis. Interacts with digoxin"]
    rows = [(i, "filler word\n" * 30 + t if i % 2 else t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    parts = [(1, "cold ring", "PROMO TIN", "Brand#1"), (2, "low mood", "insomnia", "warfarin")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    for t in ("documents", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    least = {"extract_indications": 6, "detect_contraindications": 2, "detect_interactions": 3, "detect_severity": len(rows), "detect_evidence": len(rows), "normalize_indications": len(rows)}
    for name, n in least.items():
        df = catalog.QUERIES[name](spark, str(tmp_path))
        got = sorted(map(tuple, df.collect()))
        want = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE[name]})").fetchall())
        assert got == want and len(got) >= n, name


def test_hybrid_queries_search_vectors(spark):
    import hashlib
    import os
    import re

    import numpy as np

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    P = vector.projection()

    def embedded(text):
        w = re.sub(r"[^\w\s]", " ", text.lower()).split()
        v = np.zeros(P.shape[1])
        for t in w + [f"{a} {b}" for a, b in zip(w, w[1:])]:
            v[int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "little") % P.shape[1]] += 1
        v = P @ (v / np.linalg.norm(v))
        return (v / np.linalg.norm(v)).astype(np.float16).astype(np.float64)

    items = {r.id: embedded(r.normalized_text or r.indication_text) for r in catalog.D.indications(spark, sf).collect()}
    lex = {(r.query_id, r.id): r for r in catalog.part_hits(spark, sf).collect()}
    got = {m: catalog.QUERIES[f"fuse_{m}_searched"](spark, sf).collect() for m in ("rrf", "weighted", "interleave")}
    for q, text in enumerate(catalog.SYMPTOMS):
        v = embedded(text)
        cosine = {i: round(float(v @ x / np.linalg.norm(v) / np.linalg.norm(x)), 6) for i, x in items.items()}
        near = sorted((i for i in cosine if cosine[i] >= 0), key=lambda i: (-cosine[i], i))[:50]
        vr, lr = {i: n + 1 for n, i in enumerate(near)}, {i: r["rank"] for (p, i), r in lex.items() if p == q}
        ls = {i: r.score for (p, i), r in lex.items() if p == q}
        both = set(vr) | set(lr)
        rrf = {i: (1 / (60 + lr[i]) if i in lr else 0) + (1 / (60 + vr[i]) if i in vr else 0) for i in both}
        weighted = {i: 0.4 * ls.get(i, 0) + (0.6 * cosine[i] if i in vr else 0) for i in both}
        for name, want in (("rrf", rrf), ("weighted", weighted)):
            mine = sorted((r for r in got[name] if r.query_id == q), key=lambda r: r["rank"])
            assert len(mine) == 20
            assert all(abs(r.score - s) < 2e-5 for r, s in zip(mine, sorted(want.values(), reverse=True)))
            assert all(abs(r.score - want[r.id]) < 2e-5 for r in mine)
        turns = {i: min(2 * (lr[i] - 1) if i in lr else 1 << 30, 2 * (vr[i] - 1) + 1 if i in vr else 1 << 30) for i in both}
        mine = sorted((r for r in got["interleave"] if r.query_id == q), key=lambda r: r["rank"])
        assert [r.id for r in mine] == sorted(both, key=lambda i: (turns[i], i))[:20]
    assert catalog.repertorize_hybrid_searched(spark, sf).count() > 0


def counted(df, name: str) -> int:
    """How often a function stands in the optimized plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(f"{name}(")


def long_monograph(n: int) -> str:
    return "intro\n" + "".join(f"## Part {k % (n - 2)}\n- entry {k} of it\n\n" for k in range(n)) + "## Uses\n- gentle rest\n## Warnings\n- never with wine\n"


def test_markdown_indications_split_a_text_once(spark):
    df = spark.createDataFrame([(long_monograph(60),)], "t string").repartition(1)
    got = df.select(E.markdown_indications(F.col("t")).alias("x"))
    assert counted(got, "split") == 2  # lines of the text, and of a section
    assert [(i.text, i.section) for i in got.first().x] == [("gentle rest", "uses")]


def test_markdown_sections_are_made_once(spark, tmp_path):
    df = spark.createDataFrame([(1, long_monograph(60)), (2, None), (3, "")], "id long, t string").repartition(1)
    got = df.select("id", E.sections(F.col("t")).alias("x"))
    assert counted(got, "split") == 1
    rows = {r.id: r.x for r in got.collect()}
    assert [s.name for s in rows[1]] == ["_header", *[f"part {k}" for k in [*range(2, 58), 0, 1]], "uses", "warnings"]
    assert rows[1][-4].content == "- entry 58 of it" and rows[2] is None and [(s.name, s.content) for s in rows[3]] == [("_header", "")]
    spark.createDataFrame([(k, "cold ring", "PROMO", "Brand#1") for k in range(9)], "p_partkey long, p_name string, p_type string, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert catalog.markdown_sections(spark, str(tmp_path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism  # a small file, dealt over all cores


def test_markdown_sections_of_many_headings(spark):
    texts = [(1, long_monograph(20_000)), (2, "# B\nx\n# a\ny\n#b\nz\n# A\n"), (3, "#\n- 1\n# b\n- 2\n##\n- 3\n"), (4, "# c\n1\n# b\n2\n# c\n3\n# a\n4\n# b\n5\n")]
    df = spark.createDataFrame(texts, "id long, t string").repartition(1)
    got = df.select("id", E.sections(F.col("t")).alias("x"))
    assert counted(got, "exists") == 0  # a section was held against all after it: time by the square of their number
    rows = {r.id: [(s.name, s.content) for s in r.x] for r in got.collect()}
    assert [s for s, _ in rows[1]] == ["_header", *[f"part {k}" for k in [*range(2, 19_998), 0, 1]], "uses", "warnings"]
    assert rows[1][-4:-2] == [("part 0", "- entry 19998 of it"), ("part 1", "- entry 19999 of it")]
    assert rows[2] == [("b", "z"), ("a", "")] and rows[3] == [("b", "- 2"), ("", "- 3")]
    assert rows[4] == [("c", "3"), ("a", "4"), ("b", "5")]


def test_markdown_safety_splits_a_text_once(spark):
    df = spark.createDataFrame([(long_monograph(60),)], "t string").repartition(1)
    got = df.select(E.markdown_safety(F.col("t")).alias("x"))
    assert counted(got, "split") == 2
    assert [i.text for i in got.first().x] == ["never with wine"]


def test_markdown_safety_passes_blank_lines_once(spark):
    blank = " \n" * 80_000
    df = spark.createDataFrame([(f"# T\n\n## Warnings\n{blank}- never with wine{blank}- avoid it\n{blank}",)], "t string").repartition(1)
    began = time.monotonic()
    got = df.select(E.sections(F.col("t")).alias("s"), E.markdown_safety(F.col("t")).alias("x")).first()
    assert time.monotonic() - began < 10  # each blank was tried as the start of the text's end: 133 s for this text
    assert [i.text for i in got.x] == ["never with wine", "avoid it"]
    assert got.s[-1].content == f"- never with wine{blank}- avoid it"


def test_doc_lengths_cache_nothing(spark):
    text = "''Tis the 'quoted' dog's ''' rock 'n' roll' a''b"
    assert one(spark, lambda c: T.words(c, None), text) == ["tis", "the", "quoted", "dog's", "rock", "n", "roll", "a''b"]
    items = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "!!")], "id long, text string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    index = lexical.build_index(items, lexical.Analysis(stem=False, synonyms=None, stopwords=None), (("text", "text", True),))
    assert {r.id: r.length for r in index.lengths.collect()} == {1: 15, 4: 0}
    assert index.stats.first() == (2, 7.5) and spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert "InMemoryRelation" not in index.lengths._jdf.queryExecution().optimizedPlan().toString()


def test_search_bm25_documents_caches_nothing(spark):
    items = spark.createDataFrame([(k, "red fox " * (k % 3 + 1) + "blue dog") for k in range(30)], "id long, text string")
    index = lexical.build_index(items, catalog.NO_SYNONYMS, catalog.TEXT_FIELD)
    named = items.select("id", F.col("text").alias("indication_text"), F.lit(None).cast("string").alias("normalized_text"))
    hits = lexical.scores(index, lexical.query_table(spark, ["fox", "blue cat"]), named, catalog.NO_SYNONYMS)
    assert "InMemoryRelation" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.query_id, r.id) for r in hits.collect()} == {(q, k) for q in (0, 1) for k in range(30)}


def test_term_df_idf_caches_nothing(spark):
    items = spark.createDataFrame([(1, "fox fox dog"), (2, "fox"), (3, None)], "id long, text string")
    terms = lexical.build_index(items, catalog.NO_SYNONYMS, catalog.TEXT_FIELD).terms
    assert "InMemoryRelation" not in terms._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.term, r.df, r.n_postings) for r in terms.collect()} == {("fox", 2, 2), ("dog", 1, 1), ("fox_fox", 1, 1), ("fox_dog", 1, 1)}


def test_search_stemmed_documents_stem_each_word_of_a_batch_once(spark, monkeypatch):
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(stemmer, "stem", lambda w: seen.append(w) or w[:3])
    rows = [["running", "flies", "running"], None, [], ["flies", None]]
    assert stemmer.stem_arrays.func(pa.array([["x"], *rows], pa.list_(pa.string())).slice(1)).to_pylist() == [["run", "fli", "run"], None, [], ["fli", None]]
    assert sorted(seen) == ["flies", "running"]


def test_doc_pairs_edges_make_each_list_once(spark):
    docs = spark.createDataFrame([(1, "Rosa canina and Salvia officinalis ease indigestion and restlessness"), (2, "Rosa canina"), (3, None)], "doc_id long, text string").repartition(1)
    got = catalog.document_pairs(docs)
    assert counted(got, "regexp_extract_all") == 2
    assert {(r.doc_id, r.name_a, r.name_b) for r in got.collect()} == {(1, a, b) for a in ("Rosa canina", "Salvia officinalis") for b in ("officinalis", "indigestion", "restlessness")}


def test_extract_indications_search_a_text_once_for_each_pattern(spark):
    docs = spark.createDataFrame([("USED FOR rest. Treats cough, treat  Coughing fits. used for Rest",), ("nothing",), (None,)], "t string").repartition(1)
    got = docs.select(E.indications(F.col("t")).alias("x"))
    assert counted(got, "regexp_extract_all") == 6
    assert [sorted(r.x or []) for r in got.collect()] == [["cough", "rest"], [], []]
    assert E.literals(E.values.INDICATION_PATTERNS[0]) == ["used", "employed", "utilized"]


def test_normalize_indications_lower_a_text_once(spark):
    import re

    cases = ["loose  stools", "Skin rash", "skin rashes", "a gas", "gases", "boost immunity", "BOOSTS IMMUNITY", "low mood swings", "asthmatic", "head pain; migraine", "plain text.", "İnsomnia", "poor\nappetite"]
    want = [next((n for p, n in E.values.NORMALIZATION_RULES if re.search(p, x.lower(), re.ASCII)), None) for x in cases]
    got = spark.createDataFrame([(x,) for x in cases], "t string").repartition(1).select("t", E.normalize_indication(F.col("t")).alias("x"))
    assert counted(got, "lower") == 1
    rows = {r.t: r.x for r in got.collect()}
    assert all(rows[x] == w for x, w in zip(cases, want) if w and x != "İnsomnia") and rows["plain text."] == "plain text" and rows["gases"] == "gases" and rows["asthmatic"] == "asthmatic"
    for p in [*E.values.INDICATION_PATTERNS, *E.values.INTERACTION_PATTERNS, *[p for p, _ in E.values.NORMALIZATION_RULES], *[p for _, p in E.values.EVIDENCE_PATTERNS]]:
        assert all(len(x) > 2 for x in E.literals(p)), p


def test_detect_evidence_lowers_a_text_once(spark):
    cases = {"A Double-Blind test": "clinical_trial", "in  vivo": "traditional", "In vivo  study": "clinical_trial", "arct": "traditional", "an RCT": "clinical_trial", "xplacebo-controlled": "clinical_trial", "Cell Culture": "in_vitro", "cell cultures": "traditional", "": "traditional"}
    got = spark.createDataFrame([(x,) for x in [*cases, None]], "t string").repartition(1).select("t", E.evidence(F.col("t")).alias("x"))
    assert counted(got, "lower") == 1
    assert {r.t: (r.x.level, r.x.confidence) for r in got.collect() if r.t != ""} == {**{k: (v, 0.5 if v == "traditional" else 0.85) for k, v in cases.items() if k}, None: ("traditional", 0.5)}


def test_searched_vectors_are_made_once_for_equal_texts(spark, monkeypatch):
    items = spark.createDataFrame([(k, ("red fox", "blue dog runs", "")[k % 3]) for k in range(300)], "id long, text string").coalesce(1)
    rows = {r.id: tuple(r.vector) for r in vector.embed(items).collect()}
    assert len(rows) == 300 and all(rows[k] == rows[k % 3] for k in rows) and len(set(rows.values())) == 3 and not any(rows[2])
    import pyarrow as pa

    schema = "query_id long, id long, score double"
    block = pa.table({"query_id": pa.array([0], pa.int64()), "q": pa.array([[1.0, 0.0]], pa.list_(pa.float32()))})

    class Vectors:  # a column of Arrow that can't be turned into Python lists
        def __init__(self, x):
            self.x = x

        def flatten(self):
            return self.x.flatten()

    class Batch:
        def __init__(self, b):
            self.b, self.num_rows = b, b.num_rows

        def slice(self, *at):
            return Batch(self.b.slice(*at))

        def column(self, k):
            return Vectors(self.b.column(k)) if k else self.b.column(k)

    b = pa.record_batch({"id": pa.array([9, 7, 8], pa.int64()), "vector": pa.array([[0.5, 1], [1, 0], [0.5, 0]], pa.list_(pa.float32()))})
    got = [r for out in vector.best_of(block, 2, 0.0, 5, schema)(iter([Batch(b)])) for r in out.to_pylist()]
    assert [(r["id"], r["score"]) for r in got] == [(7, 1.0), (8, 0.5)]


def test_hash_features_are_counted_side_by_side(spark):
    import hashlib
    from collections import Counter

    from wellspring.functions import values
    from wellspring.operators import vector

    long = " ".join(["Ünï" * 9, "x" * 54, "y" * 55, "z" * 56, "w" * 300, "_a1", "b"] * 3)
    texts = [long, None, "", " ,;", "One two, one TWO! one", "Don't\tstop\n"]
    df = vector.hashed_counts(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    assert counted(df, "md5") == 0  # no interpreted functions token by token
    want = {}
    for i, t in enumerate(texts):
        w = "".join(c if c.isalnum() or c == "_" else " " for c in (t or "").lower()).split()
        n = Counter(int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "little") % values.HASH_BUCKETS for x in [*w, *map(" ".join, zip(w, w[1:]))])
        want |= {(i, b): (k, round(k / sum(x * x for x in n.values()) ** 0.5, 9)) for b, k in n.items()}
    assert {(r.id, r.bucket): (r.tf, round(r.weight, 9)) for r in df.collect()} == want


def test_term_df_idf_counts_terms_a_block_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from wellspring.operators import counted as C

    texts = ["fox fox dog", None, "the 'dog' dog's ''", "", "fox", "a_1 fox"]
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert "lambda" not in lexical.build_index(items, catalog.NO_SYNONYMS, catalog.TEXT_FIELD).terms._jdf.queryExecution().optimizedPlan().toString()
    rules = [catalog.NO_SYNONYMS.rules("text", True), catalog.PLAIN.rules("category", False)]
    batch = pa.record_batch({"id": pa.array(range(6), pa.int64()), "a": pa.array(["fox fox dog", None, "the 'dog' dog's ''", None, "fox", "a_1 fox"]), "b": pa.array([None, None, "dog", "fox", "fox", None])})
    kind = pa.schema([("term", pa.string()), ("d", pa.int64()), ("p", pa.int64())])
    for size in (1, 1 << 20):
        monkeypatch.setattr(C, "BLOCK_BYTES", size)
        got: dict = {}
        for b in C.indexed(kind, rules, "marks")(iter([batch])):
            for r in b.to_pylist():
                d, p = got.get(r["term"], (0, 0))
                got[r["term"]] = (d + r["d"], p + r["p"])
        assert got == {"fox": (4, 5), "dog": (2, 3), "dog's": (1, 1), "a_1": (1, 1), "fox_fox": (1, 1), "fox_dog": (1, 1), "dog_dog's": (1, 1), "a_1_fox": (1, 1)}


def test_search_bm25_documents_counts_only_the_queries_terms(spark):
    items = spark.createDataFrame([(1, "red red red fox"), (2, "fox blue"), (3, "dog")], "id long, text string")
    index = lexical.build_index(items, catalog.NO_SYNONYMS, catalog.TEXT_FIELD)
    few = index.only(["fox", "none"])
    assert {(r.term, r.id, round(r.tf, 6), r.field, r.length) for r in few.postings.collect()} == {("fox", 1, 0.666667, "text", 7), ("fox", 2, 1.0, "text", 3)}
    assert [(r.term, r.df) for r in few.marks.groupBy("term").agg(F.sum("d").alias("df")).collect()] == [("fox", 2)]
    named = items.select("id", F.col("text").alias("indication_text"), F.lit(None).cast("string").alias("normalized_text"))
    query = lexical.query_table(spark, ["fox", "blue dog"])
    whole = lexical.LexicalIndex(index.postings, index.terms, index.lengths, index.stats)
    ask = lambda i: {(r.query_id, r.id, round(r.score, 9)) for r in lexical.scores(i, query, named, catalog.NO_SYNONYMS).collect()}
    assert ask(index) == ask(whole) and len(ask(index)) == 4


def test_search_stemmed_documents_index_sets_of_stems_and_synonyms(spark):
    from wellspring.functions.text import synonym_map
    from wellspring.functions.values import STOPWORDS

    key, more = next((k, vs) for k, vs in synonym_map().items() if stemmer.stem(k) == k)
    texts = [f"running the dogs running {key} {key}", f"'{key}'", "the", "flies", None]
    index = lexical.build_index(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), lexical.Analysis(), catalog.TEXT_FIELD)
    want = {}
    for i, t in enumerate(texts[:4]):
        w = [stemmer.stem(x) for x in (x.strip("'") for x in t.split()) if x not in STOPWORDS]
        terms = {*w, *map("_".join, zip(w, w[1:]))}
        want[i] = terms | {v for x in terms for v in synonym_map().get(x, [])}
    assert more and {(r.id, r.term, r.tf, r.length) for r in index.postings.collect()} == {(i, x, 1.0, len(s)) for i, s in want.items() for x in s}
    assert {r.id: r.length for r in index.lengths.collect()} == {i: len(s) for i, s in want.items()}
