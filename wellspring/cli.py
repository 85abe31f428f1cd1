"""Command line: init, ingest, index, search, repertorize, export, stats."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import lexical, vector
from .plans import ingest, ranking
from .sources.store import Store


def engine(store: Store, index: str) -> ranking.Engine:
    spark = store.spark
    vectors = f"{index}/vectors"
    have = store._fs.exists(store._path(vectors))
    return ranking.Engine(
        spark,
        *[store.read(t) for t in ("botanicals", "indications", "edges")],
        lexical.LexicalIndex.load(spark, index),
        store.read("contraindications"),
        store.read("drug_interactions"),
        spark.read.parquet(vectors) if have else None,
    )


def build(store: Store, index: str) -> None:
    items = store.read("indications")
    lexical.build_index(items).save(index)
    text = vector.index_text(items["normalized_text"], items["indication_text"])
    vector.embed(items.select("id", text.alias("text"))).write.mode("overwrite").parquet(f"{index}/vectors")
    store.set_meta({"lexical_index_built": "true", "vector_index_built": "true"})


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--store", default="store")
    p.add_argument("--index", default="index")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    a = sub.add_parser("ingest")
    a.add_argument("folder")
    a.add_argument("--kind", choices=["md", "txt", "monographs"], default="md")
    sub.add_parser("index")
    a = sub.add_parser("search")
    a.add_argument("query")
    a.add_argument("--mode", choices=ranking.MODES, default="hybrid")
    a.add_argument("--limit", type=int, default=20)
    a.add_argument("--category")
    a = sub.add_parser("repertorize")
    a.add_argument("symptoms")
    a.add_argument("--top", type=int, default=20)
    a.add_argument("--mode", choices=ranking.MODES, default="hybrid")
    a.add_argument("--json")
    a = sub.add_parser("export")
    a.add_argument("path")
    a.add_argument("--format", choices=["json", "csv"], default="json")
    sub.add_parser("stats")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("wellspring").getOrCreate()
    store = Store(spark, args.store)
    if args.command == "init":
        store.initialise()
    elif args.command == "ingest":
        print(json.dumps(ingest.ingest_monographs(store, args.folder) if args.kind == "monographs" else ingest.ingest_documents(store, args.folder, args.kind)))
    elif args.command == "index":
        build(store, args.index)
    elif args.command == "search":
        e = engine(store, args.index)
        hits = e.search(e.queries([args.query]), args.mode, args.limit, args.category)
        for r in hits.join(e.indications.select("id", "indication_text"), "id").orderBy("rank").collect():
            print(f"{r['rank']:>3}. {r['indication_text']}  {r['score']:.4f}  {r['match_type']}")
    elif args.command == "repertorize":
        ranked = engine(store, args.index).repertorize(args.symptoms, args.top, args.mode).persist()
        print(ranking.format_text(ranked))
        if args.json:
            ranking.export_json(ranked, args.json)
    elif args.command == "export":
        from pyspark.sql import functions as F

        df = store.read("botanicals").select("id", "latin_binomial", F.to_json("common_names").alias("common_names"), "family", "genus", "species")
        getattr(df.write.mode("overwrite"), args.format)(args.path, **({"header": True} if args.format == "csv" else {}))
    else:
        from .operators.relational import table_counts
        from .sources.schemas import SCHEMAS

        for r in table_counts({t: store.read(t) for t in SCHEMAS}).collect():
            print(f"{r['table_name']}: {r['n']}")


if __name__ == "__main__":
    main()
