"""Command line: build an index, verify, describe, search, show documents and versions, ask, reindex, serve."""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sextant")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="index the Python files of a folder")
    b.add_argument("folder")
    b.add_argument("out")
    for name, text in (("verify", "compare files with the manifest"), ("search", "search an index")):
        s = sub.add_parser(name, help=text)
        s.add_argument("index")
        if name == "search":
            s.add_argument("query")
            s.add_argument("--k", type=int, default=10)
    b.add_argument("--history", action="store_true", help="the folder is a git repository: index every function at every commit")
    b.add_argument("--limit", type=int, help="chunks at most, by file and line; of a history the latest commits")
    for name, text, more in (("describe", "facts of an index", []), ("categories", "tag the rows of an index", []), ("doc", "show a document", ["doc_id"]), ("history", "versions of a lineage", ["id"]), ("diff", "changes of a lineage", ["id", "a", "b"]), ("compare", "hits at two versions", ["query", "a", "b"])):
        s = sub.add_parser(name, help=text)
        s.add_argument("index")
        for m in more:
            s.add_argument(m, type=int if m in "ab" else str)
    r = sub.add_parser("reindex", help="bring an index up to date with its source")
    r.add_argument("index")
    r.add_argument("--dry-run", action="store_true")
    v = sub.add_parser("serve", help="serve indexes over HTTP")
    v.add_argument("index", nargs="+")
    v.add_argument("--port", type=int, default=8000)
    a = sub.add_parser("ask", help="ask about the code of a folder")
    a.add_argument("folder")
    a.add_argument("question")
    args = p.parse_args(argv)

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sextant.agent import CodeAgent
    from sextant.sources.build import build_categories, build_history_index
    from sextant.sources.encoders import hashing
    from sextant.service import SearchService
    from sextant.sources.files import chunk_folder, read_sources
    from sextant.sources.index import verify_index, write_index
    from sextant.sources.reindex import reindex_index

    encoder = hashing()
    say = lambda x: print(json.dumps(x, default=str))
    spark = SparkSession.builder.appName("sextant").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "build" and args.history:
        say({k: v for k, v in build_history_index(spark, args.folder, args.out, encoder, args.limit).items() if k != "files"})
    elif args.command == "categories":
        say(build_categories(spark, args.index)["families"])
    elif args.command == "build":
        chunks, stats = chunk_folder(spark, args.folder)
        chunks = chunks if args.limit is None else chunks.orderBy("file", "start_line").limit(args.limit)
        rows = chunks.withColumn("row", F.xxhash64("chunk_id")).withColumn("doc_id", F.col("chunk_id"))
        write_index(rows.join(encoder.encode_docs(rows), "row"), args.out, source_root=args.folder, task="folder", **encoder.manifest())
        print(json.dumps(stats))
    elif args.command == "verify":
        problems = verify_index(spark, args.index)
        print("\n".join(problems) or "ok")
        return 1 if problems else 0
    elif args.command == "search":
        for r in SearchService.open(spark, args.index).search(args.query, args.k).collect():
            print(json.dumps({k: r[k] for k in ("rank", "doc_id", "score", "preview")}))
    elif args.command == "reindex":
        say(reindex_index(spark, args.index, lambda work: encoder.encode_docs(work, "hash"), args.dry_run))
    elif args.command == "serve":
        from sextant.server import Application, serve

        serve(Application(spark, {i: i for i in args.index}, encode=lambda work: encoder.encode_docs(work, "hash")), port=args.port).serve_forever()
    elif args.command in ("describe", "doc", "history", "diff", "compare"):
        service = SearchService.open(spark, args.index)
        if args.command == "describe":
            say(service.describe())
        elif args.command == "doc":
            say(service.get_doc(args.doc_id))
        elif args.command == "diff":
            say(service.diff(args.id, args.a, args.b))
        else:
            for r in (service.history(args.id) if args.command == "history" else service.compare(args.query, args.a, args.b)).drop("embedding").collect():
                say(r.asDict())
    else:
        out = CodeAgent(spark, read_sources(spark, args.folder)).run(args.question)
        for r in out["answers"]:
            print(json.dumps(r, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
