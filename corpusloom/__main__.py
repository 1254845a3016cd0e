"""python -m corpusloom STORE COMMAND ..."""

from __future__ import annotations

import argparse
import datetime
import json
import os
import sys
import time

#: Settings and their defaults.
SETTINGS = {"CORPUSLOOM_DIMENSIONS": "64", "CORPUSLOOM_LIMIT": "20", "CORPUSLOOM_LISTEN": "127.0.0.1:8080"}


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="corpusloom")
    parser.add_argument("store", help="folder of the corpus, as a URI that Spark can write")
    parser.add_argument("--config", help="a file of settings")
    commands = parser.add_subparsers(dest="command", required=True)
    add = commands.add_parser
    one = add("ingest")
    one.add_argument("root")
    one.add_argument("--name")
    one.add_argument("--kind", default="filesystem")
    one.add_argument("--watch", type=float, help="seconds between scans")
    for name in ("query", "chat"):
        one = add(name)
        one.add_argument("text", nargs="*" if name == "chat" else "+")
        one.add_argument("--limit", type=int)
        one.add_argument("--sources", default="")
        one.add_argument("--topics", default="")
    one = add("sources")
    one.add_argument("action", nargs="?", default="list", choices=("list", "describe", "remove", "export", "import"))
    one.add_argument("what", nargs="?", help="type/name, or a path")
    one.add_argument("description", nargs="?", default="")
    one.add_argument("--force", action="store_true")
    for name in ("export", "backup", "restore"):
        add(name).add_argument("path")
    one = add("cluster")
    one.add_argument("--k", type=int)
    one.add_argument("--picture")
    one.add_argument("--dims", type=int, default=2)
    one = add("enrich")
    one.add_argument("model")
    one.add_argument("--base", default="http://localhost:11434")
    one.add_argument("--client", default="Local", choices=("Local", "Completions", "Messages"))
    one.add_argument("--key", default="")
    one.add_argument("--version", type=int, default=2, choices=(1, 2))
    one = add("eval")
    one.add_argument("testset")
    one.add_argument("results")
    for name in ("serve", "mcp", "config", "version", "info"):
        add(name)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    from . import serve, settings

    layers = [(p, open(p).read() if os.path.isfile(p) else None) for p in (os.path.expanduser("~/.config/corpusloom/config"), ".env", args.config) if p]
    chosen, _ = settings.resolve(SETTINGS, layers, os.environ)
    if args.command == "version":
        print(serve.VERSION)
        return
    if args.command == "config":
        for key in sorted(SETTINGS):
            print(json.dumps({"key": key, "value": chosen[key].value, "origin": chosen[key].origin}))
        return

    from pyspark.sql import SparkSession

    from .functions.models import HashEmbedder
    from .plans import clusters, corpus, evaluation, results
    from .plans.store import Store
    from .session import ship
    from .sources import registry

    spark = ship(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate())
    store, embedder, limit = Store(spark, args.store), HashEmbedder(int(chosen["CORPUSLOOM_DIMENSIONS"].value)), int(chosen["CORPUSLOOM_LIMIT"].value)
    now = lambda: datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    service = serve.Service(store, embedder, now)
    show = lambda rows: [print(json.dumps(r.asDict(), default=str)) for r in rows.toLocalIterator()]

    if args.command == "ingest":
        config = {"root": args.root, "name": args.name} if args.kind == "filesystem" else {"url": args.root, "work": f"{args.store}/work"}
        source = registry.connector(args.kind, **config)
        changed, deleted = corpus.ingest(store, source, embedder, now())
        print(json.dumps({"changed": changed, "deleted": deleted}))
        if args.watch:
            corpus.watch(store, source, embedder, now, lambda: time.sleep(args.watch) is None)
    elif args.command == "query":
        out = corpus.search(store, args.text, embedder, args.limit or limit, now()).orderBy("query_id", "rank")
        show(out.select("query_id", "rank", "id", "source_path", "overall", "raw_content"))
    elif args.command == "chat":
        for line in [" ".join(args.text)] if args.text else map(str.strip, sys.stdin):
            request = {"messages": [{"role": "user", "content": line}], "mode": "raw", "limit": args.limit, "sources": serve._list(args.sources), "topics": serve._list(args.topics)}
            print(json.dumps(service.query(request)))
    elif args.command == "sources":
        if args.action == "export":
            corpus.export_sources(store, args.what)
        elif args.action == "import":
            corpus.import_sources(store, args.what)
        elif args.action in ("describe", "remove"):
            kind, _, name = args.what.partition("/")
            corpus.remove(store, kind, name) if args.action == "remove" else corpus.describe(store, kind, name, args.description, args.force)
        else:
            show(corpus.overview(store).orderBy("source_type", "source_name"))
    elif args.command == "export":
        corpus.export(store, args.path)
    elif args.command == "backup":
        store.backup(corpus.FRAGMENTS, args.path)
    elif args.command == "restore":
        store.restore(corpus.FRAGMENTS, args.path)
    elif args.command == "cluster":
        rows = corpus.searchable(store)
        found, units = clusters.run(rows, args.k, as_of=now())
        clusters.store(units, store, now())
        if args.picture:
            with open(args.picture, "w") as f:
                f.write(clusters.picture(clusters.points(rows, found, units, args.dims)))
        show(units.select("cluster", "unit_id", "n", "topic", "overall"))
    elif args.command == "eval":
        from pyspark.sql import functions as F
        from pyspark.sql.window import Window

        cases = results.load_testset(spark, args.testset)
        cases = cases.withColumn("query_id", F.row_number().over(Window.orderBy("id")).cast("long") - 1).persist()  # a row a case
        texts = [r["query"] for r in cases.orderBy("query_id").select("query").collect()]
        each = evaluation.run(cases, corpus.search(store, texts, embedder, limit, now()))
        results.save(each, f"{args.results}/cases")
        results.save_summary(evaluation.summary(each), f"{args.results}/summary", now())
        print(results.summary_line(evaluation.summary(each), now()))
    elif args.command == "enrich":
        from .functions import clients

        n = corpus.enrich(store, getattr(clients, args.client)(args.base, args.model, args.key), args.model, embedder, args.version)
        print(json.dumps({"enriched": n}))
    elif args.command == "serve":
        host, _, port = chosen["CORPUSLOOM_LISTEN"].value.rpartition(":")
        serve.http(service, host or "0.0.0.0", int(port)).serve_forever()
    elif args.command == "mcp":
        for line in serve.rpc(service, sys.stdin):
            print(line, flush=True)
    else:
        print(json.dumps(corpus.info(store, embedder)))


if __name__ == "__main__":
    main()
