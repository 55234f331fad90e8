"""Command line: ``python -m sparklog.cli COMMAND``."""

from __future__ import annotations

import argparse
import sys
from datetime import date

from sparklog.operators.bronze import archive, ingest_to_bronze
from sparklog.operators.embed import embed_segments
from sparklog.operators.gold import transform_to_gold
from sparklog.operators.retrieval import retrieve
from sparklog.operators.silver import reset_silver, transform_to_silver
from sparklog.plans import pipeline, rag
from sparklog.session import get_session
from sparklog.sources import synth
from sparklog.sources.config import get_source_config
from sparklog.sources.tables import Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparklog")
    p.add_argument("--root", default="warehouse", help="folder of the tables")
    p.add_argument("--master", default=None)
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("init", help="create missing tables")
    commands.add_parser("check", help="show versions and tables")
    for name in ("bronze", "silver", "gold", "embed", "archive", "reset-silver"):
        c = commands.add_parser(name)
        c.add_argument("--source-id", required=name != "embed")
        c.add_argument("--config")
    c = commands.add_parser("pipeline")
    c.add_argument("--config")
    for name in ("retrieve", "ask", "chat"):
        c = commands.add_parser(name)
        if name != "chat":
            c.add_argument("text")
            c.add_argument("--from", dest="from_utc")
            c.add_argument("--to", dest="to_utc")
        for flag in ("--source-id", "--severity", "--log-type"):
            c.add_argument(flag)
        c.add_argument("--top-k", type=int, default=10 if name == "retrieve" else rag.DEFAULT_TOP_K)
        c.add_argument("--all-occurrences", action="store_true")
        if name != "retrieve":
            c.add_argument("--model", default=rag.DEFAULT_MODEL)
        if name == "ask":
            c.add_argument("--show-context", action="store_true")
    for name in ("generate-windows", "generate-apache"):
        c = commands.add_parser(name)
        c.add_argument("folder")
        c.add_argument("--from", dest="start", type=date.fromisoformat, default=date(2026, 5, 1))
        c.add_argument("--to", dest="end", type=date.fromisoformat, default=date(2026, 5, 21) if "windows" in name else date(2026, 5, 11))
        c.add_argument("--seed", type=int, default=42)
        c.add_argument("--per-day", type=int, default=500 if "windows" in name else 120)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = get_session(master=args.master)
    store = Store(spark, args.root)
    filters = {k: getattr(args, k) for k in ("source_id", "severity", "log_type", "from_utc", "to_utc") if getattr(args, k, None) is not None}
    distinct = not getattr(args, "all_occurrences", False)
    match args.command:
        case "init":
            print("created:", ", ".join(store.create_all()) or "nothing")
        case "check":
            print(f"Spark {spark.version}; answers {spark.range(1).count()}")
            for table in sorted(t for t in __import__("sparklog.schemas", fromlist=["TABLES"]).TABLES):
                print(f"  {table}: {store.read(table).count() if store.exists(table) else 'missing'}")
        case "bronze" | "silver" | "gold":
            run = {"bronze": ingest_to_bronze, "silver": transform_to_silver, "gold": transform_to_gold}[args.command]
            print(run(store, get_source_config(args.source_id, args.config)))
        case "embed":
            print(embed_segments(store, get_source_config(args.source_id, args.config) if args.source_id else None))
        case "archive":
            print(archive(store, args.source_id), "entries archived")
        case "reset-silver":
            reset_silver(store, args.source_id)
        case "pipeline":
            records = pipeline.run_all(spark, args.root, args.config)
            print(pipeline.report(records))
            return pipeline.exit_code(records)
        case "retrieve":
            print(rag.format_results(retrieve(store, args.text, top_k=args.top_k, distinct=distinct, **filters).collect(), distinct))
        case "ask":
            got = rag.ask(store, args.text, model=args.model, top_k=args.top_k, distinct=distinct, **filters)
            print(got["answer"] + (f"\n\n{got['context']}" if args.show_context else ""))
        case "chat":
            rag.talk(rag.ChatSession(store, model=args.model, top_k=args.top_k, distinct=distinct, filters=filters))
        case "generate-windows" | "generate-apache":
            make = synth.windows_corpus if "windows" in args.command else synth.apache_corpus
            print(synth.write_files(make(spark, args.start, args.end, args.per_day, seed=args.seed), args.folder), "files written")
    return 0


if __name__ == "__main__":
    sys.exit(main())
