"""Command line: init, sync, search, query, status, health, watch, serve."""

from __future__ import annotations

import argparse
import json
import sys

from marginalia import config


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("marginalia").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="marginalia", description="Search a tree of notes with Spark.")
    p.add_argument("--config", default="rag_config.toml")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("init").add_argument("--force", action="store_true")
    s = verbs.add_parser("sync")
    s.add_argument("--mode", choices=["full", "incremental", "file"], default="incremental")
    s.add_argument("--file-path")
    for name, k in (("search", 10), ("query", 8)):
        v = verbs.add_parser(name)
        v.add_argument("query")
        v.add_argument("--top-k", type=int, default=k)
        v.add_argument("--filters", type=json.loads, help="JSON object")
    verbs.add_parser("note-context").add_argument("note_path")
    for name in ("status", "health", "watch", "serve"):
        verbs.add_parser(name)
    return p


def run(args: argparse.Namespace, index=None) -> dict | None:
    if args.verb == "init":
        return config.initialize(args.config, args.force)
    if index is None:
        from marginalia.service import NoteIndex

        index = NoteIndex(session(), config.load(args.config))
    match args.verb:
        case "sync":
            return index.sync(args.mode, args.file_path)
        case "search" | "query":
            return getattr(index, args.verb)(args.query, args.filters, args.top_k)
        case "note-context":
            return index.note_context(args.note_path)
        case "watch":
            from marginalia.streaming.watch import watch

            watch(index, str(index.config.state_path) + ".checkpoint").awaitTermination()
        case "serve":
            from marginalia.server import serve

            serve(index, sys.stdin, sys.stdout)
        case verb:
            return getattr(index, verb)()
    return None


def main(argv: list[str] | None = None) -> None:
    out = run(parser().parse_args(argv))
    if out is not None:
        print(json.dumps(out, indent=2, default=str))


if __name__ == "__main__":
    main()
