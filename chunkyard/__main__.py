"""Command line: index a folder, search a collection, put a job where the stream reads."""

from __future__ import annotations

import argparse

from chunkyard.engine import Engine
from chunkyard.plans.search import MODES, SearchRequest, as_text
from chunkyard.session import session
from chunkyard.sources.files import head_commit


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="chunkyard")
    parser.add_argument("--root", required=True, help="where the index is")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    one.add_argument("folder")
    one.add_argument("--repo", required=True)
    one.add_argument("--branch", default="main")
    one.add_argument("--collection")
    one.add_argument("--commit", help="by default the folder's own")
    one.add_argument("--skip-descriptions", action="store_true")
    two = commands.add_parser("search")
    two.add_argument("query")
    two.add_argument("--collection", required=True)
    two.add_argument("--top-k", type=int, default=5)
    two.add_argument("--mode", choices=MODES, default="hybrid")
    three = commands.add_parser("trigger")
    three.add_argument("--repo", required=True)
    three.add_argument("--branch", default="main")
    three.add_argument("--events", required=True)
    commands.add_parser("collections")
    args = parser.parse_args(argv)
    engine = Engine(spark or session(), args.root)
    if args.command == "ingest":
        commit = args.commit or head_commit(args.folder) or ""
        version = engine.ingest(args.folder, args.repo, args.branch, commit, describe_chunks=not args.skip_descriptions, collection=args.collection)
        print(f"version {version} of {args.collection or engine.collection_of(args.repo)}")
    elif args.command == "search":
        for r in as_text(engine.search(SearchRequest(args.query, args.collection, args.top_k, search_mode=args.mode))).orderBy("place").toLocalIterator():
            print(r.block)
    elif args.command == "trigger":
        engine.trigger(args.events, args.repo, args.branch)
    else:
        for name in engine.index.collections():
            print(name)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
