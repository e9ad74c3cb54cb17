"""python -m corpusloom FOLDER COMMAND: stats, search QUERY, dedup, authors, publish PATH; with
--store: ingest FILES (a pattern), reindex, compact, backup PATH, status."""

from __future__ import annotations

import argparse
import glob
from datetime import date

from .engine import Engine
from .session import local_session
from .streaming.ingest import CorpusSink


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("command", choices=["stats", "search", "dedup", "authors", "publish", "ingest", "reindex", "compact", "backup", "status"])
    parser.add_argument("value", nargs="?", default="")
    parser.add_argument("--store", help="a folder that lasts, with the corpus and its text index")
    parser.add_argument("--today", default=date.today().isoformat())
    parser.add_argument("--limit", type=int, default=30)
    parser.add_argument("--offset", type=int, default=0)
    parser.add_argument("--dialect", choices=["engine", "site"], default="engine")
    args = parser.parse_args(argv)
    engine = Engine(local_session(), args.folder, args.store)
    if args.command in ("ingest", "reindex", "compact", "backup", "status") and not args.store:
        parser.error(f"{args.command} needs --store")
    if args.command == "stats":
        for name, df in engine.stats().items():
            print(name)
            df.show(50, truncate=False)
    elif args.command == "search":
        result = engine.search(args.value, args.today, args.limit, args.offset, args.dialect)
        print(f"{result.total()} cards")
        result.hits.show(args.limit, truncate=80)
    elif args.command == "dedup":
        engine.dedup().groupBy("relation").count().show()
    elif args.command == "ingest":
        print(engine.ingest(glob.glob(args.value)))
    elif args.command == "reindex":
        print(f"{engine.reindex().rows} cards indexed")
    elif args.command == "compact":
        CorpusSink(engine.spark, f"{args.store}/corpus").compact()
    elif args.command == "backup":
        engine.backup(args.value)
    elif args.command == "status":
        manifest = CorpusSink(engine.spark, f"{args.store}/corpus").manifest()
        print(f"{len(manifest['files'])} files, {len(manifest['parts'])} parts")
        for path, reason in manifest["failed"].items():
            if reason:
                print(f"failed: {path}: {reason}")
    elif args.command == "authors":
        engine.authors().show(args.limit, truncate=80)
    else:
        print(f"{engine.publish(args.value).count()} cards written")


if __name__ == "__main__":
    main()
