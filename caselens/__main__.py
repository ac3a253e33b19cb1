"""Search from the command line: one query, a file of them, or one after the other from the terminal.

    python -m caselens FOLDER "text" [--mode problem] [--retriever bm25] [--address TEXT] [--top-k 10]
    python -m caselens FOLDER --file queries.txt
    python -m caselens FOLDER

FOLDER holds Parquet tables: cases, index/{postings,lengths,vocabulary,stats}, and optionally addresses. Each result is a line of JSON."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator

from pyspark.sql import SparkSession

from caselens.operators.lexical import Index
from caselens.plans.search import Searcher
from caselens.session import local_session


def opened(spark: SparkSession, folder: str, with_addresses: bool) -> Searcher:
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return Searcher(read("cases"), Index.read(spark, f"{folder}/index"), addresses=read("addresses") if with_addresses else None)


def asked(args: argparse.Namespace) -> Iterator[str]:
    if args.query is not None:
        yield args.query
    else:
        lines = open(args.file, encoding="utf-8") if args.file else sys.stdin
        yield from (line.strip() for line in lines if line.strip())


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> None:
    parser = argparse.ArgumentParser(prog="caselens")
    parser.add_argument("folder")
    parser.add_argument("query", nargs="?")
    parser.add_argument("--file")
    parser.add_argument("--mode", default="problem")
    parser.add_argument("--retriever", default="bm25")
    parser.add_argument("--address")
    parser.add_argument("--top-k", type=int, default=10)
    parser.add_argument("--case-k", type=int, default=50)
    parser.add_argument("--allow-broader", action="store_true")
    args = parser.parse_args(argv)
    searcher = opened(spark or local_session(), args.folder, args.mode != "problem")
    for query in asked(args):
        try:
            found = searcher.search(query, args.mode, args.retriever, args.address, args.top_k, args.case_k, allow_broader=args.allow_broader)
            rows = [r.asDict(recursive=True) for r in found.collect()]
            print(json.dumps({"query": query, "results": rows}, ensure_ascii=False, default=str), file=out, flush=True)
        except ValueError as e:  # a query that cannot be asked; the next one may be
            print(json.dumps({"query": query, "error": str(e)}, ensure_ascii=False), file=out, flush=True)


if __name__ == "__main__":
    main()
