"""``python -m textloom FOLDER QUERY``: searches files and prints one event a line, as JSON. Exits with 2 if the request is rejected."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from textloom import model
from textloom.plans.request import InputError, SearchRequest
from textloom.plans.run import events


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description="Searches the text of files.")
    p.add_argument("directory")
    p.add_argument("query")
    p.add_argument("--query-spec-json", type=json.loads, help="conditions or a batch, instead of the query")
    p.add_argument("--add-directory", action="append", default=[], metavar="PATH")
    p.add_argument("--exclude-directory", action="append", default=[], metavar="PATH")
    p.add_argument("--extensions", type=lambda x: tuple(x.split(",")) if x else (), default=model.DEFAULT_EXTENSIONS, metavar="xlsx,txt,...")
    p.add_argument("--use-index", metavar="FOLDER", help="folder of an index that is kept and brought up to date")
    p.add_argument("--fuzzy-search", action="store_true")
    p.add_argument("--include-notes", action="store_true")
    p.add_argument("--include-formulas", action="store_true")
    p.add_argument("--cancel-on-start", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(argv)  # exits with 2 by itself
    request = SearchRequest(
        a.directory, a.query, additional_directories=tuple(a.add_directory), excluded_directories=tuple(a.exclude_directory), extensions=a.extensions,
        query_spec=a.query_spec_json, fuzzy=a.fuzzy_search, include_notes=a.include_notes, include_formulas=a.include_formulas,
    )
    try:
        request.validated()
    except InputError as e:
        print(f"{e.field}: {e}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("textloom").getOrCreate()
    for e in events(spark, request, cancelled=lambda: a.cancel_on_start, index_folder=a.use_index):
        print(json.dumps(e, ensure_ascii=False, default=str), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
