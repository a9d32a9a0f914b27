"""python -m pagestrata.cli INPUT --output OUT [--indent 2]: one document to JSON."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.document import documents
from .sinks.json import export_document
from .sources.readers import open_document


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pagestrata", description="Parse a technical document into a JSON block model.")
    parser.add_argument("input", help="path of the document")
    parser.add_argument("--output", "-o", required=True, help="path of the JSON file")
    parser.add_argument("--indent", type=int, default=2, help="spaces of indentation")
    options = parser.parse_args(argv)
    try:
        spark = SparkSession.builder.appName("pagestrata").getOrCreate()
        export_document(documents(*open_document(spark, options.input)), options.output, options.indent)
    except Exception as problem:  # any failure is reported and leaves no output
        print(f"Error: {problem}", file=sys.stderr)
        return 1
    print(f"Wrote {options.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
