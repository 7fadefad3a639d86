"""python -m papercairn QUERY FOLDER [-n ROWS]: rows of a named query over a folder of the standard tables.

Exit codes: 0 rows were shown, 1 there are none, 2 the query or folder isn't known, 3 the query failed, 130 stopped."""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    from papercairn.plans import pages, queries, sources  # noqa: F401

    p = argparse.ArgumentParser(prog="papercairn", description="Rows of a named query.")
    p.add_argument("query")
    p.add_argument("folder")
    p.add_argument("-n", type=int, default=20, help="rows to show")
    a = p.parse_args(argv)
    if a.query not in queries.QUERIES or not os.path.isdir(a.folder):
        print(f"no query {a.query} or no folder {a.folder}; queries: {', '.join(sorted(queries.QUERIES))}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    try:
        rows = queries.QUERIES[a.query](SparkSession.builder.getOrCreate(), a.folder).limit(a.n).collect()
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001
        print(f"{type(e).__name__}: {str(e)[:500]}", file=sys.stderr)
        return 3
    for r in rows:
        print(r.asDict(True))
    return 0 if rows else 1


if __name__ == "__main__":
    sys.exit(main())
