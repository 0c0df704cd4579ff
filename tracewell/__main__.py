"""``python -m tracewell QUERY FOLDER``: a query's rows as JSON lines. Exit codes: 0 done, 2 wrong arguments, 3 failed, 130 interrupted."""

from __future__ import annotations

import sys


def main(arguments: list[str]) -> int:
    from tracewell.queries import QUERIES

    if len(arguments) != 2 or arguments[0] not in QUERIES:
        print(__doc__, "Queries:", *sorted(QUERIES), file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        for line in QUERIES[arguments[0]](spark, arguments[1]).toJSON().toLocalIterator():
            print(line)
    except KeyboardInterrupt:
        return 130
    except Exception as error:  # noqa: BLE001  told by its kind alone, as its text may hold what was read
        print(type(error).__name__, file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
