"""python -m quiverlake [NAME ...]: runs queries by name on a folder of tables, as tables or files; without names it lists them."""

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .catalog import QUERIES


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="quiverlake", description=__doc__)
    parser.add_argument("names", nargs="*", metavar="NAME")
    parser.add_argument("--dir", default="/root/testdata/sf0.01", help="folder of the tables")
    parser.add_argument("--out", help="folder for the results, a folder a query; else some rows are shown")
    parser.add_argument("--format", default="parquet", choices=("parquet", "json"))
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    given = parser.parse_args(arguments)
    if not given.names or set(given.names) - set(QUERIES):
        print(*sorted(QUERIES), sep="\n")
        return 0 if not given.names else 2
    spark = SparkSession.builder.getOrCreate()
    for name in given.names:
        began, found = time.time(), QUERIES[name](spark, given.dir)
        if given.out:
            found.write.mode("overwrite").format(given.format).save(f"{given.out}/{name}")
        else:
            found.show(given.rows, truncate=False)
        print(f"{name}: {time.time() - began:.3f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
