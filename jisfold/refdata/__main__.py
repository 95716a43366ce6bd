"""Builds the tables from the official files:

python -m jisfold.refdata JIS.xlsx MJ.xlsx SHRINK.json DESTINATION
"""

import argparse

from pyspark.sql import SparkSession

from jisfold.refdata import ingest


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m jisfold.refdata", description="Builds the tables as Parquet files.")
    for name, text in (("jis", "workbook of JIS characters (XLSX)"), ("mj", "workbook of MJ characters (XLSX)"), ("shrink", "MJ shrink targets (JSON)"), ("destination", "folder for the tables")):
        parser.add_argument(name, help=text)
    given = parser.parse_args(args)
    ingest.build(SparkSession.builder.getOrCreate(), given.jis, given.mj, given.shrink, given.destination)


if __name__ == "__main__":
    main()
