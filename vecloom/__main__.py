"""python -m vecloom ROOT: a session over the collections below a folder.

Without -c and -f lines are read from the terminal, until \\quit. Further commands:
load NAME FILE (upsert a JSON payload), and what a session knows, see \\help.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from vecloom.plans.engine import Engine
from vecloom.plans.shell import Shell


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("vecloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("root", help="folder of the engine, in any store that Spark can write to")
    out.add_argument("-c", "--command", action="append", default=[], help="run a line and end; may be given several times")
    out.add_argument("-f", "--file", help="run the lines of a file and end")
    out.add_argument("--load", nargs=2, metavar=("NAME", "FILE"), help="first upsert a JSON payload into a collection, which is created if need be")
    out.add_argument("--format", default="table", choices=("table", "json", "csv", "vertical"))
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, write=print) -> int:
    """The number of lines that failed."""
    told = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("vecloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine, failed = Engine(spark, told.root), 0

    def out(text: str) -> None:
        nonlocal failed
        failed += text.startswith("error: ")
        write(text)

    shell = Shell(engine, out)
    shell.how = told.format
    if told.load:
        from vecloom.sources.payload import read_payload

        engine.create_collection(told.load[0], get=True).upsert_frame(read_payload(spark, told.load[1]))
    lines = told.command + ([f"\\i {told.file}"] if told.file else [])
    for line in lines:
        shell.line(line)
    while not lines and not told.load and shell.open:
        try:
            shell.line(input("vecloom> ") if sys.stdin.isatty() else input())
        except EOFError:
            break
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 100))
