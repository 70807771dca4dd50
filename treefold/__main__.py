"""Run one JSON query: python -m treefold DATABASE QUERY [options]."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .functions.shipping import ship
from .operators.decompose import Factors
from .operators.matrix import as_rows
from .plans.query import Options, run_query
from .sources.relation import Database, write_csv


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="treefold", description=__doc__)
    p.add_argument("database")
    p.add_argument("query")
    p.add_argument("--base", help="folder that relative data paths start from")
    p.add_argument("--method", choices=["divide_and_conquer", "qr_iter", "power_iter", "eigen"])
    p.add_argument("--factor", choices=["heads_tails", "cofactor", "auto"], default="auto")
    p.add_argument("--factorised", action="append", default=[], metavar="SUFFIX", help="another suffix of operators that means factorised, beside TREE")
    p.add_argument("--percent", type=float, default=100.0)
    p.add_argument("--iterations", type=int, default=10_000)
    p.add_argument("--compute-all", action="store_true", default=None)
    p.add_argument("--precision", type=int, default=15)
    p.add_argument("--dump", help="folder for the factors and rows as CSV")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("treefold").getOrCreate()
    ship(spark)
    began = time.time()
    found = run_query(Database.from_config(spark, a.database, a.base).load_all(), a.query, Options(a.method, a.percent, a.iterations, a.compute_all, a.factor, aliases=tuple(a.factorised)))
    if not isinstance(found, Factors):
        found = Factors(found.columns, rows=found)
    parts = {k: getattr(found, k) for k in ("r", "u", "sigma", "v")}
    if found.coefficients:
        for name, x in found.coefficients.items():
            print(f"{name}\t{x:.{a.precision}e}")
    for name, m in parts.items():
        if m is not None and a.dump:
            write_csv(as_rows(spark, m), f"{a.dump}/{name}", precision=a.precision)
    if found.rows is not None and a.dump:
        write_csv(found.rows, f"{a.dump}/rows", precision=a.precision)
    print(f"seconds\t{time.time() - began:.3f}")


if __name__ == "__main__":
    main()
