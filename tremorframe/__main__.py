"""Command line: ``spark-submit -m``-style entry to the jobs of ``plans.flows``.

    python -m tremorframe explore  --catalog C --mainshocks M --sequences 'S/*_eq.csv' --out O
    python -m tremorframe features --mainshocks M --sequences 'S/*_eq.csv' --out O
    python -m tremorframe train    --features O/features --out O --folds loo
    python -m tremorframe ingest   --sequences 'S/*_seq.csv' --out RAW
    python -m tremorframe load     --catalog C --events RAW/events --malformed RAW/malformed --out STORE
    python -m tremorframe forecast --mainshocks M --sequences 'S/*_eq.csv' --out O
    python -m tremorframe reports  --catalog C --events STORE/events --out O
    python -m tremorframe reports  --catalog C --sequences 'S/*_seq.csv' --out O

``--events`` is a Parquet table in engine columns (or a ``.csv`` of them), ``--malformed`` and ``--unusable`` are Parquet
tables that ``ingest`` wrote (the second names sequences whose file could not be used), all other inputs are CSV.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tremorframe.plans import flows
from tremorframe.sources.catalog import (
    clean_catalog,
    mainshocks_from_catalog,
    read_catalog,
    read_mainshocks,
    unique_mainshocks,
)
from tremorframe.sources.sequences import read_sequences

NEEDS = {
    "explore": ("catalog", "mainshocks", "sequences"),
    "features": ("mainshocks", "sequences"),
    "train": ("features",),
    "ingest": ("sequences",),
    "load": ("catalog", "events"),
    "forecast": ("mainshocks", "sequences"),
    "reports": ("catalog",),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tremorframe", description=__doc__.splitlines()[0])
    parser.add_argument("job", choices=sorted(NEEDS))
    for name in ("catalog", "mainshocks", "sequences", "features", "events", "malformed", "unusable"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--out", required=True)
    parser.add_argument("--folds", default="5", help="number of folds, or loo")
    parser.add_argument("--top", type=int, default=0, help="load the largest mainshocks only, 0 for all")
    parser.add_argument("--issue-time", type=float, help="hours after the mainshock")
    args = parser.parse_args(argv)
    missing = [n for n in NEEDS[args.job] if getattr(args, n) is None]
    if missing:
        parser.error(f"{args.job} needs --" + " --".join(missing))
    if args.job == "reports" and (args.events is None) == (args.sequences is None):
        parser.error("reports needs either --events or --sequences")

    spark = spark or SparkSession.builder.appName(f"tremorframe-{args.job}").getOrCreate()

    def sequences(strict: bool = True):
        layout = "iso" if args.sequences.endswith("_seq.csv") else "date_time"
        return read_sequences(spark, args.sequences, layout, strict)

    if args.job == "explore":
        flows.explore(
            read_catalog(spark, args.catalog), sequences(False), read_mainshocks(spark, args.mainshocks), args.out
        )
    elif args.job == "features":
        flows.extract_features(sequences(False), read_mainshocks(spark, args.mainshocks), args.out)
    elif args.job == "train":
        folds = args.folds if args.folds == "loo" else int(args.folds)
        flows.train(spark.read.parquet(args.features), args.out, folds).show()
    elif args.job == "load":
        top = args.top or None
        flows.load_sequences(
            read_catalog(spark, args.catalog), flows.stored_events(spark, args.events), args.out, top,
            malformed=spark.read.parquet(args.malformed) if args.malformed else None,
            unusable=spark.read.parquet(args.unusable) if args.unusable else None,
        ).show()
    elif args.job == "ingest":
        layout = "iso" if args.sequences.endswith("_seq.csv") else "date_time"
        flows.ingest(spark, args.sequences, args.out, layout).show()
    elif args.job == "forecast":
        cat = read_mainshocks(spark, args.mainshocks)
        flows.forecast_all(sequences(), cat, args.out, args.issue_time).show()
    else:
        clean = clean_catalog(read_catalog(spark, args.catalog), ordered=False)
        cat = unique_mainshocks(mainshocks_from_catalog(clean))
        ev = flows.stored_events(spark, args.events) if args.events else sequences(False)
        flows.extract_features(ev, cat, args.out, "spark")


if __name__ == "__main__":
    main()
