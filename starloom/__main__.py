"""Command line: python -m starloom {bronze,silver,gold,all} [--source DIR] ..."""

from __future__ import annotations

import argparse
import logging

from starloom.plans import incremental, jobs
from starloom.session import get_spark
from starloom.sources.tables import Lakehouse


def main() -> None:
    parser = argparse.ArgumentParser(prog="starloom")
    parser.add_argument("layer", choices=["bronze", "silver", "gold", "rollups", "all", "new"], help="new: all layers, from new files")
    parser.add_argument("--source", default="./data", help="folder of the source CSV files")
    parser.add_argument("--catalog", help="catalog of the layers (default: the session's)")
    parser.add_argument("--location", help="root folder of the layers")
    parser.add_argument("--format", default="parquet", help="table format")
    parser.add_argument("--infer-schema", action="store_true", help="have Spark infer column types")
    parser.add_argument("--shuffle-gb", type=int, help="size of the largest shuffle expected")
    parser.add_argument("--order-buckets", type=int, help="buckets of the tables with one row per order")
    parser.add_argument("--partition-fact", action="store_true", help="partition the fact by day")
    args = parser.parse_args()

    logging.basicConfig(level=logging.INFO)
    shuffle_bytes = args.shuffle_gb << 30 if args.shuffle_gb else None
    spark = get_spark(f"starloom {args.layer}", shuffle_bytes=shuffle_bytes)
    try:
        lake = Lakehouse(spark, args.location, args.catalog, fmt=args.format)
        how = {
            "infer_schema": args.infer_schema,
            "order_buckets": args.order_buckets,
            "partition_fact_by": ["date_key"] if args.partition_fact else (),
        }
        if args.layer == "new":
            incremental.run_incremental(lake, args.source, **how)
        else:
            jobs.run_all(lake, args.source, ["bronze", "silver", "gold"] if args.layer == "all" else [args.layer], **how)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
