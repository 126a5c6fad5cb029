"""Run the analysis on a CSV drop:

    python -m agora --csv /data/drop --out /shared/analysis [--segment office_furniture ...]

Parses each of the nine files once, with declared schemas, into typed tables
under ``--out/landed``, counts unreadable rows, profiles and audits them, cleans them (checking the order keys), writes the cleaned
tables, the flat table and the dashboard extracts under ``--out``, then writes
every report and analysis result as parquet under ``--out/results/<name>``.
"""

from __future__ import annotations

import argparse
import dataclasses
import os

from agora.operators import cleaning, findings, quality
from agora.report import Params, analyses
from agora.session import build_session, run_folder
from agora.sources import sinks
from agora.sources.readers import land_csv_tables, landed_corrupt_rows, read_landed


def run(
    spark,
    csv_dir: str,
    out_dir: str,
    params: Params = Params(),
    include_geolocation: bool = True,
    null_tokens: bool = True,
) -> list[str]:
    """With ``null_tokens`` the missing-value tokens of the original load
    (``NA``, ``null``, ...) become NULL in every text column."""
    landed = os.path.join(out_dir, "landed")
    land_csv_tables(spark, csv_dir, landed, null_tokens=null_tokens, include_geolocation=include_geolocation)
    raw = read_landed(spark, landed, include_geolocation)
    quality_reports = {
        **{f"preview_{name}": quality.preview(df) for name, df in raw.named().items()},
        "csv_corrupt_rows": landed_corrupt_rows(spark, landed, include_geolocation),
        "table_profile": quality.table_profile(raw.named()),
        "null_audit_orders": quality.null_audit(raw.orders),
        "null_audit_reviews": quality.null_audit(raw.reviews),
        "null_audit_products": quality.null_audit(raw.products),
        "order_status_counts": quality.value_counts(raw.orders, "order_status", "n_orders"),
        "review_score_counts": quality.value_counts(raw.reviews, "review_score", "n_reviews"),
    }
    tables = sinks.load_tables(cleaning.clean_tables(raw), os.path.join(out_dir, "tables"), verify_keys=True)
    flat_path = os.path.join(out_dir, "flat_orders")
    sinks.write_flat_table(cleaning.flat_orders(tables), flat_path)
    flat = sinks.read_flat_table(spark, flat_path).drop(sinks.MONTH_COLUMN)
    load_reports = {
        "invalid_delivered": cleaning.invalid_delivered(tables.orders),
        "review_mean_by_comment": quality.review_mean_by_comment(tables.reviews),
        "review_dist_by_comment": quality.review_dist_by_comment(tables.reviews),
        "key_check_orders": quality.key_check(tables.orders, ["order_id"]),
        "key_check_payments": quality.key_check(tables.payments, ["order_id"]),
        "flat_row_check": quality.flat_row_check(tables.orders, flat),
        "dashboard_extracts": findings.dashboard_extracts(
            tables, os.path.join(out_dir, "dashboard_extracts"), params.seller_min_orders
        ),
    }
    results = {**quality_reports, **load_reports, **analyses(tables, flat, params)}
    # No coalesce(1): it would pull each result's last stage into one task;
    # AQE already merges small outputs into few files.
    outputs = {os.path.join(out_dir, "results", name): df for name, df in results.items()}
    sinks.write_parquet_concurrently(outputs)
    return sorted(results)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m agora", description=__doc__.split("\n\n")[0])
    ap.add_argument("--csv", required=True, help="folder with <table>.csv for the nine tables")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    ap.add_argument("--no-geolocation", action="store_true", help="the drop has no geolocation table")
    ap.add_argument("--keep-null-tokens", action="store_true", help="keep NA, null, ... as text")
    for f in dataclasses.fields(Params):
        ap.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    args = ap.parse_args(argv)
    params = Params(**{f.name: getattr(args, f.name) for f in dataclasses.fields(Params)})
    spark = build_session()
    with run_folder(spark):
        names = run(
            spark, args.csv, args.out, params,
            include_geolocation=not args.no_geolocation, null_tokens=not args.keep_null_tokens,
        )
    for name in names:
        print(name)


if __name__ == "__main__":
    main()
