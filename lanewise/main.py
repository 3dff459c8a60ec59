"""Command line: python -m lanewise.main --job daily|backfill ..."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from typing import Any

from lanewise.plans import jobs

#: Option to setting.
OVERRIDES = {
    "raw_base_path": "paths.raw_base_path",
    "reference_base_path": "paths.reference_base_path",
    "staging_base_path": "paths.staging_base_path",
    "curated_base_path": "paths.curated_base_path",
    "spark_profile": "spark.profile",
    "hive_database": "hive.database",
    "fail_fast": "runtime.fail_fast",
    "register_hive": "hive.register_tables",
}
_SWITCHES = ("fail_fast", "register_hive")


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lanewise", description="Delivery analytics batch runs")
    parser.add_argument("--job", choices=["daily", "backfill"], default="daily")
    parser.add_argument("--config", default="dev", help="a path, or base, dev or prod")
    for name in ("run-date", "start-date", "end-date"):
        parser.add_argument(f"--{name}", help="YYYY-MM-DD")
    for name, setting in OVERRIDES.items():
        more = {"action": argparse.BooleanOptionalAction} if name in _SWITCHES else {"choices": ["local", "emr"]} if name == "spark_profile" else {}
        parser.add_argument(f"--{name.replace('_', '-')}", default=None, help=f"sets {setting}", **more)
    return parser


def overrides(args: argparse.Namespace) -> dict[str, Any]:
    given = {setting: getattr(args, name) for name, setting in OVERRIDES.items()}
    return {k: v for k, v in given.items() if v is not None and v != ""}


def main(argv: Sequence[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    over = overrides(args) or None
    if args.job == "daily":
        return jobs.run_daily_batch(config_path=args.config, run_date=args.run_date, overrides=over)
    return jobs.run_backfill_batch(config_path=args.config, start_date=args.start_date, end_date=args.end_date, overrides=over)


if __name__ == "__main__":
    sys.exit(main())
