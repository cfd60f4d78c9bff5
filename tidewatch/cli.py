"""Command line: python -m tidewatch.cli COMMAND --tables DIR --out DIR [--start DAY] [--end DAY].

Every command runs a group of queries, writes each one's rows as a new version of a store below --out, and a JSON and a Markdown report beside
them. Rows with a ``day`` are clipped to --start..--end, both included. ``list`` names the queries, ``query NAME ...`` runs some of them.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tidewatch import reports
from tidewatch.operators import calendar as C
from tidewatch.operators import stores as K
from tidewatch.operators.research import search_due

GROUPS = {
    "ingest": ["normalise_records", "third_party_posts", "stream_messages", "tweet_posts", "author_records", "incremental_plan"],
    "aggregates": ["daily_entity_counts", "ticker_daily_mentions", "theme_daily", "ticker_daily_sentiment", "term_daily", "spike_terms"],
    "conviction": ["conviction_set", "conviction_rank", "conviction_crossings"],
    "signals": ["trade_decisions", "certainty_rank", "signal_scorecard", "trade_ledger", "latest_states"],
    "top": ["euphoria_level", "euphoria_alerts", "top_judge", "walk_forward_threshold", "budget_threshold"],
    "onset": ["onset_features", "onset_judge", "desk_scores", "danger_runs"],
    "influence": ["influence_board", "influence_full", "pagerank_50", "label_propagation_30", "loud_but_wrong"],
    "analytics": ["lead_lag_corr", "correlations", "event_study", "forward_table", "episode_catalog"],
    "dashboard": ["weekly_heatmap", "monthly_snail_trail", "coverage_pivot", "emerging_rank", "top_trends", "source_breadth"],
    "panel": ["referrals", "ticker_rate", "panel_addition"],
    "evidence": ["era_robustness", "fa_anatomy", "calibration_buckets", "ablation_level", "perturbation_curve", "label_sensitivity"],
}
GROUPS["pipeline"] = [n for g in ("ingest", "aggregates", "conviction", "signals", "top", "onset", "influence", "analytics", "dashboard", "panel") for n in GROUPS[g]]


def run(spark: SparkSession, names: list[str], tables: str, out: str, start: str | None = None, end: str | None = None, title: str = "report") -> dict:
    """Each query's rows to a store of its name; returns and writes the report."""
    from tidewatch.plans import registry

    unknown = [n for n in names if n not in registry.QUERIES]
    if unknown:
        raise ValueError(f"no query {', '.join(unknown)}")
    report, pages = {}, []
    for name in names:
        frame = registry.QUERIES[name](spark, tables)
        if "day" in frame.columns:
            frame = C.clip(frame, start, end)
        K.replace(frame, f"{out}/{name}", guarded=False)
        frame = K.load(spark, f"{out}/{name}")
        report[name] = reports.summary(frame)
        pages.append(reports.markdown(name, reports.top_rows(frame)))
    reports.write_json(spark, f"{out}/{title}.json", report)
    K.Files(spark, out).write(f"{out}/{title}.md", "\n".join(pages))
    return report


def research(spark: SparkSession, tables: str, out: str, year: int) -> bool:
    """Thresholds of a year are searched once; later runs of the year go by the report."""
    import json

    files, path = K.Files(spark, out), f"{out}/thresholds.json"
    old = json.loads(files.read(path)) if files.exists(path) else None
    if not search_due(old, year):
        return False
    from tidewatch.plans import registry

    rows = reports.top_rows(registry.QUERIES["budget_threshold"](spark, tables).where("chosen"))
    reports.write_json(spark, path, {"thresholds": ((old or {}).get("thresholds", {})) | {str(year): rows}})
    return True


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from tidewatch.plans import registry

    p = argparse.ArgumentParser(prog="tidewatch")
    p.add_argument("command", choices=["list", "query", "research", *GROUPS])
    p.add_argument("names", nargs="*")
    for name in ("--tables", "--out", "--start", "--end"):
        p.add_argument(name)
    p.add_argument("--year", type=int)
    a = p.parse_args(arguments)
    if a.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if not a.tables or not a.out or (a.command == "query" and not a.names) or (a.command == "research" and not a.year):
        p.print_usage(sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("tidewatch").getOrCreate()
    if a.command == "research":
        print("searched" if research(spark, a.tables, a.out, a.year) else "up to date")
        return 0
    report = run(spark, a.names if a.command == "query" else GROUPS[a.command], a.tables, a.out, a.start, a.end, a.command)
    for name, r in report.items():
        print(name, r["rows"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
