"""End-to-end jobs: stored inputs in, stored tables out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barcast.config import Params
from barcast.operators.baselines import baseline_results
from barcast.operators.clean import regular_bars
from barcast.operators.evaluation import eval_summary, forecast_eval, worst_assets
from barcast.operators.pooled_models import pooled_eval
from barcast.operators.series_models import per_asset_eval, refit_forecasts
from barcast.operators.summary import asset_summary
from barcast.session import prepare, scratch, staged
from barcast.sources.assets import asset_list, restricted
from barcast.sources.bars import bars_report, read_bars, write_bars
from barcast.sources.raw import read_raw
from barcast.sources.sinks import read_forecasts, write_forecasts, write_results


@dataclass(frozen=True)
class Outcome:
    """What a job on stored bars left out, and whether it produced anything."""

    skipped_files: list[tuple[str, str]]  # (file, error), the first MAX_REPORTED of n_skipped_files by name
    n_skipped_files: int
    n_rows: int
    notice: str | None = None


MAX_REPORTED = 1_000
NOTHING = "no forecasts generated"


def build_bars(spark: SparkSession, inputs: list[str], out: str) -> list[str]:
    """Raw inputs → regular bars by bucket and month. Returns the inputs that were missing."""
    with scratch(prepare(spark)):
        scan = read_raw(spark, inputs)
        write_bars(regular_bars(scan.records), out)
    return scan.skipped


def summarise_raw(spark: SparkSession, inputs: list[str], out: str) -> list[str]:
    with scratch(prepare(spark)):
        scan = read_raw(spark, inputs)
        write_results(asset_summary(scan.records), out)
    return scan.skipped


def _chosen_bars(spark: SparkSession, bars_path: str, report: DataFrame, params: Params, assets: Iterable[str] | str | None) -> DataFrame:
    bars = read_bars(spark, bars_path, skip_corrupt=True, report=report)
    if assets is None:
        return restricted(bars, params)
    listed = asset_list(spark, path=assets) if isinstance(assets, str) else asset_list(spark, assets)
    return restricted(bars, params, listed)


def _outcome(spark: SparkSession, report: DataFrame, out: str, results: str) -> Outcome:
    """The report of unreadable files goes to ``<out>_skipped_files``; results are counted where they were written."""
    bad = report.where("error is not null")
    write_results(bad, f"{out}_skipped_files")
    named = [(r["file"], r["error"]) for r in bad.orderBy("file").limit(MAX_REPORTED).collect()]
    n_rows = spark.read.option("header", "true").csv(results).count()
    return Outcome(named, bad.count(), n_rows, None if n_rows else NOTHING)


def run_baselines(spark: SparkSession, bars_path: str, out: str, params: Params = Params()) -> None:
    with scratch(prepare(spark)):
        write_results(baseline_results(read_bars(spark, bars_path), params), out)


def run_pooled(spark: SparkSession, bars_path: str, out: str, params: Params = Params()) -> Outcome:
    with scratch(prepare(spark)):
        report = bars_report(spark, bars_path)
        write_results(pooled_eval(_chosen_bars(spark, bars_path, report, params, None), params), out)
        return _outcome(spark, report, out, out)


def run_per_asset(
    spark: SparkSession,
    bars_path: str,
    out: str,
    params: Params = Params(),
    assets: Iterable[str] | str | None = None,
) -> Outcome:
    """``assets``: ids, or the path of a text file with one id per line."""
    with scratch(prepare(spark)):
        report = bars_report(spark, bars_path)
        write_results(per_asset_eval(_chosen_bars(spark, bars_path, report, params, assets), params), out)
        return _outcome(spark, report, out, out)


def run_refit(
    spark: SparkSession,
    bars_path: str,
    out: str,
    params: Params = Params(),
    assets: Iterable[str] | str | None = None,
) -> Outcome:
    """Forecasts of the test period and their scores, under ``out``.

    Forecasts of assets outside this run stay untouched, and only this run's
    are scored. Scores are computed from the stored forecasts, so models are
    fitted once. A run without any forecast leaves empty results and says so in its notice.
    """
    with scratch(prepare(spark)):
        report = bars_report(spark, bars_path)
        bars = _chosen_bars(spark, bars_path, report, params, assets)
        run = staged(bars.select("asset").distinct(), "run")
        write_forecasts(refit_forecasts(bars, params), out, run)
        results = forecast_eval(read_forecasts(spark, out).join(run, "asset", "left_semi"))
        results.write.mode("overwrite").parquet(f"{out}/results_table")
        stored = spark.read.parquet(f"{out}/results_table")
        write_results(stored, f"{out}/results")
        write_results(eval_summary(stored), f"{out}/results_summary")
        write_results(worst_assets(stored), f"{out}/worst_assets")
        return _outcome(spark, report, out, f"{out}/results")
