import pathlib
from html.parser import HTMLParser

import pytest
from conftest import BARS, RAW, SF, series, utc
from pyspark.sql import functions as F

from barcast.config import Params
from barcast.operators.clean import dedupe_last
from barcast.operators.summary import asset_summary
from barcast.plans import workflows
from barcast.plans.fixture import FIXTURE_PARAMS, raw_ohlcv
from barcast.sources import assets, sinks
from barcast.session import shared_root
from barcast.sources.bars import bars_report, read_bars, write_bars
from barcast.sources.files import CUT, NO_FOOTER
from barcast.sources.pages import matching_links, page_links
from barcast.sources.raw import RAW_SCHEMA, normalise_records, read_raw
from barcast.streaming.summary import start_stored_summary, start_summary, stored_summary, stream_raw, upsert_batch


def test_inputs_are_scanned_in_order_and_missing_ones_reported(spark, tmp_path):
    def write(name, value):
        rows = [("A", utc("2024-01-01 10:00"), value, value, value)]
        spark.createDataFrame(rows, "ID string, ExecutionTime timestamp, high double, low double, close double").coalesce(
            1
        ).write.parquet(f"{tmp_path}/{name}")

    write("b_first", 1.0)
    write("a_second", 2.0)
    scan = read_raw(spark, [f"{tmp_path}/b_first", f"{tmp_path}/gone", f"{tmp_path}/a_second"])
    assert scan.skipped == [f"{tmp_path}/gone"]
    row = dedupe_last(scan.records).first()
    assert row["high"] == 2.0 and row["volume"] is None
    assert scan.records.select("seq").distinct().count() == 2
    with pytest.raises(FileNotFoundError):
        read_raw(spark, [f"{tmp_path}/gone"])


def test_row_order_within_a_file_decides(spark, tmp_path):
    rows = [("A", utc("2024-01-01 10:00"), float(i), 0.0, 0.0, 0.0) for i in range(50)]
    schema = "ID string, ExecutionTime timestamp, high double, low double, close double, volume double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/one")
    assert dedupe_last(read_raw(spark, [f"{tmp_path}/one"]).records).first()["high"] == 49.0


def test_time_parsing_and_absent_columns(spark):
    raw = spark.createDataFrame(
        [("A", "2024-01-01 10:00:00"), ("A", "2024-01-01T11:00:00+01:00"), ("A", "soon"), ("A", None)],
        "ID string, ExecutionTime string",
    )
    found = normalise_records(raw).select(F.date_format("ExecutionTime", "HH:mm").alias("t")).collect()
    assert sorted(str(r["t"]) for r in found) == ["10:00", "10:00", "None", "None"]
    assert normalise_records(raw.select("ID")).where("ExecutionTime is null and high is null").count() == 4


def test_nan_becomes_missing(spark):
    raw = spark.createDataFrame([("A", utc("2024-01-01"), float("nan"))], "ID string, ExecutionTime timestamp, high double")
    assert normalise_records(raw).where("high is null").count() == 1


def test_bars_keep_text_ids_and_skip_corrupt_files(spark, tmp_path):
    bars = spark.createDataFrame(series("007", "2024-01-01", [1.0, 2.0]) + series("b c", "2024-01-01", [3.0, 4.0]), BARS)
    path = f"{tmp_path}/bars"
    write_bars(bars, path)
    assert sorted(map(tuple, read_bars(spark, path).collect())) == sorted(map(tuple, bars.collect()))
    broken = pathlib.Path(path) / "buckets=64" / "bucket=3" / "month=2024-01"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"not parquet")
    assert read_bars(spark, path, skip_corrupt=True).count() == 4
    with pytest.raises(Exception):
        read_bars(spark, path).count()


def test_broken_files_are_reported_and_left_out_as_a_whole(spark, tmp_path):
    """A file without a footer, one without a byte, and one whose data break in the middle."""
    path = f"{tmp_path}/bars"
    rows = series("a", "2024-01-01", [float(i) for i in range(3000)])
    write_bars(spark.createDataFrame(rows, BARS), path, buckets=1)
    files = sorted(pathlib.Path(path).rglob("*.parquet"))
    assert len(files) == 2  # two months
    data = bytearray(files[1].read_bytes())
    data[4:200] = bytes(196)
    files[1].write_bytes(bytes(data))
    for crc in pathlib.Path(path).rglob("*.crc"):
        crc.unlink()
    (files[0].parent / "part-empty.parquet").write_bytes(b"")
    (files[0].parent / "part-text.parquet").write_bytes(b"PAR1 no footer here PAR1")
    found = {pathlib.PurePath(r["file"]): r for r in bars_report(spark, path).collect()}
    report = {f.name if f.name.startswith(("part-e", "part-t")) else f.parent.name: r for f, r in found.items()}
    assert report["month=2024-01"]["error"] is None and report["month=2024-01"]["n_rows"] == 31 * 96
    assert report["month=2024-02"]["error"] == CUT and report["month=2024-02"]["n_rows"] == 3000 - 31 * 96
    assert len(report) == 3 and report["part-text.parquet"]["error"] == NO_FOOTER
    assert read_bars(spark, path, skip_corrupt=True).count() == 31 * 96


def _files_read(df):
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    return plan.collectLeaves().head().metrics().apply("numFiles").value()


def test_chosen_assets_and_times_open_few_files(spark, tmp_path):
    """Files depend on buckets and months only; an asset list and a time bound choose folders."""
    path = f"{tmp_path}/bars"
    names = [f"asset {i}" for i in range(120)]
    bars = spark.createDataFrame([r for a in names for r in series(a, "2024-01-31 12:00", [1.0] * 96)], BARS)
    write_bars(bars, path, buckets=4)
    assert len(list(pathlib.Path(path).rglob("*.parquet"))) == 8
    february = utc("2024-02-01 00:00")
    assert _files_read(read_bars(spark, path)) == 8
    one = read_bars(spark, path, assets=["asset 7"])
    assert _files_read(one) == 2 and one.count() == 96
    late = read_bars(spark, path, assets=["asset 7", "nobody"], since=F.lit(february))
    assert _files_read(late) <= 2 and late.count() == 48
    early = read_bars(spark, path, until=F.lit("2024-01-31 12:30:00").cast("timestamp"))
    assert _files_read(early) == 4 and early.count() == 120 * 3
    assert read_bars(spark, path, assets=[]).count() == 0
    assert read_bars(spark, path, assets=[*names, *map(str, range(1000))]).count() == 120 * 96


def test_failed_run_leaves_the_old_forecasts(spark, tmp_path):
    schema = "asset string, feature string, origin timestamp, horizon int, target_time timestamp, pred double, `true` double"

    def rows(asset, pred):
        return spark.createDataFrame([(asset, "close", utc("2024-01-01"), 1, utc("2024-01-01 00:15"), pred, None)], schema)

    path = f"{tmp_path}/fc"
    sinks.write_forecasts(rows("a", 1.0), path)
    broken = rows("a", 2.0).withColumn("pred", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception):
        sinks.write_forecasts(broken, path)
    assert [r["pred"] for r in sinks.read_forecasts(spark, path).collect()] == [1.0]
    # a run that stored its forecasts and ended before the ledger was written
    half = rows("a", 3.0).withColumns({"run": F.lit("half"), "buckets": F.lit(1), "bucket": F.lit(0), "month": F.lit("2024-01")})
    half.write.mode("append").partitionBy("run", "buckets", "bucket", "month").parquet(f"{path}/forecasts")
    assert [r["pred"] for r in sinks.read_forecasts(spark, path).collect()] == [1.0]
    assert [r["pred"] for r in sinks.read_run(spark, path, "half").collect()] == [3.0]


def test_jobs_remove_their_scratch_and_say_what_they_skipped(spark, tmp_path):
    root = pathlib.Path(shared_root(spark).removeprefix("file:")) / "barcast"
    before = set(root.glob("job-*"))
    write_bars(spark.createDataFrame(series("a", "2024-01-01", [1.0] * 50), BARS), f"{tmp_path}/bars")
    bad = next(pathlib.Path(f"{tmp_path}/bars").rglob("*.parquet")).parent / "part-x.parquet"
    bad.write_bytes(b"x")
    params = Params(horizon=1, features=("close",), refit_rounds=2, train_cutoff="2024-01-01T09:45+00:00")
    done = workflows.run_refit(spark, f"{tmp_path}/bars", f"{tmp_path}/refit", params, ["nobody"])
    assert (done.n_rows, done.notice, done.n_skipped_files) == (0, workflows.NOTHING, 1)
    assert pathlib.PurePath(done.skipped_files[0][0]).name == "part-x.parquet" and done.skipped_files[0][1] == NO_FOOTER
    assert set(root.glob("job-*")) == before


def test_asset_lists(spark, tmp_path):
    bars = spark.createDataFrame([r for a in ("b", "a-b", "a") for r in series(a, "2024-01-01", [1.0])], BARS)
    # file names sort "a-b.parquet" before "a.parquet"
    assert [r["asset"] for r in assets.first_assets(bars, 2).collect()] == ["a-b", "a"]
    text = tmp_path / "list.txt"
    text.write_text(" b \n\nnope\r\na\nb\n")
    listed = assets.asset_list(spark, path=str(text))
    assert [r["asset"] for r in listed.orderBy("pos").collect()] == ["b", "nope", "a"]
    assert [r["asset"] for r in assets.listed_assets(bars, listed, 1).collect()] == ["b"]
    assert [r["asset"] for r in assets.unknown_assets(bars, listed).collect()] == ["nope"]
    assert assets.restricted(bars, Params(), listed).count() == 2
    assert assets.restricted(bars, Params(max_assets=1)).select("asset").first()["asset"] == "a-b"


def test_links(spark):
    html = (
        '<A HREF="x.parquet">1</A> <a class=c href=\'y.csv\'>2</a><!-- <a href="no.parquet"> -->'
        '<script>"<a href=\\"js.parquet\\">"</script><a href="">e</a><a href=z.parquet?a=1&amp;b=2>3</a><abbr href="q">'
    )
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    rows = page_links(pages, ".parquet").orderBy("link_pos").collect()
    assert [(r["href"], r["is_match"]) for r in rows] == [
        ("x.parquet", True), ("y.csv", False), ("z.parquet?a=1&b=2", False)
    ]
    assert [r["href"] for r in matching_links(pages).collect()] == ["x.parquet"]


class _Targets(HTMLParser):
    """Anchor targets as the standard library's parser sees them."""

    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        hrefs = [v for k, v in attrs if k == "href"]
        if tag == "a" and hrefs and hrefs[0]:
            self.found.append(hrefs[0])


def test_links_like_a_parser(spark):
    cases = [
        '<a title="a > b" href="z.parquet">',
        '<a data-x=" href=bad" href="good.parquet">',
        '<a href="q&#38;r.parquet">',
        "<a href=x&#x26;y&lt;&eacute;zz>",
        '<a href="1.parquet"class="b"><a HREF = \'2.parquet\' href="3">',
        "<a name=top>no</a><a href>no</a><abbr href=q><a/href=slash>",
        '<a data-href="no" href="yes.parquet"/>',
        '<a href="caf&eacute;.parquet"><a href="?a=1&copy=2&para;m=3&notit;&notin;&unknown;&amp&lt">',
        '<a href="&#x80;&#150;&#0;&#xD800;&#x110000;&#11;&#127;&#xFDD0;&#x1FFFF;&#13;&#9;x">',
        '<a href="&#65&#x42;&#0000000000000000067;&#99999999999999999999;&#xFFFFFFFFFFFFFFFF41;">',
        '<a href="&&;&#;&#x;&fj;&NotEqualTilde;&acE;&CounterClockwiseContourIntegral;&Aacuteq">',
        "text without links",
        "",
    ]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate([*cases, None])], "page_id long, url string, html string")
    got = [[] for _ in range(len(cases) + 1)]
    for r in page_links(pages, ".parquet").orderBy("page_id", "link_pos").collect():
        got[r["page_id"]].append(r["href"])
    for case, found in zip(cases, got):
        parser = _Targets()
        parser.feed(case)
        assert found == parser.found, case
    assert got[-1] == []


def test_text_ids_survive_folders_by_id(spark, tmp_path):
    rows = [(i, utc("2024-01-01"), 1.0, 1.0, 1.0, 1.0, 0) for i in ("007", "08", "1e3", "b c")]
    sinks.write_raw_by_id(spark.createDataFrame(rows, RAW), f"{tmp_path}/ids")
    assert {r["ID"] for r in read_raw(spark, [f"{tmp_path}/ids"]).records.collect()} == {"007", "08", "1e3", "b c"}


def test_assets_without_new_forecasts_lose_their_old_ones(spark, tmp_path):
    schema = "asset string, feature string, origin timestamp, horizon int, target_time timestamp, pred double, `true` double"
    row = ("close", utc("2024-01-01"), 1, utc("2024-01-01 00:15"), 1.0, None)
    path = f"{tmp_path}/fc"
    sinks.write_forecasts(spark.createDataFrame([(a, *row) for a in "abc"], schema), path)
    run = spark.createDataFrame([("a",), ("b",)], "asset string")
    sinks.write_forecasts(spark.createDataFrame([("a", *row)], schema), path, run)
    assert sorted(r["asset"] for r in sinks.read_forecasts(spark, path).collect()) == ["a", "c"]


def test_raw_rows_by_id_append(spark, tmp_path):
    raw = raw_ohlcv(spark, SF)
    path = f"{tmp_path}/by_id"
    sinks.write_raw_by_id(raw, path)
    sinks.write_raw_by_id(raw.where("ID = 'view'"), path)
    n_view = raw.where("ID = 'view'").count()
    assert spark.read.parquet(path).count() == raw.count() + n_view
    assert spark.read.parquet(path).where("ID = 'view'").count() == 2 * n_view


def test_forecast_sink_replaces_only_its_assets(spark, tmp_path):
    path = f"{tmp_path}/fc"
    schema = "asset string, feature string, origin timestamp, horizon int, target_time timestamp, pred double, `true` double"

    def rows(asset, pred):
        return spark.createDataFrame([(asset, "close", utc("2024-01-01"), 1, utc("2024-01-01 00:15"), pred, None)], schema)

    sinks.write_forecasts(rows("a", 1.0).unionByName(rows("b", 1.0)), path)
    sinks.write_forecasts(rows("b", 2.0), path)
    found = sinks.read_forecasts(spark, path)
    assert {(r["asset"], r["pred"]) for r in found.collect()} == {("a", 1.0), ("b", 2.0)}
    sinks.append_forecasts(found, f"{tmp_path}/csv")
    sinks.append_forecasts(found, f"{tmp_path}/csv")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").count() == 4


def test_jobs_end_to_end(spark, tmp_path):
    raw = raw_ohlcv(spark, SF).drop("seq")
    raw.where(F.col("ExecutionTime") <= FIXTURE_PARAMS.cutoff()).write.parquet(f"{tmp_path}/train")
    raw.where(F.col("ExecutionTime") > FIXTURE_PARAMS.cutoff()).write.parquet(f"{tmp_path}/test")
    inputs = [f"{tmp_path}/train", f"{tmp_path}/test", f"{tmp_path}/absent"]
    assert workflows.build_bars(spark, inputs, f"{tmp_path}/bars") == inputs[2:]
    assert read_bars(spark, f"{tmp_path}/bars").count() == 17_268
    workflows.summarise_raw(spark, inputs, f"{tmp_path}/summary")
    workflows.run_baselines(spark, f"{tmp_path}/bars", f"{tmp_path}/baselines", FIXTURE_PARAMS)
    params = FIXTURE_PARAMS.with_(horizon=2, features=("close",), rounds=5, refit_rounds=5)
    workflows.run_per_asset(spark, f"{tmp_path}/bars", f"{tmp_path}/models", params, ["click", "dormant", "gone"])
    workflows.run_refit(spark, f"{tmp_path}/bars", f"{tmp_path}/refit", params, ["click", "dormant"])
    workflows.run_refit(spark, f"{tmp_path}/bars", f"{tmp_path}/refit", params, ["view"])

    def csv(name):
        return spark.read.option("header", "true").csv(f"{tmp_path}/{name}")

    assert csv("summary").count() == 6 and csv("baselines").count() == 6 * 4 * 2
    assert csv("models").groupBy("asset").count().count() == 2 and csv("models").count() == 4
    # the last run's assets are scored; forecasts of the run before stay stored
    assert csv("refit/results").count() == 1 * 2 and csv("refit/worst_assets").count() == 1
    assert csv("refit/results_summary").count() == 2
    stored = sinks.read_forecasts(spark, f"{tmp_path}/refit")
    assert {r["asset"] for r in stored.select("asset").distinct().collect()} == {"click", "dormant", "view"}


def test_stream_summary_equals_batch(spark, tmp_path):
    raw = raw_ohlcv(spark, SF)
    raw.select(*RAW_SCHEMA.names).repartition(4).write.parquet(f"{tmp_path}/in")
    query = start_summary(
        stream_raw(spark, f"{tmp_path}/in", files_per_batch=1), f"{tmp_path}/cp", "memory", once=True, queryName="summary"
    )
    assert query.awaitTermination(120)
    # update mode emits every change; the last state per asset has the highest count
    last = spark.sql("select max_by(struct(*), total_count) as r from summary group by ID").select("r.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, asset_summary(raw).collect()))
    assert spark.table("summary").count() > last.count()


def test_stored_summary_survives_restarts_and_replays(spark, tmp_path):
    """Batches before and after a restart add up, a replayed batch changes nothing, with and without snapshots."""
    raw = raw_ohlcv(spark, SF).select(*RAW_SCHEMA.names)
    early = F.col("ExecutionTime") <= FIXTURE_PARAMS.cutoff()

    def run():
        stream = stream_raw(spark, f"{tmp_path}/in", files_per_batch=1)
        assert start_stored_summary(stream, f"{tmp_path}/cp", f"{tmp_path}/state", once=True, compact_every=3).awaitTermination(120)

    raw.where(early).repartition(4).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    raw.where(~early).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    want = sorted(map(tuple, asset_summary(raw).collect()))
    assert sorted(map(tuple, stored_summary(spark, f"{tmp_path}/state").collect())) == want
    last = 6
    batch = spark.read.schema(RAW_SCHEMA).parquet(f"{tmp_path}/in")
    file = batch.select("_metadata.file_path").distinct().collect()
    assert len(file) == 7
    again = spark.read.parquet(f"{tmp_path}/state/kind=part/batch={last}")
    assert again.count() > 0
    # the newest batch once more, from its own rows: state unchanged
    rows = spark.read.schema(RAW_SCHEMA).parquet(f"{tmp_path}/in").where(~early)
    upsert_batch(f"{tmp_path}/twice", 2)(rows, 0)
    upsert_batch(f"{tmp_path}/twice", 2)(rows.where("ID = 'view'"), 1)
    first = sorted(map(tuple, stored_summary(spark, f"{tmp_path}/twice").collect()))
    upsert_batch(f"{tmp_path}/twice", 2)(rows.where("ID = 'view'"), 1)
    assert sorted(map(tuple, stored_summary(spark, f"{tmp_path}/twice").collect())) == first
