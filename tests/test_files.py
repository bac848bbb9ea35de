"""Reading and writing."""

import csv
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tarmac import schema as S
from tarmac.operators import runs as R
from tarmac.plans import carrier_deviation, delay_band_report, route_month_stats
from tarmac.session import scratch_path
from tarmac.sources import (
    append_run,
    compact_runs,
    declare_flights,
    read_csv,
    read_ordered,
    read_parquet,
    read_report,
    read_runs,
    reconcile_files,
    snapshot,
    timed,
    write_report,
    write_scales,
)
from tarmac.sources.tables import flights_view, load

HEADER = (
    "year,diverted,month,fl_date,op_unique_carrier,origin,dep_delay,arr_delay,cancelled,"
    "cancellation_code,carrier_delay,extra"
)
LINES = [
    "2024,0,1,2024-01-01,AA,ABE,5,NaN,0,,12,x",
    "2024,0,1.0,2024-01-01, AA ,ABE,,3.5,1.0,A,abc,x",
    "2024,0,1,2024-01-01,AA,ABE,late,7,0,,12.0,x",
    "2024,0,1,2024-13-45,AA,ABE,1,7,0,,12.0,x",
    "2024,0,1,2024-01-01,AA,ABE,1,7,2,,12.0,x",
    "2024,0,1,2024-01-01,AA,ABE,1,7,,,12.0,x",
    "2024,0,1,2024-01-01,AA,ABE",
    "2024,0,1,2024-01-01,AA,ABE,1,7,0,,12.0,x,y",
    "",
    HEADER,
    '2024,0,1,2024-01-01 10:30:00,"A,A",ABE, 1 ,7,0,,,x',
]


@pytest.fixture
def folder(tmp_path):
    data = tmp_path / "raw"
    data.mkdir()
    (data / "a.csv").write_text("\n".join([HEADER, *LINES]) + "\n")
    (data / "b.csv").write_text("\n".join([HEADER, LINES[0]]) + "\n")
    return str(data)


def test_csv_good_rows(spark, folder):
    good = read_csv(spark, folder).good
    rows = {
        (r.month, r.op_unique_carrier, r.dep_delay, r.arr_delay, r.cancelled, r.carrier_delay)
        for r in good.collect()
    }
    assert good.count() == 4
    assert rows == {
        (1, "AA", 5.0, None, 0, 12.0),
        (1, "AA", None, 3.5, 1, None),
        (1, "A,A", 1.0, 7.0, 0, None),
    }
    assert "extra" not in good.columns
    assert dict(good.dtypes)["cancelled"] == "bigint"


def test_csv_rejects(spark, folder):
    rejected = read_csv(spark, folder).rejected
    got = sorted(tuple(r.reasons) for r in rejected.collect())
    assert got == sorted(
        [("dep_delay",), ("fl_date",), ("flag",), ("flag",), ("width",), ("width",)]
    )


def test_rejection_does_not_depend_on_the_columns_used(spark, folder):
    good = read_csv(spark, folder).good
    assert good.select("origin").count() == good.groupBy("month").count().first()["count"] == 4


def test_strict_dates_stop(spark, folder):
    with pytest.raises(PySparkException):
        read_csv(spark, folder, strict_dates=True).good.collect()


def test_another_header_stops(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("month,origin,cancelled\n1,ABE,0\n")
    (tmp_path / "d" / "b.csv").write_text("origin,month,cancelled\nABE,1,0\n")
    with pytest.raises(PySparkException, match="another header"):
        read_csv(spark, str(tmp_path / "d")).good.collect()


def test_lines_are_parsed_once_and_cells_converted_once(spark, folder):
    loaded = read_csv(spark, folder)
    for df in (loaded.good, loaded.rejected, loaded.lines):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_csv(") == 1 and plan.count("Relation [") == 1
        # Two numbers, the flag, year, month, diverted and a cause; the date.
        assert plan.count("as double)") <= 7


def test_lines_hold_what_both_frames_do(spark, folder):
    loaded = read_csv(spark, folder)
    assert loaded.lines.count() == loaded.good.count() + loaded.rejected.count() == 10


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text("origin;cancelled;month\nABE;0;3\n")
    row = read_csv(spark, str(tmp_path / "x.csv"), sep=";").good.first()
    assert (row.origin, row.cancelled, row.month) == ("ABE", 0, 3)


def test_parquet_and_csv_give_the_same_report(spark, small, tmp_path):
    flights = flights_view(spark, small).withColumn("fl_date", F.col("fl_date").cast("timestamp"))
    flights.write.parquet(str(tmp_path / "p"))
    flights.write.option("header", True).csv(str(tmp_path / "c"))
    a = route_month_stats(read_parquet(spark, str(tmp_path / "p")).good)
    b = route_month_stats(read_csv(spark, str(tmp_path / "c")).good)
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 0


def test_parquet_reads_only_the_used_columns(spark, small, tmp_path):
    flights_view(spark, small).write.parquet(str(tmp_path / "p"))
    report = route_month_stats(read_parquet(spark, str(tmp_path / "p")).good)
    plan = report._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema") :]
    assert "arr_delay" in read and "dest" not in read and "nas_delay" not in read


def test_declared_table(spark, small, tmp_path):
    flights_view(spark, small).write.option("header", True).csv(str(tmp_path / "c"))
    for _ in range(2):
        declare_flights(spark, str(tmp_path / "c"), "airline_db.flights", source="csv")
    n = spark.sql("select count(*) as n from airline_db.flights where cancelled = 0").first().n
    assert n == flights_view(spark, small).where("cancelled = 0").count()


def test_declared_table_finds_columns_by_name(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.csv").write_text("arr_delay,note,dep_delay\n7,a,5\n")
    table = declare_flights(spark, str(tmp_path / "t"), "by_name", source="csv")
    row = table.first()
    assert (row.dep_delay, row.arr_delay, row.note) == (5.0, 7.0, "a")


def test_rejects_keep_the_line_and_the_true_reason(spark, tmp_path):
    line = '1,"A,B",1,2,7'
    (tmp_path / "x.csv").write_text(f"month,origin,dep_delay,arr_delay,cancelled\n{line}\n")
    row = read_csv(spark, str(tmp_path / "x.csv")).rejected.first()
    assert (row.record, row.reasons) == (line, ["flag"])


def part_lines(path):
    return [
        line for f in sorted(Path(path).glob("part-*")) for line in f.read_text().splitlines()
    ]


def test_report_files_are_ordered_and_formatted(spark, small, tmp_path):
    flights = flights_view(spark, small)
    out = str(tmp_path / "r")
    write_report(delay_band_report(flights), out, S.DELAY_BAND_KEY)
    header = ",".join(S.DELAY_BAND_HEADER)
    lines = [line for line in part_lines(out) if line != header]
    keys = [tuple(line.split(",")[:2]) for line in lines]
    assert keys == sorted(keys, key=lambda k: (k[0], int(k[1])))
    cells = next(csv.reader([lines[0]]))
    assert cells[-1].startswith("['") and '"[\'' in lines[0]
    assert "." in cells[3] and len(cells[3].split(".")[1]) == 2
    back = read_report(spark, out, S.DELAY_BAND_REPORT)
    assert back.exceptAll(delay_band_report(flights)).count() == 0


def test_plain_numbers(spark, make_flights, tmp_path):
    report = route_month_stats(make_flights([{"arr_delay": -4.8}]))
    for plain, text in ((False, "-4.80"), (True, "-4.8")):
        out = str(tmp_path / str(plain))
        write_report(report, out, S.ROUTE_MONTH_KEY, plain_numbers=plain)
        assert part_lines(out)[-1].split(",")[5] == text


def test_snapshot(spark, small, tmp_path):
    order = ["aeroporto_partenza", "classifica"]
    full, top = (str(tmp_path / n) for n in ("full", "top"))
    write_report(carrier_deviation(flights_view(spark, small)), full, order)
    snapshot(spark, full, top, S.CARRIER_DEVIATION_REPORT, order)
    header = ",".join(S.CARRIER_DEVIATION_HEADER)
    rows = [line for line in part_lines(full) if line != header]
    assert part_lines(top) == [header, *rows[:10]]


def test_scales_on_disk(spark, small, tmp_path):
    orders = load(spark, small, "orders").select("o_orderkey", "o_custkey")
    n = orders.count()
    write_scales(orders, str(tmp_path / "s"), key=["o_orderkey"])
    for fmt in ("parquet", "csv"):
        reader = spark.read.option("header", True)
        for scale, size in ((10, round(0.1 * n)), (75, round(0.75 * n)), (150, round(1.5 * n))):
            path = str(tmp_path / "s" / fmt / f"scale={scale}")
            assert reader.format(fmt).load(path).count() == size


def test_reconcile_files(spark, make_flights, tmp_path):
    report = route_month_stats(make_flights([{"arr_delay": 1.0}]))
    for name in ("a", "b"):
        write_report(report, str(tmp_path / name), S.ROUTE_MONTH_KEY)
    layout = (S.ROUTE_MONTH_REPORT, S.ROUTE_MONTH_KEY)
    jobs = [
        ("same", str(tmp_path / "a"), str(tmp_path / "b"), *layout),
        ("gone", str(tmp_path / "a"), str(tmp_path / "none"), *layout),
    ]
    got = {r.job: r.verdict for r in reconcile_files(spark, jobs).collect()}
    assert got == {"same": "identical", "gone": "missing input"}


def test_run_log(spark, tmp_path):
    log = str(tmp_path / "log")
    append_run(spark, log, 10, "3.1", "Hive", 8)
    seconds = timed(spark, log, 100, "3.1", "Spark_SQL", lambda: spark.range(5).count())
    rows = read_runs(spark, log, "Locale")
    assert rows.select(*R.RUN, "env").distinct().count() == 2
    got = {(r.tech, r.pct): r.seconds for r in rows.collect()}
    assert got == {("Hive", 10): 8.0, ("Spark_SQL", 100): seconds}


def test_appended_runs_keep_their_order(spark, tmp_path):
    log = str(tmp_path / "log")
    for i in range(8):
        append_run(spark, log, 100, "3.1", "Hive", i)
    rows = read_runs(spark, log, "Locale").orderBy("repeat").collect()
    assert [r.seconds for r in rows] == list(range(8))
    both = read_runs(spark, log, "Locale").unionByName(read_runs(spark, log, "Cluster"))
    assert R.side_values(both).first().a == 0


def test_run_log_without_a_start(spark, tmp_path):
    (tmp_path / "log.csv").write_text(
        "Percentuale,Analisi,Tecnologia,Tempo_Secondi\n10%,3.1,Hive,8\n10%,3.1,Hive,9\n"
    )
    rows = read_runs(spark, str(tmp_path / "log.csv"), "Locale").orderBy("repeat").collect()
    assert [(r.pct, r.seconds) for r in rows] == [(10, 8.0), (10, 9.0)]


def test_scratch_is_shared(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_flag_check_reaches_the_parquet_scan(spark, make_flights, tmp_path):
    flights = make_flights([{"cancelled": c} for c in (0, 1, 2, None)])
    flights.write.parquet(str(tmp_path / "p"))
    loaded = read_parquet(spark, str(tmp_path / "p"))
    assert (loaded.good.count(), loaded.rejected.count()) == (2, 2)
    plan = loaded.good._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cancelled" in plan or "Or(EqualTo(cancelled" in plan


def test_runs_added_at_once_are_all_kept(spark, tmp_path):
    log = str(tmp_path / "log")
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: append_run(spark, log, 10, "3.1", f"T{i:02d}", i), range(20)))
    before = sorted(tuple(r) for r in read_runs(spark, log, "x").collect())
    assert [r[1] for r in before] == [f"T{i:02d}" for i in range(20)]
    compact_runs(spark, log, rows_per_file=8)
    after = read_runs(spark, log, "x")
    assert sorted(tuple(r) for r in after.collect()) == before
    kept = sorted(p.name for p in Path(log).iterdir() if p.name[0] not in "._")
    assert 1 <= len(kept) <= 3
    starts = [int(row["Inizio"]) for n in kept for row in csv.DictReader(open(f"{log}/{n}"))]
    assert starts == sorted(starts) and len(starts) == 20


def test_an_interrupted_compaction_is_undone(spark, tmp_path):
    log = tmp_path / "log"
    for i in range(3):
        append_run(spark, str(log), 10, "3.1", f"T{i}", i)
    before = sorted(tuple(r) for r in read_runs(spark, str(log), "x").collect())
    (log / "_old-abc").mkdir()
    (log / "_new-abc").mkdir()
    for f in sorted(log.glob("run-*.csv"))[:2]:
        f.rename(log / "_old-abc" / f.name)
    (log / "all-abc-00000.csv").write_text("partly moved\n")
    compact_runs(spark, str(log))
    assert sorted(tuple(r) for r in read_runs(spark, str(log), "x").collect()) == before
    assert not list(log.glob("_*"))


def test_a_report_is_read_back_in_its_order(spark, small, tmp_path):
    report = carrier_deviation(flights_view(spark, small))
    path = str(tmp_path / "r")
    write_report(report.repartition(5), path, S.CARRIER_DEVIATION_KEY)
    rows = read_ordered(spark, path, S.CARRIER_DEVIATION_REPORT, S.CARRIER_DEVIATION_KEY).collect()
    rows.sort(key=lambda r: r.place)
    keys = [(r.aeroporto_partenza, r.compagnia) for r in rows]
    assert [r.place for r in rows] == list(range(1, report.count() + 1)) and keys == sorted(keys)
    report.repartition(4).write.option("header", True).csv(str(tmp_path / "u"))
    with pytest.raises(ValueError, match="do not follow"):
        read_ordered(spark, str(tmp_path / "u"), S.CARRIER_DEVIATION_REPORT, S.CARRIER_DEVIATION_KEY)
