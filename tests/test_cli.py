"""The command line from raw text to compared reports."""

from pyspark.sql import functions as F

from tarmac.__main__ import main
from tarmac.sources import append_run
from tarmac.sources.tables import raw_view


def test_raw_text_to_reports(spark, small, tmp_path, capsys):
    raw, clean, scaled = (str(tmp_path / n) for n in ("raw", "clean", "scaled"))
    raw_view(spark, small).write.option("header", True).csv(raw)

    main(["prepare", raw, clean], spark)
    assert "drop_outliers" in capsys.readouterr().out
    flights = spark.read.parquet(f"{clean}/flights")
    assert dict(flights.dtypes)["nas_delay"] == "double" and "year" not in flights.columns
    refused = spark.read.parquet(f"{clean}/rejected").count()
    audit = {r.name: r.row_count for r in spark.read.parquet(f"{clean}/audit").collect()}
    assert flights.count() == audit["drop_outliers"] < audit["initial"]
    everything = raw_view(spark, small)
    assert refused == everything.where("cancelled = 2 or cancelled is null").count() > 0
    assert audit["read"] == audit["initial"] + refused == everything.count()
    profile = spark.read.parquet(f"{clean}/profile")
    assert {r.measure for r in profile.select("measure").distinct().collect()} == {
        "nulls", "nulls_uncoded", "smallest", "largest", "rows", "outliers", "outlier_percent",
        "flags",
    }

    main(["scales", f"{clean}/flights", scaled, "--scale", "0.5", "--scale", "1.5"], spark)
    half = spark.read.parquet(f"{scaled}/parquet").where(F.col("scale") == 50)
    assert half.count() == round(flights.count() * 0.5)

    log = str(tmp_path / "log")
    for name in ("3.1", "3.2", "3.3"):
        out = str(tmp_path / name)
        main(["report", name, f"{clean}/flights", out, "--log", log], spark)
        assert "refused rows: 0" in capsys.readouterr().out
        top = spark.read.option("header", True).csv(f"{out}/top")
        assert top.count() == 10
        main(["reconcile", name, f"{out}/full", f"{out}/full"], spark)
        assert "identical" in capsys.readouterr().out
        main(["reconcile", name, f"{out}/full", str(tmp_path / "none")], spark)
        assert "missing input" in capsys.readouterr().out

    other = str(tmp_path / "other")
    append_run(spark, other, 100, "3.1", "Spark_SQL", 0.5)
    main(["runs", log, other, "--overhead", "0"], spark)
    shown = capsys.readouterr().out
    assert "A3.1_speedup" in shown and "best_run" in shown
