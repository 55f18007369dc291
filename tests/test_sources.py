import os
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plotscope.operators.parcels import PARCEL_COLUMNS, build_parcels, build_snapshots
from plotscope.operators.stability import id_transitions, ids_in_every_year
from plotscope.plans.history import build_history_table, build_parcel_file, build_snapshot_table, build_stability_report
from plotscope.sources import rolls, tables


def put_zip(path, member, header, records):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    lines = [",".join(header)] + [",".join('"' + r.get(c, "") + '"' for c in header) for r in records]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member, "\r\n".join(lines) + "\r\n")


def roll_record(pid, **change):
    base = {
        "PARCEL_ID": pid, "DOR_UC": "001", "NBRHD_CD": "N1", "JV": "100000", "LND_VAL": "5", "TOT_LVG_AREA": "1000",
        "ACT_YR_BLT": "1980", "OWN_NAME": f"Owner {pid}", "OWN_ADDR1": "1 A St", "PHY_ADDR1": "1 A St.",
        "PHY_ZIPCD": "33101", "OWN_ZIPCD": "33101", "OWN_STATE": "FL",
    }
    return base | change


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_sale_files(spark, folder):
    extra = ["CO_NO", *rolls.SALE_COLUMNS]
    for year, price in ((2016, "100"), (2017, "100")):
        record = {
            "PARCEL_ID": " 0012 ", "DOR_UC": "001", "QUAL_CD": "01", "SALE_YR": "2016", "SALE_MO": "5", "SALE_PRC": price,
            "OR_BOOK": "7", "OR_PAGE": "8", "MULTI_PAR_SAL": "  ", "CO_NO": "23",
        }
        put_zip(f"{folder}/SDF/{year}F.zip", f"SDF{year}.csv", extra, [record, {"PARCEL_ID": "x", "SALE_YR": "2015"}])
    raw = rolls.read_sale_files(spark, f"{folder}/SDF", [2016, 2017])
    assert raw.columns == [*rolls.SALE_COLUMNS, "source_year"]
    assert raw.count() == 4 and raw.filter("PARCEL_ID = '0012' AND MULTI_PAR_SAL IS NULL").count() == 2
    table = build_history_table(spark, f"{folder}/SDF", [2016, 2017], f"{folder}/history")
    assert rows(table.select("parcel_id", "sale_year", "price", "source_year", "comp_eligible"), "parcel_id") == [
        ("0012", 2016, 100.0, 2017, True), ("x", 2015, None, 2017, False),
    ]
    assert sorted(p for p in os.listdir(f"{folder}/history") if "=" in p) == ["sale_year=2015", "sale_year=2016"]


def test_missing_files(spark, folder):
    with pytest.raises(FileNotFoundError, match="2016F.zip"):
        rolls.read_sale_files(spark, folder, [2016])
    with pytest.raises(RuntimeError, match="no county files"):
        rolls.read_county_rolls(spark, folder, ["Miami-Dade", "Broward"])


def test_missing_column(spark, folder):
    put_zip(f"{folder}/SDF/2016F.zip", "s.csv", ["PARCEL_ID"], [{"PARCEL_ID": "1"}])
    with pytest.raises(Exception, match="DOR_UC"):
        rolls.read_sale_files(spark, f"{folder}/SDF", [2016]).collect()


def test_county_rolls_and_csv(spark, folder):
    name, member = rolls.COUNTY_FILES["Broward"]
    records = [
        roll_record("01", QUAL_CD1="01", SALE_PRC1="80000", SALE_YR1="2020", SALE_MO1="03"),
        roll_record("02", TOT_LVG_AREA=""), roll_record("03", PHY_ZIPCD=""), roll_record("04", DOR_UC="004"),
        roll_record("05", OWN_STATE="ny", OWN_ADDR1="PO, Box 9"),
    ]
    put_zip(f"{folder}/{name}", member, rolls.ROLL_COLUMNS, records)
    counties = ["Miami-Dade", "Broward"]  # the first has no file
    with pytest.raises(RuntimeError, match="Miami-Dade"):
        build_parcel_file(spark, folder, counties, f"{folder}/parcels.csv")
    with pytest.warns(UserWarning, match="Miami-Dade"):
        parcels = build_parcel_file(spark, folder, counties, f"{folder}/parcels.csv", include_extra=True, skip_missing=True)
    assert parcels.columns == PARCEL_COLUMNS
    back = tables.read_parcels_csv(spark, f"{folder}/parcels.csv")
    assert back.schema == tables.PARCEL_SCHEMA
    assert back.exceptAll(parcels).count() == 0 and parcels.exceptAll(back).count() == 0
    got = {r.parcel_id: r for r in back.collect()}
    assert sorted(got) == ["01", "04", "05"] and got["01"].county == "Broward"
    assert (got["01"].equity_proxy, got["01"].equity_proxy_annualized_pct, got["01"].sale1_month) == (20000.0, 5.0, "03")
    assert (got["05"].absentee, got["05"].out_of_state, got["05"].ownership_tenure_years) == (True, True, 100.0)
    plan = build_parcels(rolls.read_county_rolls(spark, folder, counties, skip_missing=True))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(PARCEL" not in plan


def test_snapshots_and_duplicates(spark, folder):
    for year in (2016, 2017):
        put_zip(f"{folder}/NAL/{year}F.zip", "n.csv", rolls.ROLL_COLUMNS, [roll_record("a"), roll_record("b", DOR_UC="004")])
    table = build_snapshot_table(spark, f"{folder}/NAL", [2016, 2017], f"{folder}/snaps")
    assert rows(table.select("parcel_id", "vintage_year", "living_area"), "vintage_year") == [
        ("a", 2016, 1000.0), ("a", 2017, 1000.0),
    ]
    put_zip(f"{folder}/NAL/2018F.zip", "n.csv", rolls.ROLL_COLUMNS, [roll_record("a"), roll_record("a")])
    with pytest.raises(ValueError, match="duplicate"):
        build_snapshot_table(spark, f"{folder}/NAL", [2018], f"{folder}/snaps2")


def test_id_stability(spark, folder):
    first = [("keep", "O", "1 A"), ("gone", "P", "2 B"), ("new-id", "Q", "3 C")]
    second = [("keep", "O", "1 A"), ("renumbered", "q", "3  C.")]
    data = [(*r, 2016) for r in first] + [(*r, 2017) for r in second]
    df = spark.createDataFrame(data, "PARCEL_ID string, OWN_NAME string, PHY_ADDR1 string, vintage_year int")
    assert tuple(ids_in_every_year(df).first())[:2] == (4, 1)
    got = {r.from_year: r for r in id_transitions(df).collect()}
    assert (got[2016].disappeared, got[2016].renumbered, got[2016].dropped) == (2, 1, 1)
    assert got[None].disappeared == 2


def test_stability_of_gaps_repeated_rows_and_missing_ids(spark):
    data = [("a", "O", "1", 2016), ("a", "O", "1", 2016), ("a", "O", "1", 2019), ("b", "P", "2", 2017), (None, "N", None, 2016)]
    data += [("c", "O", "1", 2017), (None, "N", None, 2017)]
    df = spark.createDataFrame(data, "PARCEL_ID string, OWN_NAME string, PHY_ADDR1 string, vintage_year int")
    assert tuple(ids_in_every_year(df).first())[:2] == (4, 0)
    got = {r.from_year: (r.disappeared, r.renumbered) for r in id_transitions(df).collect()}
    assert got == {2016: (2, 2), None: (2, 2)}  # 2018 has no roll, so 2017 has no next one
    assert id_transitions(df.limit(0)).count() == 0 and ids_in_every_year(df.limit(0)).first()[0] == 0


def test_stability_report_reads_three_columns(spark, folder):
    for year, ids in ((2016, "ab"), (2017, "ac")):
        records = [{"PARCEL_ID": i, "OWN_NAME": "x", "PHY_ADDR1": "1 A", "JV": "7"} for i in ids]
        put_zip(f"{folder}/NAL/{year}F.zip", "n.csv", ["JV", *rolls.STABILITY_COLUMNS], records)
    ids, transitions = build_stability_report(spark, f"{folder}/NAL", [2016, 2017], f"{folder}/report")
    assert tuple(ids.first())[:2] == (3, 1)
    assert {r.from_year: r.renumbered for r in transitions.collect()} == {2016: 1, None: 1}
    assert spark.read.parquet(f"{folder}/report-staged").columns == [*rolls.STABILITY_COLUMNS, "vintage_year"]


def test_every_member_is_a_partition(spark, folder):
    paths = {}
    for year in (2016, 2017, 2018):
        put_zip(f"{folder}/{year}F.zip", "n.csv", ["PARCEL_ID"], [{"PARCEL_ID": f"{year}-{i}"} for i in range(50_000)])
        paths[str(year)] = (f"{folder}/{year}F.zip", None)
    df = rolls.read_zips(spark, paths, ["PARCEL_ID"])
    assert df.rdd.getNumPartitions() == 3
    assert df.groupBy("file_label").count().collect() and df.select("PARCEL_ID").distinct().count() == 150_000
    again = rolls.staged(df, f"{folder}/staged", "file_label")
    assert "zipped_csv" not in again._jdf.queryExecution().executedPlan().toString()


def test_parquet_scan_is_pruned(spark, folder):
    from plotscope.operators.parcels import subjects_as_of
    import datetime as dt

    raw = spark.createDataFrame([tuple(roll_record("a").values()) + (y,) for y in (2016, 2017)], [*roll_record("a"), "vintage_year"])
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in rolls.SNAPSHOT_COLUMNS if c not in raw.columns})
    tables.write_table(build_snapshots(raw), f"{folder}/s", ["vintage_year"])
    got = subjects_as_of(tables.read_table(spark, f"{folder}/s"), [dt.date(2018, 1, 1)]).select("as_of", "parcel_id", "living_area")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "vintage_year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThan(living_area,0.0)" in plan and "own_addr1" not in plan.split("ReadSchema")[1]
    assert got.count() == 1


def test_staged_rows_stay_with_their_member(spark, folder, monkeypatch):
    for year in (2016, 2017):
        put_zip(f"{folder}/{year}F.zip", "a.csv", rolls.SALE_COLUMNS, [{"PARCEL_ID": f"{year}-{i}"} for i in range(3)])
    raw = rolls.read_sale_files(spark, folder, [2016, 2017])
    monkeypatch.setattr(type(raw), "hint", lambda *_: pytest.fail("shuffled"))
    staged = rolls.staged(raw, f"{folder}/staged", "source_year")
    assert staged.schema["source_year"].dataType == raw.schema["source_year"].dataType
    assert rows(staged, "PARCEL_ID") == rows(raw, "PARCEL_ID")
    files = staged.groupBy(F.input_file_name()).agg(F.count_distinct("source_year").alias("n"))
    assert [r.n for r in files.collect()] == [1, 1]
