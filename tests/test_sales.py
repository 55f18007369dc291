import datetime as dt

from conftest import rows

from plotscope.operators import sales as S

RAW = (
    "PARCEL_ID string, DOR_UC string, VI_CD string, OR_BOOK string, OR_PAGE string, CLERK_NO string, QUAL_CD string,"
    " SALE_YR string, SALE_MO string, SALE_PRC string, MULTI_PAR_SAL string, source_year int"
)


def raw(spark, *records):
    """(parcel, book, clerk, qual, month, price, multi, file year)"""
    data = [(p, "001", "I", b, "1" if b else None, c, q, "2016", m, pr, mu, y) for p, b, c, q, m, pr, mu, y in records]
    return spark.createDataFrame(data, RAW)


def test_dedup_rules(spark):
    df = raw(
        spark,
        ("A", "b", None, "01", "6", "100", None, 2016), ("A", "b", None, "01", "6", "100", None, 2017),  # copies
        ("B", "b", None, "01", "6", "100", None, 2016), ("B", "b", None, "01", "6", "250", None, 2017),  # conflict
        ("C", "b", None, "01", "6", "300", None, 2017), ("C", "b", None, "01", "6", "200", None, 2017),  # same file
        ("D", None, None, "01", "6", "100", None, 2016), ("D", None, None, "01", "6", "100", None, 2017),  # no ref
        ("E", None, None, "01", "6", "100", None, 2016), ("E", None, None, "01", "6", "150", None, 2017),  # no ref
        ("F", None, "9", "01", "6", "n/a", None, 2016), ("F", None, "9", "01", "6", "n/a", None, 2017),  # null price
    )
    typed = S.typed_sales(df)
    kept = rows(S.deduplicate(typed).select("parcel_id", "price", "source_year"), "parcel_id", "price")
    assert kept == [
        ("A", 100.0, 2017), ("B", 250.0, 2017), ("C", 300.0, 2017), ("D", 100.0, 2017), ("E", 100.0, 2016),
        ("E", 150.0, 2017), ("F", None, 2017),
    ]
    two_steps = S.resolve_conflicts(S.drop_exact_duplicates(typed))
    assert rows(two_steps.select("parcel_id", "price", "source_year"), "parcel_id", "price") == kept
    report = S.dedup_report(typed).first()
    assert (report.raw_rows, report.no_ref_rows, report.exact_duplicates) == (12, 4, 3)
    assert (report.conflict_groups, report.conflict_rows, report.distinct_sales) == (2, 4, 7)
    assert S.same_file_conflicts(S.drop_exact_duplicates(typed)).first().groups == 1


def test_flags(spark):
    df = raw(
        spark,
        ("A", "1", None, "01", "6", "1", None, 2016), ("B", "1", None, "02", "13", "1", "M", 2016),
        ("C", "1", None, "11", None, "1", "", 2016), ("D", "1", None, None, "0", "1", None, 2016),
    )
    got = rows(
        S.sale_history(df).select("parcel_id", "qualified", "multi_parcel_sale", "comp_eligible", "sale_date"), "parcel_id"
    )
    assert got == [
        ("A", True, False, True, dt.date(2016, 6, 1)), ("B", True, True, False, None),
        ("C", False, False, False, None), ("D", False, False, False, None),
    ]


def test_row_order_and_partitions_do_not_matter(spark, tiny):
    from catalog import adapters

    df = adapters.raw_sales(spark, tiny)
    base = S.sale_history(df)
    shuffled = S.sale_history(df.orderBy("SALE_PRC", "PARCEL_ID").repartition(5, "SALE_PRC"))
    assert base.exceptAll(shuffled).count() == 0 and shuffled.exceptAll(base).count() == 0


def test_copies_are_limited_before_the_shuffle(spark, tiny):
    from catalog import adapters

    plan = S.sale_history(adapters.raw_sales(spark, tiny))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 1
