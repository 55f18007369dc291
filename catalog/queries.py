"""Registered queries: (spark, sf_dir) -> DataFrame, one per operator or composite."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import adapters as A
from plotscope.functions.dates import month_start
from plotscope.functions.text import normalize_address, to_number, zip5
from plotscope.operators import evaluation, flips, guard, index, parcels, sales, scoring, signals, stability, valuation
from plotscope.operators.order_stats import percent_rank_average
from plotscope.params import AS_OF_SETTINGS, COARSE_DISPERSION, COARSE_MIN_SALES
from plotscope.plans import backtest, history, leakage, screen
from plotscope.sources import rolls, tables
from plotscope.storage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DATES = A.AS_OF_DATES
INDEX_DATES = [dt.date(1999, 1, 1), dt.date(1999, 7, 16), dt.date(2000, 1, 1)]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Round the given columns, or all floating-point ones, by plain arithmetic that
    gives the same bits in any engine."""
    chosen = columns or [c for c, kind in df.dtypes if kind == "double"]
    unit = float(10**digits)
    return df.withColumns({c: F.floor(F.col(c) * unit + 0.5) / unit for c in chosen})


# -- stored intermediates, shared by the queries of one session ---------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        events = valuation.comp_events(A.history(spark, d), A.snapshots(spark, d))
        return events.select(*valuation.EVENT_COLUMNS, "recording_ref", "price")

    return A.stored(spark, d, "events", build)


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return parcels.subjects_as_of(A.snapshots(spark, d), DATES)


def _valued(spark: SparkSession, d: str) -> DataFrame:
    return A.stored(
        spark, d, "valued", lambda: backtest.valued_subjects(A.history(spark, d), A.snapshots(spark, d), DATES)
    )


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return A.stored(
        spark, d, "signals", lambda: signals.owner_signals(_valued(spark, d), A.history(spark, d), DATES)
    )


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return A.stored(
        spark, d, "scored", lambda: backtest.score_dates(A.history(spark, d), A.snapshots(spark, d), DATES)
    )


def _screen_base(spark: SparkSession, d: str) -> DataFrame:
    def build() -> DataFrame:
        return screen.screen_base(A.parcels(spark, d), A.history(spark, d), A.snapshots(spark, d), A.SCREEN_DATE)

    return A.stored(spark, d, "screen_base", build)


def _flip_results(spark: SparkSession, d: str) -> DataFrame:
    return A.stored(spark, d, "flip_results", lambda: flips.flip_backtest(A.parcels(spark, d)))


# -- cleaning and row-wise derivations -----------------------------------------------


@query
def zip5_(spark, d):
    roll = A.raw_county_roll(spark, d)
    return roll.select("PARCEL_ID", zip5(F.col("PHY_ZIPCD")).alias("situs_zip"), zip5(F.col("OWN_ZIPCD")).alias("mail_zip"))


QUERIES["zip5"] = QUERIES.pop("zip5_")


@query
def addr_norm(spark, d):
    roll = A.raw_county_roll(spark, d)
    return roll.select(
        "PARCEL_ID",
        normalize_address(F.col("OWN_ADDR1")).alias("own_addr"),
        normalize_address(F.col("PHY_ADDR1")).alias("situs_addr"),
    )


@query
def numbers(spark, d):
    roll = A.raw_county_roll(spark, d)
    return roll.select(
        "PARCEL_ID", to_number(F.col("TOT_LVG_AREA")).alias("living_area"), to_number(F.col("JV")).alias("just_value")
    )


@query
def use_code_filter(spark, d):
    kept = parcels.residential(A.raw_county_roll(spark, d), include_extra=True)
    return kept.select("PARCEL_ID", "DOR_UC", (F.col("DOR_UC") == "001").alias("core"))


def _built(spark: SparkSession, d: str) -> DataFrame:
    return parcels.build_parcels(A.raw_county_roll(spark, d), assessment_year=A.ASSESSMENT_YEAR)


@query
def absentee(spark, d):
    return _built(spark, d).select("parcel_id", "absentee")


@query
def out_of_state(spark, d):
    return _built(spark, d).select("parcel_id", "out_of_state")


@query
def tenure(spark, d):
    return _built(spark, d).select("parcel_id", "ownership_tenure_years")


@query
def equity_proxy(spark, d):
    df = _built(spark, d).select("parcel_id", "equity_proxy", "equity_proxy_annualized_pct")
    return rounded(df, 6, "equity_proxy_annualized_pct")


@query
def parcels_table(spark, d):
    return rounded(_built(spark, d), 6, "equity_proxy_annualized_pct")


@query
def csv_roundtrip(spark, d):
    path = f"{shared_folder(spark)}/parcels_csv_{spark.sparkContext.applicationId}"
    tables.write_csv(_built(spark, d), path)
    return rounded(tables.read_parcels_csv(spark, path), 6, "equity_proxy_annualized_pct")


@query
def recording_ref(spark, d):
    return sales.typed_sales(A.raw_sales(spark, d)).groupBy("recording_ref").agg(F.count("*").alias("n"))


@query
def sale_date(spark, d):
    counted = sales.typed_sales(A.raw_sales(spark, d)).groupBy("sale_year", "sale_month").agg(F.count("*").alias("n"))
    return counted.select(
        "sale_year",
        "sale_month",
        month_start(F.col("sale_year"), F.col("sale_month")).alias("month_or_null"),
        month_start(F.col("sale_year"), F.col("sale_month"), "clip").alias("month_clipped"),
        "n",
    )


# -- sale history --------------------------------------------------------------------


def _multi(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("multi_par_sal", "multi")


@query
def dedup_exact(spark, d):
    return _multi(sales.drop_exact_duplicates(sales.typed_sales(A.raw_sales(spark, d))))


@query
def dedup_conflict(spark, d):
    return _multi(sales.deduplicate(sales.typed_sales(A.raw_sales(spark, d))))


@query
def sale_history(spark, d):
    return sales.sale_history(A.raw_sales(spark, d))


@query
def table_roundtrip(spark, d):
    path = f"{shared_folder(spark)}/history_{spark.sparkContext.applicationId}"
    tables.write_table(sales.sale_history(A.raw_sales(spark, d)), path, ["sale_year"])
    return tables.read_table(spark, path).select(*sales.HISTORY_COLUMNS)


@query
def sale_flags(spark, d):
    flagged = sales.with_flags(sales.deduplicate(sales.typed_sales(A.raw_sales(spark, d))))
    return flagged.groupBy("qual_code", "qualified", "multi_parcel_sale", "comp_eligible").agg(F.count("*").alias("n"))


@query
def qual_by_year(spark, d):
    return sales.codes_by_file_year(A.raw_sales_once(spark, d))


@query
def dedup_report(spark, d):
    return rounded(sales.dedup_report(sales.typed_sales(A.raw_sales(spark, d))))


@query
def conflict_groups(spark, d):
    return sales.conflict_groups(sales.typed_sales(A.raw_sales(spark, d)))


@query
def same_file_conflicts(spark, d):
    return sales.same_file_conflicts(sales.drop_exact_duplicates(sales.typed_sales(A.raw_sales(spark, d))))


@query
def multi_parcel_report(spark, d):
    return rounded(sales.multi_parcel_report(A.history(spark, d)))


@query
def sales_per_year(spark, d):
    return sales.qualified_per_year(A.history(spark, d))


@query
def date_coverage(spark, d):
    return sales.date_coverage(A.history(spark, d))


# -- snapshots, comp events, index ------------------------------------------------------


@query
def snapshots(spark, d):
    return parcels.build_snapshots(A.raw_rolls(spark, d))


@query
def duplicate_snapshots(spark, d):
    return parcels.duplicate_snapshots(A.snapshots(spark, d))


@query
def subjects(spark, d):
    return _subjects(spark, d).select("as_of", "parcel_id", "nbrhd_cd", "living_area", "year_built", "just_value")


@query
def comp_events(spark, d):
    events = valuation.comp_events(A.history(spark, d), A.snapshots(spark, d))
    kept = events.select(
        "parcel_id", "sale_date", "recording_ref", "price", "nbrhd_cd", "living_area", "year_built", "just_value",
        "price_per_sqft",
    )
    return rounded(kept, 6, "price_per_sqft")


@query
def comp_join_report(spark, d):
    return valuation.comp_join_report(A.history(spark, d), A.snapshots(spark, d))


@query
def annual_median(spark, d):
    return rounded(index.year_medians(_events(spark, d)))


@query
def index_asof(spark, d):
    return rounded(index.index_asof(_events(spark, d), INDEX_DATES))


@query
def index_level(spark, d):
    """Level at every sale month, including months outside the anchors of a date."""
    anchors = index.anchor_arrays(index.index_asof(_events(spark, d), INDEX_DATES))
    months = A.history(spark, d).select("sale_date").distinct().filter(F.col("sale_date").isNotNull())
    each = months.select("sale_date", F.explode(F.array(*[F.lit(x) for x in INDEX_DATES])).alias("as_of"))
    joined = each.join(F.broadcast(anchors), "as_of")
    return rounded(joined.select("as_of", "sale_date", index.level_at(F.col("anchors"), F.col("sale_date")).alias("level")))


@query
def adjusted_psf(spark, d):
    pool = valuation.comp_pool(_events(spark, d), DATES)
    return rounded(pool.select("as_of", "parcel_id", "sale_date", "recording_ref", "price", "psf"), 6, "psf")


# -- valuation ------------------------------------------------------------------------


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    pool = valuation.comp_pool(_events(spark, d), DATES)
    return valuation.comp_statistics(_subjects(spark, d), pool, AS_OF_SETTINGS).fillna(0, ["all_n", "band_n"])


@query
def comp_stats(spark, d):
    names = [f"{p}_{s}" for p in ("all", "band") for s in ("n", "median", "q1", "q3")]
    return rounded(_statistics(spark, d).select("as_of", "parcel_id", *names))


@query
def arv_unbanded(spark, d):
    estimate = F.when(F.col("all_n") >= 5, F.rint(F.col("all_median") * F.col("living_area")))
    return _statistics(spark, d).select(
        "as_of", "parcel_id", estimate.alias("arv_estimate"), F.col("all_n").cast("int").alias("arv_comp_count")
    )


@query
def arv_banded(spark, d):
    return valuation.value_as_of(_subjects(spark, d), _events(spark, d), DATES)


@query
def arv_by_pages(spark, d):
    """The same valuation through the price index that large neighbourhoods take, of several
    levels."""
    settings = dataclasses.replace(AS_OF_SETTINGS, task_comps=20, page_comps=16, fan_out=8)
    return valuation.value_as_of(_subjects(spark, d), _events(spark, d), DATES, settings)


@query
def spread(spark, d):
    df = _valued(spark, d).select("as_of", "parcel_id", "spread_estimate", "pct_spread")
    return rounded(rounded(df, 4, "spread_estimate"), 6, "pct_spread")


@query
def default_ranked(spark, d):
    ranked = valuation.default_ranked(_valued(spark, d))
    df = ranked.select("as_of", "parcel_id", "arv_estimate", "spread_estimate", "pct_spread")
    return rounded(rounded(df, 4, "spread_estimate"), 6, "pct_spread")


@query
def default_places(spark, d):
    """The order of the default view, as places."""
    return valuation.default_places(_valued(spark, d)).select("as_of", "parcel_id", "rank")


@query
def coarse_nbrhd(spark, d):
    return rounded(valuation.neighbourhood_dispersion(_events(spark, d), COARSE_DISPERSION, COARSE_MIN_SALES))


# -- signals, scores, outcomes -----------------------------------------------------------


@query
def last_sales(spark, d):
    return signals.last_sales(A.history(spark, d), DATES)


@query
def signals_asof(spark, d):
    df = signals.owner_signals(_valued(spark, d), A.history(spark, d), DATES)
    kept = df.select(
        "as_of", "parcel_id", "absentee", "no_sale_on_record", "ownership_tenure_years", "last_qual_price", "equity_proxy"
    )
    return rounded(kept, 6, "ownership_tenure_years")


@query
def motivation_score(spark, d):
    names = ["absentee_score", "tenure_score", "equity_proxy_score", "motivation_score"]
    return rounded(scoring.motivation_score(A.parcels(spark, d)).select("parcel_id", *names, "grade"))


_COMPOSITE = ["absentee_score", "tenure_score", "equity_score", "pct_spread_score", "composite_score"]


@query
def composite_minmax(spark, d):
    return rounded(scoring.composite_score(_signals(spark, d)).select("as_of", "parcel_id", *_COMPOSITE))


@query
def composite_rank(spark, d):
    return rounded(scoring.composite_score(_signals(spark, d), "rank").select("as_of", "parcel_id", *_COMPOSITE))


@query
def pct_rank(spark, d):
    ranked = percent_rank_average(_valued(spark, d), ["as_of"], "pct_spread", "pct_rank")
    return rounded(ranked.select("as_of", "parcel_id", "pct_rank"))


@query
def outcomes(spark, d):
    df = _scored(spark, d).select(
        "as_of", "parcel_id", "ce_price", "q_price", "q_sale_year", "jv_prior", "sold_ce", "discount_pct", "discounted",
        "sold_q", "has_jv_prior", "below_jv",
    )
    return rounded(df, 6, "discount_pct")


# -- evaluation ----------------------------------------------------------------------------


def _tie():
    """Key arithmetic that SQL can repeat, in place of the seeded hash."""
    pid = F.col("parcel_id").cast("long")
    return (pid * 7919) % 10007 * 1_000_000_000 + pid


@query
def populations(spark, d):
    return evaluation.populations(_scored(spark, d)).select("as_of", "population", "parcel_id")


@query
def eval_rank(spark, d):
    rows = evaluation.rank_rows(evaluation.populations(_scored(spark, d)), _tie())
    return rounded(evaluation.evaluate_ranks(rows))


@query
def eval_group(spark, d):
    return rounded(evaluation.evaluate_groups(evaluation.populations(_scored(spark, d))))


@query
def eval_matrix(spark, d):
    return rounded(evaluation.evaluate(_scored(spark, d), _tie()))


@query
def eval_verdict(spark, d):
    """The whole back-test from sales and snapshots to p-values and the Bonferroni verdict."""
    return rounded(backtest.run_backtest(A.history(spark, d), A.snapshots(spark, d), DATES, tie=_tie()))


@query
def component_diag(spark, d):
    return rounded(evaluation.component_diagnostic(evaluation.populations(_scored(spark, d))))


@query
def year_header(spark, d):
    return rounded(evaluation.year_header(_scored(spark, d)))


# -- reports and screen ------------------------------------------------------------------------


@query
def zip_summary(spark, d):
    return parcels.zip_summary(A.parcels(spark, d))


@query
def parcel_summary(spark, d):
    return rounded(parcels.parcel_summary(A.parcels(spark, d)))


@query
def id_stability(spark, d):
    return rounded(stability.ids_in_every_year(A.stability_rolls(spark, d)))


@query
def id_transitions(spark, d):
    return rounded(stability.id_transitions(A.stability_rolls(spark, d)))


# -- from zipped files: the same tables, written as zips, staged and built ----------------


def _job_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}"


@query
def sale_history_from_zips(spark, d):
    folder, labels = A.zipped(A.raw_sales_once(spark, d), "source_year", "{}F.zip")
    found = [int(label) for label in labels if label != "None"]
    years = range(min(found), max(found) + 1)
    built = history.build_history_table(spark, folder, years, _job_folder(spark, "zipped-history"))
    return built.select(*sales.HISTORY_COLUMNS)


@query
def snapshots_from_zips(spark, d):
    raw = A.raw_rolls(spark, d)
    folder, _ = A.zipped(raw, "vintage_year", "{}F.zip")
    years = range(A.VINTAGES[0], A.VINTAGES[1] + 1)
    built = history.build_snapshot_table(spark, folder, years, _job_folder(spark, "zipped-snapshots"))
    return built.select(*A.snapshots(spark, d).columns)


@query
def parcels_from_zips(spark, d):
    files = {county: (f"{county}.zip", "roll.csv") for county in ("North", "South")}
    unused = {c: F.lit(None).cast("string") for c in ("OWN_ADDR2", "PHY_ADDR2")}
    folder, _ = A.zipped(A.raw_county_roll(spark, d).withColumns(unused), "county", "{}.zip", "roll.csv")
    rows = rolls.staged(
        rolls.read_county_rolls(spark, folder, list(files), files), _job_folder(spark, "zipped-parcels"), "county"
    )
    built = parcels.build_parcels(rows, assessment_year=A.ASSESSMENT_YEAR)
    return rounded(built, 6, "equity_proxy_annualized_pct")


def _stability_job(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    folder, _ = A.zipped(A.stability_rolls(spark, d), "vintage_year", "{}F.zip")
    years = range(A.VINTAGES[0], A.VINTAGES[1] + 1)
    return history.build_stability_report(spark, folder, years, _job_folder(spark, "zipped-stability"))


@query
def id_stability_from_zips(spark, d):
    return rounded(_stability_job(spark, d)[0])


@query
def id_transitions_from_zips(spark, d):
    return rounded(_stability_job(spark, d)[1])


def _shown(view: DataFrame, limit: int | None = None) -> DataFrame:
    view = rounded(rounded(view, 6, "pct_spread", "ownership_tenure_years"), 2, "spread_estimate")
    return screen.display(view, limit)


@query
def screen_(spark, d):
    return _shown(screen.screen(A.parcels(spark, d), A.history(spark, d), A.snapshots(spark, d), A.SCREEN_DATE))


QUERIES["screen"] = QUERIES.pop("screen_")


@query
def screen_places(spark, d):
    """The order of the screen by dollars, as places."""
    scored = screen.score_screen(_screen_base(spark, d))
    return screen.screen_places(screen.filter_screen(scored), "spread_estimate").select("parcel_id", "rank")


@query
def screen_top_25(spark, d):
    """A limit below the number of rows in view: which rows, and in which order."""
    scored = screen.score_screen(_screen_base(spark, d))
    top = screen.rank_screen(screen.filter_screen(scored), "pct_spread", 25)
    return screen.screen_places(top, "pct_spread").select("parcel_id", "rank")


@query
def screen_top(spark, d):
    scored = screen.score_screen(_screen_base(spark, d))
    return _shown(screen.rank_screen(screen.filter_screen(scored), limit=500))


@query
def screen_absentee_by_dollars(spark, d):
    scored = screen.score_screen(_screen_base(spark, d))
    kept = screen.filter_screen(
        scored, min_spread=10_000, max_just_value=250_000, high_confidence=False, absentee_only=True
    )
    return _shown(screen.rank_screen(kept, "spread_estimate"))


@query
def screen_header(spark, d):
    return screen.screen_header(screen.score_screen(_screen_base(spark, d)))


@query
def parcel_record(spark, d):
    record = screen.parcel_record(screen.score_screen(_screen_base(spark, d)), "12")
    return record.select("parcel_id", "owner_name", "living_area", "year_built", "arv_estimate", "grade")


@query
def mao_grid(spark, d):
    valued = valuation.value_as_of(
        parcels.subjects_as_of(A.snapshots(spark, d), [A.SCREEN_DATE]), _events(spark, d), [A.SCREEN_DATE]
    )
    grid = scoring.offer_grid(valued, [0, 35_000])
    return rounded(grid.select("as_of", "parcel_id", "arv_estimate", "rule", "repair_cost", "max_offer"), 4, "max_offer")


# -- older single-roll engine ------------------------------------------------------------------


@query
def sale_slots(spark, d):
    events = flips.sale_events(A.parcels(spark, d))
    return rounded(
        events.select("parcel_id", "slot", "sale_price", "sale_date", "qual_cd", "price_per_sqft"), 6, "price_per_sqft"
    )


@query
def arv_single_roll(spark, d):
    return flips.value_single_roll(A.parcels(spark, d))


@query
def flip_funnel(spark, d):
    return flips.flip_funnel(A.parcels(spark, d))


@query
def flip_describe(spark, d):
    return rounded(flips.flip_describe(A.parcels(spark, d)))


@query
def flips_(spark, d):
    found = flips.find_flips(A.parcels(spark, d))
    return rounded(
        found.select("parcel_id", F.col("sale2_date").alias("acquired"), "holding_months", "price_delta_pct"),
        6,
        "price_delta_pct",
    )


QUERIES["flips"] = QUERIES.pop("flips_")


@query
def flip_backtest(spark, d):
    return _flip_results(spark, d)


@query
def flip_hits(spark, d):
    return flips.flip_hits(_flip_results(spark, d))


# -- leakage checks ---------------------------------------------------------------------------


@query
def accuracy_(spark, d):
    return rounded(leakage.accuracy_before_after(A.history(spark, d), A.snapshots(spark, d), DATES))


QUERIES["accuracy"] = QUERIES.pop("accuracy_")


@query
def leaky_vs_fixed(spark, d):
    return rounded(index.compare_index_levels(_events(spark, d), DATES))


@query
def guard_leaky_rows(spark, d):
    """What the guard catches in a pool that reaches a month past the date, per month."""
    date = DATES[-1]
    pool = _events(spark, d).filter(F.col("sale_date") <= F.add_months(F.lit(date), 1))
    return guard.late_rows(pool, date).groupBy("sale_date").agg(F.count("*").alias("n"))


@query
def guard_fires(spark, d):
    """Does a plan with the guard stop on a pool that reaches past the date, and only then?"""

    def fired(pool: DataFrame) -> bool:
        try:
            guard.guarded(pool.withColumn("as_of", F.lit(DATES[-1]))).agg(F.count("*")).collect()
        except PySparkException as stopped:
            if "look-ahead" in str(stopped):
                return True
            raise
        return False

    past = F.col("sale_date") < F.lit(DATES[-1])
    pools = {"all sales": _events(spark, d), "past sales": _events(spark, d).filter(past)}
    return spark.createDataFrame([(name, fired(pool)) for name, pool in pools.items()], "pool STRING, fired BOOLEAN")


@query
def seeded_sample(spark, d):
    """A reproducible sample of exactly 1000 subjects (or all, if fewer)."""
    sample = leakage.seeded_sample(parcels.subjects_as_of(A.snapshots(spark, d), DATES[:1]), 1000, draw=_tie())
    return sample.select("as_of", "parcel_id")


@query
def invariance(spark, d):
    return leakage.invariance(A.history(spark, d), A.snapshots(spark, d), DATES[-1])
