"""Building the stored tables from the zipped source files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from plotscope.operators.parcels import build_parcels, build_snapshots, duplicate_snapshots
from plotscope.operators.sales import sale_history
from plotscope.operators.stability import id_transitions, ids_in_every_year
from plotscope.params import ASSESSMENT_YEAR, CORE_USE_CODES
from plotscope.sources.rolls import STABILITY_COLUMNS, read_county_rolls, read_roll_vintages, read_sale_files, staged
from plotscope.sources.tables import read_table, write_csv, write_table


def build_history_table(
    spark: SparkSession, folder: str, years: Sequence[int], out: str, stage: str | None = None
) -> DataFrame:
    """Zipped sale files to the sale-history table, partitioned by sale year. The zips are
    parsed once, into the staged table ``stage`` (beside ``out`` if not named)."""
    rows = staged(read_sale_files(spark, folder, years), stage or f"{out}-staged", "source_year")
    write_table(sale_history(rows), out, ["sale_year"])
    return read_table(spark, out)


def build_snapshot_table(
    spark: SparkSession,
    folder: str,
    years: Sequence[int],
    out: str,
    use_codes: Sequence[str] = CORE_USE_CODES,
    stage: str | None = None,
) -> DataFrame:
    """Zipped yearly rolls to the snapshot table, partitioned by vintage; a parcel that
    occurs twice in a vintage is an error, because joins on it would fan out. Staged as in
    ``build_history_table``."""
    rows = staged(read_roll_vintages(spark, folder, years), stage or f"{out}-staged", "vintage_year")
    write_table(build_snapshots(rows, use_codes), out, ["vintage_year"])
    table = read_table(spark, out)
    doubles = duplicate_snapshots(table).limit(5).collect()
    if doubles:
        raise ValueError(f"duplicate parcel-vintage rows, for example {[r.parcel_id for r in doubles]}")
    return table


def build_parcel_file(
    spark: SparkSession,
    folder: str,
    counties: Sequence[str],
    out: str,
    include_extra: bool = False,
    assessment_year: int = ASSESSMENT_YEAR,
    skip_missing: bool = False,
    stage: str | None = None,
) -> DataFrame:
    """County rolls to the parcel table, written as CSV. See ``read_county_rolls`` for
    counties without a file. Staged as in ``build_history_table``."""
    rolls = staged(
        read_county_rolls(spark, folder, counties, skip_missing=skip_missing), stage or f"{out}-staged", "county"
    )
    parcels = build_parcels(rolls, include_extra, assessment_year)
    write_csv(parcels, out)
    return parcels


def build_stability_report(
    spark: SparkSession, folder: str, years: Sequence[int], out: str, stage: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Zipped yearly rolls to the two reports on parcel ids, as Parquet below ``out``: ids on
    every roll, and what became of the ids that disappear. Only the three columns that they
    need are parsed."""
    rolls = staged(read_roll_vintages(spark, folder, years, STABILITY_COLUMNS), stage or f"{out}-staged", "vintage_year")
    write_table(ids_in_every_year(rolls), f"{out}/ids")
    write_table(id_transitions(rolls), f"{out}/transitions")
    return read_table(spark, f"{out}/ids"), read_table(spark, f"{out}/transitions")
