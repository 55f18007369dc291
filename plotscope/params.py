"""Fixed values of the domain and the tunable settings built on them."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values (public tax-roll code lists and documented defaults).
ARMS_LENGTH_CODES = ("01", "02")
CORE_USE_CODES = ("001",)
EXTRA_RESIDENTIAL_USE_CODES = ("004", "005", "008")
HOME_STATE_NAMES = ("FL", "FLORIDA")
ASSESSMENT_YEAR = 2025
LONG_TENURE_YEARS = 100
OFFER_RULE = 0.70
OFFER_RULES = (0.65, 0.70, 0.75)
MIN_DOLLAR_SPREAD = 25_000
DISCOUNT_THRESHOLD = 0.20
OUTCOME_WINDOW_MONTHS = 30
ACCURACY_WINDOW_MONTHS = 12
TIE_BREAK_SEED = 0
WINSOR_BAND = (0.05, 0.95)
MIN_RANK_ROWS = 50
MIN_GROUP_ROWS = 20
COARSE_DISPERSION = 0.35
COARSE_MIN_SALES = 30
DISPLAY_ROWS = 500
MOTIVATION_WEIGHTS = {"absentee_score": 40, "tenure_score": 30, "equity_proxy_score": 30}
COMPOSITE_WEIGHTS = {
    "absentee_score": 25,
    "tenure_score": 25,
    "equity_score": 25,
    "pct_spread_score": 25,
}
GRADE_FLOORS = (("A", 80), ("B", 65), ("C", 50), ("D", 35))
FLIP_MONTHS = (6, 18)
FLIP_MIN_GAIN_PCT = 10.0
TOP_DECILE_PCT = 90.0


@dataclass(frozen=True)
class ValuationSettings:
    """Comparable-sale rules; the defaults are those of the as-of valuation."""

    area_tolerance: float = 0.20
    year_tolerance: int = 15
    window_months: int = 36
    min_comps: int = 5
    iqr_multiplier: float = 1.5
    value_band: bool = True
    tercile_cuts: tuple[float, float] = (33.3 / 100, 66.7 / 100)
    min_band_pool: int = 15
    confidence_min_comps: int = 8
    confidence_max_dispersion_pct: float = 30.0
    # Points (comps alike in area, year, tercile and price) of a neighbourhood that one task
    # holds. Beyond, the price index: comps of a page, children of a node. Requests, or
    # rectangles with all their lookups, answered together.
    task_comps: int = 200_000
    page_comps: int = 512
    fan_out: int = 64
    max_block_lookups: int = 1_024


AS_OF_SETTINGS = ValuationSettings()
SINGLE_ROLL_SETTINGS = ValuationSettings(window_months=24, value_band=False)
