"""The same questions as independent SQL on the driver's tables (DuckDB dialect).

Each check is composed from common table expressions; ``_query`` pulls in the ones a
final SELECT needs, in order. Quantiles are written out on sorted lists so that both
engines use one interpolation formula.
"""

from __future__ import annotations

import re

from plotscope.plans.leakage import VERSIONS
from plotscope.plans.screen import DISPLAY_NAMES

_DATES = "(VALUES (DATE '1999-01-01'), (DATE '2000-01-01')) t(as_of)"
_INDEX_DATES = "(VALUES (DATE '1999-01-01'), (DATE '1999-07-16'), (DATE '2000-01-01')) t(as_of)"


def _area20(year: str) -> str:
    return f"(40 + 2 * p_size + CASE WHEN p_partkey % 10 = 0 AND {year} >= 1998 THEN 20 ELSE 0 END)"


def _q(lst: str, p: float) -> str:
    """Linearly interpolated quantile of a sorted list."""
    pos = f"({p!r}::DOUBLE * (len({lst}) - 1))"
    low = f"{lst}[CAST(floor({pos}) AS BIGINT) + 1]"
    high = f"{lst}[least(CAST(floor({pos}) AS BIGINT) + 2, len({lst}))]"
    if p == 0.5:
        return f"(CASE WHEN len({lst}) % 2 = 1 THEN {low} ELSE ({low} + {high}) / 2 END)"
    t = f"({pos} - floor({pos}))"
    return f"(CASE WHEN {t} < 0.5 THEN {low} + ({high} - {low}) * {t} ELSE {high} - ({high} - {low}) * (1 - {t}) END)"


def _norm(c: str) -> str:
    text = f"trim(upper(coalesce({c}, '')))"
    return f"regexp_replace(regexp_replace({text}, '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')"


def _zip5(c: str) -> str:
    return f"lpad(substring(trim(coalesce({c}, '')), 1, 5), 5, '0')"


def _absentee(own: str, situs: str, mail_zip: str, situs_zip: str) -> str:
    return f"(({_norm(own)} <> {_norm(situs)} OR {mail_zip} <> {situs_zip}) AND {mail_zip} NOT IN ('00000', ''))"


_OWNER = """
    concat(p_partkey, ' ', p_name, ' St.') AS PHY_ADDR1, p_brand AS PHY_CITY,
    CASE WHEN p_partkey % 101 <> 0 THEN concat(' ', 33000 + p_partkey % 50, '-1234') END AS PHY_ZIPCD,
    CASE WHEN p_partkey % 4 = 2 THEN concat('PO Box ', p_partkey)
        ELSE upper(concat(' ', p_partkey, '  ', p_name, ' st ')) END AS OWN_ADDR1,
    p_brand AS OWN_CITY,
    CASE p_partkey % 11 WHEN 0 THEN 'NY' WHEN 1 THEN 'florida' WHEN 2 THEN NULL ELSE 'FL' END AS OWN_STATE,
    CASE WHEN p_partkey % 31 <> 0 THEN CAST(33000 + p_partkey % 50
        + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS OWN_ZIPCD,
    concat('Owner ', p_name, ' ', p_partkey) AS OWN_NAME"""


def _roll(year: str) -> str:
    return f"""
    CAST(p_partkey AS VARCHAR) AS PARCEL_ID, CASE WHEN p_partkey % 20 = 7 THEN '004' ELSE '001' END AS DOR_UC,
    CASE WHEN p_partkey % 83 <> 1 THEN p_type END AS NBRHD_CD,
    CASE WHEN p_partkey % 97 = 5 THEN 'n/a' ELSE CAST(20 * {_area20(year)} AS VARCHAR) END AS TOT_LVG_AREA,
    CASE WHEN p_partkey % 89 = 3 THEN '0' ELSE CAST(1950 + p_partkey % 60 AS VARCHAR) END AS ACT_YR_BLT,
    CAST({_area20(year)} * (60 + p_partkey % 50) * ({year} - 1975) AS VARCHAR) AS JV"""


_LATEST = (
    "source_year DESC, sale_year DESC NULLS LAST, sale_month DESC NULLS LAST, price DESC NULLS LAST,"
    " qual_code DESC NULLS LAST, vi_code DESC NULLS LAST, dor_use_code DESC NULLS LAST, multi DESC NULLS LAST"
)
_OLDEST = (
    "sale_date NULLS FIRST, source_year NULLS FIRST, recording_ref NULLS FIRST, price NULLS FIRST,"
    " qual_code NULLS FIRST"
)
_NEWEST = (
    "sale_date DESC NULLS LAST, source_year DESC NULLS LAST, recording_ref DESC NULLS LAST,"
    " price DESC NULLS LAST, qual_code DESC NULLS LAST"
)


def _trimmed(lst: str) -> str:
    q1, q3 = _q(lst, 0.25), _q(lst, 0.75)
    return (
        f"CASE WHEN len({lst}) = 0 OR {q3} - {q1} <= 0 THEN {lst} ELSE list_filter({lst}, lambda x:"
        f" x >= {q1} - 1.5 * ({q3} - {q1}) AND x <= {q3} + 1.5 * ({q3} - {q1})) END"
    )


def _dispersion(lst: str) -> str:
    m = _q(lst, 0.5)
    return f"(CASE WHEN len({lst}) < 2 OR {m} = 0 THEN 'Infinity'::DOUBLE ELSE ({_q(lst, 0.75)} - {_q(lst, 0.25)}) / {m} END)"




_CTES: dict[str, str] = {
    # -- adapters --------------------------------------------------------------
    "recorded": f"""
        SELECT *, floor({_area20("sale_year")} * 20 * (100 + (l_extendedprice / l_quantity) % 50) * (sale_year - 1975) / 20
            * CASE WHEN l_tax >= 0.075 THEN 2.5::DOUBLE WHEN l_tax < 0.015 THEN 0.7::DOUBLE ELSE 1::DOUBLE END + 0.5)::BIGINT
            AS rec_price
        FROM (SELECT *, CASE WHEN p_partkey % 7 = 3 THEN 2000 + year(o_orderdate) % 2
                WHEN p_partkey % 3 = 1 THEN 1995 + year(o_orderdate) % 2 ELSE year(o_orderdate) END AS sale_year,
                month(o_orderdate) AS sale_month
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "raw_sales": """
        SELECT CAST(p_partkey AS VARCHAR) AS PARCEL_ID, CASE WHEN p_partkey % 20 = 7 THEN '004' ELSE '001' END AS DOR_UC,
            CASE WHEN l_linestatus = 'F' THEN 'I' ELSE 'V' END AS VI_CD,
            CASE WHEN l_linenumber <> 7 THEN CAST(l_orderkey AS VARCHAR) END AS OR_BOOK,
            CASE WHEN l_linenumber <> 7 THEN CAST(l_linenumber AS VARCHAR) END AS OR_PAGE,
            CASE WHEN l_linenumber = 7 AND l_suppkey % 3 <> 0 THEN CAST(l_orderkey AS VARCHAR) END AS CLERK_NO,
            CASE l_returnflag WHEN 'A' THEN '11' WHEN 'N' THEN '01' ELSE '02' END AS QUAL_CD,
            CAST(sale_year AS VARCHAR) AS SALE_YR,
            CAST(CASE WHEN l_suppkey % 97 = 96 THEN 13 ELSE sale_month END AS VARCHAR) AS SALE_MO,
            CASE WHEN l_suppkey % 89 = 88 THEN 'n/a' ELSE CAST(rec_price + extra AS VARCHAR) END AS SALE_PRC,
            CASE WHEN l_discount >= 0.095 THEN 'M' END AS MULTI_PAR_SAL,
            CAST(sale_year + 1 - back AS INTEGER) AS source_year
        FROM (SELECT *, 0 AS back, 0 AS extra FROM recorded
            UNION ALL SELECT *, 1, 0 FROM recorded WHERE l_suppkey % 4 = 0
            UNION ALL SELECT *, 1, 1000 FROM recorded WHERE l_suppkey % 10 = 1)""",
    "years": "SELECT CAST(unnest(range(1996, 2002)) AS INTEGER) AS vintage_year",
    "raw_rolls": f"SELECT {_roll('vintage_year')}, {_OWNER}, vintage_year FROM part, years",
    "stability": """
        SELECT CASE WHEN p_partkey % 13 = 0 AND vintage_year >= 1999 THEN concat('R', p_partkey)
                ELSE CAST(p_partkey AS VARCHAR) END AS PARCEL_ID,
            concat('Owner ', p_name, ' ', p_partkey) AS OWN_NAME, concat(p_partkey, ' ', p_name, ' St.') AS PHY_ADDR1,
            vintage_year
        FROM part, years WHERE NOT (p_partkey % 13 = 0 AND vintage_year >= 1999) OR p_partkey % 26 = 0""",
    "slots": """
        SELECT p_partkey, sale_year, sale_month, rec_price,
            CASE l_returnflag WHEN 'A' THEN '11' WHEN 'N' THEN '01' ELSE '02' END AS qual,
            row_number() OVER (PARTITION BY p_partkey ORDER BY sale_year DESC, sale_month DESC, l_orderkey DESC,
                l_linenumber DESC, rec_price DESC, l_suppkey DESC) AS slot
        FROM recorded QUALIFY slot <= 2""",
    "raw_roll": f"""
        SELECT {_roll("2001")}, CAST({_area20("2001")} * (60 + p_partkey % 50) * 5 AS VARCHAR) AS LND_VAL, {_OWNER},
            a.qual AS QUAL_CD1, CAST(a.rec_price AS VARCHAR) AS SALE_PRC1, CAST(a.sale_year AS VARCHAR) AS SALE_YR1,
            CAST(a.sale_month AS VARCHAR) AS SALE_MO1, b.qual AS QUAL_CD2, CAST(b.rec_price AS VARCHAR) AS SALE_PRC2,
            CAST(b.sale_year AS VARCHAR) AS SALE_YR2, CAST(b.sale_month AS VARCHAR) AS SALE_MO2,
            CASE WHEN part.p_partkey % 3 = 0 THEN 'North' ELSE 'South' END AS county
        FROM part LEFT JOIN (SELECT p_partkey AS k, * EXCLUDE (p_partkey) FROM slots WHERE slot = 1) a ON a.k = part.p_partkey
            LEFT JOIN (SELECT p_partkey AS k, * EXCLUDE (p_partkey) FROM slots WHERE slot = 2) b ON b.k = part.p_partkey""",
    # -- history and snapshots ---------------------------------------------------
    "typed": """
        SELECT PARCEL_ID AS parcel_id, TRY_CAST(SALE_YR AS INTEGER) AS sale_year, TRY_CAST(SALE_MO AS INTEGER) AS sale_month,
            TRY_CAST(SALE_PRC AS DOUBLE) AS price,
            CASE WHEN OR_BOOK IS NOT NULL THEN OR_BOOK || '-' || coalesce(OR_PAGE, '')
                WHEN CLERK_NO IS NOT NULL THEN 'CLERK:' || CLERK_NO END AS recording_ref,
            QUAL_CD AS qual_code, VI_CD AS vi_code, DOR_UC AS dor_use_code, MULTI_PAR_SAL AS multi, source_year
        FROM raw_sales""",
    "exact": f"""
        SELECT * FROM typed QUALIFY row_number() OVER (
            PARTITION BY parcel_id, sale_year, sale_month, price, recording_ref ORDER BY {_LATEST}) = 1""",
    "resolved": f"""
        SELECT * FROM exact WHERE recording_ref IS NULL
        UNION ALL
        SELECT * FROM (SELECT * FROM exact WHERE recording_ref IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY parcel_id, recording_ref ORDER BY {_LATEST}) = 1)""",
    "hist": """
        SELECT parcel_id, sale_year, sale_month, price, recording_ref, qual_code,
            coalesce(qual_code IN ('01', '02'), false) AS qualified, multi IS NOT NULL AS multi_parcel_sale,
            coalesce(qual_code IN ('01', '02'), false) AND multi IS NULL AS comp_eligible, vi_code, dor_use_code,
            CASE WHEN sale_month BETWEEN 1 AND 12 THEN make_date(sale_year, sale_month, 1) END AS sale_date, source_year
        FROM resolved""",
    "snaps": """
        SELECT PARCEL_ID AS parcel_id, DOR_UC AS dor_use_code, NBRHD_CD AS nbrhd_cd,
            TRY_CAST(TOT_LVG_AREA AS DOUBLE) AS living_area, TRY_CAST(ACT_YR_BLT AS DOUBLE) AS year_built,
            TRY_CAST(JV AS DOUBLE) AS just_value, PHY_ADDR1 AS situs_addr1, PHY_CITY AS situs_city, PHY_ZIPCD AS situs_zip,
            OWN_ADDR1 AS own_addr1, OWN_CITY AS own_city, OWN_STATE AS own_state, OWN_ZIPCD AS own_zip, vintage_year
        FROM raw_rolls WHERE DOR_UC = '001'""",
    "parcels0": f"""
        SELECT PARCEL_ID AS parcel_id, county, DOR_UC AS dor_use_code, NBRHD_CD AS nbrhd_cd, PHY_ADDR1 AS situs_addr1,
            PHY_CITY AS situs_city, {_zip5("PHY_ZIPCD")} AS situs_zip, OWN_NAME AS owner_name, OWN_ADDR1 AS own_addr1,
            OWN_CITY AS own_city, OWN_STATE AS own_state, {_zip5("OWN_ZIPCD")} AS mail_zip,
            TRY_CAST(TOT_LVG_AREA AS DOUBLE) AS living_area, TRY_CAST(ACT_YR_BLT AS DOUBLE) AS year_built,
            TRY_CAST(LND_VAL AS DOUBLE) AS land_value, TRY_CAST(JV AS DOUBLE) AS just_value,
            TRY_CAST(SALE_PRC1 AS DOUBLE) AS sale1_price, TRY_CAST(SALE_YR1 AS DOUBLE) AS sale1_year,
            SALE_MO1 AS sale1_month, QUAL_CD1 AS sale1_qual_cd, TRY_CAST(SALE_PRC2 AS DOUBLE) AS sale2_price,
            TRY_CAST(SALE_YR2 AS DOUBLE) AS sale2_year, SALE_MO2 AS sale2_month, QUAL_CD2 AS sale2_qual_cd
        FROM raw_roll WHERE DOR_UC = '001'""",
    "parcels1": f"""
        SELECT *, {_absentee("own_addr1", "situs_addr1", "mail_zip", "situs_zip")} AS absentee,
            upper(trim(coalesce(own_state, ''))) NOT IN ('FL', 'FLORIDA', '') AS out_of_state,
            greatest(least(coalesce(2002 - sale1_year, 100), 100), 0)::DOUBLE AS ownership_tenure_years
        FROM parcels0 WHERE living_area > 0 AND year_built > 0 AND situs_zip <> '00000'""",
    "parcels": """
        SELECT *, CASE WHEN sale1_qual_cd IN ('01', '02') AND sale1_price > 0 THEN just_value - sale1_price END AS equity_proxy,
            CASE WHEN sale1_qual_cd IN ('01', '02') AND sale1_price > 0 AND ownership_tenure_years > 0
                THEN (just_value / sale1_price - 1) / ownership_tenure_years * 100 END AS equity_proxy_annualized_pct
        FROM parcels1""",
    # -- index ---------------------------------------------------------------------
    "events": """
        SELECT h.*, s.nbrhd_cd, s.living_area, s.year_built, s.just_value, h.price / s.living_area AS price_per_sqft
        FROM hist h JOIN snaps s ON s.parcel_id = h.parcel_id AND s.vintage_year = h.sale_year
        WHERE h.comp_eligible AND h.dor_use_code = '001' AND h.price IS NOT NULL AND s.living_area > 0""",
    "dates": f"SELECT * FROM {_DATES}",
    "screen_dates": "SELECT DATE '2002-01-01' AS as_of",
    "index_dates": f"SELECT * FROM {_INDEX_DATES}",
    "anchors": f"""
        SELECT as_of, CASE WHEN sale_year < year(as_of) THEN make_date(sale_year, 7, 1) ELSE CAST(as_of - 1 AS DATE) END AS anchor_date,
            {_q("l", 0.5)} AS level
        FROM (SELECT as_of, sale_year, list(price_per_sqft ORDER BY price_per_sqft) AS l
            FROM events JOIN (SELECT * FROM dates UNION SELECT * FROM index_dates UNION SELECT * FROM screen_dates)
                ON sale_date < as_of GROUP BY as_of, sale_year)""",
    "leaky_anchors": f"""
        SELECT as_of, make_date(sale_year, 7, 1) AS anchor_date, {_q("l", 0.5)} AS level
        FROM (SELECT sale_year, list(price_per_sqft ORDER BY price_per_sqft) AS l FROM events GROUP BY sale_year), dates""",
}


def _levels(name: str, anchors: str, points: str) -> None:
    """Adds a CTE with the level at each (as_of, d) of ``points``."""
    _CTES[name] = f"""
        SELECT as_of, d, CASE WHEN a IS NULL THEN lb WHEN b IS NULL THEN la
            ELSE la + (lb - la) * ((d - a)::DOUBLE / (b - a)::DOUBLE) END AS level
        FROM (SELECT p.as_of, p.d, max(anchor_date) FILTER (anchor_date <= d) AS a,
                arg_max(level, anchor_date) FILTER (anchor_date <= d) AS la,
                min(anchor_date) FILTER (anchor_date > d) AS b, arg_min(level, anchor_date) FILTER (anchor_date > d) AS lb
            FROM ({points}) p JOIN {anchors} x ON x.as_of = p.as_of GROUP BY p.as_of, p.d)"""


def _valuation(prefix: str, dates: str, anchors: str, months: int = 36) -> None:
    """Adds the CTEs of an as-of valuation: ``<prefix>_pool``, ``_lists``, ``_valued``."""
    window = f"sale_date < as_of AND sale_date >= as_of - INTERVAL {months} MONTH"
    _levels(
        f"{prefix}_levels",
        anchors,
        f"SELECT DISTINCT as_of, sale_date AS d FROM events JOIN {dates} ON {window} UNION SELECT as_of, as_of FROM {dates}",
    )
    _CTES[f"{prefix}_pool"] = f"""
        SELECT e.*, x.as_of, e.price_per_sqft * (n.level / t.level) AS psf
        FROM events e JOIN {dates} x ON {window}
            JOIN {prefix}_levels t ON t.as_of = x.as_of AND t.d = e.sale_date
            JOIN {prefix}_levels n ON n.as_of = x.as_of AND n.d = x.as_of"""
    _CTES[f"{prefix}_subjects"] = f"""
        SELECT x.as_of, s.* FROM snaps s JOIN {dates} x ON s.vintage_year = year(x.as_of) - 1
        WHERE s.living_area > 0 AND s.year_built > 0"""
    _CTES[f"{prefix}_cuts"] = f"""
        SELECT as_of, nbrhd_cd, pool_size, {_q("l", 33.3 / 100)} AS c1, {_q("l", 66.7 / 100)} AS c2
        FROM (SELECT as_of, nbrhd_cd, count(*) AS pool_size, list(just_value ORDER BY just_value) FILTER (just_value IS NOT NULL) AS l
            FROM {prefix}_pool WHERE nbrhd_cd IS NOT NULL GROUP BY as_of, nbrhd_cd)"""
    tercile = lambda v: f"coalesce(({v} >= c1)::INTEGER + ({v} >= c2)::INTEGER, 2)"
    _CTES[f"{prefix}_lists"] = f"""
        SELECT s.as_of, s.parcel_id, list(c.psf ORDER BY c.psf) AS l,
            coalesce(list(c.psf ORDER BY c.psf) FILTER (pool_size >= 15 AND {tercile("c.just_value")} = {tercile("s.just_value")}), []) AS b
        FROM {prefix}_subjects s JOIN {prefix}_cuts k ON k.as_of = s.as_of AND k.nbrhd_cd = s.nbrhd_cd
            JOIN {prefix}_pool c ON c.as_of = s.as_of AND c.nbrhd_cd = s.nbrhd_cd AND c.parcel_id <> s.parcel_id
                AND c.living_area BETWEEN s.living_area * 0.8 AND s.living_area * 1.2
                AND c.year_built BETWEEN s.year_built - 15 AND s.year_built + 15
        GROUP BY s.as_of, s.parcel_id"""
    _estimates(prefix, banded=True)


def _estimates(prefix: str, banded: bool) -> None:
    band = f"len(b) >= 5 AND {_dispersion('b')} < {_dispersion('l')}" if banded else "false"
    _CTES[f"{prefix}_trimmed"] = f"SELECT as_of, parcel_id, {_trimmed('l')} AS l, {_trimmed('b')} AS b FROM {prefix}_lists"
    _CTES[f"{prefix}_chosen"] = f"""
        SELECT as_of, parcel_id, {band} AS banded, CASE WHEN {band} THEN b ELSE l END AS v FROM {prefix}_trimmed"""
    m = _q("v", 0.5)
    _CTES[f"{prefix}_valued"] = f"""
        SELECT *, coalesce(arv_estimate IS NOT NULL AND arv_comp_count >= 8 AND arv_dispersion_pct <= 30.0, false) AS high_confidence
        FROM (SELECT s.*, CASE WHEN len(v) >= 5 THEN round_even({m} * s.living_area, 0) END AS arv_estimate,
                coalesce(len(v), 0)::INTEGER AS arv_comp_count,
                CASE WHEN len(v) >= 5 AND {m} <> 0 THEN round_even(({_q("v", 0.75)} - {_q("v", 0.25)}) / {m} * 100 * 10, 0) / 10 END
                    AS arv_dispersion_pct,
                coalesce(banded AND len(v) >= 5, false) AS used_value_band
            FROM {prefix}_subjects s LEFT JOIN {prefix}_chosen c ON c.as_of = s.as_of AND c.parcel_id = s.parcel_id)"""
    _CTES[f"{prefix}_spread"] = f"""
        SELECT *, spread_estimate / arv_estimate AS pct_spread
        FROM (SELECT *, arv_estimate * 0.7::DOUBLE - just_value AS spread_estimate FROM {prefix}_valued)"""


_valuation("v", "dates", "anchors")
_valuation("k", "dates", "leaky_anchors")
_valuation("w", "screen_dates", "anchors")
_levels("point_levels", "anchors", "SELECT as_of, d FROM index_dates, (SELECT DISTINCT sale_date AS d FROM hist WHERE sale_date IS NOT NULL)")
_levels("fixed_at", "anchors", "SELECT as_of, as_of AS d FROM dates")
_levels("leaky_at", "leaky_anchors", "SELECT as_of, as_of AS d FROM dates")

# -- signals, scores, outcomes ---------------------------------------------------
_CTES |= {
    "last_sales": f"""
        SELECT as_of, parcel_id, max(sale_date) AS last_sale_date,
            first(price ORDER BY {_NEWEST}) FILTER (qualified AND price IS NOT NULL) AS last_qual_price
        FROM hist JOIN dates ON sale_date < as_of GROUP BY as_of, parcel_id""",
    "signals": f"""
        SELECT v.*, {_absentee("own_addr1", "situs_addr1", _zip5("own_zip"), _zip5("situs_zip"))} AS absentee,
            last_sale_date IS NULL AS no_sale_on_record,
            greatest(least(coalesce((v.as_of - last_sale_date) / 365.25::DOUBLE, 100), 100), 0) AS ownership_tenure_years,
            last_qual_price, just_value - last_qual_price AS equity_proxy
        FROM v_spread v LEFT JOIN last_sales l ON l.as_of = v.as_of AND l.parcel_id = v.parcel_id""",
    "score_range": f"""
        SELECT *, {_q("e", 0.05)} AS e0, {_q("e", 0.95)} AS e1
        FROM (SELECT as_of, min(ownership_tenure_years) AS t0, max(ownership_tenure_years) AS t1, min(pct_spread) AS s0,
                max(pct_spread) AS s1, list(equity_proxy ORDER BY equity_proxy) FILTER (equity_proxy IS NOT NULL) AS e
            FROM signals GROUP BY as_of)""",
    "minmax": """
        SELECT s.*, absentee::INTEGER * 100::DOUBLE AS absentee_score,
            CASE WHEN t1 > t0 THEN (ownership_tenure_years - t0) / (t1 - t0) * 100 END AS tenure_score,
            CASE WHEN e1 > e0 AND equity_proxy IS NOT NULL THEN (least(greatest(equity_proxy, e0), e1) - e0) / (e1 - e0) * 100 END
                AS equity_score,
            CASE WHEN s1 > s0 THEN (pct_spread - s0) / (s1 - s0) * 100 END AS pct_spread_score
        FROM signals s JOIN score_range r ON r.as_of = s.as_of""",
    "first_ce": f"""
        SELECT as_of, parcel_id, price AS ce_price FROM hist
            JOIN dates ON sale_date >= as_of AND sale_date < as_of + INTERVAL 30 MONTH
        WHERE dor_use_code = '001' AND comp_eligible
        QUALIFY row_number() OVER (PARTITION BY as_of, parcel_id ORDER BY {_OLDEST}) = 1""",
    "first_q": f"""
        SELECT as_of, parcel_id, price AS q_price, sale_year AS q_sale_year FROM hist
            JOIN dates ON sale_date >= as_of AND sale_date < as_of + INTERVAL 30 MONTH
        WHERE dor_use_code = '001' AND qualified
        QUALIFY row_number() OVER (PARTITION BY as_of, parcel_id ORDER BY {_OLDEST}) = 1""",
    "outcomes": """
        SELECT c.*, ce_price, q_price, q_sale_year, p.just_value AS jv_prior, ce_price IS NOT NULL AS sold_ce,
            (arv_estimate - ce_price) / arv_estimate AS discount_pct,
            coalesce((arv_estimate - ce_price) / arv_estimate >= 0.2::DOUBLE, false) AS discounted,
            q_price IS NOT NULL AS sold_q, q_price IS NOT NULL AND p.just_value IS NOT NULL AS has_jv_prior,
            coalesce(q_price < p.just_value, false) AS below_jv
        FROM composite c LEFT JOIN first_ce e ON e.as_of = c.as_of AND e.parcel_id = c.parcel_id
            LEFT JOIN first_q q ON q.as_of = c.as_of AND q.parcel_id = c.parcel_id
            LEFT JOIN snaps p ON p.parcel_id = c.parcel_id AND p.vintage_year = q.q_sale_year - 1""",
    "pops": """
        SELECT 'default' AS population, * FROM outcomes WHERE high_confidence AND spread_estimate >= 25000
        UNION ALL SELECT 'ungated', * FROM outcomes WHERE arv_estimate IS NOT NULL""",
    "cases": """
        SELECT *, 'discount' AS outcome, discounted::INTEGER AS hit FROM pops WHERE sold_ce
        UNION ALL SELECT *, 'A_any_sale', sold_q::INTEGER FROM pops
        UNION ALL SELECT *, 'B_below_jv', below_jv::INTEGER FROM pops WHERE has_jv_prior""",
    "rank_cases": """
        SELECT as_of, population, outcome, signal, hit, value,
            row_number() OVER (PARTITION BY as_of, population, outcome, signal
                ORDER BY value DESC, (pid * 7919) % 10007, pid) AS place,
            count(*) OVER (PARTITION BY as_of, population, outcome, signal) AS n
        FROM (SELECT *, parcel_id::BIGINT AS pid, 'composite' AS signal, composite_score AS value FROM cases
            UNION ALL SELECT *, parcel_id::BIGINT, 'pct_spread', pct_spread FROM cases
            UNION ALL SELECT *, parcel_id::BIGINT, 'equity_proxy', equity_proxy FROM cases
            UNION ALL SELECT *, parcel_id::BIGINT, 'tenure: years, among parcels with a sale on record',
                ownership_tenure_years FROM cases WHERE NOT no_sale_on_record)
        WHERE value IS NOT NULL""",
    "rank_counts": """
        SELECT as_of, population, outcome, signal, 'top10 vs bottom50' AS method, n, sum(hit) AS hits,
            count(*) FILTER (place <= n // 10) AS hi_n, coalesce(sum(hit) FILTER (place <= n // 10), 0) AS hi_hits,
            count(*) FILTER (place > n - n // 2) AS lo_n, coalesce(sum(hit) FILTER (place > n - n // 2), 0) AS lo_hits,
            count(*) FILTER (value = edge) / n AS boundary_tie_share
        FROM (SELECT *, max(CASE WHEN place = n // 10 THEN value END)
                OVER (PARTITION BY as_of, population, outcome, signal) AS edge FROM rank_cases WHERE n >= 50)
        GROUP BY as_of, population, outcome, signal, n""",
    "group_counts": """
        SELECT as_of, population, outcome, signal, method, count(*) AS n, sum(hit) AS hits, count(*) FILTER (flag) AS hi_n,
            coalesce(sum(hit) FILTER (flag), 0) AS hi_hits, count(*) FILTER (NOT flag) AS lo_n,
            coalesce(sum(hit) FILTER (NOT flag), 0) AS lo_hits, NULL::DOUBLE AS boundary_tie_share
        FROM (SELECT *, 'absentee' AS signal, 'absentee vs not' AS method, absentee AS flag FROM cases
            UNION ALL SELECT *, 'tenure: no sale on record', 'no_sale_on_record vs not', no_sale_on_record FROM cases)
        GROUP BY as_of, population, outcome, signal, method
        HAVING count(*) FILTER (flag) >= 20 AND count(*) FILTER (NOT flag) >= 20""",
    "errors": f"""
        SELECT as_of, version, high_confidence, abs(arv_estimate - price) / price AS error
        FROM (SELECT '{VERSIONS["asof"]}' AS version, as_of, parcel_id, arv_estimate, high_confidence FROM v_valued
            UNION ALL SELECT '{VERSIONS["leaky"]}', as_of, parcel_id, arv_estimate, high_confidence FROM k_valued) v
        JOIN (SELECT as_of, parcel_id, price FROM hist
                JOIN dates ON sale_date >= as_of AND sale_date < as_of + INTERVAL 12 MONTH
            WHERE dor_use_code = '001' AND comp_eligible
            QUALIFY row_number() OVER (PARTITION BY as_of, parcel_id ORDER BY {_OLDEST}) = 1) s USING (as_of, parcel_id)
        WHERE arv_estimate IS NOT NULL""",
    "error_bands": """
        SELECT as_of, version, 'overall' AS band, error FROM errors
        UNION ALL SELECT as_of, version, CASE WHEN high_confidence THEN 'high_conf' ELSE 'low_conf' END, error FROM errors""",
}


def _mean(weights: dict[str, int]) -> str:
    total = " + ".join(f"coalesce({c} * {w}::DOUBLE, 0)" for c, w in weights.items())
    weight = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for c, w in weights.items())
    return f"(CASE WHEN {weight} > 0 THEN ({total}) / ({weight})::DOUBLE END)"


_QUARTERS = {"absentee_score": 25, "tenure_score": 25, "equity_score": 25, "pct_spread_score": 25}
_MOTIVES = {"absentee_score": 40, "tenure_score": 30, "equity_proxy_score": 30}
_CTES["composite"] = f"SELECT *, {_mean(_QUARTERS)} AS composite_score FROM minmax"


def _pct_rank(c: str, by: str) -> str:
    w = f"PARTITION BY {by}, {c} IS NULL"
    return (
        f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER ({w} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE)"
        f" / count(*) OVER ({w}) * 100 END"
    )


_CTES["by_rank"] = f"""
    SELECT *, absentee::INTEGER * 100::DOUBLE AS absentee_score, {_pct_rank("ownership_tenure_years", "as_of")} AS tenure_score,
        {_pct_rank("equity_proxy", "as_of")} AS equity_score, {_pct_rank("pct_spread", "as_of")} AS pct_spread_score
    FROM signals"""


def _motivation(source: str) -> str:
    return f"""
        SELECT *, {_mean(_MOTIVES)} AS motivation_score FROM (
            SELECT p.*, absentee::INTEGER * 100::DOUBLE AS absentee_score,
                CASE WHEN t1 > t0 THEN (ownership_tenure_years - t0) / (t1 - t0) * 100 END AS tenure_score,
                CASE WHEN e1 > e0 AND equity_proxy IS NOT NULL
                    THEN (least(greatest(equity_proxy, e0), e1) - e0) / (e1 - e0) * 100 END AS equity_proxy_score
            FROM {source} p, (SELECT *, {_q("e", 0.05)} AS e0, {_q("e", 0.95)} AS e1
                FROM (SELECT min(ownership_tenure_years) AS t0, max(ownership_tenure_years) AS t1,
                    list(equity_proxy ORDER BY equity_proxy) FILTER (equity_proxy IS NOT NULL) AS e FROM {source})))"""


_GRADE = (
    "CASE WHEN motivation_score IS NULL THEN 'N/A' WHEN motivation_score >= 80 THEN 'A' WHEN motivation_score >= 65 THEN 'B'"
    " WHEN motivation_score >= 50 THEN 'C' WHEN motivation_score >= 35 THEN 'D' ELSE 'F' END"
)
_CTES |= {
    "motivated": _motivation("parcels"),
    "screen_base": """
        SELECT p.* EXCLUDE (just_value), w.as_of, w.just_value, w.arv_estimate, w.arv_comp_count, w.arv_dispersion_pct,
            w.high_confidence, w.spread_estimate, w.pct_spread
        FROM parcels p JOIN w_spread w ON w.parcel_id = p.parcel_id""",
    "screen_scored0": _motivation("screen_base"),
    "screen_scored": f"SELECT *, {_GRADE} AS grade FROM screen_scored0",
    # -- older single-roll valuation and flips ------------------------------------
    "sale_events": """
        SELECT *, sale_price / living_area AS price_per_sqft
        FROM (SELECT parcel_id, nbrhd_cd, living_area, year_built, 1 AS slot, sale1_price AS sale_price, sale1_qual_cd AS qual_cd,
                make_date(sale1_year::INTEGER, sale1_month::INTEGER, 1) AS sale_date FROM parcels
            UNION ALL SELECT parcel_id, nbrhd_cd, living_area, year_built, 2, sale2_price, sale2_qual_cd,
                make_date(sale2_year::INTEGER, sale2_month::INTEGER, 1) FROM parcels)
        WHERE qual_cd IN ('01', '02') AND sale_price > 0 AND sale_date IS NOT NULL""",
    "two_sales": """
        SELECT *, (sale1_price / sale2_price - 1) * 100 AS price_delta_pct,
            ((sale1_year - sale2_year) * 12 + sale1_month::INTEGER - sale2_month::INTEGER)::INTEGER AS holding_months,
            make_date(sale2_year::INTEGER, sale2_month::INTEGER, 1) AS acquired
        FROM parcels WHERE sale1_qual_cd IN ('01', '02') AND sale2_qual_cd IN ('01', '02') AND sale1_price > 0 AND sale2_price > 0""",
    "flips": "SELECT * FROM two_sales WHERE holding_months BETWEEN 6 AND 18 AND price_delta_pct >= 10",
    "roll_dates": "SELECT CAST(max(sale_date) + INTERVAL 1 MONTH AS DATE) AS as_of FROM sale_events",
    "flip_dates": "SELECT DISTINCT acquired AS as_of FROM flips",
}


def _single_roll(prefix: str, dates: str, built_by: str) -> None:
    _CTES[f"{prefix}_subjects"] = f"SELECT as_of, p.* FROM parcels p JOIN {dates} ON {built_by}"
    _CTES[f"{prefix}_lists"] = f"""
        SELECT s.as_of, s.parcel_id, list(c.price_per_sqft ORDER BY c.price_per_sqft) AS l, []::DOUBLE[] AS b
        FROM {prefix}_subjects s JOIN sale_events c ON c.nbrhd_cd = s.nbrhd_cd AND c.parcel_id <> s.parcel_id
            AND c.sale_date < s.as_of AND c.sale_date >= s.as_of - INTERVAL 24 MONTH
            AND c.living_area BETWEEN s.living_area * 0.8 AND s.living_area * 1.2
            AND c.year_built BETWEEN s.year_built - 15 AND s.year_built + 15 AND {built_by.replace("p.", "c.")}
        GROUP BY s.as_of, s.parcel_id"""
    _estimates(prefix, banded=False)


_single_roll("r", "roll_dates", "true")
_single_roll("f", "flip_dates", "p.year_built <= year(as_of)")
_CTES["f_ranked"] = f"""
    SELECT *, {_pct_rank("spread_estimate", "as_of")} AS percentile FROM f_spread WHERE spread_estimate IS NOT NULL"""
_CTES["flip_results"] = """
    SELECT f.parcel_id, f.acquired AS as_of, round_even(percentile * 10, 0) / 10 AS percentile,
        coalesce(percentile >= 90, false) AS in_top_decile,
        CASE WHEN percentile IS NULL THEN 'no ARV / not in ranked pool at as_of' ELSE '' END AS reason,
        CASE WHEN percentile IS NOT NULL THEN f.holding_months END AS holding_months,
        CASE WHEN percentile IS NOT NULL THEN round_even(f.price_delta_pct * 10, 0) / 10 END AS price_delta_pct
    FROM flips f LEFT JOIN f_ranked r ON r.as_of = f.acquired AND r.parcel_id = f.parcel_id"""


def _plain_rounding(sql: str) -> str:
    """``round(x, d)`` written out as floor arithmetic, to give the same bits everywhere."""
    while (at := re.search(r"\bround\(", sql)) is not None:
        depth, split, i = 1, -1, at.end()
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                split = i
            i += 1
        unit = f"1e{int(sql[split + 1 : i - 1])}"
        sql = f"{sql[: at.start()]}(floor(({sql[at.end() : split]})::DOUBLE * {unit} + 0.5) / {unit}){sql[i:]}"
    return sql


def _query(final: str) -> str:
    """``final`` with the common table expressions it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in _CTES and word not in needed and word not in visiting:
                visiting.append(word)
                visit(_CTES[word])
                needed.append(word)

    visiting: list[str] = []
    visit(final)
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({_CTES[name]})" for name in needed)
    return _plain_rounding(f"WITH {ctes}\n{final}" if ctes else final)


def _r(expression: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({expression}, {digits}) AS {name or expression.split('.')[-1]}"


_Z = """CASE WHEN hi_n > 0 AND lo_n > 0 AND (hi_hits + lo_hits) > 0 AND (hi_hits + lo_hits) < (hi_n + lo_n)
    THEN (hi_hits / hi_n - lo_hits / lo_n) / sqrt((hi_hits + lo_hits) / (hi_n + lo_n)
        * (1 - (hi_hits + lo_hits) / (hi_n + lo_n)) * (1 / hi_n + 1 / lo_n)) END"""


# Two-sided p of |z| = x * sqrt(2): the series of the error function up to 3, its continued fraction beyond.
_P = """CASE WHEN x <= 3 THEN 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(81), lambda k:
        pow(2::DOUBLE, k) * pow(x, 2 * k + 1) / coalesce(list_product(list_transform(range(1, k + 1), lambda j: 2.0::DOUBLE * j + 1)), 1)))
    ELSE exp(-x * x) / (x * sqrt(pi())) / list_reduce(list_concat([1::DOUBLE], list_transform(range(80), lambda i: (80 - i)::DOUBLE)),
        lambda t, k: 1 + k / (2 * x * x) / t) END"""


def _verdict(source: str) -> str:
    return f"""
        SELECT * EXCLUDE (x, p), round(p, 6) AS p, coalesce(p < 0.05::DOUBLE / comparisons, false) AS significant
        FROM (SELECT *, {_P} AS p, count(*) OVER () AS comparisons FROM ({_evaluated(source, f", abs({_Z}) / sqrt(2) AS x")}))"""


def _evaluated(source: str, more: str = "") -> str:
    return f"""
        SELECT as_of, population, outcome, signal, method, n, round(hits / n, 6) AS base_rate,
            round(hi_hits / hi_n, 6) AS hi_rate, hi_n, round(lo_hits / lo_n, 6) AS lo_rate, lo_n,
            CASE WHEN hits > 0 THEN round((hi_hits / hi_n) / (hits / n), 6) END AS lift, round({_Z}, 6) AS z,
            round(boundary_tie_share, 6) AS boundary_tie_share{more}
        FROM {source}"""


_VALUED = (
    "as_of, parcel_id, arv_estimate, arv_comp_count, arv_dispersion_pct, used_value_band, high_confidence"
)
_SCORES = ", ".join(
    _r(c) for c in ("absentee_score", "tenure_score", "equity_score", "pct_spread_score", "composite_score")
)
_DISPLAY_ROUNDED = {"pct_spread": 6, "spread_estimate": 2, "ownership_tenure_years": 6}
_DISPLAY = ", ".join(
    (f"round({c}, {_DISPLAY_ROUNDED[c]})" if c in _DISPLAY_ROUNDED else c) + f' AS "{name}"'
    for c, name in DISPLAY_NAMES.items()
)
_IN_VIEW = "arv_estimate IS NOT NULL AND spread_estimate >= 25000 AND high_confidence"
_PARCELS = """SELECT * EXCLUDE (equity_proxy_annualized_pct),
    round(equity_proxy_annualized_pct, 6) AS equity_proxy_annualized_pct FROM parcels"""

ORACLES: dict[str, str] = {
    name: _query(sql)
    for name, sql in {
        "zip5": f"SELECT PARCEL_ID, {_zip5('PHY_ZIPCD')} AS situs_zip, {_zip5('OWN_ZIPCD')} AS mail_zip FROM raw_roll",
        "addr_norm": f"SELECT PARCEL_ID, {_norm('OWN_ADDR1')} AS own_addr, {_norm('PHY_ADDR1')} AS situs_addr FROM raw_roll",
        "numbers": "SELECT PARCEL_ID, TRY_CAST(TOT_LVG_AREA AS DOUBLE) AS living_area, TRY_CAST(JV AS DOUBLE) AS just_value FROM raw_roll",
        "use_code_filter": "SELECT PARCEL_ID, DOR_UC, DOR_UC = '001' AS core FROM raw_roll WHERE DOR_UC IN ('001', '004', '005', '008')",
        "absentee": "SELECT parcel_id, absentee FROM parcels",
        "out_of_state": "SELECT parcel_id, out_of_state FROM parcels",
        "tenure": "SELECT parcel_id, ownership_tenure_years FROM parcels",
        "equity_proxy": f"SELECT parcel_id, equity_proxy, {_r('equity_proxy_annualized_pct')} FROM parcels",
        "parcels_table": _PARCELS,
        "csv_roundtrip": _PARCELS,
        "recording_ref": "SELECT recording_ref, count(*) AS n FROM typed GROUP BY recording_ref",
        "sale_date": """SELECT sale_year, sale_month,
                CASE WHEN sale_month BETWEEN 1 AND 12 THEN make_date(sale_year, sale_month, 1) END AS month_or_null,
                make_date(sale_year, least(greatest(sale_month, 1), 12), 1) AS month_clipped, count(*) AS n
            FROM typed GROUP BY sale_year, sale_month""",
        "dedup_exact": "SELECT * FROM exact",
        "dedup_conflict": "SELECT * FROM resolved",
        "sale_history": "SELECT * FROM hist",
        "table_roundtrip": "SELECT * FROM hist",
        "sale_flags": """SELECT qual_code, qualified, multi_parcel_sale, comp_eligible, count(*) AS n
            FROM hist GROUP BY ALL""",
        "qual_by_year": "SELECT source_year, QUAL_CD AS qual_code, count(*) AS n FROM raw_sales GROUP BY ALL",
        "dedup_report": """
            SELECT (SELECT count(*) FROM typed) AS raw_rows,
                (SELECT count(*) FROM typed WHERE recording_ref IS NULL) AS no_ref_rows,
                (SELECT count(*) FROM typed) - (SELECT count(*) FROM exact) AS exact_duplicates,
                count(*) AS conflict_groups, coalesce(sum(n), 0)::BIGINT AS conflict_rows,
                (SELECT count(*) FROM resolved) AS distinct_sales,
                round((SELECT count(*) FROM typed WHERE recording_ref IS NULL) * 100.0::DOUBLE
                    / (SELECT count(*) FROM typed), 6) AS no_ref_pct
            FROM (SELECT count(*) AS n FROM exact WHERE recording_ref IS NOT NULL GROUP BY parcel_id, recording_ref HAVING n > 1)""",
        "conflict_groups": """SELECT parcel_id, recording_ref, count(*) AS variants FROM exact
            WHERE recording_ref IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
        "same_file_conflicts": """SELECT count(*) FILTER (k > 1) AS groups
            FROM (SELECT parcel_id, recording_ref, count(*) FILTER (source_year = m) AS k
                FROM (SELECT *, max(source_year) OVER (PARTITION BY parcel_id, recording_ref) AS m FROM exact
                    WHERE recording_ref IS NOT NULL) GROUP BY ALL)""",
        "multi_parcel_report": """SELECT count(*) FILTER (qualified) AS qualified,
                count(*) FILTER (qualified AND multi_parcel_sale) AS qualified_multi,
                count(*) FILTER (comp_eligible) AS comp_eligible,
                round(count(*) FILTER (qualified AND multi_parcel_sale) * 100 / count(*) FILTER (qualified), 6) AS multi_pct
            FROM hist""",
        "sales_per_year": "SELECT sale_year, count(*) AS n FROM hist WHERE qualified AND dor_use_code = '001' GROUP BY sale_year",
        "date_coverage": "SELECT min(sale_date) AS first_sale, max(sale_date) AS last_sale FROM hist",
        "snapshots": "SELECT * FROM snaps",
        "duplicate_snapshots": "SELECT parcel_id, vintage_year, count(*) AS rows FROM snaps GROUP BY ALL HAVING count(*) > 1",
        "subjects": "SELECT as_of, parcel_id, nbrhd_cd, living_area, year_built, just_value FROM v_subjects",
        "comp_events": f"""SELECT parcel_id, sale_date, recording_ref, price, nbrhd_cd, living_area, year_built, just_value,
            {_r("price_per_sqft")} FROM events""",
        "comp_join_report": """
            SELECT CASE WHEN v.vintage_year IS NULL THEN 'no roll of that year' WHEN s.parcel_id IS NULL THEN 'parcel not on that roll'
                    WHEN h.price IS NULL THEN 'no price' WHEN coalesce(s.living_area, 0) <= 0 THEN 'no living area' ELSE 'used' END AS outcome,
                count(*) AS sales
            FROM hist h LEFT JOIN years v ON v.vintage_year = h.sale_year
                LEFT JOIN snaps s ON s.parcel_id = h.parcel_id AND s.vintage_year = h.sale_year
            WHERE h.comp_eligible AND h.dor_use_code = '001' GROUP BY 1""",
        "annual_median": f"""SELECT sale_year, len(l) AS n, round({_q("l", 0.5)}, 6) AS median_psf
            FROM (SELECT sale_year, list(price_per_sqft ORDER BY price_per_sqft) AS l FROM events GROUP BY sale_year)""",
        "index_asof": f"SELECT as_of, anchor_date, {_r('level')} FROM anchors JOIN index_dates USING (as_of)",
        "index_level": f"SELECT as_of, d AS sale_date, {_r('level')} FROM point_levels",
        "adjusted_psf": f"SELECT as_of, parcel_id, sale_date, recording_ref, price, {_r('psf')} FROM v_pool",
        "comp_stats": f"""
            SELECT s.as_of, s.parcel_id, coalesce(len(l), 0) AS all_n,
                {", ".join(f"round({_q('l', p)}, 6) AS all_{n}" for n, p in (("median", 0.5), ("q1", 0.25), ("q3", 0.75)))},
                coalesce(len(b), 0) AS band_n,
                {", ".join(f"round(CASE WHEN len(b) > 0 THEN {_q('b', p)} END, 6) AS band_{n}" for n, p in (("median", 0.5), ("q1", 0.25), ("q3", 0.75)))}
            FROM v_subjects s LEFT JOIN v_trimmed t ON t.as_of = s.as_of AND t.parcel_id = s.parcel_id""",
        "arv_unbanded": f"""
            SELECT s.as_of, s.parcel_id, CASE WHEN len(l) >= 5 THEN round_even({_q("l", 0.5)} * s.living_area, 0) END AS arv_estimate,
                coalesce(len(l), 0)::INTEGER AS arv_comp_count
            FROM v_subjects s LEFT JOIN v_trimmed t ON t.as_of = s.as_of AND t.parcel_id = s.parcel_id""",
        "arv_banded": f"SELECT {_VALUED} FROM v_valued",
        "arv_by_pages": f"SELECT {_VALUED} FROM v_valued",
        "spread": f"SELECT as_of, parcel_id, {_r('spread_estimate', 4)}, {_r('pct_spread')} FROM v_spread",
        "default_places": """SELECT as_of, parcel_id, row_number() OVER (ORDER BY pct_spread DESC, parcel_id, as_of) AS rank
            FROM v_spread WHERE high_confidence AND spread_estimate >= 25000""",
        "default_ranked": f"""SELECT as_of, parcel_id, arv_estimate, {_r("spread_estimate", 4)}, {_r("pct_spread")} FROM v_spread
            WHERE high_confidence AND spread_estimate >= 25000""",
        "coarse_nbrhd": f"""
            SELECT nbrhd_cd, n, round(m, 6) AS median_psf, round(r, 6) AS iqr_ratio, r >= 0.35 AND n >= 30 AS coarse
            FROM (SELECT nbrhd_cd, len(l) AS n, {_q("l", 0.5)} AS m, ({_q("l", 0.75)} - {_q("l", 0.25)}) / {_q("l", 0.5)} AS r
                FROM (SELECT nbrhd_cd, list(price_per_sqft ORDER BY price_per_sqft) AS l FROM events
                    WHERE nbrhd_cd IS NOT NULL GROUP BY nbrhd_cd))""",
        "last_sales": "SELECT * FROM last_sales",
        "signals_asof": f"""SELECT as_of, parcel_id, absentee, no_sale_on_record, {_r("ownership_tenure_years")}, last_qual_price,
            equity_proxy FROM signals""",
        "motivation_score": f"""SELECT parcel_id, {_r("absentee_score")}, {_r("tenure_score")}, {_r("equity_proxy_score")},
            {_r("motivation_score")}, {_GRADE} AS grade FROM motivated""",
        "composite_minmax": f"SELECT as_of, parcel_id, {_SCORES} FROM composite",
        "composite_rank": f"SELECT as_of, parcel_id, {_SCORES} FROM (SELECT *, {_mean(_QUARTERS)} AS composite_score FROM by_rank)",
        "pct_rank": f"SELECT as_of, parcel_id, round({_pct_rank('pct_spread', 'as_of')}, 6) AS pct_rank FROM v_spread",
        "outcomes": f"""SELECT as_of, parcel_id, ce_price, q_price, q_sale_year, jv_prior, sold_ce, {_r("discount_pct")}, discounted,
            sold_q, has_jv_prior, below_jv FROM outcomes""",
        "populations": "SELECT as_of, population, parcel_id FROM pops",
        "eval_rank": _evaluated("rank_counts"),
        "eval_group": _evaluated("group_counts"),
        "eval_matrix": _evaluated("(SELECT * FROM rank_counts UNION ALL SELECT * FROM group_counts)"),
        "eval_verdict": _verdict("(SELECT * FROM rank_counts UNION ALL SELECT * FROM group_counts)"),
        "year_header": """
            SELECT as_of, population, count(*) AS parcels, round(avg(sold_q::INTEGER) * 100, 6) AS any_sale_pct,
                round(avg(absentee::INTEGER) * 100, 6) AS absentee_pct, round(avg(no_sale_on_record::INTEGER) * 100, 6) AS no_sale_pct
            FROM (SELECT 'all' AS population, * FROM outcomes UNION ALL SELECT * FROM pops) GROUP BY as_of, population""",
        "component_diag": f"""
            SELECT as_of, population, component, round(stddev_samp(value), 6) AS std,
                round({_q("list_sort(list(value) FILTER (value IS NOT NULL))", 0.75)}
                    - {_q("list_sort(list(value) FILTER (value IS NOT NULL))", 0.25)}, 6) AS iqr,
                CASE WHEN stddev_pop(rv) * stddev_pop(rs) > 0 THEN round(corr(rv, rs), 6) END AS spearman_with_composite,
                round(avg((value IS NOT NULL)::INTEGER), 6) AS coverage
            FROM (SELECT *, CASE WHEN ok THEN rank() OVER (PARTITION BY as_of, population, component, ok ORDER BY value)
                        + (count(*) OVER (PARTITION BY as_of, population, component, ok, value) - 1) / 2.0::DOUBLE END AS rv,
                    CASE WHEN ok THEN rank() OVER (PARTITION BY as_of, population, component, ok ORDER BY composite_score)
                        + (count(*) OVER (PARTITION BY as_of, population, component, ok, composite_score) - 1) / 2.0::DOUBLE END AS rs
                FROM (SELECT as_of, population, composite_score, component, value, value IS NOT NULL AND composite_score IS NOT NULL AS ok
                    FROM ({" UNION ALL ".join(f"SELECT as_of, population, composite_score, '{c}' AS component, {c} AS value FROM pops" for c in _QUARTERS)})))
            GROUP BY as_of, population, component""",
        "zip_summary": f"""
            SELECT situs_zip, count(*) AS property_count, round_even(avg(absentee::INTEGER) * 100 * 100, 0) / 100 AS absentee_rate,
                round_even(avg(out_of_state::INTEGER) * 100 * 100, 0) / 100 AS out_of_state_rate,
                round_even(avg(ownership_tenure_years) * 10, 0) / 10 AS avg_tenure_years,
                {_q("list_sort(list(just_value))", 0.5)} AS median_just_value
            FROM parcels GROUP BY situs_zip""",
        "parcel_summary": f"""
            SELECT count(*) AS parcels, round(avg(absentee::INTEGER) * 100, 6) AS absentee_pct,
                round(avg(out_of_state::INTEGER) * 100, 6) AS out_of_state_pct, count(equity_proxy) AS with_equity,
                round(count(equity_proxy) * 100 / count(*), 6) AS equity_pct,
                {_q("list_sort(list(ownership_tenure_years))", 0.5)} AS median_tenure
            FROM parcels""",
        "id_stability": """
            SELECT count(*) AS all_ids, count(*) FILTER (y = 6) AS ids_every_year,
                round(count(*) FILTER (y = 6) * 100 / count(*), 6) AS every_year_pct
            FROM (SELECT PARCEL_ID, count(DISTINCT vintage_year) AS y FROM stability GROUP BY PARCEL_ID)""",
        "id_transitions": f"""
            SELECT vintage_year AS from_year, count(*) AS disappeared, count(*) FILTER (found) AS renumbered,
                count(*) FILTER (NOT found) AS dropped, round(count(*) FILTER (found) * 100 / count(*), 6) AS renumbered_pct
            FROM (SELECT a.vintage_year, EXISTS (SELECT 1 FROM stability b WHERE b.vintage_year = a.vintage_year + 1
                    AND {_norm("b.OWN_NAME || '|' || b.PHY_ADDR1")} = {_norm("a.OWN_NAME || '|' || a.PHY_ADDR1")}) AS found
                FROM stability a WHERE a.vintage_year < 2001 AND NOT EXISTS (SELECT 1 FROM stability b
                    WHERE b.PARCEL_ID = a.PARCEL_ID AND b.vintage_year = a.vintage_year + 1))
            GROUP BY ROLLUP (vintage_year)""",
        "screen": f"SELECT {_DISPLAY} FROM screen_scored WHERE {_IN_VIEW}",
        "screen_places": f"""SELECT parcel_id, row_number() OVER (ORDER BY spread_estimate DESC, parcel_id) AS rank
            FROM screen_scored WHERE {_IN_VIEW}""",
        "screen_top_25": f"""SELECT * FROM (SELECT parcel_id, row_number() OVER (ORDER BY pct_spread DESC, parcel_id) AS rank
            FROM screen_scored WHERE {_IN_VIEW}) WHERE rank <= 25""",
        "screen_top": f"""SELECT {_DISPLAY} FROM (SELECT * FROM screen_scored WHERE {_IN_VIEW}
            ORDER BY pct_spread DESC, parcel_id LIMIT 500)""",
        "screen_absentee_by_dollars": f"""SELECT {_DISPLAY} FROM screen_scored
            WHERE arv_estimate IS NOT NULL AND spread_estimate >= 10000 AND absentee AND just_value <= 250000""",
        "screen_header": f"""SELECT count(*) AS parcels, count(arv_estimate) AS with_arv, count(*) FILTER ({_IN_VIEW}) AS in_view
            FROM screen_scored""",
        "mao_grid": """SELECT as_of, parcel_id, arv_estimate, rule, repair_cost,
                round(greatest(0, arv_estimate * rule - repair_cost), 4) AS max_offer
            FROM w_valued, (VALUES (0.65::DOUBLE), (0.7::DOUBLE), (0.75::DOUBLE)) r(rule),
                (VALUES (0::DOUBLE), (35000::DOUBLE)) c(repair_cost)
            WHERE arv_estimate IS NOT NULL""",
        "parcel_record": "SELECT parcel_id, owner_name, living_area, year_built, arv_estimate, grade FROM screen_scored WHERE parcel_id = '12'",
        "sale_slots": f"SELECT parcel_id, slot, sale_price, sale_date, qual_cd, {_r('price_per_sqft')} FROM sale_events",
        "arv_single_roll": "SELECT as_of, parcel_id, arv_estimate, arv_comp_count, arv_dispersion_pct FROM r_valued",
        "flip_funnel": """SELECT count(*) AS two_sales, count(*) FILTER (holding_months <= 0) AS not_later,
                count(*) FILTER (holding_months > 0) AS in_order, count(*) FILTER (holding_months BETWEEN 6 AND 18) AS held,
                count(*) FILTER (holding_months BETWEEN 6 AND 18 AND price_delta_pct >= 10) AS flips
            FROM two_sales""",
        "flip_describe": f"""
            SELECT measure, count(*) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min,
                round(max(x), 6) AS max,
                {", ".join(f"round({_q('list_sort(list(x))', p)}, 6) AS {n}" for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))}
            FROM (SELECT 'holding_months' AS measure, holding_months::DOUBLE AS x FROM two_sales WHERE holding_months > 0
                UNION ALL SELECT 'price_delta_pct', price_delta_pct FROM two_sales WHERE holding_months BETWEEN 6 AND 18)
            GROUP BY measure""",
        "flips": f"SELECT parcel_id, acquired, holding_months, {_r('price_delta_pct')} FROM flips",
        "flip_backtest": "SELECT * FROM flip_results",
        "flip_hits": "SELECT count(*) FILTER (in_top_decile) AS hits, count(*) AS flips FROM flip_results",
        "accuracy": f"""
            SELECT as_of, version, band, count(*) AS n, round({_q("list_sort(list(error) FILTER (error IS NOT NULL))", 0.5)} * 100, 6) AS median,
                round(avg(error) * 100, 6) AS mean, round(avg(coalesce(error <= 0.1, false)::INTEGER) * 100, 6) AS w10,
                round(avg(coalesce(error <= 0.2, false)::INTEGER) * 100, 6) AS w20
            FROM error_bands GROUP BY as_of, version, band""",
        "guard_leaky_rows": """SELECT sale_date, count(*) AS n FROM events
            WHERE sale_date >= DATE '2000-01-01' AND sale_date <= DATE '2000-02-01' GROUP BY sale_date""",
        "invariance": "SELECT * FROM (VALUES ('index', 0::BIGINT), ('valuation', 0), ('signals', 0)) AS t(compared, different)",
        "guard_fires": """SELECT * FROM (VALUES ('all sales', (SELECT count(*) > 0 FROM events WHERE sale_date >= DATE '2000-01-01')),
            ('past sales', (SELECT count(*) < 0 FROM events))) AS t(pool, fired)""",
        "seeded_sample": """SELECT as_of, parcel_id FROM v_subjects WHERE as_of = DATE '1999-01-01'
            ORDER BY (parcel_id::BIGINT * 7919) % 10007 * 1000000000 + parcel_id::BIGINT, parcel_id LIMIT 1000""",
        "leaky_vs_fixed": f"""
            SELECT f.as_of, round(f.level, 6) AS fixed_level, round(l.level, 6) AS leaky_level,
                round(m.median_psf, 6) AS prior_year_median, round((l.level / f.level - 1) * 100, 6) AS overstated_pct,
                abs(f.level - m.median_psf) <= 0.000001 * abs(m.median_psf) AS equals_prior_median
            FROM fixed_at f JOIN leaky_at l ON l.as_of = f.as_of LEFT JOIN (SELECT sale_year, {_q("l", 0.5)} AS median_psf
                FROM (SELECT sale_year, list(price_per_sqft ORDER BY price_per_sqft) AS l FROM events GROUP BY sale_year)) m
                ON m.sale_year = year(f.as_of) - 1""",
    }.items()
}

# The same tables by way of zipped files, whose text is stripped when it is read.
for _name in ("sale_history", "id_stability", "id_transitions"):
    ORACLES[f"{_name}_from_zips"] = ORACLES[_name]
ORACLES["snapshots_from_zips"] = f"""SELECT * REPLACE (trim(own_addr1) AS own_addr1, trim(situs_zip) AS situs_zip)
    FROM ({ORACLES["snapshots"]})"""
ORACLES["parcels_from_zips"] = f"SELECT * REPLACE (trim(own_addr1) AS own_addr1) FROM ({ORACLES['parcels_table']})"
