"""Declared schemas of sources after their transforms, and checks of what comes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: By source, as DDL. Fixed values.
SCHEMAS = {
    "ces": "series_id string, year int, period string, period_name string, value double, footnotes array<struct<code:string,text:string>>, month int, date date, mom_change double, yoy_change double, unit string, is_preliminary boolean",
    "laus": "series_id string, year int, period string, period_name string, value double, footnotes array<struct<code:string,text:string>>, month int, date date, state_fips string, measure string, state_name string, mom_change double, yoy_change double",
    "claims": "report_date date, state_code string, initial_claims double, continued_claims double, initial_claims_4wk_ma double, continued_claims_13week double",
    "treasury": "date date, classification string, balance double, daily_withholding double, withholding_5day_ma double, withholding_20day_ma double, is_business_day boolean, day_of_month int, is_mid_month boolean, is_month_end boolean",
    "bfs": "date date, high_propensity_applications double, business_formations double, total_applications double, formation_rate double",
    "strikes": "date date, workers_involved double, num_stoppages long, industry string, strike_impact_score double, is_significant_month boolean",
    "weather": "year_month date, event_type string, state string, deaths double, injuries double, damage_millions double, employment_impact_score double, date date, num_major_events long, is_high_impact_month boolean",
}


def conform(df: DataFrame, source: str) -> DataFrame:
    """Columns of the schema in its order, parsed to its types; missing ones are null, others stay behind."""
    wanted = StructType.fromDDL(SCHEMAS[source])
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted])


def drift(df: DataFrame, source: str) -> dict[str, list[str]]:
    """Columns that are missing, new, or of another type."""
    wanted, got = dict((f.name, f.dataType.simpleString()) for f in StructType.fromDDL(SCHEMAS[source])), dict(df.dtypes)
    return {"missing": sorted(set(wanted) - set(got)), "new": sorted(set(got) - set(wanted)), "changed": sorted(c for c in set(got) & set(wanted) if got[c] != wanted[c])}
