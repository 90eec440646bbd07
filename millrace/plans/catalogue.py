"""All queries outside the subpackage for text training data.

Sums and quotients of doubles differ in their last bits with the order of the rows, so the columns
listed here are rounded, in the plan and in its oracle alike.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from millrace.plans import analytics, more, pipelines, problems, reports

QUERIES = {**reports.QUERIES, **analytics.QUERIES, **more.QUERIES, **pipelines.QUERIES, **problems.QUERIES}
SQL = {**reports.SQL, **analytics.SQL, **more.SQL, **pipelines.SQL, **problems.SQL}

ROUNDED = {
    "monthly_revenue": ["growth"], "yoy_growth": ["growth"], "yoy_growth_gap_safe": ["growth"], "revenue_by_region": ["share"],
    "revenue_by_category": ["share"], "region_category": ["share"], "payment_mix": ["mean_value", "order_share", "value_share"],
    "freight_ratio_category": ["pct"], "freight_ratio_region": ["pct"], "freight_hotspots": ["pct"], "late_rate_nation": ["pct"], "late_rate_seller": ["pct"],
    "forecast_metrics": ["mae", "mape", "rmse"], "did_estimate": ["did", "se", "z", "low", "high"], "event_study": ["difference", "se"],
    "did_by_weekend": ["did", "se"], "did_robustness": ["did"], "did_quadrants": ["before", "after", "change"], "temperature_correlation": ["correlation", "slope", "intercept"],
    "neighbour_similarity": ["mean_similarity"], "auc_by_group": ["auc"], "fairness_gaps": ["auc", "gap"], "score_bands": ["mean_score"], "psi_drift": ["psi"], "drift_report": ["psi"],
    "monitoring_stats": ["mean", "flagged_rate", "p95"], "rain_effect": ["with_mean", "without_mean", "pct_change"], "day_type_profile": ["W", "A", "U"],
    "recent_weather": ["temperature_2m", "windspeed_10m"], "funding_trends": ["growth"], "cohort_revenue": ["so_far"], "ab_ztest": ["rate_a", "rate_b", "lift", "z"],
    "calendar_features": ["dow_sin", "dow_cos", "month_sin", "month_cos"], "weekly_resample": ["mean_rides"], "p2_trailing_totals": ["avg_7", "avg_30"],
}
ROUNDED |= more.ROUNDED | pipelines.ROUNDED
DIGITS = 7


def _rounded(fn, columns):
    @wraps(fn)
    def run(spark, folder):
        return fn(spark, folder).withColumns({c: F.round(c, DIGITS) + F.lit(0.0) for c in columns})

    return run


for _name, _columns in ROUNDED.items():
    QUERIES[_name] = _rounded(QUERIES[_name], _columns)
    _parts = ", ".join(f'round("{c}", {DIGITS}) + 0.0::DOUBLE AS "{c}"' for c in _columns)
    if _name in SQL:
        SQL[_name] = f"SELECT * REPLACE ({_parts}) FROM ({SQL[_name]}) AS rounded"
