"""SQL-callable versions of the most used expressions, as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "clock_seconds": "(face STRING) RETURNS DOUBLE RETURN CASE WHEN contains(face, ':') THEN "
    "try_cast(split_part(face, ':', 1) AS INT) * 60 + try_cast(split_part(face, ':', 2) AS DOUBLE) END",
    "american_probability": "(odds DOUBLE) RETURNS DOUBLE RETURN "
    "CASE WHEN odds < 0 THEN -odds / (-odds + 100) ELSE 100 / (odds + 100) END",
    "floor_to_grid": "(at BIGINT, step BIGINT, phase BIGINT) RETURNS BIGINT RETURN at - pmod(at - phase, step)",
    "taker_fee": "(contracts DOUBLE, price DOUBLE) RETURNS DOUBLE RETURN "
    "ceil(0.07D * contracts * price * (1 - price) * 100) / 100",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)
