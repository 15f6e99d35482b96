"""The engine's scalar rules as SQL functions, for users who write Spark SQL (O).

``register`` creates temporary functions whose bodies are SQL expressions: the analyser puts the body where the call stands,
so a query that uses them is optimised and compiled like any other and runs no Python. Names start with ``cw_``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from countwatch.functions.text import TokenLists, token_pattern


def _quoted(text: str) -> str:
    """A raw SQL string literal; a quote inside is not expected in a pattern."""
    if "'" in text:
        raise ValueError("a token with a quote cannot be part of a SQL function")
    return f"r'{text}'"


def _token(value: str, pattern: str) -> str:
    return f"nullif(lower(regexp_extract(cw_squeeze({value}), {_quoted(pattern)}, 0)), '')"


def definitions(lists: TokenLists) -> dict[str, str]:
    """Signature to body, in the order of creation: later functions may call earlier ones."""
    return {
        "cw_squeeze(value STRING) RETURNS STRING": r"trim(regexp_replace(value, r'\s+', ' '))",
        "cw_firm_token(value STRING) RETURNS STRING": f"CASE WHEN NOT rlike(cw_squeeze(value), {_quoted(token_pattern(lists.not_firm))}) THEN {_token('value', token_pattern(lists.firm))} END",
        "cw_brand_token(value STRING) RETURNS STRING": _token("value", token_pattern(lists.brand)),
        "cw_month(value TIMESTAMP_NTZ) RETURNS INT": "year(value) * 12 + month(value)",
        "cw_month_label(mi INT) RETURNS STRING": "concat(lpad(cast((mi - 1) div 12 AS STRING), 4, '0'), '-', lpad(cast(pmod(mi - 1, 12) + 1 AS STRING), 2, '0'))",
        "cw_baseline_a(y0 DOUBLE, y1 DOUBLE, y2 DOUBLE) RETURNS DOUBLE": "(y0 + y1 + y2) / 3",
        "cw_ets_log_point(level DOUBLE, trend DOUBLE, phi DOUBLE, season ARRAY<DOUBLE>, h INT) RETURNS DOUBLE": (
            "level + trend * aggregate(sequence(1, h), 0D, (a, j) -> a + pow(phi, j)) + element_at(season, pmod(h - 1, 12) + 1)"
        ),
        "cw_ets_point(level DOUBLE, trend DOUBLE, phi DOUBLE, season ARRAY<DOUBLE>, h INT) RETURNS DOUBLE": "greatest(0D, expm1(cw_ets_log_point(level, trend, phi, season, h)))",
        "cw_interval_score(y DOUBLE, low DOUBLE, high DOUBLE, alpha DOUBLE) RETURNS DOUBLE": "(high - low) + 2 / alpha * (greatest(low - y, 0D) + greatest(y - high, 0D))",
        "cw_wis(y DOUBLE, point DOUBLE, low50 DOUBLE, high50 DOUBLE, low80 DOUBLE, high80 DOUBLE) RETURNS DOUBLE": (
            "(0.5D * abs(y - point) + 0.25D * cw_interval_score(y, low50, high50, 0.5D) + 0.1D * cw_interval_score(y, low80, high80, 0.2D)) / 2.5D"
        ),
    }


def register(spark: SparkSession, lists: TokenLists) -> list[str]:
    """Create the functions in this session, anew if they are there; returns their names."""
    names = []
    for signature, body in definitions(lists).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.split("(")[0])
    return names
