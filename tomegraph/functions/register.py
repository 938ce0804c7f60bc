"""The engine's functions under SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import parsers
from .similarity import weighted_ratio

#: SQL functions made of built-in ones, so calls stay inside the plan.
_SQL = {
    "snake_id(s STRING) RETURNS STRING": "regexp_replace(regexp_replace(lower(s), '[ \\\\-]', '_'), '[^\\\\p{L}\\\\p{N}_]', '')",
    "normalized_label(s STRING) RETURNS STRING": "trim(regexp_replace(regexp_replace(lower(replace(s, '_', ' ')), '[\\'`]', ''), '(?U)\\\\s+', ' '))",
    "md5_id(prefix STRING, name STRING, source STRING) RETURNS STRING": "md5(lower(concat_ws(':', prefix, trim(name), trim(coalesce(source, 'unknown')))))",
    "similar_labels(a STRING, b STRING) RETURNS BOOLEAN": "CASE WHEN coalesce(a = '' OR b = '', true) THEN false ELSE a = b OR ((contains(a, b) OR contains(b, a)) AND least(length(a), length(b)) >= 0.5 * greatest(length(a), length(b))) OR levenshtein(a, b) <= 2 OR levenshtein(a, b) <= 0.2 * greatest(length(a), length(b)) END",
}


def register(spark: SparkSession) -> None:
    """snake_id, normalized_label, md5_id, similar_labels, weighted_ratio, parse_entities, parse_events, parse_report."""
    for head, body in {**_SQL, f"parse_report(reply STRING) RETURNS {parsers.REPORT}": parsers.report_sql("reply")}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])

    spark.udf.register("weighted_ratio", ratio)
    spark.udf.register("parse_entities", parsers.entity_udf())
    spark.udf.register("parse_events", parsers.event_udf())
