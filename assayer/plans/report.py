"""Findings, run summary and the before/after quality report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import text as X
from assayer.operators import derive as D
from assayer.operators import profile as A
from assayer.operators.dedup import duplicate_summary
from assayer.plans.clean import clean, coerce
from assayer.session import materialise
from assayer.spec import Spec


def _section(df: DataFrame, name: str, item: str, measure: str, order: list, k: int) -> DataFrame:
    """First ``k`` rows of a result table (one row per column, key or test) as findings."""
    first = df.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy("section").orderBy(*order))
    named = first.withColumn("section", F.lit(name))
    return named.select("section", rank.alias("rank"), F.col(item).alias("item"), F.col(measure).cast("double").alias("measure"))


def key_findings(df: DataFrame, keys: Sequence[str], categories: Sequence[str], tests: DataFrame | None = None, p_value: str = "p_value", test_name: str = "pair") -> DataFrame:
    """Ten columns with most nulls, repeated keys, five top categories per column, first five significant tests."""
    nulls = _section(A.null_profile(df), "nulls", "column", "null_pct", [F.desc("null_pct"), F.desc("null_count"), F.col("column")], 10)
    repeated = _section(
        duplicate_summary(df, [[k] for k in keys]), "repeated_keys", "key_columns", "duplicate_rows", [F.desc("duplicate_rows"), F.col("key_columns")], len(keys)
    )
    top = A.top_values(df, categories, 5).select(
        F.concat(F.lit("top_categories:"), F.col("column")).alias("section"), "rank", F.col("value").alias("item"), F.col("n").cast("double").alias("measure")
    )
    found = nulls.unionByName(repeated).unionByName(top)
    if tests is not None:
        significant = tests.filter(F.col(p_value) < 0.05)
        found = found.unionByName(_section(significant, "significant_tests", test_name, p_value, [F.col(p_value), F.col(test_name)], 5))
    return found


def run_summary(df: DataFrame, spec: Spec, conversions: DataFrame | None = None, tests: DataFrame | None = None) -> DataFrame:
    """One row: size, distinct ids, the worst null count, anomalies and values that cleaning will correct.

    ``conversions`` (from ``conversion_summary``) adds the values that conversions lost, ``tests`` (with a p-value each) the
    tests that ran and those below .05.
    """
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.greatest(*[F.count_if(F.col(c).isNull()) for c in df.columns]).alias("most_nulls"),
        F.count_if(D.timestamp_rules(spec)["temporal_anomaly"]).alias("temporal_anomalies"),
        F.count_if(F.col(spec.price) < 0).alias("negative_prices"),
        F.count_if(F.col(spec.duration) < 0).alias("negative_durations"),
    )
    ids = df.filter(F.col(spec.id).isNotNull()).groupBy(spec.id).agg(F.lit(1)).agg(F.count(F.lit(1))).scalar()
    more = []
    if conversions is not None:
        more.append(conversions.agg(F.coalesce(F.sum("coerced_to_null"), F.lit(0)).alias("v")).scalar().alias("conversions_lost"))
    if tests is not None:
        more.append(tests.agg(F.count("p_value").alias("v")).scalar().alias("tests_run"))
        more.append(tests.agg(F.count_if(F.col("p_value") < 0.05).alias("v")).scalar().alias("significant_tests"))
    return counted.select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), ids.alias("distinct_ids"), "most_nulls", "temporal_anomalies", "negative_prices",
        "negative_durations", *more,
    )


def _facts(frame: DataFrame, stage: str, spec: Spec) -> DataFrame:
    """Sizes, repeated ids, placeholders, constants and nulls of one table: three aggregations in all."""
    copies = frame.groupBy(*frame.columns).agg(F.count(F.lit(1)).alias("c"))
    sizes = copies.agg(
        F.sum("c").alias("rows"), F.sum(F.col("c") - 1).alias("exact_duplicates"), F.lit(len(frame.columns)).cast("long").alias("columns")
    )
    text = set(A.text_columns(frame))

    # Whether a column is constant is counted against any one row: least and greatest texts would keep the aggregate out of generated code.
    one = F.broadcast(frame.limit(1).select(*[F.col(c).alias(f"1|{c}") for c in frame.columns]))

    def constant(name: str):
        return (F.count_if(~F.col(name).eqNullSafe(F.col(f"1|{name}"))) == 0).cast("long")

    measures = {
        c: {"nulls": F.count_if(F.col(c).isNull()), "constant": constant(c),
            "placeholders": F.count_if(A.is_placeholder(F.col(f"t|{c}"))) if c in text else F.count_if(F.lit(False))} for c in frame.columns
    }
    texts = frame.withColumns({f"t|{c}": X.normalize_text(F.col(c)) for c in text}) if text else frame
    per_column = A.wide_to_rows(texts.crossJoin(one), measures).unpivot(["column"], ["nulls", "constant", "placeholders"], "section", "value")
    repeated = duplicate_summary(frame, [[spec.id]])
    parts = [
        sizes.unpivot([], ["rows", "exact_duplicates", "columns"], "item", "value").withColumn("section", F.lit("size")),
        repeated.select(F.col("key_columns").alias("item"), F.col("duplicate_rows").alias("value"), F.lit("repeated_id").alias("section")),
        per_column.filter((F.col("section") == "nulls") | (F.col("value") > 0)).withColumnRenamed("column", "item"),
    ]
    united = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return united.select(F.lit(stage).alias("stage"), "section", "item", F.col("value").cast("double").alias("value"))


def _listed(frame: DataFrame, stage: str, section: str) -> DataFrame:
    rows = frame.unpivot([], frame.columns, "item", "value")
    return rows.select(F.lit(stage).alias("stage"), F.lit(section).alias("section"), "item", F.col("value").cast("double").alias("value"))


def quality_report(df: DataFrame, spec: Spec, nfkc: str | bool = "auto", cleaned: DataFrame | None = None) -> DataFrame:
    """Table before and after cleaning: sizes, duplicates, placeholders and constants left, nulls, corrections.

    One row per (stage, section, item). ``cleaned`` is the written result of the
    cleaning plan when there is one; otherwise it is computed once and kept in
    the checkpoint folder, because every fact reads it.
    """
    df = materialise(df)  # read by cleaning, by the corrections and by three reductions
    if cleaned is None:
        cleaned = materialise(clean(df, spec, nfkc))
    base = coerce(df, spec, nfkc)
    corrected = base.agg(
        F.count_if(F.col(spec.price) < 0).alias("negative_prices"), F.count_if(F.col(spec.duration) < 0).alias("negative_durations")
    )
    remaining = cleaned.agg(
        F.count_if("temporal_anomaly").alias("temporal_anomalies"), F.count_if(D.duration_not_computable(spec)).alias("durations_not_computable")
    )
    return (
        _facts(df, "before", spec).unionByName(_facts(cleaned, "after", spec))
        .unionByName(_listed(corrected, "before", "corrected")).unionByName(_listed(remaining, "after", "remaining"))
    )
