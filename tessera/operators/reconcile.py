"""Disagreement of sources about one number: classify by precedence, resolve by reliability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

#: Tolerances in percent, days between period ends that count as misaligned, source tiers.
AGREE, MINOR, SPAN = 0.5, 2.0, 20
TIERS = {"edgar": 0, "fmp": 1, "polygon": 1}


def reconcile(obs: DataFrame, by: Sequence[str], tiers: dict[str, int] = TIERS) -> DataFrame:
    """One row per group of (source, value, period_end): spread, disagreement, class, resolved value and source, outlier.

    Classes in precedence: single_source, unit_scale_mismatch, period_misalignment, agreement, minor_divergence,
    material_divergence. A source that
    reports a group twice raises, as the map of values cannot be built.
    """
    rank = F.create_map(*[F.lit(x) for kv in tiers.items() for x in kv])
    o = obs.withColumn("_tier", F.coalesce(F.try_element_at(rank, F.col("source")), F.lit(2)))
    order = F.struct("_tier", "source")
    g = o.groupBy(*by).agg(
        F.count("*").alias("n_sources"), F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.median("value").alias("_mid"),
        F.datediff(F.max("period_end"), F.min("period_end")).alias("_days"), F.min_by("value", order).alias("resolved_value"), F.min_by("source", order).alias("resolved_source"),
        F.min("_tier").alias("_best"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "value")))).alias("source_values"),
    )
    spread = F.col("_hi") - F.col("_lo")
    off = F.when((F.col("n_sources") < 2) | (F.col("_mid") == 0), F.lit(0.0)).otherwise(spread / F.abs("_mid") * 100)
    kind = (
        F.when(F.col("n_sources") < 2, "single_source").when(C.scale_mixup(F.col("_lo"), F.col("_hi")), "unit_scale_mismatch").when(F.col("_days") > SPAN, "period_misalignment")
        .when(off <= AGREE, "agreement").when(off <= MINOR, "minor_divergence").otherwise("material_divergence")
    )
    others = F.filter(F.map_entries("source_values"), lambda e: e["key"] != F.col("resolved_source"))
    far = F.array_max(F.transform(others, lambda e: F.abs(e["value"] - F.col("resolved_value"))))
    outlier = F.filter(others, lambda e: F.abs(e["value"] - F.col("resolved_value")) == far)
    return g.select(
        *by, "n_sources", spread.alias("spread"), off.alias("disagreement_pct"), kind.alias("classification"), "resolved_value", "resolved_source",
        (F.col("_best") == 0).alias("regulatory_anchor"), F.when(F.col("n_sources") > 1, F.try_element_at(outlier, F.lit(1))["key"]).alias("outlier"), "source_values",
    )
