"""Drivers of an outcome: a weighted logistic regression with named coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def logistic_drivers(df: DataFrame, formula: str, weight: str, rounds: int = 50) -> DataFrame:
    """(feature, coefficient, auc) of a regression by formula, largest effect first."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import RFormula

    spark: SparkSession = df.sparkSession
    ready = RFormula(formula=formula).fit(df).transform(df)
    fitted = LogisticRegression(maxIter=rounds, weightCol=weight).fit(ready)
    groups = ready.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for g in groups.values() for a in g}
    auc = float(fitted.summary.areaUnderROC)
    rows = sorted(((names[i], float(c), auc) for i, c in enumerate(fitted.coefficients)), key=lambda r: (-abs(r[1]), r[0]))
    return spark.createDataFrame(rows, "feature string, coefficient double, auc double").orderBy(F.desc(F.abs("coefficient")), "feature")
