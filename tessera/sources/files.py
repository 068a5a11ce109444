"""Readers and sinks: explicit schemas in, fixed formats out."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; an empty cell stays an empty string."""
    raw = spark.read.csv(path, header=True, inferSchema=False, nullValue="\x00", emptyValue="")
    return raw.fillna("")


def view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def csv_view(spark: SparkSession, path: str, name: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV with a header as a named view; without a schema its types are inferred from all rows."""
    df = csv(spark, path, schema) if schema is not None else spark.read.csv(path, header=True, inferSchema=True)
    return view(df, name)


class Registry:
    """Frames by name: readers that are called once, on first use; what a model refers to."""

    def __init__(self):
        self._make: dict[str, Callable[[], DataFrame]] = {}
        self._made: dict[str, DataFrame] = {}

    def add(self, name: str, make: Callable[[], DataFrame]) -> None:
        if name in self._make:
            raise ValueError(f"{name} is registered already")
        self._make[name] = make

    def ref(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make[name]()
        return self._made[name]


def json_documents(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """One row per document with the file it came from, in the order of file names; dynamic keys are maps in the schema."""
    return spark.read.schema(schema).json(folder, multiLine=True).withColumn("file", F.col("_metadata.file_name")).orderBy("file")


def statements(script: str) -> list[str]:
    """Statements of a script; lines that are only a comment go."""
    kept = "\n".join(line for line in script.splitlines() if not line.lstrip().startswith("--"))
    return [s.strip() for s in kept.split(";") if s.strip()]


def cuts(script: str) -> dict[str, str]:
    """Named statements of a script with lines `-- @cut: name`."""
    parts = re.split(r"(?m)^--\s*@cut:\s*(\S+)\s*$", script)
    return {name: "; ".join(statements(body)) for name, body in zip(parts[1::2], parts[2::2], strict=True)}


def run_script(spark: SparkSession, script: str) -> list[DataFrame]:
    return [spark.sql(s) for s in statements(script)]


def shown(v: object) -> str:
    """A cell of a report: four digits, thousands apart, nothing for null."""
    if v is None:
        return ""
    return f"{v:,.4f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


def render(df: DataFrame, most: int = 10_000) -> str:
    """A fixed-width table of a report, in the caller's order. A frame of more rows than most is no report and raises."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for a report")
    rows = [[shown(v) for v in r] for r in found]
    width = [max(map(len, c)) for c in zip(df.columns, *rows, strict=True)]
    line = lambda r: "  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in width]), *map(line, rows)]) + "\n"


def percent(x: float | None, digits: int = 1) -> str:
    return "" if x is None else f"{100 * x:.{digits}f}%"


def markdown(df: DataFrame, title: str) -> str:
    """A section of a report: a heading and the table in a code block."""
    return f"## {title}\n\n```\n{render(df)}```\n"


def chart(df: DataFrame, x: str, series: list[str], path: str, most: int = 10_000) -> None:
    """Lines of a few series over x, a panel each, as SVG; the frame is an aggregate."""
    rows = df.select(x, *series).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a chart")
    width, height, parts = 640, 160, []
    for n, c in enumerate(series):
        v = [float(r[c]) for r in rows if r[c] is not None]
        low, high = (min(v), max(v)) if v else (0.0, 1.0)
        at = lambda i, y: f"{20 + i * (width - 40) / max(1, len(rows) - 1):.1f},{height * (n + 1) - 20 - (y - low) / ((high - low) or 1.0) * (height - 50):.1f}"  # noqa: B023, E731
        points = " ".join(at(i, float(r[c])) for i, r in enumerate(rows) if r[c] is not None)
        parts.append(f'<text x="20" y="{height * n + 16}">{c}: {shown(low)} to {shown(high)}</text><polyline fill="none" stroke="#336699" points="{points}"/>')
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height * len(series)}" font-size="12">{"".join(parts)}</svg>\n')


def metrics(df: DataFrame) -> str:
    """The single row of a frame as JSON with sorted keys."""
    return json.dumps(df.first().asDict(recursive=True), sort_keys=True, indent=2, default=str) + "\n"


def write_csv(df: DataFrame, path: str, order: list[str], digits: int = 4) -> None:
    """Fixed column order and float format, one file for a report; the caller's frame is an aggregate."""
    shown = [F.format_string(f"%.{digits}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.select(*order).dtypes]
    df.select(*shown).coalesce(1).write.mode("overwrite").csv(path, header=True, lineSep="\n")


def rebuild(df: DataFrame, path: str, schema: StructType) -> DataFrame:
    """Overwrite a store with rows cast to a declared schema."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def settled(df: DataFrame, path: str) -> DataFrame:
    """The frame written to a folder that all executors see, and read from there: its lineage ends here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
