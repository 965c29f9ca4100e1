"""Writers: CSV (plain or gzip), Parquet, JSON, and text tables of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: list[str] = (), gzip: bool = False) -> None:
    """CSV with a header; rows in order across the files."""
    df = df.orderBy(*order) if order else df
    df.write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def write_parquet(df: DataFrame, path: str, partition: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_arrays(arrays: dict[str, DataFrame], path: str, name: str = "name", values: str = "values") -> None:
    """Named arrays as one Parquet table (name, values), which read_arrays reads; each table has one array column."""
    out = None
    for key, df in arrays.items():
        part = df.select(F.lit(key).alias(name), F.col(df.columns[0]).alias(values))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no arrays")
    out.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def mean_std(mean: str, std: str, digits: int = 3):
    """``mean ± std`` as text; only the mean where there is no deviation, and ``--`` where there is no mean."""
    number = lambda c: F.format_string(f"%.{digits}f", c)
    return F.when(F.col(mean).isNull(), "--").when(F.col(std).isNull(), number(mean)).otherwise(F.concat(number(mean), F.lit(" ± "), number(std)))


def text_table(df: DataFrame, style: str = "markdown", most: int = 1000) -> str:
    """A small result as a markdown or LaTeX table; more than ``most`` rows are an error, since a report is read by people."""
    rows = [["" if v is None else str(v) for v in r] for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    if style == "latex":
        body = [" & ".join(r) + r" \\" for r in [df.columns, *rows]]
        return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", body[0], r"\hline", *body[1:], r"\end{tabular}"])
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])
