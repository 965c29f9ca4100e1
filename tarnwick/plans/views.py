"""The measurement views over the driver's tables, and helpers that make results comparable.

A measurement is a line item: brand of the part (solute), nation of the supplier (solvent), supplier (source), quantity (temperature), price (value). In
``raw`` the value is noise; in ``mix`` it follows the temperature, with an error that depends on the brand, so sources agree or copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.operators.blocks import part_of
from tarnwick.sources.tables import table

KEYS = ["solute", "solvent"]
ORDER = ["rid"]


#: Rows of a dimension that is broadcast; a larger one is joined by a shuffle.
SMALL = 2_000_000
RID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _value(kind: str) -> Column:
    noise = F.log10(F.col("l_extendedprice") / 10000.0)
    brand = F.substring("p_brand", 7, 10).cast("int")
    return noise if kind == "raw" else -2.0 + 0.02 * F.col("l_quantity") + (0.03 + 0.25 * (brand % 5)) * noise


def _rid() -> Column:
    return F.concat_ws("-", *(F.col(c).cast("string") for c in RID))


def measurements(spark: SparkSession, sf_dir: str, kind: str = "mix") -> DataFrame:
    """rid, solute, solvent, source, t, y, x, sigma, seed, flag, weight. rid is a row's own number."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    supplier, nation = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        _rid().alias("rid"),
        F.col("p_brand").alias("solute"), F.col("n_name").alias("solvent"), F.col("l_suppkey").cast("string").alias("source"), (273.15 + F.col("l_quantity")).alias("t"), _value(kind).alias("y"),
        (F.col("l_extendedprice") / 200000.0).alias("x"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("sigma"), F.col("l_linenumber").cast("long").alias("seed"), F.col("l_returnflag").alias("flag"), F.col("p_size").cast("double").alias("weight"), F.col("p_type").alias("kind"),
    )


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, solute, solvent, source (a number), t, y of measurements, and dealt, the part by solute and source. Only numbers are shuffled; what is made of them, such as rid, is made where they arrive."""
    part = small(table(spark, sf_dir, "part").select("p_partkey", "p_brand"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = small(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name"))
    line = table(spark, sf_dir, "lineitem").select(*RID).join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", *RID)
    rows = line.where("p_brand is not null and l_suppkey is not null").withColumn("dealt", part_of(line, "p_brand", "l_suppkey")).repartition("dealt").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("dealt", _rid().alias("rid"), F.col("p_brand").alias("solute"), F.col("n_name").alias("solvent"), F.col("l_suppkey").alias("source"), (273.15 + F.col("l_quantity")).alias("t"), _value("mix").alias("y"))


def by_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """solute, solvent, source (a number), t, y of measurements, the columns of RID, and dealt, the part by solute, solvent and temperature. Only numbers and brands are shuffled; the text of
    RID isn't made."""
    part = small(table(spark, sf_dir, "part").select("p_partkey", "p_brand"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = small(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name"))
    t = 273.15 + F.col("l_quantity")
    line = table(spark, sf_dir, "lineitem").select(*RID).join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = line.where("p_brand is not null and n_name is not null and l_quantity is not null").withColumn("dealt", part_of(line, "p_brand", "n_name", F.bround(t, 2))).select("dealt", "p_brand", "n_name", *RID).repartition("dealt")
    return rows.select("dealt", F.col("p_brand").alias("solute"), F.col("n_name").alias("solvent"), F.col("l_suppkey").alias("source"), t.alias("t"), _value("mix").alias("y"), *RID)


def _view(y: str) -> str:
    return f"""SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rid, p_brand AS solute, n_name AS solvent,
  cast(l_suppkey AS varchar) AS source, 273.15e0 + l_quantity AS t, {y} AS y, l_extendedprice / 200000e0 AS x, nullif(l_discount, 0e0) AS sigma,
  cast(l_linenumber AS bigint) AS seed, l_returnflag AS flag, cast(p_size AS double) AS weight, p_type AS kind
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""


RAW = _view("log10(l_extendedprice / 10000e0)")
MIX = _view("-2e0 + 2e-2 * l_quantity + (3e-2 + 25e-2 * (cast(substr(p_brand, 7, 10) AS int) % 5)) * log10(l_extendedprice / 10000e0)")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with doubles rounded, and without negative zeros, so that the order of sums doesn't show."""
    return df.select(*((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))


def rounded_sql(ctes: str, select: str, doubles: str = "", digits: int = 6, view: str = MIX) -> str:
    """The same in SQL. ctes: further named queries over m; doubles: the names of the columns to round."""
    names = doubles.split()
    replace = f" REPLACE ({', '.join(f'round({c}, {digits}) + 0e0 AS {c}' for c in names)})" if names else ""
    return f"WITH m AS ({view}){', ' + ctes if ctes else ''} SELECT *{replace} FROM ({select})"
