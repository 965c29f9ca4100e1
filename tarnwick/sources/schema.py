"""Schemas of the measurement tables, and how columns of other generations of files map to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_MEASUREMENTS = T.StructType([
    T.StructField("SMILES_Solute", T.StringType()), T.StructField("SMILES_Solvent", T.StringType()), T.StructField("Solvent", T.StringType()),
    T.StructField("Temperature_K", T.DoubleType()), T.StructField("Solubility(mole_fraction)", T.DoubleType()), T.StructField("LogS(mol/L)", T.DoubleType()),
    T.StructField("Compound_Name", T.StringType()), T.StructField("CAS", T.StringType()), T.StructField("PubChem_CID", T.StringType()),
    T.StructField("FDA_Approved", T.StringType()), T.StructField("Source", T.StringType()),
])
DENSITIES = T.StructType([T.StructField("Solvent", T.StringType()), T.StructField("Temperature_K", T.DoubleType()), T.StructField("Density_g/cm^3", T.StringType())])
DENSITY_COEFFICIENTS = T.StructType([T.StructField("Solvent", T.StringType()), T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
CLEANED = T.StructType([
    T.StructField("Solute", T.StringType()), T.StructField("Solvent", T.StringType()), T.StructField("Solvent_Name", T.StringType()),
    T.StructField("Temperature", T.DoubleType()), T.StructField("LogS", T.DoubleType()), T.StructField("Solubility(mole_fraction)", T.DoubleType()),
    T.StructField("MW", T.DoubleType()), T.StructField("Compound_Name", T.StringType()), T.StructField("CAS", T.StringType()),
    T.StructField("PubChem_CID", T.StringType()), T.StructField("FDA_Approved", T.StringType()), T.StructField("Source", T.StringType()),
])


def resolve(df: DataFrame, candidates: list[str]) -> str:
    """The first of several possible names that the table has."""
    found = next((c for c in candidates if c in df.columns), None)
    if found is None:
        raise ValueError(f"none of {candidates} is a column; there are {df.columns}")
    return found


def standardise(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """df with each resolved column under its standard name; others stay. Where a standard name is already taken by a
    column that isn't chosen, that column goes."""
    chosen = {resolve(df, found): name for name, found in names.items()}
    rest = [c for c in df.columns if c not in chosen and c not in names]
    return df.select(*(F.col(f"`{old}`").alias(new) for old, new in chosen.items()), *(F.col(f"`{c}`") for c in rest))


def require(df: DataFrame, columns: set[str]) -> DataFrame:
    """df itself, or an error that names the missing columns."""
    if missing := sorted(columns - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """df with null for NaN in every floating column, so that comparisons and aggregates leave such values out."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns))
