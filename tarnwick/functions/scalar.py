"""Column expressions: unit conversions, curves, rounding, text and array helpers. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_solubility(x: Column, density: Column, weight: Column) -> Column:
    """log10 of mol/L from a mole fraction, by the solvent's density (g/cm3) and molar mass; null outside 0 < x < 1 or without a positive density."""
    fine = (x > 0) & (x < 1) & (density > 0) & (weight > 0)
    return F.when(fine, F.log10(x / F.when(x < 1, 1 - x) * density * 1000 / F.when(weight > 0, weight)))


def log_solubility_dilute(x: Column, density: Column, weight: Column) -> Column:
    """The older form, log10(x / (weight / density))."""
    return F.when((x > 0) & (density > 0) & (weight > 0), F.log10(x / (F.when(weight > 0, weight) / F.when(density > 0, density))))


def decimal_comma(text: Column) -> Column:
    """A number whose decimal mark may be a comma; null if it is none."""
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def name_key(text: Column) -> Column:
    return F.lower(F.trim(text))


def number(text: Column) -> Column:
    """A number, or null where the text is none."""
    return text.try_cast("double")


def apelblat(t: Column, a: Column, b: Column, c: Column) -> Column:
    return a + b / t + c * F.ln(t)


def vanthoff(t: Column, a: Column, b: Column) -> Column:
    return a + b / t


def half_width(t: Column, caa: Column, cab: Column, cac: Column, cbb: Column, cbc: Column, ccc: Column) -> Column:
    """Half the 95 % interval of a fitted curve at t, from the six entries of the parameters' covariance."""
    u, w = 1 / t, F.ln(t)
    return 1.96 * F.sqrt(F.greatest(F.lit(0.0), caa + 2 * u * cab + 2 * w * cac + u * u * cbb + 2 * u * w * cbc + w * w * ccc))


def significant_digits(x: Column) -> Column:
    """Digits of the number as printed with ten significant ones, without leading and trailing zeros; 0 for zero."""
    mantissa = F.regexp_replace(F.split(F.format_string("%.9e", F.abs(x)), "e")[0], r"\.", "")
    return F.when(x.isNotNull(), F.length(F.rtrim(mantissa, F.lit("0"))))


def is_round(x: Column, digits: int) -> Column:
    """Whether x is a number of so many significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(F.when(x != 0, x)))))
    return F.coalesce(F.abs(F.rint(x * scale) / scale - x) <= 1e-12 * F.abs(x), x == 0)


def temperature_features(t: Column) -> list[Column]:
    """T/300, 1000/T, (T/300)^2 and ln(T/300)."""
    r = t / 300
    return [r.alias("t_ratio"), (1000 / t).alias("t_inverse"), (r * r).alias("t_square"), F.ln(r).alias("t_log")]


def reduced_temperature(t: Column, melting: Column) -> list[Column]:
    return [F.try_divide(t, melting).alias("t_reduced"), (1000 / t).alias("t_inverse")]


def finite(x: Column, other: float = 0.0) -> Column:
    """x, or ``other`` where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), other).otherwise(x)


def block_interaction(array: Column, block: int, t: Column) -> Column:
    """For each block of an array: the sign of its mean times its length as a vector, times 1000 / t."""
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(array) - 1) / block).cast("int")))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(at, lambda k: F.signum(total(F.slice(array, k * block + 1, block))) * norm(F.slice(array, k * block + 1, block)) * 1000 / t)


def free_energy(terms: list[tuple[Column, Column]], constant: Column) -> Column:
    """A linear free-energy relation: the constant plus the products of coefficients and descriptors."""
    out = constant
    for coefficient, descriptor in terms:
        out = out + coefficient * descriptor
    return out


def joined_set(column: Column, mark: str = "|") -> Column:
    """The sorted distinct values of a group as one text."""
    return F.array_join(F.array_sort(F.collect_set(column)), mark)


def prefix_class(name: Column, classes: dict[str, str], other: str) -> Column:
    """The class of the first prefix that the name has."""
    out = F.lit(other)
    for prefix, label in reversed(classes.items()):
        out = F.when(name.startswith(prefix), label).otherwise(out)
    return out


def json_object(text: Column) -> Column:
    """What stands from the first { to the last }, or an empty object."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise("{}")


def key_of(mark: str, *parts: Column | str) -> Column:
    return F.concat_ws(mark, *parts)


def alias_name(name: Column, aliases: dict[str, str]) -> Column:
    """The standard name of an alias, else the name itself."""
    if not aliases:
        return name
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(table[name], name)


def template(text: str, **values: Column) -> Column:
    """A text with ``{name}`` replaced by columns; a null value becomes an empty text."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
