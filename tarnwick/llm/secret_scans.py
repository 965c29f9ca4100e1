"""Secret scans with linked parts of credentials. DataFrame functions only.

Strong kinds are reported wherever they stand: ``assign`` (a password, secret, token or API key that is assigned),
``access`` (an access key id) and ``hex`` (a long run of hexadecimal digits). Weak kinds are ordinary on their own and
are reported only beside their complements, by an interval join of the document's spans: ``key`` (a mixed token of
32 characters or more) within SCOPE characters of an access id, and ``endpoint`` (a url) within SCOPE of both an access id and a
secret part (assign, hex or a linked key). Offsets count code points; ends are exclusive.

A document is the outer scope, so nothing is shuffled: the join is a sweep over the document's spans in order of their starts. One running
maximum from the front carries the farthest end of a complement so far, one from the back its nearest start to come, and a weak part has a complement in reach
if either is. Running totals are taken in blocks of about the root of their number, as an array that grows by one element at a time is copied each time:
the work grows with the number of matches to the power of one and a half.

Cases: a null or empty text has no spans. Repeated rows are scanned each by itself. Columns named like the outputs are
replaced by ``secret_scan``; all others pass through, and ``redact`` changes no column but the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.columns import unused

#: Characters between two parts of one credential, at most.
SCOPE = 400

# Fixed patterns of the contract; letters of the names in either case, ASCII only.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs of digits never overlap, so short runs needn't be matched first
KEY = r"[A-Za-z0-9/+]{32,}"
ENDPOINT = r"https?://[^\x00-\x20\"'<>]+"

ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: Kinds in the order of the listing.
KINDS = ["assign", "access", "hex", "key", "endpoint"]

_SPAN = "struct<start:bigint,rank:int,end:bigint>"
_NONE = f"array<{_SPAN}>"
_FAR = 1 << 60


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is computed once, however often ``of`` names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _blocks(xs: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` each block of about the root of the array's number of elements; one empty block of an empty array."""

    def cut(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int"))), lambda k: _bound(F.slice(v, k * width + 1, width), of))

    return _bound(xs, cut)


def _running(xs: Column, plus: Callable[[Column, Column], Column], zero: int) -> Column:
    """The running totals of an array of numbers: totals within blocks first, then what stands before each block."""
    begin = F.struct(F.lit(zero).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def scan(part: Column) -> Column:
        return F.aggregate(part, begin, lambda acc, x: F.struct(plus(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(plus(acc["at"], x))).alias("out")))

    def carry(blocks: Column) -> Column:
        before = F.aggregate(blocks, begin, lambda acc, b: F.struct(plus(acc["at"], b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, before, lambda b, o: F.transform(b["out"], lambda x: plus(o, x))))

    return _bound(_blocks(xs, scan), carry)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _spans(rows: DataFrame, text: str, pattern: str, rank: int, out: str, keep=None, where: Column | None = None) -> DataFrame:
    """rows with the spans of the leftmost non-overlapping matches, those for which ``keep`` holds. The pieces between the matches give the offsets."""
    t = F.col(text)
    some = t.rlike(pattern) if where is None else where & t.rlike(pattern)
    pairs, ends = unused(rows.columns, "pairs", "ends")
    found, between = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
    gaps = F.slice(F.transform(between, lambda p: F.length(p)), 1, F.size(found))
    zipped = F.arrays_zip(F.transform(found, lambda m: F.length(m).cast("long")).alias("n"), gaps.alias("gap"), found.alias("m"))
    rows = rows.withColumn(pairs, F.when(some, zipped))
    rows = rows.withColumn(ends, F.when(F.col(pairs).isNotNull(), _running(F.transform(pairs, lambda x: x["n"] + x["gap"]), _sum, 0)))
    placed = F.zip_with(pairs, ends, lambda x, e: F.struct((e - x["n"]).alias("start"), e.alias("end"), x["m"].alias("m")))
    if keep is not None:
        placed = F.filter(placed, lambda x: keep(x["m"]))
    spans = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))
    return rows.withColumn(out, F.coalesce(spans, F.array().cast(_NONE))).drop(pairs, ends)


def _near(rows: DataFrame, weak: str, strong: str, out: str, reach: int, beside: bool = True) -> DataFrame:
    """rows with those of ``weak``'s spans that have (or, not ``beside``, have not) one of ``strong``'s within ``reach`` characters (0: touching, -1: sharing one): the sweep."""
    both, before, after = unused(rows.columns, "both", "before", "after")
    one = lambda side: lambda x: F.struct(x["start"].alias("start"), F.lit(side).alias("side"), x["end"].alias("end"), x["rank"].alias("rank"))
    rows = rows.withColumn(both, F.when((F.size(weak) > 0) & (F.size(strong) > 0), F.array_sort(F.concat(F.transform(weak, one(1)), F.transform(strong, one(0))))))
    ends = F.transform(both, lambda x: F.when(x["side"] == 0, x["end"]).otherwise(F.lit(-_FAR)))
    starts = F.reverse(F.transform(both, lambda x: F.when(x["side"] == 0, x["start"]).otherwise(F.lit(_FAR))))
    some = F.col(both).isNotNull()
    rows = rows.withColumns({before: F.when(some, _running(ends, F.greatest, -_FAR)), after: F.when(some, F.reverse(_running(starts, F.least, _FAR)))})
    zipped = F.arrays_zip(F.col(both).alias("x"), F.col(before).alias("b"), F.col(after).alias("a"))
    held = F.filter(zipped, lambda z: (z["x"]["side"] == 1) & (((z["b"] + reach >= z["x"]["start"]) | (z["a"] <= z["x"]["end"] + reach)) == beside))
    spans = F.transform(held, lambda z: F.struct(z["x"]["start"].alias("start"), z["x"]["rank"].alias("rank"), z["x"]["end"].alias("end")))
    none = F.array().cast(_NONE)
    return rows.withColumn(out, F.coalesce(spans, none if beside else F.col(weak))).drop(both, before, after)


def _listing(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _scan(docs: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """docs with the spans by kind, the strong ones and all, under the names given for assign, access, hex, strong and found."""
    assign, access, hexa, strong, found = (names[k] for k in ("assign", "access", "hex", "strong", "found"))
    t, key, endpoint, own, linked, secret, ends = unused([*docs.columns, *names.values()], "t", "key", "endpoint", "own", "linked", "secret", "ends")
    rows = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    rows = _spans(rows, t, ASSIGN, 0, assign, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST)
    rows = _spans(rows, t, ACCESS, 1, access, lambda m: F.length(m) >= ACCESS_LEAST)
    rows = _spans(rows, t, HEX, 2, hexa)
    any_access = F.size(access) > 0  # without an access id no weak part can be linked
    rows = _spans(rows, t, KEY, 3, key, lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"), any_access)
    rows = _spans(rows, t, ENDPOINT, 4, endpoint, where=any_access)
    rows = rows.withColumn(strong, F.array_sort(F.concat(assign, access, hexa)))
    rows = _near(rows, key, strong, own, -1, beside=False)  # a key that shares a character with a strong part is that part
    rows = _near(rows, own, access, linked, SCOPE)
    rows = rows.withColumn(secret, F.concat(assign, hexa, linked))
    rows = _near(_near(rows, endpoint, access, ends, SCOPE), ends, secret, ends, SCOPE)
    return rows.withColumn(found, F.array_sort(F.concat(strong, linked, ends))).drop(t, key, endpoint, own, linked, secret, ends)


def secret_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base (listing of the strong spans), spans (listing of all) and found (array of all)."""
    rows = docs.drop("n_assign", "n_access", "n_hex", "base", "spans", "found")
    names = dict(zip(("assign", "access", "hex", "strong"), unused([*rows.columns, "found"], "assign", "access", "hex", "strong"), strict=True)) | {"found": "found"}
    rows = _scan(rows, text, names)
    rows = rows.withColumns({f"n_{kind}": F.size(names[kind]).cast("long") for kind in ("assign", "access", "hex")} | {"base": _listing(F.col(names["strong"])), "spans": _listing(F.col("found"))})
    return rows.drop(*(names[k] for k in ("assign", "access", "hex", "strong"))).select(*rows.drop(*names.values()).columns, "found")


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs whose texts have each maximal run of secret characters replaced by ``mark``; other columns stay. A null text stays null."""
    kinds = ("assign", "access", "hex", "strong", "found")
    *made, upto, cuts = unused(docs.columns, *kinds, "upto", "cuts")
    names = dict(zip(kinds, made, strict=True))
    found, t = F.col(names["found"]), F.col(text)
    rows = _scan(docs, text, names)
    rows = rows.withColumn(upto, _running(F.transform(found, lambda x: x["end"]), F.greatest, 0))
    # a run begins where a span starts beyond all before it, and what stands between is kept
    before = F.concat(F.array(F.lit(-1).cast("long")), F.slice(upto, 1, F.greatest(F.lit(0), F.size(upto) - 1)))
    runs = F.filter(F.arrays_zip(before.alias("from"), F.transform(found, lambda x: x["start"]).alias("to")), lambda x: x["from"] < x["to"])
    rows = rows.withColumn(cuts, F.transform(runs, lambda x: F.struct(F.greatest(x["from"], F.lit(0)).alias("from"), x["to"].alias("to"))))

    def of(part: Column) -> Column:
        """The texts between the runs of a block: the block's stretch is cut out once, as finding a character counts from the front."""
        low, high = F.element_at(part, 1)["from"], F.element_at(part, -1)["to"]
        stretch = F.substring(t, (low + 1).cast("int"), (high - low).cast("int"))
        return _bound(stretch, lambda s: F.array_join(F.transform(part, lambda x: F.concat(F.substring(s, (x["from"] - low + 1).cast("int"), (x["to"] - x["from"]).cast("int")), F.lit(mark))), ""))

    end = F.element_at(upto, -1)
    cut = F.concat(F.array_join(_blocks(F.col(cuts), of), ""), F.substring(t, (end + 1).cast("int"), F.lit((1 << 31) - 1)))
    return rows.withColumn(text, F.when(F.size(found) > 0, cut).otherwise(t)).drop(*made, upto, cuts)
