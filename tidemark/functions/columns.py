"""Column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical status by carrier code.
STATUS = {
    "OC": "CREATED",
    "IN": "IN_TRANSIT",
    "DL": "DELIVERED",
    "DE": "EXCEPTION",
    "HD": "HELD",
    "transit": "IN_TRANSIT",
    "delivered": "DELIVERED",
    "failure": "EXCEPTION",
    "customs": "CUSTOMS_HOLD",
    "gate_in": "PORT_GATE_IN",
    "loaded": "VESSEL_LOADED",
    "discharged": "VESSEL_DISCHARGED",
    "gate_out": "PORT_GATE_OUT",
    "AT_RISK": "AT_RISK",
    "DELAYED": "DELAYED",
}
#: Carriers by mode, and incoterms that pass the risk on at the origin.
OCEAN = ("MAERSK", "MSC", "CMA_CGM", "EVERGREEN")
PARCEL = ("FEDEX", "DHL", "UPS", "TNT")
ORIGIN_RISK = ("EXW", "FCA", "FAS", "FOB")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp01(c: str | Column) -> Column:
    """Into [0, 1]; greatest and least skip nulls, so a null becomes the maximum, 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c)))


def currency(c: str | Column) -> Column:
    """A double from text with dollar signs, commas and spaces; null where that is no number."""
    return F.regexp_replace(col(c), r"[$,\s]", "").try_cast("double")


def whole(c: str | Column) -> Column:
    """An integer from text, fractions cut off; null where that is no number."""
    return col(c).try_cast("double").try_cast("int")


def truthy(c: str | Column) -> Column:
    """1 for Y, YES, 1 and TRUE in any case, else 0, also for null."""
    return F.when(F.upper(col(c)).isin("Y", "YES", "1", "TRUE"), 1).otherwise(0)


def canonical_status(c: str | Column) -> Column:
    """Looked up in upper case, then in lower case; UNKNOWN if neither is known."""
    known = F.create_map(*(F.lit(x) for pair in STATUS.items() for x in pair))
    return F.coalesce(known[F.upper(col(c))], known[F.lower(col(c))], F.lit("UNKNOWN"))


def transport_mode(c: str | Column) -> Column:
    return F.when(col(c).isin(*OCEAN), "OCEAN").when(col(c).isin(*PARCEL), "AIR_PARCEL").otherwise("TRUCK")


def ladder(c: str | Column, steps: tuple[tuple[float, str], ...], rest: str, closed: bool = True) -> Column:
    """The first label whose bound the value reaches (or, if not ``closed``, is above), else ``rest``, also for null."""
    out = None
    for bound, label in steps:
        test = col(c) >= bound if closed else col(c) > bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(rest)


def geo_tier(c: str | Column) -> Column:
    return ladder(c, ((0.75, "CRITICAL"), (0.50, "HIGH"), (0.25, "MEDIUM")), "LOW")


def gold_tier(c: str | Column) -> Column:
    return ladder(c, ((0.7, "CRITICAL"), (0.4, "HIGH"), (0.2, "MEDIUM")), "LOW")


def model_tier(c: str | Column) -> Column:
    """Bounds belong to the lower tier; 0 and null have none."""
    return F.when(col(c) > 0, ladder(c, ((0.75, "CRITICAL"), (0.50, "HIGH"), (0.25, "MEDIUM")), "LOW", closed=False))


def weighted(**parts: float) -> Column:
    """Sum of columns by weight; null if one of them is."""
    total = None
    for name, weight in parts.items():
        term = F.col(name) * F.lit(float(weight))
        total = term if total is None else total + term
    return total


def rounded(c: str | Column, digits: int, signed: bool = False) -> Column:
    """A double to some decimals, ties of its product with 10^digits away from zero, as the SQL twins round.

    Spark's own ``round`` goes by the shortest decimal text, so 1.000005 ends in a tie there, though the number lies below it. A zero from below is
    -0.0 with ``signed``, as its text shows, else 0.0.
    """
    scale = float(10**digits)
    found = F.round(col(c) * scale) / scale
    return F.when(col(c) < 0, -F.abs(found)).otherwise(found) if signed else found


def printed(c: str | Column, digits: int) -> Column:
    """The double whose text at ``digits`` decimals is what C's printf gives for ``c``: the exact binary value, ties to even.

    Java's formatter rounds the shortest decimal text half up. The number is cut in two halves, whose products with 10^digits
    are exact, so the side of the tie it lies on is known.
    """
    x, scale = F.abs(col(c).cast("double")), float(10**digits)
    wide = x * 134217729.0  # 2^27 + 1
    high = wide - (wide - x)
    whole = F.floor(x * scale).cast("double")
    beyond = (high * scale - (whole + 0.5)) + (x - high) * scale
    up = (beyond > 0) | (beyond == 0) & (whole % 2 == 1)
    size = F.when(up, whole + 1).otherwise(whole) / scale
    return F.when(col(c).cast("double").cast("string").startswith("-"), -size).otherwise(size)  # -0.0 keeps its sign
