"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens.schema import HIGH_RISK, MEDIUM_RISK

# --- Fixed values: band names and label wording (English re-wording) ---
BAND_HIGH = "High risk"
BAND_MEDIUM = "Medium risk"
BAND_LOW = "Low risk"
BIN_LABELS = ("Low", "Medium", "High")
LABEL_ACTIVE = "Active customer"
LABEL_LEFT = "Left (churned)"
# --- end of fixed values ---


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyed_hash(id_col: str | Column, seed: int | str = 42) -> Column:
    """First 8 hex digits of md5(id || ':' || seed) as a bigint in [0, 2^32)."""
    return F.conv(F.substring(F.md5(F.concat(_c(id_col).cast("string"), F.lit(f":{seed}"))), 1, 8),
                  16, 10).cast("bigint")


def keyed_uniform(id_col: str | Column, seed: int | str = 42) -> Column:
    """Keyed hash scaled to [0, 1): reproducible under any partitioning."""
    return keyed_hash(id_col, seed).cast("double") / F.lit(4294967296.0)


def risk_band(p: str | Column, hi: float = HIGH_RISK, lo: float = MEDIUM_RISK) -> Column:
    """SCR3: left-closed bands (>= hi high, >= lo medium, else low); null stays null."""
    p = _c(p)
    return (F.when(p >= hi, F.lit(BAND_HIGH)).when(p >= lo, F.lit(BAND_MEDIUM))
            .when(p.isNotNull(), F.lit(BAND_LOW)))


def risk_bin(p: str | Column) -> Column:
    """SCR4: right-closed bins (0,.4], (.4,.7], (.7,1]; 0 and outside -> null."""
    p = _c(p)
    return (F.when((p > 0.0) & (p <= 0.4), F.lit(BIN_LABELS[0]))
            .when((p > 0.4) & (p <= 0.7), F.lit(BIN_LABELS[1]))
            .when((p > 0.7) & (p <= 1.0), F.lit(BIN_LABELS[2])))


def predict_class(p: str | Column, cut: float = 0.5) -> Column:
    """SCR2: class 1 when the probability reaches the cut."""
    return (_c(p) >= F.lit(cut)).cast("int")


def label_text(y: str | Column) -> Column:
    """SCR5: 0 -> active, 1 -> left."""
    y = _c(y)
    return F.when(y == 0, F.lit(LABEL_ACTIVE)).when(y == 1, F.lit(LABEL_LEFT))


def fixed_text(x: str | Column, digits: int) -> Column:
    """STR2: fixed-decimal text. Rounding is done in decimal arithmetic (half away
    from zero), so the text does not depend on binary representation error."""
    return F.round(_c(x).cast("decimal(38,10)"), digits).cast(f"decimal(38,{digits})").cast("string")


def signed_text(x: str | Column, digits: int = 3) -> Column:
    """STR2: signed fixed-decimal text, '+' for values >= 0."""
    x = _c(x)
    body = fixed_text(x, digits)
    return F.when(F.round(x.cast("decimal(38,10)"), digits) >= 0, F.concat(F.lit("+"), body)).otherwise(body)


def percent_text(p: str | Column, digits: int = 1) -> Column:
    """STR1: '%' followed by the probability in percent with one decimal."""
    return F.concat(F.lit("%"), fixed_text(_c(p).cast("double") * F.lit(100.0), digits))


def squared_distance(a: str | Column, b: str | Column) -> Column:
    """MTH1 / ARR1: sum of squared element differences of two equal-length arrays."""
    diff = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")))
    return F.aggregate(diff, F.lit(0.0), lambda acc, d: acc + d * d)


#: White space of any script, as a character class that Java and RE2 both read.
SPACE = (r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def word_count(text: str | Column) -> Column:
    """STR6: number of whitespace-separated words."""
    return F.size(F.filter(F.split(_c(text), SPACE + "+"), lambda w: w != F.lit("")))


def strip_all(text: str | Column) -> Column:
    """STR7: remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(_c(text), f"^{SPACE}+|{SPACE}+$", "")
