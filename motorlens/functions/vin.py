"""Vehicle identification numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Place weights of ISO 3779, and values of the letters.
WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VALUES = {
    "A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7, "H": 8, "J": 1, "K": 2, "L": 3, "M": 4, "N": 5, "P": 7, "R": 9, "S": 2, "T": 3, "U": 4, "V": 5, "W": 6, "X": 7, "Y": 8, "Z": 9,
    "0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 6, "7": 7, "8": 8, "9": 9,
}
_ALPHABET = "".join(VALUES)
_MAPPED = "".join(str(v) for v in VALUES.values())


def normal(vin) -> Column:
    """Upper case without white space; null unless 17 characters are left."""
    x = F.upper(F.regexp_replace(vin, r"\s+", ""))
    return F.when(F.octet_length(x) == 17, x)


def _weighed(digits: Column) -> Column:
    """Weighed sum of the places; null unless there are 17. A short expression: seventeen spelled-out places would make
    generated methods that the JVM no longer compiles."""
    parts = F.zip_with(F.split(digits, ""), F.array(*map(F.lit, WEIGHTS)), lambda c, w: (F.ascii(c) - 48) * w)
    return F.aggregate(parts, F.lit(0), lambda total, x: total + x) % 11


def _fits(vin: Column, total: Column) -> Column:
    x = F.upper(vin)
    want = F.when(total == 10, F.lit("X")).otherwise(total.cast("string"))
    return F.coalesce((F.octet_length(vin) == 17) & x.rlike("^[A-HJ-NPR-Z0-9]{17}$") & (F.substring(x, 9, 1) == want), F.lit(False))


def check_ok(vin) -> Column:
    """17 bytes of allowed characters whose check digit fits; letters become digits by ``translate``."""
    return _fits(vin, _weighed(F.translate(F.upper(vin), _ALPHABET, _MAPPED)))


def with_check(df: DataFrame, column: str, out: str) -> DataFrame:
    """``check_ok`` as a column, in steps that are each made once for a row (for use beside many other expressions)."""
    stepped = df.withColumn("__digits", F.translate(F.upper(column), _ALPHABET, _MAPPED)).withColumn("__weighed", _weighed(F.col("__digits")))
    return stepped.withColumn(out, _fits(F.col(column), F.col("__weighed"))).drop("__digits", "__weighed")


def masked(vin) -> Column:
    return F.concat(F.lit("***"), F.right(vin, F.lit(4)))


def masked_end(vin) -> Column:
    """For logs: the last four characters hidden; of a short one all."""
    x = F.trim(vin)
    shown = F.greatest(F.length(x) - 4, F.lit(0))
    return F.concat(F.substring(x, F.lit(1), shown), F.repeat(F.lit("*"), F.length(x) - shown))


def model_year(vin) -> Column:
    """Year of the tenth character: letters from 2010 on, digits 2001 to 2009; null if it names none."""
    at = F.position(F.substring(F.upper(vin), 10, 1), F.lit("123456789ABCDEFGHJKLMNPRSTVWXY"))
    return F.when((F.length(vin) == 17) & (at > 0), at + 2000)


def parts(vin) -> Column:
    """Maker's code, plant and serial number; null unless there are 17 characters."""
    x = F.upper(F.trim(vin))
    return F.when(F.length(x) == 17, F.struct(F.substring(x, 1, 3).alias("wmi"), F.substring(x, 11, 1).alias("plant"), F.substring(x, 12, 6).alias("serial")))
