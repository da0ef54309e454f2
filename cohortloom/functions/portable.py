"""Column builders whose values can be repeated by any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Hart's rational approximation of the normal distribution
# function (double precision), coefficients from the highest power down.
CDF_NUMERATOR = (
    0.0352624965998911,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
CDF_DENOMINATOR = (
    0.0883883476483184,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
CDF_REACH = 7.07106781186547
SQRT_TWO_PI = 2.50662827463100


def dbl(value: float) -> Column:
    return F.lit(float(value))


def round6(col) -> Column:
    return F.round(col, 6)


def round9(col) -> Column:
    return F.round(col, 9)


def sigmoid(margin) -> Column:
    return dbl(1) / (dbl(1) + F.exp(-margin))


def is_zero(col, const: float = 0.001) -> Column:
    """True where a log2 value stands for a measured zero."""
    return F.round(col, 6) == F.round(F.log2(dbl(const)), 6)


def hash48(*cols) -> Column:
    """A whole number below 2**48 from the md5 of the joined columns."""
    text = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def unit_hash(*cols) -> Column:
    """A reproducible uniform number in [0, 1)."""
    return hash48(*cols).cast("double") / dbl(2**48)


def draw_index(size, *cols) -> Column:
    """A reproducible whole number in [0, size)."""
    return F.pmod(hash48(*cols), size)


def _polynomial(coefficients, x: Column) -> Column:
    out = dbl(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + dbl(c)
    return out


def normal_cdf(z: Column) -> Column:
    x = F.abs(z)
    tail = F.when(
        x < dbl(CDF_REACH),
        F.exp(-x * x / dbl(2)) * _polynomial(CDF_NUMERATOR, x) / _polynomial(CDF_DENOMINATOR, x),
    ).otherwise(dbl(0))
    return F.when(z > 0, dbl(1) - tail).otherwise(tail)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / dbl(2)) / dbl(SQRT_TWO_PI)


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A handful of parameter rows as an in-plan relation (exact statistics)."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)

    names = [part.split()[0] for part in schema.split(",")]
    types = [part.split()[1] for part in schema.split(",")]
    values = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(names)})")
