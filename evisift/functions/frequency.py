"""Frequency strings: parsing, validity and the planning estimate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequency category code -> (lower, upper).
CATEGORY_BOUNDS = {
    "HP:0040280": (1.0, 1.0),
    "HP:0040281": (0.80, 0.99),
    "HP:0040282": (0.30, 0.79),
    "HP:0040283": (0.05, 0.29),
    "HP:0040284": (0.01, 0.04),
    "HP:0040285": (0.0, 0.0),
}
EXCLUDED_CATEGORY = "HP:0040285"

# Numeric frequency id of the association files -> category code.
NUMERIC_FREQUENCY = {
    "28405": "HP:0040280",
    "28412": "HP:0040281",
    "28419": "HP:0040282",
    "28426": "HP:0040283",
    "28433": "HP:0040284",
    "28440": "HP:0040285",
}

FREQUENCY_TYPE = (
    "struct<kind:string,raw:string,numerator:bigint,denominator:bigint,"
    "lower:double,upper:double,category:string>"
)

# A share is digits with an optional decimal part; blanks may stand between the parts of a frequency.
_SHARE = r"([0-9]+(?:\.[0-9]+)?)"
_COUNT = r"\A([0-9]+)\s*/\s*(0*[1-9][0-9]*)\z"
_PERCENT = rf"\A{_SHARE}\s*%\z"
_RANGE = rf"\A{_SHARE}\s*[-\x{{2013}}]\s*{_SHARE}\s*%\z"


def _bounds(category: Column, index: int) -> Column:
    expr = F.lit(None).cast("double")
    for code, bounds in CATEGORY_BOUNDS.items():
        expr = F.when(category == code, F.lit(bounds[index])).otherwise(expr)
    return expr


def _struct(kind, raw, numerator=None, denominator=None, lower=None, upper=None, category=None):
    null = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"),
        raw.alias("raw"),
        (null if numerator is None else numerator).cast("bigint").alias("numerator"),
        (null if denominator is None else denominator).cast("bigint").alias("denominator"),
        (null if lower is None else lower).cast("double").alias("lower"),
        (null if upper is None else upper).cast("double").alias("upper"),
        (null if category is None else category).cast("string").alias("category"),
    )


def strip_blanks(text: Column) -> Column:
    """Text without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def parse_frequency(raw: Column) -> Column:
    """Struct for a frequency string; kind ``invalid`` marks text that must be refused, counts beyond 64 bits among it."""
    value = strip_blanks(raw)
    k = F.regexp_extract(value, _COUNT, 1).try_cast("bigint")
    n = F.regexp_extract(value, _COUNT, 2).try_cast("bigint")
    ratio = F.try_divide(k.cast("double"), n.cast("double"))
    point = F.regexp_extract(value, _PERCENT, 1).try_cast("double") / 100
    low = F.regexp_extract(value, _RANGE, 1).try_cast("double") / 100
    high = F.regexp_extract(value, _RANGE, 2).try_cast("double") / 100
    category = value.isin(*CATEGORY_BOUNDS)
    parsed = (
        F.when(raw.isNull() | (value == ""), _struct("missing", raw))
        .when(
            value == EXCLUDED_CATEGORY,
            _struct("excluded", raw, lower=F.lit(0.0), upper=F.lit(0.0), category=value),
        )
        .when(
            category,
            _struct("category", raw, lower=_bounds(value, 0), upper=_bounds(value, 1), category=value),
        )
        .when(value.rlike(_COUNT) & k.isNotNull() & n.isNotNull(), _struct("count", raw, k, n, ratio, ratio))
        .when(value.rlike(_PERCENT), _struct("percentage", raw, lower=point, upper=point))
        .when(value.rlike(_RANGE), _struct("interval", raw, lower=low, upper=high))
        .otherwise(_struct("invalid", raw))
    )
    return parsed


def is_valid(freq: Column) -> Column:
    """Kind-specific invariants; False also for text no rule could read."""
    kind, lower, upper = freq["kind"], freq["lower"], freq["upper"]
    k, n, category = freq["numerator"], freq["denominator"], freq["category"]
    ordered = lower.isNotNull() & upper.isNotNull() & (lower <= upper) & (lower >= 0) & (upper <= 1)
    no_counts = k.isNull() & n.isNull()
    coded = (lower == _bounds(category, 0)) & (upper == _bounds(category, 1))
    return F.coalesce(
        F.when(
            kind == "missing",
            lower.isNull() & upper.isNull() & no_counts & category.isNull(),
        )
        .when(
            kind == "count",
            ordered & (n > 0) & (k >= 0) & (k <= n) & category.isNull()
            & (lower == k / n) & (upper == lower),
        )
        .when(kind == "percentage", ordered & no_counts & category.isNull() & (lower == upper))
        .when(kind == "interval", ordered & no_counts & category.isNull())
        .when(kind == "category", ordered & no_counts & coded)
        .when(kind == "excluded", ordered & no_counts & coded & (category == EXCLUDED_CATEGORY))
        .otherwise(F.lit(False)),
        F.lit(False),
    )


def estimate(freq: Column) -> Column:
    """Smoothed count, interval midpoint, or NULL when nothing is known."""
    k, n = freq["numerator"].cast("double"), freq["denominator"].cast("double")
    return (
        F.when(freq["kind"] == "count", (k + 1) / (n + 2))
        .when(freq["kind"].isin("missing", "invalid"), F.lit(None).cast("double"))
        .otherwise((freq["lower"] + freq["upper"]) / 2)
    )


def association_frequency(
    negated: Column, count: Column, total: Column, percentage: Column
) -> Column:
    """Frequency of a graph association row: negation, then k/n, then percent, else NULL."""
    ratio = F.try_divide(count.cast("double"), total.cast("double"))
    raw_count = F.concat_ws("/", count.cast("string"), total.cast("string"))
    raw_percent = F.concat(percentage.cast("string"), F.lit("%"))
    return (
        F.when(
            negated,
            _struct(
                "excluded", F.lit(EXCLUDED_CATEGORY), lower=F.lit(0.0), upper=F.lit(0.0),
                category=F.lit(EXCLUDED_CATEGORY),
            ),
        )
        .when(
            count.isNotNull() & (total > 0) & (count <= total),
            _struct("count", raw_count, count, total, ratio, ratio),
        )
        .when(
            percentage.between(0, 100),
            _struct("percentage", raw_percent, lower=percentage / 100, upper=percentage / 100),
        )
        .otherwise(F.lit(None).cast(FREQUENCY_TYPE))
    )


def numeric_category(code: Column) -> Column:
    """Category code for a numeric frequency id, NULL when the id is unknown."""
    table = F.create_map(*[F.lit(x) for pair in NUMERIC_FREQUENCY.items() for x in pair])
    return F.try_element_at(table, code)
