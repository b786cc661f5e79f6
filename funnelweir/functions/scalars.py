"""Column expressions for ids, timestamps, numbers, prices and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: text shown for a missing part of a position key
MISSING_PART = "nan"
# fixed values: texts read as true
TRUE_TEXTS = ["true", "1", "1.0", "yes"]
# fixed values: label cleaning steps, in order
COMPONENT_MARKS = ["res_", "__reverse_gs_pure", "__gs_pure", "_calibrated", "_calib", "atomic_"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c) -> Column:
    return _col(c).try_cast("double")


def safe_double(c, fill: float | None = None) -> Column:
    """Number or NULL; infinities and NaN become NULL, then ``fill``."""
    x = as_double(c)
    finite = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    return finite if fill is None else F.coalesce(finite, F.lit(float(fill)))


def clean_id(c) -> Column:
    return F.trim(_col(c).cast("string"))


def clean_item_id(c) -> Column:
    """Trim, drop a ``.0`` tail and leading zeros; an all-zero id becomes empty."""
    return F.regexp_replace(F.regexp_replace(clean_id(c), r"\.0$", ""), "^0+", "")


def clean_item_id_keep_zero(c) -> Column:
    """As :func:`clean_item_id`, but an all-zero id stays ``0``."""
    cleaned = clean_item_id(c)
    return F.when(cleaned == "", F.lit("0")).otherwise(cleaned)


def normalize_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: clean_item_id(c) if c == "item_id" else clean_id(c) for c in present})


def numeric_timestamp(c) -> Column:
    """The number itself, else the parsed date as epoch seconds."""
    text = _col(c).cast("string")
    return F.coalesce(text.try_cast("double"), F.unix_timestamp(F.try_to_timestamp(text)).cast("double"))


def date_number(ts: Column) -> Column:
    """Timestamp or date to a YYYYMMDD number, without string formatting."""
    return F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)


def day_key(c) -> Column:
    """YYYYMMDD number from a day number, epoch seconds, epoch milliseconds or date text (UTC)."""
    text = _col(c).cast("string")
    x = text.try_cast("double")
    whole = x.try_cast("bigint")
    return (
        F.when(x.between(19000101, 21001231), x)
        .when(x >= 1e11, date_number(F.timestamp_millis(whole)))
        .when((x >= 1e8) & (x < 1e11), date_number(F.timestamp_seconds(whole)))
        .otherwise(date_number(F.try_to_timestamp(text)))
        .cast("double")
    )


def epoch_day_text(c) -> Column:
    """Epoch seconds or milliseconds to YYYYMMDD text; anything else is 19700101."""
    x = safe_double(c)
    seconds = F.when(x > 1e11, x / 1000.0).otherwise(x)
    # the bound keeps the timestamp conversion inside its valid range
    valid = F.when(F.abs(seconds) < 2.5e11, seconds)
    return F.coalesce(F.date_format(F.timestamp_seconds(valid), "yyyyMMdd"), F.lit("19700101"))


def any_positive(*cols) -> Column:
    """1 if any of the flag or quantity columns is above zero."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | (F.coalesce(as_double(c), F.lit(0.0)) > 0)
    return hit.cast("int")


def position_key(module, slot) -> Column:
    parts = [F.coalesce(_col(p).cast("string"), F.lit(MISSING_PART)) for p in (module, slot)]
    return F.concat_ws("_", *parts)


def parse_price(c) -> Column:
    """First run of digits and dots, as a number if it is one."""
    return F.regexp_extract(_col(c).cast("string"), "[0-9.]+", 0).try_cast("double")


def is_true_text(c) -> Column:
    return F.coalesce(F.lower(F.trim(_col(c).cast("string"))).isin(TRUE_TEXTS), F.lit(False))


def clean_component_name(c) -> Column:
    name = _col(c)
    for mark in COMPONENT_MARKS:
        name = F.replace(name, F.lit(mark), F.lit(""))
    return F.when(name == "mkt_price", F.lit("a_pri")).otherwise(name)


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Bounded value; NULL stays NULL (``least`` and ``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), c)))


def rating_treatment(mean_rating) -> Column:
    """Mean rating 1..5 scaled to 0..1; no history counts as 3."""
    return clip((F.coalesce(_col(mean_rating), F.lit(3.0)) - 1) / 4)


def mask_without_history(value, level) -> Column:
    return F.when(F.coalesce(as_double(level), F.lit(0.0)) != 0, _col(value))


def dampen_high(value, threshold: float = 0.7, factor: float = 0.5) -> Column:
    return F.when(_col(value) > threshold, _col(value) * factor).otherwise(_col(value))


def raise_clipped(value, step: float = 0.1) -> Column:
    return clip(F.coalesce(_col(value), F.lit(0.0)) + step)


def best_image(images) -> Column:
    """URL of the MAIN image, else of the first one; high resolution preferred."""
    arr = _col(images)
    main = F.try_element_at(F.filter(arr, lambda i: i["variant"] == "MAIN"), F.lit(1))
    first = F.try_element_at(arr, F.lit(1))
    chosen = F.when(main.isNotNull(), main).otherwise(first)
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(chosen["hi_res"]), filled(chosen["large"]))


def require_columns(df: DataFrame, columns: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    banned = [c for c in forbidden if c in columns]
    if missing or banned:
        raise ValueError(f"missing columns {missing}, forbidden columns {banned}")
    return df
