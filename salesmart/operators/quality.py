"""Data-quality profile and cleaning of raw sales rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesmart.functions.dates import parse_date
from salesmart.functions.numeric import round_half_up
from salesmart.functions.rows import fingerprint
from salesmart.schema import KEY_FIELDS, SALE_COLUMNS

COPIES = "_copies"
CORRUPT = "_corrupt_record"

COUNTERS = [
    "total_rows",
    "null_any_key_field",
    "null_sales_quantity",
    "null_stock_quantity",
    "negative_sales",
    "negative_stock",
    "duplicate_rows",
]


def missing(df: DataFrame, name: str, value: Column | None = None) -> Column:
    """True where a field (or ``value`` in its place) holds no usable value: null, or a non-finite number."""
    value = F.col(name) if value is None else value
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        # NaN sorts above infinity, so this one test finds NaN and both infinities.
        return value.isNull() | (F.abs(value) >= F.lit(float("inf")))
    return value.isNull()


def _any_missing(df: DataFrame, fields: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (missing(df, f) for f in fields))


def _quantities_valid() -> Column:
    return (F.col("sales_quantity") >= 0) & (F.col("stock_quantity") >= 0)


def drop_missing(df: DataFrame, fields: Sequence[str] = KEY_FIELDS) -> DataFrame:
    return df.filter(~_any_missing(df, fields))


def drop_negative(df: DataFrame) -> DataFrame:
    return df.filter(_quantities_valid())


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Full-row distinct. Copies collapse map-side, so a much-copied row never moves whole."""
    return df.dropDuplicates()


def cast_quantities(df: DataFrame) -> DataFrame:
    """Quantities to int, truncating; values that do not fit become null."""
    return df.withColumns(
        {c: F.col(c).try_cast("int") for c in ("sales_quantity", "stock_quantity")}
    )


def _drop_uncastable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("sales_quantity").isNotNull() & F.col("stock_quantity").isNotNull())


def _sale_columns(df: DataFrame) -> DataFrame:
    return df.drop(CORRUPT)


def clean_sales(raw: DataFrame) -> DataFrame:
    """Rows with all key fields, no negative quantity, no copies, integer quantities.

    The row filters stand before the distinct (they commute with it), so only
    usable rows are shuffled.
    """
    return (
        _sale_columns(raw)
        .transform(drop_missing)
        .transform(drop_negative)
        .transform(drop_duplicates)
        .transform(cast_quantities)
        .transform(_drop_uncastable)
    )


def _conditions(df: DataFrame, values: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """What the counters between the row count and the duplicates count, for other ``values`` if given."""
    held = {f: F.col(f) for f in KEY_FIELDS} | {f: v for f, v in (values or {}).items() if f in KEY_FIELDS}
    absent = {f: missing(df, f, v) for f, v in held.items()}
    return {
        "null_any_key_field": reduce(lambda a, b: a | b, absent.values()),
        "null_sales_quantity": absent["sales_quantity"],
        "null_stock_quantity": absent["stock_quantity"],
        "negative_sales": held["sales_quantity"] < 0,
        "negative_stock": held["stock_quantity"] < 0,
    }


def _counters(conditions: dict[str, Column], weight: Column) -> dict[str, Column]:
    """The seven counters as aggregates over distinct rows, each standing for ``weight`` rows."""
    sums = {name: F.sum(F.when(c, weight)) for name, c in conditions.items()}
    sums = {"total_rows": F.sum(weight), **sums, "duplicate_rows": F.sum(weight - 1)}
    return {name: F.coalesce(total, F.lit(0)).cast("bigint") for name, total in sums.items()}


def _marks(conditions: dict[str, Column]) -> Column:
    """The conditions that a row meets, as the bits of one number."""
    bits = (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values()))
    return reduce(lambda a, b: a + b, bits)


def _marked(df: DataFrame, marks: str) -> dict[str, Column]:
    """The conditions read back from a column of marks."""
    return {name: F.col(marks).bitwiseAND(F.lit(1 << i)) != 0 for i, name in enumerate(_conditions(df))}


def _distinct_marks(df: DataFrame, **more: Column) -> DataFrame:
    """One short row per distinct row: its marks, copies and ``more`` numbers that follow from it.

    Rows are told apart by a 128-bit fingerprint, so no row is shuffled whole. Copies
    collapse map-side.
    """
    one, two = fingerprint([F.col(c) for c in df.columns])
    marks = _marks(_conditions(df)).alias("_marks")
    short = df.select(one.alias("_one"), two.alias("_two"), marks, *(c.alias(n) for n, c in more.items()))
    same = [F.max(n).alias(n) for n in ("_marks", *more)]  # equal among copies
    return short.groupBy("_one", "_two").agg(F.count(F.lit(1)).alias(COPIES), *same)


def _named(counters: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in counters.items()]


def profile_dq(df: DataFrame, stage: str = "before_clean") -> DataFrame:
    """The seven counters as one row: one scan and one shuffle for all of them."""
    sales = _sale_columns(df)
    rows = _distinct_marks(sales)
    counted = rows.agg(*_named(_counters(_marked(sales, "_marks"), F.col(COPIES))))
    return counted.select(F.lit(stage).alias("stage"), *COUNTERS)


def _report_rows(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Generator of the two report rows; the after row also says how many rows went."""
    raw_total = before["total_rows"]
    removed = raw_total - after["total_rows"]
    share = round_half_up(removed * F.lit(100.0) / F.greatest(raw_total, F.lit(1)), 2)

    def row(stage: str, counts: dict[str, Column], gone: Column, pct: Column) -> Column:
        return F.struct(
            F.lit(stage).alias("stage"),
            counts["total_rows"].alias("total_rows"),
            gone.cast("bigint").alias("rows_removed"),
            pct.cast("double").alias("pct_removed"),
            *(counts[c].alias(c) for c in COUNTERS[1:]),
        )

    nothing = F.lit(None)
    return F.inline(
        F.array(
            row("before_clean", before, nothing, nothing),
            row("after_clean", after, removed, share),
        )
    )


def report_from_counts(before: dict[str, int], after: dict[str, int], duplicates: DataFrame) -> DataFrame:
    """Report from counters that runs have observed, and the measured duplicates of the fact."""

    def known(counts: dict[str, int]) -> dict[str, Column]:
        return {c: F.lit(counts[c]).cast("bigint") for c in COUNTERS}

    return duplicates.select(_report_rows(known(before), known(after) | {"duplicate_rows": F.col("duplicate_rows")}))


def dq_report(raw: DataFrame) -> DataFrame:
    """Before/after report, both rows measured, from one scan of the raw data.

    The distinct raw rows give the before counters; grouped by what is left of
    them in the fact they give the after counters (rows that cleaning made equal
    show up as duplicates). Both groupings go by fingerprints, so short rows are
    shuffled only. Rejected rows share one group, summed map-side.
    """
    raw = _sale_columns(raw)
    sale = {
        "date": parse_date(F.col("date")),
        "product_id": F.col("product_id"),
        "product_name": F.col("product_name"),
        "store_id": F.col("store_id"),
        "warehouse_id": F.col("warehouse_id"),
        "sales_quantity": F.col("sales_quantity").try_cast("int"),
        "stock_quantity": F.col("stock_quantity").try_cast("int"),
        "price": F.col("price"),
    }
    parsed = (sale[c].isNotNull() for c in ("date", "sales_quantity", "stock_quantity"))
    kept = reduce(
        lambda a, b: a & b, parsed, ~_any_missing(raw, KEY_FIELDS) & F.coalesce(_quantities_valid(), F.lit(False))
    )
    one, two = fingerprint(list(sale.values()))
    rows = _distinct_marks(
        raw,
        _kept=kept,
        _sale_one=F.when(kept, one),
        _sale_two=F.when(kept, two),
        _sale_marks=F.when(kept, _marks(_conditions(raw, sale))),
    )
    before = _counters(_marked(raw, "_marks"), F.col(COPIES))
    by_sale = rows.groupBy("_kept", "_sale_one", "_sale_two").agg(
        F.count(F.lit(1)).alias("_sales"),
        F.max("_sale_marks").alias("_sale_marks"),
        *(c.alias(f"_raw_{n}") for n, c in before.items()),
    )
    after = _counters(_marked(raw, "_sale_marks"), F.when(F.col("_kept"), F.col("_sales")))
    totals = by_sale.agg(
        *(F.coalesce(F.sum(f"_raw_{n}"), F.lit(0)).alias(f"_raw_{n}") for n in COUNTERS),
        *_named(after),
    )
    return totals.select(
        _report_rows({n: F.col(f"_raw_{n}") for n in COUNTERS}, {n: F.col(n) for n in COUNTERS})
    )


def clean_and_observe(raw: DataFrame) -> tuple[DataFrame, Observation]:
    """``clean_sales`` that also counts the raw rows while it runs.

    The observation sits behind the only shuffle, in the stage that writes the
    result, where a partition is counted once however often it is retried. Rows read
    with the text of corrupt lines are counted under ``corrupt_rows`` as well.
    """
    observation = Observation("before_clean")
    counts = [F.count(F.lit(1)).alias(COPIES)]
    figures = []
    if CORRUPT in raw.columns:
        counts.append(F.count(CORRUPT).alias(CORRUPT))
        figures.append(F.coalesce(F.sum(CORRUPT), F.lit(0)).alias("corrupt_rows"))
    rows = raw.groupBy(*_sale_columns(raw).columns).agg(*counts)
    watched = rows.observe(observation, *_named(_counters(_conditions(rows), F.col(COPIES))), *figures)
    clean = (
        watched.transform(drop_missing)
        .transform(drop_negative)
        .drop(COPIES, CORRUPT)
        .transform(cast_quantities)
        .transform(_drop_uncastable)
    )
    return clean, observation


def observe_clean(fact: DataFrame) -> tuple[DataFrame, Observation]:
    """The enriched fact, which counts its own rows and days while it is written."""
    observation = Observation("after_clean")
    counters = _counters(_conditions(fact), F.lit(1))
    days = [F.min("date").cast("string").alias("date_min"), F.max("date").cast("string").alias("date_max")]
    return fact.observe(observation, *_named(counters), *days), observation


def duplicate_sales(fact: DataFrame) -> DataFrame:
    """One row: how many sales are copies of others in what identifies a sale."""
    one, two = fingerprint([F.col(c) for c in SALE_COLUMNS])
    copies = fact.groupBy(one.alias("_one"), two.alias("_two")).agg(F.count(F.lit(1)).alias(COPIES))
    return copies.agg(F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def ingest_report(raw: DataFrame) -> DataFrame:
    """One row per column (position, name, type) with the table's row count."""
    fields = F.array(
        *(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
            )
            for i, f in enumerate(raw.schema, 1)
        )
    )
    return raw.agg(F.count(F.lit(1)).alias("row_count")).select(F.inline(fields), "row_count")


def corrupt_rows(raw: DataFrame) -> DataFrame:
    """Rows the reader could not fully parse (read with ``keep_corrupt=True``)."""
    return raw.filter(F.col(CORRUPT).isNotNull())


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The frame itself, or ValueError naming the absent columns."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df


def fill_missing_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Null and NaN features to 0.0."""
    return df.withColumns({n: F.col(n).cast("double") for n in names}).fillna(0.0, list(names))
