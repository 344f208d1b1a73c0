"""Data-quality audits. Each returns its findings as a DataFrame.

An audit that one pass over a table can answer is a `ScanAudit`: it names its
measures, and several of them share one pass (`profile`).

Checks over keys count rows per key first, with a map-side partial count, so a
key that repeats very often costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import calendar_days_between, within
from ..functions.rates import percent, rounded
from ..settings import ROW_FLOORS, RowFloor, Settings
from ..sources.tables import ALL_TABLES
from .delivered import has_status_delivered, is_delivered, is_late

Tables = Mapping[str, DataFrame]


class DuplicateKeyError(ValueError):
    """A key that must be unique repeats."""


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# -- measures of one pass --------------------------------------------------------

# Aggregates by table and name, each a whole number.
Measures = dict[str, dict[str, Column]]


def profile(tables: Tables, measures: Measures) -> DataFrame:
    """``table_name, row_count, measure, value``: all measures of a table from one pass over it."""
    parts = []
    for name, wanted in measures.items():
        columns = [column.cast("bigint").alias(f"m{i}") for i, column in enumerate(wanted.values())]
        # greatest: a count from footers is NULL, not 0, where no file has rows
        counted = tables[name].agg(F.greatest(F.count("*"), F.lit(0)).alias("row_count"), *columns)
        rows = [F.struct(F.lit(m).alias("measure"), F.col(f"m{i}").alias("value")) for i, m in enumerate(wanted)]
        parts.append(counted.select(F.lit(name).alias("table_name"), "row_count", F.inline(F.array(*rows))))
    return _stack(parts)


@dataclass(frozen=True)
class ScanAudit:
    """What to measure in the tables, and the findings as made from the measured values."""

    measures: Callable[[Tables, Settings], Measures]
    findings: Callable[[DataFrame, Settings], DataFrame]

    def __call__(self, tables: Tables, settings: Settings | None = None) -> DataFrame:
        settings = settings or Settings()
        return self.findings(profile(tables, self.measures(tables, settings)), settings)


def shared_measures(audits: Iterable[ScanAudit], tables: Tables, settings: Settings) -> Measures:
    """The measures of all the audits, for one pass over each table."""
    found: Measures = {}
    for audit in audits:
        for name, wanted in audit.measures(tables, settings).items():
            found.setdefault(name, {}).update(wanted)
    return found


def _one_row(measured: DataFrame, table: str, columns: Mapping[str, str]) -> DataFrame:
    """One row with a column for each measure; ``columns``: column to measure."""
    picked = [F.max(F.when(F.col("measure") == m, F.col("value"))).alias(c) for c, m in columns.items()]
    return measured.where(F.col("table_name") == table).agg(*picked)


_COLUMNS, _NULLS = "columns", "nulls in "


def _nulls(columns: Iterable[str]) -> dict[str, Column]:
    return {_NULLS + c: F.count_if(F.col(c).isNull()) for c in columns}


def _null_counts(measured: DataFrame) -> DataFrame:
    name = F.substring("measure", len(_NULLS) + 1, 1000).alias("column_name")
    found = measured.where(F.startswith("measure", F.lit(_NULLS)))
    return found.select("table_name", name, "row_count", F.col("value").alias("null_count"))


def _width(tables: Tables) -> Measures:
    return {name: {_COLUMNS: F.lit(len(df.columns))} for name, df in tables.items()}


ROW_COUNTS = ScanAudit(
    lambda tables, settings: _width(tables),
    lambda measured, settings: measured.where(F.col("measure") == _COLUMNS).select(
        "table_name", "row_count", F.col("value").alias("column_count")
    ),
)


def row_floor_audit(floors: Sequence[RowFloor] = ROW_FLOORS) -> ScanAudit:
    """Row counts against their expected minimum; reports, never raises."""

    def findings(measured: DataFrame, settings: Settings) -> DataFrame:
        floor = F.coalesce(*[F.when(F.col("table_name") == f.table, F.lit(f.rows)) for f in floors])
        rows = measured.where(F.col("measure") == _COLUMNS).withColumn("expected_rows", floor.cast("bigint"))
        status = F.when(F.col("row_count") < F.col("expected_rows"), "below expected").otherwise("passed")
        return rows.where(F.col("expected_rows").isNotNull()).select(
            "table_name", "row_count", "expected_rows", status.alias("status")
        )

    return ScanAudit(lambda tables, settings: _width({f.table: tables[f.table] for f in floors}), findings)


def _declared_required(tables: Tables, settings: Settings) -> Measures:
    named = {n: t for n, t in ALL_TABLES.items() if t.required and n in tables}
    return {n: _nulls(t.required) for n, t in named.items()}


def _of_required(measured: DataFrame, settings: Settings) -> DataFrame:
    required = [f"{n}.{c}" for n, t in ALL_TABLES.items() for c in t.required]
    found = _null_counts(measured)
    return found.where(F.concat_ws(".", "table_name", "column_name").isin(required))


REQUIRED_COLUMNS = ScanAudit(_declared_required, _of_required)

NULL_PROFILE = ScanAudit(
    lambda tables, settings: {name: _nulls(df.columns) for name, df in tables.items()},
    lambda measured, settings: _null_counts(measured).withColumn(
        "null_pct", rounded(percent("null_count", "row_count"))
    ),
)

# Listing details that products without a category lack as well.
CATALOGUE_COLUMNS = (
    "product_category_name",
    "product_name_lenght",
    "product_description_lenght",
    "product_photos_qty",
)


def _together(columns: Sequence[str]) -> dict[str, Column]:
    every = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])
    either = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    return {"all null": F.count_if(every), "any null": F.count_if(either)}


def _missing_catalogue(measured: DataFrame, settings: Settings) -> DataFrame:
    columns = {"all_null": "all null", "any_null": "any null"}
    columns |= {f"nulls_{i}": _NULLS + c for i, c in enumerate(CATALOGUE_COLUMNS)}
    return _by_column(_one_row(measured, "products", columns), CATALOGUE_COLUMNS)


CATALOGUE_GAPS = ScanAudit(
    lambda tables, settings: {"products": _together(CATALOGUE_COLUMNS) | _nulls(CATALOGUE_COLUMNS)},
    _missing_catalogue,
)


def _delivery_measures(tables: Tables, settings: Settings) -> Measures:
    carrier, bought = F.col("order_delivered_carrier_date"), F.col("order_purchase_timestamp")
    delivered_at = F.col("order_delivered_customer_date")
    window = settings.analysis
    inside = is_delivered() & within(bought, window.start, window.end)
    return {
        "orders": {
            "marked delivered": F.count_if(has_status_delivered()),
            "undated": F.count_if(has_status_delivered() & delivered_at.isNull()),
            "delivered": F.count_if(is_delivered()),
            "carrier before purchase": F.count_if(is_delivered() & (carrier < bought)),
            "delivered before carrier": F.count_if(is_delivered() & (delivered_at < carrier)),
            "carrier missing": F.count_if(is_delivered() & carrier.isNull()),
            "delivered in window": F.count_if(inside),
            "first day": F.unix_date(F.min(F.to_date(bought))),
            "last day": F.unix_date(F.max(F.to_date(bought))),
        }
    }


def _delivery_audit(columns: Mapping[str, str]) -> ScanAudit:
    used = set(columns.values())

    def measures(tables: Tables, settings: Settings) -> Measures:
        found = _delivery_measures(tables, settings)["orders"]
        return {"orders": {name: column for name, column in found.items() if name in used}}

    return ScanAudit(measures, lambda measured, settings: _one_row(measured, "orders", columns))


# Orders marked delivered, and those of them without a delivery date.
UNDATED_DELIVERIES = _delivery_audit({"delivered_orders": "marked delivered", "undated_orders": "undated"})

# Delivered orders whose carrier date contradicts the purchase or the delivery.
IMPOSSIBLE_DURATIONS = _delivery_audit(
    {
        "delivered_orders": "delivered",
        "carrier_before_purchase": "carrier before purchase",
        "delivered_before_carrier": "delivered before carrier",
        "carrier_missing": "carrier missing",
    }
)

_COVERAGE = _delivery_audit(
    {
        "first_purchase_date": "first day",
        "last_purchase_date": "last day",
        "delivered_orders": "delivered",
        "delivered_in_window": "delivered in window",
    }
)


def _coverage(measured: DataFrame, settings: Settings) -> DataFrame:
    days = {c: F.date_from_unix_date(F.col(c).cast("int")) for c in ("first_purchase_date", "last_purchase_date")}
    share = rounded(percent("delivered_in_window", "delivered_orders"))
    return _COVERAGE.findings(measured, settings).withColumns(days).withColumn("in_window_pct", share)


# Purchase dates covered, and the share of delivered orders in the analysis window.
WINDOW_COVERAGE = ScanAudit(_COVERAGE.measures, _coverage)


def row_counts(tables: Tables) -> DataFrame:
    """Rows and columns of each table."""
    return ROW_COUNTS(tables)


def row_changes(before: Tables, after: Tables) -> DataFrame:
    """``table_name, rows_before, rows_after, lost, gained`` of the tables that are in both."""
    both = [name for name in before if name in after]
    counts = [row_counts({n: t[n] for n in both}).drop("column_count") for t in (before, after)]
    counts = [c.withColumnRenamed("row_count", n) for c, n in zip(counts, ("rows_before", "rows_after"))]
    more = F.col("rows_after") - F.col("rows_before")
    return counts[0].join(counts[1], "table_name").select(
        "table_name", "rows_before", "rows_after",
        F.greatest(-more, F.lit(0)).alias("lost"), F.greatest(more, F.lit(0)).alias("gained"),
    )


def row_floors(tables: Tables, floors: Sequence[RowFloor] = ROW_FLOORS) -> DataFrame:
    """Row counts against their expected minimum; reports, never raises."""
    return row_floor_audit(floors)(tables)


def required_columns(tables: Tables) -> DataFrame:
    """NULLs in columns declared NOT NULL."""
    return REQUIRED_COLUMNS(tables)


def null_profile(tables: Tables) -> DataFrame:
    """NULL count and share of every column."""
    return NULL_PROFILE(tables)


def missing_catalogue_data(tables: Tables) -> DataFrame:
    """Whether products lacking a category lack their listing details as well."""
    return CATALOGUE_GAPS(tables)


def undated_deliveries(tables: Tables) -> DataFrame:
    """Orders marked delivered, and those of them without a delivery date."""
    return UNDATED_DELIVERIES(tables)


def impossible_durations(tables: Tables) -> DataFrame:
    """Delivered orders whose carrier date contradicts the purchase or the delivery."""
    return IMPOSSIBLE_DURATIONS(tables)


def window_coverage(tables: Tables, settings: Settings) -> DataFrame:
    """Purchase dates covered, and the share of delivered orders in the analysis window."""
    return WINDOW_COVERAGE(tables, settings)


# -- keys, references and groups ---------------------------------------------------


def duplicate_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Repeated keys and the rows beyond the first of each; equal NULL keys count as repeats."""
    return (
        df.groupBy(*key)
        .agg(F.count("*").alias("n"))
        .agg(
            F.count_if(F.col("n") > 1).alias("repeated_keys"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"),
        )
    )


def require_unique(df: DataFrame, key: Sequence[str], name: str) -> None:
    """Raise when the key repeats."""
    extra = duplicate_rows(df, key).first()["extra_rows"]
    if extra:
        raise DuplicateKeyError(f"{name}: {extra} rows repeat the key {', '.join(key)}")


def primary_keys(tables: Tables) -> DataFrame:
    """Uniqueness of every declared key."""
    return _stack(
        [
            duplicate_rows(tables[name], table.key).select(
                F.lit(name).alias("table_name"),
                F.lit(", ".join(table.key)).alias("key_columns"),
                "repeated_keys",
                "extra_rows",
            )
            for name, table in ALL_TABLES.items()
            if table.key and name in tables
        ]
    )


def missing_together(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether columns are NULL in the same rows: NULLs of each against NULLs of all."""
    together = _together(columns)
    counts = df.agg(
        together["all null"].alias("all_null"),
        together["any null"].alias("any_null"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(columns)],
    )
    return _by_column(counts, columns)


def _by_column(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column, from one row with ``all_null``, ``any_null`` and ``nulls_0`` and so on."""
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"nulls_{i}").alias("null_count"))
        for i, c in enumerate(columns)
    ]
    found = counts.select("all_null", "any_null", F.inline(F.array(*rows)))
    return found.select("column_name", "null_count", "all_null", "any_null")


def missing_groups(tables: Tables) -> DataFrame:
    """Columns that are NULL in exactly the same rows, found among all columns of each table.

    Each row is reduced to its pattern of NULLs, and the patterns are counted, so
    what is shuffled is one row per pattern and task. Columns belong together if
    they are NULL in the same patterns: two hashes over these propose groups, which
    the patterns then confirm. Columns without NULLs are in no group.
    """
    patterns = _stack([_null_patterns(name, df) for name, df in tables.items()])
    missing = patterns.select(
        "*", F.explode(F.sequence(F.lit(1), F.length("pattern"))).alias("position")
    ).where(F.expr("substring(pattern, position, 1) = '1'"))
    signature = {
        "null_count": F.sum("rows"),
        "patterns": F.count("*"),
        "one": F.sum(F.xxhash64("pattern").cast("decimal(20,0)")),
        "two": F.bit_xor(F.xxhash64("pattern", F.lit("two"))),
    }
    by_column = missing.groupBy("table_name", "position").agg(*[c.alias(n) for n, c in signature.items()])
    groups = (
        by_column.groupBy("table_name", *signature)
        .agg(F.sort_array(F.collect_list("position")).alias("positions"))  # columns of one table
        .where(F.size("positions") > 1)
    )
    held = F.transform("positions", lambda p: F.substring("pattern", p, F.lit(1)) == "1")
    checked = groups.join(patterns, "table_name").groupBy("table_name", "positions", "null_count").agg(
        F.sum(F.when(F.exists(held, lambda h: h), F.col("rows"))).alias("any_null"),
        F.sum(F.when(F.forall(held, lambda h: h), F.col("rows"))).alias("all_null"),
    )
    names = F.create_map(*[
        x for name, df in tables.items() for x in (F.lit(name), F.array(*[F.lit(c) for c in df.columns]))
    ])
    named = F.transform("positions", lambda p: F.element_at(names[F.col("table_name")], p))
    return checked.where(F.col("any_null") == F.col("all_null")).select(
        "table_name", F.concat_ws(", ", named).alias("column_names"), "null_count"
    )


def _null_patterns(name: str, df: DataFrame) -> DataFrame:
    """``table_name, pattern, rows``: a 1 for each column that is NULL, a 0 for the others."""
    bits = [F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns]
    counted = df.groupBy(F.concat(*bits).alias("pattern")).agg(F.count("*").alias("rows"))
    return counted.select(F.lit(name).alias("table_name"), "pattern", "rows")


def foreign_keys(tables: Tables) -> DataFrame:
    """Rows whose reference does not exist, per declared reference."""
    found = []
    for name, table in ALL_TABLES.items():
        for ref in table.references:
            if name not in tables or ref.table not in tables:
                continue
            used = (
                tables[name]
                .where(F.col(ref.column).isNotNull())
                .groupBy(F.col(ref.column).alias("used_key"))
                .agg(F.count("*").alias("n"))
            )
            known = tables[ref.table].select(F.col(ref.key).alias("used_key"))
            found.append(
                used.join(known, "used_key", "left_anti")
                .agg(
                    F.count("*").alias("orphan_keys"),
                    F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
                )
                .select(
                    F.lit(name).alias("table_name"),
                    F.lit(ref.column).alias("column_name"),
                    F.lit(ref.table).alias("referenced_table"),
                    "orphan_keys",
                    "orphan_rows",
                )
            )
    return _stack(found)


def unreviewed_orders(tables: Tables) -> DataFrame:
    """Orders without any review."""
    reviewed = tables["order_reviews"].select("order_id").distinct()
    orders = tables["orders"].select("order_id")
    return _stack(
        [
            orders.agg(F.count("*").alias("orders")).select(
                F.lit("all orders").alias("population"), "orders"
            ),
            orders.join(reviewed, "order_id", "left_anti")
            .agg(F.count("*").alias("orders"))
            .select(F.lit("without review").alias("population"), "orders"),
        ]
    )


def itemless_orders(tables: Tables) -> DataFrame:
    """Orders without items, by status."""
    return (
        tables["orders"]
        .select("order_id", "order_status")
        .join(tables["order_items"].select("order_id").distinct(), "order_id", "left_anti")
        .groupBy("order_status")
        .agg(F.count("*").alias("orders"))
        .orderBy(F.col("orders").desc(), "order_status")
    )


def batch_deliveries(tables: Tables, settings: Settings) -> DataFrame:
    """Delivery dates shared by late orders bought long apart, flagged as one-off events."""
    late = tables["orders"].where(is_delivered() & is_late())
    by_date = late.groupBy(F.to_date("order_delivered_customer_date").alias("delivery_date")).agg(
        F.count("*").alias("late_orders"),
        F.min(F.to_date("order_purchase_timestamp")).alias("first_purchase_date"),
        F.max(F.to_date("order_purchase_timestamp")).alias("last_purchase_date"),
        F.max(
            calendar_days_between("order_estimated_delivery_date", "order_delivered_customer_date")
        ).alias("max_days_late"),
    )
    spread = F.datediff("last_purchase_date", "first_purchase_date")
    return by_date.select(
        "delivery_date",
        "late_orders",
        "first_purchase_date",
        "last_purchase_date",
        spread.alias("purchase_spread_days"),
        "max_days_late",
        (
            (F.col("late_orders") >= settings.batch_min_orders)
            & (spread >= settings.batch_min_purchase_spread)
            & (F.col("max_days_late") >= settings.batch_min_days_late)
        ).alias("is_batch"),
    ).orderBy("delivery_date")


def customer_identity(tables: Tables) -> DataFrame:
    """How many customer rows, per-order ids and persons there are."""
    customers = tables["customers"]

    def distinct(column: str) -> DataFrame:
        return (
            customers.where(F.col(column).isNotNull())
            .groupBy(column)
            .agg(F.count("*").alias("rows_per_id"))
            .agg(
                F.count("*").alias("distinct_ids"),
                F.max("rows_per_id").alias("max_rows_per_id"),
            )
            .select(F.lit(column).alias("id_column"), "distinct_ids", "max_rows_per_id")
        )

    return _stack([distinct("customer_id"), distinct("customer_unique_id")])


# Error of a distinct-count sketch, and how many of these errors two counts may lie apart by chance.
SKETCH_ERROR, SKETCH_ERRORS = 0.02, 6


def identifiers(name: str, df: DataFrame) -> list[str]:
    """Columns named as identifiers and declared as texts, or texts if the table is not declared."""
    schema = ALL_TABLES[name].schema if name in ALL_TABLES else df.schema
    texts = {f.name for f in schema.fields if f.dataType == T.StringType()}
    return [c for c in df.columns if c.endswith("_id") and c in texts]


def possible_dependencies(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs of columns of which the first may determine the second, by sketches from one pass.

    If it does, there are as many different pairs as values of the first; where the
    estimates lie further apart than sketches err, it does not.
    """
    pairs = list(permutations(columns, 2))
    if not pairs:
        return []
    alone = {c: F.approx_count_distinct(c, SKETCH_ERROR) for c in columns}
    joint = {frozenset(p): F.approx_count_distinct(F.struct(*sorted(p)), SKETCH_ERROR) for p in pairs}
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    counts = df.where(known).agg(*alone.values(), *joint.values()).first()  # one number a column and pair
    of_column = dict(zip(alone, counts))
    of_pair = dict(zip(joint, counts[len(alone) :]))
    slack = 1 + SKETCH_ERRORS * SKETCH_ERROR
    return [(a, b) for a, b in pairs if of_pair[frozenset((a, b))] <= of_column[a] * slack]


def key_relations(tables: Tables) -> DataFrame:
    """Identifiers that determine another one of their table, and whether that holds both ways.

    ``determinant`` determines ``dependent`` if each of its values stands with one
    value of the other, among rows where both are known. Sketches discard most
    pairs; the rest is checked exactly, with one row per value and task shuffled.
    Pairs of a table without rows are left out.
    """
    found = []
    for name, df in tables.items():
        for a, b in possible_dependencies(df, identifiers(name, df)):
            values = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("value")).agg(
                F.min(b).alias("least"), F.max(b).alias("most")
            )
            found.append(
                values.agg(
                    F.count("*").alias("distinct_values"),
                    F.count_if(F.col("least") < F.col("most")).alias("broken"),
                ).select(F.lit(name).alias("table_name"), F.lit(a).alias("determinant"),
                         F.lit(b).alias("dependent"), "distinct_values", "broken")
            )
    if not found:
        empty = "table_name string, determinant string, dependent string, distinct_values bigint, both_ways boolean"
        return next(iter(tables.values())).sparkSession.createDataFrame([], empty)
    held = _stack(found).where("broken = 0 AND distinct_values > 0").drop("broken")
    turned = held.select("table_name", F.col("dependent").alias("determinant"),
                         F.col("determinant").alias("dependent"), F.lit(True).alias("turned"))
    both = held.join(turned, ["table_name", "determinant", "dependent"], "left")
    return both.withColumn("both_ways", F.col("turned").isNotNull()).drop("turned")
