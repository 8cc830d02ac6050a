"""JSON records in and out (PRJ-1..5, PRJ-4 quarantine, OBS-1 counts).

Parsing is ``from_json`` with the contract's StructType in PERMISSIVE mode
and a corrupt-record column: a row whose text is not a JSON object of the
right field types is split off to quarantine, never matched. Missing fields
and JSON nulls become the zero value of their type, as a Go decoder would
leave them (a missing quantity is then a no-op order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from crossbook.sources.contracts import CONTRACTS, contract_schema, violations

CORRUPT = "_corrupt_record"
# Strict JSON: no single quotes, no NaN/Infinity literals.
JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}


def _with_corrupt(schema: StructType) -> StructType:
    return StructType(list(schema.fields) + [StructField(CORRUPT, StringType(), True)])


def _zero(dt) -> Column:
    if isinstance(dt, StringType):
        return F.lit("")
    if isinstance(dt, LongType):
        return F.lit(0).cast("bigint")
    if isinstance(dt, DoubleType):
        return F.lit(0.0)
    if isinstance(dt, BooleanType):
        return F.lit(False)
    return F.lit(None).cast(dt)


def parse_records(messages: DataFrame, contract: dict | str, value_col: str = "value",
                  strict: bool = False) -> DataFrame:
    """Adds the contract's fields (zero-filled) and ``malformed``.

    ``strict`` also rejects values Spark would coerce (e.g. a number where a
    string is declared), by the contract's type check on the raw JSON."""
    if isinstance(contract, str):
        contract = CONTRACTS[contract]
    schema = contract_schema(contract)
    rec = F.from_json(F.col(value_col).cast("string"), _with_corrupt(schema), JSON_OPTIONS)
    # a generator: filters and projections above it never repeat the parse
    parsed = messages.select("*", F.explode(F.array(rec)).alias("_rec"))
    bad = F.col("_rec").isNull() | F.col(f"_rec.{CORRUPT}").isNotNull() | F.col(value_col).isNull()
    if strict:
        type_errors = F.exists(violations(F.col(value_col).cast("string"), contract),
                               lambda x: x.startswith("type:") | x.startswith("not_"))
        bad = bad | type_errors
    fields = [F.coalesce(F.col(f"_rec.{f.name}"), _zero(f.dataType)).alias(f.name)
              for f in schema.fields]
    return parsed.select("*", *fields, bad.alias("malformed")).drop("_rec")


def parse_orders(messages: DataFrame, value_col: str = "value", strict: bool = False) -> DataFrame:
    """PRJ-1: JSON -> order rows (good rows only)."""
    return parse_records(messages, "order", value_col, strict).where(~F.col("malformed")).drop("malformed")


def parse_trades(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """PRJ-2: JSON -> trade legs (good rows only)."""
    return parse_records(messages, "trade", value_col).where(~F.col("malformed")).drop("malformed")


def parse_prices(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """PRJ-3: JSON -> price points (good rows only)."""
    return parse_records(messages, "pricepoint", value_col).where(~F.col("malformed")).drop("malformed")


def quarantine(messages: DataFrame, contract: dict | str = "order", value_col: str = "value") -> DataFrame:
    """PRJ-4: the rows that did not parse (kept aside, never matched)."""
    return parse_records(messages, contract, value_col).where(F.col("malformed"))


def to_json_value(df: DataFrame, contract: dict | str) -> Column:
    """PRJ-5: record -> JSON text, fields in contract order."""
    if isinstance(contract, str):
        contract = CONTRACTS[contract]
    return F.to_json(F.struct(*[F.col(name) for name in contract["properties"]]))


def ingest_counts(parsed: DataFrame) -> DataFrame:
    """OBS-1 (batch): consumed vs malformed message counts per source, one
    aggregation. Malformed messages are not counted as consumed."""
    outcome = F.when(F.col("malformed"), F.lit("malformed")).otherwise(F.lit("consumed"))
    return parsed.groupBy("source", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("messages"))
