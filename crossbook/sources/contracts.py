"""Record contracts (SRC-7) and validation (VAL-1, VAL-2).

A contract is a small JSON document: type, version, metadata{name, topic},
properties{field: {type}}, required[]. It maps to a Spark ``StructType``;
validation of records is a set of generated column predicates over the
parsed JSON (``try_parse_json`` variant), so it runs JVM-side on executors.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DataType, DoubleType, LongType,
                               StringType, StructField, StructType)

# The three record contracts of the order pipeline.
CONTRACTS: dict[str, dict] = {
    "order": {
        "type": "object",
        "version": "1.0.0",
        "metadata": {"name": "order", "topic": "orders.topic"},
        "properties": {
            "order_id": {"type": "string"},
            "order_type": {"type": "string"},
            "price": {"type": "number"},
            "quantity": {"type": "integer"},
            "timestamp": {"type": "integer"},
        },
        "required": ["order_id", "order_type", "price", "quantity", "timestamp"],
    },
    "trade": {
        "type": "object",
        "version": "1.0.0",
        "metadata": {"name": "trade", "topic": "trades.topic"},
        "properties": {
            "trade_id": {"type": "string"},
            "order_id": {"type": "string"},
            "quantity": {"type": "integer"},
            "price": {"type": "number"},
            "action": {"type": "string"},
            "status": {"type": "string"},
            "timestamp": {"type": "integer"},
        },
        "required": ["trade_id", "order_id", "quantity", "price", "action", "status", "timestamp"],
    },
    "pricepoint": {
        "type": "object",
        "version": "1.0.0",
        "metadata": {"name": "pricepoint", "topic": "order.last_price.topic"},
        "properties": {"price": {"type": "number"}},
        "required": ["price"],
    },
}

# Contract type -> Spark type.
TYPE_MAP: dict[str, DataType] = {
    "integer": LongType(),
    "string": StringType(),
    "boolean": BooleanType(),
    "array": ArrayType(StringType()),
    "object": StructType([]),
    "number": DoubleType(),
}


class UnsupportedContractType(ValueError):
    pass


def load_contracts(folder: str | Path) -> dict[str, dict]:
    """SRC-7: every ``*.json`` contract in a folder, keyed by metadata.name."""
    out = {}
    for path in sorted(Path(folder).glob("*.json")):
        doc = json.loads(path.read_text())
        out[doc["metadata"]["name"]] = doc
    return out


def spark_type(contract_type: str) -> DataType:
    try:
        return TYPE_MAP[contract_type]
    except KeyError:
        raise UnsupportedContractType(f"unsupported contract type: {contract_type!r}") from None


def contract_schema(contract: dict) -> StructType:
    """Contract -> StructType; field metadata carries ``required``."""
    required = set(contract.get("required", []))
    return StructType([
        StructField(name, spark_type(spec["type"]), True, {"required": name in required})
        for name, spec in contract["properties"].items()
    ])


def contract_type_of(dt: DataType) -> str | None:
    """Spark type -> contract type name (None when nothing maps)."""
    for name, t in TYPE_MAP.items():
        if type(t) is type(dt):
            return name
    return None


def validate_schema(spark: SparkSession, schema: StructType, contract: dict,
                    data: DataFrame | None = None) -> DataFrame:
    """VAL-2: every contract property must exist with the mapped type; extra
    columns are allowed; ``required`` is not checked. One row per property.

    The type check reads schema metadata only (a handful of rows). With
    ``data``, each present field also reports how many of its values are
    non-null (one aggregate over the table, unpivoted to one row per field)."""
    actual = {f.name: f.dataType for f in schema.fields}
    rows = []
    for name, spec in contract["properties"].items():
        got = actual.get(name)
        got_name = contract_type_of(got) if got is not None else None
        rows.append((contract["metadata"]["name"], name, spec["type"], got_name,
                     got_name == spec["type"]))
    checks = spark.createDataFrame(
        rows, "contract string, field string, expected_type string, actual_type string, ok boolean")
    if data is None:
        return checks
    present = [n for n in contract["properties"] if n in actual]
    counts = data.agg(*[F.count(F.col(n)).alias(n) for n in present]).unpivot(
        [], present, "field", "non_null")
    return checks.join(counts, "field", "left").select(
        "contract", "field", "expected_type", "actual_type", "ok",
        F.coalesce(F.col("non_null"), F.lit(0)).cast("bigint").alias("non_null"))


def _type_ok(field_v: Column, t: Column, contract_type: str) -> Column:
    """Whether a variant, whose schema text is ``t``, is of a contract type."""
    numeric = t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
    if contract_type == "string":
        return t == "STRING"
    if contract_type == "number":
        return numeric
    if contract_type == "integer":
        as_double = F.try_variant_get(field_v, "$", "double")
        return numeric & (as_double == F.floor(as_double))
    if contract_type == "boolean":
        return t == "BOOLEAN"
    if contract_type == "array":
        return t.startswith("ARRAY")
    if contract_type == "object":
        return t.startswith("OBJECT")
    raise UnsupportedContractType(contract_type)


def _violations(v: Column, field_v: dict[str, Column], field_t: dict[str, Column], contract: dict) -> Column:
    required = set(contract.get("required", []))
    checks = []
    for name, spec in contract["properties"].items():
        fv = field_v[name]
        missing = F.when(fv.isNull() & F.lit(name in required), F.lit(f"missing:{name}"))
        wrong = F.when(fv.isNotNull() & ~F.coalesce(_type_ok(fv, field_t[name], spec["type"]), F.lit(False)),
                       F.lit(f"type:{name}"))
        checks += [missing, wrong]
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    # drops the NULLs of checks that passed (a lambda would leave generated code)
    field_errors = F.array_except(F.array(*checks), F.array(F.lit(None).cast("string")))
    return (F.when(v.isNull(), F.array(F.lit("not_json")))
            .when(~is_object, F.array(F.lit("not_object")))
            .otherwise(field_errors))


def violations(value: Column, contract: dict) -> Column:
    """VAL-1: ARRAY<STRING> of contract violations of one JSON text:
    ``not_json``, ``not_object``, ``missing:<f>`` (required and absent),
    ``type:<f>`` (present, including JSON null, but of the wrong type).
    A whole-valued number such as 10.0 counts as an integer."""
    v = F.try_parse_json(value)
    fields = {name: F.variant_get(v, f"$.{name}", "variant") for name in contract["properties"]}
    return _violations(v, fields, {n: F.schema_of_variant(f) for n, f in fields.items()}, contract)


def validate_records(messages: DataFrame, contract: dict, value_col: str = "value") -> DataFrame:
    """VAL-1 over a message table: adds ``violations`` and ``valid``.

    The text is parsed once into a variant column, each field is extracted
    once and its schema text written once, in separate projections, so the
    checks reuse them instead of re-parsing the JSON per check."""
    names = list(contract["properties"])
    parsed = messages.withColumn("_v", F.try_parse_json(F.col(value_col)))
    fields = parsed.select("*", *[F.variant_get("_v", f"$.{n}", "variant").alias(f"_f_{n}")
                                  for n in names])
    typed = fields.select("*", *[F.schema_of_variant(f"_f_{n}").alias(f"_t_{n}") for n in names])
    viol = _violations(F.col("_v"), {n: F.col(f"_f_{n}") for n in names},
                       {n: F.col(f"_t_{n}") for n in names}, contract)
    return (typed.withColumn("violations", viol)
            .withColumn("valid", F.size("violations") == 0)
            .drop("_v", *[f"_{k}_{n}" for n in names for k in "ft"]))
