"""Contracts, JSON parsing, quarantine and validation."""

import json

import pytest
from pyspark.sql import functions as F

from crossbook.sources import ingest as I
from crossbook.sources.contracts import (CONTRACTS, UnsupportedContractType, contract_schema,
                                         load_contracts, spark_type, validate_records,
                                         validate_schema)

TS = 1700000000000
# FIXTURES.md payloads
ORDER = {"order_id": "abc-abc", "order_type": "Sell", "price": 10.0, "quantity": 10.0, "timestamp": TS}
PRICE = {"price": 10.0}
TRADE = {"trade_id": "abc-123", "order_id": "abc-abc", "quantity": 10.0, "price": 10.0,
         "action": "buy", "status": "closed", "timestamp": TS}

CASES = [
    ("valid_contract_payload", json.dumps(ORDER)),
    ("int_quantity", json.dumps({**ORDER, "quantity": 10})),
    ("missing_quantity", json.dumps({k: v for k, v in ORDER.items() if k != "quantity"} | {"x": 1})),
    ("wrong_type_price", json.dumps({**ORDER, "quantity": 10, "price": "1"})),
    ("unknown_field", json.dumps({**ORDER, "quantity": 10, "extra": True})),
    ("json_null", "null"),
    ("broken", '{"order_id": "a", '),
    ("zero_quantity", json.dumps({**ORDER, "quantity": 0})),
    ("null_quantity", json.dumps({**ORDER, "quantity": None})),
    ("array", "[]"),
]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(CASES, "case string, value string")


def test_contract_payloads_validate(spark):
    """The contract test payloads are valid by contract (10.0 is an integer)."""
    df = spark.createDataFrame([("order", json.dumps(ORDER)), ("pricepoint", json.dumps(PRICE)),
                                ("trade", json.dumps(TRADE))], "name string, value string")
    for name in CONTRACTS:
        out = validate_records(df.where(F.col("name") == name), CONTRACTS[name]).collect()
        assert [r.valid for r in out] == [True], (name, out)


def test_violations(spark, messages):
    got = {r.case: list(r.violations) for r in validate_records(messages, CONTRACTS["order"]).collect()}
    assert got["valid_contract_payload"] == []
    assert got["missing_quantity"] == ["missing:quantity"]
    assert got["wrong_type_price"] == ["type:price"]
    assert got["unknown_field"] == []
    assert got["json_null"] == ["not_object"]
    assert got["broken"] == ["not_json"]
    assert got["null_quantity"] == ["type:quantity"]
    assert got["array"] == ["not_object"]


def test_parse_split(spark, messages):
    parsed = {r.case: r for r in I.parse_records(messages, "order").collect()}
    # an int64 parse rejects 10.0 although the contract accepts it
    assert parsed["valid_contract_payload"].malformed
    assert not parsed["int_quantity"].malformed and parsed["int_quantity"].quantity == 10
    # missing and null fields become zero values (a no-op order)
    assert not parsed["missing_quantity"].malformed and parsed["missing_quantity"].quantity == 0
    assert not parsed["null_quantity"].malformed and parsed["null_quantity"].quantity == 0
    assert parsed["wrong_type_price"].malformed
    assert not parsed["unknown_field"].malformed
    assert parsed["json_null"].malformed and parsed["broken"].malformed and parsed["array"].malformed
    bad = {r.case for r in I.quarantine(messages).collect()}
    assert bad == {"valid_contract_payload", "wrong_type_price", "json_null", "broken", "array"}
    counts = {(r.outcome): r.messages for r in I.ingest_counts(
        I.parse_records(messages.withColumn("source", F.lit("t")), "order")).collect()}
    assert counts == {"consumed": 5, "malformed": 5}


def test_strict_rejects_coercions(spark):
    df = spark.createDataFrame([(json.dumps({**ORDER, "quantity": 10, "order_id": 7}),)], "value string")
    assert I.parse_records(df, "order").first().malformed is False
    assert I.parse_records(df, "order", strict=True).first().malformed is True


def test_round_trip(spark):
    df = spark.createDataFrame([("a", "limit", 10.5, -3, TS)],
                               "order_id string, order_type string, price double, quantity long, timestamp long")
    msgs = df.select(I.to_json_value(df, "order").alias("value"))
    back = I.parse_orders(msgs).select(*CONTRACTS["order"]["properties"]).collect()
    assert [tuple(r) for r in back] == [("a", "limit", 10.5, -3, TS)]


def test_schema_mapping_and_validate_schema(spark):
    schema = contract_schema(CONTRACTS["trade"])
    assert [f.dataType.simpleString() for f in schema.fields] == [
        "string", "string", "bigint", "double", "string", "string", "bigint"]
    assert schema["quantity"].metadata == {"required": True}
    with pytest.raises(UnsupportedContractType):
        spark_type("decimal")
    df = spark.createDataFrame([("t", "o", 1, 1.0, "BUY", "closed", 1, "extra")],
                               "trade_id string, order_id string, quantity long, price double, "
                               "action string, status string, timestamp long, more string")
    assert all(r.ok for r in validate_schema(spark, df.schema, CONTRACTS["trade"]).collect())
    bad = spark.createDataFrame([("t", 1.5)], "trade_id string, quantity double")
    res = {r.field: r.ok for r in validate_schema(spark, bad.schema, CONTRACTS["trade"]).collect()}
    assert res["trade_id"] and not res["quantity"] and not res["price"]


def test_load_contracts(tmp_path):
    for name, doc in CONTRACTS.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    assert load_contracts(tmp_path) == CONTRACTS
