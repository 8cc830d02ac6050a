"""Declared-versus-actual keyed diffs (JN-3, SET-4).

One full outer join on the key; the action list per key is a ``when`` chain
and ``posexplode`` turns it into ordered action rows. Both inputs may be
large: the join shuffles both sides on the key (no broadcast assumed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READ, CREATE, DELETE, UPDATE = "READ", "CREATE", "DELETE", "UPDATE"


def reconcile_diff(declared: DataFrame, actual: DataFrame, key: str = "topic",
                   value: str = "partitions") -> DataFrame:
    """JN-3: actual-only -> DELETE; value mismatch -> DELETE then CREATE;
    equal -> READ; declared-only -> CREATE (UPDATE is never produced).
    Returns (key, step, action, declared value for CREATE else NULL)."""
    d = declared.select(F.col(key), F.col(value).alias("d_value"), F.lit(True).alias("d_present"))
    a = actual.select(F.col(key), F.col(value).alias("a_value"), F.lit(True).alias("a_present"))
    j = d.join(a, key, "full_outer")
    in_d, in_a = F.col("d_present").isNotNull(), F.col("a_present").isNotNull()
    actions = (F.when(in_a & ~in_d, F.array(F.lit(DELETE)))
               .when(in_a & in_d & ~F.col("a_value").eqNullSafe(F.col("d_value")),
                     F.array(F.lit(DELETE), F.lit(CREATE)))
               .when(in_a & in_d, F.array(F.lit(READ)))
               .otherwise(F.array(F.lit(CREATE))))
    return (j.select(key, "d_value", F.posexplode(actions).alias("step", "action"))
            .select(key, F.col("step").cast("int").alias("step"), "action",
                    F.when(F.col("action") == CREATE, F.col("d_value")).alias(value)))


def key_set_diff(declared: DataFrame, actual: DataFrame, key: str = "topic") -> DataFrame:
    """SET-4: keys only declared, only actual, or in both. One full outer
    join of the two distinct key sets (each side is read once)."""
    dk = declared.select(key, F.lit(True).alias("_d")).distinct()
    ak = actual.select(key, F.lit(True).alias("_a")).distinct()
    return dk.join(ak, key, "full_outer").select(
        key,
        F.when(F.col("_a").isNull(), F.lit("declared_only"))
         .when(F.col("_d").isNull(), F.lit("actual_only"))
         .otherwise(F.lit("both")).alias("membership"))


def topics_from_yaml(spark, text: str) -> DataFrame:
    """SRC-6: declared topics from a YAML document
    ``topics: [{<name>: {partition: <n>}}, ...]`` (driver-side config, a
    handful of rows)."""
    import yaml  # gated: only needed for config files

    doc = yaml.safe_load(text) or {}
    rows = []
    for item in doc.get("topics", []):
        for name, cfg in item.items():
            rows.append((name, int((cfg or {}).get("partition", 1))))
    return spark.createDataFrame(rows, "topic string, partitions int")
