"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion into Spark's ``noop`` sink (the full plan
executes, nothing is collected to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from crossbook.plans import catalog  # noqa: E402
from crossbook.plans.match import match_orders  # noqa: E402
from crossbook.session import local_session  # noqa: E402
from crossbook.sources.fixtures import LINEITEM_TIEBREAK, lineitem_orders  # noqa: E402

HEADLINE = [
    "match_orders", "match_orders_first_seen", "book_snapshot", "trade_legs",
    "order_fill_state", "volume_at_price", "book_depth", "mid_ticks", "price_heartbeat",
    "sweep_book", "crossing_orders", "running_remaining", "validate_records", "parse_orders",
    "reconcile_diff", "seeded_match",
]


def run(df) -> float:
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def timed(make) -> float:
    """Seconds to build the query (some run eager checkpoint jobs) and run it."""
    t0 = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shuffle = int(os.environ.get("BENCH_SHUFFLE", str(2 * int(cpus)) if cpus.isdigit() else "16"))
    spark = local_session(cpus, shuffle_partitions=shuffle, app_name="crossbook-bench")
    qs = catalog.registry()
    # warm up the JVM and the Python workers (untimed)
    run(qs["src_orders"](spark, sf_dir))
    run(match_orders(qs["src_orders"](spark, sf_dir)).fills)

    times = {}
    for name in HEADLINE:
        times[name] = round(timed(lambda: qs[name](spark, sf_dir)), 3)

    # the bench adapter: every lineitem row is an order, one symbol per part
    orders = lineitem_orders(spark, sf_dir)
    n_orders = orders.count()
    res = match_orders(orders, tiebreak=LINEITEM_TIEBREAK)
    t = run(res.raw)
    times["match_lineitem"] = round(t, 3)
    n_fills = res.fills.agg(F.count(F.lit(1))).first()[0]

    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "match_lineitem_orders_per_sec": round(n_orders / t, 1) if t else None,
        "match_lineitem_orders": n_orders,
        "match_lineitem_fills": n_fills,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
