"""DuckDB SQL for the correctness check.

These strings are the independent side of the check: the same answers as
the Spark plans, written as ANSI/DuckDB SQL over the fixture views. The
matching fold has a set-based SQL form: a recursive CTE that advances every
symbol's book by one order per step, all symbols at once.

Relations defined by ``match_ctes``:
  o      adapted orders (symbol, order_id, order_type, price, quantity, timestamp, seq)
  ob     o plus n = arrival index within the symbol
  st     book after each step (recursive)
  fills  one row per execution
  book   resting orders after the last order (ghost levels with NULL order_id)
  tops   best bid / ask after each order (rows where it changed)
"""

from __future__ import annotations

EVENTS_ORDERS = """
  SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol,
         'E-' || CAST(event_id AS VARCHAR) AS order_id,
         'limit' AS order_type,
         CAST(45.0 + floor(value) % 16 AS DOUBLE) AS price,
         CAST((10 + (event_id * 31) % 30)
              * CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END
              AS BIGINT) AS quantity,
         epoch_us(ts) AS timestamp,
         event_id AS seq
  FROM events"""

# Repeated (l_orderkey, l_linenumber) pairs: the place in the total order stands for seq.
LINEITEM_ORDERS = """
  SELECT symbol, order_id, 'limit' AS order_type, price, quantity, timestamp,
         row_number() OVER (PARTITION BY symbol ORDER BY l_orderkey * 8 + l_linenumber, l_suppkey, l_quantity,
                            l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq
  FROM (SELECT *, 'P' || CAST(l_partkey AS VARCHAR) AS symbol, 'L-' || l_orderkey || '-' || l_linenumber AS order_id,
               CAST(45.0 + floor(l_extendedprice) % 16 AS DOUBLE) AS price,
               CAST(l_quantity AS BIGINT) * CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS quantity,
               epoch_us(l_shipdate) AS timestamp
        FROM lineitem)"""

_FILL_T = ("STRUCT(taker_seq BIGINT, fill_idx INTEGER, taker_order_id VARCHAR, "
           "maker_order_id VARCHAR, maker_seq BIGINT, taker_side VARCHAR, price DOUBLE, "
           "quantity BIGINT, taker_remaining BIGINT, maker_remaining BIGINT, timestamp BIGINT)")

# ---------------------------------------------------------------- best_price
# A side is a list of entries kept sorted by (k, pos): k = price for asks,
# -price for bids, pos = queue key. Crossing entries are then a prefix.
_E_BEST = "STRUCT(k DOUBLE, pos BIGINT, oid VARCHAR, q BIGINT, seq BIGINT, ts BIGINT, price DOUBLE)"

_CROSS = "(CASE WHEN is_buy THEN e.price <= t_price ELSE e.price >= t_price END)"
_BEFORE = "coalesce(list_sum(list_transform(list_slice(opp, 1, i - 1), lambda y: y.q)), 0)"
_FILL = f"(CASE WHEN {_CROSS} THEN greatest(0, least(e.q, big_q - {_BEFORE})) ELSE 0 END)"


def _best_price_st(residual: str) -> str:
    requeue = "CASE WHEN e.f > 0 THEN t_seq ELSE e.pos END" if residual == "tail" else "e.pos"
    return f"""
st AS (
  SELECT symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS t_seq, CAST(NULL AS BIGINT) AS t_ts,
         CAST([] AS {_E_BEST}[]) AS bids, CAST([] AS {_E_BEST}[]) AS asks,
         CAST([] AS {_FILL_T}[]) AS fills
  FROM (SELECT DISTINCT symbol FROM o)
  UNION ALL
  SELECT symbol, n, t_seq, t_ts,
         CASE WHEN is_buy THEN new_own ELSE new_opp END,
         CASE WHEN is_buy THEN new_opp ELSE new_own END,
         new_fills
  FROM (
    SELECT symbol, n, t_seq, t_ts, is_buy,
      list_sort(list_transform(list_filter(x, lambda e: e.q > e.f),
        lambda e: struct_pack(k := e.k, pos := {requeue}, oid := e.oid, q := e.q - e.f,
                              seq := e.seq, ts := e.ts, price := e.price))) AS new_opp,
      CASE WHEN rem > 0 THEN list_sort(list_append(own, struct_pack(
             k := CASE WHEN is_buy THEN -t_price ELSE t_price END, pos := t_seq, oid := t_oid,
             q := rem, seq := t_seq, ts := t_ts, price := t_price))) ELSE own END AS new_own,
      list_transform(list_filter(x, lambda e: e.f > 0),
        lambda e, i: struct_pack(taker_seq := t_seq, fill_idx := CAST(i - 1 AS INTEGER),
                                 taker_order_id := t_oid, maker_order_id := e.oid, maker_seq := e.seq,
                                 taker_side := CASE WHEN is_buy THEN 'BUY' ELSE 'SELL' END,
                                 price := e.price, quantity := e.f, taker_remaining := big_q - e.cum,
                                 maker_remaining := e.q - e.f, timestamp := t_ts)) AS new_fills
    FROM (
      SELECT *, big_q - coalesce(list_sum(list_transform(x, lambda e: e.f)), 0) AS rem
      FROM (
        SELECT *, list_transform(opp, lambda e, i: struct_pack(
                 k := e.k, pos := e.pos, oid := e.oid, q := e.q, seq := e.seq, ts := e.ts,
                 price := e.price, f := {_FILL}, cum := {_BEFORE} + {_FILL})) AS x
        FROM (
          SELECT s.symbol, b.n, b.seq AS t_seq, b.order_id AS t_oid, b.price AS t_price,
                 b.timestamp AS t_ts, b.quantity > 0 AS is_buy, abs(b.quantity) AS big_q,
                 CASE WHEN b.quantity > 0 THEN s.asks ELSE s.bids END AS opp,
                 CASE WHEN b.quantity > 0 THEN s.bids ELSE s.asks END AS own
          FROM st s JOIN ob b ON b.symbol = s.symbol AND b.n = s.n + 1))))
)"""


_BEST_PRICE_TAIL = """
last_st AS (
  SELECT * FROM st QUALIFY n = max(n) OVER (PARTITION BY symbol)),
book_rows AS (
  SELECT symbol, 'BUY' AS side, unnest(bids) AS e FROM last_st
  UNION ALL
  SELECT symbol, 'SELL' AS side, unnest(asks) AS e FROM last_st),
book AS (
  SELECT symbol, side, e.price AS price,
         CAST(dense_rank() OVER (PARTITION BY symbol, side ORDER BY e.k) - 1 AS INTEGER) AS level_seq,
         CAST(row_number() OVER (PARTITION BY symbol, side, e.price ORDER BY e.pos) - 1 AS INTEGER) AS queue_pos,
         e.oid AS order_id, e.seq AS seq, e.q AS remaining, e.ts AS timestamp
  FROM book_rows),
step_tops AS (
  SELECT symbol, t_seq AS seq, t_ts AS timestamp,
         CASE WHEN len(bids) > 0 THEN bids[1].price END AS best_bid,
         CASE WHEN len(asks) > 0 THEN asks[1].price END AS best_ask, n
  FROM st WHERE n > 0)"""

# ---------------------------------------------------------------- first_seen
# A side is (levels: prices in insertion order, entries: sorted by pos).
# Only the first level is ever matched; see the README for the closed form.
_E_FS = "STRUCT(pos BIGINT, oid VARCHAR, q BIGINT, seq BIGINT, ts BIGINT, price DOUBLE)"
_BEFORE_FS = "coalesce(list_sum(list_transform(list_slice(q0, 1, i - 1), lambda y: y.q)), 0)"
_FILL_FS = f"greatest(0, least(e.q, big_q - {_BEFORE_FS}))"


def _first_seen_st(residual: str) -> str:
    requeue = "CASE WHEN e.f > 0 THEN t_seq ELSE e.pos END" if residual == "tail" else "e.pos"
    return f"""
st AS (
  SELECT symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS t_seq, CAST(NULL AS BIGINT) AS t_ts,
         CAST([] AS DOUBLE[]) AS bid_lv, CAST([] AS {_E_FS}[]) AS bids,
         CAST([] AS DOUBLE[]) AS ask_lv, CAST([] AS {_E_FS}[]) AS asks,
         CAST([] AS {_FILL_T}[]) AS fills
  FROM (SELECT DISTINCT symbol FROM o)
  UNION ALL
  SELECT symbol, n, t_seq, t_ts,
         CASE WHEN is_buy THEN new_own_lv ELSE new_opp_lv END,
         CASE WHEN is_buy THEN new_own ELSE new_opp END,
         CASE WHEN is_buy THEN new_opp_lv ELSE new_own_lv END,
         CASE WHEN is_buy THEN new_opp ELSE new_own END,
         new_fills
  FROM (
    SELECT symbol, n, t_seq, t_ts, is_buy,
      CASE WHEN NOT crossed THEN opp_lv
           WHEN left_in_q > 0 THEN opp_lv
           WHEN rem = 0 THEN list_slice(opp_lv, 1, len(opp_lv) - 1)
           ELSE CAST([] AS DOUBLE[]) END AS new_opp_lv,
      CASE WHEN NOT crossed THEN opp
           WHEN left_in_q > 0 THEN list_sort(list_concat(
                list_filter(opp, lambda e: e.price <> lv0),
                list_transform(list_filter(x, lambda e: e.q > e.f),
                  lambda e: struct_pack(pos := {requeue}, oid := e.oid, q := e.q - e.f,
                                        seq := e.seq, ts := e.ts, price := e.price))))
           WHEN rem = 0 THEN list_filter(opp, lambda e: e.price <> lv0 AND e.price <> opp_lv[len(opp_lv)])
           ELSE CAST([] AS {_E_FS}[]) END AS new_opp,
      CASE WHEN rem > 0 AND NOT list_contains(own_lv, t_price) THEN list_append(own_lv, t_price)
           ELSE own_lv END AS new_own_lv,
      CASE WHEN rem > 0 THEN list_append(own, struct_pack(pos := t_seq, oid := t_oid, q := rem,
             seq := t_seq, ts := t_ts, price := t_price)) ELSE own END AS new_own,
      list_transform(list_filter(x, lambda e: e.f > 0),
        lambda e, i: struct_pack(taker_seq := t_seq, fill_idx := CAST(i - 1 AS INTEGER),
                                 taker_order_id := t_oid, maker_order_id := e.oid, maker_seq := e.seq,
                                 taker_side := CASE WHEN is_buy THEN 'BUY' ELSE 'SELL' END,
                                 price := e.price, quantity := e.f, taker_remaining := big_q - e.cum,
                                 maker_remaining := e.q - e.f, timestamp := t_ts)) AS new_fills
    FROM (
      SELECT *,
             big_q - coalesce(list_sum(list_transform(x, lambda e: e.f)), 0) AS rem,
             coalesce(list_sum(list_transform(x, lambda e: e.q - e.f)), 0) AS left_in_q
      FROM (
        SELECT *, list_transform(q0, lambda e, i: struct_pack(
                 pos := e.pos, oid := e.oid, q := e.q, seq := e.seq, ts := e.ts, price := e.price,
                 f := {_FILL_FS}, cum := {_BEFORE_FS} + {_FILL_FS})) AS x
        FROM (
          SELECT *,
                 crossed_raw AND big_q > 0 AS crossed,
                 CASE WHEN crossed_raw AND big_q > 0
                      THEN list_sort(list_filter(opp, lambda e: e.price = lv0))
                      ELSE CAST([] AS {_E_FS}[]) END AS q0
          FROM (
            SELECT *, coalesce(CASE WHEN is_buy THEN lv0 <= t_price ELSE lv0 >= t_price END, false) AS crossed_raw
            FROM (
              SELECT s.symbol, b.n, b.seq AS t_seq, b.order_id AS t_oid, b.price AS t_price,
                     b.timestamp AS t_ts, b.quantity > 0 AS is_buy, abs(b.quantity) AS big_q,
                     CASE WHEN b.quantity > 0 THEN s.asks ELSE s.bids END AS opp,
                     CASE WHEN b.quantity > 0 THEN s.ask_lv ELSE s.bid_lv END AS opp_lv,
                     CASE WHEN b.quantity > 0 THEN s.bids ELSE s.asks END AS own,
                     CASE WHEN b.quantity > 0 THEN s.bid_lv ELSE s.ask_lv END AS own_lv,
                     CASE WHEN b.quantity > 0 THEN s.ask_lv ELSE s.bid_lv END[1] AS lv0
              FROM st s JOIN ob b ON b.symbol = s.symbol AND b.n = s.n + 1))))))
)"""


_FIRST_SEEN_TAIL = """
last_st AS (
  SELECT * FROM st QUALIFY n = max(n) OVER (PARTITION BY symbol)),
levels AS (
  SELECT symbol, 'BUY' AS side, unnest(bid_lv) AS price,
         CAST(generate_subscripts(bid_lv, 1) - 1 AS INTEGER) AS level_seq FROM last_st
  UNION ALL
  SELECT symbol, 'SELL' AS side, unnest(ask_lv) AS price,
         CAST(generate_subscripts(ask_lv, 1) - 1 AS INTEGER) AS level_seq FROM last_st),
entries AS (
  SELECT symbol, 'BUY' AS side, unnest(bids) AS e FROM last_st
  UNION ALL
  SELECT symbol, 'SELL' AS side, unnest(asks) AS e FROM last_st),
book AS (
  SELECT l.symbol, l.side, l.price, l.level_seq,
         CAST(CASE WHEN x.e.oid IS NOT NULL THEN row_number() OVER (
              PARTITION BY l.symbol, l.side, l.price ORDER BY x.e.pos) - 1 END AS INTEGER) AS queue_pos,
         x.e.oid AS order_id, x.e.seq AS seq, coalesce(x.e.q, 0) AS remaining, x.e.ts AS timestamp
  FROM levels l LEFT JOIN entries x
    ON x.symbol = l.symbol AND x.side = l.side AND x.e.price = l.price),
step_tops AS (
  SELECT symbol, t_seq AS seq, t_ts AS timestamp, bid_lv[1] AS best_bid, ask_lv[1] AS best_ask, n
  FROM st WHERE n > 0)"""


_COMMON_TAIL = """
fills AS (
  SELECT symbol, f.taker_seq, f.fill_idx, f.taker_order_id, f.maker_order_id, f.maker_seq,
         f.taker_side, f.price, f.quantity, f.taker_remaining, f.maker_remaining, f.timestamp
  FROM (SELECT symbol, unnest(fills) AS f FROM st)),
tops AS (
  SELECT symbol, seq, timestamp, best_bid, best_ask FROM (
    SELECT *, lag(best_bid) OVER w AS pb, lag(best_ask) OVER w AS pa,
              lag(n) OVER w AS pn
    FROM step_tops WINDOW w AS (PARTITION BY symbol ORDER BY n))
  WHERE pn IS NULL AND (best_bid IS NOT NULL OR best_ask IS NOT NULL)
     OR best_bid IS DISTINCT FROM pb OR best_ask IS DISTINCT FROM pa)"""


def match_ctes(level_priority: str = "best_price", residual: str = "tail",
               orders_sql: str = EVENTS_ORDERS) -> str:
    """``WITH RECURSIVE ...`` prefix; append a final SELECT over the relations."""
    if level_priority == "best_price":
        st, tail = _best_price_st(residual), _BEST_PRICE_TAIL
    else:
        st, tail = _first_seen_st(residual), _FIRST_SEEN_TAIL
    return (f"WITH RECURSIVE\no AS ({orders_sql}),\n"
            "ob AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq) AS n FROM o),"
            f"{st},{tail},{_COMMON_TAIL}\n")


def with_orders(orders_sql: str = EVENTS_ORDERS) -> str:
    """Plain ``WITH o AS (...)`` prefix for queries that need no matching."""
    return f"WITH o AS ({orders_sql})\n"


# ---------------------------------------------------------------- per query
HOUR_US = 3600 * 1_000_000

_LEGS = """,
legs AS (
  SELECT symbol, taker_seq, fill_idx, CAST(0 AS INTEGER) AS leg,
         sha256(symbol || '|' || CAST(taker_seq AS VARCHAR) || '|' || taker_order_id || '|' || CAST(fill_idx AS VARCHAR)) AS trade_id,
         taker_order_id AS order_id, quantity, price, taker_side AS action,
         CASE WHEN taker_remaining = 0 THEN 'closed' ELSE 'partial' END AS status, timestamp
  FROM fills
  UNION ALL
  SELECT symbol, taker_seq, fill_idx, CAST(1 AS INTEGER) AS leg,
         sha256(symbol || '|' || CAST(taker_seq AS VARCHAR) || '|' || taker_order_id || '|' || CAST(fill_idx AS VARCHAR)) AS trade_id,
         maker_order_id AS order_id, quantity, price,
         CASE WHEN taker_side = 'BUY' THEN 'SELL' ELSE 'BUY' END AS action,
         CASE WHEN maker_remaining = 0 THEN 'closed' ELSE 'partial' END AS status, timestamp
  FROM fills)
"""


def _mid_ticks_ctes(tick_us: int, until: str = "max(timestamp)") -> str:
    return f""",
bounds AS (SELECT symbol, min(timestamp) AS t0, {until} AS t1 FROM tops GROUP BY symbol),
grid AS (
  SELECT symbol, unnest(generate_series(g0, g1, {tick_us})) AS timestamp
  FROM (SELECT symbol, CAST(ceil(t0 / {tick_us}) AS BIGINT) * {tick_us} AS g0,
               CAST(floor(t1 / {tick_us}) AS BIGINT) * {tick_us} AS g1 FROM bounds)
  WHERE g0 <= g1),
as_of AS (
  SELECT symbol, timestamp, is_grid,
         last_value(top IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp, is_grid, seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top
  FROM (SELECT symbol, timestamp, seq, 0 AS is_grid,
               struct_pack(best_bid := best_bid, best_ask := best_ask) AS top FROM tops
        UNION ALL
        SELECT symbol, timestamp, CAST(NULL AS BIGINT), 1, NULL FROM grid)),
mid_ticks AS (
  SELECT symbol, timestamp AS tick_ts, top.best_bid AS best_bid, top.best_ask AS best_ask,
         (top.best_bid + top.best_ask) / 2 AS mid_price
  FROM as_of
  WHERE is_grid = 1 AND top.best_bid IS NOT NULL AND top.best_ask IS NOT NULL AND top.best_bid > 0)
"""


_FILLED = """,
filled AS (
  SELECT symbol, order_id, CAST(sum(quantity) AS BIGINT) AS filled, count(*) AS n_fills
  FROM (SELECT symbol, taker_order_id AS order_id, quantity FROM fills
        UNION ALL SELECT symbol, maker_order_id AS order_id, quantity FROM fills)
  GROUP BY symbol, order_id)
"""

_TOP = """
  SELECT symbol, arg_min(price, level_seq) FILTER (WHERE side = 'BUY') AS best_bid,
         arg_min(price, level_seq) FILTER (WHERE side = 'SELL') AS best_ask
  FROM book GROUP BY symbol"""


def oracles() -> dict[str, str]:
    m = match_ctes()
    mf = match_ctes("first_seen")
    mh = match_ctes("best_price", "head")
    o = with_orders()
    hour = HOUR_US
    mid = f"""SELECT symbol, best_bid, best_ask,
       CASE WHEN best_bid IS NOT NULL AND best_ask IS NOT NULL AND best_bid > 0
            THEN (best_bid + best_ask) / 2 END AS mid_price
FROM ({_TOP})"""
    return {
        "match_orders": m + "SELECT * FROM fills",
        "match_orders_first_seen": mf + "SELECT * FROM fills",
        "match_orders_head": mh + "SELECT * FROM fills",
        "book_snapshot": m + "SELECT * FROM book",
        "book_snapshot_first_seen": mf + "SELECT * FROM book",
        "rest_orders": o + """
SELECT symbol, side, price,
       CAST(dense_rank() OVER (PARTITION BY symbol, side
            ORDER BY CASE WHEN side = 'BUY' THEN -price ELSE price END) - 1 AS INTEGER) AS level_seq,
       CAST(row_number() OVER (PARTITION BY symbol, side, price ORDER BY seq) - 1 AS INTEGER) AS queue_pos,
       order_id, seq, quantity AS remaining, timestamp
FROM (SELECT *, CASE WHEN quantity > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM o)""",
        "trade_legs": m + _LEGS + """
SELECT symbol, trade_id, order_id, quantity, price, action, status, timestamp FROM legs""",
        "execution_legs": m + _LEGS + "SELECT * FROM legs",
        "pair_legs": m + _LEGS + """
SELECT trade_id, max(CASE WHEN action = 'BUY' THEN order_id END) AS buy_order_id,
       max(CASE WHEN action <> 'BUY' THEN order_id END) AS sell_order_id,
       max(quantity) AS quantity, max(price) AS price, max(timestamp) AS timestamp,
       count(*) AS legs
FROM legs GROUP BY trade_id""",
        "price_points": m + "SELECT symbol, taker_seq, fill_idx, price, timestamp FROM fills",
        "order_fill_state": m + _FILLED + """
SELECT o.symbol, o.order_id, o.seq, CASE WHEN o.quantity > 0 THEN 'BUY' ELSE 'SELL' END AS side,
       abs(o.quantity) AS original, coalesce(f.filled, 0) AS filled,
       abs(o.quantity) - coalesce(f.filled, 0) AS remaining, coalesce(f.n_fills, 0) AS n_fills,
       CASE WHEN abs(o.quantity) = 0 THEN 'noop'
            WHEN abs(o.quantity) - coalesce(f.filled, 0) = 0 THEN 'closed'
            WHEN coalesce(f.filled, 0) > 0 THEN 'partial' ELSE 'open' END AS status
FROM o LEFT JOIN filled f ON f.symbol = o.symbol AND f.order_id = o.order_id""",
        "running_remaining": m + """
SELECT *, CASE WHEN remaining = 0 THEN 'closed' ELSE 'partial' END AS status FROM (
  SELECT l.symbol, l.order_id, l.taker_seq, l.fill_idx, l.leg, l.quantity,
         CAST(abs(o.quantity) - sum(l.quantity) OVER (PARTITION BY l.symbol, l.order_id
              ORDER BY l.taker_seq, l.fill_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS BIGINT) AS remaining
  FROM (SELECT symbol, taker_order_id AS order_id, taker_seq, fill_idx, quantity, 0 AS leg FROM fills
        UNION ALL
        SELECT symbol, maker_order_id, taker_seq, fill_idx, quantity, 1 FROM fills) l
  JOIN o ON o.symbol = l.symbol AND o.order_id = l.order_id)""",
        "best_bid": m + """
SELECT symbol, arg_min(price, level_seq) AS best_bid FROM book WHERE side = 'BUY' GROUP BY symbol""",
        "best_ask": m + """
SELECT symbol, arg_min(price, level_seq) AS best_ask FROM book WHERE side = 'SELL' GROUP BY symbol""",
        "mid_price": m + mid,
        "two_sided_books": m + f"SELECT * FROM ({mid}) WHERE mid_price IS NOT NULL",
        "level_count": mf + """
SELECT symbol, side, count(DISTINCT price) AS levels FROM book GROUP BY symbol, side""",
        "volume_at_price": m + """
SELECT symbol, side, price, CAST(sum(remaining) AS BIGINT) AS volume, count(order_id) AS orders
FROM book GROUP BY symbol, side, price""",
        "level_queues": m + """
SELECT symbol, side, price, min(level_seq) AS level_seq, count(*) AS orders,
       CAST(sum(remaining) AS BIGINT) AS volume,
       arg_min(order_id, queue_pos) AS head_order_id, arg_max(order_id, queue_pos) AS tail_order_id
FROM book WHERE order_id IS NOT NULL GROUP BY symbol, side, price""",
        "queue_position": m + """
SELECT symbol, side, price, order_id, remaining,
       CAST(row_number() OVER (PARTITION BY symbol, side, price ORDER BY queue_pos) AS INTEGER) AS position
FROM book WHERE order_id IS NOT NULL""",
        "match_priority": m + """
SELECT symbol, side, price, order_id, remaining,
       CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY level_seq, queue_pos) AS INTEGER) AS priority
FROM book WHERE order_id IS NOT NULL""",
        "book_depth": m + """
SELECT symbol, side, price, order_id, remaining,
       CAST(sum(remaining) OVER (PARTITION BY symbol, side ORDER BY level_seq, queue_pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_depth
FROM book WHERE order_id IS NOT NULL""",
        "ask_ladder": m + """
SELECT symbol, price, CAST(sum(remaining) AS BIGINT) AS volume,
       CAST(row_number() OVER (PARTITION BY symbol ORDER BY price) AS INTEGER) AS rank
FROM book WHERE side = 'SELL' GROUP BY symbol, price""",
        "bid_ladder": m + """
SELECT symbol, price, CAST(sum(remaining) AS BIGINT) AS volume,
       CAST(row_number() OVER (PARTITION BY symbol ORDER BY price DESC) AS INTEGER) AS rank
FROM book WHERE side = 'BUY' GROUP BY symbol, price""",
        "top_levels": m + """
SELECT * FROM (
  SELECT symbol, side, price, min(level_seq) AS level_seq, CAST(sum(remaining) AS BIGINT) AS volume,
         CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY min(level_seq)) AS INTEGER) AS rank
  FROM book GROUP BY symbol, side, price)
WHERE rank <= 3""",
        "queue_cut": m + """
SELECT symbol, side, price, order_id, remaining,
       CAST(queue_pos - CASE WHEN queue_pos > 0 THEN 1 ELSE 0 END AS INTEGER) AS queue_pos
FROM book WHERE order_id IS NOT NULL AND queue_pos <> 0""",
        "price_stream": m + _LEGS + """
SELECT symbol, timestamp, source, taker_seq, k, price,
       CAST(row_number() OVER (PARTITION BY symbol ORDER BY timestamp, source, taker_seq, k) AS INTEGER) AS ord
FROM (SELECT symbol, timestamp, 'trade' AS source, taker_seq, CAST(fill_idx * 2 + leg AS INTEGER) AS k, price
      FROM legs
      UNION ALL
      SELECT symbol, timestamp, 'price' AS source, taker_seq, CAST(fill_idx AS INTEGER) AS k, price
      FROM fills)""",
        "last_price": m + """
SELECT symbol, seq, last_price FROM (
  SELECT symbol, seq, kind,
         coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq, kind, fill_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CAST(50.0 AS DOUBLE)) AS last_price
  FROM (SELECT symbol, seq, CAST(NULL AS DOUBLE) AS price, 0 AS kind, 0 AS fill_idx FROM o
        UNION ALL
        SELECT symbol, taker_seq, price, 1, fill_idx FROM fills))
WHERE kind = 0""",
        "mid_ticks_stream": m + _mid_ticks_ctes(hour) + "SELECT * FROM mid_ticks",
        "price_heartbeat_stream": m + f"""
SELECT symbol, price, timestamp AS source_ts,
       unnest(CASE WHEN next_ts > timestamp + {hour}
                   THEN generate_series(timestamp + {hour}, next_ts - 1, {hour})
                   ELSE CAST([] AS BIGINT[]) END) AS beat_ts
FROM (SELECT symbol, price, timestamp,
             lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp, taker_seq, fill_idx) AS next_ts
      FROM fills)
WHERE next_ts IS NOT NULL""",
        "service_price_topic": m + _mid_ticks_ctes(hour, "(SELECT max(timestamp) // 1000 * 1000 FROM o)") + """
SELECT symbol AS key, CAST(to_json(struct_pack(price := price)) AS VARCHAR) AS value
FROM (SELECT symbol, price FROM fills UNION ALL SELECT symbol, mid_price AS price FROM mid_ticks)""",
        "service_counts": m + f""",
msgs AS (SELECT value, CASE WHEN json_valid(value) THEN value END AS j FROM ({ORDER_MESSAGES})),
flags AS (SELECT coalesce({_json_is_object()}, false) AS good FROM msgs)
SELECT 'ingest' AS name, 'messages' AS metric, count(*) AS value FROM flags
UNION ALL SELECT 'ingest', 'consumed', count(*) FROM flags WHERE good
UNION ALL SELECT 'ingest', 'malformed', count(*) FROM flags WHERE NOT good
UNION ALL SELECT 'produced', 'trades', 2 * count(*) FROM fills
UNION ALL SELECT 'produced', 'prices', count(*) FROM fills""",
        "trader_order_ids": with_orders() + """
SELECT order_id, 'Trader-' || substr(symbol, 2) AS trader_id,
       'Trader-' || substr(symbol, 2) || '-' || CAST(timestamp * 1000 AS VARCHAR) AS trader_order_id FROM o""",
        "seeds_in_book": match_ctes(orders_sql=SEEDED_ORDERS) + """
SELECT * FROM book
UNION ALL
SELECT 'P' || p_partkey, s.side, s.price, 0, 0, 'SEED-P' || p_partkey || '-' || s.tag, s.seq, 100, 0
FROM part, (VALUES ('BUY', 49.5::DOUBLE, 'BID', -2), ('SELL', 50.5::DOUBLE, 'ASK', -1)) s(side, price, tag, seq)""",
        "unique_trades_stream": m + _LEGS + """
SELECT trade_id, order_id, quantity, price, action, status, timestamp FROM legs""",
        "book_after_batch": match_ctes(orders_sql=f"""
  SELECT symbol, order_id, order_type, price, quantity, timestamp, seq
  FROM (SELECT *, min(seq) OVER () AS a, max(seq) OVER () AS b FROM ({EVENTS_ORDERS}))
  WHERE floor((seq - a) * 3 / (b - a + 1)) < 2""") + "SELECT * FROM book",
        "level_pages": m + """
SELECT symbol, side, price, CAST(queue_pos // 2 AS INTEGER) AS page, CAST(queue_pos // 2 * 2 AS INTEGER) AS first_pos,
       string_agg(order_id || ':' || remaining, ',' ORDER BY queue_pos) AS entries
FROM book WHERE order_id IS NOT NULL GROUP BY symbol, side, price, queue_pos // 2""",
        "level_pages_cut": m + """
SELECT symbol, side, price, CAST(queue_pos // 2 AS INTEGER) AS page,
       CAST(queue_pos // 2 * 2 - CASE WHEN queue_pos // 2 > 1 THEN 1 ELSE 0 END AS INTEGER) AS first_pos,
       string_agg(order_id || ':' || remaining, ',' ORDER BY queue_pos) AS entries
FROM book WHERE order_id IS NOT NULL AND queue_pos <> 2 GROUP BY symbol, side, price, queue_pos // 2""",
        # seq is the place in the total order there, so it never repeats
        "last_price_lineitem": match_ctes(orders_sql=LINEITEM_ORDERS) + """
SELECT symbol, order_id, CAST(seq - 1 AS BIGINT) AS arrival, last_price FROM (
  SELECT symbol, order_id, seq, kind,
         coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq, kind, fill_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), CAST(50.0 AS DOUBLE)) AS last_price
  FROM (SELECT symbol, order_id, seq, CAST(NULL AS DOUBLE) AS price, 0 AS kind, 0 AS fill_idx FROM o
        UNION ALL
        SELECT symbol, NULL, taker_seq, price, 1, fill_idx FROM fills))
WHERE kind = 0""",
        "top_of_book": m + "SELECT * FROM tops",
        "mid_ticks": m + _mid_ticks_ctes(hour) + "SELECT * FROM mid_ticks",
        "price_heartbeat": m + f"""
SELECT symbol, price, timestamp AS source_ts,
       unnest(CASE WHEN next_ts > timestamp + {hour}
                   THEN generate_series(timestamp + {hour}, next_ts - 1, {hour})
                   ELSE CAST([] AS BIGINT[]) END) AS beat_ts
FROM (SELECT symbol, price, timestamp,
             lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp, taker_seq, fill_idx) AS next_ts
      FROM fills)
WHERE next_ts IS NOT NULL""",
        "price_topic": m + _mid_ticks_ctes(hour) + """
SELECT symbol, timestamp, 'fill' AS source, price FROM fills
UNION ALL
SELECT symbol, tick_ts AS timestamp, 'mid' AS source, mid_price AS price FROM mid_ticks""",
        "src_orders": o + "SELECT * FROM o",
        "order_side": o + """
SELECT symbol, order_id, seq, CASE WHEN quantity > 0 THEN 'BUY' ELSE 'SELL' END AS side,
       abs(quantity) AS magnitude FROM o""",
        "nonzero_orders": o + "SELECT * FROM o WHERE quantity <> 0 AND seq % 7 <> 0",
        **record_oracles(),
        **more_oracles(),
        "match_orders_stream": m + "SELECT * FROM fills",
        "seeded_match_stream": match_ctes(orders_sql=SEEDED_ORDERS) + "SELECT * FROM fills",
        "drain_available": "SELECT CAST(count(*) AS BIGINT) AS rows_processed FROM events",
        "replay_equal": m + _LEGS + """
SELECT count(*) AS first_run, count(*) AS second_run, CAST(0 AS BIGINT) AS differing FROM legs""",
    }


ORDER_MESSAGES = f"""
  SELECT 'order' AS source, CAST(seq AS VARCHAR) AS msg_id,
         CAST(to_json(struct_pack(order_id := order_id, order_type := order_type, price := price,
                                  quantity := quantity, timestamp := timestamp)) AS VARCHAR) AS value
  FROM ({EVENTS_ORDERS})
  UNION ALL
  SELECT 'props' AS source, CAST(event_id AS VARCHAR) AS msg_id, props AS value FROM events
  UNION ALL
  SELECT 'chat' AS source, conv_id || '-' || turn AS msg_id, text AS value FROM conversations"""


def _json_is_object() -> str:
    # j is the text when it is valid JSON, else NULL (json functions raise on bad text)
    return "coalesce(json_type(j) = 'OBJECT', false)"


def _json_type_ok(field: str, ctype: str) -> str:
    t = f"json_type(j, '$.{field}')"
    num = f"{t} IN ('BIGINT', 'UBIGINT', 'DOUBLE')"
    if ctype == "string":
        return f"{t} = 'VARCHAR'"
    if ctype == "number":
        return num
    if ctype == "integer":
        d = f"CAST(json_extract(j, '$.{field}') AS DOUBLE)"
        return f"({t} IN ('BIGINT', 'UBIGINT') OR ({t} = 'DOUBLE' AND {d} = floor({d})))"
    if ctype == "boolean":
        return f"{t} = 'BOOLEAN'"
    raise ValueError(ctype)


def _violations_sql(contract: dict) -> str:
    required = set(contract["required"])
    parts = []
    for f, spec in contract["properties"].items():
        t = f"json_type(j, '$.{f}')"
        if f in required:
            parts.append(f"CASE WHEN {t} IS NULL THEN 'missing:{f}' END")
        parts.append(f"CASE WHEN {t} IS NOT NULL AND NOT coalesce({_json_type_ok(f, spec['type'])}, false) "
                     f"THEN 'type:{f}' END")
    return (f"CASE WHEN j IS NULL THEN 'not_json' "
            f"WHEN json_type(j) <> 'OBJECT' THEN 'not_object' "
            f"ELSE concat_ws(',', {', '.join(parts)}) END")


def record_oracles() -> dict[str, str]:
    from crossbook.sources.contracts import CONTRACTS
    msgs = ("WITH msgs AS (SELECT *, CASE WHEN json_valid(value) THEN value END AS j "
            f"FROM ({ORDER_MESSAGES}))\n")
    parsed = f"""
SELECT source, msg_id,
       coalesce(json_extract_string(j, '$.order_id'), '') AS order_id,
       coalesce(json_extract_string(j, '$.order_type'), '') AS order_type,
       coalesce(CAST(json_extract(j, '$.price') AS DOUBLE), 0.0) AS price,
       coalesce(CAST(json_extract(j, '$.quantity') AS BIGINT), 0) AS quantity,
       coalesce(CAST(json_extract(j, '$.timestamp') AS BIGINT), 0) AS timestamp
FROM msgs WHERE {_json_is_object()}"""
    viol = _violations_sql(CONTRACTS["order"])
    m = match_ctes() + _LEGS
    return {
        "parse_orders": msgs + parsed,
        "src_microbatch": msgs + parsed,
        "quarantine": msgs + f"""
SELECT source, msg_id, length(value) AS n_chars FROM msgs WHERE NOT {_json_is_object()}""",
        "ingest_counts": msgs + f"""
SELECT source, CASE WHEN {_json_is_object()} THEN 'consumed' ELSE 'malformed' END AS outcome,
       count(*) AS messages
FROM msgs GROUP BY ALL""",
        "validate_records": msgs + f"""
SELECT source, msg_id, v = '' AS valid, v AS violations FROM (SELECT source, msg_id, {viol} AS v FROM msgs)""",
        "parse_trades": m + """
SELECT symbol, trade_id, order_id, quantity, price, action, status, timestamp FROM legs""",
        "parse_prices": m + "SELECT symbol, taker_seq, fill_idx, price FROM fills",
        "json_round_trip": m + """
SELECT 'order' AS record, count(*) AS records, count(*) AS identical FROM o
UNION ALL SELECT 'trade', count(*), count(*) FROM legs
UNION ALL SELECT 'pricepoint', count(*), count(*) FROM fills""",
    }


def _mix(x: str, salt: int) -> str:
    from crossbook.operators.generate import MIX_MOD, MIX_MUL, MIX_SALT
    return f"(((({x}) % {MIX_MOD}) * {MIX_MUL} + {salt * MIX_SALT}) % {MIX_MOD} * {MIX_MUL} % {MIX_MOD})"


def _uniform(x: str, salt: int) -> str:
    from crossbook.operators.generate import MIX_MOD
    return f"(CAST({_mix(x, salt)} AS DOUBLE) / CAST({MIX_MOD} AS DOUBLE))"


_EVENT_IDS = """
  SELECT 'U' || CAST(user_id AS VARCHAR) AS symbol, event_id, epoch_us(ts) AS timestamp FROM events"""

SEEDED_ORDERS = f"""
  SELECT * FROM ({EVENTS_ORDERS})
  UNION ALL
  SELECT symbol, 'SEED-' || symbol || '-BID', 'limit', CAST(49.5 AS DOUBLE), CAST(100 AS BIGINT),
         min(timestamp), CAST(-2 AS BIGINT) FROM ({EVENTS_ORDERS}) GROUP BY symbol
  UNION ALL
  SELECT symbol, 'SEED-' || symbol || '-ASK', 'limit', CAST(50.5 AS DOUBLE), CAST(-100 AS BIGINT),
         min(timestamp), CAST(-1 AS BIGINT) FROM ({EVENTS_ORDERS}) GROUP BY symbol"""


def _validate_schema_sql() -> str:
    """Expected VAL-2 rows: every derived column has its contract type."""
    from crossbook.sources.contracts import CONTRACTS
    parts = []
    for name, rel in (("order", "o"), ("trade", "legs"), ("pricepoint", "fills")):
        for field, spec in CONTRACTS[name]["properties"].items():
            parts.append(f"SELECT '{name}' AS contract, '{field}' AS field, '{spec['type']}' AS expected_type, "
                         f"'{spec['type']}' AS actual_type, true AS ok, count({field}) AS non_null FROM {rel}")
    return "\n" + "\nUNION ALL ".join(parts)


def more_oracles() -> dict[str, str]:
    m = match_ctes()
    d = "," + ",".join([
        "\ndeclared AS (SELECT symbol || ':' || side AS topic, count(DISTINCT price) AS partitions "
        "FROM book GROUP BY symbol, side)",
        "\nactual AS (SELECT symbol || ':' || side AS topic, count(DISTINCT price) AS partitions "
        "FROM (SELECT symbol, CASE WHEN quantity > 0 THEN 'BUY' ELSE 'SELL' END AS side, price FROM o) "
        "GROUP BY symbol, side)",
        "\nj AS (SELECT coalesce(d.topic, a.topic) AS topic, d.partitions AS dp, a.partitions AS ap, "
        "d.topic IS NOT NULL AS in_d, a.topic IS NOT NULL AS in_a "
        "FROM declared d FULL OUTER JOIN actual a ON d.topic = a.topic)\n"])
    gen1 = f""",
pu AS (SELECT symbol, taker_seq * 1000 + fill_idx AS price_id, price, timestamp FROM fills),
gen AS (
  SELECT symbol,
         'Trader-' || CAST({_mix('price_id', 4)} % 600 AS VARCHAR) || '-'
           || CAST(timestamp * 1000 + price_id % 1000 AS VARCHAR) AS order_id,
         'limit' AS order_type,
         CASE WHEN {_mix('price_id', 2)} % 2 = 0
              THEN price * (CAST(1.0 AS DOUBLE) + {_uniform('price_id', 3)} / CAST(100.0 AS DOUBLE)) + CAST(0.5 AS DOUBLE)
              ELSE price * (CAST(1.0 AS DOUBLE) - {_uniform('price_id', 3)} / CAST(100.0 AS DOUBLE)) - CAST(0.5 AS DOUBLE)
         END AS price,
         CAST(CASE WHEN {_mix('price_id', 2)} % 2 = 0 THEN 1 ELSE -1 END * (10 + {_mix('price_id', 1)} % 30) AS BIGINT) AS quantity,
         timestamp, price_id AS seq
  FROM pu)
"""
    ids = f"WITH ids AS ({_EVENT_IDS})\n"
    rtrades = f"""
SELECT symbol, 'T-' || CAST(event_id AS VARCHAR) AS trade_id,
       'T-' || CAST(event_id AS VARCHAR) || '-' || CAST(leg AS VARCHAR) AS order_id,
       CAST(10 + {_mix('event_id', 7)} % 41 AS BIGINT) AS quantity,
       CAST(40.0 AS DOUBLE) + {_uniform('event_id', 8)} * CAST(5.0 AS DOUBLE) AS price,
       CASE WHEN leg = 0 THEN 'BUY' ELSE 'SELL' END AS action, 'PARTIAL' AS status, timestamp
FROM ids, (SELECT unnest([0, 1]) AS leg)"""
    to_json_order = ("CAST(to_json(struct_pack(order_id := order_id, order_type := order_type, "
                     "price := price, quantity := quantity, timestamp := timestamp)) AS VARCHAR)")
    to_json_trade = ("CAST(to_json(struct_pack(trade_id := trade_id, order_id := order_id, quantity := quantity, "
                     "price := price, action := action, status := status, timestamp := timestamp)) AS VARCHAR)")
    return {
        "reconcile_diff": m + d + """
SELECT topic, CAST(0 AS INTEGER) AS step, 'DELETE' AS action, CAST(NULL AS BIGINT) AS partitions
FROM j WHERE in_a AND (NOT in_d OR dp IS DISTINCT FROM ap)
UNION ALL SELECT topic, CAST(1 AS INTEGER), 'CREATE', dp FROM j WHERE in_a AND in_d AND dp IS DISTINCT FROM ap
UNION ALL SELECT topic, CAST(0 AS INTEGER), 'READ', CAST(NULL AS BIGINT) FROM j
          WHERE in_a AND in_d AND dp IS NOT DISTINCT FROM ap
UNION ALL SELECT topic, CAST(0 AS INTEGER), 'CREATE', dp FROM j WHERE NOT in_a""",
        "key_set_diff": m + d + """
SELECT topic, 'declared_only' AS membership FROM j WHERE in_d AND NOT in_a
UNION ALL SELECT topic, 'actual_only' FROM j WHERE in_a AND NOT in_d
UNION ALL SELECT topic, 'both' FROM j WHERE in_a AND in_d""",
        "orders_from_prices": m + gen1 + "SELECT * FROM gen",
        "order_ids": m + gen1 + "SELECT symbol, seq, order_id FROM gen",
        "random_orders": ids + f"""
SELECT symbol, 'R-' || CAST(event_id AS VARCHAR) AS order_id, 'limit' AS order_type,
       CAST(45 + {_mix('event_id', 5)} % 16 AS DOUBLE) AS price,
       CAST(CASE WHEN {_mix('event_id', 6)} % 101 - 50 = 0 THEN 1 ELSE {_mix('event_id', 6)} % 101 - 50 END
            AS BIGINT) AS quantity,
       timestamp, event_id AS seq
FROM ids""",
        "random_trades": ids + rtrades,
        "normalize_labels": m + _LEGS + """
SELECT trade_id, order_id, action, status FROM legs""",
        "match_lineitem": match_ctes(orders_sql=LINEITEM_ORDERS) + """
SELECT symbol, taker_order_id, maker_order_id, fill_idx, taker_side, price, quantity, taker_remaining,
       maker_remaining FROM fills""",
        "match_reduced": match_ctes(orders_sql=LINEITEM_ORDERS) + """
SELECT symbol, taker_order_id, maker_order_id, fill_idx, taker_side, price, quantity, taker_remaining,
       maker_remaining FROM fills""",
        "book_reduced": match_ctes(orders_sql=LINEITEM_ORDERS) + """
SELECT symbol, side, price, level_seq, queue_pos, order_id, remaining, timestamp FROM book""",
        "fold_load_reduced": f"""
WITH o AS ({LINEITEM_ORDERS}),
x AS (SELECT symbol, quantity, price, min(CASE WHEN quantity < 0 THEN price END) OVER w AS lowest_sell,
             max(CASE WHEN quantity > 0 THEN price END) OVER w AS highest_buy, count(*) OVER w AS n
      FROM o WINDOW w AS (PARTITION BY symbol)),
per AS (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE n < 2 OR quantity = 0
               OR (quantity > 0 AND price >= lowest_sell) OR (quantity < 0 AND price <= highest_buy)) AS in_fold
        FROM x GROUP BY symbol)
SELECT CAST(sum(n) AS BIGINT) AS orders, CAST(sum(in_fold) AS BIGINT) AS in_fold, sum(in_fold) / sum(n) AS fold_share,
       max(n) AS largest_symbol_orders, max(in_fold) AS largest_symbol_in_fold FROM per""",
        "seed_orders": with_orders() + """
SELECT symbol, 'SEED-' || symbol || '-BID' AS order_id, 'limit' AS order_type, CAST(49.5 AS DOUBLE) AS price,
       CAST(100 AS BIGINT) AS quantity, min(timestamp) AS timestamp, CAST(-2 AS BIGINT) AS seq
FROM o GROUP BY symbol
UNION ALL
SELECT symbol, 'SEED-' || symbol || '-ASK', 'limit', CAST(50.5 AS DOUBLE), CAST(-100 AS BIGINT),
       min(timestamp), CAST(-1 AS BIGINT)
FROM o GROUP BY symbol""",
        "seeded_match": match_ctes(orders_sql=SEEDED_ORDERS) + "SELECT * FROM fills",
        "normalize_epoch": """
WITH ev AS (SELECT event_id, epoch_us(ts) AS us FROM events),
raw AS (
  SELECT event_id, 's' AS unit, CAST(floor(us / 1000000) AS BIGINT) AS raw FROM ev
  UNION ALL SELECT event_id, 'ms', CAST(floor(us / 1000) AS BIGINT) FROM ev
  UNION ALL SELECT event_id, 'us', us FROM ev
  UNION ALL SELECT event_id, 'ns', us * 1000 FROM ev)
SELECT event_id, unit, raw,
       CASE WHEN abs(raw) < 100000000000 THEN raw * 1000000
            WHEN abs(raw) < 100000000000000 THEN raw * 1000
            WHEN abs(raw) < 100000000000000000 THEN raw
            ELSE raw // 1000 END AS micros
FROM raw""",
        "sweep_book": m + """,
mk AS (
  SELECT symbol, side, price, order_id, remaining,
         CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY level_seq, queue_pos) - 1 AS INTEGER) AS rank,
         CAST(sum(remaining) OVER (PARTITION BY symbol, side ORDER BY level_seq, queue_pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - remaining AS BIGINT) AS before
  FROM book WHERE order_id IS NOT NULL)
SELECT t.symbol, t.seq AS taker_seq, t.order_id AS taker_order_id,
       CASE WHEN t.quantity > 0 THEN 'BUY' ELSE 'SELL' END AS taker_side,
       mk.rank, mk.order_id AS maker_order_id, mk.price,
       least(mk.remaining, abs(t.quantity) - mk.before) AS quantity
FROM o t JOIN mk ON mk.symbol = t.symbol AND mk.side = CASE WHEN t.quantity > 0 THEN 'SELL' ELSE 'BUY' END
WHERE abs(t.quantity) > 0 AND mk.before < abs(t.quantity)
  AND CASE WHEN t.quantity > 0 THEN mk.price <= t.price ELSE mk.price >= t.price END""",
        "crossing_orders": m + f""",
top AS ({_TOP})
SELECT o.symbol, o.seq, o.order_id, o.side, o.price,
       CASE WHEN o.side = 'BUY' THEN top.best_ask ELSE top.best_bid END AS opposite_best
FROM (SELECT *, CASE WHEN quantity > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM o) o
JOIN top ON top.symbol = o.symbol
WHERE o.quantity <> 0
  AND coalesce(CASE WHEN o.side = 'BUY' THEN o.price >= top.best_ask ELSE o.price <= top.best_bid END, false)""",
        "topic_dump": with_orders() + f"""
SELECT timestamp, seq AS "offset", {to_json_order} AS value FROM o WHERE seq >= 0""",
        "queue_removed": m + """
SELECT symbol, side, price, max(CASE WHEN queue_pos = 1 THEN order_id END) AS removed_order_id,
       max(CASE WHEN queue_pos = 1 THEN remaining END) AS removed_quantity, max(queue_pos) >= 1 AS in_range
FROM book WHERE order_id IS NOT NULL GROUP BY symbol, side, price""",
        "fold_load": """
WITH per AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS symbol, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS symbols, CAST(sum(n) AS BIGINT) AS orders, max(struct_pack(n := n, symbol := symbol)).symbol AS largest_symbol,
       max(n) AS largest_orders, max(n) / sum(n) AS largest_share FROM per""",
        "topic_dump_partitions": with_orders() + f"""
SELECT p AS partition, timestamp, seq AS "offset", {to_json_order} AS value
FROM (SELECT *, CAST(CAST(substr(symbol, 2) AS BIGINT) % 4 AS INTEGER) AS p FROM o)
WHERE (p = 0 AND seq >= 0) OR (p = 1 AND seq >= 300) OR (p = 2 AND seq >= 500) OR (p = 3 AND seq >= 0)""",
        "topic_segments_dump": with_orders() + f""",
placed AS (SELECT *, CAST(CAST(substr(symbol, 2) AS BIGINT) % 4 AS INTEGER) AS p FROM o),
numbered AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY seq) - 1 AS place FROM placed)
SELECT p AS partition, CAST(place AS BIGINT) AS "offset", timestamp, symbol AS key, {to_json_order} AS value
FROM numbered WHERE place >= CASE p WHEN 1 THEN 20 WHEN 2 THEN 50 WHEN 3 THEN 5 ELSE 0 END""",
        "published_orders": with_orders() + f"""
SELECT 'orders.topic' AS topic, symbol AS key, {to_json_order} AS value FROM o WHERE seq % 7 <> 0 AND quantity <> 0""",
        "service_segments": match_ctes(orders_sql=f"""
  SELECT symbol, order_id, order_type, price, quantity, timestamp,
         row_number() OVER (PARTITION BY CAST(substr(symbol, 2) AS BIGINT) % 4 ORDER BY seq) - 1 AS seq
  FROM ({EVENTS_ORDERS})""") + _LEGS + f"""
SELECT 'trades.topic' AS topic, trade_id AS key, {to_json_trade} AS value FROM legs
UNION ALL
SELECT 'order.last_price.topic', symbol, CAST(to_json(struct_pack(price := price)) AS VARCHAR) FROM fills""",
        "order_topic_service": m + _LEGS + f"""
SELECT 'trades.topic' AS topic, trade_id AS key, {to_json_trade} AS value FROM legs
UNION ALL
SELECT 'order.last_price.topic', symbol, CAST(to_json(struct_pack(price := price)) AS VARCHAR) FROM fills
UNION ALL
SELECT 'quarantine', CAST(NULL AS VARCHAR), value
FROM (SELECT value, CASE WHEN json_valid(value) THEN value END AS j FROM ({ORDER_MESSAGES}))
WHERE NOT {_json_is_object()}""",
        "book_from_stream": m + "SELECT * FROM book",
        "sink_orders_json": with_orders() + f"""
SELECT symbol AS key, {to_json_order} AS value FROM o WHERE quantity <> 0""",
        "sink_trades_json": m + _LEGS + f"SELECT trade_id AS key, {to_json_trade} AS value FROM legs",
        "sink_prices_json": m + _mid_ticks_ctes(HOUR_US) + """
SELECT symbol AS key, CAST(to_json(struct_pack(price := price)) AS VARCHAR) AS value
FROM (SELECT symbol, price FROM fills UNION ALL SELECT symbol, mid_price AS price FROM mid_ticks)""",
        "validate_schema": m + _LEGS + _validate_schema_sql(),
        "src_price_inputs": m + _LEGS + """
SELECT 'trades.topic' AS topic, count(*) AS messages, sum(price) AS price_sum FROM legs
UNION ALL
SELECT 'order.last_price.topic', count(*), sum(price) FROM fills""",
    }
