"""Matching traces (id:price x signed quantity) and their expected fills
per policy: (taker, maker, quantity, price)."""

TRACES = {
    "G": [("b1", 10, 20), ("s1", 11, -25), ("b2", 11, 20), ("b3", 11, 20)],
    "X": [("s1", 12, -10), ("s2", 11, -10), ("b1", 11.5, 5)],
    "V": [("s1", 11, -10), ("s2", 12, -10), ("b1", 12, 15)],
    "Y": [("s1", 11, -10), ("s2", 12, -10), ("b1", 11, 10), ("b2", 11, 4), ("s3", 13, -5), ("b3", 13, 12)],
    "Z": [("s1", 11, -10), ("s2", 11, -10), ("b1", 11, 4), ("b2", 11, 8)],
}

EXPECTED = {
    ("G", "first_seen", "tail"): [("b2", "s1", 20, 11), ("b3", "s1", 5, 11)],
    ("G", "best_price", "tail"): [("b2", "s1", 20, 11), ("b3", "s1", 5, 11)],
    ("G", "best_price", "head"): [("b2", "s1", 20, 11), ("b3", "s1", 5, 11)],
    ("X", "first_seen", "tail"): [],
    ("X", "best_price", "tail"): [("b1", "s2", 5, 11)],
    ("X", "best_price", "head"): [("b1", "s2", 5, 11)],
    ("V", "first_seen", "tail"): [("b1", "s1", 10, 11)],
    ("V", "best_price", "tail"): [("b1", "s1", 10, 11), ("b1", "s2", 5, 12)],
    ("V", "best_price", "head"): [("b1", "s1", 10, 11), ("b1", "s2", 5, 12)],
    ("Y", "first_seen", "tail"): [("b1", "s1", 10, 11), ("b3", "s3", 5, 13)],
    ("Y", "best_price", "tail"): [("b1", "s1", 10, 11), ("b3", "s2", 10, 12), ("b3", "s3", 2, 13)],
    ("Y", "best_price", "head"): [("b1", "s1", 10, 11), ("b3", "s2", 10, 12), ("b3", "s3", 2, 13)],
    ("Z", "first_seen", "tail"): [("b1", "s1", 4, 11), ("b2", "s2", 8, 11)],
    ("Z", "best_price", "tail"): [("b1", "s1", 4, 11), ("b2", "s2", 8, 11)],
    ("Z", "best_price", "head"): [("b1", "s1", 4, 11), ("b2", "s1", 6, 11), ("b2", "s2", 2, 11)],
}

# resting book after the trace: side -> [(price, order_id, remaining)] in priority order
EXPECTED_BOOK = {
    ("G", "first_seen", "tail"): {"BUY": [(10, "b1", 20), (11, "b3", 15)], "SELL": []},
    ("G", "best_price", "tail"): {"BUY": [(11, "b3", 15), (10, "b1", 20)], "SELL": []},
    ("X", "first_seen", "tail"): {"BUY": [(11.5, "b1", 5)], "SELL": [(12, "s1", 10), (11, "s2", 10)]},
    ("V", "first_seen", "tail"): {"BUY": [(12, "b1", 5)], "SELL": []},
    ("V", "best_price", "tail"): {"BUY": [], "SELL": [(12, "s2", 5)]},
    ("Y", "first_seen", "tail"): {"BUY": [(11, "b2", 4), (13, "b3", 7)], "SELL": []},
    ("Y", "best_price", "tail"): {"BUY": [(11, "b2", 4)], "SELL": [(13, "s3", 3)]},
    ("Z", "best_price", "tail"): {"BUY": [], "SELL": [(11, "s1", 6), (11, "s2", 2)]},
    ("Z", "best_price", "head"): {"BUY": [], "SELL": [(11, "s2", 8)]},
}


def trace_rows(name, symbol="X"):
    """(symbol, seq, order_id, price, quantity, timestamp) rows of a trace."""
    return [(symbol, i, oid, float(p), int(q), 1000 + i) for i, (oid, p, q) in enumerate(TRACES[name])]
