"""Books with known indicators; levels are (price, size, number of orders), best first."""

import math

A0 = [(100, 0.5, 2), (101, 0.4, 2), (102, 0.3, 2), (103, 0.2, 2), (104, 0.1, 2)]
B0 = [(99, 0.5, 2), (98, 0.4, 2), (97, 0.3, 2), (96, 0.2, 2), (95, 0.1, 2)]
A1 = [(100, 0.1, 2), (101, 1.4, 2), (102, 0.3, 1), (103, 0.7, 3), (104, 0.5, 2)]
A1_MORE = A1 + [(105, 1.1, 1)]
B0_LESS = B0[1:]
B1 = [(99, 1.5, 1), (98, 3.4, 2), (97, 2.3, 4), (96, 1.2, 3), (95, 0.3, 1)]
B2 = [(99, 0.2, 1), (98, 0.4, 2), (97, 0.3, 2), (96, 0.2, 2), (95, 0.1, 2)]
A3 = [(100, 0.1, 1), (101, 0.6, 2), (102, 0.3, 1), (104, 0.5, 2), (105, 0.4, 2)]
B3 = [(99.5, 0.1, 1), (99, 0.2, 1), (97, 0.3, 2), (96, 0.2, 2), (95, 1.3, 1)]
CASE1 = {0: (A0, B0), 1000: (A1, B0), 2000: (A1, B1)}
CASE2 = {0: (A0, B0), 1000: (A1_MORE, B0_LESS), 2000: (A1, B2)}
CASE3_MORE = {3000: (A1, B2), 4000: (A3, B3)}


def full_books(spark, books, inst="X"):
    rows = [(inst, ts, side, float(p), float(z), n) for ts, both in books.items() for side, levels in zip(("ask", "bid"), both) for p, z, n in levels]
    return spark.createDataFrame(rows, "instId string, timestamp bigint, side string, price double, size double, numOrders bigint")


def case(spark, number):
    """Rows of a case, by the delta encoder."""
    from depthlake.operators.delta import delta_encode

    if number == 1:
        return delta_encode(full_books(spark, CASE1))
    rows = delta_encode(full_books(spark, CASE2))
    return rows if number == 2 else rows.unionByName(delta_encode(full_books(spark, CASE3_MORE)))


def wave(name):
    t = [i / 999 for i in range(1000)]
    phase = [3 * x % 1 for x in t]
    prices = {
        "sine": [1000 + 100 * math.sin(i / 100) for i in range(629)],
        "triangle": [1000 + 100 * (4 * p - 1 if p < 0.5 else 3 - 4 * p) for p in phase],
        "square": [1000 + 100 * (1 if p < 0.5 else -1) for p in phase],
        "gaussian": [1000 + 100 * math.exp(-((2 * x - 1) ** 2) / 2) for x in t],
        "const": [1000.0] * 1000,
    }[name]
    return {1000 * i: ([(round(p, 1) + k, 1.0, 1) for k in range(1, 6)], [(round(p, 1) - k, 1.0, 1) for k in range(1, 6)]) for i, p in enumerate(prices)}
