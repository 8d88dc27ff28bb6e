"""Tail risk from cells against sorted returns."""

import random

import numpy as np
import pytest
from helpers import at
from datetime import timedelta

from tapewright.operators import tails


def brute(values):
    found = {"observations": len(values)}
    for level, name in ((0.05, "95"), (0.01, "99")):
        cut = np.quantile(values, level)
        found[f"var_{name}"] = -cut
        found[f"cvar_{name}"] = -np.mean([v for v in values if v <= cut + 1e-15])
    return found


def agrees(row, values):
    want = brute(values)
    assert all(row[name] == pytest.approx(want[name], abs=1e-12) for name in want)


def test_tails_of_hot_small_and_equal_keys(spark):
    chosen = random.Random(4)
    data = {
        "HOT": [chosen.gauss(0, 0.01) for _ in range(20_000)],
        "TIES": [chosen.choice([-0.02, -0.01, 0.0, 0.0, 0.01]) for _ in range(997)],
        "SAME": [0.0] * 50,
        "ONE": [-0.3],
        "UP": [chosen.random() for _ in range(101)],
        "WIDE": [chosen.choice([-1, 1]) * 10 ** chosen.uniform(-15, 3) for _ in range(3_000)],
    }
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("NONE", None), ("HOT", None), ("HOT", float("nan")), ("HOT", float("-inf"))]
    frame = spark.createDataFrame(rows, "symbol string, ret double").repartition(5).cache()
    found = {r.symbol: r for r in tails.tail_figures(frame, ["symbol"]).collect()}
    assert sorted(found) == sorted(data)
    for key, values in data.items():
        agrees(found[key], values)
    assert tails.tail_figures(frame.where("false"), ["symbol"]).count() == 0


def test_states_of_days_merge_into_the_market(spark):
    chosen = random.Random(9)
    rows = [("all", f"d{chosen.randrange(5)}", f"S{chosen.randrange(9)}", chosen.gauss(0, 0.02)) for _ in range(4_000)]
    frame = spark.createDataFrame(rows, "market string, day string, symbol string, ret double")
    stored = tails.cell_states(frame, ["market", "day", "symbol"])
    merged = tails.merged_cells(stored, ["market"])
    agrees(tails.tail_figures(frame, ["market"], states=merged).first(), [r[3] for r in rows])


def test_returns_between_bars_across_days(spark):
    start = at("2024-01-30 22:00:00")
    bars = [(s, start + timedelta(hours=h), p) for s, h, p in (("A", 0, 10.0), ("A", 1, 11.0), ("A", 5, 22.0), ("B", 2, 1.0), ("C", 0, 0.0), ("C", 1, 5.0))]
    found = tails.bar_returns(spark.createDataFrame(bars, "symbol string, ts timestamp, close double"))
    assert sorted((r.symbol, round(r.ret, 9)) for r in found.collect()) == [("A", 0.1), ("A", 1.0)]
