"""Tables without a key: worked cases, and random changes against a plain loop."""

import random
from collections import Counter

import pytest

from tidemark.operators import keyless

ROW = "struct<op:int,w:string>"


def run(spark, rows, changes):
    """changes: (op, old, new), in order of position."""
    table = spark.createDataFrame(rows, "op int, w string")
    sent = spark.createDataFrame([(i, 0, *c) for i, c in enumerate(changes)], f"commit_lsn bigint, seq int, op string, old {ROW}, new {ROW}")
    left, missing = keyless.applied(table, sent, ["op", "w"])
    return Counter(map(tuple, left.collect())), sorted(r["commit_lsn"] for r in missing.collect())


def plain(rows, changes):
    table, missing = Counter(rows), []
    for i, (op, old, new) in enumerate(changes):
        if op != "I":
            if not table[old]:
                missing.append(i)
                continue
            table[old] -= 1
        if op != "D":
            table[new] += 1
    return +table, missing


def test_a_missing_update_leaves_nothing_for_later_ones(spark):
    a, b, c, d = (1, "a"), (None, "b"), (3, None), (4, "d")
    changes = [("U", a, b), ("U", b, c), ("U", c, d), ("D", d, None)]
    assert run(spark, [], changes) == (Counter(), [0, 1, 2, 3])
    assert run(spark, [a, a], changes) == (Counter([a]), [])
    assert run(spark, [c], changes) == (Counter(), [0, 1])


def test_odd_tables(spark):
    a = (1, "a")
    assert run(spark, [], []) == (Counter(), [])
    assert run(spark, [a, a, (None, None)], []) == (Counter([a, a, (None, None)]), [])
    assert run(spark, [a], [("U", a, a), ("D", a, None), ("U", a, a), ("I", None, a)]) == (Counter([a]), [2])


@pytest.mark.parametrize("copies", [2, keyless.COPIES])
def test_random_changes(spark, copies, monkeypatch):
    monkeypatch.setattr(keyless, "COPIES", copies)
    r = random.Random(5)
    values = [(i % 3 or None, "xy"[i % 2]) for i in range(6)]
    rows = [r.choice(values) for _ in range(9)]
    changes = [(op, r.choice(values) if op != "I" else None, r.choice(values) if op != "D" else None) for op in r.choices("IUD", [1, 4, 2], k=60)]
    assert run(spark, rows, changes) == plain(rows, changes)
