"""The keyed fold: worked cases, and random histories against a plain loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import apply, resolve

ROW = "struct<v:int,w:int>"


def t(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)


def run(spark, state, changes, deltas=(), own=1, tiebreakers=None, resolver="last_update_wins"):
    """state: rows (k, v, w, ts, origin); changes: rows (k, lsn, ts, origin, op, new, old, changed)."""
    s = spark.createDataFrame([(k, v, w, t(ts), o) for k, v, w, ts, o in state], "k int, v int, w int, _ts timestamp_ntz, _origin int")
    c = spark.createDataFrame([(k, n, 0, t(ts), o, op, new, old, changed) for k, n, ts, o, op, new, old, changed in changes], f"k int, commit_lsn bigint, seq int, commit_ts timestamp_ntz, origin_id int, op string, new {ROW}, old {ROW}, changed array<string>")
    return apply.fold(c, s, ["k"], ["v", "w"], deltas, own, tiebreakers, resolver)


def one(spark, state, change, **kw):
    """A change of origin 2 to key 1, as (op, ts, new, old, changed)."""
    op, ts, new, old, changed = change
    f = run(spark, [(1, *state)] if state else [], [(1, 1, ts, 2, op, new, old, changed)], **kw).first()
    row = None if not f["present"] else (f["v"], f["w"], int((f["_ts"] - t(0)).total_seconds()), f["_origin"])
    entry = f["log"][0]
    return row, entry["conflict_type"], entry["resolution"], entry["failed"]


@pytest.mark.parametrize(
    ("state", "change", "kw", "row", "kind", "how"),
    [
        (None, ("I", 10, (5, None), None, None), {}, (5, None, 10, 2), None, None),
        ((5, None, 10, 0), ("U", 11, (6, None), None, None), {}, (6, None, 11, 2), "update_origin_differs", "apply_remote"),
        ((5, None, 12, 0), ("U", 11, (6, None), None, None), {}, (5, None, 12, 0), "update_origin_differs", "keep_local"),
        ((5, None, 10, 2), ("U", 10, (6, None), None, None), {}, (6, None, 10, 2), None, None),
        ((5, None, 10, 0), ("U", 10, (6, None), None, None), {}, (5, None, 10, 0), "update_origin_differs", "keep_local"),
        ((5, None, 10, 0), ("U", 10, (6, None), None, None), {"own": 3}, (6, None, 10, 2), "update_origin_differs", "apply_remote"),
        ((5, None, 10, 0), ("U", 10, (6, None), None, None), {"own": 2}, (6, None, 10, 2), "update_origin_differs", "apply_remote"),
        ((5, None, 10, 0), ("I", 11, (7, None), None, None), {}, (7, None, 11, 2), "insert_exists", "apply_remote"),
        ((5, None, 12, 0), ("I", 11, (7, None), None, None), {}, (5, None, 12, 0), "insert_exists", "keep_local"),
        ((5, None, 12, 0), ("D", 11, None, None, None), {}, (5, None, 12, 0), "delete_exists", "skip"),
        ((5, None, 10, 0), ("D", 11, None, None, None), {}, None, "delete_origin_differs", "apply_remote"),
        (None, ("D", 11, None, None, None), {}, None, "delete_missing", "skip"),
        ((1000, None, 10, 0), ("U", 9, (0, None), (1000, None), None), {"deltas": ["v"]}, (0, None, 10, 0), "update_origin_differs", "keep_local"),
        ((1000, None, 10, 0), ("I", 11, (50, None), None, None), {"deltas": ["v"]}, (1050, None, 11, 2), "insert_exists", "apply_remote"),
        ((1000, None, 10, 0), ("U", 11, (70, 1), (None, 1), None), {"deltas": ["v"]}, (70, 1, 11, 2), "update_origin_differs", "apply_remote"),
        ((1000, None, 10, 0), ("U", 11, (70, None), None, None), {"deltas": ["v"]}, (1000, None, 11, 2), "update_origin_differs", "apply_remote"),
        ((1, 2, 10, 0), ("U", 11, (None, 9), None, ["w"]), {}, (1, 9, 11, 2), "update_origin_differs", "apply_remote"),
        ((5, None, 10, 0), ("U", 9, (6, None), None, None), {"resolver": "first_update_wins"}, (6, None, 9, 2), "update_origin_differs", "apply_remote"),
        ((5, None, 10, 0), ("U", 11, (6, None), None, None), {"resolver": "keep_local"}, (5, None, 10, 0), "update_origin_differs", "keep_local"),
    ],
)
def test_worked_cases(spark, state, change, kw, row, kind, how):
    assert one(spark, state, change, **kw) == (row, kind, how, False)


def test_update_of_a_missing_row_fails(spark):
    assert one(spark, None, ("U", 11, (6, None), None, None)) == (None, "update_missing", "skip", True)


def test_a_delete_leaves_no_trace(spark):
    f = run(spark, [(1, 5, None, 1, 2)], [(1, 1, 11, 2, "D", None, None, None), (1, 2, 9, 2, "I", (3, None), None, None)]).first()
    assert (f["present"], f["v"], f["_ts"]) == (True, 3, t(9))


def test_two_nodes_exchange_withdrawals(spark):
    assert one(spark, (0, None, 10, 0), ("U", 9, (0, None), (1000, None), None), deltas=["v"])[0][0] == -1000


def plain(state, changes, own=1):
    """The rules once more, as a loop."""
    rows = {k: [v, w, ts, o] for k, v, w, ts, o in state}
    for k, _, ts, o, op, new, _, changed in sorted(changes, key=lambda c: c[1]):
        row = rows.get(k)
        if row is None:
            if op == "I":
                rows[k] = [*new, ts, o]
            continue
        wins = ts > row[2] or (ts == row[2] and (o == row[3] or o <= own))
        if not wins:
            continue
        if op == "D":
            del rows[k]
        else:
            rows[k] = [new[i] if changed is None or c in changed else row[i] for i, c in enumerate("vw")] + [ts, o]
    return sorted((k, *r) for k, r in rows.items())


@pytest.mark.parametrize("seed", range(3))
def test_random_histories(spark, seed):
    r = random.Random(seed)
    state = [(k, k, -k, r.randrange(20), 0) for k in range(5)]
    changes = []
    for n in range(400):
        op = r.choice("IUUUD")
        new = None if op == "D" else (r.randrange(100), r.choice([None, 7]))
        changes.append((r.randrange(12), n, r.randrange(30), r.randrange(3), op, new, None, r.choice([None, ["v"]]) if op == "U" else None))
    got = apply.rows(run(spark, state, changes)).collect()
    assert sorted((g["k"], g["v"], g["w"], int((g["_ts"] - t(0)).total_seconds()), g["_origin"]) for g in got) == plain(state, changes)


def test_batches_carry_over(spark):
    r = random.Random(9)
    changes = [(r.randrange(4), n, r.randrange(30), r.randrange(3), op, None if op == "D" else (n, n), None, None) for n in range(60) for op in [r.choice("IUD")]]
    whole = apply.rows(run(spark, [], changes)).collect()
    half = apply.rows(run(spark, [], changes[:30])).collect()
    state = [(h["k"], h["v"], h["w"], int((h["_ts"] - t(0)).total_seconds()), h["_origin"]) for h in half]
    assert sorted(whole) == sorted(apply.rows(run(spark, state, changes[30:])).collect())


def test_short_way_agrees(spark):
    changes = [(n % 7, n, (n * 37) % 101, 2, "I" if n < 7 else "U", (n, n), None, None) for n in range(80)]
    full = apply.rows(run(spark, [], changes)).select("k", "v").collect()
    c = spark.createDataFrame([(c[0], c[1], 0, t(c[2]), c[5][0]) for c in changes], "k int, commit_lsn bigint, seq int, commit_ts timestamp_ntz, v int")
    assert sorted(full) == sorted(resolve.newest(c, ["k"]).select("k", "v").collect())


def test_error_resolver_raises(spark):
    with pytest.raises(Exception, match="resolver is error"):
        run(spark, [(1, 5, None, 10, 0)], [(1, 1, 11, 2, "U", (6, None), None, None)], resolver="error").collect()


def test_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="OVERFLOW"):
        run(spark, [(1, 2**31 - 1, None, 10, 0)], [(1, 1, 11, 2, "U", (5, None), (1, None), None)], deltas=["v"]).select(F.sum("v")).collect()


@pytest.mark.parametrize("seqs", [1, 40])
def test_hot_keys_go_range_by_range(spark, seqs, monkeypatch):
    """A key with a third of the rows, some of them in one commit, gives the same rows and log as one fold."""
    r = random.Random(4)
    changes = [(0 if n % 3 == 0 else r.randrange(1, 9), 1000 + n // seqs, n % seqs, t(r.randrange(50)), r.randrange(3), op, None if op == "D" else (n, n), None, None) for n in range(900) for op in [r.choice("IUUD")]]
    c = spark.createDataFrame(changes, f"k int, commit_lsn bigint, seq int, commit_ts timestamp_ntz, origin_id int, op string, new {ROW}, old {ROW}, changed array<string>")
    s = spark.createDataFrame([(0, 1, 1, t(0), 0), (77, 1, 1, t(0), 0)], "k int, v int, w int, _ts timestamp_ntz, _origin int")
    sizes, fold = [], apply.fold
    monkeypatch.setattr(apply, "fold", lambda c, *a: sizes.append(c.groupBy("k").count().agg(F.max("count")).first()[0]) or fold(c, *a))
    rows, log = apply.applied(c, s, ["k"], ["v", "w"], max_changes=120)
    whole = fold(c, s, ["k"], ["v", "w"])
    assert sorted(rows.collect()) == sorted(apply.rows(whole).collect())
    assert sorted(map(repr, log.collect())) == sorted(map(repr, apply.log(whole, ["k"]).collect())) and log.count() == 900
    assert len(sizes) >= 4 and max(sizes) <= 120
