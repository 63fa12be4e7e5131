"""Publication, exceptions, catalog, sync, verification and streaming in small cases."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import delta, lsn, names
from tidemark.operators import apply, errors, monitor, publish, resolve, sync, verify
from tidemark.operators.catalog import Catalog, CatalogError
from tidemark.plans import queries as plans
from tidemark.sources import changes as ch
from tidemark.streaming.apply_stream import Versions, apply_stream, counts_by_window


def ids(frame, c="id"):
    return sorted(r[c] for r in frame.select(c).collect())


def test_unknown_rejects_and_modes_differ(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 5, 'a'), (2, NULL, 'a'), (3, 9, NULL), (4, 9, 'b') AS v(id, n, s)")
    filters = ["n > 4", "s = 'a'"]
    assert ids(publish.of_rows(rows, filters)) == [1]
    assert ids(publish.of_rows(rows, filters, "copy")) == [1, 2, 3, 4]
    assert ids(publish.of_rows(rows, ["n > 4"])) == [1, 3, 4]
    assert ids(publish.of_rows(rows, [])) == [1, 2, 3, 4]


def test_filters_reach_the_scan(spark, sf_dir):
    plan = publish.of_columns(publish.of_rows(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id > 100"]), ["user_id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(user_id,100)" in text and "ReadSchema: struct<user_id:bigint>" in text


@pytest.mark.parametrize("text", ["id", "id > 1; drop", "id > (select 1)", "rand() > 0.5", "sum(id) > 1", "id > 1, n > 2"])
def test_not_a_filter(spark, text):
    with pytest.raises(Exception):
        publish.checked_filter(spark.sql("SELECT 1 AS id, 2 AS n"), text)


def test_columns_of_a_filter(spark):
    assert publish.dependent_columns(spark.sql("SELECT 1 AS id, 2 AS n, 'x' AS s"), "id > 1 AND s = 'x'") == ["id", "s"]


def test_policies_unite_lists_and_masks(spark):
    c = Catalog()
    c.node_create("n", "local")
    c.repset_create("a", update=False, delete=False)
    c.repset_add_table("a", "t", columns=["x", "y"])
    c.repset_add_table("default", "t", key=["x"])
    got = c.show_table(spark, "t", ["a", "default"]).first()
    assert got["columns"] == ["x", "y"] and got["replicate_update"]
    assert not c.show_table(spark, "t", ["a"]).first()["replicate_update"]


def test_images(spark):
    row = "struct<x:int>"
    c = spark.createDataFrame([((1,), (2,)), ((3,), None)], f"old {row}, new {row}")
    assert [r["x"] for r in c.select(*publish.on_image(["x"])).collect()] == [2, 3]


def test_repair_ends_with_its_transaction(spark):
    rows = [(1, 1, 0, "M", "repair_on"), (1, 2, 0, "I", None), (2, 3, 0, "I", None)]
    c = spark.createDataFrame(rows, "xid int, commit_lsn int, seq int, op string, message string")
    assert ids(publish.outside_repair(c), "commit_lsn") == [3]


def _failing(spark):
    rows = [(1, 1, 0, "I", False), (1, 1, 1, "I", True), (1, 1, 2, "I", False), (2, 2, 0, "I", False), (3, 3, 0, "U", True)]
    return spark.createDataFrame(rows, "xid int, commit_lsn int, seq int, op string, failed boolean").withColumn("error_message", F.lit("bad"))


@pytest.mark.parametrize(("policy", "left", "logged"), [("discard", 3, 2), ("transdiscard", 1, 4), ("sub_disable", 0, 4)])
def test_policies_of_exceptions(spark, policy, left, logged):
    assert errors.applied(_failing(spark), policy).count() == left
    log = errors.exception_log(_failing(spark), policy).collect()
    assert len(log) == logged
    if policy != "discard":
        own = {(r["xid"], r["command_counter"]): r["error_message"] for r in log}
        assert own[1, 2] == "bad" and own[1, 1] == own[1, 3] == "discarded due to exception at command_counter 2"
    if policy == "sub_disable":
        assert {r["operation"] for r in log if r["xid"] == 1} == {"I", "SUB_DISABLE"}
    assert errors.exception_log(_failing(spark), policy, "none").count() == 0


def test_catalog_rules(spark):
    c = Catalog()
    assert c.node_create("n1", "dsn", info={"tiebreaker": 7}) == c.nodes["n1"].node_id
    assert c.tiebreaker("n1") == 7
    c.node_create("n2", "dsn", node_id=2)
    assert c.tiebreaker("n2") == 2
    for bad in (lambda: c.node_create("n1", "x"), lambda: c.node_create("n3", "x", node_id=2), lambda: c.repset_add_table("default", "t"), lambda: c.repset_add_table("default", "t", key=["a"], columns=["b"]), lambda: c.repset_drop("default"), lambda: c.sub_create("Bad Name", "n1"), lambda: c.sub_create("s", "none"), lambda: c.sub_enable("none"), lambda: c.node_drop("none"), lambda: c.queue_message("X", {})):
        with pytest.raises(CatalogError):
            bad()
    c.sub_create("s1", "n1", apply_delay_ms=5)
    with pytest.raises(CatalogError):
        c.node_drop("n1")
    assert c.sub_add_repset("s1", "extra") and not c.sub_add_repset("s1", "extra") and c.sub_remove_repset("s1", "extra")
    c.sub_disable("s1")
    c.sub_alter_skiplsn("s1", 9)
    c.sub_alter_options("s1", forward_origins=["all"])
    shown = c.frame(spark, "subscriptions").first()
    assert (shown["enabled"], shown["skip_lsn"], shown["forward_origins"], shown["apply_delay_ms"]) == (False, 9, ["all"], 5)
    assert c.route("t", ["id"]) == "default" and c.route("t", []) == "default_insert_only" and c.route("t", [], kept=False) is None
    c.repset_add_table("default", "p", key=["id"], row_filter="id > 0")
    assert c.repset_add_partition("p", "p1") == 1 and c.members["default", "p1"].row_filter == "id > 0"
    assert c.repset_remove_partition("p", "p1") == 1 and c.repset_remove_table("default", "p")
    assert c.sub_drop("s1") and not c.sub_drop("s1", ifexists=True) and c.node_drop("n1")
    c.queue_message("Q", {"sql": "x"}, ["default"])
    assert json.loads(c.frame(spark, "queue").first()["message"]) == {"sql": "x"}
    c.pause_apply()
    assert not c.may_apply()
    c.resume_apply()
    assert c.may_apply()


def test_text_of_positions(spark):
    got = spark.sql("SELECT '1/FF' AS a, 'x/1' AS b, 'FFFFFFFF/0' AS c, '7FFFFFFF/FFFFFFFF' AS d").select(*[lsn.parse(F.col(c)).alias(c) for c in "abcd"]).first()
    assert tuple(got) == (2**32 + 255, None, None, 2**63 - 1)


def test_text_of_positions_with_long_halves(spark, tmp_path):
    """Second halves of more than 32 bits are shown in full and carry into the first when read; plain positions stay as they were."""
    ids = [0, 4_294_967, 4_294_968, 5_999_999]
    spark.createDataFrame([(i,) for i in ids], "event_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, plans.QUERIES["lsn_text"](spark, str(tmp_path)).select("event_id", "shown", "parsed", "behind").collect()))
    assert got == [(i, f"{i // 7:X}/{i * 1000:X}", (i // 7 << 32) + i * 1000, 1000) for i in ids]
    assert len(got[-1][1].split("/")[1]) == 9
    text = spark.sql("SELECT '1/100000001' AS a, '7FFFFFFF/FFFFFFFFF' AS b, '5/FFFFFFFF' AS c")
    assert tuple(text.select(*[lsn.parse(F.col(c), carries=True) for c in "abc"]).first()) == (2**33 + 1, None, 6 * 2**32 - 1)
    assert text.select(lsn.parse(F.col("a"))).first()[0] is None and text.select(lsn.show(lsn.parse(F.col("c")))).first()[0] == "5/FFFFFFFF"


def test_registry_of_merges(spark):
    r = delta.Registry()
    r.register("t", "n", lambda old, new, local: F.greatest(new, local))
    row = spark.sql("SELECT 1 AS old, 5 AS new, 3 AS local")
    c = [F.col(x) for x in ("old", "new", "local")]
    assert row.select(r.merge("t", "n", "int")(*c)).first()[0] == 5 and row.select(r.merge("t", "m", "int")(*c)).first()[0] == 7
    with pytest.raises(ValueError):
        delta.delta_apply(*c, "string")


def test_slot_names(spark):
    long = "a" * 30
    got = spark.createDataFrame([("db", "p-1", long)], "d string, p string, s string").select(names.slot_name(F.col("d"), F.col("p"), F.col("s"))).first()[0]
    assert got.startswith("spk_db_p_1_aaaaaaaa") and len(got) == len("spk_db_p_1_") + 16


def test_md5_chain_and_nulls(spark):
    import hashlib

    rows = spark.sql("SELECT * FROM VALUES (1, 'b'), (1, 'a'), (2, NULL), (2, 'x') AS v(g, x)")
    got = {r["g"]: r["h"] for r in rows.groupBy("g").agg(verify.md5_agg(F.col("x")).alias("h")).collect()}
    h = hashlib.md5((hashlib.md5(b"a").hexdigest() + "b").encode()).hexdigest()
    assert got == {1: h, 2: None}


def test_sync_states(spark):
    s = spark.createDataFrame([("s", "a", "syncdone", 5), ("s", "b", "catchup", 5), ("s", "c", "syncdone", 50)], "sub_name string, rel string, status string, status_lsn bigint")
    got = {r["rel"]: r["status"] for r in sync.advanced(s, spark.createDataFrame([("s", 10)], "sub_name string, applied_lsn bigint")).collect()}
    assert got == {"a": "ready", "b": "syncdone", "c": "syncdone"}


def test_lsn_before_the_first_newer_commit(spark):
    c = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 9)), (3, dt.datetime(2024, 1, 2))], "commit_lsn int, commit_ts timestamp_ntz")
    at = lambda d: monitor.lsn_at(c, F.lit(dt.datetime(2024, 1, d)).cast("timestamp_ntz")).first()[0]
    assert at(3) == 1 and at(10) == 3


def test_probe_of_a_partial_index(spark):
    state = spark.createDataFrame([(1, 7, True), (2, 8, False)], "a int, b int, c boolean")
    new = spark.createDataFrame([(3, 7, True), (4, 8, True), (5, 7, False)], "a int, b int, c boolean")
    got = resolve.unique_probe(new, state, ["a"], ["b"], where="c").collect()
    assert [(r["a"], r["met_a"]) for r in got] == [(3, 1)]


def test_unknown_columns_are_an_error(spark):
    with pytest.raises(ValueError):
        ch.aligned(spark.sql("SELECT 1 AS a, 2 AS b"), T.StructType.fromDDL("a int"))


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    row = T.StructType.fromDDL("event_type string, value double")
    c = ch.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    lines = c.select("commit_lsn", "seq", "commit_ts", "origin_id", "op", F.struct("key").alias("k"), F.struct("event_type", "value").alias("new"))
    flat = lines.select("*", "k.key").drop("k")
    schema = T.StructType([flat.schema[f] for f in flat.columns])
    for i in range(3):
        flat.where((F.col("commit_lsn") >= i * 400) & (F.col("commit_lsn") < (i + 1) * 400)).coalesce(1).write.parquet(str(tmp_path / "all" / f"b={i}"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all" / "*"))
    full = read.withColumn("old", F.lit(None).cast(row)).withColumn("changed", F.lit(None).cast("array<string>"))
    empty = c.limit(0).select("key", "event_type", "value", F.col("commit_ts").alias("_ts"), F.col("origin_id").alias("_origin"))
    q = apply_stream(full, empty, str(tmp_path / "t"), str(tmp_path / "ck"), ["key"], ["event_type", "value"], log_path=str(tmp_path / "log"))
    q.awaitTermination()
    from tidemark.operators import apply

    batch = apply.rows(apply.fold(flat.withColumn("old", F.lit(None).cast(row)).withColumn("changed", F.lit(None).cast("array<string>")), empty, ["key"], ["event_type", "value"]))
    got = Versions(spark, str(tmp_path / "t")).newest()
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    assert spark.read.parquet(str(tmp_path / "log")).count() == flat.count()


def test_windowed_counts(spark, sf_dir):
    c = ch.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    assert counts_by_window(c).agg(F.sum("n")).first()[0] == c.count()


def test_unique_probe_of_one_hot_value_is_linear(spark):
    """200,000 rows of one value: all pairs would be 4e10 rows."""
    from tidemark.operators import resolve

    c = spark.range(200_000).selectExpr("id AS k", "IF(id % 2 = 0, 7L, NULL) AS v")
    for distinct, least, n in ((True, {0: 2, 2: 0}, 100_000), (False, {0: 2, 1: 3, 2: 0, 3: 1}, 200_000)):
        got = resolve.unique_probe(c, c, ["k"], ["v"], nulls_distinct=distinct)
        assert got.count() == n
        assert {r["k"]: r["met_k"] for r in got.where("k < 4").collect()} == least


def test_whole_tables_are_probed(spark, sf_dir):
    from tidemark.plans import queries as plans

    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    assert plans.QUERIES["unique_probe_not_distinct"](spark, sf_dir).count() > customers // 2
    assert {len(r["sub"]) > 16 for r in plans.QUERIES["slot_names"](spark, sf_dir).collect()} == {True, False}


def plain_transactions(changes, state):
    """Transactions one after the other on a dict; one with an update of a missing row leaves nothing behind. The table, and the xids that failed."""
    table, bad = dict(state), set()
    for xid in sorted({c[0] for c in changes}):
        now, good = dict(table), True
        for _, _, key, op, value in sorted(c for c in changes if c[0] == xid):
            if op == "D":
                now.pop(key, None)
            elif op == "U" and key not in now:
                good = False
                break
            else:
                now[key] = value
        table = now if good else table
        bad |= set() if good else {xid}
    return table, bad


@pytest.mark.parametrize("seed", [1, 2])
def test_transactions_that_fail_leave_nothing_behind(spark, seed):
    """Also where what a failing transaction didn't do makes a later one fail, or succeed."""
    r = random.Random(seed)
    changes = [(lsn_ // 3, lsn_, r.randrange(6), r.choice("IUUUD"), float(lsn_)) for lsn_ in range(45)]
    rows = [(k, n, 0, x, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n), 2, op, None if op == "D" else (v,), None, None) for x, n, k, op, v in changes]
    c = spark.createDataFrame(rows, "k int, commit_lsn bigint, seq int, xid bigint, commit_ts timestamp_ntz, origin_id int, op string, new struct<v:double>, old struct<v:double>, changed array<string>")
    state = spark.createDataFrame([(k, -1.0, dt.datetime(2020, 1, 1), 0) for k in range(4)], "k int, v double, _ts timestamp_ntz, _origin int")
    table, _, exceptions = apply.with_policy(c, state, ["k"], ["v"])
    want, bad = plain_transactions(changes, dict.fromkeys(range(4), -1.0))
    assert len(bad) > 2 and {x["k"]: x["v"] for x in table.collect()} == want
    logged = exceptions.collect()
    assert {x["xid"] for x in logged} == bad and len(logged) == 3 * len(bad)
    table, _, exceptions = apply.with_policy(c, state, ["k"], ["v"], "sub_disable")
    assert {x["k"]: x["v"] for x in table.collect()} == plain_transactions([x for x in changes if x[0] < min(bad)], dict.fromkeys(range(4), -1.0))[0]
    assert {x["xid"] for x in exceptions.collect()} == {min(bad)}


@pytest.mark.parametrize("policy", ["transdiscard", "discard", "sub_disable"])
def test_updates_alone_fold_once(spark, monkeypatch, policy):
    """Where no row comes or goes, failures are told before the fold, also of null keys and whatever the places of other changes are."""
    times, plain = [], apply.fold
    monkeypatch.setattr(apply, "fold", lambda *a, **k: times.append(1) or plain(*a, **k))
    moves = [(1, 10, 0, 1.0), (1, 11, 1, 2.0), (2, 20, 1, 4.0), (2, 21, 9, 8.0), (3, 30, None, 16.0), (3, 31, 0, 32.0), (4, 40, 0, 64.0)]
    rows = [(k, n, 0, x, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n), 2, "U", (v,), None, None) for x, n, k, v in moves]
    c = spark.createDataFrame(rows, "k int, commit_lsn bigint, seq int, xid bigint, commit_ts timestamp_ntz, origin_id int, op string, new struct<v:double>, old struct<v:double>, changed array<string>")
    state = spark.createDataFrame([(k, -1.0, dt.datetime(2020, 1, 1), 0) for k in range(3)], "k int, v double, _ts timestamp_ntz, _origin int")
    table, log, exceptions = apply.with_policy(c, state, ["k"], ["v"], policy)
    assert len(times) == 1
    want = {"transdiscard": ([64.0, 2.0, -1.0], [10, 11, 40]), "discard": ([64.0, 4.0, -1.0], [10, 11, 20, 31, 40]), "sub_disable": ([1.0, 2.0, -1.0], [10, 11])}[policy]
    assert ([r["v"] for r in table.orderBy("k").collect()], sorted(r["commit_lsn"] for r in log.collect())) == want
    logged = sorted((r["xid"], r["commit_lsn"], r["command_counter"], r["error_message"]) for r in exceptions.collect() if r["operation"] == "U")
    said = [(2, 20, 1, "discarded due to exception at command_counter 2"), (2, 21, 2, "row to update not found"), (3, 30, 1, "row to update not found"), (3, 31, 2, "discarded due to exception at command_counter 1")]
    assert logged == {"transdiscard": said, "discard": said[1:3], "sub_disable": said[:2]}[policy]


@pytest.mark.parametrize("policy", ["transdiscard", "sub_disable"])
def test_rounds_fold_once_each(spark, policy):
    """With inserts and deletes, a round's failures are folded for once and kept: nothing that is built later asks for that fold again."""
    rows = [(k, n, 0, x, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n), 2, op, (float(n),), None, None) for x, n, k, op in [(1, 1, 0, "I"), (2, 2, 5, "U"), (2, 3, 0, "U"), (3, 4, 0, "U")]]
    c = spark.createDataFrame(rows, "k int, commit_lsn bigint, seq int, xid bigint, commit_ts timestamp_ntz, origin_id int, op string, new struct<v:double>, old struct<v:double>, changed array<string>")
    state = spark.createDataFrame([], "k int, v double, _ts timestamp_ntz, _origin int")
    table, _, exceptions = apply.with_policy(c, state, ["k"], ["v"], policy)
    plan = exceptions._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and {r["xid"] for r in exceptions.collect()} == {2}
    assert [r["v"] for r in table.collect()] == [4.0 if policy == "transdiscard" else 1.0]


def test_lag_is_from_commit_to_insert(spark):
    p = spark.sql("SELECT * FROM VALUES (1, 2, TIMESTAMP_NTZ '2024-01-01 00:00:00', 100, 160, 150, TIMESTAMP_NTZ '2024-01-01 00:00:07'), (1, 3, TIMESTAMP_NTZ '2024-01-01 00:00:00', 100, 90, 100, TIMESTAMP_NTZ '2023-12-31 23:59:58') AS v(node_id, remote_node_id, remote_commit_ts, remote_commit_lsn, remote_insert_lsn, received_lsn, last_updated_ts)")
    nodes = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, 'c') AS v(node_id, node_name)")
    got = {r["origin_name"]: r for r in monitor.lag(p, nodes, spark.sql("SELECT 2 AS origin_id, 1 AS target_id")).collect()}
    assert (got["b"]["replication_lag_bytes"], got["b"]["replication_lag"], got["b"]["receiver_name"]) == (60, 7, "a")
    assert (got[None]["replication_lag_bytes"], got[None]["replication_lag"]) == (-10, -2)


def test_sequences_due_and_doubling(spark):
    """Published up to 2000 with a cache of 1000: due from 1501 on, late from 2501 on, the cache doubles from 3000 on."""
    rows = [(str(n), n, 2000, 1000) for n in (1500, 1501, 2500, 2501, 2999, 3000)] + [("big", 10**7, 2000, 800_000)]
    got = {r["seq_name"]: (r["publish"], r["in_time"], r["cache"], r["sent_value"]) for r in sync.sequences(spark.createDataFrame(rows, "seq_name string, last_value bigint, sent_value bigint, cache bigint")).collect()}
    assert got == {
        "1500": (False, True, 1000, 2000), "1501": (True, True, 1000, 2501), "2500": (True, True, 1000, 3500), "2501": (True, False, 1000, 3501),
        "2999": (True, False, 1000, 3999), "3000": (True, False, 2000, 5000), "big": (True, False, 1_000_000, 11_000_000),
    }


@pytest.mark.parametrize(("text", "good"), [("length(s) > 1", True), ("s = 'f(x)' and (id > 1 or id in (2, 3))", True), ("reflect('a', 'b') = s", False), ("from_json(s, 'a int').a > 1", False), ("version() = s", False)])
def test_filters_call_allowed_functions_alone(spark, text, good):
    table = spark.sql("SELECT 1 AS id, 'x' AS s")
    if good:
        publish.checked_filter(table, text)
    else:
        with pytest.raises(ValueError):
            publish.checked_filter(table, text)


def test_quoted_names_and_money(spark):
    from tidemark.functions import rendering

    got = spark.createDataFrame([("plain",), ("Two",), ('a"b',), ("select",), ("x y",)], "n string").select(rendering.quote_ident(F.col("n")).alias("q")).collect()
    assert [r["q"] for r in got] == ["plain", '"Two"', '"a""b"', '"select"', '"x y"']
    assert spark.range(1).select(rendering.identifier_list(F.array(F.lit("a"), F.lit("B c"))).alias("l")).first()["l"] == 'a,"B c"'
    money = spark.sql("SELECT 1.10BD AS o, 3.35BD AS n, 10.00BD AS l").select(delta.delta_apply(F.col("o"), F.col("n"), F.col("l"), "money").alias("m"))
    assert str(money.first()["m"]) == "12.25" and money.dtypes == [("m", "decimal(19,2)")]
