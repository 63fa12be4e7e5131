"""Control rows, sync events, copies made again, delay, rows of conflicts and exceptions: cases that the tables lack."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import delta
from tidemark.operators import apply, control, errors, records, resolve, verify
from tidemark.operators.catalog import Catalog, CatalogError
from tidemark.sources import progress

SYNC = "sub_name string, nsp string, rel string, status string, status_lsn bigint"


def test_steps_of_columns(spark):
    t = spark.sql("SELECT 1 AS a, 2 AS b")
    assert control.evolved(t, {"add": "c", "type": "bigint"}).dtypes[-1] == ("c", "bigint")
    assert control.evolved(t, {"add": "a", "type": "int", "if_not_exists": True}).columns == ["a", "b"]
    assert control.evolved(t, {"drop": "x", "if_exists": True}).columns == ["a", "b"]
    assert control.evolved(t, {"rename": "a", "to": "z"}).columns == ["z", "b"]
    for bad in ({"add": "a", "type": "int"}, {"drop": "x"}, {"rename": "a", "to": "b"}, {"retype": "x", "type": "int"}, {}):
        with pytest.raises(ValueError):
            control.evolved(t, bad)


@pytest.mark.parametrize(("policy", "failed", "columns"), [("transdiscard", 2, ["b"]), ("sub_disable", 1, ["a", "b"])])
def test_failing_statements(spark, policy, failed, columns):
    c = Catalog()
    for message in ({"table": "none", "drop": "a"}, {"table": "t", "drop": "a"}, {"table": "t", "drop": "a"}):
        c.queue_message("D", message)
    out, bad = control.dispatch(c.frame(spark, "queue"), {"t": spark.sql("SELECT 1 AS a, 2 AS b")}, policy)
    assert (len(bad), out["t"].columns) == (failed, columns)


def test_queue_without_rows_and_of_unknown_kinds(spark):
    empty = Catalog().frame(spark, "queue")
    sync = spark.createDataFrame([("s", "public", "t", "ready", 1)], SYNC)
    assert control.table_syncs(empty, sync, "s").collect() == sync.collect()
    odd = spark.sql("SELECT 0 AS seq, '' AS role, NULL AS sets, 'X' AS kind, '{}' AS message")
    assert control.unknown(odd).count() == 1


def test_waiting():
    seen = iter(["waiting", "no subscription", "reached"])
    assert control.wait_for(lambda: next(seen), wait_if_disabled=True, pause=0)
    assert not control.wait_for(lambda: "waiting", timeout=0.01, pause=0.01)
    with pytest.raises(CatalogError):
        control.wait_for(lambda: "disabled")


def test_copy_again_is_guarded(spark):
    sync = spark.createDataFrame([("s", "public", "t", "data", None), ("s", "public", "u", "ready", 9), ("s", None, None, "ready", 3)], SYNC)
    with pytest.raises(CatalogError):
        control.resynced(sync, "s", "public", "t")
    with pytest.raises(CatalogError):
        control.resynced(sync, "s", "public", "u", read_only="all")
    again = {(r["rel"]): (r["status"], r["status_lsn"]) for r in control.resynced(sync, "s", "public", "u").collect()}
    assert again == {"t": ("data", None), "u": ("init", None), None: ("ready", 3)}
    assert control.resynced(sync, "s", "public", "new").where("rel = 'new' AND status = 'init'").count() == 1
    left = control.all_synced(sync, "s", spark.sql("SELECT 'public' AS nsp, 'u' AS rel"))
    assert {r["rel"] for r in left.collect()} == {"u", None}


def test_copies_that_meet_keys(spark):
    old, new = spark.sql("SELECT 1 AS k, 'a' AS v"), spark.sql("SELECT 1 AS k, 'b' AS v")
    assert [r["v"] for r in control.copied_again(old, new, ["k"]).collect()] == ["b"]
    with pytest.raises(CatalogError):
        control.copied_again(old, new, ["k"], truncate=False)
    assert control.copied_again(old, new.withColumn("k", F.lit(2)), ["k"], truncate=False).count() == 2


def test_delay_holds_back_what_follows(spark):
    t = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01 00:00:00'), (2, TIMESTAMP_NTZ '2024-01-01 00:00:50'), (3, TIMESTAMP_NTZ '2024-01-01 00:00:01'), (4, TIMESTAMP_NTZ '2024-01-01 00:09:00') t(commit_lsn, commit_ts)")
    now = F.lit("2024-01-01 00:01:00").cast("timestamp_ntz")
    due = lambda ms: sorted(r["commit_lsn"] for r in control.after_delay(t, now, ms).collect())
    assert due(0) == [1, 2, 3, 4]
    assert due(30_000) == [1]
    # Its commit lies in the future, so it doesn't wait.
    assert due(5_000) == [1, 2, 3, 4]
    assert due(120_000) == []


def test_rows_taken_from_a_table_without_a_key(spark):
    t = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    gone = spark.createDataFrame([(1, None), (3, "x")], "a int, b string")
    assert sorted(resolve.without(t, gone).collect(), key=str) == sorted([(1, None), (2, "a")], key=str)
    assert resolve.missing(t, gone).collect() == [(3, "x")]


def test_previous_rows_across_ranges(spark):
    rows = spark.range(1000).select(F.col("id").alias("commit_lsn"), F.when(F.col("id") % 10 == 0, 0).when(F.col("id") < 5, F.lit(None)).otherwise(1).alias("origin_id"), (F.col("id") * 7 % 100).alias("v"))
    got = {r["commit_lsn"]: r["_before"] for r in resolve.with_previous(rows, "v", ranges=7).collect()}
    last, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["commit_lsn"]):
        want[r["commit_lsn"]] = last.get(r["origin_id"])
        last[r["origin_id"]] = r["v"]
    assert got == want
    assert resolve.with_previous(rows.limit(0), "v").count() == 0


def test_rows_of_conflicts(spark):
    state = spark.sql("SELECT 1 AS k, 'mine' AS v, TIMESTAMP_NTZ '2024-01-02' AS _ts, 5 AS _origin, 77L AS _xid")
    row = "named_struct('k', {k}, 'v', {v})"
    one = lambda lsn, op, k, v, ts: f"SELECT {lsn}L AS commit_lsn, 0 AS seq, 9L AS xid, TIMESTAMP_NTZ '{ts}' AS commit_ts, 2 AS origin_id, '{op}' AS op, {k} AS k, {row.format(k=k, v=v) if op != 'D' else 'CAST(NULL AS struct<k:int,v:string>)'} AS new, {row.format(k=k, v='CAST(NULL AS STRING)') if op == 'D' else 'CAST(NULL AS struct<k:int,v:string>)'} AS old"
    c = spark.sql(" UNION ALL ".join([one(1, "I", 1, "'x\"y'", "2024-01-03"), one(2, "U", 1, "'y'", "2024-01-03"), one(3, "D", 1, "''", "2024-01-01"), one(4, "D", 2, "''", "2024-01-01"), one(5, "U", 3, "CAST(NULL AS STRING)", "2024-01-01")]))
    met = resolve.against(c, state, ["k"], 1, F.col("origin_id"), columns=["k", "v"])
    got = records.resolutions(met, ["k", "v"], "n", "public", "T", F.current_timestamp())
    assert tuple(got.columns) == records.RESOLUTIONS
    by = {r["remote_lsn"]: r for r in got.collect()}
    # An update of a row from elsewhere is never saved.
    assert sorted(by) == [1, 3, 4, 5] and len({r["id"] for r in by.values()}) == 4
    assert by[1]["relname"] == 'public."T"' and json.loads(by[1]["remote_tuple"]) == {"k": 1, "v": 'x"y'} and by[1]["local_xid"] == 77
    assert by[3]["remote_tuple"] is None and json.loads(by[3]["local_tuple"]) == {"k": 1, "v": "mine"}
    assert json.loads(by[4]["remote_tuple"]) == {"k": 2, "v": None} and by[4]["local_tuple"] is None and by[4]["local_origin"] is None
    assert by[5]["conflict_type"] == "update_missing" and json.loads(by[5]["remote_tuple"]) == {"k": 3, "v": None}
    assert records.resolutions(met, ["k", "v"], "n", "public", "T", F.current_timestamp(), save=False).count() == 0


def test_rows_of_exceptions(spark):
    image = "named_struct('k', k, 'v', v)"
    c = spark.sql(f"SELECT *, {image} AS new, CAST(NULL AS struct<k:int,v:string>) AS old FROM (SELECT 1L AS commit_lsn, id AS seq, 4L AS xid, TIMESTAMP_NTZ '2024-01-01' AS commit_ts, 2 AS origin_id, 'U' AS op, CAST(id AS INT) AS k, 'a\"b\\n' AS v, id = 1 AS failed, 'gone' AS error_message FROM range(2))")
    state = spark.sql("SELECT 0 AS k, CAST(NULL AS STRING) AS v, TIMESTAMP_NTZ '2023-01-01' AS _ts, 6 AS _origin")
    log = errors.exception_log(c, "sub_disable")
    got = records.exceptions(log, c, ["k"], {"k": "int", "v": "string"}, "public", "t", F.current_timestamp(), state)
    assert tuple(got.columns) == records.EXCEPTIONS
    rows = sorted(got.collect(), key=lambda r: r["command_counter"])
    assert [r["operation"] for r in rows] == ["UPDATE", "UPDATE", "SUB_DISABLE"]
    assert json.loads(rows[0]["local_tup"]) == [{"attname": "k", "atttype": "int", "value": 0}, {"attname": "v", "atttype": "string", "value": None}]
    assert rows[0]["local_origin"] == 6 and rows[1]["local_tup"] is None and rows[1]["local_origin"] is None
    assert json.loads(rows[1]["remote_new_tup"])[1]["value"] == 'a"b\n' and rows[1]["error_message"] == "gone"
    assert rows[2]["table_name"] == "" and rows[2]["remote_new_tup"] is None
    ddl = spark.sql("SELECT 2 AS origin_id, TIMESTAMP_NTZ '2024-01-01' AS commit_ts, 1 AS command_counter, 4L AS xid, 'drop a' AS statement, 'me' AS role, CAST(NULL AS STRING) AS error_message")
    r = records.statement_exceptions(ddl, F.current_timestamp()).first()
    assert (r["operation"], r["ddl_statement"], r["ddl_user"], r["error_message"]) == ("DDL", "drop a", "me", "unavailable")


def test_progress_files(spark, tmp_path):
    r = spark.sql("SELECT * FROM VALUES (1L, 1, 2, TIMESTAMP_NTZ '2024-01-01', 5L, 9L), (2L, 1, 2, TIMESTAMP_NTZ '2024-01-02', 4L, 1L) t(dbid, node_id, remote_node_id, remote_commit_ts, remote_commit_lsn, received_lsn)")
    r = r.withColumns({"prev_remote_ts": F.col("remote_commit_ts"), "updated_by_decode": F.lit(True), "remote_insert_lsn": F.col("received_lsn")})
    progress.dump(r, str(tmp_path / "p"))
    progress.dump(r.withColumns({"remote_commit_lsn": F.lit(50).cast("bigint"), "received_lsn": F.lit(3).cast("bigint")}), str(tmp_path / "p"))
    got = progress.load(spark, str(tmp_path / "p"), 1).collect()
    # Equal commit times: the first version's position counts; what was received goes by its own maximum.
    assert [(x["remote_commit_lsn"], x["received_lsn"]) for x in got] == [(5, 9)]
    assert progress.load(spark, str(tmp_path / "p")).count() == 2


def test_subscriber_rules_and_own_merges(spark):
    c = spark.sql("SELECT 1L AS commit_lsn, 'I' AS op, 1 AS k, named_struct('v', 5) AS new UNION ALL SELECT 2L, 'I', 2, named_struct('v', CAST(NULL AS INT)) UNION ALL SELECT 3L, 'D', 3, NULL")
    got = apply.admitted(c, ["v > 1"], ["v"], {"v": F.col("v") * 2}).collect()
    assert sorted((r["commit_lsn"], r["new"] and r["new"]["v"]) for r in got) == [(1, 10), (3, None)]
    assert apply.admitted(c, [], ["v"]).count() == 3
    own = delta.Registry()
    own.register("t", "v", lambda old, new, local: F.greatest(local, new))
    assert set(own.of("t", {"v": "int", "w": "int"})) == {"v", "w"}


def test_catalog_of_sequences_events_and_states(spark):
    c = Catalog()
    c.node_create("n", "dsn", location="here", node_id=3)
    assert c.repset_add_all_seqs("default", ["a", "b"]) == 2 and c.repset_add_all_seqs("default", ["a", "c"]) == 1
    c.sync_seq("a", 9)
    assert json.loads(json.loads(json.dumps(c.queue[-1]["message"])))["last_value"] == "9"
    with pytest.raises(CatalogError):
        c.sync_seq("zzz", 1)
    c.sub_create("s", "n")
    assert not c.sub_wait_for_sync("s", timeout=0.01, pause=0.01)
    c.sub_status("s", "ready")
    assert c.sub_wait_for_sync("s")
    assert c.apply_status() == {"s": "down"} and c.apply_status(["s"]) == {"s": "running"}
    c.pause_apply()
    assert c.apply_status(["s"]) == {"s": "paused"}
    assert c.node_info("n")["location"] == "here"
    events = control.sync_events(c.sync_event(3, 40, spark).unionByName(c.repair_mode(True, 3, 41, spark)))
    assert [tuple(r) for r in events.collect()] == [(3, 40)]
    assert verify.members(spark.sql("SELECT 'd' AS set_name, 't' AS rel"), c.frame(spark, "sequences"), ["d", "default"]).count() == 4
