"""The catalog: nodes, interfaces, replication sets, subscriptions. A few rows of settings, kept in Python and shown as DataFrames."""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import names

MASKS = ("replicate_insert", "replicate_update", "replicate_delete", "replicate_truncate")
#: The sets that each node starts with, and what they send: insert, update, delete, truncate.
FIRST_SETS = {"default": (True, True, True, True), "default_insert_only": (True, False, False, True), "ddl_sql": (True, False, False, False)}


class CatalogError(ValueError):
    """What a caller asked for isn't possible."""


@dataclass
class Node:
    node_id: int
    node_name: str
    location: str | None = None
    country: str | None = None
    info: str | None = None


@dataclass
class Membership:
    set_name: str
    rel: str
    columns: list[str] | None = None
    row_filter: str | None = None
    parent: str | None = None


@dataclass
class Subscription:
    sub_name: str
    origin: str
    sets: list[str]
    interface: str | None = None
    enabled: bool = True
    forward_origins: list[str] = field(default_factory=list)
    apply_delay_ms: int = 0
    skip_lsn: int | None = None
    skip_schema: list[str] = field(default_factory=list)
    status: str = "init"


class Catalog:
    """Everything by name. Dropping what isn't there is an error unless it may be missing."""

    def __init__(self) -> None:
        self.nodes: dict[str, Node] = {}
        self.interfaces: dict[tuple[str, str], str] = {}
        self.sets: dict[str, dict[str, bool]] = {}
        self.members: dict[tuple[str, str], Membership] = {}
        self.sequences: set[tuple[str, str]] = set()
        self.subscriptions: dict[str, Subscription] = {}
        self.reserved: set[tuple[str, str]] = set()
        self.queue: list[dict] = []
        self.paused = False
        self.read_only = "off"

    # Nodes

    def node_create(self, name: str, dsn: str, location: str | None = None, country: str | None = None, info: dict | None = None, node_id: int | None = None) -> int:
        if name in self.nodes:
            raise CatalogError(f"node {name} exists")
        node_id = zlib.crc32(name.encode()) & 0xFFFF if node_id is None else node_id
        if any(n.node_id == node_id for n in self.nodes.values()):
            raise CatalogError(f"node id {node_id} is taken; give another")
        self.nodes[name] = Node(node_id, name, location, country, None if info is None else json.dumps(info))
        self.interfaces[name, name] = dsn
        for s, masks in FIRST_SETS.items():
            self.sets.setdefault(s, dict(zip(MASKS, masks, strict=True)))
        return node_id

    def node_drop(self, name: str, ifexists: bool = False) -> bool:
        if any(s.origin == name for s in self.subscriptions.values()):
            raise CatalogError(f"node {name} has subscriptions")
        return self._drop(self.nodes, name, ifexists, "node") and all(self.interfaces.pop(k, True) for k in [k for k in self.interfaces if k[0] == name])

    def node_add_interface(self, node: str, interface: str, dsn: str) -> None:
        self._known(self.nodes, node, "node")
        if (node, interface) in self.interfaces:
            raise CatalogError(f"interface {interface} exists")
        self.interfaces[node, interface] = dsn

    def node_drop_interface(self, node: str, interface: str) -> bool:
        if any(s.origin == node and s.interface == interface for s in self.subscriptions.values()):
            raise CatalogError(f"interface {interface} is in use")
        return self._drop(self.interfaces, (node, interface), False, "interface")

    def tiebreaker(self, node: str) -> int:
        n = self._known(self.nodes, node, "node")
        given = json.loads(n.info or "{}").get("tiebreaker")
        return n.node_id if given is None else int(given)

    # Replication sets

    def repset_create(self, name: str, insert: bool = True, update: bool = True, delete: bool = True, truncate: bool = True) -> None:
        if name in self.sets:
            raise CatalogError(f"set {name} exists")
        self.sets[name] = dict(zip(MASKS, (insert, update, delete, truncate), strict=True))

    def repset_alter(self, name: str, **masks: bool) -> None:
        """Masks by their short names; a set with tables without a key can't send updates or deletes (see repset_add_table)."""
        self._known(self.sets, name, "set").update({f"replicate_{k}": v for k, v in masks.items()})

    def repset_drop(self, name: str, ifexists: bool = False) -> bool:
        if name in FIRST_SETS:
            raise CatalogError(f"set {name} can't be dropped")
        for k in [k for k in self.members if k[0] == name]:
            del self.members[k]
        return self._drop(self.sets, name, ifexists, "set")

    def repset_add_table(self, set_name: str, rel: str, table: DataFrame | None = None, key: Sequence[str] = (), columns: Sequence[str] | None = None, row_filter: str | None = None, partitions: Sequence[str] = ()) -> None:
        """The key must be in the column list, and be there at all for sets that send updates or deletes."""
        masks = self._known(self.sets, set_name, "set")
        if (set_name, rel) in self.members:
            raise CatalogError(f"{rel} is in {set_name}")
        if (rel, "table") in self.reserved:
            raise CatalogError(f"{rel} is reserved")
        if not key and (masks["replicate_update"] or masks["replicate_delete"]):
            raise CatalogError(f"{rel} has no key, and {set_name} sends updates or deletes")
        if columns is not None and not set(key) <= set(columns):
            raise CatalogError("a column list must have the key")
        if table is not None:
            missing = [c for c in columns or () if c not in table.columns]
            if missing:
                raise CatalogError(f"{rel} has no {', '.join(missing)}")
            if row_filter:
                from tidemark.operators.publish import checked_filter

                checked_filter(table, row_filter)
        for name, parent in [(rel, None), *((p, rel) for p in partitions)]:
            self.members[set_name, name] = Membership(set_name, name, None if columns is None else list(columns), row_filter, parent)

    def repset_add_partition(self, parent: str, partition: str, row_filter: str | None = None) -> int:
        """To every set of the parent, with its columns and, unless one is given, its filter."""
        own = [m for m in self.members.values() if m.rel == parent]
        for m in own:
            self.members[m.set_name, partition] = Membership(m.set_name, partition, m.columns, row_filter or m.row_filter, parent)
        return len(own)

    def repset_remove_partition(self, parent: str, partition: str) -> int:
        gone = [k for k, m in self.members.items() if m.rel == partition and m.parent == parent]
        for k in gone:
            del self.members[k]
        return len(gone)

    def repset_add_all_tables(self, set_name: str, tables: dict[str, Sequence[str]]) -> int:
        """Tables with their keys; those already there are left alone."""
        new = [t for t in tables if (set_name, t) not in self.members]
        for t in new:
            self.repset_add_table(set_name, t, key=tables[t])
        return len(new)

    def repset_remove_table(self, set_name: str, rel: str, partitions: bool = True) -> bool:
        for k in [k for k, m in self.members.items() if partitions and m.set_name == set_name and m.parent == rel]:
            del self.members[k]
        return self._drop(self.members, (set_name, rel), False, "table")

    def repset_add_seq(self, set_name: str, seq: str) -> None:
        self._known(self.sets, set_name, "set")
        self.sequences.add((set_name, seq))

    def repset_add_all_seqs(self, set_name: str, seqs: Sequence[str]) -> int:
        """Those already there are left alone."""
        new = [q for q in seqs if (set_name, q) not in self.sequences]
        for q in new:
            self.repset_add_seq(set_name, q)
        return len(new)

    def repset_remove_seq(self, set_name: str, seq: str) -> bool:
        if (set_name, seq) not in self.sequences:
            raise CatalogError(f"{seq} isn't in {set_name}")
        self.sequences.discard((set_name, seq))
        return True

    def route(self, rel: str, key: Sequence[str], kept: bool = True) -> str | None:
        """Moves a new or altered table to the set that fits: `default` with a key, else `default_insert_only`; out of both if it isn't kept (unlogged, reserved)."""
        for s in ("default", "default_insert_only"):
            self.members.pop((s, rel), None)
        if not kept or (rel, "table") in self.reserved:
            return None
        to = "default" if key else "default_insert_only"
        self.members[to, rel] = Membership(to, rel)
        return to

    # Subscriptions

    def sub_create(self, name: str, origin: str, sets: Sequence[str] = ("default", "default_insert_only", "ddl_sql"), forward_origins: Sequence[str] = (), apply_delay_ms: int = 0, enabled: bool = True, skip_schema: Sequence[str] = (), interface: str | None = None) -> None:
        if not names.valid_subscription(name):
            raise CatalogError(f"not a name for a subscription: {name}")
        if name in self.subscriptions:
            raise CatalogError(f"subscription {name} exists")
        self._known(self.nodes, origin, "node")
        if list(forward_origins) not in ([], ["all"]):
            raise CatalogError("forward_origins is empty or all")
        self.subscriptions[name] = Subscription(name, origin, list(sets), interface or origin, enabled, list(forward_origins), apply_delay_ms, None, list(skip_schema))

    def sub_drop(self, name: str, ifexists: bool = False) -> bool:
        return self._drop(self.subscriptions, name, ifexists, "subscription")

    def _sub(self, name: str) -> Subscription:
        return self._known(self.subscriptions, name, "subscription")

    def sub_enable(self, name: str) -> None:
        self._sub(name).enabled = True

    def sub_disable(self, name: str) -> None:
        self._sub(name).enabled = False

    def sub_add_repset(self, name: str, set_name: str) -> bool:
        s = self._sub(name)
        if set_name in s.sets:
            return False
        s.sets.append(set_name)
        return True

    def sub_remove_repset(self, name: str, set_name: str) -> bool:
        s = self._sub(name)
        if set_name not in s.sets:
            return False
        s.sets.remove(set_name)
        return True

    def sub_alter_skiplsn(self, name: str, lsn: int | None) -> None:
        self._sub(name).skip_lsn = lsn

    def sub_alter_interface(self, name: str, interface: str) -> None:
        s = self._sub(name)
        self._known(self.interfaces, (s.origin, interface), "interface")
        s.interface = interface

    def sub_alter_options(self, name: str, **options) -> None:
        unknown = set(options) - {"forward_origins", "apply_delay_ms", "skip_schema"}
        if unknown:
            raise CatalogError(f"unknown options: {', '.join(sorted(unknown))}")
        for k, v in options.items():
            setattr(self._sub(name), k, v)

    def sub_alter_sync(self, name: str) -> None:
        """Starts over with a copy of all tables."""
        self._sub(name).status = "init"

    def sub_status(self, name: str, status: str) -> None:
        self._sub(name).status = status

    def sub_wait_for_sync(self, name: str, look: Callable[[], str] | None = None, timeout: float = 0, pause: float = 0.2) -> bool:
        """Waits until the subscription is ready; false after `timeout` seconds, 0 waits on. `look` reads its state anew."""
        start = time.monotonic()
        while (look() if look else self._sub(name).status) != "ready":
            if timeout and time.monotonic() - start >= timeout:
                return False
            time.sleep(pause)
        return True

    # Reserved objects, control rows

    def reserved_object_add(self, name: str, purpose: str = "table") -> None:
        self.reserved.add((name, purpose))

    def reserved_object_remove(self, name: str, purpose: str = "table") -> bool:
        found = (name, purpose) in self.reserved
        self.reserved.discard((name, purpose))
        return found

    def sync_event(self, origin_id: int, lsn: int, spark: SparkSession) -> DataFrame:
        """A row to append to a stream: whoever applies it is as far as here."""
        return self._marker(spark, origin_id, lsn, "sync_event")

    def repair_mode(self, on: bool, origin_id: int, lsn: int, spark: SparkSession) -> DataFrame:
        """A row to append to a stream: what follows it in its transaction is (or isn't) kept from others."""
        return self._marker(spark, origin_id, lsn, "repair_on" if on else "repair_off")

    @staticmethod
    def _marker(spark: SparkSession, origin_id: int, lsn: int, message: str) -> DataFrame:
        return spark.range(1).select(F.lit(lsn).cast("bigint").alias("commit_lsn"), F.lit(0).alias("seq"), F.lit(origin_id).cast("int").alias("origin_id"), F.lit("M").alias("op"), F.lit(message).alias("message"))

    def sync_seq(self, seq: str, value: int, nsp: str = "public") -> bool:
        """Queues a sequence's value, read ahead, for the subscribers of its sets."""
        sets = sorted(s for s, q in self.sequences if q == seq)
        if not sets:
            raise CatalogError(f"{seq} is in no set")
        self.queue_message("S", {"schema_name": nsp, "sequence_name": seq, "last_value": str(value)}, sets)
        return True

    def node_info(self, name: str) -> dict:
        """What a node says of itself."""
        n = self._known(self.nodes, name, "node")
        return {"node_id": n.node_id, "node_name": n.node_name, "replication_sets": ",".join(sorted(self.sets)), "location": n.location, "country": n.country, "info": n.info}

    def apply_status(self, running: Sequence[str] = ()) -> dict[str, str]:
        """The state of each subscription's applier; `running` names those with a live query."""
        return {s.sub_name: "disabled" if not s.enabled else "paused" if not self.may_apply() else "running" if s.sub_name in running else "down" for s in self.subscriptions.values()}

    def queue_message(self, kind: str, message: dict | str, sets: Sequence[str] | None = None, role: str = "") -> None:
        """Q and D for statements, A for a table's copy, S for a sequence."""
        if kind not in ("Q", "D", "A", "S"):
            raise CatalogError(f"unknown kind of message: {kind}")
        self.queue.append({"seq": len(self.queue), "role": role, "sets": None if sets is None else list(sets), "kind": kind, "message": json.dumps(message)})

    def pause_apply(self) -> None:
        self.paused = True

    def resume_apply(self) -> None:
        self.paused = False

    def may_apply(self) -> bool:
        return not self.paused and self.read_only != "all"

    # As DataFrames

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        """nodes, interfaces, sets, members, sequences, subscriptions or queue."""
        rows, schema = {
            "nodes": ([asdict(n) for n in self.nodes.values()], "node_id int, node_name string, location string, country string, info string"),
            "interfaces": ([{"node_name": n, "if_name": i, "dsn": d} for (n, i), d in self.interfaces.items()], "node_name string, if_name string, dsn string"),
            "sets": ([{"set_name": s, **m} for s, m in self.sets.items()], "set_name string, " + ", ".join(f"{m} boolean" for m in MASKS)),
            "members": ([asdict(m) for m in self.members.values()], "set_name string, rel string, columns array<string>, row_filter string, parent string"),
            "sequences": ([{"set_name": s, "seq": q} for s, q in self.sequences], "set_name string, seq string"),
            "subscriptions": ([asdict(s) for s in self.subscriptions.values()], "sub_name string, origin string, sets array<string>, interface string, enabled boolean, forward_origins array<string>, apply_delay_ms bigint, skip_lsn bigint, skip_schema array<string>, status string"),
            "queue": (self.queue, "seq int, role string, sets array<string>, kind string, message string"),
        }[name]
        return spark.createDataFrame(rows, schema)

    def show_table(self, spark: SparkSession, rel: str, sets: Sequence[str]) -> DataFrame:
        """How a table is sent to a subscriber of these sets."""
        from tidemark.operators.publish import policies

        return policies(self.frame(spark, "members").where(F.col("rel") == rel), self.frame(spark, "sets"), sets)

    # Helpers

    @staticmethod
    def _known(where: dict, key, what: str):
        if key not in where:
            raise CatalogError(f"no {what} {key}")
        return where[key]

    @staticmethod
    def _drop(where: dict, key, ifexists: bool, what: str) -> bool:
        if key not in where:
            if ifexists:
                return False
            raise CatalogError(f"no {what} {key}")
        del where[key]
        return True
