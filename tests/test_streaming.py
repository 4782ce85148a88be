import threading
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strandlog.functions.errors import FailedKeyError, TransientError, UsageError
from strandlog.functions.registry import NewEvent, build_schema
from strandlog.operators.live import CrossTenantModel, LiveModel, ModelDefinition, ModelVersions, PersistedModel, compare_listed
from strandlog.sources.store import FileStore
from strandlog.streaming.subscribe import FileCursors, MemoryCursors, Subscription, Watches, follow


@pytest.fixture
def store(tmp_path):
    return FileStore(str(tmp_path / "log"))


def fill(store, n, start=0, per=3):
    for k in range(start, start + n, per):
        store.append([NewEvent("Job", {"n": m}, {"key": f"k{m % 4}"}) for m in range(k, min(k + per, start + n))])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 12), st.sampled_from([1, 3, 500]), st.lists(st.integers(0, 11), max_size=3))
def test_every_record_once_around_poison(tmp_path_factory, n, page, poison):
    store = FileStore(str(tmp_path_factory.mktemp("log")))
    fill(store, n)
    seen = []

    def handler(events):
        if any(e.data["n"] in poison for e in events):
            raise ValueError("poison")
        seen.extend(e.data["n"] for e in events)

    s = Subscription(store, "s", {}, handler, batch_size=page, on_error=lambda e, events: "skip")
    s.run_until_caught_up()
    assert seen == [k for k in range(n) if k not in poison] and sorted(e.data["n"] for e, _ in s.skipped) == sorted({p for p in poison if p < n})


def test_late_transactions_are_not_passed_over(tmp_path):
    ids, settled, seen = iter([101, 100, 102]), {101}, []
    store = FileStore(str(tmp_path), allocate_id=lambda f: next(ids), is_settled=lambda t: t in settled)
    s = Subscription(store, "s", {}, lambda events: seen.extend(e.sequence for e in events))
    fill(store, 3, per=1)
    s.run_until_caught_up()
    assert seen == [1]
    settled.add(102)
    s.run_until_caught_up()
    assert seen == [1, 3]


def test_retry_stop_and_cursors(store, tmp_path):
    fill(store, 4)
    cursors, tries = FileCursors(str(tmp_path / "cursors.json")), []

    def flaky(events):
        tries.append(len(events))
        if len(tries) < 3:
            raise ValueError("again")

    Subscription(store, "s", {}, flaky, cursors=cursors, sleep=lambda s: None).run_until_caught_up()
    assert tries == [4, 4, 4] and cursors.get("s") == (2, 4)
    fill(store, 1, 4)
    got = []
    Subscription(store, "s", {}, got.extend, cursors=FileCursors(cursors.path)).run_until_caught_up()
    assert [e.data["n"] for e in got] == [4]
    with pytest.raises(ValueError):
        Subscription(store, "t", {}, lambda e: (_ for _ in ()).throw(ValueError()), on_error=lambda e, x: "stop").step()
    now = Subscription(store, "u", {}, got.extend, cursors=MemoryCursors(), start="now")
    assert now.step() == 0
    with pytest.raises(UsageError):
        Subscription(store, "s", {}, target=object(), cursors=cursors)


def test_running_tokens_and_watches(store):
    seen, told = [], []
    s = Subscription(store, "s", {}, seen.extend, poll=0.05).start()
    off = follow(store, {"types": ["Job"]}, told.extend)
    end = Watches(store).watch({}, told.extend)
    token = store.append([NewEvent("Job", {"n": 1})])
    s.wait_for(token, 5)
    assert s.has_passed(token) and len(seen) == 1
    deadline = time.time() + 5
    while len(told) < 2 and time.time() < deadline:
        time.sleep(0.01)
    assert len(told) == 2
    off(), end(), s.stop()
    with pytest.raises(TransientError):
        s.wait_for(store.append([NewEvent("Job", {"n": 2})]), 0.05)


def total(state, e):
    if e.data.get("poison"):
        raise ValueError("poison")
    return {"n": state["n"] + 1, "sum": state["sum"] + e.data["n"]}


MODEL = ModelDefinition("totals", 1, {"types": ["Job"]}, "key", total, {"n": 0, "sum": 0}, batch_size=3)


def test_live_model(store):
    fill(store, 10)
    m = LiveModel(store, MODEL)
    changes = []
    m.watch_list(lambda s: s["n"] >= 3, changes.append)
    m.catch_up()
    assert m.get("k0") == {"n": 3, "sum": 12} and m.get("none") == {"n": 0, "sum": 0}
    assert [r["key"] for r in m.list(sort="sum", descending=True, limit=2).rows] == ["k1", "k0"] and m.list(where={"n": 3}).total == 2
    assert {k for c in changes for k in c["rows"]} == {"k0", "k1"} and m.status()["lag"] == 0
    token = store.append([NewEvent("Job", {"n": 1, "poison": True}, {"key": "k1"}), NewEvent("Job", {"n": 5}, {"key": "k2"})])
    assert m.get("k2", at_least=token)["n"] == 3
    with pytest.raises(FailedKeyError):
        m.get("k1")
    assert m.list().failed == 1 and m.list().total == 3
    m.rebuild()
    assert m.get("k2")["n"] == 3 and m.list().failed == 1


def test_persisted_model(store):
    fill(store, 10)
    w = PersistedModel(store, MODEL)
    w.catch_up()
    store.append([NewEvent("Job", {"n": 100}, {"key": "k0"})])
    reader = PersistedModel(store, MODEL, writer=False)
    assert reader.get("k0") == {"n": 4, "sum": 112} and reader.rows["k0"].state == {"n": 3, "sum": 12}
    taken = PersistedModel(store, MODEL)
    with pytest.raises(TransientError):
        w.apply(store.query({}, cursor=w.cursor()).events, (99, 99))
    taken.catch_up()
    assert taken.get("k0") == {"n": 4, "sum": 112} and reader.get("k0") == {"n": 4, "sum": 112}
    taken.invalidate()
    assert taken.get("k0") == {"n": 4, "sum": 112}


def test_versions(store, tmp_path):
    fill(store, 6)
    v = ModelVersions(store, str(tmp_path / "models"))
    v.add(MODEL)
    assert v.step() == "active"
    v.add(ModelDefinition("totals", 2, {"types": ["Job"]}, "key", lambda s, e: {"n": s["n"] + 1, "sum": s["sum"] + 2 * e.data["n"]}, {"n": 0, "sum": 0}))
    assert v.step() == "active" and v.active.definition.version == 2 and v.active.get("k1") == {"n": 2, "sum": 12} and v.retire() == 1


def test_list_order():
    from datetime import datetime
    from functools import cmp_to_key

    values = [None, "b", 2, True, datetime(2020, 1, 1), False, "a", 1.5, float("nan"), [1]]
    rows = [(v, str(k)) for k, v in enumerate(values)]
    up = [r[1] for r in sorted(rows, key=cmp_to_key(compare_listed))]
    down = [r[1] for r in sorted(rows, key=cmp_to_key(lambda a, b: compare_listed(a, b, True)))]
    assert up == ["7", "2", "6", "1", "5", "3", "4", "0", "8", "9"] and down == ["4", "3", "5", "1", "6", "2", "7", "0", "8", "9"]


def test_definitions_are_checked():
    with pytest.raises(UsageError):
        ModelDefinition("m", 1, {"scopes": {"key": "a"}}, "key", total)
    with pytest.raises(UsageError):
        ModelDefinition("m", 0, {}, "key", total)
    assert threading.active_count() < 50


def test_cross_tenant_model(tmp_path):
    store = FileStore(str(tmp_path), build_schema([], ["key"], "tenantId", strict=False))
    for k in range(12):
        store.append([NewEvent("Job", {"n": k}, {"key": f"k{k % 2}"} | ({"tenantId": f"t{k % 3}"} if k < 9 else {}))])
    m = CrossTenantModel(store, MODEL)
    m.catch_up()
    assert m.get_for("t0", "k0") == {"n": 2, "sum": 6} and m.list_for("t1").total == 2 and m.checkpoints == {"t0": (7, 7), "t1": (8, 8), "t2": (9, 9)}


def test_erasure(store):
    fill(store, 6)
    other = FileStore(store.directory)
    assert len(other.query({}).events) == 6
    assert store.erase({"scopes": {"key": "k0"}}) == 2
    assert [e.sequence for e in store.query({}).events] == [2, 3, 4, 6] == [e.sequence for e in FileStore(store.directory).query({}).events]
    assert store.append([NewEvent("Job", {"n": 9})]).first == 7 and other.query({}).context_version == 7


def test_structured_streaming(spark, store, tmp_path):
    from pyspark.sql import functions as F

    from strandlog.streaming.source import StreamedStates, read_stream

    states = StreamedStates(str(tmp_path / "states"), ["key"], {"n": F.lit(1), "sum": F.get_json_object("payload", "$.n").cast("long")}, {"last": F.get_json_object("payload", "$.n")})

    def run():
        rows = read_stream(spark, store.directory).withColumn("key", F.get_json_object("payload", "$.scopes.key"))
        states.start(rows, str(tmp_path / "checkpoint")).awaitTermination(60)
        return {r["key"]: (r["n"], r["sum"], r["last"]) for r in states.read(spark).collect()}

    fill(store, 8)
    assert run() == {"k0": (2, 4, "4"), "k1": (2, 6, "5"), "k2": (2, 8, "6"), "k3": (2, 10, "7")}
    fill(store, 2, 8)
    assert run() == {"k0": (3, 12, "8"), "k1": (3, 15, "9"), "k2": (2, 8, "6"), "k3": (2, 10, "7")}
