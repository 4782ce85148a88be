"""The log beyond single calls: manifests, compaction, other processes, streams that start again, writers that change."""

import random
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from strandlog.functions.errors import PolicyViolationError, StalePageError, TenantMismatchError, TransientError, UniqueViolationError, UsageError
from strandlog.functions.registry import EventSpec, NewEvent, Registry, build_schema
from strandlog.operators import codec, live
from strandlog.operators.live import KEPT_LISTS, Lease, LiveModel, ModelDefinition, PersistedCrossTenantModel, PersistedModel, doc_of, failed_text
from strandlog.runtime import create_event_log
from strandlog.sources import store as store_module
from strandlog.sources.files import LocalFiles
from strandlog.sources.store import FileStore
from strandlog.streaming.source import StreamedStates, read_stream
from strandlog.streaming.subscribe import Subscription, Watches
from strandlog.testing import Slow

UNIQUE = Registry({"Job": EventSpec(unique=("n",), optional_scopes=("key",))})


def fill(store, n, start=0, per=1):
    for k in range(start, start + n, per):
        store.append([NewEvent("Job", {"n": m}, {"key": f"k{m % 4}"}) for m in range(k, min(k + per, start + n))])


def test_manifests_and_key_runs(tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MANIFEST_EVERY", 8)
    schema = build_schema([UNIQUE])
    store = FileStore(str(tmp_path), schema)
    order = random.Random(1).sample(range(1000), 90)
    for n in order:
        store.append([NewEvent("Job", {"n": n})])
    fresh = FileStore(str(tmp_path), schema)
    assert fresh.refresh() == 90 and len(fresh._tail) == 90 - 88 and len(fresh._runs) <= 8
    for n in order:
        with pytest.raises(UniqueViolationError):
            fresh.append([NewEvent("Job", {"n": n})])
    others = [n for n in range(1000) if n not in set(order)][:20]
    for n in others:
        fresh.append([NewEvent("Job", {"n": n})])
    assert [e.data["n"] for e in store.query({}).events] == order + others


def test_compaction_keeps_what_is_read(tmp_path, spark):
    store, other = FileStore(str(tmp_path)), FileStore(str(tmp_path))
    fill(store, 30)
    assert len(other.query({}).events) == 30
    reading = other.snapshot(spark).df
    assert store.compact() == 30 and len(store.segments()) == 1
    assert reading.count() == 30 == other.snapshot(spark).df.count()  # the old files are there until a sweep
    assert store.sweep(-1) == 30 and [e.sequence for e in other.query({}, after=10).events] == list(range(11, 31))
    fill(store, 20, 30)
    assert store.compact(spark) == 21 and [e.sequence for e in FileStore(str(tmp_path)).query({}).events] == list(range(1, 51))
    assert store.append([NewEvent("Job", {"n": 1})]).first == 51


def test_erasure_leaves_other_processes_reading(tmp_path, spark):
    store, other = FileStore(str(tmp_path), build_schema([], ["key"], strict=False)), FileStore(str(tmp_path), build_schema([], ["key"], strict=False))
    fill(store, 12, per=3)
    before = other.snapshot(spark).df
    assert store.erase({"scopes": {"key": "k0"}}) == 3
    assert before.count() == 12 and other.snapshot(spark).df.count() == 9 == len(other.query({}).events)
    assert other.erase_frame(spark, {"scopes": {"key": "k1"}}) == 3 and other.erase_frame(spark, {"scopes": {"key": "k1"}}) == 0
    assert [e.data["n"] for e in store.query({}).events] == [2, 3, 6, 7, 10, 11]
    assert store.sweep(-1) > 0 and store.snapshot(spark).df.count() == 6


def test_import(tmp_path, spark):
    schema = build_schema([UNIQUE])
    rows = [(k + 1, k // 3 + 1, "Job", f'{{"jobId":"j{k}","n":{k},"scopes":{{"key":"k{k % 4}"}}}}', '{"idempotencyKey":"a"}' if k == 5 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "sequence bigint, transaction_id bigint, event_type string, payload string, metadata string")
    store = FileStore(str(tmp_path / "a"), schema, fields={"n": "bigint"})
    assert store.import_frame(spark, df).last == 40
    assert store.snapshot(spark).df.agg(F.sum("field_n")).first()[0] == sum(range(40)) and len(store.query({"scopes": {"key": "k1"}}).events) == 10
    for clash in (NewEvent("Job", {"n": 7}), NewEvent("Job", {"n": 400}, metadata={"idempotencyKey": "a"})):
        with pytest.raises(UniqueViolationError):
            store.append([clash])
    assert store.append([NewEvent("Job", {"n": 41})]).first == 41 and store.query({}, cursor=(13, 39)).events[0].sequence == 40
    with pytest.raises(UsageError):
        store.import_frame(spark, df)
    with pytest.raises(UniqueViolationError):
        FileStore(str(tmp_path / "b"), schema).import_frame(spark, df.unionAll(df.withColumn("sequence", F.col("sequence") + 40)))


def test_snapshot_of_open_transactions(tmp_path, spark):
    ids, done = iter([5, 3, 9]), {5, 9}
    store = FileStore(str(tmp_path), allocate_id=lambda f: next(ids), is_settled=lambda t: t in done)
    fill(store, 3)
    log = store.snapshot(spark)
    assert log.watermark == 3 and log.df.where(log.settled).count() == 0
    done.add(3)
    log = store.snapshot(spark)
    assert log.df.where(log.settled).count() == 3


# ---- streams -----------------------------------------------------------------------------------------------------------


def states_of(tmp_path):
    n = F.get_json_object("payload", "$.n").cast("long")
    return StreamedStates(str(tmp_path / "states"), ["key"], {"count": F.lit(1).cast("long"), "sum": n}, {"last": n})


def test_streams_that_start_again_meet_each_record_once(tmp_path, spark):
    store, states = FileStore(str(tmp_path / "log")), states_of(tmp_path)

    def run(**trigger):
        rows = read_stream(spark, store.directory, rowsEach="7").withColumn("key", F.get_json_object("payload", "$.scopes.key"))
        q = states.start(rows, str(tmp_path / "checkpoint"), **trigger)
        if trigger:
            q.processAllAvailable()
            q.stop()
        else:
            q.awaitTermination(60)
        return {r["key"]: (r["count"], r["sum"], r["last"]) for r in states.read(spark).collect()}

    total = 0
    for trigger in ({}, {"processingTime": "50 milliseconds"}, {}, {"processingTime": "50 milliseconds"}):
        fill(store, 30, total)
        total += 30
        found = run(**trigger)
        assert found == {f"k{j}": (len(range(j, total, 4)), sum(range(j, total, 4)), range(j, total, 4)[-1]) for j in range(4)}
        assert run(**trigger) == found  # nothing new, nothing again
        if total == 60:
            assert states.compact(spark) > 0 and states.compact(spark) == 0 and store.compact() > 0 and run() == found


def test_streamed_last_values_follow_transactions(tmp_path, spark):
    states = states_of(tmp_path)
    batch = lambda *rows: spark.createDataFrame([(t, s, f'{{"n":{n}}}', "k") for t, s, n in rows], "transaction_id bigint, sequence bigint, payload string, key string")
    states.write(batch((5, 1, 10), (7, 3, 30)), 0)
    states.write(batch((6, 2, 20)), 1)  # commits late
    states.write(batch((6, 2, 20)), 1)  # and is run again
    assert [tuple(r) for r in states.read(spark).select("count", "sum", "last").collect()] == [(3, 60, 30)]
    assert states.compact(spark) == 2
    states.write(batch((6, 2, 20)), 1)
    assert [tuple(r) for r in states.read(spark).select("count", "sum", "last").collect()] == [(3, 60, 30)]


# ---- models ------------------------------------------------------------------------------------------------------------


def total(state, e):
    return {"n": state["n"] + 1, "sum": state["sum"] + e.data["n"]}


MODEL = ModelDefinition("totals", 1, {"types": ["Job"]}, "key", total, {"n": 0, "sum": 0}, batch_size=3)


def test_persisted_snapshots_feed_and_frame(tmp_path, spark, monkeypatch):
    monkeypatch.setattr(live, "SNAPSHOT_EVERY", 5)
    store = FileStore(str(tmp_path))
    model = PersistedModel(store, MODEL)
    follower, told = PersistedModel(store, MODEL, writer=False), []
    follower.watch(lambda changed: told.extend(changed))
    fill(store, 40)
    model.catch_up()
    rows, at, whole = follower.changes(0)
    assert set(rows) == {"k0", "k1", "k2", "k3"} and not whole and set(follower.poll()) == set(rows) == set(told)
    assert follower.rows["k1"].state == model.get("k1") == {"n": 10, "sum": sum(range(1, 40, 4))}
    assert model.trim() > 0 and PersistedModel(store, MODEL, writer=False).get("k2") == model.get("k2")
    assert follower.changes(0)[2] and set(follower.changes(0)[0]) == set(rows) and follower.changes(at) == ({}, at, False)
    fill(store, 2, 40)
    assert follower.get("k0")["n"] == 11  # the stored row and what is beyond its cursor
    model.catch_up()
    frame = {r["key"]: codec.loads(r["state"]) for r in model.frame(spark).collect()}
    assert frame == {k: model.get(k) for k in model.rows}
    model.invalidate()
    assert model.get("k0")["n"] == 11 and {r["key"] for r in model.frame(spark).collect()} == set(frame)
    follower.poll()
    assert follower.rows["k0"].state == model.get("k0")


def test_election_and_takeover(tmp_path):
    store = FileStore(str(tmp_path))
    fill(store, 6)
    clock = [100.0]
    one, two = (PersistedModel(store, MODEL, writer="elect") for _ in range(2))
    for m in (one, two):
        m.lease.now = lambda: clock[0]
    assert one.tick() and not two.tick() and two.rows["k1"].state == one.get("k1")
    clock[0] += 2
    assert one.tick() and not two.tick()
    clock[0] += 4  # the first one is silent
    fill(store, 4, 6)
    assert two.tick() and two.get("k0")["n"] == 3
    with pytest.raises(TransientError):
        one._publish(one._body({}, one.cursor()))
    assert not one.tick() and not one.is_writer and one.rows["k0"].state == two.get("k0")
    two.lease.release()
    assert one.tick() and not two.tick()
    lease = Lease(LocalFiles(), str(tmp_path / "lease"))
    assert lease.take() and not Lease(LocalFiles(), str(tmp_path / "lease")).take()


def test_the_erasure_fence(tmp_path):
    store = FileStore(str(tmp_path), build_schema([], ["key"], strict=False))
    fill(store, 8)
    model = LiveModel(store, MODEL)
    page = store.query(MODEL.source, limit=4, cursor=None, settled_only=True).events
    store.erase({"scopes": {"key": "k1"}})
    with pytest.raises(StalePageError):
        model.apply(page, (4, 4))
    assert model.rows == {}
    model.catch_up()
    assert set(model.rows) == {"k0", "k2", "k3"}


def test_processor_of_all_tenants(tmp_path):
    store = FileStore(str(tmp_path), build_schema([], ["key"], "tenantId", strict=False))
    for k in range(12):
        store.append([NewEvent("Job", {"n": k}, {"key": f"k{k % 2}"} | ({"tenantId": f"t{k % 3}"} if k < 9 else {}))])
    m = PersistedCrossTenantModel(store, MODEL)
    page = store.query(MODEL.source, limit=4, cursor=None, settled_only=True).events
    m.folded(page)
    assert m.checkpoints == {}  # they move with the commit only
    m._seen.clear()
    m.catch_up()
    again = PersistedCrossTenantModel(store, MODEL, writer=False)
    assert again.checkpoints == m.checkpoints == {"t0": (7, 7), "t1": (8, 8), "t2": (9, 9)}
    assert again.get_for("t0", "k0") == {"n": 2, "sum": 6} and again.list_for("t1").total == 2
    store.append([NewEvent("Job", {"n": 100}, {"key": "k0", "tenantId": "t0"})])
    assert again.get_for("t0", "k0") == {"n": 3, "sum": 106} and again.get_for("t1", "k0")["n"] == 1


def test_lists_forms_and_texts(tmp_path):
    from datetime import UTC, datetime

    store = FileStore(str(tmp_path))
    fill(store, 20)
    m = LiveModel(store, MODEL)
    m.catch_up()
    first = m._listed(m.rows, "", None, "sum", False)
    assert m._listed(m.rows, "", None, "sum", False) is first
    for n in range(2 * KEPT_LISTS):
        m.list(where={"n": n})
    assert len(m._lists) == KEPT_LISTS and m._listed(m.rows, "", None, "sum", False) is not first
    m.list().rows[0]["state"]["n"] = 99
    assert m.get("k0")["n"] == 5 and m.list(where={"n": "5"}).total == 0 == m.list(where={"n": True}).total and set(m.get_many(["k1", "x", "k1"])) == {"k1"}
    day = datetime(2020, 1, 1, tzinfo=UTC)
    assert doc_of({"a": -0.0, "b": float("nan"), "c": "x\0", "d": "\ud800", "e": day, "f": [1], "g": None, "h\0": 1, "i": True, "j": "🙂"}) == {"a": 0, "e": {"$date": 1577836800000}, "g": None, "i": True, "j": "🙂"}
    assert doc_of([1]) == {} and failed_text("a\0b\ud800") == "a�b�"
    assert failed_text("x" * 999 + "🙂") == "x" * 999 and failed_text("x" * 998 + "🙂y") == "x" * 998 + "🙂"


def test_a_state_that_cannot_be_stored_fails_at_its_event(tmp_path):
    store = FileStore(str(tmp_path))
    fill(store, 12)
    m = LiveModel(store, ModelDefinition("odd", 1, {}, "key", lambda s, e: object() if e.data["n"] == 5 else e.data["n"], 0))
    m.catch_up()
    assert m.rows["k1"].failed["sequence"] == 6 and m.get("k0") == 8


def test_changed_folds_warn_once(tmp_path):
    store = FileStore(str(tmp_path))
    fill(store, 4)
    PersistedModel(store, MODEL).catch_up()
    other = ModelDefinition("totals", 1, {"types": ["Job"]}, "key", lambda s, e: {"n": 0, "sum": 0}, {"n": 0, "sum": 0})
    with pytest.warns(UserWarning, match="totals changed under version 1"):
        PersistedModel(store, other, writer=False)
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("error")
        PersistedModel(store, other, writer=False)
        PersistedModel(store, MODEL, writer=False)


def test_rebuilds_read_the_log_once(tmp_path, spark):
    rows = spark.range(20_000).select((F.col("id") + 1).alias("sequence"), (F.col("id") + 1).alias("transaction_id"), F.lit("Job").alias("event_type"), F.concat(F.lit('{"n":1,"scopes":{"key":"k'), F.col("id") % 50, F.lit('"}}')).alias("payload"))
    store = FileStore(str(tmp_path), build_schema([], ["key"], strict=False))
    store.import_frame(spark, rows)
    looked = []
    hits, store._hits = store._hits, lambda f, r: looked.append(1) or hits(f, r)
    m = LiveModel(store, ModelDefinition("m", 1, {}, "key", lambda s, e: s + 1, 0, batch_size=500))
    m.catch_up()
    assert m.get("k7") == 400 and len(looked) <= 20_000 + 100


# ---- watches and views -------------------------------------------------------------------------------------------------


def until(f, seconds=10.0):
    deadline = time.time() + seconds
    while not f() and time.time() < deadline:
        time.sleep(0.02)
    assert f()


def test_watches_of_other_processes_and_one_reader(tmp_path):
    store = FileStore(str(tmp_path))
    fill(store, 2)
    watches, seen, more = Watches(store, poll=0.2), [], []
    ends = [watches.watch({"types": ["Job"]}, lambda es: seen.extend(e.data["n"] for e in es)) for _ in range(3)] + [watches.watch({"types": ["Job", "Job"]}, more.extend, data=False)]
    assert watches.readers == 2
    code = f"from strandlog.sources.store import FileStore\nfrom strandlog.functions.registry import NewEvent\nFileStore({str(tmp_path)!r}).append([NewEvent('Job', {{'n': 77}})])"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rpartition("/tests/")[0], timeout=60)
    until(lambda: seen.count(77) == 3 and len(more) == 1)
    assert seen == [77] * 3 and more[0].data == {}
    [end() for end in ends]
    assert watches.readers == 0
    store.append([NewEvent("Job", {"n": 78})])
    time.sleep(0.3)
    assert 78 not in seen


def test_a_watcher_that_falls_behind_is_dropped(tmp_path):
    store = FileStore(str(tmp_path))
    watches, errors, fast = Watches(store, queue=2, poll=0.05), [], []
    watches.watch({}, lambda es: time.sleep(0.5), errors.append)
    end = watches.watch({}, fast.extend)
    for k in range(12):
        store.append([NewEvent("Job", {"n": k})])
        time.sleep(0.06)
    until(lambda: errors and len(fast) == 12)
    end()
    watches.close()


NOTES = Registry({"NoteAdded": EventSpec(optional_scopes=("tenantId", "key"), upcast=lambda d: {"text": d.get("text", d.get("t"))})})


def test_views(tmp_path, spark):
    log = create_event_log(str(tmp_path), [NOTES], scope_keys=["key"], tenant_key="tenantId", strict=False)
    one, two = log.for_tenant("t1"), log.for_tenant("t2")
    seen = []
    off = one.on({}, lambda es: seen.extend(e.data["text"] for e in es))
    for k in range(4):
        (one if k % 2 else two).append([NewEvent("NoteAdded", {"t" if k < 2 else "text": f"x{k}"}, {"key": "a"})])
    off()
    assert seen == ["x1", "x3"] and [e.data["text"] for e in one.read(NOTES)] == ["x1", "x3"]
    definition = ModelDefinition("notes", 1, {}, "key", lambda s, e: [*s, e.data["text"]], [])
    a, b = one.read_model(definition), two.read_model(definition)
    a.catch_up(), b.catch_up()
    assert a.get("a") == ["x1", "x3"] and b.get("a") == ["x0", "x2"] and one.read_model(definition) is a and a is not b
    kept = one.persisted_read_model(definition)
    kept.catch_up()
    assert kept.get("a") == ["x1", "x3"] and one.persisted_read_model(definition, writer=False) is kept
    past = one.as_of(2)
    assert [e.data["text"] for e in past.read(NOTES)] == ["x1"] and past.context({}, lambda es, s: s + len(es), 0).state == 1
    assert log.as_of(3).for_tenant("t2").query({}).last_returned == 3
    with pytest.raises(PolicyViolationError):
        past.read_model(definition)
    with pytest.raises(TenantMismatchError):
        past.for_tenant("t2")
    with pytest.raises(UsageError):
        log.as_of(-1)
    assert sorted(r["payload"].split('"')[3] for r in log.as_frame(spark).df.collect()) == ["x0", "x1", "x2", "x3"]
    log.store.erase({"scopes": {"tenantId": "t1"}})
    one.invalidate()
    assert a.get("a") == [] == kept.get("a") and b.get("a") == ["x0", "x2"]
    late = create_event_log(str(tmp_path), [NOTES], scope_keys=["key"], tenant_key="tenantId", strict=False).for_tenant("t2")
    two.persisted_read_model(definition).catch_up()
    assert late.read_model(definition, start="persisted").rows["a"].state == ["x0", "x2"]


def test_contexts_share_a_budget(tmp_path, monkeypatch):
    from strandlog.operators import context

    store = FileStore(str(tmp_path))
    fill(store, 3)
    monkeypatch.setattr(context.PROCESS_BUDGET, "most", sum(c.kept_bytes() for c in context.PROCESS_BUDGET.caches) + 40_000)
    caches = [context.ContextCache(store) for _ in range(3)]
    for k in range(30):
        caches[k % 3].load({"types": ["Job"], "where": [{"n": k}]}, lambda es, s: s, "x" * 2000)
    assert sum(c.kept_bytes() for c in caches) <= 40_000 and all(c._kept for c in caches)


def test_slow_stores_are_still_right(tmp_path):
    store = Slow(FileStore(str(tmp_path)), 0.01)
    fill(store, 3)
    seen = []
    Subscription(store, "s", {}, seen.extend).run_until_caught_up()
    assert [e.data["n"] for e in seen] == [0, 1, 2]
