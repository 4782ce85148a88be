"""What the executors do for a log of any size, held against the same work page by page."""

import pytest

from strandlog.functions.registry import EventSpec, NewEvent, Registry, build_schema
from strandlog.operators.live import CrossTenantModel, LiveModel, ModelDefinition, PersistedCrossTenantModel, PersistedModel
from strandlog.plans import catalogue
from strandlog.sources.files import LocalFiles
from strandlog.sources.store import FileStore

DATA = "/root/testdata/sf0.001"


def functions():
    """A fold and an upcast that go to the executors by value: this file is not theirs to import."""

    def fold(state, e):
        if e.data["n"] == 23:
            raise ValueError("poison")
        return {"n": state["n"] + 1, "seen": [*state["seen"], e.data["n"]], "last": e.id}

    def moved(data):
        return {"n": data["n"]} | ({"key": data["old"]} if "old" in data else {})

    return fold, moved


def filled(tmp_path, upcast=None):
    spec = EventSpec(optional_scopes=("key", "tenant"), upcast=upcast)
    store = FileStore(str(tmp_path / "log"), build_schema([Registry({"Job": spec, "Other": spec})], tenant_key="tenant"))
    for k in range(0, 60, 3):
        store.append([NewEvent("Other" if m % 11 == 0 else "Job", {"n": m} | ({"old": "flat"} if m % 7 == 0 else {}), ({"key": f"k{m % 4}"} if m % 7 else {}) | ({"tenant": f"t{m % 2}"} if m % 5 else {})) for m in range(k, k + 3)])
    return store


def told(rows):
    return {k: (r.state if r.failed is None else None, r.failed) for k, r in rows.items()}


@pytest.mark.parametrize("upcast", [False, True])
@pytest.mark.parametrize("kind", [LiveModel, CrossTenantModel, PersistedModel, PersistedCrossTenantModel])
def test_models_begin_on_executors(tmp_path, spark, monkeypatch, kind, upcast):
    fold, moved = functions()
    store = filled(tmp_path, moved if upcast else None)
    paged_definition, definition = (ModelDefinition(name, 1, {"types": ["Job"]}, "key", fold, {"n": 0, "seen": [], "last": None}, batch_size=7) for name in ("paged", "begun"))
    paged, begun = kind(store, paged_definition), kind(store, definition)
    paged.catch_up()
    sizes, query = [], FileStore.query
    monkeypatch.setattr(FileStore, "query", lambda *a, **o: (r := query(*a, **o), sizes.append(len(r.events)))[0])
    begun.catch_up(spark)
    assert sizes == [0] and told(begun.rows) == told(paged.rows) and begun.cursor() == paged.cursor()
    assert any(r.failed for r in begun.rows.values()) and len(begun.rows) >= 3 and (not upcast or any(k.endswith("flat") for k in begun.rows))
    assert getattr(begun, "checkpoints", None) == getattr(paged, "checkpoints", None)
    store.append([NewEvent("Job", {"n": 99}, {"key": "k2", "tenant": "t0"})])
    paged.catch_up()
    begun.catch_up(spark)
    assert told(begun.rows) == told(paged.rows)
    if isinstance(begun, PersistedModel):
        reader = kind(store, definition, writer=False)
        assert told(reader.rows) == told(paged.rows) and reader.cursor() == paged.cursor() and reader.changes()[2]
        shown = lambda m: sorted((r["key"], r["state"], r["failed"]) for r in m.frame(spark).collect())
        assert shown(begun) == shown(paged)
        begun.write_snapshot()
        assert begun.trim() >= 3 and not [n for n in LocalFiles().names(begun.directory) if n.startswith("states-")]
        assert told(kind(store, definition, writer=False).rows) == told(paged.rows) and shown(begun) == shown(paged)
        begun.invalidate(spark)
        assert told(begun.rows) == told(paged.rows)


@pytest.mark.parametrize("name", ["cross_tenant_processor", "persisted_model_rows", "live_model_page"])
def test_model_queries_bring_no_records_to_the_driver(spark, monkeypatch, name):
    sizes, query = [], FileStore.query
    monkeypatch.setattr(FileStore, "query", lambda *a, **o: (r := query(*a, **o), sizes.append(len(r.events)))[0])
    catalogue.queries()[name](spark, DATA).collect()
    assert sizes and sum(sizes) == 0


def test_orders_log_is_shuffled_once(spark):
    """Numbering and import together: one shuffle of the rows, and files that are ranges of the sequence."""
    from strandlog.sources.canonical import ORDER_KEYS, new_store, orders_frame

    java = spark._jvm.java.util
    stages = lambda: spark._jsc.sc().statusStore().stageList(java.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), java.ArrayList())
    shuffled = lambda: sum(s.shuffleWriteRecords() for s in (stages().apply(k) for k in range(stages().size())))
    before = shuffled()
    store = new_store(spark, orders_frame(spark, DATA), ORDER_KEYS, None, True)
    rows = sum(s.rows for s in store.segments())
    assert rows == store.segments()[-1].last == sum(spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("customer", "orders", "lineitem")) and shuffled() - before < 1.1 * rows + 500
    assert all(a.last + 1 == b.first for a, b in zip(store.segments(), store.segments()[1:], strict=False))
    for s in store.segments():
        own = [r["sequence"] for r in store._rows_of(s)]
        assert own == list(range(s.first, s.last + 1))


def test_a_context_reads_columns_first(spark, monkeypatch):
    """A context over a long log makes rows of what may match, and the version is not looked for on every page."""
    from strandlog.functions.filters import scope
    from strandlog.operators.context import ContextCache
    from strandlog.sources import store as module
    from strandlog.sources.canonical import EVENT_KEYS, events_frame, new_store, store_of

    monkeypatch.setattr(module, "MOST_WHOLE", 10)
    store = new_store(spark, events_frame(spark, DATA), EVENT_KEYS, "tenantId")
    whole = store_of(spark, store.directory, EVENT_KEYS, "tenantId")
    every = [r for s in whole.segments() for r in whole._rows_of(s)]
    wanted = [r for r in every if r["scope_userId"] == "u7"]
    assert len(wanted) > 6
    looked, last = [], FileStore._last_match
    monkeypatch.setattr(FileStore, "_last_match", lambda *a: looked.append(a) or last(*a))
    cache = ContextCache(store, page=3)
    fold = lambda events, s: [*s, *(e.sequence for e in events)]
    found = cache.load(scope("userId", "u7"), fold, [])
    assert found.state == [r["sequence"] for r in wanted] and found.ctx[1] == max(found.state) and not looked
    assert sum(map(len, store._rows.values())) == len(wanted) < len(every)
    again = cache.load(scope("userId", "u7"), fold, [])
    assert again.cache_hit and (again.state, again.ctx[1]) == (found.state, found.ctx[1])
    for query in [{"types": ["error"]}, [{"types": ["click"], "scopes": {"tenantId": "t2"}}, scope("userId", ["u1", "u2"])], {"types": []}, {"types": ["view"], "not": {"scopes": {"userId": "u3"}}}]:
        monkeypatch.setattr(module, "MOST_WHOLE", 10)
        some = store_of(spark, store.directory, EVENT_KEYS, "tenantId").query(query)
        monkeypatch.setattr(module, "MOST_WHOLE", 1 << 40)
        assert some == store_of(spark, store.directory, EVENT_KEYS, "tenantId").query(query)


def test_import_of_a_frame_that_is_not_in_order(spark):
    """A frame whose files are no ranges of the sequence, though it was said to be in order, is sorted after all."""
    from strandlog.sources.canonical import ORDER_KEYS, new_store, orders_frame

    mixed = orders_frame(spark, DATA).repartition(3)
    store = new_store(spark, mixed, ORDER_KEYS, None, True)
    found = [r["sequence"] for s in store.segments() for r in store._rows_of(s)]
    assert found == list(range(1, mixed.count() + 1)) and all(a.last < b.first for a, b in zip(store.segments(), store.segments()[1:], strict=False))
