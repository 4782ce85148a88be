import threading

import pytest

from strandlog.functions.errors import ConflictError, PolicyViolationError, TenantMismatchError, UnindexableContextError, UniqueViolationError, UsageError, ValidationError, http_status_of
from strandlog.functions.registry import EventSpec, NewEvent, Registry, build_schema
from strandlog.operators.context import Command, ContextCache, Fold, execute, reject
from strandlog.operators.read import read
from strandlog.runtime import create_event_log
from strandlog.sources.store import FileStore, condition_lock_keys, event_lock_keys
from strandlog.testing import Interfering, given, make_event

BANK = Registry({
    "AccountOpened": EventSpec(unique=("owner",)),
    "MoneyDeposited": EventSpec(data=lambda d: [] if d.get("amount", 0) > 0 else ["amount must be above 0"], scopes=("accountOpenedId",), optional_scopes=("tenantId",)),
    "NoteAdded": EventSpec(optional_scopes=("accountOpenedId",), upcast=lambda d: {"text": d.get("text", d.get("t"))}),
})
BALANCE = Fold("balance", 1, BANK.fold({"MoneyDeposited": lambda s, e: s + e.data["amount"]}))


@pytest.fixture
def store(tmp_path):
    return FileStore(str(tmp_path / "log"), build_schema([BANK]))


def opened(store, owner="ann"):
    a = BANK.new("AccountOpened", {"owner": owner})
    store.append([a])
    return a.id


def deposit(account, amount=5, **more):
    return BANK.new("MoneyDeposited", {"amount": amount}, {"accountOpenedId": account}, **more)


def test_reads(store, spark):
    a = opened(store)
    store.append([deposit(a, 1), deposit(a, 2), NewEvent("NoteAdded", {"t": "x"})])
    q = BANK.scope("AccountOpened", a)
    r = store.query(q)
    assert [e.sequence for e in r.events] == [1, 2, 3] and r.context_version == r.last_returned == 3 and r.settled_cursor == (2, 3)
    assert store.query(q, after=2).context_version == 3 and len(store.query(q, until=2).events) == 2 and store.query(q, until=2).context_version == 2
    assert store.query(q, limit=0).events == [] and store.query(q, order="desc", limit=1).events[0].sequence == 3
    assert store.query({"types": ["NoteAdded"]}).events[0].data == {"text": "x"}
    assert store.query(q, version=False).context_version == -1 and store.query(q, payload=False).events[0].id == "~1"
    assert [len(x) for x in store.query([q, {"types": ["MoneyDeposited"]}]).by_filter] == [3, 2]
    log = store.snapshot(spark)
    for options in ({}, {"after": 1}, {"until": 2}, {"limit": 2, "order": "desc"}, {"cursor": (2, 2)}):
        mine, other = read(log, q, **{"order": "asc"} | options), store.query(q, **options)
        assert [r["sequence"] for r in mine.rows.collect()] == [e.sequence for e in other.events]
        s = mine.summary().first()
        assert (s["context_version"], s["last_returned"]) == (other.context_version, other.last_returned)


def test_one_winner_of_twenty(store):
    a = opened(store)
    ctx = store.query(BANK.scope("AccountOpened", a)).ctx
    won, lost = [], []

    def race(k):
        try:
            won.append(FileStore(store.directory, store.schema).append_if([deposit(a, k + 1)], ctx))
        except ConflictError as e:
            lost.append(e)

    threads = [threading.Thread(target=race, args=(k,)) for k in range(20)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 19 and lost[0].expected == 1 and lost[0].actual == 2 and http_status_of(lost[0]) == 409
    with open(f"{store.directory}/data/left.parquet", "w"):
        pass
    assert store.sweep() == 0 and store.sweep(-1) >= 1 and len(store.query({}).events) == 2


def test_parallel_appends_have_all_sequences(store):
    threads = [threading.Thread(target=lambda k=k: [FileStore(store.directory, store.schema).append([NewEvent("NoteAdded", {"text": f"{k}-{n}"})]) for n in range(5)]) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [e.sequence for e in store.query({}).events] == list(range(1, 31))


def test_uniques_and_idempotency(store):
    opened(store)
    with pytest.raises(UniqueViolationError) as e:
        opened(store)
    assert "ann" not in str(e.value)
    with pytest.raises(UniqueViolationError):
        store.append([BANK.new("AccountOpened", {"owner": "bob"}), BANK.new("AccountOpened", {"owner": "bob"})])
    store.append([NewEvent("AccountOpened", {"owner": None}), NewEvent("AccountOpened", {"owner": None})])
    store.append([NewEvent("NoteAdded", {}, metadata={"idempotencyKey": "1"})])
    with pytest.raises(UniqueViolationError):
        store.append([NewEvent("NoteAdded", {}, metadata={"idempotencyKey": "1"})])


@pytest.mark.parametrize("event", [NewEvent("AccountOpened", {"accountOpenedId": "x"}), NewEvent("NoteAdded", {"scopes": {}}), NewEvent("NoteAdded", {"accountOpenedId": 1}), NewEvent("NoteAdded", {}, {"a b": "x"}), NewEvent("NoteAdded", {}, {"a": ""}), NewEvent("NoteAdded", [])])
def test_refused_envelopes(store, event):
    with pytest.raises(ValidationError):
        store.append([event])
    assert store.query({}).events == []


def test_refused_batches_and_guards(store):
    with pytest.raises(UsageError):
        store.append([])
    with pytest.raises(UnindexableContextError):
        store.append_if([NewEvent("NoteAdded", {})], ({"types": ["NoteAdded"]}, 0))
    with pytest.raises(UsageError):
        condition_lock_keys({"scopes": {"accountOpenedId": [str(k) for k in range(257)]}}, store.schema)
    assert event_lock_keys([deposit("a")], store.schema) == condition_lock_keys({"scopes": {"accountOpenedId": "a"}}, store.schema)[0]
    with pytest.raises(ValidationError):
        BANK.new("MoneyDeposited", {"amount": 0}, {"accountOpenedId": "a"})


def test_open_transactions(tmp_path):
    ids, settled = iter([100, 101, 102]), {100}
    store = FileStore(str(tmp_path), allocate_id=lambda first: next(ids), is_settled=lambda t: t in settled)
    for k in range(3):
        store.append([NewEvent("A", {"n": k})])
    assert [e.sequence for e in store.query({}, settled_only=True).events] == [1]
    assert [e.sequence for e in store.query({}, cursor=(100, 1)).events] == [2, 3]
    settled.update({101, 102})
    assert [e.sequence for e in store.query({}, cursor=(100, 1), limit=1).events] == [2]
    assert store.query({}, cursor=None).settled_cursor == (102, 3)


def test_contexts_and_commands(store, tmp_path):
    a = opened(store)
    q = BANK.scope("AccountOpened", a)
    store.append([deposit(a, k + 1) for k in range(30)])
    cache = ContextCache(store, page=7, stored=str(tmp_path / "states"), store_every=10)
    first, again = cache.load(q, BALANCE, 0), cache.load(q, BALANCE, 0)
    assert first.state == again.state == 465 and not first.cache_hit and again.cache_hit and again.delta == 0
    assert ContextCache(store, page=7).load(q, BALANCE, 0).state == 465
    kept = ContextCache(store, stored=str(tmp_path / "states")).load(q, BALANCE, 0)
    assert kept.state == 465 and kept.delta == 0
    done = execute(Interfering(store, lambda: store.append([deposit(a, 1)])), cache, Command(lambda s: [deposit(a, s)], q, BALANCE, 0, sleep=lambda s: None))
    assert done.ok and done.attempts == 2 and cache.load(q, BALANCE, 0).state == 932
    assert execute(store, cache, Command(lambda s: reject("poor"), q, BALANCE, 0)).code == "poor"
    assert execute(store, cache, Command(lambda s: [], q, BALANCE, 0)).appended is None
    never = execute(Interfering(store, lambda: store.append([deposit(a, 1)]), 9), cache, Command(lambda s: [deposit(a, 1)], q, BALANCE, 0, sleep=lambda s: None))
    assert never.code == "conflict" and never.attempts == 4


def test_tenants_and_the_past(tmp_path):
    log = create_event_log(str(tmp_path), [BANK], tenant_key="tenantId", strict=False)
    one, two = log.for_tenant("t1"), log.for_tenant("t2")
    one.append([NewEvent("NoteAdded", {"text": "x"})])
    two.append([NewEvent("NoteAdded", {"text": "y"})])
    assert [e.data["text"] for e in one.query({}).events] == ["x"] and [s["count"] for s in two.statistics()] == [1]
    for bad in (lambda: one.append([NewEvent("NoteAdded", {}, {"tenantId": "t2"})]), lambda: one.query({"scopes": {"tenantId": "t2"}})):
        with pytest.raises(TenantMismatchError):
            bad()
    past = log.as_of(2).as_of(1)
    assert len(past.query({}).events) == 1 and past.query({}).context_version == 1
    with pytest.raises(PolicyViolationError):
        past.append([])


def test_specs():
    run = BANK.fold({"MoneyDeposited": lambda s, e: s + e.data["amount"]})
    command = Command(lambda s: reject("poor") if s < 5 else [deposit("a", s)], {}, run, 0)
    given(make_event("MoneyDeposited", {"amount": 7})).when(command).then(("MoneyDeposited", {"amount": 7}))
    given(make_event("MoneyDeposited", {"amount": 2})).when(command).then_rejects("poor")
    assert BANK.fold_by(lambda e: e.scopes.get("k"), {"NoteAdded": lambda s, e: None if e.data.get("end") else (s or 0) + 1})([make_event("NoteAdded", {}, {"k": "a"}), make_event("NoteAdded", {"end": 1}, {"k": "a"}), make_event("NoteAdded", {}, {"k": "b"}), make_event("NoteAdded")], {}) == {"b": 1}


def test_bounded_reads_agree_with_whole_ones(store):
    a, b = opened(store, "ann"), opened(store, "bob")
    for k in range(20):
        store.append([deposit(a if k % 3 else b, k + 1)])
    for q in (BANK.scope("AccountOpened", a), {"types": ["AccountOpened"]}):
        whole = store.query(q)
        for n in (0, 1, 5, 21, 22):
            part, capped = store.query(q, after=n), store.query(q, after=n, until=12)
            assert [e.sequence for e in part.events] == [e.sequence for e in whole.events if e.sequence > n] and part.context_version == whole.context_version
            assert capped.context_version == max(e.sequence for e in whole.events if e.sequence <= 12)
            beyond = store.query(q, cursor=(n, n))
            assert [e.sequence for e in beyond.events] == [e.sequence for e in whole.events if e.sequence > n] and beyond.context_version == whole.context_version


def test_keys_declared_later(tmp_path, spark):
    store = FileStore(str(tmp_path), build_schema([], ["a"], strict=False))
    store.append([NewEvent("T", {}, {"a": "1", "b": "2"})])
    more = FileStore(str(tmp_path), build_schema([], ["a", "b"], strict=False))
    more.append([NewEvent("T", {}, {"b": "2"})])
    log = more.snapshot(spark)
    assert log.scope_keys == ("a",)
    assert read(log, {"scopes": {"b": "2"}}).rows.count() == 2 == len(more.query({"scopes": {"b": "2"}}).events)
    (tmp_path / "properties.json").write_text('{"rule": 0, "scope_keys": []}')
    with pytest.raises(UsageError):
        FileStore(str(tmp_path))
