"""What every store of the log must do, as cases that run over any store: for makers of stores, and for our own.

for name, case in cases(): case(make), where make(schema, **options) gives a new empty store.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from typing import Any

from strandlog.functions.errors import ConflictError, UnindexableContextError, UniqueViolationError, UsageError, ValidationError
from strandlog.functions.filters import UNDEFINED
from strandlog.functions.registry import EventSpec, NewEvent, Registry, build_schema

Make = Callable[..., Any]
_CASES: list[tuple[str, Callable[[Make], None]]] = []

SHOP = Registry({
    "OrderPlaced": EventSpec(unique=("number",), optional_scopes=("customerId",)), "ItemAdded": EventSpec(scopes=("orderPlacedId",), optional_scopes=("tenantId",)),
    "Renamed": EventSpec(upcast=lambda d: {"name": d.get("name", d.get("title"))}), "Owned": EventSpec(id_key="ownId"),
})
SCHEMA = build_schema([SHOP], ["tenantId"], strict=False)


def case(f: Callable[[Make], None]) -> Callable[[Make], None]:
    _CASES.append((f.__name__, f))
    return f


def cases() -> Iterator[tuple[str, Callable[[Make], None]]]:
    yield from _CASES


def sequences(store: Any, query: Any = None, **options: Any) -> list[int]:
    return [e.sequence for e in store.query({} if query is None else query, **options).events]


def refused(kind: type[BaseException], f: Callable[[], Any]) -> BaseException:
    try:
        f()
    except kind as e:
        return e
    raise AssertionError(f"{kind.__name__} was expected")


def filled(make: Make) -> Any:
    """Orders a and b with items in turn, then notes without a scope: sequences 1 to 10."""
    store = make(SCHEMA)
    store.append([NewEvent("OrderPlaced", {"number": 1}, {"customerId": "c"}, "a"), NewEvent("OrderPlaced", {"number": 2}, {}, "b")])
    for k in range(6):
        store.append([NewEvent("ItemAdded", {"price": k, "tags": ["x", f"t{k}"], "at": {"shelf": k % 2}}, {"orderPlacedId": "ab"[k % 2]})])
    store.append([NewEvent("Renamed", {"title": "old"}), NewEvent("Renamed", {"name": None})])
    return store


@case
def an_empty_store_reads_empty(make: Make) -> None:
    r = make(SCHEMA).query({})
    assert (r.events, r.context_version, r.last_returned, r.settled_cursor) == ([], 0, 0, None)


@case
def appends_number_records_without_gaps(make: Make) -> None:
    store = filled(make)
    assert sequences(store) == list(range(1, 11))
    done = store.append([NewEvent("Renamed", {}), NewEvent("Renamed", {})])
    assert (done.first, done.last, done.count) == (11, 12, 2)


@case
def a_batch_is_all_or_nothing(make: Make) -> None:
    store = make(SCHEMA)
    refused(ValidationError, lambda: store.append([NewEvent("Renamed", {}), NewEvent("Renamed", {"scopes": 1})]))
    assert sequences(store) == []


@case
def records_come_back_as_written(make: Make) -> None:
    store = make(SCHEMA)
    data = {"text": "ü 🙂 \u0000", "n": 1.5, "none": None, "deep": {"a": [1, {"b": False}]}}
    store.append([NewEvent("Renamed", data | {"name": "x"}, {"customerId": "c"}, "id1", {"by": "me"})])
    plain = make(build_schema([], strict=False))
    plain.append([NewEvent("Note", data, {"k": "v"}, "id1", {"by": "me"})])
    e = plain.query({}).events[0]
    assert (e.type, e.id, e.data, e.scopes, e.metadata) == ("Note", "id1", data, {"k": "v"}, {"by": "me"})


@case
def undefined_keys_vanish(make: Make) -> None:
    store = make(build_schema([], strict=False))
    store.append([NewEvent("Note", {"a": UNDEFINED, "b": float("nan")})])
    assert store.query({}).events[0].data == {"b": None}


@case
def types_select(make: Make) -> None:
    store = filled(make)
    assert sequences(store, {"types": ["OrderPlaced"]}) == [1, 2] and sequences(store, {"types": []}) == [] and sequences(store, {"types": ["Never"]}) == []


@case
def scopes_select_own_ids_and_links(make: Make) -> None:
    store = filled(make)
    assert sequences(store, {"scopes": {"orderPlacedId": "a"}}) == [1, 3, 5, 7] and sequences(store, {"scopes": {"orderPlacedId": ["a", "b"]}}) == list(range(1, 9))
    assert sequences(store, {"scopes": {"orderPlacedId": "a", "customerId": "c"}}) == [1]


@case
def undeclared_scopes_are_found_too(make: Make) -> None:
    store = make(build_schema([], strict=False))
    store.append([NewEvent("T", {"flat": "1"}), NewEvent("T", {"flat": 1}), NewEvent("T", {}, {"flat": "1"}), NewEvent("T", {"flat": "1"}, {"flat": "2"})])
    assert sequences(store, {"scopes": {"flat": "1"}}) == [1, 3]


@case
def where_contains(make: Make) -> None:
    store = filled(make)
    assert sequences(store, {"where": [{"price": 3}]}) == [6] and sequences(store, {"where": [{"tags": ["t1"]}, {"at": {"shelf": 0}}]}) == [3, 4, 5, 7]
    assert sequences(store, {"where": [{"price": "3"}]}) == [] and sequences(store, {"types": ["Renamed"], "where": [{"name": None}]}) == [10]


@case
def negations_leave_out(make: Make) -> None:
    store = filled(make)
    assert sequences(store, {"not": {"types": ["ItemAdded"]}}) == [1, 2, 9, 10] and sequences(store, {"types": ["ItemAdded"], "not": [{"scopes": {"orderPlacedId": "a"}}, {"where": [{"price": 1}]}]}) == [6, 8]


@case
def malformed_queries_are_refused(make: Make) -> None:
    store = make(SCHEMA)
    for q in ([], {"not": {}}, {"not": {"where": [{}]}}, {"not": {"not": {"types": ["a"]}}}, {"not": {"where": [{"a": UNDEFINED}]}}, {"scopes": {"a b": "x"}}, {"scopes": {"a": []}}, [{}] * 65):
        refused(UsageError, lambda q=q: store.query(q))
    for o in ({"limit": -1}, {"after": 1.5}, {"order": "up"}, {"omit": ["scopes"]}, {"cursor": 3}, {"unknown": 1}):
        refused(UsageError, lambda o=o: store.query({}, **o))


@case
def many_filters_give_each_record_once(make: Make) -> None:
    r = filled(make).query([{"types": ["OrderPlaced"]}, {"scopes": {"orderPlacedId": "a"}}])
    assert [e.sequence for e in r.events] == [1, 2, 3, 5, 7] and [[e.sequence for e in f] for f in r.by_filter] == [[1, 2], [1, 3, 5, 7]]


@case
def bounds_and_versions(make: Make) -> None:
    store = filled(make)
    q = {"scopes": {"orderPlacedId": "a"}}
    assert sequences(store, q, after=3) == [5, 7] and store.query(q, after=7).context_version == 7 and sequences(store, q, until=4) == [1, 3] and store.query(q, until=4).context_version == 3
    assert sequences(store, q, order="desc", limit=2) == [7, 5] and store.query(q, limit=0).context_version == 7 and store.query(q, limit=1).context_version == 7
    assert store.query(q, order="desc", limit=0).context_version == 7 and store.query(q, order="desc", limit=1, after=3).context_version == 7
    assert store.query(q, version=False).context_version == -1 and store.query({"types": ["Never"]}).context_version == 0


@case
def pages_by_cursor_meet_every_record_once(make: Make) -> None:
    store = filled(make)
    for size in (1, 3, 100):
        seen, cursor = [], None
        while page := store.query({"not": {"types": ["Renamed"]}}, cursor=cursor, limit=size, settled_only=True).events:
            seen += [e.sequence for e in page]
            cursor = page[-1].transaction_id, page[-1].sequence
        assert seen == list(range(1, 9))


@case
def projections(make: Make) -> None:
    store = filled(make)
    q = {"types": ["ItemAdded"]}
    assert set(store.query(q, omit=["tags", "at"]).events[0].data) == {"price"} and store.query(q, data=False).events[0].data == {}
    assert store.query(q, payload=False).events[0].id == "~3" and store.query(q, data=False).events[0].scopes == {"orderPlacedId": "a"}
    refused(UsageError, lambda: store.query({"types": ["OrderPlaced"]}, omit=["orderPlacedId"]))


@case
def upcasts_on_read(make: Make) -> None:
    assert [e.data for e in filled(make).query({"types": ["Renamed"]}).events] == [{"name": "old"}, {"name": None}]


@case
def own_id_keys(make: Make) -> None:
    store = make(SCHEMA)
    store.append([NewEvent("Owned", {"x": 1}, {}, "o1")])
    e = store.query({"scopes": {"ownId": "o1"}}).events[0]
    assert e.id == "o1" and e.data == {"x": 1}


@case
def guards_hold(make: Make) -> None:
    store = filled(make)
    a, b = (store.query({"scopes": {"orderPlacedId": k}}).ctx for k in "ab")
    store.append_if([NewEvent("ItemAdded", {"price": 9}, {"orderPlacedId": "a"})], a)
    e = refused(ConflictError, lambda: store.append_if([NewEvent("ItemAdded", {"price": 9}, {"orderPlacedId": "a"})], a))
    assert (e.expected, e.actual) == (7, 11)
    store.append_if([NewEvent("ItemAdded", {"price": 9}, {"orderPlacedId": "b"})], b)
    refused(UsageError, lambda: store.append_if([NewEvent("Renamed", {})], (a[0], -1)))


@case
def strict_guards_need_a_declared_scope(make: Make) -> None:
    store = make(build_schema([SHOP]))
    refused(UnindexableContextError, lambda: store.append_if([NewEvent("Renamed", {})], ({"types": ["Renamed"]}, 0)))


@case
def one_of_many_writers_wins(make: Make) -> None:
    store = filled(make)
    ctx, won, lost = store.query({"scopes": {"orderPlacedId": "a"}}).ctx, [], []

    def race(k: int) -> None:
        try:
            won.append(store.append_if([NewEvent("ItemAdded", {"price": k}, {"orderPlacedId": "a"})], ctx))
        except ConflictError as e:
            lost.append(e)

    threads = [threading.Thread(target=race, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 7


@case
def unique_paths(make: Make) -> None:
    store = filled(make)
    e = refused(UniqueViolationError, lambda: store.append([NewEvent("OrderPlaced", {"number": 1})]))
    assert (e.type, e.path) == ("OrderPlaced", "number") and "1" not in str(e).replace("OrderPlaced", "")
    store.append([NewEvent("OrderPlaced", {"number": "1"}), NewEvent("OrderPlaced", {"number": None}), NewEvent("OrderPlaced", {})])


@case
def idempotency_keys_are_one_tenants_own(make: Make) -> None:
    store = make(build_schema([SHOP], tenant_key="tenantId", strict=False))
    of = lambda tenant: [NewEvent("Renamed", {}, {"tenantId": tenant}, metadata={"idempotencyKey": "k"})]
    store.append(of("t1"))
    store.append(of("t2"))
    assert refused(UniqueViolationError, lambda: store.append(of("t1"))).idempotency_key


@case
def batches_have_limits(make: Make) -> None:
    store = make(SCHEMA)
    refused(UsageError, lambda: store.append([]))
    refused(UsageError, lambda: store.append([NewEvent("Renamed", {})] * 10_001))


@case
def statistics_count(make: Make) -> None:
    found = {s["type"]: (s["count"], s["last_sequence"]) for s in filled(make).statistics({"not": {"types": ["Renamed"]}})}
    assert found == {"OrderPlaced": (2, 2), "ItemAdded": (6, 8)}


@case
def open_transactions_are_not_passed(make: Make) -> None:
    ids, done = iter([101, 100, 102]), {101, 102}
    store = make(SCHEMA, allocate_id=lambda first: next(ids), is_settled=lambda t: t in done)
    for _ in range(3):
        store.append([NewEvent("Renamed", {})])
    first = store.query({}, cursor=None, settled_only=True)
    assert [e.sequence for e in first.events] == [1, 3] and first.watermark == 100
    assert sequences(store, cursor=(101, 1)) == [2, 3]
    done.add(100)
    assert sequences(store, cursor=(100, 2)) == [1, 3] and sequences(store, settled_only=True) == [2, 1, 3]


@case
def appends_are_pushed(make: Make) -> None:
    store, seen = make(SCHEMA), []
    off = store.on_appended(lambda records: seen.extend(r.sequence for r in records))
    store.append([NewEvent("Renamed", {}), NewEvent("Renamed", {})])
    off()
    store.append([NewEvent("Renamed", {})])
    assert seen == [1, 2]


@case
def erased_records_stay_away(make: Make) -> None:
    store = filled(make)
    assert store.erase({"scopes": {"orderPlacedId": "a"}}) == 4 and sequences(store) == [2, 4, 6, 8, 9, 10]
    refused(UniqueViolationError, lambda: store.append([NewEvent("OrderPlaced", {"number": 1})]))
    assert store.append([NewEvent("Renamed", {})]).first == 11
