"""The whole log behind one object, and narrowed views of it."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import SparkSession

from strandlog.functions.errors import NotConfiguredError, PolicyViolationError, TenantMismatchError, UsageError
from strandlog.functions.filters import SAFE, Query, normalised
from strandlog.functions.registry import NewEvent, Recorded, Registry, build_schema
from strandlog.operators import read as reads
from strandlog.operators.context import Command, Context, ContextCache, Outcome, execute
from strandlog.operators.live import LiveModel, ModelDefinition, PersistedCrossTenantModel, PersistedModel
from strandlog.sources.canonical import Log
from strandlog.sources.store import Appended, FileStore, Result
from strandlog.streaming.subscribe import Subscription, Watches, follow

PLATFORM = "00000000-0000-0000-0000-000000000000"


def narrowed(query: Query, key: str, tenant: str) -> Query:
    """The query within a tenant; a claim to another tenant is an error."""
    out = []
    for f in normalised(query):
        claimed = f.get("scopes", {}).get(key)
        if claimed is not None and claimed != [tenant]:
            raise TenantMismatchError("the query names another tenant")
        out.append(f | {"scopes": f.get("scopes", {}) | {key: [tenant]}})
    return out


class EventLog:
    def __init__(self, store: FileStore, registries: list[Registry] = (), cache: ContextCache | None = None, most_views: int = 10_000, stored_states: str | None = None):
        self.store, self.registries = store, list(registries)
        self.cache = cache or ContextCache(store, stored=stored_states)
        self.watches = Watches(store)
        self._views: OrderedDict[str, TenantView] = OrderedDict()
        self._most_views = most_views
        self._models: dict[tuple, tuple[ModelDefinition, LiveModel]] = {}

    def query(self, query: Query, **options: Any) -> Result:
        return self.store.query(query, **options)

    def read(self, registry: Registry, query: Query | None = None, **options: Any) -> list[Recorded]:
        """Records of a registry's types, checked against their declarations."""
        return [registry.parse(r) for r in self.store.query(query if query is not None else registry.filter(), **options).events]

    def append(self, events: list[NewEvent]) -> Appended:
        self._check(events)
        return self.store.append(events)

    def append_if(self, events: list[NewEvent], ctx: tuple[Query, int]) -> Appended:
        self._check(events)
        return self.store.append_if(events, ctx)

    def _check(self, events: list[NewEvent]) -> None:
        for e in events:
            for r in self.registries:
                if e.type in r.specs:
                    r.validate(e)

    def statistics(self, query: Query | None = None) -> list[dict]:
        return self.store.statistics(query)

    def context(self, query: Query, fold: Any, initial: Any = None) -> Context:
        return self.cache.load(query, fold, initial)

    def command(self, command: Command) -> Outcome:
        return execute(self.store, self.cache, command)

    def subscribe(self, name: str, query: Query, handler: Callable | None = None, **options: Any) -> Subscription:
        return Subscription(self.store, name, query, handler, **options)

    def on(self, query: Query, handler: Callable[[list[Recorded]], None]) -> Callable[[], None]:
        return follow(self.store, query, handler)

    def watch(self, query: Query, handler: Callable, on_error: Callable | None = None, **projection: Any) -> Callable[[], None]:
        return self.watches.watch(query, handler, on_error, **projection)

    def read_model(self, definition: ModelDefinition, tenant: str = "", start: str = "rebuild") -> LiveModel:
        """One live model for each tenant, name and version. start="persisted" goes on from the persisted model's rows."""

        def make() -> LiveModel:
            own = self._narrowed(definition, tenant)
            if start != "persisted":
                return LiveModel(self.store, own)
            kept = PersistedModel(self.store, own, self._folder(tenant), writer=False)
            return LiveModel(self.store, own, (kept.rows, kept.cursor()) if kept.cursor() else None)

        return self._model(("live", tenant, definition.name, definition.version), definition, make)

    def persisted_read_model(self, definition: ModelDefinition, tenant: str = "", writer: bool | str = True) -> LiveModel:
        return self._model(("persisted", tenant, definition.name, definition.version), definition, lambda: PersistedModel(self.store, self._narrowed(definition, tenant), self._folder(tenant), writer))

    def cross_tenant_model(self, definition: ModelDefinition, writer: bool | str = True) -> PersistedCrossTenantModel:
        """One persisted model, kept by one writer for all tenants."""
        return self._model(("processor", "", definition.name, definition.version), definition, lambda: PersistedCrossTenantModel(self.store, definition, writer=writer))

    def _folder(self, tenant: str) -> str:
        import hashlib

        return f"{self.store.directory}/models" + (f"-of-{hashlib.sha256(tenant.encode()).hexdigest()[:32]}" if tenant else "")

    def _narrowed(self, definition: ModelDefinition, tenant: str) -> ModelDefinition:
        return replace(definition, source=narrowed(definition.source, self.store.schema.tenant_key, tenant)) if tenant else definition

    def _model(self, key: tuple, definition: ModelDefinition, make: Callable[[], LiveModel]) -> LiveModel:
        if key not in self._models:
            self._models[key] = definition, make()
        if self._models[key][0] is not definition:
            raise UsageError(f"{definition.name} version {definition.version} is defined twice")
        return self._models[key][1]

    def as_frame(self, spark: SparkSession) -> Log:
        """The log for Spark, with payloads as the current versions of their types say."""
        schema = self.store.schema
        python = {t: f for t, f in schema.upcasts.items() if t not in schema.upcast_columns}
        return reads.upcasted(self.store.snapshot(spark), schema.upcast_columns, python)

    def invalidate(self, query: Query | None = None, tenant: str | None = None) -> None:
        """Forgets kept states. Without a query all of them (of one tenant, if given), and models are built anew; with one, only
        the contexts of that query."""
        self.cache.invalidate(query)
        if query is None:
            for key, (_, m) in self._models.items():
                if tenant is None or key[1] == tenant:
                    m.rebuild() if not isinstance(m, PersistedModel) else m.invalidate() if m.is_writer else m.poll()

    def for_tenant(self, tenant: str) -> TenantView:
        if self.store.schema.tenant_key is None:
            raise UsageError("no tenant key is configured")
        if tenant not in self._views:
            self._views[tenant] = TenantView(self, tenant)
            while len(self._views) > self._most_views:
                self._views.popitem(last=False)
        self._views.move_to_end(tenant)
        return self._views[tenant]

    def for_platform(self) -> TenantView:
        return self.for_tenant(PLATFORM)

    def as_of(self, sequence: int) -> PastView:
        return PastView(self, sequence)


class TenantView:
    """Everything within one tenant: reads are narrowed, appends stamped, foreign claims refused."""

    def __init__(self, log: EventLog, tenant: str):
        self.log, self.tenant, self.key = log, tenant, log.store.schema.tenant_key

    def query(self, query: Query, **options: Any) -> Result:
        return self.log.query(narrowed(query, self.key, self.tenant), **options)

    def statistics(self, query: Query | None = None) -> list[dict]:
        return self.log.statistics(narrowed(query if query is not None else {}, self.key, self.tenant))

    def stamped(self, e: NewEvent) -> NewEvent:
        own = self.log.store.schema.id_key(e.type)
        if own == self.key:  # the event that founds the tenant carries it as its id
            if e.id != self.tenant:
                raise TenantMismatchError("the tenant's own event has another id")
            return e
        if e.scopes.get(self.key, self.tenant) != self.tenant or e.data.get(self.key, self.tenant) != self.tenant:
            raise TenantMismatchError("the event names another tenant")
        return replace(e, scopes=e.scopes | {self.key: self.tenant})

    def append(self, events: list[NewEvent]) -> Appended:
        return self.log.append([self.stamped(e) for e in events])

    def append_if(self, events: list[NewEvent], ctx: tuple[Query, int]) -> Appended:
        return self.log.append_if([self.stamped(e) for e in events], (narrowed(ctx[0], self.key, self.tenant), ctx[1]))

    def context(self, query: Query, fold: Any, initial: Any = None) -> Context:
        return self.log.context(narrowed(query, self.key, self.tenant), fold, initial)

    def command(self, command: Command) -> Outcome:
        decide = lambda s: d if not isinstance(d := command.decide(s), list) else [self.stamped(e) for e in d]
        query = narrowed(command.query, self.key, self.tenant) if command.query is not None else None
        return self.log.command(replace(command, query=query, decide=decide))

    def subscribe(self, name: str, query: Query, handler: Callable | None = None, **options: Any) -> Subscription:
        return self.log.subscribe(f"{self.tenant}/{name}", narrowed(query, self.key, self.tenant), handler, **options)

    def read(self, registry: Registry, query: Query | None = None, **options: Any) -> list[Recorded]:
        return self.log.read(registry, narrowed(query if query is not None else registry.filter(), self.key, self.tenant), **options)

    def on(self, query: Query, handler: Callable[[list[Recorded]], None]) -> Callable[[], None]:
        return self.log.on(narrowed(query, self.key, self.tenant), handler)

    def watch(self, query: Query, handler: Callable, on_error: Callable | None = None, **projection: Any) -> Callable[[], None]:
        return self.log.watch(narrowed(query, self.key, self.tenant), handler, on_error, **projection)

    def read_model(self, definition: ModelDefinition, start: str = "rebuild") -> LiveModel:
        return self.log.read_model(definition, self.tenant, start)

    def persisted_read_model(self, definition: ModelDefinition, writer: bool | str = True) -> LiveModel:
        return self.log.persisted_read_model(definition, self.tenant, writer)

    def as_of(self, sequence: int) -> PastView:
        return PastView(self, sequence)

    def invalidate(self, query: Query | None = None) -> None:
        self.log.invalidate(None if query is None else narrowed(query, self.key, self.tenant), self.tenant)

    def as_frame(self, spark: SparkSession) -> Log:
        return reads.tenant_view(self.log.as_frame(spark), self.tenant)


class PastView:
    """The log, or one tenant's part of it, as of a sequence: reads only. It keeps no states."""

    def __init__(self, log: EventLog | TenantView, until: int):
        if isinstance(until, bool) or not isinstance(until, int) or not 0 <= until <= SAFE:
            raise UsageError("as_of takes an integer from 0")
        self.log, self.until = log, until

    def _bounded(self, options: dict[str, Any]) -> dict[str, Any]:
        return options | {"until": min(self.until, options.get("until") if options.get("until") is not None else self.until)}

    def query(self, query: Query, **options: Any) -> Result:
        return self.log.query(query, **self._bounded(options))

    def read(self, registry: Registry, query: Query | None = None, **options: Any) -> list[Recorded]:
        return self.log.read(registry, query, **self._bounded(options))

    def context(self, query: Query, fold: Any, initial: Any = None) -> Context:
        """Folded page by page, from the beginning each time."""
        state, cursor, n = initial() if callable(initial) else initial, None, 0
        run = getattr(fold, "run", fold)
        while True:
            page = self.query(query, after=cursor, limit=5_000)
            state, n = run(page.events, state), n + len(page.events)
            if len(page.events) < 5_000:
                return Context(state, page.ctx, n, False)
            cursor = page.last_returned

    def as_of(self, sequence: int) -> PastView:
        return PastView(self.log, min(self.until, sequence))

    def for_tenant(self, tenant: str) -> PastView:
        if isinstance(self.log, TenantView):
            raise TenantMismatchError("this view is a tenant's already")
        return PastView(self.log.for_tenant(tenant), self.until)

    def as_frame(self, spark: SparkSession) -> Log:
        return reads.as_of(self.log.as_frame(spark), self.until)

    def _refuse(self, *_: Any, **__: Any) -> Any:
        raise PolicyViolationError("a view of the past only reads")

    append = append_if = command = subscribe = on = watch = statistics = read_model = persisted_read_model = invalidate = _refuse


_ambient: EventLog | None = None


def create_event_log(directory: str, registries: list[Registry] = (), scope_keys: list[str] = (), tenant_key: str | None = None, strict: bool = True, lock_salt: str | None = None) -> EventLog:
    return EventLog(FileStore(directory, build_schema(list(registries), scope_keys, tenant_key, lock_salt, strict)), list(registries))


def configure(directory: str, **options: Any) -> EventLog:
    global _ambient
    _ambient = create_event_log(directory, **options)
    return _ambient


def es() -> EventLog:
    if _ambient is None:
        raise NotConfiguredError("call configure first")
    return _ambient


def reset() -> None:
    global _ambient
    _ambient = None
