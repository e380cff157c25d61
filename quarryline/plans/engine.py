"""The engine: argument dictionaries become lazy DataFrames.

Order of a read: where (with the table's global filter), cursor, distinct, order, offset and limit; then projection,
and relations are attached to the page only. Relations are aggregated by key before they are joined, never after. Joins
deal rows out, so a page with relations is put in its order again after them.

A page that is cut is kept (:meth:`Engine.release` lets it go), for it is read as parents and for the keys of their
children. Every cut follows a total order: what was asked for, then the table's key, or all columns where there is none.
"""

from __future__ import annotations

import copy
import inspect
import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.catalog import Catalog, Relation, Table, star_schema
from quarryline.errors import UNSAFE, UNSET, ConnectionError_, DeadlockError, DepthError, NotFoundError, PipelineError, RelationError, SerializationError, TimeoutError_, ValidationError, is_unsafe
from quarryline.functions.predicate import COMPARE, distance, everything, field_condition, finite, given, json_path

DEPTH = 10
RETRYABLE = (ConnectionError_, DeadlockError, SerializationError, TimeoutError_)
TO_MANY = ("some", "every", "none")
TO_ONE = ("is", "isNot")


def ordered(column: Column, direction: str, nulls: str | None) -> Column:
    """Ascending puts nulls last and descending first, unless told otherwise."""
    down = direction.lower() == "desc"
    first = down if nulls is None else nulls.lower() == "first"
    return getattr(column, f"{'desc' if down else 'asc'}_nulls_{'first' if first else 'last'}")()


def direction_of(spec: object) -> tuple[str, str | None]:
    sort, nulls = (spec.get("sort"), spec.get("nulls")) if isinstance(spec, dict) else (spec, None)
    if not isinstance(sort, str) or sort.lower() not in ("asc", "desc") or (nulls is not None and str(nulls).lower() not in ("first", "last")):
        raise ValidationError("an order is asc or desc, with nulls first or last")
    return sort, nulls


def sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(sortable(f.dataType) for f in kind.fields)
    return sortable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def tie_break(meta: Table, df: DataFrame) -> list[Column]:
    """What makes any order of a table's rows total: its key, else all columns."""
    return [F.col(k).asc_nulls_last() for k in meta.key or [f.name for f in df.schema.fields if sortable(f.dataType)] if k in df.columns]


def natural(value: object, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValidationError(f"{name} must be a natural number")
    return value


class Engine:
    """Entry point: ``Engine(spark, folder).table("orders").find_many(where=…)``.

    ``filters`` maps a table to a where (or a function giving one, of nothing or of the session's context) that every read
    of it obeys, at any depth.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, catalog: Catalog | None = None, frames: dict[str, DataFrame] | None = None, filters: dict | None = None, default_limit: int | None = None, scoped_connect: bool = False) -> None:
        self.spark, self.folder = spark, folder
        self.catalog = catalog or star_schema()
        self.frames = dict(frames or {})
        self.filters = filters or {}
        self.default_limit = default_limit
        self.scoped_connect = scoped_connect
        self.middleware: list[Callable] = []
        self.listeners: list[Callable] = []
        self.pages: list[DataFrame] = []
        self.context: dict[str, object] = {}

    def with_session(self, **context: object) -> Engine:
        """The same tables, seen under a context that filters are told of, such as a tenant."""
        for name in context:
            if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
                raise ValidationError("a context has plain names")
        out = copy.copy(self)
        out.context = self.context | context
        return out

    def filter_of(self, name: str) -> dict | None:
        """A table's global filter in this session."""
        spec = self.filters.get(name)
        if not callable(spec):
            return spec
        return spec(self.context) if inspect.signature(spec).parameters else spec()

    @staticmethod
    def retry(run: Callable[[], object], tries: int = 3, wait: float = 0.05) -> object:
        """What ``run`` gives; errors that may pass (a lost connection, a timeout, a changed table) are tried again, ever later."""
        for attempt in range(tries):
            try:
                return run()
            except RETRYABLE:
                if attempt == tries - 1:
                    raise
                time.sleep(min(5.0, wait * 2**attempt * (1 + random.random())))
        raise ValidationError("a retry takes one try or more")

    def held(self, df: DataFrame) -> DataFrame:
        """The rows of a page, kept once read."""
        self.pages.append(df.persist())
        return self.pages[-1]

    def release(self) -> None:
        """Lets the kept pages go."""
        while self.pages:
            self.pages.pop().unpersist()

    def table(self, name: str) -> TableQuery:
        return TableQuery(self, self.catalog[name])

    def base(self, name: str) -> DataFrame:
        if name not in self.frames:
            if self.folder is None:
                raise ValidationError(f"no rows are known for table {name}")
            self.frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.frames[name]

    def rows(self, name: str, skip: object = None) -> DataFrame:
        """The one place where a table's global filter is applied."""
        df = self.base(name)
        spec = self.filter_of(name)
        if not spec or self._skipped(name, skip):
            return df
        return Compiler(self, self.catalog[name], skip).filtered(df, spec)

    @staticmethod
    def _skipped(name: str, skip: object) -> bool:
        if isinstance(skip, list | tuple):
            if not skip or skip[0] is not UNSAFE:
                raise ValidationError("skipping global filters takes the UNSAFE marker")
            return name in skip[1:]
        return is_unsafe(skip)

    def raw(self, query: str, args: dict | list | None = None) -> DataFrame:
        """SQL with bound parameters over the catalog's tables (as views)."""
        for name in self.catalog.tables:
            if name in query and (name in self.frames or self.folder):
                self.base(name).createOrReplaceTempView(name)
        return self.spark.sql(query, args=args)

    def sql(self, query: str, args: dict | list | None = None) -> RawQuery:
        """As :meth:`raw`, to be read as rows, one row or one value."""
        return RawQuery(self.raw(query, args))

    def view(self, name: str, query: str, key: tuple[str, ...] = ()) -> TableQuery:
        """Registers SQL over the tables as a view: it is read like a table and cannot be written."""
        self.frames[name] = self.raw(query)
        self.catalog.tables[name] = Table(name, tuple(key), view=True)
        return self.table(name)

    def use(self, step: Callable) -> None:
        """Adds middleware: step(call, next) with call = (table, method, args)."""
        self.middleware.append(step)

    def on_query(self, listener: Callable) -> None:
        self.listeners.append(listener)

    def pipeline(self, *reads: Callable[[], object], transactional: bool = True, threads: int = 4) -> list:
        """The results of several reads, in order; they run side by side. Unless ``transactional`` is False one failure fails all,
        else each failed read gives its error, in a PipelineError with ``results`` where nothing else was asked for."""
        with ThreadPoolExecutor(max(1, min(threads, len(reads) or 1))) as pool:
            running = [pool.submit(read) for read in reads]
        errors = [r.exception() for r in running]
        results = [e if e is not None else r.result() for r, e in zip(running, errors, strict=True)]
        if transactional and any(errors):
            failed = PipelineError(f"{sum(e is not None for e in errors)} of {len(reads)} reads failed")
            failed.results = results
            raise failed from next(e for e in errors if e is not None)
        return results


class RawQuery:
    """The result of SQL: ``rows``, ``one`` (a row, or None) and ``scalar`` (its first value, or None)."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def rows(self) -> DataFrame:
        return self.df

    def one(self) -> Row | None:
        return self.df.first()

    def scalar(self) -> object:
        row = self.one()
        return None if row is None else row[0]


class Compiler:
    """Conditions of one table; relation conditions become semi and anti joins, or flag columns under OR and NOT."""

    def __init__(self, engine: Engine, table: Table, skip: object = None, depth: int = 0) -> None:
        if depth > DEPTH:
            raise DepthError("relations are nested too deeply")
        self.engine, self.table, self.skip, self.depth = engine, table, skip, depth
        self.flags: list[str] = []

    def filtered(self, df: DataFrame, where: dict | None) -> DataFrame:
        columns = df.columns
        for key, value in self._spread(where or {}):
            relation = self.table.relations.get(key)
            if relation is not None:
                for op, sub in self._operations(relation, key, value):
                    df = self._joined(df, relation, op, sub)
            else:
                df, condition = self.condition(df, {key: value})
                if condition is not None:
                    df = df.where(condition)
        return df.select(*[df[c] for c in columns]) if self.flags else df

    def _spread(self, where: dict) -> Iterator[tuple[str, object]]:
        for key, value in given(where).items():
            if key == "AND":
                for member in value if isinstance(value, list) else []:
                    yield from self._spread(member)
            else:
                yield key, value

    def condition(self, df: DataFrame, where: dict) -> tuple[DataFrame, Column | None]:
        out: list[Column] = []
        for key, value in given(where).items():
            if key in ("AND", "OR"):
                members = []
                for member in value if isinstance(value, list) else []:
                    df, found = self.condition(df, member)
                    if found is not None:
                        members.append(found)
                if members:
                    out.append(reduce((lambda a, b: a & b) if key == "AND" else (lambda a, b: a | b), members))
            elif key == "NOT":
                df, found = self.condition(df, value)
                if found is not None:
                    out.append(~found)
            elif key in self.table.relations:
                for op, sub in self._operations(self.table.relations[key], key, value):
                    df, flag = self._flag(df, self.table.relations[key], op, sub)
                    if flag is not None:
                        out.append(flag)
            elif key in df.columns:
                kind = df.schema[key].dataType
                out.append(field_condition(df[key], kind, key in self.table.json, value, lambda c, df=df: self._ref(df, c)))
            elif (compound := self._compound(key, value, df)) is not None:
                out.append(compound)
            else:
                raise ValidationError(f"unknown field {key} of {self.table.name}; known: {', '.join(df.columns)}")
        return df, everything(out)

    def _ref(self, df: DataFrame, column: str) -> Column:
        if column not in df.columns:
            raise ValidationError(f"unknown field {column} of {self.table.name}")
        return df[column]

    def _compound(self, key: str, value: object, df: DataFrame) -> Column | None:
        """A unique key of several columns, named by them joined with underscores."""
        for columns in (self.table.key, *self.table.unique):
            if len(columns) > 1 and key == "_".join(columns) and isinstance(value, dict):
                if set(value) != set(columns):
                    raise ValidationError(f"{key} takes exactly {', '.join(columns)}")
                return everything([df[c] == F.lit(value[c]) for c in columns])
        return None

    @staticmethod
    def _operations(relation: Relation, key: str, value: object) -> list[tuple[str, object]]:
        if relation.single:
            if value is None:
                return [("isNot", {})]
            if not isinstance(value, dict) or not set(value) & set(TO_ONE):
                return [("is", value)]
        allowed = TO_ONE if relation.single else TO_MANY
        if not isinstance(value, dict) or set(value) - set(allowed):
            raise ValidationError(f"relation {key} takes {', '.join(allowed)}")
        return [(op, sub) for op, sub in value.items() if sub is not UNSET]

    def _keys(self, relation: Relation, op: str, sub: object) -> tuple[DataFrame | None, bool]:
        """Keys of this table's rows for which the match exists (some of them more than once), and whether it must."""
        positive = op in ("some", "is")
        if sub is None:  # is null: no target; isNot null: some target
            positive, sub = not positive, {}
        target = self.engine.rows(relation.target, self.skip)
        inner = Compiler(self.engine, self.engine.catalog[relation.target], self.skip, self.depth + 1)
        if op == "every":
            columns = target.columns
            target, condition = inner.condition(target, sub)
            if condition is None:
                return None, True
            target = target.where(~condition).select(*columns)
        else:
            target = inner.filtered(target, sub)
        names = [f"_k{n}" for n in range(len(relation.here))]
        if relation.kind == "through":
            link = self.engine.rows(relation.junction, self.skip).select(*[F.col(c).alias(n) for c, n in zip(relation.junction_here, names, strict=True)], *[F.col(c).alias(f"_j{k}") for k, c in enumerate(relation.junction_there)])
            keys = target.select(*[F.col(c).alias(f"_j{k}") for k, c in enumerate(relation.there)])
            found = link.join(keys, [f"_j{k}" for k in range(len(relation.there))], "left_semi").select(*names)
        else:
            found = target.select(*[F.col(c).alias(n) for c, n in zip(relation.there, names, strict=True)])
        return found, positive

    def _on(self, df: DataFrame, keys: DataFrame, relation: Relation) -> Column:
        return everything([df[c] == keys[f"_k{n}"] for n, c in enumerate(relation.here)])

    def _joined(self, df: DataFrame, relation: Relation, op: str, sub: object) -> DataFrame:
        keys, positive = self._keys(relation, op, sub)
        if keys is None:
            return df
        return df.join(keys, self._on(df, keys, relation), "left_semi" if positive else "left_anti")

    def _flag(self, df: DataFrame, relation: Relation, op: str, sub: object) -> tuple[DataFrame, Column | None]:
        keys, positive = self._keys(relation, op, sub)
        if keys is None:
            return df, None
        name = f"_f{self.depth}_{len(self.flags)}"
        self.flags.append(name)
        keys = keys.distinct().withColumn(name, F.lit(True))
        own = df.columns
        df = df.join(keys, self._on(df, keys, relation), "left").select(*[df[c] for c in own], keys[name])
        flag = F.coalesce(df[name], F.lit(False))
        return df, flag if positive else ~flag


class TableQuery:
    """Reads of one table. Every method returns a DataFrame, but for those named as giving rows."""

    def __init__(self, engine: Engine, table: Table) -> None:
        self.engine, self.meta = engine, table

    # reads

    def find_many(self, **args) -> DataFrame:
        return self._call("find_many", args, self._find_many)

    def find_first(self, **args) -> DataFrame:
        return self._call("find_first", args, lambda a: self._find_many(a | {"limit": 1, "take": UNSET}))

    def find_unique(self, **args) -> DataFrame:
        """At most one row; the where needs some effective condition."""
        if not effective(args.get("where")):
            raise ValidationError("find_unique needs a where")
        return self._call("find_unique", args, lambda a: self._find_many(a | {"limit": 1}))

    def find_first_or_throw(self, **args) -> Row:
        return self._one(self.find_first(**args), args)

    def find_unique_or_throw(self, **args) -> Row:
        return self._one(self.find_unique(**args), args)

    def stream(self, batch: int = 1000, **args) -> Iterator[list[Row]]:
        """Rows in batches, a partition at a time on the driver."""
        held: list[Row] = []
        for row in self.find_many(**args).toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) >= batch:
                yield held
                held = []
        if held:
            yield held

    def explain(self, **args) -> list[str]:
        return self.find_many(**args)._jdf.queryExecution().toString().splitlines()

    def search(self, text: str = "", columns: list[str] | None = None, limit: int = 50, offset: int = 0, filters: list[dict] | None = None, orderBy: str | None = None, dir: str = "asc", **args) -> DataFrame:
        """A page (1 to 500 rows) of the rows with the text, in any case, in one of the columns (all text columns but personal ones), and all filters."""
        if not 1 <= limit <= 500:
            raise ValidationError("a page has 1 to 500 rows")
        order = {"orderBy": {orderBy: dir}} if orderBy and orderBy not in self.meta.pii else {}
        return self.find_many(**(order | args | {"where": self._searched(text, columns, filters, args.get("where")), "limit": limit, "offset": offset}))

    def search_total(self, text: str = "", columns: list[str] | None = None, filters: list[dict] | None = None, where: dict | None = None) -> DataFrame:
        """How many rows :meth:`search` has on all pages."""
        return self.count(self._searched(text, columns, filters, where))

    def _searched(self, text: str, columns: list[str] | None, filters: list[dict] | None, where: dict | None) -> dict:
        schema = self.engine.base(self.meta.name).schema
        words = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType) and f.name not in self.meta.pii and f.name not in self.meta.json]
        parts = [where or {}]
        if text.strip():
            parts.append({"OR": [{c: {"contains": text.strip(), "mode": "insensitive"}} for c in (words if columns is None else columns)]})
        if len(filters or []) > 10:
            raise ValidationError("a page takes up to ten filters")
        for one in filters or []:
            column, op, value = one.get("column"), one.get("op"), one.get("value")
            if column not in schema.names or column in self.meta.pii:
                raise ValidationError(f"no filter on column {column}")
            if op in ("isNull", "notNull"):
                parts.append({column: None if op == "isNull" else {"not": None}})
            elif op not in ("equals", "not", "gt", "gte", "lt", "lte", "contains") or not isinstance(value, str | int | float):
                raise ValidationError(f"a filter takes an operator and one value, {column} has not")
            elif op == "contains":
                if column not in words:
                    raise ValidationError(f"contains is for text columns, {column} is none")
                parts.append({column: {"contains": value, "mode": "insensitive"}})
            else:
                parts.append({column: {op: value}})
        return {"AND": parts}

    def sample(self, n: int = 50) -> DataFrame:
        return self.find_many(limit=min(n, 50))

    def _one(self, df: DataFrame, args: dict) -> Row:
        row = df.first()
        if row is None:
            raise NotFoundError(f"no {self.meta.name} for {', '.join(sorted(args.get('where') or {}))}")
        return row

    def _call(self, method: str, args: dict, run: Callable[[dict], DataFrame]) -> DataFrame:
        def inner(at: int, args: dict) -> DataFrame:
            if at < len(self.engine.middleware):
                return self.engine.middleware[at]((self.meta.name, method, args), lambda a=args: inner(at + 1, a))
            return run(args)

        out = inner(0, args)
        for listener in self.engine.listeners:
            listener({"table": self.meta.name, "method": method, "keys": sorted(args)})
        return out

    def page(self, args: dict) -> tuple[DataFrame, list[str], list[Column]]:
        """The filtered, cut and ordered rows, with all columns and what they are ordered by; the table's own columns; the order, if any."""
        args = given(args)
        known = {"where", "select", "omit", "orderBy", "limit", "take", "offset", "cursor", "distinct", "with", "with_", "includePii", "skipGlobalFilters", "relationLoadStrategy", "stableRelationOrder", "timeout", "forceCustomPlan"}
        if set(args) - known:
            raise ValidationError(f"unknown option {sorted(set(args) - known)[0]}")
        skip = args.get("skipGlobalFilters")
        df = Compiler(self.engine, self.meta, skip).filtered(self.engine.rows(self.meta.name, skip), args.get("where"))
        columns = df.columns
        order = args.get("orderBy") or []
        order = [o for o in (order if isinstance(order, list) else [order]) if o]
        df = self._cursor(df, args.get("cursor"), order)
        limit = args.get("take", args.get("limit", self.engine.default_limit))
        paged = limit is not None or args.get("offset")
        if paged and not order and not args.get("distinct") and args.get("cursor") and len(args["cursor"]) == 1:
            order = [{k: "asc"} for k in args["cursor"]]
        if args.get("distinct"):
            df, keys = self._distinct(df, args["distinct"], order, skip)
        else:
            df, keys = self._order(df, order, skip)
        total = [*keys, *tie_break(self.meta, df.select(*columns))] if keys or paged else []
        if total:
            df = df.orderBy(*total)
        if args.get("offset"):
            df = df.offset(natural(args["offset"], "offset"))
        if limit is not None:
            df = df.limit(natural(limit, "limit"))
        return df, columns, total

    def _find_many(self, args: dict) -> DataFrame:
        args = given(args)
        with_ = args.get("with", args.get("with_"))
        df, columns, order = self.page(args)
        shown = self.shown(columns, args.get("select"), args.get("omit"), args.get("includePii"))
        if not with_:
            return df.select(*shown)
        cut = args.get("take", args.get("limit", self.engine.default_limit)) is not None
        return attach(self.engine, self.meta, self.engine.held(df) if cut else df, with_, shown, args.get("skipGlobalFilters"), cut, order=order)

    def shown(self, columns: list[str], select: dict | None, omit: dict | None, pii: object = None) -> list[str]:
        return projection(self.meta, columns, select, omit, pii)

    def _cursor(self, df: DataFrame, cursor: dict | None, order: list[dict]) -> DataFrame:
        """Rows after the cursor: greater than it, or smaller where its field is ordered descending."""
        directions = {k: direction_of(v)[0].lower() for o in order for k, v in o.items() if not isinstance(v, dict) or "sort" in v}
        for key, value in given(cursor or {}).items():
            if key not in df.columns:
                raise ValidationError(f"unknown cursor field {key}")
            df = df.where(df[key] < F.lit(value) if directions.get(key) == "desc" else df[key] > F.lit(value))
        return df

    def _distinct(self, df: DataFrame, fields: list[str], order: list[dict], skip: object) -> tuple[DataFrame, list[Column]]:
        """One row for each combination: the first in order, else the one with the smallest key."""
        for o in order:
            if any(k not in df.columns for k in o):
                raise ValidationError("distinct takes column orders only")
        df, keys = self._order(df, order, skip)
        at = Window.partitionBy(*fields).orderBy(*keys, *tie_break(self.meta, self.engine.base(self.meta.name)))
        return df.withColumn("_rn", F.row_number().over(at)).where("_rn = 1"), keys

    def _order(self, df: DataFrame, order: list[dict], skip: object) -> tuple[DataFrame, list[Column]]:
        keys: list[Column] = []
        for number, item in enumerate(o for spec in order for o in ({k: v} for k, v in spec.items())):
            (name, spec), extra = next(iter(item.items())), f"_o{number}"
            if name in self.meta.relations:
                df, column = self._relation_order(df, self.meta.relations[name], name, spec, extra, skip)
                keys.append(column)
            elif name not in df.columns:
                raise ValidationError(f"unknown order field {name}")
            elif isinstance(spec, dict) and "path" in spec:
                text = F.get_json_object(F.col(name), json_path(spec["path"]))
                text = text.cast("decimal(38,10)") if spec.get("type") == "numeric" else text
                sort, nulls = direction_of({"sort": spec.get("sort", "asc"), "nulls": spec.get("nulls", "last")})
                keys.append(ordered(text, sort, nulls))
            elif isinstance(spec, dict) and "distance" in spec:
                d = spec["distance"]
                keys.append(ordered(distance(F.col(name), d["to"], d.get("metric", "l2")), d.get("sort", "asc"), None))
            else:
                keys.append(ordered(F.col(name), *direction_of(spec)))
        return df, keys

    def _relation_order(self, df: DataFrame, relation: Relation, name: str, spec: dict, extra: str, skip: object) -> tuple[DataFrame, Column]:
        if not isinstance(spec, dict) or len(spec) == 0:
            raise ValidationError(f"order by {name} takes a field, _count or pick")
        if "_count" in spec:
            counts = counted(self.engine, relation, None, skip).withColumnRenamed("_n", extra)
            df = df.join(counts, everything([df[c] == counts[f"_k{n}"] for n, c in enumerate(relation.here)]), "left").select(*[df[c] for c in df.columns], F.coalesce(counts[extra], F.lit(0)).alias(extra))
            return df, ordered(F.col(extra), *direction_of(spec["_count"]))
        if "pick" in spec:
            pick = spec["pick"]
            if relation.kind != "many" or not pick.get("orderBy"):
                raise ValidationError("pick takes a to-many relation and an orderBy")
            query = TableQuery(self.engine, self.engine.catalog[relation.target])
            child = Compiler(self.engine, query.meta, skip).filtered(self.engine.rows(relation.target, skip), pick.get("where"))
            child, keys = query._order(child, pick["orderBy"] if isinstance(pick["orderBy"], list) else [pick["orderBy"]], skip)
            at = Window.partitionBy(*relation.there).orderBy(*keys, *tie_break(query.meta, self.engine.base(relation.target)))
            by = spec["by"]
            value = F.get_json_object(F.col(by["field"]), json_path(by["path"])) if isinstance(by, dict) else F.col(by)
            child = child.withColumn("_rn", F.row_number().over(at)).where("_rn = 1").select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(relation.there)], value.alias(extra))
            sort, nulls = direction_of({"sort": spec.get("sort", "asc"), "nulls": spec.get("nulls", "last")})
            df = df.join(child, everything([df[c] == child[f"_k{n}"] for n, c in enumerate(relation.here)]), "left").select(*[df[c] for c in df.columns], child[extra])
            return df, ordered(F.col(extra), sort, nulls)
        if not relation.single:
            raise ValidationError(f"order by {name} takes _count or pick")
        # a chain of to-one steps, each a left join on a unique key
        hops, path, last = [relation], spec, name
        while True:
            (field, inner), table = next(iter(path.items())), self.engine.catalog[hops[-1].target]
            if field in table.relations:
                hops.append(table.relations[field])
                path = inner
                if len(hops) > DEPTH:
                    raise DepthError("an order chain is too long")
                if not hops[-1].single:
                    raise ValidationError("an order chain takes to-one relations")
            else:
                last = field
                break
        value = None
        for hop in reversed(hops):
            target = one_each(self.engine.rows(hop.target, skip), hop, self.engine.catalog[hop.target])
            if value is None:
                if last not in target.columns:
                    raise ValidationError(f"unknown order field {last}")
                value = target.withColumn(extra, F.col(last))
            else:
                value = target.join(value, everything([target[c] == value[f"_k{n}"] for n, c in enumerate(nxt.here)]), "left").select(*[target[c] for c in target.columns], value[extra])  # noqa: F821
            value = value.select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(hop.there)], extra)
            nxt = hop  # noqa: F841
        df = df.join(value, everything([df[c] == value[f"_k{n}"] for n, c in enumerate(relation.here)]), "left").select(*[df[c] for c in df.columns], value[extra])
        return df, ordered(F.col(extra), *direction_of(path[last]))

    # aggregates

    def count(self, where: dict | None = None, skipGlobalFilters: object = None) -> DataFrame:
        return self.filtered(where, skipGlobalFilters).agg(F.count("*").alias("count"))

    def filtered(self, where: dict | None, skip: object = None) -> DataFrame:
        return Compiler(self.engine, self.meta, skip).filtered(self.engine.rows(self.meta.name, skip), where)

    def aggregate(self, **args) -> DataFrame:
        from quarryline.operators.aggregate import aggregate

        return self._call("aggregate", args, lambda a: aggregate(self, **a))

    def group_by(self, **args) -> DataFrame:
        from quarryline.operators.aggregate import group_by

        return self._call("group_by", args, lambda a: group_by(self, **a))


def effective(where: dict | None) -> bool:
    """Whether a where says anything."""
    for key, value in given(where or {}).items():
        if key in ("AND", "OR"):
            if any(effective(m) for m in (value if isinstance(value, list) else [])):
                return True
        elif key == "NOT":
            if effective(value):
                return True
        else:
            return True
    return False


def projection(meta: Table, columns: list[str], select: dict | None, omit: dict | None, pii: object = None) -> list[str]:
    """Selected columns, all but the omitted, or all; personal ones only when selected by name or UNSAFE is given."""
    open_ = is_unsafe(pii)
    if select is not None and omit is not None:
        raise ValidationError("select and omit exclude each other")
    chosen = select if select is not None else omit
    if chosen is not None:
        if not isinstance(chosen, dict) or (select is not None and not any(v is True for v in select.values())):
            raise ValidationError("select and omit take field names with True")
        for name in chosen:
            if name in meta.relations or name not in columns:
                raise ValidationError(f"unknown field {name} of {meta.name}")
    if select is not None:
        return [c for c in columns if select.get(c) is True]
    hidden = set() if open_ else set(meta.pii) - set(meta.key)
    return [c for c in columns if c not in hidden and not (omit or {}).get(c) is True]


def one_each(df: DataFrame, relation: Relation, target: Table) -> DataFrame:
    """One row a key: as it is where the key is unique, else the row with the smallest primary key."""
    if target.is_unique(relation.there):
        return df
    at = Window.partitionBy(*relation.there).orderBy(*([F.col(k).asc_nulls_last() for k in target.key] or [F.col(c).asc_nulls_last() for c in df.columns]))
    return df.withColumn("_rn", F.row_number().over(at)).where("_rn = 1").drop("_rn")


def counted(engine: Engine, relation: Relation, where: dict | None, skip: object) -> DataFrame:
    """_k…, _n: children of each key; for a junction its rows."""
    names = [f"_k{n}" for n in range(len(relation.here))]
    target = Compiler(engine, engine.catalog[relation.target], skip).filtered(engine.rows(relation.target, skip), where)
    if relation.kind == "through":
        link = engine.rows(relation.junction, skip)
        target = target.select(*[F.col(c).alias(f"_t{k}") for k, c in enumerate(relation.there)])
        link = link.join(target, everything([link[c] == target[f"_t{k}"] for k, c in enumerate(relation.junction_there)]), "left_semi")
        return link.groupBy(*[F.col(c).alias(n) for c, n in zip(relation.junction_here, names, strict=True)]).agg(F.count("*").alias("_n"))
    return target.groupBy(*[F.col(c).alias(n) for c, n in zip(relation.there, names, strict=True)]).agg(F.count("*").alias("_n"))


def attach(engine: Engine, meta: Table, page: DataFrame, with_: dict, shown: list[str], skip: object, cut: bool, depth: int = 0, order: list[Column] | None = None) -> DataFrame:
    """The page with a column a relation: an array of structs, or a struct (null where there is no match).

    Children are looked up by the page's keys only where the page is cut, so few; else all are gathered and joined.
    The page's order, if it has one, holds for what comes out, however the joins were made.
    """
    if depth >= DEPTH:
        raise DepthError("relations are nested too deeply")
    out, extra = page, []
    for name, spec in given(with_).items():
        if name == "_count":
            if depth:
                raise RelationError("_count is for the outermost read only")
            out, column = _counts(engine, meta, out, spec, skip)
            extra.append(column)
            continue
        relation = meta.relations.get(name)
        if relation is None:
            raise ValidationError(f"unknown relation {name} of {meta.name}; known: {', '.join(sorted(meta.relations))}")
        if spec is False or spec is None:
            continue
        child = related(engine, relation, page if cut else None, {} if spec is True else given(spec), skip, depth, f"_r_{name}")
        own = [f"_c{depth}_{n}" for n in range(len(relation.here))]  # the page may have keys of its own
        child = child.withColumnsRenamed({f"_k{n}": c for n, c in enumerate(own)})
        on = everything([out[c] == child[n] for n, c in zip(own, relation.here, strict=True)])
        out = out.join(child, on, "left").drop(*own)
        made = F.col(f"_r_{name}")
        extra.append((made if relation.single else F.coalesce(made, F.array().cast(child.schema[f"_r_{name}"].dataType))).alias(name))
    if order:  # a page that is cut went through one partition when it was
        out = out.repartition(1).sortWithinPartitions(*order) if cut else out.orderBy(*order)
    return out.select(*[F.col(c) for c in shown], *extra)


def related(engine: Engine, relation: Relation, page: DataFrame | None, spec: dict, skip: object, depth: int, out: str) -> DataFrame:
    """_k…, and the children (of the page's keys, if a page is given), gathered into ``out``."""
    target = engine.catalog[relation.target]
    query = TableQuery(engine, target)
    names = [f"_k{n}" for n in range(len(relation.here))]
    keys = None if page is None else page.select(*[F.col(c).alias(n) for c, n in zip(relation.here, names, strict=True)]).distinct()
    child = Compiler(engine, target, skip, depth).filtered(engine.rows(relation.target, skip), spec.get("where"))
    fields = child.columns
    if relation.kind == "through":
        link = engine.rows(relation.junction, skip).select(*[F.col(c).alias(n) for c, n in zip(relation.junction_here, names, strict=True)], *[F.col(c).alias(f"_j{k}") for k, c in enumerate(relation.junction_there)])
        link = link if keys is None else link.join(keys, names, "left_semi")
        link = link.distinct()  # a pair that the junction repeats is one link
        child = link.join(child, everything([link[f"_j{k}"] == child[c] for k, c in enumerate(relation.there)])).drop(*[f"_j{k}" for k in range(len(relation.there))])
    else:
        child = child.withColumns({n: F.col(c) for c, n in zip(relation.there, names, strict=True)})
        child = child.where(everything([F.col(n).isNotNull() for n in names])) if keys is None else child.join(keys, names, "left_semi")
    shown = projection(target, fields, spec.get("select"), spec.get("omit"))
    nested = {k: v for k, v in given(spec.get("with") or {}).items() if v is not False and v is not None}

    def nest(rows: DataFrame) -> DataFrame:
        if not nested:
            return rows
        return attach(engine, target, rows if page is None else engine.held(rows), nested, [*rows.columns], skip, page is not None, depth + 1)

    if relation.single:
        child = one_each(child, Relation(relation.kind, relation.target, relation.here, tuple(names)), target) if not target.is_unique(relation.there) else child
        return nest(child).select(*names, F.struct(*shown, *nested).alias(out))
    order, limit = spec.get("orderBy") or [], spec.get("limit")
    order = [o for o in (order if isinstance(order, list) else [order]) if o]
    child, sort = query._order(child, order, skip)
    tie = tie_break(target, child.select(*fields))
    if order or limit is not None:
        child = child.withColumn("_rn", F.row_number().over(Window.partitionBy(*names).orderBy(*sort, *tie)))
        if limit is not None:
            child = child.where(F.col("_rn") <= natural(limit, "limit"))
        place = [F.col("_rn")]
    else:  # by the key, or all columns: sorting each array is enough
        place = [F.struct(F.col(c).isNull(), F.col(c)).alias(f"_p{k}") for k, c in enumerate(target.key or [f.name for f in child.select(*fields).schema.fields if sortable(f.dataType)])]
    child = nest(child)
    one = F.struct(F.struct(*place).alias("place"), F.struct(*shown, *nested).alias("row"))
    gathered = child.groupBy(*names).agg(F.collect_list(one).alias("_rows"))
    by_place = F.array_sort("_rows")  # places differ, so rows are never compared
    if not sortable(gathered.schema["_rows"].dataType):
        by_place = F.array_sort("_rows", lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0))
    return gathered.select(*names, F.transform(by_place, lambda x: x["row"]).alias(out))


def _counts(engine: Engine, meta: Table, df: DataFrame, spec: object, skip: object) -> tuple[DataFrame, Column]:
    many = {n: r for n, r in meta.relations.items() if not r.single}
    wanted = {n: {} for n in many} if spec is True else {n: (s if isinstance(s, dict) else {}) for n, s in spec.items() if s}
    parts = []
    for name, options in wanted.items():
        if name not in many:
            raise ValidationError(f"_count knows no to-many relation {name}")
        counts = counted(engine, many[name], options.get("where"), skip).withColumnRenamed("_n", f"_n_{name}")
        on = everything([df[c] == counts[f"_k{n}"] for n, c in enumerate(many[name].here)])
        df = df.join(counts, on, "left").drop(*[f"_k{n}" for n in range(len(many[name].here))])
        parts.append(F.coalesce(F.col(f"_n_{name}"), F.lit(0)).alias(name))
    return df, F.struct(*parts).alias("_count")


__all__ = ["COMPARE", "Engine", "TableQuery", "finite"]
