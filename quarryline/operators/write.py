"""Data changes as pure functions: a table's rows in, its new rows (and what was touched) out.

Parquet has no row-level changes, so a change is a new version of the table. ``Staged`` keeps versions of several
tables and swaps them in on success. One writer at a time.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.errors import UNSAFE, UNSET, NotFoundError, OptimisticLockError, ReadOnlyError, TimeoutError_, ValidationError, is_unsafe
from quarryline.functions.predicate import everything, finite, given
from quarryline.plans.engine import Compiler, Engine, TableQuery, effective, projection, sortable

MATH = ("set", "increment", "decrement", "multiply", "divide")


def writable(query: TableQuery, fields=()) -> None:
    """Refuses views, and fields that are not there or are generated."""
    if query.meta.view:
        raise ReadOnlyError(f"{query.meta.name} is a view")
    columns = query.engine.base(query.meta.name).columns
    for name in fields:
        if name not in columns or name in query.meta.generated:
            raise ValidationError(f"field {name} cannot be written")


def guarded(query: TableQuery, where: dict | None, all_rows: object) -> None:
    writable(query)
    if not effective(where) and not is_unsafe(all_rows):
        raise ValidationError("a change of all rows needs UNSAFE")


def shown(query: TableQuery, row: dict, pii: object = None) -> dict:
    """A written row as it is given back: without personal fields, unless UNSAFE asks for them."""
    return {c: row[c] for c in projection(query.meta, list(row), None, None, pii)}


def computed(query: TableQuery, df: DataFrame) -> DataFrame:
    """Rows with their stored generated fields computed anew."""
    made = {c: F.expr(e).cast(df.schema[c].dataType) for c, e in query.meta.formulas.items() if c in df.columns}
    return df.withColumns(made) if made else df


def changed(column: Column, kind: T.DataType, spec: object) -> Column:
    """The new value of a field: a value, or one of set, increment, decrement, multiply, divide."""
    if not isinstance(spec, dict):
        return F.lit(spec).cast(kind)
    if len(spec) != 1 or next(iter(spec)) not in MATH:
        raise ValidationError(f"an update takes one of {', '.join(MATH)}")
    op, value = next(iter(spec.items()))
    if op == "set":
        return F.lit(value).cast(kind)
    if not finite(value):
        raise ValidationError(f"{op} takes a finite number")
    by = F.lit(value)
    if op == "divide" and isinstance(kind, T.IntegralType):
        return F.call_function("div", column, by).cast(kind)
    return {"increment": column + by, "decrement": column - by, "multiply": column * by, "divide": column / by}[op].cast(kind)


def _flagged(query: TableQuery, where: dict | None, skip: object = None) -> tuple[DataFrame, Column]:
    df = query.engine.base(query.meta.name)
    spec = query.engine.filter_of(query.meta.name)
    if query.engine._skipped(query.meta.name, skip):
        spec = None
    df, condition = Compiler(query.engine, query.meta, skip).condition(df, {"AND": [where or {}, spec or {}]})
    return df, F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(True)


def update_many(query: TableQuery, where: dict | None, data: dict, allowFullTableScan: object = None, optimisticLock: dict | None = None, skipGlobalFilters: object = None) -> tuple[DataFrame, DataFrame]:
    """New rows of the table, and the updated ones."""
    guarded(query, where, allowFullTableScan)
    base = query.engine.base(query.meta.name)
    data = given(data)
    writable(query, data)
    if optimisticLock:
        where = {"AND": [where, {optimisticLock["field"]: optimisticLock["expected"]}]}
        data[optimisticLock["field"]] = {"increment": 1}
    if query.meta.updated_at and query.meta.updated_at not in data and data:
        data[query.meta.updated_at] = UNSET
    df, hit = _flagged(query, where, skipGlobalFilters)
    made = {n: F.current_timestamp().cast(base.schema[n].dataType) if v is UNSET else changed(F.col(n), base.schema[n].dataType, v) for n, v in data.items()}
    new = [F.when(hit, made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in base.columns]
    return computed(query, df.select(*new)), computed(query, df.where(hit).select(*new))


def update(query: TableQuery, where: dict, data: dict, includePii: object = None, **options) -> tuple[DataFrame, dict]:
    """New rows of the table, and the first of the updated ones, by key. Data that say nothing change nothing."""
    rows, touched = update_many(query, where, data, **options)
    first = touched.orderBy(*query.meta.key).first() if query.meta.key else touched.first()
    if first is None:
        raise OptimisticLockError(query.meta.name) if options.get("optimisticLock") else NotFoundError(query.meta.name)
    return rows, shown(query, first.asDict(), includePii)


_update = update


def delete_many(query: TableQuery, where: dict | None, allowFullTableScan: object = None, skipGlobalFilters: object = None) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and the deleted ones."""
    guarded(query, where, allowFullTableScan)
    columns = query.engine.base(query.meta.name).columns
    df, hit = _flagged(query, where, skipGlobalFilters)
    return df.where(~hit).select(*columns), df.where(hit).select(*columns)


def delete(query: TableQuery, where: dict, includePii: object = None, **options) -> tuple[DataFrame, dict]:
    """Rows that stay, and the first of the deleted ones, by key."""
    rows, gone = delete_many(query, where, **options)
    first = gone.orderBy(*query.meta.key).first() if query.meta.key else gone.first()
    if first is None:
        raise NotFoundError(query.meta.name)
    return rows, shown(query, first.asDict(), includePii)


def first_of_each(new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in ``order``; keys with a null are all different."""
    at = Window.partitionBy(*key).orderBy(*order)
    some_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    return new.withColumn("_place", F.row_number().over(at)).where((F.col("_place") == 1) | some_null).drop("_place")


def create_many(query: TableQuery, data: list[dict] | DataFrame, skipDuplicates: bool = False) -> tuple[DataFrame, DataFrame]:
    """New rows of the table, and the created ones.

    With skipDuplicates rows whose unique key is there, or came before in ``data``, are left out; a DataFrame's rows have
    no order, there the smallest row of a key stays. Keys with a null are never duplicates.
    """
    base = query.engine.base(query.meta.name)
    if isinstance(data, DataFrame):
        writable(query, [c for c in data.columns if c not in query.meta.generated])
        new = data.select(*[F.col(c).cast(base.schema[c].dataType).alias(c) if c in data.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns])
        order = [f.name for f in base.schema.fields if sortable(f.dataType)]
    else:
        if any(set(r) != set(data[0]) for r in data):
            raise ValidationError("rows to create have different fields")
        writable(query, data[0] if data else ())
        fields = [T.StructField(f.name, f.dataType, True) for f in base.schema.fields]
        new = query.engine.spark.createDataFrame([(*(r.get(c) for c in base.columns), k) for k, r in enumerate(data)], T.StructType([*fields, T.StructField("_order", T.LongType())]))
        order = ["_order"]
    if skipDuplicates:
        for key in (query.meta.key, *query.meta.unique):
            if key:
                columns = new.columns
                new = first_of_each(new, list(key), order).join(base.select(*key), list(key), "left_anti").select(*columns)
    new = computed(query, new.select(*base.columns))
    return base.unionByName(new), new


def upsert(query: TableQuery, rows: DataFrame, key: list[str], update: list[str], skipGlobalFilters: object = None) -> DataFrame:
    """The table merged with ``rows`` on ``key``: matches take the fields ``update``, others are added.

    Matches that the global filter hides stay as they are. Of rows that repeat a key the smallest is taken.
    """
    writable(query, update)
    base, hit = _flagged(query, None, skipGlobalFilters)
    columns = query.engine.base(query.meta.name).columns
    new = first_of_each(rows.select(*columns), key, [c for c in columns if sortable(rows.schema[c].dataType)])
    mark = new.select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(key)], *[F.col(c).alias(f"_u{n}") for n, c in enumerate(update)], F.lit(True).alias("_hit"))
    base = base.withColumn("_seen", hit)
    met = base.join(mark, everything([base[c] == mark[f"_k{n}"] for n, c in enumerate(key)]), "left")
    kept = met.select(*[F.when(F.col("_hit") & F.col("_seen"), F.col(f"_u{update.index(c)}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in columns])
    return computed(query, kept.unionByName(new.join(base.select(*key), key, "left_anti").select(*columns)))


def upsert_one(query: TableQuery, where: dict, create: dict, update: dict, skipGlobalFilters: object = None, includePii: object = None) -> tuple[DataFrame, dict]:
    """The table with the row of ``where`` updated, or ``create`` added where there is none; and that row.

    A row that the global filter hides is neither updated nor added again: it is not found.
    """
    guarded(query, where, None)
    writable(query, create)
    if query.engine.table(query.meta.name).count(where, UNSAFE).first()[0]:
        return _update(query, where, update, includePii=includePii, skipGlobalFilters=skipGlobalFilters)
    rows, new = create_many(query, [create])
    return rows, shown(query, new.first().asDict(), includePii)


def connect(query: TableQuery, where: dict, column: str, value: object) -> DataFrame:
    """Points the rows of ``where`` to a parent; ``disconnect`` is the value None."""
    return update_many(query, where, {column: {"set": value}})[0]


def link(engine: Engine, junction: str, here: dict, there: list[dict], replace: bool = False) -> DataFrame:
    """Junction rows after linking ``here`` with each of ``there``: added once, or in place of all others."""
    query = engine.table(junction)
    writable(query, [*here, *(c for t in there for c in t)])
    base = engine.base(junction)
    if replace:
        own = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in here.items()])
        base = base.where(~F.coalesce(own, F.lit(False)))
    new = engine.spark.createDataFrame([tuple({**here, **t}.get(c) for c in base.columns) for t in there], T.StructType([T.StructField(f.name, f.dataType, True) for f in base.schema.fields]))
    key = list(query.meta.key) or base.columns
    return base.unionByName(new.dropDuplicates(key).join(base.select(*key), key, "left_anti").select(*base.columns))


class Staged:
    """Changes of several tables that are seen together or not at all: ``with Staged(engine) as t: t.put("orders", rows)``.

    One inside another is a savepoint: its failure undoes its own changes only, if it is caught. ``timeout`` in seconds counts when it ends.
    """

    def __init__(self, engine: Engine, isolation: str | None = None, timeout: float | None = None) -> None:
        if isolation not in (None, "ReadUncommitted", "ReadCommitted", "RepeatableRead", "Serializable"):
            raise ValidationError("unknown isolation level")
        self.engine, self.timeout = engine, timeout

    def __enter__(self) -> Staged:
        self.before, self.began = dict(self.engine.frames), time.monotonic()
        return self

    def put(self, table: str, rows: DataFrame) -> None:
        self.engine.frames[table] = rows

    def __exit__(self, kind, error, trace) -> bool:
        late = self.timeout is not None and time.monotonic() - self.began > self.timeout
        if kind is not None or late:
            self.engine.frames = self.before
        if late and kind is None:
            raise TimeoutError_("a staged change took too long")
        return False


def save(rows: DataFrame, folder: str, table: str, version: int) -> str:
    """Writes a version of a table; older ones stay."""
    path = f"{folder}/{table}/v={version}"
    rows.write.mode("errorifexists").parquet(path)
    return path
