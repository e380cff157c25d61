"""What a database would enforce, asked for: unique keys, key columns without nulls, foreign keys, checks; and an advisor.

Spark enforces none of these, so each is a query: a row a rule with the number of rows that break it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.errors import CheckError, EngineError, ForeignKeyError, NotNullError, UniqueError
from quarryline.plans.engine import Engine

ERRORS: dict[str, type[EngineError]] = {"unique": UniqueError, "not null": NotNullError, "foreign key": ForeignKeyError, "check": CheckError}


def violations(engine: Engine, table: str) -> DataFrame:
    """kind, rule, n of every rule of a table: how many rows break it. Rows with a null in a unique or foreign key break none of these."""
    meta, base = engine.catalog[table], engine.base(table)
    full = lambda columns: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    out = []

    def counted(kind: str, rule: str, rows: DataFrame, n=None) -> None:
        out.append(rows.agg((F.count("*") if n is None else n).alias("n")).select(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), F.coalesce("n", F.lit(0)).alias("n")))

    for key in (meta.key, *meta.unique):
        if key:
            groups = base.where(full(key)).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
            counted("unique", ", ".join(key), groups, F.sum(F.col("n") - 1))
    for column in meta.key:
        counted("not null", column, base.where(F.col(column).isNull()))
    for fk in meta.foreign:
        targets = engine.base(fk.target).select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(fk.references)])
        rows = base.where(full(fk.columns))
        counted("foreign key", f"{', '.join(fk.columns)} -> {fk.target}", rows.join(targets, reduce(lambda a, b: a & b, [rows[c] == targets[f"_k{n}"] for n, c in enumerate(fk.columns)]), "left_anti"))
    for name, condition in meta.checks.items():
        counted("check", name, base.where(F.expr(f"NOT ({condition})")))
    return reduce(lambda a, b: a.unionByName(b), out) if out else engine.spark.createDataFrame([], "kind string, rule string, n long")


def enforce(engine: Engine, table: str) -> None:
    """Raises the error of the first broken rule."""
    broken = violations(engine, table).where("n > 0").orderBy("kind", "rule").first()
    if broken is not None:
        raise ERRORS[broken["kind"]](f"{broken['n']} rows of {table} break {broken['kind']} {broken['rule']}")


def advice(engine: Engine, threshold: int = 10 << 20) -> list[dict]:
    """Relations whose joins shuffle large tables at both ends: the columns by which to bucket them, by the optimizer's sizes."""
    size = {t: int(str(engine.base(t)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in engine.catalog.tables if t in engine.frames or engine.folder}
    out = []
    for name, table in sorted(engine.catalog.tables.items()):
        for relation, r in sorted(table.relations.items()):
            if r.kind != "through" and name in size and min(size[name], size.get(r.target, 0)) > threshold:
                out.append({"table": name, "relation": relation, "bucket": {name: list(r.here), r.target: list(r.there)}, "bytes": size[name] + size[r.target]})
    return out


def introspected(engine: Engine) -> dict[str, dict]:
    """Columns with their types, keys and relations of every table that can be read."""
    return {
        name: {
            "columns": [{"name": f.name, "type": f.dataType.simpleString(), "pii": f.name in t.pii, "generated": f.name in t.generated} for f in engine.base(name).schema.fields],
            "key": list(t.key), "unique": [list(u) for u in t.unique], "view": t.view,
            "relations": {n: {"kind": r.kind, "target": r.target, "here": list(r.here), "there": list(r.there)} for n, r in t.relations.items()},
        }
        for name, t in engine.catalog.tables.items() if name in engine.frames or engine.folder
    }
