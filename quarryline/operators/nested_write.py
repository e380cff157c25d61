"""Changes that reach over relations: create and connect, disconnect, set, update and delete of related rows.

All of one call is staged: either every table's new version is seen, or none. Key-side relations are resolved first, then
the row itself, then what points to it. New keys are one above the largest: one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.catalog import Relation, Table
from quarryline.errors import UNSAFE, DepthError, NotFoundError, ValidationError
from quarryline.functions.predicate import given
from quarryline.operators import write
from quarryline.plans.engine import DEPTH, Engine

TO_OPS = {"create", "connect", "connectOrCreate", "disconnect", "update", "delete"}
MANY_OPS = {"create", "connect", "connectOrCreate", "disconnect", "set", "update", "upsert", "delete"}
LINK_OPS = {"connect", "disconnect", "set"}


def listed(value: object) -> list:
    return value if isinstance(value, list) else [value]


def found(engine: Engine, table: str, where: dict) -> dict:
    """The row of a unique where, with all fields; not there is an error that names keys only."""
    row = engine.table(table).find_unique(where=where, includePii=UNSAFE).first()
    if row is None:
        raise NotFoundError(f"no {table} for {', '.join(sorted(where))}")
    return row.asDict()


def create(engine: Engine, table: str, data: dict, includePii: object = None) -> dict:
    """Creates a row with its relations; returns the row without personal fields."""
    with write.Staged(engine):
        return write.shown(engine.table(table), _create(engine, table, [data], 0)[0], includePii)


def update(engine: Engine, table: str, where: dict, data: dict, includePii: object = None) -> dict:
    """Updates the first row of ``where`` and its relations; returns the row as it is after, without personal fields."""
    with write.Staged(engine):
        row = found(engine, table, where)
        meta = engine.catalog[table]
        own, inner, outer = _split(meta, data)
        for relation, value in inner:
            own |= _key_side(engine, relation, value, row, 0)
        key = {k: row[k] for k in meta.key}
        if own:
            engine.frames[table] = write.update_many(engine.table(table), key, own)[0]
        row = found(engine, table, key)
        for relation, value in outer:
            _other_side(engine, relation, value, row, 0)
        return write.shown(engine.table(table), row, includePii)


def _split(meta: Table, data: dict) -> tuple[dict, list, list]:
    own, inner, outer = {}, [], []
    for name, value in given(data).items():
        relation = meta.relations.get(name)
        if relation is None:
            own[name] = value
        else:
            (inner if relation.kind == "to" else outer).append((relation, value))
    return own, inner, outer


def _create(engine: Engine, table: str, data: list[dict], depth: int) -> list[dict]:
    """Creates rows in one change; the rows' relations come after."""
    if depth >= DEPTH:
        raise DepthError("nested changes are too deep")
    meta = engine.catalog[table]
    made, after = [], []
    for one in data:
        own, inner, outer = _split(meta, one)
        for relation, value in inner:
            own |= _key_side(engine, relation, value, None, depth)
        made.append(own)
        after.append(outer)
    base = engine.base(table)
    unnamed = [r for r in made if len(meta.key) == 1 and r.get(meta.key[0]) is None]
    if unnamed:
        highest = base.agg(F.max(meta.key[0])).first()[0] or 0
        named = [r[meta.key[0]] for r in made if r.get(meta.key[0]) is not None]
        for number, row in enumerate(unnamed, max([highest, *named]) + 1):
            row[meta.key[0]] = number
    fields = list(dict.fromkeys(f for r in made for f in r))
    engine.frames[table], new = write.create_many(engine.table(table), [{f: r.get(f) for f in fields} for r in made])
    if meta.formulas:  # what is computed is known only when the rows are read
        by_key = {tuple(r[k] for k in meta.key): r.asDict() for r in new.collect()}
        rows = [by_key[tuple(r[k] for k in meta.key)] for r in made]
    else:
        rows = [{c: r.get(c) for c in base.columns} for r in made]
    for row, outer in zip(rows, after, strict=True):
        for relation, value in outer:
            _other_side(engine, relation, value, row, depth)
    return rows


def _checked(value: object, allowed: set[str]) -> dict:
    if not isinstance(value, dict) or set(value) - allowed:
        raise ValidationError(f"a related change takes {', '.join(sorted(allowed))}")
    return value


def _either(engine: Engine, table: str, spec: dict, depth: int) -> dict:
    """The row of ``where``, or a new one."""
    row = engine.table(table).find_unique(where=spec["where"], includePii=UNSAFE).first()
    return row.asDict() if row is not None else _create(engine, table, [spec["create"]], depth + 1)[0]


def _free_to_take(engine: Engine, relation: Relation, target: dict, own: dict) -> None:
    """With ``engine.scoped_connect`` a row that belongs to another parent is not taken from it."""
    held = {t: target[t] for t in own}
    if engine.scoped_connect and held != own and None not in held.values():
        raise ValidationError(f"a row of {relation.target} belongs to another row")


def _key_side(engine: Engine, relation: Relation, value: dict, row: dict | None, depth: int) -> dict:
    """Values of this row's foreign key after the change of its to-one relation."""
    out: dict = {}
    for op, spec in _checked(value, TO_OPS).items():
        if op in ("disconnect", "delete"):
            out |= dict.fromkeys(relation.here)
            if op == "delete" and row is not None:
                there = {t: row[h] for h, t in zip(relation.here, relation.there, strict=True)}
                engine.frames[relation.target] = write.delete_many(engine.table(relation.target), there)[0]
            continue
        if op == "update":
            there = {t: (row or {}).get(h) for h, t in zip(relation.here, relation.there, strict=True)}
            if None in there.values():
                raise NotFoundError(f"no related {relation.target}")
            engine.frames[relation.target] = write.update_many(engine.table(relation.target), there, spec)[0]
            continue
        target = {"create": lambda s: _create(engine, relation.target, [s], depth + 1)[0], "connect": lambda s: found(engine, relation.target, s), "connectOrCreate": lambda s: _either(engine, relation.target, s, depth)}[op](spec)
        out |= {h: target[t] for h, t in zip(relation.here, relation.there, strict=True)}
    return out


def _other_side(engine: Engine, relation: Relation, value: dict, row: dict, depth: int) -> None:
    """Changes of rows that point to this one, by their key or by a junction."""
    if relation.kind == "through":
        here = {j: row[h] for h, j in zip(relation.here, relation.junction_here, strict=True)}
        for op, spec in _checked(value, LINK_OPS).items():
            there = [{j: found(engine, relation.target, s)[t] for t, j in zip(relation.there, relation.junction_there, strict=True)} for s in listed(spec)]
            if op == "disconnect":
                for pair in there:
                    engine.frames[relation.junction] = write.delete_many(engine.table(relation.junction), here | pair)[0]
            else:
                engine.frames[relation.junction] = write.link(engine, relation.junction, here, there, replace=op == "set")
        return
    own = {t: row[h] for h, t in zip(relation.here, relation.there, strict=True)}
    free = dict.fromkeys(own)

    def put(where: dict, data: dict) -> None:
        engine.frames[relation.target] = write.update_many(engine.table(relation.target), where, data)[0]

    for op, spec in _checked(value, MANY_OPS).items():
        if op == "set":
            put(own, free)
        if op == "create":
            _create(engine, relation.target, [one | own for one in listed(spec)], depth + 1)
            continue
        for one in listed(spec):
            if op in ("connect", "set"):
                _free_to_take(engine, relation, found(engine, relation.target, one), own)
                put(one, own)
            elif op == "connectOrCreate":
                target = _either(engine, relation.target, one | {"create": one["create"] | own}, depth)
                _free_to_take(engine, relation, target, own)
                put({k: target[k] for k in engine.catalog[relation.target].key}, own)
            elif op == "disconnect":
                put({"AND": [one, own]}, free)
            elif op == "delete":
                found(engine, relation.target, {"AND": [one, own]})
                engine.frames[relation.target] = write.delete_many(engine.table(relation.target), {"AND": [one, own]})[0]
            else:  # update, upsert: only rows that belong to this one
                where = {"AND": [one["where"], own]}
                there = engine.table(relation.target).find_unique(where=where).first()
                if there is not None:
                    put(where, one["data"] if op == "update" else one["update"])
                elif op == "upsert":
                    _create(engine, relation.target, [one["create"] | own], depth + 1)
                else:
                    raise NotFoundError(f"no related {relation.target}")
