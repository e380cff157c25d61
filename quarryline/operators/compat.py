"""Other spellings of read arguments, turned into the engine's own, at every depth."""

from __future__ import annotations

from quarryline.catalog import Catalog
from quarryline.errors import UNSET, UnsupportedError, ValidationError
from quarryline.functions.predicate import given
from quarryline.plans.engine import Table, direction_of


def _related(meta: Table, specs: dict, catalog: Catalog | None) -> dict:
    """Relations to read: ``take`` is limit there, ``include`` and relations in ``select`` are with."""
    out = {}
    for name, spec in given(specs).items():
        if name == "_count" and isinstance(spec, dict) and set(spec) == {"select"}:
            spec = spec["select"]
        if name != "_count" and isinstance(spec, dict):
            relation = meta.relations.get(name)
            if relation is None:
                raise ValidationError(f"unknown relation {name} of {meta.name}")
            if spec.get("skip") or spec.get("cursor"):
                raise UnsupportedError("related rows are not skipped")
            target = catalog[relation.target] if catalog is not None else None
            spec = _shaped(target, dict(spec), catalog)
            if "take" in spec:
                spec["limit"] = spec.pop("take")
            spec.pop("skip", None)
        out[name] = spec
    return out


def _shaped(meta: Table | None, args: dict, catalog: Catalog | None) -> dict:
    """``include``, and relations named in ``select``, as with."""
    with_ = dict(args.pop("include", None) or {})
    select = args.get("select")
    if isinstance(select, dict) and meta is not None:
        chosen = {k: v for k, v in select.items() if k in meta.relations or k == "_count"}
        fields = {k: v for k, v in select.items() if k not in chosen}
        with_ |= {k: v for k, v in chosen.items() if v}
        if chosen and not fields:
            fields = dict.fromkeys(meta.key, True)
        args["select"] = fields
    if with_ and meta is not None:
        args["with"] = _related(meta, with_, catalog)
    elif with_:
        args["with"] = with_
    if isinstance(args.get("distinct"), str):
        args["distinct"] = [args["distinct"]]
    return args


def translated(meta: Table, args: dict, catalog: Catalog | None = None) -> dict:
    """``include`` is with, ``skip`` is offset; a cursor with a skip of one or more is exclusive, else inclusive."""
    args = _shaped(meta, given(dict(args)), catalog)
    take = args.get("take")
    if isinstance(take, int) and take < 0:
        raise UnsupportedError("a negative take is not there")
    skip = args.pop("skip", 0)
    cursor = args.get("cursor")
    if cursor and skip >= 1:
        args["offset"] = skip - 1
    elif cursor:
        if len(cursor) != 1:
            raise ValidationError("an inclusive cursor takes one field")
        (field, value), order = next(iter(cursor.items())), args.get("orderBy") or {}
        order = order if isinstance(order, list) else [order]
        if any(set(o) - {field} for o in order):
            raise ValidationError("an inclusive cursor must be the order's field")
        down = any(direction_of(o[field])[0].lower() == "desc" for o in order if field in o)
        args["where"] = {"AND": [args.get("where") or {}, {field: {"lte" if down else "gte": value}}]}
        args["cursor"] = UNSET
        args["orderBy"] = order if any(order) else [{field: "asc"}]
    elif skip:
        args["offset"] = skip
    return args
