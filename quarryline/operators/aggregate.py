"""aggregate and groupBy: flat result columns, ``_sum_x`` and the like; ``nested`` makes structs of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.errors import UNSET, ValidationError, is_unsafe
from quarryline.functions.predicate import COMPARE, given, json_path

BLOCKS = ("_sum", "_avg", "_min", "_max")


def _target(query, df: DataFrame, block: str, name: str, spec: object, pii: object) -> Column:
    if isinstance(spec, dict):
        text = F.get_json_object(F.col(spec["field"]), json_path(spec["path"]))
        if block in ("_sum", "_avg"):
            if spec.get("type") == "text":
                raise ValidationError(f"{block} takes numbers")
            return text.cast("decimal(38,10)")
        return text.cast("decimal(38,10)") if spec.get("type") == "numeric" else text
    if name not in df.columns:
        raise ValidationError(f"unknown field {name}")
    if block in ("_min", "_max") and name in query.meta.pii and not is_unsafe(pii):
        raise ValidationError(f"{block} of a personal field needs UNSAFE")
    return F.col(name)


def _function(block: str, column: Column) -> Column:
    return {"_sum": F.sum, "_avg": lambda c: F.avg(c.cast("double")), "_min": F.min, "_max": F.max}[block](column)


def _measures(query, df: DataFrame, args: dict, pii: object) -> dict[str, Column]:
    out: dict[str, Column] = {}
    count = args.get("_count")
    if count is True or (count is None and not any(args.get(b) for b in BLOCKS)):
        out["_count"] = F.count("*")
    for name, on in (count if isinstance(count, dict) else {}).items():
        if on:
            if name != "_all" and name not in df.columns:
                raise ValidationError(f"unknown field {name}")
            out[f"_count_{name.lstrip('_')}"] = F.count("*") if name == "_all" else F.count(F.col(name))
    for block in BLOCKS:
        for name, spec in given(args.get(block) or {}).items():
            if spec:
                out[f"{block}_{name}"] = _function(block, _target(query, df, block, name, spec, pii))
    return out


def aggregate(query, where: dict | None = None, includePii: object = None, skipGlobalFilters: object = None, **args) -> DataFrame:
    df = query.filtered(where, skipGlobalFilters)
    return df.agg(*[c.alias(n) for n, c in _measures(query, df, args, includePii).items()])


def _compare(column: Column, spec: object) -> Column:
    if not isinstance(spec, dict):
        return column.isNull() if spec is None else column == F.lit(spec)
    out = []
    for key, value in given(spec).items():
        if key == "equals":
            out.append(column.isNull() if value is None else column == F.lit(value))
        elif key == "not":
            out.append(column.isNotNull() if value is None else column != F.lit(value))
        elif key == "in":
            out.append(column.isin(list(value)) if value else F.lit(False))
        elif key == "notIn":
            out.append(~column.isin(list(value)) if value else F.lit(True))
        elif key in COMPARE:
            out.append(COMPARE[key](column, F.lit(value)))
        else:
            raise ValidationError(f"unknown having operator {key}")
    return reduce(lambda a, b: a & b, out, F.lit(True))


def group_by(query, by: list, where: dict | None = None, having: dict | None = None, orderBy=None, limit=None, offset=None, distinctOn: dict | None = None, includePii: object = None, skipGlobalFilters: object = None, nested: bool = False, **args) -> DataFrame:
    """where, then the distinct rows, then groups, having, order, offset and limit."""
    from quarryline.plans.engine import direction_of, natural, ordered, tie_break

    if not by:
        raise ValidationError("groupBy needs keys")
    df = query.filtered(where, skipGlobalFilters)
    if distinctOn:
        order = distinctOn.get("orderBy")
        if not order:
            raise ValidationError("distinctOn needs an orderBy")
        df, keys = query._order(df, order if isinstance(order, list) else [order], skipGlobalFilters)
        at = Window.partitionBy(*distinctOn["fields"]).orderBy(*keys, *tie_break(query.meta, query.engine.base(query.meta.name)))
        df = df.withColumn("_rn", F.row_number().over(at)).where("_rn = 1")
    names, keys = [], []
    for key in by:
        if isinstance(key, dict):
            names.append(key.get("alias") or str(key["path"][-1]))
            keys.append(F.get_json_object(F.col(key["field"]), json_path(key["path"])).alias(names[-1]))
        else:
            if key not in df.columns:
                raise ValidationError(f"unknown field {key}")
            if key in query.meta.pii:
                raise ValidationError(f"personal field {key} cannot be a group key")
            names.append(key)
            keys.append(F.col(key))
    measures = _measures(query, df, args, includePii)
    if len({*names, *measures}) < len(names) + len(measures):
        raise ValidationError("two result columns have one name")
    shown = [*names, *measures]

    def needed(block: str, field: str) -> str:
        name = f"{block}_{field}"
        if name not in measures:
            measures[name] = _function(block, _target(query, df, block, field, True, includePii))
        return name

    def wanted(spec: dict) -> list[Column]:
        out = []
        for key, value in given(spec).items():
            if key in ("AND", "OR", "NOT"):
                parts = [wanted(m) for m in (value if isinstance(value, list) else [value])]
                members = [reduce(lambda a, b: a & b, p) for p in parts if p]
                if members:
                    both = reduce((lambda a, b: a | b) if key == "OR" else (lambda a, b: a & b), members)
                    out.append(~both if key == "NOT" else both)
            elif key == "_count":
                measures.setdefault("_hidden_count", F.count("*"))
                out.append(_compare(F.col("_hidden_count"), value))
            elif isinstance(value, dict) and set(value) & set(BLOCKS):
                out.extend(_compare(F.col(needed(block, key)), spec) for block, spec in value.items())
            elif key in names:
                out.append(_compare(F.col(key), value))
            else:
                raise ValidationError(f"having field {key} is no group key")
        return out

    conditions = wanted(having or {})
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])
    if conditions:
        out = out.where(reduce(lambda a, b: a & b, conditions))
    sort = []
    for spec in orderBy if isinstance(orderBy, list) else [orderBy] if orderBy else []:
        for key, value in spec.items():
            fields = [(f"{key}_{f}", v) for f, v in value.items()] if key in BLOCKS else [(key, value)]
            for name, how in fields:
                if name not in shown:
                    raise ValidationError(f"order field {name} is not requested")
                sort.append(ordered(F.col(name), *direction_of(how)))
    if sort or limit not in (None, UNSET) or offset not in (None, UNSET):
        out = out.orderBy(*sort, *[F.col(n).asc_nulls_last() for n in names])  # a cut follows a total order
    if offset is not None and offset is not UNSET:
        out = out.offset(natural(offset, "offset"))
    if limit is not None and limit is not UNSET:
        out = out.limit(natural(limit, "limit"))
    if not nested:
        return out.select(*shown)
    blocks = [F.struct(*[F.col(m).alias(m[len(b) + 1 :]) for m in shown if m.startswith(f"{b}_")]).alias(b) for b in BLOCKS if any(m.startswith(f"{b}_") for m in shown)]
    return out.select(*names, *[c for c in shown if c == "_count"], *blocks)
