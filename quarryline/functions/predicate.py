"""Scalar conditions: the value side of ``where`` as Column expressions, with three-valued logic."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.errors import UNSET, ValidationError

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}
LIKE = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}
SCALAR = {"equals", "not", "in", "notIn", "mode", *COMPARE, *LIKE}
ARRAY = {"has", "hasEvery", "hasSome", "isEmpty"}
JSON_KEYS = {"path", "equals", "contains", "hasKey", "mode", "stringContains", "stringStartsWith", "stringEndsWith", *COMPARE}


def everything(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def given(spec: dict) -> dict:
    return {k: v for k, v in spec.items() if v is not UNSET}


def json_path(path: list) -> str:
    """A JSON path; digits are array places, other names are quoted."""
    out = "$"
    for step in path:
        text = str(step)
        if "'" in text or "]" in text:
            raise ValidationError("a JSON path step holds a quote or bracket")
        out += f"[{text}]" if text.isdigit() else f"['{text}']"
    return out


def json_text(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def finite(value: object) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)


NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def _variant_step(key: object) -> str:
    """One step of a variant's path: an array place, or a name in whichever quotes it does not hold."""
    if isinstance(key, int) and not isinstance(key, bool):
        return f"[{key}]"
    text = str(key)
    if "'" not in text:
        return f"['{text}']"
    if '"' not in text:
        return f'["{text}"]'
    raise ValidationError("a JSON name holds both kinds of quotes")


def _held(value: Column, pattern: object) -> Column:
    """Whether a variant contains a constant; type and null count, numbers are equal by value."""
    kind = F.schema_of_variant(value)
    if isinstance(pattern, dict):
        inside = [_held(F.try_variant_get(value, "$" + _variant_step(k), "variant"), v) for k, v in pattern.items()]
        found = reduce(lambda a, b: a & b, inside, F.startswith(kind, F.lit("OBJECT")))
    elif isinstance(pattern, list):
        items = F.try_variant_get(value, "$", "array<variant>")

        def some(wanted: object) -> Column:
            return F.coalesce(F.exists(items, lambda x: _held(x, wanted)), F.lit(False))

        inside = list(map(some, pattern))
        found = reduce(lambda a, b: a & b, inside, F.startswith(kind, F.lit("ARRAY")))
    elif pattern is None:
        found = F.is_variant_null(value)
    elif isinstance(pattern, bool):
        found = (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == pattern)
    elif isinstance(pattern, str):
        found = (kind == "STRING") & (F.try_variant_get(value, "$", "string") == pattern)
    elif finite(pattern):
        # as decimals where they fit, so that large whole numbers keep apart
        exact = F.try_variant_get(value, "$", "decimal(38,10)") == F.lit(str(pattern)).try_cast("decimal(38,10)")
        found = F.rlike(kind, F.lit(NUMBER)) & F.coalesce(exact, F.try_variant_get(value, "$", "double") == float(pattern))
    else:
        raise ValidationError("a JSON value is an object, a list, a text, a number, a truth value or null")
    return F.coalesce(found, F.lit(False))


def contained(column: Column, pattern: object, path: list | None = None) -> Column:
    """Deep containment of a constant JSON pattern: objects by key, arrays by some element, scalars by type and value.

    An outermost array contains a scalar that is one of its elements. Text that is no JSON contains nothing.
    """
    value = F.try_parse_json(column)
    if path:
        steps = "".join(_variant_step(int(str(p)) if str(p).isdigit() else p) for p in path)
        value = F.try_variant_get(value, "$" + steps, "variant")
    found = _held(value, pattern)
    return found if isinstance(pattern, dict | list) else found | _held(value, [pattern])


def json_condition(column: Column, spec: dict) -> Column:
    spec = given(spec)
    unknown = set(spec) - JSON_KEYS
    if unknown:
        raise ValidationError(f"unknown JSON filter {sorted(unknown)[0]}")
    if not set(spec) - {"path", "mode"}:
        raise ValidationError("a JSON path needs a condition")
    path = spec.get("path")
    text = F.get_json_object(column, json_path(path)) if path else None
    out = []
    for key, value in spec.items():
        if key in ("path", "mode"):
            continue
        if key == "equals":
            out.append(text == json_text(value) if path else contained(column, value))
        elif key == "contains":
            out.append(contained(column, value, path))
        elif key == "hasKey":
            out.append(F.array_contains(F.json_object_keys(column), value))
        elif text is None:
            raise ValidationError(f"JSON {key} needs a path")
        elif key in COMPARE:
            if not isinstance(value, str) and not finite(value):
                raise ValidationError(f"JSON {key} takes a finite number or a text")
            out.append(COMPARE[key](text, F.lit(value)) if isinstance(value, str) else COMPARE[key](text.cast("decimal(38,10)"), F.lit(value)))
        else:
            test = LIKE[key.removeprefix("string")[0].lower() + key.removeprefix("string")[1:]]
            fold = spec.get("mode") == "insensitive"
            out.append(test(F.lower(text) if fold else text, F.lit(value.lower() if fold else value)))
    return everything(out)


def array_condition(column: Column, spec: dict) -> Column:
    out = []
    for key, value in given(spec).items():
        if key == "has":
            out.append(F.array_contains(column, value))
        elif key in ("hasEvery", "hasSome"):
            listed = F.array(*[F.lit(v) for v in value])
            if not value:
                out.append(F.when(column.isNotNull(), F.lit(key == "hasEvery")))
            elif key == "hasEvery":
                out.append(F.size(F.array_except(listed, column)) == 0)
            else:
                out.append(F.when(column.isNotNull(), F.coalesce(F.arrays_overlap(column, listed), F.lit(False))))
        elif key == "isEmpty":
            empty = F.coalesce(F.size(column), F.lit(0)) == 0
            out.append(empty if value else ~empty)
        else:
            raise ValidationError(f"unknown array filter {key}")
    return everything(out)


def distance(column: Column, to: list[float], metric: str) -> Column:
    """Distance of a vector column from a constant, in double precision; ``ip`` is the negated inner product."""
    if not to or not all(finite(x) for x in to):
        raise ValidationError("a vector takes finite numbers")
    v = F.transform(column, lambda x: x.cast("double"))
    target = F.array(*[F.lit(float(x)) for x in to])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(v, target, lambda a, b: a * b))
    if metric == "l2":
        return F.sqrt(total(F.zip_with(v, target, lambda a, b: (a - b) * (a - b))))
    if metric == "cosine":
        norm = math.sqrt(sum(float(x) ** 2 for x in to))
        return 1 - dot / (F.sqrt(total(F.transform(v, lambda a: a * a))) * F.lit(norm))
    if metric == "ip":
        return -dot
    raise ValidationError(f"unknown vector metric {metric}")


def vector_condition(column: Column, spec: dict) -> Column:
    d = given(spec["distance"])
    bounds = {k: v for k, v in d.items() if k in COMPARE}
    if not bounds or not all(finite(v) for v in bounds.values()):
        raise ValidationError("a vector filter needs a finite threshold")
    at = distance(column, d.get("to", []), d.get("metric", "l2"))
    return everything([COMPARE[k](at, F.lit(float(v))) for k, v in bounds.items()])


TOKEN = re.compile(r"\s*(<->|[()&|!]|[^\s()&|!<]+)")


def text_search(column: Column, query: str, config: str = "simple") -> Column:
    """Words joined by & | ! <-> and brackets, matched on lower-cased words. Only the ``simple`` configuration."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", config):
        raise ValidationError("a text search configuration is a plain name")
    if config != "simple":
        raise ValidationError("only the simple text search configuration is there")
    words = F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    tokens = TOKEN.findall(query)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def atom() -> tuple[Column, str | None]:
        token = peek()
        if token is None or token in "&|)" or token == "<->":
            raise ValidationError("malformed text search")
        take()
        if token == "!":
            return ~atom()[0], None
        if token == "(":
            inner = either()
            if peek() != ")":
                raise ValidationError("malformed text search")
            take()
            return inner, None
        return F.array_contains(words, token.lower()), token.lower()

    def phrase() -> Column:
        first, word = atom()
        run = [word]
        while peek() == "<->":
            take()
            other, word = atom()
            run.append(word)
        if len(run) == 1:
            return first
        if None in run:
            raise ValidationError("a phrase takes words only")
        return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(" " + " ".join(run) + " "))

    def both() -> Column:
        out = phrase()
        while peek() == "&":
            take()
            out = out & phrase()
        return out

    def either() -> Column:
        out = both()
        while peek() == "|":
            take()
            out = out | both()
        return out

    found = either()
    if peek() is not None:
        raise ValidationError("malformed text search")
    return found


def operand_for(kind: T.DataType | None, value: object) -> Column:
    """A constant for comparing with a column of ``kind``: dates and times take the column's type, texts are read in UTC."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) and isinstance(value, str | dt.date | dt.datetime):
        if isinstance(value, dt.datetime) and value.tzinfo is not None:
            value = value.astimezone(dt.UTC).replace(tzinfo=None)
        text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat() if isinstance(value, dt.date) else value
        at = F.lit(text).cast("timestamp") if re.search(r"(Z|[+-]\d\d:?\d\d)$", text) else F.lit(text).cast("timestamp_ntz")
        return at.cast(kind)
    if isinstance(kind, T.StringType) and isinstance(value, dt.time):
        return F.lit(value.strftime("%H:%M:%S"))
    return F.lit(value)


def scalar_condition(column: Column, spec: dict, ref: Callable[[str], Column], kind: T.DataType | None = None) -> Column:
    if not spec:
        raise ValidationError("an empty filter; give a value or an operator")
    spec = given(spec)
    unknown = set(spec) - SCALAR
    if unknown:
        raise ValidationError(f"unknown operator {sorted(unknown)[0]}")
    fold = spec.get("mode") == "insensitive"

    def operand(value: object) -> Column:
        if isinstance(value, dict):
            if set(value) != {"col"} or fold:
                raise ValidationError("an operand is a value or a column reference")
            return ref(value["col"])
        if isinstance(value, list | set | tuple):
            raise ValidationError("an operand is one value")
        return operand_for(kind, value)

    out = []
    for key, value in spec.items():
        if key == "mode":
            continue
        if key == "equals":
            out.append(column.isNull() if value is None else column == operand(value))
        elif key == "not":
            out.append(column.isNotNull() if value is None else column != operand(value))
        elif key in COMPARE:
            out.append(COMPARE[key](column, operand(value)))
        elif key == "in":
            out.append(column.isin([operand_for(kind, v) for v in value]) if value else F.lit(False))
        elif key == "notIn":
            out.append(~column.isin([operand_for(kind, v) for v in value]) if value else F.lit(True))
        else:
            out.append(LIKE[key](F.lower(column) if fold else column, F.lit(value.lower() if fold else value)))
    found = everything(out)
    return F.lit(True) if found is None else found


def field_condition(column: Column, kind: T.DataType, is_json: bool, value: object, ref: Callable[[str], Column]) -> Column:
    """One field's condition: null, vector, JSON, array, text search, operators, equality, in this order."""
    if value is None:
        return column.isNull()
    if isinstance(value, dict):
        if "distance" in value:
            return vector_condition(column, value)
        if is_json:
            return json_condition(column, value)
        if isinstance(kind, T.ArrayType) and set(value) <= ARRAY:
            return array_condition(column, value)
        if "search" in value:
            return text_search(column, value["search"], value.get("config", "simple"))
        if set(value) & {"path", "hasKey", "stringContains"}:
            raise ValidationError("a JSON filter on a column that is not JSON")
        if set(value) == {"col"}:
            return column == ref(value["col"])
        return scalar_condition(column, value, ref, kind)
    if isinstance(value, list | set | tuple):
        raise ValidationError("a field takes one value; use in for several")
    return column == operand_for(kind, value)
