"""Tables, keys and relations. Spark does not enforce keys, so they live here only."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from quarryline.errors import ValidationError


@dataclass(frozen=True)
class Relation:
    """A step to another table. ``here`` columns of this table equal ``there`` columns of the target.

    kind: ``many`` (array), ``one`` (object, key on the target), ``to`` (object, key here), ``through`` (array by a junction).
    """

    kind: str
    target: str
    here: tuple[str, ...]
    there: tuple[str, ...]
    junction: str | None = None
    junction_here: tuple[str, ...] = ()
    junction_there: tuple[str, ...] = ()

    @property
    def single(self) -> bool:
        return self.kind in ("one", "to")


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    target: str
    references: tuple[str, ...]
    name: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign: tuple[ForeignKey, ...] = ()
    pii: tuple[str, ...] = ()
    json: tuple[str, ...] = ()
    updated_at: str | None = None
    generated: tuple[str, ...] = ()
    formulas: dict[str, str] = field(default_factory=dict, hash=False)
    columns: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict, hash=False)
    view: bool = False
    relations: dict[str, Relation] = field(default_factory=dict, hash=False)

    def is_unique(self, columns: tuple[str, ...]) -> bool:
        return any(k and set(k) <= set(columns) for k in (self.key, *self.unique))


#: Fixed endings of plural names, in this order: ending, what takes its place, how many letters go.
ENDINGS = (("ies", "y", 3), ("ses", "", 2), ("xes", "", 2), ("zes", "", 2), ("ss", "", 0), ("s", "", 1))


def singular(name: str) -> str:
    """The singular of a plural table name, by its ending alone."""
    for ending, put, cut in ENDINGS:
        if name.endswith(ending):
            return name[: len(name) - cut] + put
    return name


def _free(name: str, taken: dict) -> str:
    if name not in taken:
        return name
    number = 1
    while (found := f"{name}Rel{'' if number == 1 else number}") in taken:
        number += 1
    return found


class Catalog:
    def __init__(self, tables: list[Table], through: dict[str, dict[str, Relation]] | None = None) -> None:
        self.tables = {t.name: replace(t, relations={}) for t in tables}
        self._derive()
        for table, relations in (through or {}).items():
            self.tables[table].relations.update(relations)

    def __getitem__(self, name: str) -> Table:
        if name not in self.tables:
            raise ValidationError(f"unknown table {name}; known: {', '.join(sorted(self.tables))}")
        return self.tables[name]

    def _derive(self) -> None:
        """Names relations by foreign keys; several keys between two tables take the key column's name."""
        for table in self.tables.values():
            pairs = [f.target for f in table.foreign]
            for fk in table.foreign:
                several = pairs.count(fk.target) > 1
                base = (fk.name or "_".join(fk.columns)) if len(fk.columns) > 1 else fk.columns[0].removesuffix("_id")
                name = base if several else singular(fk.target)
                table.relations[_free(name, table.relations)] = Relation("to", fk.target, fk.columns, fk.references)
                target = self.tables.get(fk.target)
                if target is None:
                    continue
                unique = any(set(k) == set(fk.columns) for k in (table.key, *table.unique) if k)
                back = singular(table.name) if unique else table.name
                if several:
                    back = f"{back}_by_{base}"
                target.relations[_free(back, target.relations)] = Relation("one" if unique else "many", table.name, fk.references, fk.columns)
        for table in list(self.tables.values()):
            self._junction(table)

    def _junction(self, table: Table) -> None:
        """Two single-column keys to different tables that are a table's whole key, or without a primary key a unique
        one, are a many-to-many link, if the table has no other columns (where its columns are told). No name is taken away."""
        if len(table.foreign) != 2 or any(len(f.columns) != 1 for f in table.foreign):
            return
        a, b = table.foreign
        both = {*a.columns, *b.columns}
        keys = [table.key] if table.key else table.unique
        if a.target == b.target or len(both) != 2 or not any(len(k) == 2 and set(k) == both for k in keys) or (table.columns and set(table.columns) != both):
            return
        for x, y in ((a, b), (b, a)):
            if x.target in self.tables and y.target not in self.tables[x.target].relations:
                target = self.tables[x.target]
                target.relations[_free(y.target, dict.fromkeys(target.columns))] = Relation("through", y.target, x.references, y.references, table.name, x.columns, y.columns)


def _fk(column: str, target: str, reference: str) -> ForeignKey:
    return ForeignKey((column,), target, (reference,))


def star_schema() -> Catalog:
    """The tables that the registered queries read."""
    tables = [
        Table("region", ("r_regionkey",)),
        Table("nation", ("n_nationkey",), foreign=(_fk("n_regionkey", "region", "r_regionkey"),)),
        Table("customer", ("c_custkey",), foreign=(_fk("c_nationkey", "nation", "n_nationkey"),)),
        Table("supplier", ("s_suppkey",), foreign=(_fk("s_nationkey", "nation", "n_nationkey"),)),
        Table("part", ("p_partkey",)),
        Table("orders", ("o_orderkey",), foreign=(_fk("o_custkey", "customer", "c_custkey"),)),
        Table("lineitem", foreign=(_fk("l_orderkey", "orders", "o_orderkey"), _fk("l_partkey", "part", "p_partkey"), _fk("l_suppkey", "supplier", "s_suppkey"))),
        Table("events", ("event_id",), foreign=(_fk("user_id", "customer", "c_custkey"),), json=("props",)),
        Table("documents", ("doc_id",)),
        Table("labels", ("doc_id",), foreign=(_fk("doc_id", "documents", "doc_id"),)),
        Table("conversations", ("conv_id", "turn")),
        Table("embeddings", ("vec_id",)),
        Table("pages", ("page_id",)),
        Table("benchmark", ("item_id",)),
    ]
    through = {
        "orders": {"parts": Relation("through", "part", ("o_orderkey",), ("p_partkey",), "lineitem", ("l_orderkey",), ("l_partkey",))},
        "part": {"orders": Relation("through", "orders", ("p_partkey",), ("o_orderkey",), "lineitem", ("l_partkey",), ("l_orderkey",))},
    }
    return Catalog(tables, through)
