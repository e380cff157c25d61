from __future__ import annotations

import random

import pytest
from quarryline.catalog import Catalog, ForeignKey, Table
from quarryline.errors import UNSAFE, UNSET, DepthError, ForeignKeyError, NotFoundError, OptimisticLockError, PipelineError, RelationError, TimeoutError_, UniqueError, ValidationError
from quarryline.operators import checks, write
from quarryline.plans.engine import Engine


def _fk(c, t, r="id"):
    return ForeignKey((c,), t, (r,))


CATALOG = Catalog([
    Table("orgs", ("id",)),
    Table("users", ("id",), unique=(("org_id", "email"),), foreign=(_fk("org_id", "orgs"), _fk("boss_id", "users")), pii=("email",)),
    Table("posts", ("id",), foreign=(_fk("user_id", "users"),), json=("meta",)),
    Table("tags", ("id",)),
    Table("post_tags", ("post_id", "tag_id"), foreign=(_fk("post_id", "posts"), _fk("tag_id", "tags"))),
    Table("profiles", ("id",), unique=(("user_id",),), foreign=(_fk("user_id", "users"),)),
])
USERS = [(1, 1, None, "a@x", "Ann"), (2, 1, 1, "b@x", "Bob"), (3, 2, 1, "c@x", None), (4, None, 2, "d@x", "100%_x")]
POSTS = [(1, 1, "one", 5, '{"s":"x","n":1,"in":{"t":[1,2]}}'), (2, 1, "two", None, '{"s":null}'), (3, 2, "one", 7, None), (4, 3, "ONE_%", 2, '{"n":10}')]


@pytest.fixture(scope="module")
def engine(spark):
    make = spark.createDataFrame
    frames = {
        "orgs": make([(1, "o1"), (2, "o2"), (3, "empty")], "id long, name string"),
        "users": make(USERS, "id long, org_id long, boss_id long, email string, name string"),
        "posts": make(POSTS, "id long, user_id long, title string, views int, meta string"),
        "tags": make([(1, "t1"), (2, "t2")], "id long, name string"),
        "post_tags": make([(1, 1), (1, 2), (3, 1)], "post_id long, tag_id long"),
        "profiles": make([(1, 1, "bio")], "id long, user_id long, bio string"),
    }
    return Engine(spark, catalog=CATALOG, frames=frames)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ({"views": None}, [2]),
        ({"views": {"not": 5}}, [3, 4]),
        ({"views": {"not": None}}, [1, 3, 4]),
        ({"views": {"in": []}}, []),
        ({"views": {"notIn": []}}, [1, 2, 3, 4]),
        ({"views": {"notIn": [5, None]}}, []),
        ({"title": {"contains": "_%"}}, [4]),
        ({"title": {"startsWith": "one", "mode": "insensitive"}}, [1, 3, 4]),
        ({"OR": []}, [1, 2, 3, 4]),
        ({"OR": [{}, {"id": 1}]}, [1]),
        ({"NOT": {"views": {"gt": 5}}}, [1, 4]),
        ({"views": UNSET, "id": 3}, [3]),
        ({"views": {"gt": {"col": "id"}}}, [1, 3]),
        ({"meta": {"path": ["n"], "gte": 5}}, [4]),
        ({"meta": {"path": ["in", "t", 1], "equals": 2}}, [1]),
        ({"meta": {"contains": {"in": {"t": [2]}}}}, [1]),
        ({"meta": {"hasKey": "s"}}, [1, 2]),
        ({"users": {"is": {"name": "Ann"}}}, [1, 2]),
        ({"tags": {"some": {"name": "t2"}}}, [1]),
        ({"tags": {"none": {}}}, [2, 4]),
        ({"OR": [{"tags": {"some": {"name": "t1"}}}, {"id": 4}]}, [1, 3, 4]),
        ({"NOT": {"tags": {"some": {}}}}, [2, 4]),
    ],
)
def test_where(engine, where, want):
    key = {"users": "user"}
    assert ids(engine.table("posts").find_many(where={key.get(k, k): v for k, v in where.items()})) == want


def test_every_ignores_unknown_and_passes_childless(engine):
    assert ids(engine.table("users").find_many(where={"posts": {"every": {"views": {"gt": 4}}}})) == [1, 2, 4]
    assert ids(engine.table("users").find_many(where={"posts": {"every": {}}})) == [1, 2, 3, 4]
    assert ids(engine.table("users").find_many(where={"profile": None})) == [2, 3, 4]


def test_nested_reads(engine):
    spec = {"posts": {"orderBy": {"views": "desc"}, "limit": 1, "with": {"tags": True}}, "org": True, "profile": True}
    rows = {r["id"]: r for r in engine.table("users").find_many(orderBy={"id": "asc"}, **{"with": spec | {"_count": {"posts": True}}}).collect()}
    assert [p["id"] for p in rows[1]["posts"]] == [2]  # descending puts nulls first
    assert rows[4]["posts"] == [] and rows[4]["org"] is None and rows[1]["profile"]["bio"] == "bio" and rows[2]["profile"] is None
    assert [t["id"] for t in rows[2]["posts"][0]["tags"]] == [1]
    assert rows[1]["_count"]["posts"] == 2 and "email" not in rows[1].asDict()


def test_projection_and_guards(engine):
    users = engine.table("users")
    assert users.find_many(select={"email": True}).columns == ["email"]
    assert "email" in users.find_many(includePii=UNSAFE).columns
    for bad in ({"select": {"id": True}, "omit": {"id": True}}, {"includePii": True}, {"where": {"nope": 1}}, {"where": {"name": {"like": 1}}}, {"where": {"name": {}}}, {"limit": -1}, {"orderBy": {"id": "up"}}, {"odd": 1}):
        with pytest.raises(ValidationError):
            users.find_many(**bad)
    with pytest.raises(ValidationError):
        users.find_unique(where={"OR": []})
    with pytest.raises(NotFoundError):
        users.find_first_or_throw(where={"id": 99})
    with pytest.raises(ValidationError):
        users.group_by(by=["email"])
    assert ids(users.find_unique(where={"org_id_email": {"org_id": 1, "email": "b@x"}})) == [2]
    deep: dict = {}
    for _ in range(11):
        deep = {"user": {"with": deep}}
    with pytest.raises(DepthError, match="E007"):
        users.find_many(**{"with": deep})


def test_order_nulls_and_cursor(engine):
    posts = engine.table("posts")
    at = lambda **a: [r["id"] for r in posts.find_many(**a).collect()]
    assert at(orderBy={"views": "asc"})[-1] == 2 and at(orderBy={"views": "desc"})[0] == 2
    assert at(orderBy={"views": {"sort": "desc", "nulls": "last"}})[-1] == 2
    assert at(cursor={"id": 2}, limit=1) == [3] and at(cursor={"id": 3}, orderBy={"id": "desc"}) == [2, 1]
    assert at(distinct=["title"], orderBy={"title": "asc"}) == [4, 1, 2]
    assert at(orderBy=[{"user": {"org": {"name": "asc"}}}, {"id": "asc"}]) == [1, 2, 3, 4]


def test_writes(engine):
    posts = engine.table("posts")
    rows, hit = write.update_many(posts, {"id": {"lte": 2}}, {"views": {"divide": 2}})
    assert {r["id"]: r["views"] for r in rows.collect()} == {1: 2, 2: None, 3: 7, 4: 2} and hit.count() == 2
    rows, gone = write.delete_many(posts, {"views": {"gt": 4}})
    assert ids(rows) == [2, 4] and ids(gone) == [1, 3]
    with pytest.raises(ValidationError):
        write.delete_many(posts, {})
    with pytest.raises(OptimisticLockError):
        write.update(posts, {"id": 1}, {"title": "x"}, optimisticLock={"field": "views", "expected": 4})
    made, new = write.create_many(engine.table("tags"), [{"id": 2, "name": "no"}, {"id": 5, "name": "yes"}], skipDuplicates=True)
    assert ids(made) == [1, 2, 5] and ids(new) == [5]
    linked = write.link(engine, "post_tags", {"post_id": 1}, [{"tag_id": 2}], replace=True)
    assert sorted(map(tuple, linked.collect())) == [(1, 2), (3, 1)]
    before = engine.frames["tags"]
    with pytest.raises(RuntimeError), write.Staged(engine) as staged:
        staged.put("tags", made)
        raise RuntimeError
    assert engine.frames["tags"] is before


def test_global_filter_applies_everywhere(engine):
    scoped = Engine(engine.spark, catalog=CATALOG, frames=engine.frames, filters={"posts": {"views": {"gt": 4}}})
    rows = {r["id"]: r for r in scoped.table("users").find_many(**{"with": {"posts": True, "_count": {"posts": True}}}).collect()}
    assert [p["id"] for p in rows[1]["posts"]] == [1] and rows[1]["_count"]["posts"] == 1 and rows[3]["posts"] == []
    assert scoped.table("posts").find_many(skipGlobalFilters=UNSAFE).count() == 4


def _holds(row, where):
    """Three-valued truth by hand."""
    out = True
    for key, value in where.items():
        if key in ("AND", "OR"):
            parts = [_holds(row, w) for w in value]
            if not parts:
                continue
            if key == "AND":
                got = False if False in parts else None if None in parts else True
            else:
                got = True if True in parts else None if None in parts else False
        elif key == "NOT":
            got = _holds(row, value)
            got = None if got is None else not got
        else:
            (op, to), have = next(iter(value.items())), row[key]
            got = None if have is None else {"gt": lambda a, b: a > b, "lte": lambda a, b: a <= b, "not": lambda a, b: a != b, "in": lambda a, b: a in b}[op](have, to)
        out = False if out is False or got is False else None if out is None or got is None else True
    return out


def test_where_fuzz(engine):
    rnd = random.Random(11)

    def spec(depth):
        if depth and rnd.random() < 0.6:
            kind = rnd.choice(["AND", "OR", "NOT"])
            return {kind: spec(depth - 1)} if kind == "NOT" else {kind: [spec(depth - 1) for _ in range(rnd.randint(1, 2))]}
        op = rnd.choice(["gt", "lte", "not", "in"])
        return {rnd.choice(["views", "user_id"]): {op: [1, 5] if op == "in" else rnd.randint(0, 8)}}

    rows = [dict(zip(("id", "user_id", "title", "views", "meta"), p, strict=True)) for p in POSTS]
    for _ in range(25):
        where = spec(3)
        assert ids(engine.table("posts").find_many(where=where)) == [r["id"] for r in rows if _holds(r, where) is True], where


def test_names_of_relations():
    from quarryline.catalog import singular

    assert [singular(x) for x in ("posts", "categories", "ties", "boxes", "cases", "status", "glass", "quizzes", "fish")] == ["post", "category", "ty", "box", "cas", "statu", "glass", "quizz", "fish"]
    a, b = Table("as", ("id",)), Table("bs", ("id",))
    junction = {"foreign": (_fk("a_id", "as"), _fk("b_id", "bs"))}
    assert "bs" in Catalog([a, b, Table("ab", (), unique=(("b_id", "a_id"),), **junction)])["as"].relations
    assert "bs" not in Catalog([a, b, Table("ab", ("id",), unique=(("b_id", "a_id"),), **junction)])["as"].relations
    assert "bs" not in Catalog([a, b, Table("ab", ("a_id", "b_id"), columns=("a_id", "b_id", "rank"), **junction)])["as"].relations


def test_stream_middleware_explain(engine):
    own = Engine(engine.spark, catalog=CATALOG, frames=engine.frames)
    calls, events = [], []
    own.use(lambda call, go: (calls.append(("outer", call[0], call[1])), go())[1])
    own.use(lambda call, go: (calls.append(("inner", call[0], call[1])), go().where("id > 1"))[1])
    own.on_query(events.append)
    posts = own.table("posts")
    batches = list(posts.stream(batch=2, where={"views": {"not": None}}, **{"with": {"user": True}}))
    assert [len(b) for b in batches] == [2] and batches[0][0]["user"]["id"] == 2
    assert calls == [("outer", "posts", "find_many"), ("inner", "posts", "find_many")] and events == [{"table": "posts", "method": "find_many", "keys": ["where", "with"]}]
    assert any("Filter" in line for line in posts.explain(where={"views": 5}))


def test_pages_are_read_once(spark, tmp_path):
    for name, rows, schema in (("users", USERS, "id long, org_id long, boss_id long, email string, name string"), ("posts", POSTS, "id long, user_id long, title string, views int, meta string"), ("post_tags", [(1, 1), (3, 1)], "post_id long, tag_id long")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    own = Engine(spark, str(tmp_path), CATALOG)
    deep = {"with": {"posts": {"with": {"post_tags": True}}}}
    whole = own.table("users").find_many(where={"name": {"not": "x"}}, **deep)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 3 and "LeftSemi" not in plan and not own.pages
    page = own.table("users").find_many(limit=2, orderBy={"org_id": "asc"}, **deep)
    assert len(own.pages) == 2 and [len(r["posts"]) for r in page.collect()] == [2, 1]
    own.release()
    assert not own.pages


def test_order_holds_however_relations_are_joined(engine):
    """Joins that are not broadcast deal the page's rows out."""
    own, conf = Engine(engine.spark, catalog=CATALOG, frames=engine.frames), engine.spark.conf
    threshold = conf.get("spark.sql.autoBroadcastJoinThreshold")
    conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        at = lambda **args: [r["id"] for r in own.table("users").find_many(select={"id": True}, **args, **{"with": {"org": True, "posts": {"limit": 1}}}).collect()]
        for cut in ({}, {"limit": 4}, {"limit": 4, "offset": 0}):
            assert at(orderBy={"id": "desc"}, **cut) == [4, 3, 2, 1]
            assert at(orderBy={"name": "asc"}, **cut) == [4, 1, 2, 3]
            assert at(orderBy={"org": {"name": "desc"}}, **cut) == [4, 3, 1, 2]
            assert at(orderBy=[{"posts": {"_count": "asc"}}, {"id": "desc"}], **cut) == [4, 3, 2, 1]
        assert at(orderBy={"id": "desc"}, limit=2, offset=1) == [3, 2] and at(orderBy={"id": "desc"}, offset=1) == [3, 2, 1]
        assert at(distinct=["org_id"], orderBy={"email": "desc"}) == [4, 3, 2]
        rows = own.table("posts").find_many(orderBy={"meta": {"path": ["n"], "type": "numeric", "sort": "desc"}}, **{"with": {"user": True, "tags": True}}).collect()
        assert [r["id"] for r in rows] == [4, 1, 2, 3] and rows[0].asDict().keys() == {"id", "user_id", "title", "views", "meta", "user", "tags"}
    finally:
        conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        own.release()


def test_sql_and_pipeline(engine):
    own = Engine(engine.spark, catalog=CATALOG, frames=engine.frames)
    assert own.sql("SELECT id, name FROM tags WHERE id = :k", {"k": 2}).one()["name"] == "t2"
    assert own.sql("SELECT count(*) FROM tags").scalar() == 2 and own.sql("SELECT id FROM tags WHERE id > 9").scalar() is None
    assert own.sql("SELECT id FROM tags WHERE id > 9").one() is None and own.sql("SELECT id FROM tags").rows().count() == 2
    reads = [lambda: own.table("tags").count().first()[0], lambda: own.table("tags").find_first_or_throw(where={"id": 9})]
    with pytest.raises(PipelineError) as failed:
        own.pipeline(*reads)
    assert failed.value.results[0] == 2 and isinstance(failed.value.results[1], NotFoundError)
    partial = own.pipeline(*reads, transactional=False)
    assert partial[0] == 2 and isinstance(partial[1], NotFoundError)
    with pytest.raises(RelationError, match="E005"):
        own.table("users").find_many(**{"with": {"posts": {"with": {"_count": True}}}})


def test_personal_fields_stay_in(engine):
    users = engine.table("users")
    assert "email" not in write.update(users, {"id": 1}, {"name": "A"})[1] and "email" in write.update(users, {"id": 1}, {"name": "A"}, includePii=UNSAFE)[1]
    assert "email" not in write.delete(users, {"id": 2})[1]
    with pytest.raises(ValidationError):
        users.aggregate(_max={"email": True})
    assert users.aggregate(_max={"email": True}, includePii=UNSAFE).first()[0] == "d@x"
    with pytest.raises(ValidationError):
        users.search(filters=[{"column": "email", "op": "equals", "value": "a@x"}])
    assert ids(users.search("ann")) == [1] and users.search_total("a@x").first()[0] == 0
    with pytest.raises(ValidationError):
        users.group_by(by=["org_id"], _count=True, _max={"id": True}, _min={"id": True}, orderBy={"_sum": {"id": "asc"}})


def test_unique_rows_and_stages(engine):
    users = engine.table("users")
    rows = [{"id": 10, "org_id": 1, "email": "a@x"}, {"id": 11, "org_id": None, "email": "n"}, {"id": 12, "org_id": None, "email": "n"}, {"id": 13, "org_id": 2, "email": "new"}, {"id": 14, "org_id": 2, "email": "new"}]
    assert ids(write.create_many(users, rows, skipDuplicates=True)[1]) == [11, 12, 13]
    own = Engine(engine.spark, catalog=CATALOG, frames=engine.frames)
    with pytest.raises(TimeoutError_), write.Staged(own, timeout=0) as staged:
        staged.put("tags", own.base("tags").where("id = 1"))
    assert own.table("tags").count().first()[0] == 2
    with write.Staged(own) as outer:
        outer.put("tags", own.base("tags").where("id = 1"))
        with pytest.raises(RuntimeError), write.Staged(own) as inner:
            inner.put("tags", own.base("tags").where("id = 99"))
            raise RuntimeError
    assert ids(own.base("tags")) == [1]
    doubled = Engine(engine.spark, catalog=CATALOG, frames=engine.frames | {"users": engine.base("users").unionByName(engine.base("users").where("id = 1")), "profiles": engine.spark.createDataFrame([(1, 77, "x")], "id long, user_id long, bio string")})
    with pytest.raises(UniqueError, match="E008"):
        checks.enforce(doubled, "users")
    with pytest.raises(ForeignKeyError, match="E009"):
        checks.enforce(doubled, "profiles")
    checks.enforce(engine, "users")
    assert checks.introspected(engine)["users"]["relations"]["posts"]["kind"] == "many" and checks.advice(engine, 1 << 64) == []


def test_session_and_retry(engine):
    own = Engine(engine.spark, catalog=CATALOG, frames=engine.frames, filters={"posts": lambda context: {"user_id": context["user"]} if "user" in context else {}})
    assert ids(own.with_session(user=1).table("posts").find_many()) == [1, 2] and own.table("posts").count().first()[0] == 4
    assert [len(r["posts"]) for r in own.with_session(user=2).table("users").find_many(orderBy={"id": "asc"}, **{"with": {"posts": True}}).collect()] == [0, 1, 0, 0]
    kept = write.delete_many(own.with_session(user=2).table("posts"), {"id": {"gt": 0}})[0]
    assert ids(kept) == [1, 2, 4]
    with pytest.raises(ValidationError):
        own.with_session(**{"a b": 1})
    tried = []

    def fails(error):
        tried.append(1)
        if len(tried) < 3:
            raise error("x")
        return "done"

    assert Engine.retry(lambda: fails(TimeoutError_), wait=0.001) == "done"
    tried.clear()
    with pytest.raises(NotFoundError):
        Engine.retry(lambda: fails(NotFoundError), wait=0.001)
    assert len(tried) == 1


def test_update_of_nothing_gives_the_row(engine):
    rows, row = write.update(engine.table("posts"), {"id": 3}, {})
    assert row["title"] == "one" and sorted(map(tuple, rows.collect()), key=str) == sorted(POSTS, key=str)
