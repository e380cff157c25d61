from __future__ import annotations

import pytest
from quarryline.errors import NotFoundError, UnsupportedError, ValidationError
from quarryline.operators import nested_write as nw
from quarryline.operators.compat import translated
from quarryline.plans.engine import Engine
from test_engine import CATALOG, POSTS, USERS


@pytest.fixture
def engine(spark):
    make = spark.createDataFrame
    return Engine(spark, catalog=CATALOG, frames={
        "orgs": make([(1, "o1")], "id long, name string"),
        "users": make(USERS, "id long, org_id long, boss_id long, email string, name string"),
        "posts": make(POSTS, "id long, user_id long, title string, views int, meta string"),
        "tags": make([(1, "t1"), (2, "t2")], "id long, name string"),
        "post_tags": make([(1, 1), (1, 2)], "post_id long, tag_id long"),
        "profiles": make([(1, 1, "bio")], "id long, user_id long, bio string"),
    })


def test_create_with_relations(engine):
    row = nw.create(engine, "users", {"name": "New", "org": {"create": {"name": "o9"}}, "posts": {"create": [{"title": "a"}, {"title": "b"}], "connect": [{"id": 4}]}})
    assert row["id"] == 5 and row["org_id"] == 2
    assert sorted(r["id"] for r in engine.table("posts").find_many(where={"user_id": 5}).collect()) == [4, 5, 6]


def test_children_in_one_change(engine):
    row = nw.create(engine, "users", {"name": "Many", "posts": {"create": [{"title": f"t{k}", "views": k} for k in range(40)]}})
    assert "email" not in row
    assert engine.table("posts").count({"user_id": row["id"]}).first()[0] == 40
    assert engine.base("posts")._jdf.queryExecution().analyzed().toString().count("Union") == 1  # one layer for all of them


def test_scoped_connect(engine):
    scoped = Engine(engine.spark, catalog=CATALOG, frames=engine.frames, scoped_connect=True)
    with pytest.raises(ValidationError):
        nw.update(scoped, "users", {"id": 2}, {"posts": {"connect": {"id": 1}}})
    nw.update(engine, "users", {"id": 2}, {"posts": {"connect": {"id": 1}}})
    assert engine.table("posts").find_unique(where={"id": 1}).first()["user_id"] == 2


def test_update_relations(engine):
    nw.update(engine, "posts", {"id": 1}, {"views": {"increment": 1}, "user": {"connect": {"id": 3}}, "tags": {"set": [{"id": 2}]}})
    post = engine.table("posts").find_unique(where={"id": 1}).first()
    assert (post["views"], post["user_id"]) == (6, 3)
    assert [tuple(r) for r in engine.base("post_tags").collect()] == [(1, 2)]
    nw.update(engine, "users", {"id": 1}, {"posts": {"disconnect": [{"id": 2}]}})
    assert engine.table("posts").find_unique(where={"id": 2}).first()["user_id"] is None


def test_failure_changes_nothing(engine):
    before = dict(engine.frames)
    with pytest.raises(NotFoundError):
        nw.create(engine, "users", {"name": "x", "posts": {"create": {"title": "t"}, "connect": {"id": 99}}})
    assert engine.frames == before
    with pytest.raises(ValidationError):
        nw.update(engine, "posts", {"id": 1}, {"tags": {"create": {"name": "n"}}})


def test_other_spellings(engine):
    posts = engine.table("posts")
    at = lambda **a: [r["id"] for r in posts.find_many(**translated(posts.meta, a)).collect()]
    assert at(cursor={"id": 2}, take=2) == [2, 3] and at(cursor={"id": 2}, skip=1, take=2) == [3, 4] and at(skip=1, take=1) == [2]
    with pytest.raises(UnsupportedError):
        at(take=-1)


def test_other_spellings_of_relations(engine):
    users = engine.table("users")
    args = {"select": {"name": True, "posts": {"take": 1, "orderBy": {"id": "desc"}, "include": {"tags": True}}, "_count": {"select": {"posts": True}}}, "orderBy": {"id": "asc"}, "distinct": "name"}
    rows = users.find_many(**translated(users.meta, args, engine.catalog)).collect()
    first = next(r for r in rows if r["name"] == "Ann")
    assert [p["id"] for p in first["posts"]] == [2] and first["_count"]["posts"] == 2 and set(first.asDict()) == {"name", "posts", "_count"}
    with pytest.raises(UnsupportedError):
        translated(users.meta, {"include": {"posts": {"skip": 1}}}, engine.catalog)
    with pytest.raises(ValidationError):
        translated(users.meta, {"include": {"nope": {"take": 1}}}, engine.catalog)
