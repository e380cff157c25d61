"""Registered queries of the engine, each beside its reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline import showcase_more
from quarryline.operators import write
from quarryline.plans.engine import Engine
from quarryline.streaming.rollup import minute_rollup

OCOLS = "o_orderkey, o_custkey, o_totalprice"
OSEL = {"o_orderkey": True, "o_custkey": True, "o_totalprice": True}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their three dearest orders, nested, and how many they have."""
    return Engine(spark, sf_dir).table("customer").find_many(
        orderBy={"c_acctbal": "desc"}, limit=100,
        **{"with": {"nation": True, "orders": {"orderBy": {"o_totalprice": "desc"}, "limit": 3, "with": {"lineitem": {"orderBy": {"l_linenumber": "asc"}, "limit": 5}}}, "_count": {"orders": True}}},
    )


def _orders(**args) -> Callable[[Engine], DataFrame]:
    return lambda e: e.table("orders").find_many(select=OSEL, **args)


def _of(table: str, select: list[str], **args) -> Callable[[Engine], DataFrame]:
    return lambda e: e.table(table).find_many(select=dict.fromkeys(select, True), **args)


def _flat(df: DataFrame, array: str, keep: list[str], fields: dict[str, str]) -> DataFrame:
    return df.select(*keep, F.explode(array).alias("_x")).select(*keep, *[F.col(f"_x.{f}").alias(n) for f, n in fields.items()])


def _with(table: str, relation: str, spec: object, keep: list[str], fields: dict[str, str], **args) -> Callable[[Engine], DataFrame]:
    return lambda e: _flat(e.table(table).find_many(**{"with": {relation: spec}}, **args), relation, keep, fields)


def _group(table: str, **args) -> Callable[[Engine], DataFrame]:
    return lambda e: e.table(table).group_by(**args)


def _nested3(e: Engine) -> DataFrame:
    df = e.table("customer").find_many(where={"c_mktsegment": "BUILDING"}, **{"with": {"orders": {"where": {"o_orderstatus": "F"}, "with": {"lineitem": {"where": {"l_quantity": {"gt": 40}}}}}}})
    orders = _flat(df, "orders", ["c_custkey"], {"o_orderkey": "o_orderkey", "lineitem": "lineitem"})
    return _flat(orders, "lineitem", ["c_custkey", "o_orderkey"], {"l_partkey": "l_partkey", "l_quantity": "l_quantity"})


def _to_one(e: Engine) -> DataFrame:
    df = e.table("orders").find_many(where={"o_totalprice": {"gt": 200000}}, **{"with": {"customer": {"with": {"nation": True}}}})
    return df.select("o_orderkey", F.col("customer.c_name").alias("c_name"), F.col("customer.nation.n_name").alias("n_name"))


def _has_one(e: Engine) -> DataFrame:
    return e.table("documents").find_many(select={"doc_id": True}, **{"with": {"label": True}}).select("doc_id", F.col("label.toxic").alias("toxic"))


def _counts(e: Engine) -> DataFrame:
    return e.table("nation").find_many(select={"n_nationkey": True}, **{"with": {"_count": True}}).select("n_nationkey", F.col("_count.customer").alias("customers"), F.col("_count.supplier").alias("suppliers"))


def _knn(metric: str) -> Callable[[Engine], DataFrame]:
    target = [((7 * k) % 13 - 6) / 10 for k in range(64)]

    def run(e: Engine) -> DataFrame:
        from quarryline.functions.predicate import distance

        df = e.table("embeddings").find_many(orderBy=[{"embedding": {"distance": {"to": target, "metric": metric}}}, {"vec_id": "asc"}], limit=10)
        return df.select("vec_id", F.round(distance(F.col("embedding"), target, metric), 4).alias("d"))

    return run


def _knn_sql(expression: str) -> str:
    target = "[" + ", ".join(str(((7 * k) % 13 - 6) / 10) for k in range(64)) + "]::DOUBLE[]"
    d = expression.format(v="embedding::DOUBLE[]", t=target)
    return f"SELECT vec_id, round({d}, 4) AS d FROM embeddings ORDER BY {d}, vec_id LIMIT 10"


def _written(change: Callable[[Engine], DataFrame], columns: list[str]) -> Callable[[Engine], DataFrame]:
    return lambda e: change(e).select(*columns)


def _created(e: Engine) -> DataFrame:
    rows = [{"r_regionkey": 2, "r_name": "again"}, {"r_regionkey": 77, "r_name": "new"}, {"r_regionkey": 77, "r_name": "new"}]
    return write.create_many(e.table("region"), rows, skipDuplicates=True)[0]


def _merged(e: Engine) -> DataFrame:
    base = e.base("supplier")
    rows = base.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.lit(1.5)).unionByName(base.where("s_suppkey = 1").withColumn("s_suppkey", F.lit(10_000_000).cast("bigint")))
    return write.upsert(e.table("supplier"), rows, ["s_suppkey"], ["s_acctbal"])


def _filtered(e: Engine) -> DataFrame:
    scoped = Engine(e.spark, e.folder, filters={"orders": {"o_orderstatus": "F"}, "customer": {"c_acctbal": {"gt": 0}}})
    df = scoped.table("nation").find_many(where={"customer": {"some": {"orders": {"some": {"o_totalprice": {"gt": 300000}}}}}}, select={"n_nationkey": True}, **{"with": {"_count": {"customer": True}}})
    return df.select("n_nationkey", F.col("_count.customer").alias("customers"))


def _raw(e: Engine) -> DataFrame:
    return e.raw("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > :least GROUP BY o_orderstatus", {"least": 100000})


def _searched(e: Engine) -> DataFrame:
    return e.table("part").search("an", ["p_name", "p_type"], limit=200).select("p_partkey")


PAIR = "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem"
QUERIES: dict[str, tuple[Callable[[Engine], DataFrame], str]] = {
    "where_eq": (_orders(where={"o_orderstatus": "F"}), f"SELECT {OCOLS} FROM orders WHERE o_orderstatus = 'F'"),
    "where_not": (_orders(where={"o_orderstatus": {"not": "F"}}), f"SELECT {OCOLS} FROM orders WHERE o_orderstatus <> 'F'"),
    "where_range": (_orders(where={"o_totalprice": {"gte": 1000, "lt": 50000}}), f"SELECT {OCOLS} FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000"),
    "where_in": (_orders(where={"o_orderpriority": {"in": ["1-URGENT", "2-HIGH"]}}), f"SELECT {OCOLS} FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "where_notin": (_orders(where={"o_orderpriority": {"notIn": ["1-URGENT"]}}), f"SELECT {OCOLS} FROM orders WHERE o_orderpriority NOT IN ('1-URGENT')"),
    "where_contains": (_of("part", ["p_partkey"], where={"p_name": {"contains": "ed"}}), "SELECT p_partkey FROM part WHERE contains(p_name, 'ed')"),
    "where_startswith": (_of("part", ["p_partkey"], where={"p_type": {"startsWith": "S"}}), "SELECT p_partkey FROM part WHERE starts_with(p_type, 'S')"),
    "where_endswith": (_of("part", ["p_partkey"], where={"p_name": {"endsWith": "e"}}), "SELECT p_partkey FROM part WHERE ends_with(p_name, 'e')"),
    "where_icontains": (_of("part", ["p_partkey"], where={"p_brand": {"contains": "BRAND#1", "mode": "insensitive"}}), "SELECT p_partkey FROM part WHERE contains(lower(p_brand), 'brand#1')"),
    "where_colref": (_of("lineitem", ["l_orderkey", "l_partkey"], where={"l_suppkey": {"gt": {"col": "l_linenumber"}}}), "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_suppkey > l_linenumber"),
    "where_and_or_not": (_orders(where={"OR": [{"o_orderstatus": "F"}, {"o_totalprice": {"gt": 100000}}], "NOT": {"o_orderpriority": "1-URGENT"}}), f"SELECT {OCOLS} FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT o_orderpriority = '1-URGENT'"),
    "where_or_empty": (_orders(where={"OR": [], "o_custkey": {"lt": 50}}), f"SELECT {OCOLS} FROM orders WHERE o_custkey < 50"),
    "where_compound_unique": (lambda e: e.table("conversations").find_unique(where={"conv_id_turn": {"conv_id": 3, "turn": 1}}).select("conv_id", "turn", "role"), "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 1 LIMIT 1"),
    "order_limit": (_orders(orderBy=[{"o_totalprice": "desc"}, {"o_orderkey": "asc"}], limit=20), f"SELECT {OCOLS} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "order_offset": (_orders(orderBy={"o_orderkey": "asc"}, limit=15, offset=30), f"SELECT {OCOLS} FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 30"),
    "order_nulls": (_orders(orderBy=[{"o_custkey": {"sort": "desc", "nulls": "last"}}, {"o_orderkey": "asc"}], take=12), f"SELECT {OCOLS} FROM orders ORDER BY o_custkey DESC NULLS LAST, o_orderkey LIMIT 12"),
    "cursor_asc": (_orders(cursor={"o_orderkey": 100}, limit=10), f"SELECT {OCOLS} FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 10"),
    "cursor_desc": (_orders(cursor={"o_orderkey": 500}, orderBy={"o_orderkey": "desc"}, limit=10), f"SELECT {OCOLS} FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 10"),
    "distinct_pick": (_orders(distinct=["o_custkey"], orderBy={"o_totalprice": "desc"}), f"SELECT {OCOLS} FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "find_first": (lambda e: e.table("orders").find_first(where={"o_orderstatus": "O"}, orderBy={"o_orderkey": "desc"}).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 1"),
    "find_unique": (lambda e: e.table("orders").find_unique(where={"o_orderkey": 7}).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7 LIMIT 1"),
    "omit_columns": (lambda e: e.table("nation").find_many(omit={"n_name": True}), "SELECT n_nationkey, n_regionkey FROM nation"),
    "grid_search": (_searched, "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an') ORDER BY p_partkey LIMIT 200"),
    "raw_sql": (_raw, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus"),
    "count_where": (lambda e: e.table("lineitem").count(where={"l_returnflag": "R"}), "SELECT count(*) AS count FROM lineitem WHERE l_returnflag = 'R'"),
    "agg_all": (lambda e: e.table("orders").aggregate(_count=True, _sum={"o_totalprice": True}, _avg={"o_totalprice": True}, _min={"o_orderkey": True}, _max={"o_orderpriority": True}).select("_count", F.round("_sum_o_totalprice", 2).alias("_sum_o_totalprice"), F.round("_avg_o_totalprice", 4).alias("_avg_o_totalprice"), "_min_o_orderkey", "_max_o_orderpriority"), "SELECT count(*) AS _count, round(sum(o_totalprice), 2) AS _sum_o_totalprice, round(avg(o_totalprice), 4) AS _avg_o_totalprice, min(o_orderkey) AS _min_o_orderkey, max(o_orderpriority) AS _max_o_orderpriority FROM orders"),
    "agg_count_fields": (lambda e: e.table("events").aggregate(_count={"_all": True, "value": True}), "SELECT count(*) AS _count_all, count(value) AS _count_value FROM events"),
    "groupby_basic": (_group("orders", by=["o_orderstatus"]), "SELECT o_orderstatus, count(*) AS _count FROM orders GROUP BY o_orderstatus"),
    "groupby_multi": (_group("lineitem", by=["l_returnflag", "l_linestatus"], _count=True, _max={"l_quantity": True}, _min={"l_shipdate": True}), "SELECT l_returnflag, l_linestatus, count(*) AS _count, max(l_quantity) AS _max_l_quantity, min(l_shipdate) AS _min_l_shipdate FROM lineitem GROUP BY ALL"),
    "groupby_having_count": (_group("orders", by=["o_custkey"], having={"_count": {"gte": 15}}), "SELECT o_custkey, count(*) AS _count FROM orders GROUP BY o_custkey HAVING count(*) >= 15"),
    "groupby_having_sum": (_group("orders", by=["o_custkey"], having={"o_totalprice": {"_sum": {"gt": 1000000}}}), "SELECT o_custkey, count(*) AS _count FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000"),
    "groupby_having_key": (_group("orders", by=["o_orderpriority"], having={"o_orderpriority": {"in": ["1-URGENT", "5-LOW"]}}), "SELECT o_orderpriority, count(*) AS _count FROM orders GROUP BY 1 HAVING o_orderpriority IN ('1-URGENT', '5-LOW')"),
    "groupby_having_not": (_group("orders", by=["o_custkey"], having={"NOT": {"_count": {"lt": 12}}, "OR": [{"o_totalprice": {"_max": {"gt": 100000}}}, {"o_custkey": {"lt": 20}}]}), "SELECT o_custkey, count(*) AS _count FROM orders GROUP BY 1 HAVING NOT count(*) < 12 AND (max(o_totalprice) > 100000 OR o_custkey < 20)"),
    "groupby_order_agg": (_group("lineitem", by=["l_suppkey"], _max={"l_quantity": True}, _count=True, orderBy=[{"_count": "desc"}, {"l_suppkey": "asc"}], limit=7), "SELECT l_suppkey, count(*) AS _count, max(l_quantity) AS _max_l_quantity FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7"),
    "groupby_topn": (_group("events", by=["user_id"], orderBy=[{"_count": "desc"}, {"user_id": "asc"}], limit=10, offset=5), "SELECT user_id, count(*) AS _count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 5"),
    "groupby_json_key": (_group("events", by=[{"field": "props", "path": ["k"], "alias": "k"}]), "SELECT json_extract_string(props, '$.k') AS k, count(*) AS _count FROM events GROUP BY 1"),
    "groupby_json_target": (lambda e: e.table("events").group_by(by=["event_type"], _sum={"k": {"field": "props", "path": ["k"]}}).withColumn("_sum_k", F.col("_sum_k").cast("double")), "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS DECIMAL(28, 10)))::DOUBLE AS _sum_k FROM events GROUP BY 1"),
    "groupby_distinct_on": (_group("orders", by=["o_orderstatus"], distinctOn={"fields": ["o_custkey"], "orderBy": {"o_orderdate": "desc"}}), "SELECT o_orderstatus, count(*) AS _count FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1) GROUP BY 1"),
    "rel_some": (_of("customer", ["c_custkey"], where={"orders": {"some": {"o_totalprice": {"gt": 400000}}}}), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "rel_none": (_of("customer", ["c_custkey"], where={"orders": {"none": {"o_orderstatus": "P"}}}), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    "rel_every": (_of("customer", ["c_custkey"], where={"orders": {"every": {"o_totalprice": {"gt": 5000}}}}), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > 5000)"),
    "rel_is": (_of("nation", ["n_nationkey"], where={"region": {"is": {"r_regionkey": {"lt": 2}}}}), "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_regionkey < 2)"),
    "rel_isnot": (_of("nation", ["n_nationkey"], where={"region": {"isNot": {"r_regionkey": 1}}}), "SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_regionkey = 1)"),
    "rel_m2m_some": (_of("orders", ["o_orderkey"], where={"parts": {"some": {"p_size": {"gt": 45}}}}), "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size > 45)"),
    "rel_nested_some": (_of("nation", ["n_nationkey"], where={"customer": {"some": {"orders": {"some": {"lineitem": {"none": {"l_returnflag": "R"}}}}}}}), "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))"),
    "rel_some_under_or": (_of("customer", ["c_custkey"], where={"OR": [{"c_acctbal": {"lt": 0}}, {"orders": {"some": {"o_totalprice": {"gt": 450000}}}}]}), "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)"),
    "with_has_many": (_with("customer", "orders", True, ["c_custkey"], {"o_orderkey": "o_orderkey"}), "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey"),
    "with_belongs_to": (_to_one, "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000"),
    "with_has_one": (_has_one, "SELECT d.doc_id, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "with_m2m": (_with("orders", "parts", {"select": {"p_partkey": True}}, ["o_orderkey"], {"p_partkey": "p_partkey"}), f"SELECT o_orderkey, p_partkey FROM orders JOIN ({PAIR}) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey"),
    "with_nested_l3": (_nested3, "SELECT c_custkey, o_orderkey, l_partkey, l_quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND l_quantity > 40"),
    "with_limit_per_parent": (_with("customer", "orders", {"orderBy": {"o_totalprice": "desc"}, "limit": 2}, ["c_custkey"], {"o_orderkey": "o_orderkey"}), "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "with_where": (_with("nation", "supplier", {"where": {"s_acctbal": {"gt": 0}}}, ["n_nationkey"], {"s_suppkey": "s_suppkey"}), "SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 0"),
    "rel_count": (_counts, "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation"),
    "order_by_rel_count": (_of("customer", ["c_custkey"], orderBy=[{"orders": {"_count": "desc"}}, {"c_custkey": "asc"}], limit=10), "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY coalesce(n, 0) DESC, c_custkey LIMIT 10"),
    "order_by_to_one": (_of("orders", ["o_orderkey"], orderBy=[{"customer": {"c_acctbal": "desc"}}, {"o_orderkey": "asc"}], limit=10), "SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY c_acctbal DESC NULLS FIRST, o_orderkey LIMIT 10"),
    "order_by_chain": (_of("orders", ["o_orderkey"], orderBy=[{"customer": {"nation": {"n_name": "asc"}}}, {"o_orderkey": "asc"}], limit=10), "SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey ORDER BY n_name ASC NULLS LAST, o_orderkey LIMIT 10"),
    "order_by_pick": (_of("customer", ["c_custkey"], orderBy=[{"orders": {"pick": {"orderBy": {"o_orderdate": "desc"}}, "by": "o_totalprice", "sort": "desc"}}, {"c_custkey": "asc"}], limit=10), "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1) ON o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS LAST, c_custkey LIMIT 10"),
    "json_path_eq": (_of("events", ["event_id"], where={"props": {"path": ["k"], "equals": 3}}), "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '3'"),
    "json_range": (_of("events", ["event_id"], where={"props": {"path": ["k"], "gte": 10, "lt": 20}}), "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 10 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) < 20"),
    "json_has_key": (_of("events", ["event_id"], where={"props": {"hasKey": "k"}}), "SELECT event_id FROM events WHERE list_contains(json_keys(props), 'k')"),
    "json_contains": (_of("events", ["event_id"], where={"props": {"contains": {"k": 5}}}), "SELECT event_id FROM events WHERE json_contains(props, '{\"k\": 5}')"),
    "json_string_contains": (_of("events", ["event_id"], where={"props": {"path": ["k"], "stringContains": "7"}}), "SELECT event_id FROM events WHERE contains(json_extract_string(props, '$.k'), '7')"),
    "json_order": (_of("events", ["event_id"], orderBy=[{"props": {"path": ["k"], "type": "numeric", "sort": "desc"}}, {"event_id": "asc"}], limit=10), "SELECT event_id FROM events ORDER BY CAST(json_extract_string(props, '$.k') AS DOUBLE) DESC NULLS LAST, event_id LIMIT 10"),
    "vector_l2_knn": (_knn("l2"), _knn_sql("list_distance({v}, {t})")),
    "vector_cosine_knn": (_knn("cosine"), _knn_sql("list_cosine_distance({v}, {t})")),
    "vector_ip_filter": (_of("embeddings", ["vec_id"], where={"embedding": {"distance": {"to": [0.1] * 64, "metric": "ip", "lt": -0.05}}}), "SELECT vec_id FROM embeddings WHERE -list_inner_product(embedding::DOUBLE[], [0.1 FOR i IN range(64)]::DOUBLE[]) < -0.05"),
    "text_search_simple": (_of("documents", ["doc_id"], where={"text": {"search": "the & !de"}}), "SELECT doc_id FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'the') AND NOT list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'de')"),
    "global_filter": (_filtered, "SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS customers FROM nation WHERE EXISTS (SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey AND c_acctbal > 0 AND o_orderstatus = 'F' AND o_totalprice > 300000)"),
    "update_increment": (_written(lambda e: write.update_many(e.table("part"), {"p_size": {"gt": 40}}, {"p_size": {"increment": 5}})[0], ["p_partkey", "p_size"]), "SELECT p_partkey, CASE WHEN p_size > 40 THEN p_size + 5 ELSE p_size END::INT AS p_size FROM part"),
    "update_divide_int": (_written(lambda e: write.update_many(e.table("part"), {"p_partkey": {"lte": 100}}, {"p_size": {"divide": 4}})[0], ["p_partkey", "p_size"]), "SELECT p_partkey, CASE WHEN p_partkey <= 100 THEN p_size // 4 ELSE p_size END::INT AS p_size FROM part"),
    "delete_many": (_written(lambda e: write.delete_many(e.table("orders"), {"lineitem": {"none": {}}})[0], ["o_orderkey"]), "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "upsert_merge": (_written(_merged, ["s_suppkey", "s_acctbal"]), "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 1.5 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT 10000000, s_acctbal FROM supplier WHERE s_suppkey = 1"),
    "create_many_skip_dups": (_created, "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'new'"),
    "minute_rollup": (lambda e: minute_rollup(e.base("events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6)), "SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1, 2"),
}


QUERIES |= showcase_more.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, run=run: run(Engine(spark, sf_dir))) for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
