"""Queries over the whole tables leave no rows out."""

import __spark_entry__
from rollmark import registry
from rollmark.queries.base import Whole

from .test_queries import DATA, duck, pytestmark  # noqa: F401


def test_thresholds_count_all_entities(spark, duck):  # noqa: F811
    wanted = dict(duck.sql("SELECT n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name").fetchall())
    for frame in (registry.QUERIES["component_thresholds_whole"](spark, DATA), __spark_entry__.entry(spark)):
        assert {r["component_id"]: r["n_entities"] for r in frame.collect()} == wanted
    registered = registry.QUERIES["registry_entries_whole"](spark, DATA).collect()
    assert {r["component_id"]: r["sample_size"] for r in registered} == wanted
    assert {r["component"]: r["sample_size"] for r in registry.QUERIES["resolver_artifact_whole"](spark, DATA).collect()} == wanted


def test_old_registry_has_an_earlier_state(spark, duck):  # noqa: F811
    wanted = duck.sql("SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < DATE '1995-07-01'").fetchall()
    assert sorted(r["soldier_id"] for r in Whole(spark, DATA).earlier().collect()) == sorted(x for (x,) in wanted)
    assert registry.QUERIES["rebuild_candidates_whole"](spark, DATA).count() > 0


def test_designators_come_from_all_orders_and_parts(spark, duck):  # noqa: F811
    orders = "SELECT DISTINCT n_name, strftime(o_orderdate, '%Y-%m') FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    found = Whole(spark, DATA).component_designators().where("level = 'month'").select("component", "value")
    assert sorted(map(tuple, found.collect())) == sorted(duck.sql(orders).fetchall())
    sizes = "SELECT DISTINCT r_name, CAST(p_size AS VARCHAR) FROM part JOIN region ON (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) - 1) // 5 = r_regionkey"
    found = Whole(spark, DATA).dims().where("level = 'size'").select("branch", "value")
    assert sorted(map(tuple, found.collect())) == sorted(duck.sql(sizes).fetchall())


def test_no_condition_of_the_given_sql_is_left():
    whole = [registry.ORACLES[name] for name in registry.ORACLES if name.endswith("_whole")]
    assert whole and not any(word in sql for sql in whole for word in ("balance >", "o_totalprice >", "red widget", "FRANCE"))


def test_collisions_cover_all_orders(spark):
    given, whole = (registry.QUERIES[f"component_collisions{end}"](spark, DATA).collect() for end in ("", "_whole"))
    assert sum(len(r["members"].split(",")) for r in whole) > sum(len(r["members"].split(",")) for r in given)
