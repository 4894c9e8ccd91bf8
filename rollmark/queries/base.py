"""The shared tables in the roles that the operators need, as DataFrames and as SQL.

region is a branch, nation a component, customer an entity, order a record of an entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored


class Tables:
    #: The parts that give sizes and the orders that give designators in the given SQL.
    cheap, largest = "p_type = 'ECONOMY' AND p_name = 'red widget'", "o_totalprice > 400000"

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._dims = spark, sf_dir, None

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def entities(self) -> DataFrame:
        """soldier_id, component_id, branch, segment, balance."""
        return self.customer.join(F.broadcast(self.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(
            F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey")
        ).select(
            F.col("c_custkey").alias("soldier_id"), F.col("n_name").alias("component_id"), F.col("r_name").alias("branch"),
            F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
        )

    def rated(self) -> DataFrame:
        """The entities that the given SQL counts for thresholds."""
        return self.entities().where("balance > 5000")

    def earlier(self) -> DataFrame:
        """The entities of the old registry in the given SQL."""
        return self.entities().where("balance > 7000 AND component_id <> 'FRANCE'")

    def dims(self) -> DataFrame:
        """Designators: the nations and brands of a region, the segments of its customers, the sizes of
        cheap red widgets among its brands, and a post level that some regions have for themselves.
        A region has the five brands that its key stands for; regions differ in depth. The table is stored
        once, since what follows from it reads it many times."""
        if self._dims is None:
            self._dims = stored(self._designators())
        return self._dims

    def _designators(self) -> DataFrame:
        depth = (F.lit(3) + F.pmod(F.col("r_regionkey"), F.lit(3))).cast("int").alias("depth")
        region = F.broadcast(self.region)
        branch = F.col("r_name").alias("branch")
        level = lambda i, name, value: [branch, depth, F.lit(i).alias("level_idx"), name.alias("level"), value.alias("value")]
        nation = self.nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        segment = self.customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
        brand = self.part.join(region, F.floor((number - 1) / 5) == F.col("r_regionkey"))
        widget = brand.where(self.cheap)
        post = brand.where("r_name LIKE '%A'")
        return (
            nation.select(*level(0, F.lit("nation"), F.col("n_name")))
            .unionByName(segment.select(*level(1, F.lit("segment"), F.col("c_mktsegment"))))
            .unionByName(widget.select(*level(2, F.lit("size"), F.col("p_size").cast("string"))))
            .unionByName(brand.select(*level(3, F.lit("brand"), F.col("p_brand"))))
            .unionByName(post.select(*level(4, F.concat(F.lit("post_"), F.lower(F.substring("r_name", 1, 3))), F.expr("substring('ABC', p_size % 3 + 1, 1)"))))
            .distinct()
        )

    def component_designators(self) -> DataFrame:
        """component (nation), level, value: segments and priorities of its largest orders."""
        rows = self.orders.where(self.largest).join(self.entities(), F.col("o_custkey") == F.col("soldier_id"))
        segment = rows.select(F.col("component_id").alias("component"), F.lit("segment").alias("level"), F.col("segment").alias("value"))
        month = rows.select(F.col("component_id").alias("component"), F.lit("month").alias("level"), F.date_format("o_orderdate", "yyyy-MM").alias("value"))
        return segment.unionByName(month).distinct()


class Whole(Tables):
    """The same roles without the conditions by which the given SQL leaves rows out."""

    cheap = largest = "true"

    def rated(self) -> DataFrame:
        return self.entities()

    def earlier(self) -> DataFrame:
        """The registry's earlier state: the entities with an order before July 1995."""
        before = self.orders.where("o_orderdate < DATE '1995-07-01'").select(F.col("o_custkey").alias("soldier_id"))
        return self.entities().join(before, "soldier_id", "left_semi")


ENTITIES = """entities AS (
  SELECT c_custkey AS soldier_id, n_name AS component_id, r_name AS branch, c_mktsegment AS segment, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

DIMS = """branded AS (
  SELECT r_name, r_regionkey, p_size, p_type, p_name, p_brand FROM part JOIN region ON (CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) - 1) // 5 = r_regionkey
), dims AS (
  SELECT r_name AS branch, 3 + r_regionkey % 3 AS depth, 0 AS level_idx, 'nation' AS level, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT r_name, 3 + r_regionkey % 3, 1, 'segment', c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION SELECT r_name, 3 + r_regionkey % 3, 2, 'size', CAST(p_size AS VARCHAR) FROM branded WHERE p_type = 'ECONOMY' AND p_name = 'red widget'
  UNION SELECT r_name, 3 + r_regionkey % 3, 3, 'brand', p_brand FROM branded
  UNION SELECT r_name, 3 + r_regionkey % 3, 4, 'post_' || lower(substring(r_name, 1, 3)), substring('ABC', p_size % 3 + 1, 1) FROM branded WHERE r_name LIKE '%A'
)"""

DESIGNATORS = f"""{ENTITIES}, designators AS (
  SELECT component_id AS component, 'segment' AS level, segment AS value FROM orders JOIN entities ON o_custkey = soldier_id WHERE o_totalprice > 400000
  UNION SELECT component_id, 'month', strftime(o_orderdate, '%Y-%m') FROM orders JOIN entities ON o_custkey = soldier_id WHERE o_totalprice > 400000
), edges AS (
  SELECT a.component AS comp_a, b.component AS comp_b, a.level, a.value
  FROM designators a JOIN designators b ON a.level = b.level AND a.value = b.value AND a.component < b.component
)"""


def joined(column, separator: str = ","):
    return F.array_join(column, separator)
