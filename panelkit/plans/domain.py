"""Domain views over the given tables, as DataFrames and as SQL for the counterparts.

docs: one row per order line, with the order as document, the supplier as person, the customer as firm, the part's
brand as class. moves: stable moves of suppliers between customers' market segments. panel_cy: customer x year with
zero rows for empty years; treated from the first year with an order above BIG.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import fill_counts
from ..operators.moves import stable_moves
from ..operators.stages import dealt, stage

FIRST, LAST, BIG = 1995, 2001, 480000
MOVE_ORDER = ["ship_date", "doc_id", "line", "part_id"]
#: What prices are summed as.
EXACT = "decimal(28,10)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    li, o = dealt(li, "l_orderkey"), dealt(o, "o_orderkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("person"),
        F.col("o_custkey").alias("firm"),
        F.to_date("o_orderdate").alias("filing_date"),
        F.year("o_orderdate").cast("long").alias("year"),
        F.to_date("l_shipdate").alias("ship_date"),
        F.col("p_brand").alias("class"),
        F.concat_ws("-", F.col("p_brand"), F.col("p_size").cast("string")).alias("grp"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_quantity").alias("qty"),
    )


DOCS = """docs AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS person, o_custkey AS firm,
         CAST(o_orderdate AS DATE) AS filing_date, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(l_shipdate AS DATE) AS ship_date,
         p_brand AS class, p_brand || '-' || p_size AS grp, l_extendedprice AS value, l_quantity AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def segment_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("firm"), F.col("c_mktsegment").alias("state"))
    return docs(spark, sf).join(c, "firm").withColumn("ship_year", F.year("ship_date").cast("long"))


SEGMENTS = DOCS + """, seg AS (
  SELECT docs.*, c_mktsegment AS state, CAST(year(ship_date) AS BIGINT) AS ship_year FROM docs JOIN customer ON firm = c_custkey)"""


def moves(spark: SparkSession, sf: str) -> DataFrame:
    got = stable_moves(segment_rows(spark, sf), "person", "state", MOVE_ORDER)
    return got.withColumn("move_year", F.year("ship_date").cast("long"))


def moves_and_rows(spark: SparkSession, sf: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Moves and segment rows (what moves need and the columns named), each written once: what uses both reads the base tables a single time."""
    rows = segment_rows(spark, sf)
    rows = stage(rows.select(*dict.fromkeys(["person", "state", *MOVE_ORDER, "ship_year", *columns])), "segment-rows")
    got = stable_moves(rows, "person", "state", MOVE_ORDER).withColumn("move_year", F.year("ship_date").cast("long"))
    return stage(got, "moves"), rows


MOVES = SEGMENTS + """, lagged AS (
  SELECT *, lag(state, 1) OVER w AS p1, lag(state, 2) OVER w AS p2, lead(state, 1) OVER w AS n1, lead(state, 2) OVER w AS n2,
         count(*) OVER (PARTITION BY person) AS n
  FROM seg WINDOW w AS (PARTITION BY person ORDER BY ship_date, doc_id, line, part_id)),
moves AS (
  SELECT person, ship_date, doc_id, line, part_id, p1 AS from_state, state AS to_state, CAST(year(ship_date) AS BIGINT) AS move_year
  FROM lagged WHERE n >= 5 AND state <> p1 AND p2 = p1 AND n1 = state AND n2 = n1
  QUALIFY row_number() OVER (PARTITION BY person, state, p1 ORDER BY ship_date, doc_id, line, part_id) = 1)"""


def _panel(spark: SparkSession, sf: str, roles: dict[str, str]) -> DataFrame:
    """panel_cy and the first years of the roles. Orders are summed to one row a customer, which is joined before its years are spelled out.

    Prices are summed as decimals: a sum of doubles hangs on their order by its last bits, and then customers with the
    same orders are not alike and ties between them not ties. The join is by sorting: files of customers are so small
    that Spark would send all of them to the driver and to every task.
    """
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("long").alias("y0"), "o_totalprice", *(["o_orderpriority"] if roles else []))
    years, exact, big = range(FIRST, LAST + 1), F.col("o_totalprice").try_cast(EXACT), F.col("o_totalprice") > BIG
    told, rest = F.sum(exact).cast("double"), F.sum(F.when(exact.isNull(), F.col("o_totalprice")))  # what no decimal holds is added as it is
    firsts = {"g": F.lit(True), **{f"g_{r}": F.expr(c) for r, c in roles.items()}}
    o = dealt(o.where("id IS NOT NULL"), "id").groupBy("id", "y0").agg(F.count("*").alias("n"), F.coalesce(told + rest, told, rest).alias("s"), *[F.bool_or(big & c).alias(n) for n, c in firsts.items()])
    sums = [f(F.when(F.col("y0") == y, F.col(x))).alias(f"{x}{y}") for y in years for x, f in (("n", F.max), ("s", F.max))]  # one row a year
    firsts = [F.min(F.when(F.col(n), F.col("y0"))).alias(n) for n in firsts]
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    wide = c.join(o.groupBy("id").agg(*sums, *firsts).hint("merge"), "id", "left")
    cell = F.explode(F.array(*[F.struct(F.lit(y).cast("long").alias("year"), F.col(f"n{y}").alias("n_orders"), F.col(f"s{y}").alias("spend")) for y in years]))
    names = ["g", *(f"g_{r}" for r in roles)]
    p = wide.select("id", "segment", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names], cell.alias("cell")).select("*", "cell.*")
    p, g = fill_counts(p, ["n_orders", "spend"]), F.col("g")
    return p.select(
        "id", "segment", "year", "n_orders", "spend", F.log1p("spend").alias("y"), F.col("n_orders").cast("double").alias("x"), "g",
        F.when(g > 0, F.col("year") - g).alias("k"), F.when((g > 0) & (F.col("year") >= g), 1).otherwise(0).cast("long").alias("d"), *names[1:],
    )


def panel_cy(spark: SparkSession, sf: str) -> DataFrame:
    """id, segment, year, n_orders, spend, y = ln(1 + spend), x (orders), g (first treated year, 0: never), k, d."""
    return _panel(spark, sf, {})


PANEL = f"""cells AS (
  SELECT o_custkey AS id, CAST(year(o_orderdate) AS BIGINT) AS year, count(*) AS n_orders, sum(o_totalprice) AS spend FROM orders GROUP BY ALL),
firsts AS (SELECT o_custkey AS id, CAST(min(year(o_orderdate)) AS BIGINT) AS g FROM orders WHERE o_totalprice > {BIG} GROUP BY 1),
panel AS (
  SELECT c_custkey AS id, c_mktsegment AS segment, t.year, coalesce(n_orders, 0) AS n_orders, coalesce(spend, 0) AS spend,
         ln(1 + coalesce(spend, 0)) AS y, CAST(coalesce(n_orders, 0) AS DOUBLE) AS x, coalesce(g, 0) AS g,
         CASE WHEN g > 0 THEN t.year - g END AS k, CASE WHEN g > 0 AND t.year >= g THEN 1 ELSE 0 END AS d
  FROM customer CROSS JOIN (SELECT CAST(unnest(range({FIRST}, {LAST + 1})) AS BIGINT) AS year) t
  LEFT JOIN cells ON cells.id = c_custkey AND cells.year = t.year LEFT JOIN firsts ON firsts.id = c_custkey)"""


#: Roles of a big order: by its priority. The overall cohort is panel's g.
ROLES = {"urgent": "o_orderpriority < '3'", "routine": "o_orderpriority >= '3'"}


def panel_roles(spark: SparkSession, sf: str) -> DataFrame:
    """panel_cy with g_urgent and g_routine, the first years with a big order of that kind (0: none), and s, a 0/1 trait."""
    return _panel(spark, sf, ROLES).withColumn("s", (F.col("segment") < "F").cast("double"))


PANEL_ROLES = PANEL + f""", role_first AS (SELECT o_custkey AS id, {", ".join(f"CAST(min(year(o_orderdate)) FILTER ({c}) AS BIGINT) AS g_{r}" for r, c in ROLES.items())} FROM orders WHERE o_totalprice > {BIG} GROUP BY 1),
panel_roles AS (SELECT panel.*, {", ".join(f"coalesce(g_{r}, 0) AS g_{r}" for r in ROLES)}, CAST(segment < 'F' AS DOUBLE) AS s FROM panel LEFT JOIN role_first USING (id))"""
