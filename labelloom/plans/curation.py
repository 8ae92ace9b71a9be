"""Dataset curation on the order tables: a nation is a dataset, an order status its part, a part type a cell type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import token_count
from labelloom.operators import curation as op
from labelloom.plans.registry import Tables, query

CFG = op.Curation(
    least_rows=1, most_rows=10_000_000, least_types=2, most_tissues=3, most_diseases=5, exclude_diseases=("5-urgent!",), exclude_titles=("iran", "iraq"),
    exclude_collections=("antarctica",), prefer=("united", "an"), per_tissue=3, least_selected=8, most_selected=12)
TARGETS = ["F", "O", "P"]


def obs(t: Tables) -> DataFrame:
    """One row a line item, with the columns of an observation."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    places = t.customer.select("c_custkey", "c_nationkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    parts = t.part.select("p_partkey", "p_type")
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(places, F.col("o_custkey") == F.col("c_custkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("n_name").alias("dataset_id"), F.col("o_orderstatus").alias("tissue_general"), F.col("l_returnflag").alias("tissue"),
        F.col("o_orderpriority").alias("disease"), F.col("p_type").alias("cell_type"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cell_id"))


OBS = """obs AS (
  SELECT n_name AS dataset_id, o_orderstatus AS tissue_general, l_returnflag AS tissue, o_orderpriority AS disease, p_type AS cell_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
STATS = OBS + """, partial AS (
  SELECT dataset_id, tissue_general, count(*) AS n_rows, count(DISTINCT cell_type) AS n_types FROM obs GROUP BY ALL
), stats AS (
  SELECT p.dataset_id, CAST(sum(n_rows) AS BIGINT) AS n_rows, max(n_types) AS n_types, x.tissues, x.diseases, x.n_tissues, x.n_diseases
  FROM partial p JOIN (
    SELECT dataset_id, string_agg(DISTINCT tissue, ';' ORDER BY tissue) AS tissues, string_agg(DISTINCT disease, ';' ORDER BY disease) AS diseases,
      count(DISTINCT tissue) AS n_tissues, count(DISTINCT disease) AS n_diseases FROM obs GROUP BY dataset_id) x USING (dataset_id)
  GROUP BY ALL
), titled AS (
  SELECT s.*, n_name AS title, r_name AS collection FROM stats s LEFT JOIN nation ON dataset_id = n_name LEFT JOIN region ON n_regionkey = r_regionkey
)"""


def partial(t: Tables) -> DataFrame:
    return op.partial_stats(obs(t), "dataset_id", "tissue_general", "cell_type", "tissue", "disease")


def stats(t: Tables) -> DataFrame:
    return op.merged_stats(partial(t), "dataset_id", "tissue_general")


def titled(t: Tables) -> DataFrame:
    """stats with title and collection from the dimension tables, by a left join."""
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("dataset_id"), F.col("n_name").alias("title"), F.col("r_name").alias("collection"))
    return stats(t).join(names, "dataset_id", "left").withColumns({"n_tissues": F.size("tissues"), "n_diseases": F.size("diseases")})


@query("A1_pushed_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 30 AND l_linestatus = 'F'")
def a1(t):
    return t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 30) & (F.col("l_linestatus") == "F")).select("l_orderkey", "l_partkey", "l_quantity")


@query("D1_partial_stats", f"WITH {OBS} SELECT dataset_id, tissue_general, count(*) AS n_rows, count(DISTINCT cell_type) AS n_types, string_agg(DISTINCT tissue, ';' ORDER BY tissue) AS tissues, string_agg(DISTINCT disease, ';' ORDER BY disease) AS diseases FROM obs GROUP BY dataset_id, tissue_general")
def d1(t):
    return partial(t).withColumns({c: F.array_join(c, ";") for c in ("tissues", "diseases")})


@query("D2_final_stats", f"WITH {STATS} SELECT dataset_id, n_rows, n_types, tissues, diseases FROM stats")
def d2(t):
    return stats(t).drop("parts").withColumns({c: F.array_join(c, ";") for c in ("tissues", "diseases")})


@query("B1_range_filter", f"WITH {STATS} SELECT dataset_id, n_rows, n_types FROM stats WHERE n_rows BETWEEN 100 AND 3000 AND n_types >= 6")
def b1(t):
    cfg = op.Curation(least_rows=100, most_rows=3000, least_types=6)
    return stats(t).where(op.within_thresholds("n_rows", "n_types", cfg)).select("dataset_id", "n_rows", "n_types")


@query("C1_left_join_stats", f"WITH {STATS} SELECT dataset_id, n_rows, title, collection FROM titled")
def c1(t):
    return titled(t).select("dataset_id", "n_rows", "title", "collection")


GUARD = """passed AS (
  SELECT * FROM titled WHERE NOT (lower(diseases) LIKE '%5-urgent!%') AND NOT (lower(title) LIKE '%iran%' OR lower(title) LIKE '%iraq%')
  AND NOT lower(collection) LIKE '%antarctica%' AND n_tissues <= 3 AND n_diseases <= 5)"""


def passed(t: Tables) -> DataFrame:
    return titled(t).where(op.guardrail(F.array_join("diseases", ";"), "n_tissues", "n_diseases", "title", "collection", CFG))


@query("B3_guardrail", f"WITH {STATS}, {GUARD} SELECT dataset_id, n_tissues, n_diseases FROM passed")
def b3(t):
    return passed(t).select("dataset_id", F.col("n_tissues").cast("long"), F.col("n_diseases").cast("long"))


@query("B4_reference_preference", f"WITH {STATS} SELECT dataset_id, CASE WHEN lower(title || ' ' || collection) LIKE '%united%' OR lower(title || ' ' || collection) LIKE '%an%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM titled")
def b4(t):
    return titled(t).select("dataset_id", op.reference_preference("title", "collection", CFG).alias("score"))


SCORED = """scaled AS (
  SELECT *, (lower(title || ' ' || collection) LIKE '%united%' OR lower(title || ' ' || collection) LIKE '%an%')::INT AS ref,
    CASE WHEN max(n_types) OVER () = min(n_types) OVER () THEN 1.0 ELSE (n_types - min(n_types) OVER ())::DOUBLE / (max(n_types) OVER () - min(n_types) OVER ()) END AS s1,
    CASE WHEN max(n_rows) OVER () = min(n_rows) OVER () THEN 1.0 ELSE (n_rows - min(n_rows) OVER ())::DOUBLE / (max(n_rows) OVER () - min(n_rows) OVER ()) END AS s2,
    1 - CASE WHEN max(n_tissues) OVER () = min(n_tissues) OVER () THEN 1.0 ELSE (n_tissues - min(n_tissues) OVER ())::DOUBLE / (max(n_tissues) OVER () - min(n_tissues) OVER ()) END AS s3,
    1 - CASE WHEN max(n_diseases) OVER () = min(n_diseases) OVER () THEN 1.0 ELSE (n_diseases - min(n_diseases) OVER ())::DOUBLE / (max(n_diseases) OVER () - min(n_diseases) OVER ()) END AS s4
  FROM titled
), scored AS (SELECT *, CAST(s1 AS DOUBLE) + 0.6 * s2 + 0.8 * s3 + 0.8 * s4 + 0.5 * ref AS auto_score FROM scaled)"""


def scored(t: Tables) -> DataFrame:
    return op.with_scores(titled(t), CFG)


@query("E5_min_max", f"WITH {STATS}, {SCORED} SELECT dataset_id, round(CAST(s1 AS DOUBLE), 6) AS score_celltype, round(CAST(s2 AS DOUBLE), 6) AS score_cells FROM scored")
def e5(t):
    return scored(t).select("dataset_id", F.round("score_celltype", 6).alias("score_celltype"), F.round("score_cells", 6).alias("score_cells"))


@query("E6_auto_score", f"WITH {STATS}, {SCORED} SELECT dataset_id, round(CAST(auto_score AS DOUBLE), 6) AS auto_score FROM scored")
def e6(t):
    return scored(t).select("dataset_id", F.round("auto_score", 6).alias("auto_score"))


@query("E2_top_per_tissue", f"""WITH {OBS}, n AS (SELECT tissue_general, dataset_id, count(*) AS n FROM obs GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY tissue_general ORDER BY n DESC, dataset_id) AS rank FROM n)
SELECT tissue_general, dataset_id, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= 4""")
def e2(t):
    n = obs(t).groupBy("tissue_general", "dataset_id").agg(F.count("*").alias("n"))
    return op.top_per_group(n, "tissue_general", 4, F.desc("n"), F.col("dataset_id"))


SELECTION = """general AS (SELECT DISTINCT dataset_id, tissue_general AS target FROM obs WHERE tissue_general IN ('F', 'O', 'P')
), r AS (SELECT s.dataset_id, g.target, row_number() OVER (PARTITION BY g.target ORDER BY round(auto_score, 9) DESC, n_types DESC, n_rows DESC, s.dataset_id) AS k FROM scored s JOIN general g USING (dataset_id)
), top AS (SELECT dataset_id, string_agg(target, ';' ORDER BY target) AS matched_tissues FROM r WHERE k <= 3 GROUP BY dataset_id
), marked AS (SELECT s.*, coalesce(matched_tissues, '') AS matched_tissues, CASE WHEN t.dataset_id IS NULL THEN 'fill_up' ELSE 'top_of_tissue' END AS selected_reason,
    row_number() OVER (PARTITION BY t.dataset_id IS NULL ORDER BY round(auto_score, 9) DESC, n_types DESC, n_rows DESC, s.dataset_id) AS k2
  FROM scored s LEFT JOIN top t ON s.dataset_id = t.dataset_id
), kept AS (SELECT * FROM marked WHERE selected_reason = 'top_of_tissue' OR k2 <= greatest(0, 8 - (SELECT count(*) FROM top)))
SELECT dataset_id, matched_tissues, selected_reason, round(CAST(auto_score AS DOUBLE), 6) AS auto_score FROM kept ORDER BY round(auto_score, 9) DESC, n_types DESC, n_rows DESC, dataset_id LIMIT 12"""


@query("E3_balanced_selection", f"WITH {STATS}, {SCORED}, {SELECTION}")
def e3(t):
    order = (F.desc(F.round("auto_score", 9)), F.desc("n_types"), F.desc("n_rows"), F.col("dataset_id"))
    picked = op.balanced_selection(scored(t), "dataset_id", "parts", TARGETS, CFG, *order)
    return picked.select("dataset_id", F.array_join("matched_tissues", ";").alias("matched_tissues"), "selected_reason", F.round("auto_score", 6).alias("auto_score"))


@query("E4_template_selection", f"""WITH {OBS}, n AS (SELECT dataset_id, count(*) AS n_rows, count(DISTINCT cell_type) AS n_types FROM obs GROUP BY dataset_id),
g AS (SELECT DISTINCT dataset_id, tissue_general FROM obs),
r AS (SELECT dataset_id, row_number() OVER (PARTITION BY tissue_general ORDER BY n_types DESC, n_rows DESC, dataset_id) AS k FROM n JOIN g USING (dataset_id))
SELECT DISTINCT dataset_id FROM r WHERE k <= 2""")
def e4(t):
    rows = obs(t).groupBy("dataset_id").agg(F.count("*").alias("n_rows"), F.count_distinct("cell_type").alias("n_types"), F.collect_set("tissue_general").alias("general"))
    return op.template_selection(rows, "dataset_id", "general", TARGETS, 2).select("dataset_id")


@query("E1_best_per_key", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE k = 1")
def e1(t):
    return op.best_per_key(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", F.desc("o_totalprice"), F.col("o_orderkey"))


@query("C2_reattached_list", f"WITH {OBS}, g AS (SELECT dataset_id, string_agg(DISTINCT tissue_general, ';' ORDER BY tissue_general) AS matched FROM obs GROUP BY dataset_id) SELECT n_name AS dataset_id, matched FROM nation LEFT JOIN g ON n_name = dataset_id")
def c2(t):
    lists = obs(t).groupBy("dataset_id").agg(F.array_join(F.array_sort(F.collect_set("tissue_general")), ";").alias("matched"))
    return t.nation.select(F.col("n_name").alias("dataset_id")).join(lists, "dataset_id", "left")


@query("F1_candidate_order", f"WITH {STATS} SELECT dataset_id, CAST(row_number() OVER (ORDER BY tissues, n_types DESC, n_rows DESC, dataset_id) AS INT) AS place FROM stats")
def f1(t):
    return op.placed(stats(t).withColumn("tissues", F.array_join("tissues", ";")), "tissues", F.desc("n_types"), F.desc("n_rows"), "dataset_id").select("dataset_id", F.col("place").cast("int").alias("place"))


@query("H9_token_counts", f"WITH {STATS} SELECT dataset_id, CAST(len(list_filter(string_split(diseases, ';'), lambda x: trim(x) <> '')) AS INT) AS n FROM stats")
def h9(t):
    return stats(t).select("dataset_id", token_count(F.array_join("diseases", ";")).alias("n"))


@query("G1_union_all", "SELECT 'customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier")
def g1(t):
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(t.customer, "customer").unionByName(n(t.supplier, "supplier"))


@query("G2_set_operations", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT 'both' AS kind, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def g2(t):
    of = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    n = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    a, b = of("F"), of("O")
    return n(a.intersect(b), "both").union(n(a.subtract(b), "first")).union(n(a.union(b).distinct(), "either"))
