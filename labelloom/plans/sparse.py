"""Sparse counts: an order is a cell, its status the dataset, its priority the label, brands are genes; zeros aren't rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.tails import normal_tail_sql
from labelloom.operators import order, sparse
from labelloom.operators.sides import spread
from labelloom.plans.registry import Tables, query
from labelloom.sources import matrix
from labelloom.sources.files import scratch

BY = ("dataset",)


def cells(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("cell"), F.col("o_orderpriority").alias("label"))


def counts(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity").join(t.part.select("p_partkey", F.col("p_brand").alias("gene")), F.col("l_partkey") == F.col("p_partkey"))
    rows = spread(rows, t.lineitem.count(), "l_orderkey")
    return rows.join(cells(t), F.col("l_orderkey") == F.col("cell")).groupBy("dataset", "cell", "label", "gene").agg(F.sum("l_quantity").alias("value"))


FILLED = """c AS (SELECT o_orderstatus AS dataset, o_orderkey AS cell, o_orderpriority AS label FROM orders),
k AS (SELECT dataset, cell, label, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN c ON l_orderkey = cell GROUP BY ALL),
g AS (SELECT DISTINCT dataset, gene FROM k), raw AS (SELECT c.dataset, c.cell, c.label, g.gene, coalesce(k.value, 0) AS value FROM c JOIN g USING (dataset) LEFT JOIN k USING (dataset, cell, gene)),
logged AS (SELECT dataset, cell, label, gene, round(ln(1 + coalesce(value / nullif(sum(value) OVER (PARTITION BY dataset, cell), 0), 0) * 10000), 6) AS value FROM raw)"""
RANKED = """r AS (SELECT *, rank() OVER (PARTITION BY dataset, gene ORDER BY value) + (count(*) OVER (PARTITION BY dataset, gene, value) - 1) / 2.0 AS rk FROM raw),
n AS (SELECT dataset, gene, sum(same)::DOUBLE AS n, sum(pow(same, 3) - same) AS ties FROM (SELECT dataset, gene, value, count(*) AS same FROM raw GROUP BY ALL) GROUP BY ALL),
s AS (SELECT dataset, label, gene, count(*) AS n_in, CAST(sum(rk) AS DOUBLE) AS rank_sum, avg(value) AS mean_in, sum(value) AS total, count(*) FILTER (value > 0) AS k FROM r GROUP BY ALL),
z AS (SELECT s.*, n.n, (rank_sum - n_in * (n + 1) / 2.0) / sqrt(n_in * (n - n_in) / 12.0 * (n + 1 - {ties})) AS z FROM s JOIN n USING (dataset, gene))"""
CORRECTED, PLAIN = RANKED.format(ties="ties / (n * (n - 1))"), RANKED.format(ties="0")


@query("D14_sparse_rank_sums", f"WITH {FILLED}, {CORRECTED} SELECT dataset, label, gene, n_in, CAST(n AS BIGINT) - n_in AS n_out, rank_sum, round(z, 6) AS z FROM z")
def d14ranks(t):
    """Rank sums with the correction for ties, zeros implied, against SQL that fills them in."""
    return sparse.statistics(counts(t), cells(t), BY, tie_correction=True).select("dataset", "label", "gene", "n_in", "n_out", "rank_sum", F.round("z", 6).alias("z"))


@query("D14_sparse_welch", f"""WITH {FILLED}, b AS (SELECT dataset, label, gene, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM logged GROUP BY ALL),
o AS (SELECT *, sum(n) OVER w - n AS n2, sum(s) OVER w - s AS s2, sum(q) OVER w - q AS q2 FROM b WINDOW w AS (PARTITION BY dataset, gene)),
v AS (SELECT *, (q - s * s / n) / (n - 1) / n AS a, (q2 - s2 * s2 / n2) / (n2 - 1) / n2 AS b FROM o)
SELECT dataset, label, gene, round((s / n - s2 / n2) / sqrt(a + b), 4) AS t, round(pow(a + b, 2) / (a * a / (n - 1) + b * b / (n2 - 1)), 2) AS df FROM v""")
def d14moments(t):
    """Welch's t of values by depth, as ln(1 + x), zeros implied."""
    rows = sparse.depth_normalised(counts(t), BY, digits=6)
    return sparse.statistics(rows, cells(t), BY).select("dataset", "label", "gene", F.round("t", 4).alias("t"), F.round("df", 2).alias("df"))


@query("D13_sparse_shares", f"WITH {FILLED}, b AS (SELECT dataset, label, gene, count(*) AS n, count(*) FILTER (value > 0) AS k FROM raw GROUP BY ALL) SELECT dataset, label, gene, round(k::DOUBLE / n, 4) AS pct_in, round((sum(k) OVER w - k)::DOUBLE / (sum(n) OVER w - n), 4) AS pct_out FROM b WINDOW w AS (PARTITION BY dataset, gene)")
def d13(t):
    return sparse.statistics(counts(t), cells(t), BY).select("dataset", "label", "gene", "pct_in", "pct_out")


@query("D14_sparse_candidates", f"""WITH {FILLED}, {PLAIN}, p AS (SELECT *, {normal_tail_sql('z')} AS p FROM z),
u AS (SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY p, gene) AS nth, count(*) OVER (PARTITION BY dataset, label) AS m FROM p),
a AS (SELECT *, least(1.0, min(p * m / nth) OVER (PARTITION BY dataset, label ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)) AS p_adj, (sum(total) OVER w - total) / (n - n_in) AS mean_out FROM u WINDOW w AS (PARTITION BY dataset, gene)),
f AS (SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY z DESC, gene) AS de_rank FROM a)
SELECT dataset, label, gene, round(z, 6) AS statistic, round(p_adj, 8) AS p_adj, round(log2((exp(mean_in) - 1 + 1e-9) / (exp(mean_out) - 1 + 1e-9)), 5) AS lfc, CAST(de_rank AS INT) AS de_rank FROM f WHERE de_rank <= 10""")
def d14candidates(t):
    """The ten genes of each dataset's labels with the highest rank statistic, with adjusted p and effect."""
    rows = sparse.differential(counts(t), cells(t), BY, most=10)
    return rows.select("dataset", "label", "gene", F.round("statistic", 6).alias("statistic"), F.round("p_adj", 8).alias("p_adj"), F.round("lfc", 5).alias("lfc"), "de_rank")


@query("E7_downsampled_cells", "WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey), o_orderkey) AS k FROM orders) SELECT o_orderkey, o_orderpriority FROM r WHERE k <= 2000")
def e7(t):
    """At most 2,000 orders of each priority."""
    return sparse.markers.downsampled(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


@query("D29_percentiles_of_prices", "WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, any_value(n) AS n, max(v) FILTER (k = floor(n * 0.5)) AS p50, max(v) FILTER (k = floor(n * 0.95)) AS p95, max(v) FILTER (k = floor(n * 0.99)) AS p99, max(v) AS largest FROM r GROUP BY l_returnflag")
def d29(t):
    """Positions in continuous values, sought by ranges in groups of more than 10,000 rows."""
    return order.nearest_percentiles(t.lineitem, "l_returnflag", "l_extendedprice", most=10_000)


@query("A5_cell_matrix", f"WITH {FILLED} SELECT cell, label, gene, CAST(value AS DOUBLE) AS value FROM k WHERE label IN ('1-URGENT', '2-HIGH') AND cell >= 1000")
def a5(t):
    """Counts of all orders, written as a cell matrix and read again with filters that reach its blocks."""
    path = scratch(t.spark, "matrix")
    matrix.write_matrix(cells(t), counts(t), path, ("label",))
    return matrix.read_matrix(t.spark, path).where("label in ('1-URGENT', '2-HIGH') and cell >= 1000")
