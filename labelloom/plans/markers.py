"""Markers: a vector's label is its group and its components are genes; line items give sparse counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions import scoring as sc
from labelloom.functions.tails import normal_tail_sql, student_tail_sql
from labelloom.operators import markers as op
from labelloom.operators.sides import spread
from labelloom.plans.registry import Tables, query


def cells(t: Tables) -> DataFrame:
    return t.embeddings.where("label is not null").select(F.col("vec_id").alias("cell"), "label", F.posexplode("embedding").alias("gene", "value")).withColumn("value", F.col("value").cast("double"))


def counts(t: Tables) -> DataFrame:
    """Sparse counts: order, brand and quantity, labelled by priority."""
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = spread(rows, t.lineitem.count(), "l_orderkey")
    rows = rows.join(t.orders.select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("l_orderkey").alias("cell"), F.col("o_orderpriority").alias("label"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("value"))


CELLS = "cells AS (SELECT vec_id AS cell, label, CAST(i AS INT) AS gene, CAST(embedding[i + 1] AS DOUBLE) AS value FROM (SELECT vec_id, label, embedding, unnest(range(64)) AS i FROM embeddings WHERE label IS NOT NULL))"
COUNTS = "counts AS (SELECT l_orderkey AS cell, o_orderpriority AS label, p_brand AS gene, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
SHARES = "g AS (SELECT label, gene, count(*) AS n_in, count(*) FILTER (value > 0) AS k FROM cells GROUP BY ALL), shares AS (SELECT label, gene, round(k::DOUBLE / n_in, 4) AS pct_in, round(coalesce((sum(k) OVER w - k)::DOUBLE / nullif(sum(n_in) OVER w - n_in, 0), 0), 4) AS pct_out FROM g WINDOW w AS (PARTITION BY gene))"
RANKS = "r AS (SELECT cell, label, gene, rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER (PARTITION BY gene, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY gene) AS n FROM cells), z AS (SELECT label, gene, count(*) AS n1, any_value(n) AS n, CAST(sum(rk) AS DOUBLE) AS rank_sum, (CAST(sum(rk) AS DOUBLE) - count(*) * (any_value(n) + 1) / 2.0) / sqrt(count(*)::DOUBLE * (any_value(n) - count(*)) / 12.0 * (any_value(n) + 1)) AS z FROM r GROUP BY label, gene)"


@query("B8_feature_detection", f"WITH {COUNTS} SELECT gene, count(*) AS n FROM counts WHERE gene IN (SELECT gene FROM counts GROUP BY gene HAVING count(*) FILTER (value > 0) >= 200) GROUP BY gene")
def b8(t):
    return op.detected_genes(counts(t), 200).groupBy("gene").agg(F.count("*").alias("n"))


@query("D13_detection_shares", f"WITH {CELLS}, {SHARES} SELECT * FROM shares")
def d13(t):
    return op.detection(cells(t))


@query("D14_welch_t", f"""WITH {CELLS}, g AS (SELECT label, gene, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM cells GROUP BY ALL),
o AS (SELECT *, sum(n) OVER w - n AS n2, sum(s) OVER w - s AS s2, sum(q) OVER w - q AS q2 FROM g WINDOW w AS (PARTITION BY gene)),
v AS (SELECT *, (q - s * s / n) / (n - 1) / n AS a, (q2 - s2 * s2 / n2) / (n2 - 1) / n2 AS b FROM o WHERE n > 1 AND n2 > 1)
SELECT label, gene, round((s / n - s2 / n2) / sqrt(a + b), 4) AS t, round(pow(a + b, 2) / (a * a / (n - 1) + b * b / (n2 - 1)), 2) AS df FROM v""")
def d14t(t):
    return op.welch(cells(t)).where("n_in > 1 and n_out > 1").select("label", "gene", F.round("t", 4).alias("t"), F.round("df", 2).alias("df"))


@query("D14_rank_sum_z", f"WITH {CELLS}, {RANKS} SELECT label, gene, rank_sum, round(z, 6) AS z FROM z")
def d14w(t):
    return op.rank_sums(cells(t)).select("label", "gene", "rank_sum", F.round("z", 6).alias("z"))


P = f"p AS (SELECT label, gene, z, {normal_tail_sql('z')} AS p FROM z)"
WELCH = """g AS (SELECT label, gene, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM cells GROUP BY ALL),
o AS (SELECT *, sum(n) OVER w - n AS n2, sum(s) OVER w - s AS s2, sum(q) OVER w - q AS q2 FROM g WINDOW w AS (PARTITION BY gene)),
v AS (SELECT *, (q - s * s / n) / (n - 1) / n AS a, (q2 - s2 * s2 / n2) / (n2 - 1) / n2 AS b FROM o WHERE n > 1 AND n2 > 1),
x AS (SELECT label, gene, (s / n - s2 / n2) / sqrt(a + b) AS t, pow(a + b, 2) / (a * a / (n - 1) + b * b / (n2 - 1)) AS df FROM v)"""
ADJUSTED = "k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p, gene) AS k, count(*) OVER (PARTITION BY label) AS m FROM p), a AS (SELECT *, least(1.0, min(p * m / k) OVER (PARTITION BY label ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM k)"


@query("D14_rank_sum_p", f"WITH {CELLS}, {RANKS}, {P} SELECT label, gene, round(p, 9) AS p FROM p")
def d14p(t):
    return op.with_p(op.rank_sums(cells(t))).select("label", "gene", F.round("p", 9).alias("p"))


@query("D14_welch_p", f"WITH {CELLS}, {WELCH} SELECT label, gene, round({student_tail_sql('t', 'df')}, 9) AS p FROM x")
def d14tp(t):
    return op.with_p(op.welch(cells(t)).where("n_in > 1 and n_out > 1")).select("label", "gene", F.round("p", 9).alias("p"))


@query("D14_adjusted_p", f"WITH {CELLS}, {RANKS}, {P}, {ADJUSTED} SELECT label, gene, round(p_adj, 8) AS p_adj FROM a")
def d14bh(t):
    return op.adjusted(op.with_p(op.rank_sums(cells(t))), "label").select("label", "gene", F.round("p_adj", 8).alias("p_adj"))


@query("D14_candidates", f"""WITH {CELLS}, {RANKS}, {P}, {ADJUSTED}, top AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY z DESC, gene) AS de_rank FROM a)
SELECT label, gene, round(z, 6) AS statistic, round(p_adj, 8) AS p_adj, CAST(de_rank AS INT) AS de_rank FROM top WHERE de_rank <= 50""")
def d14top(t):
    """The 50 genes of each label with the highest rank statistic, with their adjusted p."""
    return op.differential(cells(t)).select("label", "gene", F.round("statistic", 6).alias("statistic"), F.round("p_adj", 8).alias("p_adj"), "de_rank")


@query("D14_candidates_by_t", f"""WITH {CELLS}, {WELCH}, p AS (SELECT label, gene, t, {student_tail_sql('t', 'df')} AS p FROM x), {ADJUSTED}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY t DESC, gene) AS de_rank FROM a)
SELECT label, gene, round(t, 6) AS statistic, round(p_adj, 8) AS p_adj, CAST(de_rank AS INT) AS de_rank FROM r WHERE de_rank <= 50""")
def d14topt(t):
    return op.differential(cells(t), "t").select("label", "gene", F.round("statistic", 6).alias("statistic"), F.round("p_adj", 8).alias("p_adj"), "de_rank")


@query("D15_depth_normalised", f"WITH {COUNTS} SELECT gene, count(*) AS n, round(sum(x), 4) AS s FROM (SELECT gene, round(ln(1 + value / sum(value) OVER (PARTITION BY cell) * 10000), 6) AS x FROM counts) GROUP BY gene")
def d15(t):
    return op.depth_normalised(counts(t), digits=6).groupBy("gene").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,6)")), 4).cast("double").alias("s"))  # exact, in whatever order


@query("E7_downsample", "WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS k FROM embeddings) SELECT vec_id, label FROM r WHERE k <= 20")
def e7(t):
    return op.downsampled(t.embeddings.select("vec_id", "label"), "label", "vec_id", 20)


@query("E8_group_fraction", "SELECT source, lang, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source), 6) AS share, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY source) < 0.2 AS rare FROM documents GROUP BY source, lang")
def e8(t):
    n = t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))
    total = n.groupBy("source").agg(F.sum("n").alias("all"))
    share = F.col("n") / F.col("all")
    return n.join(total, "source").select("source", "lang", "n", F.round(share, 6).alias("share"), (share < 0.2).alias("rare"))


@query("E10_occurrence_counts", "SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n FROM documents")
def e10(t):
    n = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return t.documents.select("doc_id", "source").join(n, "source").select("doc_id", "source", "n")


NAMED = "named AS (SELECT z.label, CASE z.gene % 16 WHEN 0 THEN 'MT-' || z.gene WHEN 1 THEN 'rpl' || z.gene WHEN 2 THEN 'HBEGF' || z.gene ELSE 'G' || z.gene END AS gene, z.z AS lfc, pct_in, pct_out, round(z.z, 6) AS zr FROM z JOIN shares s ON z.label = s.label AND z.gene = s.gene)"
POSITIVE = f"{CELLS}, {SHARES}, {RANKS}, {NAMED}, t50 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY zr DESC, gene) AS k FROM named), pos AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k) AS rank FROM t50 WHERE k <= 50 AND lfc > 0 AND NOT regexp_matches(upper(gene), '^(MT-|RPL|RPS|HB|IGJ)')), ten AS (SELECT *, round(round(lfc, 6) * pct_in * greatest(0, 1 - pct_out), 4) AS score FROM pos WHERE rank <= 10)"


def named(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Statistics and shares with gene names, some of them listed out; the effect is z."""
    k = F.col("gene") % 16
    name = F.concat(F.when(k == 0, "MT-").when(k == 1, "rpl").when(k == 2, "HBEGF").otherwise("G"), F.col("gene").cast("string"))
    long = cells(t)
    return op.rank_sums(long).select("label", name.alias("gene"), F.round("z", 6).alias("lfc")), op.detection(long).select("label", name.alias("gene"), "pct_in", "pct_out")


def ten(t: Tables) -> DataFrame:
    stats, shares = named(t)
    return op.positive_markers(op.ranked(stats, F.desc("lfc"), 50), shares, 10)


@query("F5_positive_markers", f"WITH {POSITIVE} SELECT label, CAST(rank AS INT) AS rank, gene, round(lfc, 6) AS lfc, pct_in, pct_out, score FROM ten")
def f5(t):
    return ten(t).select("label", "rank", "gene", "lfc", "pct_in", "pct_out", "score")


@query("F4_negative_markers", f"""WITH {CELLS}, {SHARES}, {RANKS}, {NAMED}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY zr, gene) AS rank FROM named WHERE zr <= 0 AND NOT regexp_matches(upper(gene), '^(MT-|RPL|RPS|HB|IGJ)'))
SELECT label, CAST(rank AS INT) AS rank, gene, CASE WHEN pct_out > 0.5 AND pct_in < 0.2 THEN 'high_pct_out_low_pct_in' WHEN zr < -0.5 THEN 'negative_logfc' ELSE 'low_expression' END AS reason FROM n WHERE rank <= 5""")
def f4(t):
    stats, shares = named(t)
    return op.negative_markers(stats, shares, 5).select("label", "rank", "gene", "reason")


@query("B9_listed_out", f"WITH {CELLS}, {SHARES}, {RANKS}, {NAMED} SELECT DISTINCT gene, regexp_matches(upper(gene), '^(MT-|RPL|RPS|HB|IGJ)') AS out FROM named")
def b9(t):
    return named(t)[0].select("gene", sc.listed_out("gene").alias("out")).distinct()


@query("H13_marker_records", f"""WITH {POSITIVE}, s AS (SELECT label, count(*) AS n_in FROM embeddings WHERE label IS NOT NULL GROUP BY label)
SELECT label, count(*) AS n_markers, string_agg(gene, '|' ORDER BY rank) AS genes, round(avg(score), 6) AS mean_score,
  round(least(round((0.4 * least(count(*), 10) / 10.0 + 0.5 * least(avg(score) / 3.0, 1.0) + 0.1) * CASE WHEN any_value(n_in) >= 100 THEN 1.0 ELSE greatest(0.3, any_value(n_in) / 100.0) END, 4), 1.0), 3) AS quality
FROM ten JOIN s USING (label) GROUP BY label HAVING count(*) >= 5""")
def h13(t):
    rows = op.marker_records(ten(t), op.group_sizes(t.embeddings.where("label is not null").select(F.col("vec_id").alias("cell"), "label")), 5)
    return rows.select("label", "n_markers", F.array_join(F.transform("markers", lambda m: m["gene"]), "|").alias("genes"), F.round("mean_score", 6).alias("mean_score"), F.round("quality", 3).alias("quality"))


@query("D16_mean_of_first", "SELECT vec_id, round((CAST(embedding[1] AS DOUBLE) + embedding[2] + embedding[3] + embedding[4] + embedding[5]) / 5, 6) AS m FROM embeddings")
def d16(t):
    return t.embeddings.select("vec_id", sc.mean_of_first("embedding", 5).alias("m"))


@query("D17_array_summary", "SELECT vec_id, round(list_max(CAST(embedding[1:10] AS DOUBLE[])), 6) AS hi, round(list_min(CAST(embedding[1:10] AS DOUBLE[])), 6) AS lo, round(list_min(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x > 0)), 6) AS least_positive FROM embeddings")
def d17(t):
    v = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.round(F.array_max(F.slice(v, 1, 10)), 6).alias("hi"), F.round(F.array_min(F.slice(v, 1, 10)), 6).alias("lo"), F.round(F.array_min(F.filter(v, lambda x: x > 0)), 6).alias("least_positive"))


@query("H15_hardness_flags", "SELECT p_partkey, p_size < 20 AS low_cells, p_retailprice / 2000 < 0.6 AS low_marker_quality, p_partkey % 3 = 0 AS ontology_unmapped, p_size < 20 OR p_retailprice / 2000 < 0.6 OR p_partkey % 3 = 0 AS hard FROM part")
def h15(t):
    flags = sc.hardness("p_size", F.col("p_retailprice") / 2000, F.when(F.col("p_partkey") % 3 != 0, F.lit("CL:1")), F.lit(0.5), low=20, least=0.6)
    rows = t.part.withColumn("f", flags)
    return rows.select("p_partkey", "f.low_cells", "f.low_marker_quality", "f.ontology_unmapped", sc.any_flag("f").alias("hard"))


@query("H17_confidence_rules", "SELECT p_partkey, CASE WHEN p_size * 10 >= 200 AND p_retailprice / 500 >= 2.0 THEN 'high' WHEN p_size * 10 >= 80 AND p_retailprice / 500 >= 1.0 THEN 'medium' ELSE 'low' END AS c FROM part")
def h17(t):
    return t.part.select("p_partkey", sc.confidence_by_size(F.col("p_size") * 10, F.col("p_retailprice") / 500).alias("c"))


@query("H16_feature_vector", f"""WITH {POSITIVE}, s AS (SELECT label, count(*) AS n_in, count(*) / sum(count(*)) OVER () AS share FROM embeddings WHERE label IS NOT NULL GROUP BY label),
neg AS (SELECT label, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY zr, gene) AS k FROM named WHERE zr <= 0 AND NOT regexp_matches(upper(gene), '^(MT-|RPL|RPS|HB|IGJ)')) WHERE k <= 5 GROUP BY label),
rec AS (SELECT label, count(*) AS n, round((0.4 * least(count(*), 10) / 10.0 + 0.5 * least(avg(score) / 3.0, 1.0) + 0.1) * CASE WHEN any_value(n_in) >= 100 THEN 1.0 ELSE greatest(0.3, any_value(n_in) / 100.0) END, 4) AS q, any_value(n_in) AS n_in, any_value(share) AS share,
  avg(round(lfc, 6)) FILTER (rank <= 5) AS lfc, avg(pct_in) FILTER (rank <= 5) AS pin, avg(pct_out) FILTER (rank <= 5) AS pout, avg(score) FILTER (rank <= 5) AS sc, avg(pct_in - pct_out) FILTER (rank <= 5) AS spec FROM ten JOIN s USING (label) GROUP BY label)
SELECT rec.label, CAST(rec.n AS INT) AS n_positive_markers, CAST(coalesce(neg.n, 0) AS INT) AS n_negative_markers, n_in AS n_cells, round(ln(n_in + 1), 4) AS log_n_cells, round(lfc, 5) AS mean_logfc_top5, round(pin, 5) AS mean_pct_in_top5, round(pout, 5) AS mean_pct_out_top5, round(sc, 5) AS mean_score_top5,
  round(spec, 3) AS specificity_score, round(least(q, 1.0), 3) AS marker_quality_score, (n_in < 100)::INT AS flag_low_cells, (q < 0.3)::INT AS flag_low_quality, 1 AS flag_ontology_unmapped, (share < 0.02)::INT AS flag_rare_label FROM rec LEFT JOIN neg USING (label)""")
def h16(t):
    """The 14 features of each label's marker record, means and quality with a digit less, as engines round halves apart."""
    stats, shares = named(t)
    cells_ = t.embeddings.where("label is not null")
    rows = op.marker_records(ten(t), op.group_sizes(cells_.select(F.col("vec_id").alias("cell"), "label")))
    rows = rows.join(op.negative_markers(stats, shares, 5).groupBy("label").agg(F.collect_list("gene").alias("negative")), "label", "left")
    rows = rows.crossJoin(F.broadcast(cells_.agg(F.count("*").alias("n"))))  # one row
    rows = rows.withColumn("f", sc.hardness("n_in", "quality", F.lit(None).cast("string"), F.col("n_in") / F.col("n")))
    out = rows.select("label", *sc.feature_vector("markers", "negative", "n_in", "quality", "f"))
    digits = {"specificity_score": 3, "marker_quality_score": 3} | {f"mean_{c}_top5": 5 for c in ("logfc", "pct_in", "pct_out", "score")}
    return out.select(*(F.round(c, digits[c]).alias(c) if c in digits else c for c in out.columns))
