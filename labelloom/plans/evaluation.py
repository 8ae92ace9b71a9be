"""Evaluation: a rule on a document's length predicts its quality; labels are the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions import labels as lb
from labelloom.operators import diagnosis as dg
from labelloom.operators import evaluation as op
from labelloom.operators import order
from labelloom.operators.splits import group_split
from labelloom.plans.registry import Tables, query, values


def judged(t: Tables) -> DataFrame:
    """Documents with a prediction, a score, and what the labels say."""
    d = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels, "doc_id", "left")
    pred = (F.col("n_chars") % 3 > 0).cast("int")
    score = F.col("n_chars") % 101 / 100.0
    right = pred == F.col("quality")
    return d.select("doc_id", "source", "lang", "quality", "toxic", pred.alias("pred"), score.alias("score"), right.alias("exact"), F.coalesce(pred > F.col("quality"), F.lit(False)).alias("severe"), (F.col("toxic") == 0).alias("lineage"))


JUDGED = "j AS (SELECT doc_id, source, lang, quality, toxic, (n_chars % 3 > 0)::INT AS pred, n_chars % 101 / 100.0::DOUBLE AS score, (n_chars % 3 > 0)::INT = quality AS exact, coalesce((n_chars % 3 > 0)::INT > quality, false) AS severe, toxic = 0 AS lineage FROM documents LEFT JOIN labels USING (doc_id))"


@query("D18_rates_by_source", f"WITH {JUDGED} SELECT source, count(*) AS n, round(avg(coalesce(exact, false)::INT), 4) AS exact, round(avg(severe::INT), 4) AS severe FROM j GROUP BY source")
def d18(t):
    return judged(t).groupBy("source").agg(F.count("*").alias("n"), op.rate("exact").alias("exact"), op.rate("severe").alias("severe"))


@query("D18_core_metrics", f"""WITH {JUDGED}, x AS (SELECT *, CASE WHEN doc_id % 4 > 0 THEN 'CL:' || (doc_id % 3) END AS gold_id, 'cl:' || (doc_id % 2) AS pred_id FROM j)
SELECT count(*) AS n, round(avg(coalesce(exact, false)::INT), 4) AS exact, round(avg(coalesce(exact OR lineage, false)::INT), 4) AS compatible, round(avg(coalesce(lineage, false)::INT), 4) AS same_lineage, round(avg(severe::INT), 4) AS severe_error,
  1.0::DOUBLE AS parse_ok, round(avg(CASE WHEN gold_id IS NOT NULL THEN (lower(gold_id) = lower(pred_id))::INT END), 4) AS id_accuracy, count(gold_id) AS n_with_id FROM x""")
def d18c(t):
    rows = judged(t).withColumns({"gold_id": F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("CL:"), (F.col("doc_id") % 3).cast("string"))), "pred_id": F.concat(F.lit("cl:"), (F.col("doc_id") % 2).cast("string")), "parsed": F.lit(None).cast("boolean"), "compat": F.col("exact") | F.col("lineage")})
    m = op.core_metrics("exact", "compat", "lineage", "severe", "parsed", "pred_id", "gold_id")
    return rows.agg(*(c if k != 2 else c.alias("compatible") for k, c in enumerate(m)))


@query("D20_null_aware_rates", f"WITH {JUDGED} SELECT count(*) AS n, round(avg(exact::INT), 4) AS exact, round(avg(lineage::INT), 4) AS lineage, count(*) FILTER (pred = 1) AS n_accept FROM j")
def d20(t):
    return judged(t).agg(F.count("*").alias("n"), op.known_rate("exact").alias("exact"), op.known_rate("lineage").alias("lineage"), F.count_if(F.col("pred") == 1).alias("n_accept"))


@query("D21_rates_by_group", f"WITH {JUDGED} SELECT coalesce(CASE WHEN lang = 'de' THEN NULL ELSE lang END, 'unknown') AS lang, count(*) AS n, round(avg(exact::INT), 4) AS exact FROM j GROUP BY 1")
def d21(t):
    return op.rates_by(judged(t), F.when(F.col("lang") != "de", F.col("lang")), "lang", exact="exact")


@query("D22_subset_metrics", f"WITH {JUDGED} SELECT count(*) FILTER (quality IS NULL) AS n_unmapped, round(avg(score) FILTER (quality IS NULL), 4) AS score_unmapped, round(avg(score) FILTER (toxic = 1), 4) AS score_toxic FROM j")
def d22(t):
    return judged(t).agg(F.count_if(F.col("quality").isNull()).alias("n_unmapped"), F.round(F.avg(F.when(F.col("quality").isNull(), F.col("score"))), 4).alias("score_unmapped"), F.round(F.avg(F.when(F.col("toxic") == 1, F.col("score"))), 4).alias("score_toxic"))


@query("D23_calibration", f"""WITH {JUDGED}, k AS (SELECT score AS p, exact::INT AS y FROM j WHERE exact IS NOT NULL), edges(b, lo, hi) AS (VALUES (0, 0.0::DOUBLE, 0.1::DOUBLE), (1, 0.1, 0.2), (2, 0.2, 0.1 + 0.2::DOUBLE), (3, 0.1 + 0.2::DOUBLE, 0.4), (4, 0.4, 0.5), (5, 0.5, '0.6000000000000001'::DOUBLE), (6, '0.6000000000000001'::DOUBLE, '0.7000000000000001'::DOUBLE), (7, '0.7000000000000001'::DOUBLE, 0.8), (8, 0.8, 0.9), (9, 0.9, 1.0)),
x AS (SELECT b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM k JOIN edges ON p >= lo AND p < hi GROUP BY b)
SELECT (SELECT count(*) FROM k) AS n, (SELECT round(avg((p - y) * (p - y)), 4) FROM k) AS brier, round(sum(n * abs(mp - my)) / (SELECT count(*) FROM k), 4) AS ece FROM x""")
def d23(t):
    return op.calibration(judged(t), "score", "exact")


BUCKETS = f"{JUDGED}, b AS (SELECT *, CASE WHEN toxic IS NULL THEN 'unknown' ELSE CAST(toxic AS VARCHAR) END AS tox FROM j), rep AS (SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(tox) = 0 THEN 'toxic' ELSE 'overall' END AS dimension, coalesce(source, lang, tox, 'all') AS bucket, count(*) AS n, round(avg(coalesce(exact, false)::INT), 4) AS exact, round(avg(severe::INT), 4) AS severe_error FROM b GROUP BY GROUPING SETS ((), (source), (lang), (tox)))"


def buckets(t: Tables) -> DataFrame:
    return op.bucket_report(judged(t), {"source": "source", "lang": "lang", "toxic": "toxic"}, [F.count("*").alias("n"), op.rate("exact").alias("exact"), op.rate("severe").alias("severe_error")])


@query("D24_grouping_sets", f"WITH {BUCKETS} SELECT * FROM rep")
def d24(t):
    return buckets(t)


@query("D25_bottlenecks", f"WITH {BUCKETS}, x AS (SELECT dimension, bucket, n, severe_error, round(severe_error - (SELECT severe_error FROM rep WHERE dimension = 'overall'), 4) AS excess FROM rep WHERE dimension NOT IN ('overall', 'toxic') AND n >= 3) SELECT * FROM x WHERE excess > 0 ORDER BY excess DESC, dimension, bucket LIMIT 3")
def d25(t):
    return op.bottlenecks(buckets(t), leave_out=("toxic",))


SPLIT = "sp AS (SELECT source, CASE WHEN k <= n - greatest(1, round_even(n * 0.15, 0)) - greatest(1, round_even(n * 0.10, 0)) THEN 'train' WHEN k <= n - greatest(1, round_even(n * 0.15, 0)) THEN 'val' ELSE 'test' END AS split FROM (SELECT source, row_number() OVER (ORDER BY md5('42|' || source), source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)))"


@query("D26_coverage_pivot", f"WITH {SPLIT}, c AS (SELECT lang, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test FROM documents JOIN sp USING (source) GROUP BY lang) SELECT *, CASE WHEN n_train = 0 AND n_val + n_test > 0 THEN 'zero_shot' WHEN n_train = 0 THEN 'absent' WHEN n_train = 1 THEN 'singleton' WHEN n_train <= 4 THEN 'rare' ELSE 'covered' END AS status FROM c")
def d26(t):
    s = group_split(t.documents.select("source").distinct(), "source")
    return dg.coverage(t.documents.select("source", "lang").join(s, "source"), "lang")


@query("D27_quality_histogram", f"WITH {JUDGED} SELECT CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score >= 0.3 THEN 'low' ELSE 'very_low' END AS bucket, count(*) AS n FROM j GROUP BY 1")
def d27(t):
    return judged(t).groupBy(dg.quality_bucket("score").alias("bucket")).agg(F.count("*").alias("n"))


@query("D28_label_quality_summary", "SELECT 'clean' AS grade, count(*) FILTER (c_custkey % 4 = 0) AS n, round(count(*) FILTER (c_custkey % 4 = 0) / count(*)::DOUBLE, 4) AS rate FROM customer UNION ALL SELECT 'weak', count(*) FILTER (c_custkey % 4 = 1), round(count(*) FILTER (c_custkey % 4 = 1) / count(*)::DOUBLE, 4) FROM customer UNION ALL SELECT 'noisy', count(*) FILTER (c_custkey % 4 = 2), round(count(*) FILTER (c_custkey % 4 = 2) / count(*)::DOUBLE, 4) FROM customer UNION ALL SELECT 'invalid', count(*) FILTER (c_custkey % 4 = 3), round(count(*) FILTER (c_custkey % 4 = 3) / count(*)::DOUBLE, 4) FROM customer")
def d28(t):
    return dg.quality_summary(graded(t))


def graded(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    rows = t.customer.select("c_custkey", F.when(k == 2, "nothing").when(k == 3, " ").otherwise("T cell").alias("l"), F.when(k == 1, "CL:12").when(k == 2, None).otherwise("CL:0000084").alias("i"), F.lit("Lymphocyte").alias("p"))
    known = values(t.spark, [("t cell", "CL:0000084"), ("lymphocyte", "CL:0000542")], "label string, id string")
    return dg.with_label_quality(rows, "l", "i", "p", known.select("label"), known.select("id"), known.select("label"))


@query("H33_label_quality", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'weak' WHEN 2 THEN 'noisy' ELSE 'invalid' END AS grade, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'id_malformed' WHEN 2 THEN 'label_unknown|id_missing' ELSE 'label_empty' END AS issues FROM customer")
def h33(t):
    return graded(t).select("c_custkey", "grade", F.array_join("issues", "|").alias("issues"))


@query("D29_percentiles", "WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, any_value(n) AS n, max(n_chars) FILTER (k = floor(n * 0.5)) AS p50, max(n_chars) FILTER (k = floor(n * 0.95)) AS p95, max(n_chars) FILTER (k = floor(n * 0.99)) AS p99, max(n_chars) AS largest FROM r GROUP BY lang")
def d29(t):
    return order.nearest_percentiles(t.documents, "lang", "n_chars")


@query("D32_metric_delta", f"WITH {JUDGED}, a AS (SELECT round(avg(coalesce(exact, false)::INT), 4) AS e, round(avg(severe::INT), 4) AS s FROM j WHERE lang = 'en'), b AS (SELECT round(avg(coalesce(exact, false)::INT), 4) AS e, round(avg(severe::INT), 4) AS s FROM j WHERE lang <> 'en') SELECT 'exact' AS metric, a.e AS base, b.e AS variant, round(b.e - a.e, 4) AS delta FROM a, b UNION ALL SELECT 'severe', a.s, b.s, round(b.s - a.s, 4) FROM a, b")
def d32(t):
    m = [op.rate("exact").alias("exact"), op.rate("severe").alias("severe")]
    return op.delta(judged(t).where("lang = 'en'").agg(*m), judged(t).where("lang <> 'en'").agg(*m), "exact", "severe")


@query("D34_id_checks", "SELECT count(*) AS n, count(*) FILTER (c_custkey % 3 = 0) AS n_invalid, count(*) FILTER (c_custkey % 3 = 1) AS n_fabricated FROM customer")
def d34(t):
    k = F.col("c_custkey") % 3
    known = values(t.spark, [("CL:2",)], "id string")
    return op.id_checks(t.customer.select(F.when(k == 0, "bad").when(k == 1, "CL:1").otherwise("CL:2").alias("i")), "i", known)


@query("D37_mapped_share", "SELECT lang, round(avg((doc_id % 3 > 0)::INT), 4) AS share FROM documents GROUP BY lang")
def d37(t):
    i = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("CL:"), F.col("doc_id").cast("string"))).otherwise("")
    return t.documents.groupBy("lang").agg(F.round(F.avg(i.startswith("CL:").cast("double")), 4).alias("share"))


@query("H30_three_valued_match", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS m FROM documents")
def h30(t):
    a = F.when(F.col("doc_id") % 5 != 0, F.upper("lang"))
    return t.documents.select("doc_id", lb.three_valued(a, F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("x")).alias("m"))


@query("H34_seen_status", "WITH n AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) SELECT c_custkey, CASE WHEN n IS NULL THEN 'zero_shot' WHEN n = 1 THEN 'singleton' WHEN n <= 4 THEN 'rare' ELSE 'frequent' END AS seen FROM customer LEFT JOIN n ON c_custkey = o_custkey")
def h34(t):
    n = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", dg.seen_status("n").alias("seen"))


@query("E9_rank_in_group", "SELECT c_custkey, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rank FROM customer")
def e9(t):
    return t.customer.select("c_custkey", "c_nationkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"))
