"""Smaller operators of the inventory, and the calibrator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from labelloom.functions import scoring as sc
from labelloom.functions.text import has_any
from labelloom.operators import calibration as cal
from labelloom.operators import evaluation as ev
from labelloom.operators import markers as mk
from labelloom.operators.curation import best_per_key
from labelloom.operators.inference import with_outputs
from labelloom.plans.evaluation import JUDGED, judged
from labelloom.plans.knowledge import ENTRIES, entries
from labelloom.plans.markers import CELLS, NAMED, RANKS, SHARES, named
from labelloom.plans.registry import Tables, query


@query("A2_dimension_scan", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def a2(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("A18_missing_outputs", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id < 10)")
def a18(t):
    have = t.documents.where("doc_id < 10").select("source").distinct()
    return t.documents.select("source").distinct().join(have, "source", "left_anti")


@query("B2_keyword_predicate", "SELECT doc_id, contains(lower(text), 'idiot') OR contains(lower(text), 'a.b') OR contains(lower(text), '$$$') AS hit FROM documents")
def b2(t):
    return t.documents.select("doc_id", has_any("text", ("Idiot", "a.b", "$$$")).alias("hit"))


@query("B18_sub_record", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user'")
def b18(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", "role")


@query("C17_kept_on_one_row", "SELECT conv_id, max(text) FILTER (turn = 0) AS question, max(text) FILTER (turn = 1) AS answer FROM conversations GROUP BY conv_id")
def c17(t):
    at = lambda k: F.max(F.when(F.col("turn") == k, F.col("text")))
    return t.conversations.groupBy("conv_id").agg(at(0).alias("question"), at(1).alias("answer"))


@query("D19_inference_metrics", f"WITH {JUDGED} SELECT count(*) AS n, round(avg(coalesce(exact, false)::INT), 4) AS exact, round(avg(severe::INT), 4) AS severe, count(*) FILTER (severe) AS n_high_risk, round(avg((pred < quality AND quality IS NOT NULL)::INT), 4) AS more_general FROM j")
def d19(t):
    return judged(t).agg(F.count("*").alias("n"), ev.rate("exact").alias("exact"), ev.rate("severe").alias("severe"), F.count_if("severe").alias("n_high_risk"), ev.rate(F.col("pred") < F.col("quality")).alias("more_general"))


@query("D31_simple_summary", f"WITH {JUDGED} SELECT round(avg(exact::INT), 4) AS accuracy, count(exact) AS n FROM j")
def d31(t):
    return judged(t).agg(ev.known_rate("exact").alias("accuracy"), F.count("exact").alias("n"))


@query("D33_metrics_of_a_column", f"WITH {JUDGED} SELECT lang, round(avg((pred = quality)::INT), 4) AS by_rule, round(avg((1 = quality)::INT), 4) AS by_majority FROM j WHERE quality IS NOT NULL GROUP BY lang")
def d33(t):
    rows = judged(t).where("quality is not null").withColumn("majority", F.lit(1))
    return rows.groupBy("lang").agg(*(ev.known_rate(F.col(c) == F.col("quality")).alias(n) for c, n in (("pred", "by_rule"), ("majority", "by_majority"))))


@query("E11_best_row_by_status", "SELECT o_custkey, arg_min(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) * 10000000000::BIGINT + o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def e11(t):
    s = F.col("o_orderstatus")
    return best_per_key(t.orders.select("o_custkey", "o_orderkey", s), "o_custkey", F.when(s == "F", 0).when(s == "O", 1).otherwise(2), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("F2_top_by_score", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def f2(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("F3_entry_order", f"WITH {ENTRIES} SELECT entry_id, tissue, label FROM e ORDER BY tissue, label, entry_id LIMIT 10")
def f3(t):
    return entries(t).select("entry_id", "tissue", "label").orderBy("tissue", "label", "entry_id").limit(10)


@query("F6_minimum_markers", f"WITH {CELLS}, {SHARES}, {RANKS}, {NAMED} SELECT label, count(*) AS n FROM named WHERE zr > 1.5 GROUP BY label HAVING count(*) >= 3")
def f6(t):
    stats, _ = named(t)
    return stats.where("lfc > 1.5").groupBy("label").agg(F.count("*").alias("n")).where("n >= 3")


@query("F7_first_twenty", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 20")
def f7(t):
    return t.customer.where("c_acctbal < 0").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").limit(20)


@query("F8_coverage_order", "SELECT source, n, CAST(row_number() OVER (ORDER BY n DESC, source) AS INT) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def f8(t):
    n = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", "n", F.row_number().over(Window.orderBy(F.desc("n"), "source")).alias("place"))  # one row a source


@query("H12_marker_score", "SELECT p_partkey, round(p_size / 16.0::DOUBLE * 0.5 * greatest(0, 1 - p_size / 64.0::DOUBLE), 4) AS s FROM part")
def h12(t):
    return t.part.select("p_partkey", sc.marker_score(F.col("p_size") / 16.0, F.lit(0.5), F.col("p_size") / 64.0).alias("s"))


@query("H14_negative_reason", "SELECT p_partkey, CASE WHEN p_size > 25 AND p_partkey % 5 = 0 THEN 'high_pct_out_low_pct_in' WHEN p_size % 4 = 0 THEN 'negative_logfc' ELSE 'low_expression' END AS r FROM part")
def h14(t):
    return t.part.select("p_partkey", sc.negative_reason(F.when(F.col("p_size") % 4 == 0, -0.6).otherwise(-0.5), F.when(F.col("p_partkey") % 5 == 0, 0.1).otherwise(0.2), F.col("p_size") / 50.0).alias("r"))


@query("D14_first_fifty", f"WITH {CELLS}, {SHARES}, {RANKS}, {NAMED}, f AS (SELECT label, gene, row_number() OVER (PARTITION BY label ORDER BY zr DESC, gene) AS k FROM named) SELECT label, gene, CAST(k AS INT) AS de_rank FROM f WHERE k <= 50")
def d14f(t):
    return mk.ranked(named(t)[0], F.desc("lfc"), 50).select("label", "gene", "de_rank")


ISOTONIC = f"""{JUDGED}, k AS (SELECT coalesce(score, 0) AS score, count(*) AS n, sum(exact::INT) AS s FROM j WHERE exact IS NOT NULL GROUP BY 1),
c AS (SELECT score, n, s, sum(n) OVER (ORDER BY score) AS nn, sum(s) OVER (ORDER BY score) AS ss FROM k),
p AS (SELECT a.score AS a, b.score AS score, (b.ss - a.ss + a.s)::DOUBLE / (b.nn - a.nn + a.n)::DOUBLE AS m FROM c a JOIN c b ON a.score <= b.score),
g AS (SELECT score, min(m) OVER (PARTITION BY a ORDER BY score DESC) AS g FROM p), f AS (SELECT score, max(g) AS p FROM g GROUP BY score),
u AS (SELECT DISTINCT coalesce(score, 0) AS s FROM j), lo AS (SELECT s, max(score) AS lo FROM u JOIN f ON score <= s GROUP BY s), hi AS (SELECT s, min(score) AS hi FROM u JOIN f ON score >= s GROUP BY s),
v AS (SELECT u.s, round(coalesce(a.p + (b.p - a.p) * coalesce((u.s - lo) / nullif(hi - lo, 0), 0), a.p, b.p), 4) AS calibrated FROM u LEFT JOIN lo USING (s) LEFT JOIN hi USING (s) LEFT JOIN f a ON a.score = lo LEFT JOIN f b ON b.score = hi)
SELECT doc_id, calibrated FROM j JOIN v ON coalesce(j.score, 0) = v.s"""


def scored(t: Tables) -> DataFrame:
    """doc_id, the eight features of each document's answer, and whether it is right."""
    rows = judged(t).withColumns({"c": F.when(F.col("score") >= 0.7, "high").when(F.col("score") >= 0.4, "medium").otherwise("low"), "e": F.when(F.col("lineage"), "strong").otherwise("weak"), "r": F.col("score") / 2, "n": F.col("doc_id") % 300, "i": F.when(F.col("doc_id") % 2 == 0, "CL:1"), "x": F.array().cast("array<string>"), "v": F.col("severe")})
    return rows.select("doc_id", "exact", *(c.alias(k) for k, c in cal.features("c", "score", "r", "e", "n", "i", "x", "v").items()))


def calibrated(t: Tables, method: str) -> DataFrame:
    rows = scored(t)
    return cal.Calibrator(method).fit(rows, "exact").calibrated(rows).select("doc_id", "calibrated")


@query("J_calibrator_logistic")
def j1(t):
    return calibrated(t, "logistic")


@query("J_calibrator_isotonic", f"WITH {ISOTONIC}")
def j2(t):
    """Spark's own isotonic regression, against the min-max formula."""
    return calibrated(t, "isotonic")


@query("J_isotonic_fit", f"WITH {ISOTONIC}")
def j2_plan(t):
    """The formula itself as a plan over counted scores."""
    rows = scored(t)
    return cal.interpolated(rows, cal.isotonic_fit(rows, "f_score", "exact"), "f_score").select("doc_id", "calibrated")


def load_model():
    """A stand-in for a language model: it answers a prompt with its longest word, and tells how long the prompt was."""

    def answer(prompts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        words = [max(p.split(" "), key=len) for p in prompts]
        return {"answer": np.array(words, dtype=object), "cost": np.array([len(p) for p in prompts]) + sizes.astype(np.int64)}

    return answer


@query("J_batch_inference", """WITH p AS (SELECT p_partkey, 'find ' || p_name || ' of ' || p_brand AS prompt, p_size FROM part), w AS (SELECT *, string_split(prompt, ' ') AS words FROM p),
m AS (SELECT *, list_max(list_transform(words, lambda x: length(x))) AS most FROM w) SELECT p_partkey, list_filter(words, lambda x: length(x) = most)[1] AS answer, length(prompt) + p_size AS cost FROM m""")
def j3(t):
    """Outputs of a model for each part's prompt, in batches."""
    rows = t.part.select("p_partkey", F.concat(F.lit("find "), "p_name", F.lit(" of "), "p_brand").alias("prompt"), "p_size")
    kind = StructType([StructField("answer", StringType()), StructField("cost", LongType())])
    return with_outputs(rows, load_model, ["prompt", "p_size"], "said", kind, batch=100).select("p_partkey", "said.answer", "said.cost")
