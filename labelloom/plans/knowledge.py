"""Retrieval and knowledge bases: documents ask, benchmark passages are the entries, words are the genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions import scoring as sc
from labelloom.operators import hierarchy as hi
from labelloom.operators import knowledge as op
from labelloom.plans.registry import Tables, query


def words(c: str):
    return F.filter(F.split(F.lower(F.col(c)), r"\s+"), lambda x: x != "")


def asked(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("query_id"), words("text").alias("genes"), F.col("lang").alias("tissue"))


def entries(t: Tables) -> DataFrame:
    k = F.col("item_id") % 4
    tissue = F.when(k == 0, "").when(k == 1, "en").when(k == 2, "de").otherwise("all")
    return t.benchmark.select(F.col("item_id").alias("entry_id"), F.concat(F.lit("L"), (F.col("item_id") % 7).cast("string")).alias("label"), words("text").alias("genes"), tissue.alias("tissue"), (F.col("item_id") % 5 / 5).alias("weight"))


WORDS = "list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda x: x <> '')"
ASKED = f"q AS (SELECT doc_id AS query_id, {WORDS.format(c='text')} AS genes, lang AS tissue FROM documents)"
ENTRIES = f"e AS (SELECT item_id AS entry_id, 'L' || (item_id % 7) AS label, {WORDS.format(c='text')} AS genes, CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'en' WHEN 2 THEN 'de' ELSE 'all' END AS tissue, item_id % 5 / 5 AS weight FROM benchmark)"
SHARED = "qg AS (SELECT DISTINCT query_id, g FROM (SELECT query_id, unnest(genes) AS g FROM q)), eg AS (SELECT DISTINCT entry_id, g FROM (SELECT entry_id, unnest(genes) AS g FROM e)), s AS (SELECT query_id, entry_id, count(*) AS shared FROM qg JOIN eg USING (g) GROUP BY ALL), j AS (SELECT s.*, q.tissue AS qt, e.tissue AS et, label, shared::DOUBLE / (len(list_distinct(q.genes)) + len(list_distinct(e.genes)) - shared) AS jaccard FROM s JOIN q USING (query_id) JOIN e USING (entry_id))"


TOP = """x AS (SELECT *, round(jaccard + CASE WHEN qt <> '' AND (contains(qt, et) OR contains(et, qt)) THEN 0.2 ELSE 0 END, 4) AS score FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM x) SELECT query_id, entry_id, shared, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5"""


@query("C9_without_tissue", f"WITH {ASKED.replace('lang AS tissue', 'CASE WHEN doc_id % 2 = 0 THEN lang END AS tissue')}, {ENTRIES}, {SHARED.replace('q.tissue AS qt', "coalesce(q.tissue, '') AS qt")}, {TOP}")
def c9_blank(t):
    """Queries without a tissue get no bonus."""
    return op.retrieved(asked(t).withColumn("tissue", F.when(F.col("query_id") % 2 == 0, F.col("tissue"))), entries(t), 5).select("query_id", "entry_id", "shared", "score", "rank")


@query("C9_jaccard_topk", f"WITH {ASKED}, {ENTRIES}, {SHARED}, {TOP}")
def c9(t):
    return op.retrieved(asked(t), entries(t), 5).select("query_id", "entry_id", "shared", "score", "rank")


def label_topk(scope: str) -> str:
    """SQL of the three best labels of each query, of the entries in its scope: a condition on entry e0 and tissue w."""
    return f"""WITH {ASKED}, {ENTRIES}, w AS (SELECT DISTINCT tissue AS w FROM q), e0 AS (SELECT w, e.* FROM e JOIN w ON {scope}),
b AS (SELECT w, label, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY w, label ORDER BY weight DESC, entry_id DESC) AS k FROM e0) WHERE k = 1),
eg AS (SELECT DISTINCT w, label, unnest(genes) AS g FROM e0), n AS (SELECT w, label, count(*) AS ne FROM eg GROUP BY ALL), qg AS (SELECT DISTINCT query_id, tissue AS w, unnest(genes) AS g FROM q),
s AS (SELECT query_id, w, label, count(*) AS shared FROM qg JOIN eg USING (w, g) GROUP BY ALL),
x AS (SELECT query_id, w, label, shared, round(shared::DOUBLE / (len(list_distinct(genes)) + ne - shared), 4) AS score FROM s JOIN q USING (query_id) JOIN n USING (w, label)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM x) SELECT query_id, label, shared, score, entry_id, CAST(rank AS INT) AS rank FROM r JOIN b USING (w, label) WHERE rank <= 3"""


@query("C10_label_union_topk", label_topk("true"))
def c10(t):
    return op.retrieved_labels(asked(t), entries(t), 3)


@query("C10_label_union_in_scope", label_topk("tissue IN ('', 'unknown', 'all') OR tissue = w.w"))
def c10_scoped(t):
    """Of each query only entries of its species, and of its tissue or of none, count."""
    human = F.lit("Homo sapiens")
    return op.retrieved_labels(asked(t).withColumn("species", human), entries(t).withColumn("species", human), 3, scoped=True)


@query("B17_scope_filter", f"WITH {ENTRIES} SELECT entry_id FROM e WHERE tissue IN ('', 'unknown', 'all', 'en')")
def b17(t):
    return entries(t).where(op.in_scope(F.lit("Human"), "tissue", F.lit("human "), F.lit("EN"))).select("entry_id")


@query("C18_label_lookup", f"WITH {ENTRIES} SELECT entry_id, label FROM e WHERE label = 'L3'")
def c18(t):
    return op.entries_by_label(entries(t), F.lit(" l3")).select("entry_id", "label")


@query("D12_merged_entries", f"""WITH {ENTRIES}, k AS (SELECT *, CASE WHEN entry_id % 3 = 0 THEN 'external' ELSE 'derived' END AS entry_type FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY tissue, label ORDER BY (entry_type <> 'external')::INT, weight DESC, entry_id) AS turn FROM k),
g AS (SELECT tissue, label, turn, i, genes[i] AS gene FROM (SELECT tissue, label, turn, genes, unnest(range(1, len(genes) + 1)) AS i FROM t)),
f AS (SELECT tissue, label, gene, min(turn * 1000000 + i) AS o FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tissue, label ORDER BY o) AS k FROM f),
u AS (SELECT tissue, label, string_agg(gene, '|' ORDER BY o) AS genes FROM r WHERE k <= 20 GROUP BY ALL), n AS (SELECT tissue, label, count(*) AS n_sources FROM t GROUP BY ALL)
SELECT t.tissue, t.label, t.entry_id, t.entry_type, u.genes, n_sources FROM t JOIN u ON t.tissue = u.tissue AND t.label = u.label JOIN n ON t.tissue = n.tissue AND t.label = n.label WHERE turn = 1""")
def d12(t):
    e = entries(t).withColumn("species", F.lit("human")).withColumn("entry_type", F.when(F.col("entry_id") % 3 == 0, "external").otherwise("derived"))
    return op.merged_entries(e).select("tissue", "label", "entry_id", "entry_type", F.array_join("genes", "|").alias("genes"), "n_sources")


@query("C6_rule_mapper", """WITH i AS (SELECT p_partkey AS ord, 'X:' || p_partkey AS id, lower(substr(p_name, 2, len(p_name) - 2)) AS name FROM part),
n AS (SELECT name, max_by(id, ord) AS id, min(ord) AS ord FROM i GROUP BY name), l AS (SELECT DISTINCT lower(p_name) AS key FROM part UNION SELECT DISTINCT lower(split_part(p_name, ' ', 1)) FROM part),
m AS (SELECT key, min_by(id, ord) AS id FROM l JOIN n ON contains(key, name) OR contains(name, key) GROUP BY key), r AS (SELECT p_name AS label FROM part UNION ALL SELECT split_part(p_name, ' ', 1) FROM part)
SELECT label, coalesce(n.id, m.id) AS id, CASE WHEN n.id IS NOT NULL THEN 'exact' WHEN m.id IS NOT NULL THEN 'part' ELSE 'none' END AS rule FROM r LEFT JOIN n ON lower(label) = name LEFT JOIN m ON lower(label) = m.key""")
def c6_column(t):
    index = t.part.select(F.concat(F.lit("X:"), "p_partkey").alias("id"), F.expr("substr(p_name, 2, length(p_name) - 2)").alias("label"), F.array().cast("array<string>").alias("synonyms"), F.col("p_partkey").alias("ord"))
    return op.rule_mapped(t.part.select(F.col("p_name").alias("label")).union(t.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)))), index)


@query("H18_overlap_score", f"""WITH p AS (SELECT d.doc_id, {WORDS.format(c='d.text')} AS q, {WORDS.format(c='b.text')} AS k FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)
SELECT doc_id, round(round(least(len(list_distinct(list_intersect(q, k)))::DOUBLE / len(list_distinct(list_concat(q, k))) + len(list_distinct(list_intersect(q[1:5], k)))::DOUBLE / len(list_distinct(q[1:5])) * 0.3, 1.0), 4), 4) AS score FROM p WHERE len(q) > 0""")
def h18(t):
    known = t.benchmark.select("item_id", words("text").alias("k"))
    size = F.broadcast(t.benchmark.agg(F.count("*").alias("size")))  # one row
    rows = t.documents.select("doc_id", words("text").alias("q")).crossJoin(size).join(known, F.col("doc_id") % F.col("size") == F.col("item_id")).where(F.size("q") > 0)
    return rows.select("doc_id", sc.overlap_score("q", "k").alias("score"))


PARTS = "p AS (SELECT p_partkey AS k, (p_partkey % 11)::DOUBLE / 19 AS o, p_size % 8 AS n, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 10) / 10.0 END AS q, p_size * 4 AS c FROM part)"
EVIDENCE = "CASE WHEN o >= 0.4 AND n >= 5 AND NOT coalesce(q < 0.2, false) THEN 'strong' WHEN (o >= 0.4 AND n >= 5) OR ((o >= 0.2 OR n >= 3) AND NOT coalesce(q < 0.2, false)) THEN 'moderate' WHEN o >= 0.2 OR n >= 3 OR o > 0 OR n >= 1 THEN 'weak' ELSE 'conflicting' END"


def parts(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(k.alias("k"), (k % 11 / 19.0).alias("o"), (F.col("p_size") % 8).alias("n"), F.when(k % 5 != 0, k % 10 / 10.0).alias("q"), (F.col("p_size") * 4).alias("c"))


@query("H20_evidence_level", f"WITH {PARTS} SELECT k, {EVIDENCE} AS level FROM p")
def h20(t):
    return parts(t).select("k", sc.evidence_level("o", "n", "q").alias("level"))


CONF = "round(least((CAST(o AS DOUBLE) * 0.5 + coalesce(CAST(q AS DOUBLE), 0) * 0.4) * (0.7 + 0.3 * least(1.0, c / 100.0::DOUBLE)), 1.0), 4)"


@query("H21_confidence_and_action", f"""WITH {PARTS}, s AS (SELECT *, {CONF} AS score, {EVIDENCE} AS level FROM p), l AS (SELECT *, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS label FROM s)
SELECT k, CAST(score AS DOUBLE) AS score, label, CASE WHEN k % 13 = 0 THEN 'novel_candidate' WHEN label = 'high' AND level IN ('strong', 'moderate') THEN 'accept' WHEN label = 'low' OR level = 'conflicting' THEN 'unresolved' ELSE 'review' END AS action FROM l""")
def h21(t):
    rows = parts(t).withColumn("score", sc.confidence_score("o", "q", "c")).withColumn("label", sc.confidence_label("score")).withColumn("level", sc.evidence_level("o", "n", "q"))
    return rows.select("k", "score", "label", sc.action("label", F.col("k") % 13 == 0, "level").alias("action"))


@query("C13_region_closure", "SELECT n_name AS label, r_name AS ancestor, 1 AS level FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'world', 2 FROM nation UNION ALL SELECT r_name, 'world', 1 FROM region")
def c13r(t):
    up = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    e = up.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")).union(t.region.select("r_name", F.lit("world")))
    return hi.ancestors(e, 3)
