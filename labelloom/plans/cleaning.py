"""Label cleaning on part types and order columns, against a small alias table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions import labels as lb
from labelloom.functions import text as tx
from labelloom.operators import cleaning as op
from labelloom.plans.registry import Tables, query, values

#: raw_label, normalized_label, id, parent_label, notes, ord: a later row with the same key wins.
ALIASES = [
    ("1-URGENT", "urgent", "CL:0000001", "priority", "upper case alias", 1),
    ("2-high", "high", "CL:0000002", "priority", "", 2),
    ("3-MEDIUM", "medium", "", "priority", "alias without id", 3),
    ("3-medium", "medium", "CL:0000003", "", "later row", 4),
    ("4-not specified", "none given", "", "", "no id", 5),
]
ALIAS_DDL = "raw_label string, normalized_label string, id string, parent_label string, notes string, ord int"
ALIAS_SQL = "al(key, normalized_label, id, parent_label, notes) AS (VALUES ('1-urgent', 'urgent', 'CL:0000001', 'priority', 'upper case alias'), ('2-high', 'high', 'CL:0000002', 'priority', ''), ('3-medium', 'medium', 'CL:0000003', '', 'later row'), ('4-not specified', 'none given', '', '', 'no id'))"


def aliases(t: Tables) -> DataFrame:
    return values(t.spark, ALIASES, ALIAS_DDL)


@query("C3_alias_lookup", f"""WITH {ALIAS_SQL}, l AS (SELECT o_orderkey, lower(trim(o_orderpriority)) AS clean_label FROM orders)
SELECT o_orderkey, clean_label, nullif(id, '') AS ontology_id, coalesce(normalized_label, clean_label) AS ontology_label, nullif(parent_label, '') AS parent_label,
  CASE WHEN coalesce(id, '') <> '' THEN CASE WHEN notes LIKE '%alias%' THEN 'alias' ELSE 'canonical' END ELSE 'unmapped' END AS status,
  CASE WHEN coalesce(parent_label, '') <> '' THEN 'leaf' ELSE 'broad' END AS level FROM l LEFT JOIN al ON clean_label = key""")
def c3(t):
    rows = op.mapped_labels(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", aliases(t))
    return rows.select("o_orderkey", "clean_label", "ontology_id", "ontology_label", "parent_label", "status", "level")


@query("H7_label_status", f"""WITH {ALIAS_SQL}, l AS (SELECT DISTINCT o_orderpriority AS label FROM orders UNION ALL SELECT DISTINCT c_mktsegment FROM customer UNION ALL SELECT * FROM (VALUES (''), (NULL), ('Unknown cell'), ('doublet T'), ('Another one')) v(label))
SELECT label, CASE WHEN coalesce(trim(label), '') = '' THEN 'empty' WHEN regexp_matches(lower(label), 'unknown|unassigned|ambiguous|doublet|multiplet|low quality|low-quality|debris|artifact|other') THEN 'ambiguous'
  WHEN coalesce(id, '') <> '' THEN CASE WHEN notes LIKE '%alias%' THEN 'alias' ELSE 'canonical' END ELSE 'unmapped' END AS status FROM l LEFT JOIN al ON lower(label) = key""")
def h7(t):
    extra = values(t.spark, [("",), (None,), ("Unknown cell",), ("doublet T",), ("Another one",)], "label string")
    rows = t.orders.select(F.col("o_orderpriority").alias("label")).distinct().union(t.customer.select("c_mktsegment").distinct()).union(extra)
    rows = rows.withColumn("key", tx.label_text("label")).join(op.alias_index(aliases(t)), "key", "left")
    return rows.select("label", lb.label_status("label", "id", F.col("normalized_label").isNotNull(), "notes").alias("status"))


@query("B6_ambiguous_filter", "SELECT p_partkey, p_type FROM part WHERE p_type IS NOT NULL AND NOT regexp_matches(lower(p_type), 'unknown|unassigned|ambiguous|doublet|multiplet|low quality|low-quality|debris|artifact|other')")
def b6(t):
    return op.unambiguous(t.part, "p_type").select("p_partkey", "p_type")


@query("B7_label_frequency", "SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY p_type HAVING count(*) >= 2)")
def b7(t):
    return op.frequent_labels(t.part.select("p_partkey", "p_type"), "p_type", 2)


@query("B5_primary_rows", "SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0")
def b5(t):
    from labelloom.operators.curation import primary_rows

    flag = F.when(F.col("c_custkey") % 2 == 0, "True").when(F.col("c_custkey") % 5 == 0, " yes ").when(F.col("c_custkey") % 3 == 0, "no")
    return primary_rows(t.customer.select("c_custkey", flag.alias("is_primary_data"))).select("c_custkey")


@query("B11_mapped_ratio_gate", "SELECT doc_id, source FROM documents WHERE source IN (SELECT d.source FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY d.source HAVING avg((quality IS NOT NULL)::INT) >= 0.4)")
def b11(t):
    marked = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return op.mapped_ratio_gate(marked, "source", "quality", 0.4).select("doc_id", "source")


@query("B12_default_values", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '  ' ELSE c_mktsegment END), ''), 'unknown') AS v FROM customer")
def b12(t):
    c = F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_custkey") % 11 == 0, "  ").otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", tx.or_default(c).alias("v"))


@query("B19_target_label", f"""WITH {ALIAS_SQL} SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN normalized_label END), ''), nullif(trim(parent_label), ''), nullif(trim(o_orderpriority), '')) AS target
FROM orders LEFT JOIN al ON lower(o_orderpriority) = key""")
def b19(t):
    rows = t.orders.select("o_orderkey", "o_orderpriority", tx.label_text("o_orderpriority").alias("key")).join(op.alias_index(aliases(t)), "key", "left")
    return rows.select("o_orderkey", op.target_label("ontology", F.when(F.col("o_orderkey") % 3 == 0, F.col("normalized_label")), "parent_label", "o_orderpriority").alias("target"))


@query("B20_group_key", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name WHEN c_custkey % 4 = 1 THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END AS g FROM customer")
def b20(t):
    k = F.col("c_custkey") % 4
    first = F.when(k == 0, F.col("c_name")).when(k == 1, "NaN").when(k == 2, " ")
    second = F.when(k == 1, F.concat(F.lit(" "), F.col("c_mktsegment"))).when(k == 2, "None")
    return t.customer.select("c_custkey", tx.group_key(first, second, last=F.col("c_nationkey").cast("string")).alias("g"))


@query("B16_fix_table", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' ELSE c_mktsegment END AS fixed_label, c_mktsegment = 'BUILDING' AS was_fixed FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def b16(t):
    fixes = values(t.spark, [("Building", "DROP", None, None, None, 1), ("building", "FIX", "construction", "X:1", "all", 2), ("machinery", "DROP", None, None, None, 3)], "key string, action string, canonical_label string, id string, parent_label string, ord int")
    return op.rewritten_labels(t.customer, "c_mktsegment", fixes).select("c_custkey", "fixed_label", "was_fixed")


@query("C8_anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def c8(t):
    return t.part.select("p_partkey").join(t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("C7_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def c7(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("C12_counts_with_default", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey) ON c_custkey = o_custkey")
def c12(t):
    n = t.orders.where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("C11_composite_key_join", """WITH m AS (SELECT o_custkey, o_orderstatus, max_by(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY ALL)
SELECT o_orderkey, priority FROM orders JOIN m USING (o_custkey, o_orderstatus)""")
def c11(t):
    keys = ["o_custkey", "o_orderstatus"]
    meta = t.orders.groupBy(*keys).agg(F.max_by("o_orderpriority", "o_orderkey").alias("priority"))
    return t.orders.join(meta, keys, "left").select("o_orderkey", "priority")


@query("C16_dimension_lookup", "SELECT s_suppkey, coalesce(r_name, 'unknown') AS scope FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_name <> 'CHINA' LEFT JOIN region ON n_regionkey = r_regionkey")
def c16(t):
    scope = t.nation.where("n_name <> 'CHINA'").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "r_name")
    return t.supplier.join(scope, "s_nationkey", "left").select("s_suppkey", F.coalesce("r_name", F.lit("unknown")).alias("scope"))


@query("D3_frequency_table", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def d3(t):
    return op.frequency_table(t.customer, "c_mktsegment")


@query("D4_null_groups", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL")
def d4(t):
    return t.orders.groupBy(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("s"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))


@query("D5_dominant_value", "WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS k FROM n) SELECT c_nationkey, c_mktsegment FROM r WHERE k = 1")
def d5(t):
    return op.dominant(t.customer, "c_nationkey", "c_mktsegment")


PROFILE = """WITH d AS (SELECT source, lang, n_chars % 7 AS kind, CASE WHEN n_chars % 2 = 0 THEN 'even' ELSE 'odd' END AS par FROM documents),
a AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM d GROUP BY source, lang),
b AS (SELECT source, par, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, par) AS k FROM d GROUP BY source, par)
SELECT d.source, count(*) AS n_records, count(DISTINCT kind) AS n_types, any_value(a.lang) AS main_lang, any_value(b.par) AS main_par FROM d JOIN a ON a.source = d.source AND a.k = 1 JOIN b ON b.source = d.source AND b.k = 1 GROUP BY d.source"""


@query("D6_profile", PROFILE)
def d6(t):
    d = t.documents.select("source", "lang", (F.col("n_chars") % 7).alias("kind"), F.when(F.col("n_chars") % 2 == 0, "even").otherwise("odd").alias("par"))
    return op.profile(d, "source", "kind", "lang", "par")


@query("D7_extended_profile", "SELECT source, count(*) AS n_records, count(quality) AS n_mapped, round(count(quality)::DOUBLE / count(*), 4) AS mapped_ratio, round(avg(quality), 4) AS mean_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def d7(t):
    d = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left").withColumn("q", F.col("quality").cast("double"))
    return op.profile(d, "source", "lang", "lang", "toxic", "quality", "q").select("source", "n_records", "n_mapped", "mapped_ratio", "mean_quality")


@query("D8_mapping_stats", "SELECT count(*) AS n, count(quality) AS n_mapped, round(count(quality)::DOUBLE / count(*), 4) AS mapped_ratio, count(DISTINCT source) AS n_labels, count(DISTINCT quality) AS n_ids FROM documents LEFT JOIN labels USING (doc_id)")
def d8(t):
    return op.mapping_stats(t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left"), "quality", "source")


@query("B21_clean_status", "SELECT source, CASE WHEN count(*) FILTER (lang = 'en') = 0 THEN 'skipped_no_rows_left' WHEN count(DISTINCT lang) < 2 THEN 'skipped_one_label' ELSE 'ok' END AS status FROM documents GROUP BY source")
def b21(t):
    n = t.documents.groupBy("source").agg(F.count("*").alias("a"), F.count_if(F.col("lang") == "en").alias("b"), F.count_distinct("lang").alias("c"))
    return n.select("source", op.clean_status("a", "b", "c").alias("status"))


CLEAN4 = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[_\\-/,]', ' ', 'g'), '\\bhuman\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
ODD = "(VALUES (1, 'CD4-positive_T cell'), (2, ' Human  NK cell '), (3, 'Treg'), (4, 'b cell precursor'), (5, NULL), (6, 'erythroid cell'), (7, 'CD8/T cell,human'), (8, 'Plasma cell')) v(k, s)"
ODD_ROWS = [(1, "CD4-positive_T cell"), (2, " Human  NK cell "), (3, "Treg"), (4, "b cell precursor"), (5, None), (6, "erythroid cell"), (7, "CD8/T cell,human"), (8, "Plasma cell")]


def odd(t: Tables) -> DataFrame:
    return values(t.spark, ODD_ROWS, "k int, s string")


@query("H1_text_or_null", "SELECT doc_id, nullif(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '') AS s FROM documents")
def h1(t):
    return t.documents.select("doc_id", tx.text_or_null("text").alias("s"))


@query("H2_label_text", "SELECT p_partkey, lower(p_name) AS s FROM part")
def h2(t):
    return t.part.select("p_partkey", tx.label_text(F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   "), F.lit("\t"))).alias("s"))


@query("H4_plain_label", f"SELECT k, {CLEAN4.format(c='s')} AS s FROM {ODD} UNION ALL SELECT p_partkey, {CLEAN4.format(c='p_name')} FROM part")
def h4(t):
    return odd(t).select("k", tx.plain_label("s").alias("s")).union(t.part.select("p_partkey", tx.plain_label("p_name")))


@query("H5_folded", "SELECT c_custkey, lower(c_name) AS s FROM customer")
def h5(t):
    return t.customer.select("c_custkey", tx.folded(F.concat(F.lit("\n "), F.col("c_name"), F.lit(" "))).alias("s"))


@query("H8_label_levels", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'broad' WHEN len(string_split(p_name, ' ')) <= 2 THEN 'leaf' ELSE 'intermediate' END AS by_words, CASE WHEN p_partkey % 3 = 0 THEN 'broad' ELSE 'leaf' END AS by_parent FROM part")
def h8(t):
    parent = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))
    return t.part.select("p_partkey", lb.level_by_words("p_name", parent).alias("by_words"), lb.leaf_or_broad(parent).alias("by_parent"))


@query("H11_short_id", "SELECT c_custkey, substring(md5(c_name || '|' || c_mktsegment || '|'), 1, 16) AS id FROM customer")
def h11(t):
    return t.customer.select("c_custkey", tx.short_id("c_name", "c_mktsegment", F.lit(None)).alias("id"))


@query("H50_tokens", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS tokens FROM part")
def h50(t):
    return t.part.select("p_partkey", F.array_join(tx.tokens("p_name"), "|").alias("tokens"))


@query("D9_distribution", "SELECT * FROM (SELECT p AS o_orderstatus, coalesce(n, 0) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(p) LEFT JOIN (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus) ON p = o_orderstatus)")
def d9(t):
    from labelloom.operators.evaluation import histogram

    return histogram(t.orders, "o_orderstatus", ["F", "O", "P", "X"])


@query("D10_collected_records", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def d10(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), "|").alias("orders"))
