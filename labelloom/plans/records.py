"""Chat records, parsing, splits and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.operators import manifest as mf
from labelloom.operators import records as op
from labelloom.operators import splits as sp
from labelloom.plans.evaluation import SPLIT
from labelloom.plans.registry import Tables, query, values
from labelloom.streaming.incremental import windowed_counts


@query("A11_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INT) >= 50")
def a11(t):
    rows = t.events.select("event_id", F.from_json("props", "k int").alias("p")).where("p.k >= 50")
    return rows.select("event_id", "p.k")


@query("A12_accepted_records", "SELECT vec_id FROM embeddings WHERE len(embedding) > 0 AND label IS NOT NULL AND label <> 3")
def a12(t):
    from labelloom.sources.files import accepted_records

    return accepted_records(t.embeddings.withColumn("l", F.when(F.col("label") != 3, F.col("label"))), "embedding", "l").select("vec_id")


@query("A20_best_status", "SELECT o_custkey, CASE p WHEN 3 THEN 'ok' WHEN 2 THEN 'skipped' ELSE 'failed' END AS status, k AS o_orderkey FROM (SELECT o_custkey, max(p) AS p, max_by(o_orderkey, p * 1000000000::BIGINT + o_orderkey) AS k FROM (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS p FROM orders) GROUP BY o_custkey)")
def a20(t):
    s = F.col("o_orderstatus")
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(s == "F", "ok").when(s == "O", "skipped").otherwise("failed").alias("status"))
    return mf.best_status(rows, "o_custkey", order="o_orderkey")


@query("A22_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def a22(t):
    done = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "done").otherwise("failed").alias("status"))
    return mf.to_do(t.orders.select("o_orderkey"), done, "o_orderkey")


@query("A19_upsert", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, 'NEW' FROM customer WHERE c_custkey % 10 = 0")
def a19(t):
    old = t.customer.select("c_custkey", "c_mktsegment")
    return mf.upserted(old, old.where("c_custkey % 10 = 0").withColumn("c_mktsegment", F.lit("NEW")), "c_custkey")


@query("A9_append_unseen", "SELECT DISTINCT lower(c_mktsegment) AS label FROM customer")
def a9(t):
    old = t.customer.where("c_mktsegment in ('BUILDING', 'MACHINERY')").select(F.lower("c_mktsegment").alias("label")).distinct()
    return mf.appended(old, t.customer.select(F.lower(F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("label")).distinct(), "label").select(F.trim("label").alias("label"))


@query("A23_recovered_rows", "SELECT source, count(*) AS n, 'recovered' AS status FROM documents WHERE source NOT IN ('src0', 'src1') GROUP BY source")
def a23(t):
    return mf.recovered(t.documents, values(t.spark, [("src0",), ("src1",)], "source string"), "source")


@query("A23_without_orphans", "SELECT doc_id FROM documents WHERE source IN ('src0', 'src1')")
def a23o(t):
    return mf.without_orphans(t.documents, values(t.spark, [("src0",), ("src1",)], "source string"), "source").select("doc_id")


@query("D35_status_counts", "SELECT count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O FROM orders")
def d35(t):
    return mf.status_counts(t.orders.withColumnRenamed("o_orderstatus", "status"), "F", "O")


@query("A26_conformed_rows", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note FROM nation")
def a26(t):
    return mf.conformed(t.nation, "n_nationkey long, n_name string, note string")


def chats(t: Tables) -> DataFrame:
    return op.conversations(t.conversations)


@query("H41_last_answer", "WITH a AS (SELECT conv_id, max_by(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT DISTINCT c.conv_id, answer FROM conversations c LEFT JOIN a ON a.conv_id = c.conv_id")
def h41(t):
    return chats(t).select("conv_id", op.last_answer("messages").alias("answer"))


@query("H41_prompt_part", "SELECT conv_id, count(*) FILTER (role <> 'assistant') AS n, count(*) AS n_all FROM conversations GROUP BY conv_id")
def h41p(t):
    return chats(t).select("conv_id", F.size(op.prompt_part("messages")).cast("long").alias("n"), F.size("messages").cast("long").alias("n_all"))


@query("H41_suffix", "SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN text || chr(10) || 'Hint.' ELSE text END, '|' ORDER BY turn) AS s FROM conversations GROUP BY conv_id")
def h41s(t):
    m = op.with_suffix("messages", "user", "Hint.")
    return chats(t).select("conv_id", F.array_join(F.transform(m, lambda x: x["content"]), "|").alias("s"))


@query("G8_sound_messages", "SELECT conv_id, count(*) >= 2 AND count(*) FILTER (role IS NULL OR text IS NULL OR text = '') = 0 AS ok FROM conversations GROUP BY conv_id")
def g8(t):
    return chats(t).select("conv_id", op.sound_messages("messages").alias("ok"))


@query("H37_answer_json", "SELECT c_custkey, c_mktsegment AS label, CAST(NULL AS VARCHAR) AS parent FROM customer")
def h37(t):
    j = t.customer.select("c_custkey", op.answer_json(label="c_mktsegment", parent=F.lit(None).cast("string")).alias("j"))
    return j.select("c_custkey", F.get_json_object("j", "$.label").alias("label"), F.get_json_object("j", "$.parent").alias("parent"))


@query("H38_prompt", "SELECT p_partkey, concat_ws(chr(10), 'Organism: human', 'Tissue: ' || p_brand, 'Disease: unknown', 'Cluster size: ' || p_size, 'Ranked markers: ' || array_to_string(string_split(p_name, ' '), ', ')) AS prompt FROM part")
def h38(t):
    return t.part.select("p_partkey", op.prompt(F.lit("human"), "p_brand", F.lit(None), "p_size", F.split("p_name", " ")).alias("prompt"))


@query("H39_marker_lines", "SELECT p_partkey, '1. ' || p_brand || ' (logFC=1.50, pct_in=0.25, pct_out=0.12)' AS lines FROM part")
def h39(t):
    m = F.array(F.struct(F.col("p_brand").alias("gene"), F.lit(1.5).alias("lfc"), F.lit(0.25).alias("pct_in"), F.lit(0.12).alias("pct_out")))
    return t.part.select("p_partkey", op.marker_lines(m).alias("lines"))


@query("H40_prompt_fields", "SELECT p_partkey, p_brand AS tissue, CAST(p_size AS VARCHAR) AS size, CAST(NULL AS VARCHAR) AS absent FROM part")
def h40(t):
    p = t.part.select("p_partkey", op.prompt(F.lit("human"), "p_brand", F.lit(None), "p_size", F.split("p_name", " ")).alias("p"))
    return p.select("p_partkey", op.prompt_field("p", "Tissue").alias("tissue"), op.prompt_field("p", "Cluster size").alias("size"), op.prompt_field("p", "Age").alias("absent"))


@query("H43_chat_record", "SELECT p_partkey, 'system|user|assistant' AS roles, '{\"label\":\"' || p_brand || '\"}' AS answer FROM part")
def h43(t):
    m = t.part.select("p_partkey", op.chat_record("You name groups.", F.concat(F.lit("Name "), F.col("p_name")), op.answer_json(label="p_brand")).alias("m"))
    return m.select("p_partkey", F.array_join(F.transform("m", lambda x: x["role"]), "|").alias("roles"), op.last_answer("m").alias("answer"))


@query("H44_simplified_targets", "SELECT p_partkey, '{\"label\":\"' || p_brand || '\",\"parent\":\"' || p_type || '\"}' AS j FROM part")
def h44(t):
    return t.part.select("p_partkey", op.answer_json(label="p_brand", parent="p_type").alias("j"))


@query("H46_missing_keys", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'quality|toxic' ELSE '' END AS missing FROM documents LEFT JOIN labels USING (doc_id)")
def h46(t):
    d = t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left")
    return d.select("doc_id", F.array_join(op.missing_keys({c: F.col(c) for c in ("text", "quality", "toxic")}), "|").alias("missing"))


@query("H47_report_text", "SELECT p_partkey, format('{:.1f}%', p_size * 1.0) AS pct, CASE WHEN length(p_name) > 12 THEN left(p_name, 9) || '...' ELSE p_name END AS line FROM part")
def h47(t):
    return t.part.select("p_partkey", tx.percent(F.col("p_size") / 100).alias("pct"), tx.one_line("p_name", 12).alias("line"))


def groups(t: Tables) -> DataFrame:
    return t.documents.select("source").distinct()


@query("G4_group_split", f"WITH {SPLIT} SELECT source, split FROM sp")
def g4(t):
    return sp.group_split(groups(t), "source")


@query("G5_stratified_split", """WITH c AS (SELECT c_custkey, c_nationkey, row_number() OVER w AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY md5('42|' || c_custkey), c_custkey)),
s AS (SELECT *, greatest(1, CAST(round_even(n * 0.15, 0) AS INT)) AS nt, greatest(1, CAST(round_even(n * 0.10, 0) AS INT)) AS nv FROM c)
SELECT c_custkey, c_nationkey, CASE WHEN k <= CASE WHEN n <= 2 OR n - nt - nv < 1 THEN 1 ELSE n - nt - nv END THEN 'train' WHEN n > 2 AND k <= n - nt THEN 'val' ELSE 'test' END AS split FROM s""")
def g5(t):
    return sp.group_split(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", strata="c_nationkey")


@query("G5_small_split", """SELECT s_suppkey, CASE WHEN k = 2 THEN 'test' WHEN k = 3 AND n >= 4 THEN 'val' ELSE 'train' END AS split FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('42|' || s_suppkey), s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)""")
def g5s(t):
    return sp.small_stratified_split(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey", "s_nationkey").select("s_suppkey", "split")


@query("G6_pseudo_validation", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= least(30, greatest(2, round_even((SELECT count(*) FROM documents) * 0.08, 0))) THEN 'pseudo_val' ELSE 'train' END AS split FROM documents")
def g6(t):
    return sp.pseudo_validation(t.documents.select("doc_id"), "doc_id")


@query("G7_routed_records", f"WITH {SPLIT} SELECT doc_id, split FROM documents JOIN sp USING (source)")
def g7(t):
    return sp.routed(t.documents.select("doc_id", "source"), sp.group_split(groups(t), "source"), "source").select("doc_id", "split")


@query("G3_no_overlap", "SELECT 'by language' AS kind, source FROM documents GROUP BY source HAVING count(DISTINCT lang = 'de') > 1")
def g3(t):
    """Sources that lie in more than one split: none of a split by source, and those with German and other texts of one by language."""
    docs = t.documents.select("doc_id", "source", "lang")
    sound = sp.routed(docs, sp.group_split(groups(t), "source"), "source")
    leaky = docs.withColumn("split", F.when(F.col("lang") == "de", "val").otherwise("train"))
    found = lambda df, kind: sp.overlapping_groups(df, "source").select(F.lit(kind).alias("kind"), "source")
    return found(sound, "by source").union(found(leaky, "by language"))


@query("D36_split_manifest", f"WITH {SPLIT} SELECT split, count(*) AS n_records, count(DISTINCT source) AS n_groups FROM documents JOIN sp USING (source) GROUP BY split")
def d36(t):
    return sp.manifest(sp.routed(t.documents.select("doc_id", "source"), sp.group_split(groups(t), "source"), "source"), "source")


@query("G9_stratified_sample", "SELECT doc_id, CASE WHEN k <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels)")
def g9(t):
    return sp.stratified_sample(t.labels.select("doc_id", "quality"), "quality", "doc_id", 0.2).select("doc_id", "part")


@query("B13_hard_subset", "SELECT p_partkey FROM part WHERE p_size % 3 <> 0 OR p_retailprice < 1000 OR p_type IN (SELECT p_type FROM part GROUP BY p_type HAVING count(*) <= 1)")
def b13(t):
    conf = F.when(F.col("p_size") % 3 == 0, "high").otherwise("low")
    return sp.hard_subset(t.part, conf, "p_retailprice", "p_type", 1000).select("p_partkey")


@query("B14_rare_subset", "SELECT p_partkey FROM part WHERE p_name || p_brand IN (SELECT p_name || p_brand FROM part GROUP BY 1 HAVING count(*) <= 2)")
def b14(t):
    rows = t.part.select("p_partkey", F.concat("p_name", "p_brand").alias("k"))
    return sp.rare_subset(rows, rows.select("k"), "k", 2).select("p_partkey")


@query("B15_unmapped_subset", "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 OR o_orderstatus = 'P' OR o_totalprice > 400000")
def b15(t):
    rows = t.orders.withColumn("i", F.when(F.col("o_orderkey") % 7 != 0, "CL:1"))
    return sp.unmapped_subset(rows, "i", F.when(F.col("o_orderstatus") == "P", "unmapped"), F.col("o_totalprice") > 400000).select("o_orderkey")


@query("I_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def i1(t):
    return windowed_counts(t.events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
