"""Small cases of column functions and operators, each beside the rows it should give."""

from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from labelloom.functions import labels as lb
from labelloom.functions import scoring as sc
from labelloom.functions import text as tx
from labelloom.operators import evaluation, records
from labelloom.operators import hierarchy as hi
from labelloom.operators import knowledge as kn
from labelloom.operators.records import answer_json, json_text
from labelloom.plans.registry import values
from tests.compare import rows

CASES = {}


def query(name, sql):
    def add(f):
        CASES[name] = f, sql
        return f

    return add


ODD_ROWS = [(1, "CD4-positive_T cell"), (2, " Human  NK cell "), (3, "Treg"), (4, "b cell precursor"), (5, None), (6, "erythroid cell"), (7, "CD8/T cell,human"), (8, "Plasma cell")]


def odd(t):
    return values(t.spark, ODD_ROWS, "k int, s string")


@query("H3_canonical_label", "SELECT k, CASE k WHEN 1 THEN 't cell' WHEN 2 THEN 'nk cell' WHEN 3 THEN 'hepatocyte' END AS s FROM (VALUES (1), (2), (3), (4)) v(k)")
def h3(t):
    return values(t.spark, [(1, " T  Cells"), (2, "nk cells "), (3, "Hepatocyte"), (4, " ")], "k int, s string").select("k", tx.canonical_label("s").alias("s"))


@query("H6_long_label", "SELECT * FROM (VALUES (1, 'cd4 positive t cell'), (2, 'natural killer cell'), (3, 'regulatory t cell'), (4, 'precursor b cell'), (5, ''), (6, 'erythrocyte'), (7, 'cd8 positive alpha beta t cell'), (8, 'plasma cell')) v(k, s)")
def h6(t):
    return odd(t).select("k", tx.long_label("s").alias("s"))


@query("H10_tolerant_numbers", "SELECT * FROM (VALUES (1, 12, 12.0::DOUBLE), (2, NULL, 1.5), (3, NULL, NULL), (4, NULL, NULL), (5, NULL, 0.123457), (6, NULL, NULL)) v(k, i, d)")
def h10(t):
    v = values(t.spark, [(1, " 12 "), (2, "1.5"), (3, "NaN"), (4, "Infinity"), (5, "0.12345678"), (6, None)], "k int, s string")
    return v.select("k", tx.whole_number("s").cast("int").alias("i"), tx.number("s").alias("d"))


@query("H31_truth", "SELECT * FROM (VALUES (1, true), (2, false), (3, NULL), (4, true), (5, NULL)) v(k, b)")
def h31(t):
    return values(t.spark, [(1, " Yes"), (2, "0"), (3, "maybe"), (4, "TRUE"), (5, None)], "k int, s string").select("k", tx.truth("s").alias("b"))


PAIRS = [(1, "CD4 T cell", "cd4-positive alpha beta T cell"), (2, "NK cell", "natural killer cell"), (3, "B cell", "T cell"), (4, "memory T cell", "naive T cell"), (5, "T cell", "regulatory T cell"), (6, None, "T cell"), (7, "hepatocyte", "Hepatocyte"), (8, "neuron", "astrocyte"), (9, "gamma delta T cell", "T cell"), (10, "platelet", "megakaryocyte")]


def pairs(t):
    return values(t.spark, PAIRS, "k int, p string, g string")


@query("H25_lineage", "SELECT * FROM (VALUES (1, 't_cell', 't_cell'), (2, 'nk', 'nk'), (3, 'b_cell', 'b_cell'), (4, 't_cell', 't_cell'), (5, 't_cell', 't_cell'), (6, 'unknown', 'unknown'), (7, 'hepatocyte', 'other'), (8, 'other', 'other'), (9, 'gamma_delta_t', 'gamma_delta_t'), (10, 'megakaryocyte_platelet', 'megakaryocyte_platelet')) v(k, a, b)")
def h25(t):
    return pairs(t).select("k", lb.lineage("p").alias("a"), lb.lineage_long("p").alias("b"))


@query("H26_granularity", "SELECT * FROM (VALUES (1, 'same', false), (2, 'same', false), (3, 'same', false), (4, 'same', true), (5, 'same', false), (6, 'same', false), (7, 'same', false), (8, 'same', false), (9, 'finer_than_gold', false), (10, 'same', false)) v(k, g, c)")
def h26(t):
    return pairs(t).select("k", lb.granularity("p", "g").alias("g"), lb.subtype_conflict("p", "g").alias("c"))


@query("H27_compare_as_written", "SELECT * FROM (VALUES (1, false, 0.5::DOUBLE, true, false), (2, false, 0.3333, true, false), (3, false, 0.5, false, true), (4, false, 0.6667, true, false), (5, false, 0.6667, true, false), (6, false, 0.0, false, false), (7, true, 1.0, true, false), (8, false, 0.0, true, false), (9, false, 0.5, false, true), (10, false, 0.0, true, false)) v(k, exact, token_overlap, same_lineage, severe_error)")
def h27(t):
    c = lb.compared("p", "g")
    return pairs(t).select("k", *(c[n].alias(n) for n in ("exact", "token_overlap", "same_lineage", "severe_error")))


@query("H28_compare_match_level", "SELECT * FROM (VALUES (1, 'normalized_exact'), (2, 'normalized_exact'), (3, 'cross_lineage_error'), (4, 'same_lineage_conflict'), (5, 'same_lineage_close'), (6, 'unavailable'), (7, 'exact'), (8, 'same_lineage_broad'), (9, 'cross_lineage_error'), (10, 'same_lineage_broad')) v(k, match_level)")
def h28(t):
    return pairs(t).select("k", lb.compared_long("p", "g")["match_level"].alias("match_level"))


@query("H29_list_overlap", "SELECT * FROM (VALUES (1, 0.3333::DOUBLE), (2, NULL), (3, 0.0), (4, 1.0)) v(k, o)")
def h29(t):
    rows = values(t.spark, [(1, ["CD3", "cd4"], ["cd4 ", "CD8"]), (2, [], None), (3, ["a"], []), (4, ["A", "a"], ["a"])], "k int, a array<string>, b array<string>")
    return rows.select("k", lb.list_overlap("a", "b").alias("o"))


@query("H32_record_metrics", "SELECT * FROM (VALUES (1, false, true, true, true), (2, true, NULL, NULL, false), (3, NULL, NULL, false, true), (4, false, false, false, false)) v(k, exact_match, parent_match, id_match, ontology_mapped)")
def h32(t):
    rows = values(t.spark, [(1, "T cell", "memory t cell", "cl:1", "CL:1"), (2, "b cell", " B cell", "x", ""), (3, "nk", None, "CL:2", "CL:3"), (4, "", "t cell", None, "CL:1")], "k int, p string, g string, pi string, gi string")
    m = evaluation.record_metrics("p", "g", "pi", "gi")
    return rows.select("k", *(c.alias(n) for n, c in m.items()))


@query("D30_match_histogram", "SELECT * FROM (VALUES ('normalized_exact', 2::BIGINT, 1.0::DOUBLE), ('cross_lineage_error', 2, 0.417), ('same_lineage_conflict', 1, 0.5), ('same_lineage_close', 1, 0.667), ('unavailable', 1, NULL), ('exact', 1, 1.0), ('same_lineage_broad', 2, 0.0)) v(match_level, n, mean_overlap)")
def d30(t):
    c = lb.compared_long("p", "g")
    rows = pairs(t).select(c["match_level"].alias("match_level"), c["token_overlap"].alias("o"))
    return rows.groupBy("match_level").agg(F.count("*").alias("n"), F.round(F.avg("o"), 3).alias("mean_overlap"))


@query("D11_ontology_index", "SELECT * FROM (VALUES ('CL:1', 't cell', 'cd3|t lymphocyte', 'lymphocyte'), ('CL:2', 'b cell', '', 'lymphocyte')) v(id, label, synonyms, parent_label)")
def d11(t):
    a = [("T cells", "t cell", "CL:1", "", 1), ("T lymphocyte", "T-cell", "CL:1", "lymphocyte", 2), ("CD3", "t cell", "CL:1", "other", 3), ("B cells", "b cell", "CL:2", "lymphocyte", 4), ("junk", "junk", "", "", 5)]
    rows = kn.ontology_index(values(t.spark, a, "raw_label string, normalized_label string, id string, parent_label string, ord int"))
    return rows.select("id", "label", F.array_join("synonyms", "|").alias("synonyms"), "parent_label")


@query("C6_rule_mapper", "SELECT * FROM (VALUES ('T cell', 'CL:1', 'exact'), ('cd3', 'CL:1', 'synonym'), ('memory b cell', 'CL:2', 'part'), ('cell', 'CL:1', 'part'), ('neuron', NULL, 'none')) v(label, id, rule)")
def c6(t):
    index = values(t.spark, [("CL:1", "t cell", ["cd3", "t lymphocyte"], 1), ("CL:2", "b cell", [], 2)], "id string, label string, synonyms array<string>, ord int")
    return kn.rule_mapped(values(t.spark, [("T cell",), ("cd3",), ("memory b cell",), ("cell",), ("neuron",)], "label string"), index)


@query("H48_external_entries", "SELECT * FROM (VALUES ('t cell', 'CL:1', 'lymphocyte', 'CD3|CD4', 0.1235::DOUBLE, 'external')) v(label, id, parent_label, genes, weight, entry_type)")
def h48(t):
    rows = values(t.spark, [("human", "Blood", " T  cell", "", [" CD3", "", "CD4 "], 0.12345)], "species string, tissue string, label string, id string, marker_genes array<string>, weight double")
    labels = values(t.spark, [("t cell", "CL:1", "lymphocyte")], "key string, id string, parent_label string")
    return kn.external_entries(rows, labels).select("label", "id", "parent_label", F.array_join("genes", "|").alias("genes"), "weight", "entry_type")


@query("H49_derived_entries", "SELECT * FROM (VALUES ('b cell', 'MS4A1', 1.0::DOUBLE)) v(label, genes, weight)")
def h49(t):
    rows = values(t.spark, [("human", "Blood", "B cell", [("MS4A1",)], 1.7), ("human", "Blood", " ", [("X",)], 0.5), ("human", "Blood", "nk cell", [], 0.5)], "species string, tissue string, label string, markers array<struct<gene:string>>, quality double")
    return kn.derived_entries(rows).select("label", F.array_join("genes", "|").alias("genes"), "weight")


@query("H19_tissue_bonus", "SELECT * FROM (VALUES (1, 0.2::DOUBLE), (2, 0.1), (3, 0.1), (4, 0.0), (5, 0.0)) v(k, b)")
def h19(t):
    rows = values(t.spark, [(1, "Blood", ["lung", " blood"]), (2, "blood", ["peripheral blood", "blood"]), (3, "left lung", ["lung"]), (4, "", ["lung"]), (5, "skin", ["lung"])], "k int, q string, known array<string>")
    return rows.select("k", sc.tissue_bonus("q", "known").alias("b"))


@query("H24_decision_blend", "SELECT * FROM (VALUES (1, 0.825::DOUBLE, 'accept', 'matched'), (2, 0.64, 'review', 'unmatched'), (3, 0.425, 'review', 'no_retrieval'), (4, 0.525, 'novel_candidate', 'parent_match'), (5, 0.72, 'review', 'missing')) v(k, score, decision, status)")
def h24(t):
    c = "array<struct<overlap_score:double,label:string,id:string,parent:string>>"
    rows = values(t.spark, [
        (1, "T cell", "CL:1", 0.8, "strong", [(0.6, "t cell", "CL:1", "lymphocyte"), (0.3, "b cell", "CL:2", "lymphocyte")]),
        (2, "neuron", "CL:9", 0.8, "strong", [(0.6, "t cell", "CL:1", "lymphocyte")]),
        (3, "neuron", "CL:9", 0.5, "weak", []),
        (4, "lymphocyte", "CL:3", 0.6, "strong", [(0.2, "memory lymphocyte", "CL:1", "lymphocyte"), (0.1, "x", "", "")]),
        (5, "t cell", "", 0.9, "weak", [(0.4, "neuron", "CL:9", "")]),
    ], f"k int, label string, id string, m double, e string, cands {c}")
    rows = rows.withColumn("top", sc.best_candidate("cands")).withColumn("s", F.coalesce("top.overlap_score", F.lit(0.0)))
    agrees = F.coalesce(sc.retrieval_agrees(F.col("label"), F.col("top.label")), F.lit(False))
    rows = rows.withColumn("score", sc.blended_confidence(F.col("m"), F.col("s"), agrees))
    novel = (F.col("s") < 0.25) & (F.col("s") > 0)
    status = sc.ontology_status(F.col("id"), F.col("label"), F.col("top").isNotNull(), F.col("top.id"), F.col("top.label"), F.col("top.parent"))
    return rows.select("k", "score", sc.decision(F.col("score"), F.col("e"), novel).alias("decision"), status.alias("status"))


EDGES = [("memory t cell", "t cell", 1), ("t cell", "lymphocyte", 2), ("lymphocyte", "leukocyte", 3), ("leukocyte", "cell", 4), ("loop a", "loop b", 5), ("loop b", "loop a", 6), ("self", "self", 7), ("b cell", "wrong", 8)]


def edges(t):
    base = values(t.spark, EDGES, "child string, parent string, ord int")
    more = values(t.spark, [("B-cell", "Lymphocyte", 1)], "child string, parent string, ord int")
    return hi.merged_edges(base, more)


EDGE_SQL = "e(child, parent) AS (VALUES ('memory t cell', 't cell'), ('t cell', 'lymphocyte'), ('lymphocyte', 'leukocyte'), ('leukocyte', 'cell'), ('loop a', 'loop b'), ('loop b', 'loop a'), ('self', 'self'), ('b cell', 'lymphocyte'))"


CLOSURE_SQL = EDGE_SQL + ", u(label, ancestor, level) AS (SELECT child, parent, 1 FROM e WHERE child <> parent UNION SELECT u.label, e.parent, level + 1 FROM u JOIN e ON u.ancestor = e.child WHERE level < 3 AND e.child <> e.parent AND u.label <> e.parent)"


@query("C15_merged_edges", f"WITH {EDGE_SQL} SELECT child, parent FROM e")
def c15(t):
    return edges(t)


@query("C13_ancestors", f"WITH RECURSIVE {CLOSURE_SQL} SELECT label, ancestor, min(level) AS level FROM u GROUP BY label, ancestor")
def c13(t):
    return hi.ancestors(edges(t), 3)


@query("C14_compatibility", "SELECT * FROM (VALUES (1, 'pred_is_parent'), (2, 'pred_is_child'), (3, 'exact'), (4, 'incompatible'), (5, 'exact'), (6, 'incompatible')) v(k, compat_type)")
def c14(t):
    pairs = values(t.spark, [(1, "lymphocyte", "Memory T-cell"), (2, "t cell", "leukocyte"), (3, "B cell", "b_cell"), (4, "b cell", "t cell"), (5, "", None), (6, "cell", "memory t cell")], "k int, pred string, gold string")
    return hi.with_compatibility(pairs, hi.ancestors(edges(t), 3)).select("k", "compat_type")


@query("B10_positive_effect", "SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false), (5, false)) v(k, p)")
def b10(t):
    rows = values(t.spark, [(1, 0.5), (2, float("inf")), (3, float("nan")), (4, None), (5, -1.0)], "k int, x double")
    return rows.select("k", sc.positive_effect("x").alias("p"))


INDEX = [("CL:1", "T cell", ["cd3"], "lymphocyte"), ("CL:2", "B cell", ["t cell", "b lymphocyte"], "lymphocyte")]


def index(t):
    return values(t.spark, INDEX, "id string, label string, synonyms array<string>, parent_label string")


@query("C4_prioritised_lookup", "SELECT * FROM (VALUES ('T cell', 'CL:1'), ('cd3', 'CL:1'), ('b lymphocyte', 'CL:2'), ('nk', 'CL:7'), ('none', NULL)) v(label, id)")
def c4(t):
    first = kn.lookup_keys(index(t)).groupBy("key").agg(F.min_by("id", "priority").alias("a"))
    second = values(t.spark, [("nk", "CL:7"), ("cd3", "CL:8")], "key string, b string")
    want = values(t.spark, [("T cell",), ("cd3",), ("b lymphocyte",), ("nk",), ("none",)], "label string").withColumn("key", F.lower("label"))
    return want.join(first, "key", "left").join(second, "key", "left").select("label", F.coalesce("a", "b").alias("id"))


@query("C5_store_lookup", "SELECT * FROM (VALUES ('t cell', 'CL:2', 1), ('cd3', 'CL:1', 1), ('b lymphocyte', 'CL:2', 1), ('b cell', 'CL:2', 0)) v(key, id, priority)")
def c5(t):
    return kn.lookup_keys(index(t)).groupBy("key").agg(F.max_by(F.struct("id", "priority"), F.struct("priority", "id")).alias("v")).select("key", "v.id", "v.priority")


@query("C19_valid_sets", "SELECT * FROM (VALUES ('t cell'), ('cd3'), ('b cell'), ('b lymphocyte')) v(key)")
def c19(t):
    return kn.lookup_keys(index(t)).select("key").distinct()


ANSWERS = [(1, "t cell", "CL:1", 10, 0.9, 500, False, False, False), (2, "b cell", "", 4, 0.5, 50, True, True, False), (3, "nk", None, 1, 0.1, 20, True, True, True)]


@query("H22_training_answer", "SELECT * FROM (VALUES (1, 'high', 'accept', 'strong', false, false), (2, 'low', 'unresolved', 'moderate', true, false), (3, 'low', 'novel_candidate', 'weak', true, true)) v(k, confidence_label, decision, evidence_support_level, need_manual_review, novelty_flag)")
def h22(t):
    a = answers(t)
    return a.select("k", "a.confidence_label", "a.decision", "a.evidence_support_level", "a.need_manual_review", "a.novelty_flag")


def answers(t):
    rows = values(t.spark, ANSWERS, "k int, label string, id string, n int, q double, c int, low boolean, un boolean, rare boolean")
    rows = rows.withColumn("f", F.struct(F.col("low").alias("low_cells"), F.col("un").alias("ontology_unmapped"), F.col("rare").alias("rare_label_in_dataset")))
    return rows.withColumn("a", sc.training_answer("label", "id", "label", F.array(F.lit("CD3")), "n", "q", "c", "f"))


@query("H23_training_confidence", "SELECT * FROM (VALUES (1, 0.83::DOUBLE), (2, 0.2632), (3, 0.0419)) v(k, s)")
def h23(t):
    return answers(t).select("k", "a.confidence_score").withColumnRenamed("confidence_score", "s")


@query("H45_rescored_outputs", "SELECT * FROM (VALUES (1, true), (2, false), (3, false)) v(k, is_right)")
def h45(t):
    rows = values(t.spark, [(1, 'out: {"label": "T-cell"}', "t cell"), (2, '{"label": "x"}', "y"), (3, "none", "y")], "k int, s string, gold string")
    from labelloom.functions.text import plain_label

    return rows.select("k", F.coalesce(plain_label(F.get_json_object(json_text("s"), "$.label")) == plain_label("gold"), F.lit(False)).alias("is_right"))


@query("H37_answer_struct_json", "SELECT * FROM (VALUES (1, 't cell', 'accept'), (2, 'b cell', 'unresolved'), (3, 'nk', 'novel_candidate')) v(k, label, decision)")
def h37s(t):
    j = answers(t).select("k", answer_json(label="a.cell_type", decision="a.decision").alias("j"))
    return j.select("k", F.get_json_object("j", "$.label").alias("label"), F.get_json_object("j", "$.decision").alias("decision"))


@query("H42_content_text", "SELECT * FROM (VALUES (1, 'plain'), (2, 'a' || chr(10) || 'b'), (3, '[not json')) v(k, s)")
def h42(t):
    rows = values(t.spark, [(1, "plain"), (2, '[{"type":"text","text":"a"},{"type":"text","text":"b"}]'), (3, "[not json")], "k int, c string")
    return rows.select("k", records.content_text("c").alias("s"))


NOISY = [
    (1, '{"cell_type":"t cell","confidence_score":0.5}'),
    (2, '<think>{x}</think> {"cell_type":"b cell","novelty_flag":"yes"}'),
    (3, 'Sure: {"cell_type":"nk {cell}","supporting_markers":"A, B"} and {"cell_type":"other"}'),
    (4, "none here"),
    (5, '```json\n{"cell_type":"monocyte","confidence_label":"Very High","confidence_score":1.7}\n```'),
    (6, '{"cell_type":"broken"'),
    (7, '{"cell_type":"q \\" }","supporting_markers":["X","Y"],"decision":"ACCEPT"}'),
    (8, ""),
]


@query("H35_json_extract", """SELECT * FROM (VALUES (1, 't cell'), (2, 'b cell'), (3, 'nk {cell}'), (4, NULL), (5, 'monocyte'), (6, NULL), (7, 'q " }'), (8, NULL)) v(k, cell_type)""")
def h35(t):
    return values(t.spark, NOISY, "k int, s string").select("k", F.get_json_object(records.json_text("s"), "$.cell_type").alias("cell_type"))


@query("H36_parsed_answer", """SELECT * FROM (VALUES (1, true, 't cell', 0.5::DOUBLE, 'low', 'review', false, ''), (2, true, 'b cell', 0, 'low', 'review', true, ''), (3, true, 'nk {cell}', 0, 'low', 'review', false, 'A|B'), (4, false, '', 0, 'low', 'review', false, ''),
 (5, true, 'monocyte', 1, 'high', 'review', false, ''), (6, false, '', 0, 'low', 'review', false, ''), (7, true, 'q " }', 0, 'low', 'accept', false, 'X|Y'), (8, false, '', 0, 'low', 'review', false, '')) v(k, parse_ok, cell_type, confidence_score, confidence_label, decision, novelty_flag, markers)""")
def h36(t):
    rows = values(t.spark, NOISY, "k int, s string").select("k", records.parsed_answer("s").alias("a"))
    return rows.select("k", "a.parse_ok", "a.cell_type", "a.confidence_score", "a.confidence_label", "a.decision", "a.novelty_flag", F.array_join("a.supporting_markers", "|").alias("markers"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    f, sql = CASES[name]
    df = f(SimpleNamespace(spark=spark))
    got = duckdb.connect().execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())
