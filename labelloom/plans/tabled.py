"""Labels, knowledge bases, hierarchies and answers over whole tables: each part's key picks labels, numbers and gaps.

The SQL computes every result anew; it shares with the library only the fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import labels as lb
from labelloom.functions import scoring as sc
from labelloom.functions import text as tx
from labelloom.operators import evaluation as ev
from labelloom.operators import hierarchy as hi
from labelloom.operators import knowledge as kn
from labelloom.operators import records as rc
from labelloom.plans.registry import Tables, query

LABELS = (
    "CD4 T cell", "cd4-positive, alpha beta T cell", "NK cell", "natural killer cell", "B cell", "T cell", "memory T cell", "naive T cell", "regulatory T cell", "Treg", None, "", " ",
    "hepatocyte", "Hepatocyte ", "neuron", "gamma delta T cell", "platelet", "megakaryocyte", "CD8/T cell,human", "b cell precursor", "erythroid cell", "erythrocyte", "Plasma cell",
    "CD56-bright natural killer cell", "CD16 positive, CD56 dim natural killer cell", "CD16 negative monocyte", "non classical monocyte", "effector memory CD8 T cell", "human dendritic cell",
    "conventional dendritic cell, human", "T  cells", "NK cells ", "monocytes", " B  cells", "terminally differentiated activated T cell", "pro B cell",
)
TISSUES = ("Blood", " blood", "peripheral blood", "lung", "left lung", "", "skin", None)


def key() -> Column:
    return F.col("p_partkey")


def picked(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values)).cast("int") + 1)


def sql_text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def picked_sql(values: tuple, k: str) -> str:
    return f"[{', '.join(map(sql_text, values))}][({k}) % {len(values)} + 1]"


def pairs(t: Tables) -> DataFrame:
    """k, p and g: two labels for each part, every fourth of the first with a word of the part's name."""
    p = picked(LABELS, key())
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    g = picked(LABELS, key() * 7 + F.floor(key() / len(LABELS)))
    return t.part.select(key().alias("k"), F.when(key() % 4 == 3, F.concat(p, F.lit(" "), word)).otherwise(p).alias("p"), g.alias("g"), *(c for c in t.part.columns if c != "p_partkey"))


def plain(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[_\\-/,]', ' ', 'g'), '\\bhuman\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


def long(c: str) -> str:
    s = plain(c)
    for short, form in tx.LONG_FORMS:
        s = f"regexp_replace({s}, '\\b{short}\\b', '{form}', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def holds(c: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, {sql_text(x)})" for x in parts) + ")"


def lineage_sql(c: str, rules) -> str:
    return f"CASE WHEN {c} = '' THEN 'unknown' " + " ".join(f"WHEN {holds(c, parts)} THEN '{name}'" for name, parts in rules) + " ELSE 'other' END"


def words_sql(c: str) -> str:
    return f"list_distinct(list_filter(string_split({c}, ' '), lambda w: w <> ''))"


def specific_sql(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN 0 ELSE least(len(list_filter(string_split({c}, ' '), lambda w: w <> '')) // 4, 2) + " + " + ".join(f"contains({c}, '{w}')::INT" for w in lb.SPECIFIC) + " END"


def conflict_sql(a: str, b: str) -> str:
    parts = dict(lb.SUBTYPES)
    return "(" + " OR ".join(f"({holds(a, parts[x])} AND {holds(b, parts[y])}) OR ({holds(a, parts[y])} AND {holds(b, parts[x])})" for x, y in lb.CONFLICTS) + ")"


RAW = f"raw AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 3 THEN {picked_sql(LABELS, 'p_partkey')} || ' ' || split_part(p_name, ' ', 1) ELSE {picked_sql(LABELS, 'p_partkey')} END AS p, {picked_sql(LABELS, f'p_partkey * 7 + p_partkey // {len(LABELS)}')} AS g, part.* EXCLUDE (p_partkey) FROM part)"
COMPARED = f"""{RAW}, c AS (SELECT k, p, g, {plain('p')} AS pp, {plain('g')} AS gp, {long('p')} AS pl, {long('g')} AS gl FROM raw),
d AS (SELECT *, {lineage_sql('pp', lb.LINEAGES)} AS pa, {lineage_sql('gp', lb.LINEAGES)} AS ga, {lineage_sql('pl', lb.LINEAGES_LONG)} AS pb, {lineage_sql('gl', lb.LINEAGES_LONG)} AS gb, {specific_sql('pl')} AS ps, {specific_sql('gl')} AS gs, {conflict_sql('pl', 'gl')} AS conflict,
  {words_sql('pp')} AS pw, {words_sql('gp')} AS gw, {words_sql('pl')} AS plw, {words_sql('gl')} AS glw FROM c),
m AS (SELECT *, round(len(list_intersect(plw, glw)) / greatest(1, len(list_distinct(list_concat(plw, glw))))::DOUBLE, 4) AS shared FROM d),
levels AS (SELECT *, CASE WHEN pl = '' OR gl = '' THEN 'unavailable' WHEN pp = gp THEN 'exact' WHEN pl = gl THEN 'normalized_exact' WHEN pb = gb AND conflict THEN 'same_lineage_conflict'
  WHEN pb = gb AND shared >= 0.5 THEN 'same_lineage_close' WHEN pb = gb THEN 'same_lineage_broad' ELSE 'cross_lineage_error' END AS match_level FROM m)"""


@query("H25_lineage", f"WITH {COMPARED} SELECT k, pa AS a, pb AS b FROM d")
def h25(t):
    return pairs(t).select("k", lb.lineage("p").alias("a"), lb.lineage_long("p").alias("b"))


@query("H26_granularity", f"WITH {COMPARED} SELECT k, CASE WHEN ps = gs THEN 'same' WHEN ps < gs THEN 'coarser_than_gold' ELSE 'finer_than_gold' END AS g, conflict AS c FROM d")
def h26(t):
    return pairs(t).select("k", lb.granularity("p", "g").alias("g"), lb.subtype_conflict("p", "g").alias("c"))


@query("H27_compare_as_written", f"""WITH {COMPARED} SELECT k, pp = gp AND pp <> '' AS exact, CASE WHEN len(pw) > 0 AND len(gw) > 0 THEN round(len(list_intersect(pw, gw)) / greatest(len(pw), len(gw))::DOUBLE, 4) ELSE 0 END AS token_overlap,
  pa = ga AND pa <> 'unknown' AS same_lineage, pa <> ga AND pa <> 'unknown' AND ga <> 'unknown' AS severe_error FROM d""")
def h27(t):
    c = lb.compared("p", "g")
    return pairs(t).select("k", *(c[n].alias(n) for n in ("exact", "token_overlap", "same_lineage", "severe_error")))


@query("H28_compare_match_level", f"WITH {COMPARED} SELECT k, match_level, CASE WHEN match_level <> 'unavailable' THEN shared END AS token_overlap, CASE WHEN match_level <> 'unavailable' THEN pp <> gp AND pl <> gl AND pb <> gb END AS severe_error FROM levels")
def h28(t):
    return pairs(t).select("k", lb.comparison("p", "g").alias("c")).select("k", "c.match_level", "c.token_overlap", "c.severe_error")


@query("D30_match_histogram", f"WITH {COMPARED} SELECT match_level, count(*) AS n, round(avg(CASE WHEN match_level <> 'unavailable' THEN shared END), 3) AS mean_overlap FROM levels GROUP BY match_level")
def d30(t):
    rows = pairs(t).select(lb.comparison("p", "g").alias("c")).select("c.match_level", F.col("c.token_overlap").alias("o"))
    return rows.groupBy("match_level").agg(F.count("*").alias("n"), F.round(F.avg("o"), 3).alias("mean_overlap"))


def items_sql(c: str) -> str:
    return f"list_distinct(list_filter(list_transform(string_split({c}, ' '), lambda w: {plain('w')}), lambda w: w <> ''))"


@query("H29_list_overlap", f"""WITH {RAW}, w AS (SELECT k, {items_sql("coalesce(p, '')")} AS a, CASE WHEN k % 7 = 0 THEN [] ELSE {items_sql("coalesce(g, '')")} END AS b FROM raw)
SELECT k, CASE WHEN len(a) + len(b) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 4) END AS o FROM w""")
def h29(t):
    a, b = F.split(F.coalesce("p", F.lit("")), " "), F.split(F.upper(F.coalesce("g", F.lit(""))), " ")
    return pairs(t).select("k", a.alias("a"), F.when(F.col("k") % 7 != 0, b).alias("b")).select("k", lb.list_overlap("a", "b").alias("o"))


def with_ids(df: DataFrame) -> DataFrame:
    """pairs with ids: some missing, some in another case, some of another kind."""
    k = F.col("k")
    number = (k % 3).cast("string")
    pi = F.when(k % 5 == 0, None).when(k % 5 == 1, "").when(k % 5 == 2, F.concat(F.lit("CL:"), number)).when(k % 5 == 3, F.concat(F.lit(" cl:"), number)).otherwise("x:1")
    gi = F.when(k % 4 == 0, None).when(k % 4 == 1, "").otherwise(F.concat(F.lit("CL:"), (k % 2).cast("string")))
    return df.withColumns({"pi": pi, "gi": gi})


IDS = f"{RAW}, ids AS (SELECT *, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'CL:' || k % 3 WHEN 3 THEN ' cl:' || k % 3 ELSE 'x:1' END AS pi, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'CL:' || k % 2 END AS gi FROM raw)"


def fold(c: str) -> str:
    return f"lower(trim(coalesce({c}, '')))"


@query("H32_record_metrics", f"""WITH {IDS}, f AS (SELECT *, {fold('p')} AS fp, {fold('g')} AS fg, {fold('pi')} AS fpi, {fold('gi')} AS fgi, coalesce(g, '') <> '' AS has FROM ids)
SELECT k, CASE WHEN has THEN fp = fg END AS exact_match, CASE WHEN has AND fp <> fg THEN fp <> '' AND fg <> '' AND (contains(fp, fg) OR contains(fg, fp)) END AS parent_match,
  CASE WHEN coalesce(gi, '') <> '' THEN fpi <> '' AND fpi = fgi END AS id_match, starts_with(upper(coalesce(pi, '')), 'CL:') AS ontology_mapped FROM f""")
def h32(t):
    m = ev.record_metrics("p", "g", "pi", "gi")
    return with_ids(pairs(t)).select("k", *(c.alias(n) for n, c in m.items()))


WORDS = ("high", "High ", "low", "", None, "medium")


def two_answers(t: Tables) -> DataFrame:
    """with_ids as two answers, pred and gold, with closed fields, flags and lists; some are missing as a whole."""
    k = F.col("k")
    bit = lambda n: F.when(n % 5 == 2, None).otherwise(n % 5 % 3 == 0)
    answer = lambda label, id_, n: F.struct(
        F.col(label).alias("cell_type"), F.col(id_).alias("cell_ontology_id"), picked(WORDS, n).alias("confidence_label"), picked(WORDS, n + 1).alias("decision"), picked(WORDS, n + 2).alias("evidence_support_level"),
        bit(n).alias("need_manual_review"), bit(n + 1).alias("novelty_flag"), F.split(label, " ").alias("supporting_markers"), (n % 10 / 10.0).alias("confidence_score"))
    return with_ids(pairs(t)).withColumns({"pred": F.when(k % 23 != 0, answer("p", "pi", k)), "gold": F.when(k % 29 != 0, answer("g", "gi", F.floor(k / 6)))})


def bit_sql(n: str) -> str:
    return f"CASE WHEN ({n}) % 5 = 2 THEN NULL ELSE ({n}) % 5 % 3 = 0 END"


def closed_sql(n: int) -> str:
    a, b = plain(picked_sql(WORDS, f"k + {n}")), plain(picked_sql(WORDS, f"k // 6 + {n}"))
    return f"CASE WHEN here AND ({a} <> '' OR {b} <> '') THEN {a} = {b} END"


@query("H30_compared_answers", f"""WITH {COMPARED}, h AS (SELECT *, k % 23 <> 0 AND k % 29 <> 0 AS here, k % 23 <> 0 AND k % 29 <> 0 AND match_level <> 'unavailable' AS told, {items_sql("coalesce(p, '')")} AS a, {items_sql("coalesce(g, '')")} AS b FROM levels)
SELECT k, CASE WHEN here THEN match_level ELSE 'unavailable' END AS cell_type_match_level, CASE WHEN told THEN pp = gp END AS cell_type_exact_match, CASE WHEN told THEN pl = gl END AS cell_type_normalized_exact_match, CASE WHEN told THEN pb = gb END AS cell_type_same_lineage,
  CASE WHEN told THEN CASE WHEN ps = gs THEN 'same' WHEN ps < gs THEN 'coarser_than_gold' ELSE 'finer_than_gold' END END AS cell_type_granularity_relation, CASE WHEN told THEN pp <> gp AND pl <> gl AND pb <> gb END AS cell_type_severe_error, CASE WHEN told THEN shared END AS cell_type_token_overlap,
  CASE WHEN told THEN pb END AS pred_lineage, CASE WHEN told THEN gb END AS gold_lineage, CASE WHEN told THEN pl END AS pred_label, CASE WHEN told THEN gl END AS gold_label,
  {closed_sql(0)} AS confidence_label_match, {closed_sql(1)} AS decision_match, {closed_sql(2)} AS evidence_support_level_match,
  CASE WHEN here THEN {bit_sql('k')} = {bit_sql('k // 6')} END AS need_manual_review_match, CASE WHEN here THEN {bit_sql('k + 1')} = {bit_sql('k // 6 + 1')} END AS novelty_flag_match,
  CASE WHEN here AND len(a) + len(b) > 0 THEN round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 4) END AS supporting_markers_jaccard, CASE WHEN here THEN len(list_intersect(a, b))::INT END AS supporting_markers_shared FROM h""")
def h30(t):
    rows = two_answers(t).withColumn("labels", lb.comparison("pred.cell_type", "gold.cell_type"))
    return rows.select("k", *(c.alias(n) for n, c in ev.compared_answers("pred", "gold", "labels").items()))


@query("H32_record_report", f"""WITH {IDS}, v AS (SELECT k, k % 23 <> 0 AS hp, k % 29 <> 0 AS hg, k // 6 AS j, CASE WHEN k % 23 <> 0 THEN p END AS p, CASE WHEN k % 29 <> 0 THEN g END AS g, CASE WHEN k % 23 <> 0 THEN pi END AS pi, CASE WHEN k % 29 <> 0 THEN gi END AS gi, p AS raw_p, p_size, p_type, p_brand FROM ids),
f AS (SELECT *, {fold('p')} AS fp, {fold('g')} AS fg, {fold('pi')} AS fpi, {fold('gi')} AS fgi, coalesce(g, '') <> '' AS has, CASE WHEN hp THEN {picked_sql(WORDS, 'k')} END AS pc, CASE WHEN hg THEN {picked_sql(WORDS, 'j')} END AS gc, CASE WHEN hp THEN {bit_sql('k')} END AS pr, CASE WHEN hg THEN {bit_sql('j')} END AS gr FROM v)
SELECT k, k % 9 <> 4 AS parse_ok, CASE WHEN has THEN fp = fg END AS exact_match, CASE WHEN has AND fp <> fg THEN fp <> '' AND fg <> '' AND (contains(fp, fg) OR contains(fg, fp)) END AS parent_match,
  CASE WHEN coalesce(gi, '') <> '' THEN fpi <> '' AND fpi = fgi END AS id_match, starts_with(upper(coalesce(pi, '')), 'CL:') AS ontology_mapped,
  CASE WHEN coalesce(gc, '') <> '' THEN {fold('pc')} = {fold('gc')} END AS confidence_match, CASE WHEN gr IS NOT NULL THEN coalesce(pr, false) = gr END AS review_match, k % 5 = 0 OR p_size * 10 < 80 AS is_hard,
  CASE WHEN has THEN k % 4 > 0 AND ({fold('raw_p')} = fg OR {fold(picked_sql(LABELS, 'k * 5 + 3'))} = fg) END AS topk_hit,
  CASE WHEN k % 3 = 0 THEN 'test' ELSE 'val' END AS split, CASE WHEN k % 7 = 0 THEN 'unknown' ELSE p_type END AS tissue, fg AS cell_type,
  CASE WHEN k % 2 = 0 THEN p_brand WHEN hp THEN coalesce({picked_sql(WORDS, 'k + 1')}, '') ELSE '' END AS final_decision, CASE WHEN k % 2 = 0 THEN 'ok' ELSE '' END AS ontology_status, CASE WHEN hp THEN coalesce({picked_sql(WORDS, 'k + 2')}, '') ELSE '' END AS evidence_level,
  p_size / 100.0::DOUBLE AS final_confidence_score, CASE WHEN hp THEN k % 10 / 10.0::DOUBLE END AS confidence_score FROM f""")
def h32_report(t):
    k = F.col("k")
    label = lambda c: F.struct(c.alias("label"))
    rows = two_answers(t).withColumns({
        "parsed": F.when(k % 9 == 4, False).when(k % 9 == 5, None).otherwise(True), "candidates": F.when(k % 4 > 0, F.array(label(F.col("p")), label(picked(LABELS, k * 5 + 3)))), "flagged": F.when(k % 5 != 1, k % 5 == 0),
        "n_cells": F.col("p_size") * 10, "of": F.when(k % 3 == 0, F.when(k % 2 == 0, "")).otherwise("val"), "place": F.when(k % 7 != 0, F.col("p_type")), "state": F.when(k % 2 == 0, "ok"), "final": F.when(k % 2 == 0, F.col("p_brand")).otherwise(""), "score": F.col("p_size") / 100.0})
    m = ev.record_report("pred", "gold", "parsed", "candidates", "flagged", "n_cells", "of", "place", "state", "final", "score")
    return rows.select("k", *(c.alias(n) for n, c in m.items()))


FLAGS = (" Yes", "0", "maybe", "TRUE", None, "no", "1", "False ", "", "y", "2")


@query("H31_truth", f"SELECT p_partkey AS k, CASE WHEN {fold(picked_sql(FLAGS, 'p_partkey'))} IN ('true', 'yes', '1') THEN true WHEN {fold(picked_sql(FLAGS, 'p_partkey'))} IN ('false', 'no', '0') THEN false END AS b FROM part")
def h31(t):
    return t.part.select(key().alias("k"), picked(FLAGS, key()).alias("s")).select("k", tx.truth("s").alias("b"))


@query("H10_tolerant_numbers", "SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_partkey::INT END AS i, CASE p_partkey % 7 WHEN 0 THEN p_partkey::DOUBLE WHEN 1 THEN round(p_partkey + 0.125, 6) WHEN 4 THEN round(('0.1234567' || p_partkey)::DOUBLE, 6) END AS d FROM part")
def h10(t):
    text, kind = key().cast("string"), key() % 7
    s = F.when(kind == 0, F.concat(F.lit(" "), text, F.lit(" "))).when(kind == 1, F.concat(text, F.lit(".125"))).when(kind == 2, "NaN").when(kind == 3, "-Infinity").when(kind == 4, F.concat(F.lit("0.1234567"), text)).when(kind == 6, F.concat(text, F.lit("x")))
    return t.part.select(key().alias("k"), s.alias("s")).select("k", tx.whole_number("s").cast("int").alias("i"), tx.number("s").alias("d"))


@query("H3_canonical_label", f"WITH {RAW}, s AS (SELECT k, nullif(trim(regexp_replace(lower(p), '\\s+', ' ', 'g')), '') AS s FROM raw) SELECT k, CASE s WHEN 't cells' THEN 't cell' WHEN 'b cells' THEN 'b cell' WHEN 'nk cells' THEN 'nk cell' WHEN 'monocytes' THEN 'monocyte' ELSE s END AS s FROM s")
def h3(t):
    return pairs(t).select("k", tx.canonical_label("p").alias("s"))


@query("H6_long_label", f"WITH {RAW} SELECT k, {long('p')} AS s FROM raw")
def h6(t):
    return pairs(t).select("k", tx.long_label("p").alias("s"))


@query("B10_positive_effect", "SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN p_partkey > 100 WHEN 5 THEN true ELSE false END AS p FROM part")
def b10(t):
    x = F.when(key() % 6 == 0, key() - 100.0).when(key() % 6 == 1, float("inf")).when(key() % 6 == 2, float("nan")).when(key() % 6 == 4, F.lit(0.0)).when(key() % 6 == 5, key() / 10.0)
    return t.part.select(key().alias("k"), x.alias("x")).select("k", sc.positive_effect("x").alias("p"))


INDEX = "i AS (SELECT 'CL:' || p_partkey AS id, lower(p_name) || ' ' || lower(p_brand) AS label, [lower(p_brand), lower(p_name)] AS synonyms FROM part), keys AS (SELECT label AS key, 0 AS priority, id FROM i UNION ALL SELECT unnest(synonyms), 1, id FROM i)"


def index_keys(t: Tables) -> DataFrame:
    """Labels (name and brand) and synonyms (either) of an index with one entry a part."""
    index = t.part.select(F.concat(F.lit("CL:"), key().cast("string")).alias("id"), F.concat_ws("  ", F.upper("p_name"), "p_brand").alias("label"), F.array("p_brand", F.concat(F.lit(" "), F.col("p_name"))).alias("synonyms"))
    return kn.lookup_keys(index)


@query("C4_prioritised_lookup", f"""WITH {INDEX}, a AS (SELECT key, id AS a FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority, id) AS k FROM keys) WHERE k = 1),
b AS (SELECT lower(p_type) AS key, 'T:' || min(p_partkey) AS b FROM part GROUP BY 1 UNION ALL SELECT lower(p_brand), 'never' FROM part GROUP BY 1),
w AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_type WHEN 2 THEN p_name || ' ' || p_brand ELSE 'none ' || p_size END AS label FROM part)
SELECT k, label, coalesce(a, b) AS id FROM w LEFT JOIN a ON lower(label) = a.key LEFT JOIN b ON lower(label) = b.key""")
def c4(t):
    first = index_keys(t).groupBy("key").agg(F.min(F.struct("priority", "id")).alias("m")).select("key", F.col("m.id").alias("a"))
    other = t.part.groupBy(F.lower("p_type").alias("key")).agg(F.concat(F.lit("T:"), F.min("p_partkey").cast("string")).alias("b"))
    other = other.union(t.part.select(F.lower("p_brand").alias("key"), F.lit("never")).distinct())
    want = F.when(key() % 4 == 0, F.col("p_brand")).when(key() % 4 == 1, F.col("p_type")).when(key() % 4 == 2, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.concat(F.lit("none "), F.col("p_size").cast("string")))
    rows = t.part.select(key().alias("k"), want.alias("label")).withColumn("key", F.lower("label"))
    return rows.join(first, "key", "left").join(other, "key", "left").select("k", "label", F.coalesce("a", "b").alias("id"))


@query("C5_store_lookup", f"WITH {INDEX} SELECT key, id, priority FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority DESC, id DESC) AS k FROM keys) WHERE k = 1")
def c5(t):
    return index_keys(t).groupBy("key").agg(F.max(F.struct("priority", "id")).alias("v")).select("key", "v.id", "v.priority")


@query("C19_valid_sets", f"WITH {INDEX} SELECT DISTINCT key FROM keys")
def c19(t):
    return index_keys(t).select("key").distinct()


@query("D11_ontology_index", """WITH a AS (SELECT p_partkey AS ord, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN ' ' ELSE 'X:' || p_partkey % 40 END AS id, p_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS parent FROM part),
r AS (SELECT *, min(ord) OVER (PARTITION BY id) AS first FROM a WHERE trim(coalesce(id, '')) <> '')
SELECT id, arg_min(p_name, ord) AS label, array_to_string(coalesce(list_sort(list_distinct(list(lower(p_name)) FILTER (ord > first))), []), '|') AS synonyms, arg_min(parent, ord) FILTER (parent <> '') AS parent_label FROM r GROUP BY id""")
def d11(t):
    id_ = F.when(key() % 13 == 0, None).when(key() % 17 == 0, " ").otherwise(F.concat(F.lit("X:"), (key() % 40).cast("string")))
    rows = t.part.select(F.concat(F.lit(" "), F.upper("p_name")).alias("raw_label"), F.col("p_name").alias("normalized_label"), id_.alias("id"), F.when(key() % 3 == 0, "").otherwise(F.col("p_brand")).alias("parent_label"), key().alias("ord"))
    return kn.ontology_index(rows).select("id", "label", F.array_join("synonyms", "|").alias("synonyms"), "parent_label")


@query("H48_external_entries", """WITH n AS (SELECT lower(p_name) AS key, 'L:' || min(p_partkey) AS lid FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT lower(p_name) AS label, CASE WHEN p_partkey % 3 = 0 THEN lid ELSE 'CL:' || p_partkey END AS id, CASE WHEN lid IS NOT NULL THEN 'widget' END AS parent_label, p_brand || '|' || p_type AS genes, round(p_partkey / 7.0::DOUBLE, 4) AS weight, 'external' AS entry_type FROM part LEFT JOIN n ON lower(p_name) = key""")
def h48(t):
    labels = t.part.where("p_size % 2 = 0").groupBy(F.lower("p_name").alias("key")).agg(F.concat(F.lit("L:"), F.min("p_partkey").cast("string")).alias("id")).withColumn("parent_label", F.lit("widget"))
    rows = t.part.select(
        F.lit("human").alias("species"), F.upper("p_type").alias("tissue"), F.concat(F.lit(" "), F.regexp_replace(F.initcap("p_name"), " ", "  ")).alias("label"), F.when(key() % 3 == 0, "").otherwise(F.concat(F.lit("CL:"), key().cast("string"))).alias("id"),
        F.array(F.concat(F.lit(" "), F.col("p_brand")), F.lit(""), F.col("p_type")).alias("marker_genes"), (key() / 7.0).alias("weight"))
    return kn.external_entries(rows, labels).select("label", "id", "parent_label", F.array_join("genes", "|").alias("genes"), "weight", "entry_type")


@query("H49_derived_entries", "SELECT lower(p_name) AS label, p_brand || '|' || p_type AS genes, least(round(p_partkey / 700.0::DOUBLE, 4), 1.0) AS weight, lower(p_type) AS tissue FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 4 <> 0")
def h49(t):
    gene = lambda c: F.struct(F.col(c).alias("gene"))
    rows = t.part.select(F.lit("human").alias("species"), F.col("p_type").alias("tissue"), F.when(key() % 5 == 0, " ").otherwise(F.upper("p_name")).alias("label"), F.when(key() % 4 != 0, F.array(gene("p_brand"), gene("p_type"))).otherwise(F.array().cast("array<struct<gene:string>>")).alias("markers"), (key() / 700.0).alias("quality"))
    return kn.derived_entries(rows).select("label", F.array_join("genes", "|").alias("genes"), "weight", "tissue")


@query("H19_tissue_bonus", f"""WITH r AS (SELECT p_partkey AS k, {picked_sql(TISSUES, 'p_partkey')} AS q, [{picked_sql(TISSUES, 'p_partkey // 8')}, {picked_sql(TISSUES, 'p_partkey // 3 + 2')}] AS known FROM part),
f AS (SELECT k, q, {fold('q')} AS fq, list_transform(known, lambda x: {fold('x')}) AS fk FROM r)
SELECT k, CASE WHEN coalesce(q, '') = '' THEN 0 ELSE coalesce(list_filter(list_transform(fk, lambda x: CASE WHEN fq = x THEN 0.2 WHEN contains(x, fq) OR contains(fq, x) THEN 0.1 ELSE 0 END), lambda b: b > 0)[1], 0) END::DOUBLE AS b FROM f""")
def h19(t):
    known = F.array(picked(TISSUES, F.floor(key() / 8)), picked(TISSUES, F.floor(key() / 3) + 2))
    return t.part.select(key().alias("k"), picked(TISSUES, key()).alias("q"), known.alias("known")).select("k", sc.tissue_bonus("q", "known").alias("b"))


EVIDENCE = ("strong", "moderate", "weak", "conflicting")


@query("H24_decision_blend", f"""WITH {IDS}, c AS (SELECT *, CASE WHEN k % 11 = 0 THEN NULL ELSE k % 101 / 100.0::DOUBLE END AS m, {picked_sql(EVIDENCE, 'k')} AS e, k % 7 / 10.0::DOUBLE AS o1, k % 5 / 10.0::DOUBLE AS o2, {picked_sql(LABELS, 'k * 5 + 3')} AS l2 FROM ids),
t AS (SELECT *, CASE WHEN k % 9 = 0 THEN 0 WHEN o1 >= o2 AND o1 > 0 THEN 1 WHEN o2 > 0 THEN 2 ELSE 0 END AS top FROM c),
u AS (SELECT *, CASE top WHEN 1 THEN o1 WHEN 2 THEN o2 ELSE 0 END AS s, {fold('p')} AS fp, lower(trim(coalesce(CASE top WHEN 1 THEN g WHEN 2 THEN l2 END, ''))) AS ft, trim(coalesce(CASE top WHEN 1 THEN gi WHEN 2 THEN 'CL:2' END, '')) AS ti, CASE top WHEN 1 THEN 't cell' ELSE '' END AS tp, coalesce(m, 0) AS m0 FROM t),
x AS (SELECT *, greatest(0, least(1, round(CAST(CASE WHEN s <= 0 THEN m0 * 0.85 WHEN contains(ft, fp) OR contains(fp, ft) THEN 0.75 * m0 + 0.25 * least(s * 1.5, 1) ELSE m0 * 0.8 END AS DECIMAL(18, 10)), 4)))::DOUBLE AS score FROM u)
SELECT k, score, CASE WHEN s > 0 AND s < 0.25 THEN 'novel_candidate' WHEN score >= 0.7 AND e IN ('strong', 'moderate') THEN 'accept' WHEN score >= 0.4 THEN 'review' ELSE 'unresolved' END AS decision,
  CASE WHEN trim(coalesce(pi, '')) = '' THEN 'missing' WHEN top = 0 THEN 'no_retrieval' WHEN ti <> '' AND ti = trim(pi) THEN 'matched' WHEN fp = ft THEN 'matched' WHEN fp = tp THEN 'parent_match' WHEN ft <> '' AND contains(ft, fp) THEN 'parent_match' ELSE 'unmatched' END AS status FROM x""")
def h24(t):
    k = F.col("k")
    candidate = lambda o, label, id_, parent: F.struct(o.alias("overlap_score"), label.alias("label"), id_.alias("id"), F.lit(parent).alias("parent"))
    two = F.array(candidate(k % 7 / 10.0, F.col("g"), F.col("gi"), "t cell"), candidate(k % 5 / 10.0, picked(LABELS, k * 5 + 3), F.lit("CL:2"), ""))
    rows = with_ids(pairs(t)).withColumns({"m": F.when(k % 11 != 0, k % 101 / 100.0), "e": picked(EVIDENCE, k), "top": sc.best_candidate(F.when(k % 9 == 0, F.slice(two, 1, 0)).otherwise(two))})
    rows = rows.withColumn("s", F.coalesce("top.overlap_score", F.lit(0.0)))
    agrees = F.coalesce(sc.retrieval_agrees(F.col("p"), F.col("top.label")), F.lit(False))
    rows = rows.withColumn("score", sc.blended_confidence(F.col("m"), F.col("s"), agrees))
    status = sc.ontology_status(F.col("pi"), F.col("p"), F.col("top").isNotNull(), F.col("top.id"), F.col("top.label"), F.col("top.parent"))
    return rows.select("k", "score", sc.decision(F.col("score"), F.col("e"), (F.col("s") < 0.25) & (F.col("s") > 0)).alias("decision"), status.alias("status"))


EDGES = """e AS (SELECT 'n ' || p_partkey AS child, 'n ' || CASE WHEN p_partkey % 10 = 0 THEN p_partkey // 2 WHEN p_partkey % 50 = 7 THEN p_partkey + 1 WHEN p_partkey % 50 = 8 THEN p_partkey - 1 WHEN p_partkey % 4 = 1 THEN p_partkey // 5 ELSE p_partkey // 3 END AS parent FROM part)"""
CLOSURE = EDGES + ", u(label, ancestor, level) AS (SELECT child, parent, 1 FROM e WHERE child <> parent UNION SELECT u.label, e.parent, level + 1 FROM u JOIN e ON u.ancestor = e.child WHERE level < 3 AND e.child <> e.parent AND u.label <> e.parent), up AS (SELECT label, ancestor, min(level) AS level FROM u GROUP BY label, ancestor)"


def edges(t: Tables) -> DataFrame:
    """Three edge tables over the parts' numbers, with cycles, and a later row or table that replaces an earlier one."""
    node = lambda k, form="N-": F.concat(F.lit(form), k.cast("long").cast("string"))
    up = F.when(key() % 50 == 7, key() + 1).when(key() % 50 == 8, key() - 1).otherwise(F.floor(key() / 3))
    base = t.part.select(node(key()).alias("child"), node(up, "n ").alias("parent"), F.lit(1).alias("ord"))
    later = t.part.where((key() % 4 == 1) & ~(key() % 50).isin(7, 8)).select(node(key(), "n_"), node(F.floor(key() / 5)), F.lit(2))
    over = t.part.where(key() % 10 == 0).select(node(key(), "Human n ").alias("child"), node(F.floor(key() / 2)).alias("parent"), F.lit(0).alias("ord"))
    return hi.merged_edges(base.union(later), over)


@query("C15_merged_edges", f"WITH {EDGES} SELECT child, parent FROM e")
def c15(t):
    return edges(t)


@query("C13_ancestors", f"WITH RECURSIVE {CLOSURE} SELECT label, ancestor, level FROM up")
def c13(t):
    return hi.ancestors(edges(t), 3)


@query("C14_compatibility", f"""WITH RECURSIVE {CLOSURE}, q AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'n ' || p_partkey // 3 WHEN 1 THEN 'n ' || p_partkey WHEN 2 THEN 'n ' || (p_partkey * 3 + 1) WHEN 3 THEN 'n ' || (p_partkey + 1) ELSE '' END AS p, CASE WHEN p_partkey % 20 = 19 THEN '' ELSE 'n ' || p_partkey END AS g FROM part)
SELECT k, CASE WHEN p = g THEN 'exact' WHEN a.label IS NOT NULL THEN 'pred_is_parent' WHEN b.label IS NOT NULL THEN 'pred_is_child' ELSE 'incompatible' END AS compat_type FROM q LEFT JOIN up a ON a.label = g AND a.ancestor = p LEFT JOIN up b ON b.label = p AND b.ancestor = g""")
def c14(t):
    node = lambda k: F.concat(F.lit("N/"), k.cast("long").cast("string"))
    pred = F.when(key() % 5 == 0, node(F.floor(key() / 3))).when(key() % 5 == 1, node(key())).when(key() % 5 == 2, node(key() * 3 + 1)).when(key() % 5 == 3, node(key() + 1))
    rows = t.part.select(key().alias("k"), pred.alias("pred"), F.when(key() % 20 == 19, " ").otherwise(node(key())).alias("gold"))
    return hi.with_compatibility(rows, hi.ancestors(edges(t), 3)).select("k", "compat_type")


@query("C13_deep_ancestors", "SELECT 'n ' || p_partkey AS label, 'n ' || (p_partkey - d) AS ancestor, CAST(d AS INT) AS level FROM (SELECT p_partkey, unnest(range(1, least(50, p_partkey % 60) + 1)) AS d FROM part)")
def c13_deep(t):
    """Chains of up to 59 parts, followed 50 levels up."""
    node = lambda k: F.concat(F.lit("n "), k.cast("string"))
    return hi.ancestors(t.part.where(key() % 60 > 0).select(node(key()).alias("child"), node(key() - 1).alias("parent")), 50)


FOREST = "e AS (SELECT 'n ' || p_partkey AS child, 'n ' || p_partkey // 3 AS parent FROM part)"


@query("C14_compatibility_by_range", f"""WITH RECURSIVE {FOREST}, {CLOSURE[len(EDGES) + 2:]}, q AS (SELECT p_partkey AS k, 'n ' || (p_partkey // (1 + p_partkey % 9)) AS p, 'n ' || p_partkey AS g FROM part)
SELECT k, CASE WHEN p = g THEN 'exact' WHEN a.label IS NOT NULL THEN 'pred_is_parent' WHEN b.label IS NOT NULL THEN 'pred_is_child' ELSE 'incompatible' END AS compat_type FROM q LEFT JOIN up a ON a.label = g AND a.ancestor = p LEFT JOIN up b ON b.label = p AND b.ancestor = g""")
def c14_range(t):
    """The same test on a forest, by places and levels instead of a table of ancestors."""
    node = lambda k: F.concat(F.lit("n "), k.cast("long").cast("string"))
    ranges = hi.intervals(t.part.select(node(key()).alias("child"), node(F.floor(key() / 3)).alias("parent")))
    rows = t.part.select(key().alias("k"), node(F.floor(key() / (1 + key() % 9))).alias("pred"), node(key()).alias("gold"))
    return hi.with_compatibility_by_range(rows, ranges).select("k", "compat_type")


def answers(t: Tables) -> DataFrame:
    """k and a: the training answer for each part's numbers and flags."""
    k = F.col("k")
    flags = F.struct((k % 3 == 0).alias("low_cells"), (k % 4 == 0).alias("ontology_unmapped"), (k % 5 == 0).alias("rare_label_in_dataset"))
    rows = with_ids(pairs(t)).withColumns({"n": F.col("p_size") % 12, "q": F.when(k % 7 != 0, k % 10 / 10.0), "c": F.col("p_size") * 10, "f": flags})
    return rows.select("k", sc.training_answer("p", "pi", "g", F.array(F.lit("CD3")), "n", "q", "c", "f").alias("a"))


HALF_UP = "round(CAST({x} AS DECIMAL(18, 10)), 4)::DOUBLE"
ANSWERS = f"""{RAW}, v AS (SELECT k, p, p_size % 12 AS n, CASE WHEN k % 7 <> 0 THEN k % 10 / 10.0::DOUBLE END AS q, p_size * 10 AS c FROM raw), w AS (SELECT *, least(n / 10.0::DOUBLE, 1) AS cover, coalesce(q, 0) AS q0 FROM v),
b AS (SELECT *, {HALF_UP.format(x="least(((q0 * 0.6 + cover * 0.4) * 0.5 + q0 * 0.4) * (0.7 + 0.3 * least(1, c / 100.0::DOUBLE)), 1)")} * CASE WHEN k % 3 = 0 THEN 0.8::DOUBLE ELSE 1 END * CASE WHEN k % 4 = 0 THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN k % 5 = 0 THEN 0.85::DOUBLE ELSE 1 END AS x, cover * 0.5 + q0 * 0.5 AS o FROM w),
s AS (SELECT *, {HALF_UP.format(x="least(x, 1)")} AS score, CASE WHEN o >= 0.4 AND n >= 5 AND NOT coalesce(q < 0.2, false) THEN 'strong' WHEN (o >= 0.4 AND n >= 5) OR ((o >= 0.2 OR n >= 3) AND NOT coalesce(q < 0.2, false)) THEN 'moderate' WHEN o >= 0.2 OR n >= 3 OR o > 0 OR n >= 1 THEN 'weak' ELSE 'conflicting' END AS evidence, k % 20 = 0 AS novel FROM b),
l AS (SELECT *, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS label FROM s),
a AS (SELECT *, CASE WHEN novel THEN 'novel_candidate' WHEN label = 'high' AND evidence IN ('strong', 'moderate') THEN 'accept' WHEN label = 'low' OR evidence = 'conflicting' THEN 'unresolved' ELSE 'review' END AS decision FROM l)"""


@query("H22_training_answer", f"WITH {ANSWERS} SELECT k, label AS confidence_label, decision, evidence AS evidence_support_level, decision <> 'accept' AS need_manual_review, novel AS novelty_flag FROM a")
def h22(t):
    return answers(t).select("k", "a.confidence_label", "a.decision", "a.evidence_support_level", "a.need_manual_review", "a.novelty_flag")


@query("H23_training_confidence", f"WITH {ANSWERS} SELECT k, score AS s FROM a")
def h23(t):
    return answers(t).select("k", "a.confidence_score").withColumnRenamed("confidence_score", "s")


@query("H37_answer_struct_json", f"WITH {ANSWERS} SELECT k, p AS label, decision FROM a")
def h37(t):
    j = answers(t).select("k", rc.answer_json(label="a.cell_type", decision="a.decision").alias("j"))
    return j.select("k", F.get_json_object("j", "$.label").alias("label"), F.get_json_object("j", "$.decision").alias("decision"))


def noisy(t: Tables) -> DataFrame:
    """k and s: an answer with each part's label in text of eight kinds, some without JSON and some with broken JSON."""
    label, name, k = F.coalesce("p", F.lit("")), F.col("p_name"), F.col("k")
    text = lambda *x: F.concat(*(F.lit(c) if isinstance(c, str) else c for c in x))
    kinds = [
        text('{"cell_type":"', label, '","confidence_score":0.5}'),
        text('<think>{x}</think> {"cell_type":"', label, '","novelty_flag":"yes"}'),
        text(name, ': {"cell_type":"', label, ' {x}","supporting_markers":"A, B"} and {"cell_type":"other"}'),
        name,
        text('```json\n{"cell_type":"', label, '","confidence_label":"Very High","confidence_score":1.7}\n```'),
        text('{"cell_type":"', label, '"'),
        text('{"cell_type":"q \\" } ', label, '","supporting_markers":["X","Y"],"decision":"ACCEPT"}'),
        text(F.repeat(name, (k % 50).cast("int")), '{"cell_type":"', label, '","evidence_support_level":"rather strong"}', F.repeat(name, (k % 30).cast("int"))),
    ]
    s = F.when(k % 8 == 0, kinds[0])
    for n, kind in enumerate(kinds[1:], 1):
        s = s.when(k % 8 == n, kind)
    return pairs(t).select("k", "g", s.alias("s"))


SAID = "CASE WHEN k % 8 IN (3, 5) THEN NULL WHEN k % 8 = 2 THEN coalesce(p, '') || ' {x}' WHEN k % 8 = 6 THEN 'q \" } ' || coalesce(p, '') ELSE coalesce(p, '') END"


@query("H35_json_extract", f"WITH {RAW} SELECT k, {SAID} AS cell_type FROM raw")
def h35(t):
    return noisy(t).select("k", F.get_json_object(rc.json_text("s"), "$.cell_type").alias("cell_type"))


@query("H36_parsed_answer", f"""WITH {RAW} SELECT k, k % 8 NOT IN (3, 5) AS parse_ok, trim(coalesce({SAID}, '')) AS cell_type, CASE k % 8 WHEN 0 THEN 0.5 WHEN 4 THEN 1 ELSE 0 END::DOUBLE AS confidence_score, CASE WHEN k % 8 = 4 THEN 'high' ELSE 'low' END AS confidence_label,
  CASE WHEN k % 8 = 6 THEN 'accept' ELSE 'review' END AS decision, k % 8 = 1 AS novelty_flag, CASE WHEN k % 8 = 7 THEN 'strong' ELSE 'weak' END AS evidence, CASE k % 8 WHEN 2 THEN 'A|B' WHEN 6 THEN 'X|Y' ELSE '' END AS markers FROM raw""")
def h36(t):
    rows = noisy(t).select("k", rc.parsed_answer("s").alias("a"))
    return rows.select("k", "a.parse_ok", "a.cell_type", "a.confidence_score", "a.confidence_label", "a.decision", "a.novelty_flag", F.col("a.evidence_support_level").alias("evidence"), F.array_join("a.supporting_markers", "|").alias("markers"))


@query("H45_rescored_outputs", f"WITH {RAW} SELECT k, {plain(SAID)} = {plain('g')} AS is_right FROM raw")
def h45(t):
    said = F.get_json_object(rc.json_text("s"), "$.cell_type")
    return noisy(t).select("k", (tx.plain_label(said) == tx.plain_label("g")).alias("is_right"))


@query("H42_content_text", "SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 1 THEN text || chr(10) || role WHEN 2 THEN '[' || text ELSE text END AS s FROM conversations")
def h42(t):
    k = (F.col("conv_id") + F.col("turn")) % 3
    part = lambda c: F.struct(F.lit("text").alias("type"), F.col(c).alias("text"))
    content = F.when(k == 1, F.to_json(F.array(part("text"), part("role")))).when(k == 2, F.concat(F.lit("["), "text")).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", content.alias("c")).select("conv_id", "turn", rc.content_text("c").alias("s"))
