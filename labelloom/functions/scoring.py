"""Marker, evidence and confidence scores, and the decisions they lead to, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.text import col, finite, folded

# Features that carry no information, and the beginnings of their names.
UNINFORMATIVE = ("MALAT1", "NEAT1", "XIST", "KCNQ1OT1", "RPPH1", "RN7SL1", "RMRP", "SNHG1", "MIAT", "H19")
UNINFORMATIVE_PREFIXES = ("MT-", "RPL", "RPS", "HB", "HBA", "HBB", "IGJ")


def listed_out(gene: str | Column, names=UNINFORMATIVE, prefixes=UNINFORMATIVE_PREFIXES) -> Column:
    """Whether the feature is on the list or begins as one of prefixes, whatever the case."""
    g = F.upper(col(gene).cast("string"))
    out = g.isin(*names) if names else F.lit(False)
    for p in prefixes:
        out = out | g.startswith(p)
    return out


def positive_effect(lfc: str | Column) -> Column:
    return F.coalesce(finite(lfc), F.lit(float("-inf"))) > 0


def marker_score(lfc: str | Column, pct_in: str | Column, pct_out: str | Column) -> Column:
    return F.round(col(lfc) * col(pct_in) * F.greatest(F.lit(0.0), 1 - col(pct_out)), 4)


def mean_of_first(values: str | Column, k: int = 5) -> Column:
    """Mean of the finite ones of the first k; null without any."""
    found = F.filter(F.transform(F.slice(col(values), 1, k), finite), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.round(F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.size(found), 6))


def marker_quality(n_markers: str | Column, mean_score: str | Column, n_cells: str | Column, low: int = 100) -> Column:
    """0 without markers; else coverage of ten markers, mean score over 3 and a constant, shrunk for small groups."""
    n, cells = col(n_markers), col(n_cells)
    coverage = F.least(n, F.lit(10)) / 10.0
    mean = F.coalesce(F.least(col(mean_score) / 3.0, F.lit(1.0)), F.lit(0.0))
    size = F.when(cells >= low, 1.0).otherwise(F.greatest(F.lit(0.3), cells / float(low)))
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.least(F.round((0.4 * coverage + 0.5 * mean + 0.1) * size, 4), F.lit(1.0)))


def negative_reason(lfc: str | Column, pct_in: str | Column, pct_out: str | Column) -> Column:
    return F.when((col(pct_out) > 0.5) & (col(pct_in) < 0.2), "high_pct_out_low_pct_in").when(col(lfc) < -0.5, "negative_logfc").otherwise("low_expression")


def hardness(n_cells: str | Column, quality: str | Column, known_id: str | Column, share: str | Column, low: int = 100, least: float = 0.3, rare: float = 0.02) -> Column:
    return F.struct(
        (col(n_cells) < low).alias("low_cells"),
        (col(quality) < least).alias("low_marker_quality"),
        (F.coalesce(col(known_id), F.lit("")) == "").alias("ontology_unmapped"),
        (col(share) < rare).alias("rare_label_in_dataset"),
    )


def feature_vector(positive: str, negative: str, n_cells: str | Column, quality: str | Column, flags: str) -> list[Column]:
    """The 14 features of a marker record: counts, means of the first five markers, specificity, quality and flags as 0 or 1.

    positive: array of structs with lfc, pct_in, pct_out and score; null arrays count as empty.
    """
    first = lambda name: F.transform(F.slice(F.col(positive), 1, 5), lambda m: m[name])
    apart = F.filter(F.transform(F.slice(F.col(positive), 1, 5), lambda m: m["pct_in"] - m["pct_out"]), lambda x: x.isNotNull())
    count = lambda c: F.coalesce(F.array_size(F.col(c)), F.lit(0))
    flag = lambda name: F.coalesce(F.col(f"{flags}.{name}"), F.lit(False)).cast("int")
    return [
        count(positive).alias("n_positive_markers"), count(negative).alias("n_negative_markers"), col(n_cells).alias("n_cells"), F.round(F.ln(col(n_cells) + 1), 4).alias("log_n_cells"),
        *(mean_of_first(first(name)).alias(f"mean_{said}_top5") for name, said in (("lfc", "logfc"), ("pct_in", "pct_in"), ("pct_out", "pct_out"), ("score", "score"))),
        F.when(F.size(apart) > 0, F.round(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) / F.size(apart), 4)).alias("specificity_score"), col(quality).alias("marker_quality_score"),
        flag("low_cells").alias("flag_low_cells"), flag("low_marker_quality").alias("flag_low_quality"), flag("ontology_unmapped").alias("flag_ontology_unmapped"), flag("rare_label_in_dataset").alias("flag_rare_label"),
    ]


def any_flag(flags: str, names=("low_cells", "low_marker_quality", "ontology_unmapped", "rare_label_in_dataset")) -> Column:
    return F.coalesce(F.greatest(*(F.col(f"{flags}.{n}") for n in names)), F.lit(False))


def ladder(x: str | Column, steps, last: str) -> Column:
    """The name of the first step (least, name) that x reaches, else last."""
    out = None
    for least, name in steps:
        out = F.when(col(x) >= least, name) if out is None else out.when(col(x) >= least, name)
    return out.otherwise(last)


def confidence_by_size(n_cells: str | Column, mean_lfc: str | Column) -> Column:
    """high from 200 cells and a mean effect of 2, medium from 80 and 1, else low."""
    n, lfc = col(n_cells), F.coalesce(col(mean_lfc), F.lit(0.0))
    return F.when((n >= 200) & (lfc >= 2.0), "high").when((n >= 80) & (lfc >= 1.0), "medium").otherwise("low")


def overlap_score(query: str | Column, known: str | Column, top: int = 5) -> Column:
    """Jaccard of two feature lists, plus 0.3 times the share of the query's first ones that are known; 1 at most."""
    up = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    q, k = up(col(query)), up(col(known))
    first = F.array_distinct(F.slice(q, 1, top))
    jaccard = F.size(F.array_intersect(q, k)) / F.size(F.array_union(q, k))
    bonus = F.size(F.array_intersect(first, k)) / F.size(first) * 0.3
    return F.when((F.size(q) == 0) | (F.size(k) == 0), 0.0).otherwise(F.round(F.least(jaccard + bonus, F.lit(1.0)), 4))


def tissue_bonus(tissue: str | Column, known: str | Column) -> Column:
    """0.2 or 0.1 for the first known tissue that equals or shares text with tissue; 0 for none."""
    q = folded(tissue)
    fit = lambda t: F.when(q == t, 0.2).when(t.contains(q) | q.contains(t), 0.1).otherwise(0.0)
    hits = F.filter(F.transform(col(known), lambda t: fit(folded(t))), lambda x: x > 0)
    return F.when(F.coalesce(col(tissue), F.lit("")) == "", 0.0).otherwise(F.coalesce(F.get(hits, F.lit(0)), F.lit(0.0)))


def evidence_level(overlap: str | Column, n_markers: str | Column, quality: str | Column) -> Column:
    """strong, moderate, weak or conflicting; one step less for a quality below 0.2, if it is known."""
    o, n, poor = col(overlap), col(n_markers), F.coalesce(col(quality) < 0.2, F.lit(False))
    strong, moderate = (o >= 0.4) & (n >= 5), (o >= 0.2) | (n >= 3)
    return (
        F.when(strong & ~poor, "strong").when(strong | (moderate & ~poor), "moderate")
        .when(moderate | (o > 0) | (n >= 1), "weak").otherwise("conflicting")
    )


def confidence_score(overlap: str | Column, quality: str | Column, n_cells: str | Column, low: int = 100) -> Column:
    base = col(overlap) * 0.5 + F.coalesce(col(quality), F.lit(0.0)) * 0.4
    return F.round(F.least(base * (0.7 + 0.3 * F.least(F.lit(1.0), col(n_cells) / float(low))), F.lit(1.0)), 4)


def confidence_label(score: str | Column) -> Column:
    return ladder(score, ((0.7, "high"), (0.4, "medium")), "low")


def action(confidence: str | Column, novel: str | Column, evidence: str | Column) -> Column:
    c, e = col(confidence), col(evidence)
    return (
        F.when(F.coalesce(col(novel), F.lit(False)), "novel_candidate").when((c == "high") & e.isin("strong", "moderate"), "accept")
        .when((c == "low") | (e == "conflicting"), "unresolved").otherwise("review")
    )


def blended_confidence(model_score: Column, top_score: Column, agrees: Column) -> Column:
    """The model's score with what retrieval says: a weighted mean if it agrees, a discount if not or if it is silent."""
    m = F.coalesce(model_score, F.lit(0.0))
    mean = 0.75 * m + 0.25 * F.least(top_score * 1.5, F.lit(1.0))
    x = F.when(top_score <= 0, m * 0.85).when(agrees, mean).otherwise(m * 0.8)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(x, 4)))


def best_candidate(candidates: str | Column) -> Column:
    """Of an array of structs with overlap_score, the first with the largest positive score; null without one."""
    c = F.filter(col(candidates), lambda x: F.coalesce(x["overlap_score"], F.lit(0.0)) > 0)
    top = F.array_max(F.transform(c, lambda x: x["overlap_score"]))
    return F.get(F.filter(c, lambda x: x["overlap_score"] == top), F.lit(0))


def retrieval_agrees(label: Column, known: Column) -> Column:
    """Whether one folded label is part of the other; an empty label is part of any."""
    a, b = folded(label), folded(known)
    return a.eqNullSafe(b) | b.contains(a) | a.contains(b)


def decision(score: Column, evidence: Column, novel: Column, accept: float = 0.7, review: float = 0.4) -> Column:
    return (
        F.when(F.coalesce(novel, F.lit(False)), "novel_candidate").when((score >= accept) & evidence.isin("strong", "moderate"), "accept")
        .when(score >= review, "review").otherwise("unresolved")
    )


def ontology_status(model_id: Column, model_label: Column, found: Column, found_id: Column, found_label: Column, found_parent: Column) -> Column:
    """missing, no_retrieval, matched, parent_match or unmatched."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    label, known, parent = folded(model_label), folded(found_label), folded(found_parent)
    return (
        F.when(blank(model_id) == "", "missing").when(~found, "no_retrieval")
        .when((blank(found_id) != "") & (blank(found_id) == blank(model_id)), "matched").when(label == known, "matched")
        .when(label == parent, "parent_match").when((known != "") & known.contains(label), "parent_match").otherwise("unmatched")
    )


def answer_evidence(n_markers: str | Column, quality: str | Column) -> dict[str, Column]:
    """For a training answer: stand-ins for the overlap that retrieval would give, from marker count and quality."""
    cover, q = F.least(col(n_markers) / 10.0, F.lit(1.0)), F.coalesce(col(quality), F.lit(0.0))
    return {"for_confidence": q * 0.6 + cover * 0.4, "for_evidence": cover * 0.5 + q * 0.5}


def training_confidence(n_markers: str | Column, quality: str | Column, n_cells: str | Column, flags: str) -> Column:
    """confidence_score on the stand-in overlap, less for small, unmapped and rare groups."""
    base = confidence_score(answer_evidence(n_markers, quality)["for_confidence"], quality, n_cells)
    for flag, factor in (("low_cells", 0.8), ("ontology_unmapped", 0.9), ("rare_label_in_dataset", 0.85)):
        base = base * F.when(F.coalesce(F.col(f"{flags}.{flag}"), F.lit(False)), factor).otherwise(1.0)
    return F.round(F.least(base, F.lit(1.0)), 4)


def training_answer(label: str, known_id: str, parent: str, markers: Column, n_markers: str, quality: str, n_cells: str, flags: str) -> Column:
    """The answer to learn, with confidence, evidence, decision and review flag that its markers justify."""
    score = training_confidence(n_markers, quality, n_cells, flags)
    evidence = evidence_level(answer_evidence(n_markers, quality)["for_evidence"], n_markers, quality)
    novel = F.coalesce(F.col(f"{flags}.ontology_unmapped") & F.col(f"{flags}.rare_label_in_dataset"), F.lit(False))
    act = action(confidence_label(score), novel, evidence)
    return F.struct(
        col(label).alias("cell_type"), col(known_id).alias("cell_ontology_id"), col(parent).alias("parent_cell_type"), markers.alias("supporting_markers"),
        confidence_label(score).alias("confidence_label"), score.alias("confidence_score"), act.isin("review", "unresolved", "novel_candidate").alias("need_manual_review"),
        act.alias("decision"), novel.alias("novelty_flag"), evidence.alias("evidence_support_level"),
    )
