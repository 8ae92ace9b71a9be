"""Rates, histograms, calibration and bucket reports of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.labels import PARTS, compared_long, list_overlap, shared_items
from labelloom.functions.text import bound, col, folded, partial_match, plain_label, truth


def rate(flag: str | Column, digits: int = 4) -> Column:
    """Share of true over all rows; null counts as false."""
    return F.round(F.avg(F.coalesce(col(flag).cast("double"), F.lit(0.0))), digits)


def known_rate(flag: str | Column, digits: int = 4) -> Column:
    """Share of true over the rows where flag is known."""
    return F.round(F.avg(col(flag).cast("double")), digits)


def core_metrics(exact: str, compatible: str, lineage: str, severe: str, parsed: str, pred_id: str, gold_id: str) -> list[Column]:
    """n, five rates, and the share of right ids over rows with a true id."""
    has = F.coalesce(F.col(gold_id), F.lit("")) != ""
    return [
        F.count("*").alias("n"), rate(exact).alias("exact"), rate(compatible).alias("compatible"), rate(lineage).alias("same_lineage"), rate(severe).alias("severe_error"),
        F.round(F.avg(F.coalesce(F.col(parsed).cast("double"), F.lit(1.0))), 4).alias("parse_ok"),
        F.round(F.avg(F.when(has, (folded(pred_id) == folded(gold_id)).cast("double"))), 4).alias("id_accuracy"), F.count_if(has).alias("n_with_id"),
    ]


def rates_by(df: DataFrame, key: str | Column, name: str, **flags: str | Column) -> DataFrame:
    """For each value of key (null: unknown) the rows and the known rate of each flag, in order of the key."""
    return df.groupBy(F.coalesce(col(key).cast("string"), F.lit("unknown")).alias(name)).agg(F.count("*").alias("n"), *(known_rate(c).alias(k) for k, c in flags.items())).orderBy(name)


def histogram(df: DataFrame, value: str, categories: list[str]) -> DataFrame:
    """Counts of the given categories, zeros too, in their order."""
    listed = df.sparkSession.createDataFrame([(c, k) for k, c in enumerate(categories)], f"{value} string, _k int")
    return F.broadcast(listed).join(df.groupBy(value).agg(F.count("*").alias("n")), value, "left").orderBy("_k").select(value, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def brier(score: str | Column, right: str | Column) -> Column:
    return F.avg(F.pow(col(score) - col(right).cast("double"), F.lit(2.0)))


#: Edges of ten equal bins, as sums of doubles would not give them.
EDGES = (0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0)


def score_bin(score: str | Column, edges=EDGES) -> Column:
    """Number of the half-open bin that score lies in; null for 1 and beyond."""
    out = None
    for k, top in enumerate(edges[1:]):
        out = F.when(col(score) < top, k) if out is None else out.when(col(score) < top, k)
    return F.when(col(score) >= edges[0], out)


def calibration(df: DataFrame, score: str, right: str) -> DataFrame:
    """n, Brier score and expected calibration error over rows with both; a score of 1 is in no bin but counts in n."""
    rows = df.where(F.col(score).isNotNull() & F.col(right).isNotNull()).select(F.col(score).cast("double").alias("p"), F.col(right).cast("double").alias("y"))
    bins = rows.groupBy(score_bin("p").alias("bin")).agg(F.count("*").alias("k"), F.avg("p").alias("mp"), F.avg("y").alias("my"), F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("sq"))
    error = F.sum(F.when(F.col("bin").isNotNull(), F.col("k") * F.abs(F.col("mp") - F.col("my"))))
    return bins.agg(F.sum("k").alias("n"), F.round(F.sum("sq") / F.sum("k"), 4).alias("brier"), F.round(error / F.sum("k"), 4).alias("ece"))


def bucket_report(df: DataFrame, dimensions: dict[str, str], metrics: list[Column]) -> DataFrame:
    """dimension, bucket and metrics: over all rows, and for each value of each dimension, in one pass by grouping sets."""
    names = list(dimensions)
    rows = df.withColumns({f"_d{k}": F.coalesce(F.col(dimensions[n]).cast("string"), F.lit("unknown")) for k, n in enumerate(names)})
    keys = [F.col(f"_d{k}") for k in range(len(names))]
    out = rows.groupingSets([[], *([k] for k in keys)], *keys).agg(*metrics, *(F.grouping(f"_d{k}").alias(f"_g{k}") for k in range(len(names))))
    which, bucket = None, F.coalesce(*keys)
    for k, n in enumerate(names):
        which = F.when(F.col(f"_g{k}") == 0, n) if which is None else which.when(F.col(f"_g{k}") == 0, n)
    out = out.withColumn("dimension", which.otherwise("overall")).withColumn("bucket", F.coalesce(bucket, F.lit("all")))
    return out.drop(*(f"_d{k}" for k in range(len(names))), *(f"_g{k}" for k in range(len(names))))


def bottlenecks(report: DataFrame, metric: str = "severe_error", least: int = 3, most: int = 3, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """The buckets of at least `least` rows whose metric exceeds the overall one most."""
    overall = report.where("dimension = 'overall'").select(F.col(metric).alias("_all"))
    rows = report.where((F.col("dimension") != "overall") & (F.col("n") >= least) & ~F.col("dimension").isin(*leave_out, ""))
    rows = rows.crossJoin(F.broadcast(overall)).withColumn("excess", F.round(F.col(metric) - F.col("_all"), 4)).where("excess > 0")  # one row
    return rows.orderBy(F.desc("excess"), "dimension", "bucket").limit(most).select("dimension", "bucket", "n", metric, "excess")


def delta(base: DataFrame, variant: DataFrame, *metrics: str) -> DataFrame:
    """metric, base, variant and delta of two one-row tables."""
    both = base.select(*(F.col(m).alias(f"a_{m}") for m in metrics)).crossJoin(F.broadcast(variant.select(*(F.col(m).alias(f"b_{m}") for m in metrics))))
    items = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").cast("double").alias("base"), F.col(f"b_{m}").cast("double").alias("variant")) for m in metrics))
    return both.select(F.explode(items).alias("x")).select("x.*", F.round(F.col("x.variant") - F.col("x.base"), 4).alias("delta"))


def record_metrics(pred: str, gold: str, pred_id: str, gold_id: str) -> dict[str, Column]:
    """Matches of one record; null where the true value is missing."""
    has, has_id = F.coalesce(F.col(gold), F.lit("")) != "", F.coalesce(F.col(gold_id), F.lit("")) != ""
    exact = folded(pred) == folded(gold)
    return {
        "exact_match": F.when(has, exact),
        "parent_match": F.when(has & ~exact, partial_match(pred, gold)),
        "id_match": F.when(has_id, (folded(pred_id) != "") & (folded(pred_id) == folded(gold_id))),
        "ontology_mapped": F.upper(F.coalesce(F.col(pred_id), F.lit(""))).startswith("CL:"),
    }


def record_report(pred: str, gold: str, parsed: str | Column, candidates: str | Column, flagged: str | Column, n_cells: str | Column, split: str | Column, tissue: str | Column, status: str | Column, final: str | Column, final_score: str | Column) -> dict[str, Column]:
    """All columns about one record: its matches, null where the true value is missing, and what groups it for rates.

    pred and gold: struct columns of answers (cell_type, cell_ontology_id, confidence_label, need_manual_review,
    decision, evidence_support_level, confidence_score). candidates: an array of structs with label, of which any may
    hit. flagged: whether a hardness flag is set. status: of the id's validation; final: decision and score after it.
    """
    p, g = (lambda c: F.col(f"{pred}.{c}")), (lambda c: F.col(f"{gold}.{c}"))
    filled = lambda *cs: F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cs), F.lit(""))
    has = filled(g("cell_type")) != ""
    hits = F.exists(F.coalesce(col(candidates), F.array()), lambda c: folded(c["label"]) == folded(g("cell_type")))
    m = record_metrics(f"{pred}.cell_type", f"{gold}.cell_type", f"{pred}.cell_ontology_id", f"{gold}.cell_ontology_id")
    return {
        "parse_ok": F.coalesce(col(parsed), F.lit(True)),
        **{k: m[k] for k in ("exact_match", "parent_match", "id_match", "ontology_mapped")},
        "confidence_match": F.when(filled(g("confidence_label")) != "", folded(p("confidence_label")) == folded(g("confidence_label"))),
        "review_match": F.when(g("need_manual_review").isNotNull(), F.coalesce(p("need_manual_review"), F.lit(False)) == g("need_manual_review")),
        "is_hard": F.coalesce(col(flagged), F.lit(False)) | (F.coalesce(col(n_cells), F.lit(9999)) < 80),
        "topk_hit": F.when(has, hits),
        "split": F.coalesce(F.nullif(col(split), F.lit("")), F.lit("test")),
        "tissue": F.coalesce(F.nullif(col(tissue), F.lit("")), F.lit("unknown")),
        "cell_type": folded(g("cell_type")),
        "final_decision": filled(final, p("decision")),
        "ontology_status": filled(status),
        "evidence_level": filled(p("evidence_support_level")),
        "final_confidence_score": col(final_score),
        "confidence_score": p("confidence_score"),
    }


def compared_answers(pred: str, gold: str, labels: str | None = None) -> dict[str, Column]:
    """Matches of two answers, each null where it can't be told: of labels, of closed fields (null if both are blank), of
    yes-or-no fields (null if either is missing) and of marker lists. All are null if an answer is missing as a whole.
    labels: a column with the comparison of both cell_type fields, if there is one: it is worked out once for all."""
    here = F.col(pred).isNotNull() & F.col(gold).isNotNull()
    p, g = (lambda c: F.col(f"{pred}.{c}")), (lambda c: F.col(f"{gold}.{c}"))
    labels = {name: F.col(f"{labels}.{name}") for name in PARTS} if labels else compared_long(p("cell_type"), g("cell_type"))

    def closed(c: str) -> Column:
        return bound(F.struct(plain_label(p(c)).alias("a"), plain_label(g(c)).alias("b")), lambda x: F.when((x["a"] != "") | (x["b"] != ""), x["a"] == x["b"]))

    def flag(c: str) -> Column:
        return truth(p(c).cast("string")) == truth(g(c).cast("string"))

    out = {f"cell_type_{k}": labels[k] for k in ("exact_match", "normalized_exact_match", "same_lineage", "granularity_relation", "severe_error", "token_overlap")}
    out |= {k: labels[k] for k in ("pred_lineage", "gold_lineage", "pred_label", "gold_label")}
    out |= {f"{c}_match": closed(c) for c in ("confidence_label", "decision", "evidence_support_level")}
    out |= {f"{c}_match": flag(c) for c in ("need_manual_review", "novelty_flag")}
    out["supporting_markers_jaccard"] = list_overlap(p("supporting_markers"), g("supporting_markers"))
    out["supporting_markers_shared"] = shared_items(p("supporting_markers"), g("supporting_markers"))
    return {"cell_type_match_level": F.when(here, labels["match_level"]).otherwise("unavailable")} | {k: F.when(here, c) for k, c in out.items()}


def id_checks(df: DataFrame, pred_id: str, known: DataFrame, key: str = "id") -> DataFrame:
    """n, ids that aren't of the form CL:, and ids of that form that known lacks."""
    rows = df.select(F.col(pred_id).alias("_id")).join(known.select(F.col(key).alias("_id")).distinct().withColumn("_known", F.lit(True)), "_id", "left")
    form = F.coalesce(F.col("_id"), F.lit("")).startswith("CL:")
    return rows.agg(F.count("*").alias("n"), F.count_if(~form).alias("n_invalid"), F.count_if(form & F.col("_known").isNull()).alias("n_fabricated"))
