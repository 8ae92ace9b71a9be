"""Label status and levels, lineages, subtype flags and comparisons of a predicted with a true label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.text import bound, col, folded, has_any, label_text, long_label, plain_label, tokens

# Parts of labels that name no class.
AMBIGUOUS = ("unknown", "unassigned", "ambiguous", "doublet", "multiplet", "low quality", "low-quality", "debris", "artifact", "other")

# Lineages and the parts of labels that show them; the first that fits counts.
LINEAGES = (
    ("gamma_delta_t", ("gamma delta t",)),
    ("t_cell", ("regulatory t",)),
    ("nk", ("natural killer", "nk cell")),
    ("t_cell", ("t cell", "alpha beta t")),
    ("b_cell", ("b cell", "plasma")),
    ("monocyte", ("monocyte",)),
    ("dendritic", ("dendritic",)),
    ("macrophage", ("macrophage",)),
    ("erythroid", ("erythrocyte", "erythroid")),
    ("megakaryocyte_platelet", ("megakaryocyte", "platelet")),
    ("neutrophil", ("neutrophil",)),
    ("hepatocyte", ("hepatocyte",)),
    ("endothelial", ("endothelial",)),
    ("fibroblast", ("fibroblast",)),
    ("epithelial", ("epithelial",)),
)
LINEAGES_LONG = (
    ("gamma_delta_t", ("gamma delta t",)),
    ("t_cell", ("regulatory t",)),
    ("nk", ("natural killer",)),
    ("t_cell", ("t cell", "alpha beta t")),
    ("b_cell", ("b cell", "plasma")),
    ("monocyte", ("monocyte",)),
    ("dendritic", ("dendritic",)),
    ("macrophage", ("macrophage",)),
    ("erythroid", ("erythrocyte", "erythroid")),
    ("megakaryocyte_platelet", ("megakaryocyte", "platelet")),
    ("precursor", ("hematopoietic precursor", "precursor", "pro b")),
    ("neutrophil", ("neutrophil",)),
)
# Subtype marks, which of them conflict, and the words that make a label specific.
SUBTYPES = (
    ("cd4", ("cd4",)),
    ("cd8", ("cd8",)),
    ("memory", ("memory",)),
    ("naive", ("naive", "thymus derived")),
    ("activated", ("activated",)),
    ("effector", ("effector",)),
    ("terminal", ("terminally differentiated",)),
    ("gamma_delta", ("gamma delta",)),
    ("nk_bright", ("cd56 bright",)),
    ("nk_dim", ("cd56 dim", "cd16 positive")),
    ("cd16_negative", ("cd16 negative",)),
)
CONFLICTS = (("cd4", "cd8"), ("naive", "memory"), ("gamma_delta", "cd4"), ("gamma_delta", "cd8"), ("nk_bright", "nk_dim"))
SPECIFIC = ("cd4", "cd8", "memory", "naive", "activated", "effector", "terminally differentiated", "gamma delta", "alpha beta", "cd16 positive", "cd16 negative", "cd56 bright", "cd56 dim", "classical", "non classical", "conventional")


def ambiguous(c: str | Column, words=AMBIGUOUS) -> Column:
    return has_any(c, words)


def label_status(label: str | Column, known_id: str | Column, alias_found: Column, alias_notes: str | Column, words=AMBIGUOUS) -> Column:
    """empty, ambiguous, canonical, alias or unmapped. alias_found: whether the alias table has the label; an id from there is known_id."""
    label, has_id = label_text(label), F.coalesce(col(known_id), F.lit("")) != ""
    noted = F.coalesce(col(alias_notes), F.lit(""))
    return (
        F.when(label.isNull(), "empty")
        .when(ambiguous(label, words), "ambiguous")
        .when(has_id & alias_found & noted.contains("alias"), "alias")
        .when(has_id, "canonical")
        .otherwise("unmapped")
    )


def leaf_or_broad(parent: str | Column) -> Column:
    return F.when(F.coalesce(col(parent), F.lit("")) != "", "leaf").otherwise("broad")


def level_by_words(label: str | Column, parent: str | Column) -> Column:
    """Without a parent broad; with one, leaf for up to two words and intermediate beyond."""
    return F.when(F.coalesce(col(parent), F.lit("")) == "", "broad").when(F.size(tokens(label)) <= 2, "leaf").otherwise("intermediate")


def _lineage(s: Column, rules) -> Column:
    out = F.when(s == "", "unknown")
    for name, parts in rules:
        out = out.when(has_any(s, parts), name)
    return out.otherwise("other")


def lineage(c: str | Column) -> Column:
    """Lineage of a label as it is written."""
    return bound(plain_label(c), lambda s: _lineage(s, LINEAGES))


def lineage_long(c: str | Column) -> Column:
    """Lineage of a label with abbreviations written out."""
    return bound(long_label(c), lambda s: _lineage(s, LINEAGES_LONG))


def _flags(s: Column) -> Column:
    return F.struct(*(has_any(s, parts).alias(name) for name, parts in SUBTYPES))


def _conflict(p: Column, g: Column) -> Column:
    out = F.lit(False)
    for a, b in CONFLICTS:
        out = out | (p[a] & g[b]) | (p[b] & g[a])
    return out


def _specificity(s: Column) -> Column:
    score = F.least(F.floor(F.size(tokens(s)) / 4), F.lit(2)).cast("int")
    for word in SPECIFIC:
        score = score + s.contains(word).cast("int")
    return F.when(s == "", 0).otherwise(score)


def _granularity(p: Column, g: Column) -> Column:
    return F.when(p == g, "same").when(p < g, "coarser_than_gold").otherwise("finer_than_gold")


def subtype_flags(c: str | Column) -> Column:
    return bound(long_label(c), _flags)


def subtype_conflict(pred: str | Column, gold: str | Column) -> Column:
    return bound(F.struct(subtype_flags(pred).alias("p"), subtype_flags(gold).alias("g")), lambda x: _conflict(x["p"], x["g"]))


def specificity(c: str | Column) -> Column:
    """Number of specific words in the label, and up to 2 more for its length."""
    return bound(long_label(c), _specificity)


def granularity(pred: str | Column, gold: str | Column) -> Column:
    return bound(F.struct(specificity(pred).alias("p"), specificity(gold).alias("g")), lambda x: _granularity(x["p"], x["g"]))


def overlap_by_longer(pred: str | Column, gold: str | Column) -> Column:
    """Shared words over the words of the longer label; 0 if either has none."""
    p, g = F.array_distinct(tokens(pred)), F.array_distinct(tokens(gold))
    both = (F.size(p) > 0) & (F.size(g) > 0)
    return F.when(both, F.round(F.size(F.array_intersect(p, g)) / F.greatest(F.size(p), F.size(g)), 4)).otherwise(0.0)


def overlap_by_union(pred: str | Column, gold: str | Column) -> Column:
    """Shared words over all words."""
    return bound(F.struct(tokens(pred).alias("p"), tokens(gold).alias("g")), lambda x: _overlap_by_union(x["p"], x["g"]))


def _overlap_by_union(p: Column, g: Column) -> Column:
    return F.round(F.size(F.array_intersect(p, g)) / F.greatest(F.lit(1), F.size(F.array_union(p, g))), 4)


def compared(pred: str | Column, gold: str | Column) -> dict[str, Column]:
    """exact, token_overlap, lineages, same_lineage and severe_error of labels as they are written."""
    p, g = plain_label(pred), plain_label(gold)
    a, b = lineage(pred), lineage(gold)
    return {
        "exact": (p == g) & (p != ""),
        "token_overlap": overlap_by_longer(pred, gold),
        "pred_lineage": a,
        "gold_lineage": b,
        "same_lineage": (a == b) & (a != "unknown"),
        "severe_error": (a != b) & (a != "unknown") & (b != "unknown"),
    }


#: The parts of a comparison.
PARTS = ("exact_match", "normalized_exact_match", "same_lineage", "granularity_relation", "match_level", "severe_error", "token_overlap", "pred_lineage", "gold_lineage", "pred_label", "gold_label")


def comparison(pred: str | Column, gold: str | Column) -> Column:
    """Match level and its parts, as a struct, of labels with abbreviations written out; null parts where either is empty.

    Each step is bound before the next names it: written out, the label's rules would be repeated a thousandfold.
    """

    def side(plain: Column, long: Column, again: Column) -> Column:
        return F.struct(
            plain.alias("plain"), long.alias("label"), _lineage(again, LINEAGES_LONG).alias("lineage"), _flags(again).alias("flags"),
            _specificity(again).alias("specificity"), tokens(long).alias("words"))

    def read(c: str | Column) -> Column:
        return bound(long_label(c), lambda s: bound(F.struct(plain_label(c).alias("plain"), s.alias("long"), long_label(s).alias("again")), lambda x: side(x["plain"], x["long"], x["again"])))

    def told(p: Column, g: Column, overlap: Column) -> Column:
        here = (p["label"] != "") & (g["label"] != "")
        exact, normal, same = p["plain"] == g["plain"], p["label"] == g["label"], p["lineage"] == g["lineage"]
        level = (
            F.when(~here, "unavailable").when(exact, "exact").when(normal, "normalized_exact")
            .when(same & _conflict(p["flags"], g["flags"]), "same_lineage_conflict").when(same & (overlap >= 0.5), "same_lineage_close")
            .when(same, "same_lineage_broad").otherwise("cross_lineage_error")
        )
        values = (exact, normal, same, _granularity(p["specificity"], g["specificity"]), level, ~exact & ~normal & ~same, overlap, p["lineage"], g["lineage"], p["label"], g["label"])
        return F.struct(*((c if name == "match_level" else F.when(here, c)).alias(name) for name, c in zip(PARTS, values, strict=True)))

    both = F.struct(read(pred).alias("p"), read(gold).alias("g"))
    with_overlap = lambda x: F.struct(x["p"].alias("p"), x["g"].alias("g"), _overlap_by_union(x["p"]["words"], x["g"]["words"]).alias("overlap"))
    return bound(bound(both, with_overlap), lambda x: told(x["p"], x["g"], x["overlap"]))


def compared_long(pred: str | Column, gold: str | Column) -> dict[str, Column]:
    """The parts of a comparison by name. A column of the whole struct, selected first, is worked out once for all of them."""
    whole = comparison(pred, gold)
    return {name: whole[name] for name in PARTS}


def _item_sets(a: str | Column, b: str | Column) -> Column:
    """Two lists as sets of plain labels, blank ones left out: struct(x, y)."""
    sets = (F.array_distinct(F.filter(F.transform(F.coalesce(col(c), F.array().cast("array<string>")), plain_label), lambda s: s != "")) for c in (a, b))
    return F.struct(*(s.alias(name) for s, name in zip(sets, "xy", strict=True)))


def list_overlap(a: str | Column, b: str | Column) -> Column:
    """Jaccard of two lists as sets of plain labels; null if both are empty."""

    def share(s: Column) -> Column:
        n = F.size(F.array_union(s["x"], s["y"]))
        return F.when(n > 0, F.round(F.size(F.array_intersect(s["x"], s["y"])) / n, 4))

    return bound(_item_sets(a, b), share)


def shared_items(a: str | Column, b: str | Column) -> Column:
    """Number of plain labels that two lists share."""
    return bound(_item_sets(a, b), lambda s: F.size(F.array_intersect(s["x"], s["y"])))


def three_valued(a: str | Column, b: str | Column) -> Column:
    """Whether a and b agree as folded text; null if either is missing."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), folded(a) == folded(b))
