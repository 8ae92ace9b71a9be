"""Knowledge bases of labels and their features: building, merging, lookup and retrieval."""

from __future__ import annotations

from importlib.util import find_spec

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from labelloom.functions.text import col, folded, label_text, plain_label, rounded, short_id
from labelloom.operators.sides import sent, small, stored


def external_entries(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries from an outside list, with id and parent from labels (key, id, parent_label), genes trimmed, weight rounded."""
    genes = F.filter(F.transform("marker_genes", lambda g: F.trim(g)), lambda g: g != "")
    rows = df.select("*", label_text("label").alias("key")).join(labels.select("key", F.col("id").alias("_id"), F.col("parent_label").alias("_parent")), "key", "left")
    return rows.select(
        short_id("species", "tissue", "key").alias("entry_id"), "species", F.lower("tissue").alias("tissue"), F.col("key").alias("label"),
        F.coalesce(F.nullif("id", F.lit("")), "_id").alias("id"), F.col("_parent").alias("parent_label"), genes.alias("genes"),
        F.round("weight", 4).alias("weight"), F.lit("external").alias("entry_type"))


def derived_entries(records: DataFrame) -> DataFrame:
    """Entries from marker records: genes of the markers, weight the quality (1 at most); blank labels and empty lists are left out."""
    genes = F.transform("markers", lambda m: m["gene"])
    return records.where((F.coalesce(F.trim("label"), F.lit("")) != "") & (F.size("markers") > 0)).select(
        short_id("species", "tissue", "label").alias("entry_id"), "species", F.lower("tissue").alias("tissue"), label_text("label").alias("label"),
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("parent_label"), genes.alias("genes"),
        F.least(F.round("quality", 4), F.lit(1.0)).alias("weight"), F.lit("derived").alias("entry_type"))


def merged_entries(entries: DataFrame, most_genes: int = 20) -> DataFrame:
    """One entry for each species, tissue and label, whatever the case: the external or else heaviest one leads, and its
    genes come first in the union, in which case-only repeats and what exceeds most_genes are left out."""
    keyed = entries.select("*", *(folded(c).alias(f"_{c}") for c in ("species", "tissue", "label")))
    keys = ["_species", "_tissue", "_label"]
    order = Window.partitionBy(*keys).orderBy((F.col("entry_type") != "external").cast("int"), F.desc("weight"), "entry_id")
    turn = keyed.withColumn("_turn", F.row_number().over(order))
    genes = turn.select(*keys, "_turn", F.posexplode("genes").alias("_pos", "gene"))
    first = genes.groupBy(*keys, F.lower("gene").alias("_g")).agg(F.min(F.struct("_turn", "_pos", "gene")).alias("g"))
    union = first.groupBy(*keys).agg(F.slice(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["gene"]), 1, most_genes).alias("genes"))
    lead = turn.where("_turn = 1").drop("genes", "_turn")
    n = turn.groupBy(*keys).agg(F.count("*").alias("n_sources"))
    return lead.join(union, keys, "left").join(n, keys).drop(*keys).orderBy("tissue", "label")


def in_scope(species: str | Column, tissue: str | Column, want_species: Column, want_tissue: Column) -> Column:
    """Whether an entry is of the species and, if it names one, of the tissue."""
    t = folded(tissue)
    return (folded(species) == folded(want_species)) & (t.isin(*ANY_TISSUE) | (t == folded(want_tissue)))


def _genes(df: DataFrame, *carried: str | Column) -> DataFrame:
    """The carried columns, size (of the row's genes, as a set, whatever their case) and each gene of it."""
    rows = df.select(*carried, F.array_distinct(F.transform("genes", F.lower)).alias("_g"))
    return rows.select(*[c for c in rows.columns if c != "_g"], F.size("_g").alias("_size"), F.explode("_g").alias("gene"))


#: Most rows of genes of a knowledge base that are sent to every executor; beyond that they are joined with a shuffle.
SENT = 1_000_000


def overlaps(queries: DataFrame, entries: DataFrame, query: str = "query_id", entry: str = "entry_id") -> DataFrame:
    """query, entry, shared and Jaccard of every pair with a gene in common, by an equi-join on the genes.

    queries and entries: id and array genes. Genes count as sets, whatever the case. Genes are joined, not ids, so
    nothing is compared that shares nothing; sizes travel with the genes. A small knowledge base is sent: the genes of
    a query then stay in its task, and its pairs are counted there, before they are shuffled.
    """
    q = _genes(queries, query).withColumnRenamed("_size", "_nq")
    e = _genes(entries, entry).withColumnRenamed("_size", "_ne")
    met = q.join(small(e, SENT), "gene").groupBy(query, "_nq", entry, "_ne").agg(F.count("*").alias("shared"))
    return met.select(query, entry, "shared", (F.col("shared") / (F.col("_nq") + F.col("_ne") - F.col("shared"))).alias("jaccard"))


#: For the best k entries of a query: how many of its rarest genes, times k, name the entries that are scored first; and how
#: many shared genes an entry must show among its rarest ones to be scored later.
RAREST, SHOWN = 4, 3


def _by_rarity(genes: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """keys and ids: the numbers of their known genes, rarest first."""
    met = genes.join(known, "gene")
    return met.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "id"))), lambda g: g["id"]).alias("ids"))


def scored_pairs(queries: DataFrame, entries: DataFrame, k: int = 5, bonus: float = 0.2) -> DataFrame:
    """query_id, entry_id, label, shared, jaccard and score (rounded) of pairs with a gene in common: all that can be among
    the k best of their query, and few others.

    Genes of an index are in order of rarity. The entries on a query's 4 k rarest genes are scored first; their k-th best
    score is what others must reach. So they must share a least number of genes, which follows from both sizes, the score
    and whether the tissues give the bonus; if they do, the rarest three of these lie among all but the last genes of
    both, as many as the number leaves. Only such prefixes are joined, and only pairs with three hits in them are scored,
    by the intersection of their gene numbers. A frequent gene is hardly ever in a prefix.

    Query and entry ids are distinct; genes count as sets, whatever the case.
    """
    listed = stored(_genes(entries, "entry_id", "label", folded("tissue").alias("_et")).withColumnRenamed("_size", "_ne"), "entries")
    known = stored(listed.groupBy("gene").agg(F.count("*").alias("df")).withColumn("id", F.monotonically_increasing_id()), "genes")
    index = stored(_by_rarity(listed, small(known, SENT), "entry_id", "label", "_et", "_ne").withColumnRenamed("ids", "_has").withColumn("_e", F.monotonically_increasing_id()), "index")
    asked = _genes(queries, "query_id", folded("tissue").alias("_qt")).withColumnRenamed("_size", "_nq")
    asked = stored(_by_rarity(asked, small(known, SENT), "query_id", "_qt", "_nq").withColumnRenamed("ids", "_asks"), "asked")
    places = small(stored(index.select("_e", "_et", "_ne", F.posexplode("_has").alias("_at", "id")), "places"), SENT)
    held = small(index)
    more = F.when((F.col("_qt") != "") & (F.col("_qt").contains(F.col("_et")) | F.col("_et").contains(F.col("_qt"))), bonus).otherwise(0.0)

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(held, "_e").join(asked, "query_id").withColumn("shared", F.size(F.array_intersect("_asks", "_has")).cast("long"))
        met = met.withColumn("jaccard", F.col("shared") / (F.col("_nq") + F.col("_ne") - F.col("shared")))
        return met.select("query_id", "_e", "entry_id", "label", "shared", "jaccard", rounded(F.col("jaccard") + more, 4).alias("score"))

    first = asked.select("query_id", F.explode(F.slice("_asks", 1, RAREST * k)).alias("id")).join(places, "id").select("query_id", "_e").distinct()
    first = stored(scored(first), "first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    least = first.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= k).groupBy("query_id").agg(F.min("score").alias("_least"), F.count("*").alias("_n"))
    least = least.where(F.col("_n") == k).select("query_id", "_least")

    def wanted(size: Column, jaccard: Column) -> Column:
        """The least number of shared genes of two sets of `size` genes in all for that similarity; 1 without one."""
        n = F.ceil(jaccard / (1 + jaccard) * size - 1e-9)
        return F.coalesce(F.when(jaccard > 0, F.greatest(n, F.lit(1))), F.lit(1)).cast("int")

    slack = 0.5e-4 + 1e-9  # of a rounded score
    rest = asked.join(least, "query_id", "left")
    own = wanted(F.col("_nq"), F.col("_least") - bonus - slack)  # whatever the entry
    rest = rest.select("query_id", "_qt", "_nq", "_least", F.size("_asks").alias("_known"), F.posexplode(F.slice("_asks", F.lit(1), F.greatest(F.lit(0), F.size("_asks") - own + SHOWN))).alias("_of", "id"))
    met = rest.join(places, "id").withColumn("_want", wanted(F.col("_nq") + F.col("_ne"), F.col("_least") - more - slack)).withColumn("_show", F.least("_want", F.lit(SHOWN)))
    met = met.where((F.col("_want") <= F.least("_known", "_ne")) & (F.col("_at") < F.col("_ne") - F.col("_want") + F.col("_show")) & (F.col("_of") < F.col("_known") - F.col("_want") + F.col("_show")))
    later = met.groupBy("query_id", "_e", "_show").agg(F.count("*").alias("_n")).where("_n >= _show").select("query_id", "_e")
    later = later.join(first.select("query_id", "_e"), ["query_id", "_e"], "left_anti")
    return first.unionByName(scored(later)).drop("_e")


def _counted_in_tasks(queries: DataFrame, entries: DataFrame, k: int, bonus: float) -> DataFrame:
    """The same columns for each query's entries that score less than a rounding below its k-th best, or more.

    For a knowledge base that is small enough to be sent: its lists of entries by gene go to every worker, and a query
    adds up those of its genes, so its pairs are numbers in one array and never rows.
    """
    rows = entries.select("entry_id", "label", folded("tissue").alias("_et"), F.array_distinct(F.transform("genes", F.lower)).alias("_g")).where(F.size("_g") > 0).toArrow()
    lists = rows["_g"].combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    of = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[order]
    starts = np.searchsorted(coded.indices.to_numpy()[order], np.arange(len(coded.dictionary) + 1))
    tissues = rows["_et"].combine_chunks().dictionary_encode()
    index = queries.sparkSession.sparkContext.broadcast((coded.dictionary, of, starts, sizes, tissues.dictionary.to_pylist(), tissues.indices.to_numpy(), rows.select(["entry_id", "label"])))
    asked = queries.select("query_id", folded("tissue").alias("_qt"), F.array_distinct(F.transform("genes", F.lower)).alias("_g")).where(F.size("_g") > 0)
    schema = StructType([asked.schema["query_id"], entries.schema["entry_id"], entries.schema["label"], *(StructField(c, kind) for c, kind in (("shared", LongType()), ("jaccard", DoubleType()), ("_more", DoubleType())))])
    out = to_arrow_schema(schema)

    def each(batches):
        genes, of, starts, sizes, names, tissue, known = index.value
        for batch in batches:
            ids = pc.index_in(batch.column(2).flatten(), genes).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())
            found = []
            for row, (qt, end, size) in enumerate(zip(batch.column(1).to_pylist(), ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True)):
                own = ids[end - size : end]
                own = own[~np.isnan(own)].astype(np.int64)
                if not len(own):
                    continue
                n = np.bincount(np.concatenate([of[starts[g] : starts[g + 1]] for g in own]), minlength=len(sizes))
                at = np.flatnonzero(n)
                jaccard = n[at] / (size + sizes[at] - n[at])
                more = np.array([bonus if qt and (qt in t or t in qt) else 0.0 for t in names])[tissue[at]]
                score = jaccard + more
                best = score >= (np.partition(score, -k)[-k] if len(at) > k else 0) - 1e-4
                found.append((np.full(int(best.sum()), row), at[best], n[at[best]], jaccard[best], more[best]))
            if found:
                of_row, at, n, jaccard, more = (np.concatenate(c) for c in zip(*found, strict=True))
                entry = known.take(pa.array(at))
                columns = [batch.column(0).take(pa.array(of_row)), *(entry[c].combine_chunks() for c in ("entry_id", "label")), pa.array(n), pa.array(jaccard), pa.array(more)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    met = asked.mapInArrow(each, schema)
    return met.select("query_id", "entry_id", "label", "shared", "jaccard", rounded(F.col("jaccard") + F.col("_more"), 4).alias("score"))


def retrieved(queries: DataFrame, entries: DataFrame, k: int = 5, bonus: float = 0.2) -> DataFrame:
    """The k best entries of each query (query_id, genes, tissue) by Jaccard and a bonus where the tissues share text.

    A blank tissue of an entry is part of any tissue and gets the bonus too; a query without a tissue gets none. Scores
    are rounded, and entries that tie are in order of their id. A knowledge base of up to SENT genes (counted) is sent
    and pairs are counted in the tasks of the queries; pairs of a larger one are found by prefixes, see scored_pairs.
    """
    n = entries.agg(F.sum(F.size("genes"))).first()[0] or 0
    pairs = _counted_in_tasks(queries, entries, k, bonus) if n <= SENT else scored_pairs(queries, entries, k, bonus)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


#: Tissues of an entry that stand for any.
ANY_TISSUE = ("", "unknown", "all")


def _scopes(queries: DataFrame, entries: DataFrame, scoped: bool) -> tuple[DataFrame, DataFrame]:
    """queries with their scope (species and tissue, folded), and for each scope the entries in it."""
    if not scoped:
        return queries.withColumn("scope", F.lit("")), entries.withColumn("scope", F.lit(""))
    species, tissue = folded("species"), folded("tissue")
    queries = queries.withColumn("scope", F.struct(species.alias("species"), tissue.alias("tissue")))
    scopes = queries.select("scope").distinct()
    e = entries.withColumns({"_species": species, "_tissue": tissue})
    any_ = F.col("_tissue").isin(*ANY_TISSUE)
    of_species = F.col("scope.species") == F.col("_species")
    wide = scopes.join(e.where(any_), of_species).unionByName(scopes.where("scope.tissue = ''").join(e.where(~any_), of_species))
    own = scopes.where("scope.tissue <> ''").join(e.where(~any_), of_species & (F.col("scope.tissue") == F.col("_tissue")))
    return queries, wide.unionByName(own).drop("_species", "_tissue")


def retrieved_labels(queries: DataFrame, entries: DataFrame, k: int = 5, scoped: bool = False) -> DataFrame:
    """The k best labels of each query by Jaccard with all genes of the label, with its heaviest entry.

    scoped: only entries of the query's species and of its tissue (or of no tissue in particular) count, for the genes
    of a label and for its heaviest entry; a query without a tissue takes those of any. The genes of each label are
    put together once for each species and tissue asked for, as distinct rows, not as one list.
    """
    queries, entries = _scopes(queries, entries, scoped)
    entries = entries.withColumn("_label", F.xxhash64("scope", "label"))  # names a scope's label in one number
    genes = entries.select("scope", "_label", F.explode("genes").alias("g")).select("scope", "_label", F.lower("g").alias("gene")).distinct()
    sizes = genes.groupBy("_label").agg(F.count("*").alias("_ne"))
    best = entries.groupBy("_label", "label").agg(F.max_by("entry_id", F.struct("weight", "entry_id")).alias("entry_id"))
    q = _genes(queries, "query_id", "scope").withColumnRenamed("_size", "_nq")
    met = q.join(sent(genes, SENT), ["scope", "gene"]).groupBy("query_id", "_nq", "_label").agg(F.count("*").alias("shared"))
    met = met.join(sent(sizes.join(best, "_label")), "_label")
    met = met.withColumn("score", rounded(F.col("shared") / (F.col("_nq") + F.col("_ne") - F.col("shared")), 4))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "label"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "label", "shared", "score", "entry_id", "rank")


def ontology_index(aliases: DataFrame) -> DataFrame:
    """One row an id: label of its first alias row, later raw labels as sorted synonyms, first parent that isn't empty."""
    rows = aliases.where(F.coalesce(F.trim("id"), F.lit("")) != "")
    ord_ = F.col("ord")
    firsts = rows.groupBy("id").agg(F.min(ord_).alias("first"))
    met = rows.join(firsts, "id")
    name = F.lower(F.trim("raw_label"))
    return met.groupBy("id").agg(
        F.min_by("normalized_label", ord_).alias("label"),
        F.array_sort(F.collect_set(F.when(ord_ > F.col("first"), name))).alias("synonyms"),
        F.min_by("parent_label", F.when(F.coalesce("parent_label", F.lit("")) != "", ord_)).alias("parent_label"),
    )


def lookup_keys(index: DataFrame) -> DataFrame:
    """key, id and priority: labels (0) and synonyms (1) of an ontology index."""
    return index.select(F.explode(F.concat(F.array(F.struct(label_text("label").alias("key"), F.lit(0).alias("priority"))), F.transform("synonyms", lambda s: F.struct(label_text(s).alias("key"), F.lit(1).alias("priority"))))).alias("k"), "id").select("k.*", "id").where("key is not null")


def _grams(c: str, least: int = 1) -> Column:
    """The substrings of `least` to 3 characters, each once."""
    def of(k: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(c) - (k - 1)), lambda i: F.col(c).substr(i, F.lit(k)))
        return F.when(F.length(c) >= k, every).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*(of(k) for k in range(least, 4))))


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (inner, outer) of distinct texts where inner is within outer; an empty inner is within all.

    Each inner meets the outers on one of its grams of three characters, the rarest among them, or, if shorter, on itself.
    """
    grams = outer.select("outer", F.explode(F.concat(F.array(F.lit("")), _grams("outer"))).alias("g"))
    own = inner.select("inner", F.explode(F.when(F.length("inner") < 3, F.array("inner")).otherwise(_grams("inner", 3))).alias("g"))
    rarest = own.join(grams.groupBy("g").count(), "g", "left").groupBy("inner").agg(F.min_by("g", F.coalesce("count", F.lit(0))).alias("g"))
    return rarest.join(grams, "g").where(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


#: Most names whose automaton is sent to every task; beyond that, or without the library for it, texts meet on grams.
NAMES = 200_000 if find_spec("ahocorasick") else -1


def _automaton(names: list[tuple[str, int]]):
    """All names at once as a machine that reads a text one time (Aho-Corasick); each knows its least number."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for name, number in names:
        if name:
            found.add_word(name, min(number, found.get(name, number)))
    found.make_automaton()
    return found


def first_inside(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text and ord: of the names (name, ord) that are part of a distinct text, the least ord; texts without one are left out.

    Up to NAMES names (counted) are sent as one automaton, which reads each text once, whatever their number, and gives
    one row a text; of more, pairs meet on grams.
    """
    if names.limit(NAMES + 1).count() > NAMES:
        pairs = containing(names.select(F.col("name").alias("inner")).distinct(), texts.withColumnRenamed("text", "outer"))
        return pairs.join(names, F.col("inner") == F.col("name")).groupBy(F.col("outer").alias("text")).agg(F.min("ord").alias("ord"))
    sent_ = texts.sparkSession.sparkContext.broadcast([(r["name"], r["ord"]) for r in names.collect()])
    schema = StructType([texts.schema["text"], StructField("ord", LongType())])

    def each(batches):
        found, blank = _automaton(sent_.value), min((n for name, n in sent_.value if not name), default=None)
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                least = min((n for _, n in found.iter(text)), default=None) if len(found) else None
                least = blank if least is None else least if blank is None else min(least, blank)
                if least is not None:
                    rows.append((text, least))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.string()), (1, pa.int64()))], ["text", "ord"])

    return texts.select("text").mapInArrow(each, schema)


def first_around(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text and ord: of the names (name, ord) that a distinct text is part of, the least ord; an empty text is part of all.

    Up to NAMES texts are sent as one automaton, which reads each name once; a task gives one row for each text it has met.
    """
    if texts.limit(NAMES + 1).count() > NAMES:
        pairs = containing(texts.withColumnRenamed("text", "inner"), names.select(F.col("name").alias("outer")).distinct())
        return pairs.join(names, F.col("outer") == F.col("name")).groupBy(F.col("inner").alias("text")).agg(F.min("ord").alias("ord"))
    sent_ = texts.sparkSession.sparkContext.broadcast([r["text"] for r in texts.collect()])
    schema = StructType([texts.schema["text"], StructField("ord", LongType())])

    def each(batches):
        every = sent_.value
        found, least = _automaton([(text, k) for k, text in enumerate(every)]), {}
        blank = [k for k, text in enumerate(every) if not text]
        for batch in batches:
            for name, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in {*blank, *(k for _, k in found.iter(name))} if len(found) else blank:
                    if number < least.get(k, number + 1):
                        least[k] = number
        yield pa.RecordBatch.from_arrays([pa.array([every[k] for k in least], pa.string()), pa.array(list(least.values()), pa.int64())], ["text", "ord"])

    met = names.select("name", F.col("ord").cast("long").alias("ord")).mapInArrow(each, schema)
    return met.groupBy("text").agg(F.min("ord").alias("ord"))


def rule_mapped(labels: DataFrame, index: DataFrame) -> DataFrame:
    """label and the id it maps to: exact label, then synonym, then the first label in file order where one is part of the other.

    Labels meet as plain_label and once each; of equal index keys the last row's id holds. A blank label is part of the
    first one, as the original has it. Labels of one key stay rows of their own.
    """
    index = index.where(F.coalesce("id", F.lit("")) != "").withColumn("_name", plain_label("label"))
    names = index.where("_name <> ''").groupBy(F.col("_name").alias("name")).agg(F.max_by("id", "ord").alias("id"), F.min("ord").alias("ord"))
    other = index.select("id", "ord", F.explode("synonyms").alias("s")).select(plain_label("s").alias("key"), "id", "ord").where("key <> ''")
    other = other.groupBy("key").agg(F.max_by("id", "ord").alias("other"))
    rows = labels.select("label", plain_label("label").alias("key"))
    met = rows.select("key").distinct().join(names.select(F.col("name").alias("key"), "id"), "key", "left").join(other, "key", "left")
    left, known = met.where("id is null and other is null").select("key"), names.select("name", "ord")
    texts = left.withColumnRenamed("key", "text")
    numbered = known.withColumn("ord", F.col("ord").cast("long"))
    first = first_around(texts, numbered).union(first_inside(texts, numbered)).groupBy("text").agg(F.min("ord").alias("_first"))
    part = first.join(names.select(F.col("ord").alias("_ord"), F.col("id").alias("part")), F.col("_first") == F.col("_ord")).groupBy(F.col("text").alias("key")).agg(F.min("part").alias("part"))
    met = met.join(part, "key", "left")
    rule = F.when(F.col("id").isNotNull(), "exact").when(F.col("other").isNotNull(), "synonym").when(F.col("part").isNotNull(), "part").otherwise("none")
    return rows.join(met.select("key", F.coalesce("id", "other", "part").alias("id"), rule.alias("rule")), "key").select("label", "id", "rule")


def entries_by_label(entries: DataFrame, label: Column) -> DataFrame:
    return entries.where(folded("label") == folded(label))


def entries_by_id(entries: DataFrame, id_: Column) -> DataFrame:
    return entries.where(col("id") == id_)
