"""The pipeline's stages on odd and on generated documents, and the library without this part."""

import os
import re
import shutil
import subprocess
import sys
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from labelloom.llm import pii, quality, queries
from labelloom.llm.common import written
from tests.compare import both, connection
from tests.llm import edges
from tests.llm.test_mixing_sharding import plain_targets
from tests.llm.test_packing import check as check_pieces
from tests.llm.test_pii import plain_spans, plain_terms
from tests.llm.test_simhash import plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(edges.key(r) for r in df.collect())


def check_good(docs, out):
    """Just the documents whose score, by the scoring query, reaches 0.3."""
    labels = docs.sparkSession.read.parquet(f"{FOLDER}/labels.parquet")
    scores = defaultdict(list)
    for r in quality.quality(docs, labels).collect():
        scores[r["doc_id"]].append(r["score"] >= 0.3)
    kept = rows_of(out)
    for row in docs.collect():
        if len(set(scores[row["doc_id"]])) == 1:
            assert (edges.key(row) in kept) == scores[row["doc_id"]][0]
    assert not kept - rows_of(docs)


def check_distinct(docs, out):
    """One row of each component of plain fingerprints, of the smallest id."""
    fp = {t: plain_fingerprint(t) for t in {r["text"] for r in docs.collect()}}
    top = edges.plain_components(sorted(set(fp.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    first, got = {}, Counter(top[fp[r["text"]]] for r in out.collect())
    for r in docs.collect():
        i = (r["doc_id"] is None, r["doc_id"] or 0)
        first[top[fp[r["text"]]]] = min(first.get(top[fp[r["text"]]], i), i)
    assert got == Counter(dict.fromkeys(first, 1)) and not rows_of(out) - rows_of(docs)
    assert {(r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()} == set(first.values())


def check_clean(docs, out):
    """Every text with its plain spans and plain telling terms replaced, all else as it was."""
    texts = [r["text"] or "" for r in docs.collect()]
    terms = plain_terms(texts, pii.THRESHOLD, pii.SUPPORT)

    def cleaned(text):
        spans = plain_spans(text)
        inside = {at for _, a, b in spans for at in range(a, b)}
        spans += [("term", *m.span()) for m in re.finditer(r"[^\W_]+", text) if m[0].lower() in terms and not inside & set(range(*m.span()))]
        return pii.generalised(text, spans)

    want = Counter()
    for r in docs.collect():
        d = r.asDict()
        d["text"] = d["text"] and cleaned(d["text"])
        d["n_chars"] = None if d["text"] is None else len(d["text"])
        want[edges.key(d[c] for c in docs.columns)] += 1
    assert want == rows_of(out)


def check_mix(docs, out):
    """Each row at most twice, and each source's words within its longest document of the plain target."""
    had, got = rows_of(docs), rows_of(out)
    assert all(got[k] <= 2 * had[k] for k in got)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, most, taken = Counter(), Counter(), Counter()
    for r in docs.collect():
        sizes[r["source"]] += size(r["text"])
        most[r["source"]] = max(most[r["source"]], size(r["text"]))
    for r in out.collect():
        taken[r["source"]] += size(r["text"])
    want = plain_targets(dict(sizes)) if sum(sizes.values()) else {}
    assert all(abs(taken[s] - want[s]) <= most[s] for s in want)


def check_pack(docs, out):
    check_pieces(docs, out.collect())


CHECKS = [check_good, check_distinct, check_clean, check_mix, check_pack]


@pytest.mark.parametrize("kind", ["generated", "odd"])
def test_stages_against_plain_code(spark, kind):
    """Each stage over what its predecessor kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet") if kind == "generated" else edges.documents(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    for (name, stage), check in zip(corpus_pipeline.STAGES, CHECKS, strict=True):
        out = written(stage(spark, docs, FOLDER), name)
        assert name == "packing" or out.columns == docs.columns
        check(docs, out)
        docs = out
    if kind == "generated":
        again = corpus_pipeline.run(spark, FOLDER)
        pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert docs.count() > 0 and rows_of(again.select(*pieces)) == rows_of(docs.select(*pieces))


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_and_empty_tables(spark, k):
    stage = corpus_pipeline.STAGES[k][1]
    for docs in (edges.documents(spark), edges.empty(spark)):
        out = stage(spark, docs, FOLDER)
        out.collect()
        assert k == 4 or out.columns == docs.columns


def test_sql_of_queries(spark):
    for name, sql in queries.ORACLE_SQL.items():
        (columns, ours), (names, theirs) = both(spark, connection(FOLDER), queries.QUERIES[name], sql, FOLDER)
        assert (columns, ours) == (names, theirs)


def test_library_without_this_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)
