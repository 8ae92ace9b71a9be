"""Documents with everything that is odd, and plain-Python helpers."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, size int, label string, fp long, node long, told string, own string, nth int, `group` int, copies int"


def documents(spark, extra=True):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(24)]
    texts += [None, "", " \t\n", "x", "a b", "long " * 30_000, "q" * 5_000, texts[0], texts[0], texts[0].upper(), "é ü \U0001f600 漢字 " * 20]
    rows = [(k, t, "en", [None, "s1", "s2"][k % 3], None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [(None, texts[1], None, None, None), (None, None, None, None, None), rows[3], rows[3]]
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return spark.createDataFrame([(*r, 1, "l", 2, 3, "t", "o", 4, 5, 6) for r in rows], DDL)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def labels(spark):
    rows = [(k, k % 2, (k // 2) % 2) for k in range(30)] + [(3, 1, 1), (None, 1, 0), (4, None, None), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def key(row):
    return tuple((v is None, str(v)) for v in row)


def plain_components(ids, linked):
    """For each id the smallest id reachable over linked(a, b), by breadth-first search."""
    out = {}
    for start in sorted(ids):
        if start in out:
            continue
        front, out[start] = [start], start
        while front:
            x = front.pop()
            for y in ids:
                if y not in out and linked(x, y):
                    out[y] = start
                    front.append(y)
    return out
