import random
import re

from loam.llm import linededup as l

from .conftest import edge_rows

STRIP = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), STRIP.sub("", line))


def brute(rows, least, keep_first):
    docs = {}
    for i, t in rows:
        docs.setdefault((i, t), (t or "").split("\n"))
    where, first = {}, {}
    for (i, t), lines in docs.items():
        for p, x in enumerate(lines):
            k = key(x)
            where.setdefault(k, set()).add(i)
    n = {}
    for (i, t), lines in docs.items():
        for x in lines:
            n[key(x)] = n.get(key(x), 0) + 1
    out = []
    bad = {k for k, ids in where.items() if k and len(ids) >= least and (not keep_first or n[k] > 1)}
    if keep_first:
        for (i, t) in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
            for p, x in enumerate(docs[i, t]):
                if key(x) in bad and key(x) not in first:
                    first[key(x)] = (i, t, p)
    for i, t in rows:
        lines = docs[i, t]
        kept = [x for p, x in enumerate(lines) if key(x) not in bad or first.get(key(x)) == (i, t, p)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(df, least, keep_first):
    return sorted((tuple(r) for r in l.line_dedup(df, least, keep_first).collect()), key=str)


def test_edges(edge, none):
    rows = [r[:2] for r in edge_rows()]
    for least in (2, 10):
        assert found(edge, least, False) == brute(rows, least, False)
    assert found(none, 10, False) == []


def test_random_lines(spark):
    rng = random.Random(1)
    lines = ["", " ", "A b", "a B ", "\ta b\x0b", "c", "C", "x\x0cy", "É", "é", "long " * 40] + [f"l{i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 150)))) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame([(*r, 0, "h") for r in rows], "doc_id long, text string, n_lines int, h1 string").repartition(3)
    for least in (1, 2, 10, 30):
        for keep in (False, True):
            assert found(df, least, keep) == brute(rows, least, keep), (least, keep)
