import hashlib
import random
import re

from loam.llm import substring as s

from .conftest import edge_rows


def brute(rows, window):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = {}
    for _, w in docs:
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, w in docs:
        gone = set()
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone.update(range(a, a + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def found(df, **kw):
    return sorted((tuple(r) for r in s.substring_dedup(df, **kw).collect()), key=str)


def test_edges_at_the_real_length(edge, none):
    assert found(edge) == brute([r[:2] for r in edge_rows()], 35)
    assert found(none) == []


def test_small_windows_over_few_words(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i % 50, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    rows += [(100 + i, "z z z z z z z z z z " * 3) for i in range(3)] + [(200, "ä ö ü " * 8 + "\x0bä\tö")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for window, seed in ((5, 2), (7, 7), (8, 3)):
        assert found(df, window=window, seed_words=seed) == brute(rows, window)
    monkeypatch.setattr(s, "GROUP_ROWS", 3)  # anchors that are very frequent
    assert found(df, window=6, seed_words=3) == brute(rows, 6)
