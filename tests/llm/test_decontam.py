import random
import re

import numpy as np

from loam.llm import decontam as d
from .conftest import edge_rows, prose


def brute(docs, items):
    """doc and item, for every item that some passage holds; words and shingles as they stand, no pieces."""
    out = set()
    for item, text in items:
        t = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        if not t:
            continue
        mark = text.rfind("?")
        asked = len(re.findall("[A-Za-z0-9\x80-\U0010ffff]+", text[: mark + 1])) if mark >= 0 else 0
        cut = asked if 0 < asked < len(t) else len(t) if len(t) < 3 else -(-2 * len(t) // 3)
        question = {tuple(t[i : i + 5]) for i in range(max(1, cut - 4))} if cut >= 5 else {tuple(t[:cut])}
        answer, wide = set(t[cut:]), max(0, len(t) - d.PIECE)
        for doc, body in docs:
            w = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
            starts = [0] + [a for a in range(d.STRIDE, max(1, len(w)), d.STRIDE) if a - d.STRIDE + d.PASSAGE < len(w)]
            for a in starts:
                part = w[max(0, a - wide) : a + d.PASSAGE + wide]
                q = sum(any(tuple(part[i : i + len(s)]) == s for i in range(len(part) - len(s) + 1)) for s in question) / len(question)
                if q >= d.OVERLAP and (not answer or len(answer & set(part)) / len(answer) >= d.OVERLAP):
                    out.add((doc, item))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([3, 12, 30, 50, 90])) + rng.choice(["?", "? yes indeed so", ""])) for i in range(40)] + [(50, ""), (51, "word")]
    docs = [(r[0], r[1]) for r in edge_rows() if r[0] is not None]
    for i in range(60):
        text = prose(rng, rng.choice([5, 60, 200, 700]))
        item = items[rng.randrange(40)][1].split()
        if i % 2:
            for _ in range(rng.randrange(3)):  # altered words
                item[rng.randrange(len(item))] = "zzz"
        at = rng.randrange(len(text.split()) + 1)
        w = text.split()
        docs.append((100 + i, " ".join(w[:at] + item + w[at:])))
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame([*items, (None, "x"), (60, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(df, b).collect()}
    assert got == brute(set(docs), items) and len(got) > 20
    clean = {r.doc_id for r in d.clean_documents(df, b).collect()}
    assert clean == {x for x, _ in docs} - {x for x, _ in got}
    assert d.contaminated(df.limit(0), b).count() == 0 and d.contaminated(df, b.limit(0)).count() == 0


def test_shards_give_the_same_scores(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, prose(rng, 25 if i % 5 else 90)) for i in range(30)]
    df = spark.createDataFrame([(i, prose(rng, 50) + " " + items[i][1]) for i in range(30)], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((r.doc_id, r.item_id, round(r.score, 6), r.question_overlap, r.answer_overlap) for r in d.contaminated(df, b).collect())
    whole = rows()
    monkeypatch.setattr(d, "SHARD_BYTES", 900)
    assert rows() == whole and {r[:2] for r in whole} >= {(i, i) for i in range(30)}


def test_an_index_is_small(monkeypatch):
    import pickle

    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(20000)}" for _ in range(rng.choice([20, 60, 200])))) for i in range(1500)]
    assert len(pickle.dumps(d.build(d.pieces_of(items)))) < 25 * sum(len(t) for _, t in items)


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(6)
    pieces = d.pieces_of([(i, prose(rng, rng.randrange(3, 40))) for i in range(150)])
    index = d.build(pieces)
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.vocabulary)), rng.randrange(1, 60)))
        if rng.random() < 0.5:
            p = rng.choice(pieces)
            terms = sorted(set(terms) | set(np.searchsorted(index.vocabulary, p.tokens).tolist()))
        want = [i for i in range(len(pieces)) if sum(x for t in terms for x in d.impact_of(index, t, i)) >= 1 - 1e-9]
        assert sorted(d.wand(index, terms)) == want


def test_long_items_as_a_whole(spark):
    rng = random.Random(8)
    fresh = lambda n, tag: [f"{tag}{i}x{rng.randrange(1000)}" for i in range(n)]
    items = [(n, fresh(n, f"i{n}w")) for n in (64, 65, 66, 68, 128, 129, 130, 400)]
    docs, want = [], set()
    for n, words in items:
        half = n // 2
        for part in (words[-1:], words[-4:], words[:half], words[half:]):  # not the item
            docs.append(fresh(100, "c") + part + fresh(100, "d"))
        for at in (0, 1, 30, 63, 64, 100, 127):  # the item, wherever passages begin
            altered = list(words)
            altered[rng.randrange(n)] = "zzz"
            for held in (words, altered):
                want.add((len(docs), n))
                docs.append(fresh(at, "c") + held + fresh(150, "d"))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(2)
    b = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.contaminated(df, b).collect()} == want


def test_clean_rows_without_id_or_with_a_shared_one_stay(spark):
    rng = random.Random(9)
    item, clean = prose(rng, 30), [prose(rng, 60) for _ in range(4)]
    rows = [(None, clean[0] + " " + item), (None, clean[1]), (None, None), (7, item), (7, clean[2]), (8, clean[3])]
    got = d.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[i] for i in (1, 2, 4, 5)]))
