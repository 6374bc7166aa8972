import itertools
import os
import random
import zlib

import numpy as np
import pytest

from loam.llm import langid

from .conftest import edge_rows

DATA = "/root/testdata/sf0.001/documents.parquet"


def test_viterbi_is_the_best_path_and_the_shortcut_agrees():
    rng = np.random.default_rng(1)
    for n, k in itertools.product((1, 2, 5, 7), (1, 2, 3)):
        for _ in range(15):
            score = rng.normal(size=(n, k)) * 3
            best = max(itertools.product(range(k), repeat=n), key=lambda p: sum(score[i, x] for i, x in enumerate(p)) - 4 * sum(a != b for a, b in zip(p, p[1:])))
            value = lambda p: sum(score[i, x] for i, x in enumerate(p)) - 4 * sum(a != b for a, b in zip(p, p[1:]))
            assert abs(value(langid.viterbi(score, 4)) - value(best)) < 1e-9
    score = rng.normal(size=(3000, 4)) * 2
    score[1000:1500, 2] += 4
    upto = np.cumsum(rng.multinomial(3000, [1 / 60] * 60))
    got, at = langid.label(score, upto, 6), 0
    for to in upto.tolist():
        if to > at:
            p, q = got[at:to], langid.viterbi(score[at:to], 6)
            value = lambda p: score[np.arange(at, to), p].sum() - 6 * (p[1:] != p[:-1]).sum()
            assert abs(value(p) - value(q)) < 1e-6
        at = to


def test_two_languages_where_a_third_is_best_over_all():
    score = np.array([[0, -5, -20]] * 2 + [[-20, -5, 0]] * 2, float)
    assert langid.label(score, np.array([4]), 12).tolist() == langid.viterbi(score, 12).tolist() == [0, 0, 2, 2]


def test_edges(edge, none):
    got = langid.identify(edge, spans=True).collect()
    assert len(got) == len(edge_rows())
    texts = {r[0]: r[1] for r in edge_rows() if r[0] is not None}
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "und"}
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            if not any(c.isalpha() for c in texts[r.doc_id] or ""):
                assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.predict(edge, langid.fit(none)).collect()} == {"und"}


def test_scripts_and_mixed_texts(spark):
    rng = random.Random(2)
    en, fr, ru = "the of and that with from this have which were".split(), "le la des une que dans pour avec est sont".split(), "это что как для они было когда если или может".split()
    rows = [(i, " ".join(rng.choice(w) for _ in range(60)), lang) for i, (lang, w) in enumerate([("en", en), ("fr", fr), ("ru", ru)] * 40)]
    mixed = " ".join([*en * 4, *ru * 3, *fr * 2])
    df = spark.createDataFrame([*rows, (1000, mixed, None), (1001, "ελληνικά", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df, spans=True).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [s.lang for s in got[1000].spans] == ["en", "ru", "fr"] and got[1000].lang_pred == "en"
    assert [s.start for s in got[1000].spans] == [0, 40, 70]
    assert got[1001].score == 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0
