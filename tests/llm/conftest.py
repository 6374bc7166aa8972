import random

import pytest

#: Null, empty, blank, repeated and very long texts, ties, null ids and sources, and columns that clash with names used inside.
WORDS = "the of and to in is that for with on as at by from this be are was were or an it not have had all one two new more some time".split()


def prose(rng, n):
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed", "er"]) + (rng.choice("abcdefgh") if rng.random() < 0.3 else "")
        out.append(w)
        if i % 11 == 10:
            out[-1] += "."
    return " ".join(out)


def edge_rows():
    rng = random.Random(5)
    long = "\n".join(prose(rng, 40) for _ in range(120))
    same = prose(rng, 80)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n\x0b ", None, "a", 5), (4, same, "en", "b", len(same)), (4, same, "en", "b", len(same)),
        (5, same, "fr", "b", None), (6, same + " tail", "en", "c", 1), (None, same, "en", "c", 1), (None, None, None, None, None), (7, long, "en", "a", len(long)),
        (8, "x", "en", "a", 1), (9, "one two", "de", "é", 7), (10, "a" * 5000, "en", "z", 5000), (11, "?? 123 -- \U0001f600 ÄÖ", "de", "z", 9),
    ]
    rows += [(20 + i, prose(rng, 30) + "\nshared line of all\n" + prose(rng, 20), "en", "a" if i % 2 else "b", 1) for i in range(14)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(*r, i, f"k{i}", 1.5, True, "w") for i, r in enumerate(edge_rows())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, fp string, score double, taken boolean, words string").repartition(3)


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)
