import os

import numpy as np
import pytest

from loam.llm import tokens

from .conftest import edge_rows

HF = os.path.join(os.path.dirname(tokens.VOCABULARY), "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary files here")


def brute(text, separator="\n"):
    """With another library's own offsets."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(HF)
    t.encode_special_tokens = True
    text = text or ""
    sections, rest = [], text
    while separator in rest:
        head, rest = rest.split(separator, 1)
        sections.append(len(head) + len(separator))
    if rest or not sections:
        sections.append(len(rest))
    ends = np.cumsum(sections)
    e = t.encode(text, add_special_tokens=False)
    counts, crossing = [0] * len(ends), 0
    for a, b in e.offsets:
        own = [max(0, min(b, int(z)) - max(a, int(z) - int(s))) for z, s in zip(ends, sections)]
        counts[own.index(max(own))] += 1
        crossing += sum(o > 0 for o in own) > 1
    return len(e.ids), len(ends), crossing, counts


def test_against_the_other_library(spark, edge, none):
    texts = [r[1] for r in edge_rows()] + ["a\n\nb \n c\n", "\n\n\n", "don't\n\n  stop", "naïve\ncafé\nüber", "<|endoftext|>\nx"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_sections, r.n_crossing, r.section_tokens) for r in tokens.token_counts(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t
    for sep in (" ", "\n\n"):
        got = {r.doc_id: (r.n_tokens, r.n_sections, r.section_tokens) for r in tokens.token_counts(df, separator=sep).collect()}
        for i, t in enumerate(texts):
            n, s, _, counts = brute(t, sep)
            assert got[i] == (n, s, counts), (sep, t)
    assert tokens.token_counts(edge).count() == len(edge_rows())
    assert tokens.token_counts(none).count() == 0


def test_a_crossing_token_goes_to_most_of_its_characters_and_ties_to_the_earlier():
    per, crossing = tokens.allocate(np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([3, 7, 9]))
    assert per.tolist() == [1, 2, 0] and crossing == 2  # 2-5: one in the first, two in the second; 5-9: two and two
    per, _ = tokens.allocate(np.array([0, 1, 1]), np.array([1, 1, 2]), np.array([1, 2]))
    assert per.tolist() == [2, 1]  # the rest of a character goes with its beginning
