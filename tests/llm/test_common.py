import random
import re

import numpy as np
import pyarrow as pa

from loam.llm import common as c

from .conftest import edge_rows

PATTERNS = {"space": rb"[^\x20\x09-\x0d]+", "alnum": rb"[a-z0-9\x80-\xff]+", "letter": rb"[a-z\x80-\xff]+"}


def texts():
    rng = random.Random(1)
    out = [r[1] for r in edge_rows()]
    return out + ["".join(rng.choice("ab9 -\n\tÄß\U0001f600Z") for _ in range(rng.randrange(0, 90))) for _ in range(200)] + ["y" * 3000 + " z"]


def test_words_and_their_hashes(monkeypatch):
    for kind, pattern in PATTERNS.items():
        for chunk, part in ((1 << 18, 1 << 20), (64, 100)):
            monkeypatch.setattr(c, "CHUNK_BYTES", chunk)
            monkeypatch.setattr(c, "PART_BYTES", part)
            w, seen, rows = c.Words(kind), {}, texts()
            arr = pa.array(["cut away", *rows]).slice(1)
            for lo, hi, data, ends in c.chunks(arr):
                h, starts, stops, upto = w.split(data, ends)
                at = 0
                for row in range(lo, hi):
                    to = int(upto[row - lo])
                    got = [data[a:b].tobytes() for a, b in zip(starts[at:to], stops[at:to])]
                    raw = (rows[row] or "").encode()
                    want = re.findall(pattern, raw if kind == "space" else raw.lower().replace("\U0001f600".encode(), b" " * 4) if kind == "letter" else raw.lower())
                    assert [x if kind == "space" else x.lower() for x in got] == want
                    for x, y in zip(want, h[at:to].tolist()):
                        assert seen.setdefault(x, y) == y  # one hash a word, wherever it stands
                    at = to
            assert len(set(seen.values())) == len(seen)


def test_rolling_hashes_depend_on_the_values_only():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 5, 400).astype(np.uint64)
    h, seen = c.rolling(c.mix(v), 4, c.Powers(0x9FB21C651E98DF25)), {}
    for i, x in enumerate(h.tolist()):
        assert seen.setdefault(tuple(v[i : i + 4].tolist()), x) == x
    assert len(set(seen.values())) == len(seen)
    assert len(c.rolling(v[:3], 4, c.Powers(3))) == 0


def test_null_slots_may_hold_bytes():
    arr = pa.StringArray.from_buffers(3, pa.py_buffer(np.array([0, 2, 5, 6], np.int32).tobytes()), pa.py_buffer(b"abxyzc"), pa.py_buffer(bytes([0b101])), 1)
    (lo, hi, data, ends), = c.chunks(arr)
    assert (lo, hi, data.tobytes(), ends.tolist()) == (0, 3, b"abc", [2, 2, 3])


def test_signs_are_no_letters():
    text = "naïve—“Größe” 3 × 4 ☃ \U0001f600 ÄÖ ªº a‑b 中文 テスト。x…y µm"
    raw = np.frombuffer(text.encode(), np.uint8)
    _, starts, stops, _ = c.Words("letter").split(raw, np.array([len(raw)]))
    assert [text.encode()[a:b].decode() for a, b in zip(starts, stops, strict=True)] == ["naïve", "Größe", "ÄÖ", "ªº", "a", "b", "中文", "テスト", "x", "y", "µm"]
