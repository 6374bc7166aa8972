import random
import re

from loam.llm import pii

from .conftest import edge_rows

PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for n, (kind, p) in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_of_random_and_awkward_texts(spark, edge, none):
    rng = random.Random(8)
    pieces = ["a@b.c", "x.y@", "@", ".", "..", "+1 (555) 010-9999", "+", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "1.2.3.4", "256.1.1.1", "000255.1.2.3", "10.0.0.1.5", "é", "\U0001f600", " ", "-", "_", "%", "12", "7", "a-b", "(", ")", "\n", "ß"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    texts += ["a@b.c_d@e.f", "a@b" + ".c" * 5000, "x" * 20000, "1" * 20000, "1." * 5000, "a." * 4000 + "@b.c", "+" + "1 " * 3000, "0" * 16, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base == want, t[:80]
        assert [got[i][f"n_{k}"] for k, _ in PATTERNS] == [want.count(f"{k}:") for k, _ in PATTERNS]
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    assert pii.personal_data(edge).count() == len(edge_rows())
    assert pii.personal_data(none).count() == 0


def loose_votes(kind, text, begin, end, left_from, right_to):
    """The five labelers in Python; the context is the text between the match before and the one after."""
    m, left, right = text[begin:end], text[left_from:begin][-40:], text[end:right_to][:1]
    digits = re.sub("[^0-9]", "", m)
    plain = m.replace(" ", "")
    words = m.replace(".", "").split(" ")
    shape = {
        "email": re.search(r"^[a-z0-9][A-Za-z0-9._%+ \[\]()-]*[a-z]$", m), "ip": not re.search(r"(^|[.])0[0-9]", m) and not m.startswith("0."),
        "phone": m[0] in "+(0" or re.search(r"^[0-9]{3}([.-])[0-9]{3}[.-][0-9]{4}$", m), "id": True, "person": len(words) <= 3, "account": 15 <= len(plain) <= 34,
        "secret": re.search("[0-9]", m) and re.search("[0-9A-Za-z+/_-]{12}", m),
    }[kind]
    fit = {
        "email": 6 <= len(m) <= 254, "ip": True, "phone": 9 <= len(digits) <= 15, "id": not m.startswith(("000", "9", "666")), "person": 5 <= len(m) <= 60,
        "account": kind == "account" and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1, "secret": 16 <= len(m) <= 128,
    }[kind]
    known = {"email": re.search("[a-z]*$", m.lower())[0] in pii.DOMAINS, "account": m[:2] in pii.COUNTRIES, "person": True}.get(kind, None)
    context = "+" if re.search(pii.CONTEXT[kind], left) else "-" if re.search(pii.AGAINST, left) else "0"
    glued = re.search("[0-9A-Za-z_]$", left) or re.match("[0-9A-Za-z_]", right)
    return ("+" if shape else "-") + ("+" if fit else "-") + ("0" if known is None else "+" if known else "-") + context + ("-" if glued else "+")


def brute_added(texts):
    """The spans that the classifier may add, and their votes, by text."""
    out = []
    for t in texts:
        mine = []
        for kind, p in pii.LOOSE.items():
            found = [m.span() for m in re.finditer(p, t or "", re.ASCII)]
            for i, (a, b) in enumerate(found):
                if kind == "phone" and not 9 <= len(re.sub("[^0-9]", "", t[a:b])) <= 15:
                    continue
                mine.append((a, pii.KINDS.index(kind), b, loose_votes(kind, t, a, b, found[i - 1][1] if i else 0, found[i + 1][0] if i + 1 < len(found) else len(t))))
        out.append(mine)
    return out


LABELLED = [  # a text, with what is personal in [[ ]]
    "Please call me at [[415-555-{n}]] today", "reach us by phone: [[020 7946 {n}]] or later", "My name is [[Anna Smith]], nice to meet you", "Dear [[Dr. Karl Weber]], thank you",
    "write to [[jane.doe{n} [at] example [dot] com]] now", "her IBAN [[DE89 3704 0044 0532 0130 00]] is known", "pay to account [[DE89370400440532013000]] please", "server [[2001:db8:85a3::8a2e:370:{n}]] answered",
    'the api_key = "x" was left, but not [[secret = "9f{n}8a7b6c5d4e3f2a1b0c9d"]] there', "SSN: [[123-45-{n}]] on file", "we met with [[Maria Lopez]] and left", "ring [[(415) 555-{n}]] soon",
    "see section 415-555-{n} of the manual", "order number 020 7946 {n} was shipped", "ISBN 978-{n}-55-1 of the book", "invoice no 123-45-{n} is due", "New York City is big", "at 10:20:{n} it rained",
    "part XX12 ABCD WXYZ 5678 9999 is out", "serial 415-555-{n} of the pump", "The Old Man sat down", "version 4.{n} is out", "token of thanks", "figure 212-555-{n} shows",
]


def labelled_texts():
    rows, want = [], set()
    for n in range(1000, 1040):
        for t in LABELLED:
            text = t.replace("{n}", str(n))
            if "[[" in text:
                a = text.index("[[")
                b = text.replace("[[", "", 1).index("]]")
                want.add((len(rows), a, b))
                text = text.replace("[[", "", 1).replace("]]", "", 1)
            rows.append(text)
    return rows, want


def test_added_spans_against_brute_force_and_labels(spark):
    texts, want = labelled_texts()
    texts += ["John Smith", "Mr. Brown-Mr Green", "\U0001f600 John Smith", "x" * 3000 + " 415-555-1000", None, ""]
    rows = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    found = brute_added(texts)
    counts = {}
    for mine in found:
        for _, k, _, v in mine:
            counts[k + len(pii.KINDS), v] = counts.get((k + len(pii.KINDS), v), 0) + 1
    assert not any(r.base for r in rows.values())  # so that all that is learned from is counted above
    good = {key for key, p in pii.span_classifier(counts).items() if p >= 0.5}
    for i, mine in enumerate(found):
        more = {(a, k, b) for a, k, b, v in mine if (k + len(pii.KINDS), v) in good}
        assert rows[i].spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(more)), texts[i]
        assert rows[i].n_spans == len(more)
    got = {(i, int(x.split(":")[1]), int(x.split(":")[2])) for i, r in rows.items() if i < len(texts) - 6 for x in r.spans.split(",") if x}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.9 * len(got), (len(got), len(want), len(got & want))


def test_many_matches_in_one_text(spark):
    import time

    n = 120_000
    begin = time.time()
    df = spark.createDataFrame([(1, "12, " * n), (2, "a@b.co " * n), (3, "1.2.3.4 x[at]y.com " * (n // 4))], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert (got[1].n_spans, got[2].n_email, got[3].n_ip) == (0, n, n // 4)
    assert got[2].base.endswith(f"email:{7 * (n - 1)}:{7 * n - 1}") and got[3].base.endswith(f"ip:{19 * (n // 4 - 1)}:{19 * (n // 4 - 1) + 7}")
    assert time.time() - begin < 120


def test_reliabilities_tell_good_labelers_from_bad():
    counts = {(3, "++0++"): 80, (3, "+-0--"): 60, (3, "00000"): 10, (3, "0+0-+"): 5}
    p = pii.span_classifier(counts)
    assert p[(3, "++0++")] > 0.8 > 0.5 > p[(3, "+-0--")]
    assert pii.span_classifier({}) == {}
