"""Personal data by weak supervision (operator 7).

DataFrame operations only on the rows. Candidate spans come from strict patterns
(email, ip, card, phone, all of whose valid matches count), from looser ones (written-out
addresses, IPv6, national phone numbers, identity and account numbers, secrets) and from
a gazetteer of first names. Labelers vote on each (-1, 0 or 1): shape, validity,
gazetteer, context, boundary. Votes are counted by kind and pattern over the whole
table, at most 16 * 3**5 rows; from these counts expectation-maximisation estimates each
labeler's reliability (strict and loose spans being kinds of their own), and a logistic
regression on the votes and kinds learns the
posteriors. It decides on the looser candidates; strict matches stay whatever it says.

The offsets of matches are running sums over blocks of BLOCK lengths, over blocks of
such sums, and so on, so that a text of many matches costs time in proportion to them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: In the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "id", "person", "account", "secret")
LABELERS = ("shape", "validity", "gazetteer", "context", "boundary")
#: Lengths summed at once for the offsets.
BLOCK = 64
#: Titles, of which one counts as a first name's hit.
TITLES = "Mr Mrs Ms Dr Prof".split()
DOMAINS = "com org net edu gov mil int info biz io app dev co uk ie de fr es pt it eu ch at nl be lu se no dk fi is pl cz hu ro bg gr tr ru ua us ca mx br ar cl au nz jp cn hk tw kr in sg za il".split()
COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK TR".split()
NAMES = (
    "Adam Alan Albert Alex Alice Amy Ana Andrea Andrew Angela Ann Anna Anne Anthony Antonio Barbara Ben Benjamin Bernard Betty Brian Bruno Camille Carl Carla Carlos Carol Caroline Catherine "
    "Charles Charlotte Chloe Chris Christian Christine Claire Clara Claude Daniel David Deborah Denis Diana Diego Donald Dorothy Edward Elena Elisabeth Elizabeth Emily Emma Eric Erik Eva Felix "
    "Fernando Francis Frank Franz Gary George Grace Hannah Hans Harry Heinz Helen Helena Henri Henry Ian Ines Ingrid Isabel Jack Jacob Jacques James Jane Janet Jason Jean Jennifer Jessica Joan "
    "Johanna John Jonas Jorge Jose Joseph Juan Judith Julia Julie Julien Karen Karl Katherine Kevin Klaus Larry Laura Lena Leo Lina Linda Lisa Louis Louise Lucas Lucy Luis Manuel Marc Marco Margaret "
    "Maria Marie Marion Mark Markus Martha Martin Mary Matthew Max Michael Michel Miguel Monica Nancy Nicolas Nina Noah Olivia Oscar Pablo Patricia Patrick Paul Paula Peter Petra Philip Pierre Rachel "
    "Ralph Raymond Rebecca Richard Robert Roger Ronald Rosa Ruth Samuel Sandra Sara Sarah Simon Sofia Sophie Stefan Stephen Steven Susan Sylvia Thomas Ursula Victor Walter Werner William Yves"
).split()


def _one_of(words: list[str]) -> str:
    """A pattern of the words, by first letter."""
    return "|".join(f"{a}(?:{'|'.join(w[1:] for w in words if w[0] == a)})" for a in sorted({w[0] for w in words}))


_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Java patterns. Possessive loops neither backtrack nor recurse on long runs; the guards
#: start where a run begins or the last match ended, as leftmost matching would.
STRICT = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HEX = "[0-9A-Fa-f]{1,4}"
LOOSE = {
    "email": r"(?i)\b[a-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[a-z0-9-]{1,63}\x20?(?:\[dot\]|\(dot\)|\.)\x20?[a-z]{2,24}\b",
    "ip": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+.-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}|\(?0[0-9]{1,4}\)?[\x20-][0-9]{3,4}[\x20-]?[0-9]{3,4})(?![0-9])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": rf"\b(?:(?:{'|'.join(TITLES)})\.?\x20[A-Z][a-z]{{1,30}}(?:\x20[A-Z][a-z]{{1,30}}){{0,2}}|(?:{_one_of(NAMES)})(?:\x20[A-Z][a-z]{{1,30}}){{1,2}})\b",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "secret": r"(?i)\b(?:token|secret|api[_-]?key|password|passwd)\x20{0,2}[=:]\x20{0,2}[\"']?[0-9a-z_+/=-]{8,128}[\"']?",
}
#: What a text must hold (cheap to test) for a pattern to be tried.
_NEEDS = {"email": "contains(t, '@')", "ip": "rlike(t, '[0-9][.][0-9]')", "card": "rlike(t, '[0-9]')", "phone": "contains(t, '+')"}
_NEEDS_LOOSE = {
    "email": "rlike(t, '(?i)[(\\\\[](at|dot)[)\\\\]]')", "ip": "rlike(t, '[0-9A-Fa-f]:[0-9A-Fa-f:]')", "phone": "rlike(t, '[0-9]{3}[\\\\x20.-]?[0-9]{3,4}')",
    "id": "rlike(t, '-[0-9]{2}-[0-9]{4}')", "person": "rlike(t, '[a-z][.]?\\\\x20[A-Z][a-z]')", "account": "rlike(t, '[A-Z]{2}[0-9]{2}')",
    "secret": "rlike(t, '(?i)(token|secret|key|passw)')",
}
_FILLER = r"(?:\W{1,4}(?:me|us|at|is|on|my|to|our|the|her|his|number|no))*\W{0,4}$"
CONTEXT = {
    "email": rf"(?i)\b(?:e-?mail|mail|contact|write|reach|address){_FILLER}",
    "ip": rf"(?i)\b(?:ip|ipv6|address|host|server|from|client|peer){_FILLER}",
    "card": rf"(?i)\b(?:card|visa|mastercard|amex|credit|debit){_FILLER}",
    "phone": rf"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|contact|ring|whatsapp|dial){_FILLER}",
    "id": rf"(?i)\b(?:ssn|social security|id|identity|insurance){_FILLER}",
    "person": r"(?i)\b(?:by|with|from|to|and|dear|signed|mr|mrs|ms|dr|prof|met|told|name is|called)\W{0,4}$",
    "account": rf"(?i)\b(?:iban|account|acct|bank|transfer|pay){_FILLER}",
    "secret": r"(?i)\b(?:access|auth|bearer|secret|api|login|user|private)\W{0,4}$",
}
AGAINST = r"(?i)\b(version|isbn|issn|order|invoice|sku|hash|sha\d*|section|figure|rev|build|part|serial|ticket|item|chapter|page|model|lot)\W{0,6}(?:number|no|nr|id)?\W{0,4}$"
def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(x: str, values: list[str]) -> str:
    return f"{x} in ({', '.join(map(repr, values))})"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    digit = f"cast(substr({d}, length({d}) + 1 - i, 1) as int)"
    return f"aggregate(sequence(1, greatest(1, length({d}))), 0, (s, i) -> s + if(i % 2 = 1, {digit}, if({digit} > 4, {digit} * 2 - 9, {digit} * 2))) % 10 = 0"


def _mod97(x: str) -> str:
    """The check of account numbers: first four characters last, letters as two digits, modulo 97."""
    plain = f"replace({x}, ' ', '')"
    code = "ascii(c)"
    return f"aggregate(split(concat(substr({plain}, 5), left({plain}, 4)), ''), 0, (s, c) -> if(c = '', s, if({code} < 58, (s * 10 + {code} - 48) % 97, (s * 100 + {code} - 55) % 97))) = 1"


def _valid(kind: str, m: str) -> str:
    """Whether a match of the strict pattern counts."""
    if kind == "ip":
        part = "if(length(ltrim('0', p)) > 3, 999, coalesce(try_cast(ltrim('0', p) as int), 0))"
        return f"forall(split({m}, '[.]'), p -> {part} <= 255)"
    if kind == "card":
        return f"(length({_digits(m)}) between 12 and 19 and {_luhn(_digits(m))})"
    if kind == "phone":
        return f"length({_digits(m)}) between 9 and 15"
    return "true"


_WORDS = "split(replace(x.m, '.', ''), ' ')"
#: Kinds of which the gazetteer holds nearly all; of the others it says nothing about what it lacks.
_COMPLETE = ("email", "card", "account")
#: By kind, whether the match has the usual shape, passes its check, and is known to the gazetteer.
_SHAPE = {
    "email": "rlike(x.m, '^[a-z0-9][A-Za-z0-9._%+ \\\\[\\\\]()-]*[a-z]$')", "ip": "not rlike(x.m, '(^|[.])0[0-9]') and not startswith(x.m, '0.')",
    "card": f"length({_digits('x.m')}) in (15, 16) and rlike(x.m, '^([0-9]+|([0-9]{{4}}[ -]){{3}}[0-9]{{4}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})$')",
    "phone": "rlike(x.m, '^[+(0]') or rlike(x.m, '^[0-9]{3}([.-])[0-9]{3}[.-][0-9]{4}$')", "id": "true", "person": f"size({_WORDS}) <= 3",
    "account": "length(replace(x.m, ' ', '')) between 15 and 34", "secret": "rlike(x.m, '[0-9]') and rlike(x.m, '[0-9A-Za-z+/_-]{12}')",
}
_FIT = {
    "email": "length(x.m) between 6 and 254", "ip": "true", "card": "true", "phone": f"length({_digits('x.m')}) between 9 and 15",
    "id": "not startswith(x.m, '000') and not startswith(x.m, '9') and not startswith(x.m, '666')", "person": "length(x.m) between 5 and 60", "account": _mod97("x.m"), "secret": "length(x.m) between 16 and 128",
}
_KNOWN = {
    "email": _in("regexp_extract(lower(x.m), '([a-z]+)$', 1)", DOMAINS), "card": f"rlike({_digits('x.m')}, '^(4|5[1-5]|2[2-7]|3[47]|6011|65)')",
    "phone": "rlike(x.m, '^[+](1|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])')", "person": "true", "account": _in("left(x.m, 2)", COUNTRIES),
}


def _spans(kind: str, pattern: str, needs: str, strict: bool) -> str:
    """SQL: array of (start, kind number, end, strict, votes) of the pattern's matches in column t.

    The text falls into n matches and the n + 1 gaps around them; their lengths in code
    points give the offsets. Sums by blocks keep the work in proportion to n."""
    q, k = _q(pattern), KINDS.index(kind)
    keep = _valid(kind, "y.m") if strict or kind == "phone" else "true"
    votes = ", ".join(
        f"if({yes}, '+', if({no}, '-', '0'))"
        for yes, no in (
            (_SHAPE[kind], f"not ({_SHAPE[kind]})"),
            (_FIT[kind], f"not ({_FIT[kind]})"),
            (_KNOWN.get(kind, "false"), f"not ({_KNOWN[kind]})" if kind in _COMPLETE else "false"),
            (f"x.l rlike {_q(CONTEXT[kind])}", f"x.l rlike {_q(AGAINST)}"),
            ("not (x.l rlike '[0-9A-Za-z_]$' or x.r rlike '^[0-9A-Za-z_]')", "x.l rlike '[0-9A-Za-z_]$' or x.r rlike '^[0-9A-Za-z_]'"),
        )
    )
    part = lambda a, at, n: f"aggregate(slice({a}, cast({at} as int) + 1, cast({n} as int)), 0L, (s, v) -> s + v)"
    totals = lambda a: f"transform(sequence(0, greatest(0, cast(ceil(size({a}) / {BLOCK}) as int) - 1)), j -> {part(a, f'j * {BLOCK}', BLOCK)})"
    let = lambda value, body: f"element_at(transform(array({value}), b -> {body}), 1)"  # noqa: E731  a value computed once
    lengths = "zip_with(slice(b.g, 1, size(b.m)), b.m, (g, m) -> cast(length(g) + length(m) as bigint))"
    # 1 = each gap with its match, 2 = sums of blocks of 1, 3 = of 2, 4 = of 3
    before = " + ".join(
        [
            part("b.c4", 0, f"y.i div {BLOCK**3}"),
            part("b.c3", f"(y.i div {BLOCK**3}) * {BLOCK}", f"(y.i div {BLOCK**2}) % {BLOCK}"),
            part("b.c2", f"(y.i div {BLOCK**2}) * {BLOCK}", f"(y.i div {BLOCK}) % {BLOCK}"),
            part("b.c1", f"(y.i div {BLOCK}) * {BLOCK}", f"y.i % {BLOCK}"),
        ]
    )
    start = f"{before} + length(element_at(b.g, y.i + 1))"
    valid = f"filter(transform(b.m, (m, i) -> named_struct('i', i, 'm', m)), y -> {keep})"
    found = f"transform({valid}, y -> named_struct('s', {start}, 'm', y.m, 'l', right(element_at(b.g, y.i + 1), 40), 'r', left(element_at(b.g, y.i + 2), 1)))"
    made = f"transform({found}, x -> named_struct('s', x.s, 'k', {k}, 'e', x.s + length(x.m), 'strict', {str(strict).lower()}, 'v', concat({votes})))"
    grown = "named_struct('m', b.m, 'g', b.g"
    four = let(f"{grown}, 'c1', b.c1, 'c2', b.c2, 'c3', b.c3, 'c4', {totals('b.c3')})", made)
    three = let(f"{grown}, 'c1', b.c1, 'c2', b.c2, 'c3', {totals('b.c2')})", four)
    two = let(f"{grown}, 'c1', b.c1, 'c2', {totals('b.c1')})", three)
    one = let(f"{grown}, 'c1', {lengths})", two)
    return f"if({needs}, {let(f'named_struct({chr(39)}m{chr(39)}, regexp_extract_all(t, {q}, 0), {chr(39)}g{chr(39)}, split(t, {q}, -1))', one)}, cast(array() as {SPAN}))"


SPAN = "array<struct<s: bigint, k: int, e: bigint, strict: boolean, v: string>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans (strict and loose, in no order) of each row; null texts count as empty."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    parts = [_spans(k, p, _NEEDS[k], True) for k, p in STRICT.items()] + [_spans(k, p, _NEEDS_LOOSE[k], False) for k, p in LOOSE.items()]
    return base.select("doc_id", F.expr(f"concat({', '.join(parts)})").alias("spans"))


#: How probable each vote is on a true and on a false span where the labeler votes ("0": it does not),
#: to begin with; and for how many spans that counts.
_BEGIN = {
    "shape": {"+": (0.9, 0.4), "-": (0.1, 0.6)},
    "validity": {"+": (0.95, 0.4), "-": (0.05, 0.6)},
    "gazetteer": {"+": (0.9, 0.3), "-": (0.1, 0.7)},
    "context": {"+": (0.98, 0.2), "-": (0.02, 0.8)},
    "boundary": {"+": (0.95, 0.4), "-": (0.05, 0.6)},
}
_BEGIN_COUNT = 100


def reliabilities(counts: dict[tuple[int, str], int], rounds: int = 50) -> tuple[dict[int, float], list[dict[str, tuple[float, float]]]]:
    """Expectation-maximisation: the share of true spans by kind, and for each labeler how
    probable each of its votes is on a true and on a false span. Labelers start better than chance."""
    prior = {k: 0.5 for k, _ in counts}
    votes = [dict(_BEGIN[name]) for name in LABELERS]
    for _ in range(rounds):
        post = {key: _posterior(prior[key[0]], votes, key[1]) for key in counts}
        for k in prior:
            t = sum(n * post[key] for key, n in counts.items() if key[0] == k)
            prior[k] = (t + _BEGIN_COUNT / 2) / (sum(n for key, n in counts.items() if key[0] == k) + _BEGIN_COUNT)
        for i, table in enumerate(votes):
            mass = {v: [_BEGIN_COUNT * x for x in _BEGIN[LABELERS[i]][v]] for v in "+-"}
            for key, n in counts.items():
                if key[1][i] != "0":
                    mass[key[1][i]][0] += n * post[key]
                    mass[key[1][i]][1] += n * (1 - post[key])
            for v in "+-":
                table[v] = tuple(mass[v][y] / (mass["+"][y] + mass["-"][y]) for y in (0, 1))
    return prior, votes


def _posterior(prior: float, votes: list[dict[str, tuple[float, float]]], pattern: str) -> float:
    a, b = math.log(prior), math.log(1 - prior)
    for table, v in zip(votes, pattern, strict=True):
        if v != "0":
            a, b = a + math.log(table[v][0]), b + math.log(table[v][1])
    return 1 / (1 + math.exp(min(700.0, max(-700.0, b - a))))


def span_classifier(counts: dict[tuple[int, str], int], rounds: int = 300) -> dict[tuple[int, str], float]:
    """Logistic regression of the posteriors on votes and kind; its probability for each kind and pattern."""
    if not counts:
        return {}
    prior, votes = reliabilities(counts)
    target = {key: _posterior(prior[key[0]], votes, key[1]) for key in counts}
    names = {key: ["", f"kind{key[0]}", *(f"{i}{v}" for i, v in enumerate(key[1]) if v != "0")] for key in counts}
    weight = {f: 0.0 for fs in names.values() for f in fs}
    total = float(sum(math.sqrt(n) for n in counts.values()))
    share = {key: math.sqrt(n) / total for key, n in counts.items()}  # a frequent pattern does not drown the others
    for _ in range(rounds):
        step = {f: -1e-4 * w for f, w in weight.items()}
        for key, fs in names.items():
            p = 1 / (1 + math.exp(-sum(weight[f] for f in fs)))
            for f in fs:
                step[f] += share[key] * (target[key] - p)
        for f, s in step.items():
            weight[f] += 2.0 * s
    return {key: 1 / (1 + math.exp(-sum(weight[f] for f in fs))) for key, fs in names.items()}


def _listed(spans: str) -> Column:
    kind = f"element_at(array({', '.join(map(repr, KINDS))}), x.k + 1)"
    return F.expr(f"array_join(transform(array_sort({spans}), x -> concat_ws(':', {kind}, cast(x.s as string), cast(x.e as string))), ',')")


def _apart(spans: str, base: str) -> str:
    """SQL: those of the spans that overlap none of base. Blocks of base tell at once what lies outside them."""
    block = f"slice(b, cast(j * {BLOCK} as int) + 1, {BLOCK})"
    blocks = f"transform(sequence(0, greatest(0, cast(ceil(size(b) / {BLOCK}) as int) - 1)), j -> named_struct('lo', array_min({block}.s), 'hi', array_max({block}.e), 'xs', {block}))"
    found = f"filter({spans}, x -> not exists(o, k -> k.lo < x.e and x.s < k.hi and exists(k.xs, y -> y.s < x.e and x.s < y.e)))"
    return f"if(size({spans}) = 0, {spans}, element_at(transform(transform(array(array_sort({base})), b -> {blocks}), o -> {found}), 1))"


def personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone and base (the strict
    spans, as kind:start:end in code points, joined by commas, by start and then kind), spans
    (with those that the classifier adds where they overlap no strict span) and n_spans.

    docs needs doc_id and text; other columns are left out, whatever their names. Null and
    empty texts have no spans; rows that repeat stay (and count as often in the estimates);
    very long texts are taken whole; an empty table gives an empty one."""
    found = Scratch(docs.sparkSession, "pii").keep(candidates(docs))
    kind = F.expr(f"x.k + if(x.strict, 0, {len(KINDS)})").alias("k")  # what a loose pattern finds is a kind of its own to learn
    rows = found.select(F.explode("spans").alias("x")).groupBy(kind, "x.v").agg(F.count(F.lit(1)).alias("n")).collect()
    sure = sorted((k - len(KINDS), v) for (k, v), p in span_classifier({(r.k, r.v): r.n for r in rows}).items() if p >= least and k >= len(KINDS))
    wanted = " or ".join(f"(x.k = {k} and x.v in ({', '.join(repr(v) for k2, v in sure if k2 == k)}))" for k in sorted({k for k, _ in sure})) or "false"
    split = found.select("doc_id", F.expr("filter(spans, x -> x.strict)").alias("base"), F.expr(f"array_distinct(filter(spans, x -> not x.strict and ({wanted})))").alias("more"))
    split = split.withColumn("more", F.expr(_apart("more", "base")))
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.k = {k})) as bigint)")
    every = "concat(base, more)"
    return split.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], _listed("base").alias("base"), _listed(every).alias("spans"), F.expr(f"cast(size({every}) as bigint)").alias("n_spans"))
