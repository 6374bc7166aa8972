"""Names, addresses and figures in text as column expressions."""

from __future__ import annotations

import difflib
import re
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What typed abbreviations stand for.
ABBREVIATIONS = {
    "rd": "road", "mt": "mount", "ck": "creek", "crk": "creek", "pt": "point", "hwy": "highway",
    "ct": "court", "ln": "lane", "tce": "terrace", "blvd": "boulevard", "hts": "heights",
    "pde": "parade", "cct": "circuit", "sq": "square", "rv": "river", "pk": "peak", "trk": "track",
    "tk": "track", "hbr": "harbour", "lk": "lake", "nth": "north", "sth": "south", "saint": "st",
}
# Words that say a street is meant.
STREET_WORDS = (
    "street", "st", "road", "rd", "avenue", "ave", "av", "court", "ct", "crescent", "cres", "cr",
    "place", "pl", "drive", "dr", "lane", "ln", "terrace", "tce", "highway", "hwy", "parade", "pde",
    "circuit", "cct", "boulevard", "blvd", "close", "cl", "way", "esplanade", "esp", "grove", "gr",
    "rise", "square", "sq", "mews", "alley", "walk", "row", "loop", "link", "bypass", "promenade",
    "quay", "wharf", "freeway", "fwy",
)
# Numbers that names spell out.
NUMBER_WORDS = {
    "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven",
    "8": "eight", "9": "nine", "10": "ten", "11": "eleven", "12": "twelve", "13": "thirteen",
    "14": "fourteen", "15": "fifteen", "16": "sixteen", "17": "seventeen", "18": "eighteen",
    "19": "nineteen", "20": "twenty", "30": "thirty", "40": "forty", "50": "fifty",
}


def _accents() -> tuple[str, str]:
    """Letters that NFD takes apart into an ASCII letter and marks, and those letters."""
    import unicodedata

    pairs = [(c, d[0]) for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accents()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{M}", "")


def normalise(c: Column) -> Column:
    """Search form: no accents, lower case, no apostrophes, other characters one space."""
    plain = F.regexp_replace(F.lower(strip_accents(c)), "['’]", "")
    return F.btrim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def norm_build(c: Column) -> Column:
    """Index form: as normalise, but apostrophes are spaces."""
    return F.btrim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " "))


def words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: w != "")


def literal_map(m: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(m.items())])


def expand(word: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(ABBREVIATIONS), word), word)


def forms(word: Column) -> Column:
    """What a typed word may mean: its expansion, then itself."""
    return F.array_distinct(F.array(expand(word), word))


def is_street_word(word: Column) -> Column:
    return word.isin(*STREET_WORDS)


def number_word(word: Column) -> Column:
    return F.try_element_at(literal_map(NUMBER_WORDS), word)


def strip_unit_and_range(c: Column) -> Column:
    """'1/12 Smith St' to '12 Smith St', '2-4 Smith St' to '2 Smith St'."""
    unit = F.regexp_replace(c, r"(?i)^\s*\d+[a-z]?\s*/\s*(\d+[a-z]?)\b", "$1")
    return F.regexp_replace(unit, r"(?i)^\s*(\d+[a-z]?)\s*[-–—]\s*\d+[a-z]?\b", "$1")


def split_house_number(tokens: Column) -> Column:
    """struct of number (or null), rest and at_end, from the words of a search."""
    n = F.size(tokens)
    at = lambda i: F.coalesce(F.try_element_at(tokens, F.lit(i)), F.lit(""))
    house, bare = lambda w: w.rlike(r"^\d+[a-z]?$"), lambda w: w.rlike(r"^\d+$")
    two, front, end = (n > 2) & bare(at(1)) & house(at(2)), (n > 1) & house(at(1)), (n > 1) & house(at(-1))
    number = F.when(two, at(2)).when(front, at(1)).when(end, at(-1))
    cut = F.when(two, F.slice(tokens, 3, F.greatest(n - 2, F.lit(0)))).when(front, F.slice(tokens, 2, F.greatest(n - 1, F.lit(0)))).otherwise(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))))
    rest = F.filter(cut, lambda w: ~w.rlike(r"^\d+$"))
    fits = number.isNotNull() & (F.size(rest) > 0)
    return F.struct(F.when(fits, number).alias("number"), F.when(fits, rest).otherwise(tokens).alias("rest"), (~two & ~front & end).alias("at_end"))


def leading_int(c: Column) -> Column:
    """Leading digits as a number; null without any."""
    return F.when(c.rlike("^[0-9]"), F.regexp_extract(c, "^([0-9]+)", 1).try_cast("bigint"))


def distance_text(km: Column) -> Column:
    """'50 m' to '950 m', '1.2 km' to '9.9 km', '12 km'."""
    metres = F.greatest(F.lit(50), F.floor(km * 20 + 0.5) * 50).cast("bigint")
    tenths = F.floor(km * 10 + 0.5).cast("bigint")
    return (
        F.when(km < 0.95, F.concat(metres.cast("string"), F.lit(" m")))
        .when(km < 10, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" km")))
        .otherwise(F.concat(F.floor(km + 0.5).cast("string"), F.lit(" km")))
    )


def species_key(c: Column) -> Column:
    """Genus and epithet; null for undetermined species, hybrids and single words."""
    w = F.filter(F.split(F.btrim(c), r"\s+"), lambda x: x != "")
    second = F.coalesce(F.try_element_at(w, F.lit(2)), F.lit(""))
    fine = (F.size(w) >= 2) & second.rlike("^[a-z][a-z-]+$") & ~second.isin("sp", "spp", "aff", "cf", "x", "sp.", "spp.") & ~c.rlike("×")
    return F.when(fine, F.concat_ws(" ", F.element_at(w, 1), second))


def same_stem(a: Column, b: Column, n: int = 5) -> Column:
    """Spelling variants: same genus, epithets that share their first letters."""
    g, e = lambda x: F.substring_index(x, " ", 1), lambda x: F.substring_index(x, " ", -1)
    return (g(a) == g(b)) & (F.left(e(a), F.lit(n)) == F.left(e(b), F.lit(n)))


#: Endings of Latin epithets that stand for each other by gender, and what a stem has in their place.
GENDER = ((("rum", "ra", "er"), "-er"), (("us", "um", "a"), "-us"), (("is", "e"), "-is"))


def gender_stem(epithet: Column) -> Column:
    """The same for forms that differ in gender alone: -us, -a, -um; -is, -e; -er, -ra, -rum. Endings
    do not fall off, so that -ica and -ensis stay apart."""
    out = epithet
    for endings, mark in reversed(GENDER):
        out = F.when(epithet.rlike(f"({'|'.join(endings)})$"), F.regexp_replace(epithet, f"({'|'.join(endings)})$", mark)).otherwise(out)
    return out


def epithet_key(epithet: Column) -> Column:
    """Also the same for honours spelt with one i or two: -i, -ii; -ae, -iae."""
    one = F.regexp_replace(F.lower(epithet), "(?<=[a-z])i(i|ae)$", "$1")
    return gender_stem(one)


_HEIGHT = r"^([0-9]+(?:[.,][0-9]+)?)\s*(m|cm|mm)?(?:\s*(?:–|—|-|to)\s*([0-9]+(?:[.,][0-9]+)?)\s*(m|cm|mm)?)?\s*(?:tall|high)?$"


def _metres(unit: Column) -> Column:
    return F.when(unit == "cm", 0.01).when(unit == "mm", 0.001).otherwise(1.0)


def _number(text: Column) -> Column:
    return F.translate(text, ",", ".").try_cast("double")


def height(c: Column) -> Column:
    """struct of min, max (metres) and up_to, or null for anything but one height or range."""
    s = F.lower(F.btrim(c))
    up = s.rlike("^(up to |to |<)")
    s = F.btrim(F.regexp_replace(s, "^(up to |to |<)", ""))
    a, ua, b, ub = (F.regexp_extract(s, _HEIGHT, i) for i in (1, 2, 3, 4))
    unit_b = _metres(F.when(ub != "", ub).when(ua != "", ua).otherwise("m"))
    unit_a = F.when(ua != "", _metres(ua)).otherwise(unit_b)
    low, high = _number(F.nullif(a, F.lit(""))) * unit_a, _number(F.coalesce(F.nullif(b, F.lit("")), F.nullif(a, F.lit("")))) * unit_b
    fine = (a != "") & ~(up & (b != "")) & (low > 0) & (high > 0) & (high < 200)
    return F.when(fine, F.struct(F.least(low, high).alias("min"), F.greatest(low, high).alias("max"), up.alias("up_to")))


_PROSE = r"(?i)\b(?:to|up to|reaching|grows to)\s+([0-9]+(?:[.,][0-9]+)?)(?:\s*(?:-|–|to)\s*([0-9]+(?:[.,][0-9]+)?))?\s*(m|cm|mm)\s+(?:tall|high)\b"


def prose_height(c: Column) -> Column:
    """A height in prose, only where it says tall or high."""
    a, b, u = (F.regexp_extract(c, _PROSE, i) for i in (1, 2, 3))
    unit = _metres(F.lower(u))
    low, high = _number(F.nullif(a, F.lit(""))) * unit, _number(F.nullif(b, F.lit(""))) * unit
    fine = (a != "") & (low > 0) & (high.isNull() | (high > 0))
    top = F.coalesce(high, low)
    return F.when(fine, F.struct(F.least(low, top).alias("min"), F.greatest(low, top).alias("max"), high.isNull().alias("up_to")))


def licence_code(c: Column) -> Column:
    """Licence text to a short code; null when it names none."""
    t = F.lower(c)
    version = F.regexp_extract(t, r"([1-4]\.[0-9])", 1)
    cc = F.regexp_replace(F.regexp_extract(t, r"(?:cc[ -]|/licenses/|creative commons.*?)(by(?:[ -](?:nc|nd|sa)){0,2})\b", 1), " ", "-")
    coded = F.when(cc != "", F.concat_ws("-", F.lit("cc"), cc, F.nullif(version, F.lit(""))))
    return F.when(t.rlike(r"cc ?-?0|public domain|/zero/"), "cc0").otherwise(coded)


def allows_any_use(c: Column) -> Column:
    """CC BY (or BY-SA) but neither NC nor ND."""
    return F.lower(c).rlike(r"\bcc[ -]by(?![ -]*(?:sa[ -]*)?(?:nc|nd))") & ~F.lower(c).rlike(r"by[ -](?:[a-z]{2}[ -])?(?:nc|nd)")


def colour(c: Column) -> Column:
    """#RRGGBBAA (or #RRGGBB) as #RRGGBB over white."""
    h = F.upper(F.regexp_replace(c, "^#", ""))
    a = F.when(F.length(h) == 8, F.conv(F.substring(h, 7, 2), 16, 10).cast("double") / 255).otherwise(1.0)
    part = lambda i: F.lpad(F.hex(F.rint(F.conv(F.substring(h, i, 2), 16, 10).cast("double") * a + 255 * (1 - a)).cast("bigint")), 2, "0")
    return F.when(h.rlike("^([0-9A-F]{6}|[0-9A-F]{8})$"), F.concat(F.lit("#"), part(1), part(3), part(5)))


def code_prefix_stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\([A-Z]{3}\)\s*", "")


def top_of_hierarchy(c: Column) -> Column:
    return F.btrim(F.element_at(F.split(c, ">"), 1))


def meta_line(kind: Column, place: Column, council: Column, name: Column) -> Column:
    """'Type · place, council': the first council only; a place equal to the name is left out."""
    where = F.when(place != name, place)
    return F.concat_ws(" · ", kind, F.nullif(F.concat_ws(", ", where, F.btrim(F.substring_index(council, ",", 1))), F.lit("")))


def unshift(c: Column, by: int = 29) -> Column:
    """Glyph codes shifted down by a constant, shifted back."""
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.char(F.ascii(x) + by)), "")


def percent_down(f: Column) -> Column:
    """Whole percent, rounded down with a little slack for float noise."""
    return F.concat(F.floor(f * 100 + 1e-6).cast("string"), F.lit("%"))


def size_text(n: Column) -> Column:
    return (
        F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1e6, F.concat(F.floor(n / 1e3 + 0.5).cast("string"), F.lit(" kB")))
        .when(n < 1e9, F.concat(F.floor(n / 1e6 + 0.5).cast("string"), F.lit(" MB")))
        .otherwise(F.concat(F.format_number(n / 1e9, 1), F.lit(" GB")))
    )


def html_text(c: Column) -> Column:
    """Visible text: scripts, styles, comments and tags dropped, common entities decoded, white space folded."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(t, r"\s+", " "))


def upload_parts(url: Column) -> Column:
    """struct of year, month, stem, size and extension of an upload's path."""
    path = F.parse_url(url, F.lit("PATH"))
    p = r"(\d{4})/(\d{2})/([^/]+?)(?:-(\d+x\d+))?\.([A-Za-z0-9]+)$"
    return F.struct(*[F.nullif(F.regexp_extract(path, p, i), F.lit("")).alias(n) for i, n in ((1, "year"), (2, "month"), (3, "stem"), (4, "size"), (5, "ext"))])


#: Words that stay lower case inside a title, and words that stay in capitals.
_SMALL = ("of", "the", "and", "on", "at", "by", "in", "de", "du", "la", "le")
_ACRONYMS = (
    "ixl", "rsl", "cwa", "tas", "anz", "abc", "dcc", "hec", "tafe", "csiro", "ymca", "ses", "cbd", "cfa", "sda", "raaf", "rspca", "nab",
    "dpipwe", "nre", "pws", "utas", "tmag", "sbs", "hcc", "lcc", "gcc", "ccc",
)


def smart_title(name) -> Column:
    """Title case that knows O'Connor, McDonald, small words and acronyms; a letter after any
    separator is a capital one."""
    capital = lambda w, n: F.concat(F.substring(w, 1, n - 1), F.upper(F.substring(w, n, 1)), F.substring(w, n + 1, 1 << 30))

    def written(parts: Column, w: Column, i: Column) -> Column:
        inside = (i > 0) & (F.get(parts, F.greatest(i - 1, F.lit(0))) == " ")
        usual = F.when(w.rlike("^mc.."), F.concat(F.lit("Mc"), F.substring(capital(w, 3), 3, 1 << 30))).when(w.rlike("^.'"), capital(capital(w, 1), 3)).otherwise(capital(w, 1))
        return F.when(w.isin(*_ACRONYMS), F.upper(w)).when(inside & w.isin(*_SMALL), w).otherwise(usual)

    c = F.col(name) if isinstance(name, str) else name
    parts = F.regexp_extract_all(F.lower(F.trim(c)), F.lit("[0-9a-z']+|[^0-9a-z']+"), F.lit(0))
    joined = F.transform(F.array(parts), lambda p: F.array_join(F.transform(p, lambda w, i: written(p, w, i)), ""))
    return F.element_at(joined, 1)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, 0 to 1."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def latin1(s: pd.Series) -> pd.Series:
    """The text in Latin-1; what does not fit falls apart by NFKD and loses its marks."""
    import unicodedata

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        return "".join(c if ord(c) < 256 else "".join(d for d in unicodedata.normalize("NFKD", c) if ord(d) < 256 and not unicodedata.combining(d)) for c in t)

    return s.map(one)


#: What a sentence on growing the plant says, and what shows that it is about the wild after all.
_GROWING = (
    r"(?i)propagat\w*|(?<!road )\bcuttings?\b|(?<!self-)\bsow(n|s|ing)?\b|germinat\w*|potting|\bpots?\b|\brepot\w*"
    r"|\bwater(ing|ed)\b|\b(plenty of|ample|abundant|regular|extra|supplementary|summer) water"
    r"|\bwater (regularly|must)|saucer of water|standing in water|capillary (watering|matting|beds?)"
    r"|fertili[sz]\w*|(?<!wind-)(?<!wind )\bprun(e|ed|es|ing)\b|tip-prun\w*|seed raising"
)
_WILD = r"(?i)after fire|relies on birds|dispersed by"
#: Most characters of a description.
DESCRIBED = 300


def description(c: Column) -> Column:
    """The text without its sentences on growing the plant; a longer one than DESCRIBED ends with a whole
    sentence and an ellipsis, or within its first sentence after a word. Null if nothing is left."""
    kept = F.filter(F.split(c, r"(?<=[.!?])\s+(?=[A-Z(])"), lambda x: ~x.rlike(_GROWING) | x.rlike(_WILD))
    whole = F.array_join(kept, " ")
    stripped = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")

    def more(at: Column, x: Column) -> Column:
        full = at["full"] | (F.length(at["text"]) + F.length(x) + 1 > DESCRIBED - 2)
        return F.struct(F.when(full, at["text"]).otherwise(stripped(F.concat_ws(" ", at["text"], x))).alias("text"), full.alias("full"))

    some = F.aggregate(kept, F.struct(F.lit("").alias("text"), F.lit(False).alias("full")), more, lambda at: at["text"])
    head = F.left(whole, F.lit(DESCRIBED - 1))
    words_ = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, "(?s)^(.*) ", 1)).otherwise(head)
    cut = F.when(some != "", F.concat(some, F.lit(" …"))).otherwise(F.concat(F.regexp_replace(words_, "[,;:]+$", ""), F.lit("…")))
    return F.nullif(F.when(F.length(whole) > DESCRIBED, cut).otherwise(whole), F.lit(""))


_BINOMIAL = re.compile(r"\b([A-Z][a-z]+|[A-Z]\.)\s+([a-z][a-z-]{2,})\b")
#: What denies a mention before it or after it, how far before it, what ends a denial's
#: scope, and what epithets and genera look like.
_DENIES = re.compile(r"\b(lacks|lacking|absence of|absent|instead of|rather than|rarely if ever|unlike)\b", re.I)
_DENIES_AFTER = re.compile(r"[\s,]*(which|that)\s+(rarely if ever|never|does not|is absent)\b", re.I)
_REACH = 60
_SCOPE_ENDS = (
    re.compile(r"(?<![A-Z])[.!?]\s+(?=[A-Z])"),
    re.compile(r",\s+(is|are|was|were|with|but|which|while|whereas)\b|\bas (is|are)\b", re.I),
)
_EPITHET = re.compile(r"(a|us|um|is|ii|i|ae|ensis|oides|ans|ens|ax|ix|ex|or|ata|ica|ina|ella|ula)$")
_GENUS = re.compile(r"(a|us|um|is|ia|on|ax|ix|ea|ra|ys|as|os|e)$")
_NOT_EPITHET = frozenset(
    "area areas data via plus thus minus versus genus status basis analysis taxa flora fauna biota media criteria formula extra ultra era idea ideas agenda vista mesa sera this his is was has its also into onto "
    "upon within elsewhere tasmania australia peninsula i ii and or a".split()
)


def denied(text: str, begin: int, end: int) -> bool:
    """Whether a mention is one of what is missing: a denial within reach before it, in the same clause, or right after it."""
    scope = text[max(0, begin - _REACH) : begin]
    opens = max((m.end() for p in _SCOPE_ENDS for m in p.finditer(scope)), default=0)
    return bool(_DENIES.search(scope, opens) or _DENIES_AFTER.match(text, end))


@F.pandas_udf(T.ArrayType(T.StringType()))
def binomials(s: pd.Series) -> pd.Series:
    """Genus-species names of a text in order; 'E. obliqua' takes the last genus with that
    letter; names that the text says are missing are left out."""
    def one(t: str | None) -> list[str]:
        out, genera = [], {}
        for m in _BINOMIAL.finditer(t or ""):
            genus, epithet = m[1], m[2]
            if epithet in _NOT_EPITHET or not _EPITHET.search(epithet):
                continue
            if genus.endswith("."):
                genus = genera.get(genus[0])
            elif not _GENUS.search(genus):
                continue
            if genus is not None:
                genera[genus[0]] = genus
                if not denied(t, m.start(), m.end()):
                    out.append(f"{genus} {epithet}")
        return out

    return s.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def paragraphs(s: pd.Series) -> pd.Series:
    """Wrapped lines joined to paragraphs; a blank line, a bullet or a short line that ends a sentence breaks."""
    def one(t: str | None) -> list[str]:
        out, now = [], ""
        for line in (t or "").split("\n"):
            line = line.strip()
            if not line or re.match(r"[-*•]\s", line):
                if now:
                    out.append(now)
                now = line
                continue
            now = f"{now} {line}".strip()
            if len(line) < 50 and line.endswith((".", "!", "?")):
                out.append(now)
                now = ""
        return [*out, now] if now else out

    return s.map(one)
