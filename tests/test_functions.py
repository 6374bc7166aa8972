import math

import pytest
from pyspark.sql import functions as F

from loam.functions import geo
from loam.functions import text as tx
from loam.functions import vector as vec
from loam.operators import names as nm
from loam.operators import runs as run


def one(spark, f, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("D’Entrecasteaux", "dentrecasteaux"), ("Ålands—Øya", "alands ya"), ("  Mt  Wellington! ", "mt wellington"), ("O'Brien's", "obriens"), ("Café", "cafe"), ("---", "")])
def test_normalise(spark, text, want):
    assert one(spark, tx.normalise, text) == want


def test_the_two_normalisers_differ_in_apostrophes(spark):
    assert one(spark, tx.norm_build, "O'Brien's Café") == "o brien s cafe"


@pytest.mark.parametrize(("text", "want"), [("  1/3-5 Smith", "3 Smith"), ("1/12ab Smith", "1/12ab Smith"), ("1/12 Smith St", "12 Smith St"), ("2-4 Smith St", "2 Smith St"), ("2a – 4b Smith", "2a Smith"), ("Smith 1/2", "Smith 1/2")])
def test_units_and_ranges(spark, text, want):
    assert one(spark, tx.strip_unit_and_range, text) == want


@pytest.mark.parametrize(
    ("words", "want"),
    [("12 3 smith", ("3", ["smith"], False)), ("12 smith st", ("12", ["smith", "st"], False)), ("smith st 15a", ("15a", ["smith", "st"], True)), ("12", (None, ["12"], False)), ("7 mile 3 beach", ("7", ["mile", "beach"], False)), ("12 13", (None, ["12", "13"], False))],
)
def test_house_numbers(spark, words, want):
    r = one(spark, tx.split_house_number, words.split())
    assert (r.number, r.rest) == want[:2] and (want[0] is None or r.at_end == want[2])


@pytest.mark.parametrize(
    ("text", "want"),
    [("30–60 cm", (0.3, 0.6, False)), ("to 2 m", (2.0, 2.0, True)), ("0.3–1 m", (0.3, 1.0, False)), ("1,5 m tall", (1.5, 1.5, False)), ("up to 15 cm high", (0.15, 0.15, True)), ("5 mm - 2 cm", (0.005, 0.02, False)),
     ("to 2 – 3 m", None), ("0", None), ("1 – 2 – 3", None), ("500", None), ("tall", None)],
)
def test_heights(spark, text, want):
    r = one(spark, tx.height, text)
    assert (r is None) if want is None else (math.isclose(r.min, want[0]) and math.isclose(r.max, want[1]) and r.up_to == want[2])


def test_prose_heights_need_tall_or_high(spark):
    r = one(spark, tx.prose_height, "A shrub, grows to 5–6 m tall in gullies")
    assert (r.min, r.max, r.up_to) == (5.0, 6.0, False)
    assert one(spark, tx.prose_height, "Cushions to 1 m in diameter") is None


@pytest.mark.parametrize(("km", "want"), [(0.01, "50 m"), (0.93, "950 m"), (0.95, "1.0 km"), (1.24, "1.2 km"), (9.94, "9.9 km"), (12.4, "12 km")])
def test_distances_in_words(spark, km, want):
    assert one(spark, tx.distance_text, km) == want


def test_names(spark):
    assert one(spark, tx.species_key, "Eucalyptus obliqua var. x") == "Eucalyptus obliqua"
    assert one(spark, tx.species_key, "Acacia sp.") is None
    assert one(spark, tx.same_stem, "Acacia melanoxylon", "Acacia melanoxilon") is True
    assert one(spark, tx.smart_title, "o'connor and mcdonald of the NW point") == "O'Connor and McDonald of the Nw Point"
    assert one(spark, tx.similarity, "abcd", "bcde") == 0.75
    assert one(spark, tx.latin1, "Łódź – café") == "ódz  café"
    assert one(spark, tx.binomials, "Eucalyptus obliqua grows with E. regnans. It does lack nothing. Acacia mearnsii too.") == ["Eucalyptus obliqua", "Eucalyptus regnans", "Acacia mearnsii"]
    assert "Themeda triandra" not in one(spark, tx.binomials, "Open ground rather than Themeda triandra grows here.")
    assert one(spark, tx.binomials, "It is found instead of Themeda triandra, but Acacia dealbata is there. Banksia marginata, which never occurs.") == ["Acacia dealbata"]
    for name, title in {"ST HELENS": "St Helens", "MT WELLINGTON RD": "Mt Wellington Rd", "SMITH/JONES": "Smith/Jones", "RSL CLUB OF THE BAY": "RSL Club of the Bay", "D'ARCY-MCKAY (O'CONNOR'S)": "D'Arcy-McKay (O'Connor's)", "THE MC": "The Mc", "": ""}.items():
        assert one(spark, tx.smart_title, name) == title
    stems = [one(spark, tx.gender_stem, e) for e in ("tasmanica", "tasmanicum", "tasmanensis", "tasmanense", "glaber", "glabra", "alba", "viridis", "viride")]
    assert stems[0] == stems[1] and stems[2] == stems[3] and stems[4] == stems[5] and stems[7] == stems[8] and len(set(stems)) == 5
    assert one(spark, tx.epithet_key, "smithii") == one(spark, tx.epithet_key, "smithi") and one(spark, tx.epithet_key, "annae") == one(spark, tx.epithet_key, "anniae")
    assert one(spark, tx.paragraphs, "a line\nwrapped here\n\n- item one\nand more\nShort end.\nnext") == ["a line wrapped here", "- item one and more Short end.", "next"]
    assert one(spark, tx.description, ("Some words here. " * 40).strip()) == ("Some words here. " * 17).strip() + " …"
    assert one(spark, tx.description, "A shrub. Sow seed in pots. Germinates after fire. Prune hard! (Wind-pruned on coasts.) Found in road cuttings.") == "A shrub. Germinates after fire. (Wind-pruned on coasts.) Found in road cuttings."
    assert one(spark, tx.description, "Propagate from cuttings.") is None and one(spark, tx.description, "") is None
    assert one(spark, tx.description, "x" * 400) == "x" * 299 + "…"
    runs = one(spark, nm.botanical_runs, "Acacia dealbata subsp. alpina Tindale 'Gold Dust' (syn. x)")
    assert [r.text for r in runs if r.italic] == ["Acacia dealbata", "alpina"]
    keys = [set(one(spark, nm.spelling_keys, e)) for e in ("sylvaticus", "sylvatica", "silvatica", "brownii", "browni", "d-alba", "dalbum")]
    assert keys[0] & keys[1] and keys[3] & keys[4] and keys[5] & keys[6]
    assert not keys[1] & keys[2]  # a y is no i: other lists tell such names apart
    states = one(spark, nm.qualified_states, "Tas (native and naturalised), Vic, NSW (doubtful, old)")
    assert [(s.state, s.note) for s in states] == [("Tas", "native and naturalised"), ("Vic", None), ("NSW", "doubtful, old")]


def test_small_text_functions(spark):
    assert one(spark, tx.licence_code, "Licensed under CC BY-NC 4.0") == "cc-by-nc-4.0"
    assert one(spark, tx.licence_code, "http://creativecommons.org/publicdomain/zero/1.0/") == "cc0"
    assert one(spark, tx.allows_any_use, "CC BY 4.0") is True and one(spark, tx.allows_any_use, "CC BY-NC-ND") is False
    assert one(spark, tx.colour, "#00000080") == "#7F7F7F" and one(spark, tx.colour, "ff0000") == "#FF0000"
    assert one(spark, tx.code_prefix_stripped, "(ABC) Heath") == "Heath"
    assert one(spark, tx.top_of_hierarchy, "A b > C > D") == "A b"
    assert one(spark, tx.meta_line, "Road", "Hobart", "Hobart, Glenorchy", "High St") == "Road · Hobart, Hobart"
    assert one(spark, tx.unshift, "+HOOR") == "Hello"
    assert one(spark, tx.percent_down, 0.29) == "29%" and one(spark, tx.size_text, 1_500_000) == "2 MB"
    assert one(spark, tx.leading_int, "15A") == 15 and one(spark, tx.leading_int, "A15") is None
    assert one(spark, tx.html_text, "<p>A&amp;B<script>x</script><br>c</p><!-- d -->") == "A&B c"
    assert one(spark, tx.upload_parts, "https://x.org/wp/uploads/2020/05/leaf-300x200.jpg").asDict() == {"year": "2020", "month": "05", "stem": "leaf", "size": "300x200", "ext": "jpg"}


def test_geo(spark):
    g = one(spark, geo.mga55, -42.88234, 147.3272)
    assert abs(g.e - 526720.3749) < 1e-3 and abs(g.n - 5252199.0926) < 1e-3
    for z, x, y, want in ((1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 1, 3), (1, 1, 0, 4), (2, 0, 0, 5), (12, 3423, 1763, 19078479)):
        assert one(spark, lambda a, b: geo.tile_id(z, a, b), x, y) == want
    t = spark.range(0, 5461).select("id", geo.tile_of_id(F.col("id")).alias("t"))
    for z in range(7):
        part = t.where(F.col("t.z") == z)
        assert part.count() == 4**z and part.where(geo.tile_id(z, F.col("t.x"), F.col("t.y")) != F.col("id")).count() == 0
    assert abs(one(spark, geo.km, -42.0, 147.0, -43.0, 147.0) - 110.57) < 1e-9
    assert one(spark, lambda a, b: geo.in_box(a, b, -44, 143, -39, 149), float("nan"), 147.0) is False
    assert abs(one(spark, lambda x: geo.tile_west(x, 4), 16) - 180) < 1e-9 and abs(one(spark, lambda y: geo.tile_north(y, 4), 8)) < 1e-9


@pytest.mark.parametrize(("months", "want"), [([1, 2, 12], [(12, 2)]), ([3, 4, 7], [(3, 4), (7, 7)]), ([], []), (list(range(1, 13)), [(1, 12)]), ([1, 5, 11, 12], [(5, 5), (11, 1)])])
def test_month_runs(spark, months, want):
    df = spark.createDataFrame([(months,)], "m array<int>")
    assert [(r["from"], r["to"]) for r in df.select(run.month_runs(F.col("m")).alias("x")).first().x] == want


def test_vectors(spark):
    assert one(spark, vec.cosine, [3.0, 4.0], [4.0, 3.0]) == pytest.approx(0.96)
    q = one(spark, vec.quantise8, [1.0, -0.5, 0.0])
    assert q.values == [127, -64, 0] or q.values == [127, -63, 0] or list(q.values) == [127, -64, 0]
    assert one(spark, vec.unit, [0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, lambda n: vec.count_transform(n, "sqrt"), 9) == 3.0
