import pytest
from pyspark.sql import functions as F

from tomegraph.functions import similarity as S
from tomegraph.functions import tags
from tomegraph.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} string" for k in values) or "x int")
    return df.select(column.alias("v")).first().v


TAGS = [
    ("Meet {@creature Marsh Wolf|ABC} by {@area the gate|0a1|x}.", "Meet Marsh Wolf by the gate.", [("Marsh Wolf", "creature", ["ABC"]), ("the gate", "area", ["0a1", "x"])], None),
    ("{@note {@b Bold} and {@item Lamp|XYZ}}", "Bold and Lamp", [("Lamp", "item", ["XYZ"])], "{@note Bold and Lamp}"),
    ("{@h}7 damage", "{@h}7 damage", [], None),
    ("{@skill Stealth} and {@skill Stealth}", "Stealth and Stealth", [("Stealth", "skill", [])], None),
    ("{@creature Élan|Q}", "Élan", [("Élan", "creature", ["Q"])], None),
    ("", "", [], None),
    (None, "", [], None),
    ("{@creature " * 12 + "x" + "}" * 12, "x", [("x", "creature", [])], "{@creature " * 11 + "x" + "}" * 11),
    ("{@{@b item} Lamp|Q} {x {@b y} z}", "Lamp {x y z}", [("Lamp", "item", ["Q"])], "{@item Lamp|Q} {x y z}"),
    ("{{@a @item b|c} d} } {@b }", "b d } {@b }", [("@item b", "a", ["c"]), ("b d", "item", [])], "{@item b d} } {@b }"),
]


@pytest.mark.parametrize(("text", "clean", "links", "once"), TAGS)
def test_tags(spark, text, clean, links, once):
    got = one(spark, tags.parse_and_clean(F.col("t")), t=text)
    assert got.text == clean
    assert [(x.text, x.tag, x.attrs) for x in got.links] == links
    assert one(spark, tags.parse_once(F.col("t")), t=text).text == (clean if once is None else once)


def test_references_and_groups(spark):
    text = "{@creature Rat|MM} {@spell Light} {@dice 1d4} {@action Dash}"
    got = one(spark, tags.tag_references(F.col("t")), t=text)
    assert [tuple(x) for x in got] == [("creature", "Rat", "MM"), ("spell", "Light", None)]
    refs = one(spark, F.transform(tags.grouped(tags.parse_and_clean(F.col("t"))["links"], "entity"), tags.external_ref), t=text)
    assert [tuple(r) for r in refs] == [("creature", "Rat|MM", "Rat"), ("spell", "Light", "Light"), ("action", "Dash", "Dash")]


SIMILAR = [("cliff_top", "clifftop", True), ("gate", "gatehouse", False), ("gate", "north gate tower", False), ("cat", "dog", False), ("cat", "cow", True), ("", "x", False), (None, "x", False)]


@pytest.mark.parametrize(("a", "b", "want"), SIMILAR)
def test_similar_labels(spark, a, b, want):
    assert one(spark, S.similar_labels(F.col("a"), F.col("b")), a=a, b=b) is want


def test_names(spark):
    c = F.col("t")
    assert one(spark, T.md5_id("monster", c, F.lit("ABC")), t="Marsh Wolf") == "ed296235fd0771a7e6e7b2ef365be508"
    assert one(spark, T.snake_id(c), t="Marsh-Wolf's Den (2)") == "marsh_wolfs_den_2"
    assert one(spark, T.slug(c), t="  A--b! ") == "a_b"
    assert one(spark, T.title_case(c), t="cave_system o'neil") == "Cave_System O'Neil"
    assert one(spark, T.normalized_label(c), t="Dragon's_ Rest") == "dragons rest"
    assert one(spark, T.relation_type(c), t="part_of") == "PART_OF"
    assert one(spark, T.relation_type(c), t="near to-it") == "NEAR_TO_IT"
    assert one(spark, T.type_label(c), t="creature") == "Creature"
    assert one(spark, T.strip_thinking(c), t="<think>a</think> b") == "b"
    assert one(spark, T.strip_thinking(c), t="<think>a") == "<think>a"
    assert one(spark, T.salvage_json(c), t='x ```json\n{"a": 1}\n``` y') .strip() == '{"a": 1}'
    assert one(spark, T.salvage_json(c), t="none") is None
    assert one(spark, T.label_kind(c), t="Dragon's Rest") == "creatures"
    assert one(spark, T.node_colour(c), t="npc") == "#f1ccb8"
    assert one(spark, T.alias_forms(c), t="Old_Mill Road") == ["old mill road", "old mill", "mill road"]
    for title, code in (("A1: Cave", "A1"), ("Area C3: Hall", "C3"), ("A1:Name", "A1"), ("b2 Name", "b2"), ("area  d10\tx", "d10"), ("A1", ""), ("AB1: x", ""), ("A1. x", ""), ("A1:", "")):
        assert one(spark, T.area_code(c), t=title) == code


@pytest.mark.parametrize(("label", "want"), [("Orchid", True), ("Zombie Lord", True), ("James", True), ("Wolves", True), ("Dragonborn", True), ("Bats", False), (None, False)])
def test_generic(spark, label, want):
    assert one(spark, T.is_generic_creature(F.col("t")), t=label) is want


@pytest.mark.parametrize(("node_id", "label", "want"), [("location_1", "x", True), ("area_b2", "x", True), ("temp_9", "", True), ("other_entities", "", True), ("den", "an area", True), ("den", "unknown object", True), ("den", "Den", False), (None, None, False)])
def test_meaningless(spark, node_id, label, want):
    assert one(spark, T.is_meaningless(F.col("i"), F.col("l")), i=node_id, l=label) is want


def test_weighted_ratio():
    assert S.weighted_ratio("bell", "bell") == 100
    assert S.weighted_ratio("lamp post", "post lamp") >= 90
    assert S.weighted_ratio("", "x") == 0
    assert S.weighted_ratio("tower", "gate") < 60
    assert abs(S.weighted_ratio("this is a test", "this is a new test!!!") - 85.5) < 10
    # by the definition: letters in common twice over all letters; tokens; runs of the longer text
    assert S.weighted_ratio("kitten", "sitting") == pytest.approx(100 * 2 * 4 / 13)
    assert S.weighted_ratio("old mill", "mill old") == pytest.approx(95)
    assert S.weighted_ratio("mill", "the old mill by the sea") == pytest.approx(90)
    assert S.weighted_ratio("mill", "x" * 40 + "mill") == pytest.approx(60)


def test_common_subsequence():
    import random

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 40))) for _ in range(2))
        assert S._common(a, b) == plain(a, b)


def test_cosine(spark):
    df = spark.sql("SELECT array(1.0f, 0.0f) a, array(1.0f, 1.0f) b, array(0.0f, 0.0f) z")
    r = df.select(S.cosine(F.col("a"), F.col("b")).alias("x"), S.cosine(F.col("a"), F.col("z")).alias("y")).first()
    assert abs(r.x - 0.5**0.5) < 1e-9
    assert r.y == 0


def test_bounds_lose_no_partner():
    """Same partners as scoring every pair, and few pairs scored."""
    import random

    from tomegraph.functions.similarity import Counted, best_partners, weighted_ratio

    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh ij") for _ in range(r.randint(1, 9))) for _ in range(120)] + ["old mill", "the old mill", "mill", "mill mill", "é☃", " ", "wolf", "wolfs", "grey wolf den"]
    name = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 4)))
    labels, names = sorted({name() for _ in range(60)}), [name() for _ in range(300)]
    counted = Counted(names)
    for j, q in enumerate(labels):
        bound = counted.bounds(Counted(labels), j)
        assert all(weighted_ratio(q, n) <= b for n, b in zip(names, bound, strict=True))
    for threshold in (0.0, 80.0):
        best, scored = {}, 0
        for lo in range(0, len(names), 90):
            scored += best_partners(Counted(labels), Counted(names[lo : lo + 90]), threshold, best)
        want = {q: min((-s, n) for n in names if (s := weighted_ratio(q, n)) >= threshold) for q in labels if any(weighted_ratio(q, n) >= threshold for n in names)}
        assert best == want
        assert scored < 0.5 * len(labels) * len(names)


def test_places_where_lower_case_is_longer(spark):
    from tomegraph.functions import containment

    t = spark.createDataFrame([(1, "İİİ the end"), (2, "THE İ the"), (3, None), (4, "x" * 40 + "İthe" + "y" * 40)], "id long, text string")
    got = {r.id: (r.n, r["at"], r.context) for r in containment.occurrences(t, [(0, "The")]).collect()}
    assert got == {1: (1, 4, "İİİ the end"), 2: (2, 0, "THE İ the"), 4: (1, 41, "x" * 29 + "İthe" + "y" * 30)}
