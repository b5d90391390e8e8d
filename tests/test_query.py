import random

import pytest

from tierspan.plans.query import DoesNotExist, Entity, MultipleObjectsReturned, Query

GRAPH = {
    "phrases": Entity("id", ("id",), {}, {"words": ("words", "phrase_id")}),
    "words": Entity("id", ("id",), {"phrase": ("phrases", "phrase_id")}, {"phones": ("phones", "word_id")}),
    "phones": Entity("id", ("id",), {"word": ("words", "word_id")}),
}


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    phrases = [(k, rng.choice(["A", "b", None]), rng.randint(0, 9)) for k in range(12)]
    words = [(k, rng.choice([*range(12), None]), rng.choice(["Ta", "ta", "straße", "", None, "é"]), rng.choice([1, 2, 3, None])) for k in range(40)]
    phones = [(k, rng.choice([*range(40)]), rng.choice(["t", "a", "ː", None])) for k in range(90)]
    return phrases, words, phones


@pytest.fixture(scope="module")
def base(spark, data):
    tables = {"phrases": spark.createDataFrame(data[0], "id long, speaker string, n int"), "words": spark.createDataFrame(data[1], "id long, phrase_id long, label string, stress int"), "phones": spark.createDataFrame(data[2], "id long, word_id long, label string")}
    return lambda entity: Query(tables, GRAPH, entity)


def ids(query):
    return sorted(r["id"] for r in query.rows().collect())


@pytest.mark.parametrize(
    ("lookup", "test"),
    [
        ({"label": None}, lambda x: x is None),
        ({"label": "ta"}, lambda x: x == "ta"),
        ({"label": 5}, lambda x: False),
        ({"label__in": ["ta", None]}, lambda x: x in ("ta", None)),
        ({"label__in": "a straße"}, lambda x: x is not None and x in "a straße"),
        ({"label__icontains": "T"}, lambda x: x is not None and "t" in x.lower()),
        ({"label__startswith": "T"}, lambda x: x is not None and x.startswith("T")),
        ({"label__iendswith": "A"}, lambda x: x is not None and x.lower().endswith("a")),
        ({"label__iexact": "STRASSE"}, lambda x: False),
        ({"label__iregex": "^É"}, lambda x: x == "é"),
        ({"label__len_gt": 2}, lambda x: x is not None and len(x) > 2),
        ({"label__len_eq": 0}, lambda x: x == ""),
    ],
)
def test_lookups(base, data, lookup, test):
    want = [w[0] for w in data[1] if test(w[2])]
    assert ids(base("words").filter(**lookup)) == want
    assert ids(base("words").exclude(**lookup)) == [w[0] for w in data[1] if not test(w[2])]


def test_paths(base, data):
    phrases, words, phones = data
    with_t = {p[1] for p in phones if p[2] == "t"}
    assert ids(base("phrases").filter(words__phones__label="t")) == sorted({w[1] for w in words if w[0] in with_t and w[1] is not None})
    assert ids(base("words").filter(phrase__n__gt=4)) == [w[0] for w in words if w[1] is not None and phrases[w[1]][2] > 4]
    per = {k: sum(p[1] == k for p in phones) for k in range(40)}
    assert ids(base("words").filter(phones__len_lt=2)) == [k for k in range(40) if per[k] < 2]
    a, b = ({p[1] for p in phones if p[2] == s} for s in ("t", "a"))
    assert ids(base("words").exclude(phones__label="t", stress=1)) == [w[0] for w in words if not (w[0] in a and w[3] == 1)]
    assert ids(base("words").filter(phones__label="t").filter(phones__label="a")) == sorted(a & b)
    assert ids(base("words").filter(phones__label__eq="t")) == []
    own = sorted(p[0] for p in phones if p[1] == 3)
    assert 3 in ids(base("words").filter(phones=own))


def test_terminals_and_errors(base, data):
    words = base("words")
    assert words.get(id=3)["id"] == 3 and words.get_or_none(id=999) is None
    with pytest.raises(DoesNotExist):
        words.get(id=999)
    with pytest.raises(MultipleObjectsReturned):
        words.get(id__in=[1, 2])
    assert [r["id"] for r in words.get_n(3).collect()] == [0, 1, 2]
    order = [r["id"] for r in words.filter(stress__gt=0).order_by("-stress", "label").df().collect()]
    want = sorted((w for w in data[1] if w[3]), key=lambda w: (-w[3], w[2] is not None, w[2] or "", w[0]))
    assert order == [w[0] for w in want]
    for bad, error in (({"nothing": 1}, AttributeError), ({"label__len": 1}, TypeError), ({"phones__label__gt": 1}, TypeError), ({"stress__gt": None}, TypeError), ({"label__x__y": 1}, AttributeError)):
        with pytest.raises(error):
            words.filter(**bad)
