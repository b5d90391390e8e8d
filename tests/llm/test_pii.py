import datetime
import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from tierspan.llm import pii


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


KEY = "of these tests"
CARD, BAD = "4845168114407329", "9807915762804491"
TEXT = f"Mail und.34@mail7.example.com or call +1 (017) 555-7713, card {CARD} {BAD} and 4845-1681-1440-7329; ip 97.51.17.173, 300.1.1.1 born 1987-02-28, 28/02/1987, 28.02.1987, 29.02.1988 ssn 123-45-6789 666-45-6789 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" end"


def one(spark, text):
    return pii.pseudonymise(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, _found string"), KEY).first()


def test_values_change_within_their_format(spark):
    r = one(spark, TEXT)
    shape = lambda s: re.sub(r"[0-9]", "9", re.sub(r"[a-f0-9]{40}", "H", s))
    out = r["text"]
    for gone in ("und.34@", "555-7713", CARD, "97.51.17.173", "1987-02-28", "28/02/1987", "29.02.1988", "123-45-6789", "04dbebab91ab"):
        assert gone not in out
    for kept in (BAD, "300.1.1.1", "666-45-6789", "@mail7.example.com", "+1 ("):
        assert kept in out
    assert r["n_found"] > r["n_replaced"] == 11
    cards = re.findall(r"(?<!\d)\d{4}-?\d{4}-?\d{4}-?\d{4}(?!\d)", out)
    assert luhn(cards[0]) and cards[2].replace("-", "") == cards[0]
    iso = re.search(r"born (\d{4})-(\d\d)-(\d\d), (\d\d)/(\d\d)/(\d{4}), (\d\d)\.(\d\d)\.(\d{4}), (29\.02\.\d{4})", out).groups()
    assert iso[:3] == iso[5:2:-1] == iso[8:5:-1]
    datetime.date(*map(int, iso[:3]))
    assert shape(out.split("ssn")[1]) == shape(TEXT.split("ssn")[1])


def test_equal_values_stay_linked_and_keys_matter(spark):
    docs = spark.createDataFrame([(k, f"{'x ' * k}card {CARD} end") for k in range(4)], "doc_id long, text string")
    a = {r["text"].split()[-2] for r in pii.pseudonymise(docs, KEY).collect()}
    b = {r["text"].split()[-2] for r in pii.pseudonymise(docs, "another key").collect()}
    assert len(a) == len(b) == 1 and a != b


def test_permutations_are_one_to_one(spark):
    n = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    assert n.select(pii.permute_symbols(F.col("s"), pii.DIGITS, "k", "t").alias("p")).distinct().count() == 1000
    pairs = spark.range(7 * 30).select(pii.permute_pair(F.floor(F.col("id") / 30), F.col("id") % 30, 7, 30, "k", "t").alias("p"))
    assert pairs.distinct().count() == 210 and pairs.where("p.l >= 7 or p.r >= 30 or p.l < 0 or p.r < 0").count() == 0
    days = spark.range(-25567, 47482, 9).select(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    made = days.select("v", pii._date(F.col("v"), "k").alias("p"))
    assert made.where("p is null").count() == 0 and made.select("p").distinct().count() == days.count()


def test_nulls_empty_and_plain_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "no data"), (3, "no data"), (4, "x" * 100000 + " 1.2 " + CARD), (None, "1" * 50 + "@")], "doc_id long, text string")
    rows = sorted(map(tuple, pii.pseudonymise(docs, KEY).collect()), key=repr)
    assert len(rows) == 6 and (1, None, 0, 0, "") in rows and (2, "", 0, 0, "") in rows and rows.count((3, "no data", 0, 0, "")) == 2
    assert pii.pseudonymise(docs.limit(0), KEY).count() == 0


def test_timestamps_and_other_layouts(spark):
    dates = ["1987-02-28T10:00:00Z", "1987/02/28", "1987/2/28", "1987-02-28"]
    phones = ["+31 20 123 4567", "+49 30 1234567", "020-1234567", "5551234567", "+31201234567", "0031 20 123 4567", "(020) 123 4567", "06 12 34 56 78", "+44 (0)20 7946 0958", "030/1234567", "+1 (017) 555-7713", "555-123-4567"]
    kept = ["1987-02-28Z1", "1987/13/28", "2.0123456789", "0.123456789", "1700000000", "12 345", "007", "+12"]
    texts = [f"on {v}, then" for v in dates + phones + kept]
    got = [r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    for r, text in zip(got, texts, strict=True):
        kind = "date" if text[3:-6] in dates else "phone" if text[3:-6] in phones else ""
        assert r["kinds"] == kind and (r["text"] == text) == (kind == ""), (text, r)
        assert re.sub(r"\d", "9", r["text"]).replace("9/9/", "9/99/") == re.sub(r"\d", "9", text).replace("9/9/", "9/99/"), (text, r)
    plain = lambda k: re.sub(r"\D", "", got[len(dates) + k]["text"])
    assert plain(0) == plain(4) and plain(0)[:2] == "31" and plain(2) == plain(6)
    day = lambda r: re.search(r"\d{4}.\d\d.\d\d", r["text"])[0].replace("/", "-")
    assert len({day(r) for r in got[:4]}) == 1 and got[0]["text"].endswith("T10:00:00Z, then")


def test_capitals_stay_where_letters_are(spark):
    values = ["Anna.Smith@Example.org", "anna.smith@Example.org", "ANNA.SMITH@Example.org", "DEADBEEF" * 5]
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    got = [r["text"] for r in pii.pseudonymise(rows, KEY).orderBy("doc_id").collect()]
    assert len({x.lower() for x in got[:3]}) == 1 and got[1] == got[0].lower().replace("example", "Example")
    for value, text in zip(values, got, strict=True):
        assert len(text) == len(value) and (text != value or "@" not in value)
        for a, b in zip(value.split("@")[0], text.split("@")[0], strict=True):
            assert not b.isalpha() or not a.isalnum() or b.isupper() == a.isupper() or a.isdigit()


# an independent version, over plain Python values


def digest(key, *parts):
    return hmac.new(key.encode(), "\x1f".join(map(str, parts)).encode(), hashlib.sha256).hexdigest()


def symbols(text, alphabet, key, tweak):
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for k in range(1, pii.ROUNDS + 1):
        pad = "".join(digest(key, tweak, k, len(text), n, right) for n in range(max(1, -(-len(left) // 16))))
        moved = "".join(alphabet[(alphabet.index(c) + int(pad[4 * i : 4 * i + 4], 16)) % len(alphabet)] for i, c in enumerate(left))
        left, right = right, moved
    return left + right


def pair(left, right, a, b, key, tweak):
    for k in range(1, pii.ROUNDS + 1):
        left, right = right, (left + int(digest(key, tweak, k, right)[:12], 16)) % (a if k % 2 else b)
    return left, right


def put(value, made, inside):
    made = iter(made)
    return "".join(next(made) if re.match(inside, c) else c for c in value)


def plain(kind, v, key):
    digits = re.sub("[^0-9]", "", v)
    if kind == "secret":
        return symbols(v, pii.HEX, key, "secret")
    if kind == "email":
        name, _, domain = v.partition("@")
        return put(name, symbols(re.sub("[^0-9a-z]", "", name), pii.ALNUM, key, "email"), "[0-9a-z]") + "@" + domain
    if kind == "card":
        body = symbols(digits[:-1], pii.DIGITS, key, "card")
        return put(v, next(body + c for c in "0123456789" if luhn(body + c)), "[0-9]")
    if kind == "phone":
        head = re.match(r"(?:\+31 )?", v)[0]
        return head + put(v[len(head) :], symbols(re.sub("[^0-9]", "", v[len(head) :]), pii.DIGITS, key, "phone"), "[0-9]")
    if kind == "ipv4":
        a, b, c, d = map(int, v.split("."))
        x, y = pair(a * 256 + b, c * 256 + d, 65536, 65536, key, "ipv4")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if kind == "ssn":
        areas = [x for x in range(1, 900) if x != 666]
        a, g, s = map(int, v.split("-"))
        x, y = pair(areas.index(a) * 99 + g - 1, s - 1, 898 * 99, 9999, key, "ssn")
        return f"{areas[x // 99]:03}-{x % 99 + 1:02}-{y + 1:04}"
    day = datetime.date.fromisoformat(v)
    if (day.month, day.day) == (2, 29):
        x, y = pair((day.year - 1904) // 4 // 7, (day.year - 1904) // 4 % 7, 7, 7, key, "leap day")
        return f"{1904 + 4 * (7 * x + y)}-02-29"
    first = datetime.date(2001, 1, 1)
    x, y = pair(day.year - 1900, (day.replace(year=2001) - first).days, 200, 365, key, "date")
    return (first + datetime.timedelta(y)).replace(year=1900 + x).isoformat()


def drawn(kind, draw):
    some = lambda alphabet, n: "".join(draw.choice(alphabet) for _ in range(n))
    if kind == "secret":
        return some(pii.HEX, draw.randint(32, 64))
    if kind == "email":
        return some(pii.ALNUM, draw.randint(1, 60)) + draw.choice(["", "._-"]) + some("abc", 1) + "@mail.example.com"
    if kind == "card":
        body = some("123456789", 1) + some(pii.DIGITS, draw.choice([11, 14, 17]))
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "phone":
        return f"+31 20 {some(pii.DIGITS, 3)} {some(pii.DIGITS, 5)}"
    if kind == "ipv4":
        return ".".join(str(draw.randrange(256)) for _ in range(4))
    if kind == "ssn":
        return f"{draw.choice([*range(1, 666), *range(667, 900)]):03}-{draw.randint(1, 99):02}-{draw.randint(1, 9999):04}"
    return draw.choice([datetime.date(1900 + 4 * draw.randint(1, 49), 2, 29), datetime.date(1900, 1, 1) + datetime.timedelta(draw.randrange(73000))]).isoformat()


@pytest.mark.parametrize("key", [KEY, "k" * 100])
def test_all_kinds_equal_an_independent_version(spark, key):
    draw = random.Random(3)
    values = [(kind, drawn(kind, draw)) for kind in pii.PATTERNS for _ in range(25)]
    docs = spark.createDataFrame([(k, f"on {v} , then") for k, (_, v) in enumerate(values)], "doc_id long, text string")
    got = [r for r in pii.pseudonymise(docs, key).orderBy("doc_id").collect()]
    for r, (kind, v) in zip(got, values, strict=True):
        assert (r["kinds"], r["text"]) == (kind, f"on {plain(kind, v, key)} , then"), v


def test_no_difference_of_symbols_survives(spark):
    """For each length, how often two symbols of a half are as far apart as before is what chance gives."""
    draw = random.Random(4)
    values = [(n, "".join(draw.choice(pii.HEX) for _ in range(n))) for n in range(2, 65) for _ in range(160)]
    df = spark.createDataFrame(values, "n int, s string")
    for key in (KEY, "another"):
        kept = {}
        for n, s, made in df.select("n", "s", pii.permute_symbols(F.col("s"), pii.HEX, key, "t").alias("p")).collect():
            x, y = [int(c, 16) for c in s], [int(c, 16) for c in made]
            for a in range(n):
                for b in range(a + 1, n):
                    for sign in (1, -1):
                        hits = kept.setdefault((b - a, sign), [0, 0])
                        hits[0] += (x[b] + sign * x[a] - y[b] - sign * y[a]) % 16 == 0
                        hits[1] += 1
        for (gap, sign), (same, of) in kept.items():
            assert abs(same - of / 16) < 6 * (of / 16) ** 0.5 + 3, (gap, sign, same, of)


def test_a_key_is_required(spark):
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([(1, CARD)], "doc_id long, text string"), "")
