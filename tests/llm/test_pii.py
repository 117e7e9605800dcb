"""Pseudonyms against a plain-Python twin, on long awkward texts, on clashing names and empty tables."""

import datetime
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from weftline.llm import pii

KEY = "a key of tests"


def prf(tag, step, x):
    return int(hashlib.sha256(f"{KEY}|{tag}|{step}|{x}".encode()).hexdigest()[:15], 16)


def network(a, b, left, right, tag):
    for i in range(6):
        if i % 2 == 0:
            a = (a + prf(tag, i, b) % left) % left
        else:
            b = (b + prf(tag, i, a) % right) % right
    return a, b


def digits(d, tag):
    if not d:
        return d
    high, low = -(-len(d) // 2), len(d) // 2
    a, b = network(int(d[:high]), int(d[high:] or 0), 10**high, 10**low, tag)
    return str(a).zfill(high) + (str(b).zfill(low) if low else "")


def letters(s, tag):
    def number(t):
        n = 0
        for c in t:
            n = n * 26 + ord(c) - 65
        return n

    def text(n, k):
        return "".join(chr(65 + n // 26**i % 26) for i in range(k - 1, -1, -1))

    high, low = -(-len(s) // 2), len(s) // 2
    a, b = network(number(s[:high]), number(s[high:]), 26**high, 26**low, tag)
    return text(a, high) + text(b, low)


def fill(form, d, s=""):
    d, s = iter(d), iter(s)
    return "".join(next(d) if "0" <= c <= "9" else next(s) if "A" <= c <= "Z" and s is not None else c for c in form)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def walk(x, valid, left, right, tag):
    def step(y):
        a, b = network(y // right, y % right, left, right, tag)
        return a * right + b

    y = step(x)
    while not valid(y):
        y = step(y)
    return y


def only_digits(s):
    return re.sub("[^0-9]", "", s)


def keep_letters(form, d):
    d = iter(d)
    return "".join(next(d) if "0" <= c <= "9" else c for c in form)


def card(m):
    d = only_digits(m)
    if luhn(d) or not 13 <= len(d) <= 19:
        return None
    p = digits(d[:-1], "card")
    return keep_letters(m, p + str(-luhn(p + "0") % 10))


def iban(m):
    s = m.replace(" ", "")
    if mod97(s) != 1 or not 15 <= len(s) <= 34:
        return None
    body = s[4:]
    d = digits(only_digits(body), "iban" + s[:2])
    old = re.sub("[^A-Z]", "", body)
    t = (letters(old[:26], f"iban{s[:2]}{d}") if old else "") + (letters(old[26:], f"iban2{s[:2]}{d}") if old[26:] else "")
    check = str(98 - mod97(s[:2] + "00" + fill(body, d, t))).zfill(2)
    return s[:2] + fill(m[2:], check + d, t)


def phone(m):
    if not 8 <= len(only_digits(m)) <= 15:
        return None
    country = (re.match(r"\+[0-9]+", m) or [""])[0]
    if len(only_digits(m[len(country) :])) < 6:
        country = m[:2]
    rest = m[len(country) :]
    return country + keep_letters(rest, digits(only_digits(rest), "phone"))


def ssn(m):
    ok = lambda x: 1 <= x // 10**6 <= 899 and x // 10**6 != 666 and x // 10**4 % 100 and x % 10**4
    x = int(only_digits(m))
    return keep_letters(m, str(walk(x, ok, 10**5, 10**4, "ssn")).zfill(9)) if ok(x) else None


def ipv4(m):
    o = [int(x) for x in m.split(".")]
    if max(o) > 255:
        return None
    a, b = network(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ipv4")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def date(m):
    forms = ["%Y-%m-%d"] if "-" in m else ["%d.%m.%Y"] if "." in m else ["%d/%m/%Y", "%m/%d/%Y"]
    if len({c for c in m if not c.isdigit()}) > 1:
        return None
    start = datetime.date(1900, 1, 1)
    for form in forms:
        try:
            n = (datetime.datetime.strptime(m, form).date() - start).days
        except ValueError:
            continue
        late = form == "%m/%d/%Y"  # only dates that can't be read day first
        return (start + datetime.timedelta(walk(n, lambda x: x < 73049 and (not late or (start + datetime.timedelta(x)).day > 12), 271, 270, "date"))).strftime(form)
    return None


def sha(kind, s, n):
    return hashlib.sha256(f"{KEY}|{kind}|{s}".encode()).hexdigest()[:n]


def email(m):
    before = re.match(r"[._%+\-]*", m)[0]
    address = m[len(before) :].lower()
    host = address.split("@")[1]
    name, end = host.rsplit(".", 1)
    return f"{before}u{sha('local', address, 20)}@h{sha('host', name, 20)}.{end}"


def secret(m):
    value = re.search('"(.*)"', m)[1]
    mask = sha("secret0", value, 64) + sha("secret1", value, 64)
    return m.split('"')[0] + '"' + (mask * (len(value) // len(mask) + 1))[: len(value)] + '"'


TWINS = {"secret": secret, "email": email, "iban": iban, "date": date, "ssn": ssn, "ipv4": ipv4, "phone": phone, "card": card}
ANY = re.compile(pii.ANY, re.ASCII)


def twin(text):
    if text is None:
        return None, []
    kinds = []

    def one(m):
        for name, make in TWINS.items():
            if re.fullmatch(pii.PATTERNS[name], m[0], re.ASCII):
                new = make(m[0])
                if new is not None:
                    kinds.append(name)
                return m[0] if new is None else new
        return m[0]

    return ANY.sub(one, text), kinds


def iban_of(country, body):
    return f"{country}{98 - mod97(country + '00' + body):02d}{body}"


def values(rng):
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    c = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    pay = n(rng.randint(12, 18))
    body = rng.choice([n(18), n(23), n(26), c(18), "MTLCASTS" + n(15), c(30), "WEST" + n(14)])
    spaced = lambda s: " ".join(s[i : i + 4] for i in range(0, len(s), 4))
    made = iban_of(rng.choice(["FR", "MT", "GB", "DE"]), body)
    return rng.choice([
        pay + str(-luhn(pay + "0") % 10), spaced("4845168114407329"), made, spaced(made), f"+{rng.randint(1, 99)} ({n(3)}) {n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"+49{n(9)}",
        f"{n(3)}-{n(2)}-{n(4)}", f"{rng.randint(0, 280)}.{rng.randint(0, 255)}.1.{rng.randint(0, 255)}", f"19{n(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 31)}", f"{rng.randint(10, 31)}.1{rng.randint(0, 3)}.20{n(2)}",
        f"{rng.randint(10, 31)}/{rng.randint(10, 31)}/19{n(2)}", f"{rng.choice(['', '-', '._'])}Joe.{n(2)}@Mail{n(1)}.example.co.uk", f"{'a' * 90}@x.io", f'Token = "{c(16)}{c(rng.randint(0, 200))}"', f'key="{c(12)}"', "plain words", n(30), "12", "@", '"',
    ])


def test_twin(spark):
    rng = random.Random(5)
    texts = [None, "", "x"] + [rng.choice([" ", ", ", " - ", "; "]).join(values(rng) for _ in range(rng.randint(1, 8))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.text, r.pii_kinds) for r in pii.pseudonymise(df, KEY).collect()}
    seen = set()
    for i, t in enumerate(texts):
        assert got[i] == twin(t), t
        seen |= set(got[i][1])
    assert seen == set(TWINS)


def test_all_of_a_long_account_changes(spark):
    text = "FR7630006000011234567890189 and MT84MALT011000012345MTLCAST001S"
    new = pii.pseudonymise(spark.createDataFrame([(text,)], "text string"), KEY).first().text
    for kept in ("30006", "MTLCAST", "MALT", "0110"):
        assert kept not in new


@pytest.mark.parametrize("unit", ["a", "1", "a.", "-234", "x@", "@", "1.", '"', "key=", "A1B2 ", "4845 ", "1984-", "(1", "%", "é1"])
def test_two_megabytes(spark, unit):
    """Awkward texts end in seconds: runs of one kind, a local part without a host, a host without an end."""
    run = unit * (2_000_000 // len(unit))
    texts = [run, "+1" + run, "x@" + run + "com", run + "@", 'key="' + run]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    start = time.time()
    assert len(pii.pseudonymise(df, KEY).select(F.length("text")).collect()) == len(texts)
    assert time.time() - start < 40


def test_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "1.2.3.4", "mine", 5, "k", 9)], "doc_id long, text string, pii_kinds string, __found int, __key string, `a.b` int")
    out = pii.pseudonymise(df, KEY)
    assert out.columns == [*df.columns, "pii_kinds_1"]
    row = out.first()
    assert (row.doc_id, row.pii_kinds, row["__found"], row["__key"], row["a.b"], row.pii_kinds_1) == (1, "mine", 5, "k", 9, ["ipv4"])
    empty = pii.pseudonymise(df.limit(0), KEY)
    assert empty.columns == out.columns and empty.count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "")


def test_key_stays_out_of_plans(spark):
    out = pii.pseudonymise(spark.createDataFrame([("1.2.3.4",)], "text string"), KEY)
    for mode in ("simpleString", "extended", "formatted"):
        assert KEY not in out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString({"simpleString": "simple"}.get(mode, mode)))
    other = pii.pseudonymise(spark.createDataFrame([("1.2.3.4",)], "text string"), "other")
    assert other.first().text != out.first().text == ipv4("1.2.3.4")


def test_dates_are_permuted_in_each_form(spark):
    start, last = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
    days = [start + datetime.timedelta(i) for i in range((last - start).days + 1)]
    for separator, forms in [("-", ["%Y-%m-%d"]), (".", ["%d.%m.%Y"]), ("/", ["%d/%m/%Y", "%m/%d/%Y"])]:
        written = sorted({d.strftime(f) for d in days for f in forms})
        out = pii.pseudonymise(spark.createDataFrame([(i, s) for i, s in enumerate(written)], "doc_id long, text string").repartition(4), KEY).collect()
        texts = [r["text"] for r in out]
        assert len(set(texts)) == len(written) and set(texts) <= set(written), separator
        assert all(r["pii_kinds"] == ["date"] for r in out)
