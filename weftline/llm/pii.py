"""Format-preserving pseudonyms for personal data by Feistel networks.

Numbers and dates that pass their format's own check are permuted by a keyed Feistel network within that format, so that the
pseudonym has the same shape, passes the same check, and equal values get equal pseudonyms in all documents:

- card numbers (13 to 19 digits, Luhn): the payload is permuted, the check digit follows from it;
- IBANs (mod 97): the country stays, all digits of the account and all its letters are permuted, the check digits follow;
- telephone numbers (with a + or in groups; 8 to 15 digits): the digits are permuted, a country code after + stays;
- social security numbers (ddd-dd-dddd, area, group and serial in range): permuted until the result is in range;
- IPv4 addresses (octets to 255): all 32 bits are permuted;
- dates from 1900-01-01 to 2099-12-31 (y-m-d, d.m.y and d/m/y): the day number is permuted within that span;
  a date with slashes is read day first if it can be, the others (month first, day beyond 12) are permuted among themselves;
- e-mail addresses and secrets (token, key or password = "..." of 16 characters and more) have no number to permute: keyed
  hashes of 80 bits take the place of the local part and of the host's name, others that of the secret's characters. A local
  part has any length, a host at most 126 labels of 63 characters and less.

Digits inside longer runs of letters or digits are left alone, and so is all other text.

DataFrame functions only; hashing is SHA-256 over key, round and half. The key has no default. It reaches the tasks as the
value of a scalar subquery, so that no plan shows it. Patterns look at a place a bounded number of times (runs of unbounded
length are entered at their start only and never left again), so that time grows with the text, however long it is.

Null text stays null and counts nothing; empty text stays empty. Rows are independent, so repeated rows and ties give equal
results; an empty table gives an empty result. Other columns pass through, whatever their names: if one is called as the
column of kinds would be, that one takes the next free name (pii_kinds_1 and so on).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 6

#: One alternative for each kind, tried in this order at each place.
PATTERNS = {
    "secret": r"(?i:token|key|secret|password)\s?[=:]\s?\"[A-Za-z0-9+/_\-]{16,}+\"",
    "email": r"(?<![A-Za-z0-9._%+\-])[._%+\-]*+[A-Za-z0-9][A-Za-z0-9._%+\-]*+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,63}\.){1,126}[A-Za-z]{2,63}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z.\-/])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
    "ipv4": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}(?:[ \-][0-9]{1,3})?)(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every match has one of these; most texts have none.
HINT = "[0-9@\"]"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def prf(key: Column, tag: Column, step: Column, x: Column) -> Column:
    """60 bits of SHA-256 as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, tag, step.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")


def network(a: Column, b: Column, left: Column, right: Column, key: Column, tag: Column) -> Column:
    """A keyed permutation of the pairs a < left, b < right (longs to 2^61): an unbalanced Feistel network of additions."""

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.when(even, F.pmod(acc["a"] + F.pmod(prf(key, tag, i, acc["b"]), left), left)).otherwise(acc["a"])
        b = F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + F.pmod(prf(key, tag, i, acc["a"]), right), right))
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), F.struct(a.alias("a"), b.alias("b")), step)


def feistel(x: Column, left: Column, right: Column, key: Column, tag: str) -> Column:
    """A keyed permutation of 0 .. left * right - 1 (all longs)."""
    b = F.pmod(x, right)
    return let(network(_div(x - b, right), b, left, right, key, F.lit(tag)), lambda o: o["a"] * right + o["b"])


def within(x: Column, valid, step) -> Column:
    """Cycle walking: step (a permutation) again and again from x until the result is valid, as x itself is.

    At most 64 times; each fails for fewer than one in two, so that the error after the last is none to be seen (below 1e-19).
    """
    walk = F.aggregate(F.array(*[F.lit(i) for i in range(63)]), step(x), lambda acc, _: F.when(valid(acc), acc).otherwise(step(acc)))
    return let(walk, lambda y: F.when(valid(y), y).otherwise(F.raise_error("cycle walking has not ended").cast("long")))


def let(x: Column, f) -> Column:
    """f(x), x being evaluated once."""
    return F.transform(F.array(x), f)[0]


def _power(base: int, most: int, n: Column) -> Column:
    """base to the power n as a long, for n to ``most``."""
    return F.element_at(F.array(*[F.expr(f"{base**i}L") for i in range(most + 1)]), n + 1)


def permute_digits(d: Column, key: Column, tag: Column) -> Column:
    """Permute a string of at most 36 digits among those of its length."""
    low, high = F.floor(F.length(d) / 2).cast("int"), F.ceil(F.length(d) / 2).cast("int")
    tail = F.when(low > 0, F.substring(d, high + 1, low).cast("long")).otherwise(F.expr("0L"))
    out = network(F.substring(d, F.lit(1), high).cast("long"), tail, _power(10, 18, high), _power(10, 18, low), key, tag)
    text = lambda o: F.concat(F.lpad(o["a"].cast("string"), high, F.lit("0")), F.when(low > 0, F.lpad(o["b"].cast("string"), low, F.lit("0"))).otherwise(""))
    return F.when(F.length(d) == 0, d).otherwise(let(out, text))


def permute_letters(s: Column, key: Column, tag: Column) -> Column:
    """Permute a string of at most 26 letters A-Z among those of its length."""
    low, high = F.floor(F.length(s) / 2).cast("int"), F.ceil(F.length(s) / 2).cast("int")
    number = lambda t: F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), F.expr("0L"), lambda acc, c: acc * 26 + (F.ascii(c) - 65).cast("long"))
    letters = lambda x, n: F.when(n > 0, F.array_join(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: F.char(F.pmod(_div(x, _power(26, 13, i)), F.lit(26)) + 65)), "")).otherwise("")
    out = network(number(F.substring(s, F.lit(1), high)), number(F.substring(s, high + 1, low)), _power(26, 13, high), _power(26, 13, low), key, tag)
    return F.when(F.length(s) == 0, s).otherwise(let(out, lambda o: F.concat(letters(o["a"], high), letters(o["b"], low))))


def fill(form: Column, digits: Column, letters: Column | None = None) -> Column:
    """form with its digits replaced by those of ``digits``, in order, and its letters A-Z by those of ``letters``."""

    def step(acc: Column, c: Column) -> Column:
        is_digit, is_letter = c.between("0", "9"), c.between("A", "Z") if letters is not None else F.lit(False)
        put = F.when(is_digit, F.substring(digits, acc["k"], F.lit(1)))
        put = put.when(is_letter, F.substring(letters, acc["j"], F.lit(1))) if letters is not None else put
        return F.struct(F.concat(acc["s"], put.otherwise(c)).alias("s"), (acc["k"] + is_digit.cast("int")).alias("k"), (acc["j"] + is_letter.cast("int")).alias("j"))

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k"), F.lit(1).alias("j")), step, lambda acc: acc["s"])


def luhn(d: Column) -> Column:
    """The Luhn sum mod 10 of a string of digits."""

    def step(acc: Column, c: Column) -> Column:
        n = c.cast("int") * (acc["k"] + 1)
        return F.struct((acc["s"] + F.when(n > 9, n - 9).otherwise(n)).alias("s"), (1 - acc["k"]).alias("k"))

    return F.aggregate(F.split(F.reverse(d), ""), F.struct(F.lit(0).alias("s"), F.lit(0).alias("k")), step, lambda acc: acc["s"] % 10)


def mod97(s: Column) -> Column:
    """An IBAN without blanks, its first four characters moved to the end and letters as 10 to 35, mod 97."""
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _card(m: Column, key: Column) -> Column:
    d = _digits(m)
    payload = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, F.lit("card"))
    check = F.pmod(10 - luhn(F.concat(payload, F.lit("0"))), F.lit(10)).cast("string")
    return F.when((luhn(d) == 0) & F.length(d).between(13, 19), fill(m, F.concat(payload, check)))


def _iban(m: Column, key: Column) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    body, country = F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 2)
    old = F.regexp_replace(body, "[^A-Z]", "")

    def letters(digits: Column) -> Column:
        first = permute_letters(F.substring(old, 1, 26), key, F.concat(F.lit("iban"), country, digits))
        return F.concat(first, permute_letters(F.substring(old, F.lit(27), F.length(old)), key, F.concat(F.lit("iban2"), country, digits)))

    def whole(p: Column) -> Column:
        check = F.lpad((98 - mod97(F.concat(country, F.lit("00"), fill(body, p["digits"], p["letters"])))).cast("string"), 2, "0")
        return F.concat(country, fill(F.substring(m, F.lit(3), F.length(m)), F.concat(check, p["digits"]), p["letters"]))

    parts = let(permute_digits(_digits(body), key, F.concat(F.lit("iban"), country)), lambda d: F.struct(d.alias("digits"), letters(d).alias("letters")))
    return F.when((mod97(s) == 1) & F.length(s).between(15, 34), let(parts, whole))


def _phone(m: Column, key: Column) -> Column:
    country = F.regexp_extract(m, "^\\+[0-9]+", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    whole = F.length(_digits(rest)) < 6  # a + and digits in one run: the first is the country
    country = F.when(whole, F.substring(m, 1, 2)).otherwise(country)
    rest = F.when(whole, F.substring(m, F.lit(3), F.length(m))).otherwise(rest)
    return F.when(F.length(_digits(m)).between(8, 15), F.concat(country, fill(rest, permute_digits(_digits(rest), key, F.lit("phone")))))


def _ssn_ok(x: Column) -> Column:
    area, group, serial = _div(x, F.expr("1000000L")), F.pmod(_div(x, F.expr("10000L")), F.lit(100)), F.pmod(x, F.expr("10000L"))
    return area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)


def _ssn(m: Column, key: Column) -> Column:
    x = _digits(m).cast("long")
    new = within(x, _ssn_ok, lambda y: feistel(y, F.expr("100000L"), F.expr("10000L"), key, "ssn"))
    return F.when(_ssn_ok(x), fill(m, F.lpad(new.cast("string"), 9, "0")))


def _ipv4(m: Column, key: Column) -> Column:
    octets = F.transform(F.split(m, "\\."), lambda o: o.cast("long"))
    x = F.aggregate(octets, F.expr("0L"), lambda acc, o: acc * 256 + o)
    new = feistel(x, F.expr("65536L"), F.expr("65536L"), key, "ipv4")
    parts = [F.pmod(_div(new, F.expr(f"{256 ** i}L")), F.lit(256)).cast("string") for i in (3, 2, 1, 0)]
    return F.when(F.forall(octets, lambda o: o <= 255), F.concat_ws(".", *parts))


DAYS = 73_049  # 1900-01-01 to 2099-12-31


def _date(m: Column, key: Column) -> Column:
    first = F.lit("1900-01-01").cast("date")
    any_day = lambda x: x < DAYS
    # What can be read day first is; a month-first date is one of a day beyond 12, and stays among those.
    late_day = lambda x: any_day(x) & (F.dayofmonth(F.date_add(first, x.cast("int"))) > 12)
    forms = [("^[0-9]{4}-", "yyyy-MM-dd", any_day), ("\\.", "dd.MM.yyyy", any_day), ("/", "dd/MM/yyyy", any_day), ("/", "MM/dd/yyyy", late_day)]
    out = []
    for test, form, valid in forms:
        day = F.datediff(F.try_to_date(m, form), first).cast("long")
        new = within(day, valid, lambda y: feistel(y, F.expr("271L"), F.expr("270L"), key, "date"))
        out.append(F.when(m.rlike(test) & day.isNotNull(), F.date_format(F.date_add(first, new.cast("int")), form)))
    return F.coalesce(*out)


def _email(m: Column, key: Column) -> Column:
    before = F.regexp_extract(m, "^[._%+\\-]*", 0)
    address = F.lower(F.substring(m, F.length(before) + 1, F.length(m)))
    host = F.split_part(address, F.lit("@"), F.lit(2))
    name = F.regexp_replace(host, "\\.[a-z]+$", "")
    tag = lambda kind, s: F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), s), 256), 1, 20)
    return F.concat(before, F.lit("u"), tag("local", address), F.lit("@h"), tag("host", name), F.regexp_extract(host, "\\.[a-z]+$", 0))


def _secret(m: Column, key: Column) -> Column:
    value = F.regexp_extract(m, "\"(.*)\"", 1)
    mask = F.concat(*[F.sha2(F.concat_ws("|", key, F.lit(f"secret{i}"), value), 256) for i in range(2)])
    return F.concat(F.substring_index(m, '"', 1), F.lit('"'), F.rpad(mask, F.length(value), mask), F.lit('"'))


KINDS = {"secret": _secret, "email": _email, "iban": _iban, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "phone": _phone, "card": _card}


def pseudonym(m: Column, key: Column) -> Column:
    """struct<kind, text> of one match; kind is null (and the text as it was) if the value fails its check."""

    def found(name: str):
        return lambda new: F.struct(F.when(new.isNotNull(), F.lit(name)).alias("kind"), F.coalesce(new, m).alias("text"))

    out = F
    for name, make in KINDS.items():
        out = out.when(m.rlike(f"^(?:{PATTERNS[name]})$"), let(make(m, key), found(name)))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text")))


def free_name(docs: DataFrame, name: str) -> str:
    """name, or name_1, name_2, ...: the first that no column of docs has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in [name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))] if n.lower() not in taken)


def session_key(spark: SparkSession) -> str:
    """The key in spark.weftline.pii.secret, else a new random one: pseudonyms of different runs are then not linked."""
    return spark.conf.get("spark.weftline.pii.secret", None) or secrets.token_hex(32)


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with ``column`` pseudonymised, and pii_kinds: the kinds replaced, one entry each, in order (empty if none)."""
    if not key:
        raise ValueError("pseudonyms need a key")
    kinds, found, secret = (free_name(docs, n) for n in ("pii_kinds", "__found", "__key"))
    q = lambda name: F.col(f"`{name}`")
    text = q(column)
    work = docs.withColumn(secret, docs.sparkSession.sql("SELECT col1 FROM VALUES (:key)", {"key": key}).scalar())
    work = work.withColumn(found, F.when(text.rlike(HINT), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, q(secret)))))
    some = F.size(q(found)) > 0
    pieces = F.zip_with(F.split(text, ANY, -1), F.concat(F.transform(q(found), lambda r: r["text"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    said = F.when(some, F.filter(F.transform(q(found), lambda r: r["kind"]), lambda k: k.isNotNull())).otherwise(F.array().cast("array<string>"))
    changed = F.when(some, F.array_join(pieces, "")).otherwise(text)
    return work.select(*[(changed if c == column else q(c)).alias(c) for c in docs.columns], said.alias(kinds))
