import pandas as pd
from pyspark.sql import functions as F

from weftline.functions import numbers as N

UNITS = "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
TENS = {20: "vingt", 30: "trente", 40: "quarante", 50: "cinquante", 60: "soixante", 80: "quatre-vingt"}


def below_hundred(n):
    if n < 20:
        return UNITS[n]
    base = max(t for t in TENS if t <= n)
    rest = n - base
    if rest == 0:
        return TENS[base] + ("s" if base == 80 else "")
    joint = " et " if rest in (1, 11) and base != 80 else "-"
    return TENS[base] + joint + UNITS[rest]


def below_thousand(n):
    h, rest = divmod(n, 100)
    if not h:
        return below_hundred(rest)
    head = "cent" if h == 1 else f"{UNITS[h]} cent" + ("s" if not rest else "")
    return head + (f" {below_hundred(rest)}" if rest else "")


def spelled(n):
    if n == 0:
        return "zéro"
    parts = []
    for size, name in ((10**9, "milliard"), (10**6, "million")):
        if n >= size:
            parts.append(f"{spelled(n // size)} {name}" + ("s" if n // size > 1 else ""))
            n %= size
    if n >= 1000:
        parts.append("mille" if n // 1000 == 1 else f"{below_thousand(n // 1000)} mille")
        n %= 1000
    return " ".join([*parts, below_thousand(n)] if n else parts)


def test_all_numbers_to_a_million(spark):
    some = [*range(0, 20_001), *range(20_001, 1_000_001, 7), *range(10**6, 4 * 10**9, 7_654_321)]
    frame = spark.createDataFrame(pd.DataFrame({"n": some, "text": [spelled(n) for n in some]})).repartition(8)
    wrong = frame.withColumn("got", N.word_values(F.col("text"))).filter((F.size("got") != 1) | (F.get("got", F.lit(0)) != F.col("n")))
    assert wrong.count() == 0, wrong.take(5)


def test_numbers_end_where_the_grammar_says(spark):
    cases = {
        "trois quatre": [3, 4], "vingt et deux": [20, 2], "vingt et un et une": [21, 1], "pendant trois mois après quatre-vingt-dix-sept mille ans": [3, 97000], "dix six": [10, 6], "cent et un": [100, 1], "mille mille": [1000, 1000], "deux mille dix et le reste": [2010],
        "soixante-quinze, seize": [75, 16], "": [], "et": [], "un million deux cents": [1_000_200], "zéro un": [0, 1], "cent cent": [100, 100], "Première et deuxième": [1], "quatre vingt": [80], "cent quatre-vingts": [180],
    }
    frame = spark.createDataFrame([(k, v) for k, v in cases.items()], "text string, want array<long>")
    for r in frame.withColumn("got", N.word_values(F.col("text"))).collect():
        assert r.got == r.want, (r.text, r.got)


def test_unsourced(spark):
    cases = [("3 mois, 97 000 euros et 012", "trois mois, quatre-vingt-dix-sept mille euros, article 12", []), ("86-83", "86 83", []), ("5 et 6", "cinq", ["6"]), ("12 000", "12 puis 000", []), ("12 500", "12 euros", ["12500"]), (None, "x", None), ("7", None, None), ("aucun", "", []), ("7 7 07", "", ["7"])]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, s string, want array<string>")
    for r in frame.withColumn("got", N.unsourced(F.col("a"), F.col("s"))).collect():
        assert (r.got or []) == (r.want or []) or r.a is None or r.s is None, (r.a, r.got)


def test_gate_on_the_table(spark):
    import re

    from weftline.plans import registry

    sf = "/root/testdata/sf0.001"
    turns = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    spelled_out = {"quatre-vingt-dix-sept mille": "97000", "deux cent trois": "203", "soixante et onze": "71"}
    fold = str.maketrans("àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc")
    got = {(r.conv_id, r.turn): (r.unsourced, r.accepted) for r in registry.queries()["number_words_gate"](spark, sf).collect()}
    seen = 0
    for (conv, turn), r in turns.items():
        answer = turns.get((conv, turn + 1))
        if r.role != "user" or answer is None or answer.role != "assistant":
            continue
        phrase = list(spelled_out)[conv % 3]
        words = re.findall("[a-z0-9]+", (r.text or "").lower().translate(fold))
        known = {str(int(x)) for x in re.findall("[0-9]+", r.text or "")} | {str(N.WORDS[w]) for w in words if w in N.WORDS} | {spelled_out[phrase]} | {str(int(re.sub("[^0-9]", "", x))) for x in re.findall(N.FIGURES, r.text or "")}
        known |= {str(N.WORDS[w]) for w in re.findall("[a-z]+", phrase) if w in N.WORDS}
        value = int(spelled_out[phrase]) + turn % 4
        said = re.findall(N.FIGURES, f"{answer.text or ''} soit {value}")
        want = {str(int(re.sub("[^0-9]", "", x))) for x in said if str(int(re.sub("[^0-9]", "", x))) not in known and not all(str(int(g)) in known for g in re.findall("[0-9]+", x))}
        assert set(got[conv, turn][0]) == want and got[conv, turn][1] == (not want and len(f"{answer.text or ''} soit {value}") >= 80), (conv, turn)
        seen += 1
    assert seen == len(got) > 5
