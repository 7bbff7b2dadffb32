"""Pseudonyms against a second version that handles one text after another in plain Python."""

import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F
from test_pii import luhn, run

from tempograin.llm import pii

KEY = "k"
DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DAY = datetime.date(1800, 1, 1)


def stream(tweak, step, half):
    return hashlib.sha256(f"{KEY}|{tweak}|{step}|{half}".encode()).hexdigest()


def network(value, tweak, classes=(DIGITS, UPPER.lower(), UPPER)):
    a, b = value[:len(value) // 2], value[len(value) // 2:]
    for step in range(8):
        signs, moved = stream(tweak, step, b), ""
        for i, c in enumerate(a):
            kind = next((k for k in classes if c in k), None)
            moved += c if kind is None else kind[(kind.index(c) + int(signs[i % 16 * 4:][:4], 16)) % len(kind)]
        a, b = b, moved
    return a + b


def pair(a, b, sizes, tweak):
    for step in range(8):
        by = int(stream(tweak, step, a if step % 2 else b)[:12], 16)
        a, b = (a, (b + by) % sizes[1]) if step % 2 else ((a + by) % sizes[0], b)
    return a, b


def refill(form, signs, kind=r"\d"):
    rest = iter(signs)
    return re.sub(kind, lambda _: next(rest), form, flags=re.ASCII)


def digits(form):
    return re.sub(r"[^0-9]", "", form)


def card(value):
    for form in [value] + [value[:19]] * bool(re.fullmatch(r"(?:\d{4}[ -]){4}\d{3}", value, re.ASCII)):
        if 13 <= len(digits(form)) <= 19 and luhn(digits(form)):
            new = network(digits(form)[:-1], "card", (DIGITS,))
            return refill(form, new + next(d for d in DIGITS if luhn(new + d))) + value[len(form):]


def phone(value):
    plus = value.startswith("+")
    form = value.replace("(0)", "()") if plus else value
    number = digits(form)
    if 9 <= len(number) <= 15:
        code = next((c for c in pii.CALLING_CODES.split() if number.startswith(c)), number[:3]) if plus else ""
        new = refill(form, code + network(number[len(code):], "phone" + code, (DIGITS,)))
        return new.replace("()", "(0)")


def ip(value):
    o = [int(x) for x in value.split(".")]
    a, b = pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def date(value):
    form = "%Y-%m-%d" if "-" in value else "%d/%m/%Y"
    try:
        n = (datetime.datetime.strptime(value, form).date() - DAY).days
    except ValueError:
        return None
    if 0 <= n < 189 * 773:
        a, b = pair(n // 773, n % 773, (189, 773), "date")
        return (DAY + datetime.timedelta(days=a * 773 + b)).strftime(form)


def remainder(plain):
    return int("".join(str(int(c, 36)) for c in plain)) % 97


def iban(value):
    plain = re.sub("[ -]", "", value)
    if remainder(plain[4:] + plain[:4]) == 1:
        account = network(plain[4:], "iban" + plain[:2], (DIGITS, UPPER))
        return refill(value, f"{plain[:2]}{98 - remainder(account + plain[:2] + '00'):02d}{account}", "[A-Z0-9]")


def secret(value):
    letters = (DIGITS, "abcdef", "ABCDEF")
    if len(value) <= 128:
        return network(value, "secret", letters)
    return "".join(network(value[i:i + 64], f"secret{i // 64}", letters) for i in range(0, len(value), 64))


def national_id(value):
    areas = [a for a in range(1, 900) if a != 666]
    a, g, s = (int(x) for x in value.split("-"))
    x, y = pair(areas.index(a) * 99 + g - 1, s - 1, (898 * 99, 9999), "national_id")
    return f"{areas[x // 99]:03d}-{x % 99 + 1:02d}-{y + 1:04d}"


def service_key(value):
    start = next(k for k in pii.SERVICE_KEYS if value.startswith(k))
    return start + network(value[len(start):], "service_key" + start)


def email(value):
    name, domain = value.split("@")
    return network(name, "email@" + domain) + "@" + domain


SWAPS = {"email": email, "service_key": service_key, "iban": iban, "national_id": national_id, "phone": phone, "ip": ip, "date": date,
         "card": card, "secret": secret}


def by_hand(text):
    kinds = []

    def swap(match):
        for kind, change in SWAPS.items():
            if re.fullmatch(pii.PATTERNS[kind], match[0], re.ASCII) and (new := change(match[0])) is not None:
                kinds.append(kind)
                return new
        return match[0]
    return text if text is None else re.sub(pii.ANY, swap, text, flags=re.ASCII), kinds


def drawn(rng):
    def some(signs, n):
        return "".join(rng.choice(signs) for _ in range(n))
    number = some(DIGITS, 15)
    return rng.choice([
        lambda: some("ab.1", 5) + "x@" + some("abc", 4) + ".org", lambda: number + next(d for d in DIGITS if luhn(number + d)), lambda: some(DIGITS, 16),
        lambda: f"{some(DIGITS, 3)}.{rng.randrange(300)}.{rng.randrange(300)}.7", lambda: f"{rng.randrange(1700, 2300)}-{rng.randrange(1, 14):02d}-{rng.randrange(1, 32):02d}",
        lambda: f"{rng.randrange(1, 32):02d}/{rng.randrange(1, 14):02d}/{rng.randrange(1700, 2300)}", lambda: some("0123456789abcdef", rng.choice([23, 24, 40, 200])),
        lambda: "GB82 WEST 1234 5698 7654 32", lambda: "DE89370400440532013000", lambda: "GB83WEST12345698765432", lambda: "+" + some("1234567", 2) + some(DIGITS, 9),
        lambda: f"+{rng.choice([1, 33, 44, 358, 999])} {some(DIGITS, 3)} {some(DIGITS, 3)} {some(DIGITS, 4)}", lambda: f"({some(DIGITS, 3)}) {some(DIGITS, 3)}-{some(DIGITS, 4)}",
        lambda: f"{rng.choice(['000', '666', '901', '667', '123', '899'])}-{rng.choice(['00', '45', '99'])}-{rng.choice(['0000', '6789', '9999'])}",
        lambda: "AKIA" + some(UPPER + DIGITS, rng.choice([15, 16])), lambda: "sk_live_" + some("abcXYZ019", 24), lambda: "ghp_" + some("abcXYZ019", 36),
        lambda: some("word ", 6), lambda: "é🙂"])()


def test_drawn_texts_equal_the_second_version(spark):
    rng = random.Random(3)
    texts = [rng.choice(["", "x "]) + rng.choice([" ", "; ", "\n", " (", '="']).join(drawn(rng) for _ in range(rng.randrange(7))) for _ in range(400)]
    texts += [None, "", "4111 1111 1111 1111 123 items"]
    want = [by_hand(t) for t in texts]
    assert run(spark, texts) == want
    assert {k for _, kinds in want for k in kinds} == set(pii.KINDS) == set(SWAPS)


def test_documents_equal_the_second_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: by_hand(r.text) for r in docs.collect()}
    assert {r.doc_id: (r.text, r.pii_kinds) for r in pii.pseudonymise(docs, KEY).collect()} == want
    assert sum(len(kinds) for _, kinds in want.values()) > 5


def test_printed_forms_of_a_number_stay_linked(spark):
    forms = [["+15551234567", "+1 555 123 4567", "+1 (555) 123-4567", "+1.555.123.4567"],
             ["+33612345678", "+33 6 12 34 56 78", "+33 (0)6 12 34 56 78", "+33.6.12.34.56.78"],
             ["+358401234567", "+358 40 123 4567"], ["+442071234567", "+44 20 7123 4567", "+44 (0)20 7123 4567"]]
    for same in forms:
        outs = [digits(out.replace("(0)", "")) for out, kinds in run(spark, same) if kinds == ["phone"]]
        assert len(outs) == len(same) and len(set(outs)) == 1 and outs[0] != digits(same[0]), (same, outs)


def test_national_numbers_are_one_to_one(spark):
    rows = spark.range(0, 898 * 99 * 9999, 177_773).select(
        F.floor(F.col("id") / (99 * 9999)).alias("a"), F.col("id") % 99 + 1, F.col("id") % 9999 + 1).toDF("a", "g", "s")
    ids = rows.select(F.format_string("%03d-%02d-%04d", F.when(F.col("a") >= 665, F.col("a") + 2).otherwise(F.col("a") + 1), "g", "s").alias("text"))
    out = pii.pseudonymise(ids, KEY)
    assert out.filter("pii_kinds = array('national_id')").select("text").distinct().count() == ids.distinct().count() == ids.count()
    assert out.filter(~F.col("text").rlike(pii.PATTERNS["national_id"])).count() == 0
