"""Format-preserving pseudonyms for personal data.

Validated numbers, dates and addresses are found in the text and permuted within their
format by a keyed Feistel network. Equal values become equal pseudonyms in every document,
different values stay different, and :func:`feistel` with ``inverse`` undoes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograin.llm.common import LOWER, UPPER, let, query

ROUNDS = 8
DIGITS = "0123456789"
LETTERS_AND_DIGITS = (DIGITS, LOWER, UPPER)
HEX = (DIGITS, "abcdef", "ABCDEF")
HEX_BLOCK, HEX_WHOLE = 64, 128  # hex runs of more than 128 characters are permuted by blocks
# Lengths of account numbers by country, needed where spaces do not show the end.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
PRINTED = "|".join(rf"(?:{names.replace(' ', '|')})\d{{2}}(?:[ -]?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, names in IBAN_LENGTHS.items())

# Country calling codes of one and two digits; all others have three.
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
CALLING_CODE = rf"^(?:{CALLING_CODES.replace(' ', '|')}|\d{{3}})"
# How keys of common services begin, and the signs and lengths of what follows.
SERVICE_KEYS = {"AKIA": "[A-Z0-9]{16}", "ASIA": "[A-Z0-9]{16}", "sk_live_": "[0-9A-Za-z]{16,}", "sk_test_": "[0-9A-Za-z]{16,}",
                "rk_live_": "[0-9A-Za-z]{16,}", "pk_live_": "[0-9A-Za-z]{16,}", "ghp_": "[0-9A-Za-z]{36}", "gho_": "[0-9A-Za-z]{36}",
                "ghs_": "[0-9A-Za-z]{36}", "AIza": "[0-9A-Za-z_-]{35}", "xoxb-": "[0-9A-Za-z-]{20,}", "xoxp-": "[0-9A-Za-z-]{20,}"}
KEY_SETTING = "tempograin.pseudonymKey"
SAMPLE_KEY = "tempograin"  # for the given synthetic tables; it is public, so it hides nothing in real ones

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "service_key": "(?<![0-9A-Za-z])(?:" + "|".join(a + b for a, b in SERVICE_KEYS.items()) + ")(?![0-9A-Za-z])",
    "secret": r"(?:(?<![0-9A-Za-z])|(?<=(?<![0-9A-Za-z])0[xX]))(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{24,}(?![0-9A-Za-z])",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:{PRINTED}|[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}(?![A-Za-z0-9]))",
    "national_id": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!\d|-\d)",
    # Last, what is in pairs or other groups: nine to fifteen digits after the plus.
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\(\d{3}\) ?\d{3}[.-]\d{4}(?!\d)"
             r"|\+33[ .-]?(?:\(0\)[ .-]?)?\d(?:[ .-]?\d{2}){4}(?!\d)|\+\d(?:[ .-]?\(?\d\)?){8,14}(?!\d)",
    "ip": rf"(?<!\d)(?<!\d\.){OCTET}(?:\.{OCTET}){{3}}(?!\d|\.\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "card": r"(?<!\d)(?:\d{4}[ -]){4}\d{3}(?!\d)|(?<!\d)(?:\d{4}[ -]){3}\d{1,7}(?!\d)|(?<!\d)\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)|(?<!\d)\d{13,19}(?!\d)",
}
KINDS = list(PATTERNS)
ANY = "|".join(PATTERNS.values())
# A quick look: every pattern needs one of these.
SUSPECT = r"@|\d[\d ./()-]{1,3}\d|\d[A-Fa-f]|[A-Fa-f]\d|[A-Z]\d\d|" + "|".join(SERVICE_KEYS)
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773  # 400 years are 189 * 773 days


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def _shift(value: Column, stream: Column, classes: tuple[str, ...], sign: int) -> Column:
    """Move each character of ``value`` within its class by the stream's next four hex digits."""
    def moved(i):
        c = F.substr(value, i, F.lit(1))
        by = _number(F.substr(stream, F.pmod(i - 1, F.lit(16)) * 4 + 1, F.lit(4)))
        out = None
        for letters in classes:
            at = F.pmod(F.instr(F.lit(letters), c) - 1 + sign * by, F.lit(len(letters)))
            new = F.substr(F.lit(letters), (at + 1).cast("int"), F.lit(1))
            inside = F.instr(F.lit(letters), c) > 0
            out = F.when(inside, new) if out is None else out.when(inside, new)
        return out.otherwise(c)
    return F.when(F.length(value) == 0, F.lit("")).otherwise(F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(value)), moved), ""))


def _stream(key: str, tweak: Column | str, step: Column, half: Column) -> Column:
    name = F.lit(tweak) if isinstance(tweak, str) else tweak
    return F.sha2(F.concat_ws("|", F.lit(key), name, step.cast("string"), half.cast("string")), 256)


def feistel(value: Column, key: str, tweak: Column | str, classes: tuple[str, ...] = LETTERS_AND_DIGITS,
            inverse: bool = False) -> Column:
    """Permute a string within its character classes; characters of no class stay."""
    def forward(s, i):
        return F.struct(s["b"].alias("a"), let(_stream(key, tweak, i, s["b"]),
                        lambda k: _shift(s["a"], k, classes, 1)).alias("b"))

    def backward(s, i):
        return F.struct(let(_stream(key, tweak, i, s["a"]),
                        lambda k: _shift(s["b"], k, classes, -1)).alias("a"), s["a"].alias("b"))
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1, F.length(value)).alias("b"))
    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(steps, start, backward if inverse else forward, lambda s: F.concat(s["a"], s["b"]))


def feistel_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, tweak: str, inverse: bool = False) -> Column:
    """Permute a pair of numbers below ``size_a`` and ``size_b``; a struct of both."""
    def forward(s, i):
        def one(x, y, size):
            return F.pmod(x + _number(F.substr(_stream(key, tweak, i, y), F.lit(1), F.lit(12))) * (-1 if inverse else 1),
                          F.lit(size)).cast("long")
        even = i % 2 == 0
        return F.struct(F.when(even, one(s["a"], s["b"], size_a)).otherwise(s["a"]).alias("a"),
                        F.when(even, s["b"]).otherwise(one(s["b"], s["a"], size_b)).alias("b"))
    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(steps, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), forward)


# ------------------------------------------------------------------ formats

def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10."""
    def step(total, i):
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), step) % 10


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _refill(form: Column, signs: Column, kind: str = r"\d") -> Column:
    """``form`` with its digits, or signs of another ``kind``, replaced in order by ``signs``."""
    def put(s, c):
        inside = c.rlike(kind)
        return F.struct(
            F.concat(s["out"], F.when(inside, F.substr(signs, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + inside.cast("int")).alias("at"))
    letters = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.substr(form, i, F.lit(1)))
    return F.aggregate(letters, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda s: s["out"])


def _card(value: Column, key: str) -> Column:
    def swap(form, digits):
        payload = feistel(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", (DIGITS,))
        return let(payload, lambda p: _refill(form, F.concat(
            p, ((10 - luhn_sum(F.concat(p, F.lit("0")))) % 10).cast("string"))))

    def valid(form):
        return let(_digits(form), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) == 0))
    # Three digits after four groups may be the card's last or a number of their own.
    short = F.when(value.rlike(r"^(?:\d{4}[ -]){4}\d{3}$"), F.substr(value, F.lit(1), F.lit(19)))
    form = F.when(valid(value), value).when(valid(short), short)
    return let(form, lambda f: F.concat(let(_digits(f), lambda d: swap(f, d)), F.substr(value, F.length(f) + 1, F.length(value))))


def _phone(value: Column, key: str) -> Column:
    """After a plus the country's code stays; a trunk zero in parentheses belongs to the form alone."""
    hidden = F.when(value.startswith("+"), F.replace(value, F.lit("(0)"), F.lit("()"))).otherwise(value)

    def swap(form):
        digits = _digits(form)
        code = F.when(form.startswith("+"), F.regexp_extract(digits, CALLING_CODE, 0)).otherwise("")
        return let(F.struct(form.alias("form"), digits.alias("all"), code.alias("code")), lambda s: F.when(
            F.length(s["all"]).between(9, 15), _refill(s["form"], F.concat(s["code"], feistel(
                F.substr(s["all"], F.length(s["code"]) + 1, F.length(s["all"])), key,
                F.concat(F.lit("phone"), s["code"]), (DIGITS,))))))
    return F.replace(let(hidden, swap), F.lit("()"), F.lit("(0)"))


def _national_id(value: Column, key: str) -> Column:
    """A nine-digit number of three parts that are never all zero; 666 and above 899 are not given out."""
    area, group, serial = (F.substr(value, F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1

    def show(s):
        first = F.floor(s["a"] / 99)
        parts = [(F.when(first >= 665, first + 2).otherwise(first + 1), 3), (s["a"] % 99 + 1, 2), (s["b"] + 1, 4)]
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in parts])
    return let(feistel_pair(place, serial - 1, 898 * 99, 9999, key, "national_id"), show)


def _service_key(value: Column, key: str) -> Column:
    start = F.regexp_extract(value, "^(?:" + "|".join(SERVICE_KEYS) + ")", 0)
    rest = F.substr(value, F.length(start) + 1, F.length(value))
    return F.concat(start, feistel(rest, key, F.concat(F.lit("service_key"), start)))


def _ip(value: Column, key: str) -> Column:
    def show(s):
        parts = [F.shiftright(s["a"], 8), s["a"].bitwiseAND(255), F.shiftright(s["b"], 8), s["b"].bitwiseAND(255)]
        return F.concat_ws(".", *[p.cast("string") for p in parts])
    return let(F.transform(F.split(value, r"\."), lambda x: x.cast("long")), lambda o: let(
        feistel_pair(F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), 1 << 16, 1 << 16, key, "ip"), show))


def _date(value: Column, key: str) -> Column:
    iso = F.contains(value, F.lit("-"))
    day = F.when(iso, F.try_to_date(value, "yyyy-MM-dd")).otherwise(F.try_to_date(value, "dd/MM/yyyy"))
    number = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))

    def show(s):
        moved = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAYS_B + s["b"]).cast("int"))
        return F.when(iso, F.date_format(moved, "yyyy-MM-dd")).otherwise(F.date_format(moved, "dd/MM/yyyy"))
    return let(number, lambda n: F.when(n.between(0, DAYS_A * DAYS_B - 1), let(
        feistel_pair(F.floor(n / DAYS_B), n % DAYS_B, DAYS_A, DAYS_B, key, "date"), show)))


def _mod97(value: Column) -> Column:
    def step(total, i):
        at = F.instr(F.lit(DIGITS + UPPER), F.substr(value, i, F.lit(1))) - 1
        return F.when(at < 10, (total * 10 + at) % 97).otherwise((total * 100 + at) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.lit(0), step)


def _iban(value: Column, key: str) -> Column:
    def swap(plain):
        country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain))
        valid = _mod97(F.concat(account, F.substr(plain, F.lit(1), F.lit(4)))) == 1
        new = let(feistel(account, key, F.concat(F.lit("iban"), country), (DIGITS, UPPER)), lambda a: F.concat(
            country, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        return F.when(valid, let(new, lambda n: _refill(value, n, "[A-Z0-9]")))
    return let(F.regexp_replace(value, "[ -]", ""), swap)


def _secret(value: Column, key: str) -> Column:
    blocks = F.transform(F.regexp_extract_all(value, F.lit(rf".{{1,{HEX_BLOCK}}}"), 0), lambda b, i: feistel(
        b, key, F.concat(F.lit("secret"), i.cast("string")), HEX))
    return F.when(F.length(value) <= HEX_WHOLE, feistel(value, key, "secret", HEX)).otherwise(F.array_join(blocks, ""))


def _email(value: Column, key: str) -> Column:
    name = F.substring_index(value, "@", 1)
    domain = F.substr(value, F.length(name) + 1, F.length(value))
    return F.concat(feistel(name, key, F.concat(F.lit("email"), domain)), domain)


SWAPS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "service_key": _service_key, "secret": _secret, "iban": _iban, "national_id": _national_id,
    "phone": _phone, "ip": _ip, "date": _date, "card": _card}


def _swapped(value: Column, key: str) -> Column:
    """(kind, value) of one match; the kind is null and the value unchanged if it is not valid.

    An account number may be all hex, and is then an account number if it is valid.
    """
    def by_kind(k):
        return F.when(value.rlike(rf"^(?:{PATTERNS[k]})$"), let(SWAPS[k](value, key), lambda n: F.when(
            n.isNotNull(), F.struct(F.lit(k).alias("kind"), n.alias("value")))))
    order = sorted(KINDS, key=lambda k: k == "secret")
    return F.coalesce(*[by_kind(k) for k in order], F.struct(F.lit(None).cast("string").alias("kind"), value.alias("value")))


def session_key(spark: SparkSession) -> str:
    """The key that the session's ``tempograin.pseudonymKey`` names; set it for real data."""
    return spark.conf.get(KEY_SETTING, SAMPLE_KEY)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced, plus ``pii_kinds``.

    ``pii_kinds`` has the kind of every replaced value, in order. Card numbers must pass the
    Luhn test and account numbers the modulo 97 test, dates must exist, address octets and
    lengths must be in range; what fails is left alone. Check digits of pseudonyms are valid.
    Account numbers, cards and phone numbers may be printed in groups with single spaces or
    hyphens: accounts in any groups where the country's length is known, cards as 4-4-4-4,
    4-4-4-4-3, 4-6-5 and 4-6-4. Secrets are hex runs of 24 characters or more, in either case.
    Phone numbers with a plus keep the country's code and are equal in all printed forms, with
    or without a trunk zero in parentheses. National numbers are those of three, two and four
    digits joined by hyphens; keys of common services keep their beginning.
    A null text stays null with no kinds; texts without a match are returned as they are.
    Other columns pass through, whatever their names; one that is named ``pii_kinds``, in
    upper or lower case, is replaced. Without the secret ``key`` no pseudonym can be undone.
    """
    rest = [c for c in docs.columns if c.lower() != "pii_kinds"]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), F.col(text).cast("string").alias("text"))
    column = F.col("text")
    matches = F.regexp_extract_all(column, F.lit(ANY), 0)
    swaps = F.transform(matches, lambda m: _swapped(m, key))
    between = F.split(column, ANY, -1)
    found = F.when(column.rlike(SUSPECT), let(swaps, lambda s: let(between, lambda b: F.struct(
        F.array_join(F.transform(b, lambda x, i: F.concat(x, F.coalesce(F.get(s, i)["value"], F.lit("")))), "").alias("text"),
        F.filter(F.transform(s, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds")))))
    done = docs.withColumn("found", found)
    return done.select(
        *[(F.coalesce("found.text", "text") if c.lower() == text.lower() else F.col("doc")[c]).alias(c) for c in rest],
        F.coalesce("found.kinds", F.array().cast("array<string>")).alias("pii_kinds"))


@query("op9_pseudonyms")
def op9(t):
    done = pseudonymise(t.documents.select("doc_id", "text"), session_key(t.spark))
    kinds = F.col("pii_kinds")
    return done.select(
        "doc_id", "text", F.size(kinds).cast("long").alias("n_replaced"),
        *[(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS])
