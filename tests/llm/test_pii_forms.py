"""Values in the forms in which they are printed, and secrets in either case and at any place."""

import re

import pytest
from test_pii import luhn, run

HEX40 = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
MIXED = "9233a8ECF7c5B09FE5949719b6"


@pytest.mark.parametrize("before, after", [('TOKEN = "', '"'), ("", ""), ("\n", "\n"), ("\t", " x"), ("[", "]"), ("(", ")"), ("key_", ","), ("0x", "")])
def test_secrets_at_any_place(spark, before, after):
    values = [HEX40, HEX40.lower(), MIXED, HEX40 * 4, HEX40 * 30 + "7"]
    for value, (out, kinds) in zip(values, run(spark, [f"{before}{v}{after}" for v in values])):
        new = out[len(before):len(out) - len(after)]
        assert kinds == ["secret"] and out.startswith(before) and out.endswith(after)
        assert new != value and len(new) == len(value) and value[:24] not in out
        assert [(c.isdigit(), c.isupper()) for c in new] == [(c.isdigit(), c.isupper()) for c in value]


def test_what_is_no_secret_stays(spark):
    texts = ["DEADBEEFDEADBEEFDEADBEEFDEAD", "x" + HEX40, HEX40 + "G", HEX40[:23]]
    assert run(spark, texts) == [(t, []) for t in texts]


def test_printed_groups(spark):
    texts = {
        "DE89 3704 0044 0532 0130 00": "iban", "DE89370400440532013000": "iban", "DE89-3704-0044-0532-0130-00": "iban",
        "BE68 5390 0754 7034": "iban", "GB82 WEST 1234 5698 7654 32": "iban", "AD12 0001 2030 2003 5910 0100": "iban",
        "AD1200012030200359100100": "iban", "3782 822463 10005": "card", "3056-930902-5904": "card", "4111 1111 1111 1111": "card",
        "+33 6 12 34 56 78": "phone", "+33612345678": "phone", "+33.6.12.34.56.78": "phone", "+49 89 1234 56 78": "phone", "+1 (017) 555-7713": "phone"}
    for after in ("", ".", " IS MINE", " THIS 12 items"):
        outs = run(spark, [f"it is {t}{after}" for t in texts])
        for (value, kind), (out, kinds) in zip(texts.items(), outs):
            assert kinds == [kind], (value, after, out, kinds)
            new = out[6:len(out) - len(after)] if after else out[6:]
            assert re.sub("[A-Z0-9]", "0", new) == re.sub("[A-Z0-9]", "0", value) and new != value and out.endswith(after)
            if kind == "card":
                assert luhn(re.sub(r"\D", "", new))
            if kind == "iban":
                plain = re.sub("[ -]", "", new)
                assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    linked = run(spark, ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "3782 822463 10005", "378282246310005"])
    plain = [re.sub("[ -]", "", out) for out, _ in linked]
    assert plain[0] == plain[1] and plain[2] == plain[3]


def test_numbers_beside_a_card_stay(spark):
    (a, ka), (b, kb) = run(spark, ["4111 1111 1111 1111 123 items", "4111 1111 1111 1111"])
    assert ka == kb == ["card"] and a == b + " 123 items"
    texts = ["DE88 3704 0044 0532 0130 00", "3782 822463 10006", "4111 1111 1111 1112 123"]
    assert run(spark, texts) == [(t, []) for t in texts]


def test_upper_cased_texts_of_the_table(spark):
    from tempograin.llm import pii
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "upper(text) AS text")
    secret = re.compile(r"(?<![0-9A-Za-z])(?=[0-9]*[A-F])(?=[A-F]*[0-9])[0-9A-F]{24,}(?![0-9A-Za-z])")
    planted = {v for r in docs.collect() for v in secret.findall(r.text)}
    left = " ".join(r.text for r in pii.pseudonymise(docs, "k").collect())
    assert planted and not any(v in left for v in planted)
