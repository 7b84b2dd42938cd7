import hashlib
import hmac

from pyspark.sql import functions as F

from paymend.functions import answers, crypto, privacy


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def test_field_masks(spark):
    def mask(field, value):
        return texts(spark, value).select(privacy.redact_field(F.col("v"), field)).first()[0]

    assert mask("card_number", "4111 1111 1111 1111") == "**** **** **** 1111"
    assert mask("cvv", "123") == "****"
    assert mask("email", "customer@example.com") == "c******r@example.com"
    assert mask("email", "ab@example.com") == "**@example.com"
    assert mask("email", "none") == "***@***.***"
    assert mask("contact", "9876543210") == "******3210"
    assert mask("contact", "12") == "****"
    assert mask("name", "Jo Doe") == "***REDACTED***"
    assert mask("address", "call 9876543210 now") == "call ******3210 now"
    assert mask("name", "") == ""


def test_free_text_is_masked_whole(spark):
    text = "pay 4111-1111-1111-1111, mail jane.doe@mail.example and 91 9876543210; no 123."
    df = texts(spark, text, "nothing here", None)
    once = privacy.mask_text(df, "v", "m")
    got = [r.m for r in once.collect()]
    assert got == ["pay **** **** **** 1111, mail j******e@mail.example and ********3210; no 123.", "nothing here", None]
    # Cards and phones do not change again; an address may only lose more letters.
    twice = [r.t for r in privacy.mask_text(once, "m", "t").collect()]
    assert twice[0].replace("j*******@", "j******e@") == got[0] and twice[1:] == got[1:]


def test_nested_records(spark):
    df = spark.createDataFrame(
        [(1, ("a@b.co", {"card_number": "4111111111111111", "network": "visa"}, [("x", "9876543210")]), 500)],
        "id int, payload struct<email:string, card:map<string,string>, people:array<struct<note:string, phone:string>>>, amount int",
    )
    row = privacy.redact_frame(df).first()
    assert row.amount == 500 and row.payload.email == "*@b.co"
    assert row.payload.card == {"card_number": "**** **** **** 1111", "network": "visa"}
    assert row.payload.people[0] == ("x", "******3210")


def test_hmac_and_signatures(spark):
    for key in (b"short", b"k" * 100):
        body = "some body ₹"
        want = hmac.new(key, body.encode(), hashlib.sha256).hexdigest()
        df = texts(spark, body)
        assert df.select(crypto.hmac_sha256(F.col("v"), key)).first()[0] == want
        checks = [crypto.signature_valid(F.col("v"), F.lit(s), key) for s in (want, want.upper(), "", None, want[::-1])]
        assert list(df.select(*checks).first()) == [True, True, False, False, False]


def test_encryption(spark):
    key, other = crypto.derive_key("secret"), crypto.derive_key("0" * 64)
    assert len(key) == 32 and other == bytes(32)
    df = texts(spark, "jane@mail.example", "", None, "jane@mail.example")
    sealed = df.select("v", crypto.encrypt(F.col("v"), key).alias("a")).collect()
    assert sealed[0].a != sealed[3].a and sealed[0].a.startswith("aes256gcm:")
    assert (sealed[1].a, sealed[2].a) == ("", None)
    again = spark.createDataFrame([(sealed[0].a, "plain", "aes256gcm:???")], "s string, p string, bad string")
    row = again.select(
        crypto.decrypt(F.col("s"), key), crypto.decrypt(F.col("s"), other), crypto.decrypt(F.col("p"), key),
        crypto.decrypt(F.col("bad"), key), crypto.is_encrypted(F.col("s")), crypto.is_encrypted(F.col("p")),
    ).first()
    assert list(row) == ["jane@mail.example", sealed[0].a, "plain", "aes256gcm:???", True, False]


def test_answer_checks(spark):
    schema = (
        "label string, payment_id string, reasoning string, facts array<string>, action string, failure_category string, "
        "discount_pct double, confidence double, ml_score double"
    )
    rows = [
        ("gateway", "pay_test001", "A temporary gateway fault; an early retry should work.", ["gateway", "retry", "temporary"], "RETRY_PAYMENT", "GATEWAY_DOWN", 0.0, 0.85, 0.72),
        ("funds", "pay_test002", "The balance is insufficient, so an EMI plan fits.", ["emi", "balance", "insufficient"], "OFFER_EMI", "INSUFFICIENT_FUNDS", 0.0, 0.78, 0.22),
        ("cancelled", "pay_test003", "The customer cancelled; a reminder is enough.", ["cancelled", "reminder"], "SEND_REMINDER", "USER_CANCELLED", 5.0, 0.7, 0.41),
        ("high_discount_violation", "pay_test004", "The bank said no; try UPI instead.", ["bank", "upi"], "OFFER_ALTERNATE_UPI", "BANK_DECLINE", 20.0, 0.65, 0.45),
        ("loud", "pay_test005", "This is FRAUD!!! see https://x.example pay_abcdefgh99", [], "REFUND", "UNKNOWN", 0.0, 1.0, 0.0),
    ]
    got = {r.label: r for r in answers.with_checks(spark.createDataFrame(rows, schema)).collect()}
    assert all(got[k].overall for k in ("gateway", "funds", "cancelled"))
    bad = got["high_discount_violation"]
    assert not bad.overall and not bad.discount_ok
    assert bad.faithful and bad.tone_ok and bad.nothing_invented and bad.action_valid and bad.confidence_ok
    loud = got["loud"]
    assert loud.faithful and not (loud.tone_ok or loud.nothing_invented or loud.action_valid or loud.confidence_ok)
