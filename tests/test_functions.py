import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates, money, redact, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, cents", [
    ("12.34", 1234), ("(12.34)", -1234), ("$1,234.50", 123450), ("1.005", 101), ("1.004", 100),
    ("2.665", 267), ("-0.005", -1), ("₹1,234.567", 123457), ("(-5)", 500), ("+3", 300),
    ("", None), ("abc", None), ("1.", None), ("--1", None),
])
def test_parse_amount(spark, raw, cents):
    assert one(spark, raw, money.parse_amount) == cents


@pytest.mark.parametrize("raw, cents", [
    ("$1,234.56", 123456), ("(12.00)", -1200), ("-12", -1200), (".50", 50), ("-$1.5", -150), ("1,23", None),
    ("", None), ("$", None), ("((1))", None), ("1.234", None), ("344.92-", None),
])
def test_parse_money(spark, raw, cents):
    assert one(spark, raw, money.parse_money) == cents


@pytest.mark.parametrize("cents, usd, inr", [
    (0, "$0.00", "₹0.00"), (-5, "-$0.05", "-₹0.05"), (123456789, "$1,234,567.89", "₹12,34,567.89"),
    (-9223372036854775808, "-$92,233,720,368,547,758.08", "-₹92,23,37,20,36,85,47,758.08"),
])
def test_format_money(spark, cents, usd, inr):
    assert one(spark, cents, lambda c: money.format_money(c, F.lit("USD")), "bigint") == usd
    assert one(spark, cents, lambda c: money.format_money(c, F.lit("INR")), "bigint") == inr


@pytest.mark.parametrize("raw, clean", [
    ("AMERICAN EXPRESS ACH PMT  Web ID: 9493560001", "AMERICAN EXPRESS ACH PMT"),
    ("03/14 COFFEE  SHOP", "COFFEE SHOP"),
    ("Zelle Payment To Bob JPM99abc123", "Zelle Payment To Bob"),
    ("PAYROLL 1234567", "PAYROLL"),
    ("SHOP abc123456 def123456", "SHOP abc123456"),
    ("Transaction#: 77-1 Refund", "Refund"),
    ("WORDSWITHOUTDIGITS LONGTOKENHERE", "WORDSWITHOUTDIGITS LONGTOKENHERE"),
    ("a  b", "a b"), ("", ""), ("01/02", "01/02"), (None, ""),
])
def test_clean_description(spark, raw, clean):
    assert one(spark, raw, text.clean_description) == clean


def test_normalize_descriptor(spark):
    assert one(spark, "Acme co PPD ID: 12*34 web-pay", text.normalize_descriptor) == "ACME PAY"


@pytest.mark.parametrize("raw, issuer, last4", [
    ("Payment To Chase Card Ending IN 562", "Chase", "0562"), ("DISCOVER E-PAYMENT 9981 X", "Discover", "9981"),
    ("Bank of America CC Pmt", "BofA", None), ("AMEX EPAYMENT", "Amex", None), ("coffee", None, None),
])
def test_card_payment(spark, raw, issuer, last4):
    found = one(spark, raw, text.card_payment)
    assert (found and found["issuer"]) == issuer and (found and found["card_last_4"]) == last4


@pytest.mark.parametrize("raw, iso", [
    ("3/4/2025", "2025-03-04"), ("3/4/79", "2079-03-04"), ("3/4/80", "1980-03-04"), ("2025/3/4", "2025-03-04"),
    (" 2025-03-04 ", "2025-03-04"), ("4.3.2025", None),
])
def test_normalize_date(spark, raw, iso):
    assert one(spark, raw, dates.normalize_date) == iso


@pytest.mark.parametrize("raw, ok", [("2024-02-29", True), ("2023-02-29", False), ("2024-2-1", False), (None, False)])
def test_is_iso_date(spark, raw, ok):
    assert one(spark, raw, dates.is_iso_date) is ok


def test_redaction(spark):
    sample = (
        "Jane Roe, 1 Elm St, card 4111-1111-1111-1234, Account Number: 123456789012, SSN 123-45-6789, "
        "jane@example.com, (212) 555-0199, janeRoe"
    )
    config = redact.RedactConfig(names=["Jane Roe"], addresses=["1 Elm St"])
    df = redact.redact(spark.createDataFrame([(1, sample)], "doc_id bigint, text string"), config)
    row = df.first()
    assert row["redacted"] == (
        "ACCOUNT HOLDER, ADDRESS REDACTED, card XXXX-XXXX-XXXX-1234, Account Number: XXXXXXXX9012, SSN SSN REDACTED, "
        "EMAIL REDACTED, PHONE REDACTED, janeRoe"
    )
    assert [f["category"] for f in row["found"]] == [
        "name", "address", "credit_card_number", "account_number", "ssn", "email_auto", "phone_auto",
    ]
    short = redact.redact(spark.createDataFrame([("4111111111111234",)], "text string"), redact.RedactConfig(keep_last=2))
    assert short.first()["redacted"] == "XXXX-XXXX-XXXX-XXX34"


def test_declared_names_are_masked_in_any_case_and_with_any_marks(spark):
    config = redact.RedactConfig(names=["José", r"A\E (B)"], auto=False)
    rows = redact.redact(spark.createDataFrame([("JOSÉ met josé",), (r"x a\e (b) y",)], "text string"), config).collect()
    assert [r.redacted for r in rows] == ["ACCOUNT HOLDER met ACCOUNT HOLDER", "x ACCOUNT HOLDER y"]
