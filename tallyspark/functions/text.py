"""Description cleaning, keys and recognisers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# Word edges spelled out, so that they mean ASCII word edges on every JDK.
_EDGE_L, _EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
# JavaScript-style white space, wider than Java's \s.
_WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def rlike_any_case(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_WS}+|{_WS}+\z", "")


def clean_description(raw: Column) -> Column:
    """Drop ACH ids, reference tags, a leading MM/DD and one trailing reference.

    The four tag patterns all hold a colon, so texts without one skip them. White space is
    collapsed before the patterns at the ends of the text, which then only meet blanks.
    """
    raw = F.coalesce(raw, F.lit(""))
    untagged = raw
    for pattern in (
        rf"(?i){_WS}*Web ID:{_WS}*\d+{_EDGE_R}",
        rf"(?i){_WS}*PPD ID:{_WS}*\d+{_EDGE_R}",
        rf"(?i){_WS}*Transaction#:{_WS}*\S*",
        rf"(?i){_WS}*Reference#:{_WS}*\S*",
    ):
        untagged = F.regexp_replace(untagged, pattern, "")
    text = F.when(F.contains(raw, F.lit(":")), untagged).otherwise(raw)
    text = F.regexp_replace(text, rf"{_WS}+", " ")
    for pattern in (
        r"^ ?\d{2}/\d{2} ",
        # one trailing token of nine or more characters with three or more digits
        r" (?=[^ ]{9,} ?\z)(?:[^ \d]*\d){3}[^ ]* ?\z",
        r" \d{6,} ?\z",
    ):
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def descriptor_key(raw: Column) -> Column:
    return F.upper(clean_description(raw))


def normalize_descriptor(text: Column) -> Column:
    """Payer or merchant key: upper case, without plumbing words, digits and punctuation."""
    noise = "|".join(fixed.DESCRIPTOR_NOISE)
    text = F.regexp_replace(F.upper(text), f"{_EDGE_L}({noise}){_EDGE_R}", " ")
    text = F.regexp_replace(text, r"\d+", " ")
    text = F.regexp_replace(text, r"[#*:/\\|-]+", " ")
    return F.trim(F.regexp_replace(text, rf"{_WS}+", " "))


def stream_key(raw: Column) -> Column:
    """Key of a recurring stream: the normalised form of the cleaned text."""
    return normalize_descriptor(clean_description(raw))


def first_match(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """One `when` chain: the value of the first condition that holds."""
    head, *rest = cases
    chain = reduce(lambda acc, c: acc.when(c[0], c[1]), rest, F.when(*head))
    return chain if otherwise is None else chain.otherwise(otherwise)


def card_payment(text: Column) -> Column:
    """struct(issuer, card_last_4) of a card-payment description, null if none matches."""
    cases = []
    for issuer, pattern, has_last4 in fixed.CARD_PAYMENT_PATTERNS:
        if has_last4:
            # lpad would also cut; three or four digits never exceed four
            last4 = F.lpad(F.regexp_extract(text, "(?i)" + pattern, 1), 4, "0")
        else:
            last4 = F.lit(None).cast("string")
        cases.append((
            rlike_any_case(text, pattern),
            F.struct(F.lit(issuer).alias("issuer"), last4.alias("card_last_4")),
        ))
    return first_match(cases)


def issuer_of_bank(bank_name: Column) -> Column:
    """Issuer whose alias list holds the bank name, ignoring case and outer blanks."""
    name = F.lower(trim_ws(bank_name))
    return first_match([
        (name.isin([alias.lower() for alias in aliases]), F.lit(issuer))
        for issuer, aliases in fixed.ISSUER_BANK_NAMES.items()
    ])


def bank_transaction_type(text: Column) -> Column:
    """Type of a bank-account row from its description."""
    is_card = reduce(
        lambda a, b: a | b,
        [rlike_any_case(text, p) for _, p, _ in fixed.CARD_PAYMENT_PATTERNS],
    )
    return first_match(
        [(is_card, F.lit("payment_to_card"))]
        + [(rlike_any_case(text, p), F.lit(t)) for t, p in fixed.TYPE_PATTERNS],
        F.lit("other"),
    )


def card_transaction_type(section: Column, text: Column) -> Column:
    """Type of a card-statement row from its section; credits are payments or refunds."""
    return first_match(
        [
            (
                section == "payments_credits",
                F.when(rlike_any_case(text, fixed.CARD_CREDIT_PAYMENT), F.lit("payment_to_card"))
                .otherwise(F.lit("refund")),
            ),
            (section == "purchase", F.lit("purchase")),
            (section == "fees", F.lit("fee")),
            (section == "interest", F.lit("interest")),
        ],
        F.lit("other"),
    )


def description_hash(text: Column) -> Column:
    """SHA-256 of the upper-cased text without a trailing date or reference."""
    text = F.regexp_replace(F.upper(text), rf"{_WS}+", " ")
    text = F.regexp_replace(
        text,
        rf"{_WS}+(?:\d{{2}}[/-]\d{{2}}[/-]\d{{2,4}}|REF[\s#]?[A-Z0-9]+|ID[\s#]?[A-Z0-9]+"
        rf"|AUTH[\s#]?[A-Z0-9]+|TRACE[\s#]?[A-Z0-9]+){_WS}*\z",
        "",
    )
    return F.sha2(F.trim(text), 256)


def padded_words(text: Column) -> Column:
    """Lower-case text with everything but ASCII letters and digits as blanks, padded."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^a-z0-9]", " "), F.lit(" "))


def contains_word(text: Column, word: str) -> Column:
    """Whole-word test that treats everything but ASCII letters and digits as an edge."""
    return F.lower(text).rlike(f"(?:^|[^a-z0-9])\\Q{word.lower()}\\E(?:\\z|[^a-z0-9])")
