"""Redaction of names, numbers and contact data in free text."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Automatic passes, in order. (category, pattern)
CARD_NUMBER = r"(?<![0-9A-Za-z_-])(\d{4})[ -]?(\d{4})[ -]?(\d{4})[ -]?(\d{4})(?![0-9A-Za-z_-])"
ACCOUNT_NUMBER = r"(?i)(?<![0-9A-Za-z_])((?:Account|Acct\.?|A/C)\s*(?:Number|No\.?|#)?\s*[#:]?\s*)(\d{9,12})(?![0-9A-Za-z_])"
SSN = r"(?<![0-9A-Za-z_])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z_])"
# begins at a word edge: marks in front of the first word are no part of an address
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
EMAIL = _EDGE + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![A-Za-z0-9_])"
PHONE = r"(?<![\d.-])(?:\+?1[\s.-]?)?\(?([2-9]\d{2})\)?[\s.-]?(\d{3})[\s.-]?(\d{4})(?![\d-])"


@dataclass(frozen=True)
class RedactConfig:
    names: list[str] = field(default_factory=list)
    addresses: list[str] = field(default_factory=list)
    phones: list[str] = field(default_factory=list)
    emails: list[str] = field(default_factory=list)
    keep_last: int = 4
    auto: bool = True


def _mask_account(text: Column, keep: int) -> Column:
    """Mask all but the last `keep` digits of account numbers, one length at a time."""
    for length in range(12, 8, -1):
        kept = min(max(keep, 0), length)
        pattern = ACCOUNT_NUMBER.replace(r"(\d{9,12})", rf"\d{{{length - kept}}}(\d{{{kept}}})")
        text = F.regexp_replace(text, pattern, "$1" + "X" * (length - kept) + "$2")
    return text


def _literal(words: str) -> str:
    """A pattern that matches just these words, whatever marks they hold."""
    return re.sub(r"([^\w\s])", r"\\\1", words)


def _passes(config: RedactConfig) -> list[tuple[str, str, object]]:
    """(category, pattern, replacement or function) in the order they run."""
    longest = lambda words: sorted(words, key=lambda w: -len(w))
    out: list[tuple[str, str, object]] = []
    for name in longest(config.names):
        out.append(("name", rf"(?iu)(?<![A-Za-z0-9]){_literal(name)}(?![A-Za-z0-9])", "ACCOUNT HOLDER"))
    for address in longest(config.addresses):
        out.append(("address", rf"(?iu){_literal(address)}", "ADDRESS REDACTED"))
    for phone in config.phones:
        out.append(("phone", _literal(phone), "PHONE REDACTED"))
    for email in config.emails:
        out.append(("email", rf"(?iu){_literal(email)}", "EMAIL REDACTED"))
    if config.auto:
        keep = config.keep_last
        if keep >= 4:
            card = "XXXX-XXXX-XXXX-$4"
        elif keep == 0:
            card = "CARD NUMBER REDACTED"
        else:
            card = None
        if card is None:
            pattern = CARD_NUMBER.replace(r"[ -]?(\d{4})(?!", rf"[ -]?\d{{{4 - keep}}}(\d{{{keep}}})(?!")
            out.append(("credit_card_number", pattern, "XXXX-XXXX-XXXX-XXX$4"))
        else:
            out.append(("credit_card_number", CARD_NUMBER, card))
        out.append(("account_number", ACCOUNT_NUMBER, lambda text: _mask_account(text, keep)))
        out.append(("ssn", SSN, "SSN REDACTED"))
        out.append(("email_auto", EMAIL, "EMAIL REDACTED"))
        out.append(("phone_auto", PHONE, "PHONE REDACTED"))
    return out


def _tagged(hits: str, number: int, category: str) -> Column:
    return F.transform(hits, lambda hit: F.struct(
        F.lit(number).alias("pass_no"), F.lit(category).alias("category"), hit.alias("original")
    ))


def redact(documents: DataFrame, config: RedactConfig = RedactConfig(), text: str = "text") -> DataFrame:
    """Adds redacted text and `found`: array of (pass_no, category, original) per pass.

    Each pass reads the text as the earlier ones left it. The whole text is processed.
    """
    df = documents.withColumn("redacted", F.coalesce(text, F.lit("")))
    found = []
    for number, (category, pattern, replacement) in enumerate(_passes(config)):
        hits = f"hits_{number}"
        df = df.withColumn(hits, F.regexp_extract_all("redacted", F.lit(pattern), F.lit(0)))
        after = replacement(F.col("redacted")) if callable(replacement) else F.regexp_replace("redacted", pattern, replacement)
        df = df.withColumn("redacted", after)
        found.append(_tagged(hits, number, category))
    empty = F.array().cast("array<struct<pass_no:int,category:string,original:string>>")
    df = df.withColumn("found", F.concat(*found) if found else empty)
    return df.drop(*[f"hits_{n}" for n in range(len(found))])


def redactions(redacted: DataFrame, *keys: str) -> DataFrame:
    """One row per redaction; `original` belongs in a restricted table.

    The outer form keeps Spark from deriving a non-empty test that would run all passes twice.
    """
    return redacted.select(*keys, F.inline_outer("found")).filter(F.col("category").isNotNull())


def redaction_summary(redacted: DataFrame) -> DataFrame:
    """Redactions per category, most frequent first."""
    return redactions(redacted).groupBy("category").agg(
        F.count("*").alias("redactions")
    ).orderBy(F.desc("redactions"), "category")

