"""Explicit schemas and enumerations of the ledger tables."""

from pyspark.sql import types as T

ROW_KEY = ["ledger_id", "source_hash", "txn_index"]
CARD_KEY = ["ledger_id", "bank_name", "account_last_4"]

# Enumerations of the data model.
ACCOUNT_TYPES = ["checking", "savings", "credit_card", "loan", "cash", "other"]
TRANSACTION_TYPES = [
    "purchase", "refund", "transfer", "fee", "interest",
    "payment_to_card", "deposit", "withdrawal", "other",
]
STATUSES = ["pending", "posted", "disputed", "reversed"]
CHECKSUM_LEVELS = ["A", "B", "C", "D"]

# Flow intents and the totals they count toward.
SPEND_INTENTS = [
    "purchase", "bill_pay", "loan_payment", "interest_charged", "fees", "cash_out", "unknown",
]
INCOME_INTENTS = ["salary", "interest_earned", "gift_in", "cash_in"]
MOVEMENT_INTENTS = ["cc_payment", "transfer_self", "investment_out"]
REFUND_INTENTS = ["refund"]

SUMMARY_LINE = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("amount_minor", T.LongType()),
])

SPLIT_PART = T.StructType([
    T.StructField("category_id", T.StringType()),
    T.StructField("amount_minor", T.LongType()),
    T.StructField("flow_intent", T.StringType()),
])

# Landed state file: money is text of the form "__bigint__:123" until it is read.
STATE_TRANSACTION = T.StructType([
    T.StructField("posted_date", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("amount_minor", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("status", T.StringType()),
])

STATE_STATEMENT = T.StructType([
    T.StructField("account_type", T.StringType()),
    T.StructField("account_last_4", T.StringType()),
    T.StructField("period_start", T.StringType()),
    T.StructField("period_end", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("opening_balance_minor", T.StringType()),
    T.StructField("closing_balance_minor", T.StringType()),
    T.StructField("total_debits_minor", T.StringType()),
    T.StructField("total_credits_minor", T.StringType()),
    T.StructField("previous_balance_minor", T.StringType()),
    T.StructField("statement_balance_minor", T.StringType()),
    T.StructField("printed_transaction_count", T.LongType()),
    T.StructField("payment_due_date", T.StringType()),
    T.StructField("statement_date", T.StringType()),
    T.StructField("minimum_payment_due_minor", T.StringType()),
    T.StructField("parser_provides", T.ArrayType(T.StringType())),
])

# One landed import, or one part of a large one: first_index is the row number of the
# part's first transaction within its statement.
STATE_IMPORT = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("ledger_id", T.LongType()),
    T.StructField("bank_name", T.StringType()),
    T.StructField("adapter_name", T.StringType()),
    T.StructField("adapter_version", T.StringType()),
    T.StructField("source_hash", T.StringType()),
    T.StructField("imported_at", T.StringType()),
    T.StructField("first_index", T.LongType()),
    T.StructField("statement", STATE_STATEMENT),
    T.StructField("transactions", T.ArrayType(STATE_TRANSACTION)),
    T.StructField("checksum_strategy_used", T.StringType()),
])

TEXT_ITEM = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("text", T.StringType()),
])
