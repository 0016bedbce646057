"""Ledger analytics on Spark: DataFrame-in, DataFrame-out operators over statement rows."""
