import datetime
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyspark.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = configure(
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        # small test data would otherwise end up in one partition, and never cross a block
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    ).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


LEDGER = (
    "ledger_id bigint, source_hash string, txn_index bigint, bank_name string, account_type string,"
    " account_last_4 string, posted_date date, description string, amount_minor bigint, transaction_type string"
)


@pytest.fixture()
def ledger(spark):
    """Builds ledger rows from short tuples: (source, index, date, description, cents, type)."""

    def build(rows, bank="Chase", account="credit_card", last4="1234", ledger_id=1):
        return spark.createDataFrame(
            [(ledger_id, s, i, bank, account, last4, datetime.date.fromisoformat(d), text, cents, kind)
             for s, i, d, text, cents, kind in rows],
            LEDGER,
        )

    return build
