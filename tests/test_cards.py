import datetime
import random
from collections import deque

from pyspark.sql import functions as F

from tallyspark.operators import cards, links, ordered, transfers

ORDER = ["posted_date", "source_hash", "txn_index"]


def queue_model(rows):
    """First-in-first-out by a queue over one card's rows."""
    rank = {"purchase": 0, "fee": 0, "interest": 0, "payment_to_card": 1, "refund": 1}
    stream = sorted(rows, key=lambda r: (r[2], rank.get(r[5], 2), r[4], r[3], r[0], r[1]))
    queue, covered, lost = deque(), {}, {}
    for s, i, _, _, amount, kind in stream:
        if rank.get(kind) == 0 and amount < 0:
            queue.append([(s, i), -amount])
        elif rank.get(kind) == 1 and amount > 0:
            left = amount
            while left and queue:
                part = min(left, queue[0][1])
                covered[(s, i), queue[0][0]] = part
                queue[0][1] -= part
                left -= part
                if not queue[0][1]:
                    queue.popleft()
            lost[(s, i)] = left
    return covered, lost, sum(q[1] for q in queue)


def random_card(n, seed):
    rng = random.Random(seed)
    kinds = ["purchase", "fee", "interest", "payment_to_card", "refund", "other"]
    rows = []
    for i in range(n):
        kind = rng.choice(kinds)
        size = rng.choice([0, 1, 2, 3, 5, 8]) * 100
        sign = -1 if kind in ("purchase", "fee", "interest") else 1
        if rng.random() < 0.05:
            sign = -sign
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(12))
        rows.append((f"s{rng.randrange(3)}", i, day.isoformat(), rng.choice("ab"), sign * size, kind))
    return rows


def test_fifo_equals_a_queue_on_one_hot_card(ledger):
    """One card holds all rows, so it spans every block."""
    for seed in range(3):
        rows = random_card(400, seed)
        covered, lost, unpaid = queue_model(rows)
        df = ledger(rows)
        axis = cards.fifo_ledger(df)
        got = {
            ((r.payment_hash, r.payment_index), (r.charge_hash, r.charge_index)): r.covered_minor
            for r in cards.fifo_attributions(axis).collect()
        }
        assert got == covered
        assert {(r.source_hash, r.txn_index): r.uncovered_minor for r in cards.payments(axis).collect()} == lost
        assert cards.unpaid_balance(df).first()["unpaid_minor"] == unpaid


def test_blocks_spread_one_key(spark, ledger):
    blocked = ordered.ordered_blocks(ledger(random_card(400, 9)), ["ledger_id"], ORDER)
    sizes = [r["count"] for r in blocked.groupBy(ordered.BLOCK).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 400


def test_positions_are_dense(ledger):
    placed = ordered.positions(ledger(random_card(300, 4)), ["ledger_id"], ORDER, "position").collect()
    want = sorted(placed, key=lambda r: (r.posted_date, r.source_hash, r.txn_index))
    assert [r.position for r in want] == list(range(300))


def test_same_day_payment_covers_same_day_purchase(ledger):
    rows = [("a", 0, "2024-05-01", "pay", 500, "payment_to_card"), ("a", 1, "2024-05-01", "buy", -500, "purchase")]
    for order in (rows, rows[::-1]):
        assert cards.unpaid_balance(ledger(order)).first()["unpaid_minor"] == 0


def test_excess_payment_does_not_prepay(ledger):
    rows = [
        ("a", 0, "2024-05-01", "buy", -100, "purchase"), ("a", 1, "2024-05-02", "pay", 300, "payment_to_card"),
        ("a", 2, "2024-05-03", "buy", -50, "purchase"),
    ]
    assert cards.unpaid_balance(ledger(rows)).first()["unpaid_minor"] == 50
    assert cards.payments(cards.fifo_ledger(ledger(rows))).first()["uncovered_minor"] == 200


def _statements(spark, *ends):
    return spark.createDataFrame(
        [(1, s, bank, "credit_card", last4, datetime.date.fromisoformat(end)) for s, bank, last4, end in ends],
        "ledger_id bigint, source_hash string, bank_name string, account_type string, account_last_4 string, period_end date",
    )


def test_reconcile_links_one_and_refuses_two(spark, ledger):
    bank = ledger([("b", 0, "2024-05-10", "Discover E-Payment 562", -5000, "payment_to_card")], account="checking")
    card = [("c", 0, "2024-05-09", "PAYMENT", 5000, "payment_to_card")]
    headers = _statements(spark, ("c", "discover ", "562", "2024-05-20"))
    link = links.reconcile(bank.union(ledger(card, "discover ", last4="562")), headers).first()
    assert (link.cc_source_hash, link.cc_txn_index, link.confidence_score) == ("c", 0, 1.0)
    twice = card + [("c", 1, "2024-05-12", "PAYMENT", 5000, "payment_to_card")]
    rows = bank.union(ledger(twice, "discover ", last4="562"))
    assert links.reconcile(rows, headers).isEmpty()
    assert links.ambiguous(rows, headers).first()["candidates"] == 2
    late = _statements(spark, ("c", "discover ", "562", "2024-06-10"))
    assert links.reconcile(bank.union(ledger(card, "discover ", last4="562")), late).isEmpty()


def _greedy(rows, max_gap=5):
    def key(r):
        return f"{r[1]}#{r[2]}"

    found = set()
    for lid in {r[0] for r in rows}:
        used = set()
        for out in sorted((r for r in rows if r[0] == lid and r[8] < 0), key=lambda r: (r[6], key(r))):
            best = min(
                ((abs((r[6] - out[6]).days), key(r)) for r in rows
                 if r[0] == lid and r[8] == -out[8] and r[3] != out[3] and key(r) not in used
                 and abs((r[6] - out[6]).days) <= max_gap),
                default=None,
            )
            if best:
                used.add(best[1])
                found.add((lid, key(out), best[1]))
    return found


def test_transfers_equal_greedy_choice(spark):
    from tests.conftest import LEDGER

    rng = random.Random(5)
    rows = []
    for lid in range(2):
        for i in range(60):
            bank = rng.choice("ABC")
            day = datetime.date(2020, 1, 1) + datetime.timedelta(days=rng.randrange(25))
            rows.append((lid, f"s{rng.randrange(3)}{bank}", i, bank, "checking", "1", day, rng.choice(["x", "Wire"]),
                         rng.choice([-1, 1]) * rng.choice([100, 200]), "transfer"))
    want = _greedy(rows)
    df = spark.createDataFrame(rows, LEDGER)
    got = {
        (r.ledger_id, f"{r.out_hash}#{r.out_index}", f"{r.in_hash}#{r.in_index}")
        for r in transfers.detect_transfers(df).collect()
    }
    assert got == want
    assert df.filter(F.col("amount_minor") == 0).isEmpty()
