"""Small event frames for unit tests."""

import random

EVENT_SCHEMA = (
    "SK_ID_PREV bigint, SK_ID_CURR bigint, NUM_INSTALMENT_VERSION int, NUM_INSTALMENT_NUMBER int, DAYS_INSTALMENT int,"
    "first_payment_day int, AMT_INSTALMENT double, total_amount_paid double, missing_payment_flag int,"
    "underpaid_after_aggregation_flag int, aggregated_payment_delay_days int"
)
PAYMENT_SCHEMA = (
    "SK_ID_PREV bigint, SK_ID_CURR bigint, NUM_INSTALMENT_VERSION int, NUM_INSTALMENT_NUMBER int, DAYS_INSTALMENT int,"
    "DAYS_ENTRY_PAYMENT int, AMT_INSTALMENT double, AMT_PAYMENT double"
)
POS_SCHEMA = "SK_ID_CURR bigint, MONTHS_BALANCE int, SK_DPD int, SK_DPD_DEF int"


def event(borrower, loan, number, due, delay=0, missing=0, under=0, paid=100.0, amount=100.0, version=1):
    first = None if delay is None else due + delay
    return (loan, borrower, version, number, due, first, amount, paid, missing, under, delay)


def random_events(seed, borrowers=4, most=40, days=200):
    rng = random.Random(seed)
    rows = []
    for b in range(borrowers):
        # the first borrower has many events, on few days
        n, span = (most * 3, 12) if b == 0 else (rng.randint(1, most), days)
        for k in range(n):
            delay = rng.choice([None, -3, 0, 0, 0, 2, 31, 45])
            rows.append(
                event(b, 1000 * b + k, rng.randint(1, 3), -rng.randint(1, span), delay, int(delay is None),
                      int(rng.random() < 0.2), rng.choice([0.0, 50.0, 100.0]), rng.choice([0.0, 100.0]))
            )
    return rows
