"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import bizlink.plans.contact_queries  # noqa: F401
import bizlink.plans.lead_queries  # noqa: F401
import bizlink.plans.outreach_queries  # noqa: F401
import bizlink.plans.record_queries  # noqa: F401
import bizlink.plans.stream_queries  # noqa: F401
from bizlink.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
#: A few of each kind; the driver compares all of them.
CHOSEN = "c1_lead_score c2_data_confidence l4_gated_export w2_batch_stop_prefix a7_summary j12_competitors a1_a3_golden_record w1_latest_attempt a6_funnel j14_call_queue j4_suppression s15_new_deliveries f13_email_harvest f8_f9_j7_phone_verdict j15_x11_signatures a13_review_weaknesses f21_f22_model_replies s10_s11_export_views t2_progress_changes t5_delivery_ledger t8_failure_streaks".split()


def _rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return str(bool(v)) if type(v).__name__ in ("bool", "bool_") else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows_as_sql(spark, duck, name):
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(duck.execute(ORACLES[name]).df())
