from __future__ import annotations

import pytest
from test_records import decisions

from tallyspark.schema import LedgerError
from tallyspark.sources.review_log import ReviewLog


def test_order_of_one_batch(spark, tmp_path):
    log = ReviewLog(spark, str(tmp_path / "log"), "csv:a")
    batch = decisions(spark, ("e1", "dismiss", "Ann", None), ("e1", "accept", "Ann", None), ("e2", "accept", "Ann", None))
    with pytest.raises(LedgerError, match="several rows of one entry"):
        log.record(batch)
    log.record(batch, "decision")
    kept = [r["decision"] for r in log.decisions.where("entry_id = 'e1'").orderBy("id").collect()]
    assert kept == ["accept", "dismiss"]
