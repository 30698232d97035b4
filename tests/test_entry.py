from __future__ import annotations

import __spark_entry__


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).columns == ["section_id", "paragraph_no", "paragraph"]
    assert __spark_entry__.entry(spark).count() > 0
