from __future__ import annotations

from datetime import datetime

import __spark_entry__

DAY, LATER = datetime(2025, 5, 29), datetime(2025, 6, 5)


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_p3_found_takes_all_utterances_and_epub_sections_once(spark, tmp_path):
    d = str(tmp_path)
    write(spark, d, "utterances", [(1, "A b. C d.", DAY), (1, "A b. C d.", LATER), (2, None, DAY), (3, " ", DAY), (4, "E f", None)], "utt_id bigint, text string, loaded_at timestamp_ntz")
    write(spark, d, "doc_meta", [(1, ".epub", DAY), (1, ".epub", LATER), (2, ".pdf", DAY)], "doc_id bigint, suffix string, loaded_at timestamp_ntz")
    write(spark, d, "sections", [(7, 1, "G h.\n\nI", DAY), (7, 1, "G h.\n\nI", LATER), (8, 2, "No.", DAY), (9, 1, None, DAY)], "section_id bigint, doc_id bigint, text string, loaded_at timestamp_ntz")
    out = __spark_entry__.queries()["p3_found"](spark, d)
    assert [f"{n} {t}" for n, t in out.dtypes] == ["kind string", "row_id bigint", "start_at bigint", "end_at bigint"]
    assert sorted(tuple(r) for r in out.collect()) == [("section", 7, 0, 4), ("section", 7, 6, 7), ("utterance", 1, 0, 4), ("utterance", 1, 5, 9), ("utterance", 4, 0, 3)]
