from __future__ import annotations

from pyspark.sql import functions as F

from foliant.sources import files


def test_scripts_come_back_as_written(spark, tmp_path):
    u = spark.createDataFrame([(1, 0, 0, "Hello.", "body", "en"), (1, 0, 1, "λόγος", "digression", "grc"), (1, 1, 0, None, "body", "en"), (1, 1, 1, "Second", "body", None)], "doc_id int, section_idx int, utt_idx int, text string, manner string, lang string")
    t = spark.createDataFrame([(1, 0, "One, and!"), (1, 1, "Two")], "doc_id int, section_idx int, title string")
    rows = files.scripts(u, t, ["doc_id", "section_idx"], "utt_idx").collect()
    assert sorted(r.file for r in rows) == ["01_one_and", "02_two"]
    for r in rows:
        (tmp_path / f"{r.file}.txt").write_text(r.content)
    (tmp_path / "01_one_and.unwoven.txt").write_text("[^a]: note\n")
    (tmp_path / "03_old.txt").write_text("no header\n\n[body]\nText\n\n[bad tag here]\nx\n\n[body]\n\n")
    back = files.read_scripts(spark, str(tmp_path)).orderBy("file", "utt_idx").collect()
    assert [tuple(r) for r in back] == [("01_one_and", "One, and!", 1, "Hello.", "body", "en"), ("01_one_and", "One, and!", 2, "λόγος", "digression", "grc"), ("02_two", "Two", 1, "Second", "body", "en"), ("03_old", "03_old", 1, "Text", "body", "en")]


def test_usage_drops_broken_lines(spark, tmp_path):
    good = '{"timestamp": "t", "provider_label": "p", "input_tokens": 1, "output_tokens": 2, "calls": 1, "truncated": 0}'
    (tmp_path / "u.jsonl").write_text(f'{good}\n\nbroken\n{{"timestamp": "t"}}\n{good[:-1]}, "extra": 1}}\n')
    assert files.read_usage(spark, str(tmp_path / "u.jsonl")).count() == 1


def test_lexicon_canon_and_playlist(spark, tmp_path):
    (tmp_path / "lexicon.json").write_text('{"_note": {"lang": "x"}, "Yates": {"phonemes": "jeɪts"}, "Bad": {}, "Ort": {"lang": "de", "note": "y"}}')
    assert sorted(tuple(r) for r in files.read_lexicon(spark, str(tmp_path / "lexicon.json")).collect()) == [("Ort", "lang", "de"), ("Yates", "phonemes", "jeɪts")]
    tier = files.canon_tier(spark, '[classical]\n"Num" = "Numa"\n"Ann" = { spoken = "Annals", note = "n" }\n"Gen" = { note = "?" }\n', "classical")
    assert sorted((tuple(r) for r in tier.collect()), key=str) == [("Ann", "Annals"), ("Gen", None), ("Num", "Numa")]
    tracks = spark.createDataFrame([(1, 2, "B", 60.5, "x", "02.wav"), (1, 1, "A, B", 61.4, "y", "01.wav")], "doc_id int, section_idx int, title string, seconds double, reciter string, file string")
    assert files.playlist(tracks, "doc_id").first().content == "#EXTM3U\n# reciter: x\n# reciter: y\n#EXTINF:61,A‚ B\n01.wav\n#EXTINF:60,B\n02.wav\n"
    assert files.digests(spark, str(tmp_path)).select(F.length("digest")).first()[0] == 64
