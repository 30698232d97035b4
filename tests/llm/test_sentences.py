from __future__ import annotations

from foliant.llm.sentences import sentences


def cut(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = sentences(df).orderBy("sentence_no").collect()
    assert all(text[r.start_at : r.end_at] == r.sentence for r in rows)
    return [r.sentence for r in rows]


def test_null_and_blank_give_no_sentence(spark):
    assert cut(spark, None) == cut(spark, "") == cut(spark, " \n\n　\n") == []


def test_plain_sentences_and_blank_lines(spark):
    assert cut(spark, " He came. She left\n\nThe end ") == ["He came.", "She left", "The end"]
    assert cut(spark, "no end mark") == ["no end mark"]


def test_quotations_and_abbreviations_stay_whole(spark):
    text = "„Wer kommt? Niemand“, heißt es. See Dr. Lant, vol. 3. He said \"Go. Now.\" Then he left."
    assert cut(spark, text) == ["„Wer kommt? Niemand“, heißt es.", "See Dr. Lant, vol. 3.", 'He said "Go. Now."', "Then he left."]


def test_clashing_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 7)], "id int, text string, start_at int")
    out = sentences(df, restore=False)
    assert out.columns == ["id", "sentence_no", "start_at", "end_at"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 0, 4), (1, 1, 5, 9)]


def test_cjk_stop_keeps_its_anchor_and_invisible_characters(spark):
    assert cut(spark, "详细描述了书信。[^p20-n2] Because it fell. So") == ["详细描述了书信。[^p20-n2]", "Because it fell.", "So"]
    assert cut(spark, "隐瞒了边界。​ If it﻿﻿\n\n第二篇。﻿﻿\n\n") == ["隐瞒了边界。​", "If it﻿﻿", "第二篇。﻿﻿"]
    assert cut(spark, "名を確かめた。​[^p18-n6]\n\n異国。第三。") == ["名を確かめた。​[^p18-n6]", "異国。", "第三。"]


def test_cjk_quotation_leaves_its_sentence_open(spark):
    text = "他说：“书已失传。没有抄本。”然后在长信中离开了。博学的编者"
    assert cut(spark, text) == ["他说：“书已失传。没有抄本。”然后在长信中离开了。", "博学的编者"]


def test_full_width_full_stop(spark):
    assert cut(spark, "ｓｈｏｗｓ． Once repaired. So") == ["ｓｈｏｗｓ．", "Once repaired.", "So"]
    assert cut(spark, 'ｃａｎｄｌｅｌｉｇｈｔ． "Who preserved it?" They') == ["ｃａｎｄｌｅｌｉｇｈｔ．", '"Who preserved it?"', "They"]
    assert cut(spark, "τρίτῳ βιβλίῳ． διὰ τί φυλάττει.") == ["τρίτῳ βιβλίῳ．", "διὰ τί φυλάττει."]
    assert cut(spark, "Ａｇａｉｎｓｔ ５．１７ ｃｍ Ｊ． Ｋｉｌｉｋ， ｖｏｌ． ３， Ｄｒ． Ｌａｎｔ")[1:] == []
    assert cut(spark, "書は失われた．写本もない．") == ["書は失われた．", "写本もない．"]


def test_long_and_nested_quotations_stay_whole(spark):
    inside = "He went. " * 60
    assert cut(spark, f"They say ‘{inside}So it was.’ Then") == [f"They say ‘{inside}So it was.’", "Then"]
    assert cut(spark, "One (A. B (c. C (d. D) e. E) f. F) two. Three") == ["One (A. B (c. C (d. D) e. E) f. F) two.", "Three"]


def test_private_use_characters_are_letters(spark):
    text = "One two a. B c. D"
    assert cut(spark, text) == ["One two a.", "B c.", "D"]


def test_both_points_of_two_part_abbreviations(spark):
    text = "Vgl. z. B. Nr. 17 und Bd. 17, wo es steht. Er kam d. h. Nach Ostern. Ende"
    assert cut(spark, text) == ["Vgl. z. B. Nr. 17 und Bd. 17, wo es steht.", "Er kam d. h. Nach Ostern.", "Ende"]
