"""Near-duplicate classes over texts of all scripts."""

from __future__ import annotations

from citetrail.functions import text
from citetrail.plans.page_queries import near_dup_classes


def test_script_words(spark):
    df = spark.createDataFrame([("Ein Überzug, 3 mm",), ("模具コート 5",), ("की विधि",), ("ที่นี่",), ("... --",), (None,)], "text string")
    got = [r[0] for r in df.select(text.script_words(df["text"])).collect()]
    assert got == [["ein", "überzug", "3", "mm"], ["模", "具", "コ", "ー", "ト", "5"], ["की", "विधि"], ["ที่", "นี่"], [], None]


def test_every_document_has_a_class(spark, tmp_path):
    hindi = "यह आविष्कार एक ताप विनिमायक से संबंधित है जिसमें कई नलिकाएँ होती हैं"
    chinese, other = "本发明涉及一种用于热交换器的涂层方法及其制备工艺", "一种电池组的冷却装置包括泵和散热片以及控制器"
    rows = [(1, hindi), (2, hindi), (3, chinese + "。"), (4, chinese), (5, other), (6, "Nr 12"), (7, "Nr 12"), (8, "Nr 13"), (9, ""), (10, ""), (11, None), (12, None),
            (13, chinese + " 2021 12 10"), (14, other + " 2021 12 10")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_dup_classes(spark, str(tmp_path)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 9, 11: 11, 12: 12, 13: 3, 14: 5}
