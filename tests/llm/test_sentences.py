from __future__ import annotations

import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from citetrail.llm import sentences as S


def corpus():
    rng = random.Random(1)
    out = []
    for _ in range(400):
        subject, verb = rng.choice(["The rotor", "A sensor", "The housing", "It"]), rng.choice(["stops", "turns", "was tested"])
        parts = [f"{subject} {verb} (see Fig. {rng.randrange(99)}).", f"Dr. {rng.choice('ABCD')}onat found {rng.randrange(9)}.{rng.randrange(9)} mm.", f'The sign reads "Stop. Wait." and {subject.lower()} {verb}.', f"{subject} was sold by Acme Ltd.", f"Why does {subject.lower()} fail?"]
        rng.shuffle(parts)
        out.append("显示屏提示“停止。等待。”并释放元件。模块压紧。\n\n" + "\n\n".join(" ".join(parts[i : i + rng.randrange(1, 4)]) for i in range(0, 5, 2)))
    return out


def model():
    counts, memo = Counter(), {}
    for t in corpus():
        S.count_events(t, counts, memo)
    return S.fit(counts)


MODEL = model()


def cut(text):
    return [text[a:b] for a, b in zip(*S.units(text, MODEL), strict=True)]


def test_abbreviations_and_quotes():
    assert cut("Dr. Bonat found 1.5 mm. The rotor stops (see Fig. 7). It turns.") == ["Dr. Bonat found 1.5 mm.", "The rotor stops (see Fig. 7).", "It turns."]
    assert cut('The sign reads "Stop. Wait." and it turns. The rotor was sold by Acme Ltd. A sensor stops.') == ['The sign reads "Stop. Wait." and it turns.', "The rotor was sold by Acme Ltd.", "A sensor stops."]
    assert cut("Why does it fail?The rotor stops.  It turns.") == ["Why does it fail?", "The rotor stops.", "It turns."]


def test_blocks_and_claims():
    assert cut("CLAIMS\n\n1. A rotor. It turns.\n2. The rotor of\nclaim 1.\n  a) more\n\n[0001] The rotor\nstops. It turns.") == ["CLAIMS", "1. A rotor. It turns.", "2. The rotor of\nclaim 1.\n  a) more", "[0001] The rotor\nstops.", "It turns."]
    assert cut("") == [] and cut(" \n\t\n ") == []


def test_scripts():
    assert cut("驱动轴压紧模块。显示屏提示“停止。等待。”并释放元件。为什么失效？") == ["驱动轴压紧模块。", "显示屏提示“停止。等待。”并释放元件。", "为什么失效？"]
    assert cut("圧力は約9．9MPaとした．弁座は透明である．") == ["圧力は約9．9MPaとした．", "弁座は透明である．"]
    assert cut("[0001] โรเตอร์โปร่งใส ตัวเรือนถอดออกได้\n\n1. อุปกรณ์ ตามข้อ") == ["[0001] โรเตอร์โปร่งใส", "ตัวเรือนถอดออกได้", "1. อุปกรณ์ ตามข้อ"]


def test_lao_without_signs():
    """Sentences of a script with neither terminators nor spaces between words: a space ends one, and where it is missing the characters tell."""
    rng = random.Random(7)
    starts, middles, ends = ["ໂຣເຕີນີ້ຖືກ", "ເຊັນເຊີອັນ", "ກ່ອງພາຍນອກ"], ["ວັດແທກໂດຍ", "ປະກອບດ້ວຍ", "ເຊື່ອມຕໍ່ກັບ", "ຕິດຕັ້ງຢູ່"], ["ແຜ່ນຮອງພື້ນ", "ມໍເຕີຕົ້ນຕໍ", "ຊັ້ນປ້ອງກັນ"]
    one = lambda: rng.choice(starts) + "".join(rng.sample(middles, 2)) + rng.choice(ends)
    counts, memo = Counter(), {}
    for _ in range(600):
        S.count_events(" ".join(one() for _ in range(4)), counts, memo)
    m = S.fit(counts)
    a, b, c = one(), one(), one()
    text = f"{a} {b}{c}"
    assert [text[x:y] for x, y in zip(*S.units(text, m), strict=True)] == [a, b, c]


def test_terminators_of_other_scripts():
    for stop in "។။۔።":
        assert cut(f"အလွန်ကောင်း{stop} ဒါပြီး{stop}") == [f"အလွန်ကောင်း{stop}", f"ဒါပြီး{stop}"]


def test_rare_pairs_are_bounded(spark):
    """What reaches the driver keeps the sums of all places, whatever pairs are rare."""
    df = spark.createDataFrame([(t,) for t in corpus()], "text string")
    whole = S.fit_corpus(df)
    assert {k for k in whole.before if k[:1] != "<"} == {k for k in MODEL.before if k[:1] != "<"}
    for k, (yes, no) in MODEL.before.items():
        assert abs(yes + no - sum(whole.before[k])) < 1e-6


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z.?!\n\"“”()9。ก \t1[]…«»")), max_size=60))
def test_every_character_in_one_unit(text):
    starts, ends = S.units(text, MODEL)
    assert all(a < b for a, b in zip(starts, ends, strict=True)) and all(b <= a for b, a in zip(ends, starts[1:], strict=False))
    assert re.sub(r"\s", "", "".join(text[a:b] for a, b in zip(starts, ends, strict=True))) == re.sub(r"\s", "", text)
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in zip(starts, ends, strict=True))


def test_operator(spark):
    texts = corpus()[:50]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "The rotor stops.", "x"), (98, None, "x"), (99, "", "x"), (100, "\n ", "x"), (101, "word " * 60_000 + "end.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_char string")
    got = S.sentence_units(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    for i, t in enumerate(texts):
        assert sorted(by[i]) == [tuple(x) for x in zip(*S.units(t, S.fit_corpus(df)), strict=True)] if i < 2 else by[i]
    assert by[None] == [(0, 16)] and by[101] == [(0, 300_004)] and not {98, 99, 100} & set(by)
    assert S.sentence_units(df.limit(0)).count() == 0
