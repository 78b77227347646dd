"""Sentence units by hand, and what holds for any text."""

import random
from functools import lru_cache

import pytest

S = pytest.importorskip("tickloom.llm.sentences")


def split(text, m=None, **how):
    return [text[a:b] for a, b in S.units(text, m or S.model_of([]), **how)]


CASES = [
    "The lease ended.|Nobody paid the rent!|Was it lost?",
    "[3] He paid GBP 5,400.50 for it.|The fence measured 27.06 m.",
    "“We never agreed to it!” wrote the owner on Monday.|Then it ended.",
    '"The crane was wet. It stayed wet," said the judge.|Nobody agreed.',
    "She answered: “I kept the crane.”|Then she left.",
    "He saw it (see the ledger. Page nine) and left.|Nobody followed.",
    "The tribunal found: (a) it existed; (b) it did not; and (c) nothing else.|Nothing followed.",
    "They paid for it . . . and then asked for it back.|Nobody agreed.",
    "Er schrieb: „Den Bescheid habe ich nie gesehen.“|Dann verlor er.",
    "„Der Antrag gehört mir. Das weiß jeder“, erklärte der Anwalt.|Niemand widersprach.",
    "Elle a écrit : « Je n'ai jamais vu le pont. »|Le canal est loin.",
    "¿Se entregó a tiempo?|¡No puede prosperar!|Nadie lo discutió.",
    "“租约是我的。大家都知道。”谭思默先生当庭如此陈述。|该码头是否按时交付？|（双方对此均无异议。）|“许可是我的。”桂澜如此陈述。",
    "利率为13.03%，谭思默未提出异议。|参见第130条。",
    "「塀は私のものだ。皆が知っている。」と証人は供述した。|水路は期限内に引き渡されたか。|（この点に争いはない。）|記録参照。",
    "पट्टा समय पर सौंपा गया?|नहर खाली था।|अपील खारिज की जाती है!",
    "هل سُلّم الجسر؟|بلغت النسبة 20.24 في المئة.|ولم يُنازع أحد.",
    "Παραδόθηκε το κανάλι;|Το επιτόκιο ήταν 2,53 τοις εκατό· πολύ.|Κατέθεσε ο μάρτυρας.",
    "(1) พยานให้การว่างเปล่า|คู่ความไม่โต้แย้ง|จำเลยจ่ายเงิน 791 โครนเป็นค่า|ศาลเห็น",
    "The ledger vanished!Nobody found it.",
    "A single line\nbreak does not end it.|This is\nthe next one.",
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    m = S.model_of([])
    want = case.split("|")
    if "!Nobody" in case:
        want = ["The ledger vanished!", "Nobody found it."]
        assert split(case, m) == want
        return
    glue = "" if any("぀" <= c <= "鿿" for c in case) else " "
    text = glue.join(want)
    assert split(text, m) == want
    assert split("\n \n".join([text, text]), m) == want * 2


def test_texts_in_one_case():
    want = ["[16] after brief talks the baker weighed a valve.", "nobody in the town copied it earlier.", "since then 3.5 of it is lost."]
    assert split(" ".join(want)) == want
    assert split(" ".join(want).upper()) == [w.upper() for w in want]
    assert split("the baker weighed a valve.nobody copied it earlier.") == ["the baker weighed a valve.", "nobody copied it earlier."]
    assert split("EACH NOTICED ITS JAR. AFTER IT CAME ANOTHER.") == ["EACH NOTICED ITS JAR.", "AFTER IT CAME ANOTHER."]
    assert split("THE BAKER WEIGHED A VALVE.NOBODY COPIED IT.") == ["THE BAKER WEIGHED A VALVE.", "NOBODY COPIED IT."]


def test_blocks():
    text = "Court of Quenby\n\n27-0001/17\r\n \r\nHaverquist v. Orvelle Mills\n　\nThe lease ended.  Nobody paid.\n\n\n  \nMr. Judge"
    assert split(text) == ["Court of Quenby", "27-0001/17", "Haverquist v. Orvelle Mills", "The lease ended.", "Nobody paid.", "Mr. Judge"]


THAI = ["คู่ความไม่โต้แย้งเรื่องกำแพง", "ศาลเห็นว่าโกดังชำรุดมาก่อน", "พยานให้การว่าสะพานว่างเปล่า", "อัตราดอกเบี้ยคือร้อยละ 11.82 ต่อปี", "จำเลยจ่ายเงิน 791 โครนเป็นค่ากำแพง"]


@lru_cache(1)
def thai_model():
    rnd = random.Random(3)
    names = ["ทัสเมอร์", "ออเวล", "มัลดริน", "[ปกปิด]"]
    docs = []
    for _ in range(60):
        blocks = [f"{rnd.choice(names)} กับ {rnd.choice(names)}"]
        blocks += [f"[{i + 1}] " + " ".join(rnd.choices(THAI, k=rnd.choice([1, 1, 2, 3]))) for i in range(8)]
        docs.append("\n\n".join([*blocks, f"ผู้พิพากษา {rnd.choice(names)}"]))
    return S.model_of(docs)


def test_scripts_without_marks_go_by_the_model():
    m = thai_model()
    assert split(" ".join(THAI), m) == THAI
    told = ["ศาลเห็นว่าโกดังชำรุดมาก่อน", "คู่ความไม่โต้แย้งเรื่องกำแพง", "พยานให้การว่าสะพานว่างเปล่า"]
    assert split("[9] " + " ".join(told), m) == ["[9] " + told[0], *told[1:]]
    # what never begins or ends a paragraph does not here: no list of words says so
    for block in ("มัลดริน กับ ทัสเมอร์", "[ปกปิด] กับ ออเวล", "ผู้พิพากษา ทัสเมอร์", "ผู้พิพากษา [ปกปิด]"):
        assert split(block, m) == [block]
    assert len(split("มัลดริน กับ ทัสเมอร์")) > 1  # untrained, spaces end sentences


def test_long_quotations_and_brackets():
    inner = "The crane was wet. It stayed wet. " * 60
    for o, c in ("“”", '""', "()", "«»"):
        want = [f"The owner said {o}{inner}so it was{c} and left.", "Nobody followed."]
        assert split(" ".join(want)) == want
    assert S.spans_of("(" * 50_000 + "x." + "“" * 50_000, 0) == []


def test_abbreviations_are_learned():
    rnd = random.Random(5)
    names = ["Quill", "Maldrin", "Orvelle", "Tasmer"]
    said = ["Counsel for Zwxpq. {} conceded it.", "The owner of Zwxpq. {} paid the harvest.", "The court agreed with the owner.", "The harvest ended in August."]
    texts = ["\n\n".join(" ".join(s.format(rnd.choice(names)) for s in rnd.choices(said, k=rnd.choice([1, 1, 2, 3]))) for _ in range(4)) for _ in range(40)]
    want = ["Counsel for Zwxpq. Maldrin conceded it.", "The court agreed with the owner."]
    assert split(" ".join(want), S.model_of(texts)) == want
    assert len(split(" ".join(want))) == 3


def test_closing_marks_are_learned():
    # a mark that stands within paragraphs only ends nothing
    texts = ["他说好！然后走了。\n\n大家都知道。他说好！然后走了。"] * 60
    assert split("他说好！然后走了。", S.model_of(texts)) == ["他说好！然后走了。"]
    assert split("他说好！然后走了。") == ["他说好！", "然后走了。"]


def test_forward_backward_decides():
    rnd = random.Random(2)
    said = ["The owner paid for the long harvest of the year.", "Nobody in the town agreed with the court.", "Zwx. Quill met the owner again.", "Zwx. Orvelle and the panel agreed."]
    texts = ["\n\n".join(" ".join(rnd.choices(said, k=rnd.choice([1, 1, 2, 3]))) for _ in range(5)) for _ in range(60)]
    m = S.model_of(texts)
    assert m.length["l", 1] < 0.2 < m.base["l"]
    # the number by itself would end a sentence; directly after a boundary it does not
    text = "The owner paid for the long harvest of the year. 1990. Marlowe left the town."
    assert split(text, m, forward_backward=False) == ["The owner paid for the long harvest of the year.", "1990.", "Marlowe left the town."]
    assert split(text, m) == ["The owner paid for the long harvest of the year.", "1990. Marlowe left the town."]


def test_posteriors_against_all_paths():
    import itertools
    import math

    m = S.model_of([])
    m.base["l"], m.length = 0.6, {("l", 1): 0.05, ("l", 2): 0.3, ("l", 3): 0.6}
    rnd = random.Random(11)
    for _ in range(200):
        n = rnd.randrange(1, 7)
        odds, tokens = [rnd.uniform(-3, 3) for _ in range(n)], [rnd.randrange(1, 4) for _ in range(n)]
        mass = [0.0] * n
        total = 0.0
        for path in itertools.product((0, 1), repeat=n):
            p, before = 1.0, 1
            for e, x, k in zip(path, odds, tokens):
                h = m.length["l", k] if before else 0.6
                p *= h * math.exp(x - math.log(0.6 / 0.4)) if e else 1 - h
                before = e
            total += p
            for i, e in enumerate(path):
                mass[i] += p * e
        assert m.decide("l", odds, tokens) == [x > total / 2 for x in mass]


def test_the_vocabulary_is_bounded(spark, monkeypatch):
    texts = [f"The w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}x ended. Nobody paid." for i in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = S.train(df)
    few = S.model_of(texts)
    assert (whole.h == few.h).all() and (whole.sure == few.sure).all() and (whole.open == few.open).all()
    monkeypatch.setattr(S, "VOCABULARY", 8)
    small = S.train(df)
    assert len(small.h) <= 8
    # the most frequent ones stay, with their own counts
    at = dict(zip(whole.h.tolist(), (whole.sure + whole.open).tolist()))
    for h, n in zip(small.h.tolist(), (small.sure + small.open).tolist()):
        assert n == at[h] == max(v for k, v in at.items() if k % 8 == h % 8)


def test_what_holds_for_any_text():
    rnd = random.Random(7)
    pieces = ["word", "Word", ".", "!", "?", " ", "  ", "\n", "\n\n", "\r\n", "“", "”", '"', "(", ")", "«", "»", "。", "」", "「", "a.", "9.", "1", "ไทย", "中", "​", "　", "🙂", "…", ";", "é", "[1] "]
    m = S.model_of([])
    for _ in range(3000):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(40)))
        at, covered = 0, []
        for a, b in S.units(t, m):
            assert at <= a < b <= len(t) and not t[a].isspace() and not t[b - 1].isspace() and "\n\n" not in t[a:b]
            covered.append(t[at:a])
            at = b
        assert not "".join([*covered, t[at:]]).strip()


def test_frames(spark):
    rows = [(1, "The lease ended. Nobody paid."), (2, None), (3, ""), (4, " \n\n \t"), (None, "One unit"), (1, "The lease ended. Nobody paid."), (5, "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start_char int")
    got = sorted(((r.doc_id, r.start_char, r.end_char) for r in S.split_sentences(df).collect()), key=str)
    assert got == sorted([(1, 0, 16), (1, 17, 29), (1, 0, 16), (1, 17, 29), (None, 0, 8), (5, 0, 200_000)], key=str)
    assert S.split_sentences(df.limit(0)).count() == 0
