"""Canonical forms, sentences and personal information."""

import numpy as np
import pytest

from mnemospark.llm import personal, sentences
from mnemospark.llm.canonical import canonicalise, recognise

SAME = [
    ("forget this", "ｆｏｒｇｅｔ ｔｈｉｓ"), ("forget this", "fоrget this"), ("forget this", "for​get this"), ("José", "José"), ("affirm the office", "aﬃrm the oﬃce"), ("パスワード", "ﾊﾟｽﾜｰﾄﾞ"), ("Привет", "Пpивeт"), ("συζήτηση", "συζήτηση"), ("Łukasz", "Łukаsz"), ("清空 2026", "清空　2026"), ("ξέχασε το", "ξέχασε τo"),
]
DIFFERENT = [("forget this", "Forget this"), ("José", "Jose"), ("who?", "who??"), ("forget this", "forgetthis"), ("グループ", "クルーフ"), ("l1", "ll"), ("rn", "m")]


def test_forms(spark):
    texts = [x for pair in SAME + DIFFERENT for x in pair] + [None, "", "a" * 200_000]
    rows = canonicalise(spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "n int, t string, t_canonical string"), ["t"]).orderBy("n").collect()
    form = [r.t_canonical for r in rows]
    assert all(form[2 * i] == form[2 * i + 1] for i in range(len(SAME)))
    assert all(form[2 * i] != form[2 * i + 1] for i in range(len(SAME), len(SAME) + len(DIFFERENT)))
    assert form[-3:] == [None, "", "a" * 200_000]


def test_recognising(spark):
    known = spark.createDataFrame([(1, "content", "mute ｔhe bot"), (2, "speaker", "mute the bot"), (3, "content", None), (4, "content", "mute the bot")], "ref_id bigint, field string, known_text string")
    rows = spark.createDataFrame([(1, "mute the bоt", None, 1), (2, "mute the bot", "mute the bot", 1), (2, "mute the bot", "x", 1), (3, None, None, 1)], "row_id bigint, content string, speaker string, field int")
    got = sorted(map(tuple, recognise(rows, known, ["content", "speaker"]).collect()))
    assert got == [(1, "content", 1), (1, "content", 4), (2, "content", 1), (2, "content", 1)]
    assert recognise(rows.limit(0), known, ["content"]).count() == 0 and recognise(rows, known.limit(0), ["content"]).count() == 0


TEXTS = [
    ["Dr. Ann saw it at 5 p.m. and left.", "She signed as A. B. Stone, Ph.D., in the U.N. office."], ["The call ended at 5 a.m.", "He lives at 7 Elm Rd. near fig. 3."], ["It cost 3.5 euros!", "Really?!", "Yes..."], ['"Stop. I mean it," he said.', "Then (see p. 4. Or not.) he went."],
    ["他说：“先别走。等我。”然后走了。", "太好了！", "版本1.2还没测试……", "走吧。"], ["Der 8. Versuch am 7. Oktober mit z. B. einem Seil gelang.", "Das war knapp!"], ["¿De verdad?", "¡Qué bien!", "Quizás mañana... o nunca."], ["วันนี้ไปไหนมา", "ราคา 5.50 บาทครับ", "ขอบคุณ"],
    ["उसने कहा, \"रुको। आता हूँ।\" और चला गया।", "यह अच्छा है।"], ["Est-ce vrai ?", "« Attends. Je viens », dit Paul."], ["The wind blew.", "Files are in notes.a.txt at wiki.example/v1.2 now."],
]


@pytest.mark.parametrize("parts", TEXTS)
def test_sentences(parts):
    text = "  " + " ".join(parts) if not any("一" <= c <= "鿿" for c in parts[0]) else "".join(parts)
    assert [text[a:b] for a, b in sentences.split(text, sentences.PRIOR_WEIGHTS)] == parts


def test_blocks_and_breaks():
    text = "Heading\n \nOne line\nand the next. Two.\r\n\r\nEnd"
    assert [text[a:b] for a, b in sentences.split(text, sentences.PRIOR_WEIGHTS)] == ["Heading", "One line\nand the next.", "Two.", "End"]
    assert sentences.split("", sentences.PRIOR_WEIGHTS) == [] and sentences.split(" \n\n ", sentences.PRIOR_WEIGHTS) == []


def test_training_moves_towards_what_is_reliable():
    weights = sentences.fit([(("dot", "next upper", "short"), False, 50), (("dot", "next upper", "long"), True, 50)])
    index = sentences.INDEX
    assert weights[index["short"]] < sentences.PRIOR["short"] and weights[index["long"]] > sentences.PRIOR["long"]
    assert np.array_equal(sentences.fit([]), sentences.PRIOR_WEIGHTS)


def test_sentences_of_a_table(spark):
    rows = [(1, "A dog ran. It barked!", 9), (2, None, 9), (3, "", 9), (4, " \n ", 9), (5, "word " * 40_000 + ".", 9), (1, "A dog ran. It barked!", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start_char int")
    got = sorted(map(tuple, sentences.sentences(df).collect()))
    assert got == [(1, 0, 10), (1, 0, 10), (1, 11, 21), (1, 11, 21), (5, 0, 200_001)]
    assert sentences.sentences(df.limit(0)).count() == 0


def test_personal_information_on_held_out_texts():
    texts, listed = personal.training_texts(300, seed=99)
    gazetteer, weights = personal.Gazetteer(listed), personal.trained_weights()
    right = wrong = missed = 0
    for text, gold in texts:
        found = {(a, b, k) for a, b, k, _ in personal.segments(text, gazetteer, weights)}
        right, wrong, missed = right + len(found & gold), wrong + len(found - gold), missed + len(gold - found)
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.85


CASES = [
    ("call +49 30 23125 110 after lunch", "call [PHONE] after lunch"), ("mail ann.lee+x@mail.example.org or call (312) 555-0151", "mail [EMAIL] or call [PHONE]"), ("order 4471-55-383 still shows as pending", None), ("单号1077-4921还没发货", None), ("the score was 202-555", None), ("invoice 2026-0042-19 has no phone on it", None),
    ("SSN 987-65-4321, needed", "SSN [ID_NUMBER], needed"), ("我住在翠鹭路25号1单元，别走错", "我住在[ADDRESS]，别走错"), ("pickup is at 65 Old Quince Road, Unit 3B as usual", "pickup is at [ADDRESS] as usual"), ("Larkspur Lane is noisy", None), ("the landlord is called Halvard Yarrowick", "the landlord is called [NAME]"), ("text me (07700 900 116) if late", "text me ([PHONE]) if late"), ("see you at Momo's", None),
]


def test_redaction(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(CASES)] + [(100, None, "x"), (101, "", "x"), (102, "é" * 100_000 + " a@b.example", "x")], "id int, content string, kind string")
    got = {r.id: r.content for r in personal.redact(df, "content").collect()}
    assert [(t, got[i]) for i, (t, want) in enumerate(CASES) if got[i] != (want or t)] == []
    assert got[100] is None and got[101] == "" and got[102].endswith(" [EMAIL]")
    assert personal.personal_kinds(df.limit(0), "id", "content").count() == 0
    segments = personal.personal_segments(df, "id", "content").where("id = '1'").orderBy("start_char").collect()
    assert [(s.kind, s.value) for s in segments] == [("email", "ann.lee+x@mail.example.org"), ("phone", "(312) 555-0151")]


def test_names_beyond_the_limit_are_found_alike(spark, monkeypatch):
    names = ["Halvard Yarrowick", "Mina Okonjo", "Serge Albarn", "momo_42", "李清照", "王小波", None]
    identities = spark.createDataFrame([(n,) for n in names], "display_name string")
    texts = ["Halvard Okonjo told me so", "thanks, Mina Yarrowick", "Unknown Person told me so", "今天李清照和王小波来了", "王清照没来", None, "", "call +49 30 23125 110"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, content string, kind string")
    found = lambda: sorted(map(tuple, personal.personal_segments(df, "id", "content", identities).collect()))
    clean = lambda: sorted(map(tuple, personal.redact(df, "content", identities).collect()), key=str)
    few = found(), clean(), sorted(map(tuple, personal.personal_kinds(df, "id", "content", identities).collect()))
    monkeypatch.setattr(personal, "GAZETTEER_LIMIT", 6 - 1)
    many = found(), clean(), sorted(map(tuple, personal.personal_kinds(df, "id", "content", identities).collect()))
    assert few == many and any(k == "name" for _, k, *_ in few[0]) and len(few[1]) == len(texts)


TRAINED = [
    ["The call is over for now.", "She left it to the bot.", "He came at 5 p.m. and left."], ["Jan. and Feb. were cold.", "See fig. 3 on p. 4."], ["\"Nobody told me.\"", "Did anyone look?"], ["La Dra. Ruiz vive cerca.", "¿De verdad?"], ["Hrn. Maier kam am 7. Mai.", "Das war z. B. gut."], ["M. Noir arrive.", "« Attends. Je viens », dit Paul."],
    ["她说：“先别走。等我。”然后走了。", "好。"],
]


@pytest.mark.parametrize("parts", TRAINED)
def test_sentences_with_learnt_weights(parts):
    """Weights that made texts teach, in which months come before small letters and quotations before capitals."""
    from collections import Counter

    lessons = Counter()
    for text in ["Jan. and Feb. were warm.\n\nThe bot.\n\nAll is well for now.\n\n“No! Not again.” and so on.\n\nIt took 3 s.", "We met at 5 p.m. and ate, e.g. a pie.\n\nBut why.\n\nVersion 2 vs. version 3 won.", "Wir brauchen z. B. ein Seil.\n\nJa.\n\nDas war es."] * 40:
        lessons.update(sentences.lessons(text))
    weights = sentences.fit([(names, label, n) for (names, label), n in sorted(lessons.items())])
    text = " ".join(parts) if not any("一" <= c <= "鿿" for c in parts[0]) else "".join(parts)
    assert [text[a:b] for a, b in sentences.split(text, weights)] == parts


def test_a_missing_space_does_not_join():
    parts = ["It ended at 8:45.", "The rest is open.", "\"Who knows?\" asked Ann."]
    text = "".join(parts)
    assert [text[a:b] for a, b in sentences.split(text, sentences.PRIOR_WEIGHTS)] == parts
