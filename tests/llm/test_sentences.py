import random
import time

import numpy as np
import pytest

from canteria.llm import seeds
from canteria.llm import sentences as S


def split(text):
    row, start, end = S.split_batch([text], S.train())
    return [text[a:b] for a, b in sorted(zip(start.tolist(), end.tolist()))]


@pytest.mark.parametrize("lang", sorted(seeds.SENTENCES))
def test_accuracy_on_sentences_never_seen(lang):
    """A quarter of the labelled sentences is held out of training, each in turn; blocks are made of those alone."""
    true, given, both = S.held_out_counts((lang,))
    assert both / true >= 0.97 and both / given >= 0.97


def test_no_sentence_is_in_two_parts():
    every = [x for sentences in seeds.SENTENCES.values() for x in sentences]
    assert len(every) == len(set(every))
    part = {k % S.FOLDS: x for k, x in enumerate(seeds.SENTENCES["de"])}
    for fold in range(S.FOLDS):
        assert part[fold] in "".join(S.training_blocks(600, 2, fold, True, ("de",))[0]).replace("\n", " ")


@pytest.mark.parametrize(
    "parts",
    [
        ["El Dr. Gil llegó.", "¿Quién abrió?", "¡Nadie!"], ["Trabaja en Talleres Unidos S. A.", "La oficina cierra."], ["Según J. R. Paz, nada cambia."], ["Sale a las 9:00 p. m.", "La fila crece."],
        ["Vive en EE. UU. desde ayer."], ["Compró sal, etc., y volvió.", "Compró sal, etc.", "Luego durmió."], ["Lo dice la pág. 12 del vol. 3."], ["Escribió: «Ya voy. Espera.» y salió.", "Nadie respondió."],
        ["«¿Vienes?», preguntó Ana.", "«La mesa está lista.»", "Comieron."], ["El cielo (¡qué azul!) brilla."], ["Pesa 3.25 kg.", "La caja se abrió…", "Nadie miró."], ["orden.txt guarda todo.", "lista.csv no."],
        ["The U.S. office opened.", "Mr. Fox left at 8:21 a.m.", "It rained."], ['"Is it late?" asked Tom.', '"It is late."', "They left."], ["“It fell. Nobody saw.” is what Ann wrote."], ["Really?!", "Yes."],
        ["Am 19. Juni kam sie.", "Der 20. Versuch half, z. B. in a.txt.", "„Wann?“, fragte Eva."], ["В 2025 г. Анна ушла.", "Он купил сыр и т. д.", "«Где?» — говорит Анна."], ["Πού είναι;", "Ο κ. Νίκος ξέρει."],
        ["क्या यह सही है?", "यह सही है।", "“चलो।” Anna ने लिखा।"], ["هل هذا صحيح؟", "قال د. Sami إن هذا صحيح."], ["« Où ? » demanda Luc.", "Il part\xa0!"],
    ],
)
def test_sentences(parts):
    assert split(" ".join(parts)) == parts
    assert split(" \n\n".join(parts)) == parts


@pytest.mark.parametrize("parts", [["门开了。", "“谁？”李四问道。", "“好。”", "他说：“走吧。”然后离开。", "书（见第3页。）在桌上！"], ["扉が開いた。", "「誰か？」と彼は尋ねた。", "「良い。」", "終わった！"]])
def test_scripts_without_spaces(parts):
    assert split("".join(parts)) == parts


@pytest.mark.parametrize("n", [1, 5, 6, 60, 2000])
@pytest.mark.parametrize(("a", "b"), ["()", "[]", "«»"])
def test_any_number_of_closing_marks(n, a, b):
    parts = [a * n + "She said it." + b * n, "Then he came."]
    assert split(" ".join(parts)) == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["Gov. Hale spoke.", "Rev. Moss listened."], ["Oct. 5 was cold.", "Nov. 6 was not."], ["Er wohnt Hauptstr. Nr. 5 am Fluss.", "Es kostet ca. 50 kr am Tag."], ["ច្បាប់នេះចាស់។", "យើងទៅផ្ទះ។"],
        ["x" * 90 + "_" * 50 + ".txt holds the list.", "a" * 60 + ".csv does not."], ["“门开了。”" + "很" * 40 + "老的人说道。", "天亮了。"], ["“दरवाज़ा खुला है।” मेरे छोटे भाई मोहन कुमार ने कहा।", "वह गया।"],
    ],
)
def test_nothing_is_too_long(parts):
    assert split(" ".join(parts)) == parts


def test_items_of_any_number():
    assert split("99998. one\n99999. two\n100000. three") == ["99998. one", "99999. two", "100000. three"]


@pytest.mark.parametrize("text", [")" * 100_000 + " x.", "(" * 50_000 + "a." + ")" * 50_000 + " B.", "ab1" * 300_000 + ".txt x. Y.", "“a.” " * 50_000, "7" * 9000 + ". x\n1. y", " \n" * 200_000 + "x", "x" + " " * 500_000 + "\ny"])
def test_strange_texts_take_no_long_time(text):
    begun = time.perf_counter()
    assert split(text)
    assert time.perf_counter() - begun < 20


def test_thai_space_ends():
    for parts in (["เปิดประตูแล้ว", "“ไม่มีใคร”", "กลับบ้าน"], ["มีคนมา12", "เขาอ่านnotes.txt", "ส่งถึงTom", "รอก่อน"]):
        assert split(" ".join(parts)) == parts


def test_layout():
    text = "\n Title of it\n\nFirst line\ngoes on. Second: one; two,\nthree.\n\n\n- item one. still one\n- item\n  wrapped\n\n1. a\n2. art.\n78. no item\n3) c\n"
    assert split(text) == ["Title of it", "First line\ngoes on.", "Second: one; two,\nthree.", "- item one. still one", "- item\n  wrapped", "1. a", "2. art.\n78. no item", "3) c"]
    assert split("\r\n\r\nUno va.\r\nDos va.\r\n\r\nE") == ["Uno va.", "Dos va.", "E"]
    assert split("😀 uno. 😀 dos.")[0].startswith("😀")


def test_nothing():
    assert split("") == split(" \n \xa0") == []
    row, _, _ = S.split_batch([None, "", "x"], S.train())
    assert row.tolist() == [2]


def test_a_batch_gives_what_each_text_gives():
    rng = random.Random(9)
    blocks, _ = S.training_blocks(200, seed=5)
    texts = ["\n\n".join(rng.sample(blocks, 3)) for _ in range(60)]
    row, start, end = S.split_batch(texts, S.train())
    for k, t in enumerate(texts):
        assert sorted(zip(start[row == k].tolist(), end[row == k].tolist())) == sorted(zip(*(x.tolist() for x in S.split_batch([t], S.train())[1:])))


def test_spans_cover_all_but_white_space():
    blocks, _ = S.training_blocks(300, seed=6)
    text = "\n\n".join(blocks) + " ) « ( \" x”” ... . 。 !"
    _, start, end = S.split_batch([text], S.train())
    spans = sorted(zip(start.tolist(), end.tolist()))
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    left = "".join(text[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(text)]))
    assert not left.strip()
    assert all(text[a:b] == text[a:b].strip() for a, b in spans)


def test_long_text_and_frame(spark, monkeypatch):
    monkeypatch.setattr(S, "CHARS_AT_ONCE", 1000)
    long = "La casa abre. " * 30_000
    df = spark.createDataFrame([(1, long, "es"), (None, "Uno. Dos.", "es"), (3, None, "es"), (4, " ", None), (1, "Uno. Dos.", "es")], "doc_id long, text string, inicio string")
    got = S.sentences(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 30_002, None: 2}
    assert S.sentences(df.limit(0)).count() == 0
