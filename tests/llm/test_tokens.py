import random

import pytest

from canteria.llm import tokens

ENC = tokens.encoding(tokens.TOKENIZER_DIR, tokens.VOCABULARY)


@pytest.mark.parametrize("size", [20_001, 90_000, 1_000_000])
@pytest.mark.parametrize("kind", ["letter", "letters", "han", "thai", "marks"])
def test_unbroken_texts_are_counted_whole(kind, size):
    rng = random.Random(size)
    pick = {"letter": "x", "letters": "abcdefghijklmnopqrstuvwxyz", "han": "的一是不了人我在有他这中大来上个国", "thai": "กขคงจฉชซญดตถทนบปผพฟมยรลวสหอ", "marks": "-=*"}[kind]
    text = "".join(rng.choices(pick, k=size))
    assert tokens.count(text, ENC) == len(ENC.encode_ordinary(text))


@pytest.mark.parametrize("space", [" ", "\n", "\t \n", "\u2003", "\x85\xa0"])
@pytest.mark.parametrize("size", [999, 1000, 1001, 3000])
def test_runs_of_white_space_are_cut_where_the_tokenizer_cuts(space, size):
    run = (space * size)[:size]
    for text in (run, f"a{run}", f"{run}a", f"a{run}b {run}12{run}.{run}", f"x{run}\x1cy", f"Don't{run}'s go"):
        assert tokens.count(text, ENC) == len(ENC.encode_ordinary(text))


def test_very_long_white_space_does_not_fail():
    want = tokens.count(" " * 2000 + "x", ENC) - tokens.count(" " * 1000 + "x", ENC)
    assert want > 0
    assert tokens.count(" " * 1_000_000 + "x", ENC) > 100 * want and tokens.count("\n" * 1_000_000, ENC) > 0


def test_counts_by_hand():
    assert tokens.count(None, ENC) == tokens.count("", ENC) == 0
    assert tokens.count("hola mundo", ENC) == len(ENC.encode_ordinary("hola mundo")) > 1
