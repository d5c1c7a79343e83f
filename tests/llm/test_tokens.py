"""Token ids of plain words: letters are asked once for all the marks that they occur with, and ids are those of whole texts."""

from __future__ import annotations

import random

import public_tokenizers

from taktwerk.llm.token_files import PieceEncoder


def test_letters_are_asked_once():
    """Before, every word was a text of its own to the tokenizer, with each of its marks."""
    encoder = PieceEncoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert encoder.plain
    marks = ["", ".", ",", "!!", "###", "_", "'", "-;"]
    encoder([" ".join(["x", *(f"qxzjvw{m}" for m in marks), "Überßqx?"])])
    texts, asked = [], encoder._learn
    encoder._learn = lambda keys: texts.extend(keys) or asked(keys)
    lines, whole = encoder.lines, encoder._whole
    encoder._whole = lambda t: texts.append(t) or whole(t)

    class Told:
        def encode_batch_fast(self, some, **more):
            texts.extend(some)
            return lines.encode_batch_fast(some, **more)

    encoder.lines = Told()
    assert encoder(["x qxzjvw$ qxzjvw.,"]) == [whole("x qxzjvw$ qxzjvw.,")]
    assert sorted(texts) == ["$", ".,"]


def test_ids_of_plain_and_odd_words_are_those_of_texts():
    encoder = PieceEncoder(str(public_tokenizers.path("byte_bpe_50k.json")), keep=500)
    rng = random.Random(1)
    chars = "aZéßÀɏʼnĊĠ×÷ªº_'.-,!9² \n\t中😀ɐΩ'"
    texts = ["".join(rng.choices(chars, k=rng.randrange(0, 60))) for _ in range(1_500)] + ["it's don't 'tis x'll' a''s Ċ ĊĠ", "", "a.b c_d e' 'f"]
    for k in range(0, len(texts), 100):
        some = texts[k : k + 100]
        assert encoder(some) == [encoder._whole(t) for t in some]
