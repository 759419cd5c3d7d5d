"""Ids of words by their stems: the same as the tokenizer's on whole texts, with one look into its model for all forms of a stem."""

import random

import numpy as np
import public_tokenizers

from stratagraph.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def _whole(enc, text):
    return np.array(enc.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_ids_of_words_are_those_of_whole_texts():
    enc, rng = packing._Encoder(PATH), random.Random(3)
    letters = "abzABZß×÷ÀÖØöøÿÉéŸİıſσΣςªº²½'\"~,.;<|>&$#09_-`̸̧́­\u0085Ὧ\x1c\x1fжЖ中ﬁÅ€"
    texts = ["".join(rng.choice(letters + "   ") for _ in range(rng.randrange(1, 16))) for _ in range(4000)]
    texts += ["<|endoftext|> foo<|endoftext|>.", "É,, é. É é́. ́é", "don't 'S! a' 's x's", "~ ~~a~ Ab~ ß~", "× a× ÷. ÀÉ''", ""]
    assert enc.by_stems
    assert enc.encode(texts) == [_whole(enc, t) for t in texts]


def test_forms_of_a_stem_share_one_look_into_the_model():
    enc = packing._Encoder(PATH)
    words = [f"{w}{tail}" for stem in ("rerthion", "él") for w in (stem, stem.title(), stem.upper()) for tail in ("", ",", ".", "###", "~")]
    asked, real = [], enc.model

    class Model:
        def tokenize(self, text):
            asked.append(text)
            return real.tokenize(text)

    enc.model = Model()
    assert enc.encode([" ".join(words)]) == [_whole(enc, " ".join(words))]
    assert len(asked) == 2 and set(enc.signs) == {b"", b",", b".", b"###", b"~"}


def test_memories_of_stems_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "_MEMO", 50)
    enc = packing._Encoder(PATH)
    texts = [" ".join(f"Stem{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k)}," for i in range(40)) for k in range(20)]
    assert [enc.encode([t])[0] for t in texts] == [_whole(enc, t) for t in texts]
    assert len(enc.stems) <= 50 + 40 and len(enc.stems_before) <= 50 + 40
