"""Token ids of op8: frequent atoms stay known when the cache overflows, and ids are the tokenizer's however PLAIN and odd words mix."""

import random

import numpy as np

from codexa.llm import packing


def test_frequent_atoms_are_asked_of_the_model_once(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 100)
    encode, asked = packing.Encoder(packing.default_tokenizer()), []
    model = encode.known.atoms.model

    class Counting:
        def tokenize(self, atom):
            asked.append(atom)
            return model.tokenize(atom)

    encode.known.atoms.model = Counting()
    rare = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) for n in range(5000)]
    for at in range(0, 5000, 40):
        text = " ".join(["frequent", "Words,", "don't", "été", *rare[at : at + 40]])
        assert encode([text])[0] == encode.whole(text)
    assert [asked.count(a) for a in ("frequent", "words", ",", "don", "'t", "Ã©tÃ©")] == [1] * 6
    assert len(encode.known.atoms) + len(encode.known.atoms.old) < 300


def test_ids_are_the_tokenizers_in_any_mixture():
    encode, rng = packing.Encoder(packing.default_tokenizer()), random.Random(7)
    signs = [*"abzSTRE''..,!0129@[`{~_^ \n\t   ", "'s", "'re", "'LL", *"éÉßŉŸſıİЁяΣς中’…²½ª×Kǅ", "́", "\xa0", "\r", "\x0b", "\x1c", "\x85", " "]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 30)))
        want = np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encode([text])[0] == want, text
