"""Words and their parts are held once, in lower case, and give the tokenizer's ids."""

import random

import public_tokenizers

from sitequarry.llm import packing


def test_words_of_one_table():
    e = packing._Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Der der DER der. it's"]
    assert list(e.batch(texts)) == [e.whole(texts[0])] and set(e) == {"der", "der.", ".", "it's", "it", "'s"}


def test_odd_texts():
    e = packing._Encoder(public_tokenizers.path("word_bpe_49k.json"))
    r, signs = random.Random(3), [*"aAZéÉßΣσςıſŉµªº²½٣中ǅ&_.'<|1", "H̱", "İ", "İ", "'S", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "\x1c", "\x00", "\x85", "\xa0", "​", " ", "\n"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 12))) for _ in range(5000)]
    assert list(e.batch(texts)) == [e.whole(t) for t in texts]
