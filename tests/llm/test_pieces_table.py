"""The Viterbi pass over many units at once against the pass over one, and ties between words."""

import random

import public_tokenizers

from sitequarry.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def words(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    letters = ["etaoinshrdlu", "ABCxyz0189-_./", "éüßñ", "дом", "漢字", "\U0001f600\0\x7f"]
    pick = lambda: rng.choice(letters[min(int(rng.expovariate(1.5)), 5)])
    return ["".join(pick() for _ in range(rng.choice([1, 2, 5, 8, 9, 16, 17, 31, 40, 64, 65, 90]))) for _ in range(n)]


def test_many_units_at_once():
    many, one = pieces.Lattice(PATH), pieces.Lattice(PATH)
    some = words(3, 3000)
    units = list(dict.fromkeys(u for w in some for u in one.units(pieces.SPACE + w)))
    many.fill_parts(units)
    assert len(many.parts) > 1000  # the others go one by one
    assert many.parts == {u: one.part(u) for u in many.parts}


def test_slices_of_cells(monkeypatch):
    some = [w for w in words(5, 2000) if len(w) < 60]
    whole, small = pieces.Lattice(PATH), pieces.Lattice(PATH)
    whole.look_up(some)
    monkeypatch.setattr(pieces, "CELLS", 64 * 100)
    small.look_up(some)
    assert whole.words == small.words


def test_texts_do_not_depend_on_company():
    texts = [" ".join(words(seed, 40)) for seed in range(30)] + ["", " ", "a  b"]
    together, alone = pieces.Lattice(PATH), [pieces.Lattice(PATH) for _ in range(3)]
    together.look_up([w for t in texts for w in t.split(" ")])
    for i, t in enumerate(texts):
        assert together.encode(t, 3, t.split(" ")) == alone[i % 3].encode(t, 3)


def test_ties_go_to_the_earlier_word():
    coder = pieces.Lattice(PATH)
    gap = {w: coder.look_up([w])[0][1] for w in ("window", "garden", "people")}
    first = min(gap, key=gap.get)
    for length in (3, 40):  # few and many words: one rule
        best, _, _ = coder.encode(" ".join([first] * length), 2)
        parts = [coder.look_up([first])[0][2]] * length
        assert best[1][1][len(best[1][1]) - sum(map(len, parts[1:])) :] == b"".join(parts[1:])


def test_units_cut_like_a_plain_scan():
    coder = pieces.Lattice(PATH)
    for w in words(11, 500):
        cut, plain = coder.units(w), [w[0]]
        for a, b in zip(w, w[1:]):
            if a + b in coder.spanned:
                plain[-1] += b
            else:
                plain.append(b)
        assert cut == plain and "".join(cut) == w
