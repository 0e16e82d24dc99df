"""Small documents with what the operators must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, slot string, fp string, row string"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, n: int) -> str:
    ws = words(rng, n)
    return "".join(w + rng.choice([" ", " ", " ", " ", ". ", ",\n", "\t"]) for w in ws).strip()


def corpus(seed: int = 5) -> list[tuple]:
    """(doc_id, text, ...) rows, in no order."""
    rng = random.Random(seed)
    texts: list[tuple[int | None, str | None]] = []
    base = [prose(rng, rng.randint(60, 160)) for _ in range(30)]
    shared = prose(rng, 70)
    for i, t in enumerate(base):
        texts.append((i, t))
    for i in range(30, 40):  # exact copies, near copies and a passage that many share
        texts.append((i, base[i % 4]))
    for i in range(40, 50):
        ws = base[5].split(" ")
        ws[rng.randrange(len(ws))] = "changed"
        texts.append((i, " ".join(ws)))
    for i in range(50, 60):
        texts.append((i, prose(rng, 30) + "\n" + shared + "\n" + prose(rng, 30)))
    texts += [(60, None), (61, ""), (62, " \n\t "), (63, "one two three"), (64, "One TWO three"), (None, base[6]), (None, prose(rng, 80)), (65, "a" * 3000), (66, "x y " * 400), (67, "é ü 日本 😀 " * 120)]
    texts += [(68, base[7]), (68, base[7]), (69, base[8]), (69, base[9])]  # a repeated row; one id with two texts
    texts.append((70, " ".join(words(rng, 6000))))
    texts.append((71, "café İstanbul \x0b line\x0csep\r\nend " * 10))
    rng.shuffle(texts)
    langs = ["en", None, "fr"]
    return [(i, t, langs[k % 3], f"src{k % 4}" if k % 7 else None, None if t is None else len(t), 7, "s", "f", "r") for k, (i, t) in enumerate(texts)]
