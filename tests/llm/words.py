"""Made texts for the tests, the same at every run."""

import random

A_TO_Z = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def invented(seed, count, vocabulary=400):
    draw = random.Random(seed)
    letters = "aeiou", "bcdfglmnprst"
    lexicon = ["".join(draw.choice(letters[k % 2]) for k in range(draw.randint(2, 8))) for _ in range(vocabulary)]
    return [draw.choice(lexicon) for _ in range(count)]


def lower(text):
    return (text or "").encode().translate(A_TO_Z).split()
