"""Texts that several tests share."""

from __future__ import annotations

import random


def made_texts(seed: int = 3) -> list[str | None]:
    """Prose with copies, near copies, passages shared at odd places, short, long, empty and null texts."""
    rnd = random.Random(seed)
    words = [("".join(rnd.choices("abcdeéßñ", k=rnd.randint(1, 7)))) for _ in range(400)] + ["The", "AND", "x's", "12", "né", "日本", "a,b"]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    passage = prose(70)
    base = prose(160)
    near = base.split(" ")
    texts: list[str | None] = [None, "", "   \n\t ", "one", "One two three four", "one two three four", base, base, base.upper(), passage]
    for k in range(6):
        edited = list(near)
        edited[20 * k + 3] = f"edit{k}"
        texts.append(" ".join(edited))
    for k in range(8):
        texts.append(prose(rnd.randint(3, 60)) + "\n" * (k % 3) + passage + " " * (k % 2 + 1) + prose(rnd.randint(0, 50)))
    texts += [prose(9000), "lo lo " * 300, "a <|endoftext|>  b <|endoftext|>", "tab\tand\x0bvertical  two   spaces  nbsp\x1cfs "]
    texts += [prose(rnd.randint(1, 90)) for _ in range(25)]
    return texts
