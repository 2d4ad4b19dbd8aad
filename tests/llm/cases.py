"""Small documents that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, k long, size long, part int, ids string, score string"


def documents():
    rng = random.Random(4)
    words = ["the", "and", "thing", "ion", "schung", "für", "él", "ñandú", "œuvre", "ΑΣ", "don't", "x=1", "١٢", "日本語", "🙂"]
    long = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(20_000))
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w7 ", "changed ", 1)
    texts = [
        None, "", " ", "\n\t ", "a", "Ab aB", "one two three", "one two three four", "ONE two three four", base, base, near, base + " tail", long, long[:-9],
        "<s>hi</s> <|endoftext|> <|startoftext|> <unk>", "tabs\tand\x0bfeeds\x0c\r\n", "▁▁ under ▁score", "\x1c\x1fodd", "12 34", "é Å ﬁ", "the same", "the same",
    ]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "b", "b"][i % 5], None, "clash", -1, 7, 3, "x", "y") for i, t in enumerate(texts)]
    rows.append((None, "null id text", None, None, None, None, None, None, None, None, None))
    rows.append((3, "\n\t ", "en", "b", None, "again", 1, 1, 1, "z", "z"))  # a repeated id and text
    rows.append((9, base, "en", None, None, "again", 1, 1, 1, "z", "z"))
    return rows
