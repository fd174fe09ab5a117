"""Small awkward tables for the tests of the llm operators."""

import random

WORDS = ("the of and to in is that for with this was on by be it as alpha beta gamma delta river stone cloud "
         "mountain yellow winter garden bottle window silver paper little under over after before").split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


def edited(text: str, seed: int, edits: int) -> str:
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def awkward_texts() -> list:
    base = prose(1, 120)
    return [
        base, base, edited(base, 2, 1), edited(base, 3, 3), edited(base, 4, 12), base.upper(),
        None, "", " ", "\n\t\x0b\x0c\r ", "one", "One", "two words", "a b c d e", "A  b\tc\nd e", "a b c d e f",
        prose(5, 30) + "\n" + prose(6, 40), prose(7, 50) + "\n" + prose(6, 40), "&&& $$$ ### 123",
        "x" * 50_000, "word " * 9_000, prose(8, 9_000), "line one is here\n" * 200, "\u00a0\u2003caf\u00e9 \u6771\u4eac \U0001f600 na\u00efve\u0301",
        "<|endoftext|> it's THE end 2024 \u03a3\u0391\u03a3",
    ]


def awkward_rows() -> list:
    """(doc_id, text), ids in no order, with the last row repeated."""
    texts = awkward_texts()
    rows = [(1000 - 7 * i, t) for i, t in enumerate(texts)]
    return rows
