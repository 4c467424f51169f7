import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, Score string, n_lines string"
#: A document of each awkward kind: null, empty, blank, short, very long, repeated, with special strings and characters.
ODD = [None, "", " \n\t ", "one", "a b c d", "<|endoftext|>x<|endoftext|>", "é ü ñ 漢字 😀 \x1c\x85\xa0", "word " * 5000, "x" * 5000, "Line A\nLine B\nLine C\nLine D", "\n\n\n\n"]


def prose(seed: int, n: int, width: int = 400) -> str:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("bcdfghklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(width)]
    out = [rnd.choice(words) for _ in range(n)]
    return "".join(w + (".\n" if i % 12 == 11 else " ") for i, w in enumerate(out))


@pytest.fixture(scope="session")
def texts():
    """Odd documents, prose, exact and near copies, shared passages and lines."""
    base = [prose(i, 60 + 17 * i) for i in range(20)]
    near = [b.replace(b.split(" ")[5], "changed", 1) for b in base[:6]]
    far = [" ".join(w if i % 9 else "other" for i, w in enumerate(b.split(" "))) for b in base[:4]]
    passage = prose(99, 70)
    shared = [prose(200 + i, 40) + passage + prose(300 + i, 30) for i in range(5)]
    return [*ODD, *base, *base[:5], *near, *far, *shared, prose(7, 30) + prose(7, 30)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "src0" if i % 3 else f"src{i}", len(t or ""), "e", "s", "n") for i, t in enumerate(texts)]
    rows.append((None, "no id here at all", "en", "src0", 1, None, None, None))
    rows.append(rows[-3])  # a repeated row
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tokenizer():
    from engram.llm.queries import tokenizer_path

    return tokenizer_path()
