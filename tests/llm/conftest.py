import random
import zlib

import pytest


def crc(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="session")
def hard_texts():
    """Texts with near copies, shared passages, ties, repeats, long and empty ones."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(40), text(60)
    out = ["", None, " \t\n", "one", "two words", "two words", "Two WORDS", text(4), passage, passage + " " + text(5), text(30) + "\n" + passage, base, base]
    for _ in range(25):  # near copies of one text, some of each other
        words = base.split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
    out += [text(rng.randint(1, 80)) for _ in range(20)]
    out += ["x y " * 40, "x y " * 41, "q " * 30, text(13), text(12), " ".join([passage] * 3), text(4000)]
    out += [rng.choice(out) for _ in range(10)]
    return out


@pytest.fixture(scope="session")
def documents(spark, hard_texts):
    rows = [(i if i != 3 else None, t, "en" if i % 3 else "fr", f"s{i % 4}", None, i * 2) for i, t in enumerate(hard_texts)]
    # columns that clash with names the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, batch long")


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
