import random

import pytest

SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]


def invented(seed=3):
    """Documents with nulls, blanks, copies, near copies, shared passages, repeats inside a text, odd characters and a long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß中") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(90)
    base = [text(120) for _ in range(4)]
    out = [None, "", " \t\n", "one", "one two", "  one\ttwo ", "ONE two", "a b c d", "A B C D", "\x1c\x85  ", "x" * 700, "xy" * 400]
    for b in base:
        out += [b, b, b.replace(" ", "\n"), b + " tail", b.upper()]
        for k in (1, 2, 6, 20):
            w = b.split(" ")
            for _ in range(k):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    for _ in range(6):
        out.append(text(30) + " " + passage + " " + text(30))
    out += [passage + "\n" + passage, text(5000), "🙂" * 300, "😀é" * 120 + text(3)]
    out += [f"line {i}\nline {i}\nsame\nsame\n" + text(30) for i in range(3)]
    out += ["dup " * 60, "## $$ ** " * 20, "<p>&|%" * 30]
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def invented_docs():
    return invented()


@pytest.fixture(scope="session")
def docs(spark, invented_docs):
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 3}", 0, "x", "y", 5, "z") for i, t in invented_docs]
    # Extra columns with names that the operators use inside.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bf_word string, ranges string, keep_id long, score string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("doc_id < 0")


@pytest.fixture(scope="session")
def paths():
    from quillspark.llm.queries import tokenizer_paths

    return tokenizer_paths()
