"""Small document tables with every odd case: nulls, empties, long texts, ties, repeats, clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, n_words long, h long, len int, recipe string, `__x` string"
WORDS = "an er th in ou re on at es ed nd to st en or ti hi as te et ng of al de".split()


def rows(texts):
    return [(k, t, "en" if k % 3 else None, f"src{k % 4}" if k % 5 else None, 0, None, 0.5, 7, 1, 2, "x", "y") for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make(spark):
    def docs(texts):
        return spark.createDataFrame(rows(texts), SCHEMA)

    return docs


@pytest.fixture(scope="session")
def texts():
    r = random.Random(5)
    line = lambda n: " ".join("".join(r.choices(WORDS, k=r.randint(1, 4))) for _ in range(n))
    base = ["\n".join(line(r.randint(1, 30)) for _ in range(r.randint(1, 6))) for _ in range(40)]
    out = [None, "", " ", "\n", "a", "one two three four", "one  TWO three four ", *base]
    shared = line(60)
    common = "A Common line of text that repeats"
    for k in range(30):
        out.append(f"{line(10)} {shared} {line(5)}\n  {common.upper() if k % 2 else common}\t\n{line(3)}")
    for k in range(25):
        words = base[0].split(" ")
        words[r.randrange(len(words))] = f"edit{k}"
        out.append(" ".join(words))
    out += [base[1], base[1] + " ", base[1].replace(" ", "  "), base[2], base[2], "same same " * 400, line(9000), "Été été x\x1cy", "x" * 5000]
    return out
