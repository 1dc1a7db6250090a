import random

import pytest

#: Columns whose names operators use themselves.
CLASHES = ("id", "key", "block", "bucket", "digest", "row", "fp", "node", "carry_lang", "n_words", "ids", "score", "shard", "slot", "stay_id", "w0", "d", "t", "s", "x", "v")


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def tricky_texts():
    """Texts of every awkward kind: null, empty, blank, very long, repeated, near copies, shared passages."""
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000))
    passage = words(rng, 70)
    base = words(rng, 120)
    near = [*base[:60], "changed", *base[61:]]
    return [
        None, "", "   \n\t ", "one", "one", "two words", " ".join(base), " ".join(base), " ".join(near),
        " ".join([*words(rng, 30), *passage, *words(rng, 40)]), "\n".join([*words(rng, 10), *passage]),
        " ".join([*words(rng, 20), *passage[:49], "end"]), long, "Ünï 日本語 ▁ text here\x0bnow", "x" * 40_000, "same " * 300, "<|endoftext|> it's",
    ]


@pytest.fixture(scope="session")
def docs(spark):
    """The tricky texts with ids, a null id, a repeated row, and columns with clashing names."""
    rows = [(k, t) for k, t in enumerate(tricky_texts())] + [(None, "null id"), (3, "one")]
    more = tuple(range(len(CLASHES)))
    kinds = ", ".join(f"{c} int" for c in CLASHES)
    return spark.createDataFrame([(*r, "en", "src", 0, *more) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {kinds}").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]
