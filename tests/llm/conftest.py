import random

import pytest

WORDS = "the of and to a in is it you that he was for on are with as his they be at one have this from".split()


@pytest.fixture(scope="session")
def prose():
    """Texts of a seeded generator: n words, lines of a dozen."""

    def make(seed, n):
        rng = random.Random(seed)
        words = [rng.choice(WORDS) + rng.choice(["", "ly", "er", "ing", "tion"]) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(n)]
        return "\n".join(" ".join(words[k : k + 12]) for k in range(0, n, 12))

    return make


@pytest.fixture
def odd_docs(spark, prose):
    """NULLs in every column, empty and blank texts, a long one, repeated rows, clashing names."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 60), "en", "a", 1), (1, prose(2, 60), "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0),
        (4, " \n\t ", "en", None, 3), (None, prose(3, 50), "de", "b", 5), (None, None, None, "b", None), (5, long, "fr", "b", len(long)),
        (6, "one", "xx", "a", 3), (7, "ünï çödé ünï", "fr", "a", 12),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = spark.createDataFrame(rows, schema)
    extra = ["score", "label", "overlap", "toxicity", "fingerprint", "host", "path", "rate", "copies", "domain", "n_words", "n_lines", "mark", "_row"]
    return base.selectExpr("*", *[f"'own' as {c}" for c in extra])
