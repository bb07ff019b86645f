import random

import pytest

ODD = [" ", "  ", "\n", "\t", "\xa0", "a", "B", "é", "ab", "<|endoftext|>", "</s>", "1", "23", "'s", "!", "日", "́", "🙂", "\x00", "▁", "Σ", "ﬁ", "the", " the", "　"]


@pytest.fixture(scope="session")
def odd_texts():
    """Short texts of awkward pieces, with nulls, repeats and one very long text."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    return [*texts, None, "", " ", texts[0], texts[0], " ".join(f"word{k % 977}" for k in range(30000))]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The texts as documents in three partitions, with a null id, a repeated id and columns of clashing names."""
    rows = [(None if k == 7 else 5 if k == 8 else k * 3, text, k, "x") for k, text in enumerate(odd_texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, part int, score string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
