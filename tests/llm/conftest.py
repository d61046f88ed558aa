"""Small tables with every awkward row."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, fp string, bucket string, h string, __x int"


def awkward_rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Prose in two made-up languages with null, empty, blank, tiny, long and repeated texts, and null ids and sources."""
    rng = random.Random(seed)
    vocab = {"aa": ["the", "thing", "that", "other", "with", "when", "this", "both"], "bb": ["le", "eau", "quelle", "oui", "dans", "leur", "beau", "étage"]}
    texts = []
    for i in range(n):
        lang = "aa" if i % 2 else "bb"
        texts.append((" ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(4, 90))), lang))
    texts += [(None, "aa"), ("", "bb"), (" \t\n ", None), ("the", "aa"), ("x" * 150_000, None), (" ".join(["thing that"] * 9000), "aa"), ("...!! 12", "bb")]
    texts += [texts[3], texts[3], texts[4], (texts[5][0] + " other", "aa")]
    rows = [(i, t, lang, f"s{i % 4}" if i % 4 else ("s0" if i % 8 else None), len(t or ""), "clash", "clash", "clash", "clash", 1) for i, (t, lang) in enumerate(texts)]
    return [*rows, rows[7], rows[7]]


@pytest.fixture
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
