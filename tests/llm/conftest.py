import random

import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, nulls, empties, a long text and columns that clash with inner names."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 80, 200]))) for _ in range(60)]
    for t in texts[:12]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(v) // 25))):
                v[rng.randrange(len(v))] = rng.choice(words)
            texts.append(" ".join(v))
    texts += [texts[0]] * 40 + [None, None, "", "  \n ", " ".join(rng.choice(words) for _ in range(30_000))]
    rows = [(i, t, "en", [None, "s1", "s2", "s3", "hot", "hot", "hot"][i % 7], None if t is None else len(t), "x") for i, t in enumerate(texts)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")
