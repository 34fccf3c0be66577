import random

import pytest

@pytest.fixture(scope="session")
def mixed(spark):
    """Documents of all awkward kinds: families of near copies, a shared passage, repeats, nulls, empties, one very long text, clashing columns."""
    r = random.Random(4)
    some = lambda n: [f"w{r.randint(0, 20000)}" for _ in range(n)]
    texts = []
    for _ in range(2):
        base = some(120)
        for _ in range(40):
            x = base[:]
            for _ in range(r.randint(0, 5)):
                x[r.randrange(len(x))] = f"z{r.randint(0, 9999)}"
            texts.append(" ".join(x + (some(r.randint(1, 40)) if r.random() < 0.1 else [])))
    passage = some(60)
    texts += [" ".join(some(r.randint(0, 30)) + passage + some(r.randint(0, 30))) for _ in range(60)]
    texts += [" ".join(["a"] * r.randint(1, 12)) for _ in range(30)]
    texts += ["", None, " \n", "Hello world", "hello  WORLD", "x" * 3000, " ".join(some(9000)), "é ü 中文。字 — “q”", "tab\tand\x0bmore\x1c."]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = [(i, t, r.choice(["s1", "s2", "s3", None]), "row", 1, 2.0) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[3], rows[3], (None, "no id here", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row string, size int, score double").repartition(3)
