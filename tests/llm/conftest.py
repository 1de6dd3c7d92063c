import random

import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """Texts with copies, near copies, blanks, nulls and a repeated id, beside columns of clashing names."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, text(rnd.randint(1, 120))) for i in range(60)]
    base = rows[3][1] + " " + text(80)
    for i in range(60, 90):
        w = base.split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = "x" + str(rnd.randrange(999))
        rows.append((i, " ".join(w)))
    rows += [(90, base), (91, base.upper()), (92, None), (93, ""), (94, " \n\t"), (95, "one two"), (96, "ONE  two"), (97, "é ß 漢字 \U0001f600"), (98, text(6000)), (99, "one two"), (99, "one two"), (None, "one two"), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rep long, score double, value string"
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), 5, 0.5, "v") for i, t in rows], schema)


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.where("false")
