import random

import pytest

#: Extra columns whose names clash with what operators use inside.
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, words string, length long, row long, rank long, h1 long, key string, salt long, bucket int, shard int"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=True):
        """Documents of (doc_id, text) or (doc_id, text, lang)."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None if r[1] is None else len(r[1])) for r in rows]
        if not extra:
            return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        return spark.createDataFrame([(*r, "x", 1, None, 3, 4, "k", 5, 6, 7) for r in full], FIELDS).repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Small texts with copies, near copies, repeated lines, odd characters, nulls and a long one."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(120)]

    def sentence(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    shared = [sentence(30) for _ in range(4)]
    base = sentence(120)
    rows = []
    for i in range(140):
        kind = i % 7
        if kind == 0:
            w = base.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        elif kind == 1:
            text = "\n".join([sentence(8), rng.choice(shared), sentence(5).upper(), rng.choice(shared)])
        elif kind == 2:
            text = rng.choice([None, "", " \t\n", "a", "A b", base, "x\ty z w v", "one two three four"])
        elif kind == 3:
            text = " ".join([rng.choice(vocabulary)] * rng.randint(1, 60))
        elif kind == 4:
            text = "\n".join([rng.choice(shared)[:40]] * 2 + [sentence(3) for _ in range(4)] + ["L1", "L2", "L3", "L4"][: rng.randint(2, 4)])
        else:
            text = sentence(rng.randint(1, 90)) + rng.choice([".", "!", "", "\n", " 中文字 😀"])
        rows.append((i * 3 % 140 + (i > 70) * 1000, text))
    rows.append((5000, "\n".join(sentence(12) for _ in range(3000))))
    return rows
