import zlib
from collections import defaultdict

import numpy as np
import pytest

from glossmill.llm.packing import length_patterns, nonnegative_fit, pack_documents, packing_plan
from glossmill.llm.queries import word_tokenizer


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


def test_pieces_and_places(make_docs, corpus, tokenizer):
    docs = [*corpus, (9001, "It's 1/2 'tis ''s don't <|endoftext|> ×÷ ABC ÀÉ ß ﬁ é \x1c x\u0085y"), (9002, "İ ΑΣ"), (9003, "a" * 30000), corpus[1], corpus[1]]
    rows = pack_documents(make_docs(docs), word_tokenizer(), capacity=512, keep_ids=True).collect()
    expected = []
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            expected.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted(tuple(r[:5]) for r in rows) == sorted(expected)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    least = -(-sum(r.length for r in rows) // 512)
    assert len(sequences) <= least * 1.03 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_tight_and_small(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1.2, 200_000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    plan = packing_plan(counts, 4096)
    used = defaultdict(int)
    for pattern, n in plan:
        assert sum(a * b for a, b in pattern) <= 4096
        for a, b in pattern:
            used[a] += n * b
    assert used == counts
    assert sum(n for _, n in plan) <= 1.01 * lengths.sum() / 4096 + 1
    assert len(plan) < 40_000


def test_many_of_one_length_and_none(make_docs):
    assert pack_documents(make_docs([]), word_tokenizer()).count() == 0
    plan = packing_plan({1: 10_000_000}, 4096)
    assert sum(n for _, n in plan) == -(-10_000_000 // 4096)
    rows = pack_documents(make_docs([(i, None) for i in range(50)]), word_tokenizer(), capacity=8, group_rows=5).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 50 and len({r.sequence_id for r in rows}) == 7


def test_fit_and_patterns():
    assert len(length_patterns(6)) == 7
    a = np.array([[1.0, 0], [1, 1], [0, 2]])
    assert np.allclose(nonnegative_fit(a, a @ [3.0, 2.0], 5000), [3, 2], atol=0.5)
    assert nonnegative_fit(a, np.array([5.0, 0, -9]))[1] == 0
