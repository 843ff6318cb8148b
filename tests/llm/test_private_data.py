import hashlib
import random
import re

import numpy as np

from glossmill.llm.private_data import _NONE, KINDS, N_FEATURES, SkipChainField, base_spans, find_private_data, luhn, secret_spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".") if kind == "ip"),
                "card": 16 <= len(d) <= 19 and luhn(d),
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if fine:
                out.append((KINDS.index(kind), m.start(), m.end()))
    return out


def test_base_is_that_of_the_patterns():
    rng = random.Random(8)
    pieces = ["a@b.c", "x.y@z", "@", ".", "+1 (555) 123-4567", "4", "44", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", " ", "-", "4242 4242 4242 4242", "4111111111111111", "+", "é", "00255.0.0.001", "a-b.c-d", "\n", "(", "5500-0000-0000-0004"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert base_spans(text) == brute(text), text
    for long in ("1" * 200_000, "a" * 200_000 + "@", "256." * 100_000, "+1" + " " * 100_000, "a@" * 100_000):
        assert base_spans(long) == [] and secret_spans(long) == []


def text_of(i):
    phone = f"+1 ({200 + i}) 555-{1000 + i}"
    return f"call {phone} or mail user{i}@mail.example.com from 10.0.{i % 256}.7 id {i} token 0x{i}9f{i}"


def test_alike_mentions_get_one_label(make_docs):
    docs = [(i, text_of(i)) for i in range(300)]
    far = " word" * 200
    docs += [(1000, f"+1 (345) 555-6789{far} again 345-555-6789 end"), (1001, None), (1002, ""), (None, "é 10.1.1.1"), (1003, "nothing 12 at all"), (1000, "twice")]
    rows = find_private_data(make_docs(docs), redact=True).collect()
    assert len(rows) == len(docs)
    known = {d: t for d, t in docs if d != 1000}
    for r in rows:
        if r.doc_id in known:
            base = brute(known[r.doc_id] or "")
            joined = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base)
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
            assert set(joined.split(",")) <= set(r.spans.split(",")) | {""}
    again = next(r for r in rows if r.doc_id == 1000 and r.n_phone)
    start = docs[300][1].index("again") + 6
    assert again.spans == f"phone:0:17,phone:{start}:{start + 12}" and again.n_added == 1
    assert again.redacted.count("[PHONE]") == 2
    assert next(r for r in rows if r.doc_id == 1001).redacted is None
    assert sum(r.n_added for r in rows) == 1


def test_marginals_on_a_tree_are_exact():
    rng = np.random.default_rng(0)
    k = _NONE + 1
    field = SkipChainField(rng.normal(size=(N_FEATURES, k)), rng.normal(size=(k, k)), np.eye(k), rounds=40)
    x = rng.normal(size=(3, N_FEATURES))
    got = field.marginals(x, np.array([-1, -1, 2]), ["a", "b", "c"])
    u = x @ field.single
    u[2] = -40
    u[2, 2] = 0
    joint = np.exp(u[0][:, None, None] + u[1][None, :, None] + u[2][None, None, :] + field.chain[:, :, None] + field.chain[None, :, :])
    joint /= joint.sum()
    assert np.allclose(got, [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))], atol=1e-6)


def test_empty_table(make_docs):
    assert find_private_data(make_docs([])).count() == 0


def test_secrets_and_their_repeats(make_docs):
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    docs = [(i, f'token = "{i:02d}{value[2:]}" and text') for i in range(60)]
    docs += [(100, f'set api_key: {value} then later {value} once more'), (101, "internationalization_of_everything = none"), (102, f"a commit {value[:12]} only")]
    rows = {r.doc_id: r for r in find_private_data(make_docs(docs), redact=True).collect()}
    assert all(rows[i].n_secret == 1 and rows[i].n_private == 1 and rows[i].secrets == "9:49" for i in range(60))
    assert rows[100].n_secret == 2 and rows[100].redacted.count("[SECRET]") == 2 and rows[100].spans == ""
    assert rows[101].n_private == 0 and rows[102].n_private == 0
