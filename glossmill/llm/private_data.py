"""Personal data in documents: pattern matches, made consistent by a skip-chain random field.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers, and secrets: long
values of letters and digits that a name such as ``token`` or ``password`` is given. A document's
mentions (the matches, and other runs that look like an address, a number or such a value) then form a
conditional random field: each has a label or none; neighbours share a potential, and so do
distant mentions that are equal or alike (the same letters without case, the same last digits).
Each mention has an edge to the last one before it of the same key, so a key has as many edges
as mentions. Loopy sum-product passing, damped, gives the marginals. Matches of the patterns
keep their label; a mention that no pattern took is added where a label is more likely than none.

The weights are learned here from the patterns' own decisions on a sample of at most
``sample_mentions`` mentions: a softmax regression on surface features for the single
potentials, smoothed counts for those of neighbours, the rate of agreement for alike pairs.

The sample has distinct texts only, each once, with all of its mentions, those of least hash first.

Defined cases: a null text is empty and has no spans; repeated rows give a row each; spans
count code points, with the end exclusive. Secrets have columns of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
_NONE = SECRET + 1

# The patterns of the base kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NUMBER = re.compile(r"[+(]?[0-9][0-9\x20().-]{5,40}[0-9]")
_AT = re.compile(r"[^\s@]{1,64}@[^\s@]{1,255}")
_DIGIT = re.compile("[0-9]")
_VALUE = re.compile("[A-Za-z0-9+/_-]{20,}+")
_LETTER = re.compile("[A-Za-z]")
_NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s*[=:]\s*[\"']?$")
_LONGEST_NAME = 40


def luhn(digits: str) -> bool:
    """The check-digit rule of card numbers."""
    values = [int(d) for d in reversed(digits)]
    return sum(values[::2] + [2 * d - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all pattern matches, by kind, then start."""
    out = []
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            out.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((1, at, end))
            at = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def _mixed(value: str) -> bool:
    """Whether a value has both letters and digits."""
    return bool(_DIGIT.search(value) and _LETTER.search(value))


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of long values of letters and digits that follow a name for secrets."""
    return [(SECRET, m.start(), m.end()) for m in _VALUE.finditer(text) if _mixed(m.group()) and _NAMED.search(text, max(0, m.start() - _LONGEST_NAME), m.start())]


def _others(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs outside the spans taken that look like an address, a number or a secret value."""
    out, at = [], 0
    for start, end in [*sorted((s, e) for _, s, e in taken), (len(text), len(text))]:
        if start > at:
            for pattern in (_AT, _VALUE, _NUMBER):
                out += [(m.start(), m.end()) for m in pattern.finditer(text, at, start) if pattern is _AT or pattern is _VALUE and _mixed(m.group()) or pattern is _NUMBER and 7 <= len(_digits(m.group())) <= 19]
        at = max(at, end)
    out.sort()
    return [s for i, s in enumerate(out) if not i or s[0] >= out[i - 1][1]]


N_FEATURES = 34


def _features(text: str, start: int, end: int) -> np.ndarray:
    """Surface features of a mention and of the characters beside it."""
    s = text[start:end]
    d = _digits(s)
    x = np.zeros(N_FEATURES)
    x[min(len(d), 20)] = 1
    x[21:34] = (
        1, "@" in s, s.startswith("+"), "(" in s, s.count(".") == 3, "." in s, "-" in s, " " in s,
        any(c.isalpha() for c in s), 16 <= len(d) <= 19 and luhn(d), start > 0 and not text[start - 1].isspace() or end < len(text) and text[end].isalnum(),
        len(s) >= 20 and "@" not in s and any(c.isalpha() for c in s), text[max(0, start - 2) : start].strip("\"' ").endswith(("=", ":")),
    )
    return x


def _key(text: str, start: int, end: int) -> str:
    """Equal for mentions that are equal or alike."""
    s = text[start:end]
    if len(s) >= 20 and "@" not in s and any(c.isalpha() for c in s):
        return f"value {s}"
    if "@" in s:
        return s.lower().strip(".,;:!?()<>\"'")
    d = _digits(s)
    return f"dots {s}" if s.count(".") >= 3 else d[-9:] if len(d) < 16 else d


@dataclass
class SkipChainField:
    """Log potentials: labels by feature, neighbours, and alike pairs."""

    single: np.ndarray
    chain: np.ndarray
    alike: np.ndarray
    rounds: int = 12
    damping: float = 0.3

    def marginals(self, features: np.ndarray, fixed: np.ndarray, keys: list[str]) -> np.ndarray:
        """The label probabilities of a document's mentions; fixed: their label, or -1."""
        n, k = len(features), _NONE + 1
        unary = features @ self.single
        known = np.flatnonzero(fixed >= 0)
        unary[known] = -40.0
        unary[known, fixed[known]] = 0.0
        a, b, pair = list(range(n - 1)), list(range(1, n)), [self.chain] * (n - 1)
        last: dict[str, int] = {}
        for i, key in enumerate(keys):
            if key in last:
                a.append(last[key])
                b.append(i)
                pair.append(self.alike)
            last[key] = i
        if not a:
            return _softmax(unary)
        source, target = np.array(a + b), np.array(b + a)
        potential = np.array(pair + [p.T for p in pair])
        messages = np.zeros((len(source), k))
        m = len(a)
        back = np.r_[m : 2 * m, 0:m]
        for _ in range(self.rounds):
            belief = unary.copy()
            np.add.at(belief, target, messages)
            inner = (belief[source] - messages[back])[:, :, None] + potential
            top = inner.max(axis=1, keepdims=True)
            new = (top + np.log(np.exp(inner - top).sum(axis=1, keepdims=True)))[:, 0]
            new -= new.max(axis=1, keepdims=True)
            messages = self.damping * messages + (1 - self.damping) * new
        belief = unary.copy()
        np.add.at(belief, target, messages)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_field(documents: list[tuple[np.ndarray, np.ndarray, list[str]]], steps: int = 300, decay: float = 1e-3) -> SkipChainField:
    """Learn from (features, labels, keys) of documents."""
    k = _NONE + 1
    x = np.concatenate([f for f, _, _ in documents] or [np.zeros((0, N_FEATURES))])
    y = np.concatenate([l for _, l, _ in documents] or [np.zeros(0, np.int64)])
    w = np.zeros((N_FEATURES, k))
    w[21, _NONE] = 1.0
    if len(y):
        wanted = np.eye(k)[y]
        for _ in range(steps):
            w -= 1.0 * (x.T @ (_softmax(x @ w) - wanted) / len(y) + decay * w)
    pairs, agree, alike = np.ones((k, k)), 1.0, 1.0
    for _, labels, keys in documents:
        np.add.at(pairs, (labels[:-1], labels[1:]), 1)
        last: dict[str, int] = {}
        for key, label in zip(keys, labels, strict=True):
            if key in last:
                alike += 1
                agree += last[key] == label
            last[key] = label
    joint = pairs / pairs.sum()
    chain = np.clip(np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True)), -0.5, 0.5)
    rate = min(max(agree / (alike + 1), 0.9), 0.999)
    return SkipChainField(w, chain, np.eye(k) * np.log(rate * (k - 1) / (1 - rate)))


def _mentions(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans; and all mentions as (start, end, label), in order, those of the patterns and others
    outside them."""
    base = base_spans(text)
    if not base and "@" not in text and not _DIGIT.search(text):
        return base, []
    taken = base + secret_spans(text)
    found = [(s, e, kind) for kind, s, e in taken] + [(s, e, _NONE) for s, e in _others(text, taken)]
    return base, sorted(found)


def _sample(texts: DataFrame, limit: int) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Mentions of a deterministic sample of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for i, (s, e, label) in enumerate(_mentions(text)[1]):
                    for x, v in zip(out, (h, i, label, _key(text, s, e), _features(text, s, e)), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.float64()))], ["h", "i", "label", "key", "features"])

    every = max(1, texts.count() * 2 // limit)
    rows = texts.filter("text is not null").withColumn("h", F.xxhash64("text")).filter(F.pmod("h", F.lit(every)) == 0)
    rows = rows.groupBy("h").agg(F.first("text").alias("text")).mapInArrow(run, "h long, i long, label long, key string, features array<double>")
    by: dict[int, list] = {}
    for r in rows.orderBy("h", "i").limit(limit).collect():
        by.setdefault(r.h, []).append(r)
    return [(np.array([r.features for r in d]), np.array([r.label for r in d]), [r.key for r in d]) for d in by.values()]


def _spans(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(found))


def find_private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, sample_mentions: int = 20_000) -> DataFrame:
    """Per row: doc_id; n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans;
    spans, those of the field included; n_added; secrets (start:end, comma-joined), n_secret; n_private, the
    number of all spans and secrets; and, if asked, the text with [KIND] in place of all of them."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    field = texts.sparkSession.sparkContext.broadcast(fit_field(_sample(texts, sample_mentions)))

    def spans_of(text: str) -> tuple[list, list, list]:
        base, mentions = _mentions(text)
        secrets = [(SECRET, s, e) for s, e, label in mentions if label == SECRET]
        if not any(label == _NONE for _, _, label in mentions):
            return base, [], secrets
        fixed = np.array([-1 if label == _NONE else label for _, _, label in mentions])
        features = np.array([_features(text, s, e) for s, e, _ in mentions])
        best = field.value.marginals(features, fixed, [_key(text, s, e) for s, e, _ in mentions]).argmax(axis=1)
        added = [(int(k), s, e) for k, (s, e, label) in zip(best, mentions, strict=True) if label == _NONE and k != _NONE]
        return base, [x for x in added if x[0] != SECRET], secrets + [x for x in added if x[0] == SECRET]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, len(KINDS) + 3), np.int64)
            digests, spans, values, masked = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                base, added, secrets = spans_of(text or "")
                for kind, _, _ in base:
                    counts[i, kind] += 1
                counts[i, -3:] = len(added), len(secrets), len(base) + len(added) + len(secrets)
                values.append(",".join(f"{s}:{e}" for _, s, e in sorted(secrets)))
                digests.append(hashlib.sha256(_spans(base).encode()).hexdigest())
                spans.append(_spans(base + added))
                masked.append(_redacted(text, base + added + secrets) if redact else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[:, -3]), pa.array(values, pa.string()), pa.array(counts[:, -2]), pa.array(counts[:, -1]), pa.array(masked, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "secrets", "n_secret", "n_private", "redacted"],
            )

    id_type = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"doc_id {id_type}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long, secrets string, n_secret long, n_private long, redacted string")
    return found if redact else found.drop("redacted")


def _redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if end > at:
            out += [text[at:start], f"[{(*KINDS, 'secret')[kind].upper()}]"] if start >= at else []
            at = end
    return "".join([*out, text[at:]])
