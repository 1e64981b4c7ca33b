"""PII by aggregation of weak labelers.

Base kinds (email, ip, card, phone) are found by fixed rules and always stay. Beyond them, candidate spans
come from looser patterns (obfuscated addresses, written numbers without a plus, card-like and address-like
numbers, secrets in assignments, names after a title or cue). Labelers vote on a candidate, 1 for personal,
-1 against, 0 no opinion: regexes (shape), gazetteers (cues, domains, titles) and context (what stands
around it). Expectation-maximisation over the counts of vote patterns estimates the prior of each kind and
the accuracy of each labeler; those posteriors train a final logistic classifier on the candidates'
features, and a candidate that it accepts is added where it overlaps no base span.

Votes and features are a few bits, so a candidate is one of a bounded number of patterns: Spark counts the
patterns over the whole corpus, and estimation needs only these counts, however many candidates there are.

Defined results: null counts as empty text; without candidates nothing is added; repeated rows get the same
spans; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm import _text as T

BASE = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
# a match can only begin where its run of digits begins, so the look-behind changes no match but keeps long
# runs of digits linear
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of LOCAL, looking only around each @."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (text[start - 1].isalnum() and text[start - 1] < "\x80" or text[start - 1] in "._%+-"):
            start -= 1
        m = LOCAL.match(text, start) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = [x.lstrip("0") for x in m[0].split(".")]  # without zeros first: int() takes no endless digits
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in parts):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


KINDS = ("email", "ip", "card", "phone", "secret", "name")
CANDIDATES = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*(?:\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)[A-Za-z0-9-]+(?:(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)[A-Za-z0-9-]+)+"), ("at",)),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), (":",)),
    (2, re.compile(r"(?<![0-9])[0-9](?:[.\x20-]?[0-9]){12,18}(?![0-9])"), None),
    (3, re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-][0-9]{3,4}[\x20./-][0-9]{3,4}(?![0-9])"), None),
    (4, re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api_?key|access_?key)\s?[=:]\s?['\"]?([^\s'\"]{6,})"), ("=", ":")),
    (4, re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|sk-[0-9A-Za-z]{20,})\b"), None),
    (5, re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sr|Sra|Mme|M)\.\s([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)"), (".",)),
)
CUES = (
    re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reach)\W*\w*\W*\Z"),
    re.compile(r"(?i)\b(?:ip|host|server|address|addr|login from)\W*\w*\W*\Z"),
    re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|account|iban)\W*\w*\W*\Z"),
    re.compile(r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|móvil|teléfono|telefon|handy|tél)\W*\w*\W*\Z"),
    re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|key)\W*\Z"),
    re.compile(r"(?i)\b(?:name|named|sign(?:ed)?|dear|from|by)\W*\w*\W*\Z"),
)
AGAINST = re.compile(r"(?i)(?:\b(?:isbn|order|version|page|figure|table|section|chapter|no|id|ref|€|\$)\W*|[=#/])\Z")
DOMAINS = re.compile(r"(?i)(?:com|org|net|edu|gov|io|info|de|fr|es|it|uk|example)\Z")
LABELERS = 6  # shape, checksum, cue, gazetteer, against, neighbours
FEATURES = 8


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, vote pattern, features) of spans that overlap no base span."""
    out, taken = [], bytearray()
    for kind, pattern, must in CANDIDATES:
        if must is not None and not any(x in text for x in must):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex or 0)
            if not taken:
                taken = bytearray(len(text))
                for x, _, y in base:
                    taken[x:y] = b"\1" * (y - x)
            if a == b or taken.find(1, a, b) >= 0:
                continue
            taken[a:b] = b"\1" * (b - a)
            body, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 1]
            digits = DIGITS.sub("", body)
            mixed = any(c.isdigit() for c in body) and any(c.isalpha() for c in body)
            shape = (
                bool(re.search(r"[\[({]", body)),
                len(set(digits)) > 2,
                len(digits) in (15, 16),
                9 <= len(digits) <= 11 and len(set(digits)) > 2,
                mixed and len(body) >= 8,
                body.count(" ") >= 1,
            )[kind]
            check = (bool(DOMAINS.search(body)), True, luhn(digits), not body.startswith("0000"), len(set(body)) >= 6, body.istitle())[kind]
            cue = bool(CUES[kind].search(before[: -len(m[0]) + len(body)] if kind in (4, 5) and len(m[0]) > len(body) else before)) or kind == 4 and a != m.start()
            gazetteer = bool(DOMAINS.search(body)) if kind == 0 else a != m.start()
            against = bool(AGAINST.search(before)) and kind in (2, 3)
            alone = not (after.isalnum() or before[-1:].isalnum())
            votes = (1 if shape else -1, 1 if check else -1, 1 if cue else 0, 1 if gazetteer else 0, -1 if against else 0, 0 if alone else -1)
            pattern_id = 0
            for v in votes:
                pattern_id = pattern_id * 3 + v + 1
            bits = sum(1 << i for i, f in enumerate((shape, check, cue, gazetteer, against, alone, len(body) > 12, "\n" in body)) if f)
            out.append((a, kind, b, pattern_id, bits))
    return out


def _votes(pattern: np.ndarray) -> np.ndarray:
    return np.column_stack([pattern // 3 ** (LABELERS - 1 - i) % 3 - 1 for i in range(LABELERS)])


def aggregate(kind: np.ndarray, pattern: np.ndarray, count: np.ndarray, rounds: int = 50):
    """EM for the prior of each kind and, for each labeler, P(vote | personal or not); posteriors of the rows."""
    votes = _votes(pattern)
    q = 1 / (1 + np.exp(-votes.sum(axis=1)))  # begin with the majority
    priors = np.full(len(KINDS), 0.5)
    table = np.zeros((LABELERS, 2, 3))
    for _ in range(rounds):
        for k in range(len(KINDS)):
            own = kind == k
            priors[k] = (q[own] @ count[own] + 1) / (count[own].sum() + 2)
        for i in range(LABELERS):
            for side, weight in ((0, 1 - q), (1, q)):
                table[i, side] = np.bincount(votes[:, i] + 1, weight * count, 3) + np.array([1.0, 1.0, 1.0])
                table[i, side] /= table[i, side].sum()
        # a vote for must not count against, nor a vote against for: keeps the two classes from changing places
        ratio = np.log(table[:, 1] / table[:, 0])
        ratio[:, 2], ratio[:, 0], ratio[:, 1] = np.maximum(ratio[:, 2], 0), np.minimum(ratio[:, 0], 0), 0
        logit = np.log(priors / (1 - priors))[kind] + sum(ratio[i, votes[:, i] + 1] for i in range(LABELERS))
        new = 1 / (1 + np.exp(-logit))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return priors, ratio, q


def _design(kind: np.ndarray, bits: np.ndarray) -> np.ndarray:
    x = np.column_stack([bits >> i & 1 for i in range(FEATURES)]).astype(float)
    return np.hstack([x, np.eye(len(KINDS))[kind], np.ones((len(kind), 1))])


def train(kind: np.ndarray, bits: np.ndarray, weight: np.ndarray, target: np.ndarray, steps: int = 50) -> np.ndarray:
    """Logistic regression on soft targets, by Newton steps on weighted patterns."""
    x, w = _design(kind, bits), np.zeros(FEATURES + len(KINDS) + 1)
    if not len(kind):
        return w
    weight = weight / weight.sum() * min(weight.sum(), 1e6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame) -> dict:
    """The span classifier, from all candidates of the corpus; only counts of patterns reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    for _, kind, _, pattern, bits in candidates(text, base_spans(text)):
                        seen[kind, pattern, bits] = seen.get((kind, pattern, bits), 0) + 1
        rows = list(seen.items())
        cols = [pa.array([k[i] for k, _ in rows], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([n for _, n in rows], pa.int64())], names=["kind", "pattern", "bits", "held"])

    got = docs.select("text").mapInArrow(run, "kind int, pattern int, bits int, held long").groupBy("kind", "pattern", "bits").agg(F.sum("held").alias("held")).toArrow()
    kind, pattern, bits, held = (got.column(c).to_numpy() for c in ("kind", "pattern", "bits", "held"))
    if not len(kind):
        return {"weights": np.zeros(FEATURES + len(KINDS) + 1), "accept": np.zeros(0)}
    priors, ratio, q = aggregate(kind, pattern, held.astype(float))
    return {"weights": train(kind, bits, held.astype(float), q), "priors": priors, "reliability": ratio}


def all_spans(text: str, weights: np.ndarray) -> tuple[list, list]:
    base = base_spans(text)
    extra = candidates(text, base)
    if extra and weights.any():
        p = _design(np.array([c[1] for c in extra]), np.array([c[4] for c in extra])) @ weights
        return base, sorted(base + [c[:3] for c, s in zip(extra, p) if s > 0])
    return base, base


def find_pii(docs: DataFrame, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, all spans and their number n_spans; with_text also the text and the text with
    spans masked. carry: further columns of docs to hand through."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    weights = learn(docs)["weights"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long" + ", text string, masked string" * with_text
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in T.blocks(batches):
            counts, sums, spans, number, masked = [], [], [], [], []
            for text in block.column("text").to_pylist():
                base, every = all_spans(text or "", weights)
                counts.append([sum(k == i for _, k, _ in base) for i in range(4)])
                sums.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest())
                spans.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in every))
                number.append(len(every))
                if with_text:
                    masked.append(None if text is None else mask(text, every))
            cols = [block.column("doc_id"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(number, pa.int64())]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]
            if with_text:
                cols, names = [*cols, block.column("text"), pa.array(masked, pa.string())], [*names, "text", "masked"]
            yield pa.RecordBatch.from_arrays([*cols, *(block.column(c) for c in carry)], names=[*names, *carry])

    return docs.mapInArrow(run, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by <KIND>; of overlapping spans the first covers what it reaches."""
    out, at = [], 0
    for a, k, b in spans:
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{KINDS[k].upper()}>"] if a >= at else []
        at = b
    return "".join([*out, text[at:]])
