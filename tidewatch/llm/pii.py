"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import trimmed

KINDS = ("email", "ip", "card", "phone")
ABSTAIN, YES, NO = 0, 1, 2
LABELERS = ("regex", "gazetteer", "context", "border")

_DIGIT = re.compile(r"[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Looser shapes that the labelers judge; every repetition is bounded.
_LOOSE = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[](?:dot|DOT)[)\]]|\.) ?[A-Za-z0-9-]{1,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9.])[0-9]{3,6}(?:[ .-]?[0-9]{4,6}){2,3}(?:[ .-]?[0-9]{1,4})?(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ .-]|[2-9][0-9]{2}[.-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")),
)
#: Gazetteers and context words.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io dev app ai co uk de fr es it nl be at ch eu us ca au jp cn in br mx ru pl se no fi dk pt ie".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "30", "36", "38", "35", "60", "62", "65")
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
CONTEXT = {
    "email": (("email", "e-mail", "mail", "contact", "write", "correo", "courriel"), ("token", "git", "commit")),
    "ip": (("ip", "host", "server", "address", "client", "login"), ("version", "release", "section", "v.")),
    "card": (("card", "visa", "mastercard", "amex", "credit", "payment", "carte", "karte", "tarjeta"), ("isbn", "order", "sku", "serial", "tracking", "token")),
    "phone": (("phone", "tel", "call", "mobile", "fax", "whatsapp", "telefon"), ("isbn", "order", "sku", "version", "serial")),
}
CONTEXT_CHARS = 32


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Each `@` with its whole local part and a domain with a dot: linear, as no part of a match can hold another `@`."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            out.append((start, end))
        elif start == at or match is None:
            end = max(end, at + 1)
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) in code points of each kind: leftmost, not overlapping, failing matches dropped without retry."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


def _gazetteer(kind: str, piece: str, digits: str) -> int:
    if kind == "email":
        last = re.split(r"[.\s)\]]+", piece.lower())[-1]
        return YES if last in TOP_DOMAINS else NO
    if kind == "card":
        return YES if digits.startswith(CARD_STARTS) else NO
    if kind == "phone":
        if piece.startswith("+"):
            return YES if any(digits[:n] in COUNTRY_CODES for n in (1, 2)) else ABSTAIN
        return YES if piece[0] in "(0" else ABSTAIN
    octets = piece.split(".")
    return NO if len(octets) == 4 and all(len(o) == 1 for o in octets) else YES


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, int, int, bool, tuple[int, ...]]]:
    """(kind, start, end, is base, feature) of base spans and of loose ones that touch no base span of any kind.

    feature: the four votes, the number of digits in five steps, the number of separators in three.
    """
    spans = [(k, s, e, True) for k in KINDS for s, e in base[k]]
    # base spans merged into disjoint ones, so that the loose spans of a kind, which rise too, pass them in one go
    taken: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e, _ in spans):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    digits = _DIGIT.search(text) is not None
    for kind, shape in _LOOSE:
        if ("(" in text or "[" in text) if kind == "email" else digits and (kind != "ip" or ":" in text):
            end, at = -1, 0
            for m in shape.finditer(text):
                s, e = m.span()
                while at < len(taken) and taken[at][1] <= s:
                    at += 1
                if s >= end and not (at < len(taken) and taken[at][0] < e):
                    spans.append((kind, s, e, False))
                    end = e
    for kind, s, e, is_base in spans:
        piece = text[s:e]
        number = _digits(piece)
        near = text[max(0, s - CONTEXT_CHARS) : s].lower()
        good, bad = CONTEXT[kind]
        strict = YES if is_base else NO
        if kind == "card" and not is_base:
            strict = YES if 13 <= len(number) <= 15 and luhn(number) else NO
        context = YES if any(w in near for w in good) else NO if any(w in near for w in bad) else ABSTAIN
        border = NO if (s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum()) else YES
        votes = (strict, _gazetteer(kind, piece, number), context, border)
        steps = min(4, len(number) // 4), min(2, sum(c in " .-()" for c in piece) // 2)
        yield kind, s, e, is_base, (*votes, *steps)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of truth for each row of votes (rows, labelers) by Dawid-Skene expectation-maximisation.

    It starts from the majority of the votes; each labeler's rates of yes, no and abstaining are estimated for true and
    false candidates with one pseudo-count, and posteriors follow by Bayes' rule.
    """
    start = (votes == YES).sum(1) - (votes == NO).sum(1)
    posterior = 1 / (1 + np.exp(-start.astype(float)))
    for _ in range(rounds):
        logit = np.full(len(votes), 0.0)
        prior = (counts @ posterior + 1) / (counts.sum() + 2)
        logit += np.log(prior) - np.log1p(-prior)
        for j in range(votes.shape[1]):
            for v in (ABSTAIN, YES, NO):
                hit = votes[:, j] == v
                yes = (counts[hit] @ posterior[hit] + 1) / (counts @ posterior + 3)
                no = (counts[hit] @ (1 - posterior[hit]) + 1) / (counts @ (1 - posterior) + 3)
                logit[hit] += np.log(yes) - np.log(no)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior


def _vector(kind: str, feature: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(KINDS) + 3 * len(LABELERS) + 5 + 3)
    out[KINDS.index(kind)] = 1
    for j, v in enumerate(feature[:4]):
        out[len(KINDS) + 3 * j + v] = 1
    out[len(KINDS) + 12 + feature[4]] = 1
    out[len(KINDS) + 17 + feature[5]] = 1
    return out


def fit(table: list[tuple[str, tuple[int, ...], int]], rounds: int = 400) -> Model | None:
    """The span classifier: a logistic model of posteriors over (kind, feature, count) rows; None without rows."""
    if not table:
        return None
    table = sorted(table)
    counts = np.array([n for _, _, n in table], float)
    truth = np.zeros(len(table))
    for kind in KINDS:
        own = np.array([k == kind for k, _, _ in table])
        if own.any():
            truth[own] = estimate(np.array([f[:4] for k, f, _ in table if k == kind]), counts[own])
    x = np.stack([_vector(k, f) for k, f, _ in table])
    weights, bias, share = np.zeros(x.shape[1]), 0.0, counts / counts.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ weights + bias)))
        gap = share * (p - truth)
        weights -= 2.0 * (x.T @ gap + 1e-4 * weights)
        bias -= 2.0 * gap.sum()
    return Model(weights, float(bias))


@trimmed
def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if text:
                seen.update((kind, feature) for kind, _, _, _, feature in candidates(text, base_spans(text)))
        rows = sorted(seen.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for (k, _), _ in rows], pa.string()), pa.array(["".join(map(str, f)) for (_, f), _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
            names=["kind", "feature", "n"],
        )


@trimmed
def _span_batches(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        hashes, spans = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            for k in KINDS:
                counts[k].append(len(base[k]))
            plain = ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in base[k])
            hashes.append(hashlib.sha256(plain.encode()).hexdigest())
            added = []
            if model is not None:
                for kind, s, e, is_base, feature in candidates(text, base):
                    if not is_base and _vector(kind, feature) @ model.weights + model.bias >= 0:
                        added.append((KINDS.index(kind), s, e))
            if added:
                rows = sorted([(KINDS.index(k), s, e) for k in KINDS for s, e in base[k]] + added)
                plain = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in rows)
            spans.append(plain)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
        )


def _valid() -> Column:
    return F.make_valid_utf8(F.col("text").cast("string")).alias("text")


def train(docs: DataFrame) -> Model | None:
    """The classifier of all candidates of all texts; what reaches the driver is a table of at most 4,860 vote patterns."""
    patterns = (
        docs.select(_valid())
        .mapInArrow(_vote_batches, "kind string, feature string, n long")
        .groupBy("kind", "feature")
        .agg(F.sum("n").alias("n"))
    )
    return fit([(r[0], tuple(map(int, r[1])), r[2]) for r in patterns.collect()])


def find_spans(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs (doc_id, text).

    Counts and base_sha256 are those of the base spans; spans holds `kind:start:end` of all spans, base ones and those
    the classifier accepts, by kind as in KINDS, then start, in code points. Null texts are empty. Bytes that are no valid
    UTF-8 count as U+FFFD. Repeated rows stay; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _valid()).mapInArrow(
        partial(_span_batches, model=model),
        f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string",
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """find_spans with the classifier trained on docs: two scans of the texts, no shuffle of them."""
    return find_spans(docs, train(docs))


def mask_text(text: str | None, model: Model | None) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the longest span, then the first, is named."""
    if not text:
        return text
    base = base_spans(text)
    spans = [(s, e, k) for k in KINDS for s, e in base[k]]
    if model is not None:
        spans += [(s, e, k) for k, s, e, b, f in candidates(text, base) if not b and _vector(k, f) @ model.weights + model.bias >= 0]
    if not spans:
        return text
    groups: list[list[tuple[int, int, str]]] = []
    for span in sorted(spans):
        if groups and span[0] < max(e for _, e, _ in groups[-1]):
            groups[-1].append(span)
        else:
            groups.append([span])
    out, at = [], 0
    for group in groups:
        name = max(group, key=lambda g: (g[1] - g[0], -g[0]))[2]
        out.append(text[at : group[0][0]] + f"[{name}]")
        at = max(e for _, e, _ in group)
    return "".join(out) + text[at:]


@trimmed
def _mask_batches(batches: Iterator[pa.RecordBatch], model: Model | None, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masked = pa.array([mask_text(t, model) for t in batch.column(at).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([masked if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows, with the personal data in `text` masked; null and empty texts stay as they are.

    Bytes of a text that are no valid UTF-8 become U+FFFD. Other string columns must be valid.
    """
    model = train(docs)
    docs = docs.withColumn("text", _valid())
    return docs.mapInArrow(partial(_mask_batches, model=model, at=docs.columns.index("text")), docs.schema)
