import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("0159@.ab-+() \né%", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_on_dense_random_text():
    rng = random.Random(2)
    for alphabet in ("0123456789 -", "1234. ", "+12()- .", "ab@.1"):
        for _ in range(300):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80)))
            assert pii.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 100_000):
        pii.base_spans(text)


def test_expectation_maximisation_finds_the_reliable_labelers():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.85, 0.7, 0.55])
    votes = np.stack([np.where((rng.random(4000) < r) == truth, pii.YES, pii.NO) for r in right], axis=1)
    found = pii.estimate(votes, np.ones(4000)) > 0.5
    majority = (votes == pii.YES).sum(1) * 2 > 4
    assert (found == truth).mean() > max((majority == truth).mean(), 0.93)


def test_rows_and_edges(spark):
    good = "mail joe@mail.example.com or call +1 (415) 555-7713, ip 10.1.2.3, visa card 4845168114407329. "
    loose = "phone: (415) 555-7713 and email joe (at) example (dot) com"
    rows = [(1, good), (2, None), (3, ""), (None, good), (1, good), (4, good * 3000), (5, loose)] + [(k, good + loose) for k in range(10, 60)]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, spans string")
    out = pii.find_personal_data(docs).collect()
    assert len(out) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, t or "")
    for r in out:
        base = plain(texts[r.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for k in pii.KINDS for s, e in base[k])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(filter(None, r.spans.split(",")))
    masked = {r.doc_id: r for r in pii.mask_documents(docs).collect()}
    assert masked[1].text == "mail [email] or call [phone], ip [ip], visa card [card]. " and masked[2].text is None
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_malformed_text_and_other_columns(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'6A6F65406D61696C2E636F6DFF2020' AS STRING) AS text, 5 AS n_email UNION ALL SELECT 2L, 'joe@mail.com', 6")
    out = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert out[1].n_email == out[2].n_email == 1 and out[1].spans == "email:0:12"
    assert {r.doc_id: r.text for r in pii.mask_documents(docs).collect()} == {1: "[email]\ufffd  ", 2: "[email]"}


def test_loose_spans_keep_off_base_spans():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("0123456789.- ()+@a") for _ in range(120))
        base = pii.base_spans(text)
        taken = [s for k in pii.KINDS for s in base[k]]
        loose = [(k, s, e) for k, s, e, own, _ in pii.candidates(text, base) if not own]
        plain_loose = []
        for kind, shape in pii._LOOSE:
            end = -1
            for m in shape.finditer(text):
                if m.start() >= end and not any(a < m.end() and m.start() < b for a, b in taken):
                    plain_loose.append((kind, *m.span()))
                    end = m.end()
        assert loose == plain_loose


def test_posteriors_equal_a_plain_loop():
    rng = random.Random(9)
    rows = [tuple(rng.randint(0, 2) for _ in range(4)) for _ in range(30)]
    counts = [rng.randint(1, 50) for _ in rows]
    belief = [1 / (1 + np.exp(-(sum(v == pii.YES for v in r) - sum(v == pii.NO for v in r)))) for r in rows]
    for _ in range(50):
        yes, no = sum(c * b for c, b in zip(counts, belief, strict=True)), sum(c * (1 - b) for c, b in zip(counts, belief, strict=True))
        prior, new = (yes + 1) / (yes + no + 2), []
        for r in rows:
            a, b = prior, 1 - prior
            for j, v in enumerate(r):
                a *= (sum(c * p for c, p, q in zip(counts, belief, rows, strict=True) if q[j] == v) + 1) / (yes + 3)
                b *= (sum(c * (1 - p) for c, p, q in zip(counts, belief, rows, strict=True) if q[j] == v) + 1) / (no + 3)
            new.append(a / (a + b))
        done = max(abs(x - y) for x, y in zip(new, belief, strict=True)) < 1e-9
        if done:
            break
        belief = new
    assert np.allclose(pii.estimate(np.array(rows), np.array(counts, float)), belief, atol=1e-8)
