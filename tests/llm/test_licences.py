import random
import re

from tidewatch.llm import licences


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns_equal_brute_force(spark):
    rng = random.Random(3)
    words = "under the mit license apache version 2 cc by nc 4 0 word été THE".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "Released under the MIT License.", "under the under the mit license, version 2", "CC-BY-NC/cc by nc", "Apache License, Version 2.0 " * 50_000, "cc by nc_ccby nc"]
    rows = list(enumerate(texts)) + [(None, texts[-1]), (3, texts[3])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, labels int")
    found = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licences.scan_licences(docs).collect()]
    assert sorted(found, key=str) == sorted(((d, *plain(t)) for d, t in rows), key=str)
    assert licences.scan_licences(docs.limit(0)).count() == 0


def test_matching_statistics_equal_brute_force():
    rng = random.Random(1)
    texts = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(5)]
    machine = licences.Automaton(texts)
    known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(200):
        words = [rng.randrange(5) for _ in range(20)]
        for at, (_, size) in enumerate(machine.statistics(words)):
            best = max((n for n in range(at + 2) if n == 0 or tuple(words[at + 1 - n : at + 1]) in known))
            assert size == best


def test_templates_with_gaps_are_found():
    own = licences.scanner()
    notice = licences.TEMPLATES["mit"].replace("free of charge", "at no charge at all")
    _, _, found = own.scan(("intro " * 30 + notice).encode())
    assert max(own.covered(t, m) for t, m in found.items() if own.labels[t] == "mit") >= licences.COVER
    _, _, found = own.scan(b"to use and to copy this file is free of charge for you and for the software")
    assert all(own.covered(t, m) < licences.COVER for t, m in found.items())


def test_phrases_inside_longer_matches_are_found():
    texts = ["Licensed under the Apache License, Version 2.0", "licensed under CC BY-NC 4.0", "This is released under the MIT license", *licences.TEMPLATES.values()]
    for text in texts:
        _, places, _ = licences.scanner().scan(text.encode())
        _, n, first, last, labels = plain(text)
        assert (len(places), min((s for s, _ in places), default=None), max((s for s, _ in places), default=None)) == (n, first, last)
        assert ",".join(sorted({licences.scanner().labels[t] for _, t in places})) == labels
    own = licences.Scanner({"a b c z": "one", "c z": "two", "z": "three"}, {"long": "q x y c z a b c z", "other": "b x y z"})
    _, places, _ = own.scan(b"q x y c z b x y z a b c z")
    assert sorted((s, own.labels[t]) for s, t in places) == [(3, "two"), (4, "three"), (8, "three"), (9, "one"), (11, "two"), (12, "three")]


def test_chains_equal_brute_force():
    rng = random.Random(5)
    own = licences.Scanner({"x y z": "x"}, {"long": " ".join(f"w{k}" for k in range(20))})
    reach = 2 * own.sizes[1]

    def longest(matches, last, total):
        best = total
        for s, p, n in matches:
            if last is None:
                best = max(best, longest(matches, (s, p, n), n))
                continue
            s0, p0, n0 = last
            over = max(0, s0 + n0 - s, p0 + n0 - p)
            if s0 < s <= s0 + reach and p0 < p and over < n:
                best = max(best, longest(matches, (s, p, n), total + n - over))
        return best

    for _ in range(200):
        matches = [(rng.randint(0, 60), rng.randint(0, 16), rng.randint(3, 6)) for _ in range(rng.randint(1, 7))]
        assert own.covered(1, matches) == longest(matches, None, 0) / 20
