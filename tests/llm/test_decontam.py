import random
import re

import regex

from tidewatch.llm import decontam

SCHEMA = "doc_id long, text string"
ITEM = "A train leaves Boston at 9:15 and travels 120 miles to Albany before Maria Lopez boards it with 3 bags and a ticket for 45 dollars"


def rows(spark, docs, items):
    d = spark.createDataFrame([(i, t, "extra") for i, t in docs], SCHEMA + ", item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.find_leaks(d, b).collect()}


def test_exact_and_reparameterised_leaks(spark):
    other = ITEM.replace("9:15", "7:40").replace("120", "96").replace("Maria Lopez", "Ada Byron").replace("miles", "km").replace("45", "80")
    steady = "Then Ann paid Bob 5 dollars and later Ann gave Bob 5 euros while Ann and Bob met 5 more friends near the old river bank"
    torn = "Then Ann paid Bob 5 dollars and later Eve gave Joe 8 euros while Kim and Lea met 7 more friends near the old river bank"
    moved = "Then Zoe paid Tim 9 dollars and later Zoe gave Tim 9 euros while Zoe and Tim met 9 more friends near the old river bank"
    docs = [(1, f"some words before. {ITEM} and after"), (2, f"other words {other} end"), (3, "nothing of it " * 50), (4, None), (5, ""), (None, ITEM), (6, moved), (7, torn), (8, steady), (1, "same id again"), (9, "filler words here " * 60_000 + ITEM)]
    found = rows(spark, docs, [(1, ITEM), (2, steady), (3, None), (4, "too short"), (None, ITEM), (5, "one two three four five six seven")])
    assert set(found) == {(1, 1), (2, 1), (6, 2), (8, 2), (9, 1)}
    assert found[1, 1].kind == "exact" and found[8, 2].kind == "exact" and found[9, 1].kind == "exact"
    assert found[2, 1].kind == "reparameterised" and found[2, 1].n_changed >= 4 and found[6, 2].kind == "reparameterised"


def test_plain_passages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda t: re.sub(r"[^\w\s]|_", "", t.lower()).split()
    grams = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    items = {r.item_id: grams(plain(r.text)) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        own = grams(plain(r.text))
        want |= {(r.doc_id, i) for i, g in items.items() if len(g & own) >= 10}
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    assert want and want <= found and len(found - want) <= 2


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, ITEM)], SCHEMA), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontam.find_leaks(d.limit(0), b).count() == 0 and decontam.find_leaks(d, b.limit(0)).count() == 0


def test_items_with_few_literal_words(spark):
    sums, short, dense = "What is 12 + 7 - 3 * 4", "Name the capital", "Add 3 kg 5 kg 7 kg 9 kg then take 4 kg 6 kg 8 kg 2 kg away from all"
    docs = [(1, f"before it. {sums}? And after"), (2, "they say: name the capital."), (3, f"so {dense} and more"), (4, f"so {dense} and more".replace("3", "13").replace("7", "17")), (5, "What is 12 + 7 - 3 * 5"), (6, "What is 12 - 7 - 3 * 4"), (7, "name a capital")]
    found = rows(spark, docs, [(1, sums), (2, short), (3, dense), (4, ""), (5, " ? ")])
    assert {k: r.kind for k, r in found.items()} == {(1, 1): "exact", (2, 2): "exact", (3, 3): "exact", (4, 3): "reparameterised"}


def test_sentence_initial_names(spark):
    item = "Tom buys 5 red apples. Ann buys 3 green pears. Bob eats 2 of them. How many are left for Tom and Ann?"
    put = lambda *names: item.replace("Tom", names[0]).replace("Ann", names[1]).replace("Bob", names[2])
    torn = put("Zoe", "Kim", "Lea").replace("for Zoe and Kim", "for Joe and Max")
    docs = [(1, item), (2, f"A story. {put('Zoe', 'Kim', 'Lea')} The end."), (3, put("Zoe", "Kim", "Lea").replace("5", "8")), (4, "Nothing at all. " * 20), (5, torn), (6, item.lower())]
    found = rows(spark, docs, [(1, item)])
    assert {(d, r.kind) for (d, _), r in found.items() if d < 5} == {(1, "exact"), (2, "reparameterised"), (3, "reparameterised")}
    assert (5, 1) not in found


SPACE = "[ \t\n\r]"
HOLE = {decontam.NUMBER, decontam.UNIT, decontam.NAME}


def plain_words(text):
    """[(literal form, named form, raw word)] by the same patterns, in Python."""
    s = regex.sub(decontam._NAMES, decontam.NAME, text)
    s = regex.sub(decontam._INITIALS, rf"\1\2{decontam.INITIAL}\3", s)
    s = regex.sub(decontam._UNITS, rf"\1{decontam.UNIT}\2", regex.sub(decontam._NUMBERS, decontam.NUMBER, s))
    s = regex.sub(decontam._OTHER, "", s).lower()
    both = zip(regex.split(SPACE, s), regex.split(SPACE, text), strict=True)
    return [(c.replace(decontam.INITIAL, ""), decontam.NAME if c.startswith(decontam.INITIAL) else c, r) for c, r in both if c]


def hole(word):
    return bool(HOLE & set(word))


def plain_leaks(docs, items):
    """{(doc, item): (windows, item windows, slots, changed)} of items that have windows of 8 words with 5 literal ones."""
    words, table, totals = {}, {}, {}
    for i, text in items:
        w = words[i] = plain_words(text)
        for at in range(len(w) - 7):
            t, u = (tuple(x[k] for x in w[at : at + 8]) for k in (0, 1))
            if sum(not hole(x) for x in t) >= 5:
                totals[i] = totals.get(i, 0) + 1
                table.setdefault((0, t), []).append((i, at))
                if t != u and sum(not hole(x) for x in u) >= 3:
                    table.setdefault((1, u), []).append((i, at))
    tidy = lambda x: regex.sub(r"[^\p{L}\p{N}]+", "", x.lower())
    out = {}
    for d, text in docs:
        own, hits = plain_words(text or ""), {}
        for pos in range(len(own) - 7):
            for way in (0, 1):
                for i, at in table.get((way, tuple(x[way] for x in own[pos : pos + 8])), ()):
                    hits.setdefault(i, set()).add((at, way, pos - at))
        for i, found in hits.items():
            first = {}
            for at, way, _ in found:
                first[at] = min(way, first.get(at, 1))
            enough = lambda n, i=i: n >= 6 or n >= 0.5 * totals[i]
            if not enough(len(first)):
                continue
            form, best = int(not enough(sum(w == 0 for w in first.values()))), (0.0, 0, 0, 0, 0)
            for line in {x for _, _, x in found}:
                was = {}
                for j, x in enumerate(words[i]):
                    if 0 <= j + line < len(own) and x[form] == own[j + line][form] and hole(x[form]):
                        old = was.setdefault(tidy(x[2]), [set(), False])
                        old[0].add(tidy(own[j + line][2]))
                        old[1] |= hole(x[0])
                kept = {k: now for k, (now, sure) in was.items() if sure or now != {k}}
                if kept:
                    steady, moved = sum(len(n) == 1 for n in kept.values()), sum(n != {k} for k, n in kept.items())
                    best = max(best, (steady / len(kept), len(kept), -moved, steady, moved))
            if best[3] >= 0.8 * best[1]:
                out[d, i] = (len(first), totals[i], best[1], best[4])
    return out


def test_all_leaks_and_slots_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(4)
    made = "Then Ann paid Bob 5 dollars and later Ann gave Bob 5 euros while Ann and Bob met 5 more friends near the old river bank. Tom left after 9 minutes with 3 bags of corn."
    items.append((9_000, made))
    names = ["Zoe", "Kim", "Joe", "Lea", "Max"]
    for k in range(150):
        text = made
        for old in ("Ann", "Bob", "Tom"):
            new = rng.choice(names)
            text = regex.sub(old, lambda _, new=new: rng.choice([new, new, new, rng.choice(names)]), text)
        text = regex.sub("[0-9]+", lambda _: str(rng.choice([5, 5, 8, 9])), text)
        lo, hi = sorted(rng.sample(range(len(text.split()) + 1), 2))
        docs.append((100_000 + k, "Some words before it. " + " ".join(text.split()[lo : max(hi, lo + 12)]) + rng.choice(["", " and more", f". {text}"])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.n_slots, r.n_changed) for r in decontam.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain_leaks(docs, items)
    assert got == want and len([k for k in want if k[1] == 9_000]) > 20
