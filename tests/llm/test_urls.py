import random

from tidewatch.llm import urls


def plain(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([k for k in map(tail.find, "?#") if k >= 0], default=len(tail))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (len(r.host + r.path), r.verdict == "block", r.host + r.path))
    return host, path, best.host + best.path, best.verdict


def test_sweep_equals_brute_force(spark):
    rng = random.Random(5)
    labels = ["a", "b", "c", "a-b", "com", "org", "x"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(40)] + ["a.com"] * 40
    paths = ["", "/", "/a", "/a/b", "/ab", "/b/é?q=1", "/a#x", "?q"]
    rows = [(k, f"http://{rng.choice(hosts).upper()}{rng.choice(paths)}") for k in range(600)]
    rows += [(-1, None), (-2, ""), (-3, "no scheme"), (-4, "://"), (None, "x://a.com/a"), (3, "http://A.com/a"), (3, "http://A.com/a"), (-5, "http://a..com/a"), (-6, "http://a.com/" + "p" * 100_000)]
    rules = [urls.Rule(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(["", "/", "/a", "/a/b"])) for _ in range(50)]
    rules += [urls.Rule("block", "com", "/a"), urls.Rule("allow", "com", "/a")]
    pages = spark.createDataFrame([(p, u, "k", 1) for p, u in rows], "page_id long, url string, key string, kind int")
    found = sorted(map(tuple, urls.filter_urls(pages, urls.rule_frame(spark, rules)).collect()), key=str)
    assert found == sorted(((p, *plain(u, rules, "allow")) for p, u in rows), key=str)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert urls.filter_urls(pages, urls.rule_frame(spark, []), "block").first()[3:] == (None, "block")
    assert urls.filter_urls(pages.limit(0), urls.rule_frame(spark, [urls.Rule("allow", "b", "/")])).count() == 0
