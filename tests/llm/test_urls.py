"""URL filter against brute force: rules, smoothed models, cutoff, odd URLs."""

import math
import random
import zlib
from collections import Counter

import pytest

from depotry.llm import urls

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def parts(url):
    if url is None or "://" not in url:
        return "", "", lower(url or "")
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    return lower(rest[:cut]), path, lower(rest)


def rule_of(host, path, rules=RULES):
    fit = [(len(r), r.find("/"), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit)[2:] if fit else (None, None)


def probability(counts, context, symbol):
    p = 1 / urls.SYMBOLS
    for k in range(urls.ORDER + 1):
        own = {s: n for s, n in counts[k].get(context[len(context) - k :], {}).items() if n}
        total = sum(own.values())
        if total:
            p = (own.get(symbol, 0) + len(own) * p) / (total + len(own))
    return p


def symbols(text):
    data = bytes([urls.START] * urls.ORDER) + text.encode() + bytes([urls.END])
    return [(data[i - urls.ORDER : i], data[i]) for i in range(urls.ORDER, len(data))]


def brute(rows, finest):
    said = [(u, *parts(u)) for u in rows]
    train = [(rule_of(h, p)[1], t) for _, h, p, t in said if rule_of(h, p)[1] and zlib.crc32(t.encode()) % 5]
    held = [(rule_of(h, p)[1], t) for _, h, p, t in said if rule_of(h, p)[1] and not zlib.crc32(t.encode()) % 5]
    both = Counter((k, c[urls.ORDER - k :], s, v) for v, t in train for c, s in symbols(t) for k in range(urls.ORDER + 1))
    all_ = Counter()
    for (k, c, s, _), n in both.items():
        all_[k, c, s] += n
    least = max(1, sum(len(symbols(t)) for _, t in train) / finest)
    models = {v: [{} for _ in range(urls.ORDER + 1)] for v in ("allow", "block")}
    for (k, c, s, v), n in both.items():
        if all_[k, c, s] >= least:
            models[v][k].setdefault(c, {})[s] = n
    def score(t):
        return sum(math.log2(probability(models["allow"], c, s)) - math.log2(probability(models["block"], c, s)) for c, s in symbols(t)) / len(symbols(t))
    a, b = [score(t) for v, t in held if v == "allow"], [score(t) for v, t in held if v == "block"]
    edges = [i / urls.FINE for i in range(-urls.WIDEST * urls.FINE, urls.WIDEST * urls.FINE + 1)]
    error = lambda e: round(sum(x < e for x in a) / len(a) + sum(x >= e for x in b) / len(b), 9)
    return [(h, p, *rule_of(h, p), score(t)) for _, h, p, t in said], error, edges


def corpus(n=400):
    rng = random.Random(2)
    hosts = ["example.org", "WWW.Example.org", "shop.example.com", "a.net", "blog.b.com", "org", "com", "notorg", "xexample.org"]
    rows = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randint(1, 200)}{rng.choice(['', '/', '?a=b/c', '#x?y'])}" for _ in range(n)]
    return [*rows, None, "", "no scheme.org/fr/", "https://", "http://org", "http://é.org/é", "x://y.com/fr/?u=http://z.org/", "http://example.org?x/es/", "http://a.org/" + "long/" * 3000, *rows[:30]]


@pytest.mark.parametrize("finest", [1 << 17, 300])
def test_equals_brute_force(spark, finest):
    rows = corpus()
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(rows)], "page_id long, url string, HOST string, text string").repartition(3)
    model = urls.fit(frame, RULES, finest)
    got = {r["page_id"]: r for r in urls.judge(frame, RULES, model).collect()}
    want, error, edges = brute(rows, finest)
    assert len(got) == len(rows) and set(next(iter(got.values())).asDict()) == {"page_id", "url", "text", *urls.RESULTS}
    for i, (host, path, rule, verdict, score) in enumerate(want):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["verdict"] == (verdict or ("allow" if r["score"] >= model.cutoff else "block"))
    assert error(model.cutoff) == min(map(error, edges))


def test_held_out_urls_are_told_apart(spark):
    rng = random.Random(4)
    rows = [f"https://{rng.choice(['news', 'docs'])}{rng.randint(0, 99)}.{tld}/{'article' if tld == 'org' else 'casino'}/{rng.randint(0, 9999)}" for tld in ("org", "com") for _ in range(300)]
    other = [f"https://site{i}.net/{word}/{i}" for i in range(50) for word in ("article", "casino")]
    frame = spark.createDataFrame(list(enumerate([*rows, *other])), "page_id long, url string")
    judged = urls.filter_urls(frame, [("allow", "org/"), ("block", "com/")]).where("rule IS NULL").collect()
    assert sum((r["verdict"] == "allow") == ("article" in r["url"]) for r in judged) >= 0.95 * len(judged)


@pytest.mark.parametrize(("rules", "want"), [([("allow", "org/")], "allow"), ([("block", "org/")], "block"), ([], "allow")])
def test_one_kind_only(spark, rules, want):
    frame = spark.createDataFrame([(i, f"http://a.{t}/x{i}") for i, t in enumerate(["org", "net"] * 9)], "page_id long, url string")
    assert {r["verdict"] for r in urls.filter_urls(frame, rules).where("rule IS NULL").collect()} == {want}


def test_empty_table_and_wrong_rule(spark):
    frame = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(frame, RULES).collect() == []
    with pytest.raises(ValueError, match="not a rule"):
        urls.filter_urls(frame, [("deny", "org/")])
