import random

from pageflow.llm import url_filter as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for k, ch in enumerate(rest):
        if ch in "/?#":
            host = rest[:k]
            break
    path = rest[len(host) :]
    for k, ch in enumerate(path):
        if ch in "?#":
            path = path[:k]
            break
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain(url, rules, default="allow"):
    """Every rule against the URL."""
    host, path = parts(url)
    best = None
    for h, p, action in rules:
        h, p = "".join(c.lower() if "A" <= c <= "Z" else c for c in h or ""), p or ""
        if not h or any(c in h for c in "/?#") or any(c in p for c in "?#") or (p and not p.startswith("/")) or action not in ("allow", "block"):
            continue
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len(h + p), len(h), h + p, action))
    return host, path, best[2] if best else None, best[3] if best else default


ODD_URLS = [
    None, "", " ", "://", "http://", "no scheme", "http:///fr/", "HTTP://EXAMPLE.ORG", "http://example.org/", "http://a.b.example.org/es/x?y#z", "http://example.org/en/1",
    "http://example.org/en/123", "http://example.org/en/", "http://notexample.org/es/", "http://example.com/fr/?a=/de/", "http://example.com/de/", "http://com/de/", "x://com?/de/",
    "http://com#/de/", "http://user@com:80/de/", "http://com./de/", "http://.com/de/", "http://..com/de/", "http://é.COM/DE/", "http://É.com/de/", "a://b://com/de/", "http://x.com\n/de/", "http://x.com/de/\n",
    "http://" + "a." * 5000 + "com/de/" + "x" * 20000, "http://" + "h" * 50000 + "/", "http://🙂.org/🙂", "http://x.org/es/", "https://example.org//es/", "http://com", "http://org/",
]


def judge(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame([(k, u, "h", "p", "r", 1) for k, u in urls], "page_id long, url string, host string, path string, rule string, row int")
    return U.judged(pages, spark.createDataFrame(rules, U.RULE_SCHEMA), default=default)


def compared(spark, urls, rules, default="allow"):
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted((tuple(r) for r in judge(spark, urls, rules, default).collect()), key=key)
    assert got == sorted(((k, *plain(u, rules, default)) for k, u in urls), key=key)
    return got


def test_contract_rules_on_odd_urls(spark):
    urls = [*enumerate(ODD_URLS), (3, ODD_URLS[3]), (9, ODD_URLS[9]), (9, ODD_URLS[9]), (None, ODD_URLS[15]), (None, None)]
    got = compared(spark, urls, U.RULES)
    assert {r[3] for r in got} >= {None, "org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"}


def test_many_random_rules(spark):
    rng = random.Random(3)
    labels, steps = ["a", "b", "co", "a.b", "", "é"], ["/", "/x", "/x/", "/xy", "/x/y/z", "", "/é/", "/x?y", "noslash"]
    rules = [(".".join(rng.choice(labels) for _ in range(rng.randrange(1, 4))), rng.choice(steps) + rng.choice(["", "", "1", "/2"]), rng.choice(["allow", "block"])) for _ in range(150)]
    rules += [("A.B", "/x", "block"), ("a.b", "/x", "allow"), (None, "/", "block"), ("", "/", "block"), ("co", None, "block"), ("a", "/x", "other"), ("a/b", "/", "block")]
    urls = [(k, "s://" + ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5))) + rng.choice(steps) + rng.choice(["", "1", "/2", "?q", "#f"])) for k in range(1500)]
    compared(spark, urls, rules, "block")


def test_empty_sides(spark):
    urls = [(1, "http://com/de/"), (2, None)]
    assert {r["verdict"] for r in judge(spark, urls, []).collect()} == {"allow"}
    pages = spark.createDataFrame(urls, "page_id long, url string")
    assert U.judged(pages.limit(0), spark.createDataFrame(U.RULES, U.RULE_SCHEMA)).count() == 0


def test_allowed_keeps_columns_and_rows(spark):
    urls = [(1, "http://com/de/"), (2, "http://com/fr/"), (2, "http://com/fr/"), (3, None), (4, "http://x.COM/de/1?q"), (5, "http://x.com/d")]
    pages = spark.createDataFrame([(k, u, "h") for k, u in urls], "page_id long, url string, host string")
    kept = U.allowed(pages, spark.createDataFrame(U.RULES, U.RULE_SCHEMA))
    assert kept.columns == pages.columns
    assert sorted((r["page_id"] for r in kept.collect())) == [2, 2, 3, 5]


def test_digests_beyond_the_short_prefix_are_confirmed(spark, monkeypatch):
    """With a prefix that all expressions share, the full digests alone decide."""
    hashed = U._hashed
    monkeypatch.setattr(U, "_hashed", lambda df, e, d: hashed(df, e, d).withColumn("short", U.F.lit(7).cast("bigint")))
    compared(spark, [*enumerate(ODD_URLS)], U.RULES)
