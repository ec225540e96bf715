import random
import re

from tessella.llm import url_rules


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_nested_rules_match_brute_force(spark):
    r = random.Random(2)
    labels = ["a", "b", "ab", "a-b", "www", "x"]
    hosts = sorted({".".join(r.choice(labels) for _ in range(r.randint(1, 4))) for _ in range(80)})
    rules = sorted({(h, r.choice(["/", "/en/", "/e", ""])): r.choice(["allow", "block"]) for h in hosts[::2]}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{r.choice(hosts).upper() if i % 7 == 0 else r.choice(hosts)}{r.choice(['', '/', '/en/x', '/e?q=/en/', '#/en/'])}" for i in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "http:///en/", "http://A.B:80/en/"] + ["http://a.b/en/"] * 300
    pages = spark.createDataFrame([(i, u, "theirs") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls)
    for x in got:
        assert (x.host, x.path, x.rule, x.verdict) == plain(urls[x.page_id], rules), urls[x.page_id]


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()] == [(None, "allow")]
    assert url_rules.judge(pages.limit(0), rules).count() == 0


def judged(spark, urls, rules, partitions=4):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        return {urls[r.page_id]: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, given).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_many_path_rules_on_one_host(spark):
    r = random.Random(4)
    rules = [("big.com", f"/{'x' * (i % 3)}{i}", r.choice(["allow", "block"])) for i in range(10_000)]
    rules += [("com", "/", "block"), ("big.com", "/7", "allow"), ("big.com", "/77", "block"), ("a.big.com", "/7", "block"), ("", "/q", "block")]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = list({f"http://{r.choice(['', 'a.', 'b.a.'])}big.com/{r.choice(['', 'x', 'xx'])}{r.randrange(12_000)}/{r.choice('ab')}" for _ in range(400)})
    urls += ["http://other.net/q", "http://other.net/p", "http://big.com", "http://x.com/1", "http://big.com/" + "7" * 100_000, "http://bigxcom/1", "http://abig.com/7"]
    for partitions in (1, 16):
        got = judged(spark, urls, rules, partitions)
        assert [u[:60] for u in urls if got[u] != plain2(u, rules)] == []


def plain2(url, rules):
    """plain() for rules that may have an empty host."""
    host, path, *_ = plain(url, [])
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_nesting_across_partitions(spark):
    # every rule is nested in the one before, and pages stand between their begins
    rules = [("h.com", "/" + "a" * n, ("allow", "block")[n % 2]) for n in range(60)]
    urls = [f"http://h.com/{'a' * n}{end}" for n in range(0, 62) for end in ("", "b", "Z", "\U0010ffff", "é")]
    got = judged(spark, urls, rules, 23)
    assert [u for u in urls if got[u] != plain2(u, rules)] == []


def test_clashing_columns_pass_through(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "k", "s", "p", "v")], "page_id long, url string, key string, best string, part string, verdict string")
    (r,) = url_rules.judge(pages, spark.createDataFrame([("b", None, "block"), ("b", "", "allow")], "host string, path string, verdict string")).collect()
    assert (r.key, r.best, r.part, r.rule, r.verdict) == ("k", "s", "p", "b", "allow")
