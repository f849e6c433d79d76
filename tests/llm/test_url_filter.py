import random

from pyspark.sql import Row

from lockstep.llm import url_filter
from lockstep.llm.url_filter import RULES, Cascade, judge

SCHEMA = "page_id long, url string, host int, key string"


def brute_force(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:end].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), rest[end:]
        path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    fits = []
    for action, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), action == "block", rule, action))
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def urls():
    rng = random.Random(1)
    out = [None, "", "nothing", "http://", "http://org", "http://org/", "HTTP://A.EXAMPLE.ORG/en/10?x#y", "http://notexample.org/es/", "x://a://b/", "http://example.org?/es/", "http://com/de/" + "x" * 5000, "http://a.b\nc.org/\nx"]
    hosts = ["example.org", "www.Example.org", "a.b.c.example.com", "com", "org", "exampleorg", "x.net", "fr.com", ".org", "org."]
    paths = ["", "/", "/es", "/es/", "/es/1", "/en/1", "/en/12", "/en/2", "/fr/x", "/de/", "/de", "//", "/ES/"]
    return out + [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/de/', '#/es/'])}" for _ in range(400)]


def test_against_brute_force(spark):
    rows = [Row(page_id=i if i else None, url=u, host=1, key="k") for i, u in enumerate(urls())]
    got = {r.page_id: tuple(r)[1:] for r in judge(spark.createDataFrame(rows, SCHEMA), RULES).collect()}
    assert got == {r.page_id: brute_force(r.url, RULES) for r in rows}


def test_many_cascades_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LISTED", 2)
    rows = [Row(page_id=i // 2, url=u, host=1, key="k") for i, u in enumerate(urls()[:60])] * 2
    got = sorted((tuple(r) for r in judge(spark.createDataFrame(rows, SCHEMA), RULES).collect()), key=str)
    assert got == sorted(((r.page_id, *brute_force(r.url, RULES)) for r in rows), key=str)


def test_equal_rules_and_none(spark):
    rows = spark.createDataFrame([Row(page_id=1, url="http://a.org/x", host=1, key="k")], SCHEMA)
    assert judge(rows, [("allow", "a.org/x"), ("block", "a.org/x")]).head().verdict == "block"
    assert tuple(judge(rows, []).head())[3:] == (None, "allow")
    assert judge(rows.limit(0), RULES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("cast(id as string) AS key")
    listed = universe.where("cast(key as long) % 7 = 0")
    old, url_filter.BITS_PER_KEY = url_filter.BITS_PER_KEY, 6
    try:
        cascade = Cascade.build(listed, universe)
    finally:
        url_filter.BITS_PER_KEY = old
    assert len(cascade.levels) > 2
    wrong = universe.withColumn("got", cascade.contains(universe["key"])).where("got <> (cast(key as long) % 7 = 0)")
    assert wrong.count() == 0
