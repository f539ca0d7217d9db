import random
import re

from twinframe.llm.url_filter import judged_urls


def parts(url):
    m = re.search("://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
    return host, m[2] if m else ""


def brute(rows, rules, default="allow"):
    out = []
    for page, url in rows:
        host, path = parts(url)
        fits = [(len(h) + len(p or ""), len(h), v, h + (p or "")) for h, p, v in rules if h is not None and v is not None
                and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fits, default=None)
        out.append((page, host, path, best[3] if best else None, best[2] if best else default))
    return sorted(out, key=repr)


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/es/deep/er", "allow"), ("org", None, "block"), ("org", "/x", "allow"), ("a.b.c.d.e", "/1/2/3/4/", "block"),
    ("twice.io", "/", "allow"), ("twice.io", "/", "block"), (None, "/", "block"), ("nothing.io", "/", None), ("é.fr", "/ü/", "block"),
]


def fixture():
    rng = random.Random(2)
    hosts = ["com", "example.com", "WWW.Example.com", "x.www.example.com", "notexample.com", "a.net", "net", "org", "a..org", "q.a.b.c.d.e",
             "twice.io", "nothing.io", "é.fr", "example.com:80", ".com", "com."]
    paths = ["", "/", "/en", "/en/", "/en/1?x=/es/", "/es/deep/ermine", "/es/deep/", "/x#/en/", "/xylo", "/1/2/3/4/5", "/ü/", "//en/", "/En/"]
    rows = [(k, f"http{rng.choice(['', 's'])}://{h}{p}") for k, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    rows += [(7, "https://net/es/1")] * 3 + [(None, "http://net/es/1"), (900, None), (901, ""), (902, "net/es/1"), (903, "x://y://net/es/"),
             (904, "http://" + "a." * 5000 + "example.com/en/" + "d/" * 20_000), (905, "http://?net/es/"), (906, "mailto:a@b")]
    return rows


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "p", 1) for r in rows], "page_id long, url string, html string, prefix string, part int")


def rule_table(spark, rules=RULES):
    return spark.createDataFrame([(*r, 1) for r in rules], "host string, path string, verdict string, page_id int")


def test_equals_brute_force(spark):
    rows = fixture()
    got = judged_urls(pages(spark, rows), rule_table(spark))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, RULES)


def test_shuffled_join_gives_the_same(spark):
    rows = fixture() + [(k, "http://a.net/es/hot") for k in range(2000, 3000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = judged_urls(pages(spark, rows), rule_table(spark), default="block").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, RULES, "block")


def test_empty_tables(spark):
    rows = fixture()
    assert judged_urls(pages(spark, rows).limit(0), rule_table(spark)).collect() == []
    got = judged_urls(pages(spark, rows), rule_table(spark).limit(0)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, [])


def test_no_python_in_the_plan(spark):
    plan = judged_urls(pages(spark, fixture()), rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
