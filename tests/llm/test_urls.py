import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import urls as U

URLS = [
    None, "", "no scheme/en/", "http://a.com/en/1", "http://COM/en/", "https://xcom/en/", "http://example.com/en/7", "http://m.EXAMPLE.com/en/77?x", "http://notexample.com/en/7", "http://example.com/EN/7",
    "ftp://b.net/de/8", "http://example.net/de/8#t", "http://example.net/de/9", "http://c.org/es/?q", "http://c.org?/es/", "http://c.org#/es/", "http://c.org", "x://y://com/en/", "http://com:80/en/", "http://a.com/en/\n", "http://a.com//en/",
    "https://spam-farm.example.org/en/728", "http://x/Login.php?a", "http://x/a.exe", "http://best-casino.biz/", "http://x/calendar/2020/1/2/", "http://ads.x/banner/1", "http://x/torrent", "http://é.com/en/ü",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for r in U.HOST_RULES:
        h, p = r.name.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r.name), r.name, r.verdict))
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    hits = [r for r in U.PATTERN_RULES if re.search(r.pattern, low)]
    rule = max(fits, default=None)
    return host, path, rule and rule[1], rule[2] if rule else "block" if hits else "allow"


def test_equals_trying_every_rule(spark):
    df = spark.createDataFrame([(i, u, "h", i) for i, u in enumerate(URLS)] + [(3, URLS[3], "h", 0)], "page_id long, url string, host string, rule int")
    rows = U.filter_urls(df, [*U.HOST_RULES, *U.PATTERN_RULES]).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert tuple(r)[1:5] == brute(URLS[r["page_id"]]), URLS[r["page_id"]]


def test_rules_stand_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(f"http://a{i}.com/de/1", 1) for i in range(5)] + [("http://b.net/en/", 1), ("http://c.net/x", 3)], "url string, n long")
    index = {r["name"]: r["token"] for r in U.rule_index(urls, U.rules_table(spark, U.HOST_RULES)).collect()}
    assert index == {"com/en/": "en", "example.com/en/7": "example", "net/de/": "net", "example.net/de/8": "example", "org/es/": "es"}


def test_rules_without_a_literal_are_refused(spark):
    pages = spark.createDataFrame([(1, "http://a.com")], "page_id long, url string")
    for rules in ([U.Rule("any", ".", ())], U.rules_table(spark, U.HOST_RULES).withColumn("tokens", F.array().cast("array<string>"))):
        with pytest.raises(ValueError):
            U.filter_urls(pages, rules)


def test_a_hundred_thousand_rules(spark):
    """Only the rules that a url's tokens fetch run: here at most a few of 100,000 for each url."""
    rules = spark.range(100_000).select(
        F.concat(F.lit("site"), "id").alias("name"),
        F.concat(F.lit("://([^/?#]*[.])?site"), "id", F.lit("[.]org([/?#:]|$)")).alias("pattern"),
        F.array(F.concat(F.lit("site"), "id"), F.lit("org")).alias("tokens"),
        F.lit("block").alias("verdict"),
        F.lit(False).alias("host_rule"),
    )
    pages = spark.range(50_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.site"), F.col("id") * 4, F.when(F.col("id") % 2 == 0, ".org/a").otherwise(".net/")).alias("url"))
    got = U.filter_urls(pages, rules).groupBy("verdict").agg(F.count("*").alias("n"), F.count("pattern_rule").alias("m")).collect()
    assert {r["verdict"]: (r["n"], r["m"]) for r in got} == {"block": (12_500, 12_500), "allow": (37_500, 0)}


def test_odd_tables(spark):
    """Null urls, repeated rows, one url on many pages, clashing columns, very long urls."""
    long = "http://a.com/" + "x" * 1_000_000 + "/casino/"
    rows = [(1, None, "h", 1, "n"), (None, "http://casino.com/", "h", 1, "n"), (1, None, "h", 1, "n"), (2, long, "h", 1, "n"), *[(3, "http://porn.x/", "h", 1, "n")] * 5, (4, "/" * 1_000_000, "h", 1, "n"), (5, "a.a" * 300_000, "h", 1, "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, path string, verdict int, token string")
    got = U.filter_urls(df, [*U.HOST_RULES, *U.PATTERN_RULES]).collect()
    assert sorted((r["page_id"] or 0, r["verdict"], r["pattern_rule"] or "") for r in got) == sorted([(1, "allow", "")] * 2 + [(0, "block", "casino"), (2, "block", "casino"), (4, "allow", ""), (5, "allow", "")] + [(3, "block", "porn")] * 5)


def test_every_match_holds_its_tokens():
    for r in U.PATTERN_RULES:
        for u in URLS:
            if u and r.tokens and re.search(r.pattern, u.lower()):
                assert set(r.tokens) <= set(re.split("[^a-z0-9]+", u.lower()))


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string"), [*U.HOST_RULES, *U.PATTERN_RULES]).count() == 0


def test_verdicts_of_the_contract(spark, tmp_path):
    """The contract's rules by their words, not by the code's list; the query and its SQL."""
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {r.name: r.verdict for r in U.HOST_RULES} == words
    hosts = {"com/en/": "a.com/en/7", "example.com/en/7": "m.example.com/en/71", "net/de/": "casino.net/de/8", "example.net/de/8": "example.net/de/8", "org/es/": "org/es/"}
    spark.createDataFrame([(i, f"http://{hosts[n]}") for i, n in enumerate(words)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    want = [(i, n, w) for i, (n, w) in enumerate(words.items())]
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in U.op4_url_filter(spark, str(tmp_path)).collect()) == want
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(duck.execute(f"SELECT page_id, rule, verdict FROM ({U.OP4_SQL})").fetchall()) == want
