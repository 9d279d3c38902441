"""URL filter: pattern rules indexed by their rarest literal token, in DataFrame functions only.

Each rule is a regular expression with the literal tokens (runs of a-z and 0-9 in the lower-cased url) that any match must hold. A
rule is indexed under the token of its own that the fewest urls hold, counted over all urls: the index is a table of tokens and
rules. The distinct tokens of each distinct url fetch its candidate rules by an equi-join with that table, and only those run
their regular expressions. So cost follows the candidates, not rules times urls, and no number of rules is too many.

The longest host rule that fits gives `rule` and its verdict; without one, the url is blocked if a pattern rule matches, else
allowed. Rules may come as a list (which stands in the plan) or as a table.

Defined results: a null url, and one without `://`, has an empty host and path, no rule, and is judged by the pattern rules on its
text (null: allowed). Repeated rows stay; empty tables give an empty result; extra columns are ignored. A rule without a literal
token is refused with a ValueError, as no token could fetch it: split it into rules that have one. Of pattern rules that match, the
one of the longest name, then the greatest, is named.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str = "block"
    host_rule: bool = False


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and its subdomains if the path starts with path; matched on host + path. Only tokens with both ends inside the rule count."""
    whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"(?<![a-zA-Z0-9])[a-z0-9]+(?=[^a-zA-Z0-9])", path)
    return Rule(host + path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}".replace(r"\/", "/"), tuple(whole), verdict, True)


def site_rule(host: str) -> Rule:
    """Blocks a site and its subdomains."""
    return Rule(host, rf"://([^/?#]*\.)?{re.escape(host)}([/?#:]|$)".replace(r"\-", "-"), tuple(re.findall("[a-z0-9]+", host)))


# The host rules of the contract, then the pattern rules of the method, which are matched on the lower-cased url.
HOST_RULES = [
    host_rule("com", "/en/", "block"),
    host_rule("example.com", "/en/7", "allow"),
    host_rule("net", "/de/", "allow"),
    host_rule("example.net", "/de/8", "block"),
    host_rule("org", "/es/", "block"),
]
ADULT = ["porn", "porno", "pornos", "xxx", "hentai", "camgirl", "camgirls", "escort", "escorts", "milf", "nsfw", "sexcam", "sexcams"]
GAMBLING = ["casino", "casinos", "slots", "jackpot", "roulette", "sportsbook", "betting", "poker-room"]
PHARMACY = ["viagra", "cialis", "levitra", "xanax", "tramadol", "canadian-pharmacy"]
MONEY = ["payday-loan", "payday-loans", "get-rich-quick", "essay-mill", "buy-followers", "free-iphone"]
PIRACY = ["torrent", "torrents", "warez", "keygen", "keygens", "nulled"]
TRACKERS = ["doubleclick.net", "googlesyndication.com", "adnxs.com", "taboola.com", "outbrain.com", "popads.net", "criteo.com", "scorecardresearch.com"]
FARMS = ["spam-farm", "link-farm", "content-farm"]
FILES = ["exe", "msi", "apk", "dmg", "iso", "rar"]
PATTERN_RULES = [
    *[Rule(w, rf"[./-]{w}([./?&#=-]|$)", tuple(w.split("-"))) for w in [*ADULT, *GAMBLING, *PHARMACY, *MONEY, *PIRACY]],
    *[site_rule(h) for h in TRACKERS],
    *[Rule(w, rf"://([^/?#]*[./-])?{w}\.", tuple(w.split("-"))) for w in FARMS],
    *[Rule(f"file-{e}", rf"/[^/?#]+\.{e}([?#]|$)", (e,)) for e in FILES],
    *[Rule(f"{a}-server", rf"://{a}\.[^/?#]+/{k}/", (a, k)) for a in ("ad", "ads") for k in ("banner", "banners", "click", "clicks")],
    Rule("login", r"/login\.php([?#]|$)", ("login", "php")),
    Rule("session", r"[?&]phpsessid=[0-9a-f]{16,}", ("phpsessid",)),
    Rule("calendar-trap", r"/calendar/[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}/", ("calendar",)),
]


def tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path as the module says."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0), F.lit(""))


RULES = "array<struct<name:string,pattern:string,tokens:array<string>,verdict:string,host_rule:boolean>>"


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """name, pattern, tokens, verdict, host_rule; the rules stand in the plan as literals."""
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.name!r} has no literal token")
    rows = [F.struct(F.lit(r.name), F.lit(r.pattern), F.array(*map(F.lit, r.tokens)), F.lit(r.verdict), F.lit(r.host_rule)) for r in rules]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows).cast(RULES)))


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """rules with the token that each is indexed under: of its own the one that the fewest rows of urls(url, n) hold, then the first by name."""
    own = rules.select(*rules.columns, F.explode(F.array_distinct("tokens")).alias("token"))
    met = urls.select("n", F.explode(tokens(F.col("url"))).alias("token")).join(own.select("token").distinct(), "token", "left_semi")
    counts = met.groupBy("token").agg(F.sum("n").alias("held"))
    whole = own.join(counts, "token", "left").withColumn("held", F.coalesce("held", F.lit(0).cast("bigint")))
    return whole.groupBy("name", "pattern", "verdict", "host_rule").agg(F.min(F.struct("held", "token")).alias("least")).select("name", "pattern", "verdict", "host_rule", "least.token")


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, pattern_rule.

    A url that many pages share is judged once; pages meet their judgement by an equi-join on the url."""
    if isinstance(rules, list):
        rules = rules_table(pages.sparkSession, rules)
    elif not rules.filter(F.size("tokens") < 1).isEmpty():
        raise ValueError("a rule has no literal token")
    pages = pages.select("page_id", "url")
    urls = pages.filter("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("n"))
    host, path = split_url(F.col("url"))
    candidates = urls.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(rule_index(urls, rules), "token")
    subject = F.when(F.col("host_rule"), F.concat(host, path)).otherwise(ascii_lower(F.col("url")))
    hits = candidates.filter(F.rlike(subject, F.col("pattern")))
    named = F.struct(F.length("name").alias("n"), "name", "verdict")
    judged = hits.groupBy("url").agg(F.max(F.when(F.col("host_rule"), named)).alias("fit"), F.max(F.when(~F.col("host_rule"), named)).alias("flag"))
    verdict = F.coalesce(F.col("fit.verdict"), F.col("flag.verdict"), F.lit("allow"))
    return pages.join(judged, "url", "left").select("page_id", host.alias("host"), path.alias("path"), F.col("fit.name").alias("rule"), verdict.alias("verdict"), F.col("flag.name").alias("pattern_rule"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), [*HOST_RULES, *PATTERN_RULES])


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    longest = sorted(HOST_RULES, key=lambda r: -len(r.name))
    names = sorted(PATTERN_RULES, key=lambda r: (len(r.name), r.name), reverse=True)
    rule = " ".join(f"WHEN regexp_matches(host || path, {q(r.pattern)}) THEN {q(r.name)}" for r in longest)
    said = " ".join(f"WHEN {q(r.name)} THEN {q(r.verdict)}" for r in longest)
    flag = " ".join(f"WHEN regexp_matches(low, {q(r.pattern)}) THEN {q(r.name)}" for r in names)
    return f"""
WITH a AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
  translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, low, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {flag} END AS pattern_rule FROM c)
SELECT page_id, host, path, rule, coalesce(CASE rule {said} END, CASE WHEN pattern_rule IS NOT NULL THEN 'block' END, 'allow') AS verdict, pattern_rule FROM d
"""


OP4_SQL = _sql()
