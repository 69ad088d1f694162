"""URL rules behind an index of their rarest literal tokens.

A rule is a regular expression over ``host + rest`` of a url, written from a host and path or
from a filter pattern. A literal token is a run of letters and digits that stands alone in every
url the rule matches. Of a rule's tokens the one that is rarest in the urls at hand becomes its
index entry. The tokens of a url fetch candidate rules by an equi-join, and only these run.
A rule without such a token is entered under the empty token, which every url has.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderweave.session import stored

#: The host rules of the query: action, host, path.
HOST_RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Patterns for urls that no host rule fits: ``||`` begins a host label, ``|`` the url's start or
#: end, ``^`` is a separator or the end, ``*`` anything, a leading ``@@`` allows.
PATTERNS = (
    "||ads-track.", "||adserver.", "||tracker.", "||doubleclick.", "/ads/", "/adserver/", "/popunder.", "/track?",
    ".exe|", "^banner=", "@@/ads/txt|")
DEFAULT = "allow"

_TOKEN = re.compile(r"[A-Za-z0-9]+")


def _alone(literal: str, before: bool, after: bool) -> list[str]:
    """Tokens of a literal that surely stand alone; before, after: so do its two ends."""
    return [m[0] for m in _TOKEN.finditer(literal)
            if (m.start() > 0 or before) and (m.end() < len(literal) or after)]


def host_rule(action: str, host: str, path: str) -> dict:
    """Fits the host and all its subdomains, if the url's path starts with ``path``."""
    end = re.escape(path) if path else r"(?=[/?#]|\z)"
    return {"rule": host + path, "pattern": None, "action": action, "tier": 2, "length": len(host + path), "host_length": len(host),
            "regex": rf"\A(?:[^/?#]*\.)?{re.escape(host)}{end}", "tokens": _alone(host + path, True, not path)}


def pattern_rule(pattern: str) -> dict:
    """A filter pattern; allowing ones rank above blocking ones."""
    allow = pattern.startswith("@@")
    body = pattern[2:] if allow else pattern
    start, end = "", ""
    if body.startswith("||"):
        start, body = r"\A(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        start, body = r"\A", body[1:]
    if body.endswith("|"):
        end, body = r"\z", body[:-1]
    regex, tokens = "", []
    pieces = re.split(r"([*^])", body)
    for i, piece in enumerate(pieces):
        if i % 2:
            regex += r".*" if piece == "*" else r"(?:[^A-Za-z0-9_.%-]|\z)"
            continue
        regex += re.escape(piece)
        before = bool(start) if i == 0 else pieces[i - 1] == "^"
        after = bool(end) if i == len(pieces) - 1 else pieces[i + 1] == "^"
        tokens += _alone(piece, before, after)
    return {"rule": None, "pattern": pattern, "action": "allow" if allow else "block", "tier": int(allow), "length": len(pattern),
            "host_length": 0, "regex": f"(?s){start}{regex}{end}", "tokens": tokens}


def rule_table(spark: SparkSession, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    rows = [host_rule(*r) for r in host_rules] + [pattern_rule(p) for p in patterns]
    made = spark.createDataFrame(
        [{"id": i, **r} for i, r in enumerate(rows)],
        "id int, rule string, pattern string, action string, tier int, length int, host_length int, regex string, tokens array<string>")
    # Read back, so that Spark knows the size and broadcasts the rules only if they are small.
    return stored(made, "url-rules")


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path, and host + rest, all empty without ``://``; A-Z lower-cased in the host."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    after = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise(F.lit(""))
    raw = F.regexp_extract(after, r"\A([^/?#]*)", 1)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = F.substring(after, F.length(raw) + 1, F.lit(1 << 30))
    return host, F.regexp_extract(rest, r"\A([^?#]*)", 1), F.concat(host, rest)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, pattern, verdict, per row of pages.

    pages: page_id, url; other columns are not touched. The longest host rule that fits decides
    (ties: the longer host, then the name), else an allowing pattern, else a blocking one, else
    ``default``. rule: the host rule; pattern: the pattern that decided; else null.

    Null url, or one without ``://``: host and path empty, the verdict that the empty url has.
    Repeated rows: one result each; equal urls are judged once. Empty tables: no rows; without
    rules every url has the default.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    urls = pages.select(url.alias("url")).distinct()
    target = url_parts(F.col("url"))[2]
    tokens = urls.select("url", target.alias("target")).withColumn("token", F.explode(F.array_distinct(F.concat(
        F.array(F.lit("")), F.regexp_extract_all("target", F.lit("([A-Za-z0-9]+)"), F.lit(1))))))
    entries = rules.select("id", F.explode(F.when(F.size("tokens") > 0, F.array_distinct("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    seen = tokens.join(entries.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = entries.join(seen, "token", "left").groupBy("id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    index = stored(rarest.select("id", F.col("least.token").alias("token")).join(rules.drop("tokens"), "id"), "url-index")
    # What is needed of the index stays small; Spark decides from its size how to join.
    candidates = tokens.join(index, "token").where(F.expr("rlike(target, regex)"))
    best = candidates.groupBy("url").agg(F.max(F.struct("tier", "length", "host_length", "rule", "pattern", "action")).alias("best"))
    host, path, _ = url_parts(F.col("own_url"))
    rows = pages.select("page_id", url.alias("own_url")).join(best, F.col("own_url") == F.col("url"), "left")
    return rows.select("page_id", host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"),
                       F.col("best.pattern").alias("pattern"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


ORACLE = r"""
with a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as after from pages),
h as (select page_id, regexp_extract(after, '^[^/?#]*') as raw, substr(after, length(regexp_extract(after, '^[^/?#]*')) + 1) as rest from a),
u as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^?#]*') as path, rest from h),
r(action, rh, rp) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m as (select page_id, max({n: length(rh || rp), h: length(rh), rule: rh || rp, action: action}) as b
      from u join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1),
l(pattern, re) as (values ('||ads-track.', '^([^/?#]*[.])?ads-track[.]'), ('||adserver.', '^([^/?#]*[.])?adserver[.]'), ('||tracker.', '^([^/?#]*[.])?tracker[.]'),
      ('||doubleclick.', '^([^/?#]*[.])?doubleclick[.]'), ('/ads/', '/ads/'), ('/adserver/', '/adserver/'), ('/popunder.', '/popunder[.]'), ('/track?', '/track[?]'),
      ('.exe|', '[.]exe$'), ('^banner=', '[^A-Za-z0-9_.%-]banner='), ('@@/ads/txt|', '/ads/txt$')),
p as (select page_id, max({tier: pattern[1:2] = '@@', n: length(pattern), pattern: pattern}) as b from u join l on regexp_matches(host || rest, re) group by 1)
select page_id, host, path, m.b.rule as rule, case when m.b is null then p.b.pattern end as pattern,
       coalesce(m.b.action, case when p.b is null or p.b.tier then 'allow' else 'block' end) as verdict
from u left join m using (page_id) left join p using (page_id)
"""
