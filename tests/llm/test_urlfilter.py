"""Rules behind the token index against all rules on all urls."""

import re

import pytest

from orderweave.llm import urlfilter

URLS = [
    None, "", "no scheme/en/", "http://", "http://com", "http://com/", "http://a.com?x=/", "https://EXAMPLE.com/en/1", "http://www.example.com/en/",
    "http://m.www.example.com/en/x", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/esx/", "http://net/fr/a?b", "http://x.net/de/",
    "http://ads-track.foo.org/a", "http://foo.org/ads-track.", "http://foo.org/ads/x", "http://foo.org/ads/txt", "http://foo.org/a.exe",
    "http://foo.org/a.exe?x", "http://foo.org/?banner=1", "http://foo.org/xbanner=1", "http://tracker.x.org", "http://foo.org/track?x", "HTTP://A://com/",
    "http://foo.org\n/ads/\n", "http://x.com:80/en/", "http://foo.org/ads/ads/" + "y" * 5000]


def plain(url, rules):
    at = (url or "").find("://")
    after = url[at + 3:] if url and at >= 0 else ""
    raw = re.match(r"[^/?#]*", after)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    rest = after[len(raw):]
    fits = [r for r in rules if re.search(r["regex"].replace(r"\z", r"\Z"), host + rest)]
    best = max(fits, key=lambda r: (r["tier"], r["length"], r["host_length"], r["rule"] or r["pattern"]), default=None)
    return host, re.match(r"[^?#]*", rest)[0], best and best["rule"], best and best["pattern"], best["action"] if best else "allow"


def test_index_finds_what_all_rules_find(spark):
    rules = [urlfilter.host_rule(*r) for r in urlfilter.HOST_RULES] + [urlfilter.pattern_rule(p) for p in (*urlfilter.PATTERNS, "s*t", "|foo")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS)], "page_id long, url string, rule string, token string")
    table = urlfilter.rule_table(spark, patterns=(*urlfilter.PATTERNS, "s*t", "|foo"))
    got = {r.page_id: (r.host, r.path, r.rule, r.pattern, r.verdict) for r in urlfilter.judge_urls(pages, table).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(URLS + URLS)}


@pytest.mark.parametrize(("pattern", "tokens"), [
    ("||ads-track.", ["ads", "track"]), ("/ads/", ["ads"]), ("s*t", []), (".exe|", ["exe"]), ("^banner=", ["banner"]), ("track", []), ("|foo", []),
    ("/a*b/c/", ["c"])])
def test_tokens_stand_alone(pattern, tokens):
    assert urlfilter.pattern_rule(pattern)["tokens"] == tokens


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    none = urlfilter.rule_table(spark, (), ())
    assert [r.verdict for r in urlfilter.judge_urls(pages, none).collect()] == ["allow"]
    assert urlfilter.judge_urls(pages.limit(0), urlfilter.rule_table(spark)).count() == 0
