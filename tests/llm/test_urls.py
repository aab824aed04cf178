import re

import pytest

from tidewatch.llm.urls import RULES, filter_urls

SCHEMA = "page_id long, url string, host string, node string"


def judge(spark, urls):
    rows = [(k, u, "h", "n") for k, u in enumerate(urls)]
    return sorted(filter_urls(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r["page_id"])


def expected(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]+", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, rule in RULES:
        of, _, start = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


URLS = [
    "https://A.Example.NET/en/1?x=/de/", "http://example.net/de/2#top", "https://example.net", "ftp://notexample.net/en/", "x://b.example.com/de/9",
    "https://example.com/de", "https://org/fr/1", "https://my.org/fr/", "no scheme", "", None, "a://b://c.net/x", "https://É.net/a", "https://h.com?p/q", "https://x.net/\nen",
]


def test_hosts_paths_and_rules(spark):
    for url, row in zip(URLS, judge(spark, URLS), strict=True):
        host, path, best = expected(url)
        assert (row["host"], row["path"], row["rule"]) == (host, path, best and best[1]), url
        if best:
            assert row["verdict"] == best[0]


def test_numbers_and_rare_segments_become_wildcards(spark):
    urls = [f"https://a.com/post/{k}/view" for k in range(30)] + [f"https://b.com/tag/{'x' * (k + 1)}" for k in range(30)]
    urls += [f"https://c.com/{s}/1" for s in ("news", "blog") for _ in range(20)]
    got = {r["path"].split("/")[1]: r["template"] for r in judge(spark, urls)}
    assert got["post"] == "a.com/post/<n>/view" and got["tag"] == "b.com/tag/*" and got["blog"] == got["news"] == "c.com/{blog|news}/<n>"


def test_templates_mostly_blocked_are_rejected(spark):
    rules = (("block", "bad.com/ads/1"), ("allow", "bad.com/news/"))
    urls = [f"https://bad.com/ads/{k}/banner" for k in [*range(100, 200), *range(20, 30)]] + [f"https://bad.com/news/{k}" for k in range(80)]
    rows = [(k, u, "h", "n") for k, u in enumerate(urls)]
    got = filter_urls(spark.createDataFrame(rows, SCHEMA), rules=rules).collect()
    by = {r["path"]: r for r in got}
    assert by["/ads/25/banner"]["rule"] is None and by["/ads/25/banner"]["verdict"] == "block"
    assert by["/news/5"]["verdict"] == "allow"


def test_similar_branches_merge_and_others_do_not(spark):
    urls = [f"https://s.example.com/{lang}/{k}" for lang in ("de", "en", "fr", "es") for k in range(50)]
    got = {r["path"].split("/")[1]: r["template"] for r in judge(spark, urls)}
    assert got["en"] == got["fr"] == got["es"] == "s.example.com/{en|es|fr}/<n>" and got["de"] == "s.example.com/de/<n>"


@pytest.mark.parametrize("sections", [3, 16, 17, 40])
def test_frequent_branches_stay_apart_at_any_number(spark, sections):
    names = ["de", *("s" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(sections - 1))]
    urls = [f"https://x.example.com/{s}/{k}" for s in names for k in range(20)] + [f"https://x.example.com/{'z' * k}" for k in range(4, 40)]
    got = judge(spark, urls)
    assert all(r["verdict"] == ("block" if r["path"].startswith("/de/") else "allow") for r in got)
    assert {r["template"] for r in got if r["path"].startswith("/de/")} == {"x.example.com/de/<n>"}
    assert {r["template"] for r in got if r["path"].startswith("/z")} == {"x.example.com/*"}
    assert len({r["template"] for r in got}) == 3


def test_branches_below_a_merged_one_and_below_four_levels_stay(spark):
    urls = [f"https://a.com/post/{k}" for k in range(30)] + [f"https://a.com/tag/{'x' * (k + 1)}" for k in range(30)]
    got = {r["path"].split("/")[1]: r["template"] for r in judge(spark, urls)}
    assert got == {"post": "a.com/{post|tag}/<n>", "tag": "a.com/{post|tag}/*"}
    rules = (("block", "b.com/a/b/c/d/bad/1"), ("allow", "b.com/a/b/c/d/good/1"))
    urls = [f"https://b.com/a/b/c/d/{s}/{k}" for s in ("bad", "good") for k in range(100, 230)]
    rows = [(k, u, "h", "n") for k, u in enumerate(urls)]
    got = filter_urls(spark.createDataFrame(rows, SCHEMA), rules=rules).collect()
    assert all((r["verdict"] == "block") == ("/bad/" in r["path"]) for r in got)
    assert {r["template"] for r in got} == {"b.com/a/b/c/d/bad/<n>", "b.com/a/b/c/d/good/<n>"}


def test_odd_rows(spark):
    deep = "https://d.com/" + "/".join(f"s{k}" for k in range(3000))
    got = judge(spark, [deep, deep, None, None, "https://d.com//a//", "://"])
    assert len(got) == 6 and {r["verdict"] for r in got} == {"allow"} and got[2]["host"] == got[2]["path"] == ""
    assert judge(spark, []) == []
