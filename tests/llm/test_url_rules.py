"""The sweep against every rule tried on every url."""

import random

import pytest

from foldwise.llm.url_rules import judge_urls

RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "a.net", ""), ("allow", "b.a.net", "/es"), ("block", "x.net", "/q"), ("allow", "x.net", "/q"), (None, "com", "/n"),
    ("block", None, "/"), ("allow", "EXAMPLE.org", "/"), ("block", "example.org", "/a/b/"),
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.index(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    path = rest[len(host) :]
    for mark in "?#":
        path = path.split(mark, 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute(url):
    host, path = plain(url)
    hits = []
    for verdict, rule_host, rule_path in RULES:
        if verdict and rule_host is not None:
            own = rule_host.lower()
            if (host == own or host.endswith("." + own)) and path.startswith(rule_path):
                hits.append((len(rule_host + rule_path), verdict == "block", rule_host + rule_path, verdict))
    return (host, path, *(max(hits)[2:] if hits else (None, "allow")))


@pytest.mark.parametrize("parts", [1, 7])
def test_every_url_gets_the_longest_rule(table, parts):
    rng = random.Random(parts)
    hosts = ["example.com", "www.example.com", "WWW.Example.com", "a.net", "b.a.net", "ba.net", "x.net", "net", "com", "example.org", "x.example.org", "é.net", ""]
    paths = ["", "/", "/en/", "/en/1?x=/es/", "/es/2#t", "/es", "/q", "/n", "/a/b/c", "?q", "#f", "/es\n/"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    urls += [None, "", "no scheme", "mailto:a@b", "http://", "a://b://c"] + ["https://hot.net/es/1"] * 200
    rows = [(i, url, "html", "host", "verdict") for i, url in enumerate(urls)]
    pages = table(rows, "page_id long, url string, html string, host string, verdict string")
    rules = table(RULES, "verdict string, host string, path string")
    found = judge_urls(pages, rules, pages.columns, parts=parts)
    answers = found.select("row.page_id", "row.url", "host", "path", "rule", "verdict").collect()
    assert len(answers) == len(rows)
    for row in answers:
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == brute(row["url"]), row


def test_without_rules_or_pages(table):
    pages, rules = table([(1, "http://a.b/c")], "page_id long, url string"), table([], "verdict string, host string, path string")
    assert [tuple(r)[1:] for r in judge_urls(pages, rules, ["page_id"], default="block").collect()] == [("a.b", "/c", None, "block")]
    assert judge_urls(pages.limit(0), rules, ["page_id"]).count() == 0
