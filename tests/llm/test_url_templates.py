import re

import pytest

from plotscope.llm import url_templates
from plotscope.llm.queries import URL_RULES, op3_url_templates


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://A.ORG", "http://a.org/", "x://y://z.com/de/1", "http://example.org/es",
    "http://example.org/es/1?q=/fr/", "http://www.EXAMPLE.org/en/1#x", "http://badexample.org/es/1", "http://com/de/x",
    "http://é.COM/fr/É?x", "http://h\n.net/a\nb/c", "://org/", "http://example.org?://x", "http://ÄB.net//a///b/",
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "x", 1, "y") for i, u in rows], "page_id BIGINT, url STRING, host STRING, n INT, template STRING")


def test_parts_and_rules(spark):
    rows = list(enumerate(URLS)) + [(None, URLS[4]), (3, URLS[3])]
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in url_templates.judge_urls(pages(spark, rows), URL_RULES).collect()), key=repr)
    assert got == sorted(((i, *parts(u), rule_of(*parts(u))[0]) for i, u in rows), key=repr)
    assert url_templates.judge_urls(pages(spark, []), URL_RULES).count() == 0


def judged(spark, urls, rules, **changes):
    found = url_templates.judge_urls(pages(spark, list(enumerate(urls))), rules).collect()
    return {urls[r.page_id]: r for r in found}


def test_blocked_branch_is_rejected_and_its_sibling_is_not(spark):
    rules = [("shop.net", "/deals/1", "block"), ("shop.net", "/help/1", "allow")]
    urls = [f"http://shop.net/{b}/{i}" for b in ("deals", "help") for i in [*range(1, 2), *range(10, 40), *range(100, 190)]]
    urls += ["http://shop.net/deals/77", "http://shop.net/help/77", "http://shop.net/new/5"]
    got = judged(spark, urls, rules)
    assert (got["http://shop.net/deals/77"].verdict, got["http://shop.net/deals/77"].template) == ("block", "/deals/{n}")
    assert (got["http://shop.net/help/77"].verdict, got["http://shop.net/help/77"].template) == ("allow", "/help/{n}")
    assert got["http://shop.net/new/5"].verdict == "allow"
    assert got["http://shop.net/deals/12"].verdict == "block" and got["http://shop.net/deals/12"].rule


def test_similar_branches_merge_and_rare_ones_become_wildcards(spark):
    urls = [f"http://a.net/{b}/{i}" for b in ("x", "y") for i in range(20)]
    urls += [f"http://a.net/x/{i}/name{i}" for i in range(40)]
    got = judged(spark, urls, [("other.net", "/", "block")])
    assert got["http://a.net/y/3"].template == "/{~}/{n}"
    assert got["http://a.net/x/7/name7"].template == "/{~}/{n}/{*}"


@pytest.mark.parametrize(("path", "shape"), [("/12/a12/12.html", ["{n}", "a12", "{n}.html"]), ("/deadbeef01/x//", ["{h}", "x"]), ("", []), ("/1/2/3/4/5/6/7/8", ["{n}"] * 6 + ["{**}"])])
def test_shapes(spark, path, shape):
    from pyspark.sql import functions as F

    assert spark.range(1).select(url_templates.segments(F.lit(path)).alias("s")).collect()[0].s == shape


def test_both_joins_agree(spark, tiny, monkeypatch):
    first = sorted(map(repr, op3_url_templates(spark, tiny).collect()))
    monkeypatch.setattr(url_templates, "FEW_PATHS", 0)
    assert first == sorted(map(repr, op3_url_templates(spark, tiny).collect()))


def test_query_judges_every_page(spark, tiny):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    found = op3_url_templates(spark, tiny).collect()
    assert len(found) == len(urls)
    for r in found:
        host, path = parts(urls[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict == ("block" if r.blocked_share >= url_templates.REJECT else "allow")


def test_templates_differ_below_the_sixth_segment(spark):
    top = "http://deep.net/a/b/c/d/e/f/g"
    rules = [("deep.net", "/a/b/c/d/e/f/g/bad/1", "block"), ("deep.net", "/a/b/c/d/e/f/g/good/1", "allow")]
    urls = [f"{top}/{b}/{i}" for b in ("bad", "good") for i in range(10, 60)] + [f"{top}/alone/x/y"]
    got = judged(spark, urls, rules)
    assert (got[f"{top}/bad/20"].verdict, got[f"{top}/bad/20"].template) == ("block", "/a/b/c/d/e/f/g/bad/{n}")
    assert (got[f"{top}/good/20"].verdict, got[f"{top}/good/20"].template) == ("allow", "/a/b/c/d/e/f/g/good/{n}")
    assert got[f"{top}/alone/x/y"].template.endswith("/x/y")


def test_rare_sibling_with_labels_of_its_own_is_no_wildcard(spark):
    rules = [("hot.net", "/s1/1", "block"), ("hot.net", "/s2/1", "allow")]
    urls = [f"http://hot.net/s{b}/{i}" for b in range(1, 25) for i in range(10, 60)]
    got = judged(spark, urls, rules)
    assert (got["http://hot.net/s1/20"].verdict, got["http://hot.net/s1/20"].template) == ("block", "/s1/{n}")
    assert (got["http://hot.net/s2/20"].verdict, got["http://hot.net/s9/20"].template) == ("allow", "/{*}/{n}")
