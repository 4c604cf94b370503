"""Public suffixes by the published cases, on the lines of the list that they need."""

import pytest

from tamarack.operators import suffixes

LIST = """// comment
com
biz
jp
ac.jp
kyoto.jp
ide.kyoto.jp
*.kobe.jp
!city.kobe.jp   trailing words
*.ck
!www.ck
us
ak.us
k12.ak.us
cn
com.cn
公司.cn
// ===BEGIN PRIVATE DOMAINS===
uk.com
"""
# Cases published with the list: a host and its registered domain.
CASES = (
    (None, None), ("COM", None), ("example.COM", "example.com"), ("WwW.example.COM", "example.com"), ("biz", None), ("domain.biz", "domain.biz"), ("b.domain.biz", "domain.biz"), ("a.b.domain.biz", "domain.biz"), ("uk.com", None), ("example.uk.com", "example.uk.com"),
    ("b.example.uk.com", "example.uk.com"), ("jp", None), ("test.jp", "test.jp"), ("www.test.jp", "test.jp"), ("ac.jp", None), ("test.ac.jp", "test.ac.jp"), ("kyoto.jp", None), ("test.kyoto.jp", "test.kyoto.jp"), ("ide.kyoto.jp", None), ("b.ide.kyoto.jp", "b.ide.kyoto.jp"),
    ("a.b.ide.kyoto.jp", "b.ide.kyoto.jp"), ("c.kobe.jp", None), ("b.c.kobe.jp", "b.c.kobe.jp"), ("a.b.c.kobe.jp", "b.c.kobe.jp"), ("city.kobe.jp", "city.kobe.jp"), ("www.city.kobe.jp", "city.kobe.jp"), ("ck", None), ("test.ck", None), ("b.test.ck", "b.test.ck"),
    ("a.b.test.ck", "b.test.ck"), ("www.ck", "www.ck"), ("www.www.ck", "www.ck"), ("us", None), ("test.us", "test.us"), ("ak.us", None), ("test.ak.us", "test.ak.us"), ("k12.ak.us", None), ("test.k12.ak.us", "test.k12.ak.us"), ("www.test.k12.ak.us", "test.k12.ak.us"),
    ("食狮.com.cn", "xn--85x722f.com.cn"), ("食狮.公司.cn", "xn--85x722f.xn--55qx5d.cn"), ("www.食狮.公司.cn", "xn--85x722f.xn--55qx5d.cn"), ("公司.cn", None), ("xn--85x722f.com.cn", "xn--85x722f.com.cn"),
)


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("list") / "list.dat"
    path.write_text(LIST, encoding="utf-8")
    return lambda **how: suffixes.read_rules(spark, str(path), **how)


def test_published_cases(spark, rules):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "i int, host string")
    got = {r.i: r.registered_domain for r in suffixes.with_registered_domain(rows, "host", rules()).collect()}
    assert got == {i: d for i, (_, d) in enumerate(CASES)}


def test_unknown_and_odd_hosts(spark, rules):
    hosts = ["a.example", "example", "1.2.3.4", "", " ", "a..com", "x.uk.com", "a.b.example.", "x.uk.com"]
    rows = spark.createDataFrame([(h, 1) for h in hosts], "host string, public int")
    got = [(r.host, r.public_suffix, r.registered_domain) for r in suffixes.with_registered_domain(rows, "host", rules(private=False), default=True).collect()]
    assert sorted(got) == sorted([("a.example", "example", "a.example"), ("example", "example", None), ("1.2.3.4", None, None), ("", None, None), (" ", None, None), ("a..com", None, None), *[("x.uk.com", "com", "uk.com")] * 2, ("a.b.example.", "example", "b.example")])
    assert suffixes.with_registered_domain(rows, "host", rules()).where("host = 'a.example' and public_suffix is null").count() == 1
