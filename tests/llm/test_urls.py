import pytest

from tidemark.llm import urls

CASES = [
    (None, ("", ""), None, "allow"),
    ("no scheme", ("", ""), None, "allow"),
    ("http://", ("", ""), None, "allow"),
    ("http://A.COM", ("a.com", ""), None, "allow"),
    ("http://a.com/?x#y", ("a.com", "/"), "com/", "allow"),
    ("https://m.Example.com/en/1?p=/", ("m.example.com", "/en/1"), "example.com/en/", "block"),
    ("https://example.com/EN/1", ("example.com", "/EN/1"), "com/", "allow"),
    ("https://www.example.com/en/", ("www.example.com", "/en/"), "www.example.com/en/", "allow"),
    ("https://x.www.example.com/en/a#b", ("x.www.example.com", "/en/a"), "www.example.com/en/", "allow"),
    ("https://notexample.com/en/a", ("notexample.com", "/en/a"), "com/", "allow"),
    ("ftp://b.net/es/://c", ("b.net", "/es/://c"), "net/es/", "block"),
    ("ftp://b.net#/es/", ("b.net", ""), None, "allow"),
    ("x://net/fr/", ("net", "/fr/"), "net/fr/", "block"),
    ("x://net:80/fr/", ("net:80", "/fr/"), None, "allow"),
]


@pytest.mark.parametrize("url, parts, rule, verdict", CASES)
def test_parse(url, parts, rule, verdict):
    assert urls.parse(url) == parts


def test_rows(spark):
    rows = [(i, c[0], "clash") for i, c in enumerate(CASES)] + [(0, CASES[0][0], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = sorted(tuple(r) for r in urls.judge(pages).collect())
    assert [(i, (h, p), r, v) for i, h, p, r, v in got] == [(0, *CASES[0][1:])] + [(i, *c[1:]) for i, c in enumerate(CASES)]
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(pages, [], default="block").collect()} == {"block"}


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda x: len(x))
    path = str(tmp_path / "rules")
    urls.write_index(path, [("aa", "/", "block"), ("bb", "/", "allow"), ("c", "/x/", "block")])
    index = urls.Index(path)
    found = index.probe([b"bb\n/", b"cc\n/", b"aa\n/", b"c\n/x/"])
    assert found[1] == -1
    assert [index.rule(i) for k, i in enumerate(found) if k != 1] == [("bb/", "allow"), ("aa/", "block"), ("c/x/", "block")]
