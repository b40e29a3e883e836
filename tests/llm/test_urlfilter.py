import duckdb
import pytest
from compare import differences

from tideline.llm import urlfilter as U
from tideline.llm.queries import SQL, URL_RULES
from tideline.llm.registry import QUERIES


def rows():
    out = [(i, f"https://Big.Example.org/{'en' if i % 3 else 'es'}/{i}.html?x#y") for i in range(120)]
    out += [(200 + i, f"http://shop.example.com/{'de' if i % 2 else 'fr'}/item/{i}/") for i in range(120)]
    out += [(400 + i, f"http://news.example.net/a/{i}") for i in range(60)]
    out += [(500, None), (501, "no scheme"), (502, "http://"), (503, "http://h.example.net"), (504, "http://org/"), (505, "http://a.org?x://y/z"), (506, "ftp://u@x.com/fr/a/b/c/d/e/f/g"), (507, "//x://COM/fr/1"), (None, "http://a.org/1"), (400, "http://news.example.net/a/0"), (508, "")]
    return out


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(rows(), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


def test_against_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    note = differences(QUERIES["op7_url_filters"](spark, folder).toPandas(), con.execute(SQL["op7_url_filters"]).df())
    assert not note, note


def plain_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.rule), default=None)


def test_parts_and_rules(spark, folder):
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in QUERIES["op7_url_filters"](spark, folder).collect()}
    for page, url in rows():
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, tail = rest[:cut].lower(), rest[cut:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        rule = plain_rule(host, path)
        found = got[(page, host, path)]
        assert found[0] == (rule.rule if rule else None)
        if rule:
            assert found[1] == rule.verdict


def test_templates_and_purity(spark):
    data = [("h", f"/good/{i}", 0) for i in range(50)] + [("h", f"/bad/{i}.php", 1) for i in range(50)] + [("h", f"/bad/x{i}.php", None) for i in range(5)] + [("h", "/about", None)]
    pages = spark.createDataFrame(data, "host string, path string, bad int")
    got = U.filter_urls(pages.withColumn("template", pages.host)).toPandas()
    assert set(got["template"]) == {"/good/*", "/bad/*.php", "/about"}
    assert got[got["template"] == "/bad/*.php"]["reject"].all() and not got[got["template"] != "/bad/*.php"]["reject"].any()
    assert len(got) == len(data)
    assert not U.filter_urls(pages.withColumn("bad", pages.bad.cast("int") * None)).toPandas()["reject"].any()
    assert U.filter_urls(pages.limit(0)).count() == 0


def test_similar_branches_merge(spark):
    data = [("h", f"/{c}/{i}", int(i % 2 == 0)) for c in "abc" for i in range(40)] + [("h", f"/z/{i}", 1) for i in range(40)]
    got = U.filter_urls(spark.createDataFrame(data, "host string, path string, bad int")).toPandas()
    assert set(got[got["template"] == "/a/*"]["branch"]) == {"/?/*"} and set(got[got["template"] == "/z/*"]["branch"]) == {"/z/*"}
