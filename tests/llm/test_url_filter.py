"""URL filter against plain Python and SQL."""

import duckdb
import pytest

from codequarry.llm import url_filter

SCHEMA = "page_id long, url string"
URLS = [
    None, "", "no-scheme.example/path", "http://", "https://Example.NET", "https://example.net/en/1", "https://sub.EXAMPLE.net/en/", "https://example.net/EN/", "http://a.net", "http://net/", "http://anet/x",
    "https://example.com/de/x?y=1", "https://www.example.com/de", "https://www.example.com/de/#f", "https://x.org/fr/", "https://org/fr/a", "https://xorg/fr/", "ftp://h?/p", "http://h#/p", "a://b://c/d",
    "https://cheap-pills.biz/buy/now", "https://m.library.example/article/9.html", "http://bücher.example/ß/🎉/ж", "http://ÀB.example/", "http://user@host.net:80/p", "x://y/\n/z?q", "http://h/" + "long/" * 3000,
]


def plain(url):
    """Host and path, by the contract's words."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:stop]


def verdict(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return max(fits)[1:]
    b, w = url_filter.weights()
    score = b + sum(w[i] for i in url_filter._buckets(f"^{host}{path}$"))
    return None, "block" if score > 0 else "allow"


def test_equals_plain_python_and_sql(spark):
    rows = list(enumerate(URLS))
    got = sorted(map(tuple, url_filter.judge(spark.createDataFrame(rows, SCHEMA)).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == [(i, *plain(u), *verdict(*plain(u))) for i, u in rows]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    assert con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.oracle()}) ORDER BY 1").fetchall() == got


def blocked(host, path, model):
    return model[0] + sum(model[1][i] for i in url_filter._buckets(f"^{host}{path}$")) > 0


def test_model_tells_the_labelled_urls_apart():
    rows = url_filter.labelled()
    assert sum(blocked(h, p, url_filter.weights()) == (y == 1) for h, p, y, _ in rows) >= 0.98 * len(rows)


def test_recall_on_hosts_not_learned_from():
    rows = [x for x in url_filter.labelled() if x[3]]
    learned = {h.split(".", 1)[-1] if h.count(".") > 1 else h for h, _, _, held in url_filter.labelled() if not held}
    assert not learned & {h for h, *_ in rows}
    model = url_filter.weights(held_out=True)
    recall = sum(blocked(h, p, model) for h, p, y, _ in rows if y) / sum(y for *_, y, _ in rows)
    wrong = sum(blocked(h, p, model) for h, p, y, _ in rows if not y) / sum(1 - y for *_, y, _ in rows)
    print(f"held out: {recall:.2f} of unwanted urls blocked, {wrong:.2f} of wanted ones")
    assert recall >= 0.8 and wrong <= 0.1


def test_repeats_empty_table_other_columns_and_plan(spark):
    pages = spark.createDataFrame([(None, "http://a.net/", "mine", 3), (1, None, "x", 2), (1, None, "x", 2)], SCHEMA + ", verdict string, grams int")
    out = url_filter.judge(pages)
    assert out.columns == ["page_id", "url", "grams", "host", "path", "rule", "score", "verdict"] and out.count() == 3
    assert url_filter.judge(pages.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and not any(x in plan for x in ("Python", "Arrow", "Pandas"))
