import duckdb
import numpy as np
import pytest

from flowsieve.llm import urls as U

FOLDER = "/root/testdata/sf0.01"


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h) + len(p), h + p, v) for v, h, p in sorted(rules, reverse=True) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: f[0], default=None)
    return host, path, best and best[1], best[2] if best else default


def test_whole_table(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()}
    got = U.op9_url_filter(spark, FOLDER).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {k: plain(u, U.RULES) for k, u in pages.items()} and len(got) == len(pages)


def test_sql_agrees():
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    urls = dict(db.execute("SELECT page_id, url FROM pages").fetchall())
    assert {r[0]: r[1:] for r in db.execute(U.SQL).fetchall()} == {k: plain(u, U.RULES) for k, u in urls.items()}


@pytest.mark.parametrize("ranges", [1, 6, 90])
def test_nested_rules(spark, ranges):
    rng = np.random.default_rng(4)
    labels, paths = ["a", "b", "ab", "a-b", "com"], ["", "/", "/a", "/a/", "/a/b", "/b"]
    host = lambda: ".".join(rng.choice(labels, rng.integers(1, 5)))
    rules = list({(host(), rng.choice(paths)): None for _ in range(30)})
    rules = [(str(rng.choice(["allow", "block"])), h, str(p)) for h, p in rules]
    rows = [(k, f"http://{host()}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#x', 'z'])}") for k in range(200)]
    out = U.judge(spark.createDataFrame(rows, "page_id long, url string"), U.rules_table(spark, rules), default="none", ranges=ranges).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out} == {k: plain(u, rules, "none") for k, u in rows}


def test_awkward_rows(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "HTTP://WWW.Example.ORG/es/1?x#y"), (4, "HTTP://WWW.Example.ORG/es/1?x#y"), (None, "x://org"), (6, "a://b://org/"), (7, "http://é.org/"), (8, "http://org./\n/"), (9, "h://" + "a." * 3000 + "org/")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, host string")
    out = U.judge(docs, U.rules_table(spark, U.RULES)).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out), key=repr) == sorted(((k, *plain(u, U.RULES)) for k, u in rows), key=repr)
    assert U.judge(docs.where("false"), U.rules_table(spark, U.RULES)).count() == 0
    none = U.judge(docs, U.rules_table(spark, U.RULES).where("false"), default="block").collect()
    assert len(none) == len(rows) and {(r.rule, r.verdict) for r in none} == {(None, "block")}


def test_rules_are_not_repeated_and_a_hot_host_is_split(spark):
    rules = U.rules_table(spark, [("allow", "org", "/")] + [("block", f"h{k}.org", "/") for k in range(50)])
    pages = spark.range(4000).selectExpr("id", "IF(id % 3 = 0, 'hot.org', concat('h', id % 60, '.org')) AS host", "concat('/', id) AS path")
    rows = U.placed(pages, rules, 16).groupBy("part").agg(U.F.count_if(U.F.expr("kind = 0")).alias("rules"), U.F.count_if(U.F.expr("kind = 1")).alias("pages")).collect()
    assert sum(r.rules for r in rows) == 51 and sum(r.pages for r in rows) == 4000 and max(r.pages for r in rows) < 700
    out = U.judge(pages.selectExpr("id AS page_id", "concat('http://', host, path) AS url"), rules, ranges=16).groupBy("host", "rule", "verdict").count().collect()
    assert all(r.rule == (f"{r.host}/" if r.verdict == "block" else "org/") for r in out) and sum(r["count"] for r in out if r.verdict == "allow") == 1334 + sum(1 for k in range(4000) if k % 3 and k % 60 >= 50)
