from matrixloom.llm import url_filters as U

URLS = [None, "", "nothing", "http://", "http://ORG/", "https://a.example.org/es/x?q#f", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/",
        "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/y", "ftp://x.net/", "http://EXAMPLE.org/es/", "http://b.example.org?x=/es/", "x://y://z.org/", "http://ÄB.org/é",
        "http://example.org:80/es/", "http://..org/", "http://example.org/es/" + "a" * 3000, "http://" + "a." * 300 + "org/es/"]


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_equal_a_plain_loop(spark):
    pages = spark.createDataFrame([(k, u, "h", "z") for k, u in enumerate([*URLS, *URLS])], "page_id long, url string, rule string, best string")
    got = {r["page_id"]: tuple(r)[1:] for r in U.url_filter(pages, U.production_rules(spark)).collect()}
    assert got == {k: plain(u, U.RULES) for k, u in enumerate([*URLS, *URLS])}


def test_many_rules_take_the_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_RULES", 900)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = U.production_rules(spark).union(spark.createDataFrame([("block", None, "/"), ("block", "org", "/"), ("allow", "", "/x")], "verdict string, host string, path string"))
    got = {r["page_id"]: tuple(r)[1:] for r in U.url_filter(pages, rules).collect()}
    known = [("block" if (h, p) == ("org", "/") else v, h, p) for v, h, p in U.RULES]
    assert got == {k: plain(u, known) for k, u in enumerate(URLS)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.url_filter(pages, U.production_rules(spark)).isEmpty()
    none = U.production_rules(spark).limit(0)
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert U.url_filter(one, none).collect()[0]["verdict"] == "allow"
