"""URL filters against sets of strings."""

from quire.llm import urlfilter


def test_against_brute_force(spark):
    hosts = [f"h{i}.example.com" for i in range(50)]
    entries = hosts[:20] + ["bad.org", "ok.net/a/b"]
    urls = [f"http://{x}{h}{p}" for h in hosts for x in ("", "www.", "a.b.") for p in ("", "/", "/x?y#z")] + ["https://bad.org:80/q", "HTTPS://User@WWW.Bad.ORG/", "ok.net/a/b/", "ok.net/a", "notbad.org", "//bad.org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    blocked = urlfilter.build(spark.createDataFrame([(e,) for e in entries + [None, "", "bad.org"]], "entry string"), shard=5)
    assert len(blocked.shards) > 1
    got = {r.page_id for r in urlfilter.match(pages, blocked).filter("matched IS NOT NULL").collect()}
    from urllib.parse import urlsplit

    want = set()
    for i, u in enumerate(urls):
        p = urlsplit(u if "//" in u else "//" + u)
        h = (p.hostname or "").removeprefix("www.")
        labels = h.split(".")
        tries = {h + p.path.rstrip("/"), h} | {".".join(labels[k:]) for k in range(1, len(labels) - 1)}
        if tries & set(entries):
            want.add(i)
    assert got == want
    assert urlfilter.url_filter(pages, blocked).count() == len(urls) - len(want)


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: 7)
    d = urlfilter.digests([b"a", b"b"])
    import numpy as np

    opened = (np.array([d[0]]), [(np.sort(d), np.array([0, 1, 2]), np.frombuffer(b"ab", np.uint8))])
    assert urlfilter.DigestArray.probe(opened, [b"b", b"c", b"a"]).tolist() == [True, False, True]


def test_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "http://bad.org/" + "p" * 200_000, "z"), (3, "   ", None), (4, "http://é.bad.org", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, matched string")
    blocked = urlfilter.build(spark.createDataFrame([("bad.org",)], "entry string"))
    out = urlfilter.match(pages, blocked)
    assert out.columns == ["page_id", "url", "matched", "_matched"]
    assert sorted(str(r.page_id) for r in out.filter("_matched IS NOT NULL").collect()) == ["4", "None"]
    assert urlfilter.match(pages.limit(0), blocked).count() == 0
    none = urlfilter.build(spark.createDataFrame([], "entry string"))
    assert urlfilter.url_filter(pages, none).count() == 6
