import math

from pyspark.sql import functions as F

from lodestone.llm import urlfilter
from lodestone.llm.registry import URL_RULES


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    tail = rest[end:]
    stop = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def brute_rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://A.Example.com/en/7?x#y", "https://www.example.com/en/9", "example.com/en/", None, "", "x://É.COM/en/#", "ftp://com/en/",
        "http://notcom/en/", "http://example.net/de/8/", "http://a.b.example.net/de/9", "http://example.org/es/", "http://example.org/es",
        "http://h?q=/en/", "http://h#f", "://host/p?q", "http://u:p@example.com:80/en/7", "a://b://c/d", "http:///en/", "http://com\n/en/"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, "http://com/en/"), (0, URLS[0])], "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    rows = urlfilter.filter_urls(pages, labels, URL_RULES).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        url = "http://com/en/" if r["page_id"] is None else URLS[r["page_id"]]
        host, path = brute_split(url)
        verdict, rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow"), url


def test_reputation_matches_the_formulas(spark):
    """Counts shrunk by hand, level by level."""
    hosts = {"bad.x.com": (40, 38), "ok.x.com": (40, 2), "few.x.com": (1, 1), "none.x.com": (0, 0), "a.y.org": (30, 1), "b.y.org": (30, 29), "z.net": (20, 3)}
    pages, labels, n = [], [], 0
    for host, (labelled, bad) in hosts.items():
        for k in range(max(1, labelled)):
            pages.append((n, host))
            if k < labelled:
                labels.append((n, int(k < bad)))
            n += 1
    got = {r["host"]: r for r in urlfilter.host_reputation(spark.createDataFrame(pages, "page_id long, host string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}

    def level(groups, parent):
        rows = [(n, k, parent[g]) for g, (n, k) in groups.items() if n and 0 < parent[g] < 1]
        x = sum(n * (k / n - m) ** 2 / (m * (1 - m)) for n, k, m in rows)
        s = 1 / min(0.5, max(1e-4, (x - len(rows)) / sum(n - 1 for n, _, _ in rows))) - 1
        return {g: ((k + s * parent[g]) / (n + s), n + s) for g, (n, k) in groups.items()}

    def rolled(part):
        out = {}
        for h, (n, k) in hosts.items():
            g = ".".join(h.split(".")[-part:])
            out[g] = (out.get(g, (0, 0))[0] + n, out.get(g, (0, 0))[1] + k)
        return out

    total, bad = (sum(v[i] for v in hosts.values()) for i in (0, 1))
    suffix = level(rolled(1), dict.fromkeys(rolled(1), (bad + 1) / (total + 2)))
    domain = level(rolled(2), {d: suffix[d.split(".")[-1]][0] for d in rolled(2)})
    host = level(hosts, {h: domain[".".join(h.split(".")[-2:])][0] for h in hosts})
    for h, (mu, w) in host.items():
        assert math.isclose(got[h]["mean"], mu, rel_tol=1e-9)
        assert math.isclose(got[h]["bound"], mu - 1.645 * math.sqrt(mu * (1 - mu) / (w + 1)), rel_tol=1e-9)
    assert got["bad.x.com"]["bound"] > 0.5 > got["few.x.com"]["bound"] and got["none.x.com"]["n"] == 0


def test_verdicts_and_edges(spark):
    pages = spark.createDataFrame([(i, "http://bad.com/") for i in range(60)] + [(100, "http://good.com/"), (101, None)], "page_id long, url string")
    pages = pages.withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(100, 0), (None, 1), (51, None), (999, 1)], "page_id long, bad int")
    rows = urlfilter.filter_urls(pages, labels, []).collect()
    assert {r["verdict"] for r in rows if r["page_id"] < 60} == {"block"}
    assert {r["verdict"] for r in rows if r["page_id"] == 100} == {"allow"} and all(r["rule"] is None for r in rows)
    assert [(r["host"], r["path"]) for r in rows if r["page_id"] == 101] == [("", "")] and len(rows) == 62
    assert urlfilter.filter_urls(pages.limit(0), labels, URL_RULES).count() == 0


def test_registered_domains_under_countries(spark):
    """co.uk is a suffix: what one of its domains does is not the other's."""
    hosts = ["a.bad.co.uk"] * 60 + ["b.bad.co.uk", "c.good.co.uk", "co.uk", "x.uk"]
    pages = spark.createDataFrame(list(enumerate(hosts)), "page_id long, host string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(61, 0)], "page_id long, bad int")
    got = {r["host"]: r["mean"] for r in urlfilter.host_reputation(pages, labels).collect()}
    assert got["b.bad.co.uk"] > got["c.good.co.uk"] and len(got) == 5
