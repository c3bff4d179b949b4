import numpy as np
from pyspark.sql import functions as F

from loopsight.llm.quality import quality_posterior, site_of


def strength(groups):
    """By moments of (sum, number, mean around)."""
    n = np.array([g[1] for g in groups], dtype=float)
    m, c = np.array([g[0] / g[1] for g in groups]), np.array([g[2] for g in groups])
    within = (n * c * (1 - c)).sum() / n.sum()
    spread = n.sum() - (n * n).sum() / n.sum()
    tau = ((n * (m - c) ** 2).sum() - (len(n) - 1) * within) / spread
    return float(np.clip(within / tau - 1, 1, 1e4)) if tau > 0 else 1e4


def test_sparse_and_hot_hosts(spark):
    random = np.random.default_rng(6)
    words = "a good long text about the study of many rivers and hills".split()
    rows = []
    for i in range(900):
        good = random.random() < (0.9 if i % 3 == 0 else 0.4)
        text = " ".join(random.choice(words, size=60)) + "." if good else "BUY NOW!!! $$$ " * int(random.integers(1, 9))
        # a third on the hot host, in two paths and other spellings; the rest alone on theirs
        url = f"https://{('Hot.example', 'me@hot.example:8080')[i % 2]}/p{i % 4}/{i}" if i % 3 == 0 else f"http://h{i}.example?x"
        rows.append((i, url, text, int(good)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, url string, text string")
    labels = spark.createDataFrame([(r[0], float(r[3])) for r in rows if r[0] % 2], "doc_id long, quality double")
    sites = {r["doc_id"]: (r["host"], r["path"]) for r in docs.select("doc_id", *[x.alias(n) for x, n in zip(site_of(F.col("url")), ("host", "path"))]).collect()}
    assert all(sites[r[0]] == (("hot.example", f"p{r[0] % 4}") if r[0] % 3 == 0 else (f"h{r[0]}.example", "")) for r in rows)
    got = {r["doc_id"]: r for r in quality_posterior(docs, labels, *site_of(F.col("url"))).collect()}
    assert len(got) == len(rows)
    hosts, paths = {}, {}
    for i, (host, path) in sites.items():
        for groups, key in ((hosts, host), (paths, (host, path))):
            s, n = groups.get(key, (0.0, 0))
            groups[key] = (s + got[i]["evidence"], n + 1)
    mean = sum(s for s, _ in hosts.values()) / len(rows)
    a = strength([(*g, mean) for g in hosts.values()])
    whole = {h: (a * mean + s) / (a + n) for h, (s, n) in hosts.items()}
    b = strength([(*g, whole[key[0]]) for key, g in paths.items()])
    for i, (host, path) in sites.items():
        e, (hs, hn), (ps, pn) = got[i]["evidence"], hosts[host], paths[host, path]
        h = (a * mean + hs - e) / (a + hn - 1)  # a document's own evidence is left out
        p = (b * h + ps - e) / (b + pn - 1)
        x = np.clip(e, 1e-6, 1 - 1e-6)
        odds = x / (1 - x) * p / (1 - p) * (1 - mean) / mean
        want = (h, p, odds / (1 + odds))
        assert np.allclose([got[i][c] for c in ("host_posterior", "path_posterior", "score")], want, rtol=1e-6)
