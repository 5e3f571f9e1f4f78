"""Rates of domains and suffixes for hosts without outcomes."""

from collections import Counter

import numpy as np

from epochal.llm import queries, urls


def test_hosts_without_outcomes_take_their_domain(spark):
    pages, labels, page = [], [], 0
    for domain in range(10):
        for host in range(5):
            for _ in range(10):
                pages.append((page, f"http://h{host}.d{domain}.net/{page}"))
                labels.append((page, domain % 2))
                page += 1
    pages += [(9001, "http://new.d1.net/"), (9002, "http://new.d2.net/"), (9003, "http://new.other.net/"), (9004, "http://new.other.zz/")]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), queries.URL_RULES).collect()}
    assert len(out) == len(pages)
    bad, good, other, none = (out[k] for k in (9001, 9002, 9003, 9004))
    assert bad.verdict == "block" and bad.bad_rate > 0.9 and bad.n_labelled == 0
    assert good.verdict == other.verdict == none.verdict == "allow"
    assert good.bad_rate < 0.1 and abs(other.bad_rate - 0.5) < 0.1 and none.bad_rate == 0.5
    assert bad.bad_bound > other.bad_bound


def test_rates_and_bounds_against_brute_force(spark):
    """Posterior means level by level in plain Python; below the bound lies a twentieth of the posterior."""
    rng = np.random.default_rng(3)
    pages, labels, page = [], [], 0
    for domain, suffix in (("a", "net"), ("b", "net"), ("c", "co.uk"), ("d", "org"), ("e", "org")):
        for host in range(6):
            for _ in range(int(rng.integers(1, 30))):
                pages.append((page, f"https://h{host}.{domain}.{suffix}/{page}"))
                labels.append((page, int(rng.random() < {"a": 0.9, "b": 0.2, "c": 0.5, "d": 0.05, "e": 0.7}[domain])))
                page += 1
    fresh = [(5000, "https://x.a.net/"), (5001, "https://q.net/"), (5002, "https://q.zz/"), (5003, "https://y.z.co.uk/")]
    out = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages + fresh, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), []).collect()}

    def added(keys):
        n, bad = Counter(), Counter()
        for (_, url), (_, y) in zip(pages, labels):
            k = keys(url.split("/")[2])
            n[k], bad[k] = n[k] + 1, bad[k] + y
        return n, bad

    suffix = lambda h: "co.uk" if h.endswith("co.uk") else h.rpartition(".")[2]
    domain = lambda h: h[: -len(suffix(h)) - 1].rpartition(".")[2] + "." + suffix(h)

    def strength(n, bad, mean):
        more = sum((bad[k] - n[k] * mean(k)) ** 2 - n[k] * mean(k) * (1 - mean(k)) for k in n)
        most = sum(n[k] * (n[k] - 1) * mean(k) * (1 - mean(k)) for k in n)
        return 1 / min(0.99, max(1e-3, more / most)) - 1

    root = (sum(y for _, y in labels) + 1) / (len(labels) + 2)
    n3, b3 = added(suffix)
    m3 = strength(n3, b3, lambda k: root)
    rate3 = {k: (b3[k] + m3 * root) / (n3[k] + m3) for k in n3}
    n2, b2 = added(domain)
    m2 = strength(n2, b2, lambda k: rate3[suffix(k)])
    rate2 = {k: (b2[k] + m2 * rate3[suffix(k)]) / (n2[k] + m2) for k in n2}
    n1, b1 = added(str)
    m1 = strength(n1, b1, lambda k: rate2[domain(k)])
    rate1 = {k: (b1[k] + m1 * rate2[domain(k)]) / (n1[k] + m1) for k in n1}
    for (p, url), _ in zip(pages, labels):
        h = url.split("/")[2]
        assert abs(out[p].bad_rate - rate1[h]) < 1e-9 and out[p].n_labelled == n1[h]
        a, b = rate1[h] * (n1[h] + m1), (1 - rate1[h]) * (n1[h] + m1)
        x = (np.arange(200_000) + 0.5) / 200_000
        density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        if a > 0.5 and b > 0.5:
            assert abs(density[x < out[p].bad_bound].sum() / density.sum() - 0.05) < 2e-3
        assert out[p].verdict == ("block" if out[p].bad_bound > 0.5 else "allow")
    assert abs(out[5000].bad_rate - rate2["a.net"]) < 1e-9 and abs(out[5001].bad_rate - rate3["net"]) < 1e-9
    assert abs(out[5002].bad_rate - root) < 1e-9 and abs(out[5003].bad_rate - rate3["co.uk"]) < 1e-9
    assert len({r.verdict for r in out.values()}) == 2
