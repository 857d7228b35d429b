import random
import re
from collections import defaultdict

from lexiforge.llm import url_templates as ut


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    i = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[i:]
    j = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:i]), path[:j]


def brute_rule(host, path):
    fit = [r for r in ut.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.host + r.path), default=None)


URLS = [None, "", "no scheme", "http://", "http://A.NET", "http://a.net/", "https://x.Example.NET/en/1?q=/", "https://example.net/en", "ftp://notexample.net/en/2",
        "http://example.com/de/x", "http://org/fr/", "http://q.org/fr/3#a", "http://É.org/FR/", "a://b://c.net/d", "http://h?x/y", "http://h#/y", "http://h/p\nq?r", "http://xnet/"]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, None, "own") for i, u in enumerate(URLS)] + [(0, None, 1, "own")], "page_id long, url string, good int, host string")
    out = ut.filter_urls(df).collect()
    assert len(out) == len(URLS) + 1
    for r in out:
        host, path = brute_split(URLS[r.page_id])
        rule = brute_rule(host, path)
        assert (r.host, r.path) == (host, path) and r.rule == (rule.host + rule.path if rule else None)
        assert r.verdict == (rule.verdict if rule else r.verdict) and r.verdict in ("allow", "block")
    assert ut.filter_urls(df.limit(0)).count() == 0


def brute_templates(rows, s):
    """Level by level on plain dictionaries: (host, path segments) -> template."""
    seg = {}
    for host, path, good in rows:
        parts = [p for p in path.split("/") if p]
        seg.setdefault((host, tuple(parts if len(parts) < s.depth else [*parts[: s.depth - 1], "/".join(parts[s.depth - 1 :])])), []).append(good)
    tpl = {k: "" for k in seg}
    kind = lambda x: "end" if x is None else "variable" if re.match(ut.VARIABLE, x) else "word"
    for d in range(max((len(k[1]) for k in seg), default=0)):
        child = defaultdict(lambda: {"n": 0, "l": 0, "g": 0, "end": 0, "variable": 0, "word": 0})
        for (h, p), goods in seg.items():
            if len(p) > d:
                c = child[h, tpl[h, p], p[d]]
                c["n"] += len(goods)
                c["l"] += sum(g is not None for g in goods)
                c["g"] += sum(g or 0 for g in goods)
                c[kind(p[d + 1] if len(p) > d + 1 else None)] += len(goods)
        new = {}
        for (h, p) in seg:
            if len(p) <= d:
                continue
            sib = [c for (a, b, x), c in child.items() if (a, b) == (h, tpl[h, p]) and kind(x) == "word"]
            c, total = child[h, tpl[h, p], p[d]], lambda k: sum(x[k] for x in sib)
            name = p[d]
            if kind(name) == "variable":
                name = "{n}"
            elif len(sib) >= s.children and max(x["n"] for x in sib) <= s.share * total("n"):
                name = "{*}"
            elif len(sib) > 1:
                off = sum(abs(c[k] / c["n"] - total(k) / total("n")) for k in ("end", "variable", "word")) / 2
                a, b = (c["g"] + 0.5) / (c["l"] + 1), (total("g") + 0.5) / (total("l") + 1)
                z = abs(a - b) / (b * (1 - b) * (1 / (c["l"] + 1) + 1 / (total("l") + 1))) ** 0.5
                name = "{=}" if off <= s.spread and z <= s.z else name
            new[h, p] = tpl[h, p] + "/" + name
        tpl.update(new)
    return seg, tpl


def test_templates_equal_brute_force(spark):
    rng, s = random.Random(1), ut.Settings(depth=4)
    rows = []
    for i in range(1500):
        host = rng.choice(["one.test", "one.test", "two.test", "tags.test"])
        if host == "tags.test":
            path, good = f"/tag/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}x", 1
        else:
            part = rng.choice(["blog", "news", "spam", "about"])
            path = "/about" if part == "about" else f"/{part}/{rng.randint(1, 99999)}" + rng.choice(["", ".html", "/a/b/c/d"])
            good = int(rng.random() < (0.05 if part == "spam" else 0.9))
        rows.append((host, path, good if rng.random() < 0.6 else None))
    seg, tpl = brute_templates(rows, s)
    df = spark.createDataFrame([(i, f"http://{h}{p}?x", g) for i, (h, p, g) in enumerate(rows)], "page_id long, url string, good int")
    out = {r.page_id: r for r in ut.filter_urls(df, s=s).collect()}
    sums, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (h, p), goods in seg.items():
        for to in (sums[h, tpl[h, p]], hosts[h]):
            to[0] += sum(g is not None for g in goods)
            to[1] += sum(g or 0 for g in goods)
    prior = (sum(g for _, g in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 1)
    for i, (h, path, _) in enumerate(rows):
        parts = [p for p in path.split("/") if p]
        k = (h, tuple(parts if len(parts) < s.depth else [*parts[: s.depth - 1], "/".join(parts[s.depth - 1 :])]))
        base = (hosts[h][1] + s.alpha * prior) / (hosts[h][0] + s.alpha)
        purity = min(1.0, (sums[h, tpl[k]][1] + s.alpha * base) / (sums[h, tpl[k]][0] + s.alpha))
        assert out[i].template == tpl[k] and abs(out[i].purity - purity) < 1e-9 and out[i].verdict == ("allow" if purity >= 0.5 else "block")
    assert {r.template for r in out.values() if r.host == "tags.test"} == {"/tag/{*}"}
    assert {r.verdict for r in out.values() if r.path.startswith("/spam")} == {"block"} and {r.verdict for r in out.values() if r.path.startswith("/news")} == {"allow"}
