import random

import pytest

from lexiforge.llm import warc_revisit as wr

SCHEMA = "record_id long, url string, ts long, kind string, headers map<string,string>, digest string, curl string"


def brute(records):
    def canon(u):
        import re

        u = re.split(r"[?#]", u)[0]
        u = re.sub(r"^[^/]*?://", "", u)
        host, _, path = u.partition("/")
        return re.sub(r"^(www|m)\.|:(80|443)$", "", host.lower()) + re.sub(r"(\.html)?/*\Z", "", "/" + path if _ else "")

    out = []
    for i, u, ts, kind, h, _, _ in records:
        if kind != "revisit":
            continue
        h = h or {}
        if u is None or ts is None:
            out.append((i, None if u is None else canon(u), None, "no_url", h))
            continue
        earlier = [r for r in records if r[3] == "response" and r[1] is not None and r[2] is not None and canon(r[1]) == canon(u) and r[2] < ts]
        if not earlier:
            out.append((i, canon(u), None, "no_response", h))
            continue
        r = max(earlier, key=lambda r: (r[2], r[0]))
        rh = r[4] or {}
        tag = lambda x: x.removeprefix("W/")
        if "etag" in h and "etag" in rh:
            ok = tag(h["etag"]) == tag(rh["etag"])
        else:
            ok = "last-modified" in h and h.get("last-modified") == rh.get("last-modified")
        if ok:
            out.append((i, canon(u), r[0], "resolved", {**rh, **{k: v for k, v in h.items() if k in wr.PERMITTED}}))
        else:
            out.append((i, canon(u), None, "validator_mismatch", h))
    return out


@pytest.mark.parametrize("slot", [wr.SLOT, 10])
def test_equals_brute_force(spark, slot):
    """A url with most records, over many slots, and all edge values."""
    rng = random.Random(1)
    urls = ["http://a.test/x", "https://www.A.test:443/x.html?q", "http://m.a.test/x/#f", "http://b.test", "http://b.test/", "http://c.test/y", None]
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit"])
        h = {k: rng.choice(["1", "W/1", "2"]) for k in rng.sample(["etag", "last-modified", "content-type", "date", "vary", "content-length"], rng.randint(0, 5))}
        rows.append((i, rng.choice(urls[:3] * 3 + urls), rng.choice([None] + [rng.randint(-50, 300)] * 9), kind, rng.choice([h, h, h, None]), f"d{i}" if kind == "response" else None, "own"))
    got = sorted((r.record_id, r.canonical_url, r.response_id, r.outcome, r.headers) for r in wr.resolve(spark.createDataFrame(rows, SCHEMA), slot).collect())
    assert [g[0] for g in got] == sorted(b[0] for b in brute(rows))
    for g, b in zip(got, sorted(brute(rows), key=lambda b: b[0])):
        assert tuple(g) == b


def test_edge_rows(spark):
    rows = [(1, "http://a/", 5, "response", {"etag": "x"}, "d", ""), (2, "http://a", 5, "revisit", {"etag": "x"}, None, ""), (3, "http://a", 6, "revisit", {"etag": "x"}, None, "")] * 2
    out = sorted((r.record_id, r.outcome, r.digest) for r in wr.resolve(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(2, "no_response", None)] * 2 + [(3, "resolved", "d")] * 2
    assert wr.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
    assert wr.records_of_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
