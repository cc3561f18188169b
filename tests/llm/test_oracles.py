"""Queries with SQL give DuckDB's rows, and models are held against brute force."""

import math

import duckdb
import pytest
import xxhash

from cairn.llm import quality_rules, queries, url_tree
from test_filters import brute_base

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, D)
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple(map(str, r))
    a, b = sorted(map(tuple, got.select(*columns).collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(a) == len(b) and not [(x, y) for x, y in zip(a, b) if x != y][:3]


def spark_hash(*words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64(w.encode(), seed=seed).intdigest()
    return seed - (1 << 64) * (seed >> 63)


def test_op4_score_and_verdict_against_brute_force(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    import re

    size = quality_rules.BUCKETS
    grams = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams[i] = [spark_hash(x) % size for x in w] + [spark_hash(x, y) % size for x, y in zip(w, w[1:])]
    raw, target = [1.0] * size, [1.0] * size
    for i, g in grams.items():
        for b in g:
            raw[b] += 1
            target[b] += labels.get(i) == 1
    weights = [round(math.log(t / sum(target)) - math.log(r / sum(raw)), 5) for r, t in zip(raw, target)]
    score = {i: sum(weights[b] for b in g) / len(g) if g else 0.0 for i, g in grams.items()}
    good, bad = ([math.floor(score[i] / quality_rules.BIN) for i in texts if labels.get(i) == q] for q in (1, 0))
    best, cut = -1.0, None
    for b in sorted({*good, *bad}):
        lost, caught = sum(x < b for x in good), sum(x < b for x in bad)
        if lost <= quality_rules.LOSS * len(good) and caught / len(bad) - lost / len(good) > best:
            best, cut = caught / len(bad) - lost / len(good), b * quality_rules.BIN
    got = queries.op4_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute_base(texts[r["doc_id"]])
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert abs(r["score"] - score[r["doc_id"]]) < 2e-5
        if abs(score[r["doc_id"]] - cut) > 1e-4:
            assert r["kept"] == (not failed and score[r["doc_id"]] >= cut)


def brute_tree(pages, prior=0.2, weight=2.0, many=24, z=1.96):
    """pages: (host, path, bad). Template, evidence and purity of each, by dictionaries."""
    import re
    from collections import defaultdict

    known = [b for _, _, b in pages if b is not None]
    parts = [[x for x in p.split("/") if x] for _, p, _ in pages]
    template, evidence = [""] * len(pages), [(sum(known) + weight * prior) / (len(known) + weight)] * len(pages)
    for level in range(max(map(len, parts), default=0)):
        at = [i for i, p in enumerate(parts) if len(p) > level]
        name = {i: "{n}" if re.fullmatch(r"[0-9]+(\.[A-Za-z]+)?", parts[i][level]) else parts[i][level] for i in at}
        node = defaultdict(lambda: [0, 0, 0])
        for i in at:
            c = node[pages[i][0], template[i], name[i]]
            c[0] += 1
            c[1] += pages[i][2] is not None
            c[2] += pages[i][2] or 0
        parent = defaultdict(list)
        for (h, t, p), c in node.items():
            parent[h, t].append((p, *c))
        over, up, grown = defaultdict(lambda: [0, 0]), {}, {}
        for (h, t, p), (n, lab, bads) in node.items():
            kin = parent[h, t]
            every, all_bads = sum(k[2] for k in kin), sum(k[3] for k in kin)
            plain = [k[1] for k in kin if k[0] != "{n}"]
            alike = None
            if lab:
                pooled = all_bads / every
                alike = abs(bads / lab - pooled) < z * math.sqrt(max(pooled * (1 - pooled) / lab, 1e-12))
            label = p
            if p != "{n}" and len(plain) >= many and sum(plain) ** 2 / sum(x * x for x in plain) >= len(plain) / 2 and alike is not False:
                label = "*"
            elif p != "{n}" and sum(k[2] > 0 for k in kin) > 1 and alike:
                label = "~"
            grown[h, t, p] = f"{t}/{label}"
            over[f"{t}/{label}"][0] += lab
            over[f"{t}/{label}"][1] += bads
        for i in at:
            up[grown[pages[i][0], template[i], name[i]]] = evidence[i]
        for i in at:
            template[i] = grown[pages[i][0], template[i], name[i]]
            lab, bads = over[template[i]]
            evidence[i] = (bads + weight * up[template[i]]) / (lab + weight)
    own = defaultdict(lambda: [0, 0])
    for (h, _, b), t in zip(pages, template):
        own[h, t][0] += b is not None
        own[h, t][1] += b or 0
    return [(t, (own[h, t][1] + weight * e) / (own[h, t][0] + weight)) for (h, _, _), t, e in zip(pages, template, evidence)]


@pytest.mark.parametrize("table", [True, False])
def test_op7_against_brute_force(spark, table):
    if table:
        pages = spark.read.parquet(f"{D}/pages.parquet").select("page_id", "url")
    else:
        import random

        rng = random.Random(4)
        deep = [f"http://{rng.choice('abc')}.{rng.choice(['net', 'example.net', 'example.com', 'org', 'xyz'])}/{rng.choice(['en', 'fr', 'de'])}/{rng.choice(['p', 'q'])}/{rng.choice(['x', f's{rng.randrange(40)}', str(rng.randrange(9))])}/{rng.choice(['', 'k/l/m', 'k/bad/m/n/o'])}" for _ in range(600)]
        pages = spark.createDataFrame(list(enumerate([*deep, None, "", "no host", deep[0]])), "page_id long, url string")
    ruled = {r["page_id"]: r for r in url_tree.apply_rules(pages.select("page_id", *(c.alias(n) for c, n in zip(url_tree.host_and_path(pages["url"]), ("host", "path")))), queries.URL_RULES).collect()}
    ids = sorted(ruled)
    want = dict(zip(ids, brute_tree([(ruled[i]["host"], ruled[i]["path"], {"block": 1, "allow": 0}.get(ruled[i]["ruled"])) for i in ids])))
    got = url_tree.judge_urls(pages, queries.URL_RULES).collect()
    assert len(got) == len(ids)
    for r in got:
        template, purity = want[r["page_id"]]
        assert r["template"] == template and abs(r["purity"] - purity) < 2e-6
        assert r["verdict"] == (ruled[r["page_id"]]["ruled"] or ("block" if purity >= 0.5 else "allow"))
    assert url_tree.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_repeated_values_generalise(spark):
    """Forty slugs seen ten times each are one wildcard; a slug that labels tell apart is not."""
    pages = spark.createDataFrame([(i, f"http://h.com/a/slug{i % 40}/x") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 40 == 7)) for i in range(400)], "page_id long, bad int")
    out = {r["page_id"]: r for r in url_tree.judge_urls(pages, [], labels).collect()}
    assert out[0]["template"] == "/a/*/x" and out[7]["template"] == "/a/slug7/x"
    assert [out[i]["verdict"] for i in (0, 7, 8, 47)] == ["allow", "block", "allow", "block"]
