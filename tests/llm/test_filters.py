import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import quality_lm, quality_rules, queries, toxicity, url_tree, warc

LONG_TEXT = "word " * 30000


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    from collections import Counter

    trios = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(trios)
    covered = {i + k for i, t in enumerate(trios) if n[t] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_op4_base_against_brute_force(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    odd = ["", None, " \n\t ", "a", "a b c a b c a b c", "x\n\nx\nx \n", "#*$%&|<>", LONG_TEXT, "é\u00a0b c\x0bd"]
    rows = [(i, t) for i, t in texts.items()] + [(10**6 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality_rules.rule_statistics(df).drop("words").collect()}
    for i, t in rows:
        r, want = got[i], brute_base(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_op4_parts_labelled_documents(spark, sf_dir):
    path = sf_dir.replace("0.001", "0.01")
    got = queries.op4_quality_rules(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").toPandas()
    passed = got[~got.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.98 and passed[passed.quality == 0].kept.mean() < 0.1
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert quality_rules.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 3


def test_perplexity(spark, sf_dir):
    path = sf_dir.replace("0.001", "0.01")
    got = queries.op5_quality_classifier(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.95 and got[got.quality == 0].kept.mean() < 0.5
    docs = spark.createDataFrame([(1, "abab", "x"), (2, None, None), (3, "", "x"), (3, LONG_TEXT, "y"), (None, "q", "x")], "doc_id long, text string, lang string")
    none = quality_lm.perplexity_filter(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(none) == 5 and all(r["kept"] and r["perplexity"] is None for r in none)
    some = quality_lm.perplexity_filter(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert len(some) == 5 and all(r["perplexity"] is None and r["kept"] for r in some if not r["n_chars"])


def test_model_sums_to_one(spark):
    from cairn.llm.common import Scratch

    alphabet, logs = quality_lm.train(spark.createDataFrame([("the cat sat on the mat",), ("a hat",), (None,)], "text string"), Scratch(spark, "t"))
    p = np.exp(logs.reshape(quality_lm.SYMBOLS, quality_lm.SYMBOLS, -1).astype(float))
    assert len(alphabet) == 10 and np.allclose(p.sum(axis=2), 1, atol=1e-4)


def near_term(word, term):
    """Edit distance of at most one to a term; of its beginning, where it ends in `*`."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    if term.endswith("*"):
        return min(distance(word[:k], term[:-1]) for k in range(len(word) + 1))
    return distance(word, term)


def test_automaton_against_edit_distance():
    a = toxicity.Automaton({"idiot": True, "scum": False, "moron": True})
    assert [a.edits(w) for w in ("idiot", "idot", "idioot", "idxot", "xidiot", "idio", "scum", "scom", "ido", "")] == [0, 1, 1, 1, 1, 1, 0, None, None, None]
    rng = np.random.default_rng(5)
    word = lambda low: "".join(rng.choice(list("abc"), rng.integers(low, 8)))
    for _ in range(20):
        terms = {word(3) + ("*" if rng.random() < 0.3 else ""): bool(rng.random() < 0.7) for _ in range(6)}
        a = toxicity.Automaton(terms)
        for w in [word(0) for _ in range(200)]:
            far = [(near_term(w, t), takes or t.removesuffix("*") in {x.removesuffix("*") for x in terms if terms[x]}) for t, takes in terms.items()]
            want = 0 if any(d == 0 for d, _ in far) else 1 if any(d == 1 and takes for d, takes in far) else None
            assert a.edits(w) == want, (terms, w)


def test_misspelled_and_quoted_terms(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("bdfgklmnprst"), 1)) + w for w in ("aller", "ondin", "erwick", "ostle", "umber", "inquet") for _ in range(12)]
    text = lambda *more: " ".join(rng.permutation([*rng.choice(vocabulary, 60), *more]))
    docs = [(i, text(*(["idiot", "moron", "clown"][: 1 + i % 3] if i % 2 else ()))) for i in range(400)]
    asked = [text("idiot"), text("idiott"), text("mroon", "idjot"), text(), 'he said "you idiot" to us ' + text(), "you idiot " + text()]
    rows = spark.createDataFrame(docs + [(1000 + i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(rows, labels).collect()}
    assert [got[1000 + i]["predicted"] for i in range(4)] == [1, 1, 1, 0]
    assert [got[1000 + i][k] for i, k in ((0, "exact"), (1, "edited"), (2, "edited"), (4, "quoted"), (5, "exact"))] == [1, 1, 1, 1, 1]
    assert got[1004]["predicted"] == 0 and got[1005]["predicted"] == 1 and got[1004]["score"] < got[1005]["score"]


def test_op8_held_out(spark, sf_dir):
    path = sf_dir.replace("0.001", "0.1")
    got = queries.op8_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert got.score.between(0, 1).all() and ((got.toxic == 1) == (got.predicted == 1)).mean() > 0.97
    docs = spark.createDataFrame([(1, "", 1), (2, None, 1), (2, "x", 1), (None, LONG_TEXT, 1)], "doc_id long, text string, score int")
    out = toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(out) == 4 and all(r["score"] == 0.0 and r["predicted"] == 0 for r in out)


def test_urls(spark):
    urls = ["HTTP://A.Example.NET/en/x?y", "http://net/", "http://net", "https://b.example.com/de/1#f", "x://y.org/fr/", "no host", None, "", "://h/p", "http://xnet/a", "http://q.example.com/de", "a://b://c/d"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("template", F.lit(1))
    rows = url_tree.judge_urls(df, queries.URL_RULES).collect()
    assert len(rows) == len(urls) + 1
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in rows}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/") and got[1] == ("net", "/", "net/") and got[2] == ("net", "", None)
    assert got[3] == ("b.example.com", "/de/1", "example.com/de/") and got[4] == ("y.org", "/fr/", "org/fr/")
    assert got[5] == got[6] == got[7] == ("", "", None) and got[8] == ("h", "/p", None) and got[9][2] is None and got[10][2] is None and got[11] == ("b:", "//c/d", None)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "page_id long, bad int")
    pages = spark.createDataFrame([(i, f"http://h.com/{'bad' if i % 2 else 'good'}/{i}/x") for i in range(60)], "page_id long, url string")
    out = {r["page_id"]: r for r in url_tree.judge_urls(pages, [], labels).collect()}
    assert all((out[i]["verdict"] == "block") == bool(i % 2) for i in range(60)) and out[1]["template"] == "/bad/{n}/x"


def test_archives(spark, sf_dir):
    import base64
    import hashlib

    rows = [(5, "http://a b/", "x"), (2, None, "x"), (3, "u", ""), (1, "u", None), (9, "u", "é\r\n\r\nWARC/1.0\r\n"), (9, "u", "é\r\n\r\nWARC/1.0\r\n"), (None, "u", "x"), (7, "u", "z" * 300000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("head", F.lit(1))
    out = warc.archive_pages(df).collect()
    assert len(out) == len(rows) and all(r["block_intact"] for r in out)
    for i, _, html in rows:
        raw = (html or "").encode()
        got = next(r for r in out if r["page_id"] == i and r["payload_bytes"] == len(raw))
        assert got["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in out} == {(5, "revisit", 2), (2, "response", None), (3, "revisit", 1), (1, "response", None), (9, "response", None), (None, "response", None), (7, "response", None)}
    assert warc.archive_pages(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.arc_file([("u", "1.1.1.1", "20000101000000", "t", b"abc")], 1)[:-3]))
