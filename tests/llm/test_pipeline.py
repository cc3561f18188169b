import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_dedup import brute_documents
from test_filters import brute_base

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def brute_pieces(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, text in texts.items():
        whole = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for a in range(0, len(whole), 4096):
            part = np.array(whole[a : a + 4096], "<u4")
            want.add((i, a, len(part), zlib.crc32(part.tobytes()), len(whole)))
    return want


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        texts = dict(docs.select("doc_id", "text").collect())
        out = stage(spark, docs, sf_dir)
        assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept = ids(docs)
        assert kept <= set(texts) and docs.count() == len(kept)
        if name == "quality_rules":
            failed = {i for i, t in texts.items() if (n := brute_base(t))[0] < 50 or 100 * n[4] > 50 * n[0]}
            assert failed and not failed & kept
            clean = [i for i in set(texts) - failed if i in labels and labels[i]["quality"] == 1]
            assert sum(i in kept for i in clean) >= 0.95 * len(clean)
        elif name == "toxicity":
            clean = [i for i in texts if i in labels and labels[i]["toxic"] == 0]
            assert sum(i in kept for i in clean) >= 0.95 * len(clean)
        else:
            _, component = brute_documents(texts)
            assert kept == set(component.values())
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    found = defaultdict(list)
    for r in pieces:
        found[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces} == brute_pieces(dict(docs.select("doc_id", "text").collect()))
    assert len(pieces) == len({(r["doc_id"], r["start"]) for r in pieces})
    for held in found.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held[:-1])]).tolist()
        assert sum(n for _, n in held) <= 4096


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, repeated and empty rows, columns of clashing names, an empty table: each row goes by its own verdict."""
    good = " ".join(f"word{i}x" for i in range(60))
    copy = good + " end"
    other = " ".join(f"other{i}y" for i in range(70))
    rows = [(1, good, "x"), (1, "bad", "x"), (None, "bad", "y"), (None, other, "y"), (2, copy, "z"), (3, None, "z"), (4, "", "z"), (4, other, "z"), (4, other, "z"), (5, "word " * 20000, "z")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, 2.0, True) for i, t, s in rows], "doc_id long, text string, lang string, source string, words int, score double, kept boolean")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r["doc_id"] or 0, r["text"] or "", r["source"]) for r in df.collect())
    from cairn.llm import quality_rules

    plain = quality_rules.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert plain.filter("kept").count() == 5
    kept = quality_rules.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert kept.columns == docs.columns and texts(kept) == sorted([(1, good, "x"), (0, other, "y"), (2, copy, "z"), (4, other, "z"), (4, other, "z")])
    assert stages["quality_rules"](spark, docs, str(tmp_path)).columns == docs.columns
    clean = stages["toxicity"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert texts(clean) == texts(docs)
    one = stages["near_duplicates"](spark, kept, str(tmp_path))
    assert one.columns == docs.columns and sorted(t for _, t, _ in texts(one)) in ([other, copy], [other, good])
    unique = docs.filter("doc_id in (1, 2) and text != 'bad'")
    assert texts(stages["near_duplicates"](spark, unique, str(tmp_path))) == [(1, good, "x")]
    whole = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert whole.filter("text is null or text = ''").count() == 2 and whole.filter("text = 'bad'").count() == 1
    assert stages["packing"](spark, docs, str(tmp_path)).agg({"doc_tokens": "min"}).first()[0] == 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
