import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import bpe, chat, packing, queries

SCHEMA = "doc_id long, text string, lang string"
ODD = ["", None, "a", " ", "it's  a\n\ntest  ", "x" * 3000, "ab " * 5000, "é ü 漢字 😀  x y", "İstanbul İ Σίσυφος ΣΑΣ", "a\x1cb \x00 c\x00d", "#*$%&|<> don't 12345", "́a é ́"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(3, "again", "en"), (3, "again", "en"), (None, "no id", "en")]
    return spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit("clash"))


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<s>", "<\\/s>", "a<\\\\/s>b</s>", "", None, "x\ny", "<", "</s", "[INST]</s><<SYS>>"]
    rows = [(c, t, r, x) for c, r0 in ((1, "assistant"), (2, "user"), (None, "a\nb\\n</s>")) for t, (r, x) in enumerate((r0 if i % 2 else "assistant", x) for i, x in enumerate(texts))]
    rows += [(4, 1, None, "b"), (4, None, "assistant", "a"), (4, 1, None, "b"), (5, 0, "assistant", "word " * 20000)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("end", F.lit(1)))
    out = {r["conv_id"]: r for r in out.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for conv, r in out.items():
        own = sorted(((t is not None, t or 0), role or "", x or "") for c, t, role, x in rows if c == conv)
        assert [(x.role, x.text) for x in r["turns"]] == [x[1:] for x in own]
        assert r["identical"] and r["loss"] == "".join(x[2] for x in own if x[1] == "assistant")
    plain = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(plain).first()["formatted"] == "<s>user\nhi</s><s>assistant\nyes</s>"
    assert chat.format_conversations(plain.limit(0)).count() == 0


def test_op1_against_python(spark, sf_dir):
    got = {r["conv_id"]: r for r in queries.op1_chat(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    assert set(got) == {r["conv_id"] for r in rows} | {-7}
    for conv in got:
        turns = [(r["turn"], r["role"], r["text"] or "") for r in rows if r["conv_id"] == conv] or [(i, x, "</s>[INST] ok [/INST]") for i, x in enumerate(("user", "assistant"))]
        turns.sort()
        loss = "".join(x[2] for x in turns if x[1] == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def _tiktoken():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(queries.tokenizer("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), public_tokenizers.PATTERN


def _same_as_tiktoken(rows, texts):
    enc, _ = _tiktoken()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        ids = enc.encode_ordinary(t)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_odd_texts(spark, odd):
    path = queries.tokenizer("byte_bpe_50k.tiktoken")
    out = bpe.encode_and_decode(odd, path, _tiktoken()[1], block=64).collect()
    texts = dict(enumerate(ODD)) | {None: "no id"}
    assert len(out) == len(ODD) + 3
    _same_as_tiktoken([r for r in out if r["doc_id"] != 3], texts)
    assert all(bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode() for r in out if r["doc_id"] != 3)
    assert bpe.encode_and_decode(odd.limit(0), path, _tiktoken()[1]).count() == 0


def test_long_words_merge_alike():
    enc, _ = _tiktoken()
    ranks = bpe.read_ranks(queries.tokenizer("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 500):
        word = bytes(rng.choice(list(b"abethinosr"), n))
        assert bpe.merge_long(word, ranks) == enc._encode_single_piece(word)


def test_expressions_fold_alike(spark):
    enc, _ = _tiktoken()
    words = [" the", "thwhstion", "é", "", "a", " 漢字😀", "aaaaaaaaaaaa", "ONHAONAN", "x" * 50]
    out = bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), queries.tokenizer("byte_bpe_50k.tiktoken"))
    assert {r["word"]: list(r["tokens"]) for r in out.collect()} == {w: enc._encode_single_piece(w.encode()) if w else [] for w in words}


def test_op9_against_tiktoken(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op9_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    _same_as_tiktoken(rows, texts)


def _pieces_are_whole(rows, docs):
    """docs: id lists by doc_id, one document for each."""
    from collections import defaultdict

    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for i, ids in docs.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    return len(by_sequence)


def test_op3_against_tokenizers(spark, sf_dir):
    tok = packing._tokenizer(queries.tokenizer("word_bpe_49k.json"))
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    docs = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    n = _pieces_are_whole(queries.op3_packing(spark, sf_dir).collect(), docs)
    assert n <= 1.05 * sum(map(len, docs.values())) / 4096 + 1


def test_word_encoder_is_the_library():
    path = queries.tokenizer("word_bpe_49k.json")
    tok, enc = packing._tokenizer(path), packing.WordEncoder(path)
    texts = [t or "" for t in ODD] + ["Don't we'LL 123.45 «Ça» ΟΔΟΣ\u0301 e\u0301É ﬁ ǅ K Å \u00a0x\u2003y z\u0345", "a" * 500 + " b" * 3, "\u0300x 👩‍👩‍👧 ﷺ ½ Ⅷ ٣"]
    for t in texts:
        chunks = enc.split(t)
        assert enc.encode(chunks)[0].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_every_code_point_is_encoded_as_the_library_does():
    path = queries.tokenizer("word_bpe_49k.json")
    tok, enc = packing._tokenizer(path), packing.WordEncoder(path)
    # All of the first 0x3400, of what lies between the large blocks of ideographs and syllables, and one in 61 of those blocks.
    blocks = ((0x3400, 0xA000), (0xAC00, 0xD7B0), (0xE000, 0xF900), (0x17000, 0x18D00), (0x20000, 0xE0000), (0xF0000, 0x110000))
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c % 61 == 0 or not any(a <= c < z for a, z in blocks))]
    for a in range(0, len(points), 1 << 15):
        some = [f"a{c}b {c} A{c}1" for c in points[a : a + (1 << 15)]]
        want = [x.ids for x in tok.encode_batch(some, add_special_tokens=False)]
        chunks = [enc.split(t) for t in some]
        ids, ends = enc.encode([c for cs in chunks for c in cs])
        at = 0
        for t, cs, w in zip(some, chunks, want):
            got = ids[ends[at] : ends[at + len(cs)]].tolist()
            at += len(cs)
            assert got == w, (hex(ord(t[1])), got, w)


def test_special_tokens_in_texts(spark):
    path = queries.tokenizer("word_bpe_49k.json")
    tok = packing._tokenizer(path)
    texts = ["a<|endoftext|>b", "<|startoftext|>", "A <|EndOfText|> b", "<|endoftext|", "x <|endoftext|> <|endoftext|>y\n"]
    out = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for r in out:
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]


def test_packing_odd_texts(spark, odd):
    path = queries.tokenizer("word_bpe_49k.json")
    tok = packing._tokenizer(path)
    out = packing.pack_documents(odd, path).collect()
    docs = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(ODD) if i != 3}
    docs[None] = [*tok.encode("no id", add_special_tokens=False).ids, 2]
    again = [r for r in out if r["doc_id"] == 3]
    assert len(again) == 3 and sorted(r["doc_tokens"] for r in again) == [1, 2, 2]
    rest = [r for r in out if r["doc_id"] != 3]
    for r in rest:
        assert bytes(r["ids"]) == np.array(docs[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in out)
    assert all(a[0] != b[0] and b[1] == 0 or a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:]))
    assert packing.pack_documents(odd.limit(0), path).count() == 0


def test_plan_holds_all_and_wastes_little():
    rng = np.random.default_rng(3)
    counts = {int(s): int(n) for s, n in zip(*np.unique(np.minimum(512, rng.lognormal(4, 1, 20000).astype(int) + 1), return_counts=True))}
    plan = packing.plan_patterns(counts, 512)
    used = {}
    for p, times in plan:
        assert sum(s * n for s, n in p.items()) <= 512
        for s, n in p.items():
            used[s] = used.get(s, 0) + n * times
    assert used == {s: n for s, n in counts.items() if n}
    assert sum(t for _, t in plan) <= 1.01 * sum(s * n for s, n in counts.items()) / 512 + 2
    assert packing.plan_patterns({}, 512) == [] and packing.plan_patterns({512: 7}, 512) == [({512: 1}, 7)]
