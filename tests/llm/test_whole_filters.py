import math
import random
from collections import Counter

from cairn.llm import quality_lm, toxicity
from cairn.llm.common import Scratch


def code(i, letters):
    return "".join(letters[i // len(letters) ** k % len(letters)] for k in range(3))


def test_lexicon_keeps_every_term(spark):
    rng = random.Random(5)
    terms = [code(i, "bcdfghjklmnpqr") for i in range(2400)]
    clean = [code(i, "aeiouy") for i in range(200)]
    rows = []
    for i in range(12):
        words = terms[:]
        rng.shuffle(words)
        rows.append((i, " ".join(words), 1))
    rows += [(100 + i, " ".join(rng.sample(clean, 100)), 0) for i in range(60)]
    found = toxicity.learn_lexicon(spark.createDataFrame([r[1:] for r in rows], "text string, toxic int"), Scratch(spark, "t"))
    assert sorted(found) == sorted(terms) and not any(found.values())


def brute_logs(texts):
    """Interpolated Kneser-Ney log-probability of every trigram, from counts in dictionaries; discounts of small tables."""
    grams = Counter(g for t in texts for g in zip(*("\0\0" + t, "\0" + t, t)))
    pairs = Counter((b, c) for _, b, c in grams)
    ones = Counter(c for _, c in pairs)
    d = lambda n: {1: 0.5, 2: 0.75}.get(n, 0.9)

    def share(counts, key):
        same = [n for k, n in counts.items() if k[:-1] == key[:-1]]
        return ((counts[key] - d(counts[key])) / sum(same) if key in counts else 0.0, sum(map(d, same)) / sum(same)) if same else (0.0, 1.0)

    def log(g):
        low = (ones.get(g[2], 0) + 0.5) / (sum(ones.values()) + 0.5 * (len(ones) + 1))
        (h2, r2), (h3, r3) = share(pairs, g[1:]), share(grams, g)
        return math.log(h3 + r3 * (h2 + r2 * low))

    return log


def test_perplexity_tells_all_characters_apart(spark):
    letters = "".join(chr(0x4E00 + i) for i in range(200))
    trusted = [letters, letters[:100], "она пришла домой"]
    docs = [*trusted, letters[::-1], "йомод алширп", "zz", "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["perplexity"] for r in quality_lm.perplexity_filter(df, spark.createDataFrame([(i, 1) for i in range(3)], "doc_id long, quality int")).collect()}
    log = brute_logs(trusted)
    for i, t in enumerate(docs):
        if not t:
            assert got[i] is None
            continue
        want = math.exp(-sum(map(log, zip("\0\0" + t, "\0" + t, t))) / len(t))
        assert math.isclose(got[i], want, rel_tol=1e-6), (i, got[i], want)
    assert got[3] > 5 * got[0] and got[4] > 2 * got[2]


def test_empty_tables_and_clashing_columns(spark):
    """Each filter on no documents, on no labels, and with columns named as those that it makes."""
    from cairn.llm import quality_rules

    schema = "doc_id long, text string, lang string, score double, perplexity double, threshold double, words int, block long, g long, own double, kept boolean, features int, bin long"
    rows = [(i, t, g, *[None] * 10) for i, t, g in ((1, "abc abc", "x"), (2, None, None), (3, "", "y"), (3, "z", "y"), (None, "q r s", "x"))]
    docs, labels = spark.createDataFrame(rows, schema), spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for run in (quality_rules.quality_rules, quality_lm.perplexity_filter, toxicity.score_toxicity):
        assert run(docs, labels).count() == 5
        assert run(docs, labels.limit(0)).count() == 5
        assert run(docs.limit(0), labels).count() == 0
        assert run(docs.limit(0), labels.limit(0)).count() == 0
    for keep in (quality_rules.keep_good, toxicity.keep_clean):
        assert keep(docs.limit(0), labels).columns == docs.columns and keep(docs, labels).columns == docs.columns


def test_language_limits_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(float(round(math.exp(rng.gauss(1, 0.3)), 3)), "ab"[i % 2]) for i in range(2000)] + [(7.0, "c")] * 10
    df = spark.createDataFrame(rows, "perplexity double, lang string")
    found = [quality_lm._limits(df.repartition(n), 0.9) for n in (1, 3)]
    a, b = ({r["lang"]: r["own"] for r in own.collect()} for own, _ in found)
    assert a == b and found[0][1] == found[1][1]
    for lang in "abc":
        own = sorted(x for x, g in rows if g == lang)
        assert sum(x <= a[lang] for x in own) >= 0.9 * len(own) > sum(x <= a[lang] * math.exp(-2e-4) for x in own) or lang == "c"
