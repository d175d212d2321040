"""Classifiers, quality verdicts and the pipeline against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerframe.llm import knn_join, language_id, packing, quality, toxicity
from ledgerframe.llm.common import table
from tests.llm.conftest import CLASHING, prose
from tests.llm.test_text_operators import bag, brute_links, brute_repeats, brute_signals, fresh_tokenizer, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK = 2**32 - 1


# --- toxicity


def brute_toxicity(text, model):
    low = [ord(c) for c in (text or "").lower()]
    seen = Counter()
    for n in (3, 4, 5):
        for i in range(len(low) - n + 1):
            h = 0
            for c in low[i : i + n]:
                h = (h * 0x01000193 + c) & MASK
            x = ((h ^ (n * 0x1C6EF35F & MASK)) * 0x9E3779B1) & MASK
            seen[((x ^ x >> 15) * 0x85EBCA77 & MASK) >> 12] += 1
    weight = dict(zip(model.grams.tolist(), model.weights.tolist(), strict=True))
    total = model.intercept
    for gram, times in seen.items():
        total += weight.get(gram, 0.0)
        total += weight.get(gram + 2**20, 0.0) * (times >= 2 and times * 1000 >= len(low))
        total += weight.get(gram + 2**21, 0.0) * (times >= 3 and times * 500 >= len(low))
    return 1 / (1 + math.exp(-max(-50, min(50, total))))


def test_toxicity_scores_equal_brute_force(spark, sf_dir, documents):
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(documents, model).collect()}
    short = [r for r in documents.select("doc_id", "text").collect() if len(r["text"] or "") < 20_000]
    assert len(model.grams) > 100 and len(short) > 150
    assert all(abs(got[r["doc_id"]] - brute_toxicity(r["text"], model)) < 1e-4 for r in short)


def test_grams_are_scaled_by_log_count_ratios():
    texts = [np.array(x) for x in ([1, 2], [1, 2], [1, 3], [1, 4], [2, 4], [4], [4, 5], [4, 5], [3, 4])]
    toxic = np.array([1, 1, 1, 0, 0, 0, 0, 0, 0])
    model = toxicity.fit_linear(texts, toxic, 1 / 3)
    ratio = {g: math.log((sum(g in t for t, y in zip(texts, toxic, strict=True) if y) + 1) / 5) - math.log((sum(g in t for t, y in zip(texts, toxic, strict=True) if not y) + 1) / 8) for g in range(1, 6)}
    often = {g for g in ratio if sum(g in t for t in texts) >= toxicity.MIN_TEXTS and abs(ratio[g]) >= toxicity.MIN_RATIO}
    assert set(model.grams.tolist()) == often
    assert all(w == 0 or (w > 0) == (ratio[g] > 0) for g, w in zip(model.grams.tolist(), model.weights.tolist(), strict=True))


# --- languages


def brute_language(text, block):
    """Language, cosine and whether it is rejected, from the centroids of a model."""
    letters = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text or ""]
    n = sum(x > 0 for x in letters)
    if not n:
        return "und", 0.0, True
    padded, counts = [*letters, 0, 0], Counter()
    for i in range(len(letters)):
        if any(padded[i : i + 3]):
            h = 0
            for k in range(3):
                h = (h * 0x01000193 + padded[i + k]) & MASK
                x = ((h + k + 1) * 0x9E3779B1) & MASK
                counts[((x ^ x >> 13) * 0xC2B2AE35 & MASK) >> 19] += 1
    v = {s: math.log1p(c) * float(block.idf[s]) for s, c in counts.items()}
    length = math.sqrt(sum(x * x for x in v.values()))
    slots, values = np.array(list(v)), np.array(list(v.values())) / length
    cosine = block.centroids[:, slots] @ values
    best = int(cosine.argmax())
    language = int(block.of[best])
    return block.languages[language], float(cosine[best]), bool(cosine[best] < block.least[language, min(int(math.log2(n)), 11)])


def test_languages_equal_brute_force(documents, edges):
    model = language_id.learn(documents)
    (block,) = model.blocks()
    for docs in (documents, edges):
        texts = {(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 20_000}
        got = {(r["doc_id"], r["text"]): r for r in language_id._judged(docs, model, ["doc_id", "text"]).collect()}
        for key in texts:
            lang, score, rejected = brute_language(key[1], block)
            assert abs(got[key]["__lf_score"] - score) < 1e-4
            assert (got[key]["__lf_lang"], got[key]["__lf_rejected"]) == (lang, rejected)


# --- quality


def brute_cutoff(good, bad, risk, delta):
    """The cutoff of one rule from the levels of labelled rows, by exact tails."""

    def passes(lost):
        # the bound is below the risk if so few rejections are improbable at that risk
        return lost < len(good) and sum(math.comb(len(good), k) * risk**k * (1 - risk) ** (len(good) - k) for k in range(lost + 1)) <= delta

    cut, best = quality.LEVELS, 0.0
    for level in range(quality.LEVELS - 1, -1, -1):
        lost = sum(x > level for x in good)
        if not good or not passes(lost):
            break
        use = sum(x > level for x in bad) / max(1, len(bad)) - lost / len(good)
        if use > best + 1e-12:
            cut, best = level, use
    return cut


def test_verdicts_equal_brute_force(spark):
    kinds = {"symbols": lambda t: " ".join(w + "#" for w in t.split()), "capitals": str.upper, "marks": lambda t: t.replace(" ", "! "), "lines": lambda t: "\n".join([t] * 3)}
    rows, labels = [], []
    for i in range(2400):
        text, lang = prose(i, 40), ("en", "de", None)[i % 3]
        kind = list(kinds)[i % 4] if i % 10 == 0 else None
        rows.append((i, lang, kinds[kind](text) if kind else text + (" #" if i % 7 == 0 else "")))
        if i % 6 < 5:
            labels.append((i, 0 if kind and i % 20 == 0 else 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs, marks).collect()}
    label, names, levels, failed = dict(labels), list(quality.rules()), {}, {}
    for i, _, text in rows:
        n, chars, symbols, duplicates, repeated = brute_signals(text)
        n_lines = sum(bool(WORD.search(x)) for x in text.split("\n"))
        shares = {"symbols": symbols / n, "duplicate_lines": duplicates / n_lines, "repeated_words": repeated / n, "capitals": sum("A" <= c <= "Z" for c in text) / chars, "marks": sum(c in "!?" for c in text) / n}
        levels[i] = {k: math.ceil(min(x, 1.0) * quality.LEVELS) for k, x in shares.items()}
        failed[i] = n < 20 or 100 * repeated > 30 * n
    cuts = {}
    for lang in ("en", "de", None):
        held = [i for i, own, _ in rows if own == lang and i in label and not failed[i]]
        for k in names:
            cuts[lang, k] = brute_cutoff([levels[i][k] for i in held if label[i]], [levels[i][k] for i in held if not label[i]], quality.RISK / len(names), quality.DELTA / (len(names) * 3))
    assert any(c < quality.LEVELS for c in cuts.values())
    for i, lang, _ in rows:
        assert got[i]["kept"] == (not failed[i] and all(levels[i][k] <= cuts[lang, k] for k in names)), i


# --- special cases that several operators share


def test_clashing_columns_are_passed_over(clashing, edges, spark):
    labels = spark.createDataFrame([(5, 1, 0, "x"), (3, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")
    extra = clashing.withColumns({n: F.lit("x") for n in ("held_out", "predicted", "stratum", "n_words", "kept", "g", "start", "length", "ids_crc32", "offset", "cell", "label", "node")})
    for made in (lambda d: toxicity.toxicity_scores(d, toxicity.learn(d, labels)), lambda d: quality.quality_verdicts(d, labels), packing.pack):
        one, other = made(edges), made(extra)
        assert one.columns == other.columns
        assert Counter(map(tuple, one.drop("sequence_id", "offset").collect())) == Counter(map(tuple, other.drop("sequence_id", "offset").collect()))
    vectors = spark.createDataFrame([(i, [i, 2]) for i in range(20)], "vec_id long, v array<long>").withColumns({n: F.lit("x") for n in ("cell", "asks", "distance", "home", "g", "s", "score", "rank")})
    assert knn_join.knn_join(vectors, F.col("vec_id") == 1, 3).count() == 3
    assert len(CLASHING) > 0


def test_quality_of_empty_tables(no_docs, edges, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_verdicts(no_docs, none).count() == 0
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.quality_verdicts(edges, none).collect())


# --- pipeline


def brute_mix(rows):
    """(doc_id, source, text) rows, each as often as the mix takes it."""
    size = {i: len(WORD.findall(t)) for i, _, t in rows}
    total = defaultdict(int)
    for i, s, _ in rows:
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full} if full else share
        left -= sum(2 * total[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for s in order:
        digest = {i: hashlib.md5(str(i).encode()).hexdigest() for i, own, _ in rows if own == s}
        own = sorted(((math.floor(math.log(size[i] + 1) * 4), int(digest[i][:4], 16) % 64, size[i], digest[i], i, t) for i, x, t in rows if x == s))
        rate, u = target[s] / total[s] if total[s] else 0.0, int(hashlib.md5(("mix:" + ("" if s is None else "s" + s)).encode()).hexdigest()[:5], 16) / 2**20
        for k, (*_, i, t) in enumerate(own, start=1):
            out += [(i, t)] * (math.floor(k * rate + u) - math.floor((k - 1) * rate + u))
    return out


def brute_cut(rows):
    """rows (doc_id, source, text) without repeated words; a word goes with the space before it."""
    first, out = {}, []
    for i, s, t in sorted(rows):
        spans = [m.span() for m in WORD.finditer(t)]
        words, gone = [t[a:b] for a, b in spans], set()
        for k in range(len(words) - 19):
            if first.setdefault(tuple(words[k : k + 20]), (i, k)) != (i, k):
                gone.update(range(k, k + 20))
        text, at = "", 0
        for k, (_, b) in enumerate(spans):
            text, at = (text if k in gone else text + t[at:b]), b
        out.append((i, s, text + t[at:] if gone else t))
    return out


def test_pipeline_equals_plain_python(spark, sf_dir, documents):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in documents.collect()]
    (block,) = language_id.learn(documents).blocks()
    rows = [r for r in rows if not brute_language(r[2], block)[2]]
    kept = {c for (_, c, _), _ in brute_links([(i, t) for i, _, t in rows]).items()}
    rows = [r for r in rows if r[0] in kept or not shingles(r[2])]
    want = Counter()
    for i, text in brute_mix(brute_cut(rows)):
        ids = np.array([*fresh_tokenizer().encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        want.update((i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048))
    out = corpus_pipeline.run(spark, sf_dir)
    assert bag(out, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == want
    by = defaultdict(list)
    for r in out.collect():
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and sum(pieces[-1]) <= 2048


def test_the_two_plain_cuts_agree(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    cut = {i: len(WORD.findall(t)) for i, _, t in brute_cut([(i, "s", t) for i, t in rows])}
    assert all(cut[i] == n - gone for i, n, gone, _ in brute_repeats(rows, lambda r: r[0]))
