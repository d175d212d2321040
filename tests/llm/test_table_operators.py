"""Search, mixing, chats, licences and the pipeline."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerframe.llm import chat, knn_join, license_scan, mixing
from ledgerframe.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import CLASHING


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


# --- top-k


def brute_top(rows, k, asks):
    out = Counter()
    for q, a in rows:
        if asks(q):
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q))[:k]  # noqa: B905
            out.update((q, rank, i, -s) for rank, (s, i) in enumerate(scored, start=1))
    return out


def test_top_k_in_special_cases(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    vectors += [(200 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]  # one very common vector
    vectors += [(300, [1.0, 2.0]), (301, [1e6] * 6)]
    odd = [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (None, [1.0] * 6)]
    monkeypatch.setattr(knn_join, "QUERY_GROUP", 8)
    monkeypatch.setattr(knn_join, "SLICE_COMPONENTS", 300)
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").select("vec_id", knn_join.quantise(F.col("embedding")).alias("v"))
    got = Counter(tuple(r) for r in knn_join.knn_join(df, F.col("vec_id") % 5 == 0, 10).collect())
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors]
    assert got == brute_top(whole, 10, lambda i: i % 5 == 0)
    assert knn_join.knn_join(df.limit(0), F.lit(True)).count() == 0
    assert knn_join.knn_join(df, F.lit(False)).count() == 0


def clusters(seed, n, n_clusters, width=8, apart=3000, spread=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, width))
    centres *= apart / np.linalg.norm(centres, axis=1, keepdims=True)  # as embeddings are
    return [(i, (centres[rng.integers(n_clusters)] + rng.normal(size=width) * spread).astype(int).tolist()) for i in range(n)]


def test_far_cells_are_not_replicated(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "QUERY_GROUP", 8)
    monkeypatch.setattr(knn_join, "SLICE_COMPONENTS", 400)
    rows = clusters(2, 3000, 20)
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    is_query = F.col("vec_id") % 20 == 0
    dealt = knn_join.deal(df, is_query, 5)
    groups, slices = (dealt.queries.select(c).distinct().count() for c in ("g", "s"))
    n_slices = -(-3000 // 50)
    assert groups >= 15 and slices >= n_slices / 2
    assert dealt.data.count() < 0.35 * groups * 3000  # sent to the groups that need them
    assert dealt.queries.count() < 0.35 * 150 * n_slices  # and queries to the slices they need
    got = Counter(tuple(r) for r in knn_join.knn_join(df, is_query, 5).collect())
    assert got == brute_top(rows, 5, lambda i: i % 20 == 0)


def test_bounds_are_exact_for_norms_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "SLICE_COMPONENTS", 200)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 10 ** rng.uniform(0, 7)).astype(int).tolist()) for i in range(500)] + [(1000 + i, [3, 4, 0, 0]) for i in range(60)] + [(2000 + i, [0] * 4) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = Counter(tuple(r) for r in knn_join.knn_join(df, F.col("vec_id") % 10 == 0, 10).collect())
    assert got == brute_top(rows, 10, lambda i: i % 10 == 0)


def test_top_k_passes_over_other_columns(spark):
    df = spark.createDataFrame([(i, [i, 1], 5, 6, 7) for i in range(30)], "vec_id long, v array<long>, g int, s int, cell int")
    got = Counter(tuple(r) for r in knn_join.knn_join(df, F.col("vec_id") == 3, 4).collect())
    assert got == brute_top([(i, [i, 1]) for i in range(30)], 4, lambda i: i == 3)


# --- mixing


def test_targets_and_taken_words(edges, spark):
    rows = [(i, f"s{i % 4}" if i % 9 else None, (i * 37) % 200) for i in range(4000)]
    mixed = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in mixed:
        sizes[r["source"]] += r["size"]
        targets[r["source"]] = r["target"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [3, 1, 2, 3, 1], strict=True))
    want, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while True:  # reshare the excess until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            want |= share
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    assert all(abs(targets[s] - want[s]) < 1e-6 * max(1, want[s]) for s in order)
    assert all(abs(taken[s] - targets[s]) <= 0.02 * targets[s] + 400 for s in order)


def test_mixing_in_special_cases(edges, clashing, no_docs):
    out = mixing.mixed_documents(clashing)
    assert out.columns == clashing.columns
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, mixing.mixed_documents(clashing.repartition(7)).collect()))
    assert mixing.mixed_documents(no_docs).count() == 0
    rows = edges.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.lit(1).alias("target"))
    assert mixing.mix_sources(rows).count() == edges.count()


def test_sources_without_words(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (None, None, 0)], "doc_id long, source string, size long")
    assert all(r["copies"] == 0 and r["target"] == 0 for r in mixing.mix_sources(rows).collect())


# --- chats


def test_chats_read_back_exactly(spark):
    texts = [r"\### Assistant: </turn> ok", "", None, "<next>\\n\\l\\b#h", "a\n### user:\nb</turn>\n", "日本😀<", "\\", "\\b"]
    roles = ["user", "assistant", "assistant", "user", None, "a:\n#<", "assistant", "assistant"]
    rows = [(1, 9 - i, r, t) for i, (r, t) in enumerate(zip(roles, texts, strict=True))]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (2, 1, "assistant", "z"), (2, 1, "assistant", "z"), (2, 1, "assistant", "b")]
    rows += [(3, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.chat_digest(turns).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by = defaultdict(list)
    for c, n, role, text in rows:
        by[c].append(((n is not None, n or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, listed in by.items():
        listed.sort()
        loss = "".join(t for _, r, t in listed if r == "assistant")
        assert got[c]["n_turns"] == len(listed)
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, r, t in listed))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    assert chat.chat_digest(turns.limit(0)).count() == 0


def test_same_role_turns_are_merged(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    row = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert row["formatted"] == "### user:\na<next>b</turn>\n### assistant:\nc</turn>\n"
    assert [row["formatted"].encode()[m["start"] : m["start"] + m["length"]] for m in row["mask"]] == [b"c"]


def test_ties_are_ordered_before_escaping_and_the_mask_fits(spark, monkeypatch):
    texts = ["<b", "=a", "#x", "\\y", "!z", "日本", "", "a#<\\"]
    rows = [(1, 5, role, text) for text in texts for role in ("assistant", "user", "a<", "a=")] + [(1, None, "#r", "é"), (2, 0, "user", "no mask")]
    monkeypatch.setattr(chat, "CHUNK_TURNS", 4)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    listed = [("#r", "é"), *sorted((r, t) for c, n, r, t in rows if n == 5)]
    row = chat.format_chats(turns).filter("conv_id = 1").select("formatted", "mask", chat.parse_chat(F.col("formatted")).alias("turns")).first()
    assert [(x["role"], x["text"]) for x in row["turns"]] == listed
    spans = [row["formatted"].encode()[m["start"] : m["start"] + m["length"]].decode() for m in row["mask"]]
    assert [s.replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\") for s in spans] == [t for r, t in listed if r == "assistant"]
    digest = {r["conv_id"]: r for r in chat.chat_digest(turns).collect()}
    loss = "".join(t for r, t in listed if r == "assistant")
    assert digest[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in listed).encode()).hexdigest()
    assert (digest[1]["loss_chars"], digest[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (digest[2]["loss_chars"], digest[2]["loss_sha256"]) == (0, hashlib.sha256(b"").hexdigest())


# --- licences


def brute_scan(files):
    import math
    import re

    sets = []
    for least, given in ((1, license_scan.TEMPLATES), (0, license_scan.full_texts())):
        bags = [(name, Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", t.lower()))) for name, texts in given.items() for t in texts]
        seen = Counter(w for _, bag in bags for w in bag)
        idf = {w: math.log((len(bags) + 1) / (n + 1)) + least for w, n in seen.items()}
        sets.append((bags, idf, math.log(len(bags) + 1) + least))

    def closest(text):
        words, found = Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())), []
        for bags, idf, unseen in sets:
            x = {w: n * idf.get(w, unseen) for w, n in words.items()}
            length = math.sqrt(sum(v * v for v in x.values()))
            for name, bag in bags:
                unit = math.sqrt(sum((n * idf[w]) ** 2 for w, n in bag.items()))
                if length:
                    found.append((-round(sum(v * bag[w] * idf[w] for w, v in x.items() if w in bag) / unit / length, 9), name))
        return min(((s, n) for s, n in found if -s >= license_scan.THRESHOLD), default=None)

    def notices(text):
        """Cue lines, and blocks of them, with their rank where equal: blocks first."""
        lines = text.split("\n")
        at = [i for i, line in enumerate(lines) if re.search(license_scan.CUE, line)]
        blocks, start = [], 0
        for k in range(1, len(at) + 1):
            if k == len(at) or at[k] - at[k - 1] > license_scan.BLOCK_GAP:
                if at[k - 1] > at[start]:
                    blocks.append("\n".join(lines[at[start] : at[k - 1] + 1]))
                start = k
        return [(-2 - n, b) for n, b in enumerate(blocks)] + [(n, lines[i]) for n, i in enumerate(at)]

    own, speaks = {}, {}
    for path, text in files:
        if not text or not re.search(license_scan.CUE, text):
            continue
        whole = closest(text)
        lines = [(c[0], i, c[1]) for i, part in notices(text) if (c := closest(part))]
        if whole:
            own[path, text] = (whole[1], -whole[0], "file")
            if path is not None:
                d = path.rpartition("/")[0]
                speaks[d] = min(speaks.get(d, (0, "", "")), (whole[0], whole[1], path))
        elif lines:
            own[path, text] = (min(lines)[2], -min(lines)[0], "header")
    out = Counter()
    for path, text in files:
        if (path, text) in own:
            out[(path, *own[path, text], None)] += 1
            continue
        d = None if path is None else path.rpartition("/")[0]
        while d is not None and d not in speaks:
            d = d.rpartition("/")[0] if d else None
        out[(path, speaks[d][1], -speaks[d][0], "inherited", d) if d is not None else (path, None, None, "none", None)] += 1
    return out


SCAN = ("path", "license", "similarity", "origin", "license_dir")


def scanned(df):
    return Counter(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in SCAN) for r in license_scan.scan_licenses(df).collect())


def rounded(found):
    return Counter({tuple(round(x, 6) if isinstance(x, float) else x for x in k): n for k, n in found.items()})


def test_scan_equals_brute_force(spark, documents):
    files = license_scan.document_paths(documents)
    rows = [(r["path"], r["text"]) for r in files.collect()]
    assert scanned(files) == rounded(brute_scan(rows))


def test_scan_in_special_cases(spark):
    mit, gpl = "Released under the MIT License.", license_scan.TEMPLATES["GPL-3.0"][0]
    rows = [("a/LICENSE", mit), ("a/b/x", "hello"), ("a/b/c/y", "foo\nLicensed under CC BY-NC 4.0.\n" + "bar " * 200), ("d/z", None), ("a/b/LICENSE", gpl), ("a/b/COPYING", mit), ("a/b/c/q", ""), (None, "x"), (None, mit), ("a/b/x", "hello"), ("top", "x"), ("e/f/g/h", "a license of no kind")]
    df = spark.createDataFrame(rows, "path string, text string").withColumns({"own": F.lit(1), "license": F.lit(2), "id": F.lit(3)})
    assert scanned(df) == rounded(brute_scan(rows))
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_full_texts_and_header_blocks_are_licences(spark):
    texts = license_scan.full_texts()
    full = {name: max(found, key=len) for name, found in texts.items()}
    rows = [(f"{name}/LICENSE", text) for name, text in full.items()] + [(f"{name}/src/x.py", "x = 1") for name in full]
    header = "".join(f" * {line}\n" for line in texts["Apache-2.0"][0].split("\n"))
    code = "\n".join(f"value{i} = compute{i}(other{i})" for i in range(400))
    rows += [("n/NOTICE", "Released under the MIT License.\n" * 70), ("n/y", "y"), ("o/a.c", f"/*\n{header} */\n{code}"), ("o/b.c", code + "\n# no licence at all")]
    got = {r["path"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    for name in full:
        assert (got[f"{name}/LICENSE"]["license"], got[f"{name}/LICENSE"]["origin"]) == (name, "file")
        assert (got[f"{name}/src/x.py"]["license"], got[f"{name}/src/x.py"]["license_dir"]) == (name, name)
    assert (got["n/NOTICE"]["license"], got["n/NOTICE"]["origin"], got["n/y"]["origin"]) == ("MIT", "file", "inherited")
    assert (got["o/a.c"]["license"], got["o/a.c"]["origin"], got["o/b.c"]["origin"]) == ("Apache-2.0", "header", "none")
    assert got["o/a.c"]["similarity"] > 0.9


# --- pipeline


def test_pipeline_stages(spark, sf_dir, documents):
    docs, names = documents, documents.columns
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == names
        docs = corpus_pipeline.settle(out)
        counts.append(docs.count())
    assert counts[0] >= 0.99 * documents.count() and counts[1] < counts[0] and counts[2] == counts[1]
    assert set(docs.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_pipeline_on_edges(spark, clashing, no_docs, sf_dir):
    for start in (clashing, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.settle(stage(spark, docs, sf_dir))
        assert docs.count() >= 0
    assert len(CLASHING) > 0


def test_pipeline_reruns_agree(spark, sf_dir):
    first, second = (Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) for _ in range(2))
    assert first == second
