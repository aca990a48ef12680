import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofline.llm import minhash
from proofline.llm.components import components
from proofline.llm.embedding_dedup import embedding_dedup
from proofline.llm.exact_dedup import exact_dedup, hash128
from proofline.llm.line_dedup import drop_bitmaps, line_dedup
from proofline.llm.minhash import inverse_frequencies, near_dedup, shingles, similar


@pytest.mark.parametrize("key", [hash128, lambda t: F.length(t).cast("string").cast("binary")])  # the second makes different texts collide
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup_on_messy_rows(messy, key, keep):
    rows = [(r.doc_id, r.text or "") for r in messy.collect()]
    out = exact_dedup(messy, keep=keep, key=key).collect()
    assert Counter((r.doc_id, r.text_sha256) for r in out) == Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    groups = Counter(hashlib.sha256(t.encode()).hexdigest() for _, t in rows)
    best = {}
    for i, t in rows:
        if i is not None:
            h = hashlib.sha256(t.encode()).hexdigest()
            best[h] = (min if keep == "smallest" else max)(best.get(h, i), i)
    for r in out:
        assert r.group_size == groups[r.text_sha256] and r.keep_id == best.get(r.text_sha256)
    assert Counter(r.text_sha256 for r in out if r.kept) == Counter(dict.fromkeys(groups, 1))


def test_exact_dedup_of_nothing(nothing):
    assert exact_dedup(nothing).count() == 0


def brute_lines(rows, min_docs, keep):
    key = lambda x: re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x).translate({c: c + 32 for c in range(65, 91)})
    held = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")})
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).digest())):
        for p, x in enumerate(t.split("\n")):
            first.setdefault(key(x), (i, t, p))
    for i, t in rows:
        lines = t.split("\n")
        gone = [len(key(x)) >= 1 and held[key(x)] >= min_docs and not (keep == "first" and first[key(x)] == (i, t, p)) for p, x in enumerate(lines)]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_line_dedup_against_brute_force(messy, keep):
    rows = [(r.doc_id, r.text or "") for r in messy.collect()]
    out = line_dedup(messy, min_docs=3, keep=keep).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out) == brute_lines(rows, 3, keep)


def test_line_bitmaps_are_runs(spark):
    docs = spark.createDataFrame([(i, "x\ny\n" + str(i) + "\nx") for i in range(4)], "doc_id long, text string")
    got = drop_bitmaps(docs, min_docs=4, keep="none").collect()
    assert len(got) == 4 and all([tuple(x) for x in r.runs] == [(0, 2), (3, 1)] for r in got)


def test_line_dedup_of_nothing(nothing):
    assert line_dedup(nothing).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(60, 50), (50, 55), (70, 70)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 55: 50, 60: 50}


@pytest.mark.parametrize("block", [64, 3])  # with 3 nearly every group is large
def test_near_dedup_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = [words[i] for i in rng.integers(0, 400, 300)]
    # a family around one text, at all distances from it and from each other
    texts = [" ".join(words[rng.integers(0, 400)] if rng.random() < share else w for w in base) for share in rng.uniform(0, 0.06, 90)]
    for size in (7, 12, 30, 80, 200, 400):
        for _ in range(12):
            base = [words[i] for i in rng.integers(0, 400, size)]
            texts.append(" ".join(base))
            for share in (0.01, 0.03, 0.08):
                texts.append(" ".join(words[rng.integers(0, 400)] if rng.random() < share else w for w in base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = inverse_frequencies(docs.select(F.col("text").alias("_text")))
    sets = []
    for t in texts:
        _, h, w, _ = shingles([t], idf)
        n, weight = Counter(h.tolist()), dict(zip(h.tolist(), w.tolist()))
        sets.append(Counter({k: n[k] * weight[k] for k in n}))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            if sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values()):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in near_dedup(docs).collect()}
    wrong = [i for i in range(len(texts)) if got[i] != find(i)]
    assert len(wrong) <= 0.01 * len(texts), wrong
    assert all(find(got[i]) == find(i) for i in range(len(texts)))  # nothing is linked that should not be


def test_similar_counts_repeated_shingles():
    idf = np.ones(1 << 18, np.float32)
    once, twice = "a b c d e f g h", "a b c d e f g h a b c d e f g h"
    assert similar([once, twice, once.upper() + "!"], idf, 0.8) == [(2, 0)]


def test_near_dedup_on_messy_rows(messy, nothing):
    out = near_dedup(messy).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in messy.collect())
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.class_id for i in (0, 1) for r in by[i]} == {0} and sum(r.kept for i in (0, 1) for r in by[i]) == 1
    assert all(r.class_id == i and r.kept for i in (2, 3, 4) for r in by[i])
    assert all(r.class_id is None and r.kept for r in by[None])
    assert near_dedup(nothing).count() == 0


def test_embedding_dedup_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        rows += [(centre + rng.standard_normal(16) * s, c % 2) for s in (0.05, 0.1, 0.2, 0.3) for _ in range(15)]
    data = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(data)
    data += [(n, data[0][1], data[0][2]), (n + 1, [2 * x for x in data[0][1]], data[0][2]), (n + 2, data[0][1], None), (n + 3, [0.0] * 16, 0),
             (n + 4, [float("nan")] + [1.0] * 15, 0), (n + 5, None, 0), (n + 6, [None] + [1.0] * 15, 0), (n + 7, [], 0), (n + 8, [1.0, 2.0], 0), (None, data[0][1], 0), data[1]]
    frame = spark.createDataFrame([(*r, 1, 2) for r in data], "vec_id long, embedding array<float>, label int, _node int, kept int")
    got = embedding_dedup(frame, threshold=0.93).collect()
    assert len(got) == len(data)
    fine = {i: (np.array(v, float) / np.linalg.norm(v), label) for i, v, label in data[:n + 2]}
    links = {i: {j for j in fine if i != j and fine[i][1] == fine[j][1] and fine[i][0] @ fine[j][0] >= 0.93} for i in fine}
    for r in got:
        if r.vec_id in fine:
            seen, todo = {r.vec_id}, [r.vec_id]
            while todo:
                todo += (new := links[todo.pop()] - seen)
                seen |= new
            assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), min(seen), r.vec_id == min(seen))
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, r.vec_id is not None)
    assert embedding_dedup(frame.filter("false")).count() == 0
