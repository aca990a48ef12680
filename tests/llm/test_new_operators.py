"""Merkle manifest, best-fit packing and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofline.llm import merkle, queries, spelling
from proofline.llm.best_fit import Bins, best_fit
from proofline.llm.bpe import Coder
from proofline.llm.packing import pack

tokenizers = pytest.importorskip("tokenizers")
files = pytest.importorskip("public_tokenizers")
BPE = files.path("byte_bpe_50k.json")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def trees(groups: dict) -> tuple[str, dict]:
    """The root, and per (group, place) its leaf, subroot and siblings level by level."""
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def siblings(built, i):
        out = []
        for nodes in built[:-1]:
            b = i // 8 * 8
            out.append(("".join(nodes[b:i]), "".join(nodes[i + 1:b + 8])))
            i //= 8
        return out
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: levels(groups[k]) for k in keys}
    top = levels([built[k][-1][0] for k in keys])
    return top[-1][0], {(k, i): (leaf, built[k][-1][0], siblings(built[k], i) + siblings(top, j))
                        for j, k in enumerate(keys) for i, leaf in enumerate(groups[k])}


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 9, "": 8, "é": 1}, {"x": 513, "y": 64, "z": 4097}, {str(i): 1 + i % 3 for i in range(20)}])
def test_manifest(spark, sizes):
    groups = {k: [sha(f"{k}-{i}") for i in range(n)] for k, n in sizes.items()}
    rows = [(i, k, leaf) for k, leaves in groups.items() for i, leaf in enumerate(leaves)]
    random.Random(3).shuffle(rows)
    leaves = spark.createDataFrame(rows, "id long, kind string, leaf string").repartition(5)
    root, want = trees(groups)
    got = merkle.manifest(leaves, "id", "kind").withColumn("proof", merkle.proof_digest(F.col("steps"))).withColumn(
        "back", merkle.fold(F.col("leaf"), F.col("steps"))).withColumn("other", merkle.fold(F.sha2(F.lit("x"), 256), F.col("steps"))).collect()
    assert len(got) == len(rows)
    for r in got:
        leaf, subroot, steps = want[r.kind, r.id]
        assert (r.leaf, r.subroot, r.root, r.back) == (leaf, subroot, root, root)
        assert [(s.left.hex(), s.right.hex()) for s in r.steps] == steps
        assert r.proof == sha("".join(a + b for a, b in steps)) and r.other != root or len(rows) == 1


def test_manifest_of_messy_rows(spark, messy, nothing, tmp_path):
    for frame in (messy, nothing):
        path = str(tmp_path / f"d{frame is messy}")
        frame.write.parquet(f"{path}/documents.parquet")
        got = queries.QUERIES["op11_merkle"](spark, path).collect()
        assert len(got) == frame.count()
        rows = frame.collect()

        def field(v):
            return "-" if v is None else f"{len(str(v).encode())}:{v}"

        def leaf(r, text):
            return sha("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, text))))
        by = defaultdict(list)
        for r in rows:
            by[r.lang].append(r)
        for group in by.values():
            group.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        if not rows:
            continue
        root, want = trees({k: [leaf(r, r.text) for r in v] for k, v in by.items()})
        expected = []
        for k, v in by.items():
            for i, r in enumerate(v):
                plain, subroot, steps = want[k, i]
                at = plain
                if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None:
                    at = leaf(r, re.sub("[A-Z]", lambda m: m.group().lower(), r.text))
                for a, b in steps:
                    at = sha(a + at + b)
                expected.append((r.doc_id, plain, subroot, root, sha("".join(a + b for a, b in steps)), at, at == root))
        assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_bins_hold_what_fits_best_and_close_the_fullest():
    bins = Bins(10, 2)
    assert bins.place(10) == (0, 0, [0])
    assert bins.place(6) == (1, 0, []) and bins.place(7) == (2, 0, [])
    assert bins.place(3) == (2, 7, [2])
    assert bins.place(8) == (3, 0, []) and bins.place(9) == (4, 0, [3])
    assert bins.place(4) == (1, 6, [1]) and bins.rest() == [4]


@pytest.mark.parametrize("most_open", [1, 4, 1024])
def test_best_fit(spark, messy, most_open):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["alpha", "beta,", "gamma.\n", "12", "naïve"], k=rng.choice([0, 1, 5, 30, 200]))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "c", i) for i, t in enumerate(texts)], "doc_id long, text string, offset string, piece int").repartition(6)
    known = tokenizers.Tokenizer.from_file(BPE)
    for frame in (docs, messy.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        want = {r.doc_id: known.encode(r.text or "", add_special_tokens=False).ids + [0] for r in frame.collect()}
        got = best_fit(frame, BPE, size=64, most_open=most_open).collect()
        by = defaultdict(list)
        for r in got:
            ids = np.array(want[r.doc_id][r.start:r.start + r.length], "<u4")
            assert r.ids == ids.astype("<u2").tobytes() and r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == len(want[r.doc_id])
            by[r.doc_id].append(r)
        for doc, ids in want.items():
            pieces = sorted(by[doc], key=lambda r: r.piece)
            assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
            assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
            assert all(p.length == 64 for p in pieces[1:]) and (len(pieces) == 1 or len(ids) > 64)
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for places in bins.values():
            at = 0
            for offset, n in sorted(places):
                assert offset == at
                at += n
            assert at <= 64
        if most_open == 1024 and frame is docs:  # the least number, but for one sequence per group of tasks
            assert len(bins) <= -(-sum(map(len, want.values())) // 64) + 4


def test_best_fit_of_repeated_rows_and_of_nothing(messy, nothing):
    assert best_fit(nothing, BPE).count() == 0
    got = best_fit(messy, BPE)
    assert got.filter("piece = 0").count() == messy.count() and got.filter("doc_id is null and piece = 0").count() == 2


def test_coder_gives_the_ids_of_whole_texts():
    known, own = tokenizers.Tokenizer.from_file(BPE), Coder(BPE)
    bits = [" ", "  ", "\n", "\n\n", "\t", "a", "bc", "'s", "don't", "1", "23", ".", ",", "!", "é", "日本", " ", "　", "\x1c", "\x85", "<|endoftext|>",
            "<", "\x01", "😀", "\r\n", "​", "Ab", "²", "Ⅷ"]
    rng = random.Random(7)
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(3000)] + ["", "word " * 200_000]
    ids, ends = own.encode(pa.array(texts), 0)
    at = 0
    for text, end in zip(texts, ends.tolist()):
        assert ids[at:end].tolist() == known.encode(text, add_special_tokens=False).ids + [0], text[:50]
        at = end


def variants(counts: dict) -> list[tuple]:
    by, near, form = defaultdict(set), defaultdict(set), {}
    for w in counts:
        for k in range(len(w)):
            by[k, w[:k] + w[k + 1:]].add(w)
    for (_, short), words in by.items():
        if short in counts:
            for w in words:
                near[w].add(short)
                near[short].add(w)
        for w in words:
            near[w] |= words - {w}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 5 * counts[w]:
            form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out, key=str)


def words_of(rows) -> dict:
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 5}


@pytest.mark.parametrize("most", [20_000, 40, 3])
def test_variants_of_dense_words(spark, rows, most):
    rng = random.Random(most)
    words = {"".join(rng.choices("abà", k=rng.choice([6, 6, 7, 8, 9]))) for _ in range(700)} | {"a" * k for k in range(6, 30)} | {"abcdefg|", "abcdefg", "abcdef|g|"}
    counts = {w: rng.choice([5, 5, 6, 30, 200, 1000]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("near", F.lit(1))
    assert sorted(map(tuple, spelling.spelling_variants(frame, most=most).collect()), key=str) == variants(counts)


@pytest.mark.parametrize("chars", [2, 5])
def test_variants_of_short_words(spark, chars):
    rng = random.Random(chars)
    counts = {w: rng.choice([1, 7, 40]) for w in {"".join(rng.choices("abcd", k=rng.randint(chars, chars + 3))) for _ in range(400)}}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.spelling_variants(frame, min_chars=chars).collect()), key=str) == variants(counts)


def test_words_of_messy_texts(spark, messy, nothing, tmp_path):
    more = [(i, f"Colour colours COLOUR; colouré ÷×÷×÷× colour's {'colour ' * (i % 7)}colou{'r' * 3000}", "en") for i in range(40)] + [(None, "colour " * 9, None)]
    frame = messy.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_spelling"](spark, str(tmp_path)).collect()
    want = variants(words_of([(r.doc_id, r.text) for r in frame.collect()]))
    assert sorted(map(tuple, got), key=str) == want and any(w[1] for w in want)
    assert spelling.spelling_variants(spelling.vocabulary(nothing)).count() == 0


def test_acceptor_is_minimal():
    words = sorted({"tap", "taps", "top", "tops"})
    found = spelling.Acceptor(words)
    assert len(found.arcs) == 5 and found.size[found.start] == 4
    left, right = found.pairs()
    assert {frozenset((words[i], words[j])) for i, j in zip(left, right)} == {
        frozenset(p) for p in (("tap", "taps"), ("top", "tops"), ("tap", "top"), ("taps", "tops"))}


def test_pack_and_best_fit_agree_on_tokens(messy):
    assert pack(messy, BPE).agg(F.sum("length")).first() == best_fit(messy, BPE).agg(F.sum("length")).first()
