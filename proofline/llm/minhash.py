"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF word shingles, banded, verified by weighted Jaccard.

The shingles of a text are dealt into bins by their hash and every bin is sampled by a few independent weighted samplers, so a
shingle is looked at a few times and not once for each of the many samples. Short texts, whose bins are thin, are sampled
over the whole text as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from ._text import mix, on_batches, parts, word_hashes
from .components import components

WORDS = 5
SIMILARITY = 0.8
IDF_BITS = 18
BINS, SAMPLERS, ROWS = 18, 8, 6  # 144 samples in 24 bands of six rows
SHORT, SHORT_BANDS, SHORT_ROWS = 96, 16, 4
BLOCK = 64  # texts that are compared at a time
TURNS = 4  # leads that a large group is compared with before the rest meets in blocks
MASK = np.uint64((1 << 54) - 1)


def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the Gamma(2, 1) distribution at 2^12 points, and logs of those at 2^16."""
    def quantiles(n):
        want, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 60.0)
        for _ in range(60):
            mid = (low + high) / 2
            less = 1 - (1 + mid) * np.exp(-mid) < want
            low, high = np.where(less, mid, low), np.where(less, high, mid)
        return low
    return quantiles(1 << 12), np.log(quantiles(1 << 16))


def _tables(kept: list = []) -> tuple[np.ndarray, np.ndarray]:
    if not kept:
        kept += _gamma()
    return kept[0], kept[1]


def shingles(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Text number, hash and weight of each word shingle in order, and a 128-bit digest of each text's words.

    A shingle weighs the sum of its words' IDF. A text of fewer words than a shingle is one shingle; of none, none.
    """
    words, counts, _ = word_hashes(texts)
    weight = idf[(words >> np.uint64(64 - IDF_BITS)).astype(np.int64)]
    ends = np.cumsum(counts)
    n = max(len(words) - WORDS + 1, 0)
    h, w = np.zeros(n, np.uint64), np.zeros(n)
    for j in range(WORDS):
        h = h * np.uint64(0x9E3779B97F4A7C55) + words[j:j + n]
        w = w + weight[j:j + n]
    doc = np.repeat(np.arange(len(texts)), counts)
    whole = np.flatnonzero(doc[:n] == doc[WORDS - 1:WORDS - 1 + n]) if n else np.empty(0, np.int64)
    at, hashes, weights = doc[whole], mix(h[whole], 11), w[whole]
    few = [i for i in np.flatnonzero((counts > 0) & (counts < WORDS))]
    if few:
        short = [words[ends[i] - counts[i]:ends[i]] for i in few]
        extra = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little") for x in short]
        at, hashes = np.concatenate([at, few]), np.concatenate([hashes, np.array(extra, np.uint64)])
        weights = np.concatenate([weights, [weight[ends[i] - counts[i]:ends[i]].sum() for i in few]])
    digests = [hashlib.blake2b(words[e - c:e].tobytes(), digest_size=16).digest() for e, c in zip(ends, counts)]
    return at, hashes, weights, digests


def _weighted(at: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text by (text, hash), 54 bits of the hash, with their summed weight."""
    key = (at.astype(np.uint64) << np.uint64(54)) | (hashes >> np.uint64(10))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    total = np.add.reduceat(weights[order], first) if len(first) else np.empty(0)
    return (key[first] >> np.uint64(54)).astype(np.int64), key[first] & MASK, total


def _samples(hashes: np.ndarray, log_weight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """One consistent weighted sample of each run of shingles: a hash of the chosen shingle and its quantised weight."""
    gamma, log_gamma = _tables()
    u = mix(hashes, seed)
    r = gamma[(u & np.uint64(4095)).astype(np.int64)]
    beta = ((u >> np.uint64(28)) & np.uint64((1 << 24) - 1)).astype(float) / (1 << 24)
    step = np.floor(log_weight / r + beta)
    value = log_gamma[((u >> np.uint64(12)) & np.uint64(65535)).astype(np.int64)] - r * (step - beta + 1)
    low = np.minimum.reduceat(value, starts)
    hit = np.flatnonzero(value == np.repeat(low, sizes))
    run = np.repeat(np.arange(len(starts)), sizes)[hit]
    first = hit[np.concatenate([[True], run[1:] != run[:-1]])]
    return mix(hashes[first] * np.uint64(3) + step[first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C55), 100 + seed)


def bands(n_texts: int, at: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> list[bytes]:
    """The band keys of each text, eight bytes each; none for a text without shingles."""
    at, hashes, weights = _weighted(at, hashes, weights)
    out = [b""] * n_texts
    if not len(at):
        return out
    logs = np.log(np.maximum(weights, 1e-9))
    slot = at * BINS + (((hashes >> np.uint64(27)) * np.uint64(BINS)) >> np.uint64(27)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    sizes = np.diff(np.append(starts, len(slot)))
    filled = np.zeros(n_texts * BINS, bool)
    filled[slot[starts]] = True
    some = np.unique(at)
    # an empty bin takes the sample of the next filled one, changed by the distance
    grid = filled.reshape(n_texts, BINS)[some]
    source, away = np.tile(np.arange(BINS), (len(some), 1)), np.zeros((len(some), BINS), np.uint64)
    for d in range(1, BINS):
        need = ~np.take_along_axis(grid, source, 1)
        source, away = np.where(need, (np.arange(BINS) + d) % BINS, source), np.where(need, np.uint64(d), away)
    found = []
    for k in range(SAMPLERS):
        flat = np.zeros(n_texts * BINS, np.uint64)
        flat[slot[starts]] = _samples(hashes, logs, starts, sizes, k)
        sample = np.take_along_axis(flat.reshape(n_texts, BINS)[some], source, 1) + away * np.uint64(0xD1342543DE82EF95)
        for g in range(BINS // ROWS):
            key = np.zeros(len(some), np.uint64)
            for column in range(g, BINS, BINS // ROWS):
                key = mix(key * np.uint64(31) + sample[:, column], 1000 + k * 10 + g)
            found.append(key)
    regular = np.stack(found, 1)
    tail: dict[int, bytes] = {}
    counts = np.bincount(at, minlength=n_texts)
    thin = counts[at] <= SHORT
    if thin.any():
        h, l, owner = hashes[thin], logs[thin], at[thin]
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(begin, len(owner)))
        extra = []
        for g in range(SHORT_BANDS):
            key = np.zeros(len(begin), np.uint64)
            for j in range(SHORT_ROWS):
                key = mix(key * np.uint64(31) + _samples(h, l, begin, size, 50 + g * SHORT_ROWS + j), 2000 + g)
            extra.append(key)
        stacked = np.stack(extra, 1)
        tail = {int(i): row.tobytes() for i, row in zip(owner[begin], stacked)}
    for i, row in zip(some.tolist(), regular):
        out[i] = row.tobytes() + tail.get(i, b"")
    return out


def _elements(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, element and weight of each shingle, and the weight of each text. The second and later copies of a
    shingle are elements of their own, so that minima become common elements."""
    at, hashes, weights, _ = shingles(texts, idf)
    order = np.lexsort((hashes, at))
    at, hashes, weights = at[order], hashes[order], weights[order]
    run = np.concatenate([[True], (at[1:] != at[:-1]) | (hashes[1:] != hashes[:-1])]) if len(at) else np.empty(0, bool)
    begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
    element = mix(hashes + (np.arange(len(at)) - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C55), 5)
    return at, element, weights, np.bincount(at, weights, len(texts))


def similarity_to_first(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """The weighted Jaccard similarity of each text to the first."""
    at, element, weights, total = _elements(texts, idf)
    shared = np.isin(element, element[at == 0])
    common = np.bincount(at[shared], weights[shared], len(texts))
    union = total[0] + total - common
    return np.where(union > 0, (common + 1e-9) / np.maximum(union, 1e-12), 0.0)


def similar(texts: list[str], idf: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Each text that is like another, with the first text it is linked to directly or through others."""
    at, element, weights, total = _elements(texts, idf)
    kinds, column, n = np.unique(element, return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    shared = n[column] > 1
    rows, columns, weights = at[shared], number[column[shared]], weights[shared]
    order = np.argsort(columns, kind="stable")
    rows, columns, weights = rows[order], columns[order], weights[order]
    common = np.zeros((len(texts), len(texts)))
    for low in range(0, int(columns[-1]) + 1 if len(columns) else 0, 4096):
        a, b = np.searchsorted(columns, [low, low + 4096])
        held = np.zeros((len(texts), 4096))
        held[rows[a:b], columns[a:b] - low] = np.sqrt(weights[a:b])
        common += held @ held.T
    union = total[:, None] + total[None, :] - common
    alike = (common >= threshold * union - 1e-9) & (union > 0)
    root = np.arange(len(texts))
    for i, j in zip(*np.nonzero(np.triu(alike, 1))):
        a, b = _root(root, i), _root(root, j)
        root[max(a, b)] = min(a, b)
    return [(i, r) for i in range(len(texts)) if (r := _root(root, i)) != i]


def _root(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return int(i)


def _by_leads(many: DataFrame, hubs: DataFrame, fetch: Callable, in_blocks: Callable, verify: Callable, against: Callable,
              threshold: float) -> list[DataFrame]:
    """Links that join the texts of large groups (label, _node, _first, _least) into classes.

    Every text is compared with the group's hub (label, _node), its first lead. What is like a lead is settled and in the class of
    the hub; the rest is compared with further leads, drawn from what is settled. What then is left is compared with all that could be
    like it, in blocks: with each other, and with those settled texts whose distance to the hub differs by no more than a link's,
    as the distance is a metric.
    """
    reach = 1 - threshold + 1e-6
    found, open_, first = [], many.select("label", "_node", "_first", "_least"), None
    heads = cut(many.join(hubs, ["label", "_node"], "left_semi").select(
        "label", F.col("_node").alias("_lead"), F.col("_first").alias("_lf"), F.col("_least").alias("_ll")), "hubs")
    leads = heads
    for turn in range(TURNS):
        sizes = open_.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).join(leads, "label")
        blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
        members = open_.join(sizes, "label").filter("_node <> _lead").select(
            "label", "_lead", "_node", "_first", "_least", F.array(F.pmod(F.xxhash64("_node"), blocks).cast("int")).alias("_blocks"))
        ahead = sizes.select("label", "_lead", F.col("_lead").alias("_node"), F.col("_lf").alias("_first"), F.col("_ll").alias("_least"),
                             F.sequence(F.lit(0), blocks - 1).alias("_blocks"))
        texts = fetch(cut(members.unionByName(ahead), "compared")).select("label", "_lead", "_node", "_text", F.explode("_blocks").alias("_block"))
        told = cut(texts.groupBy("label", "_block").applyInArrow(against, "label binary, _node binary, _lead binary, _like double"), "told")
        first = told if first is None else first
        found.append(told.filter(F.col("_like") >= threshold).select(F.col("_node").alias("a"), F.col("_lead").alias("b")))
        done = told.filter(F.col("_like") >= threshold).select("label", "_node").unionByName(heads.select("label", F.col("_lead").alias("_node")))
        open_ = cut(open_.join(done, ["label", "_node"], "left_anti"), "open")
        if open_.isEmpty():
            return found
        settled = many.join(open_.select("label", "_node"), ["label", "_node"], "left_anti")
        drawn = settled.join(heads.select("label", F.col("_lead").alias("_node")), ["label", "_node"], "left_anti").groupBy("label").agg(F.min_by(F.struct("_node", "_first", "_least"), F.xxhash64("_node", F.lit(turn))).alias("_d"))
        leads = cut(drawn.select("label", F.col("_d._node").alias("_lead"), F.col("_d._first").alias("_lf"), F.col("_d._least").alias("_ll")), "leads")
    sizes = open_.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    found.append(in_blocks(cut(open_.join(sizes, "label"), "rest")).groupBy("label", "_i", "_j").applyInArrow(verify, "a binary, b binary"))
    away = first.select("label", "_node", (1 - F.col("_like")).alias("_away"))
    near = open_.join(away, ["label", "_node"])
    bounds = near.groupBy("label").agg(F.min("_away").alias("_low"), F.max("_away").alias("_high"), F.count(F.lit(1)).alias("_n"))
    other = settled.join(away, ["label", "_node"], "left").withColumn("_away", F.coalesce("_away", F.lit(0.0)))  # the hub itself
    other = other.join(bounds.drop("_n"), "label").filter((F.col("_away") >= F.col("_low") - reach) & (F.col("_away") <= F.col("_high") + reach))
    counts = other.groupBy("label").agg(F.count(F.lit(1)).alias("_k")).join(bounds.select("label", "_n"), "label")
    tiles = [F.ceil(F.col(c) / BLOCK).cast("int") for c in ("_n", "_k")]
    side = lambda df, mine, yours, up: df.join(counts, "label").select(
        "label", "_node", "_first", "_least", F.pmod(F.xxhash64("_node"), mine).cast("int").alias("_own"), F.sequence(F.lit(0), yours - 1).alias("_others"), F.lit(up).alias("_up"))
    both = cut(side(near, tiles[0], tiles[1], True).unionByName(side(other, tiles[1], tiles[0], False)), "rest")
    cells = fetch(both).select("label", "_node", "_text", "_own", "_up", F.explode("_others").alias("_o"))
    cells = cells.select("label", "_node", "_text", F.when(F.col("_up"), F.col("_own")).otherwise(F.col("_o")).alias("_i"),
                         F.when(F.col("_up"), F.col("_o")).otherwise(F.col("_own")).alias("_j"))
    found.append(cells.groupBy("label", "_i", "_j").applyInArrow(verify, "a binary, b binary"))
    return found


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """ln(1 + N / df) by hash bucket of the word, over all texts; a fixed number of buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(1 << IDF_BITS, np.int64), 0
        for _, texts in parts(batches, "_text"):
            words, counts, _ = word_hashes(texts)
            doc = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
            seen = np.unique((doc << IDF_BITS) | (words >> np.uint64(64 - IDF_BITS)).astype(np.int64))
            held += np.bincount(seen & ((1 << IDF_BITS) - 1), minlength=1 << IDF_BITS)
            total += len(texts)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(held[some], total))], ["bucket", "n"])
    got = on_batches(rows.select("_text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most 2^18 rows
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    total = int(n[bucket < 0].sum())
    df = np.zeros(1 << IDF_BITS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return np.log1p(max(total, 1) / np.maximum(df, 1)).astype(np.float32)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY,
               digest: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``class_id``, ``class_size``, ``kept``, with ``digest`` also ``text_sha256`` (that of
    an empty text where the text is NULL), by which rows that share an id are told apart.

    Texts are alike when the weighted Jaccard similarity of their TF-IDF word shingles is at least ``threshold``; classes are
    closed under likeness and named by their smallest id. Texts of the same words (lower-cased runs of letters, digits, underscores and
    non-ASCII characters) count as copies and are one text from here on. A text without a word (NULL, empty) and a row
    with a NULL id are alike to nothing. One row of each class is kept: the first with the smallest id, and of
    the texts that share that id the one with the smallest digest.

    Candidates share a band; links from each band's smallest text to the others group them. Texts of a small group are compared
    with each other, those of a large one with a few leads, and only what is like none of these in blocks. No pair is written out
    and no task holds more than two blocks. An empty table gives no row. Only ``id_col`` and ``text_col`` are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_sha", F.unhex(F.sha2(F.coalesce("_text", F.lit("")), 256)))
    shared = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(rows))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, "_text"):
            for begin in range(0, len(texts), 1000):  # text numbers have ten bits
                some = texts[begin:begin + 1000]
                at, hashes, weights, digests = shingles(some, shared.value)
                keys = bands(len(some), at, hashes, weights)
                ids = batch.column("_id").slice(begin, len(some))
                real = [bool(k) and i.is_valid for k, i in zip(keys, ids)]
                yield pa.RecordBatch.from_arrays([
                    ids, batch.column("_sha").slice(begin, len(some)), pa.array([d if r else None for d, r in zip(digests, real)], pa.binary()),
                    pa.array([np.frombuffer(k, np.int64) if r else None for k, r in zip(keys, real)], pa.list_(pa.int64()))], ["_id", "_sha", "_node", "_bands"])
    signed = cut(on_batches(rows, sign, "_id long, _sha binary, _node binary, _bands array<long>"), "signed")
    nodes = signed.filter("_node is not null").groupBy("_node").agg(F.min(F.struct("_id", "_sha")).alias("_least"), F.first("_bands").alias("_bands"))
    nodes = cut(nodes.select("_node", F.col("_least._id").alias("_first"), F.col("_least._sha").alias("_least"), "_bands"), "nodes")

    entries = nodes.select("_node", F.explode("_bands").alias("_band"))
    full = entries.groupBy("_band").agg(F.min("_node").alias("_lead"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    met = entries.join(cut(full, "bands"), "_band").filter("_node <> _lead").groupBy("_node").agg(F.collect_set("_lead").alias("_leads"))
    met = cut(met.withColumn("_to", F.array_min("_leads")), "met")  # at most one lead per band
    # one link per text, and links between the leads that share a text: leads are few where a group is large
    between = met.select(F.explode("_leads").alias("_node"), "_to").filter("_node <> _to").distinct()
    groups = components(met.select("_node", "_to").unionByName(between), "_node", "_to")
    sizes = cut(groups.groupBy("label").agg(F.count(F.lit(1)).alias("_m")), "sizes")
    wanted = groups.join(sizes, "label").join(nodes.select("_node", "_first", "_least"), F.col("node") == F.col("_node"))
    wanted = cut(wanted.select("label", "_node", "_first", "_least", "_m"), "wanted")

    def fetch(some: DataFrame) -> DataFrame:
        asked = (F.col("_id") == F.col("_first")) & (F.col("_sha") == F.col("_least"))  # an id alone may carry several texts
        return rows.join(some.hint("merge"), asked)

    def in_blocks(some: DataFrame) -> DataFrame:
        """All texts of each label (with _n of them) compared: each block meets every block of its label, itself included."""
        blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
        block = F.pmod(F.xxhash64("_node"), blocks).cast("int")
        texts = fetch(some).select("label", "_node", "_text", block.alias("_block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
        return texts.select("label", "_node", "_text", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))

    def verify(table: pa.Table) -> pa.Table:
        held = dict(zip(table.column("_node").to_pylist(), table.column("_text").to_pylist()))
        ids = sorted(held)
        found = similar([held[i] or "" for i in ids], shared.value, threshold)
        return pa.table([pa.array([ids[a] for a, _ in found], pa.binary()), pa.array([ids[b] for _, b in found], pa.binary())], ["a", "b"])

    def against(table: pa.Table) -> pa.Table:
        lead = table.column("_lead")[0].as_py()
        held = dict(zip(table.column("_node").to_pylist(), table.column("_text").to_pylist()))
        ids = [lead, *sorted(i for i in held if i != lead)]
        found = similarity_to_first([held[i] or "" for i in ids], shared.value)
        return pa.table([pa.array([table.column("label")[0].as_py()] * (len(ids) - 1), pa.binary()), pa.array(ids[1:], pa.binary()),
                         pa.array([lead] * (len(ids) - 1), pa.binary()), pa.array(found[1:])], ["label", "_node", "_lead", "_like"])

    few = wanted.filter(F.col("_m") <= BLOCK).withColumn("_n", F.col("_m"))
    checked = [in_blocks(few).groupBy("label", "_i", "_j").applyInArrow(verify, "a binary, b binary")]
    many = cut(wanted.filter(F.col("_m") > BLOCK), "many")
    if not many.isEmpty():
        asked = met.groupBy(F.col("_to").alias("_node")).agg(F.count(F.lit(1)).alias("_k"))  # whom most texts met
        hubs = many.select("label", "_node").join(asked, "_node").groupBy("label").agg(F.max_by("_node", F.struct("_k", "_node")).alias("_node"))
        checked += _by_leads(many, hubs, fetch, in_blocks, verify, against, threshold)
    links = checked[0]
    for part in checked[1:]:
        links = links.unionByName(part)
    links = cut(links, "verified")
    classes = components(links)
    named = nodes.join(classes, F.col("_node") == F.col("node"), "left").select(
        "_node", "_first", "_least", F.coalesce("label", "_node").alias("_class"))
    named = cut(named, "named")
    counts = signed.groupBy("_node").agg(F.count(F.lit(1)).alias("_n"))
    totals = named.join(counts, "_node").groupBy("_class").agg(
        F.min(F.struct("_first", "_least")).alias("_lead"), F.sum("_n").alias("class_size"))
    totals = totals.select("_class", F.col("_lead._first").alias("class_id"), F.col("_lead._least").alias("_lead"), "class_size")
    info = cut(named.join(cut(totals, "totals"), "_class").select(F.col("_node").alias("_k"), "class_id", "_lead", "class_size"), "classes")
    out = signed.groupBy("_id", "_node", "_sha").agg(F.count(F.lit(1)).alias("_copies"))
    out = cut(out, "rows").join(info, F.col("_node") == F.col("_k"), "left")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    alone = F.col("class_id").isNull()
    # of an id that several texts of one class carry only one row is first: that of the smallest digest
    first = (F.col("_id") == F.col("class_id")) & (F.col("_sha") == F.col("_lead")) & (F.col("_copy") == 1)
    more = [F.lower(F.hex("_sha")).alias("text_sha256")] if digest else []
    return out.select("*", copy.alias("_copy")).select(
        F.col("_id").alias("doc_id"), F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (alone | first).alias("kept"), *more)
