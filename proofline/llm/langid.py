"""Language identification: an interpolated Kneser-Ney character model for each language, in sorted hash arrays.

The lowest cross-entropy per character wins; a text whose cross-entropy is far above what its language shows on
calibration texts of like length is marked as rejected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from ._text import mix, on_batches, parts
from .folds import fold

# letters are the Unicode categories L*; re's \w also takes numerals that are no decimal digits
NOT_LETTERS = re.compile(r"[\W\d_]+")
NUMERALS = [c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) in ("No", "Nl")]
NUMERAL = re.compile("[" + "".join(c for c in NUMERALS if c < "\U00010000") + "]")  # one plane makes a fast class
HIGH, HIGH_NUMERAL = re.compile("[\U00010000-\U0010ffff]"), re.compile("[" + "".join(c for c in NUMERALS if c >= "\U00010000") + "]")
PART = 1 << 20  # characters that are scored at a time
STEP = np.uint64(0x9E3779B97F4A7C55)
UNKNOWN = "und"


def characters(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts with one space for each run of other characters, laid end to end; where each
    text's own characters begin, and how many letters and inner spaces it has. ``order - 1`` spaces stand before each text."""
    plain = [t if t.isascii() or not NUMERAL.search(t) else NUMERAL.sub(" ", t) for t in texts]
    plain = [t if t.isascii() or not HIGH.search(t) else HIGH_NUMERAL.sub(" ", t) for t in plain]
    clean = [NOT_LETTERS.sub(" ", t.lower()).strip(" ") for t in plain]
    pad = " " * (order - 1)
    codes = np.frombuffer((pad + pad.join([c + " " for c in clean])).encode("utf-32-le", "replace"), "<u4")
    sizes = np.array([len(c) + 1 for c in clean], np.int64)  # with the space after the last word
    begins = np.cumsum(sizes + order - 1) - sizes
    return codes, begins, np.array([len(c) for c in clean], np.int64)


def grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each position the hashes of the 1, 2, ... ``order`` characters that end there."""
    one = mix(codes.astype(np.uint64), 3)
    out = [one]
    for n in range(1, order):
        longer = one.copy()
        longer[n:] += out[-1][n - 1:-1] * STEP
        out.append(longer)
    return out


@dataclass
class Model:
    """``keys[n]`` and ``logs[n]``: sorted hashes of n+1 characters and their log-probabilities by language; ``contexts[n]`` and
    ``weights[n]``: sorted hashes of contexts of n characters and the logs of what they leave to the shorter context."""
    langs: list[str]
    order: int
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: np.ndarray
    cutoffs: dict[str, list[float]]

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text by language, and its number of letters and inner spaces."""
        codes, begins, sizes = characters(texts, self.order)
        logs = np.zeros((len(texts), len(self.langs)))
        for low in range(0, len(codes), PART):  # a long text is scored in parts that know the characters before them
            high, before = min(low + PART, len(codes)), max(0, low - self.order + 1)
            first, last = np.clip(begins, low, high), np.clip(begins + sizes, low, high)
            here = np.flatnonzero(last > first)
            if len(here):
                sums = self._sums(codes[before:high], np.concatenate([np.arange(first[i], last[i]) for i in here]) - before)
                logs[here] += sums[last[here] - before] - sums[first[here] - before]
        return logs, sizes

    def _sums(self, codes: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Sums of the log-likelihoods of the characters at the places ``left``, up to each place."""
        hashes = grams(codes, self.order)
        total = np.zeros((len(codes), len(self.langs)), np.float32)
        for n in range(self.order - 1, -1, -1):
            if not len(left):
                break
            at, hit = _find(self.keys[n], hashes[n][left])
            total[left[hit]] += self.logs[n][at[hit]]
            left = left[~hit]
            if n and len(left):  # the context's weight, then the shorter history
                at, hit = _find(self.contexts[n], hashes[n - 1][left - 1])
                total[left[hit]] += self.weights[n][at[hit]]
        total[left] += self.floor
        return np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(total, axis=0, dtype=np.float64)])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, values, len(found))


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    """From the codes (rows of ``order`` code points) and counts of each language."""
    langs = sorted(counts)
    alphabet = len(np.unique(np.concatenate([c.ravel() for c, _ in counts.values()]))) + 1
    floor = np.full(len(langs), -np.log(alphabet), np.float32)
    levels: list[list[dict]] = [[] for _ in range(order)]
    for lang in langs:
        codes, n = counts[lang]
        n = n.astype(float)
        for k in range(order - 1, -1, -1):  # longest first; shorter ones count the distinct characters before them
            hashes = _rows_hash(codes)
            context = _rows_hash(codes[:, :-1])
            ones, twos = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
            off = ones / (ones + 2 * twos) if ones and twos else 0.5
            ckeys, csum = _sums(context, n)
            _, kinds = _sums(context, np.ones(len(n)))
            at = np.searchsorted(ckeys, context)
            levels[k].append({"keys": hashes, "own": (n - off) / csum[at], "context": context, "ckeys": ckeys, "left": off * kinds / csum,
                              "short": _rows_hash(codes[:, 1:]), "codes": codes})
            if k:
                shorter, first = np.unique(codes[:, 1:], axis=0, return_inverse=True)
                codes, n = shorter, np.bincount(first.ravel(), minlength=len(shorter)).astype(float)
    keys, logs, contexts, weights = [], [], [], []
    for k in range(order):
        union = np.unique(np.concatenate([x["keys"] for x in levels[k]]))
        cunion = np.unique(np.concatenate([x["ckeys"] for x in levels[k]]))
        probs, left = np.zeros((len(union), len(langs))), np.ones((len(cunion), len(langs)))
        # which context and which shorter history each key of the union has
        context, short = np.zeros(len(union), np.uint64), np.zeros(len(union), np.uint64)
        for x in levels[k]:
            at = np.searchsorted(union, x["keys"])
            context[at], short[at] = x["context"], x["short"]
        for j, x in enumerate(levels[k]):
            left[np.searchsorted(cunion, x["ckeys"]), j] = x["left"]
            probs[np.searchsorted(union, x["keys"]), j] = x["own"]
        if k:
            at, hit = _find(keys[-1], short)
            lower = np.where(hit[:, None], np.exp(logs[-1][at]), 1 / alphabet)
        else:
            lower = np.full_like(probs, 1 / alphabet)
        probs += left[np.searchsorted(cunion, context)] * lower
        keys.append(union)
        logs.append(np.log(probs).astype(np.float32))
        contexts.append(cunion)
        weights.append(np.log(left).astype(np.float32))
    floor = floor + weights[0][0]  # a character no language has seen
    return Model(langs, order, keys, logs, contexts, weights, floor, {})


def _rows_hash(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        out = out * STEP + mix(codes[:, j].astype(np.uint64), 3)
    return out


PIECE = 2000  # characters of a text that are drawn at a time
FEW = 20  # with fewer texts than this, pieces and not whole texts are kept apart for calibration


def _sample(docs: DataFrame, sample_chars: int) -> DataFrame:
    """Pieces of the texts of each language, about ``sample_chars`` characters of it, chosen by a hash of id, text and place; ``_fit``
    marks those that are counted. Wherever a language has a letter, at least the piece that begins with the first letter of the
    text with the smallest hash is drawn and counted."""
    docs = docs.select(F.regexp_replace("_text", r"\A[^\p{L}]++", "").alias("_text"), "_lang", F.xxhash64("_id", "_text").alias("_hash"))
    docs = docs.filter("_text <> ''").withColumn("_size", F.length("_text"))
    totals = docs.groupBy("_lang").agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.min("_hash").alias("_least"))
    share = F.least(F.lit(1.0), F.lit(sample_chars) / F.col("_sum"))
    docs = docs.join(cut(totals.select("_lang", share.alias("_share"), (F.col("_n") < FEW).alias("_few"), "_least"), "languages"), "_lang")
    lead = F.col("_hash") == F.col("_least")

    def drawn(p):
        return (F.pmod(F.xxhash64("_hash", p, F.lit(17)), F.lit(1 << 20)) / (1 << 20) < F.col("_share")) | (lead & (p == 0))
    places = F.filter(F.sequence(F.lit(0), F.floor((F.col("_size") - 1) / PIECE).cast("int")), drawn)
    pieces = F.transform(places, lambda p: F.struct(F.substring("_text", p * PIECE + 1, F.lit(PIECE)).alias("_text"), p.alias("_place")))
    docs = docs.select("_lang", "_hash", "_few", lead.alias("_lead"), F.explode(pieces).alias("_piece")).select("*", "_piece.*")
    apart = F.when(F.col("_few"), F.xxhash64("_hash", "_place", F.lit(4))).otherwise(F.xxhash64("_hash", F.lit(4)))
    fit = (F.pmod(apart, F.lit(4)) > 0) | (F.col("_lead") & (F.col("_place") == 0))
    return cut(docs.select("_lang", "_text", fit.alias("_fit")), "sample")


def fit(docs: DataFrame, order: int = 4, sample_chars: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learn from the rows given. The models come from a bounded sample: pieces of all texts, about ``sample_chars`` characters a
    language, three quarters of which are counted and the rest used to calibrate the rejection. None without any letter."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    sample = _sample(rows.dropna(subset=["_text", "_lang"]), sample_chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in parts(batches, "_text"):
            langs = np.array(batch.column("_lang").to_pylist())
            for lang in np.unique(langs):
                codes, begins, sizes = characters([t for t, own in zip(texts, langs == lang) if own], order)
                at = np.concatenate([np.arange(b, b + n) for b, n in zip(begins, sizes + (sizes > 0))])
                seen = np.stack([codes[at - k] for k in range(order - 1, -1, -1)], 1)
                kinds, n = np.unique(seen, axis=0, return_counts=True)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(kinds.ravel().astype(np.int32)), order).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(n)), flat, pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = on_batches(sample.filter("_fit").select("_text", "_lang"), count, "lang string, gram array<int>, n long")
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    langs = np.array(found.column("lang").to_pylist(), object)
    if not len(langs):
        return None
    codes = found.column("gram").combine_chunks().flatten().to_numpy().reshape(-1, order)
    n = found.column("n").to_numpy()
    counts = {lang: (codes[langs == lang], n[langs == lang]) for lang in set(langs)}
    model = build(counts, order)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, whole in parts(batches, "_text"):
            langs = batch.column("_lang").to_pylist()
            for begin in (1 << k for k in range(2, PIECE.bit_length() + 1)):  # the first letters of each text, as texts of that length
                texts = [t[:begin] for t in whole]
                scores, sizes = model.score(texts)
                use = [i for i, x in enumerate(langs) if x in model.langs and sizes[i] and model.langs[scores[i].argmax()] == x
                       and (len(whole[i]) > begin // 2)]
                own = [model.langs.index(langs[i]) for i in use]
                yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in use], pa.string()), pa.array([int(sizes[i]).bit_length() for i in use], pa.int32()),
                                                  pa.array([-scores[i, j] / sizes[i] for i, j in zip(use, own)], pa.float64())], ["lang", "size", "bits"])
    judged = on_batches(sample.filter("not _fit").select("_text", "_lang"), judge, "lang string, size int, bits double")
    judged = judged.groupBy("lang", "size").agg(F.count("bits"), F.percentile("bits", F.lit(0.5)), F.percentile("bits", F.lit(QUANTILE)))
    model.cutoffs = cutoffs(judged.collect(), _noise(model, counts))
    return model


SIZES = 40  # powers of two of a text's length
QUANTILE, MARGIN, ENOUGH = 0.95, 3.0, 20
MIXED, NEAR = 0.31, 0.6  # shares of the way from a language's usual text to evenly drawn letters: texts of two languages stay, noise goes
ODD = 60.0  # nats that a code or name within a text may cost


def _noise(model: Model, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, float]:
    """The cross-entropy of evenly drawn letters under each language's model, of those letters that make up nearly all of its text."""
    rng, out = np.random.default_rng(7), {}
    for j, lang in enumerate(model.langs):
        letters, back = np.unique(counts[lang][0][:, -1], return_inverse=True)
        n = np.bincount(back.ravel(), counts[lang][1]) * (letters != ord(" "))
        order = np.argsort(-n)
        common = order[np.cumsum(n[order]) <= 0.999 * n.sum()]
        drawn = rng.choice(letters[common if len(common) else order[:1]], 5000)
        scores, sizes = model.score(["".join(map(chr, drawn))])
        out[lang] = float(-scores[0, j] / max(1, sizes[0]))
    return out


def cutoffs(rows, noise: dict[str, float]) -> dict[str, list[float]]:
    """The largest cross-entropy accepted for each language and power of two of the length. It is the median of the calibration texts
    of that length plus ``MARGIN`` times the distance from it to their ``QUANTILE``, which single odd texts do not move, and at least
    ``MIXED`` of the way from the median of long texts to evenly drawn letters plus ``ODD`` nats over the whole text; it
    never exceeds ``NEAR`` of that way. A length without ``ENOUGH`` calibration texts takes the next shorter one that has them; where
    there is none, and for a language without calibration texts, only the cap holds."""
    out = {}
    for lang, random in noise.items():
        own = {r[1]: r for r in rows if r[0] == lang and r[2] >= ENOUGH}
        usual = own[max(own)][3] if own else random / 2
        cap, limits = usual + NEAR * (random - usual), []
        for size in range(SIZES):
            known = [k for k in own if k <= size]
            r = own[max(known)] if known else None
            least = usual + MIXED * (random - usual) + ODD / (1 << size)
            limits.append(min(cap, max(least, r[3] + MARGIN * (r[4] - r[3]))) if r else cap)
        out[lang] = limits
    return out


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id``, ``lang_pred``, ``score``, ``cross_entropy`` (nats a character), ``rejected`` and the columns in ``keep``.

    A NULL text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if there is no model. ``score`` is the
    share of the best language in the likelihoods of up to 100 characters. Whole texts are scored, long ones in parts; repeated rows and
    NULL ids stay. An empty table gives no row. Columns in ``keep`` may have any name but those of the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, texts in parts(batches, "_text"):
            langs, scores, bits, bad = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
            if known:
                logs, sizes = known.score(texts)
                some = sizes > 0
                each = logs / np.maximum(sizes, 1)[:, None]
                best = each.argmax(1)
                top = each[np.arange(len(texts)), best]
                share = 1 / np.exp((each - top[:, None]) * np.minimum(sizes, 100)[:, None]).sum(1)
                scores[some], bits[some] = share[some], -top[some]
                for i in np.flatnonzero(some):
                    langs[i] = known.langs[best[i]]
                    limit = known.cutoffs.get(langs[i])
                    bad[i] = bool(limit) and bits[i] > limit[min(int(sizes[i]).bit_length(), SIZES - 1)]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(f"_keep{i}") for i in range(len(keep) + 1)], pa.array(langs, pa.string()), pa.array(scores), pa.array(bits, from_pandas=True),
                pa.array(bad)], [id_col, *keep, "lang_pred", "score", "cross_entropy", "rejected"])
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rows = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate((id_col, *keep))], F.col(text_col).alias("_text"))
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep))
    return on_batches(rows, run, f"{columns}, lang_pred string, score double, cross_entropy double, rejected boolean")


def identify_held_out(docs: DataFrame, **options) -> DataFrame:
    """Learn from the rows outside fold 0 and predict all: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected``."""
    model = fit(docs.filter(fold(F.col("doc_id")) != 0), **options)
    out = identify(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")
