"""Small vectorised helpers on batches of texts, used inside tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MEMO = 400_000  # chunks a worker remembers
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CHUNK = 1 << 19  # characters that are worked on at a time
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
BASE = 0x9E3779B97F4A7C15 | 1


def on_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package even where the driver found it on its own path only.

    Unless the session says otherwise, rows reach the workers in batches of ``BATCH_BYTES``: a partition of long texts as one
    batch would lie in memory several times, on both sides.
    """
    if df.sparkSession.conf.get(BATCH, None) is None:
        df.sparkSession.conf.set(BATCH, BATCH_BYTES)
    known = df.sparkSession.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known.get("PYTHONPATH", "")]))
    return df.mapInArrow(run, schema)


class Chunks:
    """Results by chunk of text, remembered within a worker process; ``learn`` finds them for chunks not seen before.

    A text is cut before each space and line end that follows a non-blank. Where two blanks meet, ``whole`` cuts it.
    """

    TWO_BLANKS = re.compile(r"\s\s|\x01|\s\Z")

    def __init__(self, learn: Callable[[list[str]], list], whole: Callable[[str], list[str]]):
        self.learn, self.whole, self.memo = learn, whole, {}

    def cut(self, text: str) -> list[str]:
        if self.TWO_BLANKS.search(text):
            return self.whole(text)
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")

    def find(self, texts: list[str]) -> list[list]:
        """The results of each text's chunks."""
        cuts = [self.cut(t) for t in texts]
        seen = set().union(*cuts)
        if len(self.memo) > MEMO:  # go on with what is in use
            self.memo = {c: self.memo[c] for c in seen if c in self.memo}
        memo = self.memo
        fresh = [c for c in seen if c not in memo]
        if fresh:
            memo.update(zip(fresh, self.learn(fresh)))
        return [[memo[c] for c in chunks] for chunks in cuts]

    def each(self, chunks: Iterable[str]) -> None:
        """Learn the chunks that are not known."""
        fresh = list({c for c in chunks if c not in self.memo})
        if fresh:
            self.memo.update(zip(fresh, self.learn(fresh)))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts(batches: Iterable[pa.RecordBatch], text: str, size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of about ``size`` characters, with their texts (NULL as empty)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        begin, held = 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > size:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, held = i, 0
            held += len(t)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def _tables(n: int, kept: dict = {}) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    if not kept or len(kept["up"]) < n:
        size = 1 << max(16, int(n).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            out = np.empty(size, np.uint64)
            out[0], have, step = 1, 1, base
            while have < size:
                out[have:2 * have] = out[:have] * np.uint64(step)
                have, step = 2 * have, step * step & 0xFFFFFFFFFFFFFFFF
            kept[name] = out
    return kept["up"], kept["down"]


def _letters(kept: list = []) -> tuple[np.ndarray, np.ndarray]:
    if not kept:
        word = np.zeros(256, bool)
        word[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
        kept += [word, mix(np.arange(256, dtype=np.uint64), 7)]
    return kept[0], kept[1]


def _spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = _letters()[0][raw]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(texts: list[str], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A 64-bit hash for each word of the lower-cased texts, the number of words of each text, and a hash of each word's
    first bytes for each length in ``prefixes`` (of the whole word where it is shorter).

    A word is a run of ASCII letters, digits, underscores and non-ASCII characters. Long inputs are cut between words.
    """
    value = _letters()[1]
    coded = [t.lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    begins = np.cumsum([0, *[len(c) + 1 for c in coded]])
    starts, ends = _spans(raw)
    counts = np.diff(np.searchsorted(starts, begins))
    hashes = np.empty(len(starts), np.uint64)
    heads = [np.empty(len(starts), np.uint64) for _ in prefixes]
    done = 0
    while done < len(starts):
        low = int(starts[done])
        upto = max(done + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        high = int(ends[upto - 1])
        up, down = _tables(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(value[raw[low:high]] * up[:high - low], out=total[1:])
        s, e = starts[done:upto] - low, ends[done:upto] - low
        hashes[done:upto] = mix((total[e] - total[s]) * down[s], 1)
        for head, n in zip(heads, prefixes):
            head[done:upto] = mix((total[np.minimum(e, s + n)] - total[s]) * down[s], 2 + n)
        done = upto
    return hashes, counts, heads
