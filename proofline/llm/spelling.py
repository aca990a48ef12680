"""Spelling variants: words one edit apart, by composing the vocabulary acceptor with a one-edit transducer and itself.

The vocabulary is partitioned by initial state, the first letters of a word. Each partition is minimised to an acceptor in which
every accepted word has its number, and the composition is walked from the initial state: two copies of the acceptor read the
same letters until the transducer spends its edit, and the same letters after it. Words whose edit is among the first
letters share their last ones, so they meet in the reversed acceptor, partitioned likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from ._text import on_batches

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST = 20_000  # words of one initial state that are composed by one task
FOUND = "word string, n long, n_near long, near_n long, near string"


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words. ``arcs[s]`` maps a letter to the next state and to the number of
    words of ``s`` that come before those through this arc; ``final[s]`` tells whether ``s`` ends a word."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        # the path of the last word: each entry holds the letter that led there, whether it is final, and its finished arcs
        path: list[list] = [["", False, []]]

        def finish(depth: int) -> int:
            state = -1
            while len(path) > depth:
                letter, final, arcs = path.pop()
                key = (final, *arcs)
                state = known.get(key, -1)
                if state < 0:
                    state = known[key] = len(self.arcs)
                    out, before = {}, int(final)
                    for a, s in arcs:
                        out[a] = s, before
                        before += self.size[s]
                    self.arcs.append(out)
                    self.final.append(final)
                    self.size.append(before)
                if path:
                    path[-1][2].append((letter, state))
            return state

        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            finish(same + 1)
            for letter in word[same:]:
                path.append([letter, False, []])
            path[-1][1] = True
            last = word
        self.start = finish(0)

    def _shared(self, s: int, t: int, known: dict) -> list[tuple[int, int]]:
        """The numbers, in each of two states, of the words both accept."""
        if (s, t) in known:
            return known[s, t]
        out, todo = [], [(s, t, 0, 0)]
        while todo:
            a, b, i, j = todo.pop()
            if self.final[a] and self.final[b]:
                out.append((i, j))
            arcs, others = self.arcs[a], self.arcs[b]
            for letter in arcs if len(arcs) <= len(others) else others:
                if letter in arcs and letter in others:
                    (x, p), (y, q) = arcs[letter], others[letter]
                    todo.append((x, y, i + p, j + q))
        known[s, t] = out
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all accepted words that are one edit apart, each pair once.

        The edit is spent where the two words differ first: both read different letters there, or one reads a letter the
        other does not have and the other goes on with a different letter or ends.
        """
        known: dict[tuple[int, int], list[tuple[int, int]]] = {}
        left, right, todo = [], [], [(self.start, 0)]
        while todo:
            s, base = todo.pop()
            arcs = list(self.arcs[s].items())
            for k, (a, (x, p)) in enumerate(arcs):
                todo.append((x, base + p))
                for _, (y, q) in arcs[k + 1:]:
                    for i, j in self._shared(x, y, known):
                        left.append(base + p + i)
                        right.append(base + q + j)
                if self.final[s] and self.final[x]:
                    left.append(base)
                    right.append(base + p)
                for b, (y, q) in arcs:
                    if b != a and b in self.arcs[x]:
                        z, r = self.arcs[x][b]
                        for i, j in self._shared(y, z, known):
                            left.append(base + q + i)
                            right.append(base + p + r + j)
        return np.array(left, np.int64), np.array(right, np.int64)


def _best(words: list[str], n: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its number of partners and the number of the partner with most occurrences, ties by the word; -1 for none."""
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    near = np.bincount(left, minlength=len(words)) + np.bincount(right, minlength=len(words))
    best = np.full(len(words), len(words), np.int64)
    np.minimum.at(best, left, rank[right])
    np.minimum.at(best, right, rank[left])
    return near, np.array([order[b] if b < len(words) else -1 for b in best.tolist()], np.int64)


def _state_pairs(words: list[str], skipped: list[str], tails: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words that differ at one state: those that skip a letter there and go on alike, and one that skips none."""
    left, right = [], []
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            a, b = skipped[i], skipped[j]
            if a != b and (a and b or not tails[i] or (a or b) != tails[i][0]):
                left.append(i)
                right.append(j)
    return np.array(left, np.int64), np.array(right, np.int64)


def _compose(half: int):
    """Rows per word of the pairs found in each group of rows: forward ("f") or reversed ("r") initial states, or one state ("s")."""
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
        key, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("kind", "key", "path", "word", "n"))):
                if row[:2] != key:
                    if rows:
                        yield key[0], rows
                    key, rows = row[:2], []
                rows.append(row[2:])
        if rows:
            yield key[0], rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, names = [], ["word", "n", "n_near", "near_n", "near"]

        def flush() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names)

        for kind, rows in groups(batches):
            if len(rows) < 2:
                continue
            words, n = [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)
            if kind == "s":
                skips = [int(r[0][0]) for r in rows]  # 1: a letter is skipped, which comes first in the path
                left, right = _state_pairs(words, [r[0][1:1 + k] for r, k in zip(rows, skips)], [r[0][1 + k:] for r, k in zip(rows, skips)])
            else:
                left, right = Acceptor([r[0] for r in rows]).pairs()
            if kind == "r" and len(left):  # pairs with the same first letters are found forward
                heads = np.unique([w[:half] for w in words], return_inverse=True)[1]
                other = heads[left] != heads[right]
                left, right = left[other], right[other]
            if not len(left):
                continue
            near, best = _best(words, n, left, right)
            for i in np.flatnonzero(near).tolist():
                out.append((words[i], int(n[i]), int(near[i]), int(n[best[i]]), words[best[i]]))
            if len(out) >= 10_000:
                yield flush()
                out = []
        yield flush()
    return run


def _states(words: DataFrame, places: range) -> DataFrame:
    """A row for each word and state at one of ``places``, keyed by what is read before it and after the edit: the word as it is, and
    with the letter there skipped."""
    def at(k: int) -> Column:
        head, letter, tail = F.substring("word", 1, k), F.substring("word", k + 1, 1), F.substring("word", k + 2, 1 << 30)
        here = F.struct(F.concat(F.lit(f"{k}|"), head, F.lit("|"), tail).alias("key"), F.concat(F.lit("1"), letter, tail).alias("path"))
        rest = F.substring("word", k + 1, 1 << 30)
        whole = F.struct(F.concat(F.lit(f"{k}|"), head, F.lit("|"), rest).alias("key"), F.concat(F.lit("0"), rest).alias("path"))
        return F.when(F.length("word") > k, F.array(here, whole)).when(F.length("word") == k, F.array(whole)).otherwise(F.array())
    every = words.select("word", "n", F.explode(F.flatten(F.array(*[at(k) for k in places]))).alias("_at"))
    return every.select(F.lit("s").alias("kind"), "_at.key", "_at.path", "word", "n")


def _split(words: DataFrame, key: Column, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Words of initial states that one task can hold, and the others if there are any."""
    keyed = words.withColumn("key", key)
    large = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > most).select("key"), "large")
    if large.isEmpty():
        return keyed, None
    return keyed.join(large, "key", "left_anti"), keyed.join(large, "key", "left_semi").drop("key")


def one_edit(words: DataFrame, min_chars: int = 6, most: int = MOST) -> DataFrame:
    """``word``, ``n_near`` and, by largest ``n`` and then by code point, ``near`` and ``near_n``, for words one edit from another.

    ``words`` has distinct ``word`` of at least ``min_chars`` (2 or more) code points and ``n``. Words with one edit between them share
    their first or their last ``min_chars`` // 2 letters. An initial state of more than ``most`` words is divided: the states just
    behind it are keyed one by one, and longer beginnings become the initial states.
    """
    half = min_chars // 2
    shape = ["kind", "key", "path", "word", "n"]
    parts, rest, depth = [], words.select("word", "n"), half
    while rest is not None:
        few, rest = _split(rest, F.substring("word", 1, depth), most)
        parts.append(few.select(F.lit("f").alias("kind"), "key", F.col("word").alias("path"), "word", "n"))
        if rest is not None:
            rest = cut(rest, "divided")
            parts.append(_states(rest, range(depth, depth + 3)))
            rest, depth = rest.filter(F.length("word") >= depth + 3), depth + 3
    few, rest = _split(words.select("word", "n"), F.substring("word", -half, half), most)
    parts.append(few.select(F.lit("r").alias("kind"), "key", F.reverse("word").alias("path"), "word", "n"))
    if rest is not None:
        parts.append(_states(rest, range(half)))
    every = parts[0].select(shape)
    for part in parts[1:]:
        every = every.unionByName(part.select(shape))
    dealt = every.repartition("kind", "key").sortWithinPartitions("kind", "key", "path")
    found = on_batches(dealt, _compose(half), FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("_best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("_best.w").alias("near"), (-F.col("_best.m")).alias("near_n"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6, min_n: int = 5,
               slip: int | None = 199) -> DataFrame:
    """``word`` and ``n`` of the words in all texts: runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased.

    Where ``slip`` divides the CRC-32 of "<id>:<run>", the run loses the code point at that number modulo its length; a row
    with a NULL id loses none.
    """
    run = F.translate(F.col("_run"), UPPER, LOWER)
    runs = docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(LETTERS), F.lit(0))).alias("_run"))
    runs = runs.filter(F.length("_run") >= min_chars).select("_id", run.alias("word"))
    if slip:
        h = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
        at = F.pmod(h, F.length("word")).cast("int")
        cropped = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(F.pmod(h, F.lit(slip)) == 0, cropped).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= min_chars)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)


def spelling_variants(words: DataFrame, min_chars: int = 6, factor: int = 5, most: int = MOST) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for each row of ``words`` (distinct ``word`` and ``n``).

    ``form`` is the word one edit away (a code point inserted, deleted or replaced) with the largest ``n``, the first in
    code-point order of those that tie, if that is at least ``factor`` times the word's own; else NULL, and so is ``form_n``.
    ``root`` is reached from the word by following forms to the last. Empty input gives no row. Words may be of any length.
    """
    words = cut(words.select("word", "n"), "vocabulary")
    near = one_edit(words, min_chars, most)
    holds = F.col("near_n") >= factor * F.col("n")
    formed = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(holds, F.col("near")).alias("form"), F.when(holds, F.col("near_n")).alias("form_n")), "forms")
    roots = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the way covered; a form has several times the occurrences, so ways are short
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut(roots.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
