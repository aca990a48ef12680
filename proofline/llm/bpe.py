"""Ids of a byte-level BPE tokenizer for whole batches of texts at a time.

Texts are cut into chunks where the tokenizer starts a new token anyway. Arrow finds the distinct chunks of a batch, the
tokenizer sees each distinct chunk once per worker, and numpy lays the remembered ids out text by text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 22  # bytes of text that are worked on at a time
MEMO = 700_000  # chunks a worker remembers
MARK = "\x01"
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batches of about ``size`` bytes of text, with their texts (NULL as empty). A longer text is a part of its own."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        at = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // size
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)] if len(texts) else [0]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a), texts.slice(a, b - a)


class Coder:
    """Flat ids of many texts, with a memo over chunks.

    The tokenizer starts a new token at a blank after a non-blank, between a line end and a non-blank, and between a letter or
    digit and a comma or full stop; so what such chunks give one by one is what the text gives. Its special tokens hold none of these.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of text a token stands for
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.held = pa.array([], pa.binary())  # the ids of each chunk

    def _spread(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, and where each chunk's end. Ids of a byte-level tokenizer are told apart by the bytes they stand for."""
        found = self.tokenizer.encode_batch_fast([chunks], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.asarray(found.ids, np.int64)
        done = np.cumsum(self.width[ids])
        upto = np.cumsum(pc.binary_length(pa.array(chunks, pa.string())).to_numpy().astype(np.int64))
        ends = np.searchsorted(done, upto, "right")
        if not len(chunks) or np.array_equal(np.concatenate([[0], done])[ends], upto):
            return ids, ends
        found = self.tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        return np.asarray(found.ids, np.int64), np.searchsorted(np.asarray(found.word_ids), np.arange(1, len(chunks) + 1))

    def _binary(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        return binary(ids.astype(self.kind), ends)

    def _learn(self, chunks: list[str]) -> list[int]:
        """Add chunks that are not known; their numbers."""
        plain = [c for c in chunks if "<" not in c]
        special = [c for c in chunks if "<" in c]  # may hold a special token
        ids, ends = self._spread(plain)
        whole = [np.asarray(self.tokenizer.encode(c, add_special_tokens=False).ids, np.int64) for c in special]
        ends = np.concatenate([ends, len(ids) + np.cumsum([len(x) for x in whole], dtype=np.int64)])
        self.number.update(zip(plain + special, range(len(self.held), len(self.held) + len(chunks))))
        self.held = pa.concat_arrays([self.held, self._binary(np.concatenate([ids, *whole]), ends)])
        return [self.number[c] for c in chunks] if special else list(range(len(self.held) - len(chunks), len(self.held)))

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        texts = pc.replace_substring_regex(texts, r"([\pL\pN])([,.])", rf"\1{MARK}\2")
        marked = pc.replace_substring(pc.replace_substring(texts, " ", MARK + " "), "\n", f"{MARK}\n{MARK}")
        blanks = pc.match_substring_regex(texts, f"[{WHITE}][{WHITE}]|[{WHITE}]$|^[{WHITE}]")
        if pc.any(blanks).as_py():  # where blanks meet, only the first one starts a chunk
            some = pc.replace_substring_regex(texts.filter(blanks), f"([^{WHITE}])([{WHITE}])", rf"\1{MARK}\2")
            marked = pc.replace_with_mask(marked, blanks, some)
        return pc.split_pattern(marked, MARK)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each text's followed by ``end_id``, and where each text's ids end."""
        odd = pc.match_substring(texts, MARK)
        if pc.any(odd).as_py():  # texts that hold the mark itself
            parts, rest = [], odd.to_numpy(zero_copy_only=False)
            for i, text in enumerate(texts):
                if rest[i]:
                    ids = np.asarray(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, self.kind)
                    parts.append(ids if end_id is None else np.append(ids, self.kind.type(end_id)))
                else:
                    parts.append(self.encode(texts.slice(i, 1), end_id)[0])
            return np.concatenate(parts), np.cumsum([len(p) for p in parts])
        lists = self._cut(texts)
        coded = lists.flatten().dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        if len(self.number) > MEMO:
            self._reset()
        places = np.fromiter(map(self.number.get, kinds, repeat(-1)), np.int64, len(kinds))
        fresh = np.flatnonzero(places < 0)
        if len(fresh):
            places[fresh] = self._learn([kinds[i] for i in fresh.tolist()])
        here = self.held.take(pa.array(places))
        chunks, upto = coded.indices.to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))
        if end_id is not None:
            here = pa.concat_arrays([here, self._binary(np.array([end_id]), np.array([1]))])
            chunks = np.insert(chunks, upto, len(kinds))
            upto = upto + np.arange(1, len(upto) + 1)
        _, offsets, data = here.take(pa.array(chunks)).buffers()
        ends = np.frombuffer(offsets, np.int32)[upto].astype(np.int64) // self.kind.itemsize
        return np.frombuffer(data, self.kind)[:ends[-1] if len(ends) else 0], ends


def binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids of each text as bytes."""
    offsets = np.append(0, ends * ids.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])


KEPT: dict[str, Coder] = {}  # of the worker process; tasks reach it through the two functions below


def coder(path: str) -> Coder:
    """One coder per worker process and file."""
    if path not in KEPT:
        KEPT[path] = Coder(path)
    return KEPT[path]


def forget() -> None:
    """Give the memory of the worker's coders back."""
    KEPT.clear()
