"""SentencePiece models on the tokenizers library: the model file is parsed, its normaliser, marker, scores and byte
fallback are rebuilt, and every distinct chunk is checked against the sentencepiece library."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._text import MEMO, Chunks, on_batches, parts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the public model format
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    def varint(at):
        out = shift = 0
        while True:
            b = raw[at]
            out |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return out, at
    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = raw[at:at + size], at + size
        yield tag >> 3, value


class Model:
    """What a model file says: pieces with scores and types, kind, normaliser and flags."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            top = list(_fields(file.read()))
        self.pieces: list[tuple[str, float, int]] = []
        for number, raw in top:
            if number == 1:
                one = dict(_fields(raw))
                score = float(np.frombuffer(one.get(2, b"\0\0\0\0"), "<f4")[0])
                self.pieces.append((one.get(1, b"").decode(), score, one.get(3, NORMAL)))
        trainer = dict(_fields(next((r for n, r in top if n == 2), b"")))
        rules = dict(_fields(next((r for n, r in top if n == 3), b"")))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = rules.get(2, b"")
        self.dummy_prefix = bool(rules.get(3, 1))
        self.one_blank = bool(rules.get(4, 1))
        self.unk = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def tokenizer(self):
        """The same model for the tokenizers library."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers
        if self.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk, self.byte_fallback)
        elif self.kind == BPE:
            ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            joins = []
            for p, s, t in self.pieces:
                if t in (NORMAL, USER, UNUSED):
                    joins += [(-s, ids[p], ids[p[:k]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
            core = models.BPE(ids, [j[3:] for j in sorted(joins)], unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model kind {self.kind} is neither unigram nor BPE")
        out = Tokenizer(core)
        rules = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.one_blank:
            rules += [normalizers.Strip(True, True), normalizers.Replace(Regex(" {2,}"), " ")]
        rules += [normalizers.Prepend(MARK)] if self.dummy_prefix else []
        out.normalizer = normalizers.Sequence([*rules, normalizers.Replace(" ", MARK)])
        users = [AddedToken(p, normalized=True, special=False) for p, _, t in self.pieces if t == USER]
        if users:
            out.add_tokens(users)
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence(steps + ([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []))
        return out

    def neighbours(self) -> set[str]:
        """Pairs of characters that stand side by side in some piece; no merge crosses any other pair."""
        return {p[i:i + 2] for p, _, t in self.pieces if t in (NORMAL, USER, UNUSED) for i in range(len(p) - 1)}

    def may_be_cut(self) -> bool:
        """Blanks stay as they are and no piece runs from another character into a blank or line end, or on from a line end."""
        plain = not self.charsmap and not self.one_blank and self.dummy_prefix and self.kind == BPE
        return plain and not any(x[0] == "\n" or x[1] == "\n" or (x[1] == MARK and x[0] != MARK) for x in self.neighbours())


def joined(found: list) -> bytes | tuple[bytes, bool, bool]:
    """Results put together. A result is the ids alone where the library agrees and decoding gives the text back, which keeps
    the memo small; else the ids and the two flags."""
    try:
        return b"".join(found)
    except TypeError:
        full = [f if isinstance(f, tuple) else (f, True, True) for f in found]
        return b"".join([f[0] for f in full]), all(f[1] for f in full), all(f[2] for f in full)


class Coder:
    """Ids by the rebuilt tokenizer; for a model that may be cut at blanks with a memo over chunks, else text by text.

    For each chunk it also keeps whether the sentencepiece library gives the same ids, and whether decoding gives the
    chunk back.
    """

    def __init__(self, path: str, verify: bool = True):
        self.model = Model(path)
        self.tokenizer = self.model.tokenizer()
        self.cuttable = self.model.may_be_cut()
        self.inside = self.model.neighbours()
        self.other = None
        if verify:
            import sentencepiece
            self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        self.words = Chunks(self._learn_words, lambda t: [t])
        self.chunks = Chunks(self._learn, lambda t: [t])
        self.line_end = self.tokenizer.encode("\n").ids  # the marker and the line end

    def _check(self, texts: list[str]) -> list:
        mine = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]  # multithreaded
        theirs = self.other.encode(texts, num_threads=1) if self.other else mine
        back = self.tokenizer.decode_batch(mine, skip_special_tokens=False)
        ids = [np.asarray(a, "<u4").tobytes() for a in mine]
        return [i if a == b and t == c else (i, a == b, t == c) for i, t, a, b, c in zip(ids, texts, mine, theirs, back)]

    def _learn_words(self, words: list[str]) -> list:
        # a word after a line end has no marker of its own: it is encoded behind one, and the two ids before it go
        found = self._check([w[1:] if w[0] == " " else w for w in words])
        drop = 4 * len(self.line_end)
        own = lambda w, ids: ids if w[0] == " " else ids[drop - 4:] if w == "\n" else ids[drop:]
        return [(own(w, f[0]), *f[1:]) if isinstance(f, tuple) else own(w, f) for w, f in zip(words, found)]

    def _words(self, chunk: str) -> list[str]:
        """Words that start with a space, or with a line end that only stands in for what is before them."""
        out = []
        if not chunk:
            return out
        if chunk[0] == "\n":
            out = ["\n"]
            if len(chunk) == 1:
                return out
        if len(chunk) > 2 and chunk[-1] in ",." and chunk[-2:] not in self.inside:
            return [*out, chunk[:-1], "\n" + chunk[-1]]
        return [*out, chunk]

    def _learn(self, chunks: list[str]) -> list:
        if not self.cuttable:
            return self._check([c[1:] for c in chunks])
        made = [[c] if self.chunks.TWO_BLANKS.search(c) else self._words(c) for c in chunks]
        if len(self.words.memo) > MEMO:
            self.words.memo.clear()
        self.words.each(w for m in made for w in m)
        return [joined([self.words.memo[w] for w in m]) for m in made]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """Ids of each text, whether the sentencepiece library gives them too, and whether they decode to the text."""
        if self.cuttable:
            found = self.chunks.find([" " + t for t in texts])
        else:
            found = [[x] for x in self._learn([" " + t for t in texts])]
        out = []
        for text, f in zip(texts, found):
            all_of = joined(f)
            ids, same, back = all_of if isinstance(all_of, tuple) else (all_of, True, True)
            out.append((np.frombuffer(ids if text else b"", "<u4"), same, back))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


def coder(path: str, verify: bool = True, kept: dict = {}) -> Coder:
    """One coder per worker process and model."""
    if (path, verify) not in kept:
        kept[path, verify] = Coder(path, verify)
    return kept[path, verify]


def sentencepiece_encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = True) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``ids`` (little-endian, four bytes each), ``parity``.

    ``parity`` says whether the sentencepiece library gives the same ids for every chunk of the text; NULL without ``verify``.
    A NULL or empty text has no ids. Rows keep their number; ids may repeat or be NULL; other columns are dropped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(model, verify)
        for batch, texts in parts(batches, "_text"):
            found = known.encode(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(x) for x, *_ in found], pa.int64()), pa.array([x.tobytes() for x, *_ in found], pa.binary()),
                pa.array([same if verify else None for _, same, _ in found], pa.bool_())], ["doc_id", "n_tokens", "ids", "parity"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return on_batches(rows, run, "doc_id long, n_tokens long, ids binary, parity boolean")


def sentencepiece_decode(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of ids as :func:`sentencepiece_encode` writes them; NULL ids give a NULL text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(model, False)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                blobs = part.column("_ids").to_pylist()
                texts = known.decode([np.frombuffer(b or b"", "<u4") for b in blobs])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([t if b is not None else None for t, b in zip(texts, blobs)], pa.string())], ["doc_id", "text"])
    rows = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("_ids"))
    return on_batches(rows, run, "doc_id long, text string")


def sentencepiece_digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, verify and decode in one pass: ``doc_id``, ``n_tokens``, ``ids_crc32``, ``parity``, ``round_trip``.

    ``round_trip`` says whether the decoded ids are the text again (NULL text: empty).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(model)
        for batch, texts in parts(batches, "_text"):
            found = known.encode(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(x) for x, *_ in found], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x, *_ in found], pa.int64()), pa.array([same for _, same, _ in found], pa.bool_()),
                pa.array([back for *_, back in found], pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return on_batches(rows, run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")
