"""Exact encoding of texts with a merge-type SentencePiece model, by backtracking instead of by merging.

A sequence of pieces is the model's encoding exactly if every two adjacent pieces are what merging their joined text
gives. So the encoder walks along a word with the longest piece that starts at each place (an Aho-Corasick automaton),
steps back to shorter ones where two pieces aren't compatible, and keeps a bit field of places known to fail.
Pieces never hold a space sign after another sign, so texts are cut into words there; words are kept in a memo.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, text_slices

SPACE = "▁"
#: Words and pairs that a worker keeps at most; then it starts anew.
MEMO = 700_000


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> "PieceEncoder":
    return PieceEncoder(path)


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback, a dummy prefix and no normaliser are supported")
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(p.type == kinds.USER_DEFINED for p in model.pieces) or any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces with an inner space sign or set by the user are not supported")
        self.ids = {p: i for p, (i, _) in normal.items()}
        self.scores = {p: s for p, (_, s) in normal.items()}
        self.bytes = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in self.ids:
            automaton.add_word(p)
        automaton.make_automaton()
        self.automaton = automaton
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.library.bos_id(), self.library.eos_id()))
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """The model's merging itself: the best-scored pair of neighbours that makes a piece, the leftmost of equals, again and again."""
        parts: list[str | None] = list(text)
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        scores, heap = self.scores, []

        def push(i: int) -> None:
            j = after[i]
            if j >= 0 and (s := scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i] + parts[j], j))

        for i in range(len(parts) - 1):
            push(i)
        while heap:
            _, i, joined, j = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or parts[i] + (parts[j] or "") != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [p for p in parts if p is not None]

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the joined text of two pieces leaves just these two."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self.merge(a + b) == [a, b]
        return known

    def backtrack(self, word: str) -> list[str]:
        """Pieces of a word all of whose signs are pieces."""
        n = len(word)
        if n == 1:
            return [word]
        if word in self.ids and self.merge(word) == [word]:
            return [word]
        ids = self.ids
        # the longest piece from each place, by the automaton's matches
        longest = [1] * n
        for end, length in self.automaton.iter(word):
            start = end - length + 1
            if length > longest[start]:
                longest[start] = length
        failed = bytearray(n + 1)
        found: list[str] = []
        at, length = 0, longest[0]
        fits = self.fits
        while at < n:
            piece = word[at : at + length]
            if not failed[at + length] and (not found or fits(found[-1], piece)):
                found.append(piece)
                at += length
                if at < n:
                    length = longest[at]
                continue
            length -= 1
            while length and word[at : at + length] not in ids:
                length -= 1
            while not length:
                # nothing fits from here: this place fails, and the piece before it must be shorter
                failed[at] = 1
                last = found.pop()
                at -= len(last)
                length = len(last) - 1
                while length and word[at : at + length] not in ids:
                    length -= 1
        return found

    def encode_word(self, word: str) -> bytes:
        """Ids of a word (space signs, then other signs). A sign that is no piece becomes its bytes' pieces; nothing merges across it."""
        ids, out, run = self.ids, [], []
        for c in word:
            if c in ids:
                run.append(c)
                continue
            if run:
                out += [ids[p] for p in self.backtrack("".join(run))]
                run = []
            out += [self.bytes[f"<0x{b:02X}>"] for b in c.encode()]
        if run:
            out += [ids[p] for p in self.backtrack("".join(run))]
        return array("I", out).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit bytes."""
        if len(self.words) > MEMO:
            self.words.clear()
        if len(self.pairs) > MEMO:
            self.pairs.clear()
        # words by single spaces; runs of spaces, space signs in a text and line ends inside words are told apart below
        cut = [_words(t) for t in texts]
        words = self.words
        for w in set(chain.from_iterable(cut)).difference(words):
            words[w] = self._lines(w)
        get = words.__getitem__
        return [self.begin + b"".join(map(get, c)) + self.end for c in cut]

    def _lines(self, word: str) -> bytes:
        """encode_word, by way of the memo for the parts between line ends (a line end is no piece)."""
        if "\n" not in word or "\n" in self.ids:
            return self.encode_word(word)
        newline, words, out = np.array([self.bytes["<0x0A>"]], "<u4").tobytes(), self.words, []
        for k, part in enumerate(word.split("\n")):
            if k:
                out.append(newline)
            if part:
                if part not in words:
                    words[part] = self.encode_word(part)
                out.append(words[part])
        return b"".join(out)


def _words(text: str) -> list[str]:
    """A text with its dummy space, cut before each run of spaces; spaces appear as the space sign. An empty text has no words."""
    if not text:
        return []
    signed = SPACE + text.replace(" ", SPACE)
    parts = signed.replace(SPACE, "\0" + SPACE).split("\0") if "\0" not in signed else None
    if parts is not None and SPACE not in parts:
        return parts[1:]
    # runs of spaces stay together with the word they lead
    out, start = [], 0
    for i in range(1, len(signed)):
        if signed[i] == SPACE and signed[i - 1] != SPACE:
            out.append(signed[start:i])
            start = i
    return [*out, signed[start:]]


def encode_decode(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids and decoded.

    A null text is empty (begin and end alone). Null and repeated doc_ids are kept as they are; other columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(model_path)
        for batch in batches:
            for part in text_slices(batch):
                coded = coder.encode(part.column("text").to_pylist())
                lists = [np.frombuffer(c, "<i4").tolist() for c in coded]
                decoded = coder.library.decode(lists) if lists else []
                cols = [part.column("doc_id"), pa.array([len(x) for x in lists], pa.int64())]
                cols += [pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string())]
                if with_ids:
                    cols += [pa.array(lists, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names)

    return documents(docs).withColumn("text", F.coalesce("text", F.lit(""))).mapInArrow(run, schema)
