"""Token ids of whole texts, exactly as the tokenizers library gives them, with a memo of the chunks it encodes.

A pre-tokenizer that splits on a pattern never merges across its parts, so the ids of a text are the ids of its
parts in order. Texts are cut at spaces into chunks, where the library's own pattern always cuts too. Chunks not met
before go to the library, many in one call. A text for which the cuts aren't certain goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

#: Characters that one of the engines takes for white space and the other doesn't.
DOUBTFUL = "\x00\x1c\x1d\x1e\x1f\x85"
#: White space before a space, so that the space doesn't follow a character that isn't white space.
LOOSE_ASCII = [f"{c} " for c in " \t\n\x0b\x0c\r"]
LOOSE = LOOSE_ASCII + [f"{chr(c)} " for c in range(128, 0x3001) if chr(c).isspace()]
#: Signs that end a chunk as parts of their own, if letters stand before them.
STOPS = ".,"
#: Characters beyond those whose lower case and normal form are the same in every version.
BEYOND = re.compile("[\u0130-\U0010ffff]")
#: A stop or comma that touches another mark, with which it may make one part.
TOUCHING = re.compile(r"[.,](?=[^\s\w]|_)|(?:[^\s\w]|_)[.,]")
#: A digit is a part of its own, so it can stand between chunks.
SEPARATOR = "0"
#: Chunks that a worker keeps at most; then it starts anew.
MEMO = 900_000


@lru_cache(maxsize=4)
def encoder(path: str) -> "Encoder":
    return Encoder(path)


class Encoder:
    """encode(texts) gives the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.mode = "whole"
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = pre.get("pretokenizers", [])
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.mode = "spaced"
            vocab = self.library.get_vocab(with_added_tokens=False)
            self.leads = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.leads[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        elif [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and r"|[\p{N}]|" in steps[0]["pattern"]["Regex"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
            kinds = [x["type"] for x in (norm or {}).get("normalizers", [])]
            between = self.library.encode(SEPARATOR, add_special_tokens=False).ids
            if kinds == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and len(between) == 1:
                self.mode, self.between = "bare", between[0]
        self.chunks: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, chunks: list[str]) -> None:
        """Put new chunks into the memo; all are encoded in one call and told apart by their first token or by separators."""
        if self.mode == "spaced":
            ids = self._joined("".join(chunks))
            bounds = np.append(np.flatnonzero(self.leads[ids]), len(ids))
        else:
            ids = self._joined("".join([f"{c} {SEPARATOR} " for c in chunks]))
            ends = np.flatnonzero(ids == self.between)
            bounds = np.append(0, ends - np.arange(len(ends)))
            ids = np.delete(ids, ends)
        if len(bounds) != len(chunks) + 1:
            self.chunks.update(zip(chunks, self._library(chunks)))
            return
        raw, cuts = ids.tobytes(), (bounds * 4).tolist()
        self.chunks.update(zip(chunks, [raw[i:j] for i, j in zip(cuts, cuts[1:])]))

    def _learn_spaced(self, missing: list[str]) -> None:
        """Put chunks that start with a space, or a text, into the memo. A stop after letters is a part of its own."""
        ends = {c: c[:-1] for c in missing if c[-1:] in STOPS and c[:1] == " " and c[1:-1].isalpha() and max(c) < "\u0130"}
        wanted = set(missing).difference(ends).union(x for x in ends.values() if x not in self.chunks)
        alone = [c for c in wanted if c[:1] != " "] + [c for c in STOPS if c not in self.chunks]
        spaced = [c for c in wanted if c[:1] == " "]
        if spaced:
            self._learn(spaced)
        self.chunks.update(zip(alone, self._library(alone)))
        get = self.chunks.__getitem__
        self.chunks.update((c, get(x) + get(c[-1])) for c, x in ends.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.mode == "whole":
            return self._library(texts)
        if len(self.chunks) > MEMO:
            self.chunks.clear()
        if self.mode == "spaced":
            # every space after a character that isn't white space starts a token; a chunk keeps its leading space
            cut = [None if _loose(t) or _doubtful(t) else t.replace(" ", "\0 ").split("\0") for t in texts]
            missing = list(set(chain.from_iterable(c for c in cut if c)).difference(self.chunks))
            if missing:
                self._learn_spaced(missing)
        else:
            cut = [None if _doubtful(t) else _bare_chunks(t) for t in texts]
            missing = list(set(chain.from_iterable(c for c in cut if c)).difference(self.chunks))
            alone = [c for c in missing if SEPARATOR in c]
            missing = [c for c in missing if SEPARATOR not in c]
            if missing:
                self._learn(missing)
            if alone:
                self.chunks.update(zip(alone, self._library(alone)))
        get = self.chunks.__getitem__
        return [self._library([t])[0] if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut)]


def _doubtful(text: str) -> bool:
    return any(c in text for c in DOUBTFUL)


def _loose(text: str) -> bool:
    return text[:1] == " " or any(x in text for x in (LOOSE_ASCII if text.isascii() else LOOSE))


def _bare_chunks(text: str) -> list[str]:
    """Chunks of a text whose white space and case don't matter: fewer different ones, as case and stops are taken away."""
    if not BEYOND.search(text):
        text = text.lower()
    if not TOUCHING.search(text):
        text = text.replace(".", " . ").replace(",", " , ")
    return text.split()
