"""Tokenizing whole texts fast: each distinct word is encoded once per worker, then looked up."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids a worker remembers; beyond it the memory is emptied and filled anew (ids don't change).
CACHE_WORDS = 600_000
#: Punctuation between a letter and white space is a word of its own to the tokenizer, so it is set apart.
_ENDING = r"""(\pL)([.,;:!?*#%&$|)"]+)(\s|$)"""
#: Words of these letters alone are one piece for any letter-run splitter, and already in composed form.
_PLAIN = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}


# The normalizer and splitter for which a text's ids are its words' ids in turn.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """Ids of whole texts by a tokenizer.

    For one that drops white space and lower-cases a text's ids are its words' ids in turn, and a distinct word
    is encoded once; its file must say so in the very terms known here. Texts of any other tokenizer, and
    those with "<|", which may hold special tokens, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.by_word = rules.get("normalizer") == _NORMALIZER and rules.get("pre_tokenizer") == _SPLITTER and rules["model"].get("type") == "BPE"
        self.model, self.letters = self.tok.model, _byte_letters()
        self._reset()

    def _reset(self):
        self.word: dict[str, int] = {}
        self.start, self.size, self.flat = array("q"), array("q"), array("I")

    def _learn(self, words: list[str]):
        """Plain words go straight to the model, as normalizing and splitting change nothing in them."""
        tokenize, odd = self.model.tokenize, []
        for w in words:
            if w.isascii() and w.isalpha():
                self._keep(w, [t.id for t in tokenize(w)])
            elif _PLAIN.fullmatch(w):
                self._keep(w, [t.id for t in tokenize("".join([self.letters[b] for b in w.lower().encode()]))])
            else:
                odd.append(w)
        if odd:
            for w, e in zip(odd, self.tok.encode_batch(odd, add_special_tokens=False), strict=True):
                self._keep(w, e.ids)

    def _keep(self, word: str, ids: list[int]):
        self.word[word] = len(self.start)
        self.start.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)

    def _indices(self, words: list[str]) -> np.ndarray:
        if len(self.word) > CACHE_WORDS:
            self._reset()
        self._learn([w for w in words if w not in self.word])
        return np.fromiter(map(self.word.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]]; null has none."""
        # take() makes a copy without an offset: Arrow's string kernels misread sliced arrays.
        texts = pc.fill_null(texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts)))), "")
        if not self.by_word:
            each = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
        odd = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        whole = {i: np.array(self.tok.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in odd}
        if len(odd):
            keep = np.ones(len(texts), bool)
            keep[odd] = False
            texts = pc.if_else(pa.array(keep), texts, pa.scalar("", pa.large_string()))
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _ENDING, r"\1 \2\3"))
        bounds = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        index = self._indices(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        start, size, flat = (np.frombuffer(a, t) if len(a) else np.zeros(0, t) for a, t in ((self.start, np.int64), (self.size, np.int64), (self.flat, np.uint32)))
        sizes = size[index] if len(index) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(start[index] - ends[:-1], sizes) + np.arange(ends[-1])] if ends[-1] else np.zeros(0, np.uint32)
        offsets = ends[bounds - bounds[0]]
        del start, size, flat
        if len(odd):
            each = [whole[i] if i in whole else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            ids, offsets = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, offsets


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
