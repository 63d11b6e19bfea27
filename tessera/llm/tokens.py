"""Token ids of whole texts by a public tokenizer file, with each distinct word encoded once."""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import strings


def _letters_before_marks() -> str:
    """A character class of the Latin, Greek and Cyrillic letters that are still one letter at their end when composed
    and in lower case. (The dotted capital I ends in a combining mark, which joins with a full stop after it.)"""
    fine = []
    for c in map(chr, range(0x530)):
        if unicodedata.category(c)[0] == "L" and unicodedata.category(unicodedata.normalize("NFC", c).lower()[-1])[0] == "L":
            fine.append(rf"\x{{{ord(c):x}}}")
    return f"[{''.join(fine)}]"


class WordTokenizer:
    """Ids exactly as the tokenizers library gives for the whole text.

    The file's normaliser composes and lowers letters and its pre-tokenizer never joins characters across white
    space, nor a letter with a mark that follows it. So ASCII letters are lowered at once, a text is cut at plain
    spaces, line feeds and between a letter and a full stop or comma (all else stays inside the parts, for the
    library to handle), equal parts are encoded once, and the ids are laid end to end. About two generations of
    `known_words` parts, or 64 bytes for each of them, are remembered; parts still in use outlive a change.
    """

    def __init__(self, path: str, known_words: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), known_words
        # part: its number; the ids of number k are flat[first[k] : first[k + 1]]
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.flat, self.first, self.held = np.zeros(1 << 20, np.int32), np.zeros(1 << 16, np.int64), 0
        self.old_flat, self.old_first = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.cut = rf"({_letters_before_marks()})([.,])"
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for w, k in vocabulary.items() if w.endswith("</w>")]] = True

    def _add(self, parts: list[str], size: np.ndarray, ids: np.ndarray) -> None:
        n, used = len(self.new), int(self.first[len(self.new)])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(parts) >= len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.flat[used : used + len(ids)] = ids
        self.first[n + 1 : n + 1 + len(parts)] = used + np.cumsum(size)
        self.new.update(zip(parts, range(n, n + len(parts))))
        self.held += sum(map(len, parts))

    def _learn(self, parts: list[str]) -> None:
        """Parts of letters only are encoded together: each must come out as one piece, with one end of word."""
        plain, other = [w for w in parts if w.isalpha()], [w for w in parts if not w.isalpha()]
        for a in range(0, len(plain), 1024):
            some = plain[a : a + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(some):
                self._add(some, np.diff(at, prepend=0), ids)
            else:
                other += some
        for a in range(0, len(other), 256):
            got = [x.ids for x in self.tokenizer.encode_batch_fast(other[a : a + 256], add_special_tokens=False)]
            self._add(other[a : a + 256], np.array([len(x) for x in got], np.int64), np.array([i for x in got for i in x], np.int32))

    def _numbers(self, parts: list[str]) -> np.ndarray:
        """The numbers of distinct parts."""
        if len(self.new) > self.most or self.held > 64 * self.most:
            n = len(self.new)
            self.old, self.old_first, self.old_flat = self.new, self.first[: n + 1].copy(), self.flat[: self.first[n]].copy()
            self.new, self.held = {}, 0
            if len(self.flat) > 1 << 24:  # room that a very long part asked for
                self.flat, self.first = np.zeros(1 << 20, np.int32), np.zeros(1 << 16, np.int64)
        if missing := [w for w in parts if w not in self.new]:
            if known := [w for w in missing if w in self.old]:
                k = np.array([self.old[w] for w in known])
                size = self.old_first[k + 1] - self.old_first[k]
                self._add(known, size, self.old_flat[np.repeat(self.old_first[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
                missing = [w for w in missing if w not in self.new]
            self._learn(missing)
        return np.fromiter(map(self.new.__getitem__, parts), np.int64, len(parts))

    def encode(self, column, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), `end` after each, and the offsets by text."""
        texts = strings(column)
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else lower case could make a special token
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), self.cut, r"\1 \2")
        lists = pc.split_pattern(texts, " ")
        parts = lists.flatten().dictionary_encode()
        numbers = self._numbers(parts.dictionary.to_pylist())[parts.indices.to_numpy(zero_copy_only=False)]
        size = self.first[numbers + 1] - self.first[numbers]
        at = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.first[numbers] - at[:-1], size) + np.arange(at[-1])]
        offsets = at[lists.offsets.to_numpy(zero_copy_only=False)]
        return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))


_by_path: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer(path: str, known_words: int = 250_000) -> WordTokenizer:
    """One for each Python worker, file and memory (some 200 bytes a word, in two generations)."""
    if (path, known_words) not in _by_path:
        _by_path.clear()
        _by_path[path, known_words] = WordTokenizer(path, known_words)
    return _by_path[path, known_words]


def forget() -> None:
    _by_path.clear()
