"""Encoding of whole texts to token ids, exactly as the tokenizer's library gives them, at the cost of distinct words.

A vocabulary file of the word kind drops white space and never lets a token cross it, so a text's ids are its words' ids one
after another. ``WordEncoder`` asks the library once for each distinct word and assembles texts from the memo in numpy.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import blocks, is_space, text_buffers
from .wordtable import Ragged, WordTable

#: Words joined for one call of the library.
_JOINED = 400


def drops_white_space(path: str) -> bool:
    """Whether a tokenizers file splits texts into matches that never hold white space, and drops the rest."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        pre = json.load(f).get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    plain = pattern.replace(r"[^\s", "")
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and r"\s" not in plain and " " not in plain and r"[^\s" in pattern


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER, _STOP, _KEEPS_CASE = np.zeros((3, 256), bool)
_LETTER[97:123] = True
_STOP[[ord("."), ord(",")]] = True
_KEEPS_CASE[[ord("<"), 0xCC, 0xCD]] = True  # the lead bytes of U+0300 to U+036F


class WordEncoder:
    """Ids of texts by a tokenizers file for which ``drops_white_space`` holds.

    Special strings in a text become their ids, as is the library's default: they hold no white space, so they stay in a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        if not drops_white_space(path):
            raise ValueError(f"{path}: tokens may cross white space")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.joins = bool(suffix)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Case and full stops may only be split off where no special string can be broken by it.
        self.plain = all("<" in t for t in added) and self._lowers(path)
        self.words, self.ids = WordTable(), Ragged()

    @staticmethod
    def _lowers(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            norm = json.load(f).get("normalizer") or {}
        return any(x.get("type") == "Lowercase" for x in norm.get("normalizers", [norm]))

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (rows, ids, ids of each row's part in this block); rows come in order, a long row in several blocks."""
        data, offsets = text_buffers(column)
        for begin, end, rows, starts in blocks(data, offsets):
            ids, per_word, first, stop = self._block(data[begin:end], starts - begin)
            parts = np.searchsorted(first, np.append(starts - begin, end - begin), "left")
            sums = np.concatenate([[0], np.cumsum(per_word)])
            yield rows, ids, np.diff(sums[parts])

    def encode_with_spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, begins, ends) of each text; begins and ends are the characters at which each id's word begins and ends."""
        column = pa.array(texts, pa.string())
        data, offsets = text_buffers(column)
        found: list[list[tuple]] = [[] for _ in texts]
        for begin, end, rows, starts in blocks(data, offsets):
            text = data[begin:end]
            ids, per_word, first, stop = self._block(text, starts - begin)
            bounds = np.append(starts - begin, len(text))
            words, sums = np.searchsorted(first, bounds, "left"), np.concatenate([[0], np.cumsum(per_word)])
            place = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)]) if (text >= 0x80).any() else np.arange(len(text) + 1)  # characters before each byte
            first, stop = (np.repeat(place[x], per_word) for x in (first, stop))
            for r, a, b, at, size in zip(rows.tolist(), sums[words[:-1]].tolist(), sums[words[1:]].tolist(), place[bounds[:-1]].tolist(), np.diff(place[bounds]).tolist(), strict=True):
                before = found[r][-1][3] if found[r] else 0
                found[r].append((ids[a:b], first[a:b] - at + before, stop[a:b] - at + before, before + size))
        return [parts[0][:3] if len(parts) == 1 else tuple(np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in range(3)) for parts in found]

    def _block(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        space = is_space(data)
        new_row = np.zeros(len(data) + 1, bool)
        new_row[starts] = True
        before = np.concatenate([[True], space[:-1]])[: len(data)] | new_row[:-1]  # white space or the row's start stands before
        begins = ~space & before
        raw = data
        if self.plain:
            data = _LOWER[data]
            letter = _LETTER[data]
            stops = np.flatnonzero(_STOP[data])
            after = np.append(space, True) | new_row
            if len(stops):
                stops = stops[after[stops + 1] & ~before[stops] & letter[stops - 1]]
                begins[stops] = True
        inside = ~space
        first = np.flatnonzero(begins)
        stop = np.flatnonzero(np.append(inside, False)[:-1] & (np.append(begins, True)[1:] | np.append(space, True)[1:] | new_row[1:])) + 1
        if self.plain:  # a special string in another case is none; some marks compose with lower-case letters only
            for i in np.unique(np.searchsorted(first, np.flatnonzero(_KEEPS_CASE[raw]), "right") - 1).tolist():
                data[first[i] : stop[i]] = raw[first[i] : stop[i]]
        index, new, cleared = self.words.indices(data, first, stop)
        if cleared:
            self.ids.clear()
        if new:
            self.ids.extend(*self._ask(new))
        ids, per_word = self.ids.take(index)
        return ids, per_word, first, stop

    def _ask(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, ids of each word, and the order in which the words' ids stand."""
        texts = [w.decode() for w in words]
        alpha = np.array([self.joins and t.isalpha() for t in texts])
        letters, others = np.flatnonzero(alpha).tolist(), np.flatnonzero(~alpha).tolist()
        flats, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        order: list[int] = []
        groups = [letters[k : k + _JOINED] for k in range(0, len(letters), _JOINED)]
        for own, e in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(texts[i] for i in own) for own in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1  # a run of letters is one word of the model, and its last token says so
            if len(cuts) != len(own) or cuts[-1] != len(ids):
                others += own
                continue
            flats.append(ids)
            counts[own] = np.diff(cuts, prepend=0)
            order += own
        for i, e in zip(others, self.tokenizer.encode_batch_fast([texts[i] for i in others], add_special_tokens=False), strict=True):
            flats.append(np.array(e.ids, np.uint32))
            counts[i] = len(e.ids)
        return np.concatenate(flats), counts, np.array(order + others, np.int64)
