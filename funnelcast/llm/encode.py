"""Token ids of whole texts by the ``tokenizers`` library, with a per-worker memo of units.

BPE never merges across pre-token borders, so a text may be cut at borders that the
pre-tokenizer makes anyway, and each distinct unit needs the library only once:

* ``word_bpe`` files drop white space: units are the pieces between blanks and line feeds. No pre-token of
  theirs goes from a letter on to an ASCII sign, so a blank put there changes nothing and spares the memo
  every word's forms with signs behind it;
* ``byte_bpe`` files keep a blank with the word after it: units are stretches of the text itself, cut before
  blanks, between an ASCII letter and an ASCII digit or sign (but for the apostrophe, which may begin a
  contraction) and before a line feed that follows an ASCII sign or letter. A cut before
  a blank that touches other white space would not be such a border; texts holding one are
  encoded whole.

Texts that hold one of the file's control strings go to the library whole, too: it takes the string for the control
token, as a plain call does.

New units without further white space of a ``byte_bpe`` file go to the library many in one text: each unit's
first token is then the only one that begins with a blank, which tells where its ids begin.

The memo is bounded (``MEMO`` units). When it is full, units that were not met since the last time are
forgotten, which changes time only.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words

MEMO = 400_000
JOINED = 500
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_BLANK_LED = re.compile(r" \S+")
_ODD_SPACE = "[\\t\\r\\v\\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: One run of Latin letters: a pre-token that needs no library call to find.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SIGNED = "([A-Za-z])([.,;:!?])"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII digits and signs but for the apostrophe.
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalpha() and chr(c) != "'"]] = True
_SHOWN = np.zeros(256, bool)
_SHOWN[33:127] = True


def _byte_letters() -> dict[int, str]:
    """Latin letters beyond ASCII in the byte alphabet of byte-level BPE (printable bytes stand for themselves)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    alphabet = {b: chr(b if b in shown else next(other)) for b in range(256)}
    return {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Encoder:
    """Encodes string columns; ``flat`` holds the ids of all memoised units one after another."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.drops_space = (spec.get("pre_tokenizer") or {}).get("type") == "Sequence"
        self.letters = _byte_letters()
        controls = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
        self.control = "(?i)" + "|".join(controls) if controls else None
        vocab = self.tok.get_vocab()
        self.blank_first = np.zeros(max(vocab.values()) + 1, bool)
        self.blank_first[[i for token, i in vocab.items() if token.startswith("\u0120")]] = True
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int32)
        self.met = np.zeros(1 << 16, bool)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _sweep(self) -> None:
        """Forget the units not met since the last sweep; all of them where that would leave the memo half full."""
        kept = np.flatnonzero(self.met[: len(self.memo)])
        units = [u for u, c in self.memo.items() if self.met[c]] if len(kept) <= MEMO // 2 else []  # in order of their codes
        ids, sizes = self._gather(kept), self.sizes[kept]
        self.clear()
        if units:
            self._add_many(units, ids, sizes)
        pa.default_memory_pool().release_unused()

    def _make_room(self, n: int) -> None:
        if n > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * n), np.resize(self.sizes, 2 * n)
            self.met = np.concatenate([self.met, np.zeros(2 * n - len(self.met), bool)])

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, unit: str, ids: list[int]) -> int:
        n, m = len(self.memo), len(ids)
        self._make_room(n + 1)
        if self.used + m > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat) + m)
        self.flat[self.used : self.used + m] = ids
        self.starts[n], self.sizes[n] = self.used, m
        self.used += m
        self.memo[unit] = n
        return n

    def _add_many(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.memo), len(units)
        self._make_room(n + m)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (len(self.flat) + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + m] = sizes
        self.used += len(ids)
        self.memo.update(zip(units, range(n, n + m)))

    def _learn_blank_led(self, units: list[str]) -> None:
        """Memoise stretches of a text; those that begin with a blank and hold no other white space go many in one text."""
        led = [_BLANK_LED.fullmatch(u) is not None for u in units]
        joint = list(compress(units, led))
        texts = ["".join(joint[i : i + JOINED]) for i in range(0, len(joint), JOINED)]
        ids = np.fromiter(chain.from_iterable(self._library(texts)), np.int32)
        begins = np.flatnonzero(self.blank_first[ids])
        if len(begins) != len(joint):  # a file that splits otherwise: every unit by itself
            alone = units
        else:
            self._add_many(joint, ids, np.diff(begins, append=len(ids)))
            alone = [u for u, one in zip(units, led) if not one]
        for u, one in zip(alone, self._library(alone)):
            self._add(u, one)

    def _learn(self, units: list[str]) -> None:
        if not self.drops_space:
            return self._learn_blank_led(units)
        plain = [one is not None for one in map(_PLAIN.fullmatch, units)]
        latin = list(compress(units, plain))
        if latin:
            letters, tokenize = self.letters, self.model.tokenize
            lowered = "\n".join(latin).lower().split("\n")
            ids = [[t.id for t in tokenize(u if u.isascii() else u.translate(letters))] for u in lowered]
            self._add_many(latin, np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int32, len(ids)))
        rest = [u for u, one in zip(units, plain) if not one]
        for u, one in zip(rest, self._library(rest)):
            self._add(u, one)

    def _known(self, units: np.ndarray) -> np.ndarray:
        """Memo codes of the units, -1 where the memo has none."""
        return np.fromiter(map(self.memo.get, units.tolist(), repeat(-1)), np.int64, len(units))

    def _codes(self, units: pa.Array) -> np.ndarray:
        """Memo codes of the units, learning new ones."""
        if len(self.memo) > MEMO:
            self._sweep()
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)  # as objects: several times faster than to_pylist
        codes = self._known(distinct)
        new = np.flatnonzero(codes < 0)
        if len(new):
            self._learn(distinct[new].tolist())
            codes[new] = self._known(distinct[new])
        self.met[codes] = True
        return codes[coded.indices.to_numpy()]

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        sizes = self.sizes[codes].astype(np.int64)
        shift = self.starts[codes] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]

    def _stretches(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The texts cut at borders of a ``byte_bpe`` file: stretches, and how many each text has."""
        buf, off = words.raw(texts)
        cut = buf == 32
        cut[1:] |= (_LETTER[buf[:-1]] & _SIGN[buf[1:]]) | ((buf[1:] == 10) & _SHOWN[buf[:-1]])
        cut[off[:-1][off[1:] > off[:-1]]] = True
        borders = np.append(np.flatnonzero(cut), len(buf))
        units = pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(buf)))
        return units, np.diff(np.searchsorted(borders[:-1], off))

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts go to the library as they are."""
        whole = np.zeros(len(texts), bool)
        if self.control:
            whole |= pc.match_substring_regex(texts, self.control).to_numpy(zero_copy_only=False)
        if not self.drops_space:
            risky = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, "\n ")), pc.match_substring_regex(texts, _ODD_SPACE))
            risky = pc.or_(risky, pc.ends_with(texts, " "))
            for i in np.flatnonzero(risky.to_numpy(zero_copy_only=False)).tolist():
                whole[i] |= bool(_UNSAFE.search(texts[i].as_py()))
        return whole

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids per text) of a string column without nulls."""
        texts = texts.cast(pa.large_string())
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        whole = self._whole(texts)
        cuttable = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        if self.drops_space:
            apart = pc.replace_substring_regex(cuttable, _SIGNED, r"\1 \2")
            split = pc.split_pattern(pc.replace_substring(apart, "\n", " "), " ")
            units, counts = split.flatten(), pc.list_value_length(split).to_numpy()
        else:
            units, counts = self._stretches(cuttable)
        codes = self._codes(units)
        ids, per = self._gather(codes), self._per_text(self.sizes[codes], counts)
        if not whole.any():
            return ids, per
        own = self._library(texts.filter(pa.array(whole)).to_pylist())
        per[whole] = [len(one) for one in own]
        out, is_own = np.empty(int(per.sum()), np.int32), np.repeat(whole, per)
        out[is_own], out[~is_own] = np.fromiter(chain.from_iterable(own), np.int32), ids
        return out, per

    @staticmethod
    def _per_text(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker."""
    return Encoder(path)
