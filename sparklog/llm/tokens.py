"""Tokenising whole texts with the tokenizers library, each distinct chunk once.

A text is cut where no token can cross: before the last space of a run of white space
and around the rest of that run (for byte-level vocabularies), or at white space (for
vocabularies that drop it), and between a Latin letter and a full stop or comma. The
library encodes each distinct chunk; ids of a text are those of its chunks in order.
A chunk of Latin letters alone is one pre-token, so it goes to the library's model
directly; any other goes through the whole of its pipeline. Texts with other white space than space and newline, or
with the text of a special token, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparklog.llm.kernels import LOWER, ragged

#: White space (as Python or the library sees it) besides space and newline; such texts are encoded whole.
OTHER_SPACE = r"[\x09\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Letters that normal forms leave alone, behind at most one space.
LETTERS = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


class ChunkEncoder:
    """Ids of batches of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    keep: chunks whose ids are remembered; beyond it the memory starts anew.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.drops_space = bool(made.get("normalizer"))
        self.special = [x["content"] for x in made["added_tokens"]]
        self.keep = keep
        from tokenizers.pre_tokenizers import ByteLevel

        signs = ByteLevel(add_prefix_space=False, use_regex=False)
        low = str.lower if self.drops_space else str
        self.signs = {i: signs.pre_tokenize_str(low(chr(i)))[0][0] for i in (32, *range(65, 91), *range(97, 123), *range(0xC0, 0x100))}
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, chunks: list[str]) -> None:
        tokenize, signs, letters = self.tokenizer.model.tokenize, self.signs, LETTERS
        plain = [x for x in chunks if letters(x)]
        other = [x for x in chunks if not letters(x)]
        counts: list[int] = []
        ids: list[int] = []
        for x in plain:
            made = tokenize(x.translate(signs))
            counts.append(len(made))
            ids += [t.id for t in made]
        for at in range(0, len(other), 5000):
            some = other[at : at + 5000]
            got = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids += got.ids
            counts += np.bincount(np.array(got.word_ids, np.int64), minlength=len(some)).tolist() if got.ids else [0] * len(some)
        size, slot = np.array(counts, np.int64), len(self.slot)
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, np.array(ids, np.int32)])
        self.slot.update(zip(plain + other, range(slot, slot + len(chunks))))

    def _cuts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bytes where chunks begin, rows' beginnings included."""
        space = buf == 32
        white = space | (buf == 10)
        solid = ~white
        cut = np.zeros(len(buf) + 1, bool)
        cut[off] = True
        low = buf | 32
        letter = (low >= 97) & (low <= 122)  # the last byte of a Latin letter
        letter[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        cut[1:-1] |= letter[:-1] & ((buf[1:] == 44) | (buf[1:] == 46))
        before_solid = np.zeros(len(buf), bool)
        before_solid[1:] = solid[:-1]
        after_white_solid = solid & ~before_solid  # a word begins
        if self.drops_space:
            cut[:-1] |= after_white_solid | (white & before_solid)
            return np.flatnonzero(cut)
        last = np.zeros(len(buf), bool)  # the last white character before a word
        last[:-1] = white[:-1] & solid[1:]
        at_row = np.zeros(len(buf) + 1, bool)
        at_row[off] = True
        last &= ~at_row[1:]  # no word follows in this row
        cut[:-1] |= white & before_solid  # a run of white space begins
        cut[:-1] |= last  # its last character stands apart ...
        glue = np.zeros(len(buf), bool)
        glue[1:] = (last & space)[:-1]
        cut[:-1] |= after_white_solid & ~glue  # ... or begins the word, if it is a space
        cut[off] = True
        return np.flatnonzero(cut)

    def encode(self, column: pa.Array, off: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the ids' count of each row."""
        rows = len(off) - 1
        odd = np.zeros(rows, bool) if self.drops_space else pc.match_substring_regex(column, OTHER_SPACE).to_numpy(zero_copy_only=False)
        for s in self.special:
            odd |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        if self.drops_space:
            buf = LOWER[buf]  # as the library's normalizer does
        cuts = self._cuts(buf, off)
        sizes = np.diff(cuts)
        starts = cuts[:-1]
        keep = sizes > 0
        if self.drops_space and len(buf):
            keep &= ~((buf[starts] == 32) | (buf[starts] == 10))
        bounds = np.append(starts, len(buf)).astype(np.int64)
        made = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))])
        if not keep.all():
            made = made.filter(pa.array(keep))
            starts = starts[keep]
        coded = made.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.slot) + len(names) > self.keep:
            self._forget()
        slot = self.slot
        if new := [x for x in names if x not in slot]:
            self._learn(new)
        slots = np.fromiter(map(slot.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        n = self.size[slots]
        ids = self.ids[ragged(self.begin[slots], n)]
        row_ends = np.searchsorted(starts, off[1:])
        sums = np.concatenate([[0], np.cumsum(n)])
        counts = np.diff(sums[row_ends], prepend=0)
        if odd.any():
            pieces = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(odd):
                pieces[i] = np.array(self.tokenizer.encode(column[int(i)].as_py(), add_special_tokens=False).ids, np.int32)
            counts = np.array([len(x) for x in pieces])
            ids = np.concatenate(pieces) if pieces else ids
        return ids, counts
