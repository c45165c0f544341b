"""Byte-level BPE of whole batches: texts are cut into pieces with numpy, each distinct piece is encoded once.

The pieces are those of the vocabulary's own splitting rule (contractions, an optional space before letters,
digits or symbols, runs of white space). Texts with a contraction, a special token or letters beyond the
tabled scripts go to the tokenizer whole, so the ids are always the tokenizer's own.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np

from panelkite.llm.textcodes import Coder, mix

TABLED = 0x530  # Latin, Greek and Cyrillic scripts
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
LONGEST = 48  # longer pieces are looked up by their text, not by a code
MOST_PIECES = 500_000  # bounds a task's memory: the piece table is emptied beyond it
TEXT_BYTES = 1_000_000  # text encoded at a time; the arrays of a batch take some 60 times as much
# A batch travels in small parts, so that neither side holds many long texts at once.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def _classes() -> np.ndarray:
    table = np.full(TABLED, OTHER, np.uint8)
    for i in range(TABLED):
        kind = unicodedata.category(chr(i))
        if kind[0] == "L":
            table[i] = LETTER
        elif kind[0] == "N":
            table[i] = DIGIT
        elif kind[0] == "Z" or i in (9, 10, 11, 12, 13, 0x85):
            table[i] = SPACE
    return table


def _byte_ranks(vocabulary: dict[str, int], special: set[str]) -> dict[bytes, int]:
    """Byte strings of a byte-level vocabulary, whose tokens spell each byte as one visible character."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spelled = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in plain):
        spelled[chr(256 + i)] = b
    return {bytes(spelled[c] for c in token): rank for token, rank in vocabulary.items() if token not in special}


class Encoder:
    """Token ids of texts by a byte-level BPE file; made in each task."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = _byte_ranks(spec["model"]["vocab"], special)
        # A piece is encoded alone, so the splitting rule of this encoder takes it whole.
        self.pieces = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("|".join(["'(?:s|t|re|ve|m|ll|d)", *map(re.escape, sorted(special))]))
        self.classes = _classes()
        self.symbols = mix(np.arange(1, TABLED + 1, dtype=np.uint64))
        self.coder = Coder()
        self.empty()

    def _learn(self, keys: list, pieces: list[str]) -> None:
        """Encode pieces that are not in the table yet."""
        found = list(map(self.pieces._core_bpe.encode_single_piece, map(str.encode, pieces)))
        sizes = list(map(len, found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, sum(sizes))
        self.slot.update(zip(keys, range(len(self.size), len(self.size) + len(keys)), strict=True))
        ends = len(self.ids) + np.cumsum(sizes, dtype=np.int64)
        self.first = np.concatenate([self.first, ends - sizes])
        self.size = np.concatenate([self.size, np.array(sizes, np.int64)])
        self.ids = np.concatenate([self.ids, flat])

    def empty(self) -> None:
        self.slot: dict[int | str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each text's ids. Null is the empty text."""
        texts = [t or "" for t in texts]
        plain: list[int] = []
        parts: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if not text:
                parts[i] = np.zeros(0, np.uint32)
            elif self.odd.search(text):
                parts[i] = self._whole(text)
            else:
                plain.append(i)
        if plain:
            points = np.frombuffer("".join([texts[i] for i in plain]).encode("utf-32-le"), "<u4")
            begins = np.cumsum([0, *[len(texts[i]) for i in plain[:-1]]])
            tabled = (np.maximum.reduceat(points, begins) < TABLED).tolist()
            for i, simple in zip(plain, tabled, strict=True):
                if not simple:
                    parts[i] = self._whole(texts[i])
            if not all(tabled):
                plain = [i for i, simple in zip(plain, tabled, strict=True) if simple]
                points = np.frombuffer("".join([texts[i] for i in plain]).encode("utf-32-le"), "<u4")
        if plain:
            flat, ends = self._encode_plain([texts[i] for i in plain], points)
            for k, i in enumerate(plain):
                parts[i] = flat[ends[k] : ends[k + 1]]
        sizes = np.fromiter((len(parts[i]) for i in range(len(texts))), np.int64, len(texts))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return (np.concatenate([parts[i] for i in range(len(texts))]) if texts else np.zeros(0, np.uint32)), offsets

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _cut(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start."""
        kind = self.classes[points]
        n = len(points)
        text_start = np.zeros(n + 1, bool)
        text_start[offsets] = True
        space = kind == SPACE
        changed = np.ones(n, bool)
        changed[1:] = kind[1:] != kind[:-1]
        after_blank = np.zeros(n, bool)
        after_blank[1:] = points[:-1] == 32
        # Other than white space: a new run, unless one blank before it belongs to the piece.
        starts = ~space & changed & ~after_blank
        # White space: a new run, and its last character once something follows in the text.
        last = np.zeros(n, bool)
        last[:-1] = ~space[1:] & ~text_start[1:n]
        starts |= space & (changed | last)
        return starts | text_start[:n]

    def _encode_plain(self, texts: list[str], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        offsets = np.cumsum([0, *[len(t) for t in texts]])
        starts = np.flatnonzero(self._cut(points, offsets))
        ends = np.append(starts[1:], len(points))
        codes = self.coder.runs(self.symbols[points], starts, ends)
        if len(self.size) > MOST_PIECES:
            self.empty()
        slots = np.empty(len(starts), np.int64)
        short = ends - starts <= LONGEST
        where = np.flatnonzero(short)
        found, at, back = np.unique(codes[where], return_index=True, return_inverse=True)
        where = where[at]
        slots[short] = self._slots(found.tolist(), joined, starts[where].tolist(), ends[where].tolist())[back]
        for k in np.flatnonzero(~short).tolist():
            piece = joined[starts[k] : ends[k]]
            slots[k] = self._slots([piece], piece, [0], [len(piece)])[0]
        first, size = self.first[slots], self.size[slots]
        place = np.cumsum(size)
        flat = self.ids[np.repeat(first - (place - size), size) + np.arange(place[-1])]
        return flat, np.concatenate([[0], place])[np.searchsorted(starts, offsets)]

    def _slots(self, keys: list, joined: str, starts: list[int], ends: list[int]) -> np.ndarray:
        known = list(map(self.slot.get, keys))
        new = [i for i, slot in enumerate(known) if slot is None]
        if new:
            self._learn([keys[i] for i in new], [joined[starts[i] : ends[i]] for i in new])
            for i in new:
                known[i] = self.slot[keys[i]]
        return np.array(known, np.int64)


def default_path() -> str:
    """The vocabulary file of the machine's public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")

