"""Whole texts to token ids with the tokenizers library, a memo of recurring chunks between.

The pre-token pattern of byte-level BPE lets a piece hold one space and then characters of one class
(letters, digits, or others but white space), or an apostrophe and the letters of a contraction, or
white space alone. So a piece always begins

- where a letter, digit or sign other than the apostrophe meets a character of another of these classes,
- before a space that follows one of them,
- before and behind a line feed that stands between two of them,

and nothing behind such a place is looked at. A text is cut at these places (where its bytes are ASCII
or letters of common alphabets; elsewhere it is not cut at all), the chunks are told apart by Arrow,
and each distinct one is encoded once by the library. Texts that hold an added token's string, and all
texts where a file asks for other steps than these, are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from engram.llm.arrow import text_bytes

#: Chunks after which the memo starts anew, and the longest one that it keeps: bounds on a worker's memory.
MEMO_ENTRIES = 1 << 20
MEMO_BYTES = 40
#: Bytes of text that are encoded at once.
SEGMENT = 4 << 20
#: Chunks that the library encodes in one call.
TOGETHER = 500

LETTER, DIGIT, SIGN, SPACE, LINE = 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = LETTER if _c.isalpha() else DIGIT if _c.isdigit() else SPACE if _c == " " else LINE if _c == "\n" else SIGN if 33 <= _b < 127 and _c != "'" else 0
#: First bytes of two-byte characters that are all letters: U+0100 to U+023F, U+0400 to U+047F; and C3, but for the two signs.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xD0, 0xD1]] = True
_SIGNS_OF_C3 = (0x97, 0xB7)
#: By class before times 8 and class behind: whether a piece begins between.
_BEGINS = np.zeros(64, bool)
for _a in (LETTER, DIGIT, SIGN):
    _BEGINS[_a * 8 + SPACE] = True
    for _b in (LETTER, DIGIT, SIGN):
        _BEGINS[_a * 8 + _b] = _a != _b
#: Chunks that are one piece each.
_PIECE = r"^(?: ?(?:[A-Za-zÀ-ÖØ-öø-ȿЀ-ѿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n)\z"


def piece_starts(buf: np.ndarray) -> np.ndarray:
    """For each byte, whether a piece surely begins there; bytes at the ends of buf count as not known."""
    kind = _CLASS[buf]
    if len(buf) < 3:
        return np.zeros(len(buf), bool)
    if buf.max() >= 0xC3:
        lead = np.flatnonzero(_LEADS[buf[:-1]])
        lead = lead[(buf[lead] != 0xC3) | ~np.isin(buf[lead + 1], _SIGNS_OF_C3)]
        kind[lead] = kind[lead + 1] = LETTER
    out = np.zeros(len(buf), bool)
    out[1:] = _BEGINS[kind[:-1] * 8 + kind[1:]]
    line = np.flatnonzero(kind[1:-1] == LINE) + 1
    line = line[(kind[line - 1] >= LETTER) & (kind[line - 1] <= SIGN) & (kind[line + 1] >= LETTER) & (kind[line + 1] <= SIGN)]
    out[line] = out[line + 1] = True
    return out


def segments(buf: np.ndarray, size: int) -> list[int]:
    """Places that cut a buffer into parts of about ``size`` bytes, each but the first a sure start of a piece."""
    out, at, look = [0], size, 1 << 16
    while at < len(buf):
        found = np.flatnonzero(piece_starts(buf[at : at + look]))
        if len(found):
            out.append(at + int(found[0]))
            at = out[-1] + size
        else:
            at += look - 8  # windows overlap, so no place is lost at their ends
    return [*out, len(buf)]


def byte_letters() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, np.uint32)
    out[shown] = shown
    out[out == 0] = 256 + np.arange(256 - len(shown))
    return out


class Encoder:
    """Ids of whole texts; one per worker and file."""

    _all: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._all:
            cls._all[path] = cls(path)
        return cls._all[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        steps, model = file["pre_tokenizer"] or {}, file["model"]
        self.added = [x["content"] for x in file["added_tokens"]]
        self.cuts = (
            file["normalizer"] is None
            and (steps.get("type"), steps.get("add_prefix_space"), steps.get("use_regex")) == ("ByteLevel", False, True)
            and (model.get("type", "BPE"), model.get("unk_token"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")) == ("BPE", None, None, None)
            and not (model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"))
            and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in file["added_tokens"])
        )
        self.letters = byte_letters()
        # byte FF is in no text, and no merge of the vocabulary holds it: pieces joined by it are encoded one by one
        self.joint = chr(self.letters[0xFF])
        self.joint_id = model["vocab"].get(self.joint)
        if self.joint_id is None or any(self.joint in (m if isinstance(m, str) else "".join(m)) for m in model.get("merges", ())):
            self.cuts = False
        self.model = Tokenizer(self.library.model)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, each encoded whole by the library."""
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First places and sizes of distinct chunks, and the ids they lie in."""
        text = chunks.cast(pa.large_string())
        plain = pc.match_substring_regex(text, _PIECE).to_numpy(zero_copy_only=False)
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        buf, offsets = text_bytes(text.filter(pa.array(plain)))
        joined = self.letters[np.insert(buf, offsets[1:-1], 0xFF)] if len(buf) else self.letters[buf]
        starts = offsets + np.arange(len(offsets))  # of each piece among the joined ones
        sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for a in range(0, len(starts) - 1, TOGETHER):
            b = min(a + TOGETHER, len(starts) - 1)
            some = joined[starts[a] : starts[b] - 1].tobytes().decode("utf-32-le")
            some = np.array(self.model.encode_batch_fast([some], add_special_tokens=False)[0].ids, np.uint32)
            joints = np.flatnonzero(some == self.joint_id)
            sizes.append(np.diff(np.r_[-1, joints, len(some)]) - 1)
            ids.append(np.delete(some, joints))
        others = self.whole(text.filter(pa.array(~plain)).to_pylist())
        sizes.append(np.array([len(x) for x in others], np.int64))
        size, first = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        size[order] = np.concatenate(sizes)
        first[order] = np.cumsum(size[order]) - size[order]
        return first, size, np.concatenate([*ids, *others])

    def _find(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place and number of ids of each distinct chunk, and the ids they lie in."""
        at = pc.index_in(chunks, value_set=self.known)
        new = chunks.filter(pc.is_null(at))
        if len(self.known) + len(new) > MEMO_ENTRIES and len(self.known):
            self._forget()
            return self._find(chunks)
        where = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            where[where < 0] = len(self.known) + np.arange(len(new))
            first, size, ids = self._learn(new)
            self.known = pa.concat_arrays([self.known, new])
            self.first, self.size, self.ids = np.r_[self.first, len(self.ids) + first], np.r_[self.size, size], np.r_[self.ids, ids]
        found = self.first[where], self.size[where], self.ids
        if len(self.known) > MEMO_ENTRIES:
            self._forget()
        elif len(new) and pc.max(pc.binary_length(new)).as_py() > MEMO_BYTES:
            keep = pc.less_equal(pc.binary_length(self.known), MEMO_BYTES)
            mask = keep.to_numpy(zero_copy_only=False)
            self.known, self.first, self.size = self.known.filter(keep), self.first[mask], self.size[mask]
        return found

    def encode(self, column: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of texts, end to end (none without ``ids``), and the number of ids before each text (n + 1)."""
        special = np.zeros(len(column), bool)
        for x in self.added if self.cuts else ():
            special |= pc.fill_null(pc.match_substring(column, x), False).to_numpy(zero_copy_only=False)
        if not self.cuts or special.any():
            return self._mixed(column, special if self.cuts else np.ones(len(column), bool), ids)
        buf, offsets = text_bytes(column)
        before, total, out = np.zeros(len(offsets), np.int64), 0, []
        cuts = segments(buf, SEGMENT) if len(buf) > 2 * SEGMENT else [0, len(buf)]
        for a, b in zip(cuts, cuts[1:]):
            mark = np.zeros(b - a + 1, bool)
            mark[:-1] = piece_starts(buf[a:b])
            own = np.flatnonzero((offsets >= a) & (offsets <= b))
            mark[offsets[own] - a] = True
            mark[[0, -1]] = True
            places = np.flatnonzero(mark)
            if b > a:
                # text ends cut as well: bytes on both sides belong to different texts
                chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf[a:b]))])
                told = chunks.dictionary_encode()
                first, size, pool = self._find(told.dictionary)
                which = told.indices.to_numpy()
                n = size[which]
                ends = np.r_[0, np.cumsum(n)]
                if ids:
                    out.append(pool[np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1])])
            else:
                ends = np.zeros(1, np.int64)
            before[own] = total + ends[np.searchsorted(places, offsets[own] - a)]
            total += int(ends[-1])
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), before

    def _mixed(self, column: pa.Array, special: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same where some texts must be encoded whole."""
        rest = np.flatnonzero(~special)
        flat, before = self.encode(column.take(pa.array(rest)), ids) if len(rest) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        own: dict[int, np.ndarray] = dict(zip(np.flatnonzero(special).tolist(), self.whole([x or "" for x in column.filter(pa.array(special)).to_pylist()])))
        size = np.zeros(len(column), np.int64)
        size[rest] = np.diff(before)
        for k, x in own.items():
            size[k] = len(x)
        if ids:
            for place, k in enumerate(rest.tolist()):
                own[k] = flat[before[place] : before[place + 1]]
            flat = np.concatenate([own[k] for k in range(len(column))])
        return flat, np.r_[0, np.cumsum(size)]
