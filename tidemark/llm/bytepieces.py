"""Exact, cached byte-level BPE on whole batches of text.

The library's pre-tokenizer splits a text into pieces, and each piece is merged on its own. So texts are split with
numpy (the same rule, by character class), the distinct pieces of a worker go through the library once, and ids are
looked up by 64-bit piece hashes. Texts that hold an added token's string go to the library whole.

Memory is bounded whatever the texts: pieces are looked up in runs of a bounded number, and a long text is worked on in
parts. It is cut before white space that follows another character, or else where letters and digits meet, which are
places where the rule always begins a piece and looks at nothing before; and at added tokens.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm.common import mix64, span_hashes, text_steps

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Pieces that a worker remembers; beyond it the memory starts anew.
MEMORY = 1 << 20
#: Pieces that go to the library at once.
GROUP = 1000
_APOSTROPHE = 39
#: Bytes of text for one vectorised step; a longer text is cut into parts of about as many.
STEP = 1 << 18
#: Pieces that are looked up at once, fewer than MEMORY.
RUN = 1 << 17
_KIND = np.zeros(256, np.uint8)  # of bytes: 1 letter, 2 digit, 3 other printable ASCII but the apostrophe, 4 blank
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 0
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def part_ends(raw: np.ndarray, step: int = STEP) -> list[int]:
    """Where to cut a text's bytes into parts of about step bytes, its end included. A part without such a place is longer."""
    out, at = [], 0
    while len(raw) - at > 2 * step:
        look, found = at + step, None
        while found is None and look < len(raw):
            kind = _KIND[raw[look - 1 : look + step]]
            for hit in ((kind[1:] == 4) & (kind[:-1] > 0) & (kind[:-1] < 4), ((kind[1:] == 2) & (kind[:-1] == 1)) | ((kind[1:] == 1) & (kind[:-1] == 2))):
                if hit.any():
                    found = look + int(hit.argmax())
                    break
            look += step
        if found is None:
            break
        out.append(found)
        at = found
    return [*out, len(raw)]


class PieceEncoder:
    """ids of texts as Tokenizer.from_file(path).encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = json.loads(self.tokenizer.to_str())["added_tokens"]
        self.added = [x["content"] for x in added]
        # A plain added token is cut out of a text and leaves what stands around it as it is.
        self.plain = {x["content"]: x["id"] for x in added if not (x["lstrip"] or x["rstrip"] or x["single_word"])}
        kind = json.loads(self.tokenizer.to_str())["pre_tokenizer"]
        self.split = bool(kind) and kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and self.tokenizer.normalizer is None
        self.classes = np.full(0x110000, -1, np.int8)
        self.values = mix64(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self._forget()

    def _forget(self) -> None:
        self.slots = np.zeros(1 << 21, np.uint64)
        self.places = np.zeros(1 << 21, np.int32)
        self.starts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.uint32)
        self.known = self.used = 0

    def _classify(self, codes: np.ndarray) -> np.ndarray:
        """Class of each code point, asked of the library's own pre-tokenizer once for each new one."""
        got = self.classes[codes]
        if (got < 0).any():
            pre = self.tokenizer.pre_tokenizer
            for c in np.unique(codes[got < 0]).tolist():
                joins = lambda before: len(pre.pre_tokenize_str(before + chr(c) + before)) == 1  # noqa: E731, B023
                self.classes[c] = LETTER if joins("a") else NUMBER if joins("1") else OTHER if joins("!") else SPACE
            got = self.classes[codes]
        return got

    def pieces(self, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where pieces start in texts laid end to end (code points), as a mask."""
        n = len(codes)
        start = np.zeros(n, bool)
        if not n:
            return start
        kind = self._classify(codes)
        head = np.zeros(n, bool)
        head[off[:-1][off[:-1] < n]] = True
        tail = np.zeros(n, bool)
        tail[off[1:][off[1:] > 0] - 1] = True
        space = kind == SPACE
        changed = np.ones(n, bool)
        changed[1:] = kind[1:] != kind[:-1]
        after_blank = np.zeros(n, bool)
        after_blank[1:] = codes[:-1] == 32
        start = np.where(space, changed, changed & ~after_blank) | head
        before_word = np.zeros(n, bool)
        before_word[:-1] = ~space[1:]
        start |= space & before_word & ~tail  # the last space of a run stands alone or joins the word
        at = np.flatnonzero((codes == _APOSTROPHE) & start & ~tail)
        if len(at):
            end = off[np.searchsorted(off, at, "right")]
            one, two = codes[at + 1], codes[np.minimum(at + 2, n - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = (at + 2 < end) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            hit, size = at[short | long], np.where(short, 2, 3)[short | long]
            start[hit + 1] = False
            stop = hit + size
            inside = stop < end[short | long]
            start[stop[inside]] = True
        return start

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of known pieces, -1 of others."""
        mask = np.uint64(len(self.slots) - 1)
        slot = hashes & mask
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            there = self.slots[slot]
            hit = there == hashes[todo]
            out[todo[hit]] = self.places[slot[hit]]
            go = ~hit & (there != 0)
            todo, slot = todo[go], (slot[go] + np.uint64(1)) & mask
        return out

    def _learn(self, hashes: np.ndarray, texts: list[str], words: np.ndarray) -> None:
        flat, sizes = self._encode_pieces(texts, words)
        while self.known + len(sizes) > len(self.lengths):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.lengths[self.known : self.known + len(sizes)] = sizes
        self.starts[self.known : self.known + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        mask = np.uint64(len(self.slots) - 1)
        todo, slot = np.arange(len(hashes)), hashes & mask
        while len(todo):
            free = np.flatnonzero(self.slots[slot] == 0)
            won, at = np.unique(slot[free], return_index=True)  # of those that want one slot, one gets it
            self.slots[won], self.places[won] = hashes[todo[free[at]]], self.known + todo[free[at]]
            rest = np.ones(len(todo), bool)
            rest[free[at]] = False
            todo, slot = todo[rest], (slot[rest] + np.uint64(1)) & mask
        self.known += len(sizes)
        self.used += len(flat)

    def _encode_pieces(self, texts: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, their count by piece).

        Pieces that are one blank and a word (words) split again where their blanks stand, so many go to the library as one
        text; each other piece goes alone.
        """
        joint, alone = np.flatnonzero(words).tolist(), np.flatnonzero(~words).tolist()
        sizes = np.zeros(len(texts), np.int32)
        order, flat = np.array(joint + alone, np.int64), []
        for a in range(0, len(joint), GROUP):
            group = joint[a : a + GROUP]
            e = self.tokenizer.encode("".join(texts[k] for k in group), add_special_tokens=False)
            word = np.array(e.word_ids, np.int64)
            assert word[-1] == len(group) - 1
            sizes[group] = np.bincount(word, minlength=len(group))
            flat.append(np.array(e.ids, np.uint32))
        for a in range(0, len(alone), GROUP):
            for k, e in zip(alone[a : a + GROUP], self.tokenizer.encode_batch([texts[k] for k in alone[a : a + GROUP]], add_special_tokens=False), strict=True):
                sizes[k] = len(e.ids)
                flat.append(np.array(e.ids, np.uint32))
        ids = np.concatenate(flat)
        begin = np.zeros(len(texts), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        total = np.cumsum(sizes, dtype=np.int64)
        return ids[np.arange(len(ids)) - np.repeat(total - sizes - begin, sizes)], sizes

    def _numbers(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each piece codes[begin:end] in the memory; RUN pieces at most, as the memory may start anew."""
        a, b = int(begin[0]), int(end[-1])
        codes, begin, end = codes[a:b], begin - a, end - a
        hashes = span_hashes(self.values[codes], begin, end) | np.uint64(1)
        found = self._find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh, at = np.unique(hashes[new], return_index=True)
            if self.known + len(fresh) > MEMORY:
                self._forget()
                fresh, at = np.unique(hashes, return_index=True)
                new = np.arange(len(hashes))
            text = codes.astype("<u4").tobytes().decode("utf-32-le")
            at = new[at]
            second = codes[np.minimum(begin[at] + 1, len(codes) - 1)]
            words = (codes[begin[at]] == 32) & (end[at] - begin[at] > 1) & (self._classify(second) != SPACE)
            self._learn(fresh, [text[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)], words)
            found = self._find(hashes)
        return found

    def counts(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many ids each piece codes[begin:end] has."""
        parts = [np.zeros(0, np.int64)]
        for a in range(0, len(begin), RUN):
            numbers = self._numbers(codes, begin[a : a + RUN], end[a : a + RUN])  # may replace the memory, so it comes first
            parts.append(self.lengths[numbers])
        return np.concatenate(parts)

    def encoded(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces codes[begin:end] in a row, their count by piece)."""
        parts = [self.gather(self._numbers(codes, begin[a : a + RUN], end[a : a + RUN])) for a in range(0, len(begin), RUN)]
        if len(parts) == 1:
            return parts[0]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, their count by piece)."""
        count = self.lengths[numbers].astype(np.int64)
        total = np.cumsum(count)
        at = np.arange(int(total[-1]) if len(total) else 0)
        return self.ids[at - np.repeat(total - count - self.starts[numbers], count)], count

    def steps(self, column: pa.Array):
        """Yields (first row, end row, ids in a row, first id of each row (n + 1)) for runs of rows."""
        for first, end, raw, off in text_steps(column, STEP):
            if self.split and end - first == 1 and len(raw) > 2 * STEP:
                ids = self._long(raw)
                yield first, end, ids, np.array([0, len(ids)])
                continue
            whole = raw.tobytes()
            if not self.split or any(a.encode() in whole for a in self.added):
                got = [self._direct(whole[a:b].decode()) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                places = np.zeros(len(got) + 1, np.int64)
                np.cumsum([len(x) for x in got], out=places[1:])
                yield first, end, np.concatenate(got) if got else np.zeros(0, np.uint32), places
                continue
            ids, places = self._ids(raw, off)
            yield first, end, ids, places

    def _ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts laid end to end, first id of each (n + 1)); none holds an added token."""
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
        off = lead[off]
        begin = np.flatnonzero(self.pieces(codes, off))
        ids, count = self.encoded(codes, begin, np.append(begin[1:], len(codes)))
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        return ids, total[np.searchsorted(begin, off)]

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """The ids of a long text, part by part. The library gets it whole only for added tokens that change what is
        around them."""
        whole = raw.tobytes()
        if any(a.encode() in whole for a in self.added if a not in self.plain):
            return np.array(self.tokenizer.encode(whole.decode(), add_special_tokens=False).ids, np.uint32)
        # The longest of several added tokens at a place counts, as in the library.
        found = re.finditer(b"|".join(re.escape(a.encode()) for a in sorted(self.plain, key=len, reverse=True)), whole) if self.plain else ()
        out, at = [], 0
        for m in [*found, None]:
            stop = m.start() if m else len(raw)
            start = at
            for end in part_ends(raw[at:stop]) if stop > at else ():
                part = raw[start : at + end]
                out.append(self._ids(part, np.array([0, len(part)]))[0])
                start = at + end
            if m:
                out.append(np.array([self.plain[m[0].decode()]], np.uint32))
                at = m.end()
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _direct(self, text: str) -> np.ndarray:
        """A text's ids, split at added tokens by the library; the parts between them go through the memory."""
        if self.split and not any(a in text for a in self.added):
            return next(self.steps(pa.array([text], pa.large_string())))[2] if text else np.zeros(0, np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    return PieceEncoder(path)
