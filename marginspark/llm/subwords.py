"""Whole-text encoding by a tokenizer file, with the work done once per word.

Both supported kinds of file split a text before they merge, and no piece of
that split reaches over a blank or line feed that stands alone.  So a text's ids
are those of its chunks, a chunk being such a character and what follows up to
the next one.  Commas and full stops that follow a letter or digit start chunks
of their own too.  Chunks repeat, so each is encoded once by the library and
then looked up; texts in which white space touches white space are given to the
library as a whole.  A worker remembers a bounded number of chunks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from string import ascii_letters

import numpy as np

from marginspark.llm.batches import ragged

#: A worker remembers chunks up to this number and this length in bytes.
MAX_CHUNKS = 450_000
MAX_BYTES = 40
#: When it is full, chunks met less often than this are forgotten.
FEW = 3
#: A character of the private area that sets new chunks apart in one call.
MARK = "\ue000"
_TOUCHING = re.compile(r"\s\s")
#: Bytes of text that are split at once.
_SLICE = 1 << 19
_WEIGHTS = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * 2 + 1
#: What a byte is: white space, start of a chunk, start of a chunk after a letter
#: or digit, ASCII letter or digit, first byte of other white space.
_BLANK, _START, _AFTER, _ALNUM, _ODD = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = _ALNUM
_KIND[[*range(9, 14), *range(28, 33)]] = _BLANK
_KIND[[10, 32]] |= _START
_KIND[[*b",."]] = _AFTER
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = _ODD


def byte_letters() -> dict[str, int]:
    """The letter that byte-level files write for each byte: printable bytes are
    themselves, the others are the letters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkMemory:
    """Ids of texts through a bounded memory of their chunks.  What a chunk's
    ids are is said by ``_new_ids``, and what comes before each text by
    ``prefix``.  The texts are split as bytes, all at once; chunks are looked up
    by a hash in an open table and compared byte by byte."""

    prefix = b""
    #: Whether commas and stops start chunks.
    fine = True

    def _tables(self) -> None:
        self.known = 0
        self.hash = np.zeros(1 << 14, np.uint64)
        for name in ("length", "hits", "at", "start", "size"):
            setattr(self, name, np.zeros(1 << 14, np.int32))
        self.bytes, self.n_bytes = np.zeros(1 << 17, np.uint8), 0
        self.flat, self.n_flat = np.zeros(1 << 16, np.int32), 0
        self.slots = np.full(1 << 15, -1, np.int32)

    def _ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        raise NotImplementedError

    def _new_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks in their order, and how many each has."""
        raise NotImplementedError

    # --- the table

    def _room(self, names: tuple[str, ...], need: int) -> None:
        for name in names:
            old = getattr(self, name)
            while need > len(old):
                old = np.concatenate([old, np.zeros_like(old)])
            setattr(self, name, old)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - len(self.slots).bit_length() + 1)).astype(np.int64)

    def _find(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 if there is none."""
        found = np.full(len(h), -1, np.int64)
        open_, slot = np.arange(len(h)), self._slot(h)
        while len(open_):
            code = self.slots[slot].astype(np.int64)
            same = (code >= 0) & (self.hash[code] == h[open_]) & (self.length[code] == length[open_])
            found[open_[same]] = code[same]
            on = (code >= 0) & ~same
            open_, slot = open_[on], (slot[on] + 1) & (len(self.slots) - 1)
        return found

    def _insert(self, codes: np.ndarray) -> None:
        if 2 * self.known > len(self.slots):
            while 2 * self.known > len(self.slots):
                self.slots = np.full(2 * len(self.slots), -1, np.int32)
            codes = np.arange(self.known)
        slot = self._slot(self.hash[codes])
        while len(codes):
            free = np.flatnonzero(self.slots[slot] < 0)
            taken, first = np.unique(slot[free], return_index=True)
            self.slots[taken] = codes[free[first]]
            left = np.ones(len(codes), bool)
            left[free[first]] = False
            codes, slot = codes[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _add(self, buf, starts, length, h, keep: int) -> np.ndarray:
        """Learn the chunks at ``starts``; the first ``keep`` of them stay."""
        raw = buf.tobytes()
        chunks = [
            raw[a : a + n].decode("utf-8", "surrogatepass")
            for a, n in zip(starts.tolist(), length.tolist())
        ]
        flat, sizes = self._new_ids(chunks)
        count, total = self.known + len(chunks), self.n_flat + len(flat)
        self._room(("hash", "length", "hits", "at", "start", "size"), count)
        self._room(("flat",), total)
        new = slice(self.known, count)
        self.hash[new], self.length[new], self.hits[new] = h, length, 0
        self.start[new], self.size[new] = self.n_flat + np.cumsum(sizes) - sizes, sizes
        self.flat[self.n_flat : total] = flat
        codes = np.arange(self.known, count)
        stay = slice(0, keep)
        own = ragged(buf, starts[stay], length[stay])
        self._room(("bytes",), self.n_bytes + len(own))
        self.bytes[self.n_bytes : self.n_bytes + len(own)] = own
        self.at[codes[stay]] = self.n_bytes + np.cumsum(length[stay]) - length[stay]
        self.n_bytes += len(own)
        self.known += keep
        self.n_flat += int(sizes[stay].sum())
        self._insert(codes[stay])
        return codes

    def _forget(self) -> None:
        """When the table is full: what was met seldom goes."""
        if self.known < MAX_CHUNKS:
            return
        stay = np.flatnonzero(self.hits[: self.known] >= FEW)
        if 2 * len(stay) > MAX_CHUNKS:
            return self._tables()
        h, length, size = self.hash[stay], self.length[stay], self.size[stay]
        own = ragged(self.bytes, self.at[stay].astype(np.int64), length.astype(np.int64))
        flat = ragged(self.flat, self.start[stay].astype(np.int64), size.astype(np.int64))
        slots = len(self.slots)
        self._tables()
        self.known, self.n_bytes, self.n_flat = len(stay), len(own), len(flat)
        self._room(("hash", "length", "hits", "at", "start", "size"), len(stay))
        self._room(("bytes",), len(own))
        self._room(("flat",), len(flat))
        self.hash[: len(stay)], self.length[: len(stay)], self.size[: len(stay)] = h, length, size
        self.at[: len(stay)], self.start[: len(stay)] = np.cumsum(length) - length, np.cumsum(size) - size
        self.bytes[: len(own)], self.flat[: len(flat)] = own, flat
        self.slots = np.full(slots, -1, np.int32)
        self._insert(np.arange(self.known))

    # --- texts

    def _split(self, buf: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where chunks start."""
        cut = (kind & _START) > 0
        cut[1:] |= buf[:-1] == 10
        if self.fine:
            closes = kind == _ALNUM
            # Letters of two bytes that start with C3, but for the two signs there.
            closes[1:] |= (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
            cut[1:] |= (kind[1:] == _AFTER) & closes[:-1]
        cut[begins] = True
        return np.flatnonzero(cut)

    def _whole(self, texts: Sequence[str], kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Which texts have white space that touches white space."""
        whole = np.zeros(len(texts), bool)
        blank = (kind & _BLANK) > 0
        touch = np.flatnonzero(blank[1:] & blank[:-1]) + 1
        of = np.searchsorted(begins, touch, side="right") - 1
        whole[of[touch > begins[of]]] = True
        # Texts that may hold other white space are looked at one by one.
        odd = np.unique(np.searchsorted(begins, np.flatnonzero(kind == _ODD), side="right") - 1)
        for row in odd[~whole[odd]]:
            whole[row] = _TOUCHING.search(texts[row]) is not None
        return whole

    def _piece(self, texts: Sequence[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are not empty."""
        buf = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        begins = np.cumsum(sizes) - sizes
        kind = _KIND[buf]
        whole = self._whole(texts, kind, begins)
        starts = self._split(buf, kind, begins)
        text_of = np.searchsorted(begins, starts, side="right") - 1
        length = np.diff(np.append(starts, len(buf)))
        # Place of each byte in its chunk, and the entry's byte to compare with.
        inside = np.arange(len(buf), dtype=np.int32)
        inside -= np.repeat(starts.astype(np.int32), length)
        weight = _WEIGHTS[np.minimum(inside, 63)]
        weight *= buf + np.uint64(1)
        h = np.add.reduceat(weight, starts)
        del weight
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        short = length <= MAX_BYTES
        code = np.full(len(starts), -1, np.int64)
        code[short] = self._find(h[short], length[short])
        # Equal hashes are not enough: an entry's bytes must be the chunk's.
        inside += np.repeat(np.where(code >= 0, self.at[code], -(1 << 30)), length)
        np.maximum(inside, 0, out=inside)
        unlike = np.flatnonzero(self.bytes[inside] != buf)
        differs = np.zeros(len(starts), bool)
        differs[np.searchsorted(starts, unlike, side="right") - 1] = True
        differs &= code >= 0
        del inside, unlike
        code[differs] = -1
        asked = (code < 0) & ~whole[text_of]
        new = np.flatnonzero(asked & short & ~differs)
        _, first, own = np.unique(h[new], return_index=True, return_inverse=True)
        lead = new[first]
        # New chunks of one hash: those whose bytes are not the first one's are
        # encoded by themselves, as long ones are.
        mate = lead[own]
        same = length[new] == length[mate]
        at_new = ragged(buf, starts[new[same]], length[new[same]])
        at_mate = ragged(buf, starts[mate[same]], length[mate[same]])
        if len(at_new):
            runs = np.cumsum(length[new[same]]) - length[new[same]]
            unlike = np.add.reduceat(at_new != at_mate, runs) > 0
            same[np.flatnonzero(same)[unlike]] = False
        alone = np.concatenate([np.flatnonzero(asked & (~short | differs)), new[~same]])
        learn = np.concatenate([lead, alone])
        if len(learn):
            codes = self._add(buf, starts[learn], length[learn], h[learn], len(lead))
            code[new[same]] = codes[: len(lead)][own[same]]
            code[alone] = codes[len(lead) :]
        code[whole[text_of]] = 0
        size = np.where(whole[text_of], 0, self.size[code]).astype(np.int64)
        ids = ragged(self.flat, self.start[code].astype(np.int64), size)
        self.hits[: self.known] += np.bincount(
            code[(code < self.known) & (size > 0)], minlength=self.known
        )[: self.known]
        self._forget()
        lengths = np.bincount(text_of, weights=size, minlength=len(raw)).astype(np.int64)
        rows = np.flatnonzero(whole)
        if len(rows):
            runs = np.split(ids, np.cumsum(lengths)[:-1])
            for row, found in zip(rows, self._ids([texts[r] for r in rows])):
                runs[row] = found
            ids = np.concatenate(runs)
            lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        return ids, lengths

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.zeros(len(texts), np.int64)
        found = [np.zeros(0, np.int32)]
        rows: list[int] = []
        raw: list[bytes] = []
        held = 0
        for row, text in enumerate(texts):
            if text:
                rows.append(row)
                raw.append(self.prefix + text.encode("utf-8", "surrogatepass"))
                held += len(raw[-1])
            if rows and (held >= _SLICE or row == len(texts) - 1):
                ids, sizes = self._piece([texts[r] for r in rows], raw)
                found.append(ids)
                lengths[rows] = sizes
                rows, raw, held = [], [], 0
        return np.concatenate(found), lengths


class Encoder(ChunkMemory):
    """``encode(texts)`` gives the ids of all texts in a row and each text's
    number of ids.  Equal to the library's ``encode(text, False)`` text by text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.mark = self._ids([f" {MARK}"])[0]
        # A word's first id shows its blank, or its last id shows its end.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.at_end = bool(suffix)
        blank = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ") or [("", None)]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        # Where normalizing means lowering for words of ASCII letters, they are
        # lowered here and need not be normalized.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        letters = [f" {c}" for c in ascii_letters]
        self.lowers = self.at_end and all(
            a.tolist() == b.ids
            for a, b in zip(
                self._ids(letters),
                self.plain.encode_batch_fast([c.lower() for c in letters], add_special_tokens=False),
            )
        )
        line = self._ids(["\n"])[0]
        self.line = int(line[0]) if len(line) == 1 else -1
        self.border = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.border[i] = token.endswith(suffix) if suffix else token.startswith(blank[0][0])
        self._tables()

    def _ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.asarray(e.ids, np.int32) for e in found]

    def _marked(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of many chunks, and how many each has, by one call over
        ``mark chunk mark chunk ...``: each chunk starts with white space, so
        the marks stay by themselves."""
        ids = self._ids(["".join(f" {MARK}{c}" for c in chunks)])[0]
        size = len(self.mark)
        if len(ids) < size:
            return None
        hits = np.ones(len(ids) - size + 1, bool)
        for k in range(size):
            hits &= ids[k : len(ids) - size + 1 + k] == self.mark[k]
        at = np.flatnonzero(hits)
        if len(at) != len(chunks):
            return None
        sizes = np.diff(np.append(at, len(ids))) - size
        return ragged(ids, at + size, sizes), sizes

    def _led(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for words, each with its blank, by one call over all."""
        text = "".join(chunks)
        if self.lowers and text.isascii():
            found = self.plain.encode_batch_fast([text.lower()], add_special_tokens=False)
            ids = np.asarray(found[0].ids, np.int32)
        else:
            ids = self._ids([text])[0]
        at = np.flatnonzero(self.border[ids])
        if len(at) != len(chunks):
            return None
        ends = at + 1 if self.at_end else np.append(at[1:], len(ids))
        return ids, np.diff(ends, prepend=0)

    def _bare(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for words without a blank: as with one where blanks leave no
        trace, else line by line."""
        if self.at_end:
            return self._led([f" {c}" for c in chunks])
        ids = self._ids(["\n".join(chunks) + "\n"])[0]
        at = np.flatnonzero(ids == self.line)
        if len(at) != len(chunks):
            return None
        sizes = np.diff(at, prepend=-1) - 1
        return ids[ids != self.line], sizes

    def _single(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(chunks)
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))

    def _new_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kinds: tuple[list[int], ...] = ([], [], [], [], [])
        for i, c in enumerate(chunks):
            led = c[:1] == " "
            if (c[1:] if led else c).isalpha():
                kinds[(0 if c.isascii() else 1) if led else 2].append(i)
            else:
                kinds[3 if c[:1] in (" ", "\n") and len(c) > 1 and MARK not in c else 4].append(i)
        one = [self._single]
        plans = ([self._led, self._marked], [self._led, self._marked], [self._bare], [self._marked], [])
        flats, sizes = [], []
        for kind, some in enumerate(kinds):
            for at in range(0, len(some), 20_000):
                own = [chunks[i] for i in some[at : at + 20_000]]
                found = next(f for way in plans[kind] + one if (f := way(own)) is not None)
                flats.append(found[0])
                sizes.append(found[1])
        flat, size = np.concatenate(flats), np.concatenate(sizes)
        place = np.argsort(np.concatenate(kinds).astype(np.int64))
        starts = np.cumsum(size) - size
        return ragged(flat, starts[place], size[place]), size[place]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file; kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
