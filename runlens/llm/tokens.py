"""Exact encoding with public tokenizer files, one piece of a word at a time.

Both tokenizer kinds used here end every token where white space begins after
other text, and where letters end before ASCII punctuation, so a text's ids are
those of its pieces in order, and a bounded cache of pieces saves most of the
work. Pieces of letters alone are merged many at a time; the rest goes to the
library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: A piece is letters with what stands before them, cut where an ASCII character that is no letter (or white space, or the end) follows: every token ends there.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
LED_WORDS = re.compile(rf"[ \t\n\r]*+[^ \t\n\r{LETTERS}]*+[{LETTERS}]++(?![^\x00-\x7f])|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
ODD_SPACE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Special tokens begin so; texts that hold it are left to the library whole.
MARK = "<|"
#: Pieces that each of a worker's two cache generations holds, units in a table, characters of texts encoded together, bytes of a piece that is merged with others.
CACHE, KEPT, TOGETHER, SHORT = 300_000, 600_000, 1 << 20, 60


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def led_chunks(text: str) -> list[str]:
    """Words with the white space before them; the whole text if it holds white space that only the library tells apart."""
    return [text] if ODD_SPACE.search(text) or MARK in text else LED_WORDS.findall(text)


def byte_letters() -> list[str]:
    """The character that a byte-level vocabulary shows for each byte: printable ones themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """Byte-pair merging of many short pieces at once.

    Pieces of about one length are columns of a matrix of ids. In each round
    every piece merges its pair of the least rank, the leftmost of equal ones,
    until none has a pair left.
    """

    NONE = 1 << 30

    def __init__(self, model: dict):
        vocab, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.mask = (1 << max(4, (4 * len(pairs)).bit_length())) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -2, np.int64), np.zeros(self.mask + 1, np.int32)
        keys = np.array([vocab[a] << 24 | vocab[b] for a, b in pairs], np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self.places(keys).tolist())):
            while self.keys[at] >= 0:
                at = at + 1 & self.mask
            self.keys[at], self.ranks[at] = key, rank

    def places(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where it doesn't merge (an id of -1 never does)."""
        keys = left.astype(np.int64) << 24 | right
        at = self.places(keys)
        got = self.keys[at]
        hit = got == keys
        out = np.where(hit, self.ranks[at], self.NONE >> 6)
        on = np.flatnonzero(~hit & (got >= 0))
        while len(on):
            at[on] = at[on] + 1 & self.mask
            got = self.keys[at[on]]
            hit = got == keys[on]
            out[on[hit]] = self.ranks[at[on[hit]]]
            on = on[~hit & (got >= 0)]
        return out

    def columns(self, words: list[bytes]) -> np.ndarray:
        """Ids of pieces of at most SHORT bytes, a row each, -1 after the last."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        high, n = int(lengths.max()), len(words)
        chars = np.frombuffer(b"".join(w.ljust(high, b"\0") for w in words), np.uint8).reshape(n, high).T
        ids = np.full((high + 1, n), -1, np.int32)
        ids[:high] = np.where(np.arange(high)[:, None] < lengths, self.first[chars], -1)
        ids[lengths - 1, np.arange(n)] = self.last[chars[lengths - 1, np.arange(n)]]
        best = np.full((high + 1, n), self.NONE, np.int32)  # rank and place of each pair
        for j in range(high - 1):
            best[j] = self.rank(ids[j], ids[j + 1]) << 6 | j
        best[ids == -1] = self.NONE
        out, live = np.full((n, high), -1, np.int32), np.arange(n)
        while len(live):
            least = best.min(0)
            go = least < self.NONE - 64
            if not go.all():
                out[live[~go], : len(ids) - 1] = ids[:-1, ~go].T
                live, ids, best, least = live[go], ids[:, go], best[:, go], least[go]
                if not len(live):
                    break
            at, new, here = least & 63, self.made[least >> 6], np.arange(len(live))
            for j in range(int(at.min()), len(ids) - 1):
                after = at < j
                ids[j] = np.where(after, ids[j + 1], ids[j])
                best[j] = np.where(after, best[j + 1] - 1, best[j])
            ids[at, here] = new
            ids, best = ids[:-1], best[:-1]
            best[at, here] = self.rank(new, ids[np.minimum(at + 1, len(ids) - 1), here]) << 6 | at
            best[at, here] = np.where(at + 1 < len(ids), best[at, here], self.NONE)
            led = np.flatnonzero(at > 0)
            best[at[led] - 1, led] = self.rank(ids[at[led] - 1, led], new[led]) << 6 | at[led] - 1
        return out

    def merge(self, pieces: list[str], lower: bool) -> dict[str, bytes]:
        """Ids of pieces that are one word each to the tokenizer, as little-endian 32-bit numbers."""
        words = [p.encode() for p in (" ".join(pieces).lower().split(" ") if lower else pieces)]
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out: dict[str, bytes] = {}
        for k in range(0, len(order), 8192):
            some = order[k : k + 8192]
            ids = self.columns([words[i] for i in some])
            ends = np.cumsum((ids >= 0).sum(1)) * 4
            raw, a = ids[ids >= 0].astype("<u4").tobytes(), 0
            for i, b in zip(some, ends.tolist()):
                out[pieces[i]] = raw[a:b]
                a = b
        return out


class Chunks:
    """Ids of pieces, as little-endian 32-bit numbers, from two cache generations (the older is dropped when the newer is full), else merged."""

    held: dict[str, Chunks] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path) as f:
            model = json.load(f)["model"]
        self.lower = bool(model.get("end_of_word_suffix"))
        self.merges = Merges(model)
        self.easy = re.compile(rf"{'' if self.lower else ' '}[{LETTERS}]+")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Chunks:
        """One for each worker process and file."""
        return cls.held.get(path) or cls.held.setdefault(path, cls(path))

    def merge(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Exact ids of each piece by the tokenizer's own merges."""
        easy: list[str] = []
        rest: list[str] = []
        for c in chunks:
            (easy if 2 * len(c) <= SHORT and self.easy.fullmatch(c) else rest).append(c)
        out = self.merges.merge(easy, self.lower) if easy else {}
        for c, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False) if rest else ()):
            out[c] = np.array(e.ids, "<u4").tobytes()
        return out

    def fill(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Put the pieces into the newer generation; returns those too long to be kept."""
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = [c for c in chunks if c not in new]
        if old:
            new.update((c, old[c]) for c in missing if c in old)
            missing = [c for c in missing if c not in new]
        merged = self.merge(missing) if missing else {}
        new.update((c, x) for c, x in merged.items() if len(c) <= 200)
        return {c: x for c, x in merged.items() if len(c) > 200}

    def each(self, chunks: set[str]) -> dict[str, bytes]:
        long = self.fill(chunks)
        return {c: long[c] if c in long else self.new[c] for c in chunks}


class Units:
    """Encodes whole texts for a lower-casing tokenizer that drops white space.

    Bytes of many texts are classed at once: white space, letters (A-Z and the
    Latin letters of U+00C0 to U+00FF), other ASCII. A run of letters or of other
    ASCII is a unit, whose ids don't depend on what stands beside it; a word is
    one unit if it holds any other character, or letters right after an
    apostrophe. Units of at most 24 bytes are looked up by their bytes in a
    table of KEPT entries at most; the rest is merged or goes to the library.
    """

    held: dict[str, Units] = {}

    def __init__(self, path: str):
        self.chunks = Chunks.of(path)
        self.kinds = np.full(256, 3, np.uint8)
        self.kinds[33:127] = 2
        self.kinds[[9, 10, 13, 32]] = 0
        self.kinds[[*range(65, 91), *range(97, 123)]] = 1
        self.small = np.arange(256, dtype=np.uint8)
        self.small[65:91] += 32
        self.masks = np.array([[(1 << 8 * min(8, max(0, n - 8 * k))) - 1 for k in range(3)] for n in range(25)], np.uint64)
        self.clear()

    @classmethod
    def of(cls, path: str) -> Units:
        return cls.held.get(path) or cls.held.setdefault(path, cls(path))

    def clear(self) -> None:
        self.slots = np.full(4 * KEPT, -1, np.int32)
        self.keys, self.n = np.zeros((KEPT + 1, 3), np.uint64), 0
        self.pool, self.ends = np.zeros(1 << 20, np.uint32), np.zeros(KEPT + 2, np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        x = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) + keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) + keys[:, 2] * np.uint64(0x165667B19E3779F9)
        return ((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(24)).astype(np.int64) % len(self.slots)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 if there is none."""
        at, out = self.places(keys), np.full(len(keys), -1, np.int64)
        on = np.arange(len(keys))
        while len(on):
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == keys[on]).all(1)
            out[on[hit]] = got[hit]
            more = (got >= 0) & ~hit
            on, at = on[more], (at[more] + 1) % len(self.slots)
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Enter distinct keys that aren't there; the ids of each end at ``ends``."""
        n, m, base = self.n, len(keys), int(self.ends[self.n])
        self.keys[n : n + m], self.ends[n + 1 : n + m + 1], self.n = keys, base + ends, n + m
        if base + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) + len(ids), np.uint32)])
        self.pool[base : base + len(ids)] = ids
        at, on = self.places(keys), np.arange(n, n + m, dtype=np.int32)
        while len(on):
            free = self.slots[at] < 0
            self.slots[at[free]] = on[free]
            more = self.slots[at] != on
            on, at = on[more], (at[more] + 1) % len(self.slots)

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends) for runs of texts, in order: the ids of all of them and where each text's end."""
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= TOGETHER or i + 1 == len(texts):
                yield self.encode_run(texts[start : i + 1])
                start, size = i + 1, 0

    def encode_run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = {i: t for i, t in enumerate(texts) if MARK in t}
        raw = [b"" if i in special else t.encode("utf-8", "surrogatepass") for i, t in enumerate(texts)]
        first = np.cumsum([1, *(len(r) + 1 for r in raw)])
        whole = b" " + b" ".join(raw) + b" " * 33
        data = np.frombuffer(whole, np.uint8)
        kind, low = self.kinds[data], self.small[data]
        pair = np.flatnonzero(data == 0xC3)
        after = data[pair + 1]
        good = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
        pair, after = pair[good] + 1, after[good]
        kind[pair - 1] = kind[pair] = 1
        low[pair] = np.where(after <= 0x9E, after + 0x20, after)
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        begin, stop, what = change[:-1], change[1:], kind[change[:-1]]
        odd = (what == 3) | (what == 1) & (data[begin - 1] == 39)
        if odd.any():  # their words become one unit each
            word = np.cumsum(what == 0)
            bad = np.zeros(int(word[-1]) + 1, bool)
            bad[word[odd]] = True
            bad = bad[word] & (what > 0)
            head = bad & np.append(True, word[1:] != word[:-1]) | bad & np.append(True, what[:-1] == 0)
            tail = bad & np.append(what[1:] == 0, True)
            stop = stop.copy()
            stop[head] = stop[tail]
            what = np.where(head, 4, what)
            keep = (what > 0) & (~bad | head)
        else:
            keep = what > 0
        begin, stop, what = begin[keep], stop[keep], what[keep]
        size = stop - begin
        quick = np.flatnonzero((what < 3) & (size <= 24))
        eight = np.ndarray((len(low) - 8,), "<u8", low, strides=(1,))
        at, masks = begin[quick], self.masks[size[quick]]
        keys = np.stack([eight[at + 8 * k] & masks[:, k] for k in range(3)], 1)
        entry = self.find(keys)
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            new, one, back = np.unique(keys[lost].view("V24").ravel(), return_index=True, return_inverse=True)
            if self.n + len(new) > KEPT:
                self.clear()
                return self.encode_run(texts) if len(new) < KEPT else self.by_library(texts)
            one = quick[lost[one]]
            shown = low.tobytes()
            words = [shown[a:b] for a, b in zip(begin[one].tolist(), stop[one].tolist())]
            order, ids, counts = self.ids_of(words, what[one] == 1)
            rank = np.empty_like(order)
            rank[order] = self.n + np.arange(len(order))
            self.add(new.view(np.uint64).reshape(-1, 3)[order], ids, np.cumsum(counts))
            entry[lost] = rank[back]
        pool, ends = self.pool, self.ends
        starts, counts = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        starts[quick], counts[quick] = ends[entry], ends[entry + 1] - ends[entry]
        slow = np.flatnonzero((what > 2) | (size > 24))
        if len(slow) or special:
            pieces = [whole[a:b].decode("utf-8", "surrogatepass") for a, b in zip(begin[slow].tolist(), stop[slow].tolist())]
            found = self.chunks.each({*pieces})
            extra = [np.frombuffer(found[p], "<u4") for p in pieces]
            counts[slow] = [*map(len, extra)]
            starts[slow] = ends[self.n] + np.cumsum([0, *map(len, extra)])[:-1]
            pool = np.concatenate([pool[: ends[self.n]], *extra])
        total = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.repeat(starts - total[:-1], counts) + np.arange(total[-1])]
        upto = total[np.searchsorted(begin, first[1:])]
        if special:
            return self.with_special(ids, upto, special)
        return ids, upto

    def ids_of(self, words: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, counts) of distinct units: runs of letters merged together, then others by the library."""
        runs = sorted(np.flatnonzero(letters).tolist(), key=lambda i: len(words[i]))
        rest = np.flatnonzero(~letters).tolist()
        ids, counts = [], []
        for k in range(0, len(runs), 8192):
            rows = self.chunks.merges.columns([words[i] for i in runs[k : k + 8192]])
            ids.append(rows[rows >= 0].astype(np.uint32))
            counts.append((rows >= 0).sum(1))
        for e in self.chunks.library.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False) if rest else ():
            ids.append(np.array(e.ids, np.uint32))
            counts.append([len(e.ids)])
        return np.array(runs + rest), np.concatenate(ids), np.concatenate(counts).astype(np.int64)

    def with_special(self, ids: np.ndarray, upto: np.ndarray, special: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
        """The same with the texts that may hold special tokens, which the library encodes whole."""
        each = np.split(ids, upto[:-1])
        for (i, _), e in zip(special.items(), self.chunks.library.encode_batch_fast([*special.values()], add_special_tokens=False)):
            each[i] = np.array(e.ids, np.uint32)
        return np.concatenate(each), np.cumsum([*map(len, each)])

    def by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.with_special(np.zeros(0, np.uint32), np.zeros(len(texts), np.int64), dict(enumerate(texts)))
