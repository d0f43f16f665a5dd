"""Fast exact encoding with the ``tokenizers`` library: whole texts are cut where pre-tokenisation always cuts, and what
lies between two cuts is encoded once by the library and remembered. A piece is looked up by a 64-bit hash of its bytes,
and its bytes are compared with those remembered; a text with a piece that differs is encoded whole by the library, as are
texts that hold the string of a special token.

A cut before a single space (``space`` vocabularies: byte-level BPE, whose pre-tokens may begin with one space) or at a
space (``drop`` vocabularies, which drop white space) never changes the ids, as no pre-token reaches over it. Texts in
which runs of white space could reach over a cut are encoded whole by the library.
"""

from __future__ import annotations

import os
import re

import numpy as np

from assayloom.llm.shingles import LONG, MASK, first_lanes, lanes_of, piece_hashes
from assayloom.llm.worker import held

#: Segments that a worker remembers, about.
MEMO = 2_500_000
#: Bytes of long pieces that a worker remembers, about.
LONG_BYTES = 32_000_000
#: Texts are encoded in groups of at most so many characters or one text.
GROUP = 600_000
#: White space other than the space and the line feed.
RARE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: A word of Latin letters with at most one full stop or comma: pre-tokenisation gives the letters, then the mark.
SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?")


def byte_letters() -> dict[int, str]:
    """Latin-1 characters as the letters that stand for their UTF-8 bytes in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letter, other = {}, 0
    for byte in range(256):
        letter[byte] = chr(byte if byte in printable else 256 + other)
        other += byte not in printable
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class Memo:
    """An open-addressing table in arrays: a number for each hash."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers, -1 where unknown."""
        out = np.full(len(hashes), -1, np.int64)
        todo, mask = np.arange(len(hashes)), (1 << self.bits) - 1
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            key = self.keys[slot]
            same = key == hashes[todo]
            out[todo[same]] = self.values[slot[same]]
            more = ~same & (key != 0)
            todo, slot = todo[more], (slot[more] + 1) & mask
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Put in distinct unknown hashes."""
        while 10 * (self.size + len(hashes)) > 7 * len(self.keys):
            keys, values = self.keys[self.keys != 0], self.values[self.keys != 0]
            self.bits += 1
            self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(keys, values)
        self._place(hashes, numbers)
        self.size += len(hashes)

    def _place(self, hashes: np.ndarray, values: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            won = free & (self.keys[slot] == hashes)
            self.values[slot[won]] = values[won]
            hashes, values, slot = hashes[~won], values[~won], (slot[~won] + 1) & mask


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, at least so long."""
    return array if len(array) >= size else np.concatenate([array, np.zeros(max(size - len(array), len(array) // 2), array.dtype)])


class Encoder:
    """Ids of whole texts, as by the library with ``add_special_tokens=False``."""

    def __init__(self, path: str, style: str, most: int | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        if style not in ("space", "drop"):
            raise ValueError("style must be space or drop")
        self.tokenizer = Tokenizer.from_file(path)
        if any(t.normalized for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that are searched in the normalised text")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.style, self.most = style, most
        # The same model without its text handling, for words of which the result of that handling is plain.
        self.bare, self.letters = Tokenizer(self.tokenizer.model), byte_letters()
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.bare_between = f" {self.letters[1]} "
        self.bare_mark = self.bare.encode(self.bare_between, add_special_tokens=False).ids
        #: What stands between segments that are encoded in one call, and its id: a pre-token of its own.
        self.between = " \x01 " if style == "drop" else "\n"
        self.mark = self.direct([self.between])[0]
        self.forget()

    def forget(self) -> None:
        self.memo, self.count, self.used, self.kept = Memo(), 0, 0, 0
        self.long: dict[bytes, int] = {}
        self.long_bytes = 0
        self.flat, self.start, self.length = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        #: Sizes of the remembered pieces, and of those beyond eight bytes the bytes in eights and where they begin. The hash
        #: of a shorter piece is one to one with its bytes and size, so these stand for it.
        self.bytes, self.at, self.size = np.zeros(1 << 14, np.uint64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint8)

    def direct(self, texts: list[str]) -> list[list[int]]:
        """By the library alone."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bool:
        """Whether the library must encode the text as it is: it holds a special token, or white space could reach over a cut."""
        return any(x in text for x in self.special) or self.style == "space" and ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or RARE.search(text) is not None)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= GROUP):
                size += len(texts[end])
                end += 1
            out += self._group(texts[start:end])
            start = end
        return out

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        odd = [i for i, t in enumerate(texts) if self.whole(t)]
        ids = dict(zip(odd, self.direct([texts[i] for i in odd]), strict=True))
        most = self.most or MEMO
        if self.count > most or self.used > 8 * most or self.long_bytes > LONG_BYTES:
            self.forget()
        parts = [b"" if i in ids else t.encode() for i, t in enumerate(texts)]
        data = b"".join([*parts, bytes(8)])
        view = np.frombuffer(data, np.uint8)[:-8]
        begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        # A piece begins with a text, a space or a line feed; in style ``drop`` without that white space.
        white = (view == 32) | (view == 10)
        cuts = white.copy()
        cuts[begins[:-1][begins[:-1] < begins[1:]]] = True
        starts = np.flatnonzero(cuts)
        ends = np.append(starts[1:], len(view))[: len(starts)]
        first = np.searchsorted(starts, begins)  # first piece of each text
        if self.style == "drop" and len(starts):
            starts = starts + white[starts]
        places = self._places(data, starts, ends)
        for i in np.unique(np.searchsorted(first, np.flatnonzero(places < 0), "right") - 1).tolist():
            ids[i] = self.direct([texts[i]])[0]
        places[places < 0] = 0
        lengths = self.length[places]
        upto = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        flat = self.flat[np.repeat(self.start[places] - upto[:-1], lengths) + np.arange(upto[-1])]
        cut = upto[first]
        return [np.array(ids[i], np.uint32) if i in ids else flat[cut[i] : cut[i + 1]] for i in range(len(texts))]

    def _places(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each piece, learnt if new; -1 where another piece has its hash."""
        if not len(starts):
            return np.zeros(0, np.int64)
        lanes, sizes = lanes_of(data), ends - starts
        out = np.empty(len(starts), np.int64)
        long = np.flatnonzero(sizes > LONG)
        for i in long.tolist():
            piece = data[starts[i] : ends[i]]
            if piece not in self.long:
                self.long[piece] = self.count
                self.long_bytes += len(piece)
                self._learn([piece.decode()])
            out[i] = self.long[piece]
        short = np.flatnonzero(sizes <= LONG) if len(long) else np.arange(len(starts))
        starts, ends, sizes = starts[short], ends[short], sizes[short]
        lane = first_lanes(lanes, starts, sizes)
        hashes = piece_hashes(data, starts, ends, lanes, lane)
        places = self.memo.find(hashes)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            fresh, at = np.unique(hashes[missing], return_index=True)
            at = missing[at]
            numbers = np.arange(self.count, self.count + len(fresh))
            self._learn([data[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            self._keep(numbers, lanes, starts[at], sizes[at])
            self.memo.add(fresh, numbers.astype(np.int32))
            places[missing] = numbers[np.searchsorted(fresh, hashes[missing])]
        same = (self.size[places] == sizes) & (hashes != 1)  # 1 stands for 0 too
        todo, k = np.flatnonzero(same & (sizes > 8)), 0
        while len(todo):
            rest = sizes[todo] - 8 * k
            equal = self.bytes[self.at[places[todo]] + k] == lanes[starts[todo] + 8 * k] & MASK[np.minimum(rest, 8)]
            same[todo[~equal]] = False
            todo, k = todo[equal & (rest > 8)], k + 1
        out[short] = np.where(same, places, -1)
        return out

    def _keep(self, numbers: np.ndarray, lanes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the sizes of pieces, and the bytes of those beyond eight."""
        eights = np.where(sizes > 8, (sizes + 7) // 8, 0)
        begin = self.kept + np.cumsum(eights) - eights
        self.kept += int(eights.sum())
        self.bytes = grown(self.bytes, self.kept)
        self.at, self.size = grown(self.at, self.count), grown(self.size, self.count)
        self.at[numbers], self.size[numbers] = begin, sizes
        for k in range(int(eights.max())):
            i = np.flatnonzero(eights > k)
            self.bytes[begin[i] + k] = lanes[starts[i] + 8 * k] & MASK[np.minimum(sizes[i] - 8 * k, 8)]

    def _joined(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        return np.array(self.direct([self.between.join(words)])[0], np.uint32), self.mark

    def _bare(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """Simple words: letters and mark are pre-tokens; only bytes have to be spelt as letters."""
        text = "\n".join(words)
        text = (text if self.style == "space" else text.lower()).replace(".", "\r.").replace(",", "\r,").translate(self.letters)
        text = text.replace(self.letters[10], self.bare_between).replace(self.letters[13], " ")
        return np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32), self.bare_mark

    def _learn(self, plain: list[str]) -> None:
        """Encode new pieces: joined by marks, many in a call; those that could blur the marks one by one."""
        first, space = self.count, self.style == "space"
        simple, even, odd = [], [], []
        for i, s in enumerate(plain):
            if SIMPLE.fullmatch(s, 1 if space and s[:1] == " " else 0):
                simple.append(i)
            else:
                (odd if not s or ("\n" in s if space else "\x01" in s) else even).append(i)
        found: dict[int, np.ndarray] = {i: np.array(x, np.uint32) for i, x in zip(odd, self.direct([plain[i] for i in odd]), strict=True)}
        for places, join in ((simple, self._bare), (even, self._joined)):
            for at in range(0, len(places), 5000):
                part = places[at : at + 5000]
                words = [plain[i] for i in part]
                ids, mark = join(words)
                marks = np.flatnonzero(ids == mark[0]) if len(mark) == 1 else np.zeros(0, int)
                if len(marks) == len(part) - 1:
                    ends = [*marks.tolist(), len(ids)]
                    begin = 0
                    for i, end in zip(part, ends, strict=True):
                        found[i] = ids[begin:end]
                        begin = end + 1
                else:
                    found.update((i, np.array(x, np.uint32)) for i, x in zip(part, self.direct(words), strict=True))
        fresh = [found[i] for i in range(len(plain))]
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        total, end = int(sizes.sum()), first + len(fresh)
        self.start, self.length, self.flat = grown(self.start, end), grown(self.length, end), grown(self.flat, self.used + total)
        self.flat[self.used : self.used + total] = np.concatenate(fresh)
        self.length[first:end] = sizes
        self.start[first:end] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.count = end


def encoder(path: str, style: str, most: int | None = None) -> Encoder:
    """The encoder of this worker, kept from task to task; it remembers ``most`` pieces, ``MEMO`` by default."""
    return held(("encoder", path, style, most), lambda: Encoder(path, style, most))
