"""Token ids in files of range-coded blocks.

Texts are encoded by a public tokenizer, documents go to files in ascending
doc_id order, and a file holds its ids in blocks of ``BLOCK`` ids that are coded
and decoded independently: each starts from a fresh model and has a checksum.

The coder is a range coder with a 48-bit interval.  An id is predicted at three orders:

* order 2 and order 1: the id that last followed the two (one) ids before, with a
  confidence that grows with hits, and adaptive hit rates by confidence;
* order 0: classes of ids of like frequency, named in the head of a group of blocks.

What the three say of the likeliest id is mixed with adaptive weights that follow how
well each order did lately; the mix codes whether the id is that one.  Any other id is
coded by order 0: its class by frequencies that a block adapts, then its number in
the class.  Weights, rates, tables and class frequencies start anew in every block.

All model arithmetic is on integers, so any machine decodes what another wrote.
The blocks of a group advance in lockstep, one id a step, as numpy vectors over
up to ``LANES`` blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.llm import words as W
from pairlab.llm.base import shared_path, table, written
from pairlab.llm.files import new_file, open_in, open_out

BLOCK, LANES = 4096, 2048
END_ID = 1
#: contexts that a block's prediction tables tell apart
_SLOT_BITS = 11
SLOTS = 1 << _SLOT_BITS
_MAGIC = b"PLTOKEN2"
#: scale of hit rates and class frequencies
_BITS = 14
_ONE = 1 << _BITS
#: an id is coded from an interval of this width or more (at most 48 bits); narrower ones give out 16 bits
_LEAST = 1 << 32
#: classes of order 0, how fast a block's frequencies of them (and the weights of the
#: orders) follow its ids, and at each how many ids they do
CLASSES, _RATE, _EVERY = 16, 4, 4
#: a class of more ids than this numbers them in two steps, the lower of so many bits
_WIDE, _LOW = 1 << 15, 12

# where the share of each class starts before the first id, and what each class pulls the starts to
_FRESH = (np.arange(CLASSES) * (_ONE // CLASSES)).astype(np.int16)
_WHOLE, _SHIFT = np.int32(_ONE), np.uint32(32 - _SLOT_BITS)
_STEP = np.array([1, 0x9E3779B1, 0x85EBCA6B], dtype=np.uint32)
_PULL = np.array([[j if j <= s else _ONE - CLASSES + j for j in range(CLASSES)] for s in range(CLASSES)], dtype=np.int16)


class Classes:
    """Order 0 of a group of blocks: its ids by classes of like frequency (factors of two).

    ``of[id]`` is the class of an id (255: not in the group), ``chance[id]`` its share
    of the group's ids; inside a class ids are numbered in ascending order.
    """

    def __init__(self, of: np.ndarray):
        self.of = of
        self.order = np.argsort(of, kind="stable")[:int((of < CLASSES).sum())]
        self.size = np.bincount(of[self.order], minlength=CLASSES)
        self.first = np.cumsum(self.size) - self.size
        self.place = np.zeros(len(of), np.int64)
        self.place[self.order] = np.arange(len(self.order)) - np.repeat(self.first, self.size)
        self.chance = np.maximum(_ONE >> 2 >> np.minimum(of, CLASSES).astype(np.int32), 1).astype(np.int32)

    @classmethod
    def count(cls, ids: np.ndarray) -> Classes:
        n = np.bincount(ids)
        of = np.full(len(n), 255, np.uint8)
        seen = np.flatnonzero(n)
        if len(seen):
            of[seen] = np.minimum(np.log2(n.max() / n[seen]), CLASSES - 1).astype(np.uint8)
        return cls(of)

    def to_bytes(self) -> bytes:
        return zlib.compress(self.of.tobytes(), 6)

    @classmethod
    def from_bytes(cls, b: bytes) -> Classes:
        return cls(np.frombuffer(zlib.decompress(b), np.uint8))


class _Model:
    """The adaptive state of ``n`` blocks, and the steps that encoder and decoder share."""

    def __init__(self, n: int, classes: Classes):
        self.n, self.classes = n, classes
        lane = np.arange(n)
        #: orders 2 and 1 as rows; by context: the id that followed last, times 4, plus the confidence
        self.said = np.zeros(2 * n * SLOTS, np.int32)
        self.slots = np.stack([lane, n + lane]) * SLOTS
        self.rate = np.tile(np.array([_ONE >> 6, _ONE >> 2, _ONE >> 1, _ONE * 3 >> 2], np.int32), 2 * n)
        self.cells = np.stack([lane, n + lane]) * 4
        self.weight = [np.full(n, _ONE // 2, np.int32), np.full(n, _ONE // 2, np.int32), np.full(n, _ONE // 16, np.int32)]
        self._share()
        #: by block, where the share of each class starts; a 0 after the last
        self.starts = np.concatenate([np.tile(_FRESH, n), _FRESH[:1]])
        self.rows = self.starts[:-1].reshape(n, CLASSES)
        #: hashes of the two contexts, and of the id before alone
        self.hash = np.zeros((2, n), np.uint32)

    def _share(self) -> None:
        self.share = ((1 << 30) // (self.weight[0] + self.weight[1] + self.weight[2])).astype(np.int64)

    def part(self, blocks: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the share of class ``of`` starts in each of ``blocks``, and how wide it is (the last ends at the whole)."""
        at = blocks * CLASSES + of
        below = self.starts[at]
        return below, (self.starts[at + 1] - below) & (_ONE - 1)

    def predict(self) -> None:
        """The likeliest id of each block and its probability, mixed from what orders 2, 1 and 0 say of it."""
        self.at = self.slots + (self.hash >> _SHIFT).astype(np.int64)
        said = self.said[self.at]
        self.guess, self.conf = said >> 2, said & 3
        self.cell = self.cells + self.conf.astype(np.int64)
        self.rates = self.rate[self.cell]
        self.first = np.where(self.conf[0] > 0, self.guess[0], self.guess[1])
        two, one = self.rates
        one = np.where(self.guess[1] == self.first, one, _ONE - one >> 4)
        self.votes = two, one, self.classes.chance.take(self.first, mode="clip")
        w = self.weight
        p = (w[0] * two + w[1] * one + w[2] * self.votes[2]).astype(np.int64) * self.share >> 30
        self.p_first = np.minimum(np.maximum(p, 32), _ONE - 32)

    def learn(self, step: int, ids: np.ndarray, hit: np.ndarray, missed: np.ndarray, of: np.ndarray) -> None:
        """``missed``: the blocks whose id was coded by order 0, ``of`` its class."""
        right = ((self.guess == ids) & (self.conf > 0)).astype(np.int32)
        # the next confidence: 1 after a wrong guess or none, else one more (at most 3)
        self.said[self.at] = ids << 2 | np.minimum(self.conf, 2) * right + 1
        if step % _EVERY == 1:  # the rate of a context that said nothing is never asked for
            self.rate[self.cell] = self.rates + ((right * _WHOLE - self.rates) >> 4)
        elif step % _EVERY == 2:
            for k in range(3):
                w = self.weight[k]
                w += (np.where(hit, self.votes[k], _ONE - self.votes[k]) - w) >> 3
                np.maximum(w, 64, out=w)
            self._share()
        elif step % _EVERY == 3 and len(missed):
            rows = self.rows.take(missed, axis=0)
            rows += (_PULL.take(of, axis=0) - rows) >> _RATE
            self.rows[missed] = rows
        # the context of one id, and with it that of two
        one = (ids.view(np.uint32) + _STEP[0]) * _STEP[1]
        np.add(one * _STEP[2], self.hash[1], out=self.hash[0])
        self.hash[1] = one


def encode_blocks(ids: np.ndarray, classes: Classes) -> list[bytes]:
    """``ids`` cut into blocks, each coded on its own (lane ``i`` codes block ``i``)."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return []
    size = np.full(n, BLOCK)
    size[-1] = len(ids) - BLOCK * (n - 1)
    padded = np.full(n * BLOCK, classes.order[0], np.int32)
    padded[:len(ids)] = ids
    grid = np.ascontiguousarray(padded.reshape(n, BLOCK).T)
    model = _Model(n, classes)
    low, width = np.zeros(n, np.int64), np.full(n, (1 << 48) - 1, np.int64)
    digits = np.zeros((n, BLOCK // 2), np.uint32)  # 16 bits each, and a carry until the end
    used = np.ones(n, np.int64)  # digit 0 takes a carry out of the first

    def shift(lanes: np.ndarray, lows: np.ndarray, widths: np.ndarray) -> None:
        """Give out 16 bits while the interval is narrow."""
        small, = (widths < _LEAST).nonzero()
        while len(small):
            own, low = lanes[small], lows[small]
            at = used[own]
            digits[own, at] = low >> 32
            used[own] = at + 1
            lows[small] = (low & 0xFFFFFFFF) << 16
            now = widths[small] << 16
            widths[small] = now
            small = small[now < _LEAST]

    def uniform(lanes: np.ndarray, lows: np.ndarray, widths: np.ndarray, value: np.ndarray, of: np.ndarray) -> None:
        widths //= of
        lows += widths * value
        shift(lanes, lows, widths)

    everyone = np.arange(n)
    most = 6  # digits that an id can give out
    for step in range(int(size.max())):
        live = everyone if step < size[-1] else everyone[:-1]
        x = grid[step]
        if step % 64 == 0 and int(used.max()) + 64 * most + 4 > digits.shape[1]:
            digits = np.concatenate([digits, np.zeros((n, max(BLOCK // 2, 64 * most)), np.uint32)], axis=1)
        model.predict()
        hit = model.first == x
        part = (width >> _BITS) * model.p_first
        lows, widths = np.where(hit, low, low + part), np.where(hit, part, width - part)
        if len(live) < n:  # the last block has ended
            lows[-1], widths[-1] = low[-1], width[-1]
        low, width = lows, widths
        missed, = (~hit[:len(live)]).nonzero()
        other = x[missed]
        of = classes.of[other].astype(np.int64)
        if len(missed):
            below, share = model.part(missed, of)
            lows, widths = low[missed], width[missed]
            unit = widths >> _BITS
            lows += unit * below
            widths = unit * share
            shift(missed, lows, widths)
            place, many = classes.place[other], classes.size[of]
            big = np.flatnonzero(many > _WIDE)
            if len(big):  # a class of many ids: the upper part of the number first
                l, w = lows[big], widths[big]
                uniform(missed[big], l, w, place[big] >> _LOW, (many[big] - 1 >> _LOW) + 1)
                lows[big], widths[big] = l, w
                place[big] &= (1 << _LOW) - 1
                many[big] = 1 << _LOW
            widths //= many
            lows += widths * place
            low[missed], width[missed] = lows, widths
        shift(everyone, low, width)
        model.learn(step, x, hit, missed, of)
    digits = np.concatenate([digits, np.zeros((n, 4), np.uint32)], axis=1)
    for _ in range(3):
        digits[everyone, used] = low >> 32
        used += 1
        low = (low & 0xFFFFFFFF) << 16
    digits = digits[:, :int(used.max())]
    while (digits >> 16).any():  # carries move up until none is left
        carry = digits >> 16
        digits &= 0xFFFF
        digits[:, :-1] += carry[:, 1:]
    return [digits[i, 1:used[i]].astype(">u2").tobytes() for i in range(n)]


def decode_blocks(payloads: list[bytes], sizes: list[int], classes: Classes) -> np.ndarray:
    """The ids of blocks; all but the last must be full."""
    n = len(payloads)
    if not n:
        return np.zeros(0, np.int64)
    size = np.array(sizes)
    length = np.array([len(p) // 2 for p in payloads])
    start = np.cumsum(length + 4) - (length + 4)
    source = np.frombuffer(b"".join(p + bytes(8) for p in payloads), ">u2").astype(np.uint16)
    model = _Model(n, classes)
    code, width, at = np.zeros(n, np.int64), np.full(n, (1 << 48) - 1, np.int64), start.copy()
    for _ in range(3):
        code = code << 16 | source[at]
        at += 1
    grid = np.zeros((int(size.max()), n), np.int32)
    everyone = np.arange(n)
    stop = start + length + 3

    def shift(lanes: np.ndarray, codes: np.ndarray, widths: np.ndarray) -> None:
        small, = (widths < _LEAST).nonzero()
        while len(small):
            own = lanes[small]
            place = at[own]
            codes[small] = codes[small] << 16 | source[np.minimum(place, stop[own])]
            at[own] = place + 1
            now = widths[small] << 16
            widths[small] = now
            small = small[now < _LEAST]

    def uniform(lanes: np.ndarray, codes: np.ndarray, widths: np.ndarray, of: np.ndarray) -> np.ndarray:
        widths //= of
        value = np.minimum(codes // widths, of - 1)
        codes -= widths * value
        shift(lanes, codes, widths)
        return value

    for step in range(len(grid)):
        live = everyone if step < size[-1] else everyone[:-1]
        model.predict()
        part = (width >> _BITS) * model.p_first
        hit = code < part
        code, width = np.where(hit, code, code - part), np.where(hit, part, width - part)
        missed, = (~hit[:len(live)]).nonzero()
        x = model.first.copy()
        of = np.zeros(0, np.int64)
        if len(missed):
            codes, widths = code[missed], width[missed]
            unit = widths >> _BITS
            value = np.minimum(np.maximum(codes // unit, 0), _ONE - 1).astype(np.int16)
            # classes that start at the value or before it, as bytes of 1, eight at once
            started = np.bitwise_count((model.rows.take(missed, axis=0) <= value[:, None]).view(np.uint64))
            of = (started[:, 0] + started[:, 1]).astype(np.int64) - 1
            below, share = model.part(missed, of)
            codes -= unit * below
            widths = unit * share
            shift(missed, codes, widths)
            many = classes.size[of]
            np.maximum(many, 1, out=many)  # an empty class comes only from damaged bytes, which the checksum finds
            place = np.zeros(len(missed), np.int64)
            big = np.flatnonzero(many > _WIDE)
            if len(big):
                c, w = codes[big], widths[big]
                place[big] = uniform(missed[big], c, w, (many[big] - 1 >> _LOW) + 1) << _LOW
                codes[big], widths[big] = c, w
                many[big] = 1 << _LOW
            widths //= many
            own = np.minimum(codes // widths, many - 1)
            codes -= widths * own
            place += own
            code[missed], width[missed] = codes, widths
            x[missed] = classes.order.take(classes.first.take(of) + place, mode="clip")
        shift(everyone, code, width)  # a lane past its end goes on alone, and is cut off below
        grid[step] = x
        model.learn(step, x, hit, missed, of)
    return np.concatenate([grid[:size[i], i] for i in range(n)]).astype(np.int64)


class TokenWriter:
    """Writes documents' ids: groups of blocks, then the documents, then a footer."""

    def __init__(self, path: str):
        self.path, self.out, self.held, self.n_held = path, open_out(path), [], 0
        self.ids, self.null, self.sizes = [], [], []
        self.at = self.out.write(_MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK * LANES:
            flat = np.concatenate(self.held)
            whole = len(flat) // (BLOCK * LANES) * BLOCK * LANES
            for i in range(0, whole, BLOCK * LANES):
                self._group(flat[i:i + BLOCK * LANES])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _group(self, ids: np.ndarray) -> None:
        classes = Classes.count(ids)
        blocks, order = encode_blocks(ids, classes), classes.to_bytes()
        parts = [ids[i:i + BLOCK] for i in range(0, len(ids), BLOCK)]
        head = struct.pack("<III", len(blocks), len(order), zlib.crc32(order)) + order + b"".join(
            struct.pack("<III", len(p), len(b), zlib.crc32(p.astype("<u4").tobytes())) for p, b in zip(parts, blocks, strict=True))
        self.at += self.out.write(head + b"".join(blocks))

    def close(self) -> None:
        flat = np.concatenate([np.zeros(0, np.int64), *self.held])
        if len(flat):
            self._group(flat)
        docs = np.array(self.ids, "<i8").tobytes() + np.array(self.null, "u1").tobytes() + np.array(self.sizes, "<u8").tobytes()
        self.out.write(docs + struct.pack("<QQI", self.at, len(self.ids), zlib.crc32(docs)) + _MAGIC)
        self.out.close()


def read_tokens(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file's documents, in order; a block that fails its checksum raises."""
    source = open_in(path)
    size = source.size()
    source.seek(size - 28)
    foot = source.read(28)
    at, n, crc = struct.unpack("<QQI", foot[:20])
    if foot[20:] != _MAGIC:
        raise ValueError(f"{path} is not a token file")
    source.seek(at)
    docs = source.read(17 * n)
    if zlib.crc32(docs) != crc:
        raise ValueError(f"{path}: damaged list of documents")
    doc_ids, null, sizes = np.frombuffer(docs, "<i8", n), np.frombuffer(docs, "u1", n, 8 * n), np.frombuffer(docs, "<u8", n, 9 * n).astype(np.int64)
    source.seek(len(_MAGIC))
    held, k = np.zeros(0, np.int64), 0
    for i in range(n):
        parts = []
        need = int(sizes[i])
        while need:
            if k == len(held):
                held, k = _read_group(source, path), 0
            part = held[k:k + need]
            parts.append(part)
            k += len(part)
            need -= len(part)
        yield None if null[i] else int(doc_ids[i]), np.concatenate([np.zeros(0, np.int64), *parts])
    source.close()


def _read_group(source, path: str) -> np.ndarray:
    n, size, crc = struct.unpack("<III", source.read(12))
    order = source.read(size)
    if zlib.crc32(order) != crc:
        raise ValueError(f"{path}: damaged head of a group")
    head = list(struct.iter_unpack("<III", source.read(12 * n)))
    ids = decode_blocks([source.read(h[1]) for h in head], [h[0] for h in head], Classes.from_bytes(order))
    at = 0
    for size, _, crc in head:
        if zlib.crc32(ids[at:at + size].astype("<u4").tobytes()) != crc:
            raise ValueError(f"{path}: a block does not match its checksum")
        at += size
    return ids


# kinds of bytes as bits: white space none, letters (ASCII, or after C3 in UTF-8), other ASCII marks, the rest
_SPACE, _LETTER, _MARK, _REST = 0, 1, 2, 4
_KIND = np.full(256, _REST, np.uint8)
_KIND[33:127] = _MARK
_KIND[[0x27, *range(48, 58)]] = _REST  # an apostrophe may begin an ending, digits stand alone
_KIND[[*range(65, 91), *range(97, 123), 0xC3]] = _LETTER
_KIND[W.SPACE] = _SPACE


def pieces(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = _KIND) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words cut where a tokenizer cuts them for certain: starts, ends, first piece per text, and which are plain.

    A word of letters and marks only is cut between the two; any other word is one
    piece.  A plain piece is letters only or marks only, so it is one unit of the
    tokenizer's splitting.
    """
    kind = kinds[data]
    lead = np.flatnonzero(data == 0xC3)
    if len(lead):
        after = np.minimum(lead + 1, len(data) - 1)
        letter = (data[after] != 0x97) & (data[after] != 0xB7)  # the signs of multiplication and division
        kind[after] = np.where(letter, _LETTER, _REST)
        kind[lead[~letter]] = _REST
    start, end, first = W.spans(data, offsets)
    if not len(start):
        return start, end, first, np.zeros(0, dtype=bool)
    has = np.bitwise_or.reduceat(kind, start)
    mixed = has == _LETTER | _MARK
    mark = np.zeros(len(data) + 1, np.int8)  # 1 inside words of letters and marks
    mark[start[mixed]] = 1
    mark[end[mixed]] -= 1
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) & np.cumsum(mark[:-1], dtype=np.int8)[1:].view(bool)
    cut[start] = False
    extra = np.flatnonzero(cut)
    cut[start] = True
    starts = np.flatnonzero(cut[:-1])
    cut[start] = False
    cut[end] = True
    cut[extra] = True
    ends = np.flatnonzero(cut)
    cut[:] = False
    cut[start] = True
    plain = (has < _REST)[np.cumsum(cut[starts]) - 1]
    return starts, ends, np.searchsorted(starts, offsets), plain


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes ascending, a place of each, and for every hash which it is (``np.unique`` without its stable sort)."""
    order = np.argsort(h)
    ranked = h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], order[new], back


class WordEncoder:
    """Ids of texts by a tokenizer whose tokens never span ASCII white space.

    A distinct piece of a word is encoded once and kept (up to ``KEEP`` pieces, as
    arrays sorted by hash; fresh ones apart until there are many), so the cost follows
    the vocabulary, not the length of the corpus.  Where the vocabulary marks ends of
    words, new plain pieces are encoded many at a time.
    """

    KEEP, FRESH, TOGETHER = 2_000_000, 1 << 16, 256

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        # words that may hold an added token stay whole
        self.kinds = _KIND.copy()
        for token in self.tokenizer.get_added_tokens_decoder().values():
            marks = [x for x in token.content.encode() if _KIND[x] == _MARK]
            self.kinds[marks or self.kinds != _SPACE] = _REST
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.known, self.fresh = none, none  # hashes, where their ids start, how many
        self.ids, self.n = np.zeros(1 << 16, np.int32), 0

    @staticmethod
    def _merge(a: tuple, b: tuple) -> tuple:
        at = np.searchsorted(a[0], b[0])
        return tuple(np.insert(x, at, y) for x, y in zip(a, b, strict=True))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int32)

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are one unit each: joined by blanks, and parted at the ids that end words."""
        if not self.ends.any():
            return self._encode(words)
        groups = [words[i:i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        flat, size = self._encode([" ".join(g) for g in groups])
        stop = np.flatnonzero(self.ends[flat]) + 1
        if len(stop) != len(words) or (stop[np.cumsum([len(g) for g in groups]) - 1] != np.cumsum(size)).any():
            return self._encode(words)
        return flat, np.diff(np.concatenate([[0], stop])).astype(np.int32)

    def _learn(self, hashes: np.ndarray, words: list[str], plain: np.ndarray) -> None:
        for mine, encode in ((plain, self._encode_plain), (~plain, self._encode)):
            if mine.any():
                flat, size = encode([words[i] for i in np.flatnonzero(mine).tolist()])
                self._keep(hashes[mine], flat, size)

    def _keep(self, hashes: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        if self.n + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.n], np.zeros(max(len(flat), len(self.ids)), np.int32)])
        self.ids[self.n:self.n + len(flat)] = flat
        self.fresh = self._merge(self.fresh, (hashes, self.n + np.cumsum(size, dtype=np.int64) - size, size))
        self.n += len(flat)
        if len(self.fresh[0]) > self.FRESH:
            self.known, self.fresh = self._merge(self.known, self.fresh), (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words start (-1: not known) and how many they are."""
        start, size = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int32)
        for keys, starts, sizes in (self.known, self.fresh):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                start[hit], size[hit] = starts[at[hit]], sizes[at[hit]]
        return start, size

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: none)."""
        data, offsets = W.utf8(texts)
        for _, d, o in W.chunks(data, offsets):
            if len(self.known[0]) + len(self.fresh[0]) > self.KEEP:
                self._forget()
            starts, ends, first, plain = pieces(d, o, self.kinds)
            h, where, back = _distinct(W.hash_spans(d, starts, ends, False))
            start, size = self._find(h)
            new = np.flatnonzero(start < 0)
            if len(new):
                raw = d.tobytes()
                s, e = starts[where[new]].tolist(), ends[where[new]].tolist()
                self._learn(h[new], [raw[a:b].decode() for a, b in zip(s, e, strict=True)], plain[where[new]])
                start[new], size[new] = self._find(h[new])
            count = size[back]
            upto = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
            ids = self.ids[np.repeat(start[back] - upto[:-1], count) + np.arange(upto[-1])].astype(np.int64)
            cut = upto[first]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield ids[a:b]


#: one per vocabulary and worker, so words learnt in a task serve the next
_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


_FILE = "file string, part int, n_ids long"
_READ = "doc_id long, file string, start long, offset long, ids binary"


def _write(folder: str, tokenizer: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, n, end = None, None, 0, np.array([END_ID], np.int64)
        for b in batches:
            encoder = encoder or word_encoder(tokenizer)
            out = out or TokenWriter(new_file(folder, ".tok"))
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1)), strict=True):
                out.add(doc_id, np.concatenate((ids, end)))
                n += len(ids) + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [out.path], "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n_ids": [n]})
    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write token files; returns the files in order (file, part, n_ids).

    Documents go to files by ranges of doc_id, ascending (null first; equal ids
    by a checksum of the text).  A null text has the end id only.  The result is
    a written table: only the files it names count.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.crc32(F.col("text").cast("binary")).alias("__crc"))
    ordered = rows.repartitionByRange(n, "doc_id", "__crc").sortWithinPartitions("doc_id", "__crc").select("doc_id", "text")
    return written(ordered.mapInArrow(_write(folder, tokenizer), _FILE), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Documents of token files: doc_id, file, start (ids before it in all files), offset (in its file) and ids (little-endian unsigned 32-bit).

    ``files`` (file, part, n_ids) come in order of ``part``; a document with a null id
    has a null id, one without ids an empty binary, equal documents come as often
    as they were written.  Columns besides these three are not read.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one row a file; each task knows what comes before its files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    named = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint").alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held, at = [], 0, 0
                for doc_id, ids in read_tokens(path):
                    rows.append({"doc_id": doc_id, "file": path, "start": start + at, "offset": at, "ids": ids.astype("<u4").tobytes()})
                    at += len(ids)
                    held += 4 * len(ids)
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return named.repartition(n, "file").mapInArrow(read, _READ)


def op3_token_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole ``documents`` encoded, written as token files to the shared folder and read back."""
    import public_tokenizers
    files = write_token_files(table(spark, sf_dir, "documents"), shared_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(files).select("doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").cast("bigint").alias("ids_crc32"))
