"""Byte-pair segmentation of texts with a given SentencePiece model, merge-dropout, decoding.

A text becomes words (white-space runs with what follows them); no piece of the
model crosses a word start, so words are segmented one by one, each from an
agenda of candidate merges: the best-scored, then leftmost candidate merges
first. A candidate is the pair (start, middle, end) of one word. With dropout
``p`` it is skipped for good if a keyed hash of (seed, word, document, place of
the word, start, middle, end) falls below ``p``: each occurrence has draws of
its own, the same seed gives the same pieces on any cluster, and no state is
shared. Only without dropout are equal words segmented once. If ``variants`` is
a number, each place is dealt one of so many draws of its word instead.

Agendas of all words of a batch run in step, as arrays of words of about one
length, in which a round touches the merged symbols and their neighbours only;
one much longer word takes a heap of its own (``segment_word``, the definition).

Decoding gives back the text exactly. The model's own encoder would write both
a space and U+2581 as U+2581; here a literal U+2581 is written in byte pieces.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

MARK = "▁"
LONG_WORD = 512
SEGMENT_CHARS = 2_000_000
BLOCK_SYMBOLS = 1 << 16
NONE = 1 << 30
GONE = -NONE  # no symbol: merged into another, or outside the word
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS
SLOT_MIX = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def slot_of(key: int) -> int:
    return ((key * SLOT_MIX) & MASK) >> (64 - SLOT_BITS)


def mix(x: int) -> int:
    """One splitmix64 step."""
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def mix_array(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Odd multipliers keep start, middle and end of a candidate apart.
_START, _MIDDLE, _END = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xF1357AEA2E62A9C5
_START64, _MIDDLE64, _END64 = np.array([_START, _MIDDLE, _END], np.uint64).view(np.int64)
_PLACE = 0x9E6C63D0876A9A47


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


@dataclass
class PieceModel:
    """The tables of a model: symbols are piece ids, characters outside the
    vocabulary are ``-1 - code point``."""

    symbol_of: np.ndarray  # by code point
    slot_key: np.ndarray  # open addressing by left * n + right, -1 where empty
    slot_merged: np.ndarray
    slot_rank: np.ndarray  # equal scores have equal ranks
    byte_ids: np.ndarray
    bytes_flat: np.ndarray  # what each piece decodes to
    bytes_start: np.ndarray
    bytes_len: np.ndarray
    n: int

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        pieces = [p.piece for p in proto.pieces]
        n = len(pieces)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        byte_ids = np.zeros(256, np.int64)
        decoded = [b""] * n
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                byte_ids[int(p.piece[1:-1], 16)] = i
                decoded[i] = bytes([int(p.piece[1:-1], 16)])
            elif p.type in (1, 4):
                decoded[i] = p.piece.replace(MARK, " ").encode()
        symbol_of = -1 - np.arange(0x110000, dtype=np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                symbol_of[ord(piece)] = i
        symbol_of[0x20] = symbol_of[ord(MARK)]
        symbol_of[ord(MARK)] = -1 - ord(MARK)
        scores = sorted({-proto.pieces[i].score for i in normal.values()})
        rank_of = {score: rank for rank, score in enumerate(scores)}
        pairs = sorted(
            (normal[piece[:k]] * n + normal[piece[k:]], i, rank_of[-proto.pieces[i].score])
            for piece, i in normal.items()
            for k in range(1, len(piece))
            if piece[:k] in normal and piece[k:] in normal
        )
        slots = [np.full(SLOTS, fill, np.int64) for fill in (-1, 0, NONE)]
        for key, merged, rank in pairs:
            at = slot_of(key)
            while slots[0][at] >= 0:
                at = (at + 1) % SLOTS
            slots[0][at], slots[1][at], slots[2][at] = key, merged, rank
        lengths = np.array([len(b) for b in decoded], np.int64)
        return cls(
            symbol_of,
            slots[0],
            slots[1].astype(np.int32),
            slots[2].astype(np.int32),
            byte_ids,
            np.frombuffer(b"".join(decoded), np.uint8),
            offsets(lengths)[:-1],
            lengths,
            n,
        )

    def slots(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the pairs that merge, and the positions of these pairs."""
        right = right.astype(np.int64)
        key = left.astype(np.int64) * self.n + right
        key |= right >> 63  # negative if one of the symbols is
        at = ((key.view(np.uint64) * np.uint64(SLOT_MIX)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        found = self.slot_key[at]
        known = key >= 0
        open_ = np.flatnonzero((found != key) & (found >= 0) & known)
        while len(open_):
            at[open_] = (at[open_] + 1) % SLOTS
            found[open_] = self.slot_key[at[open_]]
            open_ = open_[(found[open_] != key[open_]) & (found[open_] >= 0)]
        merge = np.flatnonzero((found == key) & known)
        return at[merge], merge

    def pair(self, left: int, right: int) -> tuple[int, int] | None:
        slot, _ = self.slots(np.array([left]), np.array([right]))
        return (int(self.slot_merged[slot[0]]), int(self.slot_rank[slot[0]])) if len(slot) else None


class SegmentCache:
    """Pieces of words met before in this task, by key, up to a number of words;
    it changes the work only, never a result."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.keys = np.zeros(0, np.uint64)
        self.start = self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 for words not held. ``keys`` are sorted."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        room = max(0, self.most - len(self.keys))
        keys, count = keys[:room], count[:room]
        if not len(keys):
            return
        start = len(self.flat) + offsets(count)[:-1]
        self.flat = np.concatenate([self.flat, flat[: int(count.sum())].astype(np.int32)])
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys)
        self.keys = all_keys[order]
        self.start = np.concatenate([self.start, start])[order]
        self.count = np.concatenate([self.count, count])[order]


def skipped(key: int, start: int, middle: int, end: int, limit: int) -> bool:
    return mix(key ^ ((start * _START + middle * _MIDDLE + end * _END) & MASK)) < limit


def segment_word(model: PieceModel, symbols: list[int], key: int, limit: int) -> list[int]:
    """The agenda of one word: symbols after all merges, ``limit`` of 2**64 skipped."""
    n = len(symbols)
    sym, end, nxt, prev = list(symbols), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive, agenda = [True] * n, []

    def propose(i: int) -> None:
        j = nxt[i] if i >= 0 else n
        found = model.pair(sym[i], sym[j]) if i >= 0 and j < n else None
        if found and not skipped(key, i, end[i], end[j], limit):
            heapq.heappush(agenda, (found[1], i, end[i], end[j], found[0]))

    for i in range(n - 1):
        propose(i)
    while agenda:
        _, i, middle, stop, merged = heapq.heappop(agenda)
        j = nxt[i]
        if not alive[i] or end[i] != middle or j >= n or end[j] != stop:
            continue
        sym[i], end[i], alive[j] = merged, stop, False
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        propose(prev[i])
        propose(i)
    return [s for s, ok in zip(sym, alive, strict=True) if ok]


def segment_words(
    model: PieceModel, sym: np.ndarray, first: np.ndarray, lengths: np.ndarray, keys: np.ndarray, limit: int
) -> tuple[np.ndarray, np.ndarray]:
    """The agendas of many words in step: one merge of each word a round. The
    words lie in ``sym`` from ``first`` on, the shorter ones before the longer
    ones. Returns all symbols and their number by word."""
    if limit > MASK:  # every candidate is skipped
        return sym[ragged(first, lengths)], lengths
    count = np.zeros(len(lengths), np.int64)
    flats: list[np.ndarray] = []
    done = 0
    while done < len(lengths):  # words of about one length at a time
        width = lengths[done : done + BLOCK_SYMBOLS] + 2
        n = int((np.arange(1, len(width) + 1) * width <= BLOCK_SYMBOLS).sum())
        words = slice(done, done + max(1, n))
        made, count[words] = _agendas(model, sym, first[words], lengths[words], keys[words], limit)
        flats.append(made)
        done = words.stop
    return np.concatenate(flats) if flats else sym[:0], count


def _agendas(
    model: PieceModel, flat: np.ndarray, first: np.ndarray, lengths: np.ndarray, keys: np.ndarray, limit: int
) -> tuple[np.ndarray, np.ndarray]:
    """``segment_words`` for words of about one length. Symbols stay in the row of
    their first character, one column a word, with an empty row before and after;
    a row knows the rows of its neighbours, so a round touches merged symbols only."""
    n, longest = len(lengths), int(lengths.max())
    rows = longest + 2
    grid = np.full((rows, n), GONE, np.int32)
    for r in range(longest):
        some = np.searchsorted(lengths, r, side="right")
        grid[r + 1, some:] = flat[first[some:] + r]
    sym = grid.ravel()
    agenda = np.full(rows * n, NONE << 32, np.int64)  # rank of the candidate that starts here, and its row
    merged = np.zeros(rows * n, np.int32)
    after = np.repeat(np.arange(1, rows + 1), n)
    before = after - 2

    def propose(at, column, left, right, start, middle, end) -> None:
        """Candidates of pairs of symbols at ``at``, skipped ones left out."""
        slot, c = model.slots(left, right)
        if limit:
            place = start[c] * _START64 + middle[c] * _MIDDLE64 + end[c] * _END64
            drawn = mix_array(keys[column[c]] ^ place.view(np.uint64)) >= np.uint64(limit)
            slot, c = slot[drawn], c[drawn]
        agenda[at] = NONE << 32
        agenda[at[c]] = (model.slot_rank[slot].astype(np.int64) << 32) | (start[c] + 1)
        merged[at[c]] = model.slot_merged[slot]

    at = np.flatnonzero((sym[:-n] >= 0) & (sym[n:] >= 0))
    start = before[at]
    propose(at, at - (start + 1) * n, sym[at], sym[at + n], start, start + 1, start + 2)
    while longest > 1:
        best = agenda.reshape(rows, n)[1:-2].min(axis=0)
        column = np.flatnonzero(best < NONE << 32)
        if not len(column):
            break
        row = best[column] & 0xFFFFFFFF
        i = row * n + column
        j = after[i] * n + column
        stop = after[j]
        k = stop * n + column
        left = before[i]
        h = left * n + column
        new = merged[i]
        sym[i], sym[j], agenda[j] = new, GONE, NONE << 32
        after[i], before[k] = stop, row
        propose(
            np.concatenate([i, h]),
            np.concatenate([column, column]),
            np.concatenate([new, sym[h]]),
            np.concatenate([sym[k], new]),
            np.concatenate([row, left]) - 1,
            np.concatenate([stop, row]) - 1,
            np.concatenate([after[k], stop]) - 1,
        )
    by_word = grid[1:-1].T
    kept = by_word != GONE
    return by_word[kept], kept.sum(axis=1)


def to_bytes(model: PieceModel, sym: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters outside the vocabulary become one piece per byte."""
    bad = np.flatnonzero(sym < 0)
    if not len(bad):
        return sym, lengths
    encoded = [chr(-1 - s).encode() for s in sym[bad].tolist()]
    width = np.ones(len(sym), np.int64)
    width[bad] = [len(b) for b in encoded]
    out = np.repeat(sym, width)
    where = ragged(offsets(width)[bad], width[bad])
    out[where] = model.byte_ids[np.frombuffer(b"".join(encoded), np.uint8)]
    word = np.repeat(np.arange(len(lengths)), lengths)
    return out, np.bincount(word, weights=width, minlength=len(lengths)).astype(np.int64)


def cut(text: str) -> list[str]:
    """A long text in parts that start where a word starts."""
    parts, at = [], 0
    while len(text) - at > SEGMENT_CHARS:
        to = at + SEGMENT_CHARS
        while (to := text.find(" ", to)) > 0 and text[to - 1] == " ":
            to += 1
        if to < 0:
            break
        parts.append(text[at:to])
        at = to
    return [*parts, text[at:]]


def encode_parts(
    model: PieceModel, parts: list[tuple[str, int, int]], limit: int, seed: int, variants: int | None,
    cache: SegmentCache | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``parts``: (text with its leading space, document key, words before it).
    Returns all ids, and ids and words by part. A cache is for one seed and limit."""
    cp = np.frombuffer("".join(p[0] for p in parts).encode("utf-32-le"), "<u4")
    part_len = np.array([len(p[0]) for p in parts], np.int64)
    part_start = offsets(part_len)
    space = cp == 0x20
    is_start = space & ~np.concatenate([[False], space[:-1]])
    is_start[part_start[:-1][part_len > 0]] = True
    heads = np.flatnonzero(is_start)
    lengths = np.diff(np.append(heads, len(cp)))
    sym = model.symbol_of[cp]
    part = np.searchsorted(part_start, heads, side="right") - 1
    n_words = np.bincount(part, minlength=len(parts))
    place = np.arange(len(heads)) - offsets(n_words)[part]
    place = place + np.array([p[2] for p in parts], np.int64)[part]
    doc = np.array([p[1] for p in parts], np.uint64)[part]

    within = np.arange(len(cp)) - np.repeat(heads, lengths)
    letters = mix_array(cp.astype(np.uint64) + within.astype(np.uint64) * np.uint64(_PLACE))
    word_hash = np.add.reduceat(letters, heads) if len(heads) else np.zeros(0, np.uint64)
    if limit:
        dealt = mix_array(doc ^ mix_array(place.astype(np.uint64) + np.uint64(mix(seed & MASK))))
        if variants:
            dealt = (dealt % np.uint64(variants)) * np.uint64(_PLACE)
        word_hash = mix_array(word_hash + dealt)
    word_hash = mix_array(word_hash ^ np.uint64(mix(seed & MASK)))
    if limit and not variants:  # no two occurrences have the same draws
        cache = None
        keys, first = word_hash, np.arange(len(word_hash))
        inverse = first
    else:
        keys, first, inverse = np.unique(word_hash, return_index=True, return_inverse=True)

    known = cache.find(keys) if cache else np.full(len(keys), -1)
    new = np.flatnonzero(known < 0)
    u_len = lengths[first[new]]
    order = np.argsort(np.minimum(u_len, LONG_WORD + 1).astype(np.uint16), kind="stable")
    new, u_len = new[order], u_len[order]
    at = heads[first[new]]
    n_short = int(np.searchsorted(u_len, LONG_WORD, side="right"))
    flat, count = segment_words(model, sym, at[:n_short], u_len[:n_short], keys[new[:n_short]], limit)
    if n_short < len(new):
        spans = [
            np.array(segment_word(model, sym[head : head + size].tolist(), key, limit), np.int64)
            for head, size, key in zip(*(x[n_short:].tolist() for x in (at, u_len, keys[new])), strict=True)
        ]
        flat, count = np.concatenate([flat, *spans]), np.append(count, [len(x) for x in spans])
    flat, count = to_bytes(model, flat, count)
    starts, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    starts[new], counts[new] = offsets(count)[:-1], count
    if cache:
        held = np.flatnonzero(known >= 0)
        starts[held], counts[held] = len(flat) + cache.start[known[held]], cache.count[known[held]]
        pool = np.concatenate([flat, cache.flat])
        cache.add(keys[new], flat, count)
        flat = pool
    per_word = counts[inverse]
    ids = flat[ragged(starts[inverse], per_word)]
    n_ids = np.bincount(part, weights=per_word, minlength=len(parts)).astype(np.int64)
    return ids, n_ids, n_words


def encode_texts(
    model: PieceModel,
    texts: list[str | None],
    doc_keys: list[int],
    dropout: float = 0.0,
    seed: int = 0,
    variants: int | None = None,
    cache: SegmentCache | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and their number by text; a null or empty text has none."""
    limit = min(int(dropout * 2.0**64), MASK + 1)
    out, counts = [], np.zeros(len(texts), np.int64)
    group: list[tuple[str, int, int]] = []
    owners: list[int] = []

    def flush() -> None:
        if group:
            ids, n_ids, _ = encode_parts(model, group, limit, seed, variants, cache)
            out.append(ids)
            np.add.at(counts, owners, n_ids)
            group.clear()
            owners.clear()

    chars = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        before = 0
        for part in cut(" " + text):
            if chars + len(part) > SEGMENT_CHARS:
                flush()
                chars = 0
            group.append((part, doc_keys[i], before))
            owners.append(i)
            before += len(part)  # any number that differs by part will do
            chars += len(part)
    flush()
    return np.concatenate(out) if out else np.zeros(0, np.int64), counts


def decode_ids(model: PieceModel, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The UTF-8 bytes of each text."""
    flat = model.bytes_flat[ragged(model.bytes_start[ids], model.bytes_len[ids])].tobytes()
    owner = np.repeat(np.arange(len(counts)), counts)
    size = np.bincount(owner, weights=model.bytes_len[ids], minlength=len(counts)).astype(np.int64)
    at = offsets(size)
    return [flat[at[i] + 1 : at[i + 1]] for i in range(len(counts))]
