"""SentencePiece encoding and decoding with a streaming Viterbi search.

The lattice has a node after every character and an edge for every piece. A window of nodes, bounded by the
longest piece, is enough to extend it; ids are committed as soon as the back pointers of all nodes in the window
lead through one boundary, so a text of any length needs little memory.

A unigram model's best path has the highest sum of piece scores. A BPE model has no such sum: its encoding is
the one that merging the best-scored neighbours first arrives at. There, an edge survives only if its piece stays
apart from the one before it under those merges; exactly one edge then ends at each node, which is the last
piece of that prefix's encoding, and the surviving path spells the ids that merging gives.

Where no piece runs across two characters, all paths share the boundary between them. Spaces are such
boundaries in usual vocabularies, so ids are committed there. Texts are searched in lanes: the stretches
between those boundaries go through the windowed search side by side, a character of every lane at a time, in numpy, and
each distinct stretch is remembered with its ids in a table of bounded size.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from .common import fresh, share, small_batches, tidy, unused

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Stands for the character SPACE of a text itself; no text of valid UTF-8 has it, and no piece.
_RAW = "\udfff"
#: Characters that are looked at together, and rows; fewer lanes than _FEW are searched one after the other.
_WINDOW, _ROWS, _FEW = 1 << 18, 512, 8
#: Remembered pairs of pieces, and stretches: places of the table, and characters.
_PAIRS_KEPT, _PLACES_KEPT, _CHARS_KEPT = 1 << 20, 1 << 19, 1 << 21


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a serialised protocol buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    at = 0
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        at += size
        yield tag >> 3, data[at - size : at]


class Model:
    """The pieces of a model file, and an encoder and a decoder for them.

    Only models that leave characters as they are, and escape spaces, are read; others raise ValueError.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int = UNIGRAM, dummy_prefix: bool = True) -> None:
        self.kind, self.dummy_prefix = kind, dummy_prefix
        self.pieces = [p for p, _, _ in pieces]
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        for k, (piece, score, what) in enumerate(pieces):
            if what in (NORMAL, USER) and piece not in self.ids:
                self.ids[piece], self.scores[piece] = k, score
            elif what == BYTE:
                self.bytes[int(piece[3:5], 16)] = k
        self.silent = {k for k, p in enumerate(pieces) if p[2] in (CONTROL, UNUSED)}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.scores.values(), default=0.0) - 10.0
        # Spaces are boundaries if no piece has one after another character.
        self.splits = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if not any(SPACE in p.lstrip(SPACE) for p in self.ids) else None
        self.batch: BatchEncoder | None = None
        self.spelled: list[bytes] = [bytes([self.byte_of[k]]) if k in self.byte_of else b"" if k in self.silent else p.replace(SPACE, " ").encode() for k, p in enumerate(self.pieces)]
        self.apart: dict[tuple[str, str], bool] = {}
        self.ends: dict[str, tuple[list, list] | None] = {}

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            data = f.read()
        pieces, kind, dummy = [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                dummy = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError(f"{path}: models that change characters or remove spaces aren't supported")
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"{path}: neither a unigram nor a BPE model")
        return cls(pieces, kind, dummy)

    # --- lattice

    def _merged(self, text: str) -> list[tuple]:
        """A short text's pieces by merging the best-scored neighbours, leftmost first, as trees: (piece, left, right)."""
        parts: list[tuple] = [(c, None, None) for c in text]
        scores = self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k][0] + parts[k + 1][0])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [(parts[at][0] + parts[at + 1][0], parts[at], parts[at + 1])]

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """The pieces that stand at the left and at the right end of a piece while it is merged: (piece, when it comes
        to be, when it is merged into the next). When: the worst rank so far, a rank being a score with its sign turned.
        None if merging does not arrive at the piece."""
        if piece in self.ends:
            return self.ends[piece]
        parts = self._merged(piece)
        if len(parts) > 1:
            self.ends[piece] = None
            return None

        def when(tree: tuple) -> float:
            return float("-inf") if tree[1] is None else max(-self.scores[tree[0]], when(tree[1]), when(tree[2]))

        sides = []
        for side in (1, 2):
            tree, until, out = parts[0], float("inf"), []
            while tree is not None:
                since = when(tree)
                out.append((tree[0], since, until))
                until, tree = since, tree[side]
            sides.append(out)
        self.ends[piece] = (sides[0], sides[1])
        return self.ends[piece]

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether merging a + b arrives at a and b: no piece at the end of a meets one at the start of b, while both
        are there, that it would merge with before either is merged otherwise."""
        key = (a, b)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > _PAIRS_KEPT // 8:
                self.apart.clear()
            known = self.apart[key] = self._compare(a, b)
        return known

    def _compare(self, a: str, b: str) -> bool:
        left, right = self._edges(a), self._edges(b)
        if left is None or right is None:
            return False
        scores = self.scores
        for x, x_since, x_until in left[1]:
            for y, y_since, y_until in right[0]:
                s = scores.get(x + y)
                if s is not None:
                    due, end = max(-s, x_since, y_since), min(x_until, y_until)
                    if due < end:
                        return False
                    if due == end:  # equal ranks: the order of places decides
                        return [t[0] for t in self._merged(a + b)] == [a, b]
        return True

    def stream(self, text: Iterator[str] | str, before: str | None = None) -> Iterator[int]:
        """Ids of a text whose spaces are escaped; reads it once, holding a bounded window of it. before: the piece
        that was committed in front of it."""
        ids, scores, longest, bpe = self.ids, self.scores, self.longest, self.kind == BPE
        # Of each node from `base` on: the characters before it, its piece, and the best sum.
        chars: list[str] = []
        last: list[str | None] = [None]
        best = [0.0]

        def back(node: int) -> list[str]:
            out = []
            while node:
                out.append(last[node])
                node -= len(last[node])
            return out[::-1]

        for c in text:
            chars.append(c)
            n = len(chars)
            found, top = None, float("-inf")
            window = "".join(chars[max(0, n - longest) :])
            for size in range(min(longest, n), 0, -1):
                p = window[-size:]
                if p in ids or size == 1:
                    start = n - size
                    if last[start] is None and start:
                        continue  # no piece ends there
                    if bpe:
                        left = last[start] if start else before
                        if (p not in ids or size == 1 or self._edges(p) is not None) and (left is None or left not in ids or p not in ids or self._stay_apart(left, p)):
                            found = p
                            break
                    elif (s := best[start] + scores.get(p, self.worst)) > top:
                        found, top = p, s
            if found is None:  # a vocabulary that merging cannot reach: the character stands alone
                found = c
            last.append(found)
            best.append(top)
            if n >= 4 * longest:
                # The boundary through which the paths of all nodes that can still be extended lead.
                common: set[int] | None = None
                for node in range(n - longest + 1, n + 1):
                    path, k = {0}, node
                    while k:
                        path.add(k)
                        k -= len(last[k])
                    common = path if common is None else common & path
                cut = max(common)
                if cut:
                    pieces = back(cut)
                    yield from self._numbers(pieces)
                    before = pieces[-1]
                    chars, last, low = chars[cut:], [None, *last[cut + 1 :]], best[cut]
                    best = [0.0, *(s - low for s in best[cut + 1 :])]
        yield from self._numbers(back(len(chars)))

    def _numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            k = self.ids.get(p)
            if k is not None:
                out.append(k)
            elif len(self.bytes) == 256:
                out += [self.bytes[b] for b in (SPACE if p == _RAW else p).encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    # --- texts

    def escaped(self, text: str) -> str:
        """The text as pieces spell it. A character that stands for the escaped space itself goes to bytes, so that
        decode gives it back."""
        if len(self.bytes) == 256:
            text = text.replace(SPACE, _RAW)
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str) -> list[int]:
        """Ids of one text, by one search from its start to its end."""
        return list(self.stream(self.escaped(text)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids. Bytes that are no UTF-8 become replacement characters; ids that stand for nothing are
        passed over."""
        n = len(self.spelled)
        text = b"".join(self.spelled[k] for k in ids if k is not None and 0 <= k < n).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


class Suffixes:
    """All ends of a model's pieces by a hash of their characters, in open addressing: which piece one is, or none.

    A hash grows by a character in front: h + (code + 1) * BASE ** length.
    """

    def __init__(self, ids: dict[str, int], longest: int) -> None:
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(longest, 0x5851F42D4C957F2D, dtype=np.uint64)])
        found: dict[int, int] = {}
        base = [int(x) for x in self.power]
        for piece, k in ids.items():
            h = 0
            for n, c in enumerate(reversed(piece)):
                h = (h + (ord(c) + 1) * base[n]) % 2**64
                found.setdefault(h, -1)
            if found[h] >= 0:
                raise ValueError("two pieces with one hash")
            found[h] = k
        self.bits = max(8, (8 * len(found)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, dtype=np.uint64), np.full(1 << self.bits, -2, dtype=np.int32)
        self.steps = 0
        for h, k in found.items():
            at = self._home(h)
            step = 0
            while self.values[at] != -2:
                at, step = (at + 1) % len(self.keys), step + 1
            self.keys[at], self.values[at] = h, k
            self.steps = max(self.steps, step)

    def _home(self, h: int) -> int:
        return (h * 0x9E3779B97F4A7C15 % 2**64) >> (64 - self.bits)

    def look(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash; -1 if it is only the end of one, -2 if not even that."""
        at = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.values[at], -2)
        wrong = np.flatnonzero((out == -2) & (self.values[at] != -2))
        for _ in range(self.steps):
            if not len(wrong):
                break
            at[wrong] = (at[wrong] + 1) % len(self.keys)
            there = at[wrong]
            hit = self.keys[there] == h[wrong]
            out[wrong[hit]] = self.values[there[hit]]
            wrong = wrong[~hit & (self.values[there] != -2)]
        return out


def _run_of(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of runs, one after the other."""
    upto = np.cumsum(size)
    return np.repeat(start - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)


class Remembered:
    """Stretches and their ids by a hash, compared by their characters. Emptied when the table is half full, or
    when more characters than `chars` are kept."""

    def __init__(self, places: int, chars: int) -> None:
        self.shift, self.chars = np.uint64(64 - (places.bit_length() - 1)), chars
        self.slots = np.full(places, -1, dtype=np.int32)
        self.forget()

    def forget(self) -> None:
        self.slots[:] = -1
        self.hash, self.codes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32)
        self.start, self.size, self.id_start, self.id_size = (np.zeros(0, np.int32) for _ in range(4))

    def _home(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look(self, h: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each stretch; -1 for one that is not known."""
        out = np.full(len(h), -1, dtype=np.int64)
        if not len(self.hash):
            return out
        at, left = self._home(h), np.arange(len(h))
        while len(left):
            found = self.slots[at]
            there = found >= 0
            same = there & (self.hash[found] == h[left])
            out[left[same]] = found[same]
            go = there & ~same
            left, at = left[go], (at[go] + 1) % len(self.slots)
        hit = np.flatnonzero(out >= 0)
        hit = hit[self.size[out[hit]] == size[hit]]
        equal = self.codes[_run_of(self.start[out[hit]], size[hit])] == codes[_run_of(start[hit], size[hit])]
        known = np.full(len(h), -1, dtype=np.int64)
        if len(hit):
            hit = hit[np.logical_and.reduceat(equal, np.cumsum(size[hit]) - size[hit])]
            known[hit] = out[hit]
        return known

    def add(self, h: np.ndarray, codes: np.ndarray, size: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds stretches, their characters and ids one after the other, and returns their entries. Ones that exceed the bounds alone are kept until the next call."""
        if 2 * (len(self.hash) + len(h)) > len(self.slots) or len(self.codes) + len(codes) > self.chars:
            self.forget()
        if 2 * len(h) > len(self.slots):
            raise ValueError("more stretches at a time than the table holds")
        first = len(self.hash)
        self.start = np.concatenate([self.start, (len(self.codes) + np.cumsum(size) - size).astype(np.int32)])
        self.id_start = np.concatenate([self.id_start, (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32)])
        self.hash, self.codes, self.ids = np.concatenate([self.hash, h]), np.concatenate([self.codes, codes]), np.concatenate([self.ids, ids])
        self.size, self.id_size = np.concatenate([self.size, size.astype(np.int32)]), np.concatenate([self.id_size, counts.astype(np.int32)])
        own = np.arange(first, first + len(h), dtype=np.int32)
        at, left = self._home(h), np.arange(len(h))
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = own[left[free]]
            go = self.slots[at] != own[left]
            left, at = left[go], (at[go] + 1) % len(self.slots)
        return own.astype(np.int64)


class BatchEncoder:
    """Encodes many texts at a time with a BPE model whose spaces are boundaries."""

    #: What stands before the first character of a stretch; unknown characters are negative too.
    NOTHING = -(1 << 30)

    def __init__(self, model: Model) -> None:
        self.model = model
        self.suffixes = Suffixes(model.ids, model.longest)
        self.reached = np.full(len(model.pieces), -1, dtype=np.int8)
        self.pair_keys, self.pair_apart = np.zeros(_PAIRS_KEPT, dtype=np.uint64), np.zeros(_PAIRS_KEPT, dtype=bool)
        self.pair_shift = np.uint64(64 - (_PAIRS_KEPT.bit_length() - 1))
        self.known = Remembered(_PLACES_KEPT, _CHARS_KEPT)
        base = 0x9E3779B97F4A7C15
        self.power, self.inverse = self._powers(base), self._powers(pow(base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        return np.cumprod(np.r_[np.uint64(1), np.full(_WINDOW, base, dtype=np.uint64)])

    def _reached(self, ids: np.ndarray) -> np.ndarray:
        for k in np.unique(ids[self.reached[ids] < 0]):
            self.reached[k] = self.model._edges(self.model.pieces[k]) is not None
        return self.reached[ids] == 1

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) + np.uint64(1)
        at = ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.pair_shift).astype(np.int64)
        new = np.flatnonzero(self.pair_keys[at] != key)
        out = self.pair_apart[at]
        if len(new):
            keys, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            pieces, l, r = self.model.pieces, left[new[first]].tolist(), right[new[first]].tolist()
            known = np.fromiter((self.model._compare(pieces[a], pieces[b]) for a, b in zip(l, r, strict=True)), dtype=bool, count=len(keys))
            out[new] = known[back]
            self.pair_keys[at[new[first]]], self.pair_apart[at[new[first]]] = keys, known
        return out

    def _extend(self, ends: np.ndarray, cols: np.ndarray, codes: np.ndarray, last: np.ndarray, step: np.ndarray) -> None:
        """The edge that ends at the node `cols` of each lane, whose characters end at `ends`."""
        rows, h = np.arange(len(ends)), np.zeros(len(ends), dtype=np.uint64)
        for s in range(1, self.model.longest + 1):
            inside = cols[rows] >= s
            if not inside.all():
                rows, h = rows[inside], h[inside]
            c = codes[ends[rows] - s]
            h = h + (c.astype(np.uint64) + np.uint64(1)) * self.suffixes.power[s - 1]
            piece = self.suffixes.look(h)
            if s == 1:
                last[rows, cols], step[rows, cols] = np.where(piece >= 0, piece, -1 - c.astype(np.int32)), 1
            rows, h, piece = rows[go := piece != -2], h[go], piece[go]
            if not len(rows):
                return
            at = np.flatnonzero(piece >= 0)
            if len(at):
                left = last[rows[at], cols[rows[at]] - s]
                fits = np.ones(len(at), dtype=bool)
                alone = np.flatnonzero(left < 0)
                if s > 1 and len(alone):
                    fits[alone] = self._reached(piece[at[alone]])
                both = np.flatnonzero(left >= 0)
                fits[both] = self._apart(left[both], piece[at[both]])
                done = at[fits]
                last[rows[done], cols[rows[done]]], step[rows[done], cols[rows[done]]] = piece[done], s
                stay = np.ones(len(rows), dtype=bool)
                stay[done] = False
                rows, h = rows[stay], h[stay]
                if not len(rows):
                    return

    @staticmethod
    def _path(rows: np.ndarray, node: np.ndarray, last: np.ndarray, step: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(lanes, pieces) of the paths to these nodes, from the boundary on."""
        out = []
        while len(rows):
            out.append((rows, last[rows, node]))
            node = node - step[rows, node]
            rows, node = rows[node > 0], node[node > 0]
        return out[::-1]

    @staticmethod
    def _converged(rows: np.ndarray, step: np.ndarray, low: int, high: int) -> np.ndarray:
        """The last node of each lane through which the paths of all its nodes from low to high lead."""
        at = np.tile(np.arange(low, high + 1), (len(rows), 1))
        while True:
            top = at.max(axis=1, keepdims=True)
            if (at == top).all():
                return top[:, 0]
            at = np.where((at == top) & (at != at.min(axis=1, keepdims=True)), at - step[rows[:, None], at], at)

    def search(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches, how many each has); stretches are runs of codes. A lane holds the nodes since its
        last commit; when its window is full, it commits up to where all paths of its last `longest` nodes meet."""
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        lanes, longest = len(size), self.model.longest
        width = min(4 * longest, int(size[0]))
        last, step = np.full((lanes, width + 1), self.NOTHING, dtype=np.int32), np.ones((lanes, width + 1), dtype=np.int16)
        base = np.zeros(lanes, dtype=np.int64)  # characters that are committed
        out: list[tuple[np.ndarray, np.ndarray]] = []
        rest: dict[int, list[int]] = {}
        n, alive = 0, lanes
        while alive:
            if alive < _FEW and n and int(size[0]) - n > width:
                for k in range(alive):  # long ones that are left: from their last commit on
                    own = codes[start[k] + base[k] : start[k] + size[k]]
                    before = int(last[k, 0])
                    before = None if before == self.NOTHING else self.model.pieces[before] if before >= 0 else chr(-1 - before)
                    rest[k] = list(self.model.stream(map(chr, own.tolist()), before))
                break
            n += 1
            cols = n - base[:alive]
            if (full := np.flatnonzero(cols > width)).size:
                cut = self._converged(full, step, width - longest + 1, width)
                out += self._path(full[cut > 0], cut[cut > 0], last, step)
                if not cut.all():  # no boundary yet: a longer window
                    last, step = (np.concatenate([a, np.full((lanes, width), fill, dtype=a.dtype)], axis=1) for a, fill in ((last, self.NOTHING), (step, 1)))
                    width *= 2
                moved = np.minimum(cut[:, None] + np.arange(width + 1), width)
                last[full], step[full] = last[full[:, None], moved], step[full[:, None], moved]
                base[full] += cut
                cols = n - base[:alive]
            self._extend(start[:alive] + n, cols, codes, last, step)
            stay = int(np.searchsorted(-size, -n, side="left"))  # lanes that are longer
            if stay < alive:
                ended = np.arange(stay, alive)
                out += self._path(ended, size[ended] - base[ended], last, step)
                alive = stay
        lane, flat = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        flat, lane = self._spelled(flat, lane)
        if rest:
            lane = np.concatenate([lane, *(np.full(len(ids), k) for k, ids in rest.items())])
            flat = np.concatenate([flat, *(np.array(ids, dtype=np.int32) for ids in rest.values())])
        by, counts = np.argsort(order[lane], kind="stable"), np.zeros(lanes, dtype=np.int64)
        counts[order] = np.bincount(lane, minlength=lanes)
        return flat[by].astype(np.int32), counts

    def _spelled(self, flat: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their lanes with the bytes of unknown characters in their places."""
        unknown = {int(u): self.model._numbers([chr(-1 - int(u))]) for u in np.unique(flat[flat < 0])}
        if not unknown:
            return flat, lane
        width = np.ones(len(flat), dtype=np.int64)
        for u, own in unknown.items():
            width[flat == u] = len(own)
        out, start = np.repeat(flat, width), np.cumsum(width) - width
        for u, own in unknown.items():
            at = start[flat == u]
            for k, b in enumerate(own):
                out[at + k] = b
        return out, np.repeat(lane, width)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has). Works on a bounded number of characters at a time; texts that
        repeat, as a mix repeats them, are encoded once."""
        once = {t: k for k, t in enumerate(dict.fromkeys(texts))}
        if len(once) < len(texts):
            flat, counts = self.encode(list(once))
            rows = np.fromiter(map(once.__getitem__, texts), dtype=np.int64, count=len(texts))
            return flat[_run_of((np.cumsum(counts) - counts)[rows], counts[rows])], counts[rows]
        out, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), dtype=np.int64)
        parts: list[str] = []
        owners: list[int] = []
        held = 0

        def go() -> None:
            nonlocal held
            flat, n = self._some(parts)
            out.append(flat)
            np.add.at(counts, owners, n)
            parts.clear()
            owners.clear()
            held = 0

        for k, t in enumerate(texts):
            for part in self._parts(self.model.escaped(t)):
                if parts and held + len(part) > _WINDOW:
                    go()
                parts.append(part)
                owners.append(k)
                held += len(part)
        if parts:
            go()
        return np.concatenate(out), counts

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """A long text in parts of about _WINDOW characters that end at boundaries."""
        at = 0
        while len(text) - at > _WINDOW:
            cut = text.rfind(SPACE, at + 1, at + _WINDOW)
            while cut > at and text[cut - 1] == SPACE:
                cut -= 1
            if cut <= at:
                cut = at + 1
                while 0 < (cut := text.find(SPACE, cut)) and text[cut - 1] == SPACE:
                    cut += 1
                if cut <= 0:
                    break
            yield text[at:cut]
            at = cut
        if at < len(text):
            yield text[at:]

    def _some(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(p) for p in parts])
        space = codes == ord(SPACE)
        edge = space.copy()
        edge[1:] &= ~space[:-1]
        edge[np.r_[0, ends[:-1]]] = True
        start = np.flatnonzero(edge)
        size = np.diff(np.r_[start, len(codes)])
        if len(codes) <= _WINDOW:
            ids, first, counts = self._looked_up(codes, start, size)
        else:  # one stretch without a boundary
            ids, counts = self.search(codes, start, size)
            first = np.cumsum(counts) - counts
        upto = np.r_[0, np.cumsum(counts)]
        bounds = upto[np.r_[0, np.searchsorted(start, ends)]]
        return ids[_run_of(first, counts)], np.diff(bounds)

    def _looked_up(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each stretch's begin, how many they are), of which new stretches are searched once each."""
        sums = np.r_[np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.power[: len(codes)])]
        h = (sums[start + size] - sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(29)
        entry = self.known.look(h, codes, start, size)
        while (missed := np.flatnonzero(entry < 0)).size:
            _, rep, back = np.unique(h[missed], return_index=True, return_inverse=True)
            new = missed[rep]
            own = codes[_run_of(start[new], size[new])]
            ids, counts = self.search(own, np.cumsum(size[new]) - size[new], size[new])
            held = len(self.known.hash)
            added = self.known.add(h[new], own, size[new], ids, counts)
            if added[0] < held:  # the table was emptied: entries found before are gone
                entry[:] = -1
                entry[missed] = self._same(codes, start, size, missed, new, back, added)
                again = np.flatnonzero(entry < 0)
                entry[again] = self.known.look(h[again], codes, start[again], size[again])
            else:
                entry[missed] = self._same(codes, start, size, missed, new, back, added)
        return self.known.ids, self.known.id_start[entry].astype(np.int64), self.known.id_size[entry].astype(np.int64)

    @staticmethod
    def _same(codes: np.ndarray, start: np.ndarray, size: np.ndarray, missed: np.ndarray, new: np.ndarray, back: np.ndarray, added: np.ndarray) -> np.ndarray:
        """The entries of missed stretches: those of the new ones with their hashes, if these have their characters too."""
        other = new[back]
        same = size[missed] == size[other]
        at = np.flatnonzero(same)
        equal = codes[_run_of(start[missed[at]], size[missed[at]])] == codes[_run_of(start[other[at]], size[other[at]])]
        same[at] = np.logical_and.reduceat(equal, np.cumsum(size[missed[at]]) - size[missed[at]])
        return np.where(same, added[back], -1)


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    return f"/opt/tokenizers/{name}"


def encoded(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, how many each has)."""
    if model.kind == BPE and model.splits is not None:
        if model.batch is None:  # kept with the model in the worker, for the batches and tasks to come
            model.batch = BatchEncoder(model)
        return model.batch.encode(texts)
    each = [model.encode(t) for t in texts]
    return np.array([k for ids in each for k in ids], dtype=np.int32), np.array([len(ids) for ids in each], dtype=np.int64)


def decoded(model: Model, flat: np.ndarray, offsets: np.ndarray) -> list[str]:
    """The texts of runs of ids that are given one after the other."""
    import pyarrow as pa

    if not hasattr(model, "table"):  # the pieces' bytes, and none for what is no id
        model.table = pa.array([*model.spelled, b""], pa.large_binary())
    n = len(model.spelled)
    wild = (flat < 0) | (flat >= n)
    taken = model.table.take(pa.array(np.where(wild, n, flat) if wild.any() else flat))
    _, ends, data = taken.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[offsets].tolist() if len(flat) else [0] * len(offsets)
    data = memoryview(data) if data is not None else memoryview(b"")
    lead = model.dummy_prefix
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if lead and b > a and data[a] == 32:
            a += 1
        out.append(str(data[a:b], "utf-8", "replace"))
    return out


def _id_lists(flat: np.ndarray, counts: np.ndarray, null: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(flat, pa.int32()), mask=pa.array(null))


def _slices(batches: Iterator) -> Iterator:
    """Arrays in slices of _ROWS, so that what is made of a batch is handed out bit by bit."""
    for batch in batches:
        for k in range(0, max(1, len(batch)), _ROWS):
            yield batch.slice(k, _ROWS)
        tidy()


def ids_of(held, text: Column, with_decoded: bool = False) -> Column:
    """Ids of a text column; with_decoded: a struct of these and of the text that they decode to. Works on _ROWS texts
    at a time, by one model for both directions."""

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for texts in _slices(batches):
            model, null = held(), texts.is_null().to_numpy(zero_copy_only=False)
            flat, counts = encoded(model, [t or "" for t in texts.to_pylist()])
            ids = _id_lists(flat, counts, null)
            if with_decoded:
                back = decoded(model, flat, np.r_[0, np.cumsum(counts)])
                yield pa.StructArray.from_arrays([ids, pa.array(back, pa.string(), mask=null)], names=["ids", "decoded"])
            else:
                yield ids

    return arrow_udf(of, "struct<ids:array<int>,decoded:string>" if with_decoded else "array<int>", ArrowUDFType.SCALAR_ITER)(text)


def encode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df with ids (array of int): null for a null text, empty for an empty one. The model is read on the
    driver, from path. A column ids of df is an error."""
    fresh(df, "ids")
    small_batches(df.sparkSession)
    return df.withColumn("ids", ids_of(share(df.sparkSession, Model.read(path)), F.col(text_col)))


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of its ids; null for null ids. Null ids within a row, and those that the model doesn't have, stand for nothing. A column out_col of df is an error."""
    fresh(df, out_col)
    small_batches(df.sparkSession)
    held = share(df.sparkSession, Model.read(path))

    def of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids in _slices(batches):
            null = ids.is_null().to_numpy(zero_copy_only=False)
            flat = ids.flatten()  # without what stands at nulls
            counts = np.where(null, 0, np.diff(ids.offsets.to_numpy()))
            values = flat.fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.array(decoded(held(), values, np.r_[0, np.cumsum(counts)]), pa.string(), mask=null)

    return df.withColumn(out_col, arrow_udf(of, "string", ArrowUDFType.SCALAR_ITER)(F.col(ids_col)))


def round_trip(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df with ids, as encode gives them, and decoded, the text that decode makes of these; each text goes to a worker
    once for both. Columns by these names are an error."""
    fresh(df, "ids", "decoded")
    both = ids_of(share(df.sparkSession, Model.read(path)), F.col(text_col), with_decoded=True)
    small_batches(df.sparkSession)
    (name,) = unused(df, "_both")
    return df.select("*", both.alias(name)).select("*", F.col(f"{name}.ids").alias("ids"), F.col(f"{name}.decoded").alias("decoded")).drop(name)
