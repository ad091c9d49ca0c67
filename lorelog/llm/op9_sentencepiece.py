"""SentencePiece encoding and decoding by weighted finite-state transducers over the tropical semiring.

The model file is compiled into three transducers.

* Normaliser: the rules of the model's character map (read from its double-array trie), longest match first, then the
  removal of extra blanks, the escape of blanks by the piece mark, and the mark in front.
* Pieces: a trie whose final states emit symbols, as one table of integer arcs.
* Byte fallback: a character without a piece emits its bytes, or the unknown id where the model has no bytes.

Composed with an input they give an acyclic lattice: states are (place, last symbol), arcs are symbols.  The output is
the path of least weight, found by one relaxation of the lattice in order of places.

Weights.  In a unigram model an arc weighs minus its piece's score.  In a BPE model an arc weighs 0 where the merges
would leave the two neighbouring symbols as they are, and infinity otherwise; the merges of a whole text leave exactly
that path (any merge across a boundary would also happen in the two symbols alone), so it is the only finite one and
each place has one live state.

Where no piece holds a mark (or some punctuation) behind another character, the lattice falls apart in front of it.
The different new parts of a batch are relaxed together, place by place, in numpy; parts over LONG_PART characters are
relaxed one by one.  Paths of parts are remembered in two generations of bounded size, the weights of pairs in a table
of fixed size.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelog.llm.common import whole_text

MARK = "▁"
#: Fixed values of the model format: kinds of piece, kinds of model, the penalty of an unknown character.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Parts that a generation remembers, and characters of longer parts, which are not remembered.
CACHE_PARTS = 200_000
LONG_PART = 64
#: Places of the table of pair weights.
PAIR_PLACES = 1 << 20
#: Characters that are cut into parts together, and parts of one text at a time.
RUN_CHARS = 1 << 20
RUN_PARTS = 1 << 19
NEVER = 1 << 30


class PairTable:
    """Pairs of small numbers to numbers, looked up by array; open addressing."""

    def __init__(self, entries: dict[tuple[int, int], int], width: int):
        bits = max(4, (4 * len(entries)).bit_length())
        self.width, self.shift, self.mask = np.int64(width), np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        names = np.array([a * width + b for a, b in entries], dtype=np.int64)
        taken = [-1] * (1 << bits)
        where = []
        for key, slot in zip(names.tolist(), self._slots(names).tolist()):
            while taken[slot] >= 0:
                slot = (slot + 1) & self.mask
            taken[slot] = key
            where.append(slot)
        self.keys[where], self.values[where] = names, list(entries.values())

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray, default: int) -> np.ndarray:
        keys = a * self.width + b
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], np.int32(default))
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            held = self.keys[slots[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


def charsmap_rules(blob: bytes) -> dict[str, str]:
    """The rewriting rules of a precompiled character map: a double-array trie of UTF-8 keys, then the targets.

    The published layout of a unit (32 bits): the label in bits 0-7 (bit 31 marks a value), a leaf flag in bit 8, and
    the offset to the children in the bits from 10 on, shifted by 8 more where bit 9 is set.
    """
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).astype(np.int64)
    targets = blob[4 + size :]
    offsets = (units >> 10) << ((units & (1 << 9)) >> 6)
    rules: dict[str, str] = {}
    todo = [(0, b"")]
    while todo:
        at, key = todo.pop()
        base = at ^ int(offsets[at])
        if units[at] >> 8 & 1:
            start = int(units[base]) & 0x7FFFFFFF
            rules[key.decode()] = targets[start : targets.index(b"\0", start)].decode()
        children = base ^ np.arange(1, 256)
        found = np.flatnonzero((children < len(units)) & (units[np.minimum(children, len(units) - 1)] & 0x800000FF == np.arange(1, 256)))
        todo += [(int(children[c]), key + bytes([c + 1])) for c in found]
    return rules


class Normaliser:
    """Longest-match rewriting, then blanks, as the model's specification says; user symbols pass as they are."""

    def __init__(self, spec, user: list[str]):
        self.rules = charsmap_rules(spec.precompiled_charsmap)
        self.strip, self.escape, self.prefix = spec.remove_extra_whitespaces, spec.escape_whitespaces, spec.add_dummy_prefix
        self.longest = max(map(len, self.rules), default=0)
        # a rule of several characters goes on with one of these; a rule of one character is one of them
        triggers = {c for rule in self.rules for c in (rule[1:] or rule)}
        self.runs = re.compile("(?s).?[" + "".join(map(re.escape, sorted(triggers))) + "]+") if triggers else None
        self.user = re.compile("(" + "|".join(map(re.escape, sorted(user, key=len, reverse=True))) + ")") if user else None
        self.rewritten = functools.lru_cache(1 << 14)(self._rewritten)

    def _rewritten(self, run: str) -> str:
        out, at = [], 0
        while at < len(run):
            size = next((n for n in range(min(self.longest, len(run) - at), 0, -1) if run[at : at + n] in self.rules), 0)
            out.append(self.rules[run[at : at + size]] if size else run[at])
            at += size or 1
        return "".join(out)

    def _rewrite(self, text: str) -> str:
        return self.runs.sub(lambda m: self.rewritten(m[0]) if len(m[0]) < 64 else self._rewritten(m[0]), text) if self.runs else text

    def __call__(self, text: str) -> str:
        if self.user and self.runs:
            text = "".join(x if k % 2 else self._rewrite(x) for k, x in enumerate(self.user.split(text)))
        else:
            text = self._rewrite(text)
        if self.strip:
            text = re.sub("  +", " ", text).strip(" ")
        if not text:
            return ""
        text = (" " if self.prefix else "") + text
        return text.replace(" ", MARK) if self.escape else text


class Transducer:
    """Normaliser, pieces and byte fallback of one model, and the composition with inputs.

    Symbols are the piece ids, then ``start`` (before a part), ``other`` (a character that no piece has), and one for
    each character that stands in pieces and is none itself.
    """

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(proto if proto is not None else open(path, "rb").read())
        self.kind = spec.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are compiled")
        if spec.trainer_spec.treat_whitespace_as_suffix or not spec.normalizer_spec.escape_whitespaces:
            raise ValueError("only models that mark blanks in front of words are compiled")
        pieces = list(spec.pieces)
        self.ids = {p.piece: i for i, p in enumerate(pieces) if p.type in (NORMAL, USER)}
        self.user = {p.piece for p in pieces if p.type == USER}
        self.unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(pieces) if p.type == BYTE}
        if len(self.bytes) not in (0, 256):
            raise ValueError("byte fallback needs all bytes")
        self.normalise = Normaliser(spec.normalizer_spec, sorted(self.user))
        normal = [p.score for p in pieces if p.type == NORMAL]
        self.least = np.float32(min(normal) - UNKNOWN_PENALTY)
        # user symbols win in a unigram lattice by the length of their bytes
        self.scores = [len(p.piece.encode()) * max(normal) - 0.1 if p.type == USER else p.score for p in pieces]
        self.n_pieces = len(pieces)
        self.start, self.other = self.n_pieces, self.n_pieces + 1
        # in a BPE model user symbols are cut out before anything merges
        self.cut = self.normalise.user if self.kind == BPE else None
        if self.cut:
            self.merging = {p: i for p, i in self.ids.items() if p not in self.user}
        else:
            self.merging = self.ids
        self.states = {p[:n] for p in self.merging for n in range(1, len(p) + 1)}
        self.parts = self._part_pattern()
        self._compile_trie()
        if self.kind == BPE:
            self._compile_merges()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.hot: dict[str, bytes] = {}
        self.cold: dict[str, bytes] = {}
        self.surfaces = [self._surface(p) for p in pieces]

    # --- compilation ---

    def _part_pattern(self) -> re.Pattern | None:
        """Where an input may be cut: in front of a mark, and of punctuation that no piece has behind another character."""
        neighbours = {p[n : n + 2] for p in self.merging for n in range(len(p) - 1)}
        if any(two[1] in (MARK, "\n") and two[0] != two[1] for two in neighbours) or any(two[0] == "\n" for two in neighbours):
            return None
        heads = set("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")
        while bad := {two[1] for two in neighbours if two[1] in heads and two[0] not in heads and two[0] != MARK}:
            heads -= bad
        # a mark may lead to a head, so such heads stay with their mark
        own = "".join(map(re.escape, sorted(heads)))
        mixed = {two[1] for two in neighbours if two[0] == MARK and two[1] in heads}
        lead = f"[{''.join(map(re.escape, sorted(mixed)))}{own}]*" if mixed else ""
        run = f"[{own}]+[^{own}{MARK}\n]*|" if own else ""
        return re.compile(f"{MARK}+{lead}[^{own}{MARK}\n]*|{run}[^{own}{MARK}\n]+|\n")

    def _compile_trie(self) -> None:
        """Arcs (state, character class) -> state, and what each state emits."""
        letters = sorted({c for p in self.merging for c in p})
        self.classes = np.zeros(0x110000, dtype=np.int32)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        names = {"": 0} | {s: i for i, s in enumerate(sorted(self.states), 1)}
        self.arcs = PairTable({(names[s[:-1]], int(self.classes[ord(s[-1])])): i for s, i in names.items() if s}, len(letters) + 1)
        self.emits = np.full(len(names), -1, dtype=np.int32)
        self.emits[[names[p] for p in self.merging]] = list(self.merging.values())
        self.symbols = dict(self.merging)
        for c in letters:
            if c not in self.symbols:
                self.symbols[c] = self.other + 1 + len(self.symbols) - len(self.merging)
                self.emits[names[c]] = self.symbols[c]
        self.longest = max(map(len, self.states), default=1)
        weights = np.full(self.other + 1 + len(self.symbols) - len(self.merging), self.least, dtype=np.float32)
        weights[: self.n_pieces] = self.scores
        self.weights = -weights

    def _compile_merges(self) -> None:
        """Tables of the merges that make each symbol, where their scores fall, so that their order is known.

        ``spine`` has the symbols that stand at a symbol's edge while it is made, ``until`` when each is merged on;
        symbols with merges of another order are ``tangled``.
        """
        ranks = {s: k for k, s in enumerate(sorted({self.scores[i] for i in self.merging.values()}, reverse=True))}
        when = {symbol: ranks[self.scores[symbol]] if len(p) > 1 else -1 for p, symbol in self.symbols.items()}
        left: dict[str, list[int]] = {}
        right: dict[str, list[int]] = {}
        self.made, self.tangled = np.zeros(len(self.weights), dtype=bool), np.zeros(len(self.weights), dtype=bool)
        self.made[self.other] = True
        self.names = {i: p for p, i in self.symbols.items()}
        for p in sorted(self.symbols, key=len):
            own = self.symbols[p]
            if len(p) == 1:
                left[p] = right[p] = [own]
                self.made[own] = True
                continue
            split = self.last_merge(p)
            if split is None:
                left[p] = right[p] = [own]
                continue
            a, b = split
            sides = [self.symbols[a], self.symbols[b]]
            self.made[own] = True
            self.tangled[own] = self.tangled[sides].any() or when[own] <= max(when[s] for s in sides)
            left[p], right[p] = left[a] + [own], right[b] + [own]
        depth = max(max(map(len, left.values())), max(map(len, right.values()))) if left else 1
        self.spine, self.until = [], []
        for edge in (right, left):
            spine = np.zeros((len(self.weights), depth), dtype=np.int64)
            until = np.full((len(self.weights), depth), NEVER, dtype=np.int64)
            for p, symbols in edge.items():
                spine[self.symbols[p], : len(symbols)] = symbols
                until[self.symbols[p], : len(symbols) - 1] = [when[s] for s in symbols[1:]]
            self.spine.append(spine)
            self.until.append(until)
        joins = {}
        for p, own in self.merging.items():
            for n in range(1, len(p)):
                if p[:n] in self.symbols and p[n:] in self.symbols:
                    joins[self.symbols[p[:n]], self.symbols[p[n:]]] = ranks[self.scores[own]]
        self.joins = PairTable(joins, len(self.weights))
        self.known_pairs = np.full(PAIR_PLACES, -1, dtype=np.int64)
        self.known_apart = np.zeros(PAIR_PLACES, dtype=bool)

    def _surface(self, piece) -> bytes:
        if piece.type == BYTE:
            return bytes([int(piece.piece[3:5], 16)])
        if piece.type == CONTROL:
            return b""
        return piece.piece.replace(MARK, " ").encode() if piece.type != UNKNOWN else " ⁇ ".encode()

    # --- weights ---

    def _merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What the merges leave of a short string, the best-scored neighbours first, the leftmost of equals; the last merge."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        agenda: list[tuple[float, int, int, str]] = []
        last = None

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if both in self.merging:
                    heapq.heappush(agenda, (-self.scores[self.merging[both]], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != both:
                continue
            last = (parts[i], parts[j])
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None], last

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes the piece; None if the merges of its characters don't."""
        parts, last = self._merges(piece)
        return last if parts == [piece] else None

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether the merges leave a and b beside each other as they are (a empty: b alone)."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHE_PARTS:
                for key in list(islice(self.pairs, CACHE_PARTS // 2)):  # the older half
                    del self.pairs[key]
            found = self.pairs[a, b] = self._merges(a + b)[0] == ([a, b] if a else [b])
        return found

    def _merge_race(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stay_apart`` of many pairs: the merges at both edges run in order of time, until one crosses or none is left."""
        out = np.ones(len(a), dtype=bool)
        left = np.flatnonzero((a < self.start) | (a > self.other))
        out[a == self.start] = self.made[b[a == self.start]]
        left = left[b[left] != self.other]
        tangled = self.tangled[a[left]] | self.tangled[b[left]]
        for k in left[tangled].tolist():
            out[k] = self.stay_apart(self.names[int(a[k])], self.names[int(b[k])])
        left = left[~tangled]
        a, b = a[left], b[left]
        i, j = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)
        while len(left):
            own, theirs = self.until[0][a, i], self.until[1][b, j]
            cross = self.joins.get(self.spine[0][a, i], self.spine[1][b, j], NEVER)
            crosses = (cross < own) & (cross <= theirs)
            out[left[crosses]] = False
            on = ~crosses & ((own < NEVER) | (theirs < NEVER))
            first = own <= theirs  # of equals the left one
            i, j = (i + first)[on], (j + ~first)[on]
            a, b, left = a[on], b[on], left[on]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * np.int64(len(self.weights)) + b
        slots = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_PLACES.bit_length() + 1)).astype(np.int64)
        out = self.known_apart[slots]
        new = np.flatnonzero(self.known_pairs[slots] != keys)
        if len(new):
            out[new] = self._merge_race(a[new], b[new])
            self.known_pairs[slots[new]], self.known_apart[slots[new]] = keys[new], out[new]
        return out

    # --- composition and shortest path ---

    def relax(self, parts: list[str]) -> list[bytes]:
        """Ids of many parts, whose lattices are relaxed together, one place after the other."""
        if not parts:
            return []
        order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
        sizes = np.array([len(parts[k]) for k in order], dtype=np.int64)
        # a zero, which no arc takes, stands behind each part
        flat = self.classes[np.frombuffer("\0".join([parts[k] for k in order] + [""]).encode("utf-32-le"), dtype=np.uint32)]
        base = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        last, origin = np.full(len(flat), -1, dtype=np.int64), np.zeros(len(flat), dtype=np.int64)
        last[base] = self.start
        cost = np.full(len(flat), np.inf, dtype=np.float32)
        cost[base] = 0

        def arcs(ends: np.ndarray, starts: np.ndarray, symbols: np.ndarray) -> None:
            if self.kind == UNIGRAM:
                weight = cost[starts] + self.weights[symbols]
                better = weight < cost[ends]
            else:
                free = last[ends] < 0
                ends, starts, symbols = ends[free], starts[free], symbols[free]
                better = self._apart(last[starts], symbols)
                weight = np.zeros(len(ends), dtype=np.float32)
            ends = ends[better]
            cost[ends], last[ends], origin[ends] = weight[better], symbols[better], starts[better]

        for at in range(int(sizes[0])):
            starts = base[: np.searchsorted(-sizes, -at, side="left")] + at
            state = self.arcs.get(np.zeros(len(starts), dtype=np.int64), flat[starts].astype(np.int64), -1)
            lone = (state < 0) | (self.emits[np.maximum(state, 0)] < 0)
            arcs(starts[lone] + 1, starts[lone], np.full(int(lone.sum()), self.other, dtype=np.int64))
            step = 1
            starts, state = starts[state >= 0], state[state >= 0]
            while len(starts):
                symbol = self.emits[state].astype(np.int64)
                final = symbol >= 0
                arcs(starts[final] + step, starts[final], symbol[final])
                state = self.arcs.get(state.astype(np.int64), flat[starts + step].astype(np.int64), -1)
                on = state >= 0
                starts, state, step = starts[on], state[on], step + 1
        return self._paths(parts, order, base, sizes, last, origin)

    def _paths(self, parts: list[str], order: list[int], base: np.ndarray, sizes: np.ndarray, last: np.ndarray, origin: np.ndarray) -> list[bytes]:
        on_path = np.zeros(len(last), dtype=bool)
        at = base + sizes
        while len(at):
            on_path[at] = True
            at = origin[at]
            at = at[last[at] != self.start]
        on_path[base] = False
        ends = np.flatnonzero(on_path)
        symbols = last[ends]
        bounds = np.searchsorted(ends, np.append(base, len(last)))
        raw, cuts = symbols.astype("<u4").tobytes(), (4 * bounds).tolist()
        out: list[bytes] = [b""] * len(parts)
        for k, a, b in zip(order, cuts, cuts[1:]):
            out[k] = raw[a:b]
        odd = np.unique(np.searchsorted(bounds, np.flatnonzero(symbols >= self.n_pieces), side="right") - 1)
        for row in odd.tolist():
            part, begin = parts[order[row]], int(base[row])
            mine = ends[bounds[row] : bounds[row + 1]]
            out[order[row]] = self._emit([part[origin[e] - begin : e - begin] for e in mine.tolist()])
        return out

    def shortest_path(self, text: str) -> list[str]:
        """The pieces of the least path through the lattice of one normalised text, whatever its length."""
        n = len(text)
        back: list[tuple[int, str] | None] = [None] * (n + 1)
        cost = [np.float32(0)] + [np.float32(np.inf)] * n
        for at in range(n):
            last = back[at][1] if back[at] else ""
            end = at + 1
            piece = text[at:end]
            found = [] if piece in self.merging else [piece]
            while piece in self.states:
                if piece in self.merging:
                    found.append(piece)
                end += 1
                piece = text[at:end]
                if end > n:
                    break
            for piece in found:
                end = at + len(piece)
                if self.kind == UNIGRAM:
                    weight = cost[at] - np.float32(self.scores[self.ids[piece]] if piece in self.ids else self.least)
                    if weight < cost[end]:
                        cost[end], back[end] = weight, (at, piece)
                elif back[end] is None and self.stay_apart(last, piece):
                    back[end] = (at, piece)
        out, at = [], n
        while at:
            at, piece = back[at]
            out.append(piece)
        return out[::-1]

    def _emit(self, pieces: list[str]) -> bytes:
        out = array.array("I")
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return out.tobytes()

    def _learn(self, parts: set[str]) -> None:
        """Makes sure that the hot generation has these parts' ids, the long ones too."""
        new = parts.difference(self.hot)
        for part in new.intersection(self.cold):
            self.hot[part] = self.cold[part]
        if self.cut:
            self.hot.update((p, self._emit([p])) for p in new & self.user)
            new -= self.user
        new = sorted(new.difference(self.cold))
        short = [p for p in new if len(p) <= LONG_PART]
        self.hot.update(zip(short, self.relax(short)))
        for part in new:
            if len(part) > LONG_PART:
                self.hot[part] = self._emit(self.shortest_path(part))

    def _forget(self) -> None:
        if len(self.hot) > CACHE_PARTS:
            self.cold, self.hot = {p: ids for p, ids in self.hot.items() if len(p) <= LONG_PART}, {}

    def _segments(self, text: str) -> Iterator[list[str]]:
        """The parts of a normalised text, a bounded number at a time."""
        for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield [piece]
            elif self.parts is None:
                yield [piece]
            elif len(piece) <= RUN_CHARS:
                yield self.parts.findall(piece)
            else:
                found = (m[0] for m in self.parts.finditer(piece))
                while some := list(islice(found, RUN_PARTS)):
                    yield some

    def _finish(self, ids: bytes) -> bytes:
        """Without byte fallback, neighbouring unknown characters are one id."""
        if self.bytes:
            return ids
        every = np.frombuffer(ids, dtype="<u4")
        unknown = every == self.unknown
        return every[~(unknown & np.concatenate(([False], unknown[:-1])))].tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            run: list[list[str]] = []
            size = 0
            while at + len(run) < len(texts) and (not run or size + len(texts[at + len(run)]) <= RUN_CHARS):
                text = texts[at + len(run)]
                size += len(text)
                if len(text) > RUN_CHARS:
                    break
                run.append([p for some in self._segments(self.normalise(text)) for p in some])
            if run:
                self._learn(set().union(*run))
                out += [self._finish(b"".join(map(self.hot.__getitem__, parts))) for parts in run]
            else:
                ids = []
                for some in self._segments(self.normalise(texts[at])):
                    self._learn(set(some))
                    ids.append(b"".join(map(self.hot.__getitem__, some)))
                    self._forget()
                out.append(self._finish(b"".join(ids)))
            self._forget()
            at += len(run) or 1
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The inverse transducer: surfaces of the pieces, without the mark in front."""
        surfaces = self.surfaces
        raw = b"".join([surfaces[i] for i in np.frombuffer(ids, dtype=np.uint32).tolist()])
        if (self.normalise.prefix or self.normalise.strip) and raw[:1] == b" " and ids[:4] != self.unknown.to_bytes(4, "little"):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per input row: doc_id and ids (little-endian 32-bit numbers in a binary).

    Null and empty texts have no ids.  Texts of any length are encoded whole, a bounded number of parts at a time.
    Repeated rows are encoded alike; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = transducer(path).encode_all
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encode(part.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids); null ids give the empty text."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = transducer(path).decode
        for batch in batches:
            texts = [decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


SCHEMA = "doc_id long, n_tokens long, n_bytes_out long, ids_crc32 long, decoded_sha256 string"


def token_digest(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, number that are fallback bytes, CRC-32 of the ids, SHA-256 of the decoded text."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        is_byte = np.zeros(machine.n_pieces, dtype=bool)
        is_byte[list(machine.bytes.values())] = True
        for batch in batches:
            ids = [x.as_py() or b"" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([int(is_byte[np.frombuffer(x, dtype=np.uint32)].sum()) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(machine.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                [x.split()[0] for x in SCHEMA.split(", ")],
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: SQL can't express the lattice; the query is tested against the public library and by round trips.
SQL = None
