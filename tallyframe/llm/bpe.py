"""Byte-level BPE on executors: a segmentation transducer and a pair occurrence index.

*Segmentation.* The pre-tokenizer's pattern is compiled into a deterministic transducer over
twelve character classes. Every transition says whether a piece starts at the character read
or, as the pattern looks one character ahead, at the one before. Texts are cut into chunks of
equal length regardless of pieces; for every chunk the map from each possible start state to
its end state is computed for all chunks at once, the maps are composed by a parallel prefix
scan, and each chunk is then run from its true start state.

*Counting.* The merges are compiled into a second transducer, over the bytes of a piece, whose
transitions carry the change of the token count (``Counter``). Its runs over distinct pieces are
remembered, and the counts of a text's pieces add up by a prefix sum.

*Merging.* All new pieces of a batch are merged together: each pair of neighbours points to
all its positions, pairs come up in ascending rank, and a merge updates only the lists of the
pairs around it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np

from .common import worker_cache

#: Character classes and states of the transducer.
SPACE, BLANK, LETTER, NUMBER, QUOTE, OTHER, L_STMD, L_R, L_V, L_L, L_E, END = range(12)
DONE, IN_L, IN_N, IN_O, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK, Q, Q_R, Q_V, Q_L = range(12)
LETTERS = (LETTER, L_STMD, L_R, L_V, L_L, L_E)
CHUNK = 512
WORDS_KEPT = 400_000
STATES_KEPT = 300_000
NEVER = 1 << 40
#: Longer texts are worked on in sections of so many characters, so that memory doesn't follow one text.
SECTION = 1 << 19


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output) by [state, class]; output 1: a piece starts here, 2: one started a character ago."""
    begin = {SPACE: ONE_SPACE, BLANK: ONE_BLANK, NUMBER: IN_N, QUOTE: Q, OTHER: IN_O, END: DONE} | dict.fromkeys(LETTERS, IN_L)
    glued = {NUMBER: IN_N, QUOTE: IN_O, OTHER: IN_O} | dict.fromkeys(LETTERS, IN_L)
    go, out = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    stay = {IN_L: dict.fromkeys(LETTERS, IN_L), IN_N: {NUMBER: IN_N}, IN_O: {QUOTE: IN_O, OTHER: IN_O}}
    stay[ONE_SPACE] = glued | {SPACE: RUN_SPACE, BLANK: RUN_BLANK}
    stay[ONE_BLANK] = stay[RUN_BLANK] = stay[RUN_SPACE] = {SPACE: RUN_SPACE, BLANK: RUN_BLANK}
    stay[Q] = {L_STMD: DONE, L_R: Q_R, L_V: Q_V, L_L: Q_L, QUOTE: IN_O, OTHER: IN_O}
    stay[Q_R] = stay[Q_V] = {L_E: DONE}
    stay[Q_L] = {L_L: DONE}
    for s in range(12):
        for c in range(12):
            if c in stay.get(s, {}):
                go[s, c] = stay[s][c]
            elif s == RUN_SPACE and c in glued:
                go[s, c], out[s, c] = glued[c], 2
            elif s == RUN_BLANK and c != END:
                go[s, c], out[s, c] = begin[c], 3
            elif s in (Q_R, Q_V, Q_L):
                go[s, c], out[s, c] = (IN_L, 2) if c in LETTERS else (begin[c], 3)
            else:
                go[s, c], out[s, c] = begin[c], 1
    return go, out


def class_table() -> np.ndarray:
    """The class of every code point."""
    cache = worker_cache("bpe")
    if "classes" not in cache:
        import unicodedata

        t = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                t[c] = LETTER
            elif kind == "N":
                t[c] = NUMBER
        blanks = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        t[blanks] = BLANK
        t[0x20], t[0x27] = SPACE, QUOTE
        for kind, chars in ((L_STMD, "stmd"), (L_R, "r"), (L_V, "v"), (L_L, "l"), (L_E, "e")):
            for c in chars:
                t[ord(c)] = kind
        cache["classes"] = t
    return cache["classes"]


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Chunk maps [chunk, start state] -> end state, one after the other."""
    return np.take_along_axis(then, first, axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive scan of the chunk maps: row k is the map of chunks 0 to k."""
    out, step = maps.astype(np.intp), 1
    while step < len(out):
        out[step:] = compose(out[:-step].copy(), out[step:])
        step *= 2
    return out


def starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The positions at which pieces start."""
    n = len(classes)
    if not n:
        return np.zeros(0, np.int64)
    cache = worker_cache("bpe")
    if "transducer" not in cache:
        go, out = transducer()
        cache["transducer"] = go, out, np.ascontiguousarray(go.T).reshape(-1), np.ascontiguousarray(out.T).reshape(-1)
        images = [sorted(set(go[:, c].tolist())) for c in range(12)]
        wide = max(map(len, images))
        cache["tracks"] = (
            np.array([x + x[:1] * (wide - len(x)) for x in images], np.uint8),
            np.array([[images[c].index(go[s, c]) for s in range(12)] for c in range(12)]),
        )
    _, _, go, out = cache["transducer"]  # indexed by class * 12 + state
    k = -(-n // chunk)
    grid = np.full(k * chunk, END, np.int32)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(k, chunk).T) * 12
    state = np.zeros(k, np.uint8)
    if k > 1:
        tracks, track_of = cache["tracks"]
        first = grid[0] // 12
        now = tracks[first]  # [chunk, track]: after one character few states are left
        for row in grid[1:]:
            now = go[row[:, None] + now]
        maps = np.take_along_axis(now, track_of[first], axis=1)
        state[1:] = prefix_scan(maps)[:-1, DONE]
    marks = np.empty((chunk, k), np.uint8)
    for i, row in enumerate(grid):
        at = row + state
        marks[i] = out[at]
        state = go[at]
    flat = marks.T.reshape(-1)
    hit = (flat & 1).astype(bool)
    hit[:-1] |= (flat[1:] & 2).astype(bool)
    return np.flatnonzero(hit[:n])


def sections(text: str, size: int = SECTION) -> Iterator[str]:
    """The text cut where pieces start, into sections of about size characters, or of one piece where that is longer.

    From the start of a piece on nothing before it matters, and what comes after it matters to
    the piece before it only if that ends in a blank: the cut is at a start without one before it. The last
    starts of a stretch can depend on what follows it, by two characters, and are not used.
    """
    at, step = 0, size
    while len(text) - at > step:
        classes = class_table()[np.frombuffer(text[at : at + step].encode("utf-32-le"), np.uint32)]
        found = starts(classes)[1:-3]
        found = found[classes[found - 1] > BLANK]
        if not len(found):
            step *= 2
            continue
        yield text[at : at + int(found[-1])]
        at, step = at + int(found[-1]), size
    yield text[at:]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, shift)."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def piece_hashes(codes: np.ndarray, at: np.ndarray, slab: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums for each piece, over the mixed (place in the piece, code point); a slab of pieces at a time."""
    one, two = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    stop = np.append(at, len(codes))
    for i in range(0, len(at), slab):
        own = at[i : i + slab]
        first, last = own[0], stop[min(i + slab, len(at))]
        place = np.arange(1, last - first + 1, dtype=np.uint64)
        place -= np.repeat((own - first).astype(np.uint64), np.diff(np.append(own, last)))
        place <<= np.uint64(21)
        place += codes[first:last]
        x = mix(place)
        y = x * np.uint64(0x94D049BB133111EB)
        y ^= y >> np.uint64(31)
        one[i : i + slab], two[i : i + slab] = np.add.reduceat(x, own - first), np.add.reduceat(y, own - first)
    return one, two


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for count[0] places, then the same from begin[1], and so on."""
    total = np.cumsum(count)
    out = np.arange(int(total[-1]) if len(total) else 0)
    out += np.repeat(begin - (total - count), count)
    return out


class Counter:
    """A deterministic transducer over the bytes of a piece; a transition's number is by how many tokens its byte changes the count.

    Every prefix of a piece has a last token, and what comes before that is the encoding of a
    shorter prefix. Two tokens stand side by side in an encoding if and only if the merges of
    their bytes alone give these two. So the last token of a longer prefix is the one ending
    there that may follow the last token where it begins, and a state has to know no more than, for each
    suffix that can still grow into a token, its place in the trie, the last token before it, and
    how many tokens have been counted since. There are finitely many such states; those that texts
    lead to are compiled as they are met.
    """

    def __init__(self, vocabulary: Vocabulary):
        count, first, pool = vocabulary.byte_count, vocabulary.byte_first, vocabulary.byte_pool
        self.coded = [pool[a : a + n].tobytes() for a, n in zip(first.tolist(), count.tolist(), strict=True)]
        self.merges = vocabulary.merges
        self.ranks = {a << 32 | b: rank for rank, (a, b, _) in enumerate(self.merges)}
        self.byte_ids = vocabulary.byte_ids.tolist()
        special = set(vocabulary.special.values())
        self.child: dict[int, int] = {}  # by node << 8 | byte
        self.token, self.inner = [-1], [True]  # by node: the token that it spells, whether it goes on
        for i, data in enumerate(self.coded):
            if i in special or not data:
                continue
            node = 0
            for b in data:
                self.inner[node] = True
                if (key := node << 8 | b) not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.token[node] = i
        self.follows: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.go: dict[int, int] = {}  # by state << 8 | byte: the next state << 16 | 32768 + change of the count
        self.maps: dict[tuple[int, bytes], tuple[int, int]] = {}  # of whole chunks

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a few bytes: always the pair of least rank, the leftmost first."""
        ids, ranks = [self.byte_ids[b] for b in data], self.ranks
        near = [ranks.get(a << 32 | b, NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while near and (least := min(near)) < NEVER:
            i = near.index(least)
            ids[i : i + 2] = [self.merges[least][2]]
            del near[i]
            if i:
                near[i - 1] = ranks.get(ids[i - 1] << 32 | ids[i], NEVER)
            if i < len(near):
                near[i] = ranks.get(ids[i] << 32 | ids[i + 1], NEVER)
        return ids

    def may_follow(self, last: int, token: int) -> bool:
        key = last << 32 | token
        if (known := self.follows.get(key)) is None:
            if last < 0:
                known = self.merged(self.coded[token]) == [token]
            else:
                known = self.merged(self.coded[last] + self.coded[token]) == [last, token]
            self.follows[key] = known
        return known

    def compile(self, state: int, byte: int) -> int:
        """The transition from a state with a byte."""
        grown, change, token = [], None, -1
        for node, last, behind in self.states[state]:
            child = self.child.get(node << 8 | byte)
            if child is None:
                continue
            if change is None and self.token[child] >= 0 and self.may_follow(last, self.token[child]):
                change, token = 1 - behind, self.token[child]
            if self.inner[child]:
                grown.append((child, last, behind))
        new = (*((node, last, behind + change) for node, last, behind in grown), (0, token, 0))
        if (number := self.number.get(new)) is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
        self.go[state << 8 | byte] = out = number << 16 | 32768 + change
        return out

    def chunk(self, state: int, data: bytes) -> tuple[int, int]:
        """Where a stretch of a piece leads to from a state, and by how many tokens."""
        go, total = self.go, 0
        for b in data:
            step = go.get(state << 8 | b)
            if step is None:
                step = self.compile(state, b)
            state = step >> 16
            total += step & 65535
        return state, total - 32768 * len(data)

    def count(self, data: bytes) -> int:
        """The number of tokens of a piece; those of long ones come from the maps of their chunks, one after the other."""
        if len(data) <= CHUNK:
            return self.chunk(0, data)[1]
        state = total = 0
        for i in range(0, len(data), CHUNK):
            key = state, data[i : i + CHUNK]
            if key not in self.maps:
                if len(self.maps) > 10_000:
                    self.maps.clear()
                self.maps[key] = self.chunk(*key)
            state, n = self.maps[key]
            total += n
        return total

    def counts(self, pieces: list[str]) -> list[int]:
        if len(self.states) > STATES_KEPT:
            self.clear()
        if len(self.follows) > 4 * STATES_KEPT:
            self.follows.clear()
        return [self.count(x.encode()) for x in pieces]


class Pieces:
    """The pieces of some texts: distinct ones, where they occur, and which run belongs to which text."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str]):
        self.size, joined, owner = len(texts), [], []
        for k, text in enumerate(texts):
            for x in vocabulary.split_special(text):
                if isinstance(x, int):
                    owner.append((k, x))
                else:
                    owner.append((k, -1))
                    joined.append(x)
        whole = "\n".join(joined) + "\n"
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        classes = class_table()[codes]
        ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)) + 1) - 1
        classes[ends] = END
        at = starts(classes)
        one, two = piece_hashes(codes, at)
        _, where, number = np.unique(one, return_index=True, return_inverse=True)
        if (two != two[where][number]).any():  # two pieces share a hash: tell them apart by both
            _, where, number = np.unique(np.stack((one, two)), axis=1, return_index=True, return_inverse=True)
        stop = np.append(at, len(codes))
        self.distinct = [whole[a:b] for a, b in zip(at[where].tolist(), stop[where + 1].tolist(), strict=True)]
        self.number = number.reshape(-1).astype(np.int32)
        last = np.searchsorted(at, ends)  # each end is a piece of its own, and dropped
        self.keep = np.ones(len(at), bool)
        self.keep[last] = False
        lengths = np.diff(np.concatenate(([-1], last))) - 1
        self.owner, self.lengths = owner, lengths


class Vocabulary:
    """Merges, ids and bytes of a byte-level BPE file in the tokenizers library's format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        to_char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        to_byte = {c: b for b, c in to_char.items()}
        self.byte_ids = np.array([vocab[to_char[b]] for b in range(256)], np.int64)
        self.merges: list[tuple[int, int, int]] = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
        keys = np.array([a << 32 | b for a, b, _ in self.merges], np.int64)
        self.pair_ranks = np.argsort(keys)
        self.pair_keys = keys[self.pair_ranks]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        shown_as = {i: bytes(map(to_byte.__getitem__, t)) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        pool = [shown_as.get(i, b"") for i in range(max(shown_as) + 1)]
        self.byte_pool = np.frombuffer(b"".join(pool), np.uint8)
        self.byte_count = np.fromiter(map(len, pool), np.int64, len(pool))
        self.byte_first = np.cumsum(self.byte_count) - self.byte_count
        self.words: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}
        self.counter: Counter | None = None

    @staticmethod
    def load(path: str) -> Vocabulary:
        cache = worker_cache("bpe")
        if (key := ("vocabulary", path)) not in cache:
            cache[key] = Vocabulary(path)
        return cache[key]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 if it never merges."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def merge_all(self, words: list[str]) -> list[bytes]:
        """The ids of every word as little-endian unsigned 32-bit integers, merged together through one pair occurrence index."""
        coded = [w.encode() for w in words]
        sym = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        n = len(sym)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = sizes > 0
        after[ends[full] - 1] = -1
        before[(ends - sizes)[full]] = -1
        index: dict[int, list[np.ndarray]] = {}  # by rank: the positions of its pair
        heap: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks >= 0
            if not known.all():
                places, ranks = places[known], ranks[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            cuts = [0, *cut.tolist(), len(ranks)]
            for r, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heappush(heap, r)

        at = np.flatnonzero(after >= 0)
        enter(at, self.ranks(sym[at], sym[at + 1]))
        while heap:
            rank = heappop(heap)
            lists = index.pop(rank)
            p = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, new = self.merges[rank]
            q = after[p]
            live = (sym[p] == a) & (q >= 0) & (sym[q] == b)  # q of -1 reads the last symbol, which the second test drops
            if not live.all():
                p, q = p[live], q[live]
            if a == b or len(lists) > 1:
                p = np.unique(p)
                if a == b and len(p) > 1:  # of a run of equal symbols, every second pair from the left
                    taken, chosen = set(), []
                    for x, y in zip(p.tolist(), after[p].tolist(), strict=True):
                        if x not in taken:
                            chosen.append(x)
                            taken.add(y)
                    p = np.array(chosen)
                q = after[p]
            if not len(p):
                continue
            right = after[q]
            sym[p], sym[q], after[p] = new, -1, right
            has = right >= 0
            before[right[has]] = p[has]
            left = before[p]
            pl = left[left >= 0]
            pr = p[has]
            where = np.concatenate((pl, pr))
            if len(where):
                enter(where, self.ranks(sym[where], sym[after[where]]))
        live = sym >= 0
        counts = np.add.reduceat(np.append(live, False).astype(np.int64), np.minimum(ends - sizes, n)) * full if len(sizes) else sizes
        ids = sym[live].astype("<u4").tobytes()
        stops = np.cumsum(counts) * 4
        return [ids[x:y] for x, y in zip((stops - counts * 4).tolist(), stops.tolist(), strict=True)]

    def split_special(self, text: str) -> list[str | int]:
        """The text between special strings, and their ids."""
        parts: list[str | int] = [text]
        for s, i in self.special.items():
            if s in text:
                cut: list[str | int] = []
                for x in parts:
                    if isinstance(x, int):
                        cut.append(x)
                        continue
                    for j, y in enumerate(x.split(s)):
                        cut += [i, y] if j else [y]
                parts = cut
        return parts

    def learn(self, distinct: list[str]) -> dict[str, bytes]:
        """Merge the pieces that were not met before; the dict holds all of them."""
        if len(self.words) > WORDS_KEPT:  # what this batch needs, common words among it, stays
            self.words = {w: self.words[w] for w in distinct if w in self.words}
        new = [w for w in distinct if w not in self.words]
        if new:
            new = list(dict.fromkeys(new))
            self.words.update(zip(new, self.merge_all(new), strict=True))
        return self.words

    def measure(self, distinct: list[str]) -> dict[str, int]:
        """Count the tokens of pieces that were not met before; the dict holds all of them."""
        if self.counter is None:
            self.counter = Counter(self)
        if len(self.sizes) > WORDS_KEPT:
            self.sizes = {w: self.sizes[w] for w in distinct if w in self.sizes}
        new = list(dict.fromkeys(w for w in distinct if w not in self.sizes))
        self.sizes.update(zip(new, self.counter.counts(new), strict=True))
        return self.sizes

    def parts(self, text: str) -> Iterator[str | int]:
        """A long text as sections and ids of special strings."""
        for x in self.split_special(text):
            if isinstance(x, int):
                yield x
            else:
                yield from sections(x)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        short = iter(self._encode([t for t in texts if len(t) <= SECTION]))
        one = lambda x: np.array([x], "<u4") if isinstance(x, int) else self._encode([x])[0]
        return [next(short) if len(t) <= SECTION else np.concatenate([one(x) for x in self.parts(t)]) for t in texts]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        x = Pieces(self, texts)
        coded = list(map(self.learn(x.distinct).__getitem__, x.distinct))
        flat = np.frombuffer(b"".join(coded), "<u4")
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        first = np.cumsum(size) - size
        number = x.number[x.keep]
        count = size[number]
        ids = flat[spread(first[number], count)]
        done = np.concatenate(([0], np.cumsum(count)))[np.concatenate(([0], np.cumsum(x.lengths)))].tolist()
        out: list = [None] * x.size
        j = 0
        for k, special in x.owner:
            if special >= 0:
                part = np.array([special], "<u4")
            else:
                part = ids[done[j] : done[j + 1]]
                j += 1
            out[k] = part if out[k] is None else np.concatenate((out[k], part))
        return out

    def count_batch(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        short = iter(self._count([t for t in texts if len(t) <= SECTION]))
        one = lambda x: 1 if isinstance(x, int) else self._count([x])[0]
        return [next(short) if len(t) <= SECTION else sum(one(x) for x in self.parts(t)) for t in texts]

    def _count(self, texts: list[str]) -> list[int]:
        if not texts:
            return []
        x = Pieces(self, texts)
        known = self.measure(x.distinct)
        size = np.fromiter(map(known.__getitem__, x.distinct), np.int64, len(x.distinct))
        total = np.concatenate(([0], np.cumsum(size[x.number[x.keep]])))
        done = total[np.concatenate(([0], np.cumsum(x.lengths)))].tolist()
        out, j = [0] * x.size, 0
        for k, special in x.owner:
            if special >= 0:
                out[k] += 1
            else:
                out[k] += done[j + 1] - done[j]
                j += 1
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; text is their UTF-8 reading, with replacement characters for what is none."""
        ids = np.asarray(ids, np.int64)
        return self.byte_pool[spread(self.byte_first[ids], self.byte_count[ids])].tobytes()
