"""SentencePiece vocabularies without the library's encoder: a streaming Viterbi search compiled to a byte transducer.

The lattice of a text has an arc per piece. In a vocabulary of the merge kind (BPE) an arc is admitted if its piece is
*compatible* with the piece before it (merging their joined text gives the two back); every boundary then ends exactly
one path. Either way (``kind="unigram"`` keeps the arc of the highest score sum) a boundary keeps one backpointer, and
only boundaries within the longest piece's length can begin a later arc. Once the backpointer paths of all of these
pass one boundary, the ids before it are committed and leave the window.

What the search does next depends only on the longest suffix that begins a piece and on the pieces that end at the
boundaries in it. These are the states of a deterministic transducer over bytes. A transition carries the arc into the
new boundary and how far back all paths meet, or, for counting, by how much the token count changes. Transitions are
compiled as texts need them, into one hash table, so that numpy steps through many chunks of fixed size side by side.
A chunk's map takes states to states; the maps compose in a prefix scan, which tells what state each chunk begins in.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import numpy as np

SPACE = "▁"
#: The symbol before each text, read as the space that the format puts there; no byte of UTF-8 has this value.
START = 0xFF
#: Bytes of a chunk and of what is scanned at once, and bytes before a chunk from which its first state is guessed.
CHUNK, BLOCK, AHEAD = 512, 1 << 20, 32
#: Bounds on what a worker process remembers; beyond them a memo or the transducer is built anew.
MEMO_PAIRS, MOST_STATES = 300_000, 300_000


class Vocabulary:
    """Pieces, ranks and byte ids of a model file's bytes."""

    def __init__(self, model: bytes, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.kind = kind
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids = np.zeros(256, np.int32)
        self.is_byte = np.zeros(n, bool)
        for i in range(n):
            piece = sp.id_to_piece(i)
            self.scores.append(sp.get_score(i))
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.is_byte[i] = True
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if SPACE not in self.ids or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a vocabulary whose pieces begin at spaces is needed")
        self.longest = max(map(len, self.ids))
        #: What a later character can lengthen to a piece.
        self.openings = {p[:k] for p in self.ids for k in range(1, len(p))}
        self.plain = sp.normalize(" Aﬁ  ① b́ ") == f"{SPACE * 2}Aﬁ{SPACE * 2}①{SPACE}b́{SPACE}"
        self.normaliser = sp
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.pieces = {i: p for p, i in self.ids.items()}

    def merge(self, text: str) -> list[str]:
        """Merge neighbours of the best rank, leftmost first, until none is left; for short texts only."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, i: int) -> bool:
        out = self._whole.get(i)
        if out is None:
            out = self._whole[i] = len(self.merge(self.pieces[i])) == 1
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives back these two; nothing merges with what is no piece (-1)."""
        if left < 0:
            return True
        key = left << 32 | right
        out = self._pairs.get(key)
        if out is None:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            out = self._pairs[key] = self.merge(a + b) == [a, b]
        return out


#: A state: the longest suffix that begins a piece, the piece that ends at each boundary in it (-1 where it makes no
#: difference), token counts there relative to now, and the bytes of a character that is not complete.
NOTHING = ("", (-1,), (0,), b"")
#: A free slot of the table, the factor of its hash, and what a change of the count is held relative to.
FREE, FACTOR, EVEN = (1 << 64) - 1, 0x9E3779B1, 1 << 16


def packed_state(key: tuple) -> bytes:
    """A state as the machine holds it: a third of the bytes of its tuples. Equal states give equal bytes."""
    suffix, lasts, counts, partial = key
    numbers = array("i", (*lasts, *counts) if any(counts) else lasts)
    text = suffix.encode()
    return b"".join([len(text).to_bytes(3, "little"), bytes([len(partial)]), text, partial, numbers.tobytes()])


def unpacked_state(data: bytes) -> tuple:
    end = 4 + int.from_bytes(data[:3], "little")
    after = end + data[3]
    suffix, numbers = data[4:end].decode(), array("i", data[after:])
    n = len(suffix) + 1
    return suffix, tuple(numbers[:n]), tuple(numbers[n:]) or (0,) * n, data[end:after]


class Machine:
    """The transducer. ``counted``: a transition carries the change of the token count, else the number of an arc."""

    def __init__(self, v: Vocabulary, counted: bool = False, most: int | None = None):
        self.v, self.counted, self.most = v, counted, most or MOST_STATES
        self.arcs: dict[tuple[int, int, int], int] = {}
        self.chunks = 0  # chunks whose maps were made
        self._clear()
        self.begin = self.step(NOTHING, 32)[0]

    def _clear(self) -> None:
        self.shapes: dict[str, tuple] = {}
        self.keys: list[bytes] = []
        self.numbers: dict[bytes, int] = {}
        self.n, self.bits = 0, 16
        # An entry: 27 bits of state and byte, 20 of the next state, 17 of what the transition carries.
        self.table = np.full(1 << self.bits, FREE, np.uint64)

    def state(self, key: tuple) -> int:
        """The number of a state, times 256."""
        held = packed_state(key)
        out = self.numbers.get(held)
        if out is None:
            out = self.numbers[held] = len(self.keys) << 8
            self.keys.append(held)
        return out

    def states(self, keys: list[tuple]) -> np.ndarray:
        return np.array([self.state(k) for k in keys], np.uint32)

    def names(self, states: np.ndarray) -> list[tuple]:
        return [unpacked_state(self.keys[s]) for s in (states >> 8).tolist()]

    def shape(self, text: str) -> tuple[list[tuple[int, int]], list[int]]:
        """Of a window: its pieces that end it as (length, id), longest first, and the boundaries that later arcs can
        begin at, as far back as the longest suffix that begins a piece."""
        out = self.shapes.get(text)
        if out is None:
            v, n = self.v, len(text)
            ends = [(n - k, v.ids[text[k:]]) for k in range(max(0, n - v.longest), n) if text[k:] in v.ids]
            starts = [k for k in range(max(0, n - v.longest), n) if text[k:] in v.openings]
            out = self.shapes[text] = ([(k, i) for k, i in ends if v.whole(i)], starts)
        return out

    def step(self, key: tuple, byte: int) -> tuple[tuple, int, int, int, int]:
        """The next state, the change of the token count, the arc into the new boundary (bytes and piece, -1 for a
        character outside the vocabulary) and how many bytes ago all paths that can go on meet (-1: not known)."""
        if byte == START:
            return self.begin, 1, 1, self.v.ids[SPACE], 1
        suffix, lasts, counts, partial = key
        partial += bytes([byte])
        first = partial[0]
        if 0x80 <= first < 0xC0:  # only where a guess began inside a character
            return key, 0, 0, -1, -1
        if len(partial) < (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4):
            return (suffix, lasts, counts, partial), 0, 0, -1, -1
        c = SPACE if partial == b" " else partial.decode(errors="replace")
        text = suffix + c
        n = len(text)
        ends, starts = self.shape(text)
        length, piece, change = 1, -1, counts[n - 1] + len(partial)
        for k, i in ends:
            if self.v.compatible(lasts[n - k], i):
                length, piece, change = k, i, counts[n - k] + 1
                break
        size = len(partial) if length == 1 else len(text[n - length :].replace(SPACE, " ").encode())
        if not starts:
            return NOTHING, change if self.counted else 0, size, piece, 0
        low = starts[0]
        new = [-1] * (n - low) + [piece]
        relative = [0] * (n - low + 1)
        for k in starts:
            new[k - low] = lasts[k]
            if self.counted:
                relative[k - low] = counts[k] - change
        alive = {n - low, *(k - low for k in starts)}
        while len(alive) > 1:  # walk the youngest path back until all have met
            top = max(alive)
            alive.discard(top)
            back = top - len(self.v.pieces[new[top]]) if new[top] >= 0 else -1
            if back < 0:
                alive.clear()
            else:
                alive.add(back)
        lag = len(text[low + alive.pop() :].replace(SPACE, " ").encode()) if alive else -1
        if new[0] >= 0 and text[low] == SPACE and self.v.pieces[new[0]][-1] != SPACE:
            new[0] = -1  # no piece lies across
        return (text[low:], tuple(new), tuple(relative), b""), change if self.counted else 0, size, piece, lag

    def _grow(self) -> None:
        old = self.table[self.table != FREE]
        self.bits += 1
        self.table = np.full(1 << self.bits, FREE, np.uint64)
        for start in range(0, len(old), 4096):
            for x in old[start : start + 4096].tolist():
                self._put(x)

    def _put(self, entry: int) -> None:
        table, last = self.table.data, len(self.table) - 1
        slot = ((entry >> 37) * FACTOR & 0xFFFFFFFF) >> (32 - self.bits)
        while table[slot] != FREE:
            slot = (slot + 1) & last
        table[slot] = entry

    def _compile(self, x: int) -> None:
        key, change, size, piece, lag = self.step(unpacked_state(self.keys[x >> 8]), x & 255)
        what = change + EVEN if self.counted else self.arcs.setdefault((size, piece, lag), len(self.arcs))
        self._put(x << 37 | self.state(key) >> 8 << 17 | what)
        self.n += 1
        if self.n > len(self.table) >> 1:
            self._grow()

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each key, and where there is none."""
        slots = ((keys * np.uint32(FACTOR)) >> np.uint32(32 - self.bits)).astype(np.int64)
        entries = self.table[slots]
        todo = np.flatnonzero((entries >> np.uint64(37)) != keys)
        if not len(todo):
            return entries, todo
        while len(todo):
            todo = todo[entries[todo] != FREE]
            slots[todo] = (slots[todo] + 1) & (len(self.table) - 1)
            entries[todo] = self.table[slots[todo]]
            todo = todo[(entries[todo] >> np.uint64(37)) != keys[todo]]
        return entries, np.flatnonzero(entries == FREE)

    def run(self, symbols: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Step through ``symbols`` (position, stream) from ``states``: the last states, and what each step carries."""
        out = np.empty(symbols.shape, np.int32)
        for p, row in enumerate(symbols):
            keys = states + row
            entries, new = self._look(keys)
            if len(new):
                if len(self.keys) > self.most:  # only the states at hand stay
                    names = self.names(states)
                    self._clear()
                    states = self.states(names)
                    keys = states + row
                    new = slice(None)
                for x in np.unique(keys[new]).tolist():
                    self._compile(x)
                entries, _ = self._look(keys)
            states = (entries >> np.uint64(9)).astype(np.uint32) & np.uint32(0x0FFFFF00)
            out[p] = entries.astype(np.int32) & 0x1FFFF
        return states, out - EVEN if self.counted else out

    def scan(self, data: np.ndarray, entry: tuple) -> tuple[tuple, np.ndarray]:
        """The state after ``data``, begun in ``entry``, and what each byte's step carries.

        All chunks run at once, each from the state that the bytes before it suggest. A chunk's map then gets an entry
        for every state that its neighbour's map can end in, until nothing is missing; maps compose up a tree and the
        states that chunks truly begin in come down it.
        """
        n = -(-len(data) // CHUNK)
        rest = data[(n - 1) * CHUNK :]
        rows = np.concatenate([data[: (n - 1) * CHUNK], rest, np.full(CHUNK - len(rest), START, np.uint8)]).reshape(n, CHUNK)
        guess, _ = self.run(np.ascontiguousarray(rows[:-1, -AHEAD:].T), np.full(n - 1, self.state(self.begin), np.uint32))
        begin = [entry, *self.names(guess)]
        ends, out = self.run(np.ascontiguousarray(rows.T), self.states(begin))
        maps = [{b: (e, 0, k)} for k, (b, e) in enumerate(zip(begin, self.names(ends), strict=True))]
        outs = [out]
        todo = {(k, e) for k in range(1, n) for e, _, _ in maps[k - 1].values() if e not in maps[k]}
        while todo:
            which = list(todo)
            ends, out = self.run(np.ascontiguousarray(rows[[k for k, _ in which]].T), self.states([b for _, b in which]))
            todo = set()
            for at, ((k, b), e) in enumerate(zip(which, self.names(ends), strict=True)):
                maps[k][b] = (e, len(outs), at)
            for (k, b), e in zip(which, self.names(ends), strict=True):
                if k + 1 < n and e not in maps[k + 1]:
                    todo.add((k + 1, e))
            outs.append(out)
        levels = [[{b: e[0] for b, e in m.items()} for m in maps]]
        while len(levels[-1]) > 1:
            low = levels[-1]
            levels.append([{b: low[k + 1][e] for b, e in low[k].items()} if k + 1 < len(low) else low[k] for k in range(0, len(low), 2)])
        states = [entry]
        for low in reversed(levels[:-1]):
            states = [low[k - 1][states[k // 2]] if k % 2 else states[k // 2] for k in range(len(low))]
        found = np.ascontiguousarray(outs[0].T)
        for k, s in enumerate(states):
            _, which, at = maps[k][s]
            if which or at != k:
                found[k] = outs[which][:, at]
        self.chunks += n
        return levels[-1][0][entry] if len(rest) == CHUNK else self.begin, found.reshape(-1)[: len(data)]

    def counts(self, data: np.ndarray) -> np.ndarray:
        """Of texts that each have ``START`` before them: the change of the token count at each byte."""
        state, out = self.begin, []
        for s in range(0, len(data), BLOCK):
            state, e = self.scan(data[s : s + BLOCK], state)
            out.append(e)
        return np.concatenate(out)

    def ids(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts that each have ``START`` before them: how many ids end at each byte, and the ids.

        Blocks are read one after the other; what is committed leaves, the arcs since then stay for the next block.
        """
        data = np.append(data, np.uint8(START))  # all paths meet before it
        state, done, kept = self.begin, 0, np.zeros(0, np.int32)
        many, ids = np.zeros(len(data), np.uint8), []
        for s in range(0, len(data), BLOCK):
            state, e = self.scan(data[s : s + BLOCK], state)
            e = np.concatenate([kept, e])  # of the bytes from ``done`` on
            size, piece, lag = np.array(list(self.arcs), np.int32).T
            behind = lag[e]
            met = np.flatnonzero(behind >= 0).astype(np.int32)
            ends = np.concatenate([np.zeros(1, np.int32), np.maximum(met + 1 - behind[met], 0)])  # they never go back
            del met, behind
            ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])]
            last, marks = np.zeros(len(e), bool), ends[1:]
            stop = ends[:-1]
            while len(marks):
                last[marks - 1] = True
                marks = marks - size[e[marks - 1]]
                more = marks > stop
                marks, stop = marks[more], stop[more]
            at = np.flatnonzero(last)
            del last, marks, stop
            pieces, n = piece[e[at]], size[e[at]].astype(np.int64)
            n[pieces >= 0] = 1
            first = np.repeat(at + 1 - n - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            ids.append(np.where(np.repeat(pieces, n) >= 0, np.repeat(pieces, n), self.v.byte_ids[data[done + first]]))
            many[done + at] = n
            done, kept = done + int(ends[-1]), e[int(ends[-1]) :]
        return many[:-1], np.concatenate(ids)


class Encoder:
    """Encoder, decoder and counter of a vocabulary."""

    def __init__(self, model: bytes, kind: str = "bpe", counted: bool = False, most: int | None = None):
        self.v = Vocabulary(model, kind)
        self.machine = Machine(self.v, counted, most)
        self.lengths = np.array([len(b) for b in self.v.bytes_of], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.v.bytes_of), np.uint8)

    def data(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes, each text after ``START``; where each begins, and which hold anything."""
        if not self.v.plain:
            texts = [self.v.normaliser.normalize(t)[1:] if t else "" for t in texts]
        coded = [t.replace(SPACE, " ").encode() if t else b"" for t in texts]
        lengths = np.array([len(c) for c in coded], np.int64)
        return np.frombuffer(bytes([START]).join([b"", *coded]), np.uint8), np.cumsum(lengths + 1) - lengths - 1, lengths > 0

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        data, starts, some = self.data(texts)
        return np.add.reduceat(self.machine.counts(data), starts, dtype=np.int64) * some if len(starts) else np.zeros(0, np.int64)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin and end in them. Empty texts have none."""
        if self.v.kind != "bpe":
            lists = [np.array(list(self.stream(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
            return np.concatenate([*lists, np.zeros(0, np.int32)]), np.cumsum([0, *map(len, lists)])
        data, starts, some = self.data(texts)
        if not some.any():
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        many, ids = self.machine.ids(data)
        n = np.add.reduceat(many, starts, dtype=np.int64)
        if not some.all():
            ids = ids[np.repeat(some, n)]  # the space before an empty text
        return ids, np.concatenate([[0], np.cumsum(n * some)])

    def encode(self, text: str | None) -> list[int]:
        return self.batch([text])[0].tolist()

    def stream(self, text: str):
        """Ids of a text under a unigram vocabulary, the arc of the best score sum into each boundary, committed while
        characters arrive."""
        v, window, scores, arcs, kept = self.v, "", [0.0], [], ""
        worst = min(v.scores) - 10.0
        for c in (v.normaliser.normalize(text) if not v.plain else SPACE + text.replace(" ", SPACE)):
            window, kept = (window + c)[-v.longest :], kept + c
            best, arc = scores[-1] + worst, (1, -1)
            for n in range(1, len(window) + 1):
                i = v.ids.get(window[-n:])
                if i is not None and (scores[-n] + v.scores[i] > best or arc[1] < 0):
                    best, arc = scores[-n] + v.scores[i], (n, i)
            scores = [*scores, best][-v.longest :]
            arcs.append(arc)
            alive = {len(arcs)} | {len(arcs) - n for n in range(1, min(len(window), len(arcs)) + 1) if window[-n:] in v.openings}
            while len(alive) > 1:
                top = max(alive)
                alive.discard(top)
                alive.add(top - arcs[top - 1][0])
            meet = alive.pop()
            if meet > 0:
                yield from self._path(kept, arcs, meet)
                arcs, kept = arcs[meet:], kept[meet:]
        yield from self._path(kept, arcs, len(arcs))

    def _path(self, text: str, arcs: list, end: int) -> list[int]:
        out = []
        while end > 0:
            n, i = arcs[end - 1]
            out += [i] if i >= 0 else self.v.byte_ids[list(text[end - 1].encode())].tolist()[::-1]
            end -= n
        return out[::-1]

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids; the leading space that encoding adds goes."""
        n = self.lengths[ids]
        at = np.repeat(self.offsets[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        data, ends = self.bytes[at].tobytes(), np.concatenate([[0], np.cumsum(n)])[bounds].tolist()
        return [data[a + (data[a : a + 1] == b" ") : e] if a < e else b"" for a, e in zip(ends, ends[1:], strict=False)]

    def decode(self, ids) -> str:
        """Text of ids; bytes that aren't UTF-8 become U+FFFD."""
        a = np.asarray(ids, np.int64)
        return self.decoded(a, np.array([0, len(a)]))[0].decode(errors="replace")


@lru_cache(maxsize=2)
def encoder(model: bytes, kind: str = "bpe", counted: bool = False) -> Encoder:
    """A worker process's encoder; what it has compiled serves all tasks that the process runs."""
    return Encoder(model, kind, counted)
