"""Token counts by a finite-state machine compiled from a piece vocabulary.

A byte-pair vocabulary with whole-character pieces gives every prefix of a text
one last token, and the tokens before it are those of the shorter prefix. So
the count after each character follows from the last tokens at those earlier
places from which a piece can still run on. These places, each as (node in the
trie of pieces, last token before it, count relative to now), are a state of a
deterministic machine; each transition is annotated with the tokens that it
adds, which is negative where pieces merge. Whether two tokens stay apart side by
side is read off the merges that made them, the latest undone first. Across a pair
of neighbouring characters that no piece holds, nothing can merge: the token
before such a place is forgotten, which makes states few and lets the machine
fall into step at every word.

The transitions that a sample meets are compiled beforehand (``compiled_table``,
to be sent to the workers); others when they are first met. They are kept in a
dense table.

Texts are cut into chunks that run side by side, one array operation for a
character of each. A chunk's map takes states before it to states behind it and
counts. It is computed for the state that the few characters before the chunk
lead to and, round by round, for all states that its left neighbour's map leads
to, until maps fit together. Then the maps of a text are composed by a parallel
prefix scan. In text with spaces one state is all a map needs; where tokens run on
without ever falling into step (one letter over and over) it needs a state for
each phase of the run, a handful.
"""

from __future__ import annotations

import numpy as np

SPACE = "▁"
COLUMNS = 128
#: Chunks that run side by side, about, and the characters in the shortest and the longest.
LANES, SHORT, LONG = 2048, 64, 2048
#: Characters before a chunk that are read to guess the state before it.
LEAD = 48
#: Characters before a chunk by which chunks are alike.
ALIKE = 16
#: States beyond which the table is compiled afresh before the next texts.
MAX_STATES = 1 << 17
#: Pairs of tokens that are remembered while states are compiled.
MAX_PAIRS = 400_000
ANY = -1
FEW = 10


class TooManyStates(Exception):
    pass


def _grown(parts: list[int], lengths) -> tuple[list[int], tuple[int, int] | None]:
    """Neighbours merged, the leftmost first, while their sum is among ``lengths``; and the last two that were."""
    made = None
    while at := next((i for i in range(1, len(parts)) if parts[i - 1] + parts[i] in lengths), 0):
        made = parts[at - 1], parts[at]
        parts = [*parts[: at - 1], sum(made), *parts[at + 1 :]]
    return parts, made


class Machine:
    """pieces: (piece, score) of the normal pieces; texts begin with a space mark and hold marks for spaces."""

    def __init__(self, pieces: list[tuple[str, float]], max_states: int = MAX_STATES):
        self.max_states = max_states
        # Classes: a number for each character of a piece, then unknown characters by their bytes.
        self.symbols = sorted({c for p, _ in pieces for c in p})
        known = len(self.symbols)
        place = {c: i for i, c in enumerate(self.symbols)}
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[:0x80], self.class_of[0x80:0x800], self.class_of[0x800:0x10000], self.class_of[0x10000:] = known, known + 1, known + 2, known + 3
        for i, c in enumerate(self.symbols):
            self.class_of[ord(c)] = i
        self.class_of[0x20] = self.class_of[ord(SPACE)]
        self.space_class = int(self.class_of[0x20])
        self.n_classes = known + 4
        self.bytes_of = [len(c.encode()) for c in self.symbols]
        # Tokens: the characters, then the longer pieces in the order in which they are merged.
        self.is_piece = [False] * known
        for p, _ in pieces:
            if len(p) == 1:
                self.is_piece[place[p]] = True
        longer = sorted((p for p in pieces if len(p[0]) > 1), key=lambda p: -p[1])
        self.text = [*self.symbols, *(p for p, _ in longer)]
        self.parts = [(i, i) for i in range(known)]
        self.merge: dict[tuple[int, int], int] = {}
        number = dict(place)
        for p, _ in longer:  # a piece is what its last merge made of two tokens that had stayed apart until then
            at, found = len(self.parts), None
            for i in range(1, len(p)):
                x, y = number.get(p[:i]), number.get(p[i:])
                if x is not None and y is not None and self._apart(x, y):
                    found = (x, y)
                    break
            self.parts.append(found or (at, at))
            if found:
                self.merge[found] = number[p] = at
        # Runs of the space mark share one score, below all others: of such merges the leftmost comes first.
        self.run = [len(t) if set(t) == {SPACE} else 0 for t in self.text]
        runs = {n: t for t, n in enumerate(self.run) if n}
        self.runs_apart = {(x, y): _grown([1] * (x + y), runs)[0] == [x, y] for x in runs for y in runs}
        for n, t in runs.items():
            if n > 1:
                whole, made = _grown([1] * n, runs)
                self.parts[t] = (runs[made[0]], runs[made[1]]) if whole == [n] else (t, t)
        self.first = [place[t[0]] for t in self.text]
        self.last = [place[t[-1]] for t in self.text]
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [ANY]
        self.first_of: list[int] = [ANY]
        for token in [*(i for i in range(known) if self.is_piece[i]), *(t for t in range(known, len(self.text)) if self.parts[t][0] != t)]:
            at = 0
            for c in self.text[token]:
                if place[c] not in self.child[at]:
                    self.child[at][place[c]] = len(self.child)
                    self.child.append({})
                    self.token_at.append(ANY)
                    self.first_of.append(self.first_of[at] if at else place[c])
                at = self.child[at][place[c]]
            self.token_at[at] = token
        self.bigrams = {(place[t[i]], place[t[i + 1]]) for t in self.text[known:] for i in range(len(t) - 1)}
        self.heads = {a for a, _ in self.bigrams}
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces_below: dict[int, list[int] | None] = {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        #: next state * 256 + tokens added + 128, or -1 where it is not compiled, by state * COLUMNS + column.
        self.table = np.full((1 << 10) * COLUMNS, -1, np.int32)
        self.rare: dict[tuple[int, int], tuple[int, int]] = {}
        self.column_of = np.full(self.n_classes, -1, np.int32)
        self.columns = 0
        self._column(self.space_class)
        self.void = self._state(((0, ANY, 0),))  # nothing read
        self.start, _ = self.step(self.void, self.space_class)

    def compiled_table(self) -> tuple:
        """What has been compiled so far, for ``load``."""
        return self.keys, self.table[: len(self.keys) * COLUMNS], self.rare, self.column_of, self.columns

    def load(self, compiled: tuple) -> None:
        keys, table, rare, column_of, self.columns = compiled
        self.keys, self.states = list(keys), {k: i for i, k in enumerate(keys)}
        size = 1 << 10
        while size < len(keys):
            size *= 2
        self.table = np.full(size * COLUMNS, -1, np.int32)
        self.table[: len(table)] = table
        self.rare, self.column_of = dict(rare), column_of.copy()

    def _column(self, cls: int) -> None:
        if self.columns < COLUMNS:
            self.column_of[cls] = self.columns
            self.columns += 1

    def _state(self, key: tuple) -> int:
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.keys)
            self.keys.append(key)
            if (at + 1) * COLUMNS > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return at

    def _apart(self, x: int, y: int) -> bool:
        """Whether no merge reaches across the border of the tokens x and y before both are made; tokens are numbered in the order of merges."""
        merge, parts, limit = self.merge, self.parts, len(self.text)
        while True:
            both = merge.get((x, y))
            if both is not None and both < limit:
                return False
            # Undo the later of the two: the token next to the border before that merge.
            if x > y:
                limit, x = x, parts[x][1]
                if x == limit:
                    return True
            else:
                before, y = y, parts[y][0]
                limit = before + 1
                if y == before:  # a character; so is x, or it was made earlier than y could be
                    while True:
                        limit, x = x, parts[x][1]
                        if x == limit:
                            return True
                        both = merge.get((x, y))
                        if both is not None and both < limit:
                            return False

    def fits(self, before: int, token: int) -> bool:
        """Whether both stay apart and whole when they stand side by side."""
        if before == ANY:
            return True
        if self.run[before] and self.run[token]:
            return self.runs_apart[self.run[before], self.run[token]]
        key = (before, token)
        got = self._fits.get(key)
        if got is None:
            got = self._fits[key] = self._apart(before, token)
        return got

    def step(self, state: int, cls: int) -> tuple[int, int]:
        """The transition, compiled if it is new: next state, tokens added."""
        col = self.column_of[cls]
        if col >= 0:
            got = int(self.table[state * COLUMNS + col])
            if got >= 0:
                return got >> 8, (got & 255) - 128
        elif (state, cls) in self.rare:
            return self.rare[state, cls]
        known = cls < len(self.symbols)
        last, count, alive = None, 0, []
        for node, before, rel in self.keys[state]:
            to = self.child[node].get(cls) if known else None
            if to is None:
                if node == 0 and last is None:
                    last, count = (cls, rel + (1 if self.is_piece[cls] else self.bytes_of[cls])) if known else (ANY, rel + cls - len(self.symbols) + 1)
                continue
            token = self.token_at[to]
            if token != ANY and last is None and self.fits(before, token):
                last, count = token, rel + 1
            if self.child[to]:
                alive.append((to, before, rel))
            if node == 0 and last is None:
                last, count = cls, rel + self.bytes_of[cls]  # a character that is part of pieces, but none itself
        # What follows can only merge with the last token if some piece holds both neighbours; that is looked at when the next character is known.
        key = tuple([(n, b, r - count) for n, b, r in alive]) + ((0, ANY if last is None else last, 0),)
        to = self._state(self._forget(key))
        if col >= 0:
            self.table[state * COLUMNS + col] = (to << 8) + count + 128
        else:
            self.rare[state, cls] = (to, count)
        return to, count

    def _below(self, node: int) -> list[int] | None:
        """The pieces that run on beyond a node; None if they are many."""
        got = self._pieces_below.get(node, 0)
        if got == 0:
            got, todo = [], list(self.child[node].values())
            while todo and len(got) <= FEW:
                at = todo.pop()
                if self.token_at[at] != ANY:
                    got.append(self.token_at[at])
                todo.extend(self.child[at].values())
            got = self._pieces_below[node] = None if len(got) > FEW else got
        return got

    def _forget(self, key: tuple) -> tuple:
        """Leave out places that no piece can start from, and tokens that nothing can merge with: states that differ only there are one."""
        out = []
        for node, before, rel in key:
            if before != ANY:
                if node == 0:
                    if self.last[before] not in self.heads:
                        before = ANY
                elif (self.last[before], self.first_of[node]) not in self.bigrams:
                    before = ANY
                elif (few := self._below(node)) is not None:
                    can = [self.fits(before, p) for p in few]
                    if not any(can):
                        continue
                    if all(can):
                        before = ANY
            out.append((node, before, rel))
        return tuple(out)

    # Running over many texts

    def _run(self, state: np.ndarray, begin: np.ndarray, end: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read classes[begin:end] on each lane, all lanes side by side: the states behind it and the tokens added."""
        order = np.argsort(begin - end, kind="stable")  # the longest first: lanes that are still running are a prefix
        at, left = begin[order], (end - begin)[order]
        s, n = state[order].astype(np.int64), np.zeros(len(order), np.int64)
        running_at = np.searchsorted(-left, -np.arange(1, (int(left[0]) if len(left) else 0) + 1), "right")
        columns = self.column_of
        for done, running in enumerate(running_at.tolist()):
            cls = classes.take(at[:running] + done)
            col = columns.take(cls)
            now = s[:running]
            got = self.table.take(now * COLUMNS + col)
            if got.min() < 0 or col.min() < 0:
                new = np.flatnonzero((got < 0) | (col < 0))
                got[new] = self._compile(now[new], cls[new])
            s[:running] = got >> 8
            n[:running] += (got & 255) - 128
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return s[back], n[back]

    def _compile(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        pair, back = np.unique(states * self.n_classes + classes, return_inverse=True)
        found = [self.step(int(p) // self.n_classes, int(p) % self.n_classes) for p in pair.tolist()]
        if len(self.keys) > 2 * self.max_states:
            raise TooManyStates
        return np.array([(to << 8) + add + 128 for to, add in found], np.int32)[back]

    def advance(self, entry: np.ndarray, classes: np.ndarray, ends: np.ndarray, chunk: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each text, which begins in the state ``entry``: the state behind it and the tokens that it adds. classes holds all texts in a row, ends where each ends."""
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        chunk = chunk or min(LONG, max(SHORT, -(-len(classes) // LANES)))
        chunks = -(-(ends - begins) // chunk)
        text = np.repeat(np.arange(len(ends)), chunks)
        if not len(text):
            return entry.copy(), np.zeros(len(ends), np.int64)
        number = np.arange(len(text)) - (np.cumsum(chunks) - chunks)[text]
        lo = begins[text] + number * chunk
        hi = np.minimum(lo + chunk, ends[text])
        inner = np.flatnonzero(number > 0)
        # The guess: what the characters before the chunk lead to, from the text's own state or, further in, as if a text began there.
        lead = np.maximum(lo[inner] - LEAD, begins[text[inner]])
        guess = np.where(lead == begins[text[inner]], entry[text[inner]], self.start)
        before = entry[text].astype(np.int64)
        before[inner] = self._run(guess, lead, lo[inner], classes)[0]
        behind, added = self._run(before, lo, hi, classes)
        # Maps, a column for each state before the chunk; -1 where a chunk has fewer.
        before, behind, added = before[:, None], behind[:, None], added[:, None]
        step = np.zeros_like(before)  # the column of the right neighbour that holds the state behind
        open_, rounds = np.ones(before.shape, bool), 0  # states behind, of which the right neighbour's map is not known to hold them
        while True:
            k, d = np.nonzero(open_[inner - 1])
            k = inner[k]
            x = behind[k - 1, d]
            same = before[k] == x[:, None]
            step[k - 1, d] = same.argmax(1)
            lacking = ~same.any(1)
            if not lacking.any():
                break
            still, owner, x = (k[lacking] - 1, d[lacking]), k[lacking], x[lacking]
            rounds += 1
            if rounds > 2:  # phases of a run that goes on: what one chunk lacks, others behind the same characters will
                owner, x = self._alike(owner, x, classes, lo, inner)
                new = ~(before[owner] == x[:, None]).any(1)
                owner, x = owner[new], x[new]
            pair = np.unique(owner * (1 << 32) + x)  # a state once for each chunk
            owner, x = pair >> 32, pair & 0xFFFFFFFF
            place = (before >= 0).sum(1)[owner] + np.arange(len(owner)) - np.searchsorted(owner, owner)
            more = int(place.max()) + 1 - before.shape[1]
            if more > 0:
                wide = ((0, 0), (0, more))
                before, behind = (np.pad(v, wide, constant_values=-1) for v in (before, behind))
                added, step = np.pad(added, wide), np.pad(step, wide)
            before[owner, place] = x
            behind[owner, place], added[owner, place] = self._run(x, lo[owner], hi[owner], classes)
            open_ = np.zeros(before.shape, bool)
            open_[owner, place] = open_[still] = True
        # The scan: composed[k] takes the columns of chunk since[k] to those behind chunk k, within a text.
        last = np.append(number[1:] == 0, True)
        composed = np.where(last[:, None], np.arange(before.shape[1])[None, :], step)
        total, since = added.copy(), np.arange(len(text))
        while (rest := np.flatnonzero(number[since] > 0)).size:
            j = since[rest] - 1
            left = composed[j]
            total_now = total[j] + np.take_along_axis(total[rest], left, 1)
            composed_now = np.take_along_axis(composed[rest], left, 1)
            since_now = since[j]
            total[rest], composed[rest], since[rest] = total_now, composed_now, since_now
        state, count = entry.astype(np.int64), np.zeros(len(ends), np.int64)
        final = np.flatnonzero(last)
        # A text's first chunk has its own entry in column 0.
        state[text[final]] = behind[final, composed[final, 0]]
        count[text[final]] = total[final, 0]
        return state, count

    def _alike(self, owner: np.ndarray, x: np.ndarray, classes: np.ndarray, lo: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (chunk, state) with all others that have one of these states and a chunk behind the same few characters."""
        behind = classes[np.maximum(lo[inner][:, None] - np.arange(1, ALIKE + 1)[None, :], 0)]
        kind = np.full(len(lo), -1, np.int64)
        kind[inner] = np.unique(behind, axis=0, return_inverse=True)[1].ravel()
        order = inner[np.argsort(kind[inner], kind="stable")]
        pairs = np.unique(kind[owner] * (1 << 32) + x)
        a, b = (np.searchsorted(kind[order], pairs >> 32, side) for side in ("left", "right"))
        return np.concatenate([order[i:j] for i, j in zip(a, b, strict=True)]), np.repeat(pairs & 0xFFFFFFFF, b - a)

    def count(self, classes: np.ndarray, ends: np.ndarray, chunk: int | None = None) -> np.ndarray:
        """Tokens of each text; classes holds all texts in a row, and ``ends`` where each ends."""
        state, added = self.go_on([None] * len(ends), classes, ends, chunk)
        lengths = np.diff(ends, prepend=0)
        return np.where(lengths > 0, added + 1, 0)  # a text begins with a space mark, which is a token so far

    def go_on(self, entry: list[tuple | None], classes: np.ndarray, ends: np.ndarray, chunk: int | None = None) -> tuple[list[tuple], np.ndarray]:
        """``advance`` with states by their keys, None for the start of a text; the keys outlive the table.

        Texts that would need more states than the table may hold go through it
        in parts, the table being compiled afresh for each: a character makes a
        few new states at most.
        """
        if len(self.keys) > self.max_states:
            self.clear()
        if len(self._fits) > MAX_PAIRS:
            self._fits.clear()
        seen = np.bincount(classes, minlength=self.n_classes)
        for cls in np.argsort(-seen, kind="stable")[: COLUMNS - self.columns].tolist():
            if seen[cls] and self.column_of[cls] < 0:
                self._column(cls)
        try:
            state, added = self.advance(np.array([self.start if k is None else self._state(k) for k in entry], np.int64), classes, ends, chunk)
            return [self.keys[s] for s in state.tolist()], added
        except TooManyStates:
            self.clear()
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        keys, added, most = list(entry), np.zeros(len(ends), np.int64), max(1, self.max_states // 8)
        for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            for lo in range(a, b, most):
                if len(self.keys) > self.max_states:
                    self.clear()
                here = classes[lo : min(b, lo + most)]
                state, n = self.advance(np.array([self.start if keys[i] is None else self._state(keys[i])], np.int64), here, np.array([len(here)]), chunk)
                keys[i], added[i] = self.keys[int(state[0])], added[i] + int(n[0])
        return keys, added
