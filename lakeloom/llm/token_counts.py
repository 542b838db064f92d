"""Token counts by a compiled finite-state tokenizer (operator 8).

Two deterministic machines are compiled from a byte-level BPE file:

* the splitter, over classes of characters. A text is cut into chunks of equal length; each chunk yields the map from
  every entry state to its exit state; the maps are composed by a parallel prefix scan, which gives every chunk its
  entry state, so that no chunk waits for another. The states then tell where pieces begin.
* the counting transducer, over bytes. Each transition carries the number of tokens it adds to (or takes from) the
  count emitted so far. It rests on the fact that the encoding of a prefix is the encoding of a shorter prefix plus
  one last token, unique among the tokens that end there and agree with the token before. Transitions are compiled
  when first met, states are prefixes of pieces; pieces longer than ``LONG`` run with a window of states instead.

Defined results: null and empty texts have zero tokens; whole texts of any length are counted; special strings inside
texts count one token, as the library has it by default; repeated rows are rows of their own with equal results; an empty
table gives no rows; extra columns of any name are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lakeloom.llm.bpe import END, NONE, Vocabulary, groups
from lakeloom.llm.common import texts

#: Classes of characters: letters that can end or go on with a contraction stand alone.
STOP, LETTER, NUMBER, OTHER, QUOTE, BLANK, SPACE, SINGLE, R, V, L, E = range(12)
#: States: nothing read, within letters, numbers, others, after a blank, after other white space, after a quote that
#: begins a piece, after such a quote and r, v or l, and after a whole contraction.
START, LETTERS, NUMBERS, OTHERS, AFTER_BLANK, AFTER_SPACE, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CLOSED = range(11)
STATES, CLASSES = 11, 12
CHUNK = 64
#: Characters for each pass; entries of usual size kept of pieces; states kept of the transducer; bytes of a piece run by window.
SLICE, CACHE, NODES, LONG = 1 << 20, 400_000, 400_000, 48


def class_table() -> np.ndarray:
    """The class of each code point. White space is Unicode's property, as the library's \\s."""
    import sys

    import regex

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for what, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            out[a : b + 1] = what  # a run may span the surrogates, which no text holds
    for chars, what in (("stmd", SINGLE), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE), (" ", BLANK)):
        for c in chars:
            out[ord(c)] = what
    return out


def transitions() -> np.ndarray:
    """Next state by state and class, as one flat table."""
    table = np.zeros((STATES, CLASSES), np.uint8)
    for state in range(STATES):
        table[state, STOP] = START
        for c in (LETTER, SINGLE, R, V, L, E):
            table[state, c] = LETTERS
        table[state, NUMBER], table[state, OTHER] = NUMBERS, OTHERS
        table[state, BLANK], table[state, SPACE] = AFTER_BLANK, AFTER_SPACE
        # a quote goes on with a run of others or belongs to the blank before; else it begins a piece
        table[state, QUOTE] = OTHERS if state in (OTHERS, QUOTED, AFTER_BLANK) else QUOTED
    table[QUOTED, SINGLE] = CLOSED
    table[QUOTED, R], table[QUOTED, V], table[QUOTED, L] = QUOTED_R, QUOTED_V, QUOTED_L
    table[QUOTED_R, E] = table[QUOTED_V, E] = table[QUOTED_L, L] = CLOSED
    return table.ravel()


class Splitter:
    """Where the pieces of concatenated texts begin."""

    def __init__(self):
        self.classes, self.step = class_table(), transitions()

    def states(self, classes: np.ndarray) -> np.ndarray:
        """The state after each character, chunk by chunk in parallel."""
        n = len(classes)
        chunks = -(-n // CHUNK)
        grid = np.zeros(chunks * CHUNK, np.uint8)
        grid[:n] = classes
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8)[:, None], (STATES, chunks)).copy()
        for column in grid:  # the map of each chunk: every entry state followed through it
            maps = self.step[maps * np.uint8(CLASSES) + column]
        hop = 1
        while hop < chunks:  # prefix scan: maps of twice as many chunks at each round
            later = maps.copy()
            for state in range(STATES):
                later[state, hop:] = maps[maps[state, :-hop], np.arange(hop, chunks)]
            maps, hop = later, hop * 2
        entry = np.zeros(chunks, np.uint8)
        entry[1:] = maps[START, :-1]
        out = np.empty((CHUNK, chunks), np.uint8)
        for i, column in enumerate(grid):
            entry = self.step[entry * np.uint8(CLASSES) + column]
            out[i] = entry
        return out.T.ravel()[:n]

    def starts(self, points: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each character; ``stops`` are the separators between texts."""
        classes = self.classes[points]
        classes[stops] = STOP
        state = self.states(classes)
        white = (classes == BLANK) | (classes == SPACE)
        before = np.concatenate([[START], state[:-1]])
        after = np.concatenate([state[1:], [START]])
        stop = classes == STOP
        ink_next = np.concatenate([~(white | stop)[1:], [False]])
        white_before = np.concatenate([[False], white[:-1]])
        letter = (classes == LETTER) | (classes >= SINGLE)
        joins = np.zeros(len(points), bool)
        joins[letter] = np.isin(before[letter], (LETTERS, AFTER_BLANK, QUOTED_R, QUOTED_V, QUOTED_L))
        joins |= letter & (before == QUOTED) & (state == CLOSED)
        joins |= letter & (before == QUOTED) & (state >= QUOTED_R) & (state <= QUOTED_L) & (after == CLOSED)
        joins |= (classes == NUMBER) & ((before == NUMBERS) | (before == AFTER_BLANK))
        joins |= ((classes == OTHER) | (classes == QUOTE)) & ((before == OTHERS) | (before == QUOTED) | (before == AFTER_BLANK))
        joins |= white & white_before & ~ink_next
        return ~joins


class CountingTransducer:
    """Counts the tokens of pieces, byte by byte."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        words, gone = vocabulary.bytes_of, {*vocabulary.added.values()}
        own = [i for i, b in enumerate(words) if b and i not in gone]
        alone = vocabulary.encode_pieces([words[i] for i in own])
        self.tokens = {words[i]: i for i, ids in zip(own, alone, strict=True) if len(ids) == 1}
        self.sizes = sorted({len(b) for b in self.tokens})
        self.rank = dict(zip(vocabulary.pairs.tolist(), vocabulary.pair_rank.tolist(), strict=True))
        halves = {}
        for pair, rank in self.rank.items():
            halves.setdefault(int(vocabulary.merged[rank]), (pair >> 20, pair & END, rank))
        self.right_edge, self.left_edge = self._edges(halves, 1), self._edges(halves, 0)
        self.agreeing: dict[tuple[int, int], bool] = {}
        self.clear()

    def _edges(self, halves: dict[int, tuple[int, int, int]], side: int) -> dict[int, list[tuple[int, int]]]:
        """Of each token: the symbols that stand at its edge while it is built, and the rank at which each is used up."""
        out = {}
        for token in self.tokens.values():
            edge, at = [(token, NONE)], token
            while at in halves:
                rank, at = halves[at][2], halves[at][side]
                edge.append((at, rank))
            out[token] = edge
        return out

    def clear(self) -> None:
        #: Of each state by byte: the next state and the tokens the transition emits; the last token of each state.
        self.arcs: list[dict[int, tuple[int, int]]] = [{}]
        self.last: list[int] = [-1]

    def agree(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: no merge joins a symbol at the end of a with one at the beginning of b
        before both are used up. Of equal ranks the left one goes first."""
        known = self.agreeing.get((a, b))
        if known is None:
            rank = self.rank
            known = not any(r < gone_x and r <= gone_y for x, gone_x in self.right_edge[a] for y, gone_y in self.left_edge[b] if (r := rank.get(x << 20 | y, NONE)) != NONE)
            if len(self.agreeing) > NODES:
                self.agreeing.clear()
            self.agreeing[a, b] = known
        return known

    def extend(self, piece: bytes, end: int, last: list[int], counts: list[int]) -> tuple[int, int]:
        """The last token and the count of the prefix that ends at ``end``, from those of shorter prefixes."""
        for size in self.sizes:
            at = end - size
            if at < 0:
                break
            token = self.tokens.get(piece[at:end])
            if token is not None and (at == 0 or self.agree(last[at], token)):
                return token, counts[at] + 1
        raise AssertionError("every prefix ends in a token")

    def count(self, piece: bytes) -> int:
        last, counts = [-1], [0]
        if len(piece) > LONG:
            for end in range(1, len(piece) + 1):
                token, n = self.extend(piece, end, last, counts)
                last.append(token)
                counts.append(n)
            return counts[-1]
        if len(self.arcs) > NODES:
            self.clear()
        state = total = 0
        for end, byte in enumerate(piece, 1):
            arc = self.arcs[state].get(byte)
            if arc is None:
                token, n = self.extend(piece, end, last, counts)
                arc = self.arcs[state][byte] = (len(self.arcs), n - total)
                self.arcs.append({})
                self.last.append(token)
            state, emitted = arc
            total += emitted
            last.append(self.last[state])
            counts.append(total)
        return total


class Counter:
    """Tokens of whole texts."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.splitter, self.transducer = Splitter(), CountingTransducer(self.vocabulary)
        self.known: dict[str, int] = {}
        self.kept = 0

    def count(self, some: list[str]) -> Iterator[int]:
        added = self.vocabulary.added
        for group in groups(some, SLICE):
            parts, of, totals = [], [], [0] * len(group)
            for k, text in enumerate(group):
                for part in self.vocabulary.split_added.split(text) if any(x in text for x in added) else [text]:
                    if part in added:
                        totals[k] += 1
                    elif part:
                        parts.append(part)
                        of.append(k)
            if parts:
                whole = "\0".join(parts)
                points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
                ends = np.cumsum([len(x) + 1 for x in parts])
                begins = np.flatnonzero(self.splitter.starts(points, ends[:-1] - 1))
                counts = self.pieces(whole, begins, np.concatenate([begins[1:], [len(whole)]]))
                # a separator begins a piece, and so does what follows it
                counts[np.searchsorted(begins, ends[:-1] - 1)] = 0
                first = np.searchsorted(begins, np.concatenate([[0], ends[:-1]]))
                for k, n in zip(of, np.add.reduceat(counts, first).tolist(), strict=True):
                    totals[k] += n
            yield from totals

    def pieces(self, whole: str, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = [whole[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        if self.kept > CACHE * 128:
            self.known.clear()
            self.kept = 0
        known, count = self.known, self.transducer.count
        for piece in set(found).difference(known):
            known[piece] = count(piece.encode("utf-8", "surrogatepass"))
            self.kept += 120 + len(piece)
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for each worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens exceeds ``limit``, one row for each row given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some = batch["text"].tolist()
            n = np.fromiter(counter(path).count(some), np.int64, len(some))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in some], "n_tokens": n, "over_limit": n > limit})

    return texts(docs).mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
