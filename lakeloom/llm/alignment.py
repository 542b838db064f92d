"""Cross-tokenizer alignment of a byte-level BPE (A) and a sentencepiece model (B) (operator 13).

Both libraries tell where their tokens stand: character offsets of A, the spans of B's proto (in bytes; the installed
library has it as ``proto``, its ``immutable_proto`` is gone). These are the coarse cuts. Tokens that end inside a
character have no offset of their own, and byte-fallback tokens an empty span: their ends are found by running on from
the last coarse cut by the bytes that their ids decode to. Byte offsets where tokens of both end cut them into groups.

Neither side has tokens that cross a single space between two non-spaces, so texts are cut there; nor a place between a
Latin letter and a mark, if no piece of B holds both, so chunks are cut there once more. Each distinct part is asked of the
libraries once, many in one text. Documents are dealt into blocks. A block is written with its distinct
pairs, each with the number of the block's documents that hold it linked, and with its documents as chunks. Pair counts
are summed over blocks, the highest of each A id is taken (one row an A id: bounded by the vocabulary), and both go back
to the blocks that hold the pair, where documents are summed up.

Defined results: texts null, empty, or whose tokens' bytes differ from space + text (those with U+2581, for one) have
zeros and '' and count nowhere; special strings are plain text; repeated rows are documents of their own and count as
such; texts of any length are handled whole; an empty table gives no rows; extra columns of any name are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeloom.llm.bpe import byte_symbols
from lakeloom.llm.common import map_texts, written

#: Characters of a block of documents; chunks asked for in one text; bytes of what a worker keeps of chunks.
BLOCK, TOGETHER, KEPT = 1 << 22, 1024, 40 << 20
#: Rows are megabytes, of which a Parquet writer would hold a hundred before it looks at their size, and a reader a row group.
WRITER = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}
#: A space that no token of either side crosses.
SAFE = re.compile(r"(?<=\S) (?=\S)")
SPACE = "▁"
#: A Latin letter and a mark that A's splitter parts from it.
LETTER_MARK = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ][,.;:!?]")
ROW = "block long, doc_ids array<long>, no_ids array<boolean>, sums binary, digests binary, doc_ends binary, width int, codes binary, chunk_ends binary, links binary, pairs array<long>, held array<int>"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def refined(coarse: np.ndarray, sure: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse one where it is sure, else that of the last sure token and the bytes since."""
    run = np.cumsum(size)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(size)), -1))
    return run + np.where(last >= 0, (coarse - run)[last], 0)


class Aligner:
    """Both tokenizers, the bytes of their ids, and the chunks aligned so far."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = {c: i for i, c in enumerate(byte_symbols())}
        with open(a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(max(vocab.values()), *self.a.get_vocab(with_added_tokens=True).values()))
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token if c in byte_of)
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace(SPACE, " ").encode() for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        #: Decimal ids behind the sign before them: a group's first A id, other ids, a group's first B id.
        n = max(len(self.a_bytes), len(self.b_bytes))
        self.opens, self.joins, self.turns = (np.array([sign + str(i).encode() for i in range(n)], object) for sign in (b";", b",", b"|"))
        #: Parts that have a space before them; parts that follow a letter.
        self.known: dict[str, tuple | None] = {}
        self.tails: dict[str, tuple | None] = {}
        self.kept = 0
        self.cuts = not any(LETTER_MARK.search(piece(i)) for i in range(self.b.get_piece_size()))

    def ends(self, some: list[str]) -> Iterator[tuple | None]:
        """Of each text, ids and byte ends of both sides in space + text; None where their bytes are not those."""
        encoded = self.a.encode_batch([" " + x for x in some], add_special_tokens=False)
        for text, e in zip(some, encoded, strict=True):
            data = (" " + text).encode()
            a = np.array(e.ids, np.int64)
            pieces = self.b.encode(text, return_type="proto").pieces
            b = np.array([p.id for p in pieces], np.int64)
            if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != data or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != data:
                yield None
                continue
            offset = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(a)).reshape(-1, 2)
            starts = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))
            a_ends = refined(starts[offset[:, 1]], np.append(offset[1:, 0] >= offset[:-1, 1], True), self.a_size[a])
            end = np.array([p.end for p in pieces], np.int64)  # spans follow each other: where the end stays, one is empty
            yield a, a_ends, b, refined(end + 1, np.diff(end, prepend=0) > 0, self.b_size[b])  # the first space is B's own

    def parts(self, sizes: list[int], a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Iterator[tuple]:
        """Of each stretch of so many bytes of one text: tokens of A, of B, groups, linked pairs (A id << 16 | B id), groups as text."""
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        n_a, n_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        wide = n_b[a_group]
        upto = np.cumsum(wide)
        at = np.arange(int(upto[-1])) - np.repeat(upto - wide - b_first[a_group], wide)
        pairs = (np.repeat(a, wide) << 16 | b[at]).astype("<u4")
        said = np.empty(len(a) + len(b), object)
        i, j = np.arange(len(a)), np.arange(len(b))
        said[i + b_first[a_group]] = np.where(i == a_first[a_group], self.opens[a], self.joins[a])
        said[j + (a_first + n_a)[b_group]] = np.where(j == b_first[b_group], self.turns[b], self.joins[b])
        ends = np.cumsum(sizes)
        group = np.searchsorted(cuts, ends) + 1
        a_at, b_at, link = np.cumsum(n_a)[group - 1], np.cumsum(n_b)[group - 1], np.cumsum(n_a * n_b)[group - 1]
        before = (0, 0, 0, 0)
        for now in zip(a_at.tolist(), b_at.tolist(), group.tolist(), link.tolist(), strict=True):
            text = b"".join(said[before[0] + before[1] : now[0] + now[1]].tolist())[1:]
            yield now[0] - before[0], now[1] - before[1], now[2] - before[2], pairs[before[3] : now[3]].tobytes(), text
            before = now

    def learn(self, heads: list[str], tails: list[str]) -> None:
        if self.kept > KEPT:  # what is in use stays
            self.known, self.tails = ({x: had[x] for x in some if x in had} for had, some in ((self.known, heads), (self.tails, tails)))
            self.kept = sum(self.weight(x, y) for had in (self.known, self.tails) for x, y in had.items())
        new = [x for x in heads if x not in self.known]
        plain = [x for x in new if x and not x[0].isspace() and not x[-1].isspace() and SPACE not in x]
        alone = {*new}.difference(plain)
        size = lambda x: len(x.encode())
        self._ask(self.known, plain, lambda lot: " ".join(lot), lambda lot: [1 + size(x) for x in lot], slice(None))
        for x in alone:
            found = next(self.ends([x]))
            self._keep(self.known, [x], [None] if found is None else self.parts([1 + size(x)], *found))
        # a line break before each: no token of either side holds it and a mark
        after = [x for x in tails if x not in self.tails]
        self._ask(self.tails, after, lambda lot: "\n" + "\n".join(lot), lambda lot: [n for x in lot for n in (1, size(x))], slice(1, None, 2))

    def _keep(self, had: dict, some: list[str], entries) -> None:
        had.update(zip(some, entries, strict=True))
        self.kept += sum(self.weight(x, had[x]) for x in some)

    def _ask(self, had: dict, some: list[str], joined, sizes, own: slice) -> None:
        """Learn many parts in one text; where that text is not reproduced, each by itself."""
        lots = [some[i : i + TOGETHER] for i in range(0, len(some), TOGETHER)]
        for i in range(0, len(lots), 16):
            for lot, found in zip(lots[i : i + 16], self.ends([joined(x) for x in lots[i : i + 16]]), strict=True):
                if found is not None:
                    each = sizes(lot)
                    each[0] += own.start or 0  # the first line break has the space before it
                    self._keep(had, lot, list(self.parts(each, *found))[own])
                elif len(lot) > 1:
                    for x in lot:
                        self._ask(had, [x], joined, sizes, own)
                else:
                    self._keep(had, lot, [None])

    @staticmethod
    def weight(chunk: str, entry: tuple | None) -> int:
        return 300 + 2 * len(chunk) + (len(entry[3]) + len(entry[4]) if entry else 0)

    def split(self, some: list[str]) -> tuple[list[str], list[str], list[np.ndarray]]:
        """The distinct heads and tails of chunks, and each text as numbers of heads and, after these, of tails."""
        cut = pc.split_pattern(pa.array(some, pa.large_string()), " ")
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        odd = np.fromiter((not x or x[0].isspace() or x[-1].isspace() for x in distinct), bool, len(distinct))
        code, at = words.indices.to_numpy(), cut.offsets.to_numpy().tolist()
        out, number = [], {}
        for text, lo, hi in zip(some, at, at[1:], strict=False):
            own = code[lo:hi]
            if odd[own].any():
                number = number or {x: i for i, x in enumerate(distinct)}
                own = np.array([number.setdefault(x, len(number)) for x in SAFE.split(text)], np.int64)
            out.append(own)
        distinct = list(number) if number else distinct
        used = np.unique(np.concatenate([*out, np.zeros(0, np.int64)]))
        heads: dict[str, int] = {}
        tails: dict[str, int] = {}
        part = np.full((len(distinct), 2), -1)
        for i in used.tolist():
            x = distinct[i]
            found = LETTER_MARK.search(x) if self.cuts and not x[-1:].isspace() and SPACE not in x else None
            if found is not None:
                part[i, 1] = tails.setdefault(x[found.start() + 1 :], len(tails))
                x = x[: found.start() + 1]
            part[i, 0] = heads.setdefault(x, len(heads))
        part[:, 1] += np.where(part[:, 1] >= 0, len(heads), 0)
        both = (part[own].ravel() for own in out)
        return list(heads), list(tails), [x[x >= 0] for x in both]

    def block(self, number: int, doc_ids: list, no_ids: list, some: list[str]) -> dict:
        """A block of documents: see ROW."""
        heads, tails, codes = self.split(some)
        self.learn(heads, tails)
        entries = [*map(self.known.__getitem__, heads), *map(self.tails.__getitem__, tails)]
        good = np.fromiter((x is not None for x in entries), bool, len(entries))
        entries = [x or (0, 0, 0, b"", b"") for x in entries]
        links = np.frombuffer(b"".join(x[3] for x in entries), "<u4")
        n_links = np.fromiter((len(x[3]) // 4 for x in entries), np.int64, len(entries))
        first = np.cumsum(n_links) - n_links
        each = np.array([x[:3] for x in entries], np.int64).reshape(-1, 3)
        each = np.column_stack([each, n_links])
        said = [x[4] for x in entries]
        pairs, links = np.unique(links, return_inverse=True)
        held = np.zeros(len(pairs), np.int64)
        sums, digests, kept = np.zeros((len(some), 4), np.int64), [], []
        for i, (text, code) in enumerate(zip(some, codes, strict=True)):
            if not text or not good[code].all():
                digests.append(b"")
                kept.append(code[:0])
                continue
            digests.append(hashlib.sha256(b";".join(map(said.__getitem__, code.tolist()))).digest())
            kept.append(code)
            sums[i] = each[code].sum(0)
            mine = np.unique(code)
            wide = n_links[mine]
            upto = np.cumsum(wide)
            held[np.unique(links[np.arange(int(upto[-1])) + np.repeat(first[mine] - upto + wide, wide)])] += 1
        width = 2 if len(entries) <= 1 << 16 else 4
        return {
            "block": number, "doc_ids": doc_ids, "no_ids": no_ids, "sums": sums.tobytes(), "digests": b"".join(x.ljust(32, b"\0") for x in digests), "doc_ends": np.cumsum([len(x) for x in kept]).astype("<i8").tobytes(),
            "width": width, "codes": np.concatenate([*kept, np.zeros(0, np.int64)]).astype(f"<u{width}").tobytes(), "chunk_ends": np.cumsum(n_links).astype("<i8").tobytes(),
            "links": links.astype("<u4").tobytes(), "pairs": pairs.astype(np.int64), "held": held.astype(np.int32),
        }


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One for each worker process and pair of files."""
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


def aligned_blocks(docs: DataFrame, a: str, b: str, block: int = BLOCK) -> DataFrame:
    """Written blocks of aligned documents."""

    def run(slices: Iterator[tuple[list, list, list]]) -> Iterator[pd.DataFrame]:
        tool, number = aligner(a, b), TaskContext.get().partitionId() << 32
        ids, no_ids, some, size = [], [], [], 0
        for part in slices:
            for doc_id, no_id, text in zip(*part, strict=True):
                ids.append(doc_id)
                no_ids.append(no_id)
                some.append(text)
                size += len(text)
                if size >= block or len(some) >= 1 << 16:
                    yield pd.DataFrame([tool.block(number, ids, no_ids, some)])
                    number, ids, no_ids, some, size = number + 1, [], [], [], 0
        if some:
            yield pd.DataFrame([tool.block(number, ids, no_ids, some)])

    return written(map_texts(docs, run, ROW), "aligned", **WRITER)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Each linked pair (A id << 16 | B id), the documents that hold it, and whether that is its A id's highest."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n")).filter("n > 0")
    counts = written(each, "pair-counts")
    highest = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("highest"))
    # a row for each id of A's vocabulary at most
    return counts.join(F.broadcast(highest), F.shiftright("pair", 16) == F.col("a")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def align(docs: DataFrame, a: str, b: str, block: int = BLOCK) -> DataFrame:
    """Each document's alignment, summed up: see OUT."""
    blocks = aligned_blocks(docs, a, b, block)
    each = blocks.select("block", F.posexplode("pairs").alias("at", "pair")).join(pair_counts(blocks), "pair", "left")
    back = each.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.lit(False)).alias("best")))).alias("x"))
    back = back.select("block", F.col("x.n").alias("n"), F.col("x.best").alias("best"))  # of the pairs of a block, which is bounded

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        row = next(rows.itertuples(index=False))
        count, best = (np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in (row.n, row.best))
        links, codes = np.frombuffer(row.links, "<u4"), np.frombuffer(row.codes, f"<u{row.width}")
        chunk_ends, doc_ends = np.frombuffer(row.chunk_ends, "<i8"), np.frombuffer(row.doc_ends, "<i8")
        of_docs = []
        for value in (best, count):
            run_links = np.concatenate([[0], np.cumsum(value[links])])
            of_chunk = np.diff(run_links[np.concatenate([[0], chunk_ends])])
            run_codes = np.concatenate([[0], np.cumsum(of_chunk[codes])])
            of_docs.append(np.diff(run_codes[np.concatenate([[0], doc_ends])]))
        sums = np.frombuffer(row.sums, np.int64).reshape(-1, 4)
        digests = [row.digests[i : i + 32].hex() if n else "" for i, n in zip(range(0, len(row.digests), 32), sums[:, 0].tolist(), strict=True)]
        ids = pd.arrays.IntegerArray(np.array(row.doc_ids, np.int64), np.array(row.no_ids, bool))
        return pd.DataFrame({"doc_id": ids, "n_a": sums[:, 0], "n_b": sums[:, 1], "n_groups": sums[:, 2], "n_links": sums[:, 3], "n_best": of_docs[0], "count_sum": of_docs[1], "groups_sha256": digests})

    # a block is a group of its own, so that it alone is handed to Python, and not all those of a partition in one batch
    return blocks.drop("pairs", "held").join(back, "block", "left").groupBy("block").applyInPandas(run, OUT)
