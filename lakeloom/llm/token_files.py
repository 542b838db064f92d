"""Token-id files with Elias-Fano document boundaries (operator 1).

A file is a Parquet dataset of blocks. A block holds the ids of consecutive documents, concatenated, in the narrowest
unsigned type that the vocabulary needs, and the boundaries of its documents as an Elias-Fano sequence: the low bits of
each offset packed, the high bits in unary, and a sample of every ``SAMPLE``-th set bit so that select needs to look at
a few bytes only. That is about 2 + log2(ids / documents) bits a document.

Texts are split at ASCII white space column-wise, and each new word is asked of the library once: as stem and marks
apart where the tokenizer parts them anyway, many of them in one call. Readers take each document's bounds by select.

Defined results: documents are in ascending doc_id order, null ids first, equal ids in the order of their texts' hashes
(repeated rows are documents of their own, side by side); null and empty texts have the end id alone; a text of any length
is one document; an empty table writes no blocks; extra columns of any name are left out.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakeloom.llm.bpe import groups
from lakeloom.llm.common import scratch, texts

SAMPLE = 512
#: Characters that are split at a time; ids of a block, at least (a document is never cut); bytes of a word cache, about,
#: and what an entry takes besides its word and ids.
SLICE, BLOCK_IDS, CACHE, ENTRY = 1 << 22, 1 << 20, 52 << 20, 200
#: doc_ids are delta-coded against first_doc by Parquet itself, as a list column.
BLOCK = "part int, block int, first_doc long, n_docs long, n_ids long, width int, ids binary, doc_ids array<long>, low_bits int, low binary, high binary, samples binary"


#: Letters and the ASCII marks after them (no quote, which may begin a contraction).
PARTS = r"^(?P<stem>\pL+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
#: Stems that are asked for in one text.
TOGETHER = 256


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space, with select."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.size, self.low_bits, self.low, self.high, self.samples = size, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = (values[:, None] >> np.arange(low_bits)) & 1
        at = (values >> low_bits) + np.arange(n)
        high = np.zeros((int(at[-1]) + 8) // 8 * 8 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        some = int.from_bytes(self.low[a // 8 : (a + self.low_bits + 7) // 8].tobytes(), "little")
        return some >> a % 8 & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, bytes are skipped by their number of set bits."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bits = at // 8, int(self.high[at // 8]) >> at % 8 << at % 8
        while bits.bit_count() <= left:
            left -= bits.bit_count()
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        one = byte * 8 + (bits & -bits).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def select_many(self, first: int, last: int) -> np.ndarray:
        """The values from the ``first`` to before the ``last``: bits are read from the nearest sample before the first
        up to the sample after the last."""
        lo, hi = first // SAMPLE, -(-last // SAMPLE)
        begin = int(self.samples[lo]) // 8
        end = int(self.samples[hi]) // 8 + 1 if hi < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + 8 * begin
        ones = ones[np.searchsorted(ones, int(self.samples[lo])) + first - lo * SAMPLE :][: last - first]
        at = np.arange(first, last)
        bit = (at * self.low_bits)[:, None] + np.arange(self.low_bits)
        low = (self.low[bit >> 3].astype(np.int64) >> (bit & 7) & 1) << np.arange(self.low_bits)
        return (ones - at) << self.low_bits | low.sum(1)

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.size]
        low = np.unpackbits(self.low, bitorder="little")[: self.size * self.low_bits].reshape(self.size, self.low_bits)
        return (ones - np.arange(len(ones))) << self.low_bits | (low.astype(np.int64) << np.arange(self.low_bits)).sum(1)


def listed(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space: no token crosses it, so the library is asked once for
    each new word between white space. For a tokenizer that keeps white space, whole texts go to the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tool = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tool.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.by_word = not self._ids(["a \n　b"])[0] != self._ids(["a b"])[0] and self._ids([" "])[0] == []
        self.known: dict[str, bytes] = {}
        self.known_size = self.parts_size = 0
        #: Ids of stems and of runs of marks, for a tokenizer that parts them and folds ASCII case.
        whole, stem, marks = self._ids(["Ab,.", "ab", ",."])
        self.by_part = self.by_word and whole == stem + marks
        self.parts: dict[str, bytes] = {"": b""}
        #: Letters that the normalizer or the splitter does not part from a mark after them; words with one go whole.
        self.bound = "[" + "".join(map(re.escape, self._bound_letters())) + "]" if self.by_part else ""
        #: Which ids end a word, where the vocabulary tells.
        suffix = json.loads(self.tool.to_str())["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tool.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for token, i in self.tool.get_vocab().items() if suffix and token.endswith(suffix)]] = True

    def _bound_letters(self) -> list[str]:
        letters, out = [c for c in map(chr, range(0x80, 0x110000)) if c.isalpha()], []
        for lo in range(0, len(letters), 4096):
            some = letters[lo : lo + 4096]
            words = " ".join(c + "," for c in some)
            text = self.tool.normalizer.normalize_str(words) if self.tool.normalizer else words
            begins = {at for _, (at, end) in self.tool.pre_tokenizer.pre_tokenize_str(text) if end == at + 1}
            ends = [i - 1 for i, c in enumerate(text + " ") if c == " "]
            out += [c for c, end in zip(some, ends, strict=True) if end not in begins]
        return out

    def _ids(self, some: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tool.encode_batch_fast(some, add_special_tokens=False)]

    def _each(self, some: list[str]) -> list[bytes]:
        return [np.asarray(ids, self.dtype).tobytes() for ids in self._ids(some)]

    def _learn_parts(self, new: list[str]) -> None:
        """Stems and runs of marks, a text of many at a time; one whose ends do not tell its parts is asked for singly."""
        chunks = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        for chunk, ids in zip(chunks, self._ids([" ".join(x) for x in chunks]), strict=True):
            ids = np.asarray(ids, self.dtype)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(chunk) and cut[-1] == len(ids):
                data, width = ids.tobytes(), self.dtype.itemsize
                cut = [0, *(cut * width).tolist()]
                self.parts.update(zip(chunk, (data[a:b] for a, b in zip(cut, cut[1:], strict=False)), strict=True))
            else:
                self.parts.update(zip(chunk, self._each(chunk), strict=True))

    def _learn(self, new: list[str]) -> None:
        if self.by_part:
            asked = pa.array(new, pa.string())
            found = pc.extract_regex(asked, PARTS)
            if len(self.bound) > 2:
                found = pc.if_else(pc.match_substring_regex(asked, self.bound), pa.scalar(None, found.type), found)
            whole = listed(asked.filter(pc.is_null(found)))
            stems = pc.ascii_lower(pc.struct_field(found, "stem")).drop_null().dictionary_encode()
            marks = pc.struct_field(found, "marks").drop_null().dictionary_encode()
            parted = listed(asked.filter(pc.is_valid(found)))
            stem_list, marks_list = listed(stems.dictionary), listed(marks.dictionary)
            if self.parts_size > 3 * CACHE // 2:  # what the library was asked for stays longer than the words made of it
                self.parts, self.parts_size = {"": b""}, 0
            was = len(self.parts)
            self._learn_parts([x for x in dict.fromkeys([*stem_list, *marks_list]) if x not in self.parts])
            self.parts_size += (len(self.parts) - was) * ENTRY + sum(map(len, stem_list))
            s, m = ([self.parts[x] for x in some] for some in (stem_list, marks_list))
            self.known.update(zip(parted, [s[i] + m[j] for i, j in zip(listed(stems.indices), listed(marks.indices), strict=True)], strict=True))
            new = whole
        for lo in range(0, len(new), 20_000):
            self.known.update(zip(new[lo : lo + 20_000], self._each(new[lo : lo + 20_000]), strict=True))

    def encode(self, some: list[str]) -> Iterator[bytes]:
        for group in groups(some, SLICE):
            if not self.by_word:
                yield from self._each(group)
                continue
            split = pc.ascii_split_whitespace(pa.array(group, pa.large_string()))
            words = split.flatten().dictionary_encode()
            distinct = listed(words.dictionary)
            if self.known_size > CACHE:  # what is in use stays
                self.known = {w: self.known[w] for w in distinct if w in self.known}
                self.known_size = sum(ENTRY + len(w) + len(x) for w, x in self.known.items())
            new = [w for w in distinct if w not in self.known]
            self._learn(new)
            ids = list(map(self.known.__getitem__, distinct))
            self.known_size += len(new) * ENTRY + sum(map(len, new)) * 2
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
            begin = np.cumsum(size) - size
            ids = np.frombuffer(b"".join(ids), self.dtype)
            code = words.indices.to_numpy()
            wide = size[code]
            ends = np.concatenate([[0], np.cumsum(wide)])
            stream = ids[np.repeat(begin[code] - ends[:-1], wide) + np.arange(ends[-1])]
            cut = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
            for a, b in zip(cut, cut[1:], strict=False):
                yield stream[a:b].tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _block(part: int, number: int, width: int, doc_ids: list, parts: list[bytes]) -> dict:
    ends = np.cumsum([0, *map(len, parts)]) // width
    marks = EliasFano.of(ends)
    return {
        "part": part, "block": number, "first_doc": doc_ids[0], "n_docs": len(parts), "n_ids": int(ends[-1]), "width": width, "ids": b"".join(parts), "doc_ids": doc_ids,
        "low_bits": marks.low_bits, "low": marks.low.tobytes(), "high": marks.high.tobytes(), "samples": marks.samples.tobytes(),
    }


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, block_ids: int = BLOCK_IDS) -> str:
    """Encode all documents and write them as blocks in ascending doc_id order; returns the dataset's path."""
    path = path or scratch(docs.sparkSession, "token-files")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, part, number = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], tool.dtype).tobytes()
        doc_ids: list = []
        parts: list[bytes] = []
        size = 0
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], tool.encode(batch["text"].tolist()), strict=True):
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                parts.append(ids + end)
                size += len(parts[-1]) // tool.dtype.itemsize
                if size >= block_ids:
                    yield pd.DataFrame([_block(part, number, tool.dtype.itemsize, doc_ids, parts)])
                    number, doc_ids, parts, size = number + 1, [], [], 0
        if parts:
            yield pd.DataFrame([_block(part, number, tool.dtype.itemsize, doc_ids, parts)])

    turn = F.xxhash64("text")  # so that an id that very many rows share, or none, is not one task
    ordered = texts(docs).repartitionByRange(F.asc_nulls_first("doc_id"), turn).sortWithinPartitions(F.asc_nulls_first("doc_id"), turn)
    ordered.mapInPandas(run, BLOCK).write.parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Blocks' starts are running sums in two levels: over the parts (one row for each task that wrote), then over the blocks
    of a part. Documents are read out by select, ``SAMPLE`` at a time."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    heads = blocks.select("part", "block", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = heads.join(parts, "part").select("part", "block", (F.col("part_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("block_start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                marks = EliasFano(row.n_docs + 1, row.low_bits, *(np.frombuffer(x, kind) for x, kind in ((row.low, np.uint8), (row.high, np.uint8), (row.samples, "<u4"))))
                ids = np.frombuffer(row.ids, f"<u{row.width}")
                for lo in range(0, row.n_docs, SAMPLE):
                    hi = min(lo + SAMPLE, row.n_docs)
                    at = marks.select_many(lo, hi + 1)
                    own = ids[at[0] : at[-1]].astype("<u4")
                    crc = [zlib.crc32(own[a:b]) for a, b in zip((at[:-1] - at[0]).tolist(), (at[1:] - at[0]).tolist(), strict=True)]
                    yield pd.DataFrame({"part": row.part, "block": row.block, "doc_id": pd.array(row.doc_ids[lo:hi], "Int64"), "local": at[:-1], "n_tokens": np.diff(at), "ids_crc32": crc})

    found = blocks.select("part", "block", "n_docs", "width", "ids", "doc_ids", "low_bits", "low", "high", "samples").mapInPandas(run, "part int, block int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
