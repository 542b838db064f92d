"""Ranked search by presence masks and cross-tokenizer alignment against brute force."""

import functools
import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lakeloom.llm import alignment, mask_search
from lakeloom.llm.bpe import byte_symbols

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def ranked(docs, items, k=10):
    """Every document scored for every item."""
    counts = [(d, Counter(mask_search.terms_of(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in counts:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in dict.fromkeys(mask_search.terms_of(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(sorted(found)[:k], 1)]
    return out


def some_texts(seed, n, words):
    rng = random.Random(seed)
    pool = [*"abcdefgh", "Éa", "日本", "x_y", "Ab", "aB"]
    return [" ".join(rng.choice(pool[: rng.randrange(2, len(pool))]) for _ in range(rng.randrange(0, words))) for _ in range(n)]


@pytest.mark.parametrize("item_block, docs_block", [(4096, 1 << 14), (2, 7)])
def test_search_equals_brute_force(spark, docs, monkeypatch, item_block, docs_block):
    monkeypatch.setattr(mask_search, "DOCS", docs_block)
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    own += [(100 + i, x) for i, x in enumerate(some_texts(3, 300, 30))] + [(1 << 60, "日本 word é"), ((1 << 60) + 1, "日本 word é")]
    items = [(1, "A b word 日本"), (2, None), (3, "nowhere"), (4, "the quick BROWN fox"), (5, " ".join(f"w{i}" for i in range(200)) + " a b c d éa"), (None, "test a"), (7, "a a a")]
    table = spark.createDataFrame(own, "doc_id long, text string").selectExpr("*", "1 as score", "2 as terms")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as doc_id")
    got = [tuple(r) for r in mask_search.search(table, asked, item_block=item_block).collect()]
    assert sorted(got, key=str) == sorted(ranked(own, items), key=str)


def test_search_of_empty_tables(spark, no_docs, docs):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert mask_search.search(no_docs, items).count() == 0
    assert mask_search.search(docs, items.filter("false")).count() == 0


def test_masks_and_bounds_leave_documents_unscored():
    """With masks that differ in worth, most documents are never scored, and none of the best is missed."""
    rng = np.random.default_rng(1)
    n, ids = 5000, np.arange(5000)
    places = [np.flatnonzero(rng.random(n) < p) for p in (0.9, 0.8, 0.5, 0.02, 0.01)]
    impacts = [rng.integers(w // 2, w, len(x)) for w, x in zip((10, 20, 50, 900, 1000), places, strict=True)]
    best = mask_search.Best(10)
    scored = mask_search.search_block(ids, places, impacts, best)
    total = np.zeros(n, np.int64)
    for x, y in zip(places, impacts, strict=True):
        total[x] += y
    want = np.lexsort((ids, -total))[:10]
    assert best.doc.tolist() == want.tolist() and best.score.tolist() == total[want].tolist()
    assert scored < n // 10


def test_masks_of_many_terms():
    places = [np.array([i % 5, 5]) for i in range(130)]
    mask = mask_search.masks(6, places)
    assert mask.shape == (6, 3) and mask_search.has(mask, 130)[5].all() and mask_search.has(mask, 130)[0].sum() == 26


def test_norms_beyond_64_bits():
    length = np.array([0, 7, 1 << 31])
    assert mask_search.norms(length, 10**10, 10**12).tolist() == [10 + 90 * int(n) * 10**10 // 10**12 for n in length]


@functools.cache
def libraries():
    tool = Tokenizer.from_file(BYTE)
    tool.encode_special_tokens = True
    return tool, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def plain_groups(text):
    """Tokens of both sides by whole texts, groups by running sums of decoded bytes."""
    tool, model = libraries()
    byte_of = {c: i for i, c in enumerate(byte_symbols())}
    a, b = tool.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    a_bytes = [bytes(byte_of[c] for c in tool.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
    if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return None
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
    both, out, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for cut in both:
        mine, other = [], []
        while i < len(a) and ends[0][i] <= cut:
            mine.append(a[i])
            i += 1
        while j < len(b) and ends[1][j] <= cut:
            other.append(b[j])
            j += 1
        out.append((mine, other))
    return out


def aligned(docs):
    found = [(d, plain_groups(t or "")) for d, t in docs]
    links = [[(a, b) for mine, other in g for a in mine for b in other] if g else [] for _, g in found]
    counts = Counter(pair for own in links for pair in set(own))
    highest = {}
    for (a, _), n in counts.items():
        highest[a] = max(highest.get(a, 0), n)
    for (d, g), own in zip(found, links, strict=True):
        said = ";".join(",".join(map(str, mine)) + "|" + ",".join(map(str, other)) for mine, other in g or ())
        yield (
            d, sum(len(x) for x, _ in g or ()), sum(len(y) for _, y in g or ()), len(g or ()), len(own), sum(counts[p] == highest[p[0]] for p in own), sum(counts[p] for p in own),
            hashlib.sha256(said.encode()).hexdigest() if g else "",
        )


def hard_texts():
    rng = random.Random(7)
    pool = [*"abcAB19.,'!-<|>", " ", " ", "  ", "\n", "\t", " \n ", "\x1c", "\x85", "\xa0", "　", "é", "İ", "漢", "한", "😀", "🏳‍🌈", "é", "​", "\x00", "ß", "ﬁ", "the ", " the", "ing "]
    own = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    own += ["".join(rng.choice([*"abé,.;:!?\n'", "Ab", " ", "ing"]) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    return [*own, "a,b.c;d", "é.\nWas it?!", "x,▁y", "e,\n\n", "\n,a, b",  "▁x", "a ▁ b", "word ▁word word", " lead", "trail ", "  ", " ", "<s></s><unk>", "<0x41> <0x0A>", "<|endoftext|> in <|endoftext|>", "漢字 " * 50, "x" * 3000]


def test_alignment_equals_brute_force(spark, docs, monkeypatch):
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    own += [(100 + i, x) for i, x in enumerate(hard_texts())] + [((1 << 60) + 1, "twice"), ((1 << 60) + 1, "twice")]
    table = spark.createDataFrame(own, "doc_id long, text string").selectExpr("*", "1 as pair", "2 as block")
    want = sorted(aligned(own), key=str)
    for block in (1 << 23, 500):
        assert sorted((tuple(r) for r in alignment.align(table, BYTE, PIECE, block).collect()), key=str) == want
    monkeypatch.setattr(alignment, "KEPT", 1)
    tool = alignment.Aligner(BYTE, PIECE)
    for _ in range(3):
        tool.learn(["one", "two", "été"], [",", ".\nNext"])
    assert set(tool.known) == {"one", "two", "été"} and set(tool.tails) == {",", ".\nNext"}
    assert tool.cuts


def test_alignment_of_an_empty_table(no_docs):
    assert alignment.align(no_docs, BYTE, PIECE).count() == 0


def test_cuts_inside_characters():
    """A character that neither side has as one token: offsets and spans leave its bytes open, the ids' bytes close them."""
    tool = alignment.Aligner(BYTE, PIECE)
    a, a_ends, b, b_ends = next(tool.ends(["漢"]))
    assert a_ends.tolist() == np.cumsum(tool.a_size[a]).tolist() and b_ends.tolist() == np.cumsum(tool.b_size[b]).tolist()
    assert len(a) > 1 and len(b) > 1


def test_blocks_are_written_and_handed_on_a_few_at_a_time(spark, monkeypatch):
    """Blocks are megabytes: row groups are closed by size and not after a hundred rows, and Python is given one block at a time."""
    docs = spark.createDataFrame([(i, " ".join(str(i * j) for j in range(200))) for i in range(60)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(alignment, "WRITER", alignment.WRITER | {"parquet.block.size": str(1 << 16)})
    blocks = alignment.aligned_blocks(docs, BYTE, PIECE, 1000)
    files = [pq.ParquetFile(f.removeprefix("file:").replace("//", "/")) for f in blocks.inputFiles()]
    assert sum(f.metadata.num_rows for f in files) > 25 and sum(f.metadata.num_row_groups for f in files) > 5
    out = alignment.align(docs, BYTE, PIECE, 1000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "MapInPandas" not in plan.replace("FlatMapGroupsInPandas", "")
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in alignment.align(docs, BYTE, PIECE).collect())
