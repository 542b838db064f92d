"""Lexical retrieval packing against a plain BM25, and the ids of letters that the normalizer takes apart."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from lakeloom.llm import packing, token_files

WORD = public_tokenizers.path("word_bpe_49k.json")


def checked(docs, out, window):
    """Every id lies in one piece, sequences are gapless and full or a power of two, digests are right."""
    tool = Tokenizer.from_file(WORD)
    want = Counter()
    for doc_id, text in docs:
        want[doc_id, tuple([*tool.encode(text or "", add_special_tokens=False).ids, 2])] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at == window or at & (at - 1) == 0
    for (doc_id, n), rows in by_doc.items():
        docs_of = [list(ids) for (d, ids), k in want.items() if d == doc_id and len(ids) == n for _ in range(k)]
        assert sum(r.length for r in rows) == n * len(docs_of)
        if len(docs_of) == 1:
            at = 0
            for r in sorted(rows, key=lambda r: r.start):
                assert r.start == at
                at += r.length
                assert r.ids_crc32 == zlib.crc32(np.array(docs_of[0][r.start : at], "<u4").tobytes())
    assert {(d, len(ids)) for d, ids in want} == set(by_doc)


@pytest.mark.parametrize("window, shard", [(4096, 1 << 22), (16, 200)])
def test_packing_keeps_every_id_once(spark, docs, window, shard):
    rng = random.Random(2)
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    own += [(100 + i, " ".join(rng.choice("alpha beta gamma delta omega".split()) for _ in range(rng.randrange(90)))) for i in range(200)]
    own += [(None, "another without id"), (1 << 60, "x" * 20000), ((1 << 60) + 1, "word " * 9000), (7, "İ, Aİ. ẞ!")]
    table = spark.createDataFrame(own, "doc_id long, text string").selectExpr("*", "1 as start", "2 as ids")
    out = packing.pack(table, WORD, 2, window, shard).collect()
    checked(own, out, window)
    again = packing.pack(table, WORD, 2, window, shard, ids=False)
    assert sorted(map(str, again.collect())) == sorted(str(Row(**{c: r[c] for c in again.columns})) for r in out)
    assert all(zlib.crc32(np.frombuffer(r.ids, f"<u{r.width}").astype("<u4")) == r.ids_crc32 and len(r.ids) == r.length * r.width for r in out)


def test_packing_of_an_empty_table(no_docs):
    assert packing.pack(no_docs, WORD, 2).count() == 0


def plain_windows(fragments, idf, mean, window, terms):
    """The windows of one shard: each unused fragment scored by dictionaries, term by term."""
    counts = [Counter(x.tolist()) for x in fragments]

    def weight(i, t):
        return idf[t] * (counts[i][t] * (packing.K1 + 1) / (counts[i][t] + packing.K1 * (1 - packing.B + packing.B * len(fragments[i]) / mean)))

    unused, out, rest = list(range(len(fragments))), [], None
    while unused or rest:
        seed, begin = rest or (unused.pop(0), 0)
        rest, own = None, [(seed, begin, len(fragments[seed]))]
        room = window - (len(fragments[seed]) - begin)
        asked, ask = sorted(counts[seed], key=lambda t: (-weight(seed, t), t)), terms
        while room and ask < len(asked) and sum(len(fragments[i]) for i in unused if set(asked[:ask]) & set(counts[i])) < room:
            ask = 2 * ask + terms
        score = {i: sum(weight(i, t) for t in asked[:ask] if t in counts[i]) for i in unused}
        order = [*sorted((i for i in unused if score[i] > 0), key=lambda i: (-round(score[i], 9), i)), *(i for i in unused if score[i] == 0)]
        while room and order:
            i = order.pop(0)
            unused.remove(i)
            size = min(room, len(fragments[i]))
            own.append((i, 0, size))
            room -= size
            rest = (i, size) if size < len(fragments[i]) else None
        out.append(own)
    return out


@pytest.mark.parametrize("terms", [1, 3, 32])
def test_windows_equal_plain_bm25(monkeypatch, terms):
    monkeypatch.setattr(packing, "TERMS", terms)
    rng = np.random.default_rng(terms)
    topics = [rng.choice(300, 25, replace=False) for _ in range(6)]
    some = [rng.choice(topics[rng.integers(6)], rng.integers(1, 60)).astype("<u2") for _ in range(150)]
    df = np.bincount(np.concatenate([np.unique(x) for x in some]), minlength=300)
    idf, mean = np.log1p((150 - df + 0.5) / (df + 0.5)), float(np.mean([len(x) for x in some]))
    got = [[x[:3] for x in w] for w in packing.Shard(some, idf, mean, 128).windows()]
    assert got == plain_windows(some, idf, mean, 128, terms)
    assert all(sum(hi - lo for _, lo, hi in w) == 128 for w in got[:-1])
    topic = [next(j for j, t in enumerate(topics) if set(x.tolist()) <= set(t.tolist())) for x in some]
    same = [topic[i] == topic[w[0][0]] for w in got[: len(got) // 2] for i, *_ in w[1:]]
    assert sum(same) > 0.8 * len(same) > 0  # neighbours are of the seed's kind, dealt at random it is a sixth


def test_frequencies_cover_all_fragments(spark):
    table = spark.createDataFrame([(i, "red blue" if i % 2 else "red " * 30) for i in range(50)], "doc_id long, text string")
    found = {r.term: r.df for r in packing.document_frequencies(packing.fragments(table, WORD, 2)).collect()}
    red, blue = (Tokenizer.from_file(WORD).encode(x, add_special_tokens=False).ids[0] for x in ("red", "blue"))
    assert found == {red: 50, blue: 25, 2: 50}


def test_power_of_two_ends():
    parts = [(0, 5, 40, None), (1, 0, 9, 1.0)]
    out = list(packing.sequences(parts, 4096))
    assert [sum(hi - lo for _, lo, hi, _ in x) for x in out] == [32, 8, 4]
    assert [p for x in out for p in x] == [(0, 5, 37, None), (0, 37, 40, None), (1, 0, 5, 1.0), (1, 5, 9, 1.0)]
    assert math.isclose(sum(hi - lo for x in out for _, lo, hi, _ in x), 44)


def test_letters_that_fall_apart_equal_library():
    """U+0130 becomes i and a combining dot, which joins the mark after it; so do letters that decompose."""
    mine = token_files.WordEncoder(WORD)
    letters = [c for c in map(chr, range(0x80, 0x30000)) if c.isalpha() and len(mine.tool.normalizer.normalize_str(c)) > 1]
    rng = random.Random(4)
    some = ["İ,", "SABİ. Aİ!", *(f"a{c}, {c}. {c}'s {c}" for c in letters), *("".join(rng.choice(["İ", "ß", "ŉ", "a", ",", ".", " ", "'", rng.choice(letters)]) for _ in range(25)) for _ in range(2000))]
    for text, ids in zip(some, mine.encode(some), strict=True):
        assert np.frombuffer(ids, mine.dtype).tolist() == mine.tool.encode(text, add_special_tokens=False).ids, text


def test_full_caches_lose_nothing(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 3)
    mine = token_files.WordEncoder(WORD)
    some = ["alpha, beta. gamma", "beta, alpha! delta?", "one two three four five six", "alpha. two, delta"]
    for text, ids in zip(some * 2, [y for x in some * 2 for y in mine.encode([x])], strict=True):
        assert np.frombuffer(ids, mine.dtype).tolist() == mine.tool.encode(text, add_special_tokens=False).ids
