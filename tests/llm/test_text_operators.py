"""BPE, token counts, token files and TIFF payloads against the libraries and round trips."""

import hashlib
import random
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeloom.llm import bpe, tiff, token_counts, token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    random.seed(5)
    return ["".join(random.choice("'srevlmtdxAB19! \n\t　é<|>") for _ in range(random.randint(0, 80))) for _ in range(400)]


def unicode_texts():
    """Texts of letters, marks, spaces and controls of all kinds, in long and short runs."""
    rng = random.Random(11)
    pool = [*map(chr, range(0x20)), *"ÀÉÑßİıſΣςаБжʼ़ͅाักกำ한ᄀ각日本〆々ﬁﷺ²½Ⅳⅷ٣५𝐀🙂🏳‍🌈\u0301\u0327\u1ab0\u200b\u2028\xa0\u3000\x85", *"abcXYZ   ..,'!-_<|>"]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]


def test_bpe_equals_library():
    tool, mine = Tokenizer.from_file(BYTE), bpe.Encoder(BYTE)
    some = [*odd_texts(), "x<|endoftext|> y", "a" * 3000]
    for text, ids in zip(some, mine.encode(some), strict=True):
        want = tool.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert mine.vocabulary.decode(want) == tool.decode(want, skip_special_tokens=False)


def test_count_transducer_equals_library():
    tool, mine = Tokenizer.from_file(BYTE), token_counts.Counter(BYTE)
    some = [*odd_texts(), "x<|endoftext|> y", "a" * 3000]
    assert list(mine.count(some)) == [len(tool.encode(x, add_special_tokens=False).ids) for x in some]


def test_splitter_does_not_depend_on_chunks(monkeypatch):
    some = odd_texts()[:50]
    whole = list(token_counts.Counter(BYTE).count(some))
    monkeypatch.setattr(token_counts, "CHUNK", 3)
    assert list(token_counts.Counter(BYTE).count(some)) == whole


def test_word_encoder_equals_library():
    mine = token_files.WordEncoder(WORD)
    some = [*odd_texts(), *unicode_texts(), "Ab,. I'll <|endoftext|>x<|startoftext|> Σ ΑΣ ²x x² é,"]
    for text, ids in zip(some, mine.encode(some), strict=True):
        assert np.frombuffer(ids, mine.dtype).tolist() == mine.tool.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 3000])
def test_elias_fano(n):
    values = np.cumsum(np.random.default_rng(n).integers(0, 7 + n % 90, n))
    marks = token_files.EliasFano.of(values)
    assert (marks.values() == values).all()
    assert all(marks.select(i) == values[i] for i in range(n))
    for lo, hi in ((0, n), (1, min(n, 2)), (n // 2, n), (n // 3, n // 3 + 1), (max(0, n - 513), max(0, n - 1))):
        if lo < hi <= n:
            assert (marks.select_many(lo, hi) == values[lo:hi]).all()


def test_bpe_query(spark, docs, no_docs):
    tool = Tokenizer.from_file(BYTE)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = bpe.round_trip(docs, BYTE).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = tool.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(no_docs, BYTE).count() == 0


def test_count_query(spark, docs, no_docs):
    tool = Tokenizer.from_file(BYTE)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in token_counts.count_tokens(docs, BYTE, limit=4).collect():
        n = len(tool.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 4)
    assert token_counts.count_tokens(no_docs, BYTE).count() == 0


def test_token_files_query(spark, docs, no_docs, monkeypatch):
    tool = Tokenizer.from_file(WORD)
    rows = token_files.read_token_files(spark, token_files.write_token_files(docs, WORD, end_id=2)).collect()
    source = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    start = 0
    assert len(rows) == len(source)
    for r, s in zip(sorted(rows, key=lambda r: r["start"]), source, strict=True):
        ids = [*tool.encode(s["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (s["doc_id"], start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.read_token_files(spark, token_files.write_token_files(no_docs, WORD, end_id=2)).count() == 0


def test_token_files_of_several_parts_and_blocks(spark):
    tool = Tokenizer.from_file(WORD)
    texts = {i: "tok en " * (i * 7 % 23) + str(i) for i in range(900)}
    given = spark.createDataFrame([(i, x, "clash") for i, x in texts.items()], "doc_id long, text string, part string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = token_files.write_token_files(given, WORD, end_id=2, block_ids=300)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    blocks = spark.read.parquet(path)
    assert blocks.count() > 20 and blocks.select("part").distinct().count() > 1
    start = 0
    for r in token_files.read_token_files(spark, path).orderBy("doc_id").collect():
        n = len(tool.encode(texts[r["doc_id"]], add_special_tokens=False).ids) + 1
        assert (r["start"], r["n_tokens"]) == (start, n)
        start += n


def test_texts_longer_than_a_slice(monkeypatch):
    some = [*odd_texts()[:40], "Some, words. of a long text " * 200, "", "x" * 999]
    for module, make in ((token_files, lambda: token_files.WordEncoder(WORD).encode), (bpe, lambda: bpe.Encoder(BYTE).encode), (token_counts, lambda: token_counts.Counter(BYTE).count)):
        whole = list(map(bytes, make()(some))) if module is not token_counts else list(make()(some))
        monkeypatch.setattr(module, "SLICE", 50)
        assert (list(map(bytes, make()(some))) if module is not token_counts else list(make()(some))) == whole


def test_tiff_query(docs, no_docs):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = tiff.payload_features(docs).collect()
    for r in rows:
        data = texts[r["doc_id"]]
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    same = [r[1:] for r in rows if texts[r["doc_id"]] == texts[3]]
    assert len(same) == 3 and len(set(same)) == 1
    assert tiff.payload_features(no_docs).count() == 0


def pack_bits(data: bytes) -> bytes:
    return b"".join(bytes([257 - 3 if len(set(data[i : i + 3])) == 1 and len(data[i : i + 3]) == 3 else len(data[i : i + 3]) - 1]) + (data[i : i + 1] if len(set(data[i : i + 3])) == 1 and len(data[i : i + 3]) == 3 else data[i : i + 3]) for i in range(0, len(data), 3))


def pack_lzw(data: bytes) -> bytes:
    table = {bytes([i]): i for i in range(256)}
    codes, width, word = [(256, 9)], 9, b""
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        codes.append((table[word], width))
        table[word + bytes([b])] = len(table) + 2
        if len(table) + 2 >= 1 << width and width < 12:
            width += 1
        word = bytes([b])
        if len(table) + 2 >= 4094:
            codes.append((table[word], width))
            codes.append((256, width))
            table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    if word:
        codes.append((table[word], width))
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    codes.append((257, width))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def test_segment_codecs():
    random.seed(3)
    for data in (b"", b"aaab", bytes(random.choice(b"ab") for _ in range(5000)), bytes(random.randrange(256) for _ in range(9000))):
        assert tiff.unpack_lzw(pack_lzw(data)) == data
        assert tiff.unpack_bits(pack_bits(data)) == data


def test_codecs_on_published_examples():
    """The worked examples of the two formats' specifications."""
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff.unpack_lzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8))) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_payloads_of_many_pages_keep_together(spark, monkeypatch):
    monkeypatch.setattr(tiff, "PAGE_ROWS", 3)
    texts = {i: "xyz" * (i * 97 % 501) for i in range(40)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # pages of a payload in several batches
    try:
        rows = tiff.payload_features(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 40
    for r in rows:
        data = texts[r["doc_id"]].encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_sha256"]) == (len(data), hashlib.sha256(payload).hexdigest())


def test_pages_of_tiles_strips_and_broken_images(spark):
    import struct

    grid = np.arange(20 * 24, dtype=np.uint8).reshape(20, 24)
    tiles = [np.pad(grid, ((0, 12), (0, 8)))[y : y + 16, x : x + 16] for y in (0, 16) for x in (0, 16)]
    stored = [zlib.compress(np.diff(t, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()) for t in tiles]
    at, head = [], bytearray(b"MM\0*\0\0\0\x08")
    fields = [(256, 4, 1, 24), (257, 4, 1, 20), (258, 3, 1, 8 << 16), (259, 3, 1, 8 << 16), (277, 3, 1, 1 << 16), (317, 3, 1, 2 << 16), (322, 4, 1, 16), (323, 4, 1, 16), (324, 4, 4, 0), (325, 4, 4, 0)]
    lists = 8 + 2 + 12 * len(fields) + 4
    data = lists + 32
    for s in stored:
        at.append(data)
        data += len(s)
    fields[8], fields[9] = (324, 4, 4, lists), (325, 4, 4, lists + 16)
    image = bytes(head) + struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", *f) for f in fields) + bytes(4) + struct.pack(">8I", *at, *map(len, stored)) + b"".join(stored)
    payload = bytes(range(256)) * 64 * 80
    long = tiff.encode_payload(payload)
    df = spark.createDataFrame([(1, image), (2, long), (3, None), (4, b"II*\0junk")], "id long, media binary")
    rows = {(r["id"], r["page"]): r for r in tiff.read_pages(df, "id", "media").collect()}
    assert bytes(rows[1, 0]["pixels"]) == grid.tobytes() and (rows[1, 0]["width"], rows[1, 0]["height"]) == (24, 20)
    assert b"".join(bytes(rows[2, p]["pixels"]) for p in range(2)) == payload
    assert rows[3, -1]["error"] and rows[4, -1]["error"]


def test_long_pieces_equal_library_in_time():
    tool, mine = Tokenizer.from_file(BYTE), bpe.Encoder(BYTE)
    rng = random.Random(1)
    for n in (257, 600, 5000, 40_000):
        text = "".join(rng.choice("etaoinshrdluéß") for _ in range(n))
        assert next(mine.encode([text])).tolist() == tool.encode(text, add_special_tokens=False).ids
    mixed = [" " + "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 900))) for _ in range(300)]
    for text, ids in zip(mixed, mine.encode(mixed), strict=True):
        assert ids.tolist() == tool.encode(text, add_special_tokens=False).ids
    text = "".join(rng.choice("etaoinshrdlucmfw") for _ in range(1_000_000))
    began = time.perf_counter()
    ids = next(mine.encode([text])).tolist()
    assert time.perf_counter() - began < 30  # about 6 s on a free core
    assert mine.vocabulary.decode(ids) == text


def test_caches_are_bounded_by_bytes():
    mine = bpe.Encoder(BYTE, cache=100)
    for i in range(5):
        next(mine.encode([" ".join(f"{i}word{j}" + "x" * 400 for j in range(60))]))
        assert mine.chunks_size <= 2 * 100 * bpe.ENTRY + 60 * 2500
        assert len(mine.chunks) <= 120


def broken(width, length, data=b"\1", compression=1, samples=1):
    fields = [(256, 4, 1, width), (257, 4, 1, length), (258, 3, 1, 8), (259, 3, 1, compression), (273, 4, 1, 122), (277, 3, 1, samples), (278, 4, 1, length), (279, 4, 1, len(data))]
    head = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + bytes(4)
    return head.ljust(122, b"\0") + data


def test_broken_images_give_their_error(spark):
    """Sizes that no strip can hold, codes beyond the table, no size at all: one row with its error, and the task lives."""
    bad_lzw = bytes([0b10000000, 0b00011111, 0b11110000, 0])  # clear, then code 510... of a table of 258
    images = [broken(1 << 31, 1 << 31), broken(1 << 22, 1 << 22), broken(0, 5), broken(64, 64, bad_lzw, 5), broken(1 << 16, 1 << 16, b"x\x9c\x03", 8), broken(4, 1, b"\1\2\3\4"), broken(3, 1, b"\1", samples=0), b"II*\0", b"", None]
    rows = tiff.read_pages(spark.createDataFrame([(i, x) for i, x in enumerate(images)], "k int, media binary"), "k", "media").collect()
    assert len(rows) == len(images)
    by = {r["k"]: r for r in rows}
    assert by[5]["error"] is None and bytes(by[5]["pixels"]) == b"\1\2\3\4"
    assert all(by[i]["error"] and by[i]["page"] == -1 for i in range(len(images)) if i != 5)
    with pytest.raises(ValueError, match="beyond the table"):
        tiff.unpack_lzw(bad_lzw)
