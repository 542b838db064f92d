"""Retrieval over chunks for batches of questions: filters, vector top-k, rule-based reranking, context packs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakeloom.functions.text import any_of, fold_text, squeeze, strip_row_prefix, tokenize_fold
from lakeloom.sources.tables import written

# Alias, keyword and pattern lists, in the order in which the first hit wins.
COMPANIES = (("asia commercial bank", "ACB"), ("ngan hang tmcp a chau", "ACB"), ("hoa phat", "HPG"), ("tap doan hoa phat", "HPG"), ("fpt", "FPT"), ("techcombank", "TCB"), ("vinamilk", "VNM"))
REPORT_TYPES = (("ket qua kinh doanh", "income_statement"), ("bao cao ket qua hoat dong kinh doanh", "income_statement"), ("bang can doi ke toan", "balance_sheet"), ("luu chuyen tien te", "cash_flow"), ("thuyet minh", "notes"))
REPORT_FAMILIES = (("bao cao tai chinh", "BCTC"), ("bctc", "BCTC"), ("financial report", "BCTC"), ("financial statement", "BCTC"), ("thuyet minh", "notes"))
SCOPES = (("hop nhat", "Hopnhat"), ("rieng", "Congtyme"), ("cong ty me", "Congtyme"), ("consolidated", "Hopnhat"), ("separate", "Congtyme"), ("standalone", "Congtyme"), ("parent company", "Congtyme"))
AMOUNT = ("bao nhieu", "so tien", "gia tri", "how much", "what is", "what was", "as of", "tai ngay", "bien dong", "phan tram", "%")
OPINION = ("opinion", "review opinion", "audit opinion", "review conclusion", "reviewed financial statements", "soat xet", "kiem toan", "y kien soat xet", "y kien kiem toan", "ket luan kiem toan", "ket luan cua kiem toan vien")
METRICS = (
    ("tong tai san", ("tong tai san", "total assets")), ("cho vay khach hang", ("cho vay khach hang", "customer loans", "loans to customers")),
    ("tien gui cua khach hang", ("tien gui cua khach hang", "customer deposits", "deposits from customers")), ("loi nhuan sau thue", ("loi nhuan sau thue", "profit after tax", "net profit")),
)
BALANCE = ("tong tai san", "cho vay khach hang", "tien gui cua khach hang")
INCOME = ("loi nhuan sau thue",)
POLICY = ("nguyen tac", "ghi nhan", "hach toan", "trinh bay", "ke khai")
POLICY_EVIDENCE = ("nguyen tac", "ghi nhan", "hach toan", "ke khai", "gia goc", "gia tri thuan")
CUTS = (r"\bso dau ky\b", r"\bso cuoi ky\b", r"\bdau ky\b", r"\bcuoi ky\b", r"\bbao nhieu\b", r"\bbien dong\b", r"\bphan tram\b", r"\bgia tri\b", r"\bso tien\b", r"\btai ngay\b", r"\bngay \d{1,2}\b", r"\bquy \d\b", r"\bduoc lap\b", r"\btheo phuong phap\b", r"\bdon vi\b")
BALANCE_TITLES, INCOME_TITLES = ("bao cao tinh hinh tai chinh", "bang can doi ke toan"), ("bao cao ket qua hoat dong", "ket qua kinh doanh")
NOISE_TITLES = ("muc do tap trung", "rui ro", "ngoai bang", "dia ly")
OPINION_EVIDENCE = ("ket luan cua kiem toan vien", "khong thay co van de gi", "bao cao soat xet thong tin tai chinh giua nien do", "chung toi da soat xet bao cao tai chinh")
ROWS = ("table_row", "table_row_window")
TOP, CONTEXT = 12, 4

# -- questions --------------------------------------------------------------------------------------------------------


def _first(folded: Column, pairs) -> Column:
    return F.coalesce(*(F.when(F.contains(folded, F.lit(k)), F.lit(v)) for k, v in pairs))


def infer_filters(question: Column, symbols: tuple[str, ...] | None = None) -> Column:
    """Struct of ticker, company_name, year, quarter, report_type, report_family, scope. With ``symbols`` only these words
    are tickers; without, any capital word of three to five letters is."""
    folded = fold_text(question)
    word = F.nullif(F.regexp_extract(question, rf"\b({'|'.join(symbols)})\b" if symbols else r"\b([A-Z]{3,5})\b", 1), F.lit(""))
    company = F.coalesce(*(F.when(F.contains(folded, F.lit(a)) & (word.isNull() | (word == s)), F.lit(a)) for a, s in COMPANIES))
    return F.struct(
        F.coalesce(word, _first(folded, COMPANIES)).alias("ticker"), company.alias("company_name"), F.regexp_extract(question, r"\b(20\d{2})\b", 1).try_cast("int").alias("year"),
        F.regexp_extract(folded, r"\b(?:q|quy|quarter)\s*([1-4])\b", 1).try_cast("int").alias("quarter"), _first(folded, REPORT_TYPES).alias("report_type"), _first(folded, REPORT_FAMILIES).alias("report_family"), _first(folded, SCOPES).alias("scope"),
    )


def metric_targets(question: Column) -> Column:
    folded = fold_text(question)
    return F.filter(F.array(*(F.when(any_of(folded, a), F.lit(m)) for m, a in METRICS)), lambda x: x.isNotNull())


def detect_focus(question: Column) -> Column:
    q = fold_text(question)
    return (
        F.when(any_of(q, AMOUNT) | (F.size(metric_targets(question)) > 0), "amount").when(F.contains(q, F.lit("don vi")), "unit").when(F.contains(q, F.lit("phuong phap")), "method")
        .when(any_of(q, POLICY), "policy").when(F.rlike(F.trim(question), F.lit(r"^\d+(?:\.\d+)+\s+")), "numbered_section").otherwise("generic")
    )


def focus_phrase(question: Column) -> Column:
    """The first metric, else the text up to the earliest cut pattern without filler words."""
    text = squeeze(fold_text(question))
    cut = F.least(F.length(text) + 1, *(F.nullif(F.regexp_instr(text, F.lit(p)), F.lit(0)) for p in CUTS))
    phrase = F.regexp_replace(F.substring(text, F.lit(1), cut - 1), r"^[ ,.\-:;]+|[ ,.\-:;]+$", "")
    return F.coalesce(F.get(metric_targets(question), F.lit(0)), squeeze(F.regexp_replace(phrase, r"\b(co|la|o|tu|den|nam|thang|ngay|tong|so)\b", " ")))


def opinion_signal(question: Column) -> Column:
    return any_of(fold_text(question), OPINION)


def expand_queries(questions: DataFrame) -> DataFrame:
    """One row for each retrieval text of a question, in order, the question first."""
    q = F.col("question")
    rows = questions.withColumns({"f": infer_filters(q), "focus": detect_focus(q), "phrase": focus_phrase(q), "metrics": metric_targets(q), "opinion": opinion_signal(q), "dates": F.regexp_extract_all(q, F.lit(r"\b\d{2}/\d{2}/\d{4}\b"), F.lit(0))})
    phrase = F.coalesce(F.nullif("phrase", F.lit("")), squeeze(q))
    period = F.concat(F.lit("quý "), F.col("f.quarter").cast("string"), F.lit(" năm "), F.col("f.year").cast("string"))
    whole = F.concat_ws(" ", F.col("f.ticker"), period)
    known = F.col("f.ticker").isNotNull() & period.isNotNull()
    none = F.array().cast("array<string>")

    def of(m: Column) -> Column:
        titles = F.when(m.isin(*BALANCE), F.array(F.concat(F.lit("báo cáo tình hình tài chính "), m), F.concat(F.lit("bảng cân đối kế toán "), m)))
        titles = titles.when(m.isin(*INCOME), F.array(F.concat(F.lit("báo cáo kết quả hoạt động "), m), F.concat(F.lit("kết quả kinh doanh "), m))).otherwise(none)
        dated = F.transform("dates", lambda d: F.concat(m, F.lit(" "), F.replace(d, F.lit("/"), F.lit("."))))
        return F.concat(F.array(m, F.when(known, F.concat(whole, F.lit(" "), m))), dated, titles)

    texts = F.array(*map(F.lit, ("ý kiến soát xét", "kết luận của kiểm toán viên", "báo cáo soát xét thông tin tài chính giữa niên độ", "không thấy có vấn đề gì")))
    opinions = F.concat(texts, F.array(*(F.when(known, F.concat(whole, F.lit(" " + x))) for x in ("ý kiến soát xét", "kết luận của kiểm toán viên"))))
    p = F.nullif("phrase", F.lit(""))
    tail = (
        F.when(F.col("focus") == "amount", F.array(F.concat(p, F.lit(" số đầu kỳ số cuối kỳ")))).when(F.col("focus") == "unit", F.array(*map(F.lit, ("Đơn vị tính", "Đơn vị", "unit"))))
        .when(F.col("focus") == "method", F.array(*map(F.lit, ("phương pháp", "theo phương pháp nào"))))
        .when(F.col("focus") == "policy", F.array(F.lit("nguyên tắc ghi nhận"), F.lit("chính sách kế toán"), p, F.concat(F.lit("nguyên tắc "), p), F.concat(F.lit("ghi nhận "), p))).otherwise(none)
    )
    head = F.array(q, p, F.concat(F.col("f.ticker"), F.lit(" "), phrase), F.concat(F.col("f.company_name"), F.lit(" "), phrase), F.concat(period, F.lit(" "), phrase))
    every = F.concat(head, F.flatten(F.transform("metrics", of)), F.when(F.col("opinion") & (F.size("metrics") == 0), opinions).otherwise(none), tail)
    every = F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))
    return rows.select("question_id", F.posexplode(every).alias("ordinal", "query"))


# -- vectors ----------------------------------------------------------------------------------------------------------

FILTERS = ("ticker", "year", "quarter", "scope", "report_type", "report_family")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Chunks and questions of a block of the vector search, at most; multiply-adds of a block at once; questions whose best a
#: task holds before it hands them on.
CELL_CHUNKS, CELL_QUESTIONS, CELL_STEP, HELD = 8192, 1024, 1 << 22, 1 << 18


#: How far a single-precision cosine may be off, with rounding.
SLACK = 1e-5


def _units_of(flat: pa.Array, n: int) -> np.ndarray:
    """``n`` vectors of one length as unit vectors, read from Arrow's buffer; rows without a direction are not a number."""
    v = flat.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return v / np.linalg.norm(v, axis=1, keepdims=True)


def _packed(batches: Iterator[pa.RecordBatch], most: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a key, vector and point_id as blocks of a key: its ids, and its vectors end to end."""
    for rows in batches:
        rows = pa.Table.from_batches([rows]).sort_by("key").combine_chunks()
        if not len(rows):
            continue
        keys = rows.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
        ends = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys)).tolist()
        for lo, hi in zip([0, *ends], ends, strict=False):
            for at in range(lo, hi, most):
                some = rows.slice(at, min(most, hi - at))
                parts = [some.column("point_id").combine_chunks(), some.column("vector").combine_chunks().flatten()]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x).cast(schema.field(i + 1).type) for i, x in enumerate(parts)]
                yield pa.RecordBatch.from_arrays([some.column("key").combine_chunks().slice(0, 1).cast(schema.field(0).type), *lists], schema=schema)


class _Best:
    """The best chunks so far of the questions of one block."""

    def __init__(self, asks: pa.StructArray, k: int):
        self.ids, self.k = asks.field("question_id"), k
        self.units = _units_of(asks.field("vector").flatten(), len(asks))
        self.single, self.floor = self.units.astype(np.float32), np.full(len(asks), -np.inf)
        self.i, self.points, self.cosines = np.zeros(0, np.int64), None, np.zeros(0)

    def meet(self, points: np.ndarray, units: np.ndarray) -> None:
        """A product in single precision picks the chunks that can be among the best, which are worked out in double
        precision: cosine rounded to six digits, then the smaller point_id."""
        good = np.isfinite(units).all(1)  # a vector of zeros has no cosine
        if not good.all():
            points, units = points[good], units[good]
        if not len(units):
            return
        turned, few, found = units.astype(np.float32).T, min(self.k, len(units)), []
        for lo in range(0, len(self.units), step := max(1, CELL_STEP // len(units))):
            near, least = self.single[lo : lo + step] @ turned, self.floor[lo : lo + step].copy()
            new = np.flatnonzero(np.isinf(least))
            if len(new):
                least[new] = np.partition(near[new], len(units) - few, axis=1)[:, len(units) - few]
            # one pass of all products; a question without a direction is near to none
            i, j = np.divmod(np.flatnonzero(near >= (least - SLACK).astype(np.float32)[:, None]), len(units))
            found.append((i + lo, j))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(i):
            return
        cosines = np.concatenate([self.cosines, np.round(np.einsum("ij,ij->i", self.units[i], units[j]), 6)])
        held = points[j] if self.points is None else np.concatenate([self.points, points[j]])
        i = np.concatenate([self.i, i])
        order = np.lexsort((np.unique(held, return_inverse=True)[1], -cosines, i))
        i = i[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)  # among the hits of its question
        kept = place < self.k
        order = order[kept]
        self.i, self.points, self.cosines = i[kept], held[order], cosines[order]
        last = place[kept] == self.k - 1
        self.floor[self.i[last]] = self.cosines[last]

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        points = pa.array([] if self.points is None else self.points, schema.field("point_id").type)
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(self.i)).cast(schema.field("question_id").type), points, pa.array(self.cosines)], schema=schema)


def _best_of_blocks(batches: Iterator[pa.RecordBatch], k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of each question among the chunk blocks of a task, which meet question blocks of their key."""
    best: dict[tuple, _Best] = {}
    for rows in batches:
        for n in range(len(rows)):
            at = rows["key"][n].as_py(), rows["cell"][n].as_py()
            if at not in best:
                if sum(len(x.ids) for x in best.values()) > HELD:
                    yield from (x.rows(schema) for x in best.values())
                    best = {}
                best[at] = _Best(rows["asks"][n].values, k)
            ids = rows["ids"][n].values
            best[at].meet(ids.to_numpy(zero_copy_only=False), _units_of(rows["vectors"][n].values, len(ids)))
    yield from (x.rows(schema) for x in best.values())


def vector_topk(questions: DataFrame, chunks: DataFrame, k: int = TOP, filters: tuple[str, ...] = FILTERS, cell_chunks: int = CELL_CHUNKS, cell_questions: int = CELL_QUESTIONS) -> DataFrame:
    """The ``k`` chunks of highest cosine for each question vector among those that meet the filters the question sets.

    The filters that a question sets and their values are a key; a chunk has a key for each set of filters that occurs, so
    questions meet only chunks that pass. Chunks are packed into blocks of a key where they are, questions into written
    blocks of bounded size; a task keeps the ``k`` best of each question over all its blocks. Spark joins blocks by key:
    while the question blocks are small, no chunk is shuffled. Ties go to the smaller point_id, vectors of other lengths or
    of zeros are left out."""
    used = [c for c in filters if c in questions.columns and c in chunks.columns]
    mask = F.lit("")
    for x in used:
        mask = F.concat(mask, F.when(F.col(x).isNull(), "0").otherwise("1"))
    q = questions.filter(F.size("vector") > 0).select("question_id", "vector", mask.alias("mask"), *used)
    sets = sorted(r["mask"] for r in q.select("mask").distinct().collect())  # at most two to the number of filters

    def key(mask: str) -> Column:
        parts = [F.coalesce(F.col(x).cast("string"), F.lit("\0")) for x, on in zip(used, mask, strict=True) if on == "1"]
        return F.concat_ws("\1", F.lit(mask), *parts, F.size("vector").cast("string"))

    of_question = F.coalesce(*(F.when(F.col("mask") == m, key(m)) for m in sets)) if sets else F.lit("")
    q = q.select("question_id", "vector", of_question.alias("key"))
    cells = q.groupBy("key").agg(F.ceil(F.count("*") / cell_questions).cast("int").alias("cells"))
    cell = F.pmod(F.xxhash64("question_id"), F.col("cells")).cast("int")
    asks = written(q.join(cells, "key").groupBy("key", cell.alias("cell")).agg(F.collect_list(F.struct("question_id", "vector")).alias("asks")), "question-blocks")
    c = chunks.filter(F.size("vector") > 0).select("point_id", "vector", F.explode(F.array(*map(key, sets)) if sets else F.array().cast("array<string>")).alias("key"))
    c = c.join(asks.select("key").distinct(), "key", "left_semi").select("key", "point_id", "vector")
    blocks = T.StructType([T.StructField("key", T.StringType()), T.StructField("ids", T.ArrayType(c.schema["point_id"].dataType)), T.StructField("vectors", c.schema["vector"].dataType)])
    schema = T.StructType([q.schema["question_id"], c.schema["point_id"], T.StructField("cosine", T.DoubleType())])
    of_blocks, of_hits = to_arrow_schema(blocks), to_arrow_schema(schema)
    packed = c.mapInArrow(lambda rows: _packed(rows, cell_chunks, of_blocks), blocks)
    met = packed.join(asks, "key").select("key", "cell", "asks", "ids", "vectors").mapInArrow(lambda rows: _best_of_blocks(rows, k, of_hits), schema)
    order = Window.partitionBy("question_id").orderBy(F.desc("cosine"), "point_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("question_id", "rank", "point_id", "cosine")


#: Rows on which cells are fitted and probes are measured, at most; questions of that measure; cells, at most.
SAMPLE, MEASURED, CELLS = 32_768, 256, 1024


@dataclass(frozen=True)
class CellIndex:
    """A coarse quantizer of unit vectors: centres of cells, and how many cells a question looks into."""

    centres: np.ndarray
    probes: int

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each vector, nearest first."""
        near = vectors @ self.centres.T
        some = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


def _units(vectors: pd.Series, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the given length that have a direction, as unit vectors, and where they stand."""
    at = np.array([i for i, x in enumerate(vectors) if x is not None and len(x) == dims], np.int64)
    v = np.stack([np.asarray(vectors.iloc[i], np.float64) for i in at]) if len(at) else np.zeros((0, dims))
    size = np.linalg.norm(v, axis=1)
    good = np.isfinite(size) & (size > 0)
    return (v[good] / size[good, None]).astype(np.float32), at[good]


def fit_cells(chunks: DataFrame, k: int = TOP, recall: float = 0.97, cells: int | None = None, rounds: int = 12) -> CellIndex:
    """Cells by k-means over directions, fitted on ``SAMPLE`` chunks at most, the first by hash of their id; every chunk is
    indexed later. Probes are the fewest with which ``MEASURED`` of the sample find the share ``recall`` of their ``k``
    nearest others in it; those of the whole table are nearer, so its recall is higher, if anything."""
    rows = chunks.filter(F.size("vector") > 0).select("point_id", "vector")
    n = rows.count()
    drawn = rows.withColumn("_h", F.xxhash64("point_id")).orderBy("_h", "point_id").limit(SAMPLE).toPandas()
    lengths = drawn["vector"].map(len)
    dims = int(lengths.mode().iloc[0]) if len(drawn) else 0
    v, _ = _units(drawn["vector"], dims)
    if not len(v):
        return CellIndex(np.zeros((1, dims), np.float32), 1)
    cells = cells or int(min(CELLS, max(1, len(v) // 16), max(1, round(n**0.5))))
    rng = np.random.default_rng(7)
    centres = v[rng.choice(len(v), cells, replace=False)]
    for _ in range(rounds):
        own = np.argmax(v @ centres.T, axis=1)
        order = np.argsort(own, kind="stable")
        held, first = np.unique(own[order], return_index=True)
        centres[held] = np.add.reduceat(v[order], first)
        size = np.linalg.norm(centres, axis=1)
        empty = np.setdiff1d(np.arange(cells), held)
        centres[empty] = v[rng.choice(len(v), len(empty))]
        size[empty] = 1
        centres /= np.maximum(size, 1e-12)[:, None]
    index = CellIndex(centres, cells)
    asked = rng.choice(len(v), min(MEASURED, len(v)), replace=False)
    near = v[asked] @ v.T
    near[np.arange(len(asked)), asked] = -2
    top = np.argpartition(-near, min(k, len(v) - 1) - 1, axis=1)[:, : max(1, min(k, len(v) - 1))]
    turn = np.argsort(index.nearest(v[asked], cells), axis=1)  # of each cell, its place in a question's order
    place = np.sort(np.take_along_axis(turn, np.argmax(v @ centres.T, axis=1)[top], 1).ravel())
    return CellIndex(centres, int(place[max(0, int(np.ceil(recall * len(place))) - 1)]) + 1)


def in_cells(rows: DataFrame, index: CellIndex, probes: int) -> DataFrame:
    """Rows with ``_cell``, one for each of their nearest cells. Vectors of another length or without a direction are in
    cell -1."""
    dims = index.centres.shape[1]

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        v, at = _units(vectors, dims)
        out = [[-1]] * len(vectors)
        if len(v):
            for i, own in zip(at.tolist(), index.nearest(v, probes).tolist(), strict=True):
                out[i] = own
        return pd.Series(out)

    return rows.withColumn("_cell", F.explode(cells("vector")))


def vector_topk_approx(questions: DataFrame, chunks: DataFrame, k: int = TOP, filters: tuple[str, ...] = FILTERS, index: CellIndex | None = None) -> DataFrame:
    """Approximate top-k: chunks lie in the cells of a coarse quantizer, a question meets the chunks of the cells nearest to
    it that pass its filters, and those are ranked by exact cosine. A cell is one more filter of the exact search, so
    large cells are dealt into blocks like any other key."""
    index = index or fit_cells(chunks, k)
    return vector_topk(in_cells(questions, index, index.probes), in_cells(chunks, index, 1), k, (*filters, "_cell"))


def merge_candidates(hits: DataFrame) -> DataFrame:
    """Hits of several retrieval texts: the best score of each question and point."""
    return hits.groupBy("question_id", "point_id").agg(F.max("cosine").alias("cosine"))


# -- chunk texts ------------------------------------------------------------------------------------------------------


def payload_text() -> Column:
    body = F.coalesce(F.nullif("content_for_embedding", F.lit("")), F.lit(""))
    kind = F.col("chunk_type")
    return (
        F.when(kind == "table_row_window", F.coalesce(F.nullif("window_text", F.lit("")), body)).when(kind == "table_row", F.coalesce(F.nullif("focus_row_text", F.lit("")), body))
        .when(kind.isin("table", "table_full"), F.coalesce(F.nullif("raw_content", F.lit("")), body)).otherwise(body)
    )


def toc_like(text: Column) -> Column:
    """Whether folded text looks like a table of contents."""
    has = lambda x: F.contains(text, F.lit(x))
    return (has("noi dung=") & has("trang=")) | has("muc luc") | (has("noi dung") & has("trang ") & has("|"))


def table_has_metric(text: Column, metric: str) -> Column:
    return any_of(fold_text(text), dict(METRICS)[metric])


def token_coverage(question: Column, hay: Column) -> Column:
    """Share of the question's distinct tokens of two characters or more that occur in folded text; null without any."""
    tokens = F.array_distinct(F.filter(tokenize_fold(question), lambda x: F.length(x) > 1))
    return F.try_divide(F.size(F.filter(tokens, lambda x: F.contains(hay, x))).cast("double"), F.nullif(F.size(tokens), F.lit(0)))


# -- rerank -----------------------------------------------------------------------------------------------------------


def _rules(dates: tuple[str, ...]) -> list[tuple[str, Column, Column]]:
    """(name, condition, weight) of every additive rule over the prepared columns; conditions of one choice exclude each
    other. ``dates`` are the report dates that mark a balance sheet's subtitle."""
    kind, focus, hay, text, core, label, phrase = (F.col(c) for c in ("chunk_type", "focus", "_hay", "_text", "_core", "_label", "phrase"))
    title, subtitle, keys = F.col("_title"), F.col("_subtitle"), F.col("_keys")
    is_row, is_text = kind.isin(*ROWS), kind == "text"
    amount, has_phrase = focus == "amount", F.coalesce(phrase, F.lit("")) != ""
    has = lambda c, *words: any_of(c, words)
    rules: list[tuple[str, Column, float]] = []
    for m, _ in METRICS:
        wanted = amount & F.array_contains("metrics", m)
        exact, part, near = core == m, F.contains(core, F.lit(m)), F.contains(hay, F.lit(m))
        rules += [
            (f"metric_row_exact:{m}", wanted & exact, 9.0), (f"metric_row_partial:{m}", wanted & ~exact & part, 7.0), (f"metric_context:{m}", wanted & ~part & near, 3.5), (f"metric_row_miss:{m}", wanted & ~part & ~near & is_row, -2.5),
        ]
        if m in BALANCE:
            rules += [
                (f"balance_title:{m}", wanted & has(title, *BALANCE_TITLES), 4.0), (f"balance_subtitle:{m}", wanted & has(subtitle, "tai ngay", *dates), 2.5), (f"balance_noise:{m}", wanted & has(title, *NOISE_TITLES), -6.0),
                (f"policy_table:{m}", wanted & has(title, "tom tat cac chinh sach ke toan"), -6.5), (f"currency_breakdown:{m}", wanted & F.arrays_overlap(keys, F.array(*map(F.lit, ("usd", "vang", "eur", "jpy", "aud", "cad", "khac", "tong cong")))), -5.5),
                (f"value_columns:{m}", wanted & F.exists(keys, lambda k: F.contains(k, F.lit("trieu vnd"))), 3.0),
            ]
        if m in INCOME:
            rules.append((f"income_title:{m}", wanted & has(title, *INCOME_TITLES), 4.0))
    on_row = amount & has_phrase & is_row
    same, starts, inside, near = core == phrase, F.startswith(core, F.concat(phrase, F.lit(" "))), F.contains(label, phrase), F.contains(hay, phrase)
    any_metric = F.exists("metrics", lambda x: F.contains(hay, x))
    rules += [
        ("focus_row_exact", on_row & same, 8.0), ("focus_row_prefix", on_row & ~same & starts, 4.5), ("focus_row_suffix_other", on_row & ~same & starts & core.endswith(" khac"), -1.0), ("focus_row_partial", on_row & ~same & ~starts & inside, 2.5),
        ("focus_context_only", on_row & ~same & ~starts & ~inside & near, 1.0), ("focus_row_miss", on_row & ~same & ~starts & ~inside & ~near, -1.8), ("focus_phrase", amount & has_phrase & ~is_row & near, 3.0),
        ("row_window", amount & (kind == "table_row_window"), 4.0), ("row", amount & (kind == "table_row"), 3.5), ("table_context", amount & kind.isin("table_full", "table"), 1.0), ("html_table_metric", amount & (kind == "table") & any_metric, 4.0),
        ("text_penalty", amount & ~kind.isin(*ROWS, "table_full", "table"), -1.0), ("row_code", amount & F.col("row_code").isNotNull(), 0.6), ("numeric_value", amount & F.rlike(text, F.lit(r"\d[\d\.,]{5,}")), 1.2),
        ("delta_ready", amount & has(F.col("_question"), "phan tram", "%", "bien dong") & (F.regexp_count(text, F.lit(r"\d[\d\.,]{2,}")) >= 2), 1.2),
        ("unit_note", (focus == "unit") & (F.coalesce("note_text", F.lit("")) != ""), 8.0), ("unit_phrase", (focus == "unit") & has(hay, "don vi"), 5.0), ("unit_text", (focus == "unit") & is_text, 2.0), ("unit_row", (focus == "unit") & is_row, -3.0),
        ("method_phrase", (focus == "method") & has(hay, "phuong phap"), 6.0), ("method_text", (focus == "method") & is_text, 3.0), ("method_row", (focus == "method") & is_row, -4.0),
        ("policy_phrase", (focus == "policy") & has(hay, *POLICY_EVIDENCE), 7.0), ("policy_text", (focus == "policy") & is_text, 3.0), ("policy_row", (focus == "policy") & is_row, -5.0), ("numbered_text", (focus == "numbered_section") & is_text, 3.0),
        ("opinion_text", F.col("_opinion") & is_text & has(hay, *OPINION_EVIDENCE), 7.0), ("opinion_table", F.col("_opinion") & kind.isin(*ROWS, "table_full"), -3.0),
        ("toc", focus.isin("unit", "method", "policy") & toc_like(hay), -12.0), ("exact_table_title", (title != "") & (F.col("_question") == title) & (kind == "table_full"), 6.0),
    ]
    return [(name, F.coalesce(c, F.lit(False)), F.lit(w)) for name, c, w in rules]


def prepare_questions(questions: DataFrame) -> DataFrame:
    """What reranking needs of a question, worked out once for each question and not for each candidate."""
    q = F.col("question")
    rows = questions.withColumns({"focus": detect_focus(q), "phrase": focus_phrase(q), "metrics": metric_targets(q), "_question": fold_text(q), "_tokens": F.array_distinct(F.filter(tokenize_fold(q), lambda x: F.length(x) > 1))})
    return rows.withColumn("_opinion", any_of(F.col("_question"), OPINION) & (F.size("metrics") == 0))


def prepare_chunks(chunks: DataFrame) -> DataFrame:
    """What reranking needs of a chunk, worked out once for each chunk."""
    rows = chunks
    for c in ("section_subtitle", "note_text", "row_label", "row_code", "window_text", "focus_row_text", "raw_content"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    if "row_values" not in rows.columns:
        rows = rows.withColumn("row_values", F.array().cast("array<struct<key:string,value:string>>"))
    rows = rows.withColumns({"_text": payload_text(), "_title": fold_text(F.col("section_title")), "_subtitle": fold_text(F.col("section_subtitle")), "_label": fold_text(F.col("row_label")), "_core": strip_row_prefix(F.col("row_label"))})
    hay = fold_text(F.concat_ws("\n", *(F.nullif(c, F.lit("")) for c in ("section_title", "section_subtitle", "note_text")), F.col("_text")))
    keys = F.transform(F.coalesce("row_values", F.array().cast("array<struct<key:string,value:string>>")), lambda x: fold_text(x["key"]))
    return rows.withColumns({"_hay": hay, "_keys": keys})


def rerank(candidates: DataFrame, dates: tuple[str, ...] = ()) -> DataFrame:
    """Candidates (question, chunk fields, cosine) with rerank_score and the names of the rules that count: ten times the
    cosine, six times the token coverage, and additive rules by focus. Questions and chunks that were prepared before they
    were joined are not worked out again."""
    rows = candidates if "_question" in candidates.columns else prepare_questions(candidates)
    rows = rows if "_hay" in rows.columns else prepare_chunks(rows)
    flags = _rules(dates)
    # every rule is evaluated once: names and weights are read off the flags
    rows = rows.withColumn("_flags", F.array(*(c for _, c, _ in flags)))
    hay = F.col("_hay")
    coverage = F.try_divide(F.size(F.filter("_tokens", lambda x: F.contains(hay, x))).cast("double"), F.nullif(F.size("_tokens"), F.lit(0)))
    weights, names = F.array(*(w for _, _, w in flags)), F.array(*(F.lit(n) for n, _, _ in flags))
    rules = F.aggregate(F.zip_with("_flags", weights, lambda f, w: F.when(f, w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    total = F.col("cosine") * 10 + 6 * F.coalesce(coverage, F.lit(0.0)) + rules
    why = F.filter(F.zip_with("_flags", names, lambda f, n: F.when(f, n)), lambda x: x.isNotNull())
    out = rows.withColumns({"rerank_score": F.round(total, 6), "why": why})
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def rank_candidates(reranked: DataFrame) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("rerank_score"), F.desc("cosine"), "point_id")
    return reranked.withColumn("rank", F.row_number().over(order))


def metric_asks(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, metrics, filters and ``_ask`` of the questions that name a metric; those of the same metrics and filters have the
    same ``_ask``."""
    filters = [c for c in FILTERS if c in questions.columns and c in chunks.columns]
    q = questions.select("question_id", metric_targets(F.col("question")).alias("metrics"), *(F.col(c).alias(f"_{c}") for c in filters))
    return q.filter(F.size("metrics") > 0).withColumn("_ask", F.to_json(F.struct("metrics", *(f"_{c}" for c in filters))))


def _met(asks: DataFrame, chunks: DataFrame) -> tuple[list[str], Column]:
    """The filters that asks may set, and whether a chunk passes them."""
    filters = [c for c in FILTERS if f"_{c}" in asks.columns and c in chunks.columns]
    met = F.lit(True)
    for x in filters:
        met = met & (F.col(f"_{x}").isNull() | (F.col(f"_{x}") == F.col(x)))
    return filters, met


def passing(asks: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that pass the filters of one of the asks, as ``metric_asks`` gives them."""
    filters, met = _met(asks, chunks)
    return chunks.join(asks.select(*(f"_{x}" for x in filters)).distinct(), met, "left_semi")


def named_chunks(asks: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """_ask, point_id: of each ask the first ``most`` chunks by point_id under its filters whose row label or table text names one
    of its metrics. Only chunks that pass some ask's filters are read for metrics, and the join is on the metric, so only
    chunks that match are paired."""
    _, met = _met(asks, chunks)
    asks = written(asks.drop("question_id").distinct(), "metric-asks")
    # each text is folded once, and only where it is looked at: columns of their own that the rules read
    row, table = F.col("chunk_type").isin(*ROWS), F.col("chunk_type").isin("table", "table_full")
    label, text = F.when(row, strip_row_prefix(F.col("row_label"))), F.when(table, fold_text(payload_text()))
    named = F.filter(F.array(*(F.when(F.when(row, F.contains("_label", F.lit(m))).otherwise(table & any_of(F.col("_text"), a)), F.lit(m)) for m, a in METRICS)), lambda x: x.isNotNull())
    noise = any_of(F.col("_title"), (*NOISE_TITLES, "tom tat cac chinh sach ke toan"))
    c = passing(asks, chunks).withColumn("_title", fold_text(F.col("section_title"))).filter(~noise).withColumns({"_label": label, "_text": text})
    c = c.withColumn("metric", F.explode(named)).drop("_title", "_label", "_text")
    found = c.join(asks.withColumn("metric", F.explode("metrics")).drop("metrics"), "metric").filter(met).select("_ask", "point_id").distinct()
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("_ask").orderBy("point_id"))).filter(F.col("_n") <= most).drop("_n")


def rescued(asks: DataFrame, named: DataFrame, hits: DataFrame, limit: int = 48) -> DataFrame:
    """Of each question the first ``limit`` chunks named for its ask that it has not hit, with cosine 0."""
    rows = named.join(asks.select("question_id", "_ask").distinct(), "_ask").select("question_id", "point_id").distinct().join(hits, ["question_id", "point_id"], "left_anti")
    first = F.row_number().over(Window.partitionBy("question_id").orderBy("point_id"))
    return rows.withColumn("_n", first).filter(F.col("_n") <= limit).select("question_id", "point_id", F.lit(0.0).alias("cosine"))


def metric_rescue(questions: DataFrame, chunks: DataFrame, hits: DataFrame, limit: int = 48) -> DataFrame:
    """Chunks under a question's filters, not hit already, whose row label or table text names one of its metrics; at most
    ``limit`` for each question by point_id, with cosine 0. Questions of the same metrics and filters search once, for as many
    chunks more as any question has hits."""
    asks, hits = metric_asks(questions, chunks), hits.select("question_id", "point_id").distinct()
    most = hits.groupBy("question_id").count().agg(F.max("count")).first()[0] or 0
    return rescued(asks, named_chunks(asks, chunks, limit + most), hits, limit)


# -- context ----------------------------------------------------------------------------------------------------------


def linked_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each row: the retrieval ids of the chunk it links to and of its parent table."""
    ids = chunks.select(F.col("retrieval_id").alias("linked_id"), F.lit(True).alias("_known"))
    by_source = chunks.filter("chunk_type = 'table_full'").select(F.explode("source_ids").alias("parent_table_id"), F.col("retrieval_id").alias("_by_source")).groupBy("parent_table_id").agg(F.min("_by_source").alias("_by_source"))
    by_id = chunks.select(F.col("retrieval_id").alias("parent_table_id"), F.col("retrieval_id").alias("_by_id")).distinct()
    out = rows.join(ids.distinct(), "linked_id", "left").withColumn("linked_id", F.when(F.col("_known"), F.col("linked_id")))
    out = out.join(by_source, "parent_table_id", "left").join(by_id, "parent_table_id", "left")
    return out.withColumn("parent_id", F.coalesce("_by_source", "_by_id")).drop("_known", "_by_source", "_by_id")


def linked_within(chunks: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """``linked_chunks(chunks, chunks)`` where links never leave what the columns ``within`` name, say a document: chunks that
    are dealt by these columns stay where they are, are made once, and no ids are shuffled. Each chunk asks for an id and
    answers to its own; both are sorted beside each other."""
    columns, key = chunks.columns, Window.partitionBy(*within, "_key")

    def looked_up(rows: DataFrame, asked: Column, answers: Column, kept: list[str]) -> DataFrame:
        """Rows, each once, with the least of what the answers to its key hold."""
        entry = lambda k, asks, by_source, by_id: F.struct(k.alias("_key"), F.lit(asks).alias("_asks"), by_source.alias("_by_source"), by_id.alias("_by_id"))
        none = F.lit(None).cast("string")
        own = F.array(entry(asked, True, none, none), entry(F.col("retrieval_id"), False, none, F.col("retrieval_id")))
        more = F.transform(F.coalesce(answers, F.array().cast("array<string>")), lambda k: entry(k, False, F.col("retrieval_id"), none))
        met = rows.select(*kept, F.explode(F.concat(own, more)).alias("_entry")).select(*kept, "_entry.*")
        # an answer is looked for by its key alone, so that it takes nothing else with it
        met = met.select(*(c if c in within else F.when(F.col("_asks"), F.col(c)).alias(c) for c in kept), "_key", "_asks", "_by_source", "_by_id")
        found = met.withColumns({c: F.when(F.col("_key").isNotNull(), F.min(c).over(key)) for c in ("_by_source", "_by_id")})
        return found.filter("_asks").drop("_key", "_asks")

    sources = F.when(F.col("chunk_type") == "table_full", F.col("source_ids"))
    rows = looked_up(chunks.withColumn("_sources", sources), F.col("linked_id"), F.array().cast("array<string>"), [*columns, "_sources"])
    rows = rows.withColumn("linked_id", F.col("_by_id")).drop("_by_source", "_by_id")
    out = looked_up(rows, F.col("parent_table_id"), F.col("_sources"), [*columns, "_sources"])
    return out.withColumn("parent_id", F.coalesce("_by_source", "_by_id")).drop("_sources", "_by_source", "_by_id")


def assemble_context(ranked: DataFrame, items: int = CONTEXT) -> DataFrame:
    """At most ``items`` chunks for each question: the best by focus, what it links to, then by rank; rows of the best
    one's table are skipped once there are two, tables of contents for focused questions. Needs rank, focus, retrieval_id,
    chunk_type, linked_id, parent_id, toc, has_unit; a question has a few dozen candidates, one small group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        focus, cand = rows["focus"].iloc[0], list(rows.itertuples())
        best = cand[0]
        if focus == "unit":
            best = next((c for c in cand if not c.toc and c.has_unit), best)
        elif focus in ("method", "policy"):
            best = next((c for c in cand if not c.toc and c.chunk_type == "text"), best)
        chosen: list[str] = []

        def add(x) -> None:
            if x and x not in chosen and len(chosen) < items:
                chosen.append(x)

        add(best.retrieval_id)
        if focus == "amount":
            if best.chunk_type in ROWS:
                add(best.linked_id)
            add(best.parent_id)
        elif focus in ("unit", "method", "policy"):
            add(next((c.retrieval_id for c in cand if not c.toc and c.chunk_type == "table_full" and (focus != "unit" or c.has_unit)), None))
        for c in cand[1:]:
            tabular = c.chunk_type in (*ROWS, "table", "table_full")
            if focus == "amount" and tabular and c.parent_id == best.parent_id and len(chosen) >= 2:
                continue
            if focus in ("unit", "method", "policy") and c.toc:
                continue
            add(c.retrieval_id)
        return pd.DataFrame({"question_id": rows["question_id"].iloc[0], "ordinal": range(len(chosen)), "retrieval_id": chosen})

    columns = ["question_id", "rank", "focus", "retrieval_id", "chunk_type", "linked_id", "parent_id", "toc", "has_unit"]
    kind = dict(ranked.dtypes)["question_id"]
    return ranked.select(*columns).groupBy("question_id").applyInPandas(run, f"question_id {kind}, ordinal int, retrieval_id string")


def hit_preview(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"preview": F.substring(squeeze(payload_text()), 1, 280), "context": F.substring(payload_text(), 1, 420)})


def opinion_evidence(contexts: DataFrame) -> DataFrame:
    """The first context of each question that states that nothing was found."""
    rows = contexts.filter(F.contains(fold_text(payload_text()), F.lit("khong thay co van de gi")))
    return rows.groupBy("question_id").agg(F.min_by(F.struct("page", "retrieval_id"), "ordinal").alias("e")).select("question_id", "e.*")


def focus_evidence(contexts: DataFrame) -> DataFrame:
    """Whether the contexts of a unit, method or policy question hold an explicit phrase; true for others."""
    hay = fold_text(payload_text())
    ok = F.when(F.col("focus") == "unit", F.contains(hay, F.lit("don vi"))).when(F.col("focus") == "method", F.contains(hay, F.lit("phuong phap"))).when(F.col("focus") == "policy", any_of(hay, POLICY_EVIDENCE)).otherwise(True)
    return contexts.groupBy("question_id").agg(F.bool_or(ok).alias("has_evidence"))


def extract_row_values(table_rows: DataFrame, metric: str) -> DataFrame:
    """Of each table (doc_id, header rows and rows as arrays): the row whose label is a metric, its numeric cells (whole
    numbers of one to three digits are codes) set against the date-bearing header cells, right-aligned."""
    numeric = lambda c: F.rlike(c, F.lit(r"^\(?-?\d[\d.,]*\)?$")) & ~F.rlike(c, F.lit(r"^\d{1,3}$"))
    heads = F.filter(F.slice("lines", 1, 6), lambda r: F.exists(r, lambda c: F.rlike(c, F.lit(r"\d{1,2}[./]\d{1,2}[./]\d{4}|20\d{2}"))))
    header = F.filter(F.get(heads, F.lit(0)), lambda c: F.rlike(c, F.lit(r"\d{1,2}[./]\d{1,2}[./]\d{4}|20\d{2}")))
    row = F.get(F.filter("lines", lambda r: F.exists(r, lambda c: F.contains(fold_text(c), F.lit(metric)))), F.lit(0))
    out = table_rows.withColumns({"_h": header, "_v": F.filter(row, numeric)})
    n = F.least(F.size("_h"), F.size("_v"))
    out = out.filter(n > 0)
    pairs = F.zip_with(F.slice("_h", F.size("_h") - n + 1, n), F.slice("_v", F.size("_v") - n + 1, n), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    return out.withColumn("row_values", pairs).drop("_h", "_v")


def select_amounts(contexts: DataFrame) -> DataFrame:
    """One value for each question and metric: of the columns whose header holds the asked date, else the year, else the
    first numeric one; earlier contexts first. Needs metric, ordinal, row_values, and asked_date (dd/MM/yyyy) or null."""
    rows = contexts.select("question_id", "metric", "ordinal", "page", "retrieval_id", "asked_date", F.posexplode("row_values").alias("place", "cell")).filter(F.rlike("cell.value", F.lit(r"\d")))
    key = F.col("cell.key")
    d = F.split("asked_date", "/")
    plain = F.concat(d[0].cast("int").cast("string"), F.lit("."), d[1].cast("int").cast("string"), F.lit("."), d[2])
    dated = F.contains(key, F.col("asked_date")) | F.contains(key, F.replace("asked_date", F.lit("/"), F.lit("."))) | F.contains(key, plain) | F.contains(key, F.replace(plain, F.lit("."), F.lit("/")))
    match = F.when(F.coalesce(dated, F.lit(False)), 0).when(F.coalesce(F.contains(key, d[2]), F.lit(False)), 1).when(F.rlike(key, F.lit(r"20\d{2}")), 2).otherwise(3)
    order = Window.partitionBy("question_id", "metric").orderBy("match", "ordinal", "place")
    rows = rows.withColumn("match", match).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return rows.select("question_id", "metric", "asked_date", key.alias("key"), F.col("cell.value").alias("value"), "page", "retrieval_id")
