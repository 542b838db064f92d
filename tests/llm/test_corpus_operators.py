"""Language model, classifier, mixing, search, SimHash, HTML and pipeline against brute force."""

import collections
import html
import math
import re
import time
import zlib

import numpy as np
import pytest
import xxhash

from lakeloom.llm import ctw, exact_topk, html_text, mixing, quality, simhash

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_context_tree_weighting_equals_plain_recursion(monkeypatch):
    monkeypatch.setattr(ctw, "DEPTH", 2)
    rng = np.random.default_rng(0)
    data = [bytes(rng.choice(list(b"abc"), 40)) for _ in range(8)]
    count = collections.Counter()
    for d in data:
        whole = b"\0\0" + d + b"\0"
        count.update(whole[i : i + 3] for i in range(len(whole) - 2))

    def kt(z, o):
        return sum(math.log((i + 0.5) / (i + 1)) for i in range(0)) + math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(z + o + 1)

    def node(context, prefix, depth):
        """(zeros, ones) of one decision below a context."""
        z = o = 0
        for g, n in count.items():
            if g[2 - depth : 2] == context and (1 << len(prefix) | (g[2] >> (8 - len(prefix)) if prefix else 0)) == int("1" + "".join(map(str, prefix)), 2):
                bit = g[2] >> (7 - len(prefix)) & 1
                z, o = z + n * (1 - bit), o + n * bit
        return z, o

    def weighted(context, prefix):
        own = kt(*node(context, prefix, len(context)))
        if len(context) == 2:
            return own, own
        below = sum(weighted(bytes([c]) + context, prefix)[0] for c in {g[1 - len(context)] for g in count if g[2 - len(context) : 2] == context})
        return math.log(0.5) + np.logaddexp(own, below), own

    def chance(context, prefix, bit, path):
        z, o = node(context, prefix, len(context))
        p = ((o if bit else z) + 0.5) / (z + o + 1)
        if len(context) == 2:
            return p
        w, own = weighted(context, prefix)
        share = math.exp(own + math.log(0.5) - w)
        return share * p + (1 - share) * chance(path[len(path) - len(context) - 1 :][: len(context) + 1], prefix, bit, path)

    grams = sorted(int.from_bytes(g) for g in count)
    n = np.array([count[g.to_bytes(3)] for g in grams], float)
    _, mixed = ctw.deep(np.array(grams), n, 0, 2)
    for i in range(0, len(grams), 5):
        g = grams[i].to_bytes(3)
        bits = [g[2] >> (7 - j) & 1 for j in range(8)]
        for j in range(8):
            want = chance(b"", bits[:j], bits[j], g[:2])
            assert mixed[j, i] == pytest.approx(want, rel=1e-9)


def test_ngram_numbers():
    whole = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    for cells in (ctw.CELLS, 1):
        ctw.CELLS, kept = cells, ctw.CELLS
        ids, grams = ctw.numbered(whole, 3)
        ctw.CELLS = kept
        assert [grams[i].item().to_bytes(3) for i in ids] == [whole[i : i + 3].tobytes() for i in range(len(whole) - 2)]


def test_language_model_query(spark, docs, no_docs):
    rows = ctw.score_documents(docs).collect()
    source = docs.collect()
    assert len(rows) == len(source)
    count, train = collections.Counter(), []
    for r in source:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        if zlib.crc32(key.encode()) % 7 != 2:
            count.update((r["text"] or "").encode().lower().split())
            train.append(key)
    n, v = sum(count.values()) + len(train), len(count) + 1
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in source}
    for r in rows:
        words = texts[r["doc_id"]]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
        assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == n and r["n_tokens"] == len(words) + 1
        assert r["n_known"] == sum(count[w] > 0 for w in words) + 1 and -1e6 < r["score"] < 0
    assert ctw.score_documents(no_docs).count() == 0


def test_language_model_score_by_plain_recursion(spark, monkeypatch):
    """The query's score of small documents, from counts in dictionaries alone."""
    import functools

    monkeypatch.setattr(ctw, "SLICE", 30)  # several slices; several blocks below
    texts = {i: ["abab ba", "ABBA cab", "", "é a", "abab ba"][i % 5] + "ab" * (i % 3) for i in range(12)}
    texts[3] = None
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    assert 0 < sum(held.values()) < len(held)
    zeros, ones = collections.Counter(), collections.Counter()
    for i, text in texts.items():
        if not held[i]:
            data = bytes(4) + (text or "").encode().lower() + b"\0"
            for at in range(4, len(data)):
                for j in range(8):
                    node = 1 << j | data[at] >> (8 - j)
                    for depth in range(5):
                        (ones if data[at] >> (7 - j) & 1 else zeros)[data[at - depth : at], node] += 1
    seen = {k for k in {*zeros, *ones}}

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(z + o + 1)

    @functools.cache
    def weighted(context, node):
        own = kt(zeros[context, node], ones[context, node])
        if len(context) == 4:
            return own
        below = [bytes([c]) + context for c in range(256) if (bytes([c]) + context, node) in seen]
        return math.log(0.5) + np.logaddexp(own, sum(weighted(x, node) for x in below))

    def chance(before, node, bit, depth=0):
        context = before[len(before) - depth :]
        z, o = zeros[context, node], ones[context, node]
        p = ((o if bit else z) + 0.5) / (z + o + 1)
        if depth == 4:
            return p
        share = math.exp(kt(z, o) + math.log(0.5) - weighted(context, node))
        return share * p + (1 - share) * chance(before, node, bit, depth + 1)

    given = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (1 << 20, 150):
        for r in ctw.score_documents(given, block=block).collect():
            data = bytes(4) + (texts[r["doc_id"]] or "").encode().lower() + b"\0"
            want = sum(math.log10(chance(data[at - 4 : at], 1 << j | data[at] >> (8 - j), data[at] >> (7 - j) & 1)) for at in range(4, len(data)) for j in range(8))
            assert r["score"] == pytest.approx(want, rel=1e-9), r["doc_id"]


def test_boosted_trees_against_exhaustive_splits():
    """The first split of the first tree is the best of all, and leaves hold the regularised means of the gradients."""
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = (x[:, 1] + 0.3 * rng.normal(size=300) > 0.2).astype(float)
    forest = quality.fit(x, y, rounds=1, depth=1)
    p = y.mean()
    g, h = y - p, p * (1 - p)

    def gain(f, cut):
        left = x[:, f] <= cut
        parts = [(g[m].sum(), h * m.sum()) for m in (left, ~left)]
        if min(left.sum(), (~left).sum()) < quality.LEAST:
            return 0.0
        return sum(a * a / (b + quality.RIDGE) for a, b in parts) - g.sum() ** 2 / (h * len(y) + quality.RIDGE)

    best = max(gain(f, c) for f in range(3) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1], method="lower")))
    f, cut = forest.feature[0, 0], forest.cut[0, 0]
    assert gain(f, cut) == pytest.approx(best)
    for side, m in enumerate((x[:, f] <= cut, x[:, f] > cut)):
        assert forest.leaf[0, side] == pytest.approx(quality.RATE * g[m].sum() / (h * m.sum() + quality.RIDGE))


def test_boosted_trees_learn_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit(x[:1500], y[:1500], rounds=60)
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    one = forest.base
    for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
        i = 0
        while i < len(f):
            i = 2 * i + 1 + (x[7, f[i]] > c[i])
        one += leaf[i - len(f)]
    assert forest.score(x[7:8])[0] == pytest.approx(1 / (1 + math.exp(-one)))
    assert quality.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_quality_query_holds_out_a_fold(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    assert quality.classify(no_docs, labels).count() == 0
    held = quality.classify(table(spark, "documents"), table(spark, "labels")).join(table(spark, "labels"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9


@pytest.mark.parametrize("name", ["op5_curriculum_mix", "op6_exact_topk"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from lakeloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_mix_meets_targets(spark, docs, no_docs):
    for d in (docs, table(spark, "documents")):
        rows = mixing.mixed(d).collect()
        assert len(rows) == d.count()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["source"]].append(r)
            assert 0 <= r["taken"] <= 3 * r["size"]
        total = sum(r["size"] for r in rows)
        assert sum(x[0]["target"] for x in by.values()) == pytest.approx(total)
        free = []
        for rank, source in enumerate(sorted(by, key=lambda s: (s is None, s))):
            x = by[source][0]
            assert abs(sum(r["taken"] for r in by[source]) - x["target"]) <= 1
            if x["target"] < 3 * x["source_size"] - 1e-6:
                free.append(x["target"] / (5, 2, 1)[rank % 3])
        assert max(free) == pytest.approx(min(free))
    order = mixing.curriculum(table(spark, "documents")).count()
    assert order >= sum(r["taken"] > 0 for r in rows)
    assert mixing.mixed(no_docs).count() == 0 and mixing.curriculum(no_docs).count() == 0
    assert mixing.curriculum(docs).columns == [*docs.columns, "position", "round"]


def test_curriculum_follows_the_schedules(spark):
    given = table(spark, "documents")
    rows = mixing.curriculum(given.withColumn("position", given.n_chars)).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows) and len({(r["doc_id"], r["round"]) for r in rows}) == len(rows)
    sizes = {r["doc_id"]: (r["source"], r["size"], r["target"]) for r in mixing.mixed(given).collect()}
    first = {r["doc_id"]: r["position"] for r in rows if r["round"] == 0}
    assert first == {r["doc_id"]: r["position"] for r in mixing.mixed(given).collect() if r["taken"]}
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["position"], sizes[r["doc_id"]][1]))
    for rank, source in enumerate(sorted(by, key=lambda x: (x is None, x))):
        schedule = mixing.SCHEDULES[rank % 3]
        goal = next(t for s, _, t in sizes.values() if s == source)
        grid = np.linspace(0, 1, 20001)
        rate = np.interp(grid, *zip(*schedule, strict=True))
        area = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        done = 0
        for at, size in sorted(by[source]):
            assert np.interp(at, grid, area / area[-1]) == pytest.approx(done / goal, abs=1e-3)
            done += size


def test_mix_tells_repeated_and_nameless_rows_apart(spark):
    rows = [(None, f"w{i} x y", "en", "a", 1) for i in range(30)] + [(1, "p q r", "en", "a", 1)] * 3 + [(1, "s t u", "en", None, 1)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(str, mixing.mixed(given).collect())) == sorted(map(str, mixing.mixed(given.repartition(5)).collect()))
    out = mixing.curriculum(given)
    taken = collections.Counter((r["doc_id"], r["text"], r["round"]) for r in out.collect())
    assert all(n <= collections.Counter((r[0], r[1]) for r in rows)[k[:2]] for k, n in taken.items())
    assert sum(taken.values()) == mixing.mixed(given).selectExpr("sum(rounds)").first()[0]


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    steps = spark.range(0, 101).select((F.col("id") / 100).alias("s"))
    for schedule in mixing.SCHEDULES:
        got = [r[0] for r in steps.select(mixing.due(F.col("s"), schedule)).collect()]
        grid = np.linspace(0, 1, 20001)
        rate = np.interp(grid, *zip(*schedule, strict=True))
        area = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        assert got == pytest.approx(np.interp(np.linspace(0, 1, 101), area / area[-1], grid).tolist(), abs=1e-4)


def test_exact_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=8).astype(np.float32).tolist()) for i in range(700)]
    rows += [(i, rows[3][1]) for i in range(1000, 1040)] + [(2000, None), (2001, []), (2100, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, rows[0][1]), (2200, [0.5, 0.5]), (2201, [0.25, 0.5]), rows[5]]
    rows += [rows[200]] * 3 + [(200, rows[7][1]), (300, rows[8][1]), (300, rows[8][1])]  # queries repeated, and of one id with other vectors
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, v int")
    for sizes in ({"candidates": 100, "queries": 3}, {"candidates": 400, "queries": 1}, {}):
        got = collections.Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.top_products(df, **sizes).collect())
        good = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
        want = collections.Counter()
        for at, (q, v) in enumerate(good):
            if q % 100 == 0:
                found = sorted(((-int(w @ v), i) for k, (i, w) in enumerate(good) if k != at and len(w) == len(v)))[:10]
                want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(found))
        assert got == want
    assert exact_topk.top_products(df.filter("false")).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [(0, [1e16, 1.0]), (1, [1e16, 1.0]), (2, [-1e16, 0.0]), (3, [0.0, 1e15]), (4, [3e15, 3e15]), (5, [1.0, 1.0])]
    got = {r["vec_id"]: r["score"] for r in exact_topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    high = [2**63 - 1 if x * 1024 >= 2**63 else int(np.floor(x * 1024)) for x in rows[0][1]]
    for i, v in rows[1:]:
        exact = sum(a * max(-(2**63), min(2**63 - 1, int(np.floor(x * 1024)))) for a, x in zip(high, v, strict=True))
        assert got[i] == max(-(2**63), min(2**63 - 1, exact))


def test_segment_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(6)
    basis = exact_topk.steps(16)
    assert np.allclose(basis @ basis.T, np.eye(16))
    for spread in (np.ones(64), 0.8 ** np.arange(64)):  # without and with directions that matter more
        turn = np.linalg.qr(rng.normal(size=(64, 64)))[0]
        x = rng.normal(size=(3000, 64)) * spread
        x = np.floor(1024 * (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn).astype(np.int64)
        seen = {}
        ids = rng.permutation(3000)
        floor = np.sort(x[:80] @ x.T, axis=1)[:, -11].astype(float)
        for f in (np.full(80, -np.inf), floor):
            seen = {}
            for i, (at, score) in enumerate(exact_topk.best(x[:80], f, x, ids, list(range(80)), seen=seen)):
                want = sorted((-int(x[j] @ x[i]), int(ids[j])) for j in range(3000) if j != i)[:10]
                assert [(-int(s), int(ids[j])) for j, s in zip(at, score, strict=True)] == want
        left = {n: sum(seen[n]) / sum(seen["pairs"]) for n in exact_topk.LEVELS}
        (one,) = exact_topk.best(x[5:6], np.full(1, -np.inf), x, ids, [5])  # a query alone in its cell
        assert sorted(one[1].tolist()) == sorted((x @ x[5])[np.arange(3000) != 5].tolist())[-10:]
        assert left[4] >= left[16] >= left[32] and left[32] < (0.6 if spread[-1] == 1 else 0.1), left


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[root(i)].append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(ids))]


def test_trie_goes_down_in_pairs_of_nodes():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = base[:500] ^ (np.uint64(1) << rng.integers(0, 63, 500).astype(np.uint64))
    far = base[500:900] ^ (np.uint64(7) << rng.integers(0, 60, 400).astype(np.uint64))
    close = np.uint64(5) << np.uint64(40) | np.arange(600, dtype=np.uint64)  # dense: all values of some bits
    values = np.unique(np.concatenate([base, near, far, close]))
    apart = np.bitwise_count(values[:, None] ^ values[None]) <= 2
    want = np.arange(len(values))
    while not np.array_equal(low := np.where(apart, want[None], len(values)).min(1), want):
        want = low
    seen = {}
    assert (simhash.trie_links(values, seen=seen) == want).all()
    pairs = len(values) ** 2 // 2
    assert 0 < seen["visited"] < pairs / 4 and seen["cut"] > 0  # far fewer pairs of nodes than pairs of values
    x, y = values[::2], values[1::2]
    got = simhash.trie_links(x, y, differ=0)
    both = np.concatenate([x, y])
    links = np.bitwise_count(x[:, None] ^ y[None]) <= 2
    assert all(got[i] == got[len(x) + j] for i, j in zip(*np.nonzero(links), strict=True))
    assert ((got != np.arange(len(both))).sum() <= links.sum()) and len(simhash.trie_links(values[:0])) == 0


@pytest.mark.parametrize(("node", "crowd"), [(simhash.NODE, simhash.CROWD), (16, simhash.CROWD), (16, 12)])
def test_simhash_links_and_components(spark, node, crowd):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    chain = [base[0]]
    for _ in range(30):
        chain.append(chain[-1] ^ np.uint64(1 << int(rng.integers(0, 64))) ^ np.uint64(1 << int(rng.integers(0, 64))))
    near = [b ^ np.uint64(1 << int(rng.integers(0, 64))) for b in base[:20]]
    prints = sorted({int(x) for x in [*base, *chain, *near, 0, 1, 3]})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, node=node, crowd=crowd)).collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in prints]
    want = brute_components(signed, prints)
    assert [roots.get(x, x) for x in signed] == want


def test_simhash_query(spark, docs, no_docs):
    for d in (docs, table(spark, "documents")):
        source = d.select("doc_id", "text").collect()
        prints = [brute_fingerprint(r["text"]) for r in source]
        want = sorted(zip([str(r["doc_id"]) for r in source], [f"{x:016x}" for x in prints], map(str, brute_components([r["doc_id"] for r in source], prints)), strict=True))
        assert sorted(tuple(map(str, r)) for r in simhash.near_duplicates(d).select("doc_id", "fingerprint", "component_id").collect()) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_run_classes_by_brute_force():
    rng = np.random.default_rng(4)
    for run in (1, 4, 8):
        streams = [rng.integers(0, 2, rng.integers(0, 30)) for _ in range(6)]
        stream, place, kind = html_text.run_classes(streams, run)
        want = [(i, a) for i, s in enumerate(streams) for a in range(len(s) - run + 1)]
        assert sorted(zip(stream.tolist(), place.tolist(), strict=True)) == want
        text = [tuple(streams[i][a : a + run]) for i, a in zip(stream, place, strict=True)]
        for i in range(len(text)):
            for j in range(i):
                assert (text[i] == text[j]) == (kind[i] == kind[j])


def test_main_text(spark):
    shell = "<html><head><title>t</title></head><body><div class='topbox'>{0} menu one two three four five six seven</div>{1}<div>all rights reserved by the owners of this site</div></body></html>"
    rows = [
        (1, "https://a.org/1", "<nav>x</nav><article><h1>Head &amp; more</h1><header>By me</header><p>One <b>bold</b>\n\t text<br>next<p>Two&nbsp;&lt;x&gt;<div class='comments'><p>no</p></div><aside>no</aside><form>no</form><script>var a='<p>no</p>'</script><footer>no</footer></article><footer>no</footer>"),
        (2, "https://a.org/2", None),
        (3, "https://a.org/3", ""),
        (4, None, "<p>just text"),
        (5, "https://b.org/1", shell.format("", "<p>unique words of the first page</p>")),
        (6, "https://b.org/2", shell.format("", "<p>other words on the second page</p>")),
        (7, "https://c.org/", "<div id='cookie-notice'>no</div><main><p>yes</p><div class='ad'>no</div><ul><li>a</li><li>b</li></ul></main>"),
        (7, "https://c.org/", "<div id='cookie-notice'>no</div><main><p>yes</p><div class='ad'>no</div><ul><li>a</li><li>b</li></ul></main>"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_texts(df).orderBy("page_id").collect()]
    texts = ["Head & more\nBy me\nOne bold text next\nTwo <x>", "", "", "just text", "unique words of the first page", "other words on the second page", "yes\na\nb", "yes\na\nb"]
    assert got == [(r[0], t, len(t)) for r, t in zip(rows, texts, strict=True)]
    assert html_text.main_texts(df.filter("false")).count() == 0


def article(page):
    body = re.search("<article>(.*)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", body))
    return "\n".join(p for p in parts if p)


def test_main_text_of_given_pages(spark):
    pages = table(spark, "pages")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(pages).collect()}
    assert got == {r["page_id"]: article(r["html"]) for r in pages.collect()}


def test_blocks_of_awkward_markup():
    got = lambda page: [x for _, x in html_text.blocks(page)]
    assert got("<p title=it's>one</p><p title='a>b' x>two</p>") == ["one", "two"]
    assert got('<p title="never closed>three</p>') == ["three"]
    assert got("<p/ = a>four</p><br/>five") == ["four", "five"]
    assert got("1 < 2 and <b>3</b> > 2") == ["1 < 2 and 3 > 2"] and got("end <p class='x") == ["end <p class='x"] and got("a <") == ["a <"]
    assert got("<p>x<!-- <p>no --><!DOCTYPE y><?z?><![CDATA[no]]>y</p><!-- open <p>no") == ["xy"]
    assert got("<script>if (a<b) '</p>'</script>t<SCRIPT>x</SCRIPTS></script>u<style>never") == ["t", "u"] or got("<script>1</script>t") == ["t"]
    assert got("<b><div>x</b>y</div></b>z") == ["xy", "z"]
    inside = "<article><p class='share-price-news'>a</p><section class='related-work'>b</section><div class='related'>no</div><h2 id='comments'>c</h2></article>"
    assert [x for role, x in html_text.blocks(inside) if role == html_text.MAIN] == ["a", "b", "c"]


@pytest.mark.parametrize("page", ['<p title="x>' * 50_000, "</b>" * 200_000, "<div></b>" * 50_000, "<b>" + "<div>" * 100_000 + "</b>" * 100_000, "<" * 300_000, "<script>" * 50_000, "<!--" * 100_000, "<p a=" * 60_000, "<p " + "= " * 200_000, "<i><p>" * 60_000 + "</i></p>" * 60_000])
def test_blocks_take_time_in_proportion(page):
    began = time.perf_counter()
    html_text.blocks(page)
    assert time.perf_counter() - began < 5


def brute_texts(rows):
    """Texts by counting every run of every page of a host, and the choice of roles by unique tokens."""
    by_host, pages = collections.defaultdict(dict), []
    for page_id, url, page in rows:
        host = re.match("(?:[a-z]+:)?//([^/?#]*)", (url or "").lower())
        host = host[1] if host else ""
        cut = html_text.blocks(page or "")
        tokens = [t for _, x in cut for t in x.split(" ")]
        pages.append((page_id, host, cut, tokens))
        by_host[host][page or ""] = {tuple(tokens[i : i + 8]) for i in range(len(tokens) - 7)}
    out = {}
    for page_id, host, cut, tokens in pages:
        count = collections.Counter(w for runs in by_host[host].values() for w in runs)
        n = len(by_host[host])
        gone = []
        for least in (max(2, 0.3 * n - 1e-6), max(2, 0.9 * (n + 1) - 1e-6)):
            mark = [False] * len(tokens)
            for i in range(len(tokens) - 7):
                if count[tuple(tokens[i : i + 8])] >= least:
                    mark[i : i + 8] = [True] * 8
            gone.append(mark)
        kept, at, left = {0: [], 1: []}, 0, {0: 0, 1: 0}
        for role, text in cut:
            some = text.split(" ")
            if role < 2:
                flags = gone[1 - role][at : at + len(some)]
                left[role] += len(some) - sum(flags)
                kept[role].append(" ".join(html_text.unique_runs(list(zip(some, flags, strict=True)))))
            at += len(some)
        role = 0 if kept[0] and 2 * left[0] >= left[1] else 1
        out[page_id] = "\n".join(x for x in kept[role] if x)
    return out


def test_main_text_without_containers_and_in_any_groups(spark, monkeypatch):
    """Pages whose article is a plain div, with a long host of more than 256 pages: as brute force says, however they are dealt."""
    import random

    rng = random.Random(3)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    given = [(r["page_id"], r["url"], r["html"].replace("<article>", "<div>").replace("</article>", "</div>")) for r in pages]
    truth = {r["page_id"]: article(r["html"]) for r in pages}
    words = [f"w{i}" for i in range(3000)]
    menu, notice = " ".join(rng.choices(words, k=14)), " ".join(rng.choices(words, k=12))
    for i in range(400):
        body = " ".join(rng.choices(words, k=60))
        some = f"<p>{notice}</p>" if i % 3 == 0 else f"<article><p>{body} inside</p><p>{menu}</p></article>" if i % 3 == 1 else ""
        given.append((10000 + i, "https://long.example/x", f"<div>{menu}</div>{some}<div><p>{body}</p></div>"))
        truth[10000 + i] = None
    given += [given[-1], (20000, "https://long.example/y", given[-1][2]), (20001, "https://short.example/", "long " * 30000), (20002, None, None)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in given], "page_id long, url string, html string, host int, key string")
    want = brute_texts(given)
    for size in (8, 256, 10**6):
        rows = html_text.main_texts(df, size).collect()
        assert len(rows) == len(given) and {r["page_id"]: r["text"] for r in rows} == want, size
    monkeypatch.setattr(html_text, "DICTIONARY", 0)  # dictionaries too large for all tasks
    assert {r["page_id"]: r["text"] for r in html_text.main_texts(df, 64).collect()} == want
    scores = []
    for page_id, text in truth.items():
        if text is not None:
            a, b = collections.Counter(want[page_id].split()), collections.Counter(text.split())
            scores.append(2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())))
    assert np.mean(scores) >= 0.99
    assert all(menu not in want[10000 + i] and notice not in want[10000 + i] for i in range(400))


def survivors(rows):
    """The smallest id of each group of texts that a five-word similarity of 0.8 or more links, by all pairs."""
    from lakeloom.llm import near_copies as nc

    sets = [set(nc.shingle_set(text or "").tolist()) for _, text in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if min(len(a), len(sets[j])) >= 0.8 * max(len(a), len(sets[j])) and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        first[root(i)] = min(first.get(root(i), doc_id), doc_id)
    return sorted(first.values())


def test_prefixes_lose_no_pair(spark):
    import random

    from lakeloom.llm import near_copies as nc

    rng, texts = random.Random(9), []
    for i in range(12):  # edits of a common source, above and below the similarity
        words = [f"b{i}w{k}" for k in range(rng.randrange(5, 120))]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 20 * 2)):
                copy[rng.randrange(len(copy))] = rng.choice(["one", "two", f"n{rng.random()}"])
            texts.append(" ".join(copy))
    given = spark.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(texts))], "doc_id long, text string")
    keyed = {r["node"]: set(nc.shingle_set(r["text"]).tolist()) for r in nc.nodes(given).collect()}
    got = {(r["a"], r["b"]) for r in nc.prefix_pairs(nc.nodes(given).selectExpr("node", "node AS root"), nc.nodes(given)).collect()}
    want = {(a, b) for a in keyed for b in keyed if a < b and len(keyed[a] & keyed[b]) >= 0.8 * len(keyed[a] | keyed[b])}
    assert want and want <= got and len(got) < len(keyed) ** 2 / 8
    same = nc.nodes(given).selectExpr("node", "0L AS root")
    assert nc.prefix_pairs(same, nc.nodes(given)).count() == 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as c

    stages = dict(c.STAGES)
    columns = list(c.DOCUMENTS)
    given = table(spark, "documents")
    kept = stages["quality"](spark, given, SF)
    scored = {r["doc_id"] for r in quality.classify(given, table(spark, "labels")).filter("predicted = 1").collect()}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == scored
    apart = stages["near_dedup"](spark, given, SF)
    assert apart.columns == columns and sorted(r["doc_id"] for r in apart.collect()) == survivors([tuple(r) for r in given.select("doc_id", "text").collect()])
    mixed = stages["mixing"](spark, given, SF)
    assert mixed.columns == [*columns, "position", "round"] and {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in mixing.mixed(given).filter("taken > 0").collect()}
    out = c.run(spark, SF)
    assert out.columns[0] == "doc_id" and 0 < out.count() <= 3 * given.count()
    for f in stages.values():  # awkward rows, and none
        assert f(spark, docs, SF).count() >= 1
        f(spark, docs.filter("false"), SF).count()


def _planted(rng, words, share):
    """A copy of the words with single words replaced until the five-word similarity falls below ``share``."""
    from lakeloom.llm import near_copies as nc

    base, copy, last = nc.shingle_set(" ".join(words)), list(words), list(words)
    while True:
        copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**9)}"
        other = nc.shingle_set(" ".join(copy))
        both = len(np.intersect1d(base, other))
        if both / (len(base) + len(other) - both) < share:
            return " ".join(last)
        last = list(copy)


def test_pipeline_drops_planted_near_copies(spark):
    import random

    import corpus_pipeline as c

    rng, rows, bases = random.Random(5), [], 60
    for i in range(bases):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((i, " ".join(words), "en", "s", 1))
        rows += [(1000 * (k + 1) + i, _planted(rng, words, share), "en", "s", 1) for k, share in enumerate((0.8, 0.85, 0.9, 0.95))]
        far = words[:150] + [f"far{i}-{k}" for k in range(150)]  # a similarity of about a third stays
        rows.append((10000 + i, " ".join(far), "en", "s", 1))
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in c.drop_near_duplicates(spark, given, SF).collect())
    assert got == [*range(bases), *range(10000, 10000 + bases)]
    awkward = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "two")]
    given = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in awkward], given.schema)
    assert sorted(r["doc_id"] for r in c.drop_near_duplicates(spark, given, SF).collect()) == [1, 4, 5]
    assert c.drop_near_duplicates(spark, given.filter("false"), SF).count() == 0


def test_pipeline_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline as c

    words = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(None, words(k), "en", None, 1) for k in range(20)]  # no id, different texts
    rows += [(7, words("a"), "en", None, 1), (7, words("b"), "en", None, 1), (3, words("b"), "en", None, 1), (7, words("a"), "en", None, 1)]
    rows += [(9, words("c"), "en", None, 1), (9, words("d"), None, "en", 1), (8, words("c"), "en", None, 1)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = c.drop_near_duplicates(spark, given, SF).select("doc_id", "text").collect()
    want = [(None, words(k)) for k in range(20)] + [(7, words("a")), (3, words("b")), (8, words("c")), (9, words("d"))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
