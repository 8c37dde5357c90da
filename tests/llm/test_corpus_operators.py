"""Near duplicates, decontamination, archives, neighbours, URL rules and the pipeline against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, neardup, neighbours, urls, warc


# --- near duplicates

def test_shingle_helpers():
    a = "a b c d e f g h".split()
    assert neardup.aligned_share(a, a) == 1.0
    assert neardup.aligned_share(a, a[:4] + ["x"] + a[5:]) == pytest.approx(14 / 16)
    assert neardup.aligned_share(a, list("zyxwvuts")) == 0.0
    assert neardup.similarity("", "") == (1.0, 1.0) and neardup.similarity("a", "")[0] == 0.0
    assert neardup.similarity("A b  c", "a B c") == (1.0, 1.0)


def test_classes_match_brute_force(docs, prose):
    rng = random.Random(8)
    texts = []
    for k in range(25):
        base = prose(rng.choice([40, 120, 400]), 50 + k).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 8, 30])):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(1000))
            texts.append(" ".join(copy))
    shared = prose(60, 999)
    texts += [shared + " " + prose(200, 2000 + k) for k in range(40)] + [None, "", "  ", "one two", "One  two"]
    grams = [frozenset(neardup.shingles(neardup.word_hashes(t)).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = grams[a] | grams[b]
            if not both or len(grams[a] & grams[b]) >= 0.8 * len(both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(texts)).collect()}
    assert found == {k: root(k) for k in range(len(texts))}
    kept = neardup.keep_one(docs(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root(k) for k in range(len(texts))})


def test_classes_of_drifting_groups_equal_an_exact_join(docs, prose):
    rng = random.Random(21)
    texts = []
    for k in range(4):
        group = [prose(120, 700 + k).split()]
        while len(group) < 60:  # copies of copies, many too far from any hub
            copy = list(rng.choice(group))
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(100000))
            group.append(copy)
        texts += [" ".join(g) for g in rng.sample(group, 40)]
    passage = prose(90, 71)
    for k in range(6):  # several clusters in the buckets of one shared passage
        base = passage + " " + prose(60, 800 + k)
        texts += [base + " " + " ".join(f"end{k}{e}{w}" for w in range(3)) for e in range(3)]
    grams = [frozenset(neardup.shingles(neardup.word_hashes(t)).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(texts)).collect()}
    assert found == {k: root(k) for k in range(len(texts))}


def test_components_are_of_written_links(docs, prose, monkeypatch):
    rng = random.Random(21)
    group = [prose(120, 700).split()]
    while len(group) < 60:
        copy = list(rng.choice(group))
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(len(copy))] = "edit" + str(rng.randrange(100000))
        group.append(copy)
    plans, tidied, components = [], [], neardup.weak_components

    def seen(links, *ends):
        plans.append(links._jdf.queryExecution().sparkPlan().toString())
        return components(links, *ends)

    monkeypatch.setattr(neardup, "weak_components", seen)
    monkeypatch.setattr(neardup, "tidy", tidied.append)
    neardup.classes(docs([" ".join(g) for g in group]))
    # else each use of the links holds all their texts against each other again, in one large plan
    assert len(plans) == 2 and not any("MapInArrow" in p or "Join" in p for p in plans)
    assert len(tidied) >= 4


def test_bucket_and_token_rows_are_never_broadcast(docs, prose, monkeypatch):
    # Spark sizes rows after an explode, or of a file of runs, far too low: their joins must not go by that size
    plans, stored = {}, neardup.written

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(neardup, "written", seen)
    base = prose(120, 700).split()
    # texts of different pairs share half their words: too few to link, enough for a bucket
    texts = [" ".join(base[:60] + prose(60, 800 + k // 2).split() + [str(k)]) for k in range(40)]
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(texts)).collect()}
    assert found == {k: k - k % 2 for k in range(40)}
    assert "Generate" in plans["buckets"][0] and "tokens" in plans
    assert not any("Broadcast" in p for name in ("buckets", "tokens") for p in plans[name])
    # the first pairs are of hubs; the second leave out what has been tried
    assert "Join" in plans["pairs"][0] and "Broadcast" not in plans["pairs"][0]


def test_repeats_on_one_side_and_moved_blocks_link(spark, docs, prose):
    words = prose(200, 31).split()
    a, b = (np.sort(neardup.sketch(neardup.labelled(neardup.shingles(neardup.word_hashes(" ".join(w))))[0])) for w in (words, words + words[:8]))
    assert len(np.intersect1d(a, b)) >= 8
    rng = random.Random(5)
    texts = [" ".join(words), " ".join(words + words[:8]), " ".join(words[100:] + words[:100])]
    for k in range(12):  # lines repeated in one copy only
        lines = [prose(12, 6000 + 20 * k + e) for e in range(15)]
        texts += ["\n".join(lines), "\n".join(lines + rng.choices(lines, k=rng.randrange(1, 9)))]
    long = prose(25_000, 77).split()
    texts += [" ".join(long), " ".join(long[12_000:] + long[:12_000])]
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(texts)).collect()}
    assert found == {k: 0 if k < 3 else k - (k - 3) % 2 for k in range(len(texts))}
    odd = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts[:3])], "doc_id long, text string, `a.b` string, hub long")
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.collect()] == [0]


def test_prefixes_of_similar_texts_meet():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 9, 1 << neardup._SLOT_BITS)
    for n in range(1, 80):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: -max(1, n // 9)], rng.integers(0, 2**63, n // 9, dtype=np.uint64)]))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(neardup.prefix(a, common, 0.8), neardup.prefix(b, common, 0.8)))


def test_classes_of_odd_rows(docs):
    assert neardup.classes(docs([])).count() == 0
    text = "a b c d e f g h i j"
    found = neardup.classes(docs([text, text, text, "z"], ids=[None, 4, 4, None])).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in found) == [(-1, -1), (-1, 4), (4, 4), (4, 4)]
    assert sorted(r["doc_id"] or -1 for r in neardup.keep_one(docs([text, text, text, "z"], ids=[None, 4, 4, None])).collect()) == [-1, -1, 4]


# --- decontamination

@pytest.fixture(scope="module")
def benchmark(spark, prose):
    items = [prose(random.Random(k).randrange(15, 60), 300 + k) for k in range(20)]
    return spark.createDataFrame([*enumerate(items), (98, None), (99, "")], "item_id long, text string"), items


def test_decontamination(docs, prose, benchmark):
    items, texts = benchmark
    rng = random.Random(4)
    planted, rows = {}, []
    for k in range(120):
        words = prose(rng.choice([30, 300, 900]), 5000 + k).split()
        if k % 3 == 0:
            item = rng.randrange(20)
            said = texts[item].split()
            if k % 2:  # reworded: one word in seven is another
                said = [w if rng.randrange(7) else "other" for w in said]
            at = rng.randrange(len(words))
            words[at:at] = said
            planted[k] = item
        rows.append(" ".join(words))
    rows += [None, "", "...", texts[0]]
    planted[len(rows) - 1] = 0
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(rows), items).collect()}
    assert found == set(planted.items())
    kept = decontaminate.keep_clean(docs(rows), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(len(rows))) - set(planted))
    assert kept.columns == docs(rows).columns


def test_decontamination_of_reworded_and_short_items(docs, prose, spark):
    rng = random.Random(9)
    texts = [prose(n, 9000 + k) for k, n in enumerate([46] * 12 + [8, 9, 10, 12] * 3)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows, planted = [], set()
    for k in range(240):
        item = k % len(texts)
        said = texts[item].split()
        for at in rng.sample(range(len(said)), int(0.28 * len(said))):
            said[at] = "other" + str(rng.randrange(1000))
        words = prose(200, 20000 + k).split()
        at = rng.randrange(150)
        words[at:at] = said
        rows.append(" ".join(words))
        planted.add((k, item))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(rows), items).collect()}
    held = {  # exhaustive: every stretch a quarter longer than the item
        (k, i)
        for k, row in enumerate(rows)
        for i, text in enumerate(texts)
        if (k, i) in planted
        or (len(set(text.split()) & set(row.split())) >= 0.7 * len(set(text.split())) and _held(text.lower().split(), row.lower().split()))
    }
    print("recall", len(found & held) / len(held))
    assert found <= held
    assert len(found & held) >= 0.95 * len(held)


def _held(item, words):
    bits, width = decontaminate._bits(item), len(item) + max(4, len(item) // 4)
    return any(decontaminate.common_subsequence(bits, len(item), words[s : s + width]) >= 0.7 * len(item) for s in range(len(words)))


def test_basis_covers_all_documents(docs, prose):
    texts = [prose(30, 40000 + k) for k in range(1500)]
    idf = np.ones(decontaminate.TERMS)
    rows = np.zeros((len(texts), decontaminate.TERMS))
    for k, text in enumerate(texts):
        np.add.at(rows[k], decontaminate.term_ids(text), 1.0)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    basis = decontaminate.latent_basis(docs(texts), docs([]), idf)
    # a column's length is one over its eigenvalue
    assert 1 / np.linalg.norm(basis[:, 0]) == pytest.approx(np.linalg.eigvalsh(rows @ rows.T)[-1], rel=0.02)


def test_products_of_passages_match_matrices_and_fetch_few_rows_at_a_time():
    rng = np.random.default_rng(4)
    table = rng.normal(size=(decontaminate.TERMS, 144)).astype(np.float32)
    room = np.empty((2 * decontaminate._ROOM, 144), np.float32)
    total, wanted = np.zeros_like(table), np.zeros(table.shape)
    for few, most in ((decontaminate.TERMS, 32), (40, 9), (decontaminate.TERMS, 1)):
        # passages of any number of cells; terms that many, some or no passages share
        cells = [np.unique(rng.integers(0, few, rng.integers(1, most + 1))) for _ in range(decontaminate._FIT_ROWS)]
        passage, term = np.repeat(np.arange(len(cells)), list(map(len, cells))), np.concatenate(cells)
        weight = rng.random(len(term)).astype(np.float32)
        matrix = np.zeros((len(cells), decontaminate.TERMS))
        matrix[passage, term] = weight
        wanted += matrix.T @ (matrix @ table)
        tracemalloc.start()
        decontaminate._add_products(total, passage, term, weight, table, room)
        # less than a row of the table for each cell
        assert most < 32 or tracemalloc.get_traced_memory()[1] < len(term) * table.shape[1] * table.itemsize
        tracemalloc.stop()
    assert np.allclose(total, wanted, rtol=1e-3, atol=1e-3)


def test_decontamination_of_nothing(docs, benchmark):
    items, _ = benchmark
    assert decontaminate.contaminated(docs([]), items).count() == 0
    assert decontaminate.contaminated(docs(["x"]), items.limit(0)).count() == 0
    assert decontaminate.keep_clean(docs(["x"]), items.limit(0)).count() == 1


def test_answers_and_subsequences():
    item = decontaminate.Item.of(1, "What is the capital of the garden land? Silver Harbour")
    assert item.answer == (b"silver", b"harbour")
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_subsequence(decontaminate._bits(a), len(a), b) == table[-1, -1]


def test_words_across_pieces(monkeypatch):
    text = "Alpha beta, gamma_1 " * 9 + "ÉTÉ x"
    whole = decontaminate.words_of(text)
    assert whole == [w.encode() for w in text.lower().replace(",", "").split()]
    ids = decontaminate.term_ids(text)
    monkeypatch.setattr(decontaminate, "_PIECE", 24)
    assert decontaminate.words_of(text) == whole and (decontaminate.term_ids(text) == ids).all()


# --- archives

def test_loser_tree_merges_sorted_runs():
    rng = random.Random(1)
    for k in range(12):
        runs = [sorted((rng.randrange(40), i, j) for j in range(rng.randrange(25))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda e: e)) == sorted(sum(runs, []))


def test_archives_round_trip(spark):
    big, other = "q" * 2000, "é" * 900
    rows = [
        (1, "http://a.com:80/x#f", big), (2, "http://b.org/", big), (3, "HTTP://B.org/z", other), (4, "u\r\nx", None), (5, None, "a\r\n\r\nWARC/1.1"),
        (6, "http://c/", "short"), (7, "http://c/", "short"), (8, "http://b.org/z", other), (8, "http://b.org/z", other), (None, "http://x/", big), (9, "http://y/", "w" * 200_000),
    ]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, digest string")
    found = warc.round_trip(pages).collect()
    largest = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 1000:
            largest[html] = max(page, largest.get(html, page))
    expected = []
    for page, _, html in rows:
        data, first = (html or "").encode(), largest.get(html)
        revisit = first is not None and first != page
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in found))) == sorted(map(repr, expected))
    history = [(r["url_key"], r["captured"]) for r in found]
    assert history == sorted(history)
    assert warc.round_trip(pages.limit(0)).count() == 0


# --- neighbours

def test_neighbours_with_production_parameters(spark):
    """Few candidates, and vectors whose squares over- or underflow."""
    rng = np.random.default_rng(8)
    few = [(k, rng.standard_normal(64).tolist()) for k in range(15)]
    table = spark.createDataFrame(few, "vec_id long, embedding array<double>")
    found = neighbours.search(table, table.where("vec_id % 20 = 0")).orderBy("rank").collect()
    x = np.array([v for _, v in few])
    exact = sorted(range(1, 15), key=lambda k: (-(x[0] * x[k]).sum(), k))
    assert [r["vec_id"] for r in found] == exact and [r["rank"] for r in found] == list(range(1, 15))
    odd = [(0, [1e-200] * 4), (1, [1e200] * 4), (2, [1.0, 2.0, 3.0, 4.0]), (3, [-1e200] * 4), (4, [0.0] * 4), (20, [1e200] * 4)]
    table = spark.createDataFrame(odd, "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.search(table, table.where("vec_id % 20 = 0")).orderBy("rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert [v for v, _ in found[0]] == [1, 20, 2, 3] and [v for v, _ in found[20]] == [1, 2, 0, 3]
    assert found[20][0][1] == float("inf") and found[20][-1][1] == float("-inf")


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 24))
    vectors = [(i, (centres[i % 8] + rng.standard_normal(24)).tolist()) for i in range(800)]
    vectors += [(800 + i, vectors[0][1]) for i in range(300)]  # one vector many times
    bad = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] + [1.0] * 23), (2060, [None] + [1.0] * 23), (2080, [float("inf")] + [1.0] * 23), (2100, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors + bad], "vec_id long, embedding array<double>, bucket string")
    found = {}
    for r in neighbours.search(table, table.where("vec_id % 20 = 0"), probes=24).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
    queries = [i for i in ids if i % 20 == 0]
    assert set(found) == set(queries)
    hits = 0
    for q in queries:
        score = (x * x[np.searchsorted(ids, q)]).sum(axis=1)
        score[ids == q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        ranked = [found[q][k] for k in range(1, 21)]
        assert ranked == sorted(ranked, key=lambda r: (-r[1], r[0]))
        hits += len({r[0] for r in ranked} & set(ids[best].tolist()))
    assert hits >= 0.9 * 20 * len(queries)
    # the copies of vector 0 tie: the smallest ids come first
    assert [found[0][k][0] for k in range(1, 4)] == [800, 801, 802]
    assert neighbours.search(table.limit(0), table).count() == 0
    few = table.where("vec_id < 5")
    assert neighbours.search(few, table.where("vec_id = 0"), probes=64).count() == 4


def test_neighbours_of_short_tables_and_outlying_norms(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((21, 100))
    few = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = neighbours.search(few, few).groupBy("query_id").count().collect()
    assert sorted((r["query_id"], r["count"]) for r in found) == [(i, 20) for i in range(21)]
    # one very long vector leaves the others' buckets as they are
    x = rng.standard_normal((1500, 100))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    norm = np.log2(np.linalg.norm(np.vstack([x, 1e6 * x[:1]]), axis=1))
    bands = neighbours.band_of(norm, float(norm.max()))
    assert bands[-1] == 0 and bands[:-1].min() > 0
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*x, 1e6 * x[0]])], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(table, table.where("vec_id between 1 and 40")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(1, 41):
        score = np.append(x @ x[q], 1e6 * x[0] @ x[q])
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 20 * 40


# --- URL rules

def test_url_parts(spark):
    given = ["http://A.Org/x?y#z", "https://b.com?q", "x://c#f/", "nothing", None, "http://d.e/p://q/r", "://h/"]
    found = [tuple(r) for r in spark.createDataFrame([(u,) for u in given], "u string").select(urls.host_of(F.col("u")), urls.path_of(F.col("u"))).collect()]
    assert found == [("a.org", "/x"), ("b.com", ""), ("c", ""), ("", ""), ("", ""), ("d.e", "/p://q/r"), ("h", "/")]


def test_url_verdicts(spark):
    canonical = "<html><link rel='canonical' href='{}'></html>"
    rows = [
        (1, "http://a.net/x", canonical.format("http://b.com/de/y")), (2, "http://b.com/de/y#q", None), (3, "http://c.net/", '<meta http-equiv=refresh content="0; url=/z">'),
        (4, "https://C.net/z", "<LINK HREF=http://d.org/ok REL=canonical>"), (5, "http://d.org/ok", ""), (6, None, None), (7, "nourl", canonical.format("http://b.com/de/y")),
        (8, "http://e.net/q", canonical.format("//b.com/de/y")), (9, "http://x.example.org/en/12", ""), (10, "HTTP://org?x", ""), (11, "http://c.net/q", canonical.format("http://b.com/de/w") + canonical.format("/z")),
        (12, "http://b.com/de/w", ""), (13, "http://f.net/", canonical.format("http://zz.com/de/1")), (13, "http://f.net/", "plain"), (14, "http://example.org/es/a", ""), (15, "http://notexample.org/es/", ""),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, verdict string")
    found = sorted(((r["page_id"], r["rule"], r["verdict"]) for r in urls.verdicts(pages).collect()), key=lambda r: r[0])
    assert found == [
        (1, None, "block"), (2, "com/de/", "block"), (3, None, "allow"), (4, None, "allow"), (5, "org/", "allow"), (6, None, "allow"), (7, None, "allow"), (8, None, "block"),
        (9, "example.org/en/1", "block"), (10, None, "allow"), (11, None, "allow"), (12, "com/de/", "block"), (13, None, "block"), (13, None, "block"), (14, "example.org/es/", "block"), (15, "org/", "allow"),
    ]
    log = spark.createDataFrame([("http://g.net/", "http://b.com/de/y")], "src string, dst string")
    moved = spark.createDataFrame([(1, "http://g.net/", None)], "page_id long, url string, html string")
    assert urls.verdicts(moved, redirects=log).first()["verdict"] == "block"
    assert urls.verdicts(pages.limit(0)).count() == 0


# --- the pipeline

def test_pipeline(spark, docs, prose, benchmark, tmp_path):
    import corpus_pipeline

    items, said = benchmark
    texts = [prose(100, 7000 + k) for k in range(200)]
    toxic = {k for k in range(0, 200, 4)}
    texts = [t + " zargle blorf zargle" if k in toxic else t for k, t in enumerate(texts)]
    texts += [texts[1], texts[2] + " more", prose(50, 1) + " " + said[3], prose(60, 2) + " token=abcdefghijkl12345", None, ""]
    docs(texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # out: the toxic, the copies (200, 201), the benchmark passage (202), the second empty text (205)
    assert set(found) == (set(range(200)) - toxic) | {203, 204}
    assert found[204] == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "bpe"]


def test_relative_links(spark):
    base = "http://h.com/dir/p?x=1"
    cases = {
        "?y=2": "http://h.com/dir/p?y=2", "../q": "http://h.com/q", "./q": "http://h.com/dir/q", "q/../r?a/../b": "http://h.com/dir/r?a/../b", "/a/./b/..": "http://h.com/a/",
        "../../../z": "http://h.com/z", "//o.org/x": "http://o.org/x", "HTTPS://o.org/x": "HTTPS://o.org/x", "javascript:go()": None, "mailto:a@b.c": None, "#top": None, "": None, "q": "http://h.com/dir/q",
    }
    rows = spark.createDataFrame([(t, base) for t in cases], "target string, base string")
    found = {r["target"]: r["found"] for r in rows.withColumn("found", urls._absolute(F.col("target"), F.col("base"))).collect()}
    assert found == cases
    assert spark.createDataFrame([("q", "http://h.com")], "t string, b string").select(urls._absolute(F.col("t"), F.col("b"))).first()[0] == "http://h.com/q"


def test_aliases_match_a_search_of_the_graph(spark):
    rng = random.Random(12)
    hosts = ["a.example.org", "b.net", "c.com", "d.org"]
    name = lambda: f"http://{rng.choice(hosts)}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.randrange(6)}"
    pages = [(k, name(), "" if rng.random() < 0.4 else f'<link rel="canonical" href="{name()}">') for k in range(150)]
    edges, known = {}, {}

    def rule(url):
        host, path = url.split("://")[1].split("/", 1)
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        return max(fits, key=lambda r: (len(r.name), r.verdict == "allow")) if fits else None

    for _, url, html in pages:
        known[url] = rule(url)
        if html:
            to = html.split('"')[3]
            known[to] = rule(to)
            edges.setdefault(url, set()).add(to)
            edges.setdefault(to, set()).add(url)
    expected = {}
    for k, url, _ in pages:
        seen, queue = {url}, [url]
        while queue:
            more = edges.get(queue.pop(), set()) - seen
            seen |= more
            queue += more
        own = known[url]
        said = {known[u].verdict for u in seen if known[u]}
        expected[k] = own.verdict if own else "block" if said == {"block"} else "allow"
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in urls.verdicts(table).collect()} == expected
