"""Each operator against brute force or the library, over nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import pickle
import random
import time
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvlake.llm import graph_ann, jaccard_join, link_trust, packing, pieces, pretokens, quality, sharding, token_counts, topk_nra, toxicity

try:
    import public_tokenizers as P
except ImportError:  # tests that need a vocabulary are skipped
    P = None
BPE, MODEL = (P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")) if P else ("", "")
vocabulary = pytest.mark.skipif(P is None, reason="no vocabulary files")
ODD = [None, "", " ", "x", "Ünïcode ÉÀ ß it's we'LL don''t 12³ _a", "日本語 <|endoftext|> é", "a" * 300, "word " * 3000, "tab\tand\nline  two   blanks ", "\u0000\u0085 mixed ▁ ▁▁ 😀", "x" * 5000 + " y"]


def documents(spark, texts, ids=None):
    """Documents with a column that clashes with what operators make."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "s", 7) for i, t in zip(ids, texts)], "doc_id long, text string, n_tokens string, size int").repartition(3)


def mixed_texts(n=60):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of", "And"]
    out = ODD[:]
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))]
        out.append(" ".join(w))
        for _ in range(rng.randrange(3)):
            w = w[:]
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    return out + out[-5:]


def library_ids(text):
    return pretokens.tokenizer(BPE).encode(text or "", add_special_tokens=False).ids


@vocabulary
def test_token_counts(spark):
    texts = mixed_texts(10)
    got = {r["doc_id"]: r for r in token_counts.token_counts(documents(spark, texts), BPE).collect()}
    for i, t in enumerate(texts):
        n = len(library_ids(t))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)
    assert token_counts.token_counts(documents(spark, ["a"]).limit(0), BPE).count() == 0


@vocabulary
def test_packing(spark):
    texts = mixed_texts(20) + ["many words of text " * 4000]
    rows = packing.packed(documents(spark, texts), BPE, capacity=512, group=4096).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids, at = [*library_ids(t), 2], 0
        for r in sorted(docs[i], key=lambda r: r["start"]):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at & (at - 1) == 0 and at <= 512  # full, or a power of two
    assert packing.packed(documents(spark, ["a"]).limit(0), BPE).count() == 0


@vocabulary
def test_pieces(spark):
    texts = mixed_texts(10)
    docs = documents(spark, texts)
    library = pieces.vocabulary(MODEL).library
    ids = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, MODEL).collect()}
    assert all(ids[i] == library.encode(t or "") for i, t in enumerate(texts))
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()}
    assert all(back[i] == library.decode(ids[i]) for i in range(len(texts)))
    odd = spark.createDataFrame([(1, None), (2, [-5, 0, 10**6]), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pieces.decode(odd, MODEL).collect()} == {1: None, 2: "⁇  ⁇  ⁇ ", 3: ""}
    digest = {r["doc_id"]: r for r in pieces.piece_digests(docs, MODEL).collect()}
    assert all(digest[i]["n_pieces"] == len(ids[i]) and digest[i]["ids_crc32"] == zlib.crc32(np.array(ids[i], "<u4").tobytes()) for i in ids)


@vocabulary
def test_pieces_of_a_unigram_model(tmp_path):
    # the same pieces and scores, declared to be a unigram vocabulary, which is left to the library
    def number(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    def message(fields):
        return b"".join(number(f << 3 | (0 if isinstance(v, int) else 2)) + (number(v) if isinstance(v, int) else number(len(v)) + v) for f, v in fields)

    model = []
    for field, value in pieces._fields(pieces.vocabulary(MODEL).library.serialized_model_proto()):
        if field == 2:
            value = b"\x18\x01" + value + b"\x18\x01"  # the last value of a field counts
        model.append((field, value))
    path = str(tmp_path / "unigram.model")
    (tmp_path / "unigram.model").write_bytes(message(model))
    coder = pieces.Encoder(path)
    assert not coder.v.by_words and pieces.vocabulary(MODEL).by_words
    texts = [t or "" for t in mixed_texts(20)] + ["Some plain English sentences, and a few odd 数字 words."]
    ids, many = coder(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] == [coder.v.library.encode(t) for t in texts]


@vocabulary
def test_legal_pairs_are_those_merging_leaves_alone():
    v, rng = pieces.vocabulary(MODEL), np.random.default_rng(6)
    plain = np.flatnonzero((v.size[: v.pieces] < 4) & (v.rank[: v.pieces] < 4000))
    a, b = rng.choice(plain, 3000), rng.choice(plain, 3000)
    name = lambda k: v.library.id_to_piece(int(v.ids[k]))
    some = [k for k in range(3000) if name(a[k]).startswith("▁") and "▁" not in name(b[k])]
    legal = v.legal(a, b)
    assert all(legal[k] == (v.library.encode((name(a[k]) + name(b[k]))[1:]) == [v.ids[a[k]], v.ids[b[k]]]) for k in some)
    assert 10 < sum(legal[k] for k in some) < len(some)


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(texts, width, percent):
    sets, parent = [shingles(t, width) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, monkeypatch, width, percent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    texts = mixed_texts(50)
    got = jaccard_join.jaccard_components(documents(spark, texts), width, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, width, percent)


def test_jaccard_chains_and_odd_rows(spark):
    # near copies that drift: neighbours link, the ends don't, and all are one component
    w = [f"q{k}" for k in range(120)]
    chain = [" ".join(w[:k] + [f"z{j}" for j in range(k)] + w[k:]) if k else " ".join(w) for k in range(0, 12)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(documents(spark, chain)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(chain, 4, 85).items()}
    docs = documents(spark, ["a b c d e", "A b c d e", None, "other words in here now", "other words in here now"], [5, 3, 9, None, None])
    rows = sorted((r["doc_id"] or -1, r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect())
    assert rows == [(-1, None), (-1, None), (3, 3), (5, 3), (9, 9)]
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_jaccard_large_group(spark):
    # hundreds of near copies of one text, near the threshold to each other, in one large meeting
    rng = random.Random(9)
    base, copies = [f"b{k}" for k in range(90)], []
    for _ in range(400):
        w = base[:]
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        copies.append(" ".join(w))
    want = brute_components(copies, 4, 85)
    assert 10 < len({c for _, c in want.values()}) < 390
    got = jaccard_join.jaccard_components(documents(spark, copies)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_components_of_a_long_chain_take_few_steps(spark, monkeypatch):
    written, own = [], jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "stored", lambda df: written.append(df) or own(df))
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 400), (700, 900), (500, 500)], "a long, b long")
    got = {r["node"]: r["comp"] for r in jaccard_join.components(chain).collect()}
    assert got == {i: 0 for i in range(301)} | {400: 400, 700: 400, 900: 400, 500: 500}
    assert len(written) <= 5


@pytest.mark.parametrize("run", [3, 1 << 20])
def test_stars_join_what_edges_join(spark, monkeypatch, run):
    monkeypatch.setattr(jaccard_join, "RUN", run)
    rng = np.random.default_rng(4)
    edges = [tuple(x) for x in rng.integers(-60, 60, (90, 2)).tolist()]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = jaccard_join.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert {r["node"]: r["comp"] for r in got} == root


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 50, 2000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
        apart = int(np.bitwise_count(jaccard_join.bitmap(x) ^ jaccard_join.bitmap(y)).sum())
        assert 0 < apart <= len(np.setxor1d(x, y)) or not len(np.setxor1d(x, y))


def test_shards(spark):
    texts = ["copy of one text"] * 400 + mixed_texts(100)
    rows = sharding.shard_by_bytes(documents(spark, texts)).collect()
    total, sizes, slots, shards_of = 0, defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shards_of[t or ""].add(r["shard"])
    assert len(rows) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for s in shards_of.values()) <= 7
    assert sharding.shard_by_bytes(documents(spark, ["a"]).limit(0)).count() == 0
    even = [f"text number {k:04d}" for k in range(4000)]
    sizes = defaultdict(int)
    for r in sharding.shard_by_bytes(documents(spark, even)).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) <= 1.02 * min(sizes.values())
    same = defaultdict(int)  # one group of copies holds everything
    for r in sharding.shard_by_bytes(documents(spark, ["same"] * 2000)).collect():
        same[r["shard"]] += 1
    assert len(same) == 8 and max(same.values()) <= 1.1 * min(same.values())


def vectors(spark, n=700, dim=12):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(n, dim)).round(2)
    v[10:14] = v[0]  # ties
    v[20] = 2 * v[0]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows[5] = (5, None, 0)
    rows[6] = (6, [0.0] * dim, 0)
    rows[7] = (7, [None] + [1.0] * (dim - 1), 0)
    rows[8] = (8, [float("nan")] + [1.0] * (dim - 1), 0)
    rows[9] = (9, [float("inf")] + [1.0] * (dim - 1), 0)
    rows[50] = (50, [1.0, 2.0], 0)
    rows.append((None, [1.0] * dim, 0))
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int"), rows


def usable(rows, zero):
    return {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and (zero or any(v))}


def test_exact_top_products(spark, monkeypatch):
    monkeypatch.setattr(topk_nra, "SMALL", 200)
    monkeypatch.setattr(topk_nra, "ENTRIES", 16)
    df, rows = vectors(spark)
    x = {i: [int(np.floor(1024 * c)) for c in v] for i, v in usable(rows, True).items()}
    want = set()
    for q in (i for i in x if i % 100 == 0):
        s = sorted(((-sum(a * b for a, b in zip(x[q], x[c])), c) for c in x if c != q and len(x[c]) == len(x[q])))[:10]
        want |= {(q, k + 1, c, -p) for k, (p, c) in enumerate(s)}
    assert {tuple(r) for r in topk_nra.top_products(df).collect()} == want
    assert topk_nra.top_products(df.limit(0)).count() == 0


def test_graph_neighbours(spark, monkeypatch):
    monkeypatch.setattr(graph_ann, "SMALL", 300)
    df, rows = vectors(spark)
    x = usable(rows, False)
    cosine = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    want, got = {}, defaultdict(list)
    for q in (i for i in x if i % 50 == 0):
        want[q] = sorted(((-cosine(x[q], x[c]), c) for c in x if c != q and len(x[c]) == len(x[q])))[:5]
    for r in graph_ann.search(df).orderBy("query_id", "rank").collect():
        assert abs(r["score"] - cosine(x[r["query_id"]], x[r["vec_id"]])) < 1e-12
        got[r["query_id"]].append(r["vec_id"])
    hits = sum(len({c for _, c in want[q]} & set(got[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [c for c in got[0]][:5] == [10, 11, 12, 13, 20]
    assert graph_ann.search(df.limit(0)).count() == 0


def test_url_rules_and_trust(spark):
    link = '<a href="http://{}/x">x</a>'
    pages = [
        (1, "http://Sub.Example.COM/en/7?q", None), (2, "https://x.com/en/1", None), (3, "https://a.net/de/1#t", None), (4, "http://b.example.net/de/8", ""), (5, "https://c.org/es/", link.format("far.org")),
        (6, None, "x"), (7, "no scheme", "x"), (8, "https://far.org/fr/1", link.format("c.org")), (9, "https://good.net/de/2", link.format("friend.org")), (10, "https://friend.org/fr/", None), (11, "http://xcom/en/1", None), (12, "http://x.com", None),
    ]
    df = spark.createDataFrame([(*p, "v") for p in pages], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in link_trust.judged(df).collect()}
    assert got[1] == ("sub.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2][2:] == ("com/en/", "block") and got[3] == ("a.net", "/de/1", "net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("org/es/", "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][3] == "block"  # it links to a blocked host
    assert got[10][3] == "allow" and got[11][2:] == (None, "allow") and got[12] == ("x.com", "", None, "block")
    assert link_trust.judged(df.limit(0)).count() == 0


def labelled(spark, n=600):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(80)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 60))]
        toxic, junk = rng.random() < 0.25, rng.random() < 0.25
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "nasty"])
        text = " ".join(w)
        rows.append((i, text.upper().replace(" ", "!! ") if junk else text, "en"))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(n, None, "en"), (n + 1, "", "en"), (None, "w1 w2", "en"), (n + 2, "w3 " * 200_000, "en"), rows[0]]
    labels += [(n, None, None), (None, 1, 0), labels[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[1:] for r in labels if None not in r}, len(rows)


@pytest.mark.parametrize(("score", "at", "fold", "rest"), [(quality.quality_scores, 0, 3, 1), (toxicity.toxicity_scores, 1, 5, 0)])
def test_classifiers(spark, score, at, fold, rest):
    docs, labels, truth, n = labelled(spark)
    rows = score(docs, labels).collect()
    assert len(rows) == n and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % fold == rest for r in held)
    assert np.mean([r["predicted"] == truth[r["doc_id"]][at] for r in held]) > 0.97
    assert score(docs, labels.limit(0)).count() == n
    assert score(docs.limit(0), labels).count() == 0


@vocabulary
def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        left = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert left and left <= ids
        if name == "near_duplicates":
            rows = docs.collect()
            comp = brute_components([r["text"] for r in rows], 5, 80)
            least = defaultdict(list)
            for i, (_, c) in comp.items():
                least[c].append(rows[i]["doc_id"])
            assert left == {min(x) for x in least.values()}
        docs, ids = out.cache(), left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == ids


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    docs, labels, _, _ = labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    good, junk, vile = " ".join(f"w{k}" for k in range(40)), " ".join(f"W{k}!!" for k in range(40)), " ".join(["vile", "w1", "nasty", "w2", "vile", "w5"] * 4)
    new = [(None, junk), (None, vile), (9000, junk), (9000, good), (9001, vile), (9001, good + " w50")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "new") for i, t in new], docs.schema))
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.where("label = 'new'").collect()), key=str)
    by = lambda *gone: sorted((x for x in new if x[1] not in gone), key=str)
    assert left(corpus_pipeline.quality_stage(spark, docs, str(tmp_path))) == by(junk)
    assert left(corpus_pipeline.toxicity_stage(spark, docs, str(tmp_path))) == by(vile)


def test_one_row_per_component(spark):
    docs = documents(spark, ["a b c d e", "A b c d e", None, None, "other words in here now", "other words in here now", "two texts of one id", "quite another text of it"], [5, 3, 9, 9, None, None, 7, 7])
    kept = jaccard_join.one_row_per_component(docs)
    rows = sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect())
    assert kept.columns == docs.columns
    assert rows == [(-1, "other words in here now"), (3, "A b c d e"), (7, "quite another text of it"), (7, "two texts of one id"), (9, ""), (9, "")]
    assert jaccard_join.one_row_per_component(docs.limit(0)).count() == 0
    named = docs.withColumn("__row", F.lit("mine")).withColumn("__row_", F.lit(None).cast("string"))
    kept = jaccard_join.one_row_per_component(named)
    assert kept.columns == named.columns and {(r["__row"], r["__row_"]) for r in kept.collect()} == {("mine", None)} and kept.count() == 6


def test_shuffle_files_go_with_each_step(spark, monkeypatch):
    places = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {str(f) for d in places for f in Path(str(d)).rglob("shuffle_*")}
    left, own = [], jaccard_join.stored

    def stored(df):
        before, out, until = files(), own(df), time.time() + 5
        while (new := files() - before) and time.time() < until:  # executors remove them on their own time
            time.sleep(0.05)
        left.append(len(new))
        return out

    monkeypatch.setattr(jaccard_join, "stored", stored)
    texts = [" ".join(f"w{(k // 3) * 5 + j}" for j in range(60)) + f" end{k}" for k in range(60)]
    mine = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    assert jaccard_join.one_row_per_component(documents(spark, texts), 5, 80).count() < 60
    assert len(left) > 5 and not any(left)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == mine


def test_whole_sets_go_when_compared(spark, monkeypatch):
    sets, own = [], jaccard_join._full_sets
    monkeypatch.setattr(jaccard_join, "_full_sets", lambda *a: sets.append((x := own(*a)).inputFiles()) or x)
    texts = [" ".join(f"w{(k // 3) * 100 + j}" for j in range(60)) + f" end{k}" for k in range(9)]
    assert jaccard_join.one_row_per_component(documents(spark, texts), 5, 80).count() == 3
    assert sets and all(files and not any(Path(f.removeprefix("file:").replace("///", "/")).exists() for f in files) for files in sets)


def test_fits_take_one_row_of_a_labelled_id(spark, monkeypatch):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(["w1", "w2", "w3", "w4"]) for _ in range(20))
    rows = [(1, text()) for _ in range(300)] + [(i, text()) for i in range(2, 101) for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 101)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels, F.lit(True), 100).network.constant is None
    seen = []
    monkeypatch.setattr(toxicity, "Calibration", lambda x, y: seen.append(len(x)))
    toxicity.fit(docs, labels, F.lit(True), 100)
    held = spark.range(1, 101).where("pmod(xxhash64(id), 4) = 0").count()
    assert seen == [held]
    for target in ("quality", "toxic"):
        got = {r["doc_id"]: r["text"] for r in quality.labelled_texts(docs, labels, target, F.lit(True), 100).collect()}
        assert got == {i: max(t for k, t in rows if k == i) for i in range(1, 101)}


def test_distrust_over_a_long_chain(spark):
    link = '<a href="http://{}/x">x</a>'
    hosts = [f"h{k}.zz" for k in range(10)] + ["bad.org"]
    pages = [(k, f"http://{h}/", link.format(hosts[k + 1])) for k, h in enumerate(hosts[:-1])] + [(10, "http://bad.org/es/1", None), (11, "http://alone.zz/", None)]
    got = {r["page_id"]: r["verdict"] for r in link_trust.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: "block" for k in range(11)} | {11: "allow"}


def test_trust_scores_converge(spark):
    # random links of 30 hosts, some without out-links and one that many link to, against power iteration on the whole matrix
    rng = np.random.default_rng(4)
    links = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 24, 90), rng.integers(0, 30, 90)) if a != b} | {(a, 29) for a in range(12)})
    seeds = {"allow": {0: 0.75, 3: 0.25}, "block": {5: 0.5, 29: 0.5}}
    edges, want = [], {}
    for kind in seeds:
        m = np.zeros((30, 30))
        for a, b in links if kind == "allow" else [(b, a) for a, b in links]:
            m[b, a] += 1
        m /= np.maximum(m.sum(0), 1)
        edges += [(kind, f"h{a}", f"h{b}", float(m[b, a])) for b, a in zip(*np.nonzero(m))]
        start = np.array([seeds[kind].get(h, 0.0) for h in range(30)])
        x = start
        for _ in range(400):
            moved = link_trust.DAMPING * m @ x
            x = moved + (1 - moved.sum()) * start
        want |= {(kind, f"h{h}"): x[h] for h in np.flatnonzero(x)}
    edges = spark.createDataFrame(edges, "kind string, src string, dst string, weight double")
    rows = spark.createDataFrame([(k, f"h{h}", w) for k, own in seeds.items() for h, w in own.items()], "kind string, host string, weight double")
    got = {(r["kind"], r["host"]): r["score"] for r in link_trust._spread(edges, rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] / want[k] - 1) < 1e-4 for k in want)


def test_discounts():
    assert toxicity.discounts(0, 0, 0, 0) == [0, 0.75, 0.75, 0.75]
    y = 100 / 200
    assert toxicity.discounts(100, 50, 30, 20) == pytest.approx([0, 1 - 2 * y * 0.5, 2 - 3 * y * 0.6, 3 - 4 * y * 20 / 30])
    assert all(0 < d < k for k, d in enumerate(toxicity.discounts(10, 5, 1, 100)[1:], 1))  # no count is lost


def test_counts_reach_the_driver_packed(spark, monkeypatch):
    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 1 << 64, 25_000, np.uint64))
    n = rng.integers(0, 300, (2, len(keys)))
    rows = spark.createDataFrame(list(zip(rng.permutation(keys).view(np.int64).tolist(), *n.tolist())), "k long, n0 long, n1 long")
    by = {r["k"] % (1 << 64): (r["n0"], r["n1"]) for r in rows.collect()}
    monkeypatch.setattr(type(rows), "toArrow", lambda self: pytest.fail("all rows at once"))
    got, counts = toxicity.counted(rows, "k", "n")
    assert got.tolist() == keys.tolist() and counts.dtype == np.uint16
    assert list(zip(*counts.tolist())) == [by[k] for k in keys.tolist()]
    none, counts = toxicity.counted(rows.limit(0), "k", "n")
    assert len(none) == 0 and counts.shape == (2, 0)


def test_ratios_against_plain_counts(spark):
    # both classes' models word by word, from dictionaries
    rng = random.Random(21)
    fitted = [r["id"] for r in spark.range(1, 400).where("pmod(xxhash64(id), 4) != 0").limit(120).collect()]
    speech = {0: ["a", "b", "c", "d", "e", "f"], 1: ["a", "b", "c", "vile", "foul"]}
    rows = [(i, " ".join(rng.choice(speech[k % 2]) for _ in range(rng.randrange(1, 12)))) for k, i in enumerate(fitted)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(fitted)], "doc_id long, toxic int")
    models = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels, F.lit(True)).models
    models = pickle.loads(pickle.dumps(models))  # as workers get them
    triples = {(k % 2, u, v, w) for k, (_, t) in enumerate(rows) for u, v, w in zip(["", "", *t.split()], ["", *t.split()], t.split())}
    pairs = [defaultdict(int), defaultdict(int)]
    for c, _, v, w in triples:
        pairs[c][v, w] += 1
    words_ = [defaultdict(int), defaultdict(int)]
    for c in (0, 1):
        for _, w in pairs[c]:
            words_[c][w] += 1
    less = lambda counts: toxicity.discounts(*(sum(n == k for n in counts.values()) for k in range(1, 5)))
    d_word, d_pair = [less(x) for x in words_], [less(x) for x in pairs]
    every = [sum(x.values()) for x in words_]

    def p(c, w):
        over = lambda x: words_[c].get(x, 0) - d_word[c][min(words_[c].get(x, 0), 3)]
        spare = 1 - sum(map(over, words_[c])) / every[c]
        shared = sum(x.get(w, 0) for x in words_) / sum(every)
        return over(w) / every[c] + spare * (shared or 1e-9), spare

    def after(c, v, w):
        own = {x: n for (f, x), n in pairs[c].items() if f == v}
        if not own:
            return p(c, w)[0]
        all_of, n = sum(own.values()), own.get(w, 0)
        return (n - d_pair[c][min(n, 3)]) / all_of + sum(d_pair[c][min(x, 3)] for x in own.values()) / all_of * p(c, w)[0]

    text = "vile a b foul never f f a new vile"
    (_, w, doc), = toxicity._words([pa.record_batch({"text": pa.array([text])})])
    got = models.ratios(w, toxicity._before(w, doc, 1))
    for k, (v, x) in enumerate(zip(["", *text.split()], text.split())):
        rare = np.log(p(1, "")[1] / p(0, "")[1])
        alone, both = np.log(p(1, x)[0] / p(0, x)[0]) - rare, np.log(after(1, v, x) / after(0, v, x)) - rare
        m, n = sum(c.get(x, 0) for c in words_), sum(c.get((v, x), 0) for c in pairs)
        assert got[k] == pytest.approx(alone * m / (m + toxicity.WORD_TRUST) + (both - alone) * n / (n + toxicity.PAIR_TRUST), abs=1e-5)


def test_no_telling_word_is_cut_by_rank(spark):
    # 70,000 words in seven ordinary contexts each, and a toxic one in five
    rng = random.Random(11)
    many = [f"o{k}" for k in range(70_000)]
    fitted = [r["id"] for r in spark.range(1, 200).where("pmod(xxhash64(id), 4) != 0").limit(12).collect()]
    rows = [(i, " ".join(rng.sample(many, len(many)))) for i in fitted[:7]] + [(i, f"o{k} vile") for k, i in enumerate(fitted[7:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(k >= 7)) for k, i in enumerate(fitted)], "doc_id long, toxic int")
    models = toxicity.fit(docs, labels, F.lit(True)).models
    assert len(models.word) > 69_900
    (_, w, _), = toxicity._words([pa.record_batch({"text": pa.array(["vile"])})])
    assert w[0] in models.word


def test_quality_features(spark):
    vectors = np.ones((500, quality.DIM), np.float32)
    assert (quality.index_vectors(500) != 0).sum(1).tolist() == [quality.ENTRIES] * 500
    assert quality.pooled(vectors, np.array([1, 2]), np.array([0, 0]), 1).shape == (1, 2 * 32 + 3)
    # words of TEXTS labelled texts have numbers of their own, others share buckets
    known = quality.own_words(spark.createDataFrame([("a b b",), ("b c",), ("c d",), ("",)], "text string"))
    (_, w, _), = known([pa.record_batch({"text": pa.array(["b c a d e"])})])
    assert len(known.own) == 2 and sorted(w[:2]) == [0, 1] and (w[2:] >= 2).all() and known.many == 2 + quality.BUCKETS


def test_pooling_against_plain_sums():
    rng = np.random.default_rng(3)
    vectors, texts_ = rng.normal(size=(40, quality.DIM)).astype(np.float16), [[3, 3, 5, 7], [], [39], [1, 2, 1, 2, 2], list(range(40))]
    w, doc = np.concatenate([np.array(t, int) for t in texts_]), np.repeat(np.arange(5), [len(t) for t in texts_])
    got = quality.pooled(vectors, w, doc, 5)
    for x, t in zip(got, texts_):
        if not t:
            assert not x.any()
            continue
        v = vectors[t].astype(float)
        want = [*v.mean(0), *v.std(0), sum(a == b for a, b in zip(t, t[1:])) / len(t), len(set(t)) / len(t), np.log1p(len(t))]
        assert np.allclose(x, want, atol=2e-3)
    long = np.tile(np.array([4, 9, 9]), 60_000)  # worked on by its counts
    x, v = quality.pooled(vectors, long, np.zeros(len(long), int), 1)[0], vectors[[4, 9, 9]].astype(float)
    assert np.allclose(x, [*v.mean(0), *v.std(0), 60_000 / len(long), 2 / len(long), np.log1p(len(long))], atol=2e-3)


def test_sums_of_many_tasks_are_added_in_groups(spark, monkeypatch):
    monkeypatch.setattr(quality, "FAN", 1)
    docs = spark.createDataFrame([(k, "x y z") for k in range(20)], "doc_id long, text string").repartition(7)
    known = quality.own_words(spark.createDataFrame([("x y z",), ("x y z",)], "text string"))
    one = quality.word_vectors(docs.coalesce(1), known)
    assert np.array_equal(quality.word_vectors(docs, known), one) and one.any()


def test_word_vectors_sum_contexts(spark):
    docs = spark.createDataFrame([(1, "x y z"), (2, "z x"), (3, None)], "doc_id long, text string").repartition(2)
    known = quality.own_words(spark.createDataFrame([("x y z",), ("x y z",)], "text string"))
    (_, w, _), = known([pa.record_batch({"text": pa.array(["x y z"])})])
    i = quality.index_vectors(known.many).astype(float)
    x, y, z = (i[k] for k in w)
    got = quality.word_vectors(docs, known)
    for k, want in zip(w, (y + z + z, x + z, x + y + x)):
        assert np.allclose(got[k], want / np.linalg.norm(want), atol=1e-3)


@vocabulary
def test_null_ids_and_repeats(spark):
    texts, ids = ["same text here", "same text here", None, "", "other"], [1, 1, None, None, None]
    docs = documents(spark, texts, ids)
    for run, n in ((lambda d: token_counts.token_counts(d, BPE), 5), (sharding.shard_by_bytes, 5), (lambda d: pieces.encode(d, MODEL), 5), (lambda d: pieces.piece_digests(d, MODEL), 5), (lambda d: pieces.decode(pieces.encode(d, MODEL), MODEL), 5)):
        out = run(docs)
        assert out.count() == n and out.where("doc_id IS NULL").count() == 3 and run(docs.limit(0)).count() == 0
    packed = packing.packed(docs, BPE)
    assert packed.where("doc_id IS NULL").agg(F.sum("length")).first()[0] == 2 + len(library_ids("other")) + 1
    assert packed.where("doc_id = 1").agg(F.sum("length")).first()[0] == 2 * (len(library_ids("same text here")) + 1)
    digests = pieces.piece_digests(docs, MODEL).where("doc_id IS NULL").collect()
    assert all(r["round_trip"] for r in digests) and sorted(r["n_pieces"] for r in digests)[:2] == [0, 0]


def test_repeated_vector_ids(spark):
    # id 0 asks with its largest vector; all its rows are left out of its own candidates, other repeats are candidates each
    rows = [(0, [1.0, 0.0]), (0, [3.0, 1.0]), (0, [3.0, 1.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 5.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in topk_nra.top_products(df).orderBy("rank").collect()]
    k = 1024 * 1024
    assert got == [(1, 1, 6 * k), (2, 1, 6 * k), (3, 2, 5 * k), (4, 3, 4 * k)]
    near = graph_ann.search(df).orderBy("rank").collect()
    assert [r["vec_id"] for r in near] == [1, 1, 3, 2] and {r["query_id"] for r in near} == {0}


def test_lists_stop_early_on_clustered_rows(monkeypatch):
    monkeypatch.setattr(topk_nra, "ENTRIES", 64)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * (np.arange(16) < 3)  # few components tell
    x = topk_nra.whole_numbers(np.repeat(centres, 100, 0) * 4 + rng.normal(size=(4000, 16)) / 50)
    found, read = topk_nra.Lists(x).best(x[::500].astype(float), 10)
    for q, rows in zip(x[::500], found):
        score = x @ q
        assert set(np.flatnonzero(score >= np.sort(score)[-10])) <= set(rows.tolist())
    assert (read < 0.7 * x.size).all()


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], 0) for r in df.select("vec_id", "embedding").collect()]
    x = usable(rows, False)
    ids, m = np.array(list(x)), np.stack(list(x.values()))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = defaultdict(set)
    for r in graph_ann.search(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = m @ m[k]
        s[k] = -2
        hits, total = hits + len(got[ids[k]] & set(ids[np.argsort(-s, kind="stable")[:5]].tolist())), total + 5
    assert hits >= 0.95 * total


@vocabulary
def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    docs, labels, _, _ = labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(1, None, "x"), (None, None, None), (2, "", "x"), (3, "w1 w2 w3", None), (3, "w1 w2 w3", None)], docs.schema)).withColumns({"score": F.lit("own"), "prefix": F.lit(1), "n": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and out.where("score != 'own'").count() == 0, name
    left = corpus_pipeline.near_duplicate_stage(spark, odd, str(tmp_path))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in left.collect()) == [(-1, ""), (1, ""), (2, ""), (3, "w1 w2 w3")]
    packed = corpus_pipeline.packing_stage(spark, odd, str(tmp_path))
    whole = sum(len(library_ids(r["text"])) + 1 for r in odd.collect())
    assert packed.agg(F.sum("length")).first()[0] == whole and corpus_pipeline.packing_stage(spark, odd.limit(0), str(tmp_path)).count() == 0
