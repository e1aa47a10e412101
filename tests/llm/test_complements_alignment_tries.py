"""Complement packing, alignment and conversation tries against brute force, over nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kvlake.llm import alignment, complement_packing, conversation_trie
from test_operators import P, documents, library_ids, mixed_texts, vocabulary

A, B, WORDS = (P.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json")) if P else ("", "", "")


def least(counts):
    """A lower bound on sequences."""
    capacity = len(counts) - 1
    return max(-(-int((counts * np.arange(capacity + 1)).sum()) // capacity), int(counts[capacity // 2 + 1 :].sum()))


@pytest.mark.parametrize("lengths", [[], [8], [1] * 17, [3, 3, 2], [5, 3, 6, 2, 4, 4, 7, 1], [5] * 7, [4, 4, 4], [6, 1, 1], [5, 1, 1, 1], [8, 8, 9]])
def test_plans_of_few_pieces(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=10)
    plan = complement_packing.planned(counts)
    assert Counter(n for times, own in plan for n in own * times) == Counter(lengths)
    assert all(sum(own) <= 9 and times > 0 for times, own in plan)


@pytest.mark.parametrize("shape", ["uniform", "short", "hot", "long tail"])
def test_plans_are_near_the_bound(shape):
    rng = np.random.default_rng(5)
    lengths = {"uniform": rng.integers(1, 513, 5000), "short": rng.integers(1, 60, 20000), "hot": np.r_[np.full(9000, 100), rng.integers(1, 513, 9000)], "long tail": np.minimum(512, rng.lognormal(4, 1.2, 20000).astype(int) + 1)}[shape]
    counts = np.bincount(lengths, minlength=513)
    plan = complement_packing.planned(counts)
    used = np.zeros(513, int)
    for times, own in plan:
        assert sum(own) <= 512
        np.add.at(used, own, times)
    assert (used == counts).all()
    assert sum(times for times, _ in plan) <= 1.01 * least(counts) + 1
    assert len(plan) < 512 * (1 + np.log(512))
    # the plan does not grow with the number of pieces
    assert len(complement_packing.planned(counts * 1000)) < 512 * (1 + np.log(512))


def test_fillings_are_exact_and_available():
    rng = random.Random(4)
    for _ in range(300):
        counts = np.array([0] + [rng.choice([0, 0, 1, 2]) for _ in range(24)])
        sums, gap = complement_packing.Sums(counts), rng.randrange(1, 24)
        got = sums.filling(gap)
        pool = [n for n, k in enumerate(counts.tolist()) for _ in range(min(k, 3))]
        possible = any(n == gap for n in pool) or any(pool[i] + pool[j] == gap for i in range(len(pool)) for j in range(i)) or any(pool[i] + pool[j] + pool[k] == gap for i in range(len(pool)) for j in range(i) for k in range(j))
        assert bool(got) == possible and (not got or sum(got) == gap and all(counts[n] >= k for n, k in Counter(got).items()))
        n = rng.choice([n for n in range(25) if counts[n]] or [0])
        if n:
            sums.take(n, int(counts[n]))
            there = np.flatnonzero(sums.there)
            want = np.bincount([x + y for x in there for y in there if x + y < 25], minlength=25)
            assert (sums.pairs == want).all()


@vocabulary
def test_complement_packing(spark):
    texts = mixed_texts(30) + ["many words of text " * 900] + ["same text again"] * 40
    ids = [None, *range(1, len(texts))]
    rows = complement_packing.packed(documents(spark, texts, ids), WORDS, capacity=256, end_id=1).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    lengths = []
    for i, t in zip(ids, texts):
        want, at = [*library_ids(t), 1], 0
        own = sorted(docs[i], key=lambda r: r["piece"])
        for k, r in enumerate(own):
            part = want[r["start"] : r["start"] + r["length"]]
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["length"] == 256 or k == len(own) - 1
            at += r["length"]
            lengths.append(r["length"])
        assert at == len(want)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= 256
    assert len(sequences) <= least(np.bincount(lengths, minlength=257)) + 1
    assert complement_packing.packed(documents(spark, ["a"]).limit(0), WORDS).count() == 0


def test_merge_path():
    rng = random.Random(8)
    for _ in range(200):
        end = rng.randrange(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, end + 1), rng.randrange(end)), end})) for _ in "ab")
        order = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        for steps in (1, 2, 5, 64):
            i, j = alignment.cuts(a, b, steps)
            assert [(x, y) for x, y in zip(i, j)] == [(sum(k == 0 for _, k in order[:d]), sum(k == 1 for _, k in order[:d])) for d in range(0, len(order), steps)]
            at_a, at_b = alignment.common_ends(a, b, steps)
            assert a[at_a].tolist() == b[at_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def brute_groups(text):
    va, vb = alignment.vocabularies(A, B)
    if not text:
        return []
    a, b = va.encode([text])[0], vb.encode([text])[0]
    if not b"".join(va.tokens[k] for k in a) == b"".join(vb.tokens[k] for k in b) == (" " + text).encode():
        return []
    ends = [np.cumsum([len(v.tokens[k]) for k in x]).tolist() for v, x in ((va, a), (vb, b))]
    out, i, j = [], 0, 0
    for e in sorted(set(ends[0]) & set(ends[1])):
        ni, nj = ends[0].index(e) + 1, ends[1].index(e) + 1
        out.append((a[i:ni], b[j:nj]))
        i, j = ni, nj
    return out


@vocabulary
def test_alignment(spark):
    texts = mixed_texts(25) + ["</s> <s> <unk> <0x41> <|endoftext|>", " ", "   x", "x   ", "a▁b", "\u0000", "😀" * 40]
    ids = [None, *range(1, len(texts))]
    docs = documents(spark, texts, ids)
    want = dict(zip(ids, map(brute_groups, texts)))
    assert want[texts.index("a▁b")] == [] and sum(map(bool, want.values())) > 30
    count = Counter((a[-1], b[-1]) for own in want.values() for a, b in own)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for r in alignment.alignment_counts(docs, A, B).collect():
        own = want[r["doc_id"]]
        ns = [count[a[-1], b[-1]] for a, b in own]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        assert (r["n_a"], r["n_b"]) == (sum(len(a) for a, _ in own), sum(len(b) for _, b in own))
        assert r["n_groups"] == r["n_links"] == len(own) and r["count_sum"] == sum(ns) and r["n_best"] == sum(n == most[b[-1]] for n, (_, b) in zip(ns, own))
        assert r["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if own else "")
    for r in alignment.groups(docs, A, B).collect():
        a, b = [0, *r["a_ends"]], [0, *r["b_ends"]]
        assert [(r["a_ids"][i:k], r["b_ids"][j:m]) for i, k, j, m in zip(a, a[1:], b, b[1:])] == want[r["doc_id"]]
    assert alignment.alignment_counts(docs.limit(0), A, B).count() == 0 == alignment.groups(docs.limit(0), A, B).count()


@vocabulary
def test_chunks_encoded_once_give_the_tokens_of_whole_texts(monkeypatch):
    va, vb = alignment.vocabularies(A, B)
    rng = random.Random(8)
    letters = "ab cdé  \n\t \u0085 \u3000'st 12!?.<|endoftext|>世界🙂\u0301Ünß▁\u180e\u200b \x1c\x7f_S "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000)] + ["a<|endoftext|> b <|endoftext|>", " ", "  ", "a ", "a  ", "", "▁ a b", " <unk> </s> <0x41> a"]
    texts += [" ".join(rng.choice(["once", "upon", "a", "time,", "it's"]) for _ in range(3000))]
    column = pa.array(texts)
    encoded, own = [], type(va).encode
    monkeypatch.setattr(type(va), "encode", lambda self, some: encoded.extend(some) or own(self, some))
    alignment.chunks.cache_clear()
    got = alignment.aligned(column, va, vb)
    alignment.aligned(column, va, vb)
    assert va.by_chunks and vb.by_chunks and sum(map(len, encoded)) < sum(map(len, texts))
    monkeypatch.setattr(alignment, "TIED", 3)
    monkeypatch.setattr(alignment, "REMEMBERED", 1000)
    alignment.chunks.cache_clear()
    parts = [alignment.aligned(column.slice(k, 150), va, vb) for k in range(0, len(column), 150)]
    monkeypatch.setattr(va, "by_chunks", False)
    want = alignment.aligned(column, va, vb)
    for c in ("a", "b", "many_a", "many_b", "link_a", "link_b"):
        assert np.array_equal(getattr(got, c), getattr(want, c))
    for c in ("a", "b", "many_a", "many_b"):
        assert np.array_equal(np.concatenate([getattr(x, c) for x in parts]), getattr(want, c))


@vocabulary
def test_pieces_of_a_long_text_are_stitched():
    va, vb = alignment.vocabularies(A, B)
    text = "Stitched groups über mehrere Stücke 数字 " * 300
    for steps in (1, 3, 256, 10**6):
        x = alignment.aligned(pa.array([text, "", text]), va, vb, steps)
        assert list(alignment._written(x))[0] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute_groups(text)).encode()


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, key, (role, text)))
    lists = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(lists):
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = tuple(lists.get(first, [])[:h] + lists[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def turns(spark, rows):
    """With a column that clashes with what the operator makes."""
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, path string").repartition(3)


def trie_rows(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


@pytest.mark.parametrize("limit", [1, 8, 4096])
def test_conversation_trie(spark, limit):
    rng = random.Random(11)
    rows = [(None, 1, "user", "no conversation"), (7, None, None, None), (7, None, "user", "null first"), (7, 0, "user", ""), (8, 1, "user", "a"), (8, 1, "user", "a"), (8, 1, "system", "tie"), (-25, 1, "user", "below zero"), (-20, 3, "user", "its first")]
    for c in range(20, 90):  # families, copies, a hot first turn, one long conversation
        kind = rng.randrange(4)
        for t in range(rng.randrange(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "You are\ta helper  of all" if t == 0 and kind < 3 else f"turn {t}" if kind == 0 else f"turn {rng.randrange(3)} é x" if kind < 3 else None))
    rows += [(200, t, "user", f"long {t}") for t in range(60)] + [(201, t, "user", f"long {t if t < 50 else 0}") for t in range(60)]
    got = conversation_trie.conversation_trie(turns(spark, rows), limit=limit)
    assert trie_rows(got) == brute_trie(rows)


def test_conversation_trie_of_copies_and_nothing(spark):
    rows = [(20 * c, t, "user", f"same words {t}") for c in range(40) for t in range(5)]
    assert trie_rows(conversation_trie.conversation_trie(turns(spark, rows), limit=4)) == brute_trie(rows)
    absent = [(41, 0, "user", "base is absent"), (41, 1, "user", "x")]
    assert trie_rows(conversation_trie.conversation_trie(turns(spark, absent))) == brute_trie(absent)
    assert conversation_trie.conversation_trie(turns(spark, rows).limit(0)).count() == 0


def test_member_hashes_over_many_chunks(spark):
    members = spark.createDataFrame([(bytes([k % 3 % 2]), c) for k, c in enumerate(range(-50, 400))], "key binary, conv_id long").repartition(5)
    want = {bytes([k]): hashlib.sha256(",".join(str(c) for n, c in enumerate(range(-50, 400)) if n % 3 % 2 == k).encode()).hexdigest() for k in (0, 1)}
    assert {bytes(r["key"]): r["ends"] for r in conversation_trie.member_hashes(members, chunk=10).collect()} == want
