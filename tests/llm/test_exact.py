"""Operators against plain Python on awkward texts."""

import hashlib
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracefold.llm import chat, decontaminate, fmindex, graph, licenses, permutation, pieces, sharding, simhash, substring, textblocks, tokenfile

BPE, SP = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACES = rb"[^\x20\x09-\x0D]+"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def split(text):
    return re.findall(SPACES, (text or "").encode())


def brute_repeats(rows, length):
    order = sorted({r[0] for r in rows if r[0] is not None})
    rank = {k: i for i, k in enumerate(order)} | {None: len(order)}
    first = {}
    for key, text in rows:
        w = split(text)
        for i in range(len(w) - length + 1):
            window = tuple(w[i : i + length])
            first[window] = min(first.get(window, len(order)), rank[key])
    out = []
    for key, text in rows:
        w, gone = split(text), set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < rank[key]:
                gone.update(range(i, i + length))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length", [31, 50])
def test_substring(docs, rows, length):
    found = substring.remove_repeats(docs, length=length, carry=["lang", "id"], spans=True).collect()
    assert Counter((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == brute_repeats(rows, length)
    texts = Counter(rows)
    for r in found:
        assert r["carry_lang"] == "en" and r["carry_id"] == 0
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert len(split(r["clean"])) == r["n_words"] - r["n_removed"]
        if not r["n_removed"]:
            assert (r["id"], r["clean"]) in texts


def test_kept_words_take_little_memory():
    rng = np.random.default_rng(8)
    texts = [None, "", " \t", *(" " * (k % 3) + "  ".join(f"w{x}é" for x in rng.integers(0, 10**6, 300)) for k in range(1200)), None, "  x "]
    block = substring._Block(pa.table({"id": range(len(texts)), "text": pa.array(texts)}), 50, 16)
    gone = rng.random(len(block.doc)) < 0.4
    gone[block.doc == 9] = True
    assert len(block.body) > 3 * textblocks.PIECE_BYTES
    tracemalloc.start()
    found = [hashlib.sha256(t).digest() for t in block.kept(gone)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [hashlib.sha256(b" ".join(w for w, g in zip(split(t), gone[a:b]) if not g)).digest() for t, a, b in zip(texts, block.firsts[:-1], block.firsts[1:])]
    assert peak < 10 * len(block.body)


def test_rows_that_repeat_are_spread(spark):
    passage = " ".join(f"r{k}" for k in range(60))
    many = spark.range(1, 601, 1, 12).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 10).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(passage)).otherwise(F.concat(F.lit("x "), F.lit(passage))).alias("text"))
    blocks = many.where("doc_id = 7").select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(48)).alias("b")).distinct().count()
    assert blocks > 6
    found = substring.remove_repeats(many).groupBy("n_words", "n_removed").count().collect()
    assert sorted(tuple(r) for r in found) == [(60, 0, 200), (61, 60, 1), (61, 61, 399)]


def test_a_hot_component(spark):
    edges = spark.createDataFrame([(k, 0) for k in range(1, 5000)] + [(k, k + 1) for k in range(6000, 6040)], "a long, b long")
    assert graph.components(edges).groupBy("root").count().orderBy("root").collect() == [(0, 5000), (6000, 41)]
    told = graph.with_least(edges.withColumn("v", -F.col("a")), "b", "v", "least")
    assert told.where("b = 0 AND least <> -4999").count() == 0 and told.count() == 5039
    places = edges.where("b = 0").groupBy(F.pmod(F.xxhash64("a", "b"), F.lit(graph.SALTS))).count()
    assert max(r["count"] for r in places.collect()) < 5000 / 30


def test_cover_is_a_difference_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_sharding(docs, rows):
    weights = [1.0, 2.0, 1.0, 4.0]
    found = sharding.shard_rows(docs, weights).collect()
    assert Counter((r["key"], r["size"], r["text_crc32"]) for r in found) == Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
    for shard in range(4):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in found)
    assert len({(r["key"], r["shard"]) for r in found}) == len({r["key"] for r in found})


def test_shards_follow_weights(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    counts = {r["shard"]: r["count"] for r in sharding.shard_rows(keys, [1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(counts[1] / 20_000 - 0.75) < 0.02


def shingles(text, size):
    w = split((text or "").encode().translate(LOWER).decode())
    return [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def fingerprint(text, size):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, size)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_simhash(docs, rows):
    prints = [fingerprint(t, 4) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = groups(near, range(len(rows)))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root[i]] = min(least.get(root[i], key), key)
    want = Counter((key, prints[i], least.get(root[i])) for i, (key, _) in enumerate(rows))
    assert Counter((r["id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_copies(docs).collect()) == want


def linked(fps, groups=None):
    refs, own = simhash.references(groups or simhash.groups_for(len(fps), 4))
    found = []
    for keys in simhash.cells(simhash.distances(fps, refs), own, 4):
        a, b = simhash.links_within(keys, fps[:, None], fps, refs[::-1, None], 4)
        found += list(zip(a.tolist(), b.tolist()))
    return found


@pytest.mark.parametrize("groups", [6, 8])
def test_cells_of_the_pivot_table(groups):
    rng = np.random.default_rng(groups)
    fps = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    refs, own = simhash.references(groups)
    table = simhash.distances(fps, refs)
    assert table.tolist()[5][:20] == [int(f ^ refs[5]).bit_count() for f in fps[:20]]
    keys = simhash.cells(table, own, 4)
    for k in range(1, 5):  # whatever 4 bits change, a cell stays
        other = fps.copy()
        for _ in range(k):
            other ^= np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64)
        assert (simhash.cells(simhash.distances(other, refs), own, 4) == keys).any(0).all()
    # without references all are in one cell; with them few unrelated ones share one
    assert len(np.unique(simhash.cells(table[:1].repeat(65, 0), own, 4)[0])) == 1
    assert len(np.unique(keys[0])) > 2900
    assert not linked(fps, groups)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 120), st.sampled_from([1, 3, 200]), st.integers(0, 5))
def test_links_have_the_components_of_all_pairs(seed, n, centres, flips):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2**63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        fps ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    fps = np.unique(fps)
    found = linked(fps)
    want = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    assert {tuple(sorted(p)) for p in found} <= {tuple(sorted(p)) for p in want}
    assert groups(found, range(len(fps))) == groups(want, range(len(fps)))


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    pairs = chain + [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups(pairs, {n for p in pairs for n in p})
    assert got == {n: r for n, r in want.items() if n in got} and all(n in got or want[n] == n for n in want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    nodes, roots = graph.stars(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert dict(zip(nodes.tolist(), roots.tolist())) == {n: r for n, r in want.items() if n != r}


def test_one_of_each(docs):
    found = simhash.one_of_each(docs)
    assert found.columns == docs.columns
    assert Counter(r["doc_id"] for r in found.select("doc_id").collect()) == Counter([0, 3, 5, 6, 9, 10, 11, 12, 13, 14, 15, 16, None])


def test_candidates_let_go_of_their_shuffles(spark, monkeypatch):
    plans, alike = [], simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda pairs, *a, **b: (plans.append(pairs._jdf.queryExecution().executedPlan().toString()), alike(pairs, *a, **b))[1])
    assert simhash.one_of_each(pairs_of_texts(spark, 20, 20)).count() == 20
    assert len(plans) == 2 and not [p for p in plans if "Exchange" in p or "Arrow" in p]


def pairs_of_texts(spark, pairs, changed, n=180):
    """Ids 2k and 2k + 1 are texts of n shingles that differ in the last `changed` words; Jaccard (n - changed) / (n + changed)."""
    rows = []
    for k in range(pairs):
        own = [f"p{k}x{i}" for i in range(n + 4)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join([*own[: n + 4 - changed], *(f"q{k}x{i}" for i in range(changed))]))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_one_of_each_keeps_texts_below_the_similarity(spark):
    assert simhash.one_of_each(pairs_of_texts(spark, 150, 27)).count() == 300  # 153 of 207 shingles


def test_one_of_each_misses_no_pair_at_the_similarity(spark):
    assert simhash.one_of_each(pairs_of_texts(spark, 250, 20)).count() == 250  # 160 of 200 shingles, just 0.8


@pytest.mark.parametrize("run", [2, 64])
def test_prefixes_find_all_similar_sets(monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN", run)
    rng = np.random.default_rng(6)
    base = [rng.choice(400, rng.integers(1, 60), replace=False) for _ in range(30)]
    sets = [np.unique(np.concatenate([rng.permutation(x)[rng.integers(0, 1 + len(x) // 6) :], rng.integers(0, 400, rng.integers(0, 6))])).astype(np.uint64) for x in base for _ in range(8)] + [np.zeros(0, np.uint64)]
    at, ids = np.cumsum([0, *map(len, sets)]), np.arange(len(sets))
    common = [np.zeros(simhash.SLOTS // 8, np.uint8) for _ in range(2)]
    common[0][:50], common[1][::7] = 0x49, 0x81
    tokens, cuts = simhash.prefixes(np.concatenate(sets), at, common, 0.8)
    own, roots = np.repeat(ids, np.diff(cuts)), ids // 3
    a, b = simhash.sharing(tokens, np.diff(at)[own], np.arange(len(own)) - cuts[own], roots[own], 0.8)
    found = {(min(x, y), max(x, y)) for x, y in zip(own[a].tolist(), own[b].tolist())}
    bits = simhash.parities(np.concatenate(sets), at).view(np.uint64)
    want = [(i, j) for j in ids.tolist() for i in range(j) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])) > 0]
    assert len(want) > 40 and {p for p in want if roots[p[0]] != roots[p[1]]} <= found
    assert all(simhash.apart(bits[i], bits[j]) <= len(np.setxor1d(sets[i], sets[j])) for i, j in want)


def test_wide_fingerprints_follow_similarity():
    rng = np.random.default_rng(4)
    limit = simhash.reach(0.8)

    def bits(sets):
        lists = [" ".join(s) for s in sets]
        body, offsets = textblocks.flat(pa.array(lists))
        return simhash.wide_fingerprints(body, offsets, 1)

    for n in (2, 3, 4, 10, 200):
        own = [[f"{k}-{i}" for i in range(n)] for k in range(60)]
        fps = bits([*own, []])
        apart = [int(simhash.apart(fps[i], fps[j])) for i in range(61) for j in range(i)]
        assert min(apart) > limit
    for n in (40, 300):
        texts = [[f"{k}-{i}" for i in range(n)] for k in range(60)]
        near = [[f"new{k}-{i}" if i < n // 12 else w for i, w in enumerate(t)] for k, t in enumerate(texts)]  # similarity 0.85
        close = [int(simhash.apart(a, b)) <= limit for a, b in zip(bits(texts), bits(near))]
        assert np.mean(close) > 0.9
    keys = simhash.wide_keys(rng.integers(0, 2**63, (5, simhash.WORDS), dtype=np.uint64))
    assert keys.shape == (simhash.KEYS, 5) and len(np.unique(keys)) == keys.size


ITEMS = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "ONE"), (3, None), (4, " "), (None, "日本語 text here"), (5, "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "one"), (10, "two words")]
TEXTS = ["a w1 W2 w3,w4 w5 w6 w7 w8 w9 w10 w11 b one", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w9", "two\nwords two words", "日本語 text here", "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", None, ""]


def alnum(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def brute_marks(rows, items, size):
    phrases = {}
    for item, text in items:
        w = alnum(text)
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            phrases.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for key, text in rows:
        w, hit, named = alnum(text), set(), set()
        for i in range(len(w)):
            for n in {len(p) for p in phrases}:
                if tuple(w[i : i + n]) in phrases and i + n <= len(w):
                    hit.update(range(i, i + n))
                    named |= phrases[tuple(w[i : i + n])]
        out.append((key, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("size", [3, 10])
def test_decontamination(spark, docs, rows, size):
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, id int")
    more = docs.select("doc_id", "text", "id").unionAll(spark.createDataFrame([(100 + k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, id int"))
    found = decontaminate.mark(more, items, window=size, carry=["id"], clean=True).collect()
    assert Counter((r["id"], r["n_words"], r["n_hit"], len(r["items"]), r["items_sha256"]) for r in found) == brute_marks(rows + [(100 + k, t) for k, t in enumerate(TEXTS)], ITEMS, size)
    for r in found:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert len(alnum(r["clean"])) == r["n_words"] - r["n_hit"]
    assert decontaminate.mark(more, items.limit(0)).where("n_hit > 0").count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=200), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=6), min_size=1, max_size=8))
def test_fm_index(seq, phrases):
    index = fmindex.FMIndex(np.array(seq), 4)
    table = np.zeros((len(phrases), 6), np.int64)
    for k, p in enumerate(phrases):
        table[k, : len(p)] = p
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    for k, p in enumerate(phrases):
        want = [i for i in range(len(seq) - len(p) + 1) if seq[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def test_suffix_order():
    seq = np.array([2, 1, 2, 1, 2, 1] * 30 + [0])
    assert fmindex.suffix_array(seq, 2).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:].tolist())


def test_token_file(spark, docs, rows):
    from tokenizers import Tokenizer

    tokenizer, folder = Tokenizer.from_file(BPE), tokenfile.scratch(spark)
    tokenfile.write(docs, folder, BPE, 2)
    found = tokenfile.read(spark, folder, ids=True).orderBy("start").collect()
    assert [r["key"] for r in found] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    want = Counter((k, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for k, t in rows)
    assert Counter((r["key"], tuple(r["ids"])) for r in found) == want
    at = 0
    for r in found:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += len(r["ids"])


@given(st.lists(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]), max_size=9), max_size=6))
def test_segments_round_trip(lists):
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    ranks = np.array([x for own in lists for x in own], np.uint32)
    keys = np.arange(len(lists), dtype="<i8")
    image = tokenfile.segment(keys.tobytes(), len(lists) // 2, np.diff(at).astype("<i8").tobytes(), *tokenfile.pack(ranks, at))
    got_keys, nulls, got, got_at = tokenfile.read_segment(image)
    assert nulls == len(lists) // 2 and got_keys.tolist() == keys.tolist() and got.tolist() == ranks.tolist() and got_at.tolist() == at.tolist()
    for bad in (image[:-1], b"XXXX" + image[4:], image[:10]):
        with pytest.raises(ValueError):
            tokenfile.read_segment(bad)


ODD = st.text(st.one_of(st.sampled_from(list("abIÉß' \n\t.,<|>09\x0b\x85 ́日ª")), st.characters(exclude_categories=["Cs"])), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=4))
def test_tokens_are_the_library_s(texts):
    from tokenizers import Tokenizer

    ids, at = tokenfile.encoder(BPE).encode(pa.array(texts))
    tokenizer = Tokenizer.from_file(BPE)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


MODEL = sentencepiece.SentencePieceProcessor(model_file=SP)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(ODD, st.lists(st.sampled_from(["the", " ", "  ", "ing", "    ", "hello", "tion", "\n", "aaa"]), max_size=20).map("".join)), min_size=1, max_size=3))
def test_pieces_are_the_library_s(texts):
    own = pieces.batches(SP)
    ids, at = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == MODEL.encode(texts) == [own.pieces.encode(t) for t in texts]
    back = [t.decode() for t in own.decode(ids, at).to_pylist()]
    assert back == [t.replace(pieces.SPACE, " ") for t in texts] == [own.pieces.decode(i) for i in MODEL.encode(texts)]


def test_stream_commits_before_its_end():
    own = pieces.batches(SP).pieces
    pulled = 0

    def source():
        nonlocal pulled
        for c in "▁" + "abcdefghij" * 20_000:
            pulled += 1
            yield c

    stream = own.encode_stream(source())
    next(stream)
    assert pulled < 1000
    assert 1 + sum(1 for _ in stream) == len(MODEL.encode("abcdefghij" * 20_000))


def test_pieces_of_a_table(docs, rows):
    found = pieces.encode(docs, SP, carry=["text", "ids"])
    for r in found.collect():
        assert r["ids"] == MODEL.encode(r["carry_text"] or "") and r["n_ids"] == len(r["ids"]) and r["carry_ids"] is not None
        assert r["restored"] == (pieces.SPACE not in (r["carry_text"] or ""))
    back = pieces.decode(found, SP)
    assert Counter((r["id"], r["text"]) for r in back.collect()) == Counter((k, (t or "").replace(pieces.SPACE, " ")) for k, t in rows)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16))
    x[100:400] = x[50]
    vectors = [(i, x[i].tolist()) for i in range(900)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] * 16), (1200, [1.0] * 3), (None, [1.0] * 16)]
    found = permutation.nearest(spark.createDataFrame([(*r, 0, 0) for r in vectors], "vec_id long, embedding array<double>, id int, v int")).collect()
    assert {r["query_id"] for r in found} == set(range(0, 900, 50))
    norm, hits = np.linalg.norm(x, axis=1), 0
    for q in range(0, 900, 50):
        score = x @ x[q] / norm / norm[q]
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        best = [i for i in np.lexsort((np.arange(900), -np.round(score, 12))) if i != q][:5]
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert np.allclose([r["score"] for r in own], score[[r["vec_id"] for r in own]], rtol=1e-13)
        hits += len({r["vec_id"] for r in own} & set(best))
    assert hits >= 0.95 * 90
    assert [r["vec_id"] for r in found if r["query_id"] == 50] != [] and {r["vec_id"] for r in found if r["query_id"] == 50} == {100, 101, 102, 103, 104}
    again = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [1.0, 0.1]), (3, [1.0, 0.1]), (4, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in permutation.nearest(again).orderBy("rank").collect()] == [3, 3, 4]
    few = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1e-200, 0.0]), (2, [0.0, 1e200])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in permutation.nearest(few).orderBy("rank").collect()] == [(50, 1, 1, 1.0), (50, 2, 2, 0.0)]


def test_nearest_of_an_id_that_repeats(spark):
    rows = [(0, [1.0, 2.0])] * 8 + [(k, [1.0, 2.0]) for k in (101, 102, 103)] + [(k, [1.0, -float(k)]) for k in range(201, 205)]
    found = permutation.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, every=50)
    assert sorted(r["vec_id"] for r in found.where("query_id = 0").collect()) == [101, 102, 103]


def test_chat(spark):
    said = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", "Bye"), (1, 3, "ann", "Bye"), (2, 0, "system", "x"), (None, None, None, "lost")]
    df = spark.createDataFrame([(*r, 0, 0) for r in said], "conv_id long, turn long, role string, text string, d int, chunk int")
    found = chat.rotate(df).orderBy("dialogue", "perspective", "seq").collect()
    assert {(r["dialogue"], r["perspective"]) for r in found} == {(1, "ann"), (1, "bob"), (None, "unknown")}
    whole = "".join(r["rendered"] for r in found if r["dialogue"] == 1 and r["perspective"] == "ann")
    assert whole == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi <\\|end|><|end|>\n<|user name=bob|>\n<|end|>\n<|assistant|>\nBye<|end|>\n<|assistant|>\nBye<|end|>\n"
    assert [whole[r["mask_start"] : r["mask_end"]] for r in found if r["perspective"] == "ann" and r["mask_start"] is not None] == ["Hi <\\|end|><|end|>", "Bye<|end|>", "Bye<|end|>"]


def test_a_hot_dialogue_is_spread(spark):
    """A third of all messages in one dialogue, all at one turn, and one message that repeats: no task joins them all."""
    said = spark.range(0, 6000, 1, 8).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("conv_id"), F.lit(0).alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.when(F.col("id") % 6 < 3, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    found = chat.rotate(said).where("dialogue = 1").orderBy("perspective", "seq").collect()
    assert len(found) == 4002
    at = {"a": 0, "b": 0}
    for r in found:
        assert r["start"] == at[r["perspective"]] and (not at[r["perspective"]]) == (r["seq"] == 0)
        at[r["perspective"]] += len(r["rendered"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = said.repartitionByRange(50, "conv_id", "turn", "role", F.md5("text"), F.spark_partition_id()).groupBy(F.spark_partition_id()).count()
        assert max(r["count"] for r in parts.collect()) < 2000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_dialogues_in_chunks(spark):
    df = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.lit("word").alias("text"))
    at = {"a": 0, "b": 0}
    for r in chat.rotate(df).orderBy("perspective", "seq").collect():
        assert r["start"] == at[r["perspective"]] and r["turn"] == r["seq"]
        at[r["perspective"]] += len(r["rendered"])


@pytest.mark.parametrize("most", [licenses.BROADCAST_ROWS, 0])
def test_licenses(spark, monkeypatch, most):
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", most)
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 100)
    other = mit.upper().replace("COPYRIGHT (C) <YEAR> <OWNER>", "Copyright © 2020 Someone, Inc.\n(c) 2021 Else").replace("SUBLICENSE", "sub-license").replace(", ", " ,  ").replace("MIT LICENSE", "“MIT” Licence")
    texts = [mit, other, mit + " more", "text\n  released UNDER the mit licence \nmore\nLicensed under CC BY-NC 4.0", None, "", None, ""]
    df = spark.createDataFrame([(k % 7, t, 0, "") for k, t in enumerate(texts)], "doc_id long, text string, key int, license string")
    got = Counter((r["key"], r["license"], r["notices"]) for r in licenses.scan(df, licenses.known_digests(spark)).collect())
    assert got == Counter([(0, "MIT", None), (1, "MIT", None), (2, None, None), (3, None, "CC-BY-NC-4.0,MIT"), (4, None, None), (5, None, None), (6, None, None), (0, None, None)])


SHELF = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not SHELF.exists(), reason="no licence texts here")
def test_whole_licenses(spark):
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    rows, want = [], []
    for k, (file, name) in enumerate(names.items()):
        text = (SHELF / file).read_text()
        other = "Copyright (c) 2024 Somebody\nAll rights reserved.\n\n" + text.upper().replace("  ", " ").replace("LICENSE", "Licence")
        rows += [(10 * k, text), (10 * k + 1, other), (10 * k + 2, text + " and more"), (10 * k + 3, text[: len(text) // 2])]
        want += [(10 * k, name), (10 * k + 1, name), (10 * k + 2, None), (10 * k + 3, None)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_digests(spark))
    assert sorted((r["key"], r["license"]) for r in found.collect()) == sorted(want)


def test_short_licenses_wrapped_otherwise(spark):
    long = [(n, t) for n, t in licenses.KNOWN if len(t) > 300]
    assert {n for n, _ in long} >= {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense", "MIT-0", "Apache-2.0"}
    rows = [(k, "\n".join(textwrap.fill(p, 70, break_on_hyphens=False, break_long_words=False) for p in t.split("\n"))) for k, (_, t) in enumerate(long)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_digests(spark))
    assert {r["key"]: r["license"] for r in found.collect()} == {k: n for k, (n, _) in enumerate(long)}


def test_many_equal_rows_of_a_license(spark, monkeypatch):
    monkeypatch.setattr(licenses, "RUN", 7)
    df = spark.range(100).select(F.lit(1).alias("doc_id"), F.lit("Licensed under CC BY-NC 4.0.").alias("text"))
    found = licenses.scan(df, licenses.known_digests(spark)).collect()
    assert len(found) == 100 and {(r["license"], r["notices"]) for r in found} == {("CC-BY-NC-4.0", "CC-BY-NC-4.0")}


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    said = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    folder = tokenfile.scratch(spark)
    tokenfile.write(empty, folder, BPE, 2)
    for found in (
        substring.remove_repeats(empty, spans=True), sharding.shard_rows(empty, [1.0]), simhash.near_copies(empty), simhash.one_of_each(empty), decontaminate.mark(empty, items, clean=True),
        tokenfile.read(spark, folder), licenses.scan(empty, licenses.known_digests(spark)), permutation.nearest(vectors), chat.rotate(said), pieces.encode(empty, SP),
    ):
        assert found.count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("ab \n\té.")), max_size=12)), max_size=8))
def test_words(texts):
    body, offsets = textblocks.flat(pa.array(texts, pa.string()))
    starts, ends, firsts = textblocks.words(body, offsets, textblocks.NOT_SPACE)
    data = body.tobytes()
    assert [[data[starts[k] : ends[k]] for k in range(a, b)] for a, b in zip(firsts, firsts[1:])] == [split(t) for t in texts]
    joined, s, e = textblocks.joined(body, offsets, starts, ends, firsts)
    assert [joined[s[a] : e[b - 1]].tobytes() if b > a else b"" for a, b in zip(firsts, firsts[1:])] == [b" ".join(split(t)) for t in texts]
    hashes = textblocks.word_hashes(body, starts, ends)
    seen = {}
    for k in range(len(starts)):
        assert seen.setdefault(data[starts[k] : ends[k]], hashes[k]) == hashes[k]
    assert len(set(seen.values())) == len(seen)


def test_benchmarks_in_blocks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 64)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.mark(docs, items, window=3).collect()
    assert Counter((r["id"], r["n_words"], r["n_hit"], len(r["items"]), r["items_sha256"]) for r in found) == brute_marks(rows, ITEMS, 3)


def test_one_block_of_a_benchmark_in_memory():
    loaded = []

    class Stub:
        @property
        def value(self):
            if "_value" not in self.__dict__:
                self._value = object()
                loaded.append(self)
            return self._value

    blocks = [Stub() for _ in range(5)]
    for _ in range(2):
        for _ in decontaminate.each(blocks):
            assert sum("_value" in b.__dict__ for b in blocks) == 1
    assert len(loaded) == 10
    assert list(decontaminate.each(blocks[:1])) == list(decontaminate.each(blocks[:1]))


def recall(found, ids, x, asked):
    norm, hits = np.linalg.norm(x, axis=1), 0
    own = {q: set(g["vec_id"]) for q, g in found.groupby("query_id")}
    for q in asked:
        score = x @ x[q] / norm / norm[q]
        best = [ids[i] for i in np.lexsort((ids, -score))[:6] if i != q][:5]
        hits += len(set(best) & own[ids[q]])
    return hits / 5 / len(asked)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_recall_of_nearest(spark, size):
    folder = f"/root/testdata/{size}/embeddings.parquet"
    table = spark.read.parquet(folder).toPandas().sort_values("vec_id")
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    found = permutation.nearest(spark.read.parquet(folder)).toPandas()
    assert recall(found, ids, x, np.flatnonzero(ids % 50 == 0)) >= 0.9


@pytest.mark.parametrize("clusters", [0, 500])
def test_recall_on_many_vectors(spark, clusters):
    """50,000 vectors: at most a sixth are reranked, and a query reads an eighth of the postings."""
    n, d, every = 50_000, 32, 1000
    rng = np.random.default_rng(clusters)
    x = rng.normal(size=(n, d))
    if clusters:
        x = rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] + 0.3 * x
    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x.ravel()))})
    found = permutation.nearest(spark.createDataFrame(table), every=every).toPandas()
    assert recall(found, np.arange(n), x, np.arange(0, n, every)) >= 0.9

    pivots = x[rng.choice(n, permutation.PIVOTS, replace=False)]
    order = permutation.prefixes(x[:10_000], pivots)
    index, reads, reranked = permutation.InvertedFile(order, len(pivots)), [], []
    for q in range(0, 10_000, 500):
        close = index.closeness(order[q])
        want = int(np.ceil(permutation.SHARE * len(close)))
        reranked.append((close >= np.partition(close, len(close) - want)[len(close) - want]).mean())
        reads.append(sum(index.at[p + 1] - index.at[p] for p in order[q]) / len(index.vector))
    assert np.mean(reranked) < 1 / 6 and (clusters or np.mean(reads) < 0.15)
