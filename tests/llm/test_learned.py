"""Toxicity, the pipeline, and every registered query against its SQL."""

import collections
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
import corpus_pipeline
from tracefold.llm import crf, queries, toxicity

TABLES = "documents embeddings benchmark labels conversations".split()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=1, max_size=6), st.lists(st.floats(-2, 2), min_size=3, max_size=3))
def test_marginals_are_those_of_all_paths(emission, transition):
    e, (t01, t10, t11) = np.array(emission), transition
    weight = {0: {0: 0.0, 1: t01}, 1: {0: t10, 1: t11}}
    total, one = 0.0, np.zeros(len(e))
    for path in range(1 << len(e)):
        states = [path >> k & 1 for k in range(len(e))]
        w = np.exp(sum(x for x, s in zip(e, states) if s) + sum(weight[a][b] for a, b in zip(states, states[1:])))
        total, one = total + w, one + w * np.array(states)
    first = np.zeros(len(e), bool)
    first[0] = True
    odds = crf.marginal_log_odds(crf.Chains(first), e, np.array(transition))
    assert np.allclose(1 / (1 + np.exp(-odds)), one / total, atol=1e-9)


def labelled(spark, n=400):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(n):
        w = ["".join("abcdefghij"[int(c)] for c in str(x)) for x in rng.integers(100, 400, 40)]
        bad = k % 4 == 0
        if bad:
            w[int(rng.integers(0, 40))] = rng.choice(["vileling", "vilest", "nastyish", "nastyo"])
        rows.append((k, " ".join(w) + ".", 0, 0))
        labels.append((k, int(bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, id int, y int"), spark.createDataFrame(labels, "doc_id long, toxic int, id int")


def test_toxicity_on_held_out_texts(spark):
    docs, labels = labelled(spark)
    scorer = toxicity.fit(docs, labels)
    found = {r["id"]: r for r in toxicity.score(docs, scorer, carry=["text", "y"]).collect()}
    held = [r["doc_id"] for r in docs.where(toxicity.held_out(docs["doc_id"])).collect()]
    assert len(held) > 40 and np.mean([(found[k]["score"] >= 0.5) == (k % 4 == 0) for k in held]) >= 0.97
    for r in found.values():
        for s in r["spans"]:
            assert r["carry_text"][s["start"] : s["end"]].startswith(("vile", "nasty"))


@pytest.mark.parametrize("size, recall, precision", [("sf0.01", 4 / 6, 1.0), ("sf0.1", 0.85, 0.94)])
def test_toxicity_on_held_out_labels(spark, size, recall, precision):
    """Labels are those of the driver; nothing of the held-out fifth is learned from."""
    folder = f"/root/testdata/{size}"
    found = queries.QUERIES["op8_toxicity"](spark, folder).where("held_out")
    rows = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").toPandas()
    hits = ((rows["predicted"] == 1) & (rows["toxic"] == 1)).sum()
    assert hits >= recall * (rows["toxic"] == 1).sum() and hits >= precision * (rows["predicted"] == 1).sum()
    assert abs(rows["score"].mean() - rows["toxic"].mean()) < 0.04  # scores are probabilities


def test_toxicity_of_awkward_rows(spark, docs, empty):
    train, labels = labelled(spark, 60)
    scorer = toxicity.fit(train, labels)
    found = toxicity.score(docs, scorer).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["id"] in (0, 1, 2)}) == 1
    assert toxicity.score(empty, scorer).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0")):
        flat = toxicity.score(docs, toxicity.fit(train, none)).collect()
        assert len({r["score"] for r in flat}) == 1 and 0 <= flat[0]["score"] <= 0.5
    assert toxicity.score(docs, toxicity.fit(empty, labels)).count() == docs.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name, tmp_path):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    queries.QUERIES[name](spark, sf_dir).write.parquet(f"{tmp_path}/out")
    want = con.sql(queries.ORACLE_SQL[name])
    got = con.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in want.columns)} FROM '{tmp_path}/out/*.parquet'")
    assert sorted(map(repr, got.fetchall())) == sorted(map(repr, want.fetchall()))
    assert [str(t) for t in got.types] == [str(t) for t in want.types]


def test_all_eleven_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_pipeline(spark, sf_dir):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "repeated passages", "benchmark passages", "token ids"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(out) < docs.count() and all(r["restored"] for r in out)
    assert len({r["doc_id"] for r in out}) == len(out)


def brute_near_copies(folder):
    """The least id of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets, same = [], {}
    for key, text in duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall():
        w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        own = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        if own not in same:
            same[own] = key
            sets.append(own)
    ids = [same[own] for own in sets]
    posts = collections.defaultdict(list)
    for k, own in enumerate(sets):
        for shingle in own:
            posts[shingle].append(k)
    root = list(range(len(sets)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for k, own in enumerate(sets):
        shared = collections.Counter(j for shingle in own for j in posts[shingle] if j < k)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(own) + len(sets[j]) - n):
                a, b = sorted((find(j), find(k)))
                root[b] = a
    return sorted(ids[k] for k in range(len(sets)) if find(k) == k)


@pytest.mark.parametrize("size, kept", [("sf0.01", 922), ("sf0.1", 9248)])
def test_near_copies_are_those_of_all_pairs(spark, size, kept):
    folder = f"/root/testdata/{size}"
    found = corpus_pipeline.near_copies(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    got = sorted(r["doc_id"] for r in found.select("doc_id").collect())
    assert len(got) == kept and got == brute_near_copies(folder)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_on_awkward_and_empty_tables(spark, sf_dir, docs, empty, stage):
    for table in (docs, empty):
        found = stage(spark, table, sf_dir)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert found.count() <= table.count()


def test_stages_catch_what_is_planted(spark, sf_dir):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 5000, n))
    item = duckdb.sql(f"SELECT text FROM '{sf_dir}/benchmark.parquet' ORDER BY item_id LIMIT 1").fetchall()[0][0]
    base, passage = text(300), text(60)
    words = base.split()
    words[50] = "edited"
    rows = [(1, base), (2, base), (3, " ".join(words)), (4, text(80) + " " + passage + " " + text(80)), (5, text(80) + " " + passage), (6, text(50) + " " + item + " " + text(50)), (7, text(40)), (8, "")]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_copies(spark, docs, sf_dir).collect()}
    assert sorted(near) == [1, 4, 5, 6, 7, 8] and near[7] == rows[6][1]
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, sf_dir).collect()}
    assert passage in cut[4] and passage not in cut[5] and len(cut[5].split()) == 80 and 2 not in cut and cut[7] == rows[6][1]
    clean = {r["doc_id"]: r for r in corpus_pipeline.benchmark_passages(spark, docs, sf_dir).collect()}
    assert item not in clean[6]["text"] and len(clean[6]["text"].split()) >= 100 and clean[6]["n_chars"] == len(clean[6]["text"]) and clean[1]["text"] == base


@pytest.mark.parametrize("missing", ["tracefold.llm", "xxhash", "corpus_pipeline"])
def test_entry_without_this_subpackage(missing):
    """In a process of its own, which can't import the subpackage, something that it needs, or the pipeline."""
    code = f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries()), sorted(e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__spark_entry__.__file__).parent)
