"""Near duplicates, transducers, packing, n-gram joins and suffix arrays against plain Python, with the odd cases, and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismolake.llm import components as components_module
from seismolake.llm import common, embedding_pivots, ngram_join, packing, sentencepiece_fst, suffix_dedup
from seismolake.llm.components import components

from tests.llm.test_text_operators import ODD


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    rng = random.Random(5)
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    base = "the quick brown fox jumps over a lazy dog and runs far away from all those hunters who wait near old trees " * 3
    words = base.split()
    near = []
    for i in range(60):
        w = list(words)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(1000)}"
        near.append((20000 + i, " ".join(w)))
    passage = "x".join(str(k) for k in range(200))
    spread = [(30000 + i, f"{'ab' * (i % 5)}{i} {passage[: 150 + 7 * i]} tail {i} é") for i in range(30)]
    return real + near + spread + [(10000 + i, t) for i, t in enumerate(ODD + ODD)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def groups(links, nodes):
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in nodes}


@pytest.mark.parametrize("at_once", [1, 1_000_000])
def test_components(spark, at_once, monkeypatch):
    monkeypatch.setattr(components_module, "GATHER", at_once)
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(edges, {x for e in edges if e[0] != e[1] for x in e})
    assert all(got.get(k, k) == v for k, v in want.items()) and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_join(rows, size, percent):
    sets = {}
    for i, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    links = []
    for i, s in sets.items():
        for j, k in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                links.append((i, j))
    return sets, groups(links, sets)


@pytest.mark.parametrize(("size", "percent", "hot_rows", "hot_cells"), [(4, 85, 1000, 4096), (5, 80, 1, 2), (4, 85, 1, 30)])
def test_ngram_join_matches_brute_force(docs, rows, size, percent, hot_rows, hot_cells, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(ngram_join, "PART_BYTES", 1000 * hot_rows)
    if hot_cells < 4096:
        for name, value in {"HOT_CELLS": hot_cells, "MOST_DF": hot_cells, "LEAST_REPEATS": 2, "COUNT_CELLS": 5000}.items():
            monkeypatch.setattr(ngram_join, name, value)
    sets, want = brute_join(rows, size, percent)
    got = {r.row_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs, size=size, percent=percent).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_hot_ngrams_leave_their_fragment(spark):
    """Documents that share a phrase and nothing else: the largest group falls with the number of fragments."""
    phrase = "the same licence line stands in each of these texts "
    docs = spark.createDataFrame([(k, phrase + " ".join(f"w{k}x{j}" for j in range(20))) for k in range(6000)], "row_id long, text string").repartition(4)
    hot = ngram_join.hot_grams(ngram_join.sets_of(docs, 4))
    assert len(hot) == 7
    largest = {}
    for n in (16, 64, 256):
        cells = ngram_join.fragments(docs, 4, n, hot).groupBy("fragment").agg(F.sum(F.octet_length("hashes") / 6).alias("n"))
        largest[n] = cells.agg(F.max("n")).first()[0]
        assert cells.agg(F.sum("n")).first()[0] == 6000 * 27
    assert largest[256] < 1.5 * largest[64] / 4 * 2 and largest[64] < 1.5 * largest[16] / 4 * 1.5 and largest[256] < 1200
    got = ngram_join.similar_groups(docs.withColumnRenamed("row_id", "doc_id"))
    assert got.filter("row_id <> component_id or n_shingles <> 27").isEmpty() and got.count() == 6000


def test_ngram_join_odd_tables(spark):
    assert ngram_join.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, None), (None, "a b c d e"), (3, "")], "doc_id long, text string")
    got = sorted(((r.row_id, r.component_id) for r in ngram_join.similar_groups(twice).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 2), (3, 3), (None, 1)]


def brute_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, np.int64)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s] += 1
                gone[min(len(data), s + 100)] -= 1
            seen.add(data[s : s + 100])
        hit = np.cumsum(gone[: len(data)]) > 0
        left = bytes(np.frombuffer(data, np.uint8)[~hit])
        out[i] = (len(data), int(hit.sum()), int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("split", [2, 256])
def test_suffix_dedup_matches_brute_force(docs, rows, split, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT_LEAST", split)
    if split == 2:  # many small ranges and runs, texts in pieces, grams sorted window by window
        for name, value in {"MERGE_SUFFIXES": 40, "MOST_RANGES": 7, "RUN": 500, "GATHER": 3000, "STEP_BYTES": 3000, "PART_BYTES": 20000}.items():
            monkeypatch.setattr(suffix_dedup, name, value)
    got = {r.doc_id: tuple(r[1:]) for r in suffix_dedup.remove_repeats(docs, keep_text=False).collect()}
    assert got == brute_repeats(rows)


def test_suffix_dedup_of_one_long_text_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP_BYTES", 300)
    rng = random.Random(3)
    text = "".join(rng.choice("abcdef ") for _ in range(2500))
    rows = [(2, text + text[300:1900] + "ü" + text), (1, text[:1200]), (None, text[100:400])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r[2:]) for r in suffix_dedup.remove_repeats(df).collect()}
    want = brute_repeats([(-1 if i is None else i, t) for i, t in rows])
    assert got == {None if i == -1 else i: v for i, v in want.items()}
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "ab" * 40 + "c" * 60)] * 2, "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeats(twice).collect()] == [0, 0]


def test_loser_tree():
    rng = random.Random(2)
    runs = []
    for n in (0, 1, 5, 40, 40):
        strings = sorted(bytes(rng.choice(b"ab") for _ in range(6)) + b"z" * 94 for _ in range(n))
        common = [0] + [next((k for k in range(100) if a[k] != b[k]), 100) for a, b in zip(strings, strings[1:], strict=False)]
        runs.append((strings, common[:n]))
    which, at, common = suffix_dedup.merge_runs(runs)
    got = [runs[r][0][k] for r, k in zip(which, at, strict=True)]
    assert got == sorted(s for r in runs for s in r[0])
    assert common[1:] == [next((k for k in range(100) if a[k] != b[k]), 100) for a, b in zip(got, got[1:], strict=False)]


def test_sentencepiece_equals_the_library(spark, docs, rows):
    import sentencepiece

    path = packing.vocabulary_path(sentencepiece_fst.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepiece_fst.decode(sentencepiece_fst.encode(docs, path), path).collect()
    assert len(out) == len(rows)
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or ""), r.doc_id
        assert r.decoded == (r.text or "").replace("▁", " ")
    extra = ["a ▁b", " a  b \n c ", "\n\nx", "▁", "  ", "a▁▁ b\n▁c", "日本語 テスト\t🙂🙂 ́x"]
    machine = sentencepiece_fst.Transducer(sentencepiece_fst.model_bytes(path))
    assert [machine.encode(x) for x in extra] == [library.encode(x) for x in extra]


def model_with(kind, rules, squeeze=0):
    """The given model, declared as of another kind, and with the normaliser of another rule name."""
    import sentencepiece

    model = sentencepiece_fst.model_bytes(packing.vocabulary_path(sentencepiece_fst.MODEL))
    trainer = next(v for k, v in sentencepiece_fst.fields(model) if k == 2)
    at = model.index(trainer)
    assert trainer.count(b"\x18\x02") == 1
    model = model[:at] + trainer.replace(b"\x18\x02", b"\x18" + bytes([kind])) + model[at + len(trainer) :]
    return model + sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_model_proto() + b"\x1a\x02\x20" + bytes([squeeze]) if rules else model


def test_unigram_shortest_path_equals_the_library(rows):
    """The same pieces read as a unigram model, which is what their type field says after this change."""
    import sentencepiece

    model = model_with(1, None)
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_fst.Transducer(model)
    cost = lambda ids: sum(library.get_score(i) for i in ids)
    for t in [t or "" for _, t in rows[:40] + rows[-30:]]:
        got, want = machine.encode(t), library.encode(t)
        assert got == want or abs(cost(got) - cost(want)) < 1e-3 * abs(cost(want)), t[:50]


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize(("rules", "squeeze"), [("nmt_nfkc", 0), ("nmt_nfkc", 1), ("nmt_nfkc_cf", 1), ("nfkc", 1)])
def test_compiled_normaliser_equals_the_library(rows, kind, rules, squeeze):
    import sentencepiece

    model = model_with(kind, rules, squeeze)
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_fst.Transducer(model)
    rng = random.Random(11)
    pool = "abcXYZ  \t\n\u00a0\u3000\u200b\u0301é½ﬁÅ㌀ＡＢ１㍿ｶﾞ①…ß🙂日本語▁"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(400)] + [t or "" for _, t in rows[:15] + rows[-40:]]
    cost = lambda ids: sum(library.get_score(i) for i in ids)
    for t in texts:
        assert machine.normalise(t) == library.normalize(t).replace("▁", " ").removeprefix(" ") or "▁" in t, t[:60]
        got, want = machine.encode(t), library.encode(t)
        assert got == want or (kind == 1 and abs(cost(got) - cost(want)) < 1e-3 * abs(cost(want))), t[:60]


def test_packing_holds_every_id_once(spark, docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    pieces = packing.pack(docs, packing.vocabulary_path()).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {i for i, _ in rows}
    for i, text in rows:
        own = sorted(by_doc[i], key=lambda p: p.start)
        ids = np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist()
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2] and {p.doc_tokens for p in own} == {len(ids)}
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
    used = []
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        used.append(sum(p.length for p in own))
    padding = sum(0 if u & (u - 1) == 0 else 4096 - u for u in used)
    assert max(used) <= 4096 and padding < 0.03 * sum(used)
    assert packing.pack(docs.limit(0), packing.vocabulary_path()).count() == 0


@pytest.mark.parametrize("total", [1, 255, 257, 1000, 2049, 4095, 4096, 9000])
def test_cuts(total):
    got = packing.cut(total)
    assert sum(n for n, _ in got) == total and all(n * j <= 4096 for n, j in got)


@pytest.mark.parametrize(("size", "long_list", "kind"), [(24, 4096, "double"), (64, 4096, "float"), (64, 30, "double")])
def test_pivot_index_recall_by_bands_of_the_cosine(spark, size, long_list, kind, monkeypatch):
    monkeypatch.setattr(embedding_pivots, "LONG_LIST", long_list)
    rng = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    u = unit(rng.normal(size=(1600, size)))
    w = rng.normal(size=u.shape)
    w = unit(w - (w * u).sum(1, keepdims=True) * u)
    low = np.repeat([0.9001, 0.91, 0.93, 0.96], 400)
    c = low + rng.random(1600) * (np.repeat([0.91, 0.93, 0.96, 1.0], 400) - low)
    v = c[:, None] * u + np.sqrt(1 - c * c)[:, None] * w
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([u, v, rng.normal(size=(3000, size))]))]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)
    got = {r.vec_id: r for r in embedding_pivots.near_duplicates(df).collect()}
    found = np.array([got[i].component_id == got[1600 + i].component_id for i in range(1600)]).reshape(4, 400).mean(1)
    assert (found >= 0.9).all(), found


@pytest.mark.parametrize("long_list", [4096, 30])
def test_pivot_index_recall_and_links(spark, long_list, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x[200:700] = x[3] + 0.22 * rng.normal(size=(500, 32)) * np.linalg.norm(x[3]) / np.sqrt(32)
    x[700:740] = x[5]
    x[740:900] = x[10:170] + 0.42 * rng.normal(size=(160, 32))
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, []), (5002, [0.0] * 32), (5003, [float("nan")] * 32), (5004, [None] * 32), (5005, [float("inf")] + [1.0] * 31), (5006, [1.0, 2.0]), (5007, [1.0, 2.0]), (5008, x[5].tolist())]
    monkeypatch.setattr(embedding_pivots, "BLOCK", 100)
    monkeypatch.setattr(embedding_pivots, "LONG_LIST", long_list)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r for r in embedding_pivots.near_duplicates(df).collect()}
    assert len(got) == len(vectors)
    unit = np.r_[x, x[5:6]]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    similar = unit @ unit.T >= 0.9
    want = similar.sum(1) - 1
    ids = [*range(1500), 5008]
    found = np.array([got[i].n_links for i in ids])
    border = slice(740, 900)
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum() and found[border].sum() >= 0.9 * want[border].sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(5000, 5006))
    assert got[5006].n_links == got[5007].n_links == 1 and got[5007].component_id == 5006 and not got[5007].kept
    assert got[5008].component_id == got[5].component_id == got[720].component_id
    assert embedding_pivots.near_duplicates(df.limit(0)).count() == 0


def test_pipeline_stages_match_brute_force(spark, sf_dir):
    import corpus_pipeline

    from tests.llm.test_text_operators import brute_quality

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = stages["quality rules"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    assert set(kept) == {r.doc_id for r in docs.collect() if not brute_quality(r.text)[5]}
    _, group = brute_join(sorted(kept.items()), 5, 80)
    single = stages["n-gram Jaccard join"](spark, good, sf_dir)
    left = {r.doc_id: r.text for r in single.collect()}
    assert set(left) == {i for i, c in group.items() if i == c} and all(kept[i] == t for i, t in left.items())
    want = brute_repeats(left.items())
    cut = {r.doc_id: r for r in stages["suffix-array dedup"](spark, single, sf_dir).collect()}
    assert set(cut) == {i for i, w in want.items() if w[1] == 0 or w[1] < w[0]}
    assert all(len(r.text) == r.n_chars and (want[i][1] or r.text == left[i]) for i, r in cut.items())
    clean = stages["PII"](spark, single, sf_dir)
    assert clean.columns == docs.columns and all(len(r.text) == r.n_chars for r in clean.collect())
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in pieces.collect()} == set(cut)
