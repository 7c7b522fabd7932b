"""Spelling variants, filter audit and byte-level BPE against plain Python and the tokenizer library, on odd tables and shrunken limits."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seismolake.llm import bpe_trie, filter_audit, packing, spelling_trie

COLUMNS = "doc_id long, text string, lang string, n long, good string, word string"


def odd_documents(spark, sf_dir):
    """Real documents and nulls, empties, repeated rows, copies over parts, null ids and columns that have results' names."""
    rows = [(r.doc_id, r.text, r.lang, 1, "g", "w") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()]
    words = " ".join(f"Tree{chr(97 + k % 26)}house forest" for k in range(300))
    rows += [(None, words, None, 1, None, None), (None, words, "en", 1, None, None), (5001, words, "", None, None, None), (5000, words, "en", None, None, None), (5002, words, "de", None, None, None)]
    rows += [(6000, None, "en", 1, "a", "b"), (6001, "", None, 1, "a", "b"), (6002, " \t\n", "en", 1, "a", "b"), (6003, "A" * 30, "en", 1, "a", "b")] + [(6004, "same row # of words", "fr", 1, "a", "b")] * 3
    return rows


def brute_audit(docs, labels):
    first, good, toxic = {}, {}, {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, quality, bad in labels:
        good[doc_id], toxic[doc_id] = good.get(doc_id, False) or quality == 1, toxic.get(doc_id, False) or bad == 1
    failed = []
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        own["E"] = doc_id is not None and first[text] < doc_id
        failed.append((lang or "", {k for k, v in own.items() if v}, doc_id is not None and good.get(doc_id, False), doc_id is not None and toxic.get(doc_id, False)))
    out, total = {}, Counter()
    for part in {x[0] for x in failed}:
        rows = [x[1:] for x in failed if x[0] == part]
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                fails = sum(f in x[0] for x in rows)
                out[part, "".join(order), k + 1] = (len(left), len(gone), fails - len(gone), sum(x[0] == {f} for x in rows), sum(x[1] for x in gone), sum(x[2] for x in gone))
                total[part, f] += len(gone)
    return {(part, order, k): (*v, total[part, order[k - 1]]) for (part, order, k), v in out.items()}


def test_filter_audit_is_brute_force(spark, sf_dir):
    docs = odd_documents(spark, sf_dir)
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()] + [(5001, 1, None), (5001, 0, 1), (6004, 1, 1), (None, 1, 1), (6000, None, None)]
    table = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality long, toxic long, text string")
    got = filter_audit.audit(spark.createDataFrame(docs, COLUMNS), table).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute_audit(docs, labels) and len(got) == len({r.part for r in got}) * 600
    both = filter_audit.audit(spark.createDataFrame(docs, COLUMNS), table, all_parts=True).filter("part is null").collect()
    everything = brute_audit([(i, t, "", *x) for i, t, _, *x in docs], labels)
    assert {("", r.filter_order, r.step): tuple(r)[3:] for r in both} == everything


def test_filter_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and all(r.removed == (r.filter_order[r.step - 1] == "A") for r in one)


def brute_vocabulary(docs):
    counts = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if distance_one(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("leaf_words", [1, 7, 40, 4096])
def test_spelling_variants_are_brute_force(spark, leaf_words):
    """Partitions of one word up to the whole vocabulary in one; words that are prefixes of others, runs of one letter, ties and chains."""
    rng = random.Random(leaf_words)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(6, 11))) for _ in range(300)} | {"a" * k for k in range(6, 14)} | {"b" * 40 + x for x in ("", "a", "b", "ab", "ba")}
    words |= {"prefix" + "s" * k for k in range(4)} | {"ÿeßöäé", "ÿeßöäe", "yeßöäé", "a" * 3000, "a" * 3001, "b" + "a" * 3000}
    counts = {w: rng.choice([5, 25, 25, 125, 625, 3125]) for w in words}
    got = spelling_trie.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), leaf_words=leaf_words).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(counts) and len(got) == len(counts)


def test_vocabulary_of_odd_documents(spark, sf_dir):
    docs = odd_documents(spark, sf_dir) + [(7000 + k, "x" * 100_000 + " Größere GRößere größere naïveté", "en", 1, "", "") for k in range(6)]
    table = spark.createDataFrame(docs, COLUMNS).repartition(5)
    counts = brute_vocabulary(docs)
    assert {r.word: r.n for r in spelling_trie.vocabulary(table).collect()} == counts and "x" * 100_000 in counts
    got = spelling_trie.variants(spelling_trie.vocabulary(table)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute_variants(counts)
    empty = spark.createDataFrame([], COLUMNS)
    assert spelling_trie.variants(spelling_trie.vocabulary(empty)).count() == 0


def test_long_texts_are_counted_by_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling_trie, "LONG_TEXT", 10)
    docs = [(k, "several Several words words of someone " * 3, None, 1, "", "") for k in range(4)]
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    assert schema.names == ["doc_id", "text"]
    assert {r.word: r.n for r in spelling_trie.vocabulary(spark.createDataFrame(docs, COLUMNS)).collect()} == brute_vocabulary(docs)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path(bpe_trie.VOCABULARY))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_trie_bpe_is_the_library(spark, sf_dir, library):
    """All documents, and texts of odd code points, contractions, white space of all kinds and added tokens; ids there and back."""
    rng = random.Random(13)
    bits = [*"abst'  \n\t 　.,!1234é日本ß½\x1c\x85\x00", "'s", "'ll", "'re", "'ve", "'RE", "<|endoftext|>", "<|endof", "  ", "\r\n", "====", "aaaaaaaa"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0x3000), rng.randrange(0xD800), rng.randrange(0x10000, 0x110000)])) for _ in range(rng.randrange(40))) for _ in range(800)]
    texts += [None, "", "x" * 40_000, "ab" * 20_000, "word " * 30_000]
    rows = [(k if k % 50 else None, t, "e", "f") for k, t in enumerate(texts)] + [(9, "twice", "e", "f")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    got = bpe_trie.encode(docs, packing.vocabulary_path(bpe_trie.VOCABULARY), round_trip=True)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    want = [(i, t, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for i, t, *_ in rows]
    assert Counter((r.doc_id, r.text, bytes(r.ids), r.decoded) for r in got.collect()) == Counter(want)
    again = bpe_trie.decode(got.select("ids", F.lit(1).alias("decoded")), packing.vocabulary_path(bpe_trie.VOCABULARY))
    assert Counter(r.decoded for r in again.collect()) == Counter(t for *_, t in want)
    assert bpe_trie.encode(docs.limit(0), packing.vocabulary_path(bpe_trie.VOCABULARY)).count() == 0


def test_trie_bpe_query(spark, sf_dir, library):
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_trie.op13_trie_bpe(spark, sf_dir).collect()} == want


def test_trie_bpe_by_pieces_and_any_ids(library):
    """Texts cut into pieces of any size, words dropped from memory, ids that no text gives."""
    encoder = bpe_trie.compiled(packing.vocabulary_path(bpe_trie.VOCABULARY))
    text = "It's 10 o'clock,  they'll say  <|endoftext|> und 日本 \n\n so on ... " * 40
    for step in (20, 301, 5000):
        cache = bpe_trie.BoundedCache(encoder.encode_words, 7)
        got = [x for *_, ids in bpe_trie.ids_of(pa.array([text, None, "a b", text]), encoder, cache, step) for x in ids]
        assert got == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in (text, "", "a b", text)]
    rng = random.Random(1)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert bpe_trie.text_of(encoder, np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_trie_shares_prefixes():
    words = [b"", b"a", b"ab", b"abc" * 20, b"abc" * 20 + b"d", b"b\x00", b"b", b"b\x00\x00"]
    trie = bpe_trie.Trie(words)
    assert trie.words == sorted(words) and [trie.words[k][: trie.leaves[k]] for k in range(8)] == [b"", b"", b"a", b"ab", b"abc" * 20, b"", b"b", b"b\x00"]
