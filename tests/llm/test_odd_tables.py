"""Empty tables, clashing names, repeated rows, null ids; template automata against plain regular expressions; what the pipeline's last stages do to texts."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from seismolake.llm import chat, embedding_pivots, licenses, ngram_join, packing, pii, sentencepiece_fst, warc
from tests.llm.test_text_operators import brute_pii, brute_secrets


def test_clashing_and_further_columns(spark):
    docs = spark.createDataFrame([(1, "Hello under the MIT License", "x", "y"), (2, None, None, "z")], "doc_id long, text string, ids string, labels string")
    model = packing.vocabulary_path(sentencepiece_fst.MODEL)
    out = sentencepiece_fst.encode(docs.withColumnRenamed("labels", "decoded"), model, round_trip=True)
    assert out.columns == ["doc_id", "text", "ids", "n_fallback", "decoded"] and [r.decoded for r in out.orderBy("doc_id").collect()] == ["Hello under the MIT License", ""]
    out = licenses.scan(docs.withColumn("score", F.lit("s")))
    assert set(out.columns) == {"doc_id", "ids", *(x.split()[0] for x in licenses.SCHEMA.split(", "))} and {r.labels for r in out.collect()} == {"mit-notice", ""}
    assert packing.pack(docs.withColumn("offset", F.lit("o")), packing.vocabulary_path()).columns == packing.NAMES
    groups = ngram_join.similar_groups(docs.withColumn("component_id", F.lit("c")).withColumn("set_key", F.lit(1)))
    assert groups.columns == ["row_id", "n_shingles", "component_id"] and groups.count() == 2
    turns = spark.createDataFrame([(1, 0, "ann", "hi", "q"), (1, 0, "ann", "hi", "r")], "conv_id long, turn long, role string, text string, segment string")
    assert [(r.seq, r.start, r.segment) for r in chat.rotate(turns.withColumn("copies", F.lit(9))).orderBy("seq").collect()] == [(0, 0, "<|assistant|>\nhi<|end|>\n"), (1, 24, "<|assistant|>\nhi<|end|>\n")]
    pages = spark.createDataFrame([(1, "u", "h", "d", 5)], "page_id long, url string, html string, digest string, size long")
    assert [bytes(r.payload) for r in warc.read(warc.write(pages, warc.fresh_dir(spark, "warc"))).collect()] == [b"h"]
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "k", 3), (1, [1.0, 0.0], "k", 3), (None, [1.0, 0.01], "k", 3), (None, None, "k", 3)], "vec_id long, embedding array<float>, key string, n_links int")
    got = Counter(map(tuple, embedding_pivots.near_duplicates(vectors).collect()))
    assert got == Counter({(1, 2, 1, True): 2, (None, 2, 1, None): 1, (None, 0, None, None): 1})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = packing.vocabulary_path(sentencepiece_fst.MODEL)
    assert sentencepiece_fst.decode(sentencepiece_fst.encode(docs, model), model).count() == 0
    assert licenses.scan(docs).count() == 0 and pii.sanitise(docs).count() == 0


def plain(template):
    """A template as a regular expression over words that each have a space behind them."""
    out = ""
    for mark, word in re.findall(r"<<([^>]*)>>|([^\s<]+)", template):
        if word:
            out += re.escape(word) + " "
        elif mark == "beginOptional":
            out += "(?:"
        elif mark == "endOptional":
            out += ")?"
        else:
            out += r"(?:\S+ ){0,%s}" % re.search(r"max=(\d+)", mark)[1]
    return re.compile(out)


def test_template_automata_match_plain_expressions():
    rng = random.Random(8)
    automata = {k: licenses.compiled(k, v) for k, v in licenses.NOTICES.items()}
    accepted = Counter()
    for _ in range(600):
        label = rng.choice(list(licenses.NOTICES))
        words = []
        for mark, word in re.findall(r"<<([^>]*)>>|([^\s<]+)", licenses.NOTICES[label]):
            if word:
                words.append(word)
            elif "var" in mark:
                words += [rng.choice(["ann", "the", "software", "2024"]) for _ in range(rng.randrange(5))]
        if rng.random() < 0.5:
            del words[rng.randrange(len(words))]
        words = ["before", "this"] * rng.randrange(2) + words + words[: rng.randrange(4)] + ["after"]
        for name, automaton in automata.items():
            sought, got, at = plain(licenses.NOTICES[name]), [], 0
            while at < len(words):
                ends = [e for e in range(len(words), at, -1) if sought.fullmatch("".join(w + " " for w in words[at:e]))]
                if ends:
                    got.append((at, ends[0]))
                at = ends[0] if ends else at + 1
            raw = [w.encode() for w in words]
            assert licenses.matches(automaton, raw, b" " + b" ".join(raw) + b" ") == got, (name, words)
            accepted[name] += len(got)
    assert all(accepted[k] > 5 for k in licenses.NOTICES)


def filled(template, rng, name, optional):
    """A text of a template: regions taken or left out, names in replaceable ones; and which of its words are mandatory."""
    words, fixed, depth, skip = [], [], 0, None
    for mark, plain_text in re.findall(r"<<([^>]*)>>|((?:(?!<<).)+)", template, re.DOTALL):
        if mark == "beginOptional":
            depth += 1
            if skip is None and rng.random() > optional:
                skip = depth
        elif mark == "endOptional":
            skip = None if skip == depth else skip
            depth -= 1
        elif skip is None:
            got = name.split() if mark else plain_text.split()
            words += got
            fixed += [not mark and not depth and any(c.isalnum() for c in w) for w in got]
    return words, fixed


def test_whole_license_texts_and_altered_ones(spark):
    """Genuine texts with other names carry their label, texts with any mandatory word changed, missing or put in don't."""
    rng, docs, want = random.Random(3), [], {}
    for label, template in licenses.TEXTS.items():
        for k in range(24):
            words, fixed = filled(template, rng, rng.choice(["Ann Lee", "THE EXAMPLE AUTHORS AND CONTRIBUTORS", "2024 Ännchen", ""]), rng.choice([0, 0.5, 1]))
            words = ["Before."] * rng.randrange(3) + words
            fixed = [False] * (len(words) - len(fixed)) + fixed
            if k % 3:
                at = rng.choice([i for i, f in enumerate(fixed) if f and 0 < i < len(words) - 1 and fixed[i - 1] and fixed[i + 1]])
                words[at : at + 1] = rng.choice([["payable"], [], [words[at], "not"]]) if k % 3 == 1 else ["altered", words[at]]
            docs.append((len(docs), rng.choice([" ", "\n * "]).join(words) + " After."))
            want[len(docs) - 1] = (label, k % 3 == 0)
    grant = " ".join(licenses.TEXTS["mit"].split("including without")[0].split("<<endOptional>>")[-1].split())
    docs += [(9001, grant + " EXCEPT that no rights to sell or modify are granted, subject to the following conditions"), (9002, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: you pay me")]
    gnu = " ".join(filled(licenses.TEXTS["gpl-3.0-or-later"], rng, "A", 0)[0]).replace("://www", "https://www")
    docs += [(9005, gnu), (9006, gnu.replace("https", "http"))]
    docs += [(9003, None), (9004, "x " * 300_000 + " ".join(filled(licenses.TEXTS["zlib"], rng, "A", 1)[0]))]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, (label, genuine) in want.items():
        assert (label in got[i]) == genuine, (i, label, docs[i][1][:300])
    assert not got[9001] & set(licenses.TEXTS) and not got[9002] & set(licenses.TEXTS) and got[9003] == {""} and "zlib" in got[9004]
    assert "https://www.gnu.org" in gnu and all("gpl-3.0-or-later" in got[i] for i in (9005, 9006))


def test_last_stages_change_what_they_say(spark, sf_dir):
    """The PII stage puts labels where the patterns match, and the packing stage holds the ids of the texts it is given."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = {r.doc_id: r for r in pii.stage(spark, docs, sf_dir).collect()}
    spans = {r.doc_id: r.spans for r in pii.sanitise(docs.select("doc_id", "text")).collect()}
    changed = 0
    for r in docs.collect():
        text = r.text or ""
        base = brute_pii(text)
        want = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base)] + [(a, b, "secret") for a, b in brute_secrets(text, base)]
        if {s.kind for s in spans[r.doc_id]} <= {k for _, _, k in want}:
            out, at = "", 0
            for a, b, k in sorted(want, key=lambda x: (x[0], -x[1])):
                if a >= at:
                    out, at = out + text[at:a] + pii.LABEL[k], b
                at = max(at, b)
            assert (clean[r.doc_id].text or "") == out + text[at:]
            changed += bool(want)
        assert len(clean[r.doc_id].text or "") == (clean[r.doc_id].n_chars or 0)
    assert changed > 2
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    tokens = {r.doc_id: r.doc_tokens for r in packing.stage(spark, docs, sf_dir).collect()}
    assert tokens == {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
