"""Quality rules, PII, license scans, chat and WARC against plain Python, with the odd cases."""

import hashlib
import math
import re
from collections import defaultdict

import pytest

from seismolake.llm import chat, common, licenses, pii, quality, warc

ODD = [
    None, "", " ", "\n\n", "a", "word " * 60, "x" * 30000, "é ü ß\n" * 4, "one two three four five six seven eight nine " * 3,
    "mail a.b@c.de, x@y, a@b.c_d@e.f @g.h 1.2.3.4.5 300.1.1.1 10.0.0.255 +49 (0)30 123456 call +1 2",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4012888888881881 5.5.5.5 1 2 3", "1.1.1.1" * 3, "1 2" * 300, "9" * 5000, "a@b" + ".c" * 9000,
    "a@" * 3000, "+1" + "." * 4000 + "2", "café@exämple.com ü@b.de 𝒜 z@y.xx", "same line\nsame line\nsame  line\n \nsame line", "cc by cc by cc by-sa All rights  reserved",
    "This software is released under the MIT License. Licensed under the Apache License, Version 2.0.", "General Public\nLicense #1 $2 %3", "copyright c 2020 someone all rights reserved",
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    real = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = real + [(10000 + i, t, [None, "src0", "odd"][i % 3]) for i, t in enumerate(ODD + ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), rows


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_counts_match_brute_force(docs):
    df, rows = docs
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text), i
        assert not (r.kept and r.base_failed)


def test_host_verdicts_and_salted_join(spark, monkeypatch):
    rows = [(f"h{i % 3}", i % 3 == 0 or i % 50 == 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "source string, base_failed boolean")
    hosts = quality.host_verdicts(df, "source")
    got = {r.host: r for r in hosts.collect()}
    assert not got["h0"].host_kept and got["h1"].host_kept and 0 < got["h2"].host_rate < 0.1
    plain = sorted(map(tuple, quality.with_verdicts(df, hosts).collect()))
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, quality.with_verdicts(df, hosts).collect())) == plain and len(plain) == 3000


def test_quality_of_an_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string, kept string, n_words string")
    assert quality.judge(empty).count() == 0


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_pii(text):
    text, out = text or "", []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(x) if len(x) < 50 else 999 for x in m[0].split(".")) > 255:
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans_match_brute_force(docs):
    df, rows = docs
    got = {r.doc_id: r for r in pii.sanitise(df).select("doc_id", pii.written("base").alias("base"), pii.written("spans").alias("spans"), "sanitised").collect()}
    for i, text, _ in rows:
        want = brute_pii(text)
        assert got[i].base == ",".join(want), i
        assert got[i].spans.startswith(got[i].base)
        if not got[i].spans:
            assert got[i].sanitised == text


def test_pii_terms_that_disclose_are_taken_out(spark, monkeypatch):
    filler = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows = [(i, f"{filler[i % 5]} patient zorblax writes from secret{i}word me@home.org about {filler[(i + 1) % 5]} number {i}") for i in range(6)]
    rows += [(100 + i, f"{filler[i % 5]} writes patient letters about {filler[(i + 2) % 5]} word {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert "zorblax" not in got[0].sanitised and "me@home.org" not in got[0].sanitised and "[EMAIL]" in got[0].sanitised
    assert "alpha" in got[0].sanitised and got[100].sanitised == rows[6][1]
    monkeypatch.setattr(pii, "BROADCAST_TEXTS", 0)
    assert {r.doc_id: r.sanitised for r in pii.sanitise(df).collect()} == {k: r.sanitised for k, r in got.items()}
    assert pii.sanitise(df.limit(0)).count() == 0


def brute_secrets(text, base):
    held = [tuple(map(int, x.split(":")[1:])) for x in base]
    long = [(m.start(), m.end(), sum(c.isdigit() for c in m[0])) for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}", text or "")]
    return [(a, b) for a, b, n in long if 2 <= n <= b - a - 2 and not any(x < b and a < y for x, y in held)]


@pytest.mark.parametrize(("support", "bits"), [(2, -100), (3, 7)])
def test_pii_disclosing_terms_match_brute_force(spark, docs, support, bits, monkeypatch):
    import regex

    monkeypatch.setattr(pii, "SURE_BITS", bits)
    df, rows = docs
    entities, terms = defaultdict(set), defaultdict(set)
    texts = {t or "" for _, t, _ in rows}
    for t in texts:
        base = brute_pii(t)
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base)] + [("secret", a, b) for a, b in brute_secrets(t, base)]
        for k, a, b in spans:
            value = t[a:b].lower()
            for e in [f"{k}:{value}", f"kind:{k}", *([f"domain:{value.split('@')[1]}"] if k == "email" else [])]:
                entities[e].add(t)
        free = list(t)
        for _, a, b in spans:
            free[a:b] = " " * (b - a)
        for w in set(regex.split(r"[^\p{L}\p{M}\p{N}]+", "".join(free).lower())) - {""}:
            terms[w].add(t)
    own = {e: x for e, x in entities.items() if len(x) >= support}
    want = {}
    for e, x in own.items():
        for w, y in terms.items():
            both = len(x & y)
            if both >= support and len(x) < len(texts):
                ic, pmi = -math.log2(len(x) / len(texts)), math.log2(both * len(texts) / (len(x) * len(y)))
                if pmi >= ic / 1.25 - 1e-9 and both * pmi >= math.log2(len(terms)) + math.log2(len(own)) + bits:
                    want[e, w] = (len(x), len(y), both, pmi >= ic - 1e-9)
    got = {(r.entity, r.term): (r.n_entity, r.n_term, r.n_both, r.removed) for r in pii.disclosing_terms(pii.evidence(df), support=support).collect()}
    assert got == want
    if support == 2:
        assert len(want) > 10


def test_pii_secrets_and_generalised_terms(spark):
    rows = [(i, f"Mr Smith, token = \"{'0123456789abcdef'[i:] + 'fedcba98'}\" and AKIA{i}ABCDEFGH1234567, plain 9807915762804490 word{i}") for i in range(8)]
    rows += [(100 + i, f"Mr Brown and plain word {i}") for i in range(300)] + [(900, "smith token 7"), (901, "token 8")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert got[0].sanitised.startswith("Mr [NAME], [WORD] = \"[SECRET]\" and [SECRET], plain ") and {x.kind for x in got[0].spans} >= {"secret", "name", "word"}
    assert got[900].sanitised == "smith token 7" and got[100].sanitised == "Mr Brown and plain word 0"


def test_pii_copies_hide_no_disclosing_term(spark):
    rows = [(i, f"patient zorblax writes from place{'abc'[i]} me@home.org") for i in range(3) for _ in range(40)]
    rows += [(100 + i, f"patient writes letters from here {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = df.dropDuplicates(["text"])
    found = [{(r.entity, r.term, round(r.ic, 9), round(r.pmi, 9)) for r in pii.disclosing_terms(pii.evidence(d)).collect()} for d in (df, one)]
    assert found[0] == found[1] and "zorblax" in {r[1] for r in found[0]}
    assert all("zorblax" not in r.sanitised for r in pii.sanitise(df).filter("doc_id < 3").collect())


def test_pii_terms_may_be_far_short_and_mixed(spark):
    far = " ".join(f"filler{i}" for i in range(60))
    rows = [(i, f"Lee and case77 {'abc'[i]}1x {far} me@home.org") for i in range(3)]
    rows += [(100 + i, f"{far} writes letters {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.sanitised for r in pii.sanitise(df).collect()}
    assert all(w not in got[0] for w in ("Lee", "case77", "me@home.org")) and "filler7 " in got[0] and got[100] == rows[3][1]


def brute_license(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_matches_brute_force(docs):
    df, rows = docs
    got = {r.doc_id: r for r in licenses.scan(df.select("doc_id", "text")).collect()}
    for i, text, _ in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(text), i
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_license_templates():
    a = licenses.compiled("x", "start <<beginOptional>>maybe here<<endOptional>> by <<var;max=3>> all rights")
    accept = lambda s: licenses.matches(a, s.encode().split(), b" " + s.encode() + b" ")
    assert accept("start by me all rights") == [(0, 5)]
    assert accept("x start maybe here by a b c all rights start by all rights") == [(1, 10), (10, 14)]
    assert accept("start maybe by me all rights") == [] and accept("start by a b c d all rights") == []


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 2, None, "ö"), (1, 70, "ann", "bye"), (2, 0, "system", "x"), (None, None, "eve", "z"), (1, 70, "ann", "bye")]
    segments = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.perspective): r for r in chat.assemble(segments).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "eve")}
    ann = got[1, "ann"]
    assert ann.rendered == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\n<|end|>\n<|user name=unknown|>\nö<|end|>\n" + "<|assistant|>\nbye<|end|>\n" * 2
    assert [ann.rendered[m.mask_start : m.mask_end] for m in ann.masks] == ["hi < |end|><|end|>", "bye<|end|>", "bye<|end|>"]
    for r in segments.collect():
        assert got[r.conv_id, r.perspective].rendered[r.start : r.end] == r.segment
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize(("split", "broadcast"), [(100, 0), (1000, 100), (1 << 20, 0)])
def test_warc_round_trip(spark, split, broadcast, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", broadcast)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    big = "ü" * 700
    rows = [(1, "http://a", "x" * 1500), (2, None, None), (3, "u\r\nX: y", big), (9, "v", big), (7, "w", big), (5, "s", "short"), (6, "s", "short"), (None, "n", "\x1f\x8b\x08 WARC/1.0")]
    folder = warc.fresh_dir(spark, "warc")
    files = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), folder)
    got = warc.read(files, split).collect()
    assert len(got) == len(rows) and sum(r.records for r in files.collect()) == len(rows)
    by = {r.record_id: r for r in got}
    for i, _, html in rows:
        r, data = by[f"<urn:x-page:{'' if i is None else i}>"], (html or "").encode()
        assert r.payload_digest == "sha1:" + hashlib.sha1(data).hexdigest() and r.http_length == len(data)
        if i in (3, 7):
            assert r.warc_type == "revisit" and r.refers_to == "<urn:x-page:9>" and r.payload == b""
        else:
            assert r.warc_type == "response" and bytes(r.payload) == data
    empty = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), warc.fresh_dir(spark, "warc"))
    assert warc.read(empty).count() == 0
