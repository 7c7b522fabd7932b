"""F1, F2 of the fourth review: beyond the broadcast, patterns are still searched once a different text, and most rows aren't shuffled."""

import random

import pytest

from seismolake.llm import pii


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = []
    for i in range(240):
        said = [word() for _ in range(30)]
        if i % 3 == 0:
            value = rng.choice(["me@home.org", "You@home.org", "10.0.0.7", "+49 30 1234567", "key a1b2c3d4e5f6g7h8i9", "A1" * 9])
            said[4:6] = ["zorblax" if value == "me@home.org" else word(), value]
        if i % 7 == 0:
            said.append(rng.choice(["abcdefghijklmnopqrst", "1234567890123456789", "donaudampfschifffahrt1", "x@y", "1.5", "1234 5678 9012 3"]))
        texts.append(" ".join(said))
    texts += [None, "", texts[0], texts[0], texts[3]]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_many_marked_texts_give_the_same_rows(rows, monkeypatch):
    few = {r.doc_id: r for r in pii.sanitise(rows).collect()}
    monkeypatch.setattr(pii, "BROADCAST_TEXTS", 0)
    many = {r.doc_id: r for r in pii.sanitise(rows).collect()}
    assert few == many and len(many) == 245
    assert sum(bool(r.secrets) for r in many.values()) > 5 and any("zorblax" not in r.sanitised for r in many.values() if r.base and "zorblax" in r.text)


@pytest.mark.parametrize("most", [0, 50_000])
def test_patterns_are_searched_once(rows, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_TEXTS", most)
    plan = pii.sanitise(rows)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and ("SortMergeJoin" in plan or "ShuffledHashJoin" in plan or "BroadcastHashJoin" in plan)


def test_the_gate_of_secrets_lets_all_secrets_through(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aZ09 .-") for _ in range(rng.randint(10, 60))) for _ in range(300)] + ["".join(rng.choice("ab12") for _ in range(rng.randint(14, 20))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = pii.F.expr(f"exists(regexp_extract_all(text, r'{pii.PATTERNS['secret']}', 0), v -> {pii.valid('secret', 'v')})")
    got = df.select(found.alias("secret"), pii.F.expr(f"text RLIKE r'{pii.GATES['secret']}'").alias("gate")).collect()
    assert all(r.gate for r in got if r.secret) and sum(r.secret for r in got) > 100 and sum(not r.gate for r in got) > 100
