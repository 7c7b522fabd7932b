"""PII sanitisation: patterns find personal data, corpus statistics find the terms that give it away.

Four patterns mark e-mail addresses, IP addresses, payment cards and phone numbers; a fifth marks secrets, which are long runs of mixed letters and digits. What must not be disclosed
are the protected entities: each marked value, an address's domain, and each kind as such (that a text holds a card number or a secret).
Co-occurrence over the corpus then tells how much other terms reveal an entity: with IC(c) = -log2 p(c) for an entity and
PMI(c; t) = log2 p(c, t) / (p(c) p(t)) for a term of the same texts, a term that reaches PMI >= IC / ALPHA discloses the entity. In
texts that mention the entity such terms are generalised to their class (code, name or word), and removed where PMI reaches IC itself (the term
alone names the entity). Evidence must not be chance: a term needs SUPPORT different texts, and all of them together must tell more bits (n_both PMI) than naming
one of all pairs of terms and entities takes, by SURE_BITS. Terms are words of letters, marks and digits of any length, outside the spans of the patterns.

Everything runs as DataFrame expressions: the patterns once over the different texts, whose spans, entities and terms are written as a table that all counts and the rows read.
Places are code points, ends exclusive. A null text is empty and has no spans.
Repeated rows are treated one by one and count once as evidence (equal texts are one text). Ties in place are ordered by kind. Texts of any length are searched as a whole. An empty table
gives an empty table; columns beside the text are carried through, those that clash with a result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, sheltered, split_join, table
from .common import written as kept_table

KINDS = ("email", "ip", "card", "phone")
#: The loops are possessive, which changes no match and keeps Java's matcher from recursing on long texts; the look-behinds skip starts that can't match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+",
}
#: What a text must have for its pattern to be tried.
GATES = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]", "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16}"}
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

ALPHA = 1.25
SUPPORT = 3
SURE_BITS = 7
#: What words are made of.
LETTER = r"\p{L}\p{M}\p{N}"
#: More texts with spans than this are joined by a shuffle instead of a broadcast.
BROADCAST_TEXTS = 50_000
LABEL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "code": "[CODE]", "name": "[NAME]", "word": "[WORD]", "removed": ""}

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def valid(kind: str, value: str) -> str:
    """SQL: does a match count?"""
    d = digits(value)
    if kind == "ip":
        return f"{value} RLIKE r'^{IP_PART}(?:\\.{IP_PART}){{3}}$'"
    if kind == "card":
        twice = "IF(i % 2 = 0, 2, 1) * CAST(substring(d, length(d) - i + 1, 1) AS INT)"
        luhn = f"aggregate(transform(array({d}), d -> aggregate(sequence(1, length(d)), 0, (a, i) -> a + {twice} - IF({twice} > 9, 9, 0))), 0, (a, x) -> a + x) % 10 = 0"
        return f"(CASE WHEN length({d}) BETWEEN 13 AND 19 THEN {luhn} ELSE false END)"
    if kind == "phone":
        return f"length({d}) BETWEEN 9 AND 15"
    if kind == "secret":
        return f"length({d}) BETWEEN 2 AND length({value}) - 2"
    return "true"


def placed(kind: str, gaps: str, found: str) -> str:
    """SQL: the spans of matches, from the matches and the text between them."""
    step = (
        f"named_struct('at', a.at + length({gaps}[i]) + length({found}[i]), 'out', concat(a.out, array(named_struct('kind', '{kind}', "
        f"'start', a.at + length({gaps}[i]), 'end', a.at + length({gaps}[i]) + length({found}[i]), 'value', {found}[i]))))"
    )
    spans = f"aggregate(sequence(0, size({found}) - 1), named_struct('at', 0, 'out', CAST(array() AS {SPAN})), (a, i) -> {step}, a -> a.out)"
    return f"CASE WHEN size({found}) > 0 THEN filter({spans}, s -> {valid(kind, 's.value')}) ELSE CAST(array() AS {SPAN}) END"


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base, the spans of the four patterns by kind and place, and secrets, those of the fifth outside them."""
    docs = docs.drop("base", "secrets").withColumn("pii_text", F.coalesce(F.col(text), F.lit("")))
    found = {k: F.expr(f"CASE WHEN pii_text RLIKE r'{GATES[k]}' THEN regexp_extract_all(pii_text, r'{PATTERNS[k]}', 0) ELSE CAST(array() AS array<string>) END") for k in PATTERNS}
    docs = docs.withColumns({f"pii_m_{k}": v for k, v in found.items()})
    docs = docs.withColumns({f"pii_g_{k}": F.expr(f"CASE WHEN size(pii_m_{k}) > 0 THEN split(pii_text, r'{PATTERNS[k]}', -1) END") for k in PATTERNS})
    docs = docs.withColumns({f"pii_s_{k}": F.expr(placed(k, f"pii_g_{k}", f"pii_m_{k}")) for k in PATTERNS})
    docs = docs.withColumn("base", F.concat(*(f"pii_s_{k}" for k in KINDS)))
    docs = docs.withColumn("secrets", F.expr("filter(pii_s_secret, s -> NOT exists(base, b -> b.start < s.end AND s.start < b.end))"))
    return docs.drop("pii_text", *(f"pii_{x}_{k}" for x in "mgs" for k in PATTERNS))


def entities(spans: Column) -> Column:
    """Names of the protected entities of spans: values, domains and kinds."""
    values = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"])))
    domains = F.transform(F.filter(spans, lambda s: s["kind"] == "email"), lambda s: F.concat(F.lit("domain:"), F.lower(F.substring_index(s["value"], "@", -1))))
    return F.array_distinct(F.concat(values, domains, F.transform(spans, lambda s: F.concat(F.lit("kind:"), s["kind"]))))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), rf"[^{LETTER}]+"), lambda w: w != ""))


def free_text(text: str) -> Column:
    """The text without its base spans and secrets."""
    ordered = "array_sort(concat(base, secrets), (x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start ELSE y.end - x.end END)"
    step = f"named_struct('at', greatest(a.at, x.end), 'out', concat(a.out, substring({text}, a.at + 1, greatest(x.start - a.at, 0)), ' '))"
    rest = f"aggregate({ordered}, named_struct('at', 0, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring({text}, a.at + 1)))"
    return F.expr(f"CASE WHEN size(base) + size(secrets) > 0 THEN {rest} ELSE coalesce({text}, '') END")


def keys_of(text: Column) -> list[Column]:
    """text_key and text_check, two hashes that tell texts apart together."""
    return [F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit("check"), text).alias("text_check")]


def evidence(docs: DataFrame, text: str = "text") -> DataFrame:
    """The keys, base, secrets, entities and terms of each different text, as a table in the shared folder."""
    texts = base_spans(docs.select(F.coalesce(F.col(text), F.lit("")).alias("body")).distinct(), "body")
    return kept_table(texts.select(*keys_of(F.col("body")), "base", "secrets", entities(F.concat("base", "secrets")).alias("entities"), terms_of(free_text("body")).alias("terms")), "evidence")


def with_spans(docs: DataFrame, marked: DataFrame, text: str = "text") -> DataFrame:
    """docs with base, secrets and giving of marked (by a text's keys), none where the text isn't in it. Patterns aren't searched again: of many marked texts, the rows that pass a pattern's gate meet them in a shuffle, the others stay."""
    body = F.coalesce(F.col(text), F.lit(""))
    of = marked.select(F.col("text_key").alias("of_key"), F.col("text_check").alias("of_check"), "base", "secrets", "giving")
    join = lambda rows, table: rows.join(table, (F.col("text_key") == F.col("of_key")) & (F.col("text_check") == F.col("of_check")), "left").drop("of_key", "of_check", "text_key", "text_check")
    if marked.count() <= BROADCAST_TEXTS:
        docs = join(docs.select("*", *keys_of(body)), F.broadcast(of))
    else:
        gated = F.expr(" OR ".join(f"coalesce(`{text}`, '') RLIKE r'{g}'" for g in GATES.values()))
        rest = docs.filter(~gated).select("*", *(F.expr(f"CAST(NULL AS {of.schema[c].dataType.simpleString()})").alias(c) for c in ("base", "secrets", "giving")))
        docs = join(docs.filter(gated).select("*", *keys_of(body)), of).unionByName(rest)
    return docs.withColumns({c: F.coalesce(c, F.expr(f"CAST(array() AS {SPAN})")) for c in ("base", "secrets")})


def disclosing_terms(known: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """entity, term, n_entity, n_term, n_both, ic, pmi, removed for the terms that disclose an entity, from the evidence of texts."""
    n = known.agg(F.count("*").alias("n_docs"))
    own = known.select(F.explode("entities").alias("of_entity")).groupBy("of_entity").agg(F.count("*").alias("n_entity"))
    own = kept_table(own.filter(F.col("n_entity") >= support), "entities")
    all_terms = kept_table(known.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "terms")
    sizes = n.crossJoin(all_terms.agg(F.count("*").alias("n_terms"))).crossJoin(own.agg(F.count("*").alias("n_entities")))
    marked = known.filter(F.size("entities") > 0).select("text_key", "terms", F.explode("entities").alias("entity"))
    marked = split_join(marked, own, "entity", "of_entity", "n_entity", "text_key").drop("of_entity")
    both = marked.select("entity", "n_entity", F.explode("terms").alias("term")).groupBy("entity", "n_entity", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= support)
    found = both.join(all_terms.filter(F.col("n_term") >= support), "term").crossJoin(F.broadcast(sizes))
    ic = -F.log2(F.col("n_entity") / F.col("n_docs"))
    pmi = F.log2(F.col("n_both") * F.col("n_docs") / (F.col("n_entity") * F.col("n_term")))
    found = found.withColumn("ic", ic).withColumn("pmi", pmi)
    sure = F.col("n_both") * F.col("pmi") >= F.log2(F.col("n_terms")) + F.log2(F.col("n_entities")) + F.lit(float(SURE_BITS))
    found = found.filter((F.col("ic") > 0) & (F.col("pmi") >= F.col("ic") / alpha - 1e-9) & sure)
    return found.select("entity", "term", "n_entity", "n_term", "n_both", "ic", "pmi", (F.col("pmi") >= F.col("ic") - 1e-9).alias("removed"))


def term_spans(text: str) -> Column:
    """Spans of the terms in `giving` (term, removed), in any case, as whole words and outside the base spans."""
    gaps = f"split({text}, concat(r'(?iu)(?<![{LETTER}])', t.term, r'(?![{LETTER}])'), -1)"
    value = f"substring({text}, a.at + length(g) + 1, length(t.term))"
    kind = f"CASE WHEN t.removed THEN 'removed' WHEN t.term RLIKE r'\\p{{N}}' THEN 'code' WHEN {value} RLIKE r'^\\p{{Lu}}' THEN 'name' ELSE 'word' END"
    step = f"named_struct('at', a.at + length(g) + length(t.term), 'out', concat(a.out, array(named_struct('kind', {kind}, 'start', a.at + length(g), 'end', a.at + length(g) + length(t.term), 'value', {value}))))"
    one = f"aggregate({gaps}, named_struct('at', 0, 'out', CAST(array() AS {SPAN})), (a, g) -> {step}, a -> slice(a.out, 1, size(a.out) - 1))"
    free = "s -> NOT exists(concat(base, secrets), b -> b.start < s.end AND s.start < b.end)"
    return F.expr(f"CASE WHEN size(giving) > 0 THEN array_sort(filter(flatten(transform(giving, t -> {one})), {free})) ELSE CAST(array() AS {SPAN}) END")


def sanitise(docs: DataFrame, text: str = "text", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """docs with base, secrets, spans (base, secrets and disclosing terms; kinds as in LABEL) and the sanitised text."""
    names = ("base", "secrets", "spans", "sanitised", "giving", "text_key", "text_check", "of_key", "of_check")
    docs = docs.drop(*(c for c in names if c != text))
    known = evidence(docs, text)
    giving = kept_table(disclosing_terms(known, alpha, support), "giving")
    said = known.filter(F.size("entities") > 0).select("text_key", "entities", F.explode("terms").alias("term"))
    given = said.join(giving.select(F.col("term").alias("of_term"), "entity", "removed"), (F.col("term") == F.col("of_term")) & F.expr("array_contains(entities, entity)"))
    given = given.groupBy("text_key", "term").agg(F.max("removed").alias("removed"))
    by_text = given.groupBy(F.col("text_key").alias("of_key")).agg(F.sort_array(F.collect_list(F.struct("term", "removed"))).alias("giving"))
    spotted = known.filter(F.size("entities") > 0).select("text_key", "text_check", "base", "secrets")
    docs = with_spans(docs, checkpoint(spotted.join(by_text, F.col("text_key") == F.col("of_key"), "left").drop("of_key")), text)
    docs = docs.withColumn("spans", F.concat("base", "secrets", term_spans(text)))
    label = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL.items()) + " END"
    ordered = "array_sort(spans, (x, y) -> CASE WHEN x.start <> y.start THEN x.start - y.start ELSE y.end - x.end END)"
    step = f"IF(x.start < a.at, named_struct('at', greatest(a.at, x.end), 'out', a.out), named_struct('at', x.end, 'out', concat(a.out, substring({text}, a.at + 1, x.start - a.at), {label})))"
    clean = f"aggregate({ordered}, named_struct('at', 0, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring({text}, a.at + 1)))"
    return docs.withColumn("sanitised", F.expr(f"CASE WHEN size(spans) > 0 THEN {clean} ELSE {text} END")).drop("giving")


def written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    more = [F.size("secrets").cast("long").alias("n_secret"), F.size("spans").cast("long").alias("n_spans")]
    return rows.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), *more)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:

    def step(d: DataFrame) -> DataFrame:
        out = sanitise(d).withColumn("text", F.col("sanitised"))
        return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

    return sheltered(docs, step)
