"""Personal data: pattern spans, and the terms of their documents that give protected entities away.

Everything is DataFrame functions. Patterns find base spans. An entity is a base span's kind and normalised
value; the terms it meets are the lower-cased words of the documents that hold it. Over all documents, with N of them,
n(c) that hold entity c, n(t) that hold term t and n(c,t) that hold both,

    P(c | t) = (n(c,t) + prior n(c) / N) / (n(t) + prior)
    disclosure(c, t) = PMI(c; t) / IC(c) = ln(P(c | t) N / n(c)) / ln(N / n(c)),

which nears 1 if t is never seen but with c. ``prior`` documents without evidence smooth what is seen once
or twice; nothing is cut off before it is measured. In a document with c, each place of a term with a disclosure of ``threshold``
or more becomes a span: it is generalised, and removed from a disclosure of ``remove`` on.

Entities that the same documents hold have the same counts with every term, so one of them stands for all:
a document that lists thousands does not meet its terms thousands of times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.llm.shared import stored

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns, with possessive repeats where nothing can be given back and starts only where a run
#: begins or the last match ended: the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MUST = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_BYTE = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?"
_APART = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD, GAP = f"[^{_APART}]+", f"[{_APART}]+"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    digit = f"CAST(substr({d}, length({d}) - i + 1, 1) AS INT)"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END) % 10 = 0"


#: What a match (x.v) has to pass.
_PASS = {
    "email": "true",
    "ip": "x.v RLIKE r'^%s(?:\\.%s){3}$'" % (_BYTE, _BYTE),
    "card": f"CASE WHEN length({_digits('x.v')}) BETWEEN 14 AND 19 THEN {_luhn(_digits('x.v'))} ELSE false END",
    "phone": f"length({_digits('x.v')}) BETWEEN 10 AND 15",
}
_ENTITY = {"email": "lower(x.v)", "ip": "x.v", "card": _digits("x.v"), "phone": _digits("x.v")}


def _spans(parts: str, matches: str) -> str:
    """SQL for [(s, e, v)]: the matches with their ends, from the parts between them."""
    return f"""aggregate(zip_with({parts}, {matches}, (p, v) -> struct(p, v)),
        struct(0 AS at, CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, v: STRING>>) AS out),
        (a, x) -> struct(a.at + length(x.p) + coalesce(length(x.v), 0) AS at,
            CASE WHEN x.v IS NULL THEN a.out ELSE concat(a.out, array(struct(a.at + length(x.p) AS s, a.at + length(x.p) + length(x.v) AS e, x.v AS v))) END AS out),
        a -> a.out)"""


def _matched(text: str, kind: str) -> Column:
    pattern, must = PATTERNS[kind], _MUST[kind]
    found = _spans(f"split({text}, r'{pattern}', -1)", f"regexp_extract_all({text}, r'{pattern}', 0)")
    kept = f"""transform(filter({found}, x -> {_PASS[kind]}),
        x -> struct(x.s AS s, {KINDS.index(kind)} AS o, x.e AS e, '{kind}' AS kind, concat('{kind}:', {_ENTITY[kind]}) AS entity))"""
    none = "CAST(array() AS ARRAY<STRUCT<s: INT, o: INT, e: INT, kind: STRING, entity: STRING>>)"
    return F.expr(f"CASE WHEN contains({text}, '{must}') THEN {kept} ELSE {none} END")


def base_spans(text: str) -> Column:
    """[(s, o, e, kind, entity)] of a text column, by start, then kind."""
    return F.array_sort(F.concat(*(_matched(text, kind) for kind in PATTERNS)))


def scanned(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", keep: bool = False) -> DataFrame:
    """(k, h, base, text[, row]) for each row of docs: text is that of rows with spans, row holds all columns."""
    columns = [F.col(id_column).alias("k"), F.xxhash64(F.col(text_column)).alias("h"), F.coalesce(F.col(text_column), F.lit("")).alias("text")]
    if keep:
        columns.append(F.struct("*").alias("row"))
    found = docs.select(*columns).withColumn("base", base_spans("text"))
    return stored(found.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "scanned", like=docs)


def document_counts(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """(term, n_t): how many rows of docs hold each lower-cased word."""
    text = F.col(text_column)
    words = F.when(F.length(text) == F.octet_length(text), F.split(F.lower(text), GAP, -1)).otherwise(F.transform(F.split(text, GAP, -1), F.lower))  # the same for ASCII, and faster
    return docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def placed_terms(holding: DataFrame) -> DataFrame:
    """(k, h, term, s, e): the words of the texts, which must have different (k, h), with their places."""
    words = F.filter(F.split("text", GAP, -1), lambda w: w != "")
    pairs = F.zip_with(F.split("text", WORD, -1), words, lambda g, w: F.struct(F.length(g).alias("g"), w.alias("w")))
    rows = holding.select("k", "h", F.posexplode(pairs).alias("pos", "x")).select("k", "h", "pos", (F.col("x.g") + F.coalesce(F.length("x.w"), F.lit(0))).alias("n"), "x.w")
    rows = rows.withColumn("e", F.sum("n").over(Window.partitionBy("k", "h").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return rows.filter("w IS NOT NULL").select("k", "h", F.lower("w").alias("term"), (F.col("e") - F.length("w")).alias("s"), "e")


def representatives(holding: DataFrame) -> DataFrame:
    """(k, h, m, entity, n_c): of entities that the same documents hold the least one; n_c documents hold it."""
    entities = holding.select("k", "h", "m", F.explode(F.array_distinct("base.entity")).alias("entity"))
    d = F.xxhash64("k", "h")
    per = entities.groupBy("entity").agg(F.sum("m").alias("n_c"), F.min(d).alias("a"), F.max(d).alias("b"), F.sum(d.cast("decimal(38,0)")).alias("c"))
    return entities.join(per.groupBy("n_c", "a", "b", "c").agg(F.min("entity").alias("entity")).select("entity", "n_c"), "entity")


def disclosing(docs: DataFrame, found: DataFrame, *, text_column: str = "text", threshold: float = 0.8, prior: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """((entity, term, n_c, n_t, n_ct, disclosure) of the terms that give an entity away, (k, h, s, e, disclosure): their places).

    entity is the least of those that the same documents hold. A term too common for an entity, whatever n(c,t)
    is, is left out before they meet; no other is.
    """
    n = found.count()
    holding = found.filter(F.size("base") > 0).groupBy("k", "h").agg(F.count("*").alias("m"), F.first("base").alias("base"), F.first("text").alias("text"))
    holding = stored(holding, "holding", like=docs)
    terms = stored(placed_terms(holding.repartition("k", "h")), "terms", like=docs)
    share = F.lit(n) / F.col("n_c")
    most = (F.col("n_c") + prior / share) * share ** (1 - threshold) * (1 + 1e-9) - prior
    entities = stored(representatives(holding).withColumn("most", most), "entities", like=docs)
    common = entities.agg(F.max("most")).first()[0] or 0.0
    counts = document_counts(docs, text_column=text_column).filter(F.col("n_t") <= common)
    limits = entities.groupBy("k", "h").agg(F.max("most").alias("limit"))
    same = lambda a, b: F.expr(f"{a}.k <=> {b}.k AND {a}.h = {b}.h")
    seen = terms.select("k", "h", "term").distinct().join(counts, "term").alias("t").join(limits.alias("l"), same("t", "l")).filter("n_t <= limit").select("t.*")
    met = stored(seen.alias("t").join(entities.alias("c"), same("t", "c")).filter("n_t <= most").select("t.*", "m", "entity", "n_c"), "met", like=docs)
    given = (F.col("n_ct") + prior / share) / (F.col("n_t") + prior)
    scored = met.groupBy("entity", "term", "n_c", "n_t").agg(F.sum("m").alias("n_ct")).withColumn("disclosure", F.when(F.col("n_c") < n, F.log(given * share) / F.log(share)))
    scored = stored(scored.filter(F.col("disclosure") >= threshold), "disclosing", like=docs)
    worst = met.join(scored.select("entity", "term", "disclosure"), ["entity", "term"]).groupBy("k", "h", "term").agg(F.max("disclosure").alias("disclosure"))
    places = terms.alias("t").join(worst.alias("w"), F.expr("t.k <=> w.k AND t.h = w.h AND t.term = w.term")).select("t.k", "t.h", "t.s", "t.e", "w.disclosure")
    return scored, places


def _with_terms(found: DataFrame, places: DataFrame, remove: float) -> DataFrame:
    """found with spans: base, and the places of disclosing terms that no base span overlaps, by start, then kind."""
    entity = F.when(F.col("disclosure") >= remove, F.lit("term:removed")).otherwise(F.lit("term:generalised"))
    span = F.struct(F.col("s"), F.lit(KINDS.index("term")).alias("o"), F.col("e"), F.lit("term").alias("kind"), entity.alias("entity"))
    added = places.groupBy("k", "h").agg(F.collect_list(span).alias("added"))
    both = found.filter(F.size("base") > 0).alias("f").join(added.alias("a"), F.expr("f.k <=> a.k AND f.h = a.h"), "left").select("f.*", "a.added")
    free = F.expr("filter(added, t -> NOT exists(base, b -> t.s < b.e AND b.s < t.e))")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", free)))
    return both.withColumn("spans", spans).drop("added", "text").unionByName(found.filter(F.size("base") == 0).withColumn("spans", F.col("base")).drop("text"))


def find_personal_data(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8, prior: float = 1.0) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) for each row of docs.

    Null and empty texts have no spans. Rows that repeat an id with its text each get the same result and
    count as documents of their own; a null id stays null; an empty table gives no rows; further columns are
    ignored. An entity that all documents hold has no information to give away. n_term counts term spans.
    """
    found = scanned(docs, id_column=id_column, text_column=text_column)
    _, places = disclosing(docs, found, text_column=text_column, threshold=threshold, prior=prior)
    out = _with_terms(found, places, 1.0)
    listed = lambda c: F.array_join(F.expr(f"transform({c}, x -> concat(x.kind, ':', x.s, ':', x.e))"), ",")
    counts = [F.size(F.expr(f"filter(spans, x -> x.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return out.select(F.col("k").alias(id_column), *counts[:4], F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), counts[4])


def sanitise(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8, prior: float = 1.0, remove: float = 0.9) -> DataFrame:
    """docs with every span of their texts replaced: [EMAIL] and so on, [TERM], or nothing for removed terms.

    All rows and columns stay, null texts stay null. Overlapping spans become one, named by the first.
    """
    found = scanned(docs, id_column=id_column, text_column=text_column, keep=True)
    _, places = disclosing(docs, found, text_column=text_column, threshold=threshold, prior=prior)
    out = _with_terms(found, places, remove).withColumn("text", F.col(f"row.`{text_column}`"))
    text = F.expr(
        """CASE WHEN size(spans) = 0 THEN text ELSE aggregate(spans, struct(0 AS at, '' AS out), (a, x) -> struct(greatest(a.at, x.e) AS at,
        CASE WHEN x.s < a.at THEN a.out ELSE concat(a.out, substring(text, a.at + 1, x.s - a.at), CASE x.entity WHEN 'term:removed' THEN '' ELSE concat('[', upper(x.kind), ']') END) END AS out),
        a -> concat(a.out, substring(text, a.at + 1))) END"""
    )
    columns = [text.alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns)
