"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index is stored in the shared folder as segments: each task writes the postings (word, document, position)
of its documents, sorted by word, so no word's list meets in one task, however common it is, and a reader of
few words skips most of a segment. A document's length is a posting too.

Lists are stored as the intersection asks for them. Each window of the test items has its terms ranked by
their counts in the whole corpus. First the lists of the ``RANKS`` rarest terms of every window are stored; the rarest
proposes where the window may lie, and its list is intersected with the next', each less its term's offset
in the item. For the documents that are left, usually few, the lists of all other terms of the windows that are left are
stored and intersected alike. Runs of a window's length are exact phrase matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arborlake.llm.shared import small, stored, tasks_for

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words in a lower-cased text: ASCII that is neither a digit nor a small letter.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rarest terms of a window whose lists are stored for all documents.
RANKS = 2
#: The words of length postings, by how many empty words a document's ends have.
LENGTHS = (" 0", " 1", " 2")


def lowered_words(text: Column) -> Column:
    """Words after lower-casing A-Z; the first and the last may be empty, which shifts positions alike."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))  # lower() is faster, and the same for ASCII
    return F.split(lowered, SEPARATOR, -1)


def keyed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(k, h, text): an id with its text's hash names a document, so equal rows are one document."""
    text = F.col(text_column)
    return df.select(F.col(id_column).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))


def postings(docs: DataFrame, terms: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, k, h, pos): the places of the given terms (word), which must be distinct.

    Null and empty texts have none; repeated rows repeat theirs; a null id is the null k. Positions count an
    empty word before a leading separator, in all lists alike.
    """
    spread = keyed(docs, id_column, text_column).select("k", "h", F.posexplode(lowered_words(F.col("text"))).alias("pos", "word"))
    return spread.join(terms.select("word"), "word").select("word", "k", "h", "pos")


def stored_index(docs: DataFrame, terms: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """postings() of the terms, stored as segments sorted by word, with a posting for each document's length.

    A length's word is one of LENGTHS, which no text holds; see lengths().
    """
    words = F.col("words")
    empty = (words[0] == "").cast("int") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    split = keyed(docs, id_column, text_column).select("k", "h", lowered_words(F.col("text")).alias("words"))
    spread = split.select("k", "h", F.posexplode(F.concat(words, F.array(F.concat(F.lit(" "), empty.cast("string"))))).alias("pos", "word"))
    wanted = terms.select("word").union(docs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, LENGTHS)))))
    rows = spread.join(wanted, "word").select("word", "k", "h", "pos").coalesce(tasks_for(docs))
    return stored(rows.sortWithinPartitions("word"), "index")


def lengths(index: DataFrame) -> DataFrame:
    """(k, h, n_words) for each row of the indexed documents."""
    found = index.filter(F.col("word").isin(*LENGTHS))
    return found.select("k", "h", (F.col("pos") - F.trim("word").cast("int")).cast("long").alias("n_words"))


def item_terms(items: DataFrame, *, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item, ih, i, word, n): the items' words by place; n is the item's word count. Equal rows are one item."""
    rows = keyed(items, id_column, text_column).distinct()
    words = F.filter(lowered_words(F.col("text")), lambda w: w != "")
    return rows.withColumn("words", words).select(F.col("k").alias("item"), F.col("h").alias("ih"), F.posexplode("words").alias("i", "word"), F.size("words").alias("n"))


def leads(terms: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, ih, n, w0, i0, w1, i1, first, last): the RANKS rarest terms of windows first to last, rarest first.

    Windows that slide over the same rarest terms are one row. Windows with a term that the corpus lacks
    fall out; those of fewer terms than RANKS repeat their commonest.
    """
    counted = terms.join(counts, "word", "left").fillna(0, ["count"])
    first, last = F.greatest(F.lit(0), F.col("i") - window + 1), F.greatest(F.lit(0), F.least(F.col("i"), F.col("n") - window))
    spread = counted.withColumn("s", F.explode(F.sequence(F.least(first, last), last)))
    ranked = spread.groupBy("item", "ih", "n", "s").agg(F.array_sort(F.collect_list(F.struct("count", "word", "i"))).alias("t")).filter("t[0].count > 0")
    at = [F.col("t")[F.least(F.lit(r), F.size("t") - 1)] for r in range(RANKS)]
    named = [x.alias(f"{name[0]}{r}") for r, t in enumerate(at) for name, x in (("word", t["word"]), ("i", t["i"]))]
    by = ["item", "ih", "n", *(f"{c}{r}" for r in range(RANKS) for c in "wi")]
    return ranked.select("item", "ih", "n", "s", *named).groupBy(*by).agg(F.min("s").alias("first"), F.max("s").alias("last"))


def _intersected(left: DataFrame, index: DataFrame, word: str, offset: str) -> DataFrame:
    """The rows of left (k, h, delta, ...) with a posting of their word at delta + offset."""
    a, b = left.alias("a"), index.filter(~F.col("word").isin(*LENGTHS)).alias("b")
    return a.join(b, F.expr(f"a.{word} = b.word AND a.h = b.h AND a.k <=> b.k AND a.delta + a.{offset} = b.pos"), "left_semi")


def matches(docs: DataFrame, items: DataFrame, window: int, *, doc_columns: dict, item_columns: dict) -> tuple[DataFrame, DataFrame]:
    """((k, h, item, ih, delta, n, i): item terms found at document position delta + i, and the lengths()).

    All terms of each window that lies in a document are there, and some of windows that do not.
    """
    terms = stored(item_terms(items, **item_columns), "item-terms", like=items)
    text = F.col(doc_columns["text_column"])
    words = docs.select(F.explode(lowered_words(text)).alias("word")).join(terms.select("word").distinct(), "word")
    ranked = stored(leads(terms, words.groupBy("word").count(), window), "leads", like=items)
    chosen = ranked.select(F.explode(F.array(*(f"w{r}" for r in range(RANKS)))).alias("word")).distinct()
    index = stored_index(docs, chosen, **doc_columns)
    places = index.join(ranked, F.col("word") == F.col("w0")).withColumn("delta", F.col("pos") - F.col("i0")).drop("word", "pos")
    for r in range(1, RANKS):
        places = _intersected(places, index, f"w{r}", f"i{r}")
    left = stored(places.select("k", "h", "item", "ih", "n", "delta", "first", "last"), "places", like=docs)
    offsets = F.sequence(F.col("first"), F.least(F.col("n") - 1, F.col("last") + window - 1))
    wanted = left.select("k", "h", "item", "ih", "delta", F.explode(offsets).alias("i")).distinct().alias("a")
    wanted = wanted.join(terms.alias("t"), F.expr("a.item <=> t.item AND a.ih = t.ih AND a.i = t.i")).select("a.*", "t.word", "t.n")
    of = stored(left.select(F.col("k").alias("_k"), F.col("h").alias("_h")).distinct(), "documents-left", like=docs)
    some = docs.join(small(of), docs[doc_columns["id_column"]].eqNullSafe(F.col("_k")) & (F.xxhash64(docs[doc_columns["text_column"]]) == F.col("_h")), "left_semi")
    rest = terms.alias("t").join(left.alias("l"), F.expr("l.item <=> t.item AND l.ih = t.ih"), "left_semi").select("word").distinct()
    return _intersected(wanted, stored_index(some, rest, **doc_columns), "word", "i"), lengths(index)


def exact_runs(found: DataFrame, window: int) -> DataFrame:
    """(k, h, item, begin, length): maximal runs of matched terms that hold a window."""
    place = ["k", "h", "item", "ih", "delta"]
    rows = found.select(*place, "n", "i").distinct().withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(*place).orderBy("i")))
    runs = rows.groupBy(*place, "run").agg(F.min("i").alias("i"), F.count("*").alias("length"), F.first("n").alias("n"))
    return runs.filter(F.col("length") >= F.least(F.lit(window), F.col("n"))).select("k", "h", "item", (F.col("delta") + F.col("i")).alias("begin"), "length")


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, *, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    Null and empty texts have no words and no hits, as documents and as items. Rows that repeat an id with
    its text are one document and each gets its result; a null id stays null. Items that share an id count
    once. Without documents there are no rows; without items nothing is hit. Further columns are ignored.
    """
    return _contamination(docs, items, window, id_column=id_column, text_column=text_column, item_id=item_id, item_text=item_text).drop("_h")


def _contamination(docs: DataFrame, items: DataFrame, window: int, *, id_column: str, text_column: str, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """contamination()'s rows with their text's hash, _h."""
    found, sizes = matches(docs, items, window, doc_columns={"id_column": id_column, "text_column": text_column}, item_columns={"id_column": item_id, "text_column": item_text})
    runs = stored(exact_runs(found, window), "runs", like=docs)
    positions = runs.select("k", "h", F.explode(F.expr("sequence(begin, begin + CAST(length AS INT) - 1)")).alias("pos")).distinct()
    hit = positions.groupBy("k", "h").agg(F.count("*").alias("n_hit"))
    names = runs.groupBy("k", "h").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("names"))
    found = hit.alias("p").join(names.alias("q"), F.expr("p.k <=> q.k AND p.h = q.h")).select("p.k", "p.h", "p.n_hit", "q.names")
    out = sizes.alias("c").join(found.alias("f"), F.expr("c.k <=> f.k AND c.h = f.h"), "left")
    n_hit = F.coalesce("f.n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("c.k").alias(id_column),
        "c.n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("f.names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("f.names", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("c.h").alias("_h"),
    )


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 10, *, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k, item, begin, length): the longest stretches of items, of a window or more, that lie in the documents.

    begin is a word position as in postings(). Rows that repeat an id with its text give their stretches
    once; a null id or item stays null; null, empty and missing texts on either side give no rows; further
    columns are ignored. An item that lies in a document at several places has a row for each.
    """
    found, _ = matches(docs, items, window, doc_columns={"id_column": id_column, "text_column": text_column}, item_columns={"id_column": item_id, "text_column": item_text})
    return exact_runs(found, window).select("k", "item", "begin", "length")


def proximity_matches(docs: DataFrame, phrases: DataFrame, span: int, *, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k, item, begin): the rarest term of an item lies at begin and all its other terms within span words of it.

    Terms count as a set; the order is free; of terms that tie as the rarest the first in order counts.
    Postings of a phrase's terms meet on the document and on blocks of span positions, so a document's
    postings are never paired with each other at large. Rows that repeat an id with its text give their
    places once; a null id or item stays null; null, empty and missing texts on either side give no rows;
    further columns are ignored.
    """
    terms = item_terms(phrases, id_column=item_id, text_column=item_text).select("item", "ih", "word").distinct()
    found = stored_index(docs, terms.select("word").distinct(), id_column=id_column, text_column=text_column)
    counts = found.groupBy("word").count()
    wanted = terms.join(counts, "word", "left").fillna(0, ["count"])
    per = wanted.groupBy("item", "ih").agg(F.count("*").alias("n"), F.min(F.struct("count", "word")).alias("r")).filter("r.count > 0")
    centre = per.join(found, per.r.word == found.word).select("item", "ih", "n", "k", "h", F.col("pos").alias("begin"))
    near = centre.withColumn("block", F.explode(F.expr(f"sequence(greatest(0, begin - {span}) div {span + 1}, (begin + {span}) div {span + 1})")))
    others = found.join(terms, "word").withColumn("block", F.expr(f"pos div {span + 1}"))
    met = near.alias("a").join(others.alias("b"), F.expr("a.k <=> b.k AND a.h = b.h AND a.item <=> b.item AND a.ih = b.ih AND a.block = b.block"))
    met = met.filter(F.expr(f"abs(b.pos - a.begin) <= {span}"))
    return met.groupBy("a.k", "a.h", "a.item", "a.ih", "a.begin", "a.n").agg(F.countDistinct("b.word").alias("got")).filter("got = n").select("k", "item", "begin")


def clean(docs: DataFrame, items: DataFrame, window: int = 10, *, id_column: str = "doc_id", text_column: str = "text", **columns) -> DataFrame:
    """docs without those that hold a window of an item; all columns stay as they are.

    A row goes by its id and text: clean rows that share an id, or its lack, with a contaminated one stay.
    """
    found = _contamination(docs, items, window, id_column=id_column, text_column=text_column, **columns)
    hit = stored(found.filter("contaminated").select(F.col(id_column).alias("_hit"), "_h").distinct(), "contaminated", like=docs)
    return docs.join(small(hit), docs[id_column].eqNullSafe(F.col("_hit")) & (F.xxhash64(docs[text_column]) == F.col("_h")), "left_anti")
