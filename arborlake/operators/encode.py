"""Schema inference and encoding as DataFrame operators: profiles, dictionaries, cutoffs, dates, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from arborlake.functions.scalars import NON_FINITE, common_prefix, date_formats, parsed_number, without_marker

NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.DecimalType, T.DayTimeIntervalType, T.YearMonthIntervalType)


def check_types(df: DataFrame, columns: list[str]) -> None:
    """ValueError for repeated names and for types that are neither numbers, booleans, texts nor times."""
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("feature names must be unique")
    for c in columns:
        if isinstance(df.schema[c].dataType, NESTED):
            raise ValueError(f"unsupported column type {df.schema[c].dataType.simpleString()} of {c!r}")


def as_text(df: DataFrame, c: str) -> Column:
    """A column as the text that inference sees; booleans are 0 and 1."""
    kind = df.schema[c].dataType
    return F.col(f"`{c}`").cast("int").cast("string") if isinstance(kind, T.BooleanType) else F.col(f"`{c}`").cast("string")


def profile(df: DataFrame, columns: list[str], markers: dict | None = None) -> DataFrame:
    """A row for each column: kind, values, distinct values, missing values, whether all are whole, least and greatest.

    One pass over the table whatever the number of columns; values are counted before they are looked at,
    so patterns run once for each distinct value. Kind is "numeric" where every value that is not
    missing parses as a number, "lexical" otherwise, "discarded" for columns without values or with one and
    nothing missing.
    """
    markers = markers or {}
    texts = F.array(*(F.struct(F.lit(c).alias("column"), without_marker(as_text(df, c), markers.get(c, "")).alias("text")) for c in columns))
    counts = df.select(F.explode(texts).alias("x")).groupBy("x.column", "x.text").agg(F.count("*").alias("n"))
    text, number = F.col("text"), parsed_number(F.col("text"))
    found = counts.groupBy("column").agg(
        F.sum(F.when(text.isNotNull(), F.col("n")).otherwise(0)).alias("values"),
        F.count(text).alias("distinct_values"),
        F.sum(F.when(text.isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.coalesce(F.bool_and(text.isNull() | number.isNotNull()), F.lit(False)).alias("numeric"),
        F.coalesce(F.bool_or(text.rlike(NON_FINITE)), F.lit(False)).alias("non_finite"),
        F.coalesce(F.bool_and(number == F.floor(number)), F.lit(False)).alias("all_int"),
    )
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string").join(found, "column", "left").fillna(0).fillna(False)
    kind = F.when((F.col("values") == 0) | ((F.col("distinct_values") <= 1) & (F.col("missing") == 0)), "discarded")
    return every.withColumn("kind", kind.when(F.col("numeric"), "numeric").otherwise("lexical")).drop("numeric")


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, rank, n): the sorted distinct values with dense ranks from 0."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", (F.dense_rank().over(Window.orderBy("value")) - 1).cast("long"))


def upper_median(values: DataFrame) -> DataFrame:
    """(median): of a dictionary's rows, the value at position n // 2 of all sorted values."""
    running = values.withColumn("upto", F.sum("n").over(Window.orderBy("value")))
    total = values.agg(F.sum("n").alias("total"))
    return running.crossJoin(F.broadcast(total)).filter(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("value").alias("median"))


def cutoffs(values: DataFrame, numeric: bool = True) -> DataFrame:
    """(rank, boundary): the greatest value left of a cut before the rank; texts have ranks for values."""
    if not numeric:
        return values.select("rank", F.greatest(F.lit(0.0), F.col("rank") - 1.0).alias("boundary"))
    return values.select("rank", F.coalesce(F.lag("value").over(Window.orderBy("value")), "value").cast("double").alias("boundary"))


def encode_ranks(df: DataFrame, column: str, values: DataFrame, out: str) -> DataFrame:
    """df with ranks; missing values have the rank after the last."""
    last = values.agg(F.count("*").alias("_last"))
    small = values.select(F.col("value").alias("_value"), F.col("rank").alias(out))
    joined = df.join(small, df[column] == F.col("_value"), "left").crossJoin(F.broadcast(last))
    return joined.withColumn(out, F.coalesce(F.col(out), F.col("_last"))).drop("_value", "_last")


def text_positions(unseen: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """(column, position): a known text's rank; an unseen one's is half below the rank of the next text.

    Distinct texts and the dictionary are merged in one ordered pass over hash ranges of their first letters.
    """
    texts = unseen.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    both = values.select("value", F.lit(1).alias("known")).unionByName(texts.join(values.select("value"), "value", "left_anti").withColumn("known", F.lit(0)))
    ordered = both.withColumn("before", F.sum("known").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = ordered.select("value", F.when(F.col("known") == 1, F.col("before") - 1.0).otherwise(F.col("before") - 0.5).alias("position"))
    return texts.join(placed, "value").select(F.col("value").alias(column), "position")


def detect_dates(df: DataFrame, columns: list[str], key: str, rows: int = 200, seed: int = 0) -> dict[str, str]:
    """{column: format} where every value of a bounded sample has the format; the first such format.

    One aggregation tests all formats of all columns on the different texts of at most ``rows`` rows.
    """
    from arborlake.functions.sampling import sample_rows

    some = sample_rows(df.select(key, *columns) if key not in columns else df.select(*columns), rows, seed, "dates", key)
    formats = date_formats()
    texts = F.array(*(F.struct(F.lit(c).alias("column"), as_text(some, c).alias("text")) for c in columns))
    tried = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(pattern).alias("pattern"), F.lit("%Y" in f).alias("dated")) for j, (f, pattern) in enumerate(formats)))
    rows = some.select(F.explode(texts).alias("x")).select("x.*").filter(F.trim("text") != "").distinct().select("column", "text", F.explode(tried).alias("f"))
    stamp = F.try_to_timestamp(F.col("text"), F.col("f.pattern"))
    fits = stamp.isNotNull() & (~F.col("f.dated") | F.year(stamp).between(1900, 2100))
    good = rows.groupBy("column", "f.j").agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("all")).filter("all").groupBy("column").agg(F.min("j").alias("j"))
    first = {r["column"]: formats[r["j"]][0] for r in good.collect()}
    return {c: first[c] for c in columns if c in first}


def binary_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns without missing values that hold 0 and 1, both, and nothing else: one aggregation."""
    if not columns:
        return []
    number = {c: parsed_number(as_text(df, c)) for c in columns}
    row = df.agg(*(F.struct(F.bool_and(F.coalesce(number[c].isin(0.0, 1.0), F.lit(False))), F.min(number[c]), F.max(number[c])).alias(f"b{i}") for i, c in enumerate(columns))).first()
    return [c for i, c in enumerate(columns) if row[f"b{i}"][0] and (row[f"b{i}"][1], row[f"b{i}"][2]) == (0.0, 1.0)]


def conflicts(df: DataFrame, flags: list[str]) -> DataFrame:
    """(a, b, both): how many rows have both flags, for each pair of flag columns."""
    active = F.array_compact(F.array(*(F.when(parsed_number(as_text(df, c)) == 1, F.lit(c)) for c in flags)))
    pairs = df.select(F.explode(active).alias("a"), active.alias("all")).select("a", F.explode("all").alias("b")).filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("both"))


def bundles(df: DataFrame, columns: list[str], names: list[str] | None = None) -> list[tuple[str, list[str]]]:
    """[(name, members)]: exclusive flags that together cover more than half the rows of df (a bounded sample).

    Flags are coloured greedily, those with most conflicts first; members are ordered by how rare they are.
    """
    flags = binary_columns(df, columns)
    if len(flags) < 2:
        return []
    against: dict[str, set[str]] = {c: set() for c in flags}
    for a, b, _ in conflicts(df, flags).collect():
        against[a].add(b)
        against[b].add(a)
    colours: list[list[str]] = []
    for c in sorted(flags, key=lambda c: (-len(against[c]), columns.index(c))):
        home = next((colour for colour in colours if not against[c] & set(colour)), None)
        if home is None:
            colours.append([c])
        else:
            home.append(c)
    colours = [c for c in colours if len(c) > 1]
    if not colours:
        return []
    value = {c: parsed_number(as_text(df, c)) for c in flags}
    row = df.agg(F.count("*").alias("n"), *(F.sum(F.greatest(*(value[c] for c in colour))).alias(f"covered{i}") for i, colour in enumerate(colours)), *(F.sum(value[c]).alias(f"active_{c}") for c in flags)).first()
    used, out = set(names or df.columns), []
    for i, colour in enumerate(colours):
        if row[f"covered{i}"] * 2 <= row["n"]:
            continue
        members = sorted(colour, key=lambda c: (row[f"active_{c}"], columns.index(c)))
        name = common_prefix(members)
        if not name or name in used:
            name = next(f"bundle_{k}" for k in range(1, len(used) + 2) if f"bundle_{k}" not in used)
        used.add(name)
        out.append((name, members))
    return sorted(out, key=lambda b: min(columns.index(c) for c in b[1]))


def bundle_code(values: list[Column]) -> Column:
    """1 for the first member that is 1, and so on; 0 for none; null where none is 1 and one is missing.

    A member that is neither 0 nor 1 is an error.
    """
    bad = ~F.coalesce(values[0].isin(0, 1), F.lit(True))
    for v in values[1:]:
        bad = bad | ~F.coalesce(v.isin(0, 1), F.lit(True))
    code = F.when(bad, F.raise_error(F.lit("a bundle member is neither 0 nor 1")).cast("int")).when(values[0] == 1, 1)
    for i, v in enumerate(values[1:], 2):
        code = code.when(v == 1, i)
    missing = values[0].isNull()
    for v in values[1:]:
        missing = missing | v.isNull()
    return code.when(missing, None).otherwise(0)


def class_dictionary(df: DataFrame, label: str) -> DataFrame:
    """(label, class_id): sorted distinct labels; ValueError for missing ones and for fewer than two."""
    known = df.groupBy(label).agg(F.count("*").alias("n"))
    first = known.agg(F.count(label).alias("classes"), F.count("*").alias("rows")).first()
    if first["rows"] > first["classes"]:
        raise ValueError("class labels cannot be missing")
    if first["classes"] < 2:
        raise ValueError("classification requires at least two classes")
    return known.select(label, (F.row_number().over(Window.orderBy(label)) - 1).cast("long").alias("class_id"))
