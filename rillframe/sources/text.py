"""Lines, bytes, characters, CSV and TSV: readers and writers.

A text file is read as rows of lines, in parallel; the order of its lines comes from the place of each row: files by name, then splits, then
lines. Lines that a quoted field goes over are put together by a prefix scan over an automaton of two states. Records with a wrong number of fields or broken quotes are bad: plain readers stop before the first bad record, `_err` readers
return (ok, value, err) rows and go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rillframe.ordered import IDX, Ordered, in_order
from rillframe.session import stable
from rillframe.sources.memory import O

BAD = "__bad"


# --- lines


def from_lines(spark: SparkSession, path: str, separator: str | None = None) -> Ordered:
    """value: the lines of a file or folder, without line ends. A missing path raises an AnalysisException."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    # a split's rows keep their order in the id; a file's splits are ordered by where they begin
    return Ordered(rows, ["__file", "__block", "__line"])


from_file_lines = from_reader_lines = must_from_file_lines = from_scanner = from_lines


def from_lines_err(spark: SparkSession, path: str, longest: int = 64 * 1024, separator: str | None = None) -> Ordered:
    """(ok, value, err): a line longer than `longest` characters is an error and ends the rows."""
    lines = from_lines(spark, path, separator)
    bad = F.length("value") > longest
    rows = lines.df.select(*[c for c in lines.df.columns if c != "value"], (~bad).alias("ok"), F.when(~bad, F.col("value")).alias("value"), F.when(bad, F.lit("token too long")).alias("err"))
    return _until_bad(Ordered(rows, lines.order), F.col("err").isNotNull(), keep_bad=True)


from_scanner_err = from_reader_lines_err = from_lines_err


def _until_bad(s: Ordered, bad: Column, keep_bad: bool = False) -> Ordered:
    """Rows before the first bad one, found by one aggregate."""
    first = s.df.where(bad).agg(F.min(F.struct(*s.order)).alias("__first"))
    at = F.struct(*s.order)
    joined = s.df.crossJoin(F.broadcast(first))  # one row
    keep = F.col("__first").isNull() | ((at <= F.col("__first")) if keep_bad else (at < F.col("__first")))
    return s.with_df(joined.where(keep).drop("__first"))


def from_string_lines(df: DataFrame, column: str) -> Ordered:
    """value: the lines of a string; a last line end adds none, an empty string has none."""
    parts = F.split(F.regexp_replace(F.col(column), r"\r?\n\z", ""), r"\r?\n")
    rows = df.where(F.length(column) > 0).select(F.posexplode(parts).alias(O, "value"))
    return Ordered(rows.select("value", F.col(O).cast("long").alias(O)), [O])


def from_bytes(df: DataFrame, column: str) -> Ordered:
    """value: the bytes of a binary or string column as smallint, 0 to 255."""
    raw = F.col(column).cast("binary")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("smallint")
    rows = df.where(F.octet_length(raw) > 0).select(F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length(raw)), byte)).alias(O, "value"))
    return Ordered(rows.select("value", F.col(O).cast("long").alias(O)), [O])


def from_runes(df: DataFrame, column: str) -> Ordered:
    """value: the code points of a string."""
    rows = df.where(F.length(column) > 0).select(F.posexplode(F.transform(F.split(F.col(column), ""), F.ascii)).alias(O, "value"))
    return Ordered(rows.select("value", F.col(O).cast("long").alias(O)), [O])


# --- CSV and TSV


_INNER = r'[^"]*+(?:""[^"]*+)*+'
_QUOTED = f'"{_INNER}"'


def _patterns(separator: str) -> tuple[str, str]:
    """The separator and an unquoted field, as patterns. Repetition is possessive, so that long fields need no stack."""
    sep = "\\t" if separator == "\t" else "\\" + separator
    return sep, rf'[^"{sep}]*+'


def _whole(lines: Ordered, separator: str) -> Ordered:
    """value: the lines, those of one record put together with line ends between them.

    Each line is a function of whether a quoted field is open before it. The state before a line follows from the last line after which it is
    known whatever came before, and the number of lines since that turn it; both are prefix aggregates. Files begin outside.
    """
    sep, plain = _patterns(separator)
    value = F.col("value")
    opens = value.rlike(rf'\A(?:(?:{_QUOTED}|{plain}){sep})*+"{_INNER}\z')
    stays = value.rlike(rf'\A{_INNER}(?:"(?:{sep}(?:{_QUOTED}|{plain}(?={sep}|\z)))*+{sep}"{_INNER})?\z')
    if lines.df.where(opens).isEmpty():
        return lines
    s = lines.over(1, 0, __before=lambda w: F.lag("__file").over(w))
    first = F.col("__before").isNull() | (F.col("__before") != F.col("__file"))
    s = s.with_df(s.df.withColumn("__first", first).withColumn("__outside", opens).withColumn("__inside", F.when(first, opens).otherwise(stays)).withColumn("__turn", (F.col("__outside") & ~F.col("__inside")).cast("long")).drop("__before"))
    s = s.running("__turns", lambda w: F.sum("__turn").over(w), lambda: F.sum("__turn"), lambda w: F.sum("__total").over(w), lambda carry, own: carry + own)
    known = F.when(F.col("__outside") == F.col("__inside"), F.struct(IDX, F.col("__outside").cast("long").alias("state"), "__turns"))
    s = s.with_df(s.df.withColumn("__known", known))
    s = s.running("__last", lambda w: F.max("__known").over(w), lambda: F.max("__known"), lambda w: F.max("__total").over(w), lambda carry, own: F.greatest(carry, own))
    state = (F.coalesce(F.col("__last.state"), F.lit(0)) + F.col("__turns") - F.coalesce(F.col("__last.__turns"), F.lit(0))) % 2
    s = s.with_df(s.df.withColumn("__state", state).select("value", IDX, "__state", "__first"))
    s = s.over(1, 0, __open=lambda w: F.lag("__state").over(w))
    s = s.with_df(s.df.withColumn("__head", F.when(F.col("__first") | (F.col("__open") == 0), F.col(IDX))))
    s = s.running("__record", lambda w: F.max("__head").over(w), lambda: F.max("__head"), lambda w: F.max("__total").over(w), lambda carry, own: F.greatest(carry, own))
    return Ordered(s.df.groupBy("__record").agg(F.array_join(in_order("value", IDX), "\n").alias("value")), ["__record"])


def _records(spark: SparkSession, path: str, separator: str) -> Ordered:
    """value: array of fields, or null and BAD: of each record that isn't a blank line. Quotes as in RFC 4180; a quoted field may hold line ends."""
    lines = from_lines(spark, path, "\n")
    lines = _whole(lines.with_df(lines.df.withColumn("value", F.regexp_replace("value", r"\r\z", ""))), separator)
    rows = lines.df.where(F.length("value") > 0)
    sep, plain = _patterns(separator)
    good = F.col("value").rlike(rf"\A(?:{_QUOTED}|{plain})(?:{sep}(?:{_QUOTED}|{plain}))*+\z")
    # a separator before each field makes every match non-empty
    cells = F.regexp_extract_all(F.concat(F.lit(separator), F.col("value")), F.lit(rf"{sep}({_QUOTED}|{plain})"), F.lit(1))
    clean = F.transform(cells, lambda c: F.when(c.startswith('"'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return Ordered(rows.withColumn(BAD, ~good).withColumn("value", F.when(good, clean)), lines.order)


def _width(records: Ordered) -> int | None:
    """The number of fields of the first record that can be read."""
    found = records.df.where(~F.col(BAD)).orderBy(*records.order).select(F.size("value")).first()
    return None if found is None else found[0]


def from_csv(spark: SparkSession, path: str, separator: str = ",") -> Ordered:
    """value: array<string>, the header among them; the first record sets the number of fields, and rows end before the first bad one."""
    records = _records(spark, path, separator)
    width = _width(records)
    bad = F.col(BAD) | (F.size("value") != F.lit(width if width is not None else 0))
    out = _until_bad(records, bad)
    return out.with_df(out.df.drop(BAD))


def from_csv_err(spark: SparkSession, path: str, separator: str = ",") -> Ordered:
    """(ok, value, err): bad records are errors, and the rows go on."""
    records = _records(spark, path, separator)
    width = _width(records)
    wrong = F.size("value") != F.lit(width if width is not None else 0)
    err = F.when(F.col(BAD), F.lit('bare " in non-quoted field or unclosed quote')).when(wrong, F.lit("wrong number of fields"))
    rows = records.df.withColumn("err", err).withColumn("ok", F.col("err").isNull()).withColumn("value", F.when(F.col("ok"), F.col("value"))).drop(BAD)
    return records.with_df(rows)


from_csv_file = must_from_csv_file = from_csv


def from_tsv(spark: SparkSession, path: str) -> Ordered:
    return from_csv(spark, path, "\t")


from_tsv_file = must_from_tsv_file = from_tsv


def from_tsv_err(spark: SparkSession, path: str) -> Ordered:
    return from_csv_err(spark, path, "\t")


def from_csv_with_header(spark: SparkSession, path: str, separator: str = ",") -> Ordered:
    """record: map<string,string> by the names of the first record; the last of equal names wins."""
    records = from_csv(spark, path, separator)
    return _named(records, F.col("value"))


def _named(records: Ordered, fields: Column) -> Ordered:
    head = records.df.orderBy(*records.order).limit(1).select(*[F.col(c).alias(f"__h{i}") for i, c in enumerate(records.order)], F.col("value").alias("__names"))
    at, first = F.struct(*records.order), F.struct(*[f"__h{i}" for i in range(len(records.order))])
    rows = records.df.crossJoin(F.broadcast(head)).where(at > first)
    # the last of equal names: entries from the right, each name once
    pairs = F.reverse(F.arrays_zip(F.col("__names").alias("key"), fields.alias("value")))
    kept = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, p: F.when(F.exists(acc, lambda q: q["key"] == p["key"]), acc).otherwise(F.concat(acc, F.array(F.struct(p["key"].alias("key"), p["value"].alias("value"))))))
    record = F.map_from_entries(F.reverse(kept))
    extra = [c for c in ("ok", "err") if c in rows.columns]
    return records.with_df(rows.select(F.when(F.col("value").isNotNull(), record).alias("record"), *extra, *records.order))


def from_csv_with_header_err(spark: SparkSession, path: str, separator: str = ",") -> Ordered:
    """(ok, record, err); an empty input is one error."""
    records = from_csv_err(spark, path, separator)
    if records.df.isEmpty():
        rows = spark.range(1).select(F.lit(False).alias("ok"), F.lit(None).cast("map<string,string>").alias("record"), F.lit("EOF").alias("err"), F.col("id").alias(O))
        return Ordered(rows, [O])
    return _named(records, F.col("value"))


def record_get(record: Column | str, field: str) -> Column:
    """The field, or an empty string."""
    return F.coalesce(F.try_element_at(F.col(record) if isinstance(record, str) else record, F.lit(field)), F.lit(""))


def record_get_or(record: Column | str, field: str, default: str) -> Column:
    """The field, also if it is empty, or the default if there is none."""
    record = F.col(record) if isinstance(record, str) else record
    return F.when(F.map_contains_key(record, field), F.try_element_at(record, F.lit(field))).otherwise(F.lit(default))


def read_csv_columns(spark: SparkSession, path: str, names: list[str], separator: str = ",") -> DataFrame:
    """The fast form where order and first errors don't matter: string columns, parsed and pruned by Spark's own reader."""
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.csv(path, schema=schema, sep=separator, header=True, mode="DROPMALFORMED", quote='"', escape='"')


# --- sinks


def to_file(s: Ordered, path: str, line: Column) -> None:
    """A folder of text: a line for each row, sorted over the part files by name."""
    s.df.orderBy(*s.order).select(line.cast("string").alias("value")).write.mode("overwrite").text(path)


def to_writer(s: Ordered, out, line: Column) -> None:
    """The lines, in order, to a file object of the driver; rows stream through one partition at a time."""
    for row in s.df.orderBy(*s.order).select(line.cast("string").alias("value")).toLocalIterator():
        out.write(f"{row[0]}\n")


def csv_line(fields: Column, separator: str = ",") -> Column:
    """An array of strings as one line by RFC 4180: quoted where a field holds the separator, a quote, a line end or a leading space."""
    sep, _ = _patterns(separator)
    quote = lambda c: F.when(c.rlike(rf'["\r\n{sep}]|^\s'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.array_join(F.transform(fields, quote), separator)


def to_csv_file(s: Ordered, path: str, fields: Column | None = None, separator: str = ",") -> None:
    to_file(s, path, csv_line(F.col("value") if fields is None else fields, separator))


def to_csv(s: Ordered, out, fields: Column | None = None, separator: str = ",") -> None:
    to_writer(s, out, csv_line(F.col("value") if fields is None else fields, separator))


def close(s: Ordered) -> None:
    """Nothing to close: Spark opens and closes files itself."""


def cached(s: Ordered) -> Ordered:
    """s read once: for a source whose rows may change between jobs."""
    return s.with_df(stable(s.df))
