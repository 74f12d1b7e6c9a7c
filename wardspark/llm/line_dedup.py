"""Line dedup by the hashes of line windows (operator 1).

Each document is a sequence of line hashes. From every line starts a window, and at every line
ends one: the shortest run of lines that has ``window_lines`` lines or ``window_words`` words.
A run that is long enough is covered by the windows that start or end in it and lie in it, so
lines of later repeated runs are those of the windows whose hash occurs at an earlier place.
Every window meets its earliest equal one by a grouped minimum; no pairs of documents are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, stored

WINDOW_LINES, WINDOW_WORDS = 4, 50


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, seq, h, words): lines with at least one letter or digit; seq counts these lines only."""
    blank = F.trim(F.regexp_replace(F.lower(F.col("line")), r"\s+", " "))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", blank.alias("line"))
    return lines.where(F.col("line").rlike(r"[\p{L}\p{N}]")).select(
        "doc_id", "pos", F.unhex(F.md5("line")).alias("h"), F.size(F.split("line", " ")).alias("words")
    )


def _windows(lines: Column, window_lines: int, window_words: int) -> Column:
    """Different shortest windows of an array of (pos, h, words) as (at, h, positions); h is a 128-bit hash of the line hashes."""

    def size(i: Column, step: int) -> Column:
        # Lines from i on, or back from i, until they are enough; null if the document has too few.
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"), F.lit(False).alias("done"))

        def add(acc: Column, k: Column) -> Column:
            line = F.get(lines, i + k * step)
            words = F.when(acc["done"], acc["words"]).otherwise(acc["words"] + F.coalesce(line["words"], F.lit(0)))
            n = F.when(acc["done"] | line.isNull(), acc["n"]).otherwise(acc["n"] + 1)
            return F.struct(n.alias("n"), words.alias("words"), ((n >= window_lines) | (words >= window_words)).alias("done"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(window_lines - 1)), start, add, lambda acc: F.when(acc["done"], acc["n"]))

    every = F.sequence(F.lit(0), F.size(lines) - 1)
    ahead = F.transform(every, lambda i: F.struct(i.alias("at"), size(i, 1).alias("n")))
    behind = F.transform(F.transform(every, lambda i: F.struct(i.alias("i"), size(i, -1).alias("n"))), lambda x: F.struct((x["i"] - x["n"] + 1).alias("at"), x["n"].alias("n")))
    # Windows that end at different lines differ, so one that ends here repeats at most the one that starts where it does.
    behind = F.filter(behind, lambda x: x["n"] != F.coalesce(size(x["at"], 1), F.lit(0)))
    whole = F.filter(F.concat(ahead, behind), lambda x: x["n"].isNotNull())
    cut = F.transform(whole, lambda x: F.struct(x["at"].alias("at"), F.slice(lines, x["at"] + 1, x["n"]).alias("run")))
    joined = lambda run: F.concat(*[F.coalesce(F.get(run, F.lit(k))["h"], F.lit(b"")) for k in range(window_lines)])
    return F.transform(cut, lambda x: F.struct(x["at"].alias("at"), F.unhex(F.md5(joined(x["run"]))).alias("h"), x["run"]["pos"].alias("positions")))


def repeated_lines(
    docs: DataFrame, window_lines: int = WINDOW_LINES, window_words: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, pos): lines, counted from 0, of later repeated runs.

    A run of consecutive lines (blank ones aside) is repeated if it equals, line by line, any run
    that starts earlier in the order of doc_id and position and has ``window_lines`` lines or ``window_words`` words.
    Lines are equal if they are after lower-casing and collapsing white space.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    rows = rows.withColumn("copy", F.xxhash64("text"))
    # A repeated id with other text takes the place of its smallest hash only; see drop_repeated_lines.
    lines = line_table(rows.select(F.struct("doc_id", "copy").alias("doc_id"), "text"))
    lines = lines.select("doc_id.doc_id", "doc_id.copy", "pos", "h", "words").distinct()
    arrays = lines.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "words"))).alias("lines"))
    windows = arrays.select("doc_id", "copy", F.explode(_windows(F.col("lines"), window_lines, window_words)).alias("x"))
    windows = stored(windows.select("doc_id", "copy", "x.at", "x.h", "x.positions"), "line-windows")
    place = F.struct("doc_id", "copy", "at")
    first = windows.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first")
    # Stored, so that a large join starts from plain shuffles, whose skewed parts Spark can split.
    later = windows.join(sized(stored(first, "first-windows"), 96), "h").where(place > F.col("first"))
    return later.select("doc_id", "copy", F.explode("positions").alias("pos")).distinct()


def drop_repeated_lines(
    docs: DataFrame, window_lines: int = WINDOW_LINES, window_words: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, text (without later repeated runs), lines_in, lines_out, deleted (positions).

    Documents of which every line is deleted come out with an empty text. Blank lines stay, but
    go with their document if nothing else of it is left. Null texts stay null with no lines. Rows that repeat an id
    with equal text take one place in the order, so none is a repeat of the other, and all get the
    same result; with different texts the one with the smaller hash is earlier. Rows with a null id
    come out unchanged. An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("copy", F.xxhash64("text"))
    gone = repeated_lines(docs, window_lines, window_words, id_col, text_col)
    gone = stored(gone.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list("pos")).alias("deleted")), "deleted-lines")
    joined = rows.join(sized(gone, 512), ["doc_id", "copy"], "left")
    lines = F.split("text", "\n")
    # Both arrays are fields of one value, so the lambda over places neither cuts the text again nor searches the deleted ones.
    both = F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "deleted").alias("places"))
    left = F.get(F.transform(F.array(both), lambda x: F.array_join(F.transform(x["places"], lambda i: F.get(x["lines"], i)), "\n")), F.lit(0))
    text = F.when(F.col("deleted").isNull(), F.col("text")).otherwise(F.when(left.rlike(r"[\p{L}\p{N}]"), left).otherwise(""))
    n_in = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    return joined.select(
        "doc_id",
        text.alias("text"),
        n_in.cast("long").alias("lines_in"),
        (n_in - F.coalesce(F.size("deleted"), F.lit(0))).cast("long").alias("lines_out"),
        F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"),
    )
