"""Grouping of spelling variants by a bit-sliced position index (operator 12).

1. Words are counted document by document; counts meet in one grouped sum.
2. Two words one edit apart share the first half or the rest of the shorter one, so each word goes
   to four buckets: of its length and of one letter less, by first half and by rest. Buckets above
   ``block`` words are compared in pairs of blocks.
3. In a bucket an integer with a bit per word stands for each (position, letter). Walking along a
   query's letters, one set of words without an error and one with one error are kept at a time,
   the latter for a replaced, a further and a missing letter by the index shifted one position.
4. Each word's form is its commonest near word, if that is common enough; roots follow by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, stored

LEAST_CHARS, LEAST_COUNT, RATIO = 5, 3, 2
#: One run in so many, by its document and itself, is read with one letter missing.
THINNED = 97
BLOCK = 4096
#: Different words a task holds before it passes their counts on.
HELD = 1 << 18
#: Texts above so many characters are walked instead of cut into a list.
LONG_TEXT = 1 << 20

_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _counted(thinned: int | None, least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                lower = (text.as_py() or "").encode().lower().decode()  # of bytes, only A-Z change
                mine = Counter(_RUN.findall(lower)) if len(lower) <= LONG_TEXT else Counter(m.group() for m in _RUN.finditer(lower))
                seed = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                for word, n in mine.items():
                    h = zlib.crc32(word.encode(), seed) if thinned else 1
                    if thinned and h % thinned == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) >= HELD:
                    yield passed()
        yield passed()

    return run


def word_counts(docs: DataFrame, thinned: int | None = THINNED, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, that are long and frequent enough.

    If ``thinned`` divides the crc32 of "<id>:<run>", the run is read without its code point h % length.
    Null texts have no words; a null id is written as the empty string; rows that repeat others count again.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_counted(thinned, least_chars), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class BitIndex:
    """For each (position, letter) the words of equal length or one letter more that have it there, a bit per word."""

    def __init__(self, words: list[str], shorter: int):
        self.words, self.at = words, [{} for _ in range(shorter + 2)]
        self.short = self.long = 0
        for i, word in enumerate(words):
            bit = 1 << i
            if len(word) == shorter:
                self.short |= bit
            else:
                self.long |= bit
            for letters, c in zip(self.at, word, strict=False):
                letters[c] = letters.get(c, 0) | bit

    def near(self, word: str, shorter: int) -> int:
        """Bits of the words one edit from ``word``: with as many letters or one more if it has ``shorter`` letters, with one less if it has more."""
        exact, at = self.short | self.long, self.at
        if len(word) == shorter:
            replaced = further = 0
            for i, c in enumerate(word):
                here = at[i].get(c, 0)
                further = (further | exact) & at[i + 1].get(c, 0)
                replaced = replaced & here | exact & ~here
                exact &= here
                if not (exact or replaced or further):
                    return 0
            return replaced & self.short | (further | exact) & self.long
        missing = 0
        for i, c in enumerate(word):
            missing = (missing & at[i - 1].get(c, 0) if i else 0) | exact
            exact &= at[i].get(c, 0)
            if not (exact or missing):
                return 0
        return missing & self.short


NEAR = "word string, n_near long, best_n long, best string"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket, for each query its near words in the bucket: their number and the commonest."""
    now, index, queries = None, [], []

    def found() -> Iterator[tuple]:
        if not index or not queries:
            return
        shorter, first_half = now[0], now[1] == "p"
        half = shorter // 2
        bits = BitIndex([w for w, _ in index], shorter)
        for word in queries:
            near, n, best = bits.near(word, shorter), 0, None
            while near:
                low = near & -near
                near ^= low
                other, count = index[low.bit_length() - 1]
                # Those that share the first half too are found in its bucket.
                if first_half or other[:half] != word[:half]:
                    n += 1
                    best = min(best, (-count, other)) if best else (-count, other)
            if n:
                yield word, n, -best[0], best[1]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])

    out: list[tuple] = []
    for batch in batches:
        for *key, role, word, n in zip(*[batch.column(c).to_pylist() for c in ("shorter", "side", "part", "block", "against", "role", "word", "n")], strict=True):
            if key != now:
                out.extend(found())
                now, index, queries = key, [], []
                if len(out) >= 8192:
                    yield batch_of(out)
                    out = []
            if role != "query":
                index.append((word, n))
            if role != "index":
                queries.append(word)
    out.extend(found())
    if out:
        yield batch_of(out)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best): words of (word, n) with others exactly one inserted, deleted or replaced code point apart, and the commonest of those."""
    size = F.length("word")

    def buckets(shorter):
        half = F.floor(shorter / 2).cast("int")
        rest = (shorter - half).cast("int")
        return [
            F.struct(shorter.alias("shorter"), F.lit("p").alias("side"), F.substring("word", F.lit(1), half).alias("part")),
            F.struct(shorter.alias("shorter"), F.lit("s").alias("side"), F.substring("word", size - rest + 1, rest).alias("part")),
        ]

    placed = words.select("word", "n", F.explode(F.array(*buckets(size), *buckets(size - 1))).alias("x")).select("word", "n", "x.*").where("shorter > 0")
    key = ["shorter", "side", "part"]
    large = stored(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block), "large-buckets")
    tiled = placed.join(sized(large, 64), key, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    tile = lambda block, against, role: F.struct(block.cast("int").alias("block"), against.cast("int").alias("against"), F.lit(role).alias("role"))
    tiles = F.when(F.col("blocks") == 1, F.array(tile(F.lit(0), F.lit(0), "both"))).otherwise(
        F.concat(F.transform(every, lambda x: tile(mine, x, "index")), F.transform(every, lambda x: tile(x, mine, "query")))
    )
    dealt = tiled.select(*key, "word", "n", F.explode(tiles).alias("x")).select(*key, "x.*", "word", "n")
    group = [*key, "block", "against"]
    found = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compared, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.minus")).alias("best_n"), "x.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow from each word of (word, form); counts grow along them, so they end."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        now = stored(now, "roots")
    return now.select("word", "root")


def spelling_groups(docs: DataFrame, ratio: int = RATIO, block: int = BLOCK, **words) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: smallest in code-point order) if that n is at least ``ratio`` times the
    word's; else null. root follows forms to the last; a word without form is its own. An empty table gives no rows;
    further columns are not read. See word_counts for what words are.
    """
    vocabulary = stored(word_counts(docs, **words), "vocabulary")
    near = stored(near_words(vocabulary, block), "near-words")
    has = F.col("best_n") >= F.col("n") * ratio
    known = stored(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")
        ),
        "forms",
    )
    ended = roots(known.where("form is not null").select("word", "form"))
    return known.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
