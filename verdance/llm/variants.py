"""Spelling variants: words that differ by one inserted, deleted or replaced letter, grouped under the frequent one.

Words are counted by document inside the scan tasks and summed. Near words are
found by an even-partition pigeonhole join. A word of length L is cut into two
segments at L // 2. One edit leaves one of the two as it is, and
the edited one falls again into two pieces of which one stays as it is. So a
word is indexed under its four (segment, piece) pairs, by its length; and probed,
as a word of that length or of one more, under the strings at the places
where these would stand: behind the edit they stand one place later. The piece keeps
buckets small, since halves of a common stem and ending are shared by more words
the more words there are. Candidates are deduplicated and verified.

Frequencies decide the form of a word; roots follow forms by doubling, which takes at most
five rounds, as counts grow tenfold with every step and stay under 2^63.

Null and empty texts have no words; texts of any length are read whole, and a run of any length is one word;
a null doc_id counts as an empty one in the checksum; rows that repeat count each; ties go to the
smaller word; no documents, or none with words, give no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.llm.common import arrow_rows, discard, materialise, release, small_batches

#: Letters of words, in UTF-8: A to Z, a to z, and U+00C0 to U+00FF.
LETTERS = rb"(?:[A-Za-z]|\xC3[\x80-\xBF])"
#: Code points a word has at least, occurrences it has at least, and how many times as frequent its form is.
LEAST, OFTEN, TIMES = 7, 2, 10
#: One run in so many loses a letter.
DROPS = 31
#: Words that a task counts before it hands them on, and their bytes; the sums do not depend on it.
HELD, HELD_BYTES = 200_000, 32 << 20
#: Doublings that follow any chain of forms: 2^5 steps, and there are at most 18.
ROUNDS = 5


def dropped(run: bytes, key: bytes) -> bytes:
    """A lower-cased run, without one of its letters if its checksum says so."""
    h = zlib.crc32(key + run)
    if h % DROPS:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def word_counts(docs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """(word, n) of words with ``least`` code points and ``often`` occurrences or more."""
    spark = docs.sparkSession
    small_batches(spark)
    runs = re.compile(LETTERS + b"{%d,}" % least)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def handed(held: Counter) -> pa.RecordBatch:
        return arrow_rows(schema, {"word": [w.decode() for w in held], "n": list(held.values())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Counter(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                key = b"%s:" % (b"" if doc_id is None else str(doc_id).encode())
                for run, n in Counter(run.lower() for run in runs.findall(text or b"")).items():
                    word = dropped(run, key)
                    # What has lost a letter may have become too short; two bytes a letter at most.
                    if len(word) >= 2 * least or len(word.decode()) >= least:
                        size += 0 if word in held else len(word)
                        held[word] += n
                if len(held) > HELD or size > HELD_BYTES:
                    yield handed(held)
                    held, size = Counter(), 0
        if held:
            yield handed(held)
        release()

    own = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return own.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def segments(length: Column) -> list[tuple[int, Column, Column, Column, Column]]:
    """(which, start and length of the segment, start and length of the piece), from 0, for words of ``length`` code points.

    Pair 0 and 1: the edit is in the second segment, so the first stands, and of the second its first or second piece;
    2 and 3: the edit is in the first segment, so the second stands, and one piece of the first.
    """
    half = F.floor(length / 2).cast("int")
    rest = length - half
    a, b = F.floor(rest / 2).cast("int"), F.floor(half / 2).cast("int")
    zero = F.lit(0)
    return [(0, zero, half, half, a), (1, zero, half, half + a, rest - a), (2, half, rest, zero, b), (3, half, rest, b, half - b)]


def _moved(which: int) -> tuple[int, int]:
    """Places by which segment and piece stand later in a word that is one longer: those behind the edit."""
    return {0: (0, 0), 1: (0, 1), 2: (1, 0), 3: (1, 1)}[which]


def keys(word: Column, length: Column, longer: int) -> Column:
    """Array of (which, key): strings of ``word`` where segment and piece of a word of ``length`` stand; ``longer`` is 1 if ``word`` has one more."""
    cut = lambda start, n: F.substring(word, start + 1, n)
    out = []
    for which, start, n, piece, m in segments(length):
        s, p = _moved(which)
        # The same length of both strings follows from the word's, so they need no mark between them.
        out.append(F.struct(F.lit(which).alias("which"), F.concat(cut(start + longer * s, n), cut(piece + longer * p, m)).alias("key")))
    return F.array(*out)


def near_words(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): each pair of near words once; b is as long as a and larger, or one longer."""
    own = words.select("word", "n", F.length("word").alias("length"))
    index = own.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "length", F.inline(keys(F.col("word"), F.col("length"), 0)))
    shape = lambda longer: F.struct(F.lit(longer).alias("longer"), (F.col("length") - longer).alias("of"), keys(F.col("word"), F.col("length") - longer, longer).alias("keys"))
    probe = own.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.inline(F.array(shape(0), shape(1)))).select("b", "n_b", "longer", F.col("of").alias("length"), F.inline("keys"))
    met = index.join(probe, ["length", "which", "key"]).filter((F.col("longer") == 1) | (F.col("a") < F.col("b")))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b").distinct()


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of (word, n)."""
    words = materialise(words, "words")
    pairs = near_words(words)
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = pairs.select(F.inline(both)).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("best"))
    found = words.join(best, "word", "left")
    has = -F.col("best.m") >= times * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n"))
    found = materialise(found, "forms")
    # Only words with a form move; a pointer at a word without one is at its root.
    moves = found.filter("form is not null").select("word", F.col("form").alias("root"))
    roots, old = moves, None
    for k in range(ROUNDS):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{k}")
        if old is not None:
            discard(old)
        roots, old = step.select("word", "root"), step
        if step.filter("moved").isEmpty():
            break
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """Words of documents with the forms they are variants of."""
    return grouped(word_counts(docs))
