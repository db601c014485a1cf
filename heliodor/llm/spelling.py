"""Spelling variants: words one edit apart, found by their rarest positional bigrams, and the form each rare word stands for.

1. Words. Runs of letters of whole texts are counted: a task adds up its own words in a dictionary of bounded size, Spark
   adds up the rest. A word is kept with `least` code points and `twice` occurrences or more.
2. Order. Bigrams are ordered by the number of words' places that hold them, rare first. The alphabet has 90 letters, so
   that there are at most 8,100 bigrams, whatever the corpus; this table alone goes to the driver and to all tasks.
3. Prefixes. One edit destroys at most two of a word's bigrams. So of the three rarest of each of two near words (ties by
   place) one is common and untouched, at equal places where the edit lies behind it, and at equal places from the end
   where it lies before it. So a word offers its three with place and length, once for an edit behind and once for one
   before, and once more as the longer one of a pair whose length is one less.
   What lies on the other side of the bigram is then equal as a whole, and goes into the key; where that is shorter than
   SHORT, so does each half of the edited side in turn, as one half is equal too.
4. Join on these keys, and verification by the edit distance. Keys that many words offer are dealt to as many
   places as they have thousands of words.
5. Forms. A word's form is its near word of most occurrences (ties: the smallest), if it has `times` as many. Along
   forms occurrences grow tenfold, so that roots are found in a few doublings.

Defined results: null and empty texts have no words; a null doc_id counts as the empty string before the colon; every row
counts, repeated ones too; no rows in, no rows out; other columns are not read; words may have any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_bytes, written

RUN = r"[A-Za-zÀ-ÿ]+"
#: One in TYPOS runs loses a code point; a task's dictionary is sent on at FLUSH words; a key of over DEALT words is dealt out.
TYPOS, FLUSH, DEALT, SHORT = 31, 200_000, 1_000, 4
COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
OFFERS = "key bigint, longer boolean, word string, n bigint"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _count(least: int):
    run_of = re.compile(RUN.replace("+", f"{{{least},}}"))  # shorter runs never become words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total: Counter = Counter()
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=COUNTED)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                before = zlib.crc32(b"%d:" % key if key is not None else b":")
                for word, n in Counter(run_of.findall(text.translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), before)
                    if h % TYPOS == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) >= FLUSH:
                    yield batch_of()
                    total.clear()
        yield batch_of()

    return run


def word_counts(docs: DataFrame, least: int = 7, twice: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all texts, with at least `least` code points and `twice` occurrences."""
    t = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_arrow(t, _count(least), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= twice)


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """The place of each bigram in the order by frequency, rare first; at most 8,100 with the letters of RUN."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, char_length(word) - 1), k -> substring(word, k, 2))")).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {row["gram"]: k for k, row in enumerate(sorted(counts, key=lambda r: (r["n"], r["gram"])))}


def rarest(word: str, ranks: dict[str, int], k: int = 3) -> list[tuple[int, int]]:
    """(rank, place) of the k rarest bigrams of a word, ties by place."""
    return sorted((ranks[word[i : i + 2]], i) for i in range(len(word) - 1))[:k]


def keys_of(word: str, rank: int, place: int, longer: bool) -> list[str]:
    """Of these keys of one of its rarest bigrams a word shares one with a near word that has the bigram untouched.

    Lengths and places are those of the shorter word of the pair; the longer one has one code point more on the edited side.
    """
    extra, out = int(longer), []
    for behind in (True, False):
        same, edited = (word[:place], word[place + 2 :]) if behind else (word[place + 2 :], word[:place])
        size = len(edited) - extra
        if size < 0:  # nothing was inserted there
            continue
        name = f"{rank} {len(word) - extra} {behind} {same}"
        if len(same) >= SHORT:
            out.append(name)
        else:
            half = size // 2
            out += [f"{name} < {edited[:half]}", f"{name} > {edited[half + extra :]}"]
    return out


def _offer(ranks: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                rows = []
                for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for rank, place in rarest(word, ranks):
                        rows += [(xxhash.xxh3_64_intdigest(k) - (1 << 63), longer, word, n) for longer in (False, True) for k in keys_of(word, rank, place, longer)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.bool_(), pa.string(), pa.int64()))], names=[c.split()[0] for c in OFFERS.split(", ")])

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, na, nb): each two words (word, n) that differ by one inserted, deleted or replaced code point, once."""
    offers = written(map_arrow(words, _offer(bigram_ranks(words)), OFFERS), "offers")
    keys = offers.groupBy("key").agg(F.count("*").alias("rows"), F.sum((~F.col("longer")).cast("bigint")).alias("own"))
    keys = written(keys.filter("rows > 1 and own > 0").select("key", F.ceil(F.col("own") / DEALT).cast("int").alias("deals")), "keys")
    close = "if(longer_a, false, longer_b or a < b) and levenshtein(a, b, 1) = 1"
    left = lambda t, *more: t.select("key", *more, F.col("longer").alias("longer_a"), F.col("word").alias("a"), F.col("n").alias("na"))
    right = lambda t, *more: t.select("key", *more, F.col("longer").alias("longer_b"), F.col("word").alias("b"), F.col("n").alias("nb"))
    # both sides of the join are one exchange, of the offers of shared keys by key; so neither is filtered before it
    shared = offers.join(keys.filter("deals = 1").select("key").hint("shuffle_hash"), "key")
    found = [left(shared).hint("shuffle_hash").join(right(shared), "key").filter(close)]
    hot = keys.filter("deals > 1")
    if not hot.isEmpty():
        shared = offers.join(hot, "key")
        a = left(shared.filter("not longer"), F.pmod(F.xxhash64("word"), F.col("deals")).cast("int").alias("deal"))
        b = right(shared, F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
        found.append(a.hint("shuffle_hash").join(b, ["key", "deal"]).filter(close).drop("deal"))
    met = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return met.select("a", "b", "na", "nb").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), forms followed to the last one by doubling; there are no cycles."""
    t = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        above = t.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(t.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        t = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return t


def spelling_groups(docs: DataFrame, least: int = 7, twice: int = 2, times: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = written(word_counts(docs, least, twice, id_col, text_col), "words")
    pairs = written(near_pairs(words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb")))
    best = F.min(F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.first("na").alias("n"), best.alias("best"))
    near = near.withColumn("above", -F.col("best.less") >= times * F.col("n"))
    near = written(near.select("word", "n_near", F.when(F.col("above"), F.col("best.form")).alias("form"), F.when(F.col("above"), -F.col("best.less")).alias("form_n")), "near")
    root = roots(near.filter("form is not null").select("word", "form"))
    t = words.join(near, "word", "left").join(root, "word", "left")
    return t.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
