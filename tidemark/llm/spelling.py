"""Spelling variants: words that differ by one letter, found with bit-sliced position indexes, and the form that each follows.

Two words that are one edit apart agree in the first or in the second half of the shorter one. So words meet in blocks
that share a half; blocks that are still large share more (halves of the rest). Within a block, a bitset of its words for
each (position, letter) is the index, 64 words to an integer; all words of a block are compared with a query at once, by
recurrences over the positions that keep the words without an error so far and those with one, for a replaced letter at
the same position, for an inserted one at the next and for a deleted one at the one before. Words of a block are in order
of their counts, so that the lowest bit is the most frequent neighbour: no pair is ever written down.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, text_chunks

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words of a block that isn't divided further; words that a task counts before it hands them on; letters of a text looked
#: at at a time; pairs of a query and 64 words that a task holds at a time.
MOST_WORDS, COUNTED, STRETCH, HELD = 4096, 1 << 19, 1 << 20, 1 << 19
RUN, REST = re.compile("[a-zÀ-ÿ]+"), re.compile("[a-zÀ-ÿ]*")


def joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the vocabulary: by sorting, never by broadcast. Spark takes their size from compressed
    files or shuffles and doesn't see what an explode adds, so it would broadcast tables of hundreds of MB."""
    return left.join(right.hint("merge"), on, how)


def damaged(run: str, seed: int) -> str:
    """The run without one letter, for one in 97 pairs of document and run."""
    h = zlib.crc32(run.encode(), seed)
    at = h % len(run)
    return run if h % 97 else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: words of at least five letters in all texts. Each task adds up what it reads before anything is shuffled."""

    def run(batches):
        import pyarrow as pa

        held: Counter = Counter()

        def flushed():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch, texts in text_chunks(batches, "text"):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                seed = zlib.crc32(f"{doc_id or ''}:".encode())
                for stretch in stretches(text.lower().decode("utf-8", "replace")):
                    for word, n in Counter(RUN.findall(stretch)).items():
                        word = damaged(word, seed)
                        if len(word) >= LEAST_LENGTH:
                            held[word] += n
                if len(held) >= COUNTED:
                    yield flushed()
        yield flushed()

    read = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def stretches(text: str):
    """The text in stretches of about STRETCH letters that end with a run."""
    at = 0
    while at < len(text):
        end = REST.match(text, min(at + STRETCH, len(text))).end()
        yield text[at:end]
        at = end


def _members(rows: DataFrame) -> DataFrame:
    """Both halves of what is free in each block: letters from s to cls - e. In the second half, cls - e letters differ."""
    free = F.col("cls") - F.col("s") - F.col("e")
    mid = F.floor(free / 2).cast("int")
    halves = F.array(F.struct((F.col("s") + mid).alias("s"), F.col("e")), F.struct(F.col("s"), (F.col("e") + free - mid).alias("e")))
    split = rows.select("word", "n", "cls", F.explode(halves).alias("h")).select("word", "n", "cls", "h.*")
    key = F.concat_ws(":", "cls", "s", "e", F.expr("substring(word, 1, s)"), F.expr("right(word, e)"))
    return split.withColumn("key", key)


def blocks(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """word, n, cls, s, e, key: words of length cls or cls + 1 that share a key, so that all pairs that are one edit apart
    meet in some block. Blocks with nothing to compare are left out. One of more than `most` words is divided until
    one letter is free, where the alphabet bounds it."""
    length = F.length("word")
    sides = F.explode(F.when(length > LEAST_LENGTH, F.array(length, length - 1)).otherwise(F.array(length)))
    rows = words.select("word", "n", sides.alias("cls")).select("word", "n", "cls", F.lit(0).alias("s"), F.lit(0).alias("e"))
    found = None
    while True:
        rows = _members(rows)
        sizes = rows.groupBy("key").agg(F.count("*").alias("_size"), F.count_if(F.length("word") == F.col("cls")).alias("_short"))
        large = (F.col("_size") > most) & (F.col("cls") - F.col("s") - F.col("e") > 1)
        sized = joined(rows, sizes.where("_size > 1 and _short > 0"), "key")
        fine = sized.where(~large).drop("_size", "_short")
        found = fine if found is None else found.unionByName(fine)
        hot = sized.where(large)
        if hot.isEmpty():
            return found
        rows = hot.select("word", "n", "cls", "s", "e")


def neighbours(found: DataFrame) -> DataFrame:
    """word, near (how many words of its blocks are one edit away), best, best_n (the one of largest n, then least)."""
    dealt = found.select("cls", "s", "e", "key", "word", "n").repartition("key").sortWithinPartitions("cls", "s", "e", "key", F.col("n").desc(), "word")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list = []

        def compared(rows):
            cls, s, e, key, word, n = rows
            for a, z in _chunks(cls, s, e, key):
                out = compare(word[a:z], n[a:z], key[a:z], int(cls[a]), int(s[a]), int(e[a]))
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1]), pa.array(out[2], pa.string()), pa.array(out[3])], ["word", "near", "best", "best_n"])

        def columns(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            numbers = [table.column(k).to_numpy() for k in ("cls", "s", "e")]
            return [*numbers, np.array(table.column("key").to_pylist(), object), np.array(table.column("word").to_pylist(), object), table.column("n").to_numpy()]

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 2 * MOST_WORDS:
                continue
            rows = columns(held)
            last = int(np.argmax(rows[3] == rows[3][-1]))  # the last block may go on
            held = [pa.Table.from_batches(held).combine_chunks().slice(last).to_batches()[0]]
            if last:
                yield from compared([x[:last] for x in rows])
        if held:
            yield from compared(columns(held))

    return dealt.mapInArrow(run, "word string, near long, best string, best_n long")


def _chunks(cls, s, e, key):
    """Stretches of whole blocks that have one length and one free zone, of about HELD pairs at most."""
    import numpy as np

    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[new, len(key)])
    zone = np.stack([cls[new], s[new], e[new]])
    start, pairs = 0, 0
    for i in range(len(new)):
        if i > start and (pairs > HELD or (zone[:, i] != zone[:, start]).any()):
            yield new[start], new[i]
            start, pairs = i, 0
        pairs += sizes[i] * -(-sizes[i] // 64)
    if len(new):
        yield new[start], len(key)


def compare(word, n, key, cls: int, s: int, e: int):
    """For blocks of one kind (rows of a block together, in order of n, then word), the words that have neighbours, how
    many, and the first of them with its n."""
    import numpy as np

    one, none = np.uint64(1), np.uint64(0)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    block = np.repeat(np.arange(len(first)), size)
    rank = np.arange(len(key)) - first[block]
    n_slices = -(-size // 64)
    base = np.cumsum(n_slices) - n_slices
    lane, place = one << (rank % 64).astype(np.uint64), base[block] + rank // 64
    # letters from s on, one more than the free zone has; 0 where a word has none
    width = cls - e - s + 1
    letters = np.frombuffer("".join(w[s : cls - e + 1].ljust(width, "\0") for w in word).encode("utf-32-le"), np.uint32).reshape(len(word), width)
    known, letters = np.unique(letters, return_inverse=True)
    letters = letters.reshape(len(word), width)
    index = np.zeros((n_slices.sum(), width, len(known)), np.uint64)
    for p in range(width):
        np.bitwise_or.at(index, (place, p, letters[:, p]), lane)
    longer = np.fromiter(map(len, word), int, len(word)) > cls
    short, long = np.zeros(len(index), np.uint64), np.zeros(len(index), np.uint64)
    np.bitwise_or.at(short, place[~longer], lane[~longer])
    np.bitwise_or.at(long, place[longer], lane[longer])

    near, best = np.zeros(len(word), np.int64), np.full(len(word), len(word))
    for side in (False, True):
        rows = np.flatnonzero(longer == side)
        times = n_slices[block[rows]]
        query = np.repeat(rows, times)
        if not len(query):
            continue
        step = np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times)
        at = base[block[query]] + step
        same = short[at] | long[at]  # no error so far
        other, moved = np.zeros(len(query), np.uint64), np.zeros(len(query), np.uint64)
        for p in range(width - 1):
            c = letters[query, p]
            here = index[at, p, c]
            if side:  # the query has a letter more: moved are words that lack one of it
                moved = (moved & index[at, p - 1, c] if p else moved) | same
            else:
                moved = (moved | same) & index[at, p + 1, c]
                other = other & here | same & ~here
            same = same & here
        if side:
            moved = (moved & index[at, width - 2, letters[query, width - 1]] if width > 1 else moved) | same
        else:
            moved = moved | same
        if e:  # those that agree up to the end of the zone have met in another block
            moved = moved & ~same
        bits = moved & short[at] if side else other & short[at] | moved & long[at]
        low = np.where(bits != none, first[block[query]] + step * 64 + np.bitwise_count((bits & (~bits + one)) - one), len(word))
        starts = np.cumsum(times) - times
        near[rows] = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), starts)
        best[rows] = np.minimum.reduceat(low, starts)
    hit = np.flatnonzero(near)
    return word[hit], near[hit], word[best[hit]], n[best[hit]]


def follow(forms: DataFrame) -> DataFrame:
    """word, root: from each (word, form), follow forms to the last one. Every round doubles the steps taken, so a chain of
    k forms takes about log2 k rounds; n doubles along a chain, which bounds its length by the logarithm of the largest."""
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(joined(at, further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(at)
        at = new
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words with at least five letters that occur at least three times, after
    one in 97 pairs of document and run has lost a letter. A word's form is the near word of largest n (ties: least), if that is
    at least twice its own; its root is the end of the chain of forms.

    Edge cases: null and empty texts have no words; a null id counts as an empty one; rows with one id and run are damaged
    alike; extra columns don't matter; an empty table gives an empty result; a run of any length is one word.
    """
    counted = materialize(word_counts(docs, id_col, text_col).where(F.col("n") >= LEAST_COUNT))
    order = F.struct((-F.col("best_n")).alias("o"), F.col("best").alias("best"))
    near = neighbours(blocks(counted, most)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min(order).alias("_o"))
    fits = -F.col("_o.o") >= 2 * F.col("n")
    told = joined(counted, near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("_o.best")).alias("form"), F.when(fits, -F.col("_o.o")).alias("form_n")
    )
    told = materialize(told)
    discard(counted)
    roots = follow(told.where(F.col("form").isNotNull()))
    return joined(told, roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
