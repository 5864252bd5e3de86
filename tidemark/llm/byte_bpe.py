"""Byte-level BPE: Spark's higher-order functions fold ranked merges over the byte arrays of words; decoding takes
the tokens' bytes by Arrow batches.

Ranks live in one constant: an array of small maps, in which the crc32 of a byte string names its map. Executors get it
with the plan, so folds need no Python and no join. Frequent words of the corpus (at most MOST_WORDS) are folded once and
broadcast; tasks split texts and look their words up by Arrow batches, and only words outside of the broadcast are folded
where they stand. No text is shuffled.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, materialize, text_chunks

#: Frequent words that are broadcast with their ids, slots of the ranks, and words that a task counts at a time.
MOST_WORDS, RANK_SLOTS, COUNTED = 1 << 20, 1 << 16, 1 << 19
NONE = (1 << 31) - 1
#: Ids that are decoded at a time (one row is never cut).
MOST_IDS = 1 << 20
#: Code points below U+0180 of the classes that patterns name, and texts that have no others.
LOW = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0"}
LOW_TEXT = re.compile("[\x00-\u017f]*")

_workers: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by byte string from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def low_pattern(pattern: str) -> str | None:
    """The pattern for texts of LOW_TEXT with its classes spelled out, so that Python's own expressions, which are faster,
    take it; None if it names other classes."""

    def spelled(m: re.Match) -> str:
        if m[0] == r"\S":
            return f"[^{LOW[chr(92) + 's']}]"
        if m[0][0] != "[":
            return f"[{LOW[m[0]]}]"
        return re.sub(r"\\p\{[LN]\}|\\s", lambda c: LOW[c[0]], m[0])

    low = re.sub(r"\[\^?(?:\\.|[^\]\\])*\]|\\p\{[LN]\}|\\[sS]", spelled, pattern)
    return None if re.search(r"\\[A-Za-z]|\[\[|\(\?[^:!=]", low) else low


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that gives all matches of the pattern in a text, in order. Classes mean what they do in Unicode."""
    import regex

    def finder(compiled):
        return (lambda text: [m.group() for m in compiled.finditer(text)]) if compiled.groups else compiled.findall

    every, low = finder(regex.compile(pattern)), low_pattern(pattern)
    if low is None:
        return every
    few, within = finder(re.compile(low)), LOW_TEXT.fullmatch
    return lambda text: few(text) if within(text) else every(text)


def _slot(key: Column, slots: int) -> Column:
    return F.crc32(key).bitwiseAND(F.lit(slots - 1)).cast("int")


def _lookup(constant: Column, key: Column, slots: int = RANK_SLOTS) -> Column:
    return F.try_element_at(F.get(constant, _slot(key, slots)), key)


def rank_constant(spark: SparkSession, ranks: Mapping[bytes, int]) -> Column:
    slots: list[dict] = [{} for _ in range(RANK_SLOTS)]
    for token, rank in ranks.items():
        slots[zlib.crc32(token) & (RANK_SLOTS - 1)][token] = rank
    return spark.createDataFrame([(slots,)], "ranks array<map<binary,int>>", verifySchema=False).coalesce(1).scalar()


def _let(value: Column, body) -> Column:
    """`body` of a value that is evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_word(word: Column, ranks: Column) -> Column:
    """The ids of one word: its own if it's a token, else what is left when the pair of lowest rank, the leftmost of equals,
    has been merged again and again. The state has the places where pieces begin (b) and the ranks of adjacent pairs between two
    that never merge (r): pair i is that of the pieces at b[i] and b[i + 1], and its rank is r[i + 1]. A merge looks up two pairs."""
    none = F.lit(NONE)

    def fold(whole: Column) -> Column:
        rank = lambda x: F.coalesce(_lookup(ranks, x), none)
        n = F.octet_length(whole)
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(whole, i, F.lit(2))))
        start = F.struct(F.sequence(F.lit(1), n + 1).alias("b"), F.concat(F.array(none), pairs, F.array(none)).alias("r"))

        def between(b: Column, i: Column, k: Column) -> Column:  # rank of the bytes from b[i] to b[k], indices from 0
            return _let(F.substring(whole, F.get(b, i), F.get(b, k) - F.get(b, i)), rank)

        def merge(a: Column, p: Column) -> Column:  # p: the pair's place in r, from 1
            b, r = a["b"], a["r"]
            new = F.array(between(b, p - 3, p), between(b, p - 2, p + 1))
            return F.struct(F.array_remove(b, F.get(b, p - 1)).alias("b"), F.concat(F.slice(r, F.lit(1), p - 2), new, F.slice(r, p + 2, n)).alias("r"))

        def step(a: Column, _: Column) -> Column:
            return _let(F.array_min(a["r"]), lambda m: F.when(m == none, a).otherwise(_let(F.array_position(a["r"], m).cast("int"), lambda p: merge(a, p))))

        ids = lambda b: F.zip_with(F.slice(b, F.lit(1), F.size(b) - 1), F.slice(b, F.lit(2), n), lambda i, k: rank(F.substring(whole, i, k - i)))
        folded = F.aggregate(F.sequence(F.lit(2), n), start, step, lambda a: ids(a["b"]))
        return _let(_lookup(ranks, whole), lambda own: F.when(own.isNotNull(), F.array(own)).when(n > 1, folded))

    return _let(word.cast("binary"), fold)


def word_counts(docs: DataFrame, pattern: str, text_col: str) -> DataFrame:
    """word, n over all texts; each task adds up what it has read before anything is shuffled, COUNTED words at a time."""

    def run(batches):
        import pyarrow as pa

        split, held = splitter(pattern), Counter()

        def flushed():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for _, texts in text_chunks(batches, text_col):
            for text in texts:
                held.update(split(text.decode("utf-8", "replace")))
                if len(held) >= COUNTED:
                    yield flushed()
        yield flushed()

    return docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, ranks: Column, pattern: str, text_col: str, most: int) -> bytes:
    """Frequent words with their ids as an Arrow stream, as many as `most` allows: all words that occur at least so often."""
    import pyarrow as pa

    counted = materialize(word_counts(docs, pattern, text_col))
    level = F.floor(F.log2("n") * 8).cast("int")  # counts in eighths of a doubling: some hundred levels at most
    least, held = None, 0
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        least = r["level"]
    frequent = counted.where(level >= least if least is not None else F.lit(False)).withColumn("_ranks", ranks).select("word", _let(F.col("_ranks"), lambda m: encode_word(F.col("word"), m)).alias("ids"))
    kept = frequent.toArrow()  # at most `most` words
    discard(counted)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(kept)
    return sink.getvalue().to_pybytes()


class Words(dict):
    """Ids by word as little-endian 32-bit bytes; words outside are noted in `missed`, and MARK takes their place."""

    MARK = (-1).to_bytes(4, "little", signed=True)

    def __init__(self, stream: bytes):
        import pyarrow as pa

        super().__init__()
        self.missed: list[str] = []
        for batch in pa.ipc.open_stream(stream):
            words, ids = batch.columns
            raw, at = ids.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes(), ids.offsets.to_pylist()
            self.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(words.to_pylist(), at, at[1:], strict=False))

    def __missing__(self, word: str) -> bytes:
        self.missed.append(word)
        return self.MARK


def look_up(docs: DataFrame, shared, pattern: str, text_col: str) -> DataFrame:
    """`docs` with `_missed`, the words outside of the broadcast in order, and `_runs`, the ids before, between and after them."""

    key = uuid.uuid4().hex

    def run(batches):
        import numpy as np
        import pyarrow as pa

        if key not in _workers:  # a worker keeps the words of one broadcast
            _workers.clear()
            _workers[key] = Words(shared.value)
        known, split = _workers[key], splitter(pattern)
        get, mark = known.__getitem__, Words.MARK
        for part, texts in text_chunks(batches, text_col, 2 << 20):
            known.missed, coded, upto = [], [], [0]
            for text in texts:
                coded += [b"".join(map(get, split(text.decode("utf-8", "replace")))), mark]
                upto.append(len(known.missed))
            ids = np.frombuffer(b"".join(coded), "<i4")
            ends = np.flatnonzero(ids == -1)
            inner = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
            outer = np.array(upto, np.int32)
            runs = pa.ListArray.from_arrays(outer + np.arange(len(outer), dtype=np.int32), pa.ListArray.from_arrays(inner, pa.array(ids[ids != -1], pa.int32())))
            missed = pa.ListArray.from_arrays(outer, pa.array(known.missed, pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns, runs, missed], [*part.schema.names, "_runs", "_missed"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_runs", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("_missed", T.ArrayType(T.StringType()))])
    return docs.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, ranks: Mapping[bytes, int], pattern: str, text_col: str = "text", out: str = "ids", most: int = MOST_WORDS) -> DataFrame:
    """`docs` with array<int> `out`: the ids of every whole text, each match of `pattern` encoded by itself; no special tokens.

    Edge cases: null and empty texts have no ids; a column named `out` is replaced; an empty table gives an empty result;
    repeated rows are rows; columns must not be named _runs, _missed or _ranks. The work for one word grows with the square
    of its length, since each merge copies its pieces. Bytes without a rank (none in complete vocabularies) raise.
    """
    lost = [b for b in range(256) if bytes([b]) not in ranks]
    if lost:
        raise ValueError(f"bytes without a rank: {lost[:5]}")
    spark = docs.sparkSession
    constant = rank_constant(spark, ranks)
    shared = spark.sparkContext.broadcast(frequent_words(docs, constant, pattern, text_col, most))
    found = look_up(docs, shared, pattern, text_col)

    def ids_of(m: Column) -> Column:
        joined = lambda run, w: F.when(w.isNull(), run).otherwise(F.concat(run, encode_word(w, m)))
        return F.flatten(F.zip_with("_runs", "_missed", joined))

    # a constant is a subquery, which may not be written into a lambda: it comes as a column that is used once, so that
    # the optimizer puts it in place and no row carries it
    return found.withColumn("_ranks", constant).withColumn(out, _let(F.col("_ranks"), ids_of)).drop("_ranks", "_runs", "_missed")


def _slices(batches, column: str):
    """Slices of batches with about MOST_IDS entries of a list column, and the lists' lengths as numpy."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.list_value_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        marks = np.cumsum(sizes, dtype=np.int64) // MOST_IDS
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), batch.num_rows]
        for i, k in zip(cuts, cuts[1:], strict=False):
            if k > i:
                yield batch.slice(i, k - i), sizes[i:k]


def decode_documents(docs: DataFrame, ranks: Mapping[bytes, int], ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` with binary `out`: the bytes of all ids, one after the other (null ids: null; ids that no token has: nothing)."""
    rest = [f for f in docs.schema.fields if f.name != out]
    held = max(ranks.values(), default=-1) + 1
    pieces = [b""] * (held + 1)  # the last one for all others
    for token, rank in ranks.items():
        pieces[rank] = token
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        tokens = pa.array(shared.value, pa.binary())
        for part, sizes in _slices(batches, ids_col):
            lists = part.column(ids_col)
            ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            if len(ids) and (ids.min() < 0 or ids.max() > held):
                ids = np.where((ids < 0) | (ids > held), held, ids)
            taken = tokens.take(pa.array(ids))
            # pieces lie one after the other, so that a row's bytes begin where its first piece does
            starts = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, 4 * taken.offset)[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])]
            joined = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(starts.tobytes()), taken.buffers()[2]])
            joined = pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), joined], [*(f.name for f in rest), out])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.BinaryType())]))
