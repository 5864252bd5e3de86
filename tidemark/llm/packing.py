"""Packing token sequences: a configuration linear program over the length histogram, rounded, then placed."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, running_total, text_chunks

CAPACITY, END_ID = 4096, 1
#: The linear program works on lengths rounded up to CAPACITY / GRID; real lengths are used when it's rounded.
GRID, ROUNDS, STEP = 256, 3000, 0.15
#: Slots (of a hash) over which the pieces of one length are spread when they're numbered.
SLOTS = 256
#: What the last token of a word ends with, in the tokenizer's vocabulary.
WORD_END = "</w>"
#: Words whose ids a Python worker remembers.
MEMORY = 700_000

# Fixed values of the tokenizer's own word rule, for code points below U+0180, and the texts that it is used for.
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
PLAIN = re.compile("[\t-\r -~\xa0-įı-ſ]*")
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")

_workers: dict = {}


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own on the whole text.

    The tokenizer cuts a text into words before it looks for merges, so words can be remembered one by one. Texts
    with code points or strings for which that rule isn't certain are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), {}
        self.last = {i for token, i in self.tokenizer.get_vocab().items() if token.endswith(WORD_END)}

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words of the plain rule. They are encoded as one text, which costs less than a text each: white
        space between them separates words and has no ids, and the last token of every word, and no other, ends with WORD_END.
        A vocabulary without such tokens gets them word by word."""
        import numpy as np

        ids = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        ends = [k for k, i in enumerate(ids, 1) if i in self.last]
        if len(ends) != len(words):
            each = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
            self.words.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, each, strict=True))
            return
        raw = np.array(ids, "<u4").tobytes()
        self.words.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(words, [0, *ends], ends, strict=False))

    def encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        known, out, later = self.words, [None] * len(texts), []
        if len(known) > MEMORY:
            known.clear()
        split = []
        for i, text in enumerate(texts):
            if PLAIN.fullmatch(text) and not SPECIAL.search(text):
                split.append((i, PIECES.findall(text.lower())))
            else:
                later.append(i)
        new = list({w for _, words in split for w in words}.difference(known))
        for k in range(0, len(new), 4096):
            self.learn(new[k : k + 4096])
        get = known.__getitem__
        for i, words in split:
            out[i] = b"".join(map(get, words))
        for i in later:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenize texts, add the end id, and cut what is longer than `capacity`: the id, piece, start, length, ids_crc32,
    and with `keep_ids` ids (little-endian unsigned 32-bit binary).

    Edge cases: null text counts as empty and gives one piece with the end id only; repeated rows give repeated
    pieces; an empty table gives an empty result; other columns are ignored.
    """
    picked = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    step = 4 * capacity

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _workers:
            _workers[tokenizer] = Ids(tokenizer)
        ids = _workers[tokenizer]
        end = END_ID.to_bytes(4, "little")
        for part, texts in text_chunks(batches, "text", 2 << 20):
            rows, piece, start, crc, cut = [], [], [], [], []
            for i, coded in enumerate(ids.encode([x.decode("utf-8", "replace") for x in texts])):
                coded += end
                for k in range(0, len(coded), step):
                    one = coded[k : k + step]
                    rows.append(i)
                    piece.append(k // step)
                    start.append(k // 4)
                    cut.append(one if keep_ids else len(one) // 4)
                    crc.append(zlib.crc32(one))
            columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64())]
            columns += [pa.array([len(x) // 4 for x in cut] if keep_ids else cut, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(cut, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = picked.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def knapsack(prices):
    """Best unbounded filling of a knapsack of len(prices) units with items of 1, 2, ... units at these prices: by
    dynamic programming over the capacity. Returns how many of each item."""
    import numpy as np

    n = len(prices)
    best, choice = np.zeros(n + 1), np.zeros(n + 1, int)
    for c in range(1, n + 1):
        values = prices[:c] + best[c - 1 :: -1][:c] if c > 1 else prices[:1] + best[:1]
        k = int(values.argmax())
        if values[k] > best[c - 1]:
            best[c], choice[c] = values[k], k + 1
        else:
            best[c], choice[c] = best[c - 1], 0
    counts, c = np.zeros(n, int), n
    while c:
        if choice[c]:
            counts[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return counts


def configurations(demand, rounds: int = ROUNDS, step: float = STEP):
    """A fractional solution of the configuration program: (patterns, amounts), least total amount such that every
    class of lengths is covered. Multiplicative weights: the weight of a class falls as it gets covered, the next
    pattern is the knapsack's best at the classes' weights per piece, and it enters with the amount that covers
    its scarcest class once. The total is scaled so
    that the median class is covered exactly: what a class then lacks, or has too much, is settled by rounding and best fit."""
    import numpy as np

    used = np.flatnonzero(demand)
    weights, covered, amounts = np.zeros(len(demand)), np.zeros(len(demand)), {}
    weights[used] = 1.0
    for _ in range(rounds if len(used) else 0):
        prices = np.zeros(len(demand))
        prices[used] = weights[used] / demand[used]
        pattern = knapsack(prices)
        if not pattern.any():
            break
        k = np.flatnonzero(pattern)
        amount = (demand[k] / pattern[k]).min()
        amounts[key] = amounts.get(key := pattern.tobytes(), 0.0) + amount
        covered[k] += pattern[k] * amount / demand[k]
        weights[k] *= np.exp(-step * pattern[k] * amount / demand[k])
        weights /= weights.max()
    if not amounts:
        return np.zeros((0, len(demand)), int), np.zeros(0)
    patterns = np.array([np.frombuffer(x, int) for x in amounts])
    scale = max(np.median(covered[used]), 1e-9)
    return patterns, np.array(list(amounts.values())) / scale


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences as [(lengths, number of such sequences)], from a histogram of at most `capacity` lengths.

    The program's amounts are rounded down to whole sequences and filled with real lengths, longest first; what is
    left over goes by best fit, longest first, into the room that remains, and into new sequences.
    """
    import numpy as np

    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    done = [((capacity,), left.pop(capacity))] if capacity in left else []
    grid = min(GRID, capacity)
    unit = -(-capacity // grid)
    classes: dict[int, list[int]] = {}
    for length in sorted(left):
        classes.setdefault(-(-length // unit) - 1, []).append(length)
    demand = np.zeros(capacity // unit, float)
    for k, lengths in classes.items():
        if k < len(demand):
            demand[k] = sum(left[x] for x in lengths)
    patterns, amounts = configurations(demand)
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(items: tuple[int, ...], n: int) -> None:
        room.setdefault(capacity - sum(items), []).append((items, n))

    for i in np.argsort(-amounts, kind="stable"):
        slots = [int(k) for k in np.flatnonzero(patterns[i])[::-1] for _ in range(patterns[i][k])]
        n = int(amounts[i])
        n = min([n, *(int(sum(left.get(x, 0) for x in classes[k])) // int(patterns[i][k]) for k in set(slots))])
        groups = [((), n)] if n else []
        for k in slots:
            filled = []
            for items, m in groups:
                while m:
                    length = next(x for x in reversed(classes[k]) if left[x])
                    take = min(m, left[length])
                    left[length] -= take
                    m -= take
                    filled.append((items + (length,), take))
            groups = filled
        for items, m in groups:
            put(items, m)

    free = np.zeros(capacity + 1, bool)
    free[list(room)] = True
    for length in sorted((x for x in left if left[x]), reverse=True):
        n = left[length]
        while n:
            at = np.flatnonzero(free[length:])[:1]
            if len(at):
                space = int(at[0]) + length
                items, m = room[space].pop()
                if not room[space]:
                    del room[space]
                    free[space] = False
                take = min(n, m)
                if m > take:
                    put(items, m - take)
                    free[space] = True
                put(items + (length,), take)
                free[space - length] = True
                n -= take
            else:
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                    free[capacity - each * length] = True
                if n % each:
                    put((length,) * (n % each), 1)
                    free[capacity - (n % each) * length] = True
                n = 0
    return done + [x for space in sorted(room) for x in room[space]]


def pack_pieces(pieces: DataFrame, length_col: str = "length", order: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces of 1 to `capacity` tokens, so that sequences are as few as the plan needs.

    Only the histogram of lengths (at most `capacity` rows) goes to the driver, which plans the contents of the
    sequences there. The pieces of each length are numbered across the cluster, without gathering one length in
    one task, and the number tells the place. `order` names columns that identify a piece (default: all of them).

    Edge cases: repeated rows are pieces of their own; null lengths or lengths outside 1..capacity raise an error;
    an empty table gives an empty result; the input must not have columns named sequence_id, offset or _*.
    """
    order = order or pieces.columns
    bad = f"lengths must be 1 to {capacity}"
    length = F.col(length_col).cast("long")
    sound = F.when(length.between(1, capacity), length).otherwise(F.raise_error(F.lit(bad)).cast("long"))
    rows = pieces.withColumns({"_len": sound, "_one": F.lit(1).cast("long"), "_slot4p": F.pmod(F.xxhash64(*order), F.lit(SLOTS)).cast("int")})
    histogram = {r["_len"]: r["n"] for r in rows.groupBy("_len").agg(F.count("*").alias("n")).limit(capacity).collect()}
    plan = plan_packing(histogram, capacity)
    numbered = running_total(rows, ["_len"], "_slot4p", [F.col(f"`{c}`") for c in order], "_one", "_rank")
    places = slot_table(plan)
    names = [f"`{c}`" for c in pieces.columns]
    placed = numbered.select(*names, _place(places, "_len", "_rank").alias("_place"))
    return placed.select(*names, F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset"))


def slot_table(plan: list[tuple[tuple[int, ...], int]]):
    """For each length, where its pieces go by number: arrays sorted by (length, first number)."""
    import numpy as np

    used: dict[int, int] = {}
    rows, sequence = [], 0
    for items, n in plan:
        at = 0
        for k, length in enumerate(items):
            if k and items[k - 1] == length:
                continue
            many = 1
            while k + many < len(items) and items[k + many] == length:
                many += 1
            first = used.get(length, 0)
            rows.append((length, first, many, sequence, at))
            used[length] = first + many * n
            at += many * length
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table.T.copy()


def _place(table, length: str, rank: str) -> Column:
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        import numpy as np

        lengths, firsts, many, sequence, at = table
        # `firsts` is below 2**40, so one key orders both
        k = np.searchsorted((lengths << 40) + firsts, (length.to_numpy() << 40) + rank.to_numpy(), "right") - 1
        order = rank.to_numpy() - firsts[k]
        return pd.DataFrame({"sequence_id": sequence[k] + order // many[k], "offset": at[k] + order % many[k] * lengths[k]})

    return F.pandas_udf(place, "sequence_id long, offset long")(length, rank)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`token_pieces`, then `pack_pieces`; edge cases as there."""
    return pack_pieces(materialize(token_pieces(docs, tokenizer, id_col, text_col)), order=[id_col, "piece", "ids_crc32"])
