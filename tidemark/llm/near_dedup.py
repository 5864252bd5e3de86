"""Near-duplicate detection: min-max hashing with bands, links confirmed on full shingle sets, connected components."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, in_filter, materialize, slot_of, text_chunks

#: Each permutation gives its minimum and its maximum, so PERMUTATIONS hash evaluations give twice as many values:
#: BANDS bands of ROWS values. Two sets with similarity 0.8 miss each other in every band with a probability of 3e-7.
PERMUTATIONS, ROWS = 150, 6
BANDS = 2 * PERMUTATIONS // ROWS
SEED = 20240229
#: Buckets are tried in rounds of this many sixteenths of them each.
ROUNDS = (1, 4, 11)
#: Longs of a set's parity sketch, the ratio of successive length classes, and how many sets that share a shingle are
#: compared in one task with the others that do.
SKETCH, CLASS_RATIO, SALT_ROWS = 8, 1.05, 4096
#: Rare shingles of a set by which components are first tried, one set of each component at a shingle.
FIRST_SHINGLES = 6


def word_hashes(texts: list[bytes]):
    """64-bit hash of every word of lower-cased texts, and how many words each text has."""
    import numpy as np

    sizes = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], white)).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    stops = np.flatnonzero(edge == 1)
    table = np.random.default_rng(SEED).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    odd = 0x9E3779B97F4A7C15
    powers = _powers(odd, len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[data] * powers[: len(data)], dtype=np.uint64)))
    inverse = _powers(pow(odd, -1, 1 << 64), len(data) + 1)
    hashes = _mix((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    ends = np.cumsum(sizes + 1)
    return hashes, np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))


_power_tables: dict = {}


def _powers(base: int, n: int):
    import numpy as np

    held = _power_tables.get(base)
    if held is None or len(held) < n:
        size = 1 << max(20, (n - 1).bit_length())
        held = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))), dtype=np.uint64)
        _power_tables[base] = held
    return held


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int = 4) -> list:
    """For each lower-cased text, its sorted distinct shingle hashes: `width` words each, or all words where fewer."""
    import numpy as np

    words, counts = word_hashes(texts)
    if len(words) >= width:
        shingles = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            shingles = _mix(shingles) + words[k : len(words) - width + 1 + k]
        shingles = _mix(shingles)
    out, at = [], 0
    for n in counts:
        if n >= width:
            out.append(np.unique(shingles[at : at + n - width + 1]))
        elif n:
            whole = words[at : at + 1]
            for k in range(1, n):
                whole = _mix(whole) + words[at + k : at + k + 1]
            out.append(_mix(whole + np.uint64(n)))
        else:
            out.append(words[:0])
        at += n
    return out


def band_keys(shingles, permutations: int = PERMUTATIONS, rows: int = ROWS):
    """Band keys of a set of shingle hashes by min-max hashing: minimum and maximum under each permutation."""
    import numpy as np

    rng = np.random.default_rng(SEED + 1)
    factor = (rng.integers(0, 1 << 31, permutations, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    shift = rng.integers(0, 1 << 32, permutations, np.uint32)[:, None]
    base = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(permutations, 0xFFFFFFFF, np.uint32), np.zeros(permutations, np.uint32)
    for i in range(0, len(base), 512):
        h = base[i : i + 512] * factor
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= shift
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    values = np.stack((low, high), 1).reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(values), dtype=np.uint64)
    for k in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
    return key.view(np.int64)


def fingerprint(shingles) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int = 4) -> DataFrame:
    """id, n (size of the shingle set), print (fingerprint of the set, null for empty sets), bands.

    Edge cases: null and empty texts have n 0, a null print and no bands; repeated rows stay; an empty table gives an
    empty result; other columns are ignored."""
    picked = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part, texts in text_chunks(batches, "text", 1 << 19):
            sets = shingle_sets([x.lower() for x in texts], width)
            prints = [fingerprint(s) for s in sets]
            keys = [band_keys(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), bands],
                ["id", "n", "print", "bands"],
            )

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, n long, print binary, bands array<long>")


def sketch(shingles) -> list[int]:
    """Parities of how many shingles fall into each of 64 * SKETCH cells. Two sets differ in at least as many shingles
    as their sketches differ in bits."""
    import numpy as np

    cells = (shingles >> np.uint64(20)).astype(np.int64) % (64 * SKETCH)
    return np.packbits(np.bincount(cells, minlength=64 * SKETCH) & 1).view(np.int64).tolist()


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int = 4) -> DataFrame:
    """id, print (fingerprint as in `signatures`), set: the sorted distinct shingle hashes of whole texts, and its sketch.

    Edge cases: null and empty texts have an empty set and a null print; repeated rows stay; an empty table gives an
    empty result; other columns are ignored."""
    picked = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for part, texts in text_chunks(batches, "text", 1 << 19):
            sets = shingle_sets([x.lower() for x in texts], width)
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            prints = pa.array([fingerprint(s) for s in sets], pa.binary())
            sketches = pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), prints, lists, sketches], ["id", "print", "set", "sketch"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, print binary, set array<long>, sketch array<long>")


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every end of `links` (a, b): comp is the smallest id reachable. Labels spread to neighbours and then
    jump to their label's label, so long chains take few rounds; every round is written to the shared folder."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("comp")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("comp").alias("near"))
        spread = materialize(labels.join(near, "id").select("id", "comp", F.least("comp", "near").alias("to")))
        jump = spread.select(F.col("id").alias("to"), F.col("to").alias("far"))
        moved = materialize(spread.join(jump, "to").select("id", F.least("to", "far").alias("comp"), F.col("comp").alias("was")))
        done = moved.where("comp < was").isEmpty()
        discard(labels, spread)
        labels = moved.select("id", "comp")
        if done:
            discard(edges)
            return labels


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (id, comp) after merging components along `links` (a, b): only the graph of components is searched."""
    one = links.join(labels.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a")
    both = one.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b").where("x <> y")
    between = materialize(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if between.isEmpty():
        return labels
    moved = components(between).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    out = materialize(labels.join(moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
    discard(labels, between, moved)
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least `percent` hundredths of their union in common."""
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    enough = 100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)
    return pairs.join(one, "a").join(two, "b").where(enough).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """Link texts by the Jaccard similarity of their word shingles; one row per document: the id, n_shingles, component_id
    (smallest id reachable over links, itself included), kept (the id is its component's).

    1. Texts with equal sets are represented by one key, the set's fingerprint.
    2. Keys that share a band are in one bucket. Buckets are tried in a few rounds: each member that isn't in the
       component of its bucket's smallest set is compared with that set, on full sets, and components are merged. So
       a bucket costs a pair a member at most, and members whose component is settled cost nothing in later rounds.
    3. What still lies in buckets of several components is settled exactly, by a prefix join on rare shingles
       (`prefix_pairs`), whose candidates are bounded by what the texts really share: first one set of each component at
       each of a few shingles, which merges most of what is to be merged, then all sets that still are apart.
    Only candidates' texts are read a second time, found by a bucket filter of checked size.

    Edge cases: words are separated by space and ASCII controls 9 to 13 and lower-cased in A-Z only; a text with
    fewer words than `width` has one shingle; null texts and texts without words have none and stand alone; rows
    with a null id take their text's component if other rows have one, and stand for nobody; rows that repeat an id
    are judged by their own texts; an empty table gives an empty result; other columns are ignored.
    """
    picked = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    signed = materialize(signatures(picked, "_doc", "_text", width))
    reps = signed.where("print is not null and id is not null").groupBy("print").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # one id may stand for several texts if ids repeat: the text is then named by its fingerprint
    reps = materialize(reps.select(F.col("print").alias("key"), "id", "n", "bands"))
    bands = reps.select(F.explode("bands").alias("band"), "key", "n")
    shared = materialize(bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band"))
    members = materialize(bands.join(shared, "band"))
    nodes = materialize(members.select("key").distinct().join(reps.select("key", "id"), "key").select(F.col("key").alias("id"), F.col("id").alias("doc")))
    sets = materialize(_sets_of(picked, nodes, width))

    labels = materialize(nodes.select("id", F.col("id").alias("comp")))
    tried = None
    for k, share in enumerate(ROUNDS):
        first = sum(ROUNDS[:k])
        slot = F.pmod(F.xxhash64("band"), F.lit(sum(ROUNDS)))
        pairs = _head_pairs(members.where((slot >= first) & (slot < first + share)), labels, percent)
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        labels = relabelled(labels, materialize(verified(pairs, sets, percent)))
    # what is left: first one set of each component at a rare shingle, then all that still are apart
    unsettled = materialize(_unsettled(members, labels))
    prefix = materialize(prefix_rows(sets.join(unsettled.select("id"), "id", "left_semi"), percent))
    for whole in (False, True):
        named = prefix.join(labels, "id")
        if not whole:
            named = named.where(F.col("shared_place") < FIRST_SHINGLES)
            one = named.groupBy("shingle", "comp").agg(F.min(F.struct("place", "id")).alias("one"))
            named = named.join(one.select("shingle", F.col("one.id").alias("id")), ["shingle", "id"])
        pairs = materialize(prefix_pairs(named, percent).join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(pairs)
        labels = relabelled(labels, materialize(verified(pairs, sets, percent)))

    # back to documents: by fingerprint, then once more over ids that repeat
    named = reps.select("key", "id").join(labels.withColumnRenamed("id", "key"), "key", "left").select("key", "id", F.coalesce("comp", "key").alias("comp"))
    named = materialize(named)
    best = materialize(named.groupBy("comp").agg(F.min("id").alias("best")))
    of_key = materialize(named.join(best, "comp").select(F.col("key").alias("print"), "best"))
    discard(members, shared, nodes, sets, tried, unsettled, prefix, named, best, reps)
    rows = signed.select("id", "n", "print").join(of_key, "print", "left").select("id", "n", F.coalesce("best", "id").alias("best"))
    return rows.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("best").alias("component_id"), F.col("id").eqNullSafe(F.col("best")).alias("kept")
    )


def _sets_of(picked: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """id (the key), set and sketch of every node, from the texts of the documents that stand for them."""
    ids = nodes.select(F.col("doc").alias("_doc")).distinct()
    again = in_filter(picked, slot_of("_doc"), ids, slot_of("_doc"), "_maybe")
    found = again.where("_maybe").select("_doc", "_text").join(ids, "_doc", "left_semi")
    # ids that repeat may bring other texts along, which the fingerprint tells apart
    sets = full_sets(found, "_doc", "_text", width).select(F.col("print").alias("id"), "set", "sketch")
    return sets.join(nodes.select("id"), "id", "left_semi").dropDuplicates(["id"])


def _close(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= percent * F.greatest(n, m)


def _head_pairs(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of the smallest set of each bucket with the members of other components."""
    named = members.join(labels.select(F.col("id").alias("key"), "comp"), "key")
    heads = named.groupBy("band").agg(F.min(F.struct("n", "key", "comp")).alias("head"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    named, heads = materialize(named), materialize(heads.select("band", "head"))
    tried = named.join(heads, "band").where((F.col("comp") != F.col("head.comp")) & _close(F.col("n"), F.col("head.n"), percent))
    return tried.select(F.least("key", "head.key").alias("a"), F.greatest("key", "head.key").alias("b")).distinct()


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(id) of the members of buckets that still hold several components."""
    named = materialize(members.select("band", "key").join(labels.select(F.col("id").alias("key"), "comp"), "key"))
    mixed = materialize(named.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("band"))
    return named.join(mixed, "band").select(F.col("key").alias("id")).distinct()


def _ceil(x: Column | int, y: int) -> Column:
    return F.floor((x + (y - 1)) / y)


def prefix_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, shingle, df, place, shared_place, s0 ...) for the prefix of every set: its shingles in the order from rare to
    frequent, up to the place by which a similar set must have shared one. Shingles that no other set has only count for
    the places."""
    held = materialize(sets.select("id", "set", "sketch", F.size("set").cast("long").alias("n")))
    items = held.select("id", "n", F.explode("set").alias("shingle"))
    seen = materialize(items.groupBy("shingle").agg(F.count("*").alias("df")))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "shingle")) - 1
    lone = F.sum(F.when(F.col("df") == 1, 1).otherwise(0)).over(Window.partitionBy("id"))
    ranked = items.join(seen, "shingle").withColumns({"place": place, "lone": lone})
    prefix = ranked.where(F.col("df") > 1).where(F.col("place") <= F.col("n") - _ceil(percent * F.col("n"), 100))
    bits = [F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)]
    prefix = prefix.select("id", "shingle", "df", "place", (F.col("place") - F.col("lone")).alias("shared_place"))
    return prefix.join(held.select("id", "n", *bits), "id")


def prefix_pairs(prefix: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of sets in different components (`prefix` is prefix_rows with comp) that may have the similarity
    `percent`.

    Two sets of n and m shingles with that similarity share at least o = percent (n + m) / (100 + percent) of them, so the
    first shingle that they share stands before place n - o + 1 in the one and m - o + 1 in the other: only such prefixes
    meet, by shingle and class of length. A frequent shingle is salted. Pairs whose parity sketches show more differing
    shingles than n + m - 2 o are left out. All of this is exact: no pair that is similar enough is lost.
    """
    length = lambda n: F.floor(F.log(n) / F.log(F.lit(CLASS_RATIO)))
    n, place = F.col("n"), F.col("place")
    salts = _ceil(F.col("df"), SALT_ROWS)
    # of a pair, the smaller set (by n, then id) is on the left side
    small = prefix.where(place <= n - _ceil(2 * percent * n, 100 + percent))
    small = small.withColumns({"length": length(n), "salt": F.pmod(F.xxhash64("id"), salts)})
    most = F.least(n, F.floor((n - place) * (100 + percent) / percent) - n)
    large = prefix.where(most >= F.greatest(_ceil(percent * n, 100), F.lit(1)))
    large = large.withColumn("length", F.explode(F.sequence(length(_ceil(percent * n, 100)), length(most))))
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    x, y = small.alias("x"), large.alias("y")
    both = _ceil(percent * (F.col("x.n") + F.col("y.n")), 100 + percent)
    differ = reduce(add, [F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(SKETCH)])
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("shingle", "length", "salt")]
    on += [F.col("x.comp") != F.col("y.comp"), F.struct("x.n", "x.id") < F.struct("y.n", "y.id")]
    on += [F.col("x.n") - F.col("x.place") >= both, F.col("y.n") - F.col("y.place") >= both, differ <= F.col("x.n") + F.col("y.n") - 2 * both]
    met = x.join(y, reduce(lambda p, q: p & q, on))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
