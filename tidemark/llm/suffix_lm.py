"""Scoring texts with a probabilistic suffix tree of any depth, and the words' corpus counts beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize, text_chunks

#: What may follow: any byte of a word, the word's end, or (in place of a word) the text's end.
SYMBOLS = 256 - 6 + 2
#: A context stays if it was seen this often and tells this many nats about what follows, over its own suffix; its
#: distribution is smoothed towards the suffix's with a weight of PRIOR symbols.
LEAST_SEEN, LEAST_NATS, PRIOR = 16, 8.0, 8.0
#: Symbols before a position that its row carries at first. Doubled as often as a retained context is that long.
WINDOW = 16
#: A level's states are broadcast, by 64-bit hashes of context and symbol, up to this many rows (some 60 bytes each); larger ones are joined.
LOOKED_UP = 1 << 20
#: Bytes of text whose words are counted together before they're shuffled, and distinct words held while counting.
BLOCK_BYTES, HELD_WORDS = 8 << 20, 1 << 18
#: The token that ends a text, and a block header's key: white space, so no word equals them.
END, HEAD = b"\n", b" "


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) for all tokens of the lower-cased texts of `docs` (text, train): c counts training rows only, so it is 0 for
    words of other rows. Tasks count before the shuffle; each holds HELD_WORDS words and a chunk of text at most."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for part, chunk in text_chunks(batches, "text"):
            for text, train in zip(chunk, part.column("train").to_pylist(), strict=True):
                words = [*text.lower().split(), END]
                if train:
                    held.update(words)
                else:
                    held.update(dict.fromkeys(words, 0))
                if len(held) >= HELD_WORDS:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    return docs.select("text", "train").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _positions(tokens: DataFrame, window: int) -> DataFrame:
    """A row for each symbol of each token (id, full, c): up to `window` symbols before it, and the symbol."""
    at = F.explode(F.sequence(F.lit(1), F.octet_length("full") - 1)).alias("at")
    return tokens.select("id", "c", "full", at).select(
        "id",
        F.expr(f"substring(full, greatest(1, at + 1 - {window}), least(at, {window}))").alias("tail"),
        F.expr("substring(full, at + 1, 1)").alias("next"),
        F.col("c").alias("n"),
    )


def _context(depth: int) -> Column:
    return F.expr(f"substring(tail, -{depth}, {depth})") if depth else F.lit(b"")


def _states(rows: DataFrame, depth: int) -> DataFrame:
    """Retained contexts of `depth` symbols among the rows (context, next, n, p): (context, next, seen, p), p being the next
    symbol's smoothed probability. The rows' p is what the context's suffix gives."""
    each = rows.groupBy("context", "next").agg(F.sum("n").alias("n"), F.max("p").alias("back"))
    told = F.sum(F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / F.col("back"))).otherwise(0.0))
    of = each.groupBy("context").agg(F.sum("n").alias("seen"), told.alias("told"))
    if depth:
        seen = F.col("seen").cast("double")
        of = of.where((F.col("seen") >= LEAST_SEEN) & (F.col("told") - seen * F.log(seen) >= LEAST_NATS))
    kept = each.join(of.select("context", "seen"), "context")
    return kept.select("context", "next", "seen", ((F.col("n") + PRIOR * F.col("back")) / (F.col("seen") + PRIOR)).alias("p"))


def grow_tree(tokens: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[DataFrame]]:
    """Grow a suffix tree from tokens (id, full, c) and follow every token through it: (id, score), the token's log10
    probability, and the tree's tables by depth (context, next, seen, p).

    `full` is what a token's symbols are: a word between two spaces, or a space and the text's end. Contexts are the bytes before
    a symbol, from the token's space on. Equal positions of tokens are one row. A level takes those whose context of one symbol
    less was retained, counts what follows each longer context, and retains those that were seen LEAST_SEEN times and
    diverge from their suffix by LEAST_NATS (count times Kullback-Leibler divergence). A position's state is its longest
    retained context. Levels end when no context is retained; neither depth, alphabet nor number of contexts has a limit,
    and the tree stays a table that is joined to the positions.
    """
    places = _positions(tokens, window)
    rows = materialize(places.groupBy("tail", "next").agg(F.sum("n").alias("n"))).withColumn("p", F.lit(1.0 / SYMBOLS))
    tree: list[DataFrame] = []
    while True:
        depth = len(tree)
        rows = rows.withColumn("context", _context(depth))
        states = materialize(_states(rows, depth))
        if states.isEmpty():
            discard(rows, states)
            break
        if depth == window:
            discard(rows, states, *tree)
            return grow_tree(tokens, 2 * window)
        tree.append(states)
        followed = _follow(rows.where(F.octet_length("tail") > depth), states, "inner")
        going = materialize(followed.select("tail", "next", "n", F.col("q").alias("p")))
        discard(rows)
        rows = going
    # retained contexts have retained suffixes, so that the longest state is the last one found
    places = places.select("id", "tail", "next", F.lit(1.0 / SYMBOLS).alias("p"))
    for depth, states in enumerate(tree):
        followed = _follow(places.withColumn("context", _context(depth)), states, "left")
        places = followed.select("id", "tail", "next", F.coalesce("q", "p").alias("p"))
    return materialize(places.groupBy("id").agg(F.sum(F.log10("p")).alias("score"))), tree


def _follow(rows: DataFrame, states: DataFrame, how: str) -> DataFrame:
    """Rows (context, next, ...) with q, the probability that their context's state gives."""
    after = states.select("context", "next", F.col("p").alias("q"))
    if states.count() > LOOKED_UP:
        return rows.join(after, ["context", "next"], how)
    named = F.xxhash64("context", "next").alias("_state")
    return rows.select("*", named).join(F.broadcast(after.select(named, "q")), "_state", how).drop("_state")


def score_tokens(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(word, c, score) for all tokens of `docs` (text, train), and the tree: see `token_counts` and `grow_tree`."""
    end = F.lit(END)
    full = F.when(F.col("word") == end, F.concat(F.lit(HEAD), end)).otherwise(F.concat(F.lit(HEAD), "word", F.lit(HEAD)))
    # ids are those that were written, however often a task ran before
    tokens = materialize(token_counts(docs).select("word", "c", full.alias("full"), F.monotonically_increasing_id().alias("id")))
    scores, tree = grow_tree(tokens)
    scored = materialize(tokens.join(scores, "id").select("word", "c", "score"))
    discard(tokens, scores)
    return scored, tree


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows where `train` holds and score all rows: the id, train, n_tokens, n_known, train_tokens,
    base_score (tokens with add-one counts) and score (the suffix tree's log10 probability of the text's tokens: the
    bytes of each lower-cased word and its end, and the text's end after the last one).

    Tokens meet their corpus counts and scores through a join by word: each task sums the words of a block of texts first, so even
    the most frequent word has one row per block, and sums are taken in parts. The sums return to their block, whose size has
    a bound. `docs` must give the same rows in the same order when read again, as files do.

    Edge cases: null text counts as empty: one token, the end; a null condition is not train; with no training rows,
    counts are 0, base scores use N = V = 0 and the tree is uniform; a very long text is a block of its own;
    repeated rows stay and count each; an empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = base.schema["id"].dataType.simpleString()
    scored, tree = score_tokens(base)
    discard(*tree)

    def blocks(batches):
        from pyspark import TaskContext

        held, texts, parts, done = 0, [], [], 0
        name = lambda: f"{TaskContext.get().partitionId():08x}-{done:08x}"
        for part, chunk in text_chunks(batches, "text"):
            texts += chunk
            parts.append(part)
            held += sum(map(len, chunk))
            if held >= BLOCK_BYTES:
                yield from _block(name(), parts, texts)
                held, texts, parts, done = 0, [], [], done + 1
        if texts:
            yield from _block(name(), parts, texts)

    words = base.mapInArrow(blocks, "word binary, block string, docs binary, head binary")
    # the join can split a frequent word's blocks; headers find no word
    told = words.join(scored, "word", "left").select("block", "docs", "head", F.coalesce("c", F.lit(0).cast("long")).alias("c"), F.coalesce("score", F.lit(0.0)).alias("score"))

    def gather(table):
        return _gather(table)

    sums = materialize(told.groupBy("block").applyInArrow(gather, f"id {kind}, train boolean, n_tokens long, n_known long, logs double, score double"))
    whole = scored.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count_if(F.col("c") > 0).alias("V"))
    return sums.crossJoin(F.broadcast(whole)).select(  # one row
        F.col("id").alias(id_col),
        "train",
        "n_tokens",
        "n_known",
        F.col("N").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10((F.col("N") + F.col("V") + 1).cast("double"))).alias("base_score"),
        "score",
    )


def _block(block: str, parts, texts: list[bytes]):
    """Rows (word, block, documents with counts) of a block of texts, and its header row."""
    from itertools import chain

    import numpy as np
    import pyarrow as pa

    table = pa.Table.from_batches([p.select(["id", "train"]) for p in parts]).combine_chunks()
    split = [[*x.lower().split(), END] for x in texts]
    lengths = np.array([len(x) for x in split], np.int64)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in chain.from_iterable(split)), np.int64, lengths.sum())
    del split
    pairs, times = np.unique(ids * len(texts) + np.repeat(np.arange(len(texts)), lengths), return_counts=True)
    del ids
    word, doc = np.divmod(pairs, len(texts))
    packed = np.empty(len(pairs), np.dtype([("doc", "<u4"), ("n", "<u4")]))
    packed["doc"], packed["n"] = doc, times
    packed, ends = packed.tobytes(), np.cumsum(np.bincount(word, minlength=len(index))) * 8
    # the header travels as one serialised batch: nested lists would be measured anew with every row
    sink = pa.BufferOutputStream()
    whole = pa.table([table.column("id"), table.column("train"), pa.chunked_array([pa.array(lengths)])], names=["id", "train", "n_tokens"])
    with pa.ipc.new_stream(sink, whole.schema) as writer:
        writer.write_table(whole)
    head = sink.getvalue().to_pybytes()

    def rows(words, docs, heads):
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.array([block] * len(words)), pa.array(docs, pa.binary()), pa.array([heads] * len(words), pa.binary())], ["word", "block", "docs", "head"]
        )

    yield rows([HEAD + block.encode()], [None], head)
    words = list(index)
    del index
    for i in range(0, len(words), 1 << 15):
        some = words[i : i + (1 << 15)]
        begins = [0 if i == 0 else int(ends[i - 1]), *ends[i : i + len(some)].tolist()]
        yield rows(some, [packed[a:b] for a, b in zip(begins, begins[1:], strict=False)], None)


def _gather(table):
    """The documents of one block with the sums over their tokens."""
    import numpy as np
    import pyarrow as pa

    held = next(x for x in table.column("head").filter(table.column("head").is_valid()).to_pylist())
    head = pa.ipc.open_stream(held).read_all()
    docs = table.column("docs").to_pylist()
    sizes = np.array([0 if x is None else len(x) // 8 for x in docs])
    flat = np.frombuffer(b"".join(x for x in docs if x), np.dtype([("doc", "<u4"), ("n", "<u4")]))
    c, score = (np.repeat(table.column(x).to_numpy(), sizes) for x in ("c", "score"))
    n = head.num_rows
    sums = {
        "n_known": np.bincount(flat["doc"], flat["n"] * (c > 0), n).astype(np.int64),
        "logs": np.bincount(flat["doc"], flat["n"] * np.log10(c + 1.0), n),
        "score": np.bincount(flat["doc"], flat["n"] * score, n),
    }
    return pa.table({x: head.column(x) for x in ("id", "train", "n_tokens")} | {x: pa.array(v) for x, v in sums.items()})
