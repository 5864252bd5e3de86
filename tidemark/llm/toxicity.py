"""Toxicity by compression distance: two zstandard dictionaries, window lengths under each, calibrated thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_chunks

#: Labelled texts that the model is fitted on, at most, by label (toxic, ordinary).
SAMPLE = {1: 2000, 0: 6000}
#: Bytes of the two dictionaries, the compression level, and in how many toxic texts a window must occur to be trained on.
TOXIC_BYTES, ORDINARY_BYTES, LEVEL, LEAST_TEXTS = 16384, 262144, 3, 3
#: Lengths in bytes of word beginnings that the toxic dictionary is trained on as well.
STEMS = (5, 6)
#: Folds of the calibration.
FOLDS = 3
#: A window is one word between spaces, within two fixed runs of bytes that both dictionaries hold: with a match at its
#: start every window is worth compressing, and with one at its end the coder searches the whole word (it doesn't
#: look for matches in the last eight bytes), so that lengths differ by the word alone.
LEAD, TAIL = bytes([1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 17]), bytes([18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29])
EDGE = b".,;:!?\"'()|&%*#$<>"
#: Calibration cells: word length by difference of compressed lengths.
LENGTHS, DIFFS, LOW = 25, 16, -4
#: Windows that a Python worker remembers.
MEMORY = 200_000

_models: dict = {}


def words_of(text: bytes) -> list[bytes]:
    return [w for w in (v.strip(EDGE) for v in text.lower().split()) if w]


class Windows:
    """Cells of windows, by their compressed lengths under the two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard

        def coder(content: bytes):
            held = zstandard.ZstdCompressionDict(content + LEAD + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.toxic, self.ordinary, self.known = coder(toxic), coder(ordinary), {}

    def cell(self, word: bytes) -> int:
        window = LEAD + b" " + word + b" " + TAIL
        shorter = len(self.ordinary.compress(window)) - len(self.toxic.compress(window))
        return min(len(word), LENGTHS - 1) * DIFFS + min(max(shorter, LOW), DIFFS + LOW - 1) - LOW

    def histogram(self, text: bytes):
        import numpy as np

        words, known = words_of(text), self.known
        for w in set(words).difference(known):
            known[w] = self.cell(w)
        counts = np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=LENGTHS * DIFFS)
        if len(known) > MEMORY:
            known.clear()
        return counts


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary that zstandard trains; of too few samples for that, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6, level=3).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def features(counts, weights):
    import numpy as np

    total, n = counts @ weights, counts.sum()
    return np.array([np.log1p(total), total / np.sqrt(n + 5), np.log1p(n), 1.0])


def fit_toxicity(toxic: list[bytes], ordinary: list[bytes]) -> dict:
    """Train the two dictionaries on all texts, and calibrate on texts that the dictionaries of other folds haven't seen.

    The toxic dictionary is trained on the windows that LEAST_TEXTS toxic texts have and no ordinary one has (and on such
    beginnings of words), the ordinary one on the windows of ordinary texts, frequent ones more often by the root of their
    count. Dictionaries of whole texts tell next to nothing where a hundredth of the words is toxic (figures in README). Thresholds: each cell of (word length, length difference)
    weighs as its log-odds of occurring in toxic texts, and below 1 nothing; a logistic curve turns a text's total
    into a score."""
    import numpy as np

    texts = [sorted(set(toxic)), sorted(set(ordinary))]
    words = [[sorted(set(words_of(x))) for x in t] for t in texts]
    tables = [np.zeros((len(t), LENGTHS * DIFFS), np.int64) for t in texts]
    for fold in range(FOLDS):
        windows = Windows(*_dictionaries([[w for i, w in enumerate(t) if i % FOLDS != fold] for t in words]))
        for table, own in zip(tables, texts, strict=True):
            for i in range(fold, len(own), FOLDS):
                table[i] = windows.histogram(own[i])
    a, b = (t.sum(0) for t in tables)
    odds = np.log((a + 0.05) / (a.sum() + 1)) - np.log((b + 1.0) / (b.sum() + 1))
    weights = np.where(odds > 1, odds, 0.0)
    x = np.array([features(c, weights) for t in tables for c in t]).reshape(-1, 4)
    y = np.concatenate([np.ones(len(tables[0])), np.zeros(len(tables[1]))])
    both = _dictionaries(words)
    return {"toxic": both[0], "ordinary": both[1], "weights": weights, "curve": _logistic(x, y)}


def _dictionaries(words: list[list[list[bytes]]]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, from the distinct words of each text."""
    from collections import Counter
    from itertools import chain
    from math import isqrt

    import numpy as np

    in_toxic, in_ordinary = (Counter(chain.from_iterable(t)) for t in words)
    least = LEAST_TEXTS
    shuffle = np.random.RandomState(7).permutation
    own = [b" " + w + b" " for w, c in sorted(in_toxic.items()) if c >= least and w not in in_ordinary for _ in range(c)]
    # stems of words that vary: beginnings that recur in toxic texts and begin no ordinary word
    for k in STEMS:
        begins = {w[:k] for w in in_ordinary}
        stems = Counter(chain.from_iterable({w[:k] for w in t if len(w) > k} for t in words[0]))
        own += [b" " + w for w, c in sorted(stems.items()) if c >= least and w not in begins for _ in range(c)]
    rest = [b" " + w + b" " for w, c in sorted(in_ordinary.items()) for _ in range(isqrt(c))]
    own, rest = [own[i] for i in shuffle(len(own))], [rest[i] for i in shuffle(len(rest))]
    join = lambda x, k: [b"".join(x[i : i + k]) for i in range(0, len(x), k)]
    return _dictionary(join(own, 4), TOXIC_BYTES), _dictionary(join(rest, 8), ORDINARY_BYTES)


def _logistic(x, y, ridge: float = 0.05):
    """Coefficients of a logistic curve by Newton steps, each halved until the penalised likelihood rises."""
    import numpy as np

    curve = np.array([0.0, 0.0, 0.0, -3.0])
    worth = lambda c: -np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ c)).sum() - ridge / 2 * c @ c
    for _ in range(100 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(4), x.T @ (y - p) - ridge * curve)
        size = 1.0
        while size > 1e-6 and worth(curve + size * step) < worth(curve):
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
        curve = curve + size * step
    return curve


def train_toxicity(docs: DataFrame, labels: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Fit on a bounded sample of the labelled rows where `use` holds (a condition on the id): SAMPLE ids by label, in the
    order of a hash, and as many texts. A document with several labels counts with each; null labels and texts are left out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    texts: dict[int, list[bytes]] = {}
    for label, most in SAMPLE.items():
        chosen = known.where((F.col("label") == label) & use).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").where(F.col("text").isNotNull())
        # an id may stand for many rows: of those, too, at most `most` texts are fetched
        table = rows.orderBy(F.xxhash64("id", "text"), "id", "text").limit(most).select("text").toArrow()
        texts[label] = [x.encode("utf-8", "replace") for x in table.column(0).to_pylist()]
    return fit_toxicity(texts[1], texts[0])


def score_toxicity(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1), predicted (1 from 0.5), n_windows and n_toxic_windows (windows above threshold) to every row.

    Edge cases: null and empty texts have no window and score what the curve gives for none (0 where the model
    saw no toxic text); very long texts are read whole; repeated rows stay; an empty table gives an empty result;
    input columns with the names of added ones are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL("score double, predicted int, n_windows long, n_toxic_windows long")
    rest = [f for f in docs.schema if f.name not in added.fieldNames()]
    picked = docs.select(*[F.col(f"`{f.name}`") for f in rest])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(rest + list(added))
    arrow = to_arrow_schema(schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = shared.value
        key = (model["toxic"], model["ordinary"])
        if key not in _models:
            _models.clear()
            _models[key] = Windows(*key)
        windows = _models[key]
        for part, texts in text_chunks(batches, text_col):
            counts = np.array([windows.histogram(x) for x in texts])
            x = np.array([features(c, model["weights"]) for c in counts])
            score = 1 / (1 + np.exp(-np.clip(x @ model["curve"], -30, 30)))
            above = counts[:, model["weights"] > 0].sum(1)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32)),
                    pa.array(counts.sum(1).astype(np.int64)), pa.array(above.astype(np.int64)),
                ], schema=arrow,
            )

    return picked.mapInArrow(run, schema)
