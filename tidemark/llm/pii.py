"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds values which are
spelled otherwise than the patterns know."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_chunks

# The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    r"[0-9](?:[\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
CARD, PHONE = re.compile(PATTERNS[2]), re.compile(PATTERNS[3])
DIGIT = re.compile("[0-9]")
# Parts of the email and ip patterns, by which both are found in one pass of linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")

#: Lines of either sort in the labelled table at most, weight buckets, and epochs of training.
SAMPLE, BUCKETS, EPOCHS = 1500, 1 << 14, 60
#: Words kept around the values of a labelled line, values of a line that are respelled, and characters around those.
AROUND, VALUES, CONTEXT = 6, 4, 40
#: A sequence ends with its line or after a word that closes a sentence. Longer ones are decoded in parts of LONGEST words,
#: each with OVERLAP more words on either side whose labels come from the neighbouring part.
LONGEST, OVERLAP = 128, 16
#: Words of up to this many bytes are features by themselves, not only by shape.
SHORT = 6
#: Characters that don't belong to a span at its ends.
EDGE = b" \t\n\x0b\x0c\r.,;:!?\"'<>[]{}|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start: leftmost matches that don't overlap within their kind;
    matches that fail their check are dropped and not tried again."""
    found = [(0, a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        found += [(1, a, b) for a, b in addresses(text) if all(_small(p) for p in text[a:b].split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found.append((3, m.start(), m.end()))
    return found


def emails(text: str):
    """Matches of the email pattern: around every @, as far to the left as its characters reach, not before the match
    before, and the domain to the right."""
    end = 0
    at = text.find("@")
    before = -1
    while at >= 0:
        start = max(end, before + 1)
        start += len(text[start:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        before, at = at, text.find("@", max(at + 1, end))


def addresses(text: str):
    """Matches of the ip pattern: every four numbers of a chain of numbers that single dots join."""
    for chain in DOTTED.finditer(text):
        if chain.group().count(".") < 3:
            continue
        at, parts = chain.start(), chain.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            yield at, at + size
            at += size + 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _classes():
    import numpy as np

    table = np.full(256, 9, np.uint8)  # other
    for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b"@", 4), (b".", 5), (b"-", 6), (b"+", 7), (b"()", 8)):
        table[list(chars)] = k
    table[128:] = 1  # letters beyond ASCII count as small ones
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


class Words:
    """Words of many texts at once (UTF-8, joined by line feeds) with their shape features and sequences."""

    def __init__(self, texts: list[bytes]):
        import numpy as np

        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        kinds = _classes()[self.data]
        white = kinds == 0
        edge = np.diff(np.concatenate(([True], white)).astype(np.int8))
        self.starts, self.stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        n = len(self.starts)
        # the collapsed shape: class of every run of one class, up to eight runs, as one number
        fresh = ~white
        fresh[1:] &= kinds[1:] != kinds[:-1]
        fresh[self.starts] = True
        at = np.flatnonzero(fresh)
        word = np.cumsum(edge == -1)[at] - 1
        first = np.searchsorted(at, self.starts)
        place = np.minimum(np.arange(len(at)) - first[word], 7)
        shape = np.bincount(word, kinds[at].astype(np.float64) * 10.0**place, n).astype(np.int64)
        digits = np.concatenate(([0], np.cumsum(kinds == 3)))
        digits = np.minimum(digits[self.stops] - digits[self.starts], 20)
        length = np.minimum(self.stops - self.starts, 31)
        self.digits = digits
        ends = kinds[self.stops - 1] if n else kinds[:0]
        lines = np.concatenate(([0], np.cumsum(self.data == 10)))[self.starts]
        closes = (ends == 5) & (digits == 0) & (length > 1)
        new = np.ones(n, bool)
        new[1:] = (lines[1:] != lines[:-1]) | closes[:-1]
        self.new = new
        begins = np.flatnonzero(new) if n else np.zeros(0, np.int64)
        lengths = np.diff(np.append(begins, n))
        parts = np.maximum(-(-lengths // LONGEST), 1) if n else lengths
        inner = np.repeat(begins, parts) + LONGEST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        stop = np.minimum(inner + LONGEST, np.repeat(begins + lengths, parts))
        # decoded from `first` on, `size` words; labels of words from `inner` to `stop` count
        self.inner, self.stop = inner, stop
        self.first = np.maximum(inner - OVERLAP, np.repeat(begins, parts))
        self.size = np.minimum(stop + OVERLAP, np.repeat(begins + lengths, parts)) - self.first
        before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
        before[1:], after[:-1] = shape[:-1], shape[1:]
        last = np.append(begins[1:], n)[: len(begins)] - 1
        before[begins], after[last] = 10**9 + 1, 10**9 + 1
        own = np.zeros(n, np.int64)
        lower = np.where((self.data >= 65) & (self.data <= 90), self.data + 32, self.data).astype(np.int64)
        for k in range(SHORT):
            at = self.starts + k
            own = own * 257 + np.where(at < self.stops, lower[np.minimum(at, max(len(lower) - 1, 0))] + 1 if n else 0, 0)
        own = np.where(self.stops - self.starts <= SHORT, own, 0)
        previous, following = np.zeros(n, np.int64), np.zeros(n, np.int64)
        previous[1:], following[:-1] = own[:-1], own[1:]
        previous[begins], following[last] = -1, -1
        mix = lambda k, x, y=0: ((x * 0x9E3779B1 + y * 0x85EBCA6B + k * 0xC2B2AE35) >> 7) % BUCKETS
        self.features = np.stack([
            mix(1, shape), mix(2, shape, length), mix(3, shape, digits), mix(4, before, shape), mix(5, after, shape), mix(6, digits, length),
            mix(7, own), mix(8, previous, shape), mix(9, following, shape),
        ])


def padded(words: Words, pick):
    """Positions of the picked sequences as a matrix (steps, sequences), longest first; -1 past their ends."""
    import numpy as np

    pick = pick[np.argsort(-words.size[pick], kind="stable")]
    steps = np.arange(words.size[pick].max(initial=0))[:, None]
    at = words.first[pick][None, :] + steps
    at[steps >= words.size[pick][None, :]] = -1
    return at


def viterbi(words: Words, model: dict):
    """The best label of every word: all sequences advance together, those of similar length in one batch."""
    import numpy as np

    emission, move = model["emission"], model["move"]
    labels = np.zeros(len(words.starts), np.int8)
    scores = emission[words.features[0]]
    for row in words.features[1:]:
        scores += emission[row]
    order = np.argsort(-words.size, kind="stable")
    for i in range(0, len(order), 16384):
        pick = order[i : i + 16384]
        at = padded(words, pick)
        live = (at >= 0).sum(1)
        best = scores[at[0]]
        back = []
        for t in range(1, len(at)):
            k = live[t]
            step = best[:k, :, None] + move
            back.append(step.argmax(1).astype(np.int8))
            best = np.concatenate((step.max(1) + scores[at[t, :k]], best[k:]))
        now = best.argmax(1).astype(np.int8)
        inner, stop = words.inner[pick], words.stop[pick]
        for t in range(len(at) - 1, -1, -1):
            k = live[t]
            counts = (at[t, :k] >= inner[:k]) & (at[t, :k] < stop[:k])
            labels[at[t, :k][counts]] = now[:k][counts]
            if t:
                now[:k] = back[t - 1][np.arange(k), now[:k]]
    return labels


def train_field(texts: list[bytes], spans: list[list[tuple[int, int, int]]], epochs: int = EPOCHS) -> dict:
    """Maximum likelihood by gradient steps (Adam) with exact marginals from the forward-backward recursions, on a labelled
    table: texts with their (kind, start, end) in bytes. Label 0 is none, k + 1 is kind k."""
    import numpy as np

    n_labels = len(KINDS) + 1
    words = Words(texts)
    offsets = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
    gold = np.zeros(len(words.starts), np.int64)
    for i, own in enumerate(spans):
        for kind, a, b in own:
            lo, hi = np.searchsorted(words.stops, offsets[i] + a, "right"), np.searchsorted(words.starts, offsets[i] + b, "left")
            gold[lo:hi] = kind + 1
    emission, move = np.zeros((BUCKETS, n_labels), np.float32), np.zeros((n_labels, n_labels), np.float32)
    if not len(words.starts):
        return {"emission": emission, "move": move}
    at = padded(words, np.arange(len(words.first)))
    live = (at >= 0).sum(1)
    flat = words.features
    target_move = np.zeros((n_labels, n_labels))
    for t in range(1, len(at)):
        np.add.at(target_move, (gold[at[t - 1, : live[t]]], gold[at[t, : live[t]]]), 1)
    eye = np.eye(n_labels)[gold]
    m, v = [np.zeros_like(emission), np.zeros_like(move)], [np.zeros_like(emission), np.zeros_like(move)]
    norm = len(words.first)
    for epoch in range(1, epochs + 1):
        scores = sum(emission[row] for row in flat).astype(np.float64)
        alpha, beta = [scores[at[0]]], [None] * len(at)
        lse = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
        for t in range(1, len(at)):
            alpha.append(lse(alpha[-1][: live[t], :, None] + move, 1) + scores[at[t, : live[t]]])
        total = np.zeros(live[0])
        for t in range(len(at)):
            nxt = live[t + 1] if t + 1 < len(at) else 0
            total[nxt : live[t]] = lse(alpha[t][nxt:], 1)
        beta[-1] = np.zeros((live[-1], n_labels))
        expected_move = np.zeros((n_labels, n_labels))
        for t in range(len(at) - 2, -1, -1):
            k = live[t + 1]
            onward = move[None] + (scores[at[t + 1, :k]] + beta[t + 1])[:, None, :]
            beta[t] = np.zeros((live[t], n_labels))
            beta[t][:k] = lse(onward, 2)
            expected_move += np.exp(alpha[t][:k, :, None] + onward - total[:k, None, None]).sum(0)
        marginal = np.zeros((len(words.starts), n_labels))
        for t in range(len(at)):
            marginal[at[t, : live[t]]] = np.exp(alpha[t] + beta[t] - total[: live[t], None])
        error = eye - marginal
        grad = np.zeros((BUCKETS, n_labels))
        for k in range(n_labels):
            grad[:, k] = sum(np.bincount(row, error[:, k], BUCKETS) for row in flat)
        for j, (weights, g) in enumerate(((emission, grad), (move, target_move - expected_move))):
            g = g / norm - 1e-5 * weights
            m[j] = 0.9 * m[j] + 0.1 * g
            v[j] = 0.999 * v[j] + 0.001 * g * g
            weights += (0.15 * (m[j] / (1 - 0.9**epoch)) / (np.sqrt(v[j] / (1 - 0.999**epoch)) + 1e-8)).astype(np.float32)
    return {"emission": emission, "move": move}


def varied(kind: int, value: str, k: int) -> str:
    """Another value of the kind, so that the field learns more than the corpus's habits: emails without their digits
    or with a dot in the name, addresses with numbers of other lengths."""
    if kind == 0 and k % 2:
        name, _, place = re.sub("[0-9]", "", value).partition("@")
        name = name.strip(".") or "name"
        name = f"{name[: len(name) // 2 + 1]}.{name[len(name) // 2 :]}" if k % 4 == 1 else name
        return f"{name}@{place.lstrip('.') or 'host.org'}"
    if kind == 1:
        seed = hashlib.md5(f"{k}:{value}".encode()).digest()
        return ".".join(str(x % (10, 100, 256)[y % 3]) for x, y in zip(seed[:4], seed[4:8], strict=True))
    return value


def respelled(kind: int, value: str) -> list[str]:
    """Other spellings of a value found by the base patterns, which those patterns miss."""
    if kind == 0:
        name, _, place = value.partition("@")
        return [f"{name} (at) {place}", f"{name} [at] {place}", f"{name} [at] {place.replace('.', ' [dot] ')}", f"{name}(at){place}", f"{name} @ {place}"]
    if kind == 1:
        return [value.replace(".", x) for x in (" . ", "[.]", " .", ". ", "(.)")]
    digits = re.sub("[^0-9]", "", value)
    if kind == 3 and len(digits) >= 10:
        d = digits[-10:]
        return [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"001 {d[:3]} {d[3:6]}{d[6:]}", f"{d[:3]}/{d[3:6]}-{d[6:]}"]
    if kind == 2 and len(digits) == 16:
        four = [digits[i : i + 4] for i in range(0, 16, 4)]
        return [x.join(four) for x in (".", "/", "_", "--", "  ")]
    return []


def failed_values(text: str) -> bool:
    """Whether a value that looks like one of a kind fails its check, and nothing else does look so: such a line is known
    to hold none."""
    looks = any(True for _ in addresses(text)) or PHONE.search(text) or any(sum(c.isdigit() for c in m.group()) >= 16 for m in CARD.finditer(text))
    return bool(looks) and not base_spans(text)


def labelled_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """The small labelled table: at most `sample` lines of the corpus with values that the base patterns find, each labelled
    so; the same lines with up to VALUES of their values respelled, labelled alike; and at most `sample` lines known to
    hold none, because what looks like a value fails its check. Lines nobody has judged aren't in it. Lines are taken in the
    order of a hash of id and line, and hold AROUND words around their values (CONTEXT characters around respelled ones).

    Edge cases: null and empty texts give no line; repeated rows give equal lines, of which each counts; a table without
    such lines, or an empty one, gives an empty table, on which `train_field` makes a field that adds nothing; other columns
    are ignored."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("line string, hit boolean, h string")
    texts = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        import pyarrow as pa

        for part, chunk in text_chunks(batches, "text"):
            rows = []
            for key, text in zip(part.column(0).to_pylist(), chunk, strict=True):
                for line in text.decode("utf-8", "replace").split("\n"):
                    if DIGIT.search(line) or "@" in line:
                        words = line.split(" ")
                        near = [i for i, w in enumerate(words) if DIGIT.search(w) or "@" in w]
                        line = " ".join(words[max(0, near[0] - AROUND) : min(near[-1], near[0] + 30) + AROUND + 1])
                        hit = bool(base_spans(line))
                        if hit or failed_values(line):
                            rows.append((line, hit, hashlib.md5(f"{key}:{line}".encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string()))], ["line", "hit", "h"])

    lines = texts.mapInArrow(run, schema)
    table = []
    for hit in (True, False):
        for k, row in enumerate(lines.where(F.col("hit") == hit).orderBy("h", "line").limit(sample).collect()):
            table += labelled_line(row["line"], k)
    return table


def labelled_line(line: str, k: int = 0) -> list[tuple[bytes, list[tuple[int, int, int]]]]:
    """A line labelled by the base patterns, and the same line around each of its first VALUES values in the k-th respelling."""
    spans = base_spans(line)
    size = lambda text: len(text.encode())
    table = [(line.encode(), [(kind, size(line[:a]), size(line[:b])) for kind, a, b in spans])]
    for kind, a, b in spans[:VALUES]:
        others = respelled(kind, varied(kind, line[a:b], k // 5))
        head, tail = line[max(0, a - CONTEXT) : a], line[b : b + CONTEXT]
        if others and not base_spans(head) and not base_spans(tail):
            other = others[k % len(others)]
            table.append((f"{head}{other}{tail}".encode(), [(kind, size(head), size(head) + size(other))]))
    return table


def held_out_quality(table: list, model_of=None, folds: int = 5) -> dict[str, float]:
    """Precision and recall of the field alone on the labelled lines that a field trained without them hasn't seen: a span
    counts as right where kind, start and end agree (bytes)."""
    model_of = model_of or (lambda rows: train_field([x for x, _ in rows], [y for _, y in rows]))
    right = said = there = 0
    for fold in range(folds):
        model = model_of([r for i, r in enumerate(table) if i % folds != fold])
        rest = [r for i, r in enumerate(table) if i % folds == fold]
        found = added_spans([x for x, _ in rest], [[]] * len(rest), model)
        for (text, spans), got in zip(rest, found, strict=True):
            raw = text.decode()
            got_bytes = {(kind, len(raw[:a].encode()), len(raw[:b].encode())) for kind, a, b in got}
            right, said, there = right + len(got_bytes & set(spans)), said + len(got_bytes), there + len(spans)
    return {"precision": right / max(said, 1), "recall": right / max(there, 1), "spans": there}


def find_personal_data(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in whole texts, one row per input row: the id, base and added (arrays of kind, start, end; code
    points, end exclusive). `base` has what the fixed patterns find. `added` has what the random field labels beyond that:
    runs of words of one label, trimmed of punctuation, that are plausible for their kind and touch no base span.

    Edge cases: null text counts as empty, which has no spans; very long texts are read whole; repeated rows stay; an
    empty table gives an empty result; other columns are ignored.
    """
    picked = docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<kind: string, start: int, end: int>>"

    def run(batches):
        import pyarrow as pa

        model = shared.value
        names = ["kind", "start", "end"]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for part, texts in text_chunks(batches, "text", 2 << 20):
            base = [base_spans(x.decode("utf-8", "replace")) for x in texts]
            more = added_spans(texts, base, model)
            rows = [[dict(zip(names, (KINDS[k], a, b), strict=True) ) for k, a, b in x] for x in base + more]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows[: len(base)], kind), pa.array(rows[len(base) :], kind)], ["id", "base", "added"])

    out = picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, base {span}, added {span}")
    return out.withColumnRenamed("id", id_col)


def added_spans(texts: list[bytes], base: list[list[tuple[int, int, int]]], model: dict) -> list[list[tuple[int, int, int]]]:
    """Per text, the field's spans (kind, start, end in code points) outside the base ones, by kind, then start."""
    import numpy as np

    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    words = Words(texts)
    labels = viterbi(words, model) if len(words.starts) else np.zeros(0, np.int8)
    hits = np.flatnonzero(labels)
    if not len(hits):
        return out
    offsets = np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts])))
    breaks = np.flatnonzero((np.diff(hits) != 1) | (np.diff(labels[hits]) != 0) | words.new[hits[1:]]) + 1
    at, points, starts, ends = -1, None, [], []  # of the text at hand: code points up to each byte, base spans by start
    for run in np.split(hits, breaks):
        a, b = int(words.starts[run[0]]), int(words.stops[run[-1]])
        i = int(np.searchsorted(offsets, a, "right")) - 1
        a, b = a - int(offsets[i]), b - int(offsets[i])
        raw = texts[i]
        while a < b and raw[a] in EDGE:
            a += 1
        while b > a and raw[b - 1] in EDGE:
            b -= 1
        if not plausible(int(labels[run[0]]) - 1, raw[a:b].decode("utf-8", "replace")):
            continue
        if at != i:  # runs come in the order of texts
            at, points = i, np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
            own = sorted((s, e) for _, s, e in base[i])
            starts, ends = [s for s, _ in own], list(accumulate((e for _, e in own), max))
        a, b = int(points[a]), int(points[b])
        before = bisect_left(starts, b)  # base spans that begin before this one ends
        if not before or ends[before - 1] <= a:
            out[i].append((int(labels[run[0]]) - 1, a, b))
    return [sorted(x) for x in out]


def plausible(kind: int, value: str) -> bool:
    """An exact check behind the field: what a value of its kind can't do without, however it is spelled."""
    digits = re.sub("[^0-9]", "", value)
    if kind == 0:
        return bool(re.search(r"[A-Za-z0-9]\s*(?:@|\W+at\W+)\s*[A-Za-z0-9-]+(?:\.|\W+dot\W+)[A-Za-z0-9]", value, re.IGNORECASE))
    if kind == 1:
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(_small(p) for p in parts) and not re.search("[A-Za-z]", value)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and not re.search("[A-Za-z]", value)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
