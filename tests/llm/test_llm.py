"""Corpus operators against brute force, exact round trips and held-out cases, with the edge cases of their docstrings."""

import functools
import hashlib
import io
import itertools
import math
import os
import random
import re
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, exact_dedup, langid, media, mixing, near_dedup, packing, pii, suffix_lm, toxicity, warc
from tidemark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, id int"
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "rho", "tau", "psi"]


def sentence(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = sentence(1, 6000)
    near = long.replace(" ", "  ", 1)
    texts = [None, "", " \t\n", "one", "one two", "ONE two", long, long, near, long + " tail", sentence(2, 60), sentence(2, 60) + " end", sentence(3, 60), "é ü 漢字 \x00", "x" * 5000]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, None, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[3], (20, "ein Wort", "de", "s1", 1, None, 8)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, width=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def test_exact_dedup(docs, empty):
    got = [tuple(r) for r in exact_dedup.progressive_dedup(docs, digest_all=True).collect()]
    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm])[1]
        want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    assert sorted(got) == sorted(want)
    assert exact_dedup.progressive_dedup(empty).count() == 0


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup_against_all_pairs(spark, docs, width):
    base = sentence(9, 150).split()
    made = []
    for k in range(40):
        r, w = random.Random(k), list(base)
        for _ in range(k % 9):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        made.append((100 + k, " ".join(w)))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    rows = {(r.doc_id, r.text) for r in df.collect()}
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {tuple(r) for r in near_dedup.near_duplicates(df, width=width).collect()}
    assert got == {(i, len(sets[i]), find(i), find(i) == i) for i in sets}


def edited_group(n, words=60, edits=2, seed=0):
    """Copies of one text of `words` words, each with its own edits: most of them are similar, few are linked."""
    base, out = sentence(77, words).split(), []
    for k in range(n):
        r, w = random.Random(seed + k), list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        out.append((k, " ".join(w)))
    return out


@pytest.mark.parametrize("n, edits", [(600, 1), (600, 2)])
def test_large_group_of_near_copies_against_all_pairs(spark, n, edits):
    rows = edited_group(n, edits=edits)
    sets = {i: shingles(t, 5) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df, width=5).collect()}
    assert got == {(i, find(i)) for i in sets}


def test_prefix_join_loses_no_similar_pair(spark):
    """All texts are open and every text is its own component: the join alone must bring every similar pair."""
    rows = edited_group(60, words=80, edits=2) + [(100 + i, t + " " + sentence(i, i % 7)) for i, t in edited_group(60, words=80, edits=1, seed=500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_dedup.full_sets(df, "doc_id", "text", 4).select("id", "set", "sketch")
    tried = near_dedup.prefix_pairs(near_dedup.prefix_rows(sets, 80).withColumn("comp", F.col("id")), 80)
    found = {tuple(r) for r in tried.collect()}
    own = {i: shingles(t) for i, t in rows}
    for a, b in itertools.combinations(sorted(own), 2):
        both = len(own[a] & own[b])
        if 100 * both >= 80 * (len(own[a]) + len(own[b]) - both):
            assert (a, b) in found
    assert len(found) < len(own) * (len(own) - 1) // 2


def test_sketches_differ_no_more_than_their_sets():
    import numpy as np

    a = near_dedup._mix(np.arange(400, dtype=np.uint64))
    for k in (0, 5, 50, 200):
        x, y = (np.array(near_dedup.sketch(s), np.int64).view(np.uint8) for s in (a[: 200 + k], a[k:200]))
        assert int(np.unpackbits(x ^ y).sum()) <= 2 * k


def test_near_dedup_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_minmax_estimate_is_unbiased():
    import numpy as np

    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = near_dedup._mix(a)
    hits = [np.mean(near_dedup.band_keys(sets[k : k + 180], 300, 1) == near_dedup.band_keys(sets[k + 20 : k + 200], 300, 1)) for k in range(0, 800, 40)]
    assert abs(np.mean(hits) - 0.8) < 0.02


def test_mixing(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert [tuple(r) for r in mixing.mix_sources(docs).orderBy("doc_id", "taken").collect()] == sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[4]))
    total = sum(r.size for r in rows)
    assert sum(r.taken for r in rows) <= total and all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    assert sum({r.source_size: r.target for r in rows}.values()) <= total + 1e-3
    assert mixing.mix_sources(empty).count() == 0


def test_mix_shares_reach_their_caps(spark):
    df = spark.createDataFrame([("a", False, 100), ("b", False, 10), ("", True, 300)], "_src string, _null boolean, _total long")
    got = {r._src: r._target for r in mixing.source_shares(df).collect()}
    assert got["b"] == 30.0 and abs(got["a"] - 95.0) < 1e-6 and abs(got[""] - 285.0) < 1e-6


def test_media_round_trip(docs, empty):
    stored = media.encode_media(docs)
    rows = media.probe_media(stored, digest=True).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in rows:
        payload = media.pad(texts[r.doc_id])
        assert r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.n_bytes == len(texts[r.doc_id]) and r.codec == "raw "
        data = media.mux(payload)
        assert all(data[k.start : k.end] == payload[i * 1024 : i * 1024 + 64] for i, k in enumerate(r.keyframes))
    assert media.probe_media(media.encode_media(empty)).count() == 0


def test_broken_media(spark):
    good = media.mux(media.pad(b"abc"))
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:50])), (3, None), (4, bytearray(b"junk"))], "codec int, media binary")
    rows = media.probe_media(df).collect()
    assert [r.codec for r in rows] == ["raw ", None, None, None] and rows[0].n_samples == 1


def test_zip_ranges():
    data = warc.zip_archive([("a", b"x" * 1000), ("dir/b", b"yz")])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read("dir/b") == b"yz"
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("stored", b"hello")
        z.writestr("packed", b"hello" * 100, zipfile.ZIP_DEFLATED)
    raw = plain.getvalue()
    ranges = warc.ZipRanges(lambda at, n: raw[at : at + n], len(raw))
    assert ranges.member("stored", 1, 3) == b"ell"
    with pytest.raises(ValueError):
        ranges.member("packed")
    with pytest.raises(ValueError):
        warc.ZipRanges(lambda at, n: b"nothing"[at : at + n], 7)


def test_range_reads_take_few_bytes_and_revisits_name_their_record(spark):
    pages = [(i, f"https://h/{i}", f"<p>{sentence(i, 300)}</p>") for i in range(40)] + [(99, "https://h/99", f"<p>{sentence(3, 300)}</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    heads, read_once = {}, False
    for row in warc.write_archives(df).collect():
        data, taken = bytes(row.bytes), []

        def read(at, n, data=data, taken=taken):
            taken.append(min(n, len(data) - at))
            return data[at : at + n]

        archive = warc.ZipRanges(read, len(data))
        for key, start, length in (x.split(b" ") for x in archive.member(warc.INDEX_MEMBER).splitlines()):
            taken.clear()
            heads[key], payload = warc.parse_record(archive.member(warc.WARC_MEMBER, int(start), int(length)))
            assert sum(taken) == int(length) + 30  # the record and its member's local header
            if key == b"7":
                assert payload == pages[7][2].encode() and sum(taken) < len(data) // 10
                read_once = True
    first, again = heads[b"3"], heads[b"99"]
    assert read_once and len(heads) == 41
    assert again["warc-type"] == "revisit" and again["warc-refers-to"] == first["warc-record-id"] and again["warc-refers-to-target-uri"] == "https://h/3"


def test_warc_round_trip(spark):
    pages = [(1, "u1", "<p>a</p>"), (2, None, None), (3, "u3", "<p>a</p>"), (4, "u4", ""), (5, "u\r\n5", "\r\n\r\né"), (5, "u\r\n5", "\r\n\r\né")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("body", F.lit(1))
    got = sorted(tuple(r)[:5] for r in warc.read_archives(warc.write_archives(df)).collect())
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        first = min(p for p, _, h in pages if (h or "").encode() == raw)
        want.append((i, len(raw), warc.sha1_base32(raw), "response" if i == first else "revisit", None if i == first else first))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_packing_is_whole_and_gapless(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = packing.token_pieces(docs, tokenizer_path(), keep_ids=True)
    for r in pieces.collect():
        text = next(d.text for d in docs.where(F.col("doc_id") == r.doc_id).collect()) or ""
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1][r.start : r.start + r.length]
        assert r.ids == b"".join(i.to_bytes(4, "little") for i in ids) and r.ids_crc32 == zlib.crc32(r.ids)
    packed = packing.pack_documents(docs, tokenizer_path()).collect()
    assert len(packed) == pieces.count()
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 4096
    assert len(by) <= -(-sum(r.length for r in packed) // 4096) + 1
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(tokenizer_path()), packing.Ids(tokenizer_path())
    texts = ["I'm DON'T x'll 's", "ÀÉß ñ½²ª 12.5", "İΣ ǅ é", "<|endoftext|> a", "a\x1cb\x85c d", "", "漢字 😀 ok--''s", "ſ Ŀ ŉ"]
    for text, got in zip(texts, ids.encode(texts), strict=True):
        assert got == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids), text


def test_new_words_are_learned_from_one_text():
    from tokenizers import Tokenizer

    tokenizer, ids, calls = Tokenizer.from_file(tokenizer_path()), packing.Ids(tokenizer_path()), []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            calls.append(len(texts))
            return tokenizer.encode_batch_fast(texts, **kw)

    ids.tokenizer = Counted()
    r = random.Random(3)
    signs = [c for c in map(chr, range(0x21, 0x180)) if packing.PLAIN.fullmatch(c)]
    text = " ".join("".join(r.choices(signs if k % 2 else "ab's9.", k=r.randrange(1, 12))) for k in range(3000))
    assert ids.encode([text]) == [b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)]
    assert calls == [1] * -(-len(ids.words) // 4096)
    for word, got in ids.words.items():
        assert got == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(word, add_special_tokens=False).ids), word
    ids.last = set()  # a vocabulary without ends of words
    ids.learn(["again", "and"])
    assert calls[-1] == 2 and ids.words["and"] == b"".join(i.to_bytes(4, "little") for i in tokenizer.encode("and").ids)


def test_knapsack_against_brute_force():
    import numpy as np

    prices = np.random.default_rng(3).random(7)
    counts = packing.knapsack(prices)
    best = max(sum(prices[k - 1] for k in c) for n in range(8) for c in itertools.combinations_with_replacement(range(1, 8), n) if sum(c) <= 7)
    assert abs(counts @ prices - best) < 1e-12 and counts @ np.arange(1, 8) <= 7


def test_base_patterns():
    text = "a.b@c-d.org x@y 1.2.3.4 999.1.1.1 4111 1111 1111 1111 4111111111111112 +1 (415) 555-2671 +12"
    got = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.base_spans(text)]
    # the digits from "1 4111" on are one match of 33 digits, which fails and isn't tried again
    assert got == [("email", "a.b@c-d.org"), ("ip", "1.2.3.4"), ("phone", "+1 (415) 555-2671")]
    text = "card 4111 1111-1111 1111, card 4111111111111112"
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in pii.base_spans(text)] == [("card", "4111 1111-1111 1111")]


def test_random_field_learns_and_viterbi_is_exact():
    import numpy as np

    lines = [(f"call {a}{b}{c}-{d}{e}{a}{b} now".encode(), [(3, 5, 13)]) for a, b, c, d, e in itertools.product("13", "24", "57", "68", "90")] + [(f"the {w} is here".encode(), []) for w in WORDS]
    model = pii.train_field([x for x, _ in lines], [y for _, y in lines])
    assert pii.added_spans([b"call 124-5678 now"], [[]], {**model}) in ([[]], [[(3, 5, 13)]])
    words = pii.Words([b"call 111-2222 now", b"plain words"])
    labels = pii.viterbi(words, model)
    scores = sum(model["emission"][row] for row in words.features)
    for first, size in zip(words.first, words.size, strict=True):
        best = max(itertools.product(range(5), repeat=int(size)), key=lambda p: sum(scores[first + i, k] for i, k in enumerate(p)) + sum(model["move"][a, b] for a, b in zip(p, p[1:], strict=False)))
        assert np.array_equal(labels[first : first + size], best)
    assert labels[1] == 4 and not labels[words.first[1] :].any()


def test_linear_patterns_equal_their_expressions():
    email, ip = re.compile(pii.PATTERNS[0]), re.compile(pii.PATTERNS[1])
    r = random.Random(5)
    for _ in range(4000):
        text = "".join(r.choice("a.@@1-%b 9._é") for _ in range(r.randrange(24)))
        assert list(pii.emails(text)) == [m.span() for m in email.finditer(text)], text
        text = "".join(r.choice("12..3. 4") for _ in range(r.randrange(30)))
        assert list(pii.addresses(text)) == [m.span() for m in ip.finditer(text)], text


def test_patterns_take_linear_time():
    import time

    began = time.time()
    for text in ("x" * 2_000_000 + " @", "1" * 2_000_000, "1." * 1_000_000, "a@" * 500_000, "+1" + " " * 1_000_000):
        assert pii.base_spans(text) is not None
    assert time.time() - began < 30


def personal_lines():
    r = random.Random(3)
    lines = []
    for k in range(160):
        name, n = r.choice(WORDS) + r.choice(WORDS), [r.randrange(256) for _ in range(4)]
        digits = [r.randrange(10) for _ in range(15)]
        card = next(f"{''.join(map(str, digits))}{c}" for c in range(10) if pii.luhn(f"{''.join(map(str, digits))}{c}"))
        value = [f"{name}.{k}@{r.choice(WORDS)}.example.org", ".".join(map(str, n)), card, f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}"][k % 4]
        lines.append(f"{sentence(k, 5)} {value} {sentence(k + 999, 5)}")
    return lines


def test_field_finds_respelled_values_that_it_has_not_seen(spark):
    lines = personal_lines()
    table = [x for k, line in enumerate(lines) for x in pii.labelled_line(line, k)] + [(f"{sentence(k, 4)} 999.{k}.1.1 {sentence(k, 4)}".encode(), []) for k in range(40)]
    quality = pii.held_out_quality(table, folds=3)
    assert quality["precision"] > 0.9 and quality["recall"] > 0.75
    model = pii.train_field([x for x, _ in table], [y for _, y in table])
    long = " ".join(["x"] * 125) + " jane.roe (at) mail.example.org " + " ".join(["y"] * 300)
    for text, kind in (("please write to jane.roe (at) mail.example.org today", 0), ("the host 10 . 20 . 30 . 4 was down", 1), (long, 0)):
        assert [k for k, _, _ in pii.added_spans([text.encode()], [pii.base_spans(text)], model)[0]] == [kind], text
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, lines[0], None, ""])], "doc_id long, text string")
    assert len(pii.labelled_table(df)) >= len(lines) and pii.labelled_table(df.limit(0)) == []


def test_personal_data_query_against_expressions(spark, folder):
    """The contract's columns over a table, with nulls, from the fixed expressions alone."""
    from tidemark.llm import queries

    texts = [*personal_lines(), None, "", "999.1.1.1 and 4111111111111112 and +12", "é 1.2.3.4 a.b@c-d.org é 1.2.3.4"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_pii(spark, folder).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        spans = []
        for k, pattern in enumerate(pii.PATTERNS):
            for m in re.finditer(pattern, text or ""):
                digits = re.sub("[^0-9]", "", m.group())
                fine = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True, 16 <= len(digits) <= 19 and pii.luhn(digits), 8 <= len(digits) <= 15][k]
                if fine:
                    spans.append((k, m.start(), m.end()))
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for k, _, _ in spans) for j in range(4))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and (r.spans == line or r.n_added)


def test_many_added_spans_of_one_text_take_linear_time_and_are_exact():
    """Offsets in code points, spans that touch base ones and those that overlap them, against decoding from the start."""
    import time

    lines = personal_lines()
    table = [x for k, line in enumerate(lines) for x in pii.labelled_line(line, k)]
    model = pii.train_field([x for x, _ in table], [y for _, y in table])
    text = " é漢 ".join(f"please write to jane{k}.roe (at) mail.example.org today" for k in range(3000))
    base = [[(3, 0, 6), (0, 40, 400), (1, 60, 62)]]
    began = time.time()
    spans = pii.added_spans([text.encode()], base, model)[0]
    took = time.time() - began
    every = pii.added_spans([text.encode()], [[]], model)[0]
    assert len(every) > 2500 and all("jane" in text[a:b] and text[a:b].endswith(".org") for _, a, b in every[:200])
    assert spans == [x for x in every if all(x[2] <= s or e <= x[1] for _, s, e in base[0])] and len(spans) < len(every)
    assert took < 20


def test_personal_data_edges(docs, empty):
    model = pii.train_field([], [])
    assert pii.find_personal_data(docs, model).where(F.size("base") + F.size("added") > 0).count() == 0
    assert pii.find_personal_data(empty, model).count() == 0


def test_toxicity_separates(spark, docs, empty):
    clean = [sentence(i, 60).encode() for i in range(300)]
    bad = [(sentence(1000 + i, 50) + " worthless idiot scum loser " + sentence(2000 + i, 10)).encode() for i in range(80)]
    model = toxicity.fit_toxicity(bad, clean)
    rows = [(1, sentence(7777, 50) + " you idiot and loser", 0), (2, sentence(8888, 60), 0), (3, None, 0), (4, "", 0)]
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, score int"), model).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4)] == [1, 0, 0, 0] and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity([], [])).where("score between 0 and 1").count() == docs.count()
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_language(spark, docs, empty):
    en = [f"the {w}ing of the {w} and this {w}" for w in WORDS] * 3
    de = [f"der {w} und die {w}ung ist nicht {w}" for w in WORDS] * 3
    model = langid.fit_centroids([x.encode() for x in en + de], ["en"] * len(en) + ["de"] * len(de))
    df = spark.createDataFrame([(1, "the thing and this"), (2, "die Sache ist nicht und der"), (3, "123 ..."), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict_language(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "de", "und", "und"] and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict_language(docs, langid.fit_centroids([], [])).where("lang_pred = 'und'").count() == docs.count()
    assert langid.predict_language(empty, model).count() == 0
    assert langid.train_language_model(docs, F.lit(True))["langs"]


def test_language_model_against_brute_force(docs, empty):
    from collections import Counter

    got = suffix_lm.score_documents(docs, F.col("doc_id") % 7 != 2).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower()) for r in docs.collect()]
    counts = Counter()
    for i, t in rows:
        if i % 7 != 2:
            counts.update([*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*t.split(), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want.append((i, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert suffix_lm.score_documents(empty, F.lit(True)).count() == 0


DATA = "/root/testdata/sf0.001"


def _plain_suffix_tree(counts):
    """Scores of tokens and retained contexts by the definition, every context counted in a dictionary."""
    from collections import Counter, defaultdict

    full = {w: b" \n" if w == b"\n" else b" " + w + b" " for w in counts}
    follow = defaultdict(Counter)
    for w, c in counts.items():
        for i in range(1, len(full[w])):
            for d in range(i + 1):
                follow[full[w][i - d : i]][full[w][i]] += c

    @functools.cache
    def p(context, symbol):
        back = p(context[1:], symbol) if context else 1 / 252
        return (follow[context][symbol] + 8 * back) / (sum(follow[context].values()) + 8)

    @functools.cache
    def retained(context):
        if not context:
            return True
        seen = sum(follow[context].values())
        told = sum(n * math.log(n / seen / p(context[1:], x)) for x, n in follow[context].items() if n)
        return retained(context[1:]) and seen >= 16 and told >= 8

    def state(before):
        d = 0
        while d < len(before) and retained(before[len(before) - d - 1 :]):
            d += 1
        return before[len(before) - d :]

    scores = {w: sum(math.log10(p(state(f[:i]), f[i])) for i in range(1, len(f))) for w, f in full.items()}
    return scores, {c for c in list(follow) if retained(c)}, p


def test_suffix_tree_against_plain_tree(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("text", "doc_id % 7 != 2 as train")
    long = spark.createDataFrame([("stem" * 12 + x, True) for x in "abcdefgh" for _ in range(20)] + [("x" * 3000 + " \u00e9\u00df", False), (None, True)], base.schema)
    docs = base.union(long)
    scored, tree = suffix_lm.score_tokens(docs)
    got = {bytes(r.word): (r.c, r.score) for r in scored.collect()}
    counts = {w: c for w, (c, _) in got.items()}
    assert counts[b"\n"] == docs.where("train").count()
    scores, contexts, p = _plain_suffix_tree({w: c for w, c in counts.items() if len(w) < 100})
    assert all(abs(got[w][1] - s) < 1e-6 * len(w) for w, s in scores.items()) and len(scores) == len(got) - 1
    rows = [r for t in tree for r in t.collect()]
    # the one long token is in no training row: it moves no count, yet is scored whole
    assert {bytes(r.context) for r in rows} == contexts and max(map(len, contexts)) > 3
    for context in list(contexts)[:50]:  # every context's distribution sums to one
        assert abs(sum(p(context, x) for x in range(256) if x not in (9, 11, 12, 13)) - 1) < 1e-9
    # more text, more contexts; and a row's window moves nothing
    half, small = suffix_lm.score_tokens(base.where("pmod(hash(text), 2) = 0"))
    assert sum(t.count() for t in small) < len(rows)
    full = F.expr("case when word = x'0a' then x'200a' else concat(x'20', word, x'20') end")
    tokens = common.materialize(scored.select("word", "c", full.alias("full"), F.monotonically_increasing_id().alias("id")))
    again = tokens.join(suffix_lm.grow_tree(tokens, window=1)[0], "id").collect()
    assert all(abs(got[bytes(r.word)][1] - r.score) < 1e-6 * (1 + len(r.word)) for r in again) and len(again) == len(got)


@pytest.fixture(scope="module")
def edge_dir(spark):
    """The smallest driver documents and labels, with null, empty, repeated and odd rows added."""
    import tempfile

    at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "123 ...", None, "s", 7), (10**6 + 3, "Ein  Wort\t" * 3, "de", None, 4), (10**6 + 4, sentence(8, 30000), "en", "s", 4)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("row", F.lit(1)).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def crc_mod(i, k):
    return zlib.crc32(str(i).encode()) % k


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_queries_keep_their_contract(spark, edge_dir):
    from tokenizers import Tokenizer

    from tidemark.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = lambda f: {r.doc_id: r for r in f(spark, edge_dir).collect()}
    two, three, five, six = (rows(f) for f in (queries.op2_toxicity, queries.op3_media, queries.op5_language, queries.op6_suffix_lm))
    assert set(two) == set(three) == set(five) == set(six) == set(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        assert two[i].held_out == (crc_mod(i, 5) == 0) and 0 <= two[i].score <= 1 and two[i].predicted == int(two[i].score >= 0.5)
        payload = media.pad(raw)
        r = three[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(media.mux(payload)) and r.media_sha256 == hashlib.sha256(media.mux(payload)).hexdigest()
        assert five[i].held_out == (crc_mod(i, 4) == 2) and 0 <= five[i].score <= 1
        assert (five[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert six[i].held_out == (crc_mod(i, 7) == 2) and six[i].n_tokens == len(raw.split()) + 1 and six[i].score <= 0
    lookup = Tokenizer.from_file(tokenizer_path())
    pieces = {}
    for r in queries.op10_packing(spark, edge_dir).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for i in [*list(texts)[:20], 10**6, 10**6 + 1, 10**6 + 4]:
        ids = [*lookup.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == list(range(0, len(ids), 4096))
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) and r.offset + r.length <= 4096
        assert sum(r.length for r in own) == len(ids)


def test_more_members_than_a_filter_takes(spark, docs, monkeypatch):
    """Where the bucket filter isn't used, the joins behind it give the same results."""
    import corpus_pipeline as C
    from tidemark.llm import common

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    pages = plain.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    found = []
    for most in (common.FILTER_MOST, 0):
        monkeypatch.setattr(common, "FILTER_MOST", most)
        found.append([
            sorted(map(str, C.drop_copies(spark, plain, "").collect())), sorted(map(str, near_dedup.near_duplicates(plain).collect())),
            sorted(map(str, warc.read_archives(warc.write_archives(pages)).drop("url").collect())),
        ])
    assert found[0] == found[1]


def test_few_lengths_are_packed_as_well_as_they_can_be():
    """Against the fewest sequences found by trying all ways, for small cases."""
    import functools

    def fewest(lengths, capacity):
        @functools.lru_cache(None)
        def best(left, room):
            if not left:
                return 0
            tries = []
            for i in range(len(left)):
                if i and left[i] == left[i - 1]:
                    continue
                rest = left[:i] + left[i + 1 :]
                tries.append(best(rest, room - left[i]) if left[i] <= room else 1 + best(rest, capacity - left[i]))
            return min(tries)

        return best(tuple(sorted(lengths)), 0)

    for lengths in ([2048] * 3, [3000, 1096, 2000, 2000, 96], [1366] * 3, [4096, 1, 4095], [1500, 1500, 1096, 2600, 1400], [2731, 1365, 2731, 1365]):
        histogram = {n: lengths.count(n) for n in lengths}
        plan = packing.plan_packing(histogram)
        assert sum(k for _, k in plan) <= fewest(lengths, 4096) + (0 if len(lengths) < 4 else 1)
        assert sorted(n for content, k in plan for n in content * k) == sorted(lengths) and all(sum(c) <= 4096 for c, _ in plan)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_pipeline_stages(spark, folder):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen.append(docs)
        assert docs.columns == columns or k == len(C.STAGES) - 1
    toxic, exact, near, mixed, packed = seen
    norm = F.regexp_replace("text", r"[\x20\x09-\x0D]", "")
    assert exact.count() == exact.select(norm).distinct().count() == toxic.select(norm).distinct().count()
    sets = {r.doc_id: shingles(r.text, 5) for r in near.collect()}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        assert not sets[a] or not sets[b] or 100 * both < 80 * (len(sets[a]) + len(sets[b]) - both)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_pipeline_keeps_rows_with_null_and_shared_ids(spark):
    import corpus_pipeline as C

    texts = [sentence(500 + i, 40) for i in range(12)]
    rows = [(None, t, "s") for t in texts[:4]] + [(7, t, "s") for t in texts[4:8]] + [(i, texts[i], "s") for i in (8, 9)]
    copies = [(None, texts[0], "s"), (7, texts[8], "s"), (7, texts[4], "t"), (None, texts[5].replace(" ", "  ", 1), "s"), (None, texts[9] + " end", "s")]
    docs = spark.createDataFrame([*rows, *copies, (None, None, "s"), (None, "", "s")], "doc_id long, text string, source string")
    exact = C.drop_copies(spark, docs, "")
    norm = lambda df: sorted(re.sub(r"\s", "", r.text or "") for r in df.collect())
    assert norm(exact) == sorted({re.sub(r"\s", "", t or "") for _, t, _ in [*rows, *copies, (0, "", "")]})
    assert [r.source for r in exact.where(F.col("text") == texts[4]).collect()] == ["s"]
    near = C.drop_near_copies(spark, exact, "")
    assert near.count() == exact.count() - 1 and near.columns == docs.columns  # one text ends in " end"
    mixed = C.mix(spark, near, "")
    assert {r.text for r in mixed.collect()} == {r.text for r in near.collect() if r.text}
    assert {r.doc_id for r in mixed.collect()} == {None, 7}


CLASHING = ("_slot", "_maybe", "_again", "_copy", "_copies", "row", "key", "maybe", "copies", "count", "a.b", "offset", "score", "_text")


def test_pipeline_stages_with_clashing_columns_nulls_and_nothing(spark):
    import corpus_pipeline as C

    stages = [C.drop_copies, C.drop_near_copies, C.mix]
    texts = [sentence(600 + i, 40) for i in range(6)]
    rows = [(1, texts[0]), (2, texts[0]), (2, texts[1]), (None, texts[2]), (None, texts[3]), (3, None), (4, ""), (4, ""), (5, texts[4] * 200), (6, texts[5]), (7, texts[5] + " end")]
    plain = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    wide = plain.select("*", *[F.lit(7).alias(c) for c in CLASHING])
    expected = [None, None, None]
    for docs in (plain, wide, wide.limit(0)):
        for k, stage in enumerate(stages):
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            got = sorted(str((r[0], r[1])) for r in out.collect())
            if docs.columns == wide.columns:
                assert out.where(" and ".join(f"`{c}` = 7" for c in CLASHING)).count() == len(got)
            if docs is not plain and docs is not wide:
                assert not got
            else:
                expected[k] = expected[k] or got
                assert got == expected[k]
    assert len(expected[0]) == 8 and len(expected[1]) == 9 and not any("None)" in x for x in expected[2])
    assert sum("(6, " in x or "(7, " in x for x in expected[1]) == 1  # one of two near copies


def test_pipeline_drops_toxic_documents_and_keeps_all_columns(spark, folder):
    import corpus_pipeline as C

    bad = " worthless idiot scum loser filth vermin "
    rows = [(i, sentence(i, 60) + (bad * 3 if i % 3 == 0 else " fine day outside")) for i in range(1, 240)] + [(None, None), (None, ""), (1000, sentence(5, 5000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(7).alias(c) for c in CLASHING])
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 240)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = C.drop_toxic(spark, docs, folder)
    assert out.columns == docs.columns
    got = [r.doc_id for r in out.collect()]
    clean = [i for i, _ in rows if i is None or i % 3]
    assert sum(i is not None and i < 240 and i % 3 == 0 for i in got) <= 8 and len(got) >= len(clean) - 8 and got.count(None) == 2
    assert C.drop_toxic(spark, docs.limit(0), folder).count() == 0


def test_warc_keeps_every_payload_of_a_shared_id(spark):
    df = spark.createDataFrame([(3, "u", "A"), (5, "u", "A"), (5, "u", "B")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(df)).collect())
    a, b = warc.sha1_base32(b"A"), warc.sha1_base32(b"B")
    assert got == sorted([(3, a, "response", None), (5, a, "revisit", 3), (5, b, "response", None)])
