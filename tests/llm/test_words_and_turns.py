"""Spelling variants, conversation repair and byte-level BPE against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, conversations, queries, spelling

SCHEMA = "doc_id long, text string, word string, n int, ids string, key string"


def made_documents(seed):
    """Words of few letters, so that many are near; nulls, blanks, odd letters, repeated rows and long runs."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abAé") for _ in range(r.randrange(3, 9)))
    texts = [" ".join(word() for _ in range(r.randrange(400))) for _ in range(30)]
    texts += [None, "", " \t", "×÷ abcde_abcde9abcde", "ÀÉÎõü-ÀÉÎõü ÀÉÎõü", "ſtraße İstanbul 漢字漢字漢字", *["x" * 3000 + " " + "x" * 2999] * 4, texts[0], texts[0]]
    return [(i if i % 11 else None, t, "w", 1, "i", "k") for i, t in enumerate(texts)] + [(5, texts[5], "w", 1, "i", "k")] * 3


def variants(rows):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    cut = {w: [w[:k] + w[k + 1 :] for k in range(len(w))] for w in words}
    same, shorter, near = defaultdict(set), defaultdict(set), defaultdict(set)
    for w, rest in cut.items():
        for k, x in enumerate(rest):
            same[k, x].add(w)
            shorter[x].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for x in shorter[w]:
            near[w].add(x)
            near[x].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.mark.parametrize("most", [4096, 6])
def test_spelling_variants_against_all_pairs(spark, most):
    rows = made_documents(1)
    got = [tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA), most=most).collect()]
    want = variants([r[:2] for r in rows])
    assert len(got) == len(set(got)) and set(got) == want
    assert any(f and r != f for _, f, r, *_ in want)  # chains of forms are there


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spelling_broadcasts_no_table_of_words(spark, monkeypatch):
    plans, written = [], spelling.materialize
    plan = lambda df: str(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(spelling, "materialize", lambda df: plans.append(plan(df)) or written(df))
    plans.append(plan(spelling.spelling_variants(spark.createDataFrame(made_documents(1), SCHEMA), most=6)))
    assert sum(p.count("SortMergeJoin") for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_stretches_cut_no_run(monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 5)
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("ab é-9") for _ in range(r.randrange(40)))
        parts = list(spelling.stretches(text))
        assert "".join(parts) == text and [w for p in parts for w in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


def damaged(conv, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
    return [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)


def repaired(rows):
    """The report of one conversation's rows by trying every edit, from the end, with audits as strings."""
    white, seen, faults = " \t\n\x0b\x0c\r", set(), []
    for _, role, text in rows:
        body = text.strip(white)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    follow, name = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def with_inserts(best):
        for _ in range(3):
            for state, new in follow.items():
                cost, audit, out = best[new]
                best[state] = min(best[state], (cost + 2, "I" + audit, ((name[new], ""), *out)))
        return best

    far = (10**9, "", ())
    best = with_inserts({"": (0, "", ()), "s": far, "u": far, "a": (0, "", ())})
    for (_, role, text), fault in zip(reversed(rows), reversed(faults), strict=True):
        now = {}
        for state, new in follow.items():
            tries, more = [(best[state][0] + 3, "D" + best[state][1], best[state][2])], fault == "truncated"
            if fault not in ("blank", "duplicate"):
                cost, audit, out = best[new]
                tries.append((cost + 2 + more, "R" + audit, ((name[new], text), *out)))
                if (state, role[:1]) in legal:
                    cost, audit, out = best[role[:1]]
                    tries.append((cost + more, "K" + audit, ((role, text), *out)))
            now[state] = min(tries)
        best = with_inserts(now)
    cost, audit, out = best[""]
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def made_conversations(seed, long):
    r, rows = random.Random(seed), []
    for conv in range(120):
        n = long if conv == 5 else r.choice([1, 2, 3, 5, 8, 30])
        for i in range(n):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "usher", None, ""])
            rows.append((conv if conv != 7 else None, r.choice([None, i, i, i, r.randrange(n)]), role, r.choice(["Hi.", "Hi", "yes!", None, "", " \t", "no? ", "a", "b.", "c.\n", "é 漢?"]), "x"))
    return rows + rows[:3]


@pytest.mark.parametrize("seed, bits, long", [(1, 12, 300), (2, 2, 90)])
def test_repairs_against_every_edit(spark, folder, monkeypatch, seed, bits, long):
    monkeypatch.setattr(conversations, "SEGMENT_BITS", bits)
    rows = made_conversations(seed, long)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string").write.parquet(f"{folder}/conversations.parquet")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = queries.op12_conversations(spark, folder).collect()
    got = {r.conv_id: tuple(r[c] for c in names) for r in found}
    by = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        by[conv] += damaged(conv, turn, role, text)
    assert len(found) == len(got) and set(got) == set(by)
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        assert got[conv] == repaired(own), conv


def test_many_equal_rows_are_counted_not_walked(spark):
    rows = [(1, 0, "user", "Hi.")] * 5000 + [(1, 1, "assistant", "Yes.")] + [(2, None, None, None)] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in conversations.repair_conversations(df).collect()}
    assert got[1].audit == "K" + "D" * 4999 + "K" and got[1].cost == 3 * 4999 and got[1].duplicate == 4999 and got[1].illegal == 4999
    assert got[2].audit == "DDD" and got[2].blank == 3 and got[2].gaps == 0 and got[2].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert conversations.repair_conversations(df.limit(0)).count() == 0


def test_maps_and_costs_of_segments_combine(spark):
    r = np.random.default_rng(1)
    maps, costs = r.integers(0, 4, (20, 2, 4)), r.integers(0, 9, (20, 2, 16))
    packed = [[int(sum(int(x) << 8 * e for e, x in enumerate(m))) for m in pair] for pair in maps]
    df = spark.createDataFrame([(*p, *map(lambda x: x.tolist(), c)) for p, c in zip(packed, costs, strict=True)], "f int, g int, a array<long>, b array<long>")
    rows = df.select(conversations._composed("f", "g").alias("fg"), conversations._least_sums("a", "b").alias("ab")).collect()
    for row, (f, g), (a, b) in zip(rows, maps, costs, strict=True):
        assert [row.fg >> 8 * e & 255 for e in range(4)] == list(g[f])
        assert row.ab == (a.reshape(4, 4, 1) + b.reshape(1, 4, 4)).min(1).ravel().tolist()


@pytest.mark.parametrize("most", [1 << 19, 40])
def test_byte_bpe_equals_its_library(spark, most):
    """Also where few words are encoded beforehand and the rest is folded in place."""
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path(queries.RANKS))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    letters = "abcXYZ éßİſ漢字кириلعǅ²½٣ '’-=.,_\t\n\r\x0b\x1c\x85\xa0    　😀👍🏽́\x00"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(150)]
    texts += [None, "", " ", "   x", "it's we'LL 'd x'", "<|endoftext|>", "a" * 700, "=" * 400, " " * 300 + "\n" * 300, "one two\n\n three  four", "x " * 40000, "bababababcabacab" * 20]
    rows = [(i, t, "w", 1, "clash", "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[3]], SCHEMA)
    encoded = byte_bpe.encode_documents(docs, ranks, P.PATTERN, most=most)
    got = byte_bpe.decode_documents(encoded, ranks).collect()
    assert len(got) == len(rows) + 1
    for row in got:
        assert row.ids == library.encode_ordinary(row.text or ""), row.text
        assert bytes(row.decoded) == (row.text or "").encode()
    assert byte_bpe.encode_documents(docs.limit(0), ranks, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode_documents(docs, {b"a": 0}, P.PATTERN)


def test_merges_are_those_of_lowest_rank(spark):
    """A small vocabulary in which pairs have several splits, against merging one pair after the other."""
    ranks = {bytes([b]): b for b in range(256)} | {w: 256 + k for k, w in enumerate([b"ab", b"bc", b"aa", b"abc", b"ca", b"aaa", b"bca", b"cab", b"abca"])}

    def merged(word):
        pieces = [bytes([b]) for b in word]
        while True:
            pairs = [(ranks.get(a + b, 999), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False))]
            if not pairs or min(pairs)[0] == 999 or word in ranks:
                return [ranks[word]] if word in ranks else [ranks[p] for p in pieces]
            i = min(pairs)[1]
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]

    r = random.Random(6)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 14))) for _ in range(300)]
    docs = spark.createDataFrame([(w,) for w in words], "text string")
    for row in byte_bpe.encode_documents(docs, ranks, r"\S+", most=30).collect():
        assert row.ids == merged(row.text.encode()), row.text
    assert docs.select(F.count("*")).first()[0] == 300


def test_low_texts_are_split_as_all_are():
    """The spelled-out classes against those of Unicode, on every code point that they are for."""
    import public_tokenizers as P
    import regex

    low, every = re.compile(byte_bpe.low_pattern(P.PATTERN)).findall, regex.compile(P.PATTERN).findall
    r = random.Random(2)
    signs = [chr(c) for c in range(0x180)]
    texts = ["".join(r.choices(signs if r.random() < 0.5 else "aZ9é²½\x1c\x85\xa0 \t\n'.-", k=40)) for _ in range(2000)]
    for text in [*texts, *[f"a{c} {c}{c} 1{c}\n" for c in signs]]:
        assert low(text) == every(text), ascii(text)
    assert byte_bpe.low_pattern(r"\w+") is None and byte_bpe.low_pattern(r"\p{Lu}+|\S") is None


def test_letters_of_later_unicode_versions_are_letters(spark):
    """Letters that came after version 13, which Java 17 takes for other signs, in words and beside signs."""
    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.read_ranks(P.path(queries.RANKS))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["a\U00010570b \U00010570.", "x\U0001df25-\u0870 \u1c89"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for row in byte_bpe.encode_documents(docs, ranks, P.PATTERN, most=1).collect():
        assert row.ids == library.encode_ordinary(row.text), ascii(row.text)


def test_ids_are_decoded_by_batches(spark, monkeypatch):
    """Rows cut into small slices; null stays null, ids that no token has give nothing. Ids went through an interpreted lambda one by one."""
    monkeypatch.setattr(byte_bpe, "MOST_IDS", 4)
    ranks = {bytes([b]): b for b in range(9)} | {b"long": 9}
    ids = spark.createDataFrame([(0, [9, 0, 9]), (1, None), (2, []), (3, [-5, 1, None, 99, 10, 2]), (4, [9] * 7)], "id int, ids array<int>").coalesce(1)
    decoded = byte_bpe.decode_documents(ids, ranks)
    assert "MapInArrow" in decoded._jdf.queryExecution().optimizedPlan().toString()
    got = [r.decoded if r.decoded is None else bytes(r.decoded) for r in decoded.orderBy("id").collect()]
    assert got == [b"long\0long", None, b"", b"\1\2", b"long" * 7] and byte_bpe.decode_documents(ids.limit(0), ranks).count() == 0
