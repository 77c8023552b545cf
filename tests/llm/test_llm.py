"""Operators against brute force and exact round trips, on small rows with nulls, blanks, ties and repeats."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimweave.llm import ann, bpe, decontaminate, langid, ngram_lm, quality, queries, sharding, simhash, token_store, warc
from claimweave.llm.wordmemo import PieceEncoder, encode_spaced, encode_words

BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["foo,", "bar.\nBaz", "the", "ab", "'s", "''", "'ll", " ", "  ", "\n", "\t", "é", "é", "😀", "1", "23", "...", "!?", "<|endoftext|>", "<|end", "oftext|>", "x" * 7, "ẛ̣", "\x1c", "\x85", "中", "ing", "İ", " \n", "　"]


def texts(n, size, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts(60, 40))] + [(None, None), (70, ""), (71, None), (5, "again the"), (5, "again the"), (80, "ing the ab " * 3000)]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)


def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_piecewise_encoding_is_exact():
    a, b = PieceEncoder(bpe.load_spec(BYTES)), PieceEncoder(bpe.load_spec(WORDS))
    many = texts(1500, 60)
    assert encode_spaced(a, many, "<|endoftext|>") == [a.whole(t) for t in many]
    assert encode_words(b, many) == [b.whole(t) for t in many]


def test_tree_is_exact():
    enc = PieceEncoder(bpe.load_spec(WORDS))
    for k, t in enumerate([*texts(60, 2000, 7), "ab" * 5000, "'" * 999, "İ" * 700]):
        assert bpe.encode_long(enc, t, (50, 200, 700)[k % 3]).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_bpe(spark, docs):
    t = Tokenizer.from_file(WORDS)
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in bpe.encode_decode(docs, bpe.load_spec(WORDS), leaf_chars=1000).collect())
    want = Counter()
    for i, x in plain(docs):
        ids = t.encode(x, add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)] += 1
    assert got == want
    assert bpe.encode_decode(docs.limit(0), bpe.load_spec(WORDS)).count() == 0


def test_token_store(spark, docs, tmp_path):
    t = Tokenizer.from_file(BYTES)
    token_store.write_store(docs, f"{tmp_path}/s", bpe.load_spec(BYTES))
    got = token_store.lookup(spark, f"{tmp_path}/s", docs).collect()
    want = Counter((i, np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, x in plain(docs))
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    order, at = sorted(got, key=lambda r: r.start), 0
    assert [r.doc_id is not None for r in order] == sorted(r.doc_id is not None for r in order)
    for r in order:
        assert r.start == at
        at += r.n_tokens
    some = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.start, r.n_tokens, bytes(r.ids)) for r in rows)
    assert some(token_store.get(spark, f"{tmp_path}/s", [5, None, 80, 999]).collect()) == some(r for r in got if r.doc_id in (5, None, 80))
    with pytest.raises(ValueError):
        token_store.get(spark, f"{tmp_path}/s", list(range(token_store.MANY + 1)))
    assert token_store.lookup(spark, f"{tmp_path}/s", spark.createDataFrame([(999,)], "doc_id long")).count() == 0
    token_store.write_store(docs.limit(0), f"{tmp_path}/e", bpe.load_spec(BYTES))
    assert token_store.lookup(spark, f"{tmp_path}/e", docs).count() == 0


def test_perfect_hash():
    for n in (1, 2, 3, 50, 5000):
        keys = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
        assert sorted(token_store.mph_slots(keys, token_store.build_mph(keys), n)) == list(range(n))


def test_simhash(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(12)]
    rows = [(i, t + " x" * (i % 3)) for i, t in enumerate(base * 8)] + [(200, None), (201, ""), (202, "One two"), (203, "one TWO"), (None, "alone here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    f = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(f)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = [r[0] for r in rows]
    want = {(ids[i], f[i], min((ids[j] for j in range(len(f)) if find(j) == find(i) and ids[j] is not None), default=None)) for i in range(len(f))}
    for limit in (4096, 4):  # the second deals big buckets again
        assert {(r.doc_id, r.fp & simhash.ALL_BITS, r.component_id) for r in simhash.near_duplicates(df, bucket_rows=limit).collect()} == want
    assert simhash.one_of_each(df.union(df)).count() == len({w[2] for w in want})
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_of_each_keeps_what_is_not_similar(spark):
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    base, other, half = prose(400), prose(400), prose(200)
    near = [*base[:100], "changed", *base[101:]]  # five of 396 shingles
    shared = [*base[:200], *half]  # a third of the shingles in common
    rows = [(1, base), (2, near), (3, other), (4, shared), (5, base), (6, ["one", "two"]), (7, ["one", "three"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(8, None), (9, ""), (None, " ".join(base))], "doc_id long, text string")
    for limit in (4096, 2):
        assert sorted(r.doc_id for r in simhash.one_of_each(df, bucket_rows=limit).collect()) == [1, 3, 4, 6, 7, 8]
    assert simhash.one_of_each(df.limit(0)).count() == 0


def _edited(rng: random.Random, kind: str, j: float, n: int = 300) -> tuple[str, str]:
    """Two texts whose five-word shingles have a Jaccard value of j or a little more, by one kind of edit."""
    words = lambda k: [f"w{rng.randint(0, 100_000)}" for _ in range(k)]
    base, shingles = words(n), n - 4
    if kind == "cut":
        other = base[: n - int(shingles * (1 - j))]
    elif kind == "append":
        other = base + words(int(shingles * (1 / j - 1)))
    else:
        lost = int(shingles * (1 - 2 * j / (1 + j)))
        other = list(base)
        places = range(100, 100 + lost - 4) if kind == "block" else range(10, 10 + 6 * (lost // 5), 6)
        for i in places:
            other[i] = words(1)[0]
    return " ".join(base), " ".join(other)


def test_one_of_each_finds_similar_texts_of_any_edit(spark):
    rng = random.Random(5)
    pairs = [_edited(rng, kind, j) for kind in ("cut", "append", "block", "scattered") for j in (0.80, 0.82, 0.84, 0.86, 0.88, 0.90) for _ in range(3)]
    apart = [_edited(rng, kind, 0.76) for kind in ("cut", "append", "block") for _ in range(4)]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    value = lambda p: jaccard(*({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in p))
    assert all(0.8 <= value(p) < 0.93 for p in pairs) and all(0.7 < value(p) < 0.8 for p in apart)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(t for p in pairs + apart for t in p)], "doc_id long, text string")
    want = [2 * i for i in range(len(pairs))] + list(range(2 * len(pairs), 2 * len(pairs + apart)))
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == want


def test_one_print_with_many_wide_prints(spark):
    """Buckets that no bit can split are compared chunk against chunk."""
    rng = np.random.default_rng(3)
    wide = [bytes(32), bytes([1]) + bytes(31), *[rng.bytes(32) for _ in range(20)]]
    df = spark.createDataFrame([(7, w) for w in wide], "fp long, wide binary")
    got = {tuple(sorted((bytes(r.a)[:32], bytes(r.b)[:32]))) for r in simhash.links(df, 2, 8, 38).collect()}
    assert got == {(wide[0], wide[1])}


def test_decontaminate(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "say: " + item.upper() + "!"), (2, item.replace("six", "6")), (3, item.replace("eleven", "x")), (4, None), (5, ""), (6, "tiny thing"), (6, "tiny thing")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "Tiny thing"), (9, None), (None, "!")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contained_items(docs, bench).collect())
    assert got == [(1, 7, 7, 7), (3, 7, 7, 6), (6, 8, 1, 1), (6, 8, 1, 1)]
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0


def test_segments_hold_every_shingle(monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 50)
    text = b" ".join(b"w%d" % i for i in range(200))
    whole = decontaminate.shingles_of(text.split())
    assert set().union(*(decontaminate.shingles_of(decontaminate._WORDS.findall(s)) for s in decontaminate.segments(text))) == whole


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).round(1)
    v[50:80] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [1.0, None] + [0.0] * 6), (305, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = set()
    for q in range(0, 300, 20):
        s = (v * v[q]).sum(axis=1)
        want |= {(q, k + 1, int(j)) for k, j in enumerate([j for j in np.lexsort([np.arange(300), -s]) if j != q][:20])}
    from pyspark.sql import functions as F

    got = ann.nearest(df, F.col("id") % 20 == 0, block=16)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got.collect()} == want


def test_language(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !!", "de")] * 5
    f = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, "the dog", 0), (2, "die Katze", 0), (3, None, 0), (4, "12", 0), (5, "中文", 0)], "doc_id long, text string, score long")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, f).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("en", "de", "und", "und")
    empty = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(40)) + "." for _ in range(60)]
    bad = ["BUY!! " * rng.randint(20, 50) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, None if i % 7 else len(t)) for i, t in enumerate(good + bad)] + [(900, None, None), (901, "", 0)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(3, None)], "doc_id long, quality int")
    got = {r.doc_id: (r.predicted, r.score) for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(got) == 122 and all(0 <= s <= 1 for _, s in got.values())
    assert sum(got[i][0] == (i < 60) for i in range(120)) > 115
    assert quality.score(docs, quality.train(docs, labels.limit(0))).where("score <> 1").count() == 0


def test_pair_identity():
    m = quality.Machine(3)
    hashed, stats = quality.features("some words of a text", 10)
    at, x = m._row(hashed, stats)
    pairs = sum(float(m.v[a] @ m.v[b]) * x[i] * x[j] for i, a in enumerate(at) for j, b in enumerate(at) if i < j)
    assert abs(m.score(hashed, stats) - 1 / (1 + np.exp(-pairs))) < 1e-5


def lm_by_hand(rows, size, part):
    """score and counts of each (text, learn) row by dictionaries of counts."""
    words = lambda t: (t or "").lower().split()
    counts = Counter(w for t, y in rows if y for w in words(t))
    n_docs, top = sum(y for _, y in rows), [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))]
    grade = {w: int(np.floor(np.log2(n) * 8)) for w, n in counts.items()}
    top = [w for w in top if sum(g >= grade[w] for g in grade.values()) <= size]
    number = {w: k + 3 for k, w in enumerate(top)}
    rare = sum(n for w, n in counts.items() if w not in number)
    v = ngram_lm.Vocabulary([w.encode() for w in top], [counts[w] for w in top], n_docs, rare, len(counts) - len(top))
    total = sum(counts.values()) + n_docs
    one = {k: (c + (k == ngram_lm.RARE)) / (total + 1) for k, c in enumerate(v.counts.tolist())}
    grams = lambda t: (lambda s: [(1 if k == 1 else s[k - 2], s[k - 1], s[k]) for k in range(1, len(s))])([0, *(number.get(w, 2) for w in words(t)), 1])
    ctx = lambda u, x: int(v.contexts(np.array([x]), np.array([u]))[0])
    c2, c3 = Counter(), Counter()
    for t, y in rows:
        for u, x, w in grams(t) if y else []:
            c2[ctx(u, x), w] += 1
            c3[(ctx(u, x), u), w] += 1

    def under(table):
        sums, kinds = Counter(), Counter()
        for (c, _), n in table.items():
            sums[c] += n
            kinds[c] += 1
        return lambda c, w, low: low if not sums[c] else (max(0, table[c, w] - 0.75) + 0.75 * kinds[c] * low) / sums[c]

    second, third = under(c2), under(c3)
    prob = lambda u, x, w: third((ctx(u, x), u), w, second(ctx(u, x), w, one[w]))
    k_rare = len(counts) - len(top)
    own = lambda w: (counts[w] - 0.75) / (rare + 0.75) if counts[w] else 0.75 * (k_rare + 1) / ((rare + 0.75) * max(1, k_rare))
    score = lambda t: sum(np.log10(prob(*g)) for g in grams(t)) + sum(np.log10(own(w)) for w in words(t) if w not in number)
    return score, prob, counts, n_docs, list(one)


@pytest.mark.parametrize(("size", "part"), [(1000, 1 << 20), (5, 1 << 20), (5, 40)])
def test_lm(spark, monkeypatch, size, part):
    """Rare words, split contexts, null ids, repeated rows and copies, a clashing column, an empty table."""
    monkeypatch.setattr(ngram_lm, "PART_TOKENS", part)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("aaabbcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "New a b words"), (None, "a b c"), (61, "New a b words"), (1, "other text"), (62, ""), (63, "a b " * 500)]
    rows += [(70 + i, "a b c d copy") for i in range(9)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double").withColumn("learn", F.col("doc_id") % 3 != 0)
    by_hand, _, c, n_docs, _ = lm_by_hand([(t, i is not None and i % 3 != 0) for i, t in rows], size, part)
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 1)) for r in ngram_lm.score_all(df, "learn", size=size).collect())
    n, v = sum(c.values()) + n_docs, len(c) + 1
    exact = Counter()
    for i, t in rows:
        words = (t or "").lower().split()
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words) + np.log10((n_docs + 1) / (n + v + 1))
        exact[i, len(words) + 1, sum(w in c for w in words) + 1, n, round(base, 5)] += 1
    assert Counter({k[:5]: sum(m for x, m in got.items() if x[:5] == k[:5]) for k in got}) == exact
    want = sorted((i is None, i or 0, t or "", by_hand(t)) for i, t in rows)
    mine = sorted(((r.doc_id is None, r.doc_id or 0, r.score) for r in ngram_lm.score_all(df, "learn", size=size).collect()))
    for a, b in zip(sorted((x[0], x[1], x[3]) for x in want), mine, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 2e-3 * max(10, -a[2])
    assert ngram_lm.score_all(df.limit(0), "learn").count() == 0


def test_lm_counts_ngrams_of_all_words(spark):
    """More words of one count than the vocabulary takes: their pairs and triples count all the same."""
    text = " ".join(f"w{i}" for i in range(140_000))
    df = spark.createDataFrame([(1, text, True), (2, "w5 w6 w7 w8", False), (3, "w8 w5 w7 w6", False)], "doc_id long, text string, learn boolean")
    got = {r.doc_id: r for r in ngram_lm.score_all(df, "learn").collect()}
    assert got[2].score > got[3].score + 5 and got[1].n_tokens == got[1].n_known == 140_001 and np.isclose(got[2].base_score, got[3].base_score)


@pytest.mark.parametrize(("top", "bucket"), [(4, 2), (0, 100), (100, 100)])
def test_lm_numbers_rarer_words(spark, monkeypatch, top, bucket):
    """Whatever is broadcast, as by dictionaries of counts; unseen words, copies, null ids."""
    monkeypatch.setattr(ngram_lm, "VOCABULARY", top)
    monkeypatch.setattr(ngram_lm, "BUCKET_WORDS", bucket)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("aaaabbbccdefghijklmnop") for _ in range(rng.randint(0, 12)))) for i in range(90)] + [(None, "new a b words a"), (91, "new b"), (91, "new b"), (92, None), (93, "new new")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("learn", F.col("doc_id") % 3 != 0).repartition(3)
    words = lambda t: (t or "").split()
    texts = [t for i, t in rows if i is not None and i % 3]
    counts, n_docs = Counter(w for t in texts for w in words(t)), len(texts)
    grade = {w: int(np.floor(np.log2(n) * 8)) for w, n in counts.items()}
    common = {w for w in counts if sum(g >= grade[w] for g in grade.values()) <= top}
    rare, kinds, total = sum(n for w, n in counts.items() if w not in common), len(counts) - len(common), sum(counts.values()) + n_docs
    of_class = lambda n: (n - 0.75 if n else 0.75 * (kinds + 1) / max(1, kinds)) / (rare + 0.75)
    one = lambda w: n_docs / (total + 1) if w == 1 else counts[w] / (total + 1) if w in common else (rare + 1) / (total + 1) * of_class(counts[w])
    grams = lambda t: (lambda s: [(1 if k == 1 else s[k - 2], s[k - 1], s[k]) for k in range(1, len(s))])([0, *words(t), 1])
    c2, c3 = Counter((v, w) for t in texts for _, v, w in grams(t)), Counter(((u, v), w) for t in texts for u, v, w in grams(t))

    def under(table):
        sums, of = Counter(), Counter()
        for (c, _), n in table.items():
            sums[c] += n
            of[c] += 1
        return lambda c, w, low: low if not sums[c] else (max(0, table[c, w] - 0.75) + 0.75 * of[c] * low) / sums[c]

    second, third = under(c2), under(c3)
    by_hand = lambda t: sum(np.log10(third((u, v), w, second(v, w, one(w)))) for u, v, w in grams(t))
    base = lambda t: sum(np.log10((n + 1) / (total + len(counts) + 2)) for n in (n_docs, *(counts[w] for w in words(t))))
    want = sorted((i is None, i or 0, len(words(t)) + 1, 1 + sum(w in counts for w in words(t)), base(t), by_hand(t)) for i, t in rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score) for r in ngram_lm.score_all(df, "learn").collect())
    for a, b in zip(want, got, strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 and abs(a[5] - b[5]) < 2e-3 * max(10, -a[5])


def test_lm_without_training_text(spark):
    df = spark.createDataFrame([(1, "a b", False), (2, None, None)], "doc_id long, text string, learn boolean")
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in ngram_lm.score_all(df, "learn").collect()) == [(1, 3, 0, 0), (2, 1, 0, 0)]


def test_lm_query_keeps_ngrams_seen_once(spark, tmp_path):
    """A large corpus does not raise the count that an n-gram needs."""
    learnt = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(learnt[0], "often " * 2_500_000), (learnt[1], "one two three four"), (held, "one two three four"), (held, "three one four two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, mixed = sorted((r.score for r in queries.op8_lm_score(spark, str(tmp_path)).collect() if r.doc_id == held), reverse=True)
    assert seen > mixed + 5


def test_lm_sums_to_one():
    rows = [("a b c a b d", True), ("b c a", True), ("a", True), ("e f", True)]
    _, prob, _, _, names = lm_by_hand(rows, 4, 1 << 20)
    for u, v in ((1, 0), (0, 3), (3, 4), (4, 3), (2, 2)):
        assert abs(sum(prob(u, v, w) for w in names if w) - 1) < 1e-9


def test_sequence():
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 5), (200, 300), (500, 10**9), (3000, 4000), (2000, 10**6), (100, 2**49), (200_000, 10**7)):
        v = np.unique(rng.integers(0, top, n))
        s = ngram_lm.Sequence.of(v)
        assert (s.get(np.arange(len(v))) == v).all()
        assert s.low.nbytes + s.unary.nbytes <= len(v) * (s.low_bits + 3) / 8 + 32  # low bits take their own width, no more
        if len(v):
            assert (s.find(v, np.zeros(len(v), dtype=int), np.full(len(v), len(v))) == np.arange(len(v))).all()
            assert (s.find(np.setdiff1d(np.arange(min(top, 400)), v), np.zeros(1, dtype=int), np.full(1, len(v))) == -1).all()


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(i, "ab" * rng.randint(0, 30) if i % 3 else "hot text") for i in range(400)] + [(1, None), (None, ""), (7, "dup"), (7, "dup")]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    sizes = Counter()
    for _, t in rows:
        sizes[t or ""] += len(t or "") + 16
    loads = [0] * 5
    for s in sorted(sizes.values(), reverse=True):  # the schedule, one group at a time
        loads[loads.index(min(loads))] += s
    assert sorted(Counter({k: sum(r.size for r in got if r.shard == k) for k in range(5)}).values()) == sorted(loads)
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in range(5))
    assert {r.text_crc32 for r in got} == {zlib.crc32((t or "").encode()) for _, t in rows}
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"hot text")}) == 1
    assert sharding.shard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deal_in_bulk():
    one, bulk = [(k * 3, k) for k in range(7)], [(k * 3, k) for k in range(7)]
    parts = [0] * 7
    for _ in range(500):
        parts = [a + b for a, b in zip(parts, sharding.deal(one, 11, 1), strict=True)]
    assert sharding.deal(bulk, 11, 500) == parts and sorted(one) == sorted(bulk)


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>\r\n\r\né{i}</p>" * (i % 5)) for i in range(50)] + [(None, None, None), (3, "http://x/3", "<p>\r\n\r\né3</p>" * 3)], "page_id long, url string, html string")
    recs = warc.records(pages)
    manifest = warc.layout(warc.leaves(recs), 2000)
    assert warc.audit(manifest, warc.leaves(recs), 2000).count() == 0
    warc.write_archives(recs, manifest, f"{tmp_path}/w")
    read = warc.read_archives(spark, f"{tmp_path}/w")
    key = lambda rows: sorted((r.archive, r.offset, r.length, r["h"]) for r in rows)
    assert key(read.selectExpr("archive", "offset", "length", "sha2(record, 256) h").collect()) == key(manifest.selectExpr("archive", "offset", "length", "hash h").collect())
    bad = pages.where("page_id <> 9 OR page_id IS NULL").selectExpr("page_id", "url", "CASE WHEN page_id = 12 THEN 'x' ELSE html END AS html").union(spark.createDataFrame([(99, "u", "h")], pages.schema))
    got = {(r.page_id, r.kind) for r in warc.audit(manifest, warc.leaves(warc.records(bad)), 2000).collect()}
    assert got == {(9, "lost"), (12, "altered"), (99, "extra")}


def test_digests():
    assert hashlib.sha256(np.array([], "<u4").tobytes()).hexdigest().startswith("e3b0c442")


def test_dense_contexts_number_the_contexts_in_order():
    words = ngram_lm.Vocabulary([b"a", b"b", b"c"], [3 * ngram_lm.PART_TOKENS, 2 * ngram_lm.PART_TOKENS, 5], 10, 7, 4)
    v, u = np.repeat(np.arange(6), 50), np.tile(np.arange(50), 6) % 6
    names, at = np.unique(words.contexts(v, u), return_inverse=True)
    dense, same = np.unique(words.dense(v, u), return_inverse=True)
    assert (at == same).all() and len(names) == len(dense) and 0 <= dense[0] and dense[-1] < words.classes.sum()
    values = np.sort(np.random.default_rng(2).integers(0, 1 << 22, 5000))
    sequence = ngram_lm.Sequence.of(values)
    assert (sequence.get(np.arange(5000)) == values).all()
    assert (values[sequence.find(values, np.zeros(5000, dtype=np.int64), np.full(5000, 5000))] == values).all()
