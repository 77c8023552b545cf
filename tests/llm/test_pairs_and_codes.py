"""Spelling variants, MinHash classes and vector codes against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from claimweave.llm import minhash, orchard, queries, spelling

DATA = "/root/testdata/sf0.001"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# ---- spelling variants ----


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelt_by_hand(rows):
    counts = Counter()
    for i, text in rows:
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] else None for w in words}
    form = {w: f if f is not None and words[f] >= 10 * words[w] else None for w, f in form.items()}
    root = {}
    for w in words:
        root[w] = w
        while form[root[w]] is not None:
            root[w] = form[root[w]]
    return {(w, form[w], root[w], n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_spelling_variants(spark):
    rng = random.Random(4)
    base = ["spelling", "straßenbahn", "variants", "rélation", "xxxxxxx", "xxxxxxxx", "ÀÖøÿabcd", "abcdefg", "abcdefgh"]
    typo = lambda w: rng.choice([w[:3] + w[4:], w[:3] + "q" + w[3:], w[:3] + "z" + w[4:], "y" + w, w + "y", w[1:], w[:-1]])
    rows = [(i, " ".join(w if rng.random() < 0.7 else typo(w).upper() if rng.random() < 0.3 else typo(w) for w in rng.choices(base, k=40))) for i in range(80)]
    # A chain of forms, with a tie between two near words of equal number.
    rows += [(110, "chainlnk " * 2 + "chainlink " * 25 + "chainlinks " * 400), (111, "tiewordab " * 30 + "tiewordaa " * 30 + "tiewordac tiewordac")]
    rows += [(None, "nullword nullword"), (102, None), (103, ""), (104, "z" * 50_000 + " " + "z" * 50_000), (104, "spelling"), (104, "spelling"), (105, "word×word÷word")]
    docs = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], "doc_id long, text string, word string, n int, run int").repartition(3)
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(docs).collect()]
    want = spelt_by_hand(rows)
    assert len(got) == len(want) and set(got) == want
    chain = {r[0]: r[1:3] for r in got}
    assert chain["chainlnk"][1] == "chainlinks" and chain["tiewordac"][0] == "tiewordaa"
    assert spelling.variants(docs.limit(0)).count() == 0


def test_every_single_edit_shares_a_key(spark):
    """A word and each of its near words meet, wherever the edit is."""
    words = ["abcdefg", "aaaaaaa", "abcabcabcabc", "mnopqrstuvwxyz"]
    some = set(words)
    for w in words:
        some |= {w[:i] + w[i + 1 :] for i in range(len(w)) if len(w) > 7} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "az"} | {w[:i] + "k" + w[i + 1 :] for i in range(len(w))}
    pairs = [(r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame([(w, 2) for w in sorted(some)], "word string, n long")).collect()]
    assert len(pairs) == len(set(pairs))
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in some for b in some if one_edit(a, b)}


# ---- MinHash classes ----


def classes_by_hand(rows, k=4, percent=80):
    sets = []
    for _, text in rows:
        words = lowered(text or "").encode().split()
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    found = {r: min((d for d in ids if d is not None), default=None) for r, ids in least.items()}
    return Counter((d, len(sets[i]), found[find(i)], d == found[find(i)]) for i, (d, _) in enumerate(rows))


def altered(rng, words, share):
    return " ".join(rng.choice("uvwxyz") + str(rng.randint(0, 999)) if rng.random() < share else w for w in words)


def test_minhash_classes(spark):
    rng = random.Random(9)
    rows, i = [], 0
    for size in (1, 2, 3, 30):
        for _ in range(6):
            words = [f"{rng.choice('abcdef')}{rng.randint(0, 500)}" for _ in range(rng.randint(5, 300))]
            for _ in range(size):
                rows.append((i, altered(rng, words, rng.choice([0, 0.005, 0.02, 0.05, 0.1]))))
                i += 1
    rows += [(i, "One two"), (i + 1, "one\ttwo"), (i + 2, "one two three four"), (i + 3, ""), (i + 4, None), (i + 5, " \n"), (i + 5, " \n"), (None, "One two"), (None, "alone of all"), (i, "One two"), (None, None)]
    rows += [(i + 6, "long text of words " * 60_000), (i + 7, "Long text of words " * 60_001)]
    docs = spark.createDataFrame([(d, t, "x", b"y") for d, t in rows], "doc_id long, text string, node string, signature binary").repartition(4)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == classes_by_hand(rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_cells(spark, monkeypatch):
    """Buckets of many chunks give the same classes: copies of one text that are close to it, not to each other."""
    monkeypatch.setattr(minhash, "CHUNK", 8)
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    rows = [(d, " ".join(words[:a] + [f"n{d}"] * 7 + words[a + 7 :])) for d, a in enumerate(rng.choices(range(190), k=60))] + [(99, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, percent=90).collect())
    assert got == classes_by_hand(rows, percent=90)


def test_posterior_bound():
    """Pairs at the threshold are ruled out with the chosen probability at most; unlike ones go in the first batch."""
    for miss in (1e-2, 1e-6):
        least = minhash.least_equal(0.8, miss)
        lost = sum(sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(bound)) for n, bound in zip(range(16, 97, 16), least, strict=True))
        assert lost <= miss and least == sorted(least) and least[0] > 0
    a = np.arange(minhash.HASHES, dtype=np.uint32)[None, :]
    assert minhash.plausible(a, a, least).tolist() == [True] and minhash.plausible(a, a + 1, least).tolist() == [False]


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    seen = minhash._WordHashes()
    a = [str(rng.randint(0, 10**9)) for _ in range(2000)]
    for share in (0.1, 0.3):
        b = a[: int(2000 * (1 - share))] + [str(rng.randint(0, 10**9)) for _ in range(int(2000 * share))]
        s, t = (minhash.shingle_set(" ".join(x).encode(), 4, seen) for x in (a, b))
        true = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
        assert abs((minhash.signature(s) == minhash.signature(t)).mean() - true) < 0.2


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(minhash, "SLICE", 10)
    text = b"some words and onelongwordwithoutanywhitespaceinit and more \xc3\xa9 words\x1cthat go on  "
    cut = minhash.word_hashes(text, minhash._WordHashes())
    monkeypatch.setattr(minhash, "SLICE", 1000)
    assert cut.tolist() == minhash.word_hashes(text, minhash._WordHashes()).tolist()


# ---- vector codes ----


def codes_by_hand(rows, longest):
    """(vec_id, code, error, label_error, digest) of rows (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-longest // 16))
    kept = [(i, v + [0] * (16 * width - len(v)), c) for i, v, c in kept]
    firsts = {}
    for i, v, _ in kept:
        firsts[i] = min(firsts.get(i, v), v)
    order = sorted(firsts, key=lambda i: (i is None, i))[:64]
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(firsts[i], p) for i in order] for p in range(16)]

    def nearest(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, b, strict=True)), e) for e, b in enumerate(book))

    for _ in range(2):
        for p, book in enumerate(books):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[nearest(part(v, p), book)[1]].append(part(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*held[e], strict=True)] if held[e] else b for e, b in enumerate(book)]
    coded = [(i, [nearest(part(v, p), books[p]) for p in range(16)], c) for i, v, c in kept]
    by_label = Counter()
    for _, found, c in coded:
        by_label[c] += sum(d for d, _ in found)
    digest = hashlib.sha256(",".join(str(x) for book in books for b in book for x in b).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), by_label[c], digest) for i, found, c in coded)


def found_codes(df):
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_vector_codes(spark):
    rng = random.Random(8)
    rows = [(i, [round(rng.gauss(0, 0.3), 2) for _ in range(32)], rng.choice([None, 0, 1, 2])) for i in range(200)]
    rows += [(200, None, 1), (201, [1.0] * 31 + [None], 1), (202, [float("nan")] * 32, 1), (203, [float("inf")] * 32, 2), (204, [0.0] * 32, None), (None, [0.25] * 32, 2)]
    rows += [(7, [0.5] * 32, 1), (7, [0.5] * 32, 1), (205, [0.5] * 5, 1), (206, [], 2), (207, [-0.001] * 32, 0)]
    table = spark.createDataFrame([(i, v, c, "x", 5) for i, v, c in rows], "vec_id long, embedding array<float>, label int, code string, v int").repartition(3)
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    assert found_codes(orchard.compress(table)) == codes_by_hand(floats, 32)
    assert orchard.compress(table.limit(0)).count() == 0


def test_few_vectors_of_odd_length(spark):
    rows = [(3, [1.0] * 33, 1), (1, [2.0] * 33, 1), (2, [2.0] * 33, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert found_codes(orchard.compress(table)) == codes_by_hand(rows, 33)
    one = spark.createDataFrame([(None, [], None)], "vec_id long, embedding array<double>, label int")
    assert [(r.code, r.error) for r in orchard.compress(one).collect()] == [("00" * 16, 0)]


def test_huge_components_count_as_the_bound(spark):
    rows = [(i, [1e300 * (i - 1)] * 16, 0) for i in range(3)]
    got = orchard.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.code[:2], r.error) for r in got} == {("00", 0), ("01", 0), ("02", 0)}


@pytest.mark.parametrize("ties", [False, True])
def test_orchard_is_exact_and_measures_less(ties):
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (64, 4))
    entries = np.repeat(centres[:8], 8, axis=0) if ties else centres
    parts = centres[rng.integers(0, 64, 3000)] + rng.integers(-60, 60, (3000, 4))
    search = orchard.Orchard(entries)
    best, least = search.nearest(parts)
    d = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (least == d.min(axis=1)).all() and (best == d.argmin(axis=1)).all()
    if not ties:
        assert search.measured < 0.7 * len(parts) * len(entries)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_minhash", "op13_orchard"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    rows = want.select(*order).fetchall()
    assert rows and Counter(tuple(r) for r in df.select(*order).collect()) == Counter(rows)
