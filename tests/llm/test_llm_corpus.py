"""Operators over a corpus: dedup, SimHash, mixing, LM scores, and the pipeline, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomread.llm import components, exact_dedup, lm_score, mixing, simhash, suffix_dedup
from loomread.llm.common import only_rows, with_row_key, without_rows

CLASH = ("key", "size", "bin", "taken", "score", "digest", "fp", "root", "a", "b", "batch", "kept")
ODD = [None, "", " ", "\n\t", "a", "a b", "a b", "é漢🙂 ü", "x " * 3000, "word", "Word", "WORD\x0bnext", None, ""]


def docs_of(spark, rows):
    """Rows (doc_id, text, source)."""
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


def corpus(seed, n=150):
    """Texts with exact copies, near copies and shared passages, and the odd ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(120))
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            t = rng.choice(texts)
        elif texts and kind < 0.4:
            w = rng.choice(texts).split(" ")
            w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        elif kind < 0.5:
            t = " ".join(rng.choice(words) for _ in range(rng.randrange(30))) + " " + passage[rng.randrange(40) :] + " " + rng.choice(words)
        else:
            t = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 400)))
        if rng.random() < 0.1:
            t = t.upper()
        texts.append(t)
        rows.append((i, t, rng.choice(["a", "b", "c", None, "ü"])))
    rows += [(n + k, t, "odd") for k, t in enumerate(ODD)]
    rows += [rows[3], rows[3], (None, rows[5][1], "a"), (None, "alone without id", None)]
    return rows


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    rows = corpus(request.param)
    return rows, docs_of(spark, rows)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---- rows


def test_row_filters(spark, case):
    rows, df = case
    keyed = with_row_key(df)
    marked = keyed.where("source = 'a'").select("__lr_f", "__lr_i")
    n = len(rows)
    assert only_rows(keyed, marked, n).where("source = 'a'").count() == marked.count()
    assert without_rows(keyed, marked, n).count() == n - marked.count()
    assert without_rows(keyed, marked.limit(0), 0).count() == n


# ---- exact dedup


def test_exact_dedup(case):
    rows, df = case
    groups: dict = {}
    for i, t, _ in rows:
        groups.setdefault(lower(t), []).append(i)
    got = exact_dedup.decide(df).collect()
    assert len(got) == len(rows)
    kept = Counter()
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[bytes(r.digest)]
        most = max((i for i in ids if i is not None), default=None)
        assert r.keep_id == most and r.group_size == len(ids)
        if r.kept:
            kept[bytes(r.digest)] += 1
            assert r.doc_id == most
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    rest = exact_dedup.drop_copies(df)
    assert rest.columns == df.columns and Counter(lower(r.text) for r in rest.collect()) == Counter(groups.keys())


def test_exact_index_over_batches(spark, case, tmp_path):
    _, df = case
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    first = df.where("coalesce(doc_id, 0) < 80")
    n = exact_dedup.drop_copies(first, index).count()
    again = exact_dedup.DigestIndex(spark, path, 4)
    assert again.rows().count() == n
    both = exact_dedup.drop_copies(df, again)
    assert n + both.count() == exact_dedup.drop_copies(df).count()
    assert exact_dedup.drop_copies(df, again).count() == 0
    plan = again.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # buckets are the partitions


def test_empty_tables(spark, case):
    _, df = case
    none = df.limit(0)
    assert exact_dedup.decide(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert simhash.cluster(none).count() == 0 and simhash.drop_near_copies(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert lm_score.scores(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0


# ---- SimHash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_components(fps, ids, apart=4):
    v = np.array(fps, np.uint64)
    roots = union(len(v), [(i, i + 1 + int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= apart)])
    least: dict = {}
    for r, i in zip(roots, ids, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in roots], roots


def test_simhash(case):
    rows, df = case
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    want, roots = brute_components(fps, [i for i, *_ in rows])
    got = simhash.cluster(df).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == Counter((i, f, c) for (i, *_), f, c in zip(rows, fps, want, strict=True))
    rest = simhash.drop_near_copies(df).collect()
    assert len(rest) == len(set(roots))
    assert {r.doc_id for r in rest if r.doc_id is not None} == {c for c in want if c is not None}


def clustered(rng, centres, each):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            f = c
            for _ in range(rng.randrange(6)):
                f ^= 1 << rng.randrange(64)
            out.append(f)
    return out


@pytest.mark.parametrize(("split", "centres", "each"), [(50_000, 60, 6), (15, 3, 90), (50_000, 2, 200)])
def test_links_connect_all(spark, split, centres, each):
    fps = sorted(set(clustered(random.Random(each), centres, each)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(3)
    links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(df, 4, split).collect()]
    assert all((a ^ b).bit_count() <= 4 and a != b for a, b in links)
    at = {f: i for i, f in enumerate(fps)}
    _, want = brute_components(fps, fps)
    assert union(len(fps), [(at[a], at[b]) for a, b in links]) == want
    roots = {r.node: r.root for r in components.components(simhash.links(df, 4, split)).collect()}
    assert len({roots.get(f - (1 << 64) if f >> 63 else f, f - (1 << 64) if f >> 63 else f) for f in fps}) == len(set(want))


@pytest.mark.parametrize("more", [2, 4, 6])
def test_masks_find_each_near_pair(more):
    rng = random.Random(more)
    masks = [m & (1 << 64) - 1 for m in simhash.masks(4, more)]
    unary = lambda x: int(simhash._unary(np.array([x], np.uint64))[0])
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), 4):
            b ^= 1 << k
        assert (unary(a) ^ unary(b)).bit_count() <= 4
        assert any((unary(a) ^ unary(b)) & m == 0 for m in masks)


def test_components(spark):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(200)]
    edges = [*chain, *((rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(150)), (7, 7), (1, 0), (900, 901), (-5, 900)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    shift = 10
    roots = union(1000, [(a + shift, b + shift) for a, b in edges])
    assert all(got.get(x - shift, x - shift) == roots[x] - shift for x in range(1000))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_edges_need_no_rounds(spark, monkeypatch):
    """One task joins few edges; rounds give the same."""
    rng = random.Random(10)
    edges = [*((i, i + 1) for i in range(90)), *((rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(110)), (7, 7), (0, 1), (-5, 300)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    made: list[str] = []
    write = components.written
    monkeypatch.setattr(components, "written", lambda df, name: (made.append(name), write(df, name))[1])
    found = lambda: sorted((r.node, r.root) for r in components.components(df).collect())
    one = found()
    assert len(made) == 2
    monkeypatch.setattr(components, "THINNED", 40)
    assert found() == one and len(made) > 5
    roots = union(410, [(a + 5, b + 5) for a, b in edges])
    assert one == sorted((x - 5, root - 5) for x, root in enumerate(roots) if root != x)


# ---- near dedup by shingles


def plain_shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def plain_prints(text):
    """The fingerprints by their definition, from the hashes of the shingles."""
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in plain_shingles(text)]
    out, cut = [], (1 << 64) - 1
    for _ in range(simhash.PRINTS):
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
        for k, (shift, times) in enumerate(((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))):
            hashes = [(h ^ h >> shift) * times & cut for h in hashes]
    return out


def similar_roots(texts):
    """Components of pairs that are similar enough and near in some fingerprint."""
    s, p = [plain_shingles(t) for t in texts], [plain_prints(t) for t in texts]
    near = lambda i, j: any((x ^ y).bit_count() <= simhash.SIMILAR_APART for x, y in zip(p[i], p[j], strict=True))
    return union(len(s), [(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if 10 * len(s[i] & s[j]) >= 8 * len(s[i] | s[j]) and near(i, j)])


def kept_by_similarity(rows):
    """Of each component, the least id, ids that are null last."""
    stays: dict = {}
    for root, (i, *_) in zip(similar_roots([t for _, t, *_ in rows]), rows, strict=True):
        stays[root] = min(stays.get(root, (True, 0)), (i is None, i or 0))
    return Counter(None if null else i for null, i in stays.values())


def test_similar(spark, case):
    rows, df = case
    rest = simhash.drop_similar(df)
    assert rest.columns == df.columns
    assert Counter(r.doc_id for r in rest.collect()) == kept_by_similarity(rows)
    assert simhash.drop_similar(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [0, simhash.CROWD])
def test_similar_in_crowds(spark, monkeypatch, crowd):
    """Copies of a text that are similar to it but not to each other, and chains; as forests and as all pairs."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for _ in range(4):
        w = [word() for _ in range(150)]
        for k in range(25):
            v = list(w)
            for _ in range(1 + k % 4):
                v[rng.randrange(len(v))] = word()
            rows.append((len(rows), " ".join(v), "s"))
        for _ in range(10):  # each a change of the one before
            w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w), "s"))
    rng.shuffle(rows)
    assert Counter(r.doc_id for r in simhash.drop_similar(docs_of(spark, rows)).collect()) == kept_by_similarity(rows)


def test_similar_in_crowds_makes_few_rows(spark, monkeypatch):
    """Copies that are near by their fingerprints but mostly not similar: pairs across components don't become rows."""
    made: dict[str, list[int]] = {}
    write = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: (out := write(df, name), made.setdefault(name, []).append(out.count()))[0])
    monkeypatch.setattr(simhash, "CROWD", 0)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 200_000, raising=False)  # several blocks
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    w = [word() for _ in range(100)]
    rows = []
    for k in range(300):
        v = list(w)
        for at in rng.sample(range(100), 1 if k % 12 == 0 else 2):
            v[at] = word()
        rows.append((k, " ".join(v), "s"))
    assert Counter(r.doc_id for r in simhash.drop_similar(docs_of(spark, rows)).collect()) == kept_by_similarity(rows)
    assert sum(made["similar-pairs"][1:] + made["similar-links"][1:]) < len(rows), made


# ---- suffix dedup


def test_cover_has_each_difference():
    assert {(a - b) % suffix_dedup.MODULUS for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.MODULUS))


def brute_removal(texts, n=suffix_dedup.MATCH):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def test_suffix_dedup(spark):
    rng = random.Random(11)
    part = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    p, q = part(380), part(900)
    texts = [part(1000) + p + part(300), part(77) + p + "tail", q[100:700], part(500) + q, q + part(10) + q, "z" * 2000, "z" * 399, "y" * 401, "ab" * 700, part(900), part(900)]
    exact = part(395)
    for extra in ("12345", "1234", "123456"):  # at the length itself, below and above
        cut = (exact + extra).encode()[-400:].decode(errors="ignore")
        texts += [part(50) + "|" + cut, cut + "/" + part(50)]
    texts += [texts[0], texts[0], texts[3][:-1], *ODD, texts[9][3:850]]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    for (i, *_), (n, removed, spans, kept) in zip(rows, brute_removal([(t or "").encode() for t in texts]), strict=True):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, removed, len(spans)), i
        assert list(zip(r.span_starts, r.span_ends, strict=True)) == spans
        assert bytes(r.kept) == hashlib.sha256(kept).digest()


def suffix_rows(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect())


def brute_rows(rows):
    return Counter((i, *x[:2], len(x[2]), hashlib.sha256(x[3]).digest()) for (i, *_), x in zip(rows, brute_removal([(t or "").encode() for _, t, _ in rows]), strict=True))


def test_suffix_dedup_of_heavy_anchors(spark, monkeypatch):
    """Suffixes of anchors with many occurrences take another way to the same result."""
    monkeypatch.setattr(suffix_dedup, "HEAVY", 3)
    rows = corpus(5)
    assert suffix_rows(docs_of(spark, rows)) == brute_rows(rows)


def test_suffix_dedup_of_regular_texts(spark):
    """Texts on which sums of powers collide, periodic ones, and one of several strips."""
    morse = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2 * suffix_dedup.STRIP + 77))
    texts = [morse, morse.translate(str.maketrans("ab", "ba")), morse[5:2000], "abc" * 500, "bca" * 400 + "x", "q" * 3000, long, long[suffix_dedup.STRIP - 300 : suffix_dedup.STRIP + 300], "y" + long[-450:], "y" + long[:399]]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    assert suffix_rows(docs_of(spark, rows)) == brute_rows(rows)


def test_repeated_suffixes_of_a_bucket():
    rng = random.Random(4)
    for _ in range(20):
        own = ["".join(rng.choice("ab") for _ in range(rng.choice((1, 2, 5, 60)))) * 900 for _ in range(3)]
        texts = [rng.choice(own)[rng.randrange(50) :][: rng.randrange(400, 900)].encode() for _ in range(6)]
        seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
        for t, hit in zip(texts, suffix_dedup.repeated(texts), strict=True):
            assert hit.tolist() == [seen[t[i : i + 400]] > 1 for i in range(len(t) - 399)]


def test_suffix_dedup_of_corpus(case):
    rows, df = case
    assert suffix_rows(df) == brute_rows(rows)


# ---- LM scores


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores(case, order):
    rows, df = case
    words = [(t or "").encode().lower().split() for _, t, _ in rows]
    c = Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))
    want = []
    for (i, *_), w in zip(rows, words, strict=True):
        s = 0.0
        for k in range(len(w)):
            back = 0.0
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1:
                    s += back + math.log(c[g] / total)
                elif c[g] >= 2:
                    s += back + math.log(c[g] / c[g[:-1]])
                    break
                back += math.log(0.4)
        want.append((i, len(w), s))
    got = lm_score.scores(df, order=order).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    for (i, n, s), r in zip(sorted(want, key=key), sorted(got, key=lambda r: key((r.doc_id, r.n_tokens, r.log_score))), strict=True):
        assert (r.doc_id, r.n_tokens) == (i, n) and abs(r.log_score - s) < 1e-6 * max(1, abs(s))
        assert (r.mean_log_score is None) == (n == 0)


# ---- mixing


def fill(sizes, weights, total):
    """Targets by sharing out again and again what stands above twice a source's size."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while left > 1e-9 and open_:
        w = sum(weights[s] for s in open_)
        give = {s: left * weights[s] / w for s in open_}
        left = 0.0
        for s, g in give.items():
            room = 2 * sizes[s] - target[s]
            target[s] += min(g, room)
            left += max(0.0, g - room)
            if g >= room:
                open_.discard(s)
    return target


def test_mixing(case):
    rows, df = case
    sizes: Counter = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = fill(sizes, weights, 1.5 * sum(sizes.values()))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken: Counter = Counter()
    for r in mixing._taken(mixing._sized(df, mixing.SEED), *mixing._plan(mixing._sized(df, mixing.SEED), mixing.SHARE, mixing.WEIGHTS)).collect():
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.source_size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_rows(case):
    _, df = case
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert set(got) <= {(r.doc_id, r.text) for r in df.collect()}  # whole texts
    rows, want = mixing._taken(mixing._sized(df, mixing.SEED, F.col("text")), *mixing._plan(mixing._sized(df, mixing.SEED), mixing.SHARE, mixing.WEIGHTS)).collect(), Counter()
    for r in rows:
        if r.size:
            want[r.doc_id, r.text] += (2 * r.taken + r.size) // (2 * r.size)
    assert got == +want


def test_mixing_of_ties(spark):
    """Rows without ids, and ids that repeat, with texts of different sizes: the same in each partitioning."""
    rng = random.Random(8)
    rows = [(None if i % 2 else 7, "w " * rng.randrange(1, 60) + str(i % 150), "s" if i % 3 else "t") for i in range(400)]
    df = docs_of(spark, rows)
    of = lambda d: Counter((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(d).collect())
    assert of(df) == of(df.repartition(7)) == of(df.repartition(2, "text"))


def test_row_keys_of_a_path_read_twice(spark, tmp_path):
    rows = corpus(6, 40)
    docs_of(spark, rows).write.parquet(str(tmp_path / "d"))
    twice = spark.read.parquet(str(tmp_path / "d"), str(tmp_path / "d"))
    assert with_row_key(twice).select("__lr_f", "__lr_i").distinct().count() == 2 * len(rows)
    once = spark.read.parquet(str(tmp_path / "d")).where("n_chars >= 0").select("*")
    assert "loomread-" not in with_row_key(once).inputFiles()[0]
    assert exact_dedup.drop_copies(twice).count() == len({lower(t) for _, t, _ in rows})
    assert Counter((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(twice).collect()) == Counter((i, len((t or "").encode()) if len((t or "").encode()) >= 400 else 0) for i, t, _ in rows * 2)


def test_mixing_is_weighted(spark):
    rows = [(i, "word " * 10 if i % 2 else "w " * 10, "s" if i < 900 else "t") for i in range(1000)]
    got = mixing.mix(docs_of(spark, rows)).where("source_size = 9000").select("doc_id", "taken").collect()
    twice = Counter(r.doc_id % 2 for r in got if r.taken > 10)
    assert twice[1] > 1.15 * twice[0]


# ---- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(21)
    rows = [r for r in corpus(3, 120) if r[0] is not None]
    bad = []
    for k in range(40):
        w = ["filler" + rng.choice("abcdefgh") * 3 for _ in range(30)]
        for _ in range(4):
            w.insert(rng.randrange(30), "zorkly")
        bad.append((1000 + k, " ".join(w), "a"))
    docs_of(spark, rows + bad).drop(*CLASH).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i, *_ in rows] + [(i, 1, 1) for i, *_ in bad[:30]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or after.columns == docs.columns
        frames[name] = docs = after
    ids = lambda n: [r.doc_id for r in frames[n].collect()]
    assert sorted(ids("toxicity")) == sorted(i for i, *_ in rows)
    groups: dict = {}
    for i, t, _ in rows:
        groups[lower(t)] = max(i, groups.get(lower(t), i))
    assert sorted(ids("exact_dedup")) == sorted(groups.values())
    left = [(r.doc_id, r.text) for r in frames["exact_dedup"].collect()]
    assert Counter(ids("near_dedup")) == kept_by_similarity(left)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mixed = frames["mixing"].collect()
    assert sum(r.length for r in frames["packing"].collect()) == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    # how often documents are cut depends on which rows share a task, what is packed doesn't
    by_doc = lambda df: {r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert by_doc(corpus_pipeline.run(spark, str(tmp_path))) == by_doc(frames["packing"])
