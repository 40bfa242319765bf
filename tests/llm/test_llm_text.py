"""Operators on single texts: toxicity, packing, token counts, HTML, WebP."""

import hashlib
import base64
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomread.llm import html_extract, packing, token_counts, toxicity, webp

CLASH = ("key", "size", "bin", "taken", "score", "digest", "fp", "root", "a", "b")  # names that operators use


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASH})


ODD = [None, "", " ", "\n\t", "a", "a b", "a b", "é漢🙂 ü", "x " * 3000, "word", "Word", "WORD\x0bnext"]


# ---- toxicity


def brute_segments(scores):
    """All maximal segments by the recursive definition: the highest sum (the shortest, first one), then left and right."""
    if not scores:
        return []
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2]):
                best = (i, j + 1, total)
    if best is None:
        return []
    i, j, _ = best
    return [*brute_segments(scores[:i]), best, *((a + j, b + j, s) for a, b, s in brute_segments(scores[j:]))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=25), st.randoms())
def test_segments(values, rng):
    scores = [v + 0.001 + rng.random() * 0.01 for v in values]  # sums don't tie
    got = toxicity.segments(np.array(scores, float))
    want = brute_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_segments_linear():
    rng = np.random.default_rng(1)
    long = np.concatenate((np.tile([1.0, -1.01], 100_000), rng.normal(-0.1, 1, 100_000), np.tile([1.0, -0.9], 100_000)))
    assert len(toxicity.segments(long)) > 0
    assert toxicity.segments(np.zeros(0)) == [] and toxicity.segments(np.array([-1.0, 0.0])) == []


def test_lambda_solves_its_equation():
    values, weights = np.array([-1.0, 2.0]), np.array([9.0, 1.0])
    lam = toxicity._weighted_lambda(values, weights)
    assert abs(0.9 * math.exp(-lam) + 0.1 * math.exp(2 * lam) - 1) < 1e-6


@pytest.fixture(scope="module")
def toxic_case(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    texts, toxic = [], []
    for i in range(800):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        bad = i % 7 == 0
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zorkly", "zorkish", "quamp"]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    texts += ODD
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(0, 1, toxic[0]), (None, 1, 1), (5000, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return df, labels, toxic


def test_toxicity_held_out(toxic_case):
    df, labels, toxic = toxic_case
    model = toxicity.fit(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model, with_segments=True).collect()}
    assert len(got) == len(toxic) + len(ODD)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.n_segments == len(r.segments)
    held = [i for i in range(len(toxic)) if got[i].held_out]
    hits = [got[i].predicted == toxic[i] for i in held]
    assert sum(hits) / len(hits) > 0.97
    bad = next(i for i in held if toxic[i])
    words = toxicity.tokens(df.where(F.col("doc_id") == bad).first().text)
    assert any(w.startswith(("zork", "quamp")) for s in got[bad].segments for w in words[s.first : s.after])
    clean = toxicity.drop_toxic(df, model)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_learns_from_its_rows_only(toxic_case):
    df, labels, _ = toxic_case
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(df, labels), toxicity.fit(df, other)
    assert a.odds == b.odds and a.curve == b.curve and a.lam == b.lam


def test_one_word_over_and_over():
    model = toxicity.Model({"faint": 1.5, "vile": 6.0}, curve=(-3.0, 0.5, 0.5))
    many = model.statistics("faint " * 500)
    assert many[0][1] <= model.statistics("faint faint " + "word " * 498)[0][1] + 1e-9
    assert model.score(model.statistics("vile word " * 3)[0]) > model.score(many[0])


def test_late_passages_are_found():
    """Earlier uses of its words, in harmless places or in another passage, don't hide a passage."""
    passage = "vile rude foul mean grim dire"
    model = toxicity.Model(dict.fromkeys(passage.split(), 6.0), curve=(-3.0, 0.5, 0.5))
    harmless = " ".join(f"{w} {'word ' * 30}" for w in passage.split() * 2)
    for between in (3, 30, 300):
        text = f"{harmless} {passage} {'word ' * between} {passage} {'word ' * 50} {passage}"
        words = toxicity.tokens(text)
        good = model.statistics(text)[1]
        assert [words[a:b] for a, b, _ in good][-1] == passage.split()
        assert sum(w != "word" for a, b, _ in good for w in words[a:b]) == 18
    alone = model.statistics("word " * 900 + passage)[0][0]
    late = model.statistics(harmless + "word " * (900 - len(harmless.split())) + passage)[0][0]
    assert late == pytest.approx(alone, rel=1e-3)


def test_uses_count_by_their_distance():
    model = toxicity.Model({"vile": 6.0, "dull": -2.0})
    words = "vile vile word word vile dull dull".split() + ["word"] * 200 + ["vile"]
    got = model.scores(words)
    assert got[0] == 5.0 and got[-1] == pytest.approx(5.0, abs=1e-3) and got[5] == got[6] == -3.0
    assert got[1] == pytest.approx(6 * (1 - math.exp(-1 / 16)) - 1) and got[4] == pytest.approx(6 * (1 - math.exp(-3 / 16)) - 1)


def test_repeats_take_linear_time():
    rng = random.Random(8)
    for words in (["vile"] * 300_000, ["vile", "word"] * 150_000, [rng.choice(["vile", "faint", "rude", "word"]) for _ in range(300_000)]):
        model = toxicity.Model({"faint": 1.5, "vile": 6.0, "rude": 3.0})
        assert toxicity.segments(model.scores(words))


def test_curve_sees_all_segments(spark, monkeypatch):
    """The curve is fitted on the features that scoring has, also of texts with many segments."""
    rng = random.Random(9)
    seen = []
    monkeypatch.setattr(toxicity, "_curve", lambda x, y: seen.append(x) or (0.0, 0.0, 0.0))
    texts = []
    for i in range(120):
        w = [f"w{rng.choice('abcdefgh') * 3}{rng.choice('abcdefgh')}" for _ in range(700)]
        for k in range(20, 692, 24) if i % 3 == 0 else ():
            w[k] = f"zork{chr(97 + k // 24)}ly"
        texts.append(" ".join(w))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    toxicity.fit(docs_of(spark, texts), labels)
    bad = seen[0][seen[0][:, 1] > 0]
    assert len(bad) and (bad[:, 1] >= np.minimum(20 * bad[:, 0], toxicity.SURE)).all()  # 28 passages each


def test_toxicity_without_labels(spark):
    df = docs_of(spark, ODD)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, labels)).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1, 1) for i in range(10)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, one)).collect()} == {1.0}
    assert toxicity.score(df.limit(0), toxicity.Model()).count() == 0


# ---- packing


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference_ids.t = getattr(reference_ids, "t", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*reference_ids.t.encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(rows, ids_of, window=1024):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids_of)
    for d, parts in by_doc.items():
        ids, at = ids_of[d], 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0


def test_pack(spark):
    rng = random.Random(2)
    texts = [*ODD, "a<|endoftext|>b", *(" ".join(rng.choice(["alpha", "béta", "1234", "x"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)), "longer " * 5000]
    df = docs_of(spark, texts).repartition(3)
    rows = packing.pack(df, with_ids=True).collect()
    ids_of = {i: reference_ids(t) for i, t in enumerate(texts)}
    check_packing(rows, ids_of)
    assert all(list(r.ids) == ids_of[r.doc_id][r.start : r.start + r.length] for r in rows)
    assert packing.pack(df.limit(0)).count() == 0


def test_ranks_equal_the_tokenizer():
    import public_tokenizers as P

    encode = packing.encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    alphabet = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0xA0, 0xE9, 0x2028, 0x3000, 0x6F22, 0x1F642, 0x300, 0x200D)]
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert encode(t).tolist() == reference_ids(t)[:-1]
    for t in (" " * 300_000 + "x", "\n" * 300_000, "x" * 100_000):
        assert encode(t).tolist() == reference_ids(t)[:-1]


def test_pieces_bounded_state():
    rng = random.Random(4)
    docs = [(i, np.arange(rng.randrange(1, 300), dtype=np.uint32)) for i in range(500)]
    rows = list(packing.pieces(iter(docs), 0, window=64, max_open=8))

    class Row:
        def __init__(self, r):
            self.doc_id, self.start, ids, self.doc_tokens, self.sequence_id, self.offset = r
            self.length, self.ids_crc32 = len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    check_packing([Row(r) for r in rows], {i: ids.tolist() for i, ids in docs}, 64)


def test_level_choice_is_the_best():
    rng = random.Random(6)
    for _ in range(300):
        levels = packing.Levels(16)
        for h in range(1, 16):
            for k in range(rng.randrange(4)):
                levels.put(h, 100 * h + k)
        size = rng.randrange(1, 16)
        squares = lambda n: sum(x * x for x in n[1:16])
        before = levels.count.copy()
        options = {}
        for h in range(17 - size):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= h > 0
            after[h + size] += h + size < 16
            options[h] = squares(after)
        h, which = levels.place(size)
        assert options[h] == min(options.values()) and (which is None) == (h == 0)


# ---- token counts


def unigram(vocab, byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return t


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_equal_the_tokenizer(byte_fallback):
    import public_tokenizers as P

    vocab = token_counts.vocabulary(P.path("piece_bpe_32k.model"))
    t, c = unigram(vocab, byte_fallback), token_counts.Counter(vocab, 0, byte_fallback)
    rng = random.Random(7)
    letters = "abcdefghi ▁ \n\t<0x41>é漢字🙂؀߿<unk></s>"
    for x in [*(o or "" for o in ODD), *("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(600))]:
        assert len(t.encode(x, add_special_tokens=False).ids) == c.text(x)[0], x


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("ab▁c", min_size=1, max_size=4), min_size=1, max_size=12), st.randoms(), st.lists(st.text("abc d", max_size=14), max_size=8))
def test_count_ties(pieces, rng, texts):
    vocab = [("<unk>", 0.0), *((p, -float(rng.randint(1, 3))) for p in sorted(pieces))]
    t, c = unigram(vocab, False), token_counts.Counter(vocab, 0, False)
    for x in texts:
        assert len(t.encode(x).ids) == c.text(x)[0]


def test_counts_of_documents(spark):
    df = docs_of(spark, ODD)
    got = {r.doc_id: r for r in token_counts.counts(df).collect()}
    assert got[0].n_tokens == got[1].n_tokens == 0 and got[5].n_tokens == got[6].n_tokens and got[8].n_tokens >= 3000
    assert token_counts.counts(df.limit(0)).count() == 0


# ---- HTML


def test_labelled_pages_are_learned():
    right = total = 0
    for page in html_extract.labelled():
        found = html_extract.blocks(page)
        rows = html_extract.features(found).tolist()
        right += sum(html_extract._is_main(r, html_extract.tree()) == (b.text[0] == "+") for b, r in zip(found, rows, strict=True))
        total += len(found)
    assert right >= 0.98 * total
    assert html_extract.tree().feature in (0, 1)  # words or links, not names


PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=/>Home</a></nav><!-- x --><div class='ad'>Buy this now, and some more words here.</div><article><h1>Head &amp; line</h1><p><b>One\n  two<br>three</b><p>Fo&uuml;r &#x41;&#66;.</article><footer>&copy; me</footer>", "Head & line One two three Foür AB."),
    ("<article><p>Text.</p><aside>Not this</aside><form><label>Name</label><input></form><div id='comments'><p>I think that this is long enough to be a comment.</p></div><p>End</p></article>", "Text. End"),
    ("<body><header>Site name</header><main><p>Short.</p></main><div class='cookie-banner'>We use cookies on this page, and many of them for a long time to come.</div></body>", "Short."),
    ("<article><p>a < b and c > d</p><p>x&nbsp;y&amp", "a < b and c > d x y&"),
    ("<article><p>unclosed <b>bold<p>next <!-- never ends", "unclosed bold next"),
    ("<nav><a href=/>Home</a></nav><article><h1>A case</h1><p>It began in the spring of a wet year, and went on for eleven more.</p><div class='legal-history'><p>The court of the town heard it first, and sent it on to the next.</p></div><p>It ended there.</p></article><footer>All rights reserved</footer>", "A case It began in the spring of a wet year, and went on for eleven more. The court of the town heard it first, and sent it on to the next. It ended there."),
    ("<div class=post><h1>Pills</h1><p>They were white and small, and he took one each morning with his tea.</p><div class='side-effects'><p>He slept badly, and said so, but not to the doctor.</p></div></div><div id=xq7><a href=/a>More of this</a></div>", "Pills They were white and small, and he took one each morning with his tea. He slept badly, and said so, but not to the doctor."),
    ("<html><head><title>T</title><meta charset=utf-8><body><nav><a href=/>Home</a> <a href=/b>More</a></nav><article><p>The head was never closed, and still the page is read to its end.</p></article>", "The head was never closed, and still the page is read to its end."),
    ("<div class='content-sidebar-wrap no-sidebar'><article><p>What stands in a wrapper of any name is read all the same, and kept.</p><p>Last.</p></article></div>", "What stands in a wrapper of any name is read all the same, and kept. Last."),
    ("<div class=a1><a href=/1>One</a> <a href=/2>Two</a></div><div class=b2><h1>Names that say nothing</h1><p>A page whose classes were made up by a machine still has paragraphs, and these are long.</p><p>This one is long as well, since it goes on about the first for a line or more.</p></div><div class=c3><a href=/3>Privacy</a> <a href=/4>Terms of use</a></div>", "Names that say nothing A page whose classes were made up by a machine still has paragraphs, and these are long. This one is long as well, since it goes on about the first for a line or more."),
    (None, ""),
    ("", ""),
    ("<nav>only</nav>", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_extract.main_text(page)[0] == text


def test_extract(spark):
    df = spark.createDataFrame([(i, f"u{i}", p, "x") for i, (p, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert {(r.page_id, r.text) for r in got} == {(i, t) for i, (_, t) in enumerate(PAGES)} | {(None, PAGES[0][1])}
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("<>/ap=\"'! -&;", max_size=60))
def test_any_page_is_read(page):
    html_extract.main_text(page)


# ---- WebP


def picture(h, w, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    c = np.stack([(x * 3 + y) % 256, (x * x // 7 + y * 2) % 256, (x + y * 5) % 256, np.where(x > w // 2, 255, 200)], -1) + rng.integers(0, 4, (h, w, 4))
    return np.ascontiguousarray(c.astype(np.uint8)).view(np.uint32).reshape(h, w)


@pytest.mark.parametrize(("h", "w"), [(1, 1), (1, 7), (9, 1), (13, 17), (20, 33)])
@pytest.mark.parametrize("kind", ["plain", "lz", "cache", "predictor", "cross", "green", "palette2", "palette4", "palette16", "palette99", "all"])
def test_webp_round_trip(h, w, kind):
    rng = np.random.default_rng(h * w)
    p = picture(h, w)
    blocks = (-(-h // 4), -(-w // 4))
    predictor = (webp.PREDICTOR, 2, rng.integers(0, 14, blocks))
    cross = (webp.CROSS_COLOUR, 2, rng.integers(0, 1 << 24, blocks).astype(np.uint32) | np.uint32(0xFF000000))
    options: dict = {}
    if kind in ("lz", "cache"):
        p = np.resize(p.ravel()[: max(1, p.size // 3)], p.shape)
        options = {"lz": True, "cache_bits": 4 if kind == "cache" else 0}
    elif kind == "predictor":
        options = {"transforms": (predictor,)}
    elif kind == "cross":
        options = {"transforms": (cross,)}
    elif kind == "green":
        options = {"transforms": ((webp.SUBTRACT_GREEN,),), "cache_bits": 11}
    elif kind.startswith("palette"):
        p = rng.choice(rng.integers(0, 1 << 32, int(kind[7:]), dtype=np.uint64).astype(np.uint32), (h, w))
        options = {"transforms": ((webp.PALETTE,),), "lz": True}
    elif kind == "all":
        options = {"transforms": (predictor, cross, (webp.SUBTRACT_GREEN,)), "cache_bits": 3, "lz": True, "groups": (2, rng.integers(0, 3, blocks))}
    assert (webp.decode(webp.encode(p, **options)) == p).all()


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    p = picture(11, 13, mode)
    assert (webp.decode(webp.encode(p, transforms=((webp.PREDICTOR, 3, np.full((2, 2), mode)),))) == p).all()


def test_code_lengths_are_bounded():
    counts = np.array([int(1.7**k) for k in range(60)])
    for most in (15, 7):
        n = webp.code_lengths(counts[:40] if most == 7 else counts, most)
        assert n.max() <= most and np.sum(0.5 ** n[n > 0]) == 1


def kinds_of(media):
    """Transforms of a picture, and whether it has copies."""
    bits = webp.Bits(media[21:])
    bits.read(32)
    found = []
    while bits.read(1):
        kind = bits.read(2)
        found.append(kind)
        if kind == webp.PREDICTOR:
            b = bits.read(3) + 2
            webp._read_pixels(bits, 1, -(-(int.from_bytes(media[21:25], "little") >> 14 & 16383) // (1 << b)) or 1, False)
        elif kind == webp.PALETTE:
            webp._read_pixels(bits, bits.read(8) + 1, 1, False)
    return found


@pytest.mark.parametrize(("text", "kinds"), [
    ("".join(random.Random(2).choices(("abcd", "dcab", "bbda", "ccab", "badc", "acdb", "dbca"), k=900)), [webp.PALETTE]),
    ("".join(chr(33 + (i * 7) % 90) for i in range(64)) * 3 + "x" * 5, [webp.SUBTRACT_GREEN]),
    (bytes(x % 128 for x in itertools.accumulate(random.Random(4).choices((1, 2, 3), k=6400))).decode(), [webp.SUBTRACT_GREEN, webp.PREDICTOR]),
    ("some words that are told, " * 40, [webp.SUBTRACT_GREEN]),
])
def test_pictures_use_what_fits(text, kinds):
    n, media = webp.store(text)
    assert webp.read_back(media).tobytes()[:n] == text.encode()
    assert kinds_of(media) == kinds
    pixels = next(webp.pictures(media))
    c = pixels.view(np.uint8).reshape(-1, 4)
    assert (c[:, 0] == c[:, 1]).all() and (c[:, 1] == c[:, 2]).all() and (c[:, 3] == 255).all()


def test_copies():
    rng = random.Random(3)
    for _ in range(200):
        part = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 90)))
        text = (part * rng.randrange(1, 200) + "".join(rng.choice("abcdef gh") for _ in range(rng.randrange(50))) + part).encode()
        end = 0
        for at, n, back in webp.copies(text):
            assert at >= end and 3 <= n <= webp.LONGEST and 0 < back <= at
            assert all(text[at + k] == text[at + k - back] for k in range(n))
            end = at + n
        media = webp.store(text.decode())[1]
        assert webp.read_back(media).tobytes()[: len(text)] == text
    assert len(webp.store("the same again, " * 5000)[1]) < 300


def test_file_of_another_encoder():
    """The one-pixel lossless file that browsers are widely tested with: prefix codes and sizes as others write them."""
    raw = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(raw).shape == (1, 1)


def test_column_of_files(spark):
    rng = np.random.default_rng(5)
    pixels = [rng.integers(0, 1 << 32, (h, w), dtype=np.uint64).astype(np.uint32) for h, w in ((1, 1), (3, 5), (8, 2))]
    rows = [(i, bytearray(webp.encode(p, ((webp.SUBTRACT_GREEN,),), 4, True))) for i, p in enumerate(pixels)] + [(9, None)]
    got = {r.i: r.pixels for r in webp.decode_column(spark.createDataFrame(rows, "i long, file binary").repartition(2), "file").collect()}
    assert got[9] is None
    for i, p in enumerate(pixels):
        assert (got[i].width, got[i].height, bytes(got[i].argb)) == (p.shape[1], p.shape[0], p.astype("<u4").tobytes())


@pytest.mark.parametrize("text", [None, "", "a", "ab" * 40, "x" * (2 << 20), "€" * 1000, "".join(chr(32 + i * i % 90) for i in range(70_000))])
def test_store(text):
    n, media = webp.store(text)
    raw = (text or "").encode()
    samples = webp.read_back(media)
    assert n == len(raw) and len(samples) % 64 == 0 and len(samples) >= 64 and len(samples) - n < 64 + 64 * (n == 0)
    assert samples.tobytes() == raw + bytes(len(samples) - n)
    grey = next(webp.pictures(media))
    assert (grey >> 24 == 255).all() and (grey & 255 == grey >> 8 & 255).all() and (grey >> 16 & 255 == grey & 255).all()


def test_bad_files():
    with pytest.raises(ValueError, match="not a lossless"):
        webp.decode(b"RIFF" + bytes(40))


def test_store_texts(spark):
    df = docs_of(spark, ODD)
    got = {r.doc_id: r for r in webp.store_texts(df, with_media=True).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
    assert got[0][2:] == got[1][2:] and got[5][1:] == got[6][1:]
    assert webp.store_texts(df.limit(0)).count() == 0
