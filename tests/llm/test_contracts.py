"""Each registered operator against a plain version, on the driver's smallest tables and on hand-made rows:
nulls, empty, long and equal texts, repeated rows, empty tables, other columns with the operators' names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidewave.llm import catalog, components, decontamination, kneser_ney, langid, packing, quality, setsketch, shared, sharding, suffix_array, suffix_dedup, textkit, toxicity, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, n int, id string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def tokens(t):
    return WORD.findall(lower(t or ""))


def odd_rows():
    rng = random.Random(7)
    sentence = lambda n: " ".join(rng.choice(["the", "of", "Und", "naïve", "x1", "日本", "é"]) + str(rng.randrange(300)) for _ in range(n))
    long, base = sentence(3000), sentence(120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \t\n", "one", "ONE", "two words", base, base, " ".join(near), long, long[:9000] + " tail", "ab " * 400, "\u00a0x\u2028y z", "a\nb\na\n \na", "!!! ??? 123", base + "\n" + base]
    rows = [(i, t, "k", 1, "i") for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[0], (None, base, "k", 2, "i"), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def key(row):
    return (row is None, row)


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["a b", None, "", "A\x00 a", " b\u3000c ", "ab"]
    w = textkit.words(textkit.byte_view(pa.array(texts)))
    found = [tokens(t) for t in texts]
    assert np.diff(w.first).tolist() == [len(f) for f in found]
    flat = [x for f in found for x in f]
    assert len(set(w.hashes.tolist())) == len(set(flat))
    assert collections.Counter(zip(flat, w.hashes.tolist())).keys() == {(x, h) for x, h in zip(flat, w.hashes.tolist())}


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_are_no_polynomials(spark):
    """Texts, lines and words that every polynomial modulo a power of two confuses."""
    one, other = thue_morse(4096)
    data = np.frombuffer((one + other).encode(), np.uint8)
    for n in (64, 256, 2048, 4096):
        at = np.array([0, 4096])
        assert len(set(textkit.range_hashes(data, at, at + n).tolist())) == 2
        assert all(len(set(d.tolist())) == 2 for d in textkit.digests(data, at, at + n))
    text = f"{one}\n{other}\n" + " ".join(map(str, range(60)))
    df = spark.createDataFrame([(1, text), (2, one), (3, other)], "doc_id long, text string")
    assert quality.compression_bands(df).where("doc_id = 1").first().n_dup_lines == 0
    check_repeats(df)
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(df.where("doc_id > 1"), k=2).collect()}
    assert got == {2: 2, 3: 3}
    model = kneser_ney.train(df)
    assert model.v == 63


# 1


def plain_repeats(texts, length):
    """Kept bytes and runs by looking at every window."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def check_repeats(df, length=200):
    rows = df.select("doc_id", "text").collect()
    want = sorted(((r[0] is None, r[0] or 0, *w) for r, w in zip(rows, plain_repeats([r[1] for r in rows], length))))
    got = suffix_dedup.substring_dedup(df, length, spans=False).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_suffix_dedup_equals_every_window(docs):
    check_repeats(docs)


@pytest.mark.parametrize("hot", [2, 500])
def test_suffix_dedup_odd_rows(odd, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    check_repeats(odd)


@pytest.mark.parametrize("heavy", [1, 10**9])
def test_suffix_dedup_shuffled_sides(odd, monkeypatch, heavy):
    """Nothing is broadcast, or every key with two rows is heavy."""
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(shared, "LIGHT", 1 if heavy > 1 else 10**9)
    monkeypatch.setattr(shared, "HEAVY_KEYS", heavy)
    check_repeats(odd)


def first_copies(rows, length):
    """Texts without the bytes that an earlier equal window covers, by number, then place."""
    data = [(t or "").encode() for t in rows]
    seen, out = set(), []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if d[i : i + length] in seen:
                gone[i] += 1
                gone[i + length] -= 1
            seen.add(d[i : i + length])
        out.append(bytes(np.frombuffer(d, np.uint8)[np.cumsum(gone)[: len(d)] == 0]).decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("hot", [2, 500])
def test_first_copies_stay(spark, odd, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    unique = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for df in (unique, docs) if hot == 500 else (unique,):
        out = suffix_dedup.without_repeats(df)
        assert out.columns == df.columns and out.count() == df.count()
        rows = sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        want = first_copies([t for _, t in rows], 200)
        assert {r.doc_id: r.text for r in out.collect()} == {i: w if t is not None else None for (i, t), w in zip(rows, want)}


def test_rows_that_repeat_keep_one_text(odd, none):
    out = suffix_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    rows = [(r.doc_id, r.text) for r in out.collect()]
    base = odd_rows()[6][1]
    assert sum(base in (t or "") for _, t in rows) == 1 and (6, base) in rows
    assert (3, "one") in rows and (0, None) in rows and suffix_dedup.without_repeats(none).count() == 0


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(2)
    for n in range(60):
        text = rng.integers(97, 97 + 1 + n % 3, n).astype(np.uint8)
        order = suffix_array.suffix_array(text, 64)
        b = text.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])


# 2


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    import itertools

    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 5, 9) * rng.integers(0, 2, 9)
    k = int(rng.integers(1, 5))
    lengths = np.flatnonzero(counts) + 1
    pad = lambda bounds: sum(counts[n - 1] * (min(b for b in bounds if b >= n) - n) for n in lengths)
    got = packing.best_boundaries(counts, k)
    if not len(lengths):
        assert got == []
        return
    best = min(pad((*c, int(lengths[-1]))) for c in itertools.combinations(lengths[:-1].tolist(), min(k, len(lengths)) - 1))
    assert pad(got) == best and len(got) <= k


def test_packing_holds_every_token(odd):
    budget, longest = 500, 100
    rows = packing.length_buckets(odd, buckets=4, max_length=longest, budget=budget).collect()
    want = collections.Counter()
    for i, t, *_ in odd_rows():
        want[i] += len(tokens(t))
    got = collections.Counter()
    batches = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.n_tokens
        assert 0 < r.n_tokens <= min(r.padded, longest) and r.first_token == r.piece * longest
        batches[r.bucket, r.batch].append((r.place, r.padded))
    assert {k: v for k, v in want.items() if v} == dict(got)
    last = {b: max(x for y, x in batches if y == b) for b, _ in batches}
    for (b, i), places in batches.items():
        size = max(1, budget // places[0][1])
        assert sorted(p for p, _ in places) == list(range(len(places)))
        assert len(places) == size or i == last[b] and len(places) < size


def test_packing_with_a_tokenizer(docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    count = packing.rank_file_tokens(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    rows = packing.length_buckets(docs.limit(20), tokens=count).collect()
    assert sum(r.n_tokens for r in rows) > 20


# 3


def plain_quality(t):
    t = t or ""
    w = WORD.findall(t)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_quality_counts(which, request):
    df = request.getfixturevalue(which)
    got = quality.compression_bands(df).collect()
    counts = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert counts == sorted((str(r.doc_id), *plain_quality(r.text)) for r in df.collect())
    assert not any(r.kept and r.base_failed for r in got)


def plain_kept(t):
    """Whole and chunk ratios against the bands, the last chunk reaching back."""
    import zstandard

    data = (t or "").encode()
    if plain_quality(t)[-1] or not data:
        return False
    ratio = lambda b: len(zstandard.compress(b, 3)) / len(b)
    lo, hi = next((x, y) for most, x, y in quality.WHOLE_BANDS if len(data) < most)
    chunks = [data[i : i + 2048] for i in range(0, len(data), 2048)]
    if len(data) > 2048:
        chunks[-1] = data[-2048:]
    bad = sum(not (0.454 <= ratio(c) <= 0.75 if len(c) == 2048 else lo <= ratio(c) <= hi) for c in chunks)
    return lo <= ratio(data) <= hi and 4 * bad <= len(chunks)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_quality_verdicts(which, request):
    df = request.getfixturevalue(which)
    got = sorted((str(r.doc_id), r.n_words, r.kept) for r in quality.compression_bands(df).collect())
    assert got == sorted((str(r.doc_id), len(WORD.findall(r.text or "")), plain_kept(r.text)) for r in df.collect())


def test_a_noisy_tail_counts():
    import zstandard

    rng = random.Random(2)
    prose = " ".join(rng.choice(["market", "river", "stone", "winter", "letter", "engine"]) + str(rng.randrange(60)) for _ in range(260)).encode()[:2048]
    *_, n, good = quality.compression(prose + bytes(rng.randrange(256) for _ in range(700)), zstandard.ZstdCompressor(level=3))
    assert n == 2 and not good


def test_compression_bands_tell_repeats_and_noise():
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(5000))
    assert not quality.compression(b"the same again " * 500, packer)[-1]
    assert not quality.compression(noise, packer)[-1]


def test_quality_follows_labels(spark):
    rows = quality.compression_bands(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(rows)
    assert share[1] > 0.97 and share[0] < 0.7


# 4


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://A.Example.ORG/es/x", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/17?x", "example.org", "/en/17", "example.org/en/1", "block"), ("http://x.org/casino", "x.org", "/casino", "org/", "allow"), ("http://x.org", "x.org", "", None, "allow"),
    ("http://notorg/x", "notorg", "/x", None, "allow"), ("http://x.com/de/casino", "x.com", "/de/casino", "com/de/", "block"), ("https://CASINO-x.net", "casino-x.net", "", None, "block"),
    ("https://occasino.net/", "occasino.net", "/", None, "allow"), ("https://free.net/win", "free.net", "/win", None, "allow"), ("https://free.net/poker", "free.net", "/poker", None, "block"), ("https://free.net/win/bet", "free.net", "/win/bet", None, "block"), ("https://poker.net/poker", "poker.net", "/poker", None, "allow"), ("https://free.net/free", "free.net", "/free", None, "allow"),
    ("a://b://c/d#e", "b:", "//c/d", None, "allow"),
])
def test_url_verdicts(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "x")], "page_id long, url string, verdict string")
    assert tuple(urlfilter.url_vocabulary(df).first())[1:5] == (host, path, rule, verdict)


def test_url_odd_tables(spark, tmp_path):
    kind = "page_id long, url string, host string, rule string"
    assert urlfilter.url_vocabulary(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, "http://casino.net/", "x", "y")] * 3 + [(None, None, None, None), (2, "", "h", "r")]
    got = sorted((str(r.page_id), r.verdict) for r in urlfilter.url_vocabulary(spark.createDataFrame(rows, kind)).collect())
    assert got == [("1", "block")] * 3 + [("2", "allow"), ("None", "allow")]
    (tmp_path / "t").write_text("# own\nbad\tstrict\t0\nso\tsoft\t2.5\n")
    strict, soft = urlfilter.vocabulary(tmp_path / "t")
    own = urlfilter.url_vocabulary(spark.createDataFrame([(1, "a://x/so"), (2, "a://bad/"), (3, "a://x/casino")], "page_id long, url string"), strict=strict, soft=soft)
    assert [r.verdict for r in own.orderBy("page_id").collect()] == ["block", "block", "allow"]
    (tmp_path / "t").write_text("bad line\n")
    with pytest.raises(ValueError, match="no term"):
        urlfilter.vocabulary(str(tmp_path / "t"))


def test_url_query_equals_sql(spark, duck):
    got = catalog.queries()["op4_url_vocabulary"](spark, SF).collect()
    want = duck.execute(catalog.oracle_sql()["op4_url_vocabulary"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


# 5


def test_language_of_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.queries()["op5_language_spans"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_mixed_text_is_cut_into_spans(spark, docs):
    model = langid.train(docs)
    english, german = (docs.where(f"lang = '{x}' AND n_chars BETWEEN 900 AND 2500").first().text[:600] for x in ("en", "de"))
    both = spark.createDataFrame([(1, english + " " + german, "x")], "doc_id long, text string, spans string")
    r = langid.language_spans(both, model).first()
    assert [s.lang for s in r.spans] == ["en", "de"]
    assert abs(r.spans[0].end - len(english)) < 60 and 0.1 < r.score < 0.8


def plain_viterbi(s, penalty):
    """Labels of one text, word by word; ties stay, then go to the lowest."""
    value, back = list(s[0]), []
    for row in s[1:]:
        top = max(range(len(row)), key=lambda k: (value[k], -k))
        back.append([top if value[top] - penalty > value[k] else k for k in range(len(row))])
        value = [max(value[k], value[top] - penalty) + row[k] for k in range(len(row))]
    path = [max(range(len(value)), key=lambda k: (value[k], -k))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


def labels_of(scores, sizes, penalty):
    ends = np.cumsum(sizes)
    out = np.full(len(scores), -1)
    langid.viterbi(scores, ends - sizes, ends, out, penalty)
    return out


def test_viterbi_equals_all_paths():
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(20):
        s = rng.normal(0, 4, (5, 3))
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 3 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(3), repeat=5), key=value)
        assert value(labels_of(s, np.array([5]), 3.0)) == pytest.approx(value(best))
        assert value(plain_viterbi(s, 3.0)) == pytest.approx(value(best))


@pytest.mark.parametrize("whole", [False, True])
def test_viterbi_of_many_texts_is_that_of_each(whole, monkeypatch):
    """Texts of any length, none and one word included, in any order; whole scores make ties."""
    monkeypatch.setattr(langid, "STEPS", 16)
    rng = np.random.default_rng(8)
    sizes = np.concatenate([[0, 1, 1, 40], rng.integers(0, 30, 60), [0]])
    scores = rng.normal(0, 3, (sizes.sum(), 4))
    scores = np.round(scores) if whole else scores
    got, ends = labels_of(scores, sizes, 3.0), np.cumsum(sizes)
    for n, end in zip(sizes, ends):
        if n:
            assert list(got[end - n : end]) == plain_viterbi(scores[end - n : end], 3.0)
    assert len(labels_of(scores[:0], np.zeros(2, int), 3.0)) == 0


def test_texts_kept_from_the_search_have_one_best_label():
    rng = np.random.default_rng(9)
    model = langid.Model(["a", "b", "c"], np.zeros((3, 1)), np.ones((1, 3), bool))
    sizes = rng.integers(1, 12, 300)
    rows = np.repeat(np.arange(300), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 5, (len(rows), 3))
    best = np.array([scores[x:y].sum(axis=0).argmax() for x, y in zip(first[:-1], first[1:])])
    doubt = model.may_switch(scores, best[rows], rows, first)
    assert 0 < doubt.sum() < 300
    for i in np.flatnonzero(~doubt):
        assert set(plain_viterbi(scores[first[i] : first[i + 1]], langid.SWITCH)) == {best[i]}


def test_language_odd_rows(odd, none, docs):
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.language_spans(odd, model).collect() if r.doc_id is not None}
    for i in (0, 1, 2, 14):
        assert (got[i].lang_pred, got[i].score, got[i].spans) == ("und", 0.0, [])
    assert langid.train(none.withColumn("lang", F.lit("x"))).languages == []
    untrained = langid.Model([], np.zeros((0, langid.FEATURES)), np.zeros((1, 0), bool))
    assert {r.lang_pred for r in langid.language_spans(odd, untrained).collect()} == {"und"}


def test_nothing_learned_keeps_no_secret(spark, odd, none):
    untrained = langid.train(odd.withColumn("lang", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="no language was learned"):
        langid.keep_known(odd, untrained)
    assert langid.keep_known(none, untrained).count() == 0


def test_language_odd_tables(spark, none, odd, docs):
    model = langid.train(docs)
    assert langid.language_spans(none, model).count() == 0 and langid.keep_known(none, model).count() == 0
    left = langid.keep_known(odd, model)
    assert left.columns == odd.columns and {r.text for r in left.collect()}.isdisjoint({None, "", " \t\n", "!!! ??? 123"})
    tied = langid.Model(["a", "b"], np.zeros((2, langid.FEATURES)), np.ones((len(textkit.Letters.NAMES), 2), bool))
    r = langid.language_spans(spark.createDataFrame([(1, "x y", "q", 0.5)], "doc_id long, text string, lang_pred string, score double"), tied).first()
    assert (r.lang_pred, r.score) == ("a", 0.5)


def test_unknown_script_leaves_all_languages(spark, docs):
    r = langid.language_spans(spark.createDataFrame([(1, "слово ещё")], "doc_id long, text string"), langid.train(docs)).first()
    assert r.lang_pred in langid.train(docs).languages


def test_texts_of_no_known_language_go(spark, docs):
    rng = random.Random(1)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in (5, 30, 300)]
    foreign = ["Все люди рождаются свободными и равными в своем достоинстве и правах", "すべての人間は、生まれながらにして自由であり", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności"]
    known = [docs.where(f"lang = '{x}' AND n_chars BETWEEN 300 AND 2500").first().text for x in ("en", "de", "fr")]
    texts = [None, "", "123", *noise, *foreign, *known, known[0][:300] + " " + known[1][:300]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in langid.keep_known(df, langid.train(docs)).collect()) == [9, 10, 11, 12]


# 6


def test_toxicity_on_texts_not_trained_on(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.train(docs, labels.where("doc_id % 4 <> 0"))
    rows = toxicity.classifier_chain(docs.where("doc_id % 4 = 0"), chain).withColumnRenamed("toxic", "said").join(labels, "doc_id").collect()
    hit = sum(r.said and r.toxic == 1 for r in rows)
    assert hit / sum(r.toxic == 1 for r in rows) > 0.85 and hit / max(1, sum(r.said for r in rows)) > 0.85


def test_chain_without_labels(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(odd, empty)
    got = toxicity.classifier_chain(odd, chain)
    assert got.count() == odd.count() and {r.kept for r in got.collect()} == {True}


def plain_chain(rows, folds, words, ridge=0.3):
    """Words by chi-square without the fold's rows, ridge logistic models and out-of-fold probabilities."""
    sets = [set(re.findall(r"[^\W\d_]+", t.lower())) for _, t, *_ in rows]
    labels = np.array([r[2:] for r in rows], float)
    n = len(rows)

    def chosen(train):
        out = set()
        df = collections.Counter(w for i in train for w in sets[i])
        for k in range(labels.shape[1]):
            rate = labels[train, k].mean()
            hit = collections.Counter(w for i in train for w in sets[i] if labels[i, k])
            gain = {w: (hit[w] - c * rate) ** 2 / (c * rate * (1 - rate) + 1) for w, c in df.items() if c >= 3}
            out |= set(sorted(gain, key=lambda w: -gain[w])[:words])
        return sorted(out)

    def model(train, k, earlier):
        vocabulary = chosen(train)
        x = np.array([[1, *(w in sets[i] for w in vocabulary), *earlier[i]] for i in range(n)], float)
        w = np.zeros(x.shape[1])
        shrink = np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
        for _ in range(100):
            p = 1 / (1 + np.exp(-x[train] @ w))
            w += np.linalg.solve(x[train].T @ np.diag(p * (1 - p)) @ x[train] + np.diag(shrink), x[train].T @ (labels[train, k] - p) - shrink * w)
        return 1 / (1 + np.exp(-x @ w))

    every, unseen, full = list(range(n)), np.zeros((n, 0)), np.zeros((n, 0))
    for k in range(labels.shape[1]):
        fold = np.zeros(n)
        for f in set(folds):
            p = model([i for i in every if folds[i] != f], k, unseen)
            fold[[i for i in every if folds[i] == f]] = p[[i for i in every if folds[i] == f]]
        # the final model is fitted on out-of-fold probabilities and applied to its own chain
        vocabulary = chosen(every)
        x = np.array([[1, *(w in s for w in vocabulary)] for s in sets], float)
        a, b = np.column_stack([x, unseen]), np.column_stack([x, full])
        w, shrink = np.zeros(a.shape[1]), np.r_[1e-6, np.full(a.shape[1] - 1, ridge)]
        for _ in range(100):
            p = 1 / (1 + np.exp(-a @ w))
            w += np.linalg.solve(a.T @ np.diag(p * (1 - p)) @ a + np.diag(shrink), a.T @ (labels[:, k] - p) - shrink * w)
        full, unseen = np.column_stack([full, 1 / (1 + np.exp(-b @ w))]), np.column_stack([unseen, fold])
    return full


def test_chain_equals_a_plain_one(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        toxic, poor = rng.random() < 0.3, rng.random() < 0.4
        w = [rng.choice("abcdefghijkl") * 3 for _ in range(12)] + ["vile"] * (toxic and rng.random() < 0.9) + ["spam"] * (poor and rng.random() < 0.8) + ["spam"] * (rng.random() < 0.1)
        rows.append((i, " ".join(w), int(poor), int(toxic)))
    df = spark.createDataFrame([(i, t, "x") for i, t, *_ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1 - p, t) for i, _, p, t in rows], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    folds = [r.f for r in df.select(toxicity.fold_of(F.col("doc_id")).alias("f")).collect()]
    want = plain_chain([r if r[0] != 3 else r for r in rows], folds, 6)
    chain = toxicity.train(df, labels.unionAll(odd.where("doc_id IS NULL OR quality IS NULL")), words=6)
    got = toxicity.classifier_chain(df, chain).orderBy("doc_id").collect()
    assert np.array([[r.p_low_quality, r.p_toxic] for r in got]) == pytest.approx(want, abs=1e-3)
    assert [r.kept for r in got] == [not r.toxic for r in got]


def test_chain_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 1), (9, 1, 0), (9, 0, 0), (12, 0, 1), (0, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(odd, labels)
    got = toxicity.classifier_chain(odd, chain).collect()
    assert len(got) == odd.count() and all(0 <= r.p_toxic <= 1 for r in got)
    assert toxicity.classifier_chain(none, chain).count() == 0


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (400, 4)).astype(float)
    first = x[:, 0] * x[:, 1]
    weights, limits = toxicity.fit_chain(x, np.column_stack([first, first]), np.arange(400) % 3)
    assert len(weights[0]) == 5 and len(weights[1]) == 6 and weights[1][5] > 1


# 7


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_alignment_scores():
    rng = np.random.default_rng(3)
    a = [rng.integers(2, 9, rng.integers(1, 12)).astype(np.uint64) for _ in range(40)]
    b = [rng.integers(2, 9, rng.integers(1, 12)).astype(np.uint64) for _ in range(40)]
    assert decontamination.align(a, b)[0].tolist() == [plain_alignment(x, y) for x, y in zip(a, b)]


def planted(spark):
    items = ["what is the capital of the far northern land where winters last nine months and nobody owns a clock", "name the three rivers that meet below the old stone bridge near the market", "", None, "short one", "what is the capital of the far northern land where winters last nine months and nobody owns a clock"]
    fill = " ".join(f"filler{i}" for i in range(80))
    edited = items[0].replace("capital", "main city").replace("winters", "cold seasons").replace("a clock", "any clock")
    docs = [fill, f"{fill} {items[0]} {fill}", f"{fill} {edited.upper()}, {fill}", items[1], f"{fill} the three rivers {fill}", None, "", f"short one {fill}", fill]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, item string"), bench


def test_contaminated_passages(spark):
    docs, bench = planted(spark)
    want = {(1, 0), (1, 5), (2, 0), (2, 5), (3, 1), (7, 4)}
    for block in (1, 1000):
        got = decontamination.contaminated(docs, bench, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert {r.score for r in got if r.doc_id == 1} == {1.0}
    r = next(r for r in got if r.doc_id == 1)
    assert (r.first_token, r.end_token) == (80, 99)
    assert {r.doc_id for r in decontamination.decontaminated(docs, bench).collect()} == {0, 4, 5, 6, 8}


@pytest.mark.parametrize("also_exact", [False, True])
def test_edited_and_partial_copies_are_found(spark, also_exact):
    """Copies whose other seeds occur nowhere, alone and beside an exact copy; items of 40 tokens."""
    n, fill = 40, " ".join(f"filler{i}" for i in range(60))
    item = lambda i: [f"w{i}x{j}" for j in range(n)]
    copies = [[f"new{j}" if j % step == step // 2 else x for j, x in enumerate(item(i))] for i, step in enumerate((7, 6, 5))]
    copies += [item(3)[: n // 2], item(4)[n // 2 :], item(5)[:8]]
    docs = [(i, f"{fill} {' '.join(c)} {fill}") for i, c in enumerate(copies)]
    # what is left of the last item is in many texts, too: a common seed is a seed
    left = item(6)[: n // 2]
    docs += [(10 + i, f"{' '.join(left)} {fill}") for i in range(50)]
    if also_exact:
        docs += [(100 + i, " ".join(item(i))) for i in range(7)]
    bench = spark.createDataFrame([(i, " ".join(item(i))) for i in range(7)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    want = {(i, i) for i in range(5)} | {(10 + i, 6) for i in range(50)} | ({(100 + i, i) for i in range(7)} if also_exact else set())
    assert set(got) == want
    assert got[3, 3] == got[4, 4] == 0.5 and all(got[i, i] < 0.8 for i in range(5))


def test_passages_left_out_cannot_reach_the_score(monkeypatch):
    """Every text and item with a seed against a plain alignment of the whole text, in portions of any size."""
    import pyarrow as pa

    rng = random.Random(5)
    items = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30))) for _ in range(12)]
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 90))) for _ in range(100)]
    view = textkit.byte_view(pa.array(texts, pa.large_string()))
    found = decontamination.Items(list(range(12)), items)
    whole = found.hits(view)
    for r, i, score, _, _ in whole:
        a, b = ([ord(x) for x in t.split()] for t in (items[i], texts[r]))
        assert score * len(a) <= plain_alignment(a, b)
    monkeypatch.setattr(decontamination, "TOKENS", 50)
    assert found.hits(view) == whole
    monkeypatch.setattr(decontamination.Items, "shared", lambda self, h, item, lo, hi: hi - lo + 1000)
    assert found.hits(view) == whole and len(whole) > 20


def test_alignment_finds_what_all_pairs_do(spark):
    """Edited copies against every text and item aligned in full."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(400)}"
    items = [[word() for _ in range(rng.randrange(9, 50))] for _ in range(25)]
    texts = []
    for i in range(150):
        t = [word() for _ in range(rng.randrange(20, 90))]
        if i % 3:
            copy = []
            for x in rng.choice(items):
                u = rng.random()
                copy += [x] if u > 0.3 else [word()] if u > 0.15 else [x, word()] if u > 0.07 else []
            at = rng.randrange(len(t))
            t[at:at] = copy
        texts.append(t)
    want = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if plain_alignment(x, t) >= max(0.4 * len(x), min(len(x), 8))}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect()}
    assert len(want) > 60 and got <= want and len(got) >= 0.9 * len(want)


def test_contamination_odd_tables(spark, monkeypatch):
    docs, bench = planted(spark)
    whole = sorted(map(str, decontamination.contaminated(docs, bench).collect()))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)  # the index in files
    assert sorted(map(str, decontamination.contaminated(docs, bench, block=2).collect())) == whole
    twice = docs.unionAll(docs).unionAll(spark.createDataFrame([(None, "short one", "x")], docs.schema))
    got = decontamination.contaminated(twice, bench.unionAll(bench.where("item_id = 1")))
    assert got.where("doc_id = 3").count() == 4 and got.where("doc_id IS NULL").count() == 1
    one = spark.createDataFrame([(9, "filler7")], "item_id long, text string")  # an item of one common word
    assert {r.doc_id for r in decontamination.contaminated(docs, one).collect()} == {0, 1, 2, 4, 7, 8}


def test_contamination_without_items(spark, odd, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(odd, bench).count() == 0
    assert decontamination.decontaminated(odd, bench).count() == odd.count()
    assert decontamination.contaminated(none, planted(spark)[1]).count() == 0


def test_exact_leaks_are_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert want and want <= got and len(got) <= len(want) + 4


# 8


def test_kneser_ney_equals_plain_counts(spark, docs, odd):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        test = langid.held_out(parts=5)
        model = kneser_ney.train(df, ~test)
        got = kneser_ney.perplexity(df, model).collect()
        used = [[*tokens(r.text), None] for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
        uni = collections.Counter(w for t in used for w in t)
        bi = collections.Counter(p for t in used for p in zip([0, *t[:-1]], t))
        n, v = sum(uni.values()), len(uni)
        context, follows = collections.defaultdict(lambda: [0, 0, 0, 0]), collections.Counter()
        for (a, b), c in bi.items():
            context[a][0] += c
            context[a][min(c, 3)] += 1
            follows[b] += 1
        cut = lambda c, d: max(c - d[min(c, 3)], 0) if c else 0
        d, e = (kneser_ney.discounts([sum(c == i for c in x.values()) for i in (1, 2, 3, 4)]) for x in (bi, follows))
        mass = sum(e[min(c, 3)] for c in follows.values()) / len(bi)
        low = lambda w: cut(follows[w], e) / len(bi) + mass / (v + 1)
        assert sum(map(low, follows)) + mass / (v + 1) == pytest.approx(1)

        def scores(t):
            t = [*tokens(t), None]
            score = 0.0
            for a, w in zip([0, *t[:-1]], t):
                x = context.get(a)
                p = low(w) if x is None else (cut(bi.get((a, w), 0), d) + sum(d[i] * x[i] for i in (1, 2, 3)) * low(w)) / x[0]
                score += math.log10(p)
            return len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), score

        order = lambda x: (x[0] is None, x[0] or 0, *x[1:3])
        have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=order)
        want = sorted(((r.doc_id, *scores(r.text)) for r in rows), key=order)
        assert [h[:4] for h in have] == [w[:4] for w in want]
        assert [x for h in have for x in h[4:]] == pytest.approx([x for w in want for x in w[4:]], rel=1e-9, abs=1e-9)


def test_kneser_ney_in_two_steps(docs, monkeypatch):
    """More buckets than a task deals to at once, counts beyond one byte: the same model."""
    one = kneser_ney.perplexity(docs, kneser_ney.train(docs)).select("doc_id", "n_known", "score").collect()
    monkeypatch.setattr(kneser_ney, "STEP_BITS", 3)
    monkeypatch.setattr(kneser_ney, "HELD", 20000)
    two = kneser_ney.perplexity(docs, kneser_ney.train(docs)).select("doc_id", "n_known", "score").collect()
    assert sorted((r.doc_id, r.n_known, round(r.score, 6)) for r in one) == sorted((r.doc_id, r.n_known, round(r.score, 6)) for r in two)
    assert [kneser_ney.narrow(np.array([x], np.uint64)).itemsize for x in (0, 255, 256, 1 << 16, 1 << 40)] == [1, 1, 2, 4, 8]


def test_kneser_ney_of_nothing(none, odd):
    model = kneser_ney.train(none)
    assert kneser_ney.perplexity(none, model).count() == 0
    assert all(math.isfinite(r.score) for r in kneser_ney.perplexity(odd, model).collect())


# 9


def shingle_set(t, k):
    w = tokens(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain_groups(rows, k, percent=80):
    """The smallest key that links reach; a key's rows are one document with several texts."""
    node = {}
    for i, t in rows:
        if i is not None:
            node.setdefault(i, []).append(shingle_set(t, k))
    up = {i: i for i in node}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(node)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in node[i] for b in node[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("turned", [False, True])
def test_a_key_with_two_texts_loses_no_link(spark, turned):
    text = lambda name, new=(): " ".join(f"new{i}" if i in new else f"{name}{i}" for i in range(101))
    rows = [(1, text("a")), (1, text("b")), (2, text("b", [50])), (3, text("a", [7])), (7, text("c")), (7, text("d")), (8, text("c", [1])), (5, text("d", [2])), (9, text("e"))]
    rows = rows[::-1] if turned else rows
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = setsketch.near_duplicates(df, k=2).collect()
    want = plain_groups(rows, 2)
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id) for r in got)
    assert want == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5, 8: 5, 9: 9}


def test_group_query_equals_sql(spark, duck, odd):
    import duckdb

    con = duckdb.connect()
    frame = odd.select("doc_id", "text").toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM frame")
    for want, df in ((con.execute(catalog.GROUPS_SQL).fetchall(), odd), (duck.execute(catalog.GROUPS_SQL).fetchall(), spark.read.parquet(f"{SF}/documents.parquet"))):
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in setsketch.near_duplicates(df, k=2).collect())


@pytest.mark.parametrize(("which", "k"), [("docs", 2), ("docs", 5), ("odd", 2), ("odd", 5), ("odd", 1)])
def test_groups_equal_all_pairs(which, k, request):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = plain_groups(rows, k)
    got = setsketch.near_duplicates(df, k=k).collect()
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(i), len(shingle_set(t, k))) for i, t in rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.component_id == r.doc_id)


@pytest.mark.parametrize(("small", "crowd"), [(2, 10**6), (10**6, 2), (3, 4)])
def test_groups_by_blocks(spark, monkeypatch, small, crowd):
    """A large component, crowded buckets and texts around the limit: blocks instead of pairs."""
    monkeypatch.setattr(setsketch, "SMALL", small)
    monkeypatch.setattr(setsketch, "CROWD", crowd)
    monkeypatch.setattr(setsketch, "ELEMENTS", 300)
    monkeypatch.setattr(setsketch, "ROUNDS", 1)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        t = list(base)
        for j in rng.sample(range(150), rng.randrange(1, 16)):
            t[j] = f"new{i}x{j}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(df, k=2).collect()}
    assert got == plain_groups(rows, 2)


def test_groups_of_nothing(none, odd):
    assert setsketch.near_duplicates(none).count() == 0
    left = setsketch.one_of_each(odd, k=2)
    assert left.columns == odd.columns
    assert {7, 16} & {r.doc_id for r in left.collect()} == set()


@pytest.mark.parametrize("most", [0, 10**6])
def test_one_row_of_each_group(spark, monkeypatch, most):
    """Rows that repeat a key, with equal, like and other texts, and rows with a null key."""
    monkeypatch.setattr(shared, "BROADCAST_BYTES", most)
    text = lambda name, new=0: " ".join(f"{name}{'new' if i < new else ''}{i}" for i in range(100))
    a, b, c, d = map(text, "abcd")
    rows = [(1, a), (1, a), (1, a), (2, a), (None, a), (3, b), (3, text("b", 2)), (4, c), (4, d), (None, text("e")), (None, text("e")), (None, text("e", 2)), (None, None), (5, None), (6, text("f"))]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(4)
    left = setsketch.one_of_each(df, k=5)
    assert left.columns == df.columns
    got = collections.Counter((r.doc_id, r.text.split()[-1][:1] if r.text else None) for r in left.collect())
    assert got == {(1, "a"): 1, (3, "b"): 1, (4, "c"): 1, (4, "d"): 1, (None, "e"): 1, (None, None): 1, (5, None): 1, (6, "f"): 1}


@pytest.mark.parametrize(("low", "high"), [(0, (1 << 63) - 1), (-(1 << 63), 0)])
def test_nodes_of_keys_at_the_ends(spark, low, high):
    df = spark.createDataFrame([(low, "x"), (low, "x"), (high, "y"), (high, "z"), (None, "x"), (7, "x")], "doc_id long, text string")
    rows = shared.own_nodes(df, "doc_id", "node").collect()
    assert len({r.node for r in rows}) == len(rows) == 6 and {low, high, 7} <= {r.node for r in rows}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 1 << 62, 900).astype(np.uint64), rng.integers(0, 1 << 62, 300).astype(np.uint64)
    one = np.zeros(1, int)
    x, y = setsketch.registers(a, one), setsketch.registers(b, one)
    assert (setsketch.registers(np.concatenate([a, b]), one) == np.maximum(x, y)).all()
    near = np.concatenate([a[:850], b[:50]])
    n = np.array([900])
    assert setsketch.likely(x, setsketch.registers(near, one), n, n, 0.8)[0]
    assert not setsketch.likely(x, setsketch.registers(np.concatenate([a[:400], b, a[:1] + np.arange(200, dtype=np.uint64)]), one), n, n, 0.8)[0]


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in random.Random(1).sample(range(n), n)], "u long, v long").unionAll(spark.createDataFrame([(1000, 2000), (2000, 1000), (5000, 5000)], "u long, v long"))
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 2000: 1000}


def test_few_rows_take_few_tasks(spark, monkeypatch):
    """However many shuffle partitions there are, tables of a few rows are not written by as many tasks."""
    files: dict[str, int] = {}

    def counted(df, name):
        table = shared.written(df, name)
        files[name] = max(files.get(name, 0), len(table.inputFiles()))
        return table

    monkeypatch.setattr(components, "written", counted)
    monkeypatch.setattr(setsketch, "written", counted)
    now = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in now}
    texts = [(i, " ".join(f"w{i // 3}x{j}" for j in range(40 + i % 3))) for i in range(600)]
    try:
        for name, value in now.items():
            spark.conf.set(name, value)
        found = setsketch.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), k=2).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {(r.doc_id, r.component_id) for r in found} == {(i, i // 3 * 3) for i in range(600)}
    most = 2 * spark.sparkContext.defaultParallelism
    assert {name: n for name, n in files.items() if name in ("shared", "buckets", "leaders", "pairs", "likely", "links", "edges", "large-star", "small-star") and n > most} == {}



# 10


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.arange(-500, 5000)
    for n in range(1, 20):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert ((a == b) | (b == n)).all() and a.min() >= 0 and a.max() < n
        assert abs((b == n).mean() - 1 / (n + 1)) < 0.03


def plain_jump(k, n):
    k &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        k = (k * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_shards(which, request):
    df = request.getfixturevalue(which)
    got = sharding.jump_shards(df).collect()
    facts = sorted((str(r.doc_id), r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got)
    one = lambda r: (str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), "key", *(plain_jump(-1 if r.doc_id is None else r.doc_id, n) for n in (16, 17)))
    assert facts == sorted(map(one, df.collect()))
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_tables(none):
    for f in (sharding.jump_shards, packing.length_buckets, quality.compression_bands, suffix_dedup.substring_dedup, setsketch.near_duplicates):
        assert f(none).count() == 0
