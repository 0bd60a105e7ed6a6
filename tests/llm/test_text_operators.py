"""Operators on texts against brute force and the tokenizer libraries."""
import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash

from tidebar.llm import op01_pu_classifier as pu
from tidebar.llm import op06_simhash as simhash
from tidebar.llm import op07_packing as packing
from tidebar.llm import op08_bpe_transducer as bpe
from tidebar.llm import op09_token_store as store
from tidebar.llm import op10_quality_rules as rules
from tidebar.llm.common import new_path, roots, written
from tidebar.llm.tokens import WordEncoder

GPT, CLIP, MULTI = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- quality rules

def measured(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    twice = {x for x, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_quality_measures(name, request):
    df = request.getfixturevalue(name)
    got = sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
                 for r in rows(rules.quality_report(df)))
    assert got == sorted((r["doc_id"] or -1, *measured(r["text"])) for r in rows(df.select("doc_id", "text")))


def test_quality_verdicts(spark, docs, labels, odd, none):
    judged = rules.quality_report(docs).join(labels, "doc_id")
    assert judged.filter("quality = 1 AND NOT base_failed AND NOT kept").count() == 0
    assert judged.filter("quality = 0 AND kept").count() <= 1
    kept = rules.quality_filter(odd)
    assert kept.columns == odd.columns and kept.count() == 0
    assert rules.quality_report(none).count() == 0


def test_repeats_when_leading_bits_clash(spark, monkeypatch):
    """With no hash bits left in the keys, order of (hash, words, position) decides, and counts stay exact."""
    monkeypatch.setattr(rules, "POSITION_BITS", 62)
    text = "a b c d a b c e f g e f h a b"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert rows(rules.quality_report(df))[0]["n_repeat_words"] == measured(text)[-1]


# ---- classifier

def test_classifier_separates_held_out_labels(docs, labels, spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = pu.scored_documents(big, known).join(known, "doc_id").filter("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert len(bad) and np.mean([g > b for g in good for b in bad]) > 0.98
    assert ((got.predicted == got.quality).mean()) > 0.95
    assert got.held_out.all() and all(zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id)


def test_classifier_reads_no_held_out_label(docs, labels):
    """Flipping the held-out labels changes no score."""
    flipped = labels.withColumn("quality", rules.F.when(pu.held_out(), 1 - rules.F.col("quality")).otherwise(rules.F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in rows(pu.scored_documents(docs, labels))}
    b = {r["doc_id"]: r["score"] for r in rows(pu.scored_documents(docs, flipped))}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_risk_against_plain_descent(spark):
    """The Newton steps reach the least non-negative risk that many small gradient steps on all rows reach."""
    rng, prior, ridge, n = np.random.default_rng(5), 0.6, 1e-3, 400
    good = rng.random(n) < 0.3
    x = rng.normal(size=(n, pu.SIZE)) + np.where(good | (rng.random(n) < 0.4), 0.4, -0.4)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in row], bool(g)) for i, (row, g) in enumerate(zip(x, good))], "doc_id long, x array<float>, good boolean").repartition(5)
    x = x.astype(np.float32).astype(np.float64)
    mean, scale, count, positives = pu._standard(df)
    assert (count, positives) == (n, good.sum()) and mean == pytest.approx(x.mean(0)) and scale == pytest.approx(x.std(0))
    z = np.concatenate([np.clip((x - x.mean(0)) / x.std(0), -8, 8), np.ones((n, 1))], axis=1)

    def risk(w):
        g = z @ w
        negative = np.logaddexp(0, g).mean() - prior * np.logaddexp(0, g[good]).mean()
        return prior * np.logaddexp(0, -g[good]).mean() + max(0.0, negative) + ridge * w @ w / 2, negative

    w, least = np.zeros(pu.SIZE + 1), np.inf
    for _ in range(6000):
        p = 1 / (1 + np.exp(-z @ w))
        value, negative = risk(w)
        least = min(least, value)
        slope = z.T @ p / n - prior * z[good].mean(0) if negative >= 0 else prior * z[good].T @ (p[good] - 1) / good.sum()
        w = w - 0.1 * (slope + ridge * w)
    found = pu._fit(df, mean, scale, prior, 30)
    assert risk(found)[0] <= least + 2e-3 and risk(found)[0] < risk(np.zeros(pu.SIZE + 1))[0]


def test_classifier_on_odd_rows(odd, none, labels):
    got = rows(pu.scored_documents(odd, labels))
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert pu.scored_documents(none, labels).count() == 0
    assert all(r["score"] == 0.5 for r in rows(pu.scored_documents(odd, labels.limit(0))))


def test_prior_of_one_mixture_at_every_size(spark):
    """Separated bad rows, 5% of all, one positive in four rows: the prior does not jump where rows are few."""
    weights = np.zeros(pu.SIZE + 1)
    weights[0] = 4.0
    model = pu.Model(weights, np.zeros(pu.SIZE), np.ones(pu.SIZE), 0.5)

    def prior(n):
        bad = n // 20
        x = [[-1.0 if i < bad else (i * 7919 % 1000) / 1000, *[0.0] * (pu.SIZE - 1)] for i in range(n)]
        return pu.class_prior(spark.createDataFrame([(v, i >= bad and i % 4 == 0) for i, v in enumerate(x)], "x array<float>, good boolean"), model)

    priors = [prior(n) for n in (200, 400, 4000)]
    assert all(abs(p - 0.95) < 0.03 for p in priors), priors


def test_small_and_large_draws_reject_the_same_texts(spark):
    """The first 40 documents, 4 of them planted bad, are in both draws of one mixture."""
    def text(i):
        rng = random.Random(i)
        if i % 10 == 0:
            return " ".join("".join(rng.choices("#$%&*{}|~0123456789", k=rng.randint(1, 30))) for _ in range(rng.randint(5, 60)))
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(rng.randint(20, 200))) + "."

    def rejected(n):
        docs = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string")
        known = spark.createDataFrame([(i, 1) for i in range(n) if i % 10 in (1, 4, 7)], "doc_id long, quality int")
        return {r["doc_id"] for r in rows(pu.scored_documents(docs, known)) if r["doc_id"] < 40 and not r["predicted"]}

    assert rejected(400) == rejected(3000) == {0, 10, 20, 30}


# ---- simhash

def reference_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reference_components(ids, fps):
    fps = np.array(fps, np.uint64)
    left, right = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    label, least = roots(len(fps), left, right), {}
    for i, d in zip(label, ids):
        least[i] = min(least.get(i, 1 << 62), 1 << 62 if d is None else d)
    return [least[i] for i in label]


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_simhash_against_all_pairs(name, request):
    df = request.getfixturevalue(name)
    plain = [(r["doc_id"], reference_fingerprint(r["text"])) for r in rows(df.select("doc_id", "text"))]
    want = sorted((d or -1, f"{f:016x}", c) for (d, f), c in zip(plain, reference_components(*zip(*plain))))
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in rows(simhash.near_duplicates(df))) == want


@pytest.mark.parametrize("blocks", [{}, {"home_rows": 6, "guest_rows": 5}])
def test_simhash_tree_finds_every_pair(spark, blocks):
    """Clusters of close fingerprints, small leaves and small blocks: same components as all pairs."""
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            fps.add(base)
            for _ in range(rng.randint(0, 3)):
                base ^= 1 << rng.randrange(64)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = written(spark.createDataFrame([(f,) for f in fps], "fp long"), "fps")
    got = [(r["a"], r["b"]) for r in rows(simhash.near_links(df, leaf_rows=16, sample=256, **blocks))]
    at = {f: i for i, f in enumerate(fps)}
    mine = roots(len(fps), np.array([at[a] for a, _ in got]), np.array([at[b] for _, b in got]))
    bits = np.array(fps, np.int64).view(np.uint64)
    left, right = np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3)
    assert (mine == roots(len(fps), left, right)).all()


def test_one_of_each(odd, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or -1 for r in rows(kept)) == [1, 4, 6, 7]  # the row without an id has the text of 7
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_one_of_each_with_repeated_and_null_ids(spark):
    """A doc_id on different texts, copies without an id, rows repeated whole: every text keeps one row, that of the least id."""
    a, b, c, d = ("the cat sat on the mat and slept", "seven ships left the port at dawn", "rain fell over the quiet hills", "a lone text")
    own = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (None, a, "x"), (None, c, "y"), (None, c, "x"), (3, b, "x"), (1, a, "x"), (1, a, "w"), (None, d, None)]
    kept = simhash.one_of_each(spark.createDataFrame(own, "doc_id long, text string, row string"))
    assert sorted((r["text"], r["doc_id"] or -1, r["row"] or "") for r in rows(kept)) == sorted([(a, 1, "w"), (b, 1, "x"), (c, -1, "x"), (d, -1, "")])


def test_one_of_each_stands_for_every_text(spark):
    """Every row lies in the component of a kept row, and no component keeps two, ids drawn with many repeats."""
    rng = random.Random(5)
    pool = [" ".join(rng.choices("red green blue sun moon star".split(), k=rng.randint(1, 12))) for _ in range(60)]
    own = [(rng.choice([None, *range(12)]), rng.choice(pool)) for _ in range(400)]
    got = [(r["doc_id"], r["text"]) for r in rows(simhash.one_of_each(spark.createDataFrame(own, "doc_id long, text string")))]
    texts = sorted({t for _, t in own})
    bits = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    left, right = np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3)
    group = dict(zip(texts, roots(len(texts), left, right).tolist()))
    want = {}
    for i, t in own:
        want[group[t]] = min(want.get(group[t], (True, 0)), (i is None, i or 0))
    assert sorted(group[t] for _, t in got) == sorted(want)
    assert all(want[group[t]] == (i is None, i or 0) and (i, t) in own for i, t in got)


# ---- tokens

@functools.cache
def library_of(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(path, text, end):
    return np.array(library_of(path).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.mark.parametrize("path,lead", [(GPT, True), (CLIP, False)])
def test_special_tokens_have_the_ids_that_the_library_gives(path, lead):
    """Inside, beside and across words, alone, twice, in other case; between texts without any."""
    texts = ["a <|endoftext|> b", "x<|endoftext|>y z", "<|endoftext|>", " <|endoftext|>", "one two", "", "a <|startoftext|><|endoftext|> \n c",
             "<|ENDOFTEXT|> d", "<|endof text|>", "the <|endoftext|", "three four <|endoftext|>"]
    ids, sizes = WordEncoder.get(path, lead).encode(pa.array(texts))
    for t, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert own.tolist() == library_of(path).encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("path,lead", [(GPT, True), (CLIP, False)])
def test_joined_words_have_the_ids_of_whole_texts(path, lead):
    rng = random.Random(7)
    pool = ["a", "The", "don't", "'s", "x'll", "(so)", "é", "e\u0301", "İ", "ß", "12", "3a4", "</w>", "<|endoftext|>", "Ġ", "日本", "🎉", "a-b.", "ﬁ",
            " ", "\t", "\n", "\u00a0", "\x1c", "\u2003", "\x7f"]
    texts = ["", " ", " a", "a  b"] + [" ".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(400)]
    encoder = WordEncoder(path, lead)
    ids, n = encoder.encode(pa.array(texts))
    ends = np.cumsum(n)
    for text, start, end in zip(texts, ends - n, ends):
        assert ids[start:end].tolist() == ids_of(path, text, 0)[:-1].tolist(), text


@pytest.mark.parametrize("name,weights", [("docs", None), ("odd", None), ("docs", {"src0": 0.5, "src1": 0.1})])
def test_packing_places_every_id_once(name, weights, request):
    df = request.getfixturevalue(name)
    df = df if name == "docs" else df.filter("doc_id <> 2 OR doc_id IS NULL")
    got = rows(packing.pack(df, GPT, weights))
    place = sorted((r["sequence_id"] * 1024 + r["offset"], r["length"]) for r in got)
    assert all(p + n == q for (p, n), (q, _) in zip(place, place[1:])) and place[0][0] == 0
    assert all(r["offset"] + r["length"] <= 1024 for r in got)
    by_doc = {}
    for r in sorted(got, key=lambda r: r["start"]):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, text in df.select("doc_id", "text").collect():
        ids, start = ids_of(GPT, text, 0), 0
        for r in by_doc[d]:
            assert r["start"] == start and r["doc_tokens"] == len(ids) and bytes(r["ids"]) == ids[start:start + r["length"]].tobytes()
            start += r["length"]
        assert start == len(ids)


def test_packing_keeps_the_mixture_in_every_window(docs):
    got = packing.pack(docs, GPT, window_sequences=8).toPandas()
    total = got.length.sum()
    share = got.groupby("source").length.sum() / total
    got["window"] = got.sequence_id // 8
    for w, part in got.groupby("window"):
        if w < got.window.max():
            assert (part.groupby("source").length.sum() - share.reindex(part.source.unique()) * 8192).abs().max() <= 2
    seq = packing.sequences(packing.pack(docs, GPT))
    assert {len(r["ids"]) for r in rows(seq.filter(f"sequence_id < {total // 1024}"))} == {4096}


def test_packing_of_nothing(none):
    assert packing.pack(none, GPT).count() == 0


def test_transducer_equals_tiktoken(docs):
    import tiktoken

    codec = bpe.Codec(MULTI, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.transducer.ranks, special_tokens={})
    rng = random.Random(3)
    pool = ["a", "the", " ", "  ", "\n", "é", "日", "🎉", "ing", "123", "'s", "\u00a0", "\x1c", "aaaa", "!!!", "Ω", "\t"]
    texts = [r["text"] or "" for r in rows(docs)] + ["".join(rng.choices(pool, k=rng.randint(0, 30))) for _ in range(1000)]
    texts += ["".join(rng.choices("abcdehilnorst", k=40)) for _ in range(500)]
    all_ids, lengths = codec.encode(pa.array(texts))
    for t, own in zip(texts, np.split(all_ids, np.cumsum(lengths)[:-1])):
        assert own.tolist() == library.encode_ordinary(t)
        assert "".join(codec.decode_text(own, 3)) == t


def test_utf8_stream_holds_back_unfinished_characters():
    text = "aé日🎉z" * 3
    for step in (1, 2, 3, 5):
        stream, raw = bpe.Utf8Stream(), text.encode()
        assert "".join([stream.feed(raw[i:i + step]) for i in range(0, len(raw), step)] + [stream.close()]) == text
    assert bpe.Utf8Stream().feed(b"\xff") == "\ufffd"


def test_round_trip(odd, none):
    got = {r["doc_id"]: r for r in rows(bpe.round_trip(odd, MULTI, P.PATTERN))}
    assert got[1]["n_tokens"] == 0 and got[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    for d, text in odd.select("doc_id", "text").collect():
        assert got[d]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(none, MULTI, P.PATTERN).count() == 0


def test_store_round_trip_and_lookup(spark, docs, odd, none):
    got = {r["doc_id"]: r for r in rows(store.stored_digest(docs, CLIP))}
    start = 0
    for d, text in sorted(docs.select("doc_id", "text").collect()):
        ids = ids_of(CLIP, text, 1)
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    folder = new_path(spark, "store")
    store.write(odd, folder, CLIP, shard_bytes=64)
    whole = rows(store.read(spark, folder).orderBy("start"))
    assert len(whole) == 8 and whole[0]["doc_id"] is None and [r["doc_id"] for r in whole[1:]] == [1, 2, 2, 3, 4, 6, 7]
    some = rows(store.lookup(spark, folder, spark.createDataFrame([(2,), (5,), (None,), (99,)], "doc_id long")).orderBy("start"))
    assert some == [r for r in whole if r["doc_id"] in (None, 2)]
    empty = new_path(spark, "store")
    store.write(none, empty, CLIP)
    assert store.read(spark, empty).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-1 << 62, 1 << 62, 5000))
    index = store.PerfectHash.build(keys)
    assert sorted(index.slots(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        store.PerfectHash.build(np.array([1, 1]))
