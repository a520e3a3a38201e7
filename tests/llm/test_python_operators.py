"""GIF, toxicity, packing, top-k, pages and substring removal: round trips, brute force and edge cases."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import gif, packing, pages, substrings, topk, toxicity


# ---------------------------------------------------------------- GIF


@pytest.mark.parametrize("n", [0, 1, 255, 3837, 3838, 3839, 3840, 7700, 50_000])
@pytest.mark.parametrize("kind", ["same", "random", "text"])
def test_lzw_round_trip(n, kind):
    r = random.Random(n)
    data = bytes(n) if kind == "same" else r.randbytes(n) if kind == "random" else (b"the quick brown fox " * (n // 20 + 1))[:n]
    samples, whole = gif.lzw_decode(gif.lzw_encode(data), 8, n)
    assert samples.tobytes() == data and whole


def test_gif_disposal_transparency_interlace_and_local_palettes():
    def frame(pixels, w, h, left, top, disposal, hidden=None, local=None, interlaced=False):
        control = b"\x21\xf9\x04" + bytes([disposal << 2 | (hidden is not None), 5, 0, hidden or 0, 0])
        flags = (0x40 if interlaced else 0) | (0x81 if local else 0)
        body = b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([flags]) + (bytes(local) if local else b"")
        stream = gif.lzw_encode(bytes(pixels), 2)
        return control + body + b"\x02" + bytes([len(stream)]) + stream + b"\0"

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + (2).to_bytes(2, "little") + (2).to_bytes(2, "little") + bytes([0x81, 0, 0]) + palette
    data = head + frame([1, 1, 1, 1], 2, 2, 0, 0, 1) + frame([2, 3], 2, 1, 0, 0, 3, hidden=3) + frame([2], 1, 1, 1, 1, 2) + frame([1, 0, 0, 1], 2, 2, 0, 0, 1, local=[9, 9, 9, 8, 8, 8] + [0] * 6, hidden=0, interlaced=True) + b"\x3b"
    shown = [(f.start_ms, f.canvas[:, :, :].copy().tolist(), f.ok) for f in gif.decode(data)]
    red, green, grey = [255, 0, 0, 255], [0, 255, 0, 255], [8, 8, 8, 255]
    assert [s for s, _, _ in shown] == [0, 50, 100, 150] and all(ok for *_, ok in shown)
    assert shown[0][1] == [[red, red], [red, red]]
    assert shown[1][1] == [[green, red], [red, red]]  # index 3 is not drawn
    assert shown[2][1] == [[red, red], [red, green]]  # the second frame is taken back
    assert shown[3][1] == [[grey, red], [red, grey]]  # the third frame's pixel is cleared and drawn anew; index 0 is not drawn
    first = frame([1, 1, 1, 1], 2, 2, 0, 0, 1)
    half = list(gif.decode(head + first + frame([2, 2, 2, 2], 2, 2, 0, 0, 2)[:-4]))
    assert [(f.index, f.ok) for f in half] == [(0, True), (1, False)] and len(list(gif.decode(head + first))) == 1 and list(gif.decode(b"no gif")) == []


def test_gif_headers_cannot_ask_for_a_tasks_memory(spark):
    wide = b"GIF89a" + b"\xff\xff\xff\xff" + bytes([0, 0, 0])
    frame = b"GIF89a" + b"\x01\x00\x01\x00" + bytes([0, 0, 0]) + b"\x2c" + bytes(4) + b"\xff\xff\xff\xff" + b"\x00\x02\x01\x00\x00"
    df = spark.createDataFrame([(1, wide), (2, frame), (3, None)], "doc_id long, media binary")
    assert [(x.doc_id, x.frame, x.ok, len(x.rgba)) for x in gif.frames(df, "doc_id", "media").orderBy("doc_id").collect()] == [(1, 0, False, 0), (2, 0, False, 0)]
    assert [x.ok for x in gif.digests(df, "doc_id", "media").collect()] == [False, False, None]


def test_gif_columns_round_trip_any_text(spark):
    texts = [None, "", "a", "é" * 64, "x" * 5_000_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in gif.round_trip(docs, "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw.ljust(-(-max(len(raw), 1) // 64) * 64, b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.ok and r.n_frames == max(1, -(-len(padded) // 64 // gif.FRAME_ROWS))
    assert got[5].media_sha256 == got[6].media_sha256
    assert gif.round_trip(docs.where("false"), "doc_id", "text").collect() == []
    stored = gif.store_payload(docs.where("doc_id in (2, 4)"), "doc_id", "text")
    frames = gif.frames(stored, "doc_id", "media").collect()
    assert sum(f.doc_id == 4 for f in frames) == 5 and all(sum(f.histogram) == f.width * len(f.rgba) // 4 // f.width for f in frames)
    assert gif.digests(docs, "doc_id", "media").where("ok").count() == 0


# ---------------------------------------------------------------- toxicity


def test_toxicity_learns_stems_and_scores_odd_texts(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice(["ba", "ke", "lo", "mi", "nu", "ta"]) for _ in range(r.randrange(1, 4)))
    bad = ["worthless", "grumblor", "snarkwit"]
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(r.randrange(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(bad)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (902, "12 34", "x"), (903, "grumblorr worthlesss snarkwitt me", "x"), (904, "ba " * 50_000, "x")], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (3, None), (8, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.95
    assert got[903].predicted == 1  # misspellings that no row has
    neutral = 1 / (1 + np.exp(-model.bias))
    assert got[900].score == got[901].score == got[902].score == neutral < 0.3 and got[904].predicted == 0
    assert all(0 <= x.score <= 1 for x in got.values())
    again = {x.doc_id: x.score for x in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    assert again == {k: x.score for k, x in got.items()}
    twice = docs.unionByName(docs.withColumn("text", F.concat(F.lit("zz "), "text"))).withColumn("_label", F.lit(7)).withColumn("label", F.lit(8)).withColumn("id", F.lit(9))
    assert toxicity.fit(twice, known).parts is not None  # repeated ids, and names of helper columns
    clean = toxicity.keep_clean(docs.withColumn("predicted", F.lit("mine")).withColumn("row", F.lit(1)), model)
    assert clean.columns == [*docs.columns, "predicted", "row"] and {(x.predicted, x.score) for x in clean.collect()} == {("mine", "x")} and clean.where("doc_id = 903").count() == 0
    nothing = toxicity.fit(docs, known.where("false"))
    assert {x.score for x in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), model).collect() == []


def brute_score(model, text):
    """The soft maximum over passages of the mean over words of the mean of their n-grams' parts, n-gram by n-gram."""
    base, mask = int(toxicity._BASE), (1 << 64) - 1
    values, words = [], re.findall(r"[^\W\d_]+", text.lower())

    def bucket(points, size=0):
        h = 0
        for p in points:
            h = (h * base + p + 1) & mask
        return int(toxicity.mix(np.array([(h + (size << 56)) & mask], dtype=np.uint64))[0] % toxicity.BUCKETS)

    for w in words:
        framed = [60, *map(ord, w), 62]
        found = [bucket(map(ord, w))] + [bucket(framed[i : i + k], k) for k in toxicity.SIZES for i in range(len(framed) - k + 1)]
        values.append(np.mean([model.parts[b] for b in found]))
    passages = np.arange(len(values)) * -(-len(values) // toxicity.PASSAGE) // max(len(values), 1)
    logits = [toxicity.GAIN * np.mean(np.array(values)[passages == k]) + model.bias for k in sorted(set(passages.tolist()))]
    return 1 / (1 + np.exp(-(np.log(np.sum(np.exp(toxicity.SHARP * np.array(logits)))) / toxicity.SHARP if logits else model.bias)))


def test_scores_match_a_plain_version(monkeypatch):
    r = np.random.default_rng(2)
    model = toxicity.Model(r.normal(0, 0.05, toxicity.BUCKETS), -1.0)
    texts = ["", "12 - 34", "One two, THREE four5six", "ça ira \u0394\u03b5 x", "a " * 500 + "end", "longer words here " * 30]
    expected = [brute_score(model, t) for t in texts]
    assert np.allclose(model.scores(texts), expected, atol=1e-12)
    parts = " ".join(["abcde"] * toxicity.PASSAGE * 3)  # parts of whole passages
    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 6 * toxicity.PASSAGE - 1)
    assert np.allclose(model.scores([*texts[:4], parts]), [*expected[:4], brute_score(model, parts)], atol=1e-12)


def test_a_samples_sums_match_dense_products(monkeypatch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(1, 7)))
    texts = [" ".join(word() for _ in range(r.choice([0, 3, 40, 200]))) for _ in range(60)]
    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 300)  # texts in parts, and words known from other chunks
    monkeypatch.setattr(toxicity, "BLOCK", 50)  # texts go on in other blocks
    sample = toxicity.Sample(texts)
    shares, counts, held, text_of, keys = [], [], [], [], {}
    for i, t in enumerate(texts):
        for part in toxicity.in_parts(t):
            b = toxicity.bag([part])
            if not len(b.keys):
                continue
            for j, n in enumerate(np.append(b.starts[1:], len(b.flat))):
                keys.setdefault(int(b.keys[j]), np.bincount(b.flat[b.starts[j] : n], minlength=toxicity.BUCKETS)[sample.buckets])
            passage, _ = toxicity.passages(b.text_of)
            for p in range(passage[-1] + 1):
                found = [int(k) for k in b.keys[b.word_of[passage == p]]]
                shares.append({k: found.count(k) / len(found) for k in found})
                text_of.append(i)
    names, counts = list(keys), np.array(list(keys.values()))
    share = np.array([[s.get(k, 0.0) for k in names] for s in shares])
    assert sample.text.tolist() == text_of and len(text_of) == sample.n_passages > len(texts) and len(names) == len(sample.n_grams)
    mean = counts / counts.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(1)
    vectors, error = rng.normal(size=(2, counts.shape[1])), rng.normal(size=(2, len(share)))
    assert np.allclose(sample.forward(vectors), toxicity.GAIN * vectors @ mean.T @ share.T)
    assert np.allclose(sample.backward(error), toxicity.GAIN * error @ share @ mean)
    fitted = np.array(text_of) % 3 > 0
    filled = ((share[fitted] ** 2).sum(axis=0) / counts.sum(axis=1) ** 2) @ counts
    held = sum((share[np.array(text_of) == i].sum(axis=0) > 0).astype(int) for i in range(60) if i % 3) @ counts
    usual = np.median((filled / np.maximum(held, 1))[held >= 2])
    expected = 1 / np.sqrt(filled + toxicity.DAMPING * usual)
    assert np.allclose(sample.reach(fitted), expected / expected.max())


def test_the_fit_stays_out_of_the_drivers_memory(spark):
    """Texts of 5 MB: what the driver's Python holds at once is the fitted numbers, not the texts or what is made of them."""
    made = "concat_ws(' ', transform(sequence(1, 4000), i -> translate(substr(md5(concat((id * 4000 + i * i) % 9973, '')), 1, 4 + i % 5), '0123456789', 'ghijklmnop')))"
    docs = spark.range(200).selectExpr("id doc_id", f"concat(if(id % 4 = 0, repeat('grumblor ', 200), ''), {made}) text").cache()
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 = 0) toxic")
    assert docs.selectExpr("sum(length(text))").first()[0] > 5_000_000
    tracemalloc.start()
    try:
        model = toxicity.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6
    rows = docs.where(~toxicity.held_out()).orderBy("doc_id").collect()
    plain = toxicity.train([x.text for x in rows], [int(x.doc_id % 4 == 0) for x in rows])
    assert np.allclose(model.parts, plain.parts, rtol=1e-9, atol=1e-12) and np.isclose(model.bias, plain.bias)
    docs.unpersist()


def test_toxicity_in_a_hard_sample():
    """Few toxic words in texts of up to 1,000 words of a rich vocabulary, some labels wrong: held-out rows, several seeds."""
    for seed in (1, 2):
        r = random.Random(seed)
        parts = ["ba", "ke", "lo", "mi", "nu", "ta", "re", "sho", "win", "dra", "fel", "gus"]
        word = lambda: "".join(r.choice(parts) for _ in range(r.randrange(1, 6)))
        bad = ["vexling", "grumblor", "snarkwit", "toadish", "muckhead"]
        texts, labels = [], []
        for _ in range(700):
            words = [word() for _ in range(r.choice([30, 100, 300, 1000]))]
            toxic = r.random() < 0.15
            if toxic:
                for _ in range(2 + len(words) // 100):
                    words[r.randrange(len(words))] = r.choice(bad)
            texts.append(" ".join(words))
            labels.append(int(toxic) if r.random() > 0.01 else 1 - int(toxic))
        model = toxicity.train(texts[:500], labels[:500])
        scores, truth = model.scores(texts[500:]), np.array(labels[500:])
        assert (scores[truth == 1] >= 0.5).mean() > 0.85 and (scores[truth == 0] >= 0.5).mean() < 0.04


# ---------------------------------------------------------------- packing


def test_differencing_balances_and_keeps_every_length():
    r = np.random.default_rng(1)
    for n, k in ((1, 1), (7, 3), (200, 12), (50, 50)):
        lengths = r.integers(1, 500, n)
        window = packing.difference(lengths, k)
        sums = np.bincount(window, weights=lengths, minlength=k)
        assert len(window) == n and sums.sum() == lengths.sum()
        if n == 200:
            assert sums.max() - sums.min() < 20
    assert packing.windows(np.array([2048, 2048, 1])).max() == 2  # the count rises beyond the least
    equal = packing.windows(np.full(2000, 211))
    assert np.bincount(equal).max() == 9 and 222 <= len(np.unique(equal)) <= 235  # nine of 211 ids fill a window


def test_packing_deals_out_repeated_rows_and_long_documents(spark, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "GROUP_DOCS", 64)
    monkeypatch.setattr(packing, "SPAN", 4)
    docs = spark.range(3000).select(F.lit(5).alias("doc_id"), F.lit("the same words here").alias("text")).unionByName(spark.createDataFrame([(6, "word " * 60_000)], "doc_id long, text string"))
    rows = packing.pack(docs, public.path("word_bpe_49k.json")).groupBy(F.shiftright("sequence_id", 32).alias("group")).agg(F.count("*").alias("n"), F.sum("length").alias("ids"), F.max("doc_id").alias("doc")).collect()
    assert len(rows) > 50 and max(x.n for x in rows) < 200 and sum(x.ids for x in rows) == 3000 * 5 + 60_001


def test_long_texts_are_encoded_in_segments(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "SEGMENT_CHARS", 20)
    text = "  Some Words, don't  \n stop <|endoftext|> here  nor there " * 5 + "x" * 50
    parts = packing.segments(text)
    assert "".join(parts) == text and len(parts) > 8
    assert b"".join(packing.WordIds(path).encode(parts)) == np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class CountingTokenizer:
    """A tokenizer that keeps count of the words it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, 0

    def encode(self, text, **options):
        self.words += len(text.split())
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.words += sum(len(text.split()) for text in texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def word_coder(texts):
    """A coder that counts, and the ids it has to give."""
    public = pytest.importorskip("public_tokenizers")
    coder = packing.WordIds(public.path("word_bpe_49k.json"))
    whole = [np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    coder.tokenizer = CountingTokenizer(coder.tokenizer)
    return coder, whole


def test_letters_are_encoded_once_whatever_the_marks_around_them():
    stems = [a + b + c for a in "bdfglmnpr" for b in ("an", "el", "É") for c in "kstz"]
    texts = [" ".join(f"{before}{stem}{after}" for stem in stems) for before in ("", "(", "$$") for after in ("", ".", "###", ",&&&", "...")]
    texts.append("don't bank's <bank> bank's### <|endoftext|>Bank İbank e\u0301bank=\u0338 bank2###")
    coder, whole = word_coder(texts)
    assert coder.encode(texts[:7]) + coder.encode(texts[7:]) == whole
    assert coder.tokenizer.words <= len(stems) + 20


def test_words_in_use_stay_known_when_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_PARTS", 400)
    letters = "abcdefghij"
    used = [f"the{a}{b}" for a in letters for b in letters]
    rare = [[f"{a}rare{b}{c}" for b in letters for c in "klmnopqr"] for a in letters]
    texts = [" ".join(used + words) for words in rare]
    coder, whole = word_coder(texts)
    assert [coder.encode([text])[0] for text in texts] == whole
    assert coder.tokenizer.words == len(used) + sum(map(len, rare)) and len(coder.parts) <= 400


def test_letters_that_end_in_no_word_ending_id_are_encoded_one_by_one():
    coder, whole = word_coder(["some words (here) and there", ""])
    coder.ends[:] = False
    assert coder.encode(["some words (here) and there", ""]) == whole and coder.encode([]) == []


def test_packing_covers_every_id_once(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    r = random.Random(5)
    texts = [None, "", "don't I'LL <|endoftext|> x", "İ ß é 日本。", "word " * 9000, *(" ".join(r.choice(["alpha", "Beta,", "gamma.", "δ", "42"]) for _ in range(r.randrange(1, 900))) for _ in range(40)), "twice", "twice"]
    docs = spark.createDataFrame([(min(i, len(texts) - 2), t, 0) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    rows = packing.pack(docs, path).collect()
    ids = {i: np.array(coder.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_sequence.setdefault(x.sequence_id, []).append(x)
        part = ids[x.doc_id][x.start : x.start + x.length]
        assert len(part) == x.length and zlib.crc32(part.tobytes()) == x.ids_crc32 and x.doc_tokens == len(ids[x.doc_id])
    for i, own in by_doc.items():
        times = 2 if i == len(texts) - 2 else 1
        assert sum(x.length for x in own) == times * len(ids[i])
    for own in by_sequence.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= packing.CAPACITY
    assert packing.pack(docs.where("false"), path).collect() == []


# ---------------------------------------------------------------- top-k


def test_topk_matches_brute_force_with_ties_and_bad_vectors(spark, monkeypatch):
    r = np.random.default_rng(4)
    vectors = [(int(i), [float(x) for x in r.normal(size=12).astype(np.float32)]) for i in range(300)]
    vectors += [(1000 + i, vectors[i][1]) for i in range(40)]  # equal vectors tie
    vectors += [(2000, None), (2001, [1.0, None] + [0.0] * 10), (2002, [float("nan")] + [0.0] * 11), (2003, [float("inf")] * 12), (2004, [1.0, 2.0]), (2005, [3.0, 1.0]), (2006, []), (2007, []), (2010, [0.0] * 12)]
    df = spark.createDataFrame([(i, v, 7) for i, v in vectors], "vec_id long, embedding array<float>, score int")
    got = {}
    for x in topk.search(df, df.where("vec_id % 10 = 0"), k=5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    fine = {i: np.floor(256 * np.array(v, dtype=np.float64)).astype(int) for i, v in vectors if v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all()}
    for q in (i for i in fine if i % 10 == 0):
        best = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:5]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.search(df.where("false"), df.where("false")).collect() == []
    small = lambda: sorted(tuple(x) for x in topk.search(df.where("vec_id < 400"), df.where("vec_id % 3 = 0"), k=3).collect())
    whole = small()
    monkeypatch.setattr(topk, "ROWS", 50)
    monkeypatch.setattr(topk, "QUERIES", 20)
    assert small() == whole
    repeated = df.where("vec_id = 1").unionByName(df.where("vec_id in (1, 7, 1001)"))
    assert [(x.rank, x.vec_id) for x in topk.search(repeated, df.where("vec_id = 1001"), k=2).orderBy("rank").collect()] == [(1, 1), (2, 1)]


# ---------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div><!-- c -->
<article><header><h2>Head&amp;line</h2></header><p><b>First   &quot;one&quot;<br>two<p>Second&nbsp;<i>thi</i>rd</p><aside>Side</aside><form><input>Sign</form><div id="cookie-notice">Cookies</div><ul><li>a<li>b</ul>
<section class="comments"><p>Reader says</p></section></article><footer>&copy; foot</footer></body></html>"""


def test_main_text_follows_the_markup():
    assert pages.main_text(pages.lines(PAGE)) == 'Head&line\nFirst "one" two\nSecond third\na\nb'
    assert pages.main_text(pages.lines("")) == "" and pages.lines("<p title='a>b'>x</p") == [(pages.OPEN, "x")]


def made_page(r):
    """A page of known parts in random order and nesting, and the text of its article."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 8)))
    space = lambda: r.choice([" ", "  ", "\n", "\t ", "&#32;", "<br>", "<br/> "])
    marks = {"&amp;": "&", "&lt;b&gt;": "<b>", "&eacute;": "é", "&#x2019;": "\u2019", "&quot;": '"', "AT&T": "AT&T"}
    noise = lambda: " ".join(word() for _ in range(r.randrange(1, 6)))

    def run():
        source, plain = [], []
        for _ in range(r.randrange(1, 7)):
            shown = r.choice(list(marks)) if r.random() < 0.2 else word()
            tag = r.choice(["", "", "", "b", "em", "span", "a", "code"])
            opened = {"": "", "a": '<a href="/x?a=1&amp;b=2">', "span": '<span class="hl">'}.get(tag, f"<{tag}>")
            source.append(f"{opened}{shown}</{tag}>" if tag else shown)
            plain.append(marks.get(shown, shown))
        return "".join(x + space() for x in source[:-1]) + source[-1], " ".join(plain)

    blocks, text = [], []
    for _ in range(r.randrange(1, 6)):
        kind = r.choice(["p", "h2", "blockquote", "ul", "div", "table"])
        if kind == "ul":
            items = [run() for _ in range(r.randrange(1, 4))]
            blocks.append("<ul>" + "".join(f"<li>{x}" + r.choice(["", "</li>"]) for x, _ in items) + "</ul>")
            text += [t for _, t in items]
        elif kind == "table":
            (x, t), (y, u) = run(), run()
            blocks.append(f"<table><tr><td>{x}</td><td>{y}</td></tr></table>")
            text.append(f"{t} {u}")
        else:
            x, t = run()
            blocks.append(f"<{kind}>{x}</{kind}>")
            text.append(t)
        blocks.append(r.choice(["", "", "<!-- <p>no</p> -->", f"<script>x = '<p>{noise()}</p>'</script>", f"<aside>{noise()}</aside>", f'<div class="ad-slot">{noise()}</div>', f"<form><label>{noise()}</label><input></form>"]))
    before = [f"<header><h1>{noise()}</h1></header>", f"<nav><a>{noise()}</a></nav>", f'<div class="cookie-notice">{noise()}</div>', f"<style>p {{ {noise()} }}</style>"]
    after = [f"<footer><p>{noise()}</p></footer>", f'<div class="sidebar"><p>{noise()}</p></div>', f'<section class="comments"><article>{noise()}</article></section>', f"<aside>{noise()}</aside>"]
    r.shuffle(before), r.shuffle(after)
    wrap = r.choice(["{}", "<main>{}</main>", '<div class="layout has-sidebar">{}</div>'])
    article = r.choice(["<article>{}</article>", '<article class="post">{}</article>']).format("".join(blocks))
    return "<!DOCTYPE html><html><head><title>" + noise() + "</title></head><body>" + "".join(before) + wrap.format(article) + "".join(after) + "</body></html>", "\n".join(text)


@pytest.mark.parametrize("seed", range(60))
def test_made_pages_give_back_their_article(seed):
    page, text = made_page(random.Random(seed))
    assert pages.main_text(pages.lines(page)) == text


def test_differencing_matches_a_plain_version(spark):
    r = random.Random(12)
    rows = []
    for host in ("a.example", "b.example"):
        menu = [f"{host} menu {i}" for i in range(6)]
        for i in range(25):
            body = [f"{host} own {i}.{j}" for j in range(r.randrange(0, 5))]
            lines = [x for x in menu if r.random() < 0.7] + body + ([f"{host} foot"] if r.random() < 0.8 else [])
            rows.append((len(rows), f"http://{host}/{r.randrange(3)}/{i:02}", lines))
    expected = {}
    for i, url, lines in rows:
        same = sorted((u, n) for n, u, _ in rows if u.split("/")[2] == url.split("/")[2])
        at = same.index((url, i))
        shared = set()
        for _, n in same[max(at - 1, 0) : at] + same[at + 1 : at + 2]:
            other = rows[n][2]
            if common := set(lines) & set(other):  # all in one order, so the longest common subsequence is what both have
                shared |= common if len(common) < len(lines) else set()
        expected[i] = "\n".join(x for x in lines if x not in shared)
    df = spark.createDataFrame([(i, u, "".join(f"<div>{x}</div>" for x in lines)) for i, u, lines in rows], "page_id long, url string, html string")
    assert {x.page_id: x.text for x in pages.extract(df).collect()} == expected


def test_open_pages_lose_the_lines_that_neighbours_share(spark):
    page = lambda *body: "".join(f"<p>{x}</p>" for x in body)
    rows = [
        (1, "http://h.example/a/1", page("Home | About", "one", "Terms")), (2, "http://h.example/a/2", page("Home | About", "two", "more", "Terms")), (3, "http://h.example/a/3", page("Home | About", "three", "Terms")),
        (4, "http://other.example/a/1", page("Home | About", "alone")), (5, "http://copy.example/1", page("x", "y")), (6, "http://copy.example/2", page("x", "y")), (7, None, None), (8, "odd", "<article>art</article>"), (8, "odd", "<article>art</article>"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {}
    for x in pages.extract(df).collect():
        got.setdefault(x.page_id, []).append(x.text)
    assert got == {1: ["one"], 2: ["two\nmore"], 3: ["three"], 4: ["Home | About\nalone"], 5: ["x\ny"], 6: ["x\ny"], 7: [""], 8: ["art", "art"]}
    assert pages.extract(df.where("false")).collect() == []


def test_articles_in_dropped_wrappers_are_kept():
    text = lambda page: pages.main_text(pages.lines(page))
    for wrapper in ('div class="layout has-sidebar"', 'div class="page header-fixed"', 'div id="nav-open"', 'form action="/x"', 'div class="related-layout"'):
        name = wrapper.split()[0]
        assert text(f"<{wrapper}><nav>Menu</nav><article><p>Body<form>Sign</form></article></{name}><footer>Foot</footer>") == "Body"
        assert text(f"<main><{wrapper}><article>Body</article></{name}></main>") == "Body"
        assert text(f"<{wrapper}><nav>Menu</nav><div><p>Body</div></{name}>") == "Body"  # nothing else on the page
    assert text('<article>Body</article><section class="comments"><article>Reader</article></section><div class="related"><article>Teaser</article></div>') == "Body"
    assert text('<aside><article>Side</article></aside><div hidden><main>Hidden</main></div><div class="ads"><main>Body</main></div>') == "Body"
    assert text('<form><article class="comment">Reader</article><article class="post has-comments">Body</article></form>') == "Body"


def test_open_lines_beside_main_lines_are_differenced(spark):
    page = lambda x: f"<div>Home | About</div><div>Headline {x}</div><div>Body {x}</div><article>Teaser {x}</article>"
    rows = [(i, f"http://h.example/a/{i}", page(i)) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in pages.extract(df).collect()} == {i: f"Headline {i}\nBody {i}\nTeaser {i}" for i in range(3)}
    same = [(i, f"http://h.example/a/{i}", f"<div>Home</div><article>Text {i}</article>") for i in range(2)]
    df = spark.createDataFrame(same, df.schema)  # a neighbour with the same open lines is no copy if its article differs
    assert {x.page_id: x.text for x in pages.extract(df).collect()} == {0: "Text 0", 1: "Text 1"}


def test_common_lines_is_a_longest_common_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = [r.randrange(5) for _ in range(r.randrange(12))], [r.randrange(5) for _ in range(r.randrange(12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pages.common_lines(a, b)) == best[-1][-1]


# ---------------------------------------------------------------- substrings


def brute_removed(rows, n):
    holders = {}
    words = {k: (t or "").encode().split() for k, t in rows}
    for k, w in words.items():
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            holders[key] = min(holders.get(key, k), k)
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if holders[tuple(w[i : i + n])] < k:
                gone |= set(range(i, i + n))
        out[k] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def test_substring_removal_matches_brute_force(spark):
    r = random.Random(7)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(60):
        w = [f"w{r.randrange(30)}" for _ in range(r.randrange(0, 60))]
        if r.random() < 0.5:
            at, a = r.randrange(len(w) + 1), r.randrange(15)
            w[at:at] = passage[a : a + r.randrange(5, 15)]
        rows.append((i, r.choice([" ", "\n", "\t  "]).join(w)))
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, "long " * 50_000), (104, "long " * 100), (105, " nbsp is no space " * 3)]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, kept string")
    got = {x.doc_id: (x.n_words, sum(s.end - s.start for s in x.intervals), x.kept) for x in substrings.deduplicate(docs, length=6).collect()}
    assert got == brute_removed(rows, 6)
    assert substrings.deduplicate(docs.where("false")).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "a b c d e f g")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.kept) for x in substrings.deduplicate(odd, length=6).collect()) == [(0, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "")]
