"""Each operator against plain loops, an exact library, or held-out labels, on odd rows and on the small tables."""

import random
import re
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wayfold.llm import decontamination, html_extraction, language_model, ngram_join, pii, quality_classifier, queries, sentencepiece_codec, substring_dedup, suffix_dedup, topk
from wayfold.llm.components import components

LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud"
ODD = [
    "", None, " ", "a", "a" * 500, "ab" * 400, "b" * 150 + "a" * 500, "é" * 300, "日本語テキスト😀 " * 30, LOREM, LOREM.upper(), "x " + LOREM, LOREM + " y", LOREM.replace("sit", "sat"), LOREM, "\x00a\x01b", "\n\n\t\n",
    " ".join(f"w{i}" for i in range(3000)), "zz " * 200, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1", "4023 8463-26752053 +1 (953) 555-3362x", "é😀 x@y.zz 😀 4023846326752053", "password=abc123def456 token = \"0641917ea4e9feb9cda83477b57ac2654884f485\"",
    "▁a  b <s> <0x0A> </s>",
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts twice over, once as repeated rows, beside columns whose names the operators use themselves."""
    rows = [(i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows + rows[8:12], "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("node", "row", "words", "held_out", "score", "bands", "starts", "key_id", "text_code", "runs", "spans", "clean")}).repartition(3)


def pairs(df):
    return sorted({(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}, key=lambda x: x[0])


def empty(docs):
    return docs.where(F.lit(False))


def test_topk(spark):
    random.seed(4)
    vectors = [(i, [random.choice([0.5, -0.25, 0.1, 1e-4]) for _ in range(4)]) for i in range(300)]
    vectors += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 360)]
    vectors += [(400, None), (500, [0.1, None, 0.2, 0.3]), (600, [0.1, float("nan"), 0.2, 0.3]), (700, [float("inf")] * 4), (800, []), (900, [1e20, 1.0, 1.0, 1.0]), (None, [0.5] * 4), (1000, [0.5] * 5)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(5)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df.where("vec_id < 400 OR vec_id > 900 OR vec_id IS NULL OR vec_id IN (400, 500, 600, 700, 800)"), "id % 20 = 0").collect()}
    good = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors if i is not None and i != 900 and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in good:
        if q % 20 == 0:
            scored = sorted((-int(good[q] @ good[c]), c) for c in good if c != q and len(good[c]) == len(good[q]))
            want |= {(q, k): (c, -s) for k, (s, c) in enumerate(scored[:10], 1)}
    assert got == want
    assert topk.top_k(empty(df), "id % 20 = 0").count() == 0


def test_sentencepiece(spark, docs, odd):
    own = sentencepiece_codec.codec(queries.piece_model())
    random.seed(1)
    texts = [t or "" for t in ODD] + ["".join(random.choice("ab ▁\nétheion T%x1😀中") for _ in range(random.randint(0, 60))) for _ in range(500)]
    assert own.encode_batch(texts) == [own.by_library(t) for t in texts]
    for df in (docs, odd):
        out = sentencepiece_codec.encode_and_decode(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
        texts = dict(pairs(df))
        assert len(out) == df.count()
        for r in out:
            n, ids, decoded = own.by_library(texts[r.doc_id] or "")
            assert (r.n_tokens, r.ids, r.decoded, r.ids_sha256, r.decoded_sha256) == (n, ids, decoded, plain.sha(ids.encode()), plain.sha(decoded.encode()))
    assert sentencepiece_codec.encode_and_decode(empty(docs), queries.piece_model()).count() == 0


def test_html(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    truth = lambda h: " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", h)[1])).split())
    page = {r.page_id: r.html for r in pages.collect()}
    for r in html_extraction.extract_text(pages).collect():
        assert r.text == truth(page[r.page_id]) and r.n_chars == len(r.text)
    without_article = """<html><head><title>T</title></head><body><div class="cookie-notice">We use cookies to be the best for you and your friends on the site, so please accept them.</div>
    <div id=menu><a href=x>Home</a> <a>News</a></div><div><h1>A title &amp;amp; more</h1><p>This is the first paragraph of the article&nbsp;and it has many of the stop words that we want to see in a real text.</p><p>Short one.</p>
    <p>And then there was the second long paragraph with all that one would want to read in this place on the web, and more.</p></div><form><p>Subscribe to our list and you will be the first to know.</p></form>
    <div id="comments"><p>I think that this is the best of the articles that I have read on this site, thank you for it and more.</p></div><script>if (a < b) { "<p>" }</script></body></html>"""
    text = html_extraction.extract(without_article)
    assert text.startswith("A title &amp; more This is the first") and "Short one. And then" in text and text.endswith("and more.")
    assert all(w not in text for w in ("cookies", "Home", "Subscribe", "thank you", "<p>"))
    for broken in ("", "<", "<<>>", "<a " * 3000, "<p>" * 3000, "<!-- ", "<script>x", "&#x110000; &bogus;", "<nav>never closed <p>x"):
        html_extraction.extract(broken)
    rows = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>x")], "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    assert [(r.text, r.n_chars) for r in html_extraction.extract_text(rows).collect()] == [("", 0)] * 3
    assert html_extraction.extract_text(empty(pages)).count() == 0


def test_decontamination(spark, docs, odd, sf_dir):
    items = [(1, " ".join(LOREM.split()[3:17])), (2, "Sit AMET"), (3, ""), (4, None), (None, "w7 w8 w9"), (10, "sit amet"), (11, "a"), (12, "zz " * 15)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"win": F.lit(0), "wid": F.lit(0)})
    out = decontamination.contaminated(odd, bench).collect()
    want = {r[0]: r for r in plain.contaminated(pairs(odd), items)}
    assert len(out) == odd.count()
    assert all((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) == want[r.doc_id] for r in out)
    kept = decontamination.clean(odd, bench)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if not r.contaminated)
    assert decontamination.contaminated(docs, empty(bench)).where("contaminated").count() == 0
    assert decontamination.contaminated(empty(docs), bench).count() == 0
    old = decontamination.PASS_WORDS
    try:
        decontamination.PASS_WORDS = 40
        again = decontamination.contaminated(odd, bench).collect()
    finally:
        decontamination.PASS_WORDS = old
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_language_model(spark, docs):
    rows = docs.select("doc_id", "text").limit(120).unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, "")], "doc_id long, text string"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    data = pairs(rows)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data}
    scores, n, counts, p, words = plain.kneser_ney([t for i, t in data if not held[i]], [t for _, t in data])
    assert abs(sum(p("the", "of", w) for w in words) - 1) < 1e-9
    got = {r.doc_id: r for r in language_model.score(rows.withColumn("n", F.lit("clash")), held_out).collect()}
    for (i, t), s in zip(data, scores):
        w = [*plain.blank_words((t or "").translate(plain.LOWER)), "</s>"]
        base = sum(np.log10((counts.get(x, 0) + 1) / (n + len(counts) + 1)) for x in w)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(w), sum(x in counts for x in w), n)
        assert abs(got[i].base_score - base) < 1e-6 and abs(got[i].score - s) < 1e-6
    assert language_model.score(empty(rows), held_out).count() == 0


def test_language_model_over_many_groups(spark, docs):
    """Salted common words and several groups give the same scores as one group."""
    held_out = F.col("doc_id") % 7 == 2
    one = {r.doc_id: r.score for r in language_model.score(docs, held_out).collect()}
    old = language_model.GROUPED
    try:
        language_model.GROUPED = 10_000
        many = {r.doc_id: r.score for r in language_model.score(docs, held_out).collect()}
    finally:
        language_model.GROUPED = old
    assert max(abs(one[k] - many[k]) for k in one) < 1e-6


@pytest.mark.parametrize("width", [1 << 27, 1 << 16])
def test_substring_dedup(spark, docs, odd, width):
    for df in (docs, odd):
        want = {r[0]: r for r in plain.without_repeats(pairs(df))}
        out = substring_dedup.remove_repeats(df, width=width).collect()
        assert len(out) == df.count()
        assert all((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] and plain.sha(r.kept.encode()) == r.kept_sha256 for r in out)
    assert substring_dedup.remove_repeats(empty(docs)).count() == 0
    null = spark.createDataFrame([(None, LOREM), (1, LOREM), (None, LOREM)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(null).collect()] == [0, 0, 0]


def test_suffix_dedup(spark, docs, odd):
    for df in (docs, odd):
        want = {r[0]: r for r in plain.without_repeated_bytes(pairs(df))}
        out = suffix_dedup.remove_repeated_bytes(df).collect()
        assert len(out) == df.count()
        assert all((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in out)
    assert suffix_dedup.remove_repeated_bytes(empty(docs)).count() == 0
    null = spark.createDataFrame([(None, LOREM), (1, LOREM), (None, LOREM)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeated_bytes(null).collect()] == [0, 0, 0]


def test_suffix_dedup_of_periodic_and_shifted_texts(spark):
    """Windows that share an anchor at other places, hold it several times, or share only one side of it."""
    noise = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(900))
    texts = ["ab" * 200, "x" + "ab" * 130 + "y", "abc" * 120, noise, noise[:150] + "#" + noise[250:420], "?" + noise[30:135] + "!" + noise[500:599] + "!" + noise[499:600], noise[:33] * 12, (noise[700:740] + "-") * 9, noise[100:240] * 2, noise[380:560][::-1]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {r[0]: r for r in plain.without_repeated_bytes(pairs(df))}
    got = {r.doc_id: r for r in suffix_dedup.remove_repeated_bytes(df).collect()}
    assert {k: (r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == {k: (r[2], r[3], r[4]) for k, r in want.items()}


def test_sorted_suffixes():
    random.seed(3)
    strings = ["".join(random.choice("ab") for _ in range(random.randint(0, 30))).encode() for _ in range(60)] + [b"a" * 20, b"ab" * 10, b""]
    size = np.array([len(s) for s in strings])
    stops = np.cumsum(size)
    found = [np.concatenate(list(suffix_dedup.sorted_suffixes(np.frombuffer(b"".join(strings), np.uint8), stops - size, stops, buffer))) for buffer in (1, 7, 256, 1 << 18)]
    assert all((x == found[-1]).all() for x in found)
    who, length, common = (found[-1][c] for c in ("string", "length", "common"))
    want = sorted((s[len(s) - k :], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
    assert [(i, k) for _, i, k in want] == list(zip(who.tolist(), length.tolist()))
    prefix = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert common.tolist() == [0] + [prefix(a[0], b[0]) for a, b in zip(want, want[1:])]
    # windows that occur twice, however the order is dealt into parts
    many = np.arange(len(strings)) % 7 == 0
    seen = [s[len(s) - k :][:6] for s, _, k in ((strings[i], i, k) for _, i, k in want)]
    twice = [j for j, (_, i, k) in enumerate(want) if k >= 6 and (seen.count(seen[j]) > 1 or many[i])]
    for buffer in (1, 5, 4096):
        group, string, size = suffix_dedup._repeats((found[-1][i : i + buffer] for i in range(0, len(want), buffer)), 6, many)
        assert list(zip(string.tolist(), size.tolist())) == [want[j][1:] for j in twice]
        assert len(set(zip(group.tolist(), [seen[j] for j in twice]))) == len(set(group.tolist())) == len({seen[j] for j in twice})


def test_ngram_join(spark, docs, odd):
    random.seed(9)
    words = [f"t{i}" for i in range(400)]
    near = []
    for g in range(6):
        base = [random.choice(words) for _ in range(120)]
        for _ in range(40):
            copy = list(base)
            for _ in range(random.randint(0, 5)):
                copy[random.randrange(len(copy))] = random.choice(words)
            near.append(" ".join(copy))
    planted = spark.createDataFrame(list(enumerate(near)), "doc_id long, text string").repartition(4)
    old = ngram_join.BLOCK_NODES
    for size in (old, 16):
        ngram_join.BLOCK_NODES = size
        try:
            got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.similar_documents(planted).collect()}
        finally:
            ngram_join.BLOCK_NODES = old
        assert got == plain.similar(pairs(planted))
    for df in (docs, odd.dropDuplicates(["doc_id"])):
        got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.similar_documents(df).collect()}
        assert got == plain.similar(pairs(df))
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for c, *_ in plain.similar(pairs(odd)).values()})
    assert ngram_join.similar_documents(empty(docs)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (103, 102), (102, 101)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{i: 100 for i in (101, 102, 103)}}


def test_quality(spark, odd):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = quality_classifier.score(docs, labels, held_out)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    kept = quality_classifier.accepted(docs, labels, held_out)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in out.collect() if r.predicted}
    nulls = spark.createDataFrame([(None, 1), (3, None), (10**9, 0)], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.score(odd, nulls, held_out).collect()} == {0.5}
    assert quality_classifier.score(empty(docs), labels, held_out).count() == 0


def test_attention_gradients():
    random = np.random.default_rng(1)
    x, first, target = random.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    net = quality_classifier.fit(x, first, target, hidden=4, attention=3, epochs=1)
    y = lambda: net.forward(x, first)[0]
    loss = lambda: -float((target * np.log(y()) + (1 - target) * np.log(1 - y())).mean())
    for name, g in net.gradients(x, first, target).items():
        w = net.weights[name].reshape(-1)
        for k in range(len(w)):
            old = w[k]
            w[k] = old + 1e-6
            up = loss()
            w[k] = old - 1e-6
            assert abs((up - loss()) / 2e-6 - g.reshape(-1)[k]) < 1e-6
            w[k] = old


def test_pii(spark, docs, odd):
    for df in (docs, odd):
        texts = dict(pairs(df))
        out = pii.find_personal_data(df)
        rows = out.select("doc_id", *pii.KINDS, *pii.EXTRA, pii.listed(pii.KINDS + pii.EXTRA).alias("s")).collect()
        assert len(rows) == df.count()
        for r in rows:
            base = [(k, s.start, s.stop) for k in pii.KINDS for s in r[k]]
            assert base == plain.base_spans(texts[r.doc_id])
            added = [(k, s.start, s.stop) for k in pii.EXTRA for s in r[k]]
            assert r.s == ",".join(f"{k}:{a}:{b}" for k, a, b in base + added)
            assert all(b <= c or d <= a for _, a, b in added for _, c, d in base)
    clean = pii.without_personal_data(odd)
    assert clean.columns == odd.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[21] == "é😀 <email> 😀 <card>" and text[1] is None and text[9] == LOREM
    assert pii.find_personal_data(empty(docs)).count() == 0


def test_pipeline(spark, sf_dir, docs):
    import corpus_pipeline

    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "sentencepiece"]
    good = quality_classifier.score(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 == 0).where("predicted = 1").select("doc_id")
    state = sorted(((r.doc_id, r.text) for r in docs.join(good, "doc_id").collect()))
    classes = plain.similar(state)
    state = [(i, t) for i, t in state if classes[i][0] == i]
    items = [(r.item_id, r.text) for r in bench.collect()]
    bad = {r[0] for r in plain.contaminated(state, items) if r[4]}
    state = dict((i, t) for i, t in state if i not in bad)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(out) == set(state)
    own = sentencepiece_codec.codec(queries.piece_model())
    for i, t in state.items():
        if not re.search("[0-9]", t):
            assert out[i].ids == own.by_library(t)[1]
        else:
            assert not plain.base_spans(own.library.decode([int(x) for x in out[i].ids.split()]))
    stage = dict(corpus_pipeline.STAGES)
    for name in list(stage)[:-1]:
        assert stage[name](spark, docs, sf_dir).columns == docs.columns


@pytest.mark.parametrize("threshold", [(5, 10), (3, 10)])
def test_ngram_join_at_low_thresholds(spark, threshold):
    """Bands are made for the threshold, so that pairs at low ones are found too."""
    random.seed(11)
    words = [f"t{i}" for i in range(300)]
    texts = []
    for _ in range(8):
        base = [random.choice(words) for _ in range(90)]
        for k in range(12):
            copy = list(base)
            for _ in range(random.randint(0, 14)):
                copy[random.randrange(len(copy))] = random.choice(words)
            texts.append(" ".join(copy[: 90 - 2 * (k % 3)]))
    planted = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in ngram_join.similar_documents(planted, threshold=threshold[0] / threshold[1]).collect()}
    assert got == plain.similar(pairs(planted), threshold=threshold)
    assert ngram_join.Bands.of(0.8).bands * ngram_join.Bands.of(0.8).rows <= ngram_join.MOST


def test_ngram_join_of_repeated_rows_and_null_ids(spark):
    rows = [(5, LOREM), (5, LOREM), (3, LOREM), (-4, LOREM + " y"), (None, LOREM + " y"), (None, "a b c d e f"), (None, None), (7, "g h")]
    got = sorted(((r.doc_id, r.class_id, r.n_copies) for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, -4, 3), (5, -4, 3), (3, -4, 3), (-4, -4, 2), (None, -4, 2), (None, None, 1), (None, None, 1), (7, 7, 1)], key=str)


def test_components_that_are_not_final_are_an_error(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long"), rounds=1)
