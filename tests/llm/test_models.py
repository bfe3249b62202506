"""Tokenizers, the lattice language model, language ID, HTML extraction and the pipeline."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.llm.queries import vocabulary
from tests.llm import brute


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def test_bpe_equals_the_library(docs, rows, byte_bpe):
    from kestrel.llm.bpe import encode_decode
    out = encode_decode(docs, vocabulary("byte_bpe_50k.json")).collect()
    got = sorted((str(r.doc_id), r.n_tokens, hashlib.sha256(r.token_ids).hexdigest(), r.decoded, r.r) for r in out if r.r)
    expected = []
    for r in rows:
        if r[9]:
            ids = ids_of(byte_bpe, r[1])
            expected.append((str(r[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                             byte_bpe.decode(ids, skip_special_tokens=False), r[9]))
    assert got == sorted(expected)


def test_bpe_on_odd_strings(byte_bpe, monkeypatch):
    import random
    from kestrel.llm import bpe
    monkeypatch.setattr(bpe, "CACHE_WORDS", 300)
    own = bpe.Bpe(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "é", "ß", "漢", "😀", "'s", "'LL", "0", "9", "<|endoftext|>", "<|", "\x00", "the", "ing", "́"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["a" * 3000, "the" * 800, " " * 99]
    for at in range(0, len(texts), 200):
        for t, ids in zip(texts[at: at + 200], own.encode(texts[at: at + 200])):
            ids = np.frombuffer(ids, "<u4")
            assert ids.tolist() == ids_of(byte_bpe, t)
            assert own.decode(ids) == byte_bpe.decode(ids.tolist(), skip_special_tokens=False)
    assert own.stats["failed"]  # the exact path ran too


def test_token_files(spark, docs, rows):
    from tokenizers import Tokenizer
    from kestrel.llm.token_orc import digest, read_tokens, write_tokens
    from kestrel.session import scratch_path
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    path = scratch_path(spark, "test-tokens")
    write_tokens(docs, vocabulary("word_bpe_49k.json"), path)
    tokens = read_tokens(spark, path)
    by_row = collections.Counter((d, tuple(ids_of(library, t) + [2])) for d, t in ((r[0], r[1]) for r in rows))
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in tokens.collect()) == by_row
    got = sorted(digest(tokens).collect(), key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    expected = collections.Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, i), n in by_row.items() for _ in range(n))
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    assert spark.read.orc(path).where("doc_id = 9").count() == 1


def test_words_through_the_merge_model(monkeypatch):
    import random
    from kestrel.llm import token_orc
    monkeypatch.setattr(token_orc, "CACHE_WORDS", 50)
    own = token_orc._Words(vocabulary("word_bpe_49k.json"))
    rng = random.Random(2)
    alphabet = ["a", "b", "É", "é", "é", "ß", "Ω", "Σ", "İ", "漢", " ", "\n", "\x0b", "\xa0", "\x85", "\x1c", ".", ",", "'s", "'LL",
                "0", "½", "<|endoftext|>", "<|STARTOFTEXT|>", "<", "|", "the ", "ſ", "K", "​", "æ", "÷", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["", "a..b.,", "x.x. ."]
    for at in range(0, len(texts), 100):
        got = own.encode([t.encode() for t in texts[at: at + 100]])
        assert [np.frombuffer(g, "<i4").tolist() for g in got] == [ids_of(own.tokenizer, t) for t in texts[at: at + 100]]


def _cuts(text):
    if not text:
        yield []
    for k in range(1, len(text) + 1):
        for rest in _cuts(text[k:]):
            yield [text[:k], *rest]


def test_lattice_marginal_is_the_sum_over_all_segmentations():
    from kestrel.llm.lattice_lm import Lattice
    lattice = Lattice(vocabulary("piece_bpe_32k.model"), {400: 5, 1000: 30, 320: 8, 262: 9}, 3)
    for word in ["a", "the", "singing", "été", "漢x", "zq͸"]:
        total = 0.0
        for cut in _cuts("▁" + word):
            p = 0.0
            for piece in cut:
                if piece in lattice.score:
                    p += lattice.score[piece]
                elif len(piece) == 1:
                    p += sum(lattice.byte[b] for b in piece.encode())
                else:
                    p = None
                    break
            total += 10**p if p is not None else 0
        assert lattice.marginal(word) == pytest.approx(math.log10(total), rel=1e-9)


def test_lattice_scores(docs, rows):
    from kestrel.llm.lattice_lm import score
    out = score(docs, vocabulary("piece_bpe_32k.model")).collect()
    counts, n_docs, tokens = collections.Counter(), 0, []
    for d, t in ((r[0], r[1]) for r in rows):
        w = brute.SPACE_WORDS.findall(brute.lower(t))
        held = d is None or zlib.crc32(str(d).encode()) % 10 == 0
        tokens.append((d, held, w))
        if not held:
            counts.update(w)
            n_docs += 1
    n, v = sum(counts.values()) + n_docs, len(counts) + 1
    base = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    expected = sorted((str(d), h, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n,
                       round(sum(base(counts[x]) for x in w) + base(n_docs), 6)) for d, h, w in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_models_on_empty_tables(spark, none):
    from kestrel.llm.bpe import encode_decode
    from kestrel.llm.html_extract import extract
    from kestrel.llm.langid import fit, identify
    from kestrel.llm.lattice_lm import score
    from kestrel.llm.token_orc import digest, store_and_read
    assert encode_decode(none, vocabulary("byte_bpe_50k.json")).count() == 0
    assert digest(store_and_read(none, vocabulary("word_bpe_49k.json"))).count() == 0
    assert score(none, vocabulary("piece_bpe_32k.model")).count() == 0
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    nothing = fit(none)
    assert identify(none, nothing).count() == 0
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in identify(one, nothing).collect()] == [("und", 0.0)]


def test_langid_held_out_accuracy(spark):
    from kestrel.llm.langid import fit, held_out, identify
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"), 5)))
    out = identify(docs.where(held_out(F.col("doc_id"), 5)), model).select("lang", "lang_pred", "score").collect()
    assert all(0 <= r.score <= 1 for r in out)
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)


def test_langid_odd_texts(spark):
    from kestrel.llm.langid import fit, identify
    train = spark.createDataFrame([("the quick brown fox and the dog", "en"), ("der schnelle braune Fuchs und der Hund", "de"),
                                   ("no language", None), (None, "en"), ("123", "fr")], "text string, lang string")
    data = [(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "the fox and the dog", "x"), (5, "DER HUND UND DER FUCHS", "x"),
            (6, "漢字漢字漢字", "x"), (7, "the dog " * 50_000, "x")]
    out = identify(spark.createDataFrame(data, "doc_id long, text string, lang_pred string"), fit(train)).collect()
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in out}
    assert got[1] == got[2] == got[3] == ("und", True)
    assert got[4] == got[7] == ("en", False) and got[5] == ("de", False)
    assert got[6][1] and got[6][0] in ("en", "de")


def test_langid_rejects_what_it_has_not_learnt(spark):
    import random
    from kestrel.llm.langid import fit, held_out, identify
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    model = fit(docs.where(~held_out(F.col("doc_id"), 5)))
    clean = [r.rejected for r in identify(docs.where(held_out(F.col("doc_id"), 5)), model).collect()]
    assert sum(clean) <= 0.02 * len(clean)
    short = docs.where(held_out(F.col("doc_id"), 5)).withColumn("text", F.expr("array_join(slice(split(text, ' '), 1, 3), ' ')"))
    short = [r.rejected for r in identify(short, model).collect()]
    assert sum(short) <= 0.05 * len(short)
    rng = random.Random(2)
    letters = ["abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x9000))),
               "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"]
    noise = [" ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 9) if a is not letters[2] else 60)) for _ in range(n))
             for a in letters for n in (10, 30, 100, 1000) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string")
    assert all(r.rejected for r in identify(df, model).collect())
    for lang in ("de", "en"):
        less = fit(docs.where(F.col("lang") != lang))
        other = [r.rejected for r in identify(docs.where((F.col("lang") == lang) & (F.length("text") > 600)), less).collect()]
        assert sum(other) >= 0.9 * len(other)


def test_langid_copies_count_once(spark):
    """Languages whose many rows are copies of few texts are learnt, and one frequent text doesn't fill a sample."""
    from kestrel.llm import langid
    few = [f"{a} und {b} gehen heute nach hause" for a, b in (("hund", "katze"), ("mann", "frau"), ("haus", "hof"))]
    rows = [(t, lang) for lang in ("de", "nl", "at", "ch") for t in (f"{x} {lang}" for x in few) for _ in range(3000)]
    many = ["the quick fox " + chr(97 + i % 26) + chr(97 + i // 26) + " runs" for i in range(500)]
    rows += [(t, "en") for t in many] + [(t, "en") for t in sorted(many)[:5] for _ in range(400)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert set(model.langs) == {"de", "nl", "at", "ch", "en"}
    once = langid.fit(spark.createDataFrame(sorted(set(rows)), "text string, lang string"))
    assert once.langs == model.langs and np.allclose(once.centroids, model.centroids)


def test_blocks_of_markup():
    from kestrel.llm.html_extract import blocks
    page = ('<!DOCTYPE html><head><title>no</title></head><body class="a"><p>one &amp; t&#119;o<br>three<p><b>four  <a href="x">five</a></b>'
            '<script>var p = "</p>";</script><style>p{}</style><!-- no <p>no</p> --><ul><li>six<li>se<i>v</i>en</ul>eight &lt;p&gt;<div class="cut')
    assert [t for _, t, _ in blocks(page)] == ["one & two three", "four five", "six", "seven", "eight <p>"]
    assert blocks(page)[0][0] == ("html",)[:0] + ("body", ".a", "p")
    assert blocks("") == [] and blocks("plain") == [((), "plain", 0.0)]


def test_html_deep_nesting_takes_linear_time():
    import time

    from kestrel.llm.html_extract import blocks
    start = time.time()
    found = blocks("<div class='a'>" * 40_000 + "x" + "</div>" * 40_000)
    assert [t for _, t, _ in found] == ["x"] and len(found[0][0]) == 80_000 and time.time() - start < 20


def test_html_labels_hold_out():
    from kestrel.llm.html_extract import trained, training_pages
    xs, ys = training_pages(150, 4242)  # other pages than those trained on
    found = np.concatenate(trained().label(xs))
    assert (found == (np.concatenate(ys) > 0)).mean() > 0.985


def test_html_gradients():
    from kestrel.llm import html_extract as H
    xs, ys = H.training_pages(3, 1)
    net = H.Labeller()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    steps = max(map(len, xs))
    x, mask = H._padded(xs, steps)
    x, y = x.astype(np.float64), np.zeros(mask.shape)
    for j, v in enumerate(ys):
        y[: len(v), j] = v

    def loss():
        p = 1 / (1 + np.exp(-net.forward(x, mask)[0]))
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()
    g = net.gradients(x, mask, y)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        for at in rng.integers(0, v.size, 4).tolist():
            old = v.flat[at]
            v.flat[at] = old + 1e-3
            up = loss()
            v.flat[at] = old - 1e-3
            down = loss()
            v.flat[at] = old
            assert g[k].flat[at] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_html_pages_of_the_table(spark):
    from kestrel.llm.html_extract import blocks, extract
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    right = 0
    for r in pages.collect():
        expected = "\n\n".join(t for p, t, _ in blocks(r.html) if "article" in p)
        right += got[r.page_id] == (expected, len(expected))
    assert right >= 0.99 * len(got)


def test_html_plain_containers_and_comments(spark):
    from kestrel.llm.html_extract import extract
    body = " ".join(["A sentence of the article about many things."] * 12)
    page = (f'<body><div class="menu"><a href="/">Home</a> <a href="/n">News</a></div><div class="cookie-notice">We use cookies</div>'
            f'<div class="post-content"><h1>The title</h1><p>{body}</p><p>Short end.</p></div>'
            f'<div class="comments"><h3>Comments</h3><div class="comment"><p>Great article, thanks</p></div></div>'
            f'<div id="footer">&copy; 2020 all rights reserved</div></body>')
    df = spark.createDataFrame([(1, page, "t"), (2, None, "t"), (3, "", "t")], "page_id long, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract(df).collect()}
    want = "The title\n\n" + body + "\n\nShort end."
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0)}


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from kestrel.llm.langid import fit, held_out, identify
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "substring_dedup", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"), 5)))
    gone = {r.doc_id for r in identify(docs, model).where("rejected").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in gone]
    keep = {r[0] for r in brute.near(rows, 5) if r[3]}
    rows = [r for r in rows if r[0] in keep]
    cut = _cut(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.contamination(cut, items) if r[5]}
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    expected = []
    for d, t in cut:
        if d not in bad:
            ids = ids_of(library, t)
            expected.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(t)))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept.limit(0), sf)
        assert kept.columns == docs.columns and kept.count() == 0


def _cut(rows, window=13):
    first = {}
    for d, t in rows:
        w = brute.SPACE_WORDS.findall(t or "")
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        w = brute.SPACE_WORDS.findall(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    return out


def test_html_labelled_pages_of_other_layouts():
    """Characters of hand-labelled pages: none of their layouts comes from the generator."""
    from kestrel.llm.html_extract import blocks, main_text, trained
    from tests.llm.labelled_pages import PAGES
    assert len(PAGES) >= 50
    both = extra = missed = 0
    for page in PAGES:
        marked = [(t.replace("¶", ""), "¶" in t) for _, t, _ in blocks(page)]
        found = main_text([page.replace("¶", "")], trained())[0].split("\n\n")
        for text, wanted in marked:
            kept = text in found
            both, extra, missed = both + len(text) * (kept and wanted), extra + len(text) * (kept and not wanted), missed + len(text) * (wanted and not kept)
    assert both / (both + extra) >= 0.95
    assert both / (both + missed) >= 0.88


def test_language_features_of_long_texts_take_bounded_memory():
    import tracemalloc

    import numpy as np

    from kestrel.llm import langid
    texts = ["", "İß ab " * 40_000, "x", "", "aé\n" * 90_000] + ["long Text " * 20_000] * 8 + ["1 2"]
    langid._letters()
    tracemalloc.start()
    counts, some = langid._features(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # about 170 MB when all texts were hashed at once
    alone = [langid._grams([t]) for t in texts]
    assert np.array_equal(counts, np.concatenate([c for c, _ in alone]))
    assert some.tolist() == [bool(s[0]) for _, s in alone] == [False, True, True, False, True] + [True] * 8 + [False]
