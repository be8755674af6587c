import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import lm_score as L
from tidewell.llm import quality as Q
from tidewell.llm import toxicity as T
from tidewell.llm.html_text import extract, main_text


def held(doc, n=3, k=1):
    return doc is not None and zlib.crc32(str(doc).encode()) % n == k


def accuracy(rows, labels, column):
    truth = {r.doc_id: r[column] for r in labels.collect()}
    test = [r for r in rows if r.doc_id in truth and r.held_out]
    return sum(r.predicted == truth[r.doc_id] for r in test) / len(test)


def test_quality_and_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.quality(docs, labels).collect()
    assert len(rows) == docs.count() and accuracy(rows, labels, "quality") > 0.95
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    rows = T.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and accuracy(rows, labels, "toxic") > 0.93
    assert any(r.evidence and r.evidence_terms for r in rows)


def test_held_out_labels_are_never_read(spark, docs, labels):
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in Q.quality(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_odd_rows_get_scores(spark, odd_docs, no_docs, docs, labels):
    train = docs.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    model = Q.fit(train, labels)
    kept = Q.score(odd_docs, model)
    assert kept.columns == [*odd_docs.columns, "quality_score"] and kept.count() == 12
    assert all(0 <= r.quality_score <= 1 for r in kept.collect())
    for op in (Q.quality, T.toxicity):
        assert op(odd_docs, labels).count() == 12 and op(no_docs, labels).count() == 0
        assert {round(r.score, 6) for r in op(odd_docs, labels.limit(0)).collect()} == {0.5}
    twice = labels.unionByName(labels.limit(5)).unionByName(labels.limit(3).withColumn("quality", F.lit(None).cast("int")))
    assert Q.quality(odd_docs, twice).count() == 12


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    words = [f"w{i}".encode() for i in range(30)]
    bad = [f"bad{i}".encode() for i in range(12)]
    texts, labels = [], []
    for i in range(600):
        y = int(i % 4 == 0)
        w = [words[k] for k in rng.integers(0, 30, 20)] + ([bad[k] for k in rng.integers(0, 12, 4)] if y or rng.random() < 0.05 else [])
        texts.append(b" ".join(w[k] for k in rng.permutation(len(w))))
        labels.append(y)
    index = T.build(list(range(600)), texts, np.asarray(labels))
    vectors = {}
    dense = np.zeros((len(index.labels), len(index.terms)))
    for t in range(len(index.terms)):
        for b in range(index.bounds.shape[1]):
            dense[index.where[index.cuts[t, b] : index.cuts[t, b + 1]], t] = index.impact[index.cuts[t, b] : index.cuts[t, b + 1]]
    assert np.allclose((dense**2).sum(axis=1), 1)
    for t in texts[:80]:
        v = index.vector(t.split())
        if v:
            q = np.zeros(len(index.terms))
            q[[a for a, _ in v]] = [b for _, b in v]
            exact = dense @ q
            best, sims = index.nearest(v)
            assert np.allclose(np.sort(exact)[::-1][: len(best)], sims)
            vectors[v] = best
    assert vectors


def test_copies_of_labelled_examples_are_found():
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 4000, n)]
    texts, labels = [], []
    for i in range(400):
        w = word(60)
        if i % 8 == 0:
            w = [f"own{i}x{j}" for j in range(20)] + w  # no term tells these from the others
        texts.append(" ".join(w).encode())
        labels.append(int(i % 8 == 0))
    index = T.build(list(range(400)), texts, np.asarray(labels))
    full = index.close
    dense = np.zeros((400, len(full.words)))
    for j in range(400):
        dense[j, full.which[full.rows[j] : full.rows[j + 1]]] = full.weight[full.rows[j] : full.rows[j + 1]]
    assert np.allclose((dense**2).sum(axis=1), 1, atol=1e-4)
    for i in range(0, 400, 8):
        words = texts[i].split()
        near = [*words[:-4], *(w.encode() for w in word(4))]
        for w in (words, near):
            at, x = full.vector(w)
            exact = dense[:, at] @ x
            got, sims = full.nearest(w, 10)
            assert set(got.tolist()) == set(np.flatnonzero(exact >= T.CLOSE).tolist()) and np.allclose(exact[got], sims, atol=1e-4)
            p, evidence, _ = index.score(b" ".join(w))
            assert p >= T.THRESHOLD and evidence[0]["doc_id"] == i and evidence[0]["label"] == 1
        assert index.score(texts[i + 1])[0] < T.THRESHOLD


def test_language_model_base_is_exact_and_mixture_adds_up(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    data = [(r.doc_id, (r.text or "").encode().translate(L.LOWER_SPACE_TABLE).split()) for r in docs.collect()]
    count, ends = Counter(), 0
    for d, w in data:
        if not held(d, 10, 0):
            count.update(w)
            ends += 1
    n = sum(count.values()) + ends
    scale = np.log10(n + 0.1 * (len(count) + 1 + 1))
    want = sorted(((d, len(w) + 1, sum(count[x] > 0 for x in w) + 1, round(sum(np.log10(count[x] + 0.1) - scale for x in w) + np.log10(ends + 0.1) - scale, 4)) for d, w in data), key=str)
    rows = L.lm_scores(docs, max_training=60).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows), key=str) == want
    assert {r.train_tokens for r in rows} == {n} and all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert L.lm_scores(no_docs).count() == 0


def test_language_model_learns_from_every_training_document(spark):
    common, rare = [f"the cat {w} sat" for w in ("big", "small", "old", "new")], "zebra quartz violin"
    ids = [i for i in range(3000) if not held(i, 10, 0)]
    rows = [(i, common[i % 4]) for i in ids]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sampled = {r.doc_id for r in frame.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) < int(40 / len(ids) * (1 << 30))).collect()}
    outside = [i for i in ids if i not in sampled][:100]
    probe = next(i for i in range(3000, 4000) if held(i, 10, 0))
    unmet = "xylophone walrus nectar"
    texts = dict(rows) | dict.fromkeys(outside, rare) | {probe: rare, probe + 10_000: unmet}
    got = {r.doc_id: r.score for r in L.lm_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), max_training=40).collect()}
    # the words of 100 training documents that the sample left out are no strangers
    assert sampled and probe in got and got[probe] > -8
    alone = dict(rows) | {probe: rare}
    before = {r.doc_id: r.score for r in L.lm_scores(spark.createDataFrame(list(alone.items()), "doc_id long, text string"), max_training=40).collect()}
    assert got[probe] > before[probe] + 8


MASK = (1 << 64) - 1


def mixed(x):
    x ^= x >> 32
    x = x * 0x9E3779B97F4A7C15 & MASK
    x ^= x >> 29
    x = x * 0xBF58476D1CE4E5B9 & MASK
    return x ^ x >> 32


def quality_features(text, bits=Q.BITS):
    """Feature numbers of one text by their definition: words, whether neighbours are equal, n-grams inside words."""
    text = text.translate(Q.SPACES)
    hashes = []
    for w in text.split():
        h = (0xCBF29CE484222325 + len(w)) & MASK
        for at in range(0, len(w), 8):
            h = (mixed(h ^ int.from_bytes(w[at : at + 8], "little")) + 0x9E3779B97F4A7C15) & MASK
        hashes.append(h)
    grams, data = [], b" " + text + b" "
    for n in Q.NGRAMS:
        for at in range(len(data) - n + 1):
            part = data[at : at + n]
            if b" " not in part[1:-1]:
                grams.append(((int.from_bytes(part, "big") + n) * 0x9E3779B97F4A7C15 & MASK) >> (64 - bits))
    return [mixed((h + 7) & MASK) >> (64 - bits) for h in hashes], [int(a == b) for a, b in zip(hashes, hashes[1:], strict=False)], grams


def test_quality_query_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    good, bad = [f"fine{i} prose" for i in range(30)], [f"xx{i} spam spam" for i in range(30)]
    texts = {i: " ".join(rng.choice(good if i % 2 else bad, 6)) for i in range(40)} | {40: "", 41: None, 42: "fine1 ünï\tspam", 43: "a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(31, None)], "doc_id long, quality int")
    learn = [i for i in range(30) if not held(i, 3, 1)]
    # one vector a feature, one step a document, a gradient for each occurrence
    draw = np.random.default_rng(1)
    share = (sum(i % 2 for i in learn) + 1) / (len(learn) + 2)
    bias, out = np.array([0, np.log(share / (1 - share))]), np.zeros((2, Q.DIM))
    table = (draw.random((1 << Q.BITS, Q.DIM), np.float32).astype(float) - 0.5) / Q.DIM
    found = {i: [x for x in quality_features((t or "").encode())] for i, t in texts.items()}
    mean = lambda i: sum((table[x].mean(axis=0) for x in found[i] if x), np.zeros(Q.DIM))
    epochs = -(-Q.STEPS // len(learn))
    step = 0
    for _ in range(epochs):
        for k in draw.permutation(len(learn)):
            i, step = learn[k], step + 1
            lr = Q.RATE * (1 - step / (epochs * len(learn) + 1))
            v = mean(i)
            p = np.exp(out @ v + bias)
            p /= p.sum()
            p[i % 2] -= 1
            grad = p @ out
            out -= lr * np.outer(p, v)
            bias -= 0.1 * lr * p
            for x in found[i]:
                np.subtract.at(table, x, lr * Q.SPREAD * grad / max(1, len(x)))
    got = {r.doc_id: r for r in Q.quality(docs, labels).collect()}
    assert set(got) == set(texts)
    for i in texts:
        z = out @ mean(i) + bias
        want = 1 / (1 + np.exp(z[0] - z[1]))
        assert abs(got[i].score - want) < 2e-3 and got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == held(i, 3, 1), (i, got[i].score, want)


def pairs_of(seqs, end):
    n = Counter((p, i) for s in seqs for p, i in zip([end, *s[:-1].tolist()], s.tolist(), strict=True))
    return (np.asarray(x) for x in zip(*((p, i, c) for (p, i), c in sorted(n.items())), strict=True))


def test_step_over_all_documents_raises_their_likelihood():
    rng = np.random.default_rng(1)
    seqs = [np.append(np.cumsum(rng.integers(1, 4, k)) % 50, 50) for k in rng.integers(5, 60, 200)]
    start = L.train(seqs[:20], 50, epochs=2)
    tokens, lengths = np.concatenate(seqs), np.asarray([len(s) for s in seqs])
    prior, ids, n = pairs_of(seqs, 50)
    whole, parts = np.zeros((51, 2 * L.COMPONENTS), np.float32), np.zeros((51, 2 * L.COMPONENTS), np.float32)
    start.expect(prior, ids, n, whole)
    for at in range(0, len(ids), 7):
        start.expect(prior[at : at + 7], ids[at : at + 7], n[at : at + 7], parts)
    count, before = np.bincount(ids, weights=n, minlength=51), np.bincount(prior, weights=n, minlength=51)
    assert np.array_equal(count, np.bincount(tokens, minlength=51))
    assert np.allclose(whole, parts, rtol=1e-3, atol=1e-2) and np.allclose(whole[:, : L.COMPONENTS].sum(axis=1), count, rtol=1e-3) and np.allclose(whole[:, L.COMPONENTS :].sum(axis=1), before, rtol=1e-3)
    model = start.learned(count, before, whole)
    assert model.score(tokens, lengths).sum() > start.score(tokens, lengths).sum() + 10
    assert np.allclose(model.after.sum(axis=1), 1, atol=1e-4)


def test_pairs_are_counted_exactly(spark):
    texts = [f"the cat {w} sat on {i} mats" for i, w in enumerate(["big", "small", "odd", "new"] * 30)] + ["", " ", "one"]
    ids = L.WordIds(L.VOCABULARY)
    seqs = [L.sequences([t.encode()], ids)[0] for t in texts]
    want = {p * (ids.end + 1) + i: c for p, i, c in zip(*pairs_of(seqs, ids.end), strict=True)}
    parts = []
    for at in range(0, len(seqs), 3):  # many tasks, more blocks than are held
        counts = L.PairCounts(ids.end + 1)
        for s in seqs[at : at + 3] * 3:
            counts.add(s, np.asarray([len(s)]))
        parts += zip(*counts.rows(), strict=True)
    got = {}
    for r in L.merged_pairs(spark.createDataFrame(parts, "chunk int, pairs binary, times binary")).collect():
        key, n = np.frombuffer(r.pairs, np.int64), np.frombuffer(r.times, np.int64)
        assert set(key // (ids.end + 1) // L.CHUNK) == {r.chunk}
        got |= dict(zip(key.tolist(), (n // 3).tolist(), strict=True))
    assert got == want


def test_gradients_are_the_numerical_ones():
    rng = np.random.default_rng(2)
    n, d, c, size = 5, 4, 3, 7
    w = {"embed": rng.standard_normal((size, d)), "place": rng.standard_normal((n, d)), "qkv": rng.standard_normal((d, 3 * d)), "mix": rng.standard_normal((d, c)), "follow": rng.standard_normal((size, c))}
    emit, ids, want = rng.random((size, c)), rng.integers(0, size, (2, n)), rng.integers(0, size, (2, n))
    loss = lambda: -np.log((L._forward(w, ids)[-1] * emit[want]).sum(axis=2)).sum()
    kept = L._forward(w, ids)
    gamma = kept[-1] * emit[want]
    grads = L._backward(w, ids, kept, kept[-1] - gamma / gamma.sum(axis=2, keepdims=True))
    for name, x in w.items():
        for at in [tuple(int(rng.integers(k)) for k in x.shape) for _ in range(12)]:
            old, step = x[at], 1e-5
            x[at] = old + step
            up = loss()
            x[at] = old - step
            down = loss()
            x[at] = old
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at])), name


def test_model_beats_word_counts_on_held_out_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.text or "").encode() for r in rows]
    out = [held(r.doc_id, 10, 0) for r in rows]
    words = [t.translate(L.LOWER_SPACE_TABLE).split() for t in texts]
    count, ends = Counter(), 0
    for w, o in zip(words, out, strict=True):
        if not o:
            count.update(w)
            ends += 1
    scale = np.log10(sum(count.values()) + ends + 0.1 * (len(count) + 2))
    tests = [i for i, o in enumerate(out) if o]
    base = sum(np.log10(count[x] + 0.1) - scale for i in tests for x in words[i]) + len(tests) * (np.log10(ends + 0.1) - scale)
    ids = L.WordIds(L.VOCABULARY)
    seqs = [L.sequences([t], ids)[0] for t, o in zip(texts, out, strict=True) if not o]
    model = L.train(seqs, ids.end)
    prior, at, n = pairs_of(seqs, ids.end)
    sums = np.zeros((ids.end + 1, 2 * L.COMPONENTS), np.float32)
    model.expect(prior, at, n, sums)
    model = model.learned(np.bincount(at, weights=n, minlength=ids.end + 1), np.bincount(prior, weights=n, minlength=ids.end + 1), sums)
    assert model.score(*L.sequences([texts[i] for i in tests], ids)).sum() > base


def test_every_id_is_scored_once_whatever_the_windows():
    rng = np.random.default_rng(0)
    seqs = [np.append(rng.integers(0, 40, k), 40) for k in (1, 5, 23, 24, 25, 60, 200)]
    m = L.train(seqs * 4, 40, epochs=1)
    x = m.mixture(m.code[seqs[-1][None, :24]])
    share = x / x.sum(axis=2, keepdims=True)
    assert np.allclose((share @ m.emit[m.code].T).sum(axis=2), 1, atol=1e-3)
    assert np.allclose(m.mixture(m.code[seqs[-1][None, :24]], 5), x[:, 5:], rtol=1e-4)
    lengths = np.asarray([len(s) for s in seqs])
    got = m.score(np.concatenate(seqs), lengths)
    for s, total in zip(seqs, got, strict=True):
        before = m.code[np.append(40, s[:-1])]
        want, at, done = 0.0, 0, 0
        while done < len(s):
            mix = m.mixture(before[None, at : at + m.window])[0]
            p = (mix * m.emit[m.code[s[at : at + m.window]]]).sum(axis=1) / mix.sum(axis=1)
            want += np.log10(p[done - at :]).sum()
            done = at + len(p)
            at = done - m.context
        assert abs(want - total) < 1e-3 * max(1, abs(want))


def test_word_ids_are_the_tokenizers_own():
    ids = L.WordIds(L.VOCABULARY)
    words = ["anon,".encode(), "ünï cödé".encode(), b"123abc", b"!!", "　x".encode(), b"the"]
    flat, cuts = ids.encode(words)
    for i, w in enumerate(words):
        assert flat[cuts[i] : cuts[i + 1]].tolist() == ids.encoder.encode_ordinary(" " + w.decode())


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>The  Title</h1><p>First &amp; <b>bold<br>text.<p>Second\n para&nbsp;graph</p><aside>See also</aside><form><p>Sign up</p></form><div class="ad">Buy!</div><p>Short.</p><footer>tags</footer></article>
<section id="comments"><p>Nice post, I really liked reading all of this long text of yours.</p></section><footer>&copy; me</footer></body></html>"""


def test_article_text():
    assert main_text(PAGE) == "The Title\n\nFirst & bold text.\n\nSecond para graph\n\nShort."
    assert main_text(None) == "" == main_text("") == main_text("<p>") == main_text("<nav>only a menu</nav>")
    body = "word " * 60
    plain = f"<html><body><div class=menu>a b c</div><div id=content><h2>Head</h2><div><p>{body}</p><p>short</p><p>{body}</p></div></div><div id=comments><p>{body}</p></div></body></html>"
    assert main_text(plain) == "\n\n".join(["Head", body.strip(), "short", body.strip()])
    assert main_text("<p>one &#233; &eacute; &bogus; &amp") == "one é é &bogus; &"


def test_no_part_of_an_article_is_cut():
    body, less = ("word " * 90).strip(), ("more " * 60).strip()
    sections = f"<body><nav><a href=/>Home</a></nav><div><section><p>{body}</p><p>{body}</p><p>{body}</p></section><section><p>{less}</p><ul><li>one</li><li>two</li></ul><p>The end.</p></section></div></body>"
    assert main_text(sections) == "\n\n".join([body, body, body, less, "one", "two", "The end."])
    shorter = f"<body><nav><a href=/>Home</a></nav><article><p>{body}</p><p>{body}</p></article><article><p>{less}</p></article></body>"
    assert main_text(shorter) == "\n\n".join([body, body, less])


def test_marks_never_remove_the_article():
    body = ("word " * 60).strip()
    inner = f"<p>{body}</p><p>{body}</p><div class=ad>Buy!</div><div class='cookie-notice'>We use cookies</div>"
    for page in (
        f"<article class='post comments-open'>{inner}</article>", f"<article class=related>{inner}</article>", f"<div id=page class='hidden nav'><article>{inner}</article></div>",
        f"<div class='content no-sidebar'>{inner}</div>", f"<div class=widget>{inner}</div>",
    ):
        assert main_text(f"<body><nav><a href=/>Home</a></nav>{page}<div id=comments><p>Nice</p></div></body>") == f"{body}\n\n{body}", page
    assert main_text(f"<body><article><p>{body}</p></article><div id=comments><p>{body}</p><p>{body}</p></div></body>") == body


def test_pages_match_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = extract(pages.withColumn("text", F.lit("clash"))).collect()
    assert len(rows) == len(source)
    for r in rows:
        h = source[r.page_id]
        parts = re.split(r"</?(?:p|h1)>", h[h.index("<article>") + 9 : h.index("</article>")])
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in extract(odd).collect()] == [("", 0)] * 3
    assert extract(pages.limit(0)).count() == 0


def test_attention_is_learned_from_documents_that_the_sample_left_out(spark):
    common = ["eat apple now", "sell pear later", "apple now eat", "later sell pear"]
    ids = [i for i in range(3000) if not held(i, 10, 0)]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    sampled = {r.doc_id for r in frame.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30)) < int(40 / len(ids) * (1 << 30))).collect()}
    outside = [i for i in ids if i not in sampled]
    texts = {i: common[i % 4] for i in ids} | {i: " ".join(["red it it apple it", "blue it it pear it"][i % 2] for _ in range(6)) for i in outside}
    probes = dict(zip([i for i in range(3000, 4000) if held(i, 10, 0)][:4], ["red it it apple", "red it it pear", "blue it it apple", "blue it it pear"], strict=True))
    got = {r.doc_id: r.score for r in L.lm_scores(spark.createDataFrame(list((texts | probes).items()), "doc_id long, text string"), max_training=40).collect()}
    a, b, c, d = (got[i] for i in probes)
    # pairs of neighbours cannot tell which fruit follows which colour
    assert sampled and a - b - c + d > 0.01, (a, b, c, d)


def test_training_over_all_documents_uses_each_id_once_and_raises_their_likelihood():
    rng = np.random.default_rng(4)
    seqs = [np.append((np.cumsum(rng.integers(1, 3, k)) * 7 % 40), 40) for k in (1, 5, 23, 24, 25, 60, 200) * 30]
    tokens, lengths = np.concatenate(seqs), np.asarray([len(s) for s in seqs])
    model = L.train(seqs[:20], 40, epochs=1)
    parts = []
    for mine in np.array_split(np.arange(len(seqs)), 3):
        own = L.Refiner(model)
        for half in np.array_split(mine, 2):
            own.add(np.concatenate([seqs[i] for i in half]), lengths[half])
        own.end()
        assert own.met.sum() == lengths[mine].sum() and not len(own.feed)
        parts += own.changes()
    by = {}
    for p in parts:
        by.setdefault(p[0], []).append(p)
    after = L.refined(model, ((k, *L.merged_changes(iter(v))) for k, v in by.items()))
    met = np.bincount(model.code[L._before(tokens, lengths, 40)], minlength=len(model.emit))
    counted = np.zeros_like(met)
    for k, v in by.items():
        rows, times, _ = L.merged_changes(iter(v))
        if k >= 0:
            counted[rows] = times
    assert (counted == met).all()
    assert after.score(tokens, lengths).sum() > model.score(tokens, lengths).sum()
    # one part alone is its own mean
    own = L.Refiner(model)
    own.add(tokens, lengths)
    own.end()
    alone = L.refined(model, own.changes())
    assert all(np.allclose(alone.weights[k], own.weights[k], atol=1e-5) for k in ("embed", *L.PROJECTIONS))


def test_lean_gradients_are_those_of_the_network():
    rng = np.random.default_rng(5)
    m = L.train([np.append(rng.integers(0, 40, 300), 40)], 40, epochs=1)
    ids, want = (rng.integers(0, len(m.emit), (3, m.window)) for _ in range(2))
    w = {k: x.astype(np.float64) for k, x in m.weights.items()}
    kept = L._forward(w, ids)
    gamma = kept[-1] * m.emit[want]
    full = L._backward(w, ids, kept, (kept[-1] - gamma / gamma.sum(axis=2, keepdims=True)) / want.size)
    some, rows, by_row = L._gradients(m.weights, m.emit, ids, want, m.causal)
    for a, b in [(some[k], full[k]) for k in L.PROJECTIONS] + [(by_row, full["embed"][rows])]:
        assert np.abs(a - b).max() < 1e-5 * max(1e-3, np.abs(b).max()) + 1e-8


def test_words_of_a_task_are_encoded_once(monkeypatch):
    ids = L.WordIds(L.VOCABULARY)
    blocks = [[f"the cat {w} sat".encode(), f"on {i} mats".encode(), "ünï　cödé".encode()] for i, w in enumerate(["big", "small", "big", "old"])]
    want = [L.sequences(b, ids) for b in blocks]
    asked, encode = [], ids.encode
    monkeypatch.setattr(ids, "encode", lambda words: asked.extend(words) or encode(words))
    known = L.KnownWords(ids)
    for most in (1 << 19, 3):  # at last all is forgotten before each block
        monkeypatch.setattr(L, "KNOWN", most)
        for block, (tokens, lengths) in zip(blocks, want, strict=True):
            *words, code, n = L._words(block)
            got = L._expand(*known.get(*words), code, n, ids.end)
            assert np.array_equal(got[0], tokens) and np.array_equal(got[1], lengths)
        if most > 3:
            assert len(asked) == len(set(asked)) and set(asked) == {w for b in blocks for t in b for w in t.split()}


def test_exponents_are_cut_only_where_one_is_too_large(monkeypatch):
    rng = np.random.default_rng(4)
    seqs = [np.append(rng.integers(0, 40, k), 40) for k in (30, 60)]
    m = L.train(seqs * 4, 40, epochs=1)
    m.weights["follow"][-1] = 70  # of ids that are never met here
    tokens, lengths = np.concatenate(seqs), np.asarray([len(s) for s in seqs])
    ids, want = (m.code[rng.choice(tokens, (4, 24))] for _ in range(2))
    cut, minimum = [], np.minimum
    monkeypatch.setattr(L.np, "minimum", lambda a, b, **how: (cut.append(b) if np.isscalar(b) and b == 60 else None, minimum(a, b, **how))[1])
    plain, grads = m.score(tokens, lengths), L._gradients(m.weights, m.emit, ids, want, m.causal)[0]
    assert not cut and np.isfinite(plain).all() and all(np.isfinite(g).all() for g in grads.values())
    m.weights["follow"] = m.weights["follow"] + np.float32(100)  # every weight by the same factor, which the cut bounds
    assert np.isfinite(m.score(tokens, lengths)).all() and cut
