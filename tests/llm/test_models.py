"""Language, quality, pages and fingerprints: held-out accuracy, exact fixtures and brute force."""

import hashlib
import random

import numpy as np

from evispark.llm import fuzzyhash, langid, pagetree, quality, wrappers

EN = "the of and to in that is was for with this".split()
FR = "le la les des une que qui dans pour été être".split()


def prose(r, words, n):
    return " ".join(r.choice(words) + r.choice(["", "", "s"]) for _ in range(n))


def test_language(spark, table):
    r = random.Random(2)
    texts = [prose(r, EN if i % 2 else FR, 30) for i in range(200)]
    langs, model = langid.learn(table(texts, langs=["en" if i % 2 else "fr" for i in range(200)]))
    assert langs == ["en", "fr"]
    test = [prose(r, EN, 40), prose(r, FR, 40), None, "", "123 !!", prose(r, EN, 60) + " " + prose(r, FR, 60), "w", prose(r, EN, 30000)]
    out = {x["doc_id"]: x for x in langid.identify(table(test), langs, model).collect()}
    assert [out[i]["lang_pred"] for i in (0, 1, 2, 3, 4, 7)] == ["en", "fr", "und", "und", "und", "en"]
    assert out[6]["lang_pred"] in langs and out[2]["score"] == 0.0
    assert {m["lang"] for m in out[5]["mixture"]} == {"en", "fr"} and 0.3 < out[5]["score"] < 0.7
    assert len(out[0]["mixture"]) == 1
    nothing = langid.learn(table([None, "x"], langs=[None, None]))
    assert {x["lang_pred"] for x in langid.identify(table(test), *nothing).collect()} == {"und"}
    assert {x["doc_id"] for x in langid.with_language(table(test), langs, model, 0.4).collect()} >= {0, 1, 5, 7}
    assert langid.identify(table([]), langs, model).count() == 0


def test_quality(spark, table):
    r = random.Random(4)
    good = [prose(r, EN, 40) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in prose(r, EN, 40).split()) for _ in range(50)] + [" ".join([r.choice(EN)] * 40) for _ in range(50)]
    texts = good + bad
    docs = table(texts)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(250) if i % 3] + [(1, 1), (None, 1), (4, None)], "doc_id bigint, quality int")
    model = quality.learn(docs, labels)
    out = {x["doc_id"]: x for x in quality.score(table([*texts, None, ""], ids=range(252)), model).collect()}
    held = [i for i in range(250) if i % 3 == 0]
    assert np.mean([out[i]["predicted"] == (i < 150) for i in held]) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in out.values())
    assert out[250]["score"] == out[251]["score"]
    assert quality.score(table([]), model).count() == 0
    one = quality.learn(docs, labels.where("quality = 1"))
    assert {x["predicted"] for x in quality.score(docs, one).collect()} == {1}
    none = quality.learn(docs, labels.limit(0))
    assert {x["score"] for x in quality.score(docs, none).collect()} == {0.5}


def test_a_language_does_not_depend_on_the_batch():
    r = random.Random(3)
    model = np.array([[r.random() + 0.01 for _ in range(5)] for _ in range(langid.BUCKETS)])
    model /= model.sum(axis=0)
    texts = [prose(r, r.choice([EN, FR]), r.randrange(1, 60)).encode() for _ in range(40)] + [b"", b"7"]
    names = list("abcde")
    pred, score, share = langid._judge(texts, names, model)
    for i, t in enumerate(texts):
        one = langid._judge([t], names, model)
        assert one[0] == [pred[i]] and one[1][0] == score[i] and (one[2][0] == share[i]).all()


def test_many_languages_and_texts_that_are_fitted_alone(spark, table, monkeypatch):
    r = np.random.default_rng(5)
    model = r.random((langid.BUCKETS, 40)) ** 8 + 1e-6
    model /= model.sum(axis=0)
    texts = [" ".join("".join(map(chr, r.integers(97, 110, 5))) for _ in range(k)).encode() for k in (1, 3, 10, 200, 900)] + [b"", b"1"]
    buckets, n, owner, _ = langid._trigrams(texts)
    want = langid.infer(buckets, n, owner, len(texts), model)
    for cells in (1, 4000, 40_000):
        monkeypatch.setattr(langid, "CELLS", cells)
        assert np.abs(langid.infer(buckets, n, owner, len(texts), model) - want).max() < 1e-9
    monkeypatch.undo()
    langs, model = langid.learn(table([f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} word" for i in range(1100)], langs=[f"l{i}" for i in range(1100)]))
    assert len(langs) == 1100 and model.shape[1] == 1100
    assert langid.identify(table(["aab word", None]), langs, model).count() == 2


def test_slices_count_what_the_whole_text_holds(monkeypatch):
    r = random.Random(4)
    for size in (1, 7, langid.SLICE):
        monkeypatch.setattr(langid, "SLICE", size)
        for _ in range(20):
            text = "".join(r.choice("abÉ  .1") for _ in range(r.randrange(40)))
            at, n, has = langid._counts_of(text)
            plain = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
            plain = " " + " ".join(plain.split()) + " " if plain.strip() else " "
            codes = np.array([ord(c) for c in plain], np.uint64)
            want = np.bincount(langid._hashed(codes), minlength=langid.BUCKETS) if len(codes) > 2 else np.zeros(langid.BUCKETS, np.int64)
            assert has == any(c.isalpha() for c in text) and (at == np.flatnonzero(want)).all() and (n == want[at]).all()


def test_inference_matches_plain_em():
    """All sets of the largest languages, fitted one text and one trigram at a time."""
    r = random.Random(5)
    model = np.array([[r.random() ** 3 + 1e-3 for _ in range(4)] for _ in range(langid.BUCKETS)])
    model /= model.sum(axis=0)

    def em(rows, allowed):
        share = [a / sum(allowed) for a in allowed]
        for _ in range(langid.ROUNDS):
            new = [0.0] * 4
            for b, n in rows:
                total = sum(model[b][j] * share[j] for j in range(4))
                new = [x + n * model[b][j] * share[j] / total for j, x in enumerate(new)]
            new = [x / sum(n for _, n in rows) for x in new]
            moved = max(abs(x - y) for x, y in zip(new, share, strict=True))
            share = new
            if moved < langid.TOLERANCE:
                break
        return share, sum(n * np.log(sum(model[b][j] * share[j] for j in range(4))) for b, n in rows)

    for _ in range(25):
        texts = [" ".join("".join(r.choice("abcd") for _ in range(4)) for _ in range(r.randrange(1, 40))).encode() for _ in range(2)]
        buckets, n, owner, _ = langid._trigrams(texts)
        got = langid.infer(buckets, n, owner, 2, model)
        for t in range(2):
            rows = list(zip(buckets[owner == t].tolist(), n[owner == t].tolist(), strict=True))
            order = sorted(range(4), key=lambda j: -em(rows, [1] * 4)[0][j])  # noqa: B023
            tried = []
            for size in range(1, 5):
                share, value = em(rows, [float(j in order[:size]) for j in range(4)])
                tried.append((value / langid.OVERLAP - 0.5 * size * np.log(max(2, sum(c for _, c in rows))), share))
            assert np.allclose(got[t], max(tried, key=lambda x: x[0])[1], atol=1e-9)


def test_dual_descent_reaches_the_optimum(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 2000)
    monkeypatch.setattr(quality, "TOLERANCE", 1e-9)
    r = np.random.default_rng(6)
    for _ in range(5):
        dense = r.normal(size=(30, 6)) * (r.random((30, 6)) < 0.6)
        y = np.where(dense[:, 0] + 0.5 * r.normal(size=30) > 0, 1.0, -1.0)
        rows = [np.flatnonzero(x) for x in dense]
        upper = np.where(y > 0, 0.7, 0.4)
        w, bias, alpha = quality.descend(rows, [x[i] for x, i in zip(dense, rows, strict=True)], y, upper, 6, 1)
        primal = 0.5 * (w @ w + bias**2) + (upper * np.maximum(0, 1 - y * (dense @ w + bias))).sum()
        own = np.append(dense, np.ones((30, 1)), axis=1).T @ (alpha * y)
        dual = alpha.sum() - 0.5 * own @ own
        assert np.allclose(own, [*w, bias]) and ((0 <= alpha) & (alpha <= upper)).all() and abs(primal - dual) < 1e-6


def test_quality_with_string_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(f"d{k % 20}", "good words here" if k % 2 else "bad text there") for k in range(60)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{k}", k % 2) for k in range(20)], "doc_id string, quality int")
    out = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(out) == 60 and all(x["predicted"] == int(x["doc_id"][1:]) % 2 for x in out)


def naive(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + (x == y), row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(70))) for _ in range(2))
        assert fuzzyhash._common(a, b) == naive(a, b)


MASK = (1 << 64) - 1


def rolling(text):
    """The fingerprint code point by code point, the context hashed anew at each."""
    hashes = []
    for i in range(len(text)):
        h = 0
        for k in range(min(fuzzyhash.CONTEXT, i + 1)):
            h += (ord(text[i - k]) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64)
        h &= MASK
        h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & MASK
        hashes.append(h ^ (h >> 32))

    def pieces(size):
        out, now = [], []
        for h in hashes:
            now.append(h)
            if (h >> 8) % size == size - 1:
                out.append(now)
                now = []
        out += [now] if now else []
        sums = [sum(p) & MASK for p in out]
        sums = [((s ^ (s >> 29)) * 0xBF58476D1CE4E5B9) & MASK for s in sums]
        return "".join(str(fuzzyhash.ALPHABET[(s >> (58 - 6 * k)) & 63]) for s in sums for k in range(5)), sum((h >> 8) % size == size - 1 for h in hashes)

    size = 3
    while 64 * size < len(text):
        size *= 2
    while size > 3 and pieces(size)[1] < 32:
        size //= 2
    return f"{size}:{pieces(size)[0]}:{pieces(2 * size)[0]}"


def test_fingerprint_matches_rolling_hash():
    r = random.Random(9)
    texts = ["x", "ab" * 300, "one line again\n" * 200] + ["".join(r.choice("abcdé \n𐍈") for _ in range(r.randrange(1, 3000))) for _ in range(20)]
    for t in texts:
        assert fuzzyhash.fingerprint(t) == rolling(t)


def test_likeness_of_repeated_lines_and_long_texts():
    r = random.Random(10)
    line = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randrange(2, 40)))
    prints = [fuzzyhash.fingerprint((line() + "\n") * r.randrange(1, 300)) for _ in range(300)]
    assert max(fuzzyhash.likeness(a, b) for a, b in zip(prints, prints[1:], strict=False) if a != b) < 0.5
    words = [f"w{k}" for k in range(5000)]
    for n in (300, 3000, 40000):
        text = " ".join(r.choice(words) for _ in range(n))
        edited = text[: len(text) // 2] + " ".join(r.choice(words) for _ in range(n // 2))
        assert 0.25 < fuzzyhash.likeness(fuzzyhash.fingerprint(text), fuzzyhash.fingerprint(edited)) < 0.75
        pieces = fuzzyhash.fingerprint(text).split(":")[1]
        assert len(pieces) >= 32 * fuzzyhash.PIECE


def test_fingerprints(spark, table):
    r = random.Random(8)
    texts = ["".join(r.choice("abcdé \n") for _ in range(r.randrange(800, 3000))) for _ in range(30)] + [None, "", "x", "é" * 40000, "same text " * 40, "same text " * 40]
    ids = r.sample(range(10_000), len(texts))
    for parts in (1, 5, 64):
        out = {x["doc_id"]: x for x in fuzzyhash.compare(table(texts, ids=ids), parts=parts).collect()}
        order = sorted(zip(ids, (t or "" for t in texts), strict=True))
        assert len(out) == len(order)
        for k, (i, t) in enumerate(order):
            after = order[(k + 1) % len(order)][1]
            n = len(t) // 2
            edited = t[: len(t) - n] + after[:n]
            assert out[i]["n_chars"] == len(t) and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert out[i]["fingerprint"] == fuzzyhash.fingerprint(t) and out[i]["edited_fingerprint"] == fuzzyhash.fingerprint(edited)
            assert 0 <= out[i]["near_edited"] <= 1 and 0 <= out[i]["near_next"] <= 1
    random_ones = [i for i in ids[:30]]
    assert np.mean([out[i]["near_edited"] > 0.3 for i in random_ones]) > 0.9
    assert fuzzyhash.compare(table([])).count() == 0
    assert [x["near_next"] for x in fuzzyhash.compare(table(["alone"])).collect()] == [1.0]
    assert fuzzyhash.compare(table(["a", "b", "c"], ids=[None, 4, 4])).count() == 3


def test_an_id_of_many_rows_is_split(spark, table):
    rows = fuzzyhash.neighbours(table([f"text {k}" for k in range(400)], ids=[None] * 300 + list(range(100))), parts=8).where("NOT guest").collect()
    by_part = {}
    for x in rows:
        by_part.setdefault(x["part"], []).append((x["key"], x["hash"]))
    assert max(map(len, by_part.values())) < 150
    assert [k for p in sorted(by_part) for k in by_part[p]] == sorted(k for ks in by_part.values() for k in ks)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site">Site name</header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy {n}</div>
<article><header><h1>Title {n}</h1></header><p>One &amp; two<br>more <b>bold</b> {n}</p><p>Unclosed {n}<p>Next&nbsp;  one {n}<ul><li>x<li>y {n}</ul>
<p>We use cookies to make this page better.</p>
<div class="share">tweet</div><form>name <input></form><div id="comments"><article>nice {n}</article></div></article>
<aside>Side</aside><footer>&copy; site</footer></body></html>"""


def test_pages(spark):
    want = "Title {n}\nOne & two more bold {n}\nUnclosed {n}\nNext one {n}\nx\ny {n}"
    notice = "\nWe use cookies to make this page better."
    rows = [(n, f"https://u@H.example.com:80/{n}?q", PAGE.format(n=n)) for n in range(6)]
    rows += [(10, None, PAGE.format(n=10)), (11, "https://h.example.com/", None), (12, "nonsense", ""), (13, "http://a.b/", "<p>cut off <b>here</b> & there &lt;x&gt; <a href='"), (14, "http://a.b/", "plain < text > only")]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id bigint, url string, html string").repartition(3)
    out = {x["page_id"]: x for x in wrappers.digest_columns(pages).collect()}
    assert len(out) == len(rows)
    # The notice is in each article of the host; only alignment tells that. Without a host it stays.
    assert [out[n]["text"] for n in range(6)] == [want.format(n=n).replace("\nx\n", "\n") for n in range(6)]
    assert out[10]["text"] == want.format(n=10) + notice
    assert [out[n]["text"] for n in (11, 12, 13, 14)] == ["", "", "cut off here & there <x>", "plain < text > only"]
    assert all(x["n_chars"] == len(x["text"]) for x in out.values())
    assert wrappers.digest_columns(pages.limit(0)).count() == 0


def extracted(spark, pages):
    df = spark.createDataFrame([(n, f"http://host.example.org/{n}", p) for n, p in enumerate(pages)], "page_id bigint, url string, html string")
    return [x["text"] for x in sorted(wrappers.extract(df).collect(), key=lambda x: x["page_id"])]


def test_template_of_a_host_without_article_elements(spark):
    page = "<body><div><p>Welcome to our site</p></div><div><h1>Story {n}</h1><p>Body {n} one.</p><p>Body {n} two.</p></div><div><p>All rights reserved</p></div></body>"
    pages = [page.format(n=n) for n in range(8)]
    assert extracted(spark, pages) == [f"Story {n}\nBody {n} one.\nBody {n} two." for n in range(8)]
    # The wrapper is what decides: without it every page reads otherwise.
    assert sum(wrappers.main_text(p, None) != t for p, t in zip(pages, extracted(spark, pages), strict=True)) == 8


def test_copies_of_an_article_are_no_template(spark):
    page = "<body><div><p>Welcome to our site</p></div><article><h1>Story {n}</h1><p>Body {n}.</p></article></body>"
    assert extracted(spark, [page.format(n=n) for n in (1, 2, 3, 4)] + [page.format(n=9) + f"<footer>{k}</footer>" for k in range(12)]) == [f"Story {n}\nBody {n}." for n in [1, 2, 3, 4] + [9] * 12]


def test_names_that_only_look_like_boilerplate_and_teasers():
    article = '<article><div class="share-price">12.30</div><p class="social-history">smoker</p><section id="related-work">others did</section><div class="comment-on-policy">we say</div><table class="search results"><tr><td>row</td></tr></table><div class="share-buttons">tweet</div><div class="comment-list">nice</div><section class="related posts">more</section></article>'
    assert wrappers.main_text(article, None) == "12.30\nsmoker\nothers did\nwe say\nrow"
    body = "A long paragraph of the story that stands outside of both teasers, with much to say about it all. " * 3
    teasers = f"<body><article><h2>Teaser one</h2></article><div><h1>Head</h1><p>{body}</p></div><article><h2>Teaser two</h2></article></body>"
    assert wrappers.main_text(teasers, None) == f"Head\n{body.strip()}"
    assert wrappers.main_text(f"<body><form id=f><h1>Whole page</h1><p>{body}</p></form></body>", None) == f"Whole page\n{body.strip()}"


def tree(r, depth):
    name = r.choice(["div", "section", "ul"])
    inner = "".join(tree(r, depth - 1) for _ in range(r.randrange(4))) if depth else r.choice(["<p>a</p>", "<h2>b</h2><p>c</p>", "<p>a</p><h2>d</h2><p>e</p>"])
    return f"<{name}>{inner}</{name}>"


def most_pairs(a, b):
    """Simple tree matching by its recursion over all children."""

    def match(i, j):
        if a.signs[i] != b.signs[j]:
            return 0
        p, q = pagetree._children(a.levels)[i], pagetree._children(b.levels)[j]
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for x in range(len(p)):
            for y in range(len(q)):
                best[x + 1][y + 1] = max(best[x][y + 1], best[x + 1][y], best[x][y] + match(p[x], q[y]))
        return 1 + best[-1][-1]

    return match(0, 0)


def test_alignment(monkeypatch):
    r = random.Random(12)
    for cells in (pagetree.CELLS, 4):
        monkeypatch.setattr(pagetree, "CELLS", cells)
        for _ in range(60):
            a, b = (pagetree.outline(pagetree.parse("".join(tree(r, 3) for _ in range(3)))[0]) for _ in range(2))
            pairs = pagetree.align(a, b)
            assert len(pairs) == most_pairs(a, b)
            assert len({i for i, _, _ in pairs}) == len({j for _, j, _ in pairs}) == len(pairs)
            for k, (i, j, same) in enumerate(pairs):
                assert a.signs[i] == b.signs[j] and a.levels[i] == b.levels[j] and same == (a.digests[i] == b.digests[j])
                assert not k or j > pairs[k - 1][1]


def test_wide_and_deep_pages():
    import time

    wide = ["".join(f"<dt>t{k + s}</dt><dd>d{k}</dd>" for k in range(3000)) for s in (0, 1)]
    deep = ["<div>a" * 20000 + f"<p>end {s}</p>" for s in (0, 1)]
    for first, second in (wide, deep):
        began = time.time()
        a, b = (pagetree.outline(pagetree.parse(x)[0]) for x in (first, second))
        assert pagetree.align(a, b)
        assert wrappers.main_text(second, (a, set())).split()[-1] in ("d2999", "1")
        assert time.time() - began < 20
