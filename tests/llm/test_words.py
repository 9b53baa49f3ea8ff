"""Licences, decontamination, mixing and Jaccard classes against brute force."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from evispark.llm import decontam, jaccard, license, mixing
from evispark.llm.texts import SPACES, word_hashes

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))


def test_words_are_split_as_the_contract_says(spark, table):
    texts = [None, "", "".join(map(chr, range(1, 0x250))), "a\x00b É|é~ü\x7fx", " x\t\ty\x0bz\xa0q\x1cw ", "\x85\u2028 \u3000"]
    rows = table(texts).select("doc_id", license.words_of(F.col("text")).alias("w"), mixing.n_words(F.col("text")).alias("n")).collect()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["w"] == words(t) and r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", t))


def test_licenses(spark, table):
    texts = [None, "", "Under the MIT license.", "x under\nthe, mit license CC BY-NC and Apache License, Version 2.0", "under the mit licensed", "mit " * 50, "ÀÉ cc by nc cc by nc", "GNU General Public License"]
    out = {r["doc_id"]: r for r in license.digest_columns(table(texts)).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        hits = [(k, label) for label, p in license.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (out[i]["n_words"], out[i]["n_base"]) == (len(w), len(hits)), t
        assert out[i]["first_word"] == (min(hits)[0] if hits else None) and out[i]["last_word"] == (max(hits)[0] if hits else None)
        assert out[i]["base_labels"] == ",".join(sorted({x for _, x in hits}))
    assert out[7]["labels"] == "gpl" and 0 < out[7]["score"] < 0.1 and out[2]["score"] == 1.0
    gpl = next(t for label, _, t in license.TEMPLATES if label == "gpl")
    edited = ["Copyright 2020. " + gpl, gpl.replace("hope that it will be useful", "hope that you will like this"), "General Public License of GNU", gpl.split("redistribute ")[1]]
    scores = [r["score"] for r in sorted(license.digest_columns(table(edited)).collect(), key=lambda r: r["doc_id"])]
    assert scores[0] == 1.0 and 0.85 < scores[1] < 1.0 and scores[2] == 0.0 and 0.8 < scores[3] < 1.0
    for label, p, t, at, _ in license.all_templates():
        assert t[at : at + len(p)] == p, label
    assert license.digest_columns(table([])).count() == 0


def test_licenses_with_altered_words(spark, table):
    r = random.Random(6)
    texts = []
    for label, _, text in license.TEMPLATES:
        own = words(text)
        for changed in (0, 0.1, 0.2, 0.3):
            for _ in range(4):
                noise = ["lorem"] * r.randrange(4)
                altered = [w if r.random() >= changed else "x" for w in own]
                cut = r.choice([0, 0, 3])
                texts.append(" ".join([*noise, *altered[cut:], *noise, *(own if r.random() < 0.2 else [])]))
    got = {x["doc_id"]: x["hits"] for x in license.find_licenses(table(texts)).collect()}
    rare = 0
    for i, t in enumerate(texts):
        w, want = words(t), set()
        for label, p, own, at, base in license.all_templates():
            for start in range(-len(own), len(w)):
                stands = [0 <= start + k < len(w) and w[start + k] == own[k] for k in range(len(own))]
                inside = sum(stands[at : at + len(p)])
                tolerated = not base and 100 * sum(stands) >= 80 * len(own) and 2 * inside >= len(p)
                if inside == len(p) or tolerated:
                    want.add((max(start + at, 0), label, base, round(sum(stands) / len(own), 9)))
                    rare += inside < len(p)
        assert {(h["start"], h["label"], h["base"], round(h["share"], 9)) for h in got[i]} == want and len(got[i]) == len(want)
    assert rare > 10


def overlap(docs, items):
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, b in items:
            v = words(b)
            n = min(10, len(v))
            grams = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if v else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found.add(str(k))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontamination(spark, table):
    r = random.Random(3)
    vocabulary = ["a", "b", "É", "dé", "x9"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(n))) for k, n in enumerate([0, 1, 3, 10, 11, 14, 25])] + [(50, None), (51, "rare"), (10, "É é")]
    docs = [None, "", "rare", "É é", "..."] + [". ".join(r.choice(vocabulary) for _ in range(r.randrange(60))) for _ in range(40)]
    docs += [f"A, {items[6][1].upper()} b", items[6][1]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (decontam.BLOCK_WINDOWS, 7):
        found = decontam.find_overlaps(table(docs), bench, block_windows=limit)
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        got = {x["doc_id"]: (x["n_words"], x["n_hit"], x["n_items"], x["sha"], x["n_hit"] > 0) for x in found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("sha")).collect()}
        assert got == overlap(enumerate(docs), items)
        kept = {x["doc_id"] for x in decontam.remove_contaminated(table(docs), bench, block_windows=limit).collect()}
        assert kept == {i for i, v in got.items() if not v[4]}
    assert decontam.digest_columns(table(docs), bench.limit(0)).where("contaminated").count() == 0
    assert decontam.digest_columns(table([]), bench).count() == 0


def fill(sizes, weights):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {k: left * w[k] / sum(w[x] for x in free) for k in free}
        over = {k for k in free if share[k] > 3 * sizes[k]}
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
            left -= target[k]
        free -= over
    return {k: target.get(k, 0.0) for k in names}


def test_mixing(spark, table):
    r = random.Random(5)
    texts = ["w " * r.randrange(1, 90) for _ in range(120)] + [None, "", " "]
    sources = [r.choice(["a", "b", None, "c", "A", "é"]) for _ in texts[:-1]] + ["only-empty"]
    docs = table([*texts, texts[0]], sources=[*sources, sources[0]], ids=[*range(len(texts)), 0])
    pieces, rows = mixing.mix(docs, block_tokens=16)
    rows = rows.collect()
    sizes = defaultdict(int)
    for x in rows:
        sizes[x["source"]] += x["size"]
    want = fill(dict(sizes), mixing.WEIGHTS)
    taken = defaultdict(int)
    for x in rows:
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - want[x["source"]]) < 1e-6
        assert x["size"] == len((dict(enumerate(texts))[x["doc_id"]] or "").split()) and 0 <= x["taken"] <= 3 * x["size"]
        taken[x["source"]] += x["taken"]
    for k in sizes:
        assert abs(taken[k] - want[k]) <= 1
    agree = lambda found: sorted(map(repr, found))
    assert agree(rows) == agree(mixing.mix(docs.repartition(7), block_tokens=16)[1].collect())
    assert len({(x["row_key"], x["row_check"]) for x in rows}) == len(rows)
    assert len(rows) == len(texts) + 1
    # Any stretch of the schedule has nearly the target shares.
    by_key = {x["row_key"]: x["source"] for x in rows}
    slots = defaultdict(lambda: defaultdict(int))
    for x in pieces.collect():
        slots[x["slot"]][by_key[x["row_key"]]] += x["n_words"]
    order = sorted(slots)
    half = order[: len(order) // 2]
    for k, t in want.items():
        assert abs(sum(slots[s][k] for s in half) - t / 2) <= 16 * 6
    assert mixing.mix(table([]))[1].count() == 0
    assert [x["taken"] for x in mixing.mix(table([None, ""]))[1].collect()] == [0, 0]


def classes(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
        sets[i] = {tuple(w[k : k + min(4, len(w))]) for k in range(len(w) - min(4, len(w)) + 1)} if w else set()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


def near(r, base, edits):
    w = list(base)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_jaccard_classes(spark, table):
    r = random.Random(11)
    fresh = lambda n: [f"t{r.randrange(4000)}" for _ in range(n)]
    passage = fresh(40)
    docs = [None, "", "one", "ONE", "one two", "one two three four", " one\ttwo  three four "]
    docs += [" ".join(fresh(r.randrange(3, 120))) for _ in range(60)]
    docs += [" ".join(fresh(r.randrange(2, 60)) + passage) for _ in range(40)]
    for size, copies in ((150, 60), (60, 40), (30, 30), (12, 25)):
        base = fresh(size)
        docs += [near(r, base, r.randrange(0, max(2, size // 20))) for _ in range(copies)] + [" ".join(base)] * 5
    chain = fresh(200)
    for k in range(30):  # each a step from the one before it
        chain = [*chain[3:], *fresh(3)]
        docs.append(" ".join(chain))
    r.shuffle(docs)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.link_classes(table(docs)).collect()}
    assert got == classes(enumerate(docs))


def test_jaccard_links_behind_short_lists(spark, table):
    # 33 of 37 shingles stand in all documents; two documents of each lot share one or two more, in short lists.
    docs = []
    for lot in range(3):
        template = [f"t{lot}x{k}" for k in range(36)]
        for d in range(20):
            both = [f"b{lot}x{k}" for k in range(1 + lot % 2)] if d in (4, 13) else []
            docs.append(" ".join(template + both + [f"u{lot}x{d}x{k}" for k in range(4 - len(both))]))
    want = classes(enumerate(docs))
    assert sum(c != i for i, (_, c) in want.items()) == 3
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.link_classes(table(docs)).collect()}
    assert got == want


def test_jaccard_links_of_sets_that_share_templates(spark, table):
    # Documents of one template, of which 75 to 100 % is kept: lists are longer than SHORT and many pairs are near the threshold.
    r = random.Random(0)
    docs = []
    for lot in range(4):
        template = [f"t{lot}x{k}" for k in range(r.choice([30, 60, 103]))]
        for _ in range(3 * jaccard.SHORT):
            keep = r.uniform(0.75, 1)
            cut = int(len(template) * (1 - keep))
            at = r.randrange(len(template) - cut + 1)
            own = [f"u{r.randrange(200)}" for _ in range(r.randrange(cut + 2))]
            docs.append(" ".join(r.choice([template[:at] + own + template[at + cut :], own + template[cut:], template[cut:] + own])))
    # 8 own words and 95 shared ones, twice, among documents of 9 own words and the last 94.
    shared = [f"s{k}" for k in range(95)]
    docs += [" ".join([f"o{d}x{k}" for k in range(8)] + shared) for d in range(2)]
    docs += [" ".join([f"p{d}x{k}" for k in range(9)] + shared[1:]) for d in range(40)]
    r.shuffle(docs)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.link_classes(table(docs)).collect()}
    assert got == classes(enumerate(docs))


def test_jaccard_joins_in_place_of_broadcasts(spark, table, monkeypatch):
    monkeypatch.setattr(jaccard, "IDS_MAX", 0)
    r = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    docs = [near(r, base, r.randrange(4)) for _ in range(50)] + [f"other text of its own {k} and more words" for k in range(30)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.link_classes(table(docs)).collect()}
    assert got == classes(enumerate(docs))


def test_jaccard_odd_rows(spark, table):
    out = jaccard.link_classes(table(["a b c d e", "a b c d e", "x y", None], ids=[5, None, 5, 9])).collect()
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["n_shingles"], x["component_id"]) for x in out if x["doc_id"] is not None) == [(False, 5, 1, 5), (False, 5, 2, 5), (False, 9, 0, 9)]
    assert [x["component_id"] for x in out if x["doc_id"] is None] == [None]
    assert jaccard.link_classes(table([])).count() == 0


def test_word_hashes_are_those_of_words():
    texts = [b"", b" ", b"One two", b"x" * 70000 + b" two", b"TWO\n\x0bone"]
    hashes, counts = word_hashes(texts, SPACES)
    assert counts.tolist() == [0, 0, 2, 2, 2]
    assert hashes[0] == hashes[5] and hashes[1] == hashes[3] == hashes[4] and len(set(hashes.tolist())) == 3
