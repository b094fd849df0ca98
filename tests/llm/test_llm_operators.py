"""Every operator against brute force on odd rows, and on empty tables."""

from __future__ import annotations

import collections
import dataclasses
import hashlib
import math
import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import OTHER
from pyspark.sql import functions as F

from parcella.llm import (
    decontamination,
    html_blocks,
    licenses,
    minmax,
    pieces,
    pii,
    quality,
    sais,
    suffix_dedup,
    topk,
    toxicity,
)

SF = "/root/testdata/sf0.01"


def rows_of(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


# 1: benchmark decontamination


def test_leaks_are_found_exactly_and_reworded(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    hosts, draw, planted = list(texts.values())[:80], random.Random(3), {}
    rows = []
    for k, (item, text) in enumerate(items):
        reworded = [draw.choice(hosts[k].split()) if draw.random() < 0.15 else w for w in text.split()]
        for words in (text.split(), reworded):
            host = hosts[(7 * k) % 80].split()
            at = draw.randint(0, len(host))
            planted[10_000_000 + len(rows)] = (item, words is reworded)
            rows.append((10_000_000 + len(rows), " ".join(host[:at] + words + host[at:])))
    every = documents.union(spark.createDataFrame(rows, "doc_id long, text string"))
    found = decontamination.find_leaks(every, benchmark).where("size(leaks) > 0")
    found = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in found.collect()}
    exact = {(d, i) for d, t in texts.items() for i, b in items if b in t}
    assert all(i in found.get(d, ()) for d, i in exact)
    assert {d for d in found if d < 10_000_000} == {d for d, _ in exact}, "clean documents are left alone"
    for changed, least in ((False, 1.0), (True, 0.9)):
        own = [d for d, (_, c) in planted.items() if c == changed]
        assert sum(planted[d][0] in found.get(d, ()) for d in own) >= least * len(own)


def test_search_of_windows_against_brute_force(monkeypatch):
    """Every window with every chunk, word by word; small tiles, repeated words, empty, short and long texts."""
    own, draw = decontamination, random.Random(17)
    monkeypatch.setattr(own, "TILE", 32)
    pool = [f"w{k}" for k in range(60)]
    items = [" ".join(draw.choices(pool, k=n)) for n in (1, 5, 9, 24, 25, 40, 90)]
    texts = ["", "w1", items[3]] + [" ".join(draw.choices(pool, k=draw.randint(1, 200))) for _ in range(20)]
    for item in items:
        words = [w if draw.random() < 0.8 else draw.choice(pool) for w in item.split()]
        texts.append(" ".join(draw.choices(pool, k=30) + words + draw.choices(pool, k=draw.randint(0, 50))))
    generator = np.random.default_rng(4)
    idf, basis = np.ones(own.SIZE), generator.standard_normal((own.SIZE, 8)).astype(np.float32)
    table = np.vstack([basis, np.zeros((1, 8), np.float32)])
    block = own._block(list(range(len(items))), items, idf, table)
    hashes, bounds, _, _ = own.ALNUM.words(*own.utf8(own.pa.array(texts)))
    found = own._search(hashes, bounds, block, table)

    vector = lambda words: table[own._bucket(words)].sum(0)
    item_words, expected, close = own._text_words(items), {}, 0
    for r, words in enumerate(own._text_words(texts)):
        for k, item in enumerate(item_words):
            begins = set()
            size = min(own.PHRASE, len(item))
            runs = {}
            for a in range(len(item) - size + 1):
                runs.setdefault(tuple(item[a : a + size].tolist()), a)
            for a in range(len(words) - size + 1):
                if tuple(words[a : a + size].tolist()) in runs:
                    begins.add(a - runs[tuple(words[a : a + size].tolist())])
            parts = -(-len(words) // own.STRIDE)
            for a in [own.STRIDE * x for x in range(max(min(1, parts), parts - own.WINDOW // own.STRIDE + 1))]:
                window = words[a : a + own.WINDOW]
                for c in np.flatnonzero(block.chunk_item == k).tolist():
                    at = int(block.chunk_at[c])
                    chunk = item[at : at + own.WINDOW]
                    x, y = vector(window), vector(chunk)
                    cosine = x @ y / np.linalg.norm(x) / np.linalg.norm(y)
                    shared = sum(w in set(window.tolist()) for w in chunk.tolist())
                    if cosine >= own.COSINE * math.sqrt(len(chunk) / own.WINDOW) and shared >= own.SHARED * len(chunk):
                        begins.add(a - at)
                        close += 1
            for begin in begins:
                stretch = words[max(0, begin - own.SLACK) : begin + len(item) + own.SLACK].tolist()
                share = own.common_words(item.tolist(), stretch) / len(item)
                answer = {int(block.vocabulary[x - 1]) for x in block.answers[k]} <= set(stretch)
                if share >= own.COVERED or share >= own.COVERED_WITH_ANSWER and answer:
                    expected[r, k] = max(share, expected.get((r, k), 0.0))
    assert close > 20 and set(found) == set(expected) and (2, 3) in found
    # Stretches that begin within STRIDE words of each other are tried once, so a share may be a little less.
    assert all(found[x] <= expected[x] for x in found)


def test_any_ids_are_decoded(spark):
    model = pieces.Vocabulary.load(pieces.MODEL)
    n, a = len(model.content), model.pieces[" a"][0]
    rows = [(1, None), (2, []), (3, [None]), (4, [n, -1]), (5, [a, n + 7, a]), (6, [model.byte_ids[0xE4]]), (7, [model.pieces["b"][0]])]
    got = pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()
    expected = {1: "", 2: "", 3: "\ufffd", 4: "\ufffd\ufffd", 5: "a\ufffd a", 6: "\ufffd", 7: "b"}
    assert {r["doc_id"]: r["decoded"] for r in got} == expected
    assert pieces.decode(spark.createDataFrame([], "doc_id long, ids array<int>")).count() == 0


def test_leaks_in_a_third_of_the_documents(spark):
    """An item in very many documents, which differ otherwise, is as sure to be found as a rare one."""
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    item, text = min(map(tuple, benchmark.select("item_id", "text").collect()))
    draw, rows = random.Random(8), []
    for k, r in enumerate(documents):
        host = (r["text"] or "").split()
        at = draw.randint(0, len(host))
        rows.append((k, " ".join([*host[:at], *(text.split() if k % 3 == 0 else ()), *host[at:]])))
    found = decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    hits = {r["doc_id"] for r in found.where(F.array_contains("leaks.item_id", item)).collect()}
    assert all(k in hits for k in range(0, len(rows), 3))


def test_leaks_in_long_documents(spark):
    """What is found does not depend on how long the documents are."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r["text"]]
    joined = [" ".join(texts[k : k + 8]).split() for k in range(0, len(texts), 8)]
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    draw, rows, planted = random.Random(9), [(k, " ".join(x)) for k, x in enumerate(joined)], {}
    for item, text in map(tuple, benchmark.select("item_id", "text").collect()):
        for share in (0, 0.25):
            host, words = draw.choice(joined), text.split()
            words = [draw.choice(host) if draw.random() < share else w for w in words]
            at = draw.randint(0, len(host))
            planted[10_000_000 + len(rows)] = (item, share)
            rows.append((10_000_000 + len(rows), " ".join([*host[:at], *words, *host[at:]])))
    found = decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    found = {r["doc_id"]: {x["item_id"] for x in r["leaks"]} for r in found.collect()}
    for share, least in ((0, 1.0), (0.25, 0.9)):
        own = [d for d, (_, s) in planted.items() if s == share]
        assert sum(planted[d][0] in found[d] for d in own) >= least * len(own)


def test_common_words_equals_the_table():
    draw = random.Random(4)
    for _ in range(300):
        a = [draw.randint(0, 5) for _ in range(draw.randint(1, 12))]
        b = [draw.randint(0, 5) for _ in range(draw.randint(0, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_words(a, b) == table[-1][-1]


def test_shared_words_of_pairs_against_brute_force():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(600)]
    texts = [" ".join(rng.choice(words[: 40 + 20 * k], 12 + 5 * k)) for k in range(25)]
    table = rng.standard_normal((decontamination.SIZE + 1, 4)).astype(np.float32)
    block = decontamination._block(list(range(25)), texts, np.ones(decontamination.SIZE), table)
    assert len(block.vocabulary) > decontamination.MARKS
    known = {word: k + 1 for k, word in enumerate(block.vocabulary.tolist())}
    hashes = np.concatenate([*block.words, np.arange(1, 50, dtype=np.uint64)])
    numbers = decontamination._numbers(hashes, block.vocabulary, block.leading)
    assert numbers.tolist() == [known.get(h, 0) for h in hashes.tolist()]
    windows = np.stack([numbers[k : k + decontamination.WINDOW] for k in range(len(numbers) - decontamination.WINDOW + 1)])
    window, chunk = (x.ravel() for x in np.indices((len(windows), len(block.chunks))))
    got = decontamination._shared(windows, decontamination._marks(windows), block, window, chunk)
    parts, item, at = decontamination._chunks(block.words)
    own = [[known[h] for h in part.tolist()] for part in parts]
    shared = [sum(n in have for n in own[c]) for have in map(set, windows.tolist()) for c in range(len(own))]
    wanted = [k for k, n in enumerate(shared) if n >= decontamination.SHARED * len(own[chunk[k]])]
    assert 0 < len(wanted) < len(shared) and got.tolist() == wanted


def test_operators_of_many_jobs_release_what_is_over(spark):
    def let_go(step):
        weak = spark._jvm.java.lang.ref.WeakReference(spark._jvm.java.util.ArrayList())
        step()
        return weak.get() is None

    passages = spark.createDataFrame([(list(range(k, k + 24)),) for k in range(30)], "words array<int>")
    rows = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert let_go(lambda: decontamination.singular_directions(passages, np.ones(decontamination.SIZE)))
    assert let_go(lambda: minmax.near_duplicates(rows))


def test_singular_directions_approach_the_exact_ones(spark):
    draw = np.random.default_rng(0)
    rows = [[int(x) for x in draw.integers(0, 40, 24)] for _ in range(200)]
    passages = spark.createDataFrame([(r,) for r in rows], "words array<int>")
    idf = np.zeros(decontamination.SIZE)
    idf[:40] = np.linspace(1, 3, 40)
    basis = decontamination.singular_directions(passages, idf)
    x = np.zeros((200, 40))
    for k, r in enumerate(rows):
        np.add.at(x[k], r, idf[r])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # Fewer words than directions: the projection keeps all inner products.
    assert np.allclose((x @ basis[:40]) @ (x @ basis[:40]).T, x @ x.T, atol=1e-3)


def test_directions_are_fitted_on_all_passages(spark, monkeypatch):
    """More documents than any sample; the products equal those of the dense matrix."""
    own, draw, seen = decontamination, random.Random(18), []
    pool = [f"w{k}" for k in range(300)]
    texts = [" ".join(draw.choices(pool, k=draw.choice([0, 1, 5, 24, 25, 60]))) for _ in range(4_000)] + [None]
    fit = own.singular_directions
    monkeypatch.setattr(own, "singular_directions", lambda passages, idf: seen.append((passages, idf)) or fit(passages, idf))
    benchmark = spark.createDataFrame([(1, " ".join(pool[:30]))], "item_id long, text string")
    found = own.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark)
    assert found.count() == len(texts)
    passages, idf = seen[0]
    rows = [r["words"] for r in passages.collect()]
    rows = [p for r in rows for p in (np.frombuffer(r, np.uint16).reshape(-1, own.WINDOW).tolist() if isinstance(r, (bytes, bytearray)) else [r])]
    have = collections.Counter(tuple(w for w in p if w < own.SIZE) for p in rows)
    words = [own._bucket(x).tolist() for x in own._text_words([*texts, " ".join(pool[:30])])]
    want = collections.Counter(tuple(x[a : a + own.WINDOW]) for x in words for a in own._starts(len(x), own.WINDOW))
    assert have == want
    narrow = np.random.default_rng(3).standard_normal((own.SIZE, 5)).astype(np.float32)
    used = sorted({w for p in want for w in p})
    x = np.zeros((sum(want.values()), len(used)))
    for k, p in enumerate(want.elements()):
        np.add.at(x[k], np.searchsorted(used, p), idf[list(p)])
        x[k] /= np.sqrt((idf[list(p)] ** 2).sum())
    assert np.allclose(own._products(passages, idf, narrow)[used], x.T @ (x @ narrow[used]), rtol=1e-3, atol=1e-2)


def test_leaks_odd_rows(spark, odd_documents, no_documents):
    benchmark = spark.createDataFrame([(1, " ".join(OTHER.split()[30:70])), (2, None), (None, "a b"), (3, "")], "item_id long, text string")
    found = decontamination.find_leaks(odd_documents, benchmark)
    assert found.columns == [c for c in odd_documents.columns if c != "leaks"] + ["leaks"]
    hits = collections.Counter(r["doc_id"] for r in found.where("size(leaks) > 0").collect())
    assert hits == {3: 1, 4: 1}
    assert found.count() == odd_documents.count()
    assert decontamination.find_leaks(no_documents, benchmark).count() == 0
    assert decontamination.find_leaks(odd_documents, benchmark.limit(0)).where("size(leaks) > 0").count() == 0


def test_tasks_that_multiply_grow_with_the_words():
    """Every task sends sums of one size, so few words are not dealt to many tasks."""
    assert [decontamination._tasks(n) for n in (0, 1, 4_000_001, 17_000_000, 100_000_000)] == [1, 1, 2, 5, 16]
    assert decontamination._tasks(10**9) == 32


def test_directions_take_little_of_the_driver(spark):
    passages = spark.createDataFrame([(list(range(k, k + 24)),) for k in range(300)], "words array<int>")
    tracemalloc.start()
    decontamination.singular_directions(passages, np.ones(decontamination.SIZE))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70e6, peak


# 2: toxicity


def test_toxicity_held_out(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = toxicity.score_toxicity(documents, labels.where("doc_id % 4 <> 1"))
    own = scored.join(labels.where("doc_id % 4 = 1"), "doc_id").select("toxic", F.element_at("p_toxicity", -1).alias("p")).collect()
    toxic = [r["p"] >= toxicity.THRESHOLD for r in own if r["toxic"]]
    clean = [r["p"] >= toxicity.THRESHOLD for r in own if not r["toxic"]]
    # Some texts labelled toxic hold no toxic word at all.
    assert np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.01


def test_logistic_finds_the_minimum():
    from parcella.llm.learn import logistic, sigmoid

    draw = np.random.default_rng(1)
    x = draw.standard_normal((300, 4))
    y = (x @ [1, -2, 0.5, 0] + 0.3 + draw.standard_normal(300) > 0).astype(float)
    w = logistic(x, y, 1.0, 500)
    slope = np.hstack([x, np.ones((300, 1))]).T @ (sigmoid(x @ w[:-1] + w[-1]) - y) + np.append(w[:-1], 0)
    assert np.abs(slope).max() < 0.05


def test_toxicity_is_fitted_on_all_labelled_rows(spark):
    """More rows than any sample; the penalised loss over all of them is at its minimum."""
    from parcella.llm.learn import sigmoid

    draw = random.Random(19)
    rows = []
    for k in range(12_000):
        words = [w for w in "abcdefgh" if draw.random() < 0.3]
        rows.append((k, " ".join(words), int(draw.random() < 0.1 + 0.1 * len(set(words) & set("abcd")))))
    chain = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), {})
    data, offsets = toxicity.utf8(pa.array([text for _, text, _ in rows]))
    x, y = chain.dense(*toxicity.features(data, offsets), len(rows)).astype(float), np.array([label for _, _, label in rows])
    miss, w = sigmoid(x @ chain.links[0][:-1] + chain.links[0][-1]) - y, chain.links[0]
    assert np.abs(np.append(x.T @ miss + w[:-1], miss.sum())).max() < 2
    assert w[:-1].min() < 0.2 < w[:-1].max()


def test_toxicity_odd_rows(odd_documents, no_documents, labels):
    scored = toxicity.score_toxicity(odd_documents, labels)
    assert scored.count() == odd_documents.count()
    assert all(len(p) == 3 and all(0 <= x <= 1 for x in p) for (p,) in rows_of(scored, "p_toxicity"))
    assert toxicity.score_toxicity(no_documents, labels).count() == 0
    assert toxicity.score_toxicity(odd_documents, labels.limit(0)).count() == odd_documents.count()


# 3: near duplicates


def brute_groups(rows):
    sets, nodes = {}, collections.defaultdict(set)
    for i, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
        own = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        sets[i, text] = own
        if i is not None:
            nodes[i].add(frozenset(own))
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in nodes[a] for t in nodes[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = []
    for i, text in rows:
        group = None if i is None else find(i)
        out.append((i, len(sets[i, text]), group, group is None or group == i))
    return sorted(out, key=repr)


def test_groups_odd_rows(spark, odd_documents, no_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    got = rows_of(minmax.near_duplicates(odd_documents), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got, key=repr) == brute_groups(rows)
    assert minmax.near_duplicates(no_documents).count() == 0


def test_groups_of_gradual_changes(spark, monkeypatch):
    """Chains of near copies whose ends are no copies, in buckets of several chunks."""
    monkeypatch.setattr(minmax, "CHUNK", 3)
    monkeypatch.setattr(minmax, "CHUNK_SHINGLES", 500)
    draw, rows = random.Random(5), []
    for g in range(6):
        words = [f"g{g}w{k}" for k in range(80)]
        for k in range(12):
            words = list(words)
            for _ in range(1 if k % 4 else 3):
                words[draw.randrange(80)] = f"n{g}-{k}-{draw.random()}"
            rows.append((100 * draw.randrange(10**6) + len(rows), " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(minmax.near_duplicates(frame), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got, key=repr) == brute_groups(rows)


def test_groups_of_ids_with_several_texts(spark):
    """The second text of an id links it just as the first one does; equal texts under many ids are one node."""
    draw, rows = random.Random(8), []
    for k in range(40):
        texts = [[f"d{k}t{t}w{i}" for i in range(60)] for t in range(2)]
        near = [*texts[draw.randrange(2)][:-1], "end"]
        rows += [(k, " ".join(w)) for w in draw.sample(texts, 2)] + [(1_000 + k, " ".join(near))]
        if k % 8 == 0:
            rows += [(k, f"only {k}"), (k, "shared by all of these five"), (-5 - k, " ".join(texts[0])), (k, " ".join(texts[1]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = rows_of(minmax.near_duplicates(frame), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got, key=repr) == brute_groups(rows)


def test_chunks_of_a_bucket_with_a_stray_member(spark, monkeypatch):
    """Members of a bucket's largest component are met with the others only, so rows grow with the members."""
    monkeypatch.setattr(minmax, "CHUNK", 4)
    written, write = [], minmax.Scratch.write

    def noted(self, df, name):
        out = write(self, df, name)
        if name == "chunks":
            written.extend(out.groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("node").alias("m")).collect())
        return out

    monkeypatch.setattr(minmax.Scratch, "write", noted)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words, f"own{i}"])) for i in range(60)]
    # Shares buckets with the others at 0.7 or so, which is too little for a link.
    rows += [(1_000 + i, " ".join([*words[: 165 + i], *(f"x{i}-{k}" for k in range(36))])) for i in range(3)]
    got = rows_of(minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got, key=repr) == brute_groups(rows)
    assert written and max(r["m"] for r in written) > 50
    assert all(r["n"] <= 2 * r["m"] + 16 * 3 for r in written)


def test_minmax_estimate_is_unbiased():
    draw = np.random.default_rng(2)
    values = draw.integers(0, 2**63, 4000, np.uint64)
    shares = []
    for k in range(20):
        own = values[k * 200 : (k + 1) * 200]
        low, high = minmax.extremes([np.unique(own[:175]), np.unique(own[25:])])
        shares.append(np.mean([(low[0] == low[1]).mean(), (high[0] == high[1]).mean()]))
    assert abs(np.mean(shares) - 0.75) < 0.03


# 4: main text of pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>"</script></head><body>
<nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- x --><div class="ad">Buy now</div><main><article>
<h1>Title &amp; more</h1><p>First   paragraph<br>goes on.<p>Second &eacute; one.</p><div class="comments"><p>Reader says</p></div>
</article></main><aside>Side</aside><footer>&copy; 2020</footer></body></html>"""


def test_blocks_and_labels():
    found = html_blocks.blocks(PAGE)
    main = [b.text for b in found if b.main and not b.ruled_out]
    assert main == ["Title & more", "First paragraph goes on.", "Second é one."]
    assert {b.text for b in found if b.ruled_out} == {"Home", "Buy now", "Reader says", "Side", "© 2020"}


@pytest.mark.parametrize(
    "opening",
    ['<div class="content-sidebar-wrap">', '<div class="no-sidebar">', '<div class="has-header">', '<div id="search-results">', '<div class="search">'],
)
@pytest.mark.parametrize("kind", ["main", "article"])
def test_wrappers_do_not_rule_out(opening, kind):
    page = f"""<nav>Home</nav>{opening}<p>Before</p><{kind}><header class="entry-header"><h1>Title</h1></header><p>Text</p>
    <section class="related-work"><p>Others</p></section><div class="share">Send</div></{kind}></div>
    <div class="ad">Buy</div><header>Site</header><footer>End</footer>"""
    found = html_blocks.blocks(page)
    assert [b.text for b in found if b.main and not b.ruled_out] == ["Title", "Text", "Others"]
    assert [b.text for b in found if b.ruled_out] == ["Home", "Send", "Buy", "Site", "End"]


@pytest.mark.parametrize(
    ("page", "kept", "out"),
    [
        ('<p>a<span class="ad">buy now</span> b</p>', ["a b"], ["buy now"]),
        ("<p>Hello <button>Share</button> world</p>", ["Hello world"], ["Share"]),
        ('<p>a <span class="ad">buy <b>it</b> <i class="promo">now</i> or</span> b <button>x</button>c</p>d', ["a b c", "d"], ["now", "buy it or", "x"]),
        ('<p>a <span class="ad">never closed</p><p>b</p>', ["a", "b"], ["never closed"]),
        ('<p>a <span class="ad">buy<p>b', ["a", "b"], ["buy"]),
        ('x <a class="share">one <div>two</div> three</a> y', ["x", "y"], ["one", "two", "three"]),
        ('<span class="search">x<main><p>a</p></main></span>y', ["x", "a", "y"], []),
        ("<details><summary>Sum</summary>Body</details>", ["Sum", "Body"], []),
        ("<table><caption>Cap</caption><tr><td>Cell</table><fieldset><legend>Leg</legend>Set</fieldset>", ["Cap", "Cell", "Leg", "Set"], []),
    ],
)
def test_parts_inside_a_line(page, kept, out):
    found = html_blocks.blocks(page)
    assert [b.text for b in found if not b.ruled_out] == kept
    assert [b.text for b in found if b.ruled_out] == out


def test_articles_of_comments_are_ruled_out():
    page = '<article><p>Text</p></article><div class="comments"><article><p>Reader</p></article></div>'
    assert [(b.text, b.ruled_out) for b in html_blocks.blocks(page)] == [("Text", False), ("Reader", True)]


def test_all_words_of_a_block_count():
    same = " ".join(["same"] * 300)
    rows = [html_blocks.vectors([html_blocks.Block(f"{same} {end}", (), False, False)])[0] for end in ("", "| x", "other " * 300)]
    words = slice(html_blocks.PATH_SIZE, html_blocks.PATH_SIZE + html_blocks.WORD_SIZE)
    assert rows[0][-3] == 0 and rows[1][-3] == 1
    assert not np.allclose(rows[0][words], rows[2][words], atol=0.5)
    assert all(math.isclose(r[words].sum(), 8, rel_tol=1e-3) for r in rows)


def test_recurrent_gradients():
    draw = np.random.default_rng(0)
    net = html_blocks.Network.fresh()
    net.weights = {k: v.astype(float) for k, v in net.weights.items()}
    x = draw.standard_normal((4, 2, html_blocks.INPUT))
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = (draw.random((4, 2)) > 0.5).astype(float)

    def loss():
        z = net.margins(x, mask)
        return np.where(mask, np.logaddexp(0, z) - y * z, 0).sum() / mask.sum()

    for name, g in net.gradients(x, y, mask).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = net.weights[name][at], 1e-3
        net.weights[name][at] = kept + step
        up = loss()
        net.weights[name][at] = kept - step
        down = loss()
        net.weights[name][at] = kept
        assert math.isclose((up - down) / (2 * step), g[at], rel_tol=2e-2, abs_tol=1e-5)


def test_pages_equal_their_articles(spark):
    import html as entities

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_blocks.extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)


def test_copies_of_a_page_are_learnt_from_once(spark, monkeypatch):
    pages = spark.createDataFrame([(k, PAGE if k else f"<p>{PAGE}") for k in range(50)], "page_id long, html string")
    monkeypatch.setattr(html_blocks, "train", len)
    assert html_blocks.fit(pages) == 2


def test_pages_odd_rows(spark):
    long_page = "<article>" + "<p>" + "word " * 20_000 + "</p>" * 2 + "<p>x" * 3_000 + "</article>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p"), (4, "u", "a < b > c <"), (5, "u", long_page), (6, "u", "<div>" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = html_blocks.extract_text(pages)
    texts = collections.defaultdict(list)
    for i, t in rows_of(got, "page_id", "text"):
        texts[i].append(t)
    assert texts[1][0] == texts[1][1] == "Title & more\nFirst paragraph goes on.\nSecond é one."
    assert texts[2] == texts[3] == texts[6] == [""] and None not in texts[5]
    assert len(texts[5][0]) > 90_000
    assert html_blocks.extract_text(pages.limit(0)).count() == 0


# 5: pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.MODEL)


def test_shared_prefixes_change_nothing(vocabulary):
    """Best sums over all segmentations, word by word, without sharing."""
    words = [" " + w for w in ("", "a", "ab", "abc", "abcd", "unbelievable", "unbelievably", "日本語", "wörld", "▁▁", "x\ty", "the", "then")]
    scores = {i: s for i, s in vocabulary.pieces.values()} | {i: vocabulary.byte_score for i in vocabulary.byte_ids}
    for word, ids in pieces.segmented(words, vocabulary).items():
        own = np.frombuffer(ids, np.int32).tolist()
        assert b"".join(vocabulary.content[i] for i in own).decode() == word
        best = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                part = word[start:end]
                if part in vocabulary.pieces:
                    best[end] = max(best[end], best[start] + vocabulary.pieces[part][1])
                elif len(part) == 1:
                    best[end] = max(best[end], best[start] + vocabulary.byte_score * len(part.encode()))
        assert math.isclose(sum(scores[i] for i in own), best[-1])


def test_decoding_joins_whole_rows(vocabulary):
    """Row by row as before: joined bytes, one leading space less, U+FFFD for what is no UTF-8; no row is decoded by itself."""
    draw, n = random.Random(20), len(vocabulary.content)
    content = [*vocabulary.content, "\ufffd".encode()]
    space = vocabulary.content.index(b" ")
    special = [i for i in range(n) if not vocabulary.content[i]]
    for pool in (range(n), sorted(i for i, _ in vocabulary.pieces.values())):
        rows = [draw.choices(pool, k=draw.choice([0, 1, 2, 30])) for _ in range(400)] + [[], [space], [space, space], [*special, space, space], special]
        bounds, ids = np.cumsum([0] + [len(r) for r in rows]), np.array([i for r in rows for i in r], np.int32)
        got = pieces._texts(ids, bounds, pa.array(content, pa.large_binary())).to_pylist()
        assert got == [b"".join(content[i] for i in r).removeprefix(b" ").decode(errors="replace") for r in rows]


def test_few_substrings_are_looked_up(vocabulary):
    """A word costs look-ups for ends of pieces only, not for all its substrings."""

    class Counted(dict):
        looked = 0

        def get(self, *key):
            Counted.looked += 1
            return super().get(*key)

    word, own = " " + "xqzj" * 2_000, dataclasses.replace(vocabulary, ends=Counted(vocabulary.ends))
    assert pieces.segmented([word], own) == pieces.segmented([word], vocabulary)
    assert Counted.looked < 4 * len(word)


def test_round_trip_odd_rows(odd_documents, no_documents):
    both = pieces.decode(pieces.encode(odd_documents))
    assert both.count() == odd_documents.count()
    assert both.where("decoded <> coalesce(text, '')").count() == 0
    assert both.where("coalesce(text, '') = '' AND size(ids) > 0").count() == 0
    assert pieces.encode(no_documents).count() == 0


# 6: personal data


def brute_spans(text):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii._luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    return [(kind, *m.span()) for kind, p, good in kinds for m in re.finditer(p, text) if good(m[0])]


def test_base_spans_equal_the_patterns(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice(draw.choice(["ab.@-", "0123456789", "+ ()-.", "@a.b1", "é%_ "])) for _ in range(draw.randint(0, 60))) for _ in range(5_000)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text in texts:
        assert [(k, a, b) for k, a, b, base in pii.spans_of(text) if base] == brute_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("mail joe (at) site [dot] org now", "email", "joe (at) site [dot] org"),
        ("joe at site dot co dot uk ok", "email", "joe at site dot co dot uk"),
        ("ｊｏｅ＠ｓｉｔｅ．ｏｒｇ x", "email", "ｊｏｅ＠ｓｉｔｅ．ｏｒｇ"),
        ("call +four nine one five one two three four five six", "phone", "+four nine one five one two three four five six"),
        ("at １０．0．0．1 there", "ip", "１０．0．0．1"),
    ],
)
def test_disguises_map_back(text, kind, part):
    assert [(k, text[a:b]) for k, a, b, base in pii.spans_of(text) if not base] == [(kind, part)]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("joe\tat\tsite.org", "email"),
        ("joe <@> site.org", "email"),
        ("joe ( @ ) site.org", "email"),
        ("joe@site<.>org", "email"),
        ("joe@site ( . ) org", "email"),
        (" ".join(["+one", *["one"] * 9]), "phone"),
    ],
)
def test_disguises_need_no_other_sign(text, kind):
    assert [(k, text[a:b]) for k, a, b, base in pii.spans_of(text) if not base] == [(kind, text)]


def test_rewriting_keeps_the_source_of_every_character():
    """Against two positions per character."""
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice("abc") for _ in range(draw.randint(1, 30)))
        own, chars = pii.Rewritten(text), [(c, i, i + 1) for i, c in enumerate(text)]
        for _ in range(3):
            cuts = sorted(draw.sample(range(len(chars) + 1), min(len(chars) + 1, 2 * draw.randint(0, 3)) // 2 * 2))
            pieces = [(a, b, "x" * draw.randint(0, 3)) for a, b in zip(cuts[::2], cuts[1::2])]
            own.replace(pieces)
            for a, b, new in reversed(pieces):
                chars[a:b] = [(c, chars[a][1], chars[b - 1][2]) for c in new]
        assert own.text == "".join(c for c, _, _ in chars)
        for a in range(len(chars)):
            for b in range(a + 1, len(chars) + 1):
                assert own.source(a, b) == (chars[a][1], chars[b - 1][2])


def test_rewriting_long_texts_in_bounded_memory():
    tracemalloc.start()
    spans = pii.spans_of("word " * 400_000 + "joe (at) site [dot] org")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [s[1:] for s in spans] == [(2_000_000, 2_000_023, False)]
    assert peak < 20_000_000


def test_personal_data_odd_rows(odd_documents, no_documents):
    found = pii.find_personal_data(odd_documents)
    spans = {r["doc_id"]: [(s["kind"], s["base"]) for s in r["spans"]] for r in found.collect()}
    assert spans[12] == [("email", True), ("email", False)] and spans[5] == spans[6] == []
    masked = found.where("doc_id = 12").select(pii.mask("text", "spans")).first()[0]
    assert masked == "mail [EMAIL] or [EMAIL] ▁x  two  spaces\n"
    assert pii.find_personal_data(no_documents).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "The cat sat at home. A dot at the end, one two three.",
        "The shop closed at 10.30",
        "boils at 99.97",
        "Priced at 4.99",
        "Priced at 4.99 dot",
        "contact us at example.com",
        "us at example.com",
        "Documents were published at example.com in May.",
        "The second, available at www.example.co.uk, is longer.",
        "Look at it. Stay at no.5 or at st.james and meet at 8.pm",
        "About 50% at example.com and 3 - at example.org",
    ],
)
def test_clean_text_has_no_spans(text):
    assert pii.spans_of(text) == []


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("write to joe.smith at site.org today", "joe.smith at site.org"),
        ("joe_7 at mail.site.co.uk", "joe_7 at mail.site.co.uk"),
        ("Please e-mail joe at site.org today", "joe at site.org"),
        ("Name (joe at site.org)", "joe at site.org"),
        ("so joe at site.co dot uk answers", "joe at site.co dot uk"),
    ],
)
def test_plain_at_of_addresses(text, part):
    assert [(k, text[a:b]) for k, a, b, base in pii.spans_of(text) if not base] == [("email", part)]


# 7: repeated byte strings


def test_suffix_arrays():
    draw = random.Random(2)
    for k in range(600):
        top = draw.choice([1, 2, 3, 255])
        own = bytes(draw.randint(0, top) for _ in range(draw.randint(1, 60)))
        own = (own[:7] * 10)[: len(own)] if k % 3 == 0 else own
        order = sorted(range(len(own)), key=lambda i: own[i:])
        text = np.frombuffer(own, np.uint8)
        assert sais.suffix_array(text).tolist() == order == sais.sorted_suffixes(list(own), 256)
        sums, back = suffix_dedup.prefix_sums(text)
        shared = sais.permuted_prefixes(text, np.array(order), 20, sums, back)
        for a, b in zip(order, order[1:]):
            n = 0
            while n < 20 and b + n < len(own) and a + n < len(own) and own[a + n] == own[b + n]:
                n += 1
            assert shared[b] == n


def brute_removal(texts, length):
    counts = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 2_000])
def test_repeats_odd_rows(spark, odd_documents, no_documents, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 20_000)
    documents = odd_documents.where("doc_id IS NULL OR doc_id <> 11")
    passage, draw = OTHER[:600], random.Random(6)
    more = [(100 + k, f"{draw.random()} {k} " * 9 + passage + f" {draw.random()}" * 9, "en", "a", 1) for k in range(8)]
    documents = documents.select("doc_id", "text").union(spark.createDataFrame([m[:2] for m in more], "doc_id long, text string"))
    got = suffix_dedup.remove_repeats(documents).collect()
    rows = documents.collect()
    want = collections.Counter(
        (r["doc_id"], *w) for r, w in zip(rows, brute_removal([(r["text"] or "").encode() for r in rows], 200))
    )
    have = collections.Counter(
        (r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["ranges"] or ()) // 2, hashlib.sha256(r["kept"]).hexdigest()) for r in got
    )
    assert have == want
    assert suffix_dedup.remove_repeats(no_documents).count() == 0


def test_repeats_of_a_hot_anchor_are_one_row_a_segment(spark, monkeypatch):
    """Repeated places stay lists of their segment, and no join deals all occurrences by their anchor alone."""
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", 1)
    monkeypatch.setattr(suffix_dedup, "BUSY", 4, raising=False)
    draw, passage = random.Random(16), OTHER[:260]
    texts = [f"{draw.random()} " * 12 + passage + f" {draw.random()}" * 12 for _ in range(30)]
    written, plans = {}, {}
    write = suffix_dedup.Scratch.write

    def spy(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        written[name] = write(self, df, name)
        return written[name]

    monkeypatch.setattr(suffix_dedup.Scratch, "write", spy)
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(documents).collect()}
    for k, (n, removed, spans, digest) in enumerate(brute_removal([t.encode() for t in texts], 200)):
        own = got[k]
        assert (own["n_bytes"], own["n_bytes"] - len(own["kept"]), len(own["ranges"]) // 2) == (n, removed, spans)
        assert hashlib.sha256(own["kept"]).hexdigest() == digest
    partly = written["partly"]
    assert 0 < partly.count() == partly.select(suffix_dedup.ID).distinct().count()
    assert "hashpartitioning(anchor#" in plans["found"] and ", share#" in plans["found"]
    assert not any("Generate" in plan for plan in plans.values())
    anchors = suffix_dedup.segments(*suffix_dedup.utf8(suffix_dedup.pa.array(texts)))
    anchors = np.concatenate([a for *_, a, _ in anchors])
    assert 0.3 < (anchors >> np.uint64(63)).mean() < 0.7, "anchors fill a bitmap evenly"


# 8: exact top-k


def test_topk_odd_rows(spark):
    draw = random.Random(7)
    rows = [(k, [draw.uniform(-1, 1) for _ in range(4)]) for k in range(120)]
    rows += [(k, [0.5, 0.5, 0.5, 0.5]) for k in range(200, 320)]  # ties
    rows += [(50, rows[3][1]), (7, rows[7][1]), (400, None), (450, [1.0, None, 0.0, 0.0]), (500, [1.0, math.nan, 0.0, 0.0])]
    rows += [(None, [1.0] * 4), (550, [math.inf, 0.0, 0.0, 0.0]), (600, [0.25, 0.5]), (601, [0.5, 0.5]), (650, []), (651, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS score")
    usable = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for q in sorted({i for i, _ in usable if i % 50 == 0}):
        own = min(v for i, v in usable if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != q and len(v) == len(own))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    got = rows_of(topk.top_k(frame), "query_id", "rank", "vec_id", "score")
    assert sorted(got) == sorted(want)
    assert topk.top_k(frame.limit(0)).count() == 0


def test_topk_sends_no_blocks_through_the_driver(spark):
    """Packed blocks look small to Spark, however many copies of them a join makes."""
    frame = spark.range(300).selectExpr("id AS vec_id", "array(cast(id AS float), 1F, 0F) AS embedding")
    best = topk.top_k(frame)
    assert len(best.collect()) == 30
    text = best._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in text and "SortMergeJoin" in text and "Broadcast" not in text


def test_topk_scores_are_exact_in_every_type():
    draw = np.random.default_rng(3)
    for most, kind in ((1 << 8, np.float32), (1 << 22, np.float64), (1 << 28, np.int64)):
        q, c = draw.integers(-most, most, (4, 48)), draw.integers(-most, most, (9, 48))
        q[0, 0] = c[0, 0] = most
        ids = np.arange(9)
        row = SimpleNamespace(dim=48, q_ids=ids[:4].tobytes(), ids=ids.tobytes(), q_vectors=q.tobytes(), vectors=c.tobytes())
        want = q @ c.T
        want[ids[:4], ids[:4]] = -topk.LIMIT
        got = topk._scores(row)
        assert got.dtype == kind and (got.astype(np.int64) == want).all()
        for low in (want[:, 5], np.full(4, -topk.LIMIT // 4), np.full(4, topk.LIMIT // 4)):
            assert [x.tolist() for x in topk._reaching(got, low)] == [x.tolist() for x in np.nonzero(want >= low[:, None])]


# 9: licences


def test_licenses_odd_rows(odd_documents, no_documents):
    found = licenses.find_licenses(odd_documents.select("doc_id", "text", "label"))
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert {p["label"] for p in by_id[13]["places"]} == {"reserved", "cc-by", "cc-by-nc"}
    assert {(p["label"], p["start"]) for p in by_id[13]["places"] if p["base"]} == {("reserved", 0), ("cc-by", 5)}
    assert by_id[5]["n_words"] == by_id[6]["n_words"] == 0 and by_id[5]["places"] == []
    assert by_id[10]["n_words"] == 120_000
    assert licenses.find_licenses(no_documents).count() == 0


def test_licence_words_and_the_kelvin_sign(spark):
    frame = spark.createDataFrame([(1, "CCé BY cc BY ALL Rights\nreserved cKc by İx _cc__by_")], "doc_id long, text string")
    row = licenses.find_licenses(frame).first()
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in frame.first()["text"]))
    assert row["n_words"] == len(words)
    places = sorted((p["label"], p["start"]) for p in row["places"])
    assert places == [("cc-by", 2), ("cc-by", 10), ("reserved", 4)]


# 10: quality


def test_quality_held_out(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    own = quality.score_quality(documents, labels).join(labels, "doc_id").where("held_out").select("score", "quality").collect()
    assert np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in own]) >= 0.93


def test_dual_descent_separates():
    draw = np.random.default_rng(0)
    x = draw.standard_normal((200, 3))
    y = np.where(x @ [1, 2, -1] > 0, 1.0, -1.0)
    w = quality.dual_descent(x.ravel(), np.tile(np.arange(3), 200), np.arange(0, 603, 3), y, np.full(200, 10.0), 3)
    assert ((x @ w > 0) == (y > 0)).mean() > 0.97


def test_quality_odd_rows(odd_documents, no_documents, labels):
    scored = quality.score_quality(odd_documents, labels)
    assert scored.count() == odd_documents.count()
    assert all(0 <= s <= 1 for (s,) in rows_of(scored, "score"))
    assert quality.score_quality(no_documents, labels).count() == 0
    assert quality.score_quality(odd_documents, labels.limit(0)).count() == odd_documents.count()
