"""Periodic runs, multiset fingerprints and token alignment against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcella.llm import alignment, multiset_hash, periodic_runs, pii, queries
from parcella.llm.common import SPACED

SF = "/root/testdata/sf0.001"


# 11: periodic runs


def runs_by_hand(words, min_length=24, min_exponent=3):
    found = []
    for q in range(1, len(words) // min_exponent + 1):
        k = 0
        while k < len(words) - q:
            e = k
            while e < len(words) - q and words[e] == words[e + q]:
                e += 1
            run = words[k : e + q]
            if len(run) >= max(min_length, min_exponent * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                found.append((k, len(run), q))
            k = max(e, k + 1)
    return sorted(found)


def random_words(draw, n):
    words = []
    while len(words) < n:
        kind = draw.random()
        if kind < 0.3:
            words += [str(draw.randint(0, 3)) for _ in range(draw.randint(1, 30))]
        elif kind < 0.6:
            unit = [str(draw.randint(0, draw.choice([1, 5, 1000]))) for _ in range(draw.randint(1, 25))]
            words += (unit * draw.randint(2, 9))[: -draw.randint(1, len(unit))]
        elif kind < 0.7 and words:
            a = draw.randint(0, len(words) - 1)
            words += words[a : a + draw.randint(1, 60)]
        else:
            words += [str(draw.randint(0, 100_000)) for _ in range(draw.randint(1, 40))]
    return words


@pytest.mark.parametrize("least", [(24, 3), (4, 2), (10, 4), (9, 3)])
def test_runs_equal_brute_force(least):
    draw = random.Random(least[0])
    for _ in range(60):
        words = random_words(draw, draw.randint(0, 300))
        data = " ".join(words).encode()
        hashes, *_ = SPACED.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        expected = runs_by_hand(words, *least)
        assert periodic_runs.runs_of(data.split(), hashes, *least) == expected
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        assert periodic_runs.find_runs([numbers[w] for w in words], *least) == expected, "without the look ahead"


def test_runs_of_long_periodic_texts():
    for n, p in ((30_000, 1), (30_000, 9_999), (30_000, 100)):
        words = (list(range(p)) * (n // p + 1))[:n]
        assert periodic_runs.find_runs(words) == [(0, n, p)]


def edited_by_hand(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def test_runs_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op11_periodic_runs(spark, SF).collect()
    assert len(rows) == len(texts) and any(r["n_runs"] > 1 for r in rows)
    for r in rows:
        words = edited_by_hand(r["doc_id"], texts[r["doc_id"]])
        runs = runs_by_hand(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()


def test_runs_of_odd_rows(odd_documents, no_documents):
    odd = odd_documents.selectExpr("*", "'extra' AS runs", "'extra' AS collapsed")
    found = periodic_runs.with_runs(odd)
    assert found.columns == [*odd_documents.columns, "runs", "collapsed"]
    for r in found.collect():
        words = (r["text"] or "").encode().split()
        if len(words) < 1000:
            assert [tuple(x) for x in r["runs"]] == runs_by_hand(words)
            assert r["runs"] or r["collapsed"].encode() == b" ".join(words)
    assert periodic_runs.with_runs(no_documents).count() == 0


# 12: multiset hash; the query itself is compared with SQL


def test_fingerprints_ignore_order_and_follow_updates(spark):
    a, b = "one. two\nthree\nthree", "four! five\n\nsix"
    rows = [(a, b, f"{a}\n{b}", f"{b}\n{a}", None)]
    df = spark.createDataFrame(rows, "a string, b string, ab string, ba string, none string")
    prints = {c: f"f_{c}" for c in df.columns}
    f = multiset_hash.with_fingerprints(df, prints)
    r = f.select(
        "*",
        multiset_hash.insert(F.col("f_a"), F.col("f_b")).alias("inserted"),
        multiset_hash.delete(F.col("f_ab"), F.col("f_b")).alias("deleted"),
        multiset_hash.likeness(F.col("f_ab"), F.col("f_ba")).alias("same"),
        multiset_hash.likeness(F.col("f_none"), F.col("f_none")).alias("empty"),
        multiset_hash.likeness(F.col("f_a"), F.col("f_none")).alias("one_empty"),
    ).first()
    assert r["f_ab"] == r["f_ba"] == r["inserted"] and r["deleted"] == r["f_a"] != r["f_b"]
    assert (r["same"], r["empty"], r["one_empty"]) == (1.0, 1.0, 0.0)
    assert r["f_a"][0] == 4 and set(r["f_none"]) == {0} and len(r["f_a"]) == multiset_hash.LANES + 1


def test_fingerprint_lanes_by_hand(spark):
    text = "Same line.\nOther? Third part\nSame line.\n" * 3
    units = text.replace("? ", "?\n").split("\n")[:-1]
    lanes = [0] * multiset_hash.LANES
    for u in units:
        digest = hashlib.sha256(u.encode()).hexdigest()
        for c in range(4):
            number = int(digest[15 * c : 15 * c + 15], 16)
            for k in range(30):
                lanes[30 * c + k] += number >> k & 1
                lanes[120 + 30 * c + k] += number >> (k + 30) & 1
    df = spark.createDataFrame([(text,)], "text string")
    assert multiset_hash.with_fingerprints(df, {"text": "f"}).first()["f"] == [len(units), *lanes]


def test_likeness_estimates_shared_paragraphs(spark):
    rows = [(s, "\n".join(f"p{i}" for i in range(100)), "\n".join(f"p{i}" for i in range(s, s + 100))) for s in range(0, 101, 10)]
    f = multiset_hash.with_fingerprints(spark.createDataFrame(rows, "s int, a string, b string"), {"a": "fa", "b": "fb"})
    for r in f.select("s", multiset_hash.likeness(F.col("fa"), F.col("fb")).alias("near")).collect():
        assert abs(r["near"] - (1 - r["s"] / 100)) < 0.25


def test_next_documents(spark, odd_documents, no_documents):
    odd = odd_documents.selectExpr("*", "'extra' AS next_text", "'extra' AS half")
    found = multiset_hash.with_edit(multiset_hash.with_next(odd)).collect()
    assert len(found) == odd_documents.count()
    texts = collections.defaultdict(list)
    for r in found:
        texts[r["doc_id"]].append(r["text"] or "")
    ids = sorted((i for i in texts if i is not None), reverse=True) + [None]
    for r in found:
        text, follower = r["text"] or "", ids[(ids.index(r["doc_id"]) + 1) % len(ids)]
        half = len(text) // 2
        assert r["edited"] in {text[: len(text) - half] + other[:half] for other in texts[follower]}
    assert multiset_hash.with_edit(multiset_hash.with_next(no_documents)).count() == 0


def test_next_documents_across_ranges(spark):
    rows = spark.range(0, 5000, 7).selectExpr("id AS doc_id", "repeat(cast(id AS string), 3) AS text")
    found = multiset_hash.with_next(rows.repartition(16)).collect()
    for r in found:
        follower = str(r["doc_id"] - 7 if r["doc_id"] else 4998) * 3
        assert follower.startswith(r["next_text"]) and len(r["next_text"]) >= min(len(follower), len(r["text"]) // 2)


def test_fingerprints_are_native(spark):
    plan = queries.op12_multiset_hash(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 13: token alignment


def aligned_by_hand(rows):
    """Merging both sides token by token, links as a counter of every occurrence pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_MODEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_MODEL)
    letters, tokens = alignment.byte_letters(), {i: t for t, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, held = [], collections.Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a, bytes_b = [bytes(letters[c] for c in tokens[i]) for i in ids_a], [piece(i) for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            ids_a, ids_b = [], []
        ends_a, ends_b = np.cumsum([len(bytes_a[i]) for i in range(len(ids_a))]), np.cumsum([len(bytes_b[i]) for i in range(len(ids_b))])
        cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups, i, j = [], 0, 0
        for cut in cuts:
            i2, j2 = int(np.searchsorted(ends_a, cut)) + 1, int(np.searchsorted(ends_b, cut)) + 1
            groups.append((ids_a[i:i2], ids_b[j:j2]))
            i, j = i2, j2
        links = collections.Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(links.keys())
        form = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        found.append((doc_id, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(form.encode()).hexdigest() if form else ""))
    best = collections.Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return sorted(
        (
            (d, na, nb, ng, sum(c.values()), sum(n for p, n in c.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in c.items()), sha)
            for d, na, nb, ng, c, sha in found
        ),
        key=repr,
    )


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD_TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "a" * 5000), (4, "a" * 5000), (None, "ﬁ ▁x"), (6, "日本語😀\x00 x"),
    (7, "<|endoftext|> <s>"), (8, "ab" * 3000 + "é" * 999), (9, "x " * 9000), (10, "\n\t  " * 50), (11, "'s I'LL 12345 ½ ­"),
]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(alignment, "CHUNK_BYTES", 3000)
        monkeypatch.setattr(alignment, "SLICE", 50)
        monkeypatch.setattr(alignment, "LARGE_GROUP", 4)
        monkeypatch.setattr(alignment, "PROBES", 1)
    rows = ODD_TEXTS + [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS chunk", "2 AS pairs").repartition(3)
    found = sorted((tuple(r) for r in alignment.align_tokens(df).select(*ALIGNED).collect()), key=repr)
    assert found == aligned_by_hand(rows)


def test_alignment_of_no_documents(no_documents):
    assert alignment.align_tokens(no_documents).collect() == []


def test_both_encoders_agree():
    side = alignment.ByteSide(alignment.BYTE_MODEL)
    for _, text in ODD_TEXTS:
        if text:
            assert side.fast.encode_ordinary(" " + text) == side.whole.encode(" " + text, add_special_tokens=False).ids


def test_cuts_without_common_ends():
    """Ends that never meet make one group, found in few steps; ends that always do make as many as tokens."""
    n = 50_000
    odd, even = np.arange(1, 2 * n, 2), np.arange(2, 2 * n + 1, 2)
    ends_a = np.append(odd, 2 * n)
    first_a, first_b = alignment.shared_cuts(ends_a, even, np.array([0, n + 1]), np.array([0, n]))
    assert (first_a.tolist(), first_b.tolist()) == ([0], [0])
    first_a, _ = alignment.shared_cuts(even, even, np.array([0, n]), np.array([0, n]))
    assert first_a.tolist() == list(range(n))


# 6: masking in one step


def test_masking_in_one_step(odd_documents, no_documents):
    """The same texts as finding and masking apart; lengths follow changed texts only."""
    before = odd_documents.drop("spans").collect()
    after = pii.mask_documents(odd_documents.drop("spans")).collect()
    assert len(after) == len(before)
    for x, y in zip(before, after):
        spans = [{"kind": k, "start": a, "stop": b} for k, a, b, _ in pii.spans_of(x["text"])]
        assert y["text"] == (pii.masked(x["text"], spans) if spans else x["text"])
        assert y["n_chars"] == (len(y["text"]) if spans else x["n_chars"])
    assert any(x["text"] != y["text"] for x, y in zip(before, after))
    assert pii.mask_documents(no_documents.drop("n_chars")).columns == ["doc_id", "text", "lang", "source"]
