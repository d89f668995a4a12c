"""Alignment, mixing and resampling against brute force, the libraries and DuckDB."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import align, mix, queries, resample

SCHEMA = "doc_id bigint, text string, source string, lang string, size bigint, id bigint, pair bigint, block bigint, target double, key string, rank bigint, row bigint, n int, copies double, score double, buckets string"
A_PATH, B_PATH = "byte_bpe_50k.json", "piece_bpe_32k.model"


def texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéß中") for _ in range(r.randint(1, 6))) for _ in range(60)]
    plain = [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(25)]
    odd = [None, "", " ", " \t\n", " leading", "trailing ", "two  blanks", "line\nline", "<|endoftext|> </s> <s> <unk> <0x41>", "▁piece", "a▁b", "🙂🙂 emoji", "\x00\x01", "x" * 2000, "naïve café", " ".join(words * 40), "中" * 500, "A-Z, a-z; 0.5%"]
    return plain + odd + odd[:6] + plain[:3] * 3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "b", "a", "", "ü"][i % 5], "en", 7, 7, 7, 7, 0.5, "clash", 1, 1, 1, 1.0, 1.0, "clash") for i, t in enumerate(texts())]
    rows += [rows[0], rows[0], (None, *rows[1][1:]), (None, *rows[1][1:]), (None, *rows[2][1:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_alignments(texts):
    """Token by token, from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(queries.tokenizer(A_PATH))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer(B_PATH))
    letters = {}
    fresh = 256
    for byte in range(256):
        shown = 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or byte >= 0xAE
        letters[chr(byte if shown else fresh)] = byte
        fresh += not shown
    out, linked = [], collections.Counter()
    for text in texts:
        if not text:
            out.append(([], [], [], []))
            continue
        a = a_side.encode(" " + text, add_special_tokens=False).ids
        b = b_side.encode(text)
        a_bytes = [bytes(letters[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            out.append(([], [], [], []))
            continue
        spans = []
        for tokens in (a_bytes, b_bytes):
            ends = np.cumsum([len(t) for t in tokens]).tolist()
            spans.append(list(zip([0, *ends], ends, strict=False)))
        links = [(i, j) for i, (p, q) in enumerate(spans[0]) for j, (s, t) in enumerate(spans[1]) if p < t and s < q]
        cuts = sorted({q for _, q in spans[0]} & {q for _, q in spans[1]})
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            groups.append(([a[i] for i, (p, q) in enumerate(spans[0]) if low <= p and q <= high], [b[j] for j, (p, q) in enumerate(spans[1]) if low <= p and q <= high]))
        codes = [(a[i], b[j]) for i, j in links]
        linked.update(set(codes))
        out.append((a, b, groups, codes))
    most = collections.Counter()
    for (a, _), n in linked.items():
        most[a] = max(most[a], n)
    rows = []
    for a, b, groups, codes in out:
        digest = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(groups), len(codes), digest, sum(linked[c] == most[c[0]] for c in codes), sum(linked[c] for c in codes)))
    return rows


@pytest.mark.parametrize("pairs", [1 << 20, 40, 0])
def test_alignment_matches_the_libraries_token_by_token(docs, pairs, monkeypatch):
    monkeypatch.setattr(align, "WINDOW", 37)
    monkeypatch.setattr(align, "BLOCK_BYTES", 500)
    monkeypatch.setattr(align, "HELD_PAIRS", 200)
    rows = docs.select("doc_id", "text").collect()
    want = plain_alignments([r.text for r in rows])
    got = align.alignments(docs, queries.tokenizer(A_PATH), queries.tokenizer(B_PATH), pairs=pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((r.doc_id, *w)) for r, w in zip(rows, want, strict=True))


def test_alignment_of_an_empty_table_and_of_text_ids(spark, empty):
    paths = queries.tokenizer(A_PATH), queries.tokenizer(B_PATH)
    assert align.alignments(empty, *paths).count() == 0
    one = spark.createDataFrame([("k", "one word"), (None, None)], "name string, body string")
    got = {r.name: r for r in align.alignments(one, *paths, id_col="name", text_col="body").collect()}
    assert (got["k"].n_groups, got["k"].n_best, got[None].n_a, got[None].groups_sha256) == (2, 2, 0, "")


def test_overlaps_do_not_depend_on_the_window():
    r = random.Random(3)
    for _ in range(40):
        cuts = [sorted(r.sample(range(1, 90), r.randint(0, 30))) for _ in range(2)]
        sizes = [np.diff([0, *c, 90]) for c in cuts]
        whole = np.concatenate(list(align.overlaps(*sizes, window=1000)), axis=1)
        parts = np.concatenate(list(align.overlaps(*sizes, window=r.randint(1, 20))), axis=1)
        assert np.array_equal(whole, parts)
        assert whole.shape[1] == len(set(cuts[0]) | set(cuts[1])) + 1
        assert whole[2].sum() == len(set(cuts[0]) & set(cuts[1])) + 1


def targets_by_hand(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    stopped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in stopped]
        level = (total - sum(cap * sizes[s] for s in stopped)) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in stopped else weight[s] * level for s in order}
        stopped |= above


def test_mix_meets_targets_and_is_the_same_again(docs, empty):
    rows = mix.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.n_copies * r.size
    want = targets_by_hand(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2
    count = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in docs.collect() if r.doc_id is not None}
    assert all(r.size == count[r.doc_id] for r in rows if r.doc_id is not None)
    again = mix.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert mix.mix(empty).count() == 0


def test_mix_finds_the_same_ends_by_every_path(spark, docs, monkeypatch):
    want = sorted(map(repr, mix.mix(docs).collect()))
    monkeypatch.setattr(mix, "LAST_ROWS", 1)
    monkeypatch.setattr(mix, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mix.mix(docs).collect())) == want
    copies = spark.createDataFrame([(1, "same words here", "s")] * 40 + [(2, "other", "t")] * 40 + [(3, None, "u")], "doc_id long, text string, source string")
    got = mix.mix(copies).collect()
    words = collections.Counter()
    for r in got:
        words[r.source] += r.taken
    assert words["s"] in (159 // 3 * 3, 54) or abs(words["s"] - 160 / 3) <= 2
    assert abs(words["t"] - 160 * 2 / 3) <= 2 and words["u"] == 0


def test_mix_draws_documents_as_often_as_their_importance_says(spark):
    n = 4000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") < n / 2, "a").otherwise("b").alias("source"), (F.col("id") % 4).cast("double").alias("worth"))
    got = mix.mix(rows, weights=(1, 3), importance=F.col("worth")).join(rows.select("doc_id", "worth"), "doc_id").groupBy("source", "worth").agg(F.avg("n_copies").alias("mean"), F.avg("copies").alias("expected")).collect()
    for r in got:
        # Source a expects 0.5 copies of each document, b 1.5; b's best would expect 3 at most.
        mean = 0.5 if r.source == "a" else 1.5
        assert r.expected == pytest.approx(min(3.0, mean * r.worth / 1.5))
        assert r.mean == pytest.approx(r.expected, abs=0.07)


def test_pareto_ranks_order_by_odds(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 7 + 1).cast("int"))).alias("text"), F.lit("s").alias("source"))
    got = mix.mix(rows, share=0.3, importance=F.rand(1)).collect()
    drawn = {r.doc_id for r in got if r.n_copies}
    total = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - 0.3 * total) <= 1
    q = {}
    for r in got:
        u = (int(hashlib.sha256(f"2024:{r.doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        q[r.doc_id] = u / (1 - u) * (1 - r.copies) / r.copies if r.copies else math.inf
    inside = sorted(q[i] for i in drawn)
    outside = sorted(v for i, v in q.items() if i not in drawn)
    assert inside[-2] <= outside[0] + 1e-9  # all but the closing row


def brute_features(text, n_max, buckets):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = [" ".join(words[i : i + n]) for n in range(1, n_max + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]


@pytest.mark.parametrize(("n_max", "buckets", "block"), [(1, 10_000, 1 << 20), (3, 97, 40), (4, 70_000, 1 << 20), (2, 10_000, 15)])
def test_resampling_matches_brute_force(spark, docs, empty, n_max, buckets, block, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK_BYTES", block)
    goal = spark.createDataFrame([("café 中 naive abc de",), (None,), ("A-Z line line",)], "text string")
    rows = docs.select("doc_id", "text").collect()
    found = [brute_features(r.text, n_max, buckets) for r in rows]
    s, t = collections.Counter(b for _, f in found for b in f), collections.Counter(b for r in goal.collect() for b in brute_features(r.text, n_max, buckets)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in s}
    want = []
    for r, (n_words, f) in zip(rows, found, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        want.append([r.doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    drawn = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    k = 30 * len(drawn) // 100
    assert k >= 3
    got = resample.resample(docs, goal, n_max, buckets, percent=30).collect()
    assert sorted(repr(tuple(r)[:4]) for r in got) == sorted(repr(tuple(w[:4])) for w in want)
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(r["rank"], r.doc_id, r.score) for r in ranked] == [(i + 1, w[0], w[3]) for i, w in enumerate(drawn[:k])]
    assert resample.resample(empty, goal).count() == 0 and resample.resample(docs, empty).count() == len(rows)


def test_suffix_order_and_prefixes_equal_plain_ones():
    r = random.Random(4)
    for depth in (1, 2, 3, 5):
        ids = np.array([r.choice([0, 1, 1, 2, 3]) for _ in range(60)] + [0])
        order = resample.suffix_order(ids, depth)
        cut = [tuple(ids[i : i + depth]) for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(ids))) and [c for c in cut] == sorted(cut)
        got = resample.common_prefixes(ids, order, depth).tolist()
        for k in range(1, len(order)):
            a, b = cut[k - 1], cut[k]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n] != 0:
                n += 1
            assert got[k] == n
