"""The corpus operators against brute force, libraries and DuckDB.

The fixture holds nulls, empty and very long texts, ties, repeated rows and
columns whose names clash with those the operators make.
"""

import array
import collections
import glob
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from assay.llm import bpe, components, decontaminate, exact_dedup, lang_id, licenses, lm_score, near_dedup, oracle, quality, queries, token_files, url_filter

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, keep_id string, label int, ids string, word string, n int"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    r = random.Random(11)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(200)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(0, 80))) for _ in range(30)]
    near = [" ".join([*b.split()[:-1], f"x{k}"]) for k, b in enumerate(base[:10])]
    twins = [t.replace(" ", "\n\t ") for t in base[:5]] + [t.upper() for t in base[5:8]]
    odd = [None, "", " \t\n", "one", "One two", "one  two", "A\x00B \x85 c", "<|endoftext|> end", "!!! ??? 123", "wörter über alles", " ".join(words * 60), "x" * 5000]
    return base + near + twins + odd + odd + base[:3]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "de", "fr"][i % 4], "s", len(t or ""), 7, "clash", 1, "clash", "clash", 3) for i, t in enumerate(texts())]
    rows.append(rows[0])  # a row twice
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_bpe_equals_the_library_and_its_decoder(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = bpe.encode_decode(docs, path).collect()
    assert len(got) == len(texts()) + 1
    for row in got:
        want = library.encode(texts()[row.doc_id] or "", add_special_tokens=False).ids
        assert list(array.array("I", row.ids)) == want
        assert row.decoded == library.decode(want, skip_special_tokens=False)
    one = bpe.digests(bpe.encode_decode(docs, path)).first()
    assert one.n_tokens == len(library.encode(texts()[one.doc_id] or "", add_special_tokens=False).ids)
    assert bpe.digests(bpe.encode_decode(empty, path)).count() == 0


def test_byte_level_bpe_equals_the_library():
    import json

    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library, codec = Tokenizer.from_file(path), bpe.BpeCodec(json.loads(bpe.read_spec(path)))
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("ab Z9\n'sé中  .<|endoftext|>") for _ in range(r.randint(0, 20)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(array.array("I", codec.encode(text))) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_exact_dedup_matches_brute_force(docs, empty):
    bare = {i: re.sub("[\x20\x09-\x0d]", "", t or "") for i, t in enumerate(texts())}
    groups = collections.defaultdict(list)
    for i, t in [*enumerate(texts()), (0, texts()[0])]:
        groups[bare[i]].append((-len(t or ""), i))
    got = exact_dedup.exact_dedup(docs, memtable_rows=7).collect()
    assert len(got) == len(texts()) + 1
    for row in got:
        group = groups[bare[row.doc_id]]
        assert (row.keep_id, row.group_size) == (min(group)[1], len(group))
        assert row.kept == (row.keep_id == row.doc_id)
        assert row.text_sha256 == hashlib.sha256(bare[row.doc_id].encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_of_text_ids_and_null_ids_by_every_path(spark, monkeypatch):
    rows = [(f"k{i % 7}", "same\ttext") for i in range(7)] + [(None, "same text"), (None, "alone"), (None, "alone "), ("z", "longer  same text"), ("y", "longersame text"), ("x", None), ("w", "")]
    want = {}
    for i, t in rows:
        want.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or "", i))
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    for limits in ({}, {"BROADCAST_GROUPS": 0, "HOT_ROWS": 4, "BROADCAST_TEXTS": 0, "SALTED": 2, "FILTER_LIMIT": 0}):
        for name, value in limits.items():
            monkeypatch.setattr(exact_dedup, name, value)
        got = exact_dedup.exact_dedup(docs).collect()
        assert sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got))) == sorted(
            repr((i, min(g)[3], len(g), i == min(g)[3])) for i, t in rows for g in [want[re.sub("[\x20\x09-\x0d]", "", t or "")]]
        )


def test_digest_collisions_are_split_by_bytes(spark, docs):
    rows = [(1, b"d" * 32, -3, b"aaa"), (2, b"d" * 32, -3, b"aaa"), (3, b"d" * 32, -3, b"bbb"), (4, b"d" * 32, -4, b"bbb")]
    log = spark.createDataFrame([(i, bytearray(d), p) for i, d, p, _ in rows], "id bigint, digest binary, neg_points bigint")
    odd = spark.createDataFrame([(i, bytearray(d), bytearray(b)) for i, d, _, b in rows[2:]], "id bigint, digest binary, bytes binary")
    got = {r.id: (r.own_keep, r.own_size) for r in exact_dedup.corrected(log, odd).collect()}
    assert got == {3: (4, 2), 4: (4, 2)}


def test_filters_have_no_false_negatives():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(500)]
    packed = exact_dedup.make_filter(digests)
    assert exact_dedup.in_filter(exact_dedup.as_rows(digests), packed).all()
    others = exact_dedup.as_rows([hashlib.sha256(str(-i).encode()).digest() for i in range(1, 500)])
    assert exact_dedup.in_filter(others, packed).mean() < 0.05


def shingles(text):
    w = (text or "").translate(A_Z)
    w = re.findall(r"[^\x20\x09-\x0d]+", w)
    return frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute_components(sets):
    label = {i: i for i in sets}
    change = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while change:
        change = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                change = True
    return label


def test_near_dedup_matches_brute_force(docs, empty):
    sets = {i: shingles(t) for i, t in enumerate(texts())}
    want = brute_components(sets)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(texts()) + 1
    for row in got:
        assert (row.n_shingles, row.component_id, row.kept) == (len(sets[row.doc_id]), want[row.doc_id], want[row.doc_id] == row.doc_id)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_operators_take_ids_of_type_text(spark, docs):
    """The same results as with numbers, named otherwise; a null id is no other row's."""
    named = docs.withColumn("doc_id", F.format_string("d%05d", "doc_id"))
    extra = spark.createDataFrame([(None, texts()[3], "en"), (None, None, None)], "doc_id string, text string, lang string")
    named = named.unionByName(extra, allowMissingColumns=True)
    name = lambda i: f"d{i:05d}"
    want, got = by_id(near_dedup.near_duplicates(docs)), near_dedup.near_duplicates(named).collect()
    assert len(got) == named.count()
    for row in got:
        if row.doc_id is None:
            assert row.kept and row.component_id in (None, name(want[3].component_id))
        else:
            old = want[int(row.doc_id[1:])]
            assert (row.n_shingles, row.component_id, row.kept) == (old.n_shingles, name(old.component_id), old.kept)
    path = queries.tokenizer("word_bpe_49k.json")
    one, two = bpe.digests(bpe.encode_decode(docs, path)), bpe.digests(bpe.encode_decode(named, path))
    assert {(name(r.doc_id), r.ids_sha256) for r in one.collect()} == {(r.doc_id, r.ids_sha256) for r in two.collect() if r.doc_id}
    items = spark.createDataFrame([(1, texts()[4])], "item_id bigint, text string")
    one, two = (decontaminate.decontaminate(d, items) for d in (docs, named))
    assert {(name(r.doc_id), r.n_hit) for r in one.collect()} == {(r.doc_id, r.n_hit) for r in two.collect() if r.doc_id}
    assert lang_id.identify(named).count() == named.count()


def test_pipeline_near_stage_matches_brute_force_at_80_percent(spark):
    import corpus_pipeline

    r = random.Random(8)
    rows = []
    for k in range(12):  # a copy with a tail, one with a passage replaced, and one beyond the threshold
        base = [f"w{r.randrange(10**6)}" for _ in range(200)]
        new = [f"n{r.randrange(10**6)}" for _ in range(70)]
        rows += [base, base + new[: 38 + k], base[:80] + new[:15] + base[95:], base + new[::-1]]
    five = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in rows]
    likeness = {(a, b): len(five[a] & five[b]) / len(five[a] | five[b]) for a in range(len(rows)) for b in range(a)}
    assert sum(0.8 <= x < 0.85 for x in likeness.values()) >= 20
    label = list(range(len(rows)))
    for _ in rows:
        for (a, b), x in likeness.items():
            if x >= 0.8:
                label[a] = label[b] = min(label[a], label[b])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string")
    left = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()}
    assert left == {i for i, x in enumerate(label) if x == i} and 12 < len(left) < len(rows)
    assert [near_dedup.bands_for(p) for p in (100, 85, 80)] == [1, 30, 46]


def test_near_dedup_of_a_group_that_its_first_member_does_not_hold(spark):
    """A chain of edits: members near one another, many not near the smallest id."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows, current = [], list(base)
    for i in range(60):
        for _ in range(1):
            current[r.randrange(len(current))] = f"e{i}"
        rows.append((i, " ".join(current)))
    hub = [(100 + i, " ".join(base[:k] + [f"z{i}"] + base[k + 1 :])) for i, k in enumerate(range(0, 120, 6))]
    rows = [(500 + i, t) for i, t in rows] + hub + [(0, " ".join(base[:90] + [f"q{k}" for k in range(30)]))]
    sets = {i: shingles(t) for i, t in rows}
    want = brute_components(sets)
    got = by_id(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert {i: r.component_id for i, r in got.items()} == want


def test_odd_sketch_estimates_the_distance():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    a, b = np.unique(x[:1900]), np.unique(x[100:])
    sketches = [np.frombuffer(near_dedup.odd_sketch(near_dedup.min_samples(s, 1024), 4096), np.uint64) for s in (a, b)]
    assert np.bitwise_count(sketches[0] ^ sketches[1]).sum() <= near_dedup.xor_limit(near_dedup.FINE, 85)
    c = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    other = np.frombuffer(near_dedup.odd_sketch(near_dedup.min_samples(np.unique(c), 1024), 4096), np.uint64)
    assert np.bitwise_count(sketches[0] ^ other).sum() > near_dedup.xor_limit(near_dedup.FINE, 85)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51)], "a bigint, b bigint")
    got = {r.id: r.label for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 51: 50}


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z))


def test_decontamination_matches_brute_force(spark, docs, empty):
    all_texts = texts()
    items = [(1, " ".join(all_texts[3].split()[2:20])), (2, all_texts[4]), (3, "one"), (4, None), (5, "..."), (6, "one two"), (1, "wörter ÜBER alles"), (7, "never seen words at all")]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = item_words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert len(got) == len(all_texts) + 1
    for row in got:
        w, hit, found = item_words(all_texts[row.doc_id]), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[k : k + n]) in windows and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        assert (row.n_words, row.n_hit, row.n_items) == (len(w), len(hit), len(found))
        assert row.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert row.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    no_items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(docs, no_items).where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty, no_items).count() == 0


def test_decontamination_of_repeated_rows_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"passage{k}" for k in range(15))
    rows = [(1, f"so {passage} it"), (1, f"so {passage} it"), (None, f"null {passage}"), (2, "single"), (2, "single"), (3, "clean words"), (None, "clean too"), (3, f"shares an id {passage}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, passage), (2, "single")], "item_id bigint, text string")
    got = decontaminate.decontaminate(docs, items).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == [
        (0, 2, 0, 0, False), (0, 16, 15, 1, True), (1, 17, 15, 1, True), (1, 17, 15, 1, True), (2, 1, 1, 1, True), (2, 1, 1, 1, True), (3, 2, 0, 0, False), (3, 18, 15, 1, True),
    ]
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.benchmark_free(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == ["clean too", "clean words"]


def test_proximity_finds_words_that_moved(spark):
    docs = spark.createDataFrame([(1, "a zebra sat near the old quail"), (2, "a zebra sat quail")], "id bigint, text string")
    anchors = spark.createDataFrame([("p", "zebra", 0), ("p", "quail", 3)], "phrase string, word string, offset int")
    index = decontaminate.postings(docs, anchors.select("word"))
    got = {(r.id, r.start, r.other) for r in decontaminate.proximity_matches(index, anchors, 2).collect()}
    assert got == {(1, 1, 3), (2, 1, 0)}


def test_token_files_read_back_what_the_library_gives(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    manifest = token_files.write_tokens(docs, path, ids_per_file=3000)
    assert manifest.count() > 3
    got = token_files.digests(token_files.read_tokens(manifest)).orderBy("start").collect()
    order = sorted([*range(len(texts())), 0])
    assert [r.doc_id for r in got] == order
    start = 0
    for row in got:
        ids = [*library.encode(texts()[row.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(array.array("I", ids).tobytes()))
        start += len(ids)
    assert token_files.read_tokens(token_files.write_tokens(empty, path)).count() == 0


def test_elias_fano_selects_and_stays_small():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, universe in ((0, 1), (1, 1), (300, 300), (1000, 10**6), (257, 2**40)):
        values = np.sort(rng.integers(0, universe, n))
        held = token_files.EliasFano.loads(memoryview(token_files.EliasFano.of(values, universe).dumps()))
        assert (held.all() == values).all()
        assert [held.select(i) for i in range(n)] == values.tolist()
    assert len(token_files.EliasFano.of(np.sort(rng.integers(0, 10**6, 1000)), 10**6).dumps()) < 8 * 1000 / 4


def test_chunked_encoder_equals_whole_texts():
    r = random.Random(4)
    encoder = token_files.ChunkedEncoder(bpe.read_spec(queries.tokenizer("byte_bpe_50k.json")), limit=50)
    parts = [*"abA9\n\t's.é中 ", "  ", " \n", "\n ", "<|endoftext|>", " x", "don't"]
    for _ in range(60):
        some = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(40)]
        assert encoder.encode(some) == encoder.library(some)


def test_url_rules(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("allow", "tie.net", "/"), ("block", "tie.net", "/")]
    cases = {
        "http://A.Example.ORG/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"), "http://example.org/en/123?q#f": ("example.org", "/en/123", "example.org/en/1", "block"),
        "http://x.org/en/1": ("x.org", "/en/1", "org/", "allow"), "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://com/de/x": ("com", "/de/x", "com/de/", "block"),
        "http://x.org": ("x.org", "", None, "allow"), "http://x.org?a/b": ("x.org", "", None, "allow"), "no url": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://tie.net/": ("tie.net", "/", "tie.net/", "block"), "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id bigint, url string, host string")
    got = by_id(url_filter.filter_urls(pages, rules), "page_id")
    assert [tuple(got[i])[1:] for i in range(len(cases))] == list(cases.values())
    twice = pages.union(pages.where("page_id < 3")).union(pages.limit(1).withColumn("page_id", F.lit(None).cast("bigint")))
    assert url_filter.filter_urls(twice, rules).count() == len(cases) + 4
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    joined = by_id(url_filter.filter_by_join(pages, table), "page_id")
    assert [tuple(joined[i])[1:] for i in range(len(cases))] == list(cases.values())


def test_language_id_is_accurate_on_held_out_documents(spark, docs, empty):
    rows = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")
    got = lang_id.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    held = {i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {r.doc_id for r in got} == held
    small = by_id(lang_id.identify(docs))
    assert all((small[i].lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for i, t in enumerate(texts()))
    assert lang_id.identify(empty).count() == 0
    assert {r.lang_pred for r in lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_model_counts_and_gains(spark, docs, empty):
    rows = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")
    for table, some in ((docs, list(enumerate(texts()))), (rows, [(r.doc_id, r.text) for r in rows.collect()])):
        counts = collections.Counter()
        split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
        extra = [(0, texts()[0])] if table is docs else []
        for i, t in [*some, *extra]:
            if zlib.crc32(str(i).encode()) % 10:
                counts.update(split(t))
        n, v = sum(counts.values()), len(counts)
        got = lm_score.score(table).collect()
        assert len(got) == len(some) + len(extra)
        known = dict(some)
        for row in got:
            tokens = split(known[row.doc_id])
            base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
            assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
            assert abs(row.base_score - base) <= 1e-9 * max(1, abs(base))
            assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 10 == 0)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_score.score(empty).count() == 0


def test_language_model_score_matches_a_plain_softmax(spark):
    """Scores of ids of type text, null ids, nulls, repeated rows and a very long text, token by token."""
    import numpy as np

    r = random.Random(9)
    words = [f"w{k}" for k in range(120)]
    some = [" ".join(r.choices(words, range(120, 0, -1), k=r.randint(1, 60))) for _ in range(50)]
    rows = [(f"k{i}", t) for i, t in enumerate([*some, None, "", "Unseen W1 w2", " ".join(r.choices(words, k=30_000))])]
    rows += [rows[0], (None, "w1 w2 unheard"), (None, None)]
    table = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    away = lambda i: i is not None and zlib.crc32(i.encode()) % 10 == 0
    split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = collections.Counter(w for i, t in rows if not away(i) for w in split(t))
    total = sum(counts.values())
    top = sorted(counts, key=lambda w: (-counts[w], np.uint64(lm_score.hash_of(w)).view(np.int64)))[: lm_score.OWN]
    own = np.array([lm_score.hash_of(w) for w in top], np.uint64)
    docs = table.select(F.col("doc_id").alias("id"), "text", F.coalesce(F.crc32(F.col("doc_id").cast("binary")) % 10 == 0, F.lit(False)).alias("held_out"))
    weights = lm_score.train(lm_score.tokenised(docs), own, total).astype(float)
    slots, groups, within = lm_score.slots_for(total), lm_score.GROUPS, lm_score.WITHIN
    label = lambda w: top.index(w) if w in top else lm_score.OWN + lm_score.hash_of(w) % lm_score.HASHED
    mix = lambda x: int(lm_score.mix64(np.array([x], np.uint64))[0])
    log_share = lambda z, k: (z[k] - math.log(sum(math.exp(x) for x in z))) / math.log(10)

    def log_chance(word, one, two):
        a, b = lm_score.hash_of(one), lm_score.hash_of(two)
        at = [mix(a) % slots, slots + mix(b) % slots, 2 * slots + mix((a * 0x9E3779B97F4A7C15 + b) % 2**64) % slots, 3 * slots]
        z, k = weights[at].sum(axis=0), label(word)
        g = k // within
        out = log_share(z[:groups], g) + log_share(z[groups + g * within : groups + (g + 1) * within], k % within)
        if k >= lm_score.OWN:
            mates = [n for w, n in counts.items() if label(w) == k]
            out += math.log10((counts[word] + 0.1) / (sum(mates) + 0.1 * (len(mates) + 1)))
        return out

    got = lm_score.score(table).collect()
    assert len(got) == len(rows) and sum(x.held_out for x in got) == sum(away(i) for i, _ in rows) > 0
    texts_of = collections.defaultdict(list)
    for i, t in rows:
        texts_of[i].append(split(t))
    for x in got:
        options = [w for w in texts_of[x.doc_id] if len(w) == x.n_tokens]
        assert options and x.held_out == away(x.doc_id)
        w = options[0]
        if len(w) < 1000:
            padded = [b"\t", b"\t", *w]
            assert abs(x.score - sum(log_chance(w[k], padded[k + 1], padded[k]) for k in range(len(w)))) < 1e-3 * len(w)
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (len(counts) + 1))) for t in w)
        assert (x.n_known, x.train_tokens) == (sum(counts[t] > 0 for t in w), total) and abs(x.base_score - base) < 1e-9 * abs(base)


def test_quality_keeps_the_good_and_drops_junk(spark, docs, empty):
    rows = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/labels.parquet")
    got = quality.classify(rows, labels.where("quality = 1").select("doc_id")).join(labels, "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.99
    assert sum(not r.kept for r in bad) / len(bad) > 0.9
    small = by_id(quality.classify(docs, labels.where("doc_id < 5").select("doc_id")))
    assert all(small[i].perplexity is None and not small[i].kept for i, t in enumerate(texts()) if not t)
    assert all(small[i].perplexity >= 1 for i, t in enumerate(texts()) if t)
    none = quality.classify(docs, labels.where("false").select("doc_id"))
    assert all(r.kept == bool(texts()[r.doc_id]) for r in none.collect())
    assert quality.classify(empty, labels.select("doc_id")).count() == 0


def brute_kneser_ney(train):
    """Probability of a character after a history, from plain counts of ``train``."""
    order = quality.ORDER
    counts = [None, *(collections.Counter() for _ in range(order))]
    for text in train:
        padded = [None] * (order - 1) + list(text)
        counts[order].update(tuple(padded[i : i + order]) for i in range(len(text)))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    cuts = []
    for k in range(1, order + 1):
        n1, n2, n3, n4 = (sum(v == j for v in counts[k].values()) for j in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 and n3 else None
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3) if y else (0.5, 0.75, 0.9)
        cuts.append([min(max(x, 0.05), j - 0.05) for j, x in enumerate(d, 1)] if y else list(d))
    sums = [collections.defaultdict(lambda: [0, 0.0]) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in counts[k].items():
            sums[k][g[:-1]][0] += n
            sums[k][g[:-1]][1] += cuts[k - 1][min(n, 3) - 1]

    def chance(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        k, n = len(gram), counts[len(gram)][gram]
        total, freed = sums[k].get(gram[:-1], (0, 0.0))
        if not total:
            return chance(gram[1:])
        return (n - cuts[k - 1][min(n, 3) - 1] if n else 0) / total + freed / total * chance(gram[1:])

    return chance


def test_perplexity_matches_brute_force_kneser_ney(spark):
    r = random.Random(3)
    train = ["".join(r.choice("ab c") for _ in range(r.randint(1, 90))) for _ in range(40)] + ["abracadabra 中文", "a"]
    judged = [*train[:5], "zzz", "a", "abcab", "中", "\U0001f600 ab", "ab\tc 12", "", None]
    model = quality.train(spark.createDataFrame([(t,) for t in train], "text string"))
    rows = [(str(i), None, None, t) for i, t in enumerate(judged)]
    table = spark.createDataFrame(rows, "id string, lang string, row string, text string")
    chance = brute_kneser_ney(train)
    for limit in (10**6, 0):  # values broadcast, and joined by blocks
        for row in quality.perplexities(table, model, limit).collect():
            text = re.sub("[\x09-\x0d]", " ", re.sub("[0-9]", "0", judged[int(row.id)] or ""))
            padded = [None] * (quality.ORDER - 1) + list(text)
            logs = [math.log(chance(tuple(padded[i : i + quality.ORDER]))) for i in range(len(text))]
            assert row.chars == len(text)
            assert (row.perplexity is None) if not text else abs(row.perplexity / math.exp(-sum(logs) / len(logs)) - 1) < 1e-9


def test_quality_decisions_match_the_quantiles(spark, docs):
    """Edges from the half that does not train, ids of type text, null ids, repeated rows."""
    import numpy as np

    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).unionByName(docs.withColumn("doc_id", F.lit(None).cast("string")).limit(5))
    trusted = docs.where("doc_id < 40").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"))
    got = quality.classify(named, trusted, least=5, carry=["lang", "text"]).collect()
    assert len(got) == named.count()
    held = {r.doc_id for r in trusted.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1).collect()}
    reach = lambda r: math.log(r.perplexity) - 2 / math.sqrt(len(r.row.text))
    for row in got:
        if not row.row.text:
            assert not row.kept and row.perplexity is None and row.upper is None
            continue
        own = [r for r in got if r.doc_id in held and r.row.text and r.row.lang == row.row.lang]
        pool = own if row.row.lang and len(own) >= 5 else [r for r in got if r.doc_id in held and r.row.text]
        edge = np.quantile([reach(r) for r in pool], 0.995, method="inverted_cdf")
        assert row.kept == (reach(row) <= edge + 1e-12)
        assert row.kept == (row.perplexity <= row.upper * (1 + 1e-12))


def test_license_scan_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", "plain words"), (3, "a/b/y.txt", "code\nLicensed under the Apache License, Version 2.0.\nmore words here and there"),
        (4, "z/q.txt", None), (5, None, "All rights reserved."), (6, "a/b/c/COPYING.md", "This work is licensed under the GNU General Public License, version 3."), (7, "a/t.txt", ""), (8, "top.txt", "licence plates are nice"),
    ]
    got = by_id(licenses.scan(spark.createDataFrame([(*r, "clash") for r in rows], "id bigint, path string, text string, license string")), "id")
    assert {i: (r.own_license, r.license, r.license_dir) for i, r in got.items()} == {
        1: ("MIT", "MIT", None), 2: (None, "GPL-3.0", "a/b/c"), 3: ("Apache-2.0", "Apache-2.0", None), 4: (None, None, None), 5: ("Proprietary", "Proprietary", None),
        6: ("GPL-3.0", "GPL-3.0", None), 7: (None, "MIT", "a"), 8: (None, None, None),
    }
    assert licenses.scan(spark.createDataFrame([], "id bigint, path string, text string")).count() == 0


def test_license_headers_that_are_not_template_text(spark):
    cases = {
        "// SPDX-License-Identifier: MIT\nint main": "MIT", "# spdx-license-identifier: apache-2.0": "Apache-2.0", "SPDX-License-Identifier: WTFPL": None,
        "Copyright (c) 2020 Some Body.\nAll rights reserved.": "Proprietary", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        f"{'many words before ' * 10} was released under the MIT License and {'then some more ' * 10}": "MIT", "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "Mozilla Public License\nVersion 2.0\n=====": "MPL-2.0", "Permission is hereby granted, free of charge, to anybody who gets a copy of this software and associated documentation files": "MIT",
        "all of the rights that a license has under the law": None, "license " * 500: None, "": None, "word " * 200_000: None,
    }
    rows = [(str(i), f"d{i}/f", t) for i, t in enumerate(cases)]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "id string, path string, text string")), "id")
    assert [got[str(i)].own_license for i in range(len(cases))] == list(cases.values())


def brute_license_scan(rows, threshold, file_share):
    """(own_license, score, license, license_dir) of each (id, path, text), by plain loops."""
    split = lambda t: re.findall("[a-z0-9]+", (t or "").translate(A_Z))
    known = [(name, split(must), split(text)) for name, must, text in licenses.all_templates()]
    spread = collections.Counter(w for _, _, t in known for w in set(t))
    idf = {w: math.log((1 + len(known)) / (1 + n)) + 1 for w, n in spread.items()}
    vector = lambda words: {w: n * idf.get(w, math.log(1 + len(known)) + 1) for w, n in collections.Counter(words).items()}
    unit = lambda v: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    frequency = collections.Counter(w for _, _, t in rows for w in split(t) if w in spread)
    own = []
    for _, _, text in rows:
        words, hits = split(text), []
        for name, must, template in known:
            weights, out, left = unit(vector(template)), set(), 0.0
            for w in sorted(weights, key=lambda w: (-frequency[w], w)):
                left += weights[w] ** 2
                if left < threshold**2 - licenses.EPSILON:
                    out.add(w)
            starts = {max(0, p - k) for p, w in enumerate(words) for k, x in enumerate(template) if x == w and w not in out}
            for start in starts:
                passage = words[start : start + len(template)]
                score = sum(x * weights.get(w, 0) for w, x in unit(vector(passage)).items())
                if score >= threshold and set(must) <= set(passage):
                    hits.append((-round(score * len(passage), 6), -round(score, 9), name, range(start, start + len(passage))))
        best = min(hits, key=lambda h: h[:3]) if hits else None
        own.append((best[2], -best[1], -best[0], len({p for h in hits for p in h[3]}) / len(words)) if best else None)
    parent = lambda p: None if p in (None, ".", "") else p.rpartition("/")[0] if "/" in p else "."
    given = {}
    for (i, path, _), o in zip(rows, own, strict=True):
        named = re.search(r"(?i)(^|/)(LICEN[SC]E|COPYING|NOTICE)[^/]*$", path or "")
        if o and parent(path) is not None and (named or o[3] >= file_share):
            given.setdefault(parent(path), []).append((-o[2], i, o[0]))
    out = []
    for (_, path, _), o in zip(rows, own, strict=True):
        at = parent(path)
        while at is not None and at not in given:
            at = parent(at)
        out.append((o[0], o[1], o[0], None) if o else (None, None, None if at is None else min(given[at])[2], at))
    return out


def test_license_at_the_root_is_inherited(spark):
    text = "Licensed under the Apache License, Version 2.0"
    for root, paths in ((".", ["LICENSE", "src/a.c", "b.c", "x/y/z"]), ("", ["/LICENSE", "/src/b.c", "/c"])):
        rows = [(i, p, text if i == 0 else "plain words") for i, p in enumerate(paths)] + [(9, None, "no path"), (10, "/other" if root == "." else "other", "words")]
        got = {r.id: (r.license, r.license_dir) for r in licenses.scan(spark.createDataFrame(rows, "id bigint, path string, text string")).collect()}
        assert got[0] == ("Apache-2.0", None) and got[9] == got[10] == (None, None)
        assert all(got[i] == ("Apache-2.0", root) for i in range(1, len(paths)))


def test_license_scan_matches_brute_force(spark):
    r = random.Random(17)
    known = [t for _, _, t in licenses.all_templates()]
    rows = []
    for i in range(80):
        words = r.choice(known).split()
        for _ in range(r.randint(0, 4)):  # words lost, changed and added
            k = r.randrange(len(words))
            words[k : k + 1] = r.choice([["a"], ["thing"], [words[k], "the"]] if len(words) < 4 else [[], ["thing"], [words[k], "the"]])
        around = lambda: r.choices(["the", "of", "license", "thing", "software", "any", "x1"], k=r.choice([0, 3, 40]))
        path = r.choice([None, "top", "LICENSE", "/", "/x/y", "a/f", "a/b/g", "a/b/c/LICENSE", "a/b/c/d/h", "e/x", "a/NOTICE.txt"])
        rows.append((i, path, " ".join(around() + words + around()) if i % 9 else None))
    rows += [rows[1], rows[2], rows[2]]
    got = licenses.scan(spark.createDataFrame([(*x, 0, "clash") for x in rows], "id bigint, path string, text string, score int, key string")).collect()
    want = brute_license_scan(rows, 0.7, 0.5)
    assert sum(x[0] is not None for x in want) > 30 and sum(x[3] is not None for x in want) > 3
    order = lambda x: sorted(x, key=repr)
    assert order((x.id, x.path, x.own_license, x.score and round(x.score, 6), x.license, x.license_dir) for x in got) == order(
        (i, path, a, s and round(s, 6), lic, at) for (i, path, _), (a, s, lic, at) in zip(rows, want, strict=True)
    )


def test_language_sample_is_bounded_where_rows_have_no_id(spark, monkeypatch):
    r, seen, stored = random.Random(8), {}, lang_id.stored
    monkeypatch.setattr(lang_id, "stored", lambda df, label: seen.setdefault(label, stored(df, label)))
    word = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(None if i % 3 else 7, " ".join("".join(r.choice(word[k]) for _ in range(5)) for _ in range(6)), k) for i in range(600) for k in word]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lang_id.identify(docs, folds=3, held=5, per_lang=40).collect()
    assert 40 < seen["lang-sample"].count() < 130
    assert sorted(x.lang_pred for x in got) == sorted(k for _, _, k in rows)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.queries()[name](spark, SF_DIR), con.sql(oracle.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[want.columns.index(c)] for c in columns]) for r in want.fetchall())


def five_word_set(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(A_Z))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def after_quality(rows, items):
    """Stages 2 to 4 over (doc_id, text, ...) rows, by brute force."""
    bare = lambda r: re.sub("[\x20\x09-\x0d]", "", r[1] or "")
    stays = {}
    for r in rows:
        if r[0] is not None:
            key = (-len(r[1] or ""), r[0])
            stays[bare(r)] = min(stays.get(bare(r), key), key)
    rows = [r for r in rows if r[0] is None or stays[bare(r)][1] == r[0]]
    sets = {r[0]: five_word_set(r[1]) for r in rows if r[0] is not None}
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in ((a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]):
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    rows = [r for r in rows if r[0] is None or label[r[0]] == r[0]]
    windows = set()
    for text in items:
        w = item_words(text)
        n = min(13, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    sizes = {len(x) for x in windows}
    out = []
    for r in rows:
        w = item_words(r[1])
        hit = {p for k in range(len(w)) for n in sizes if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def test_pipeline_equals_the_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    r = random.Random(21)
    words = ["".join(r.choice("abdeilnorst") for _ in range(r.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    clean = [prose(r.randint(40, 160)) for _ in range(60)]
    passage = prose(20)
    planted = [
        *(t.replace(" ", "\n  ") for t in clean[:6]), *(t + " tail" for t in clean[6:14] if len(t.split()) > 50), *(f"{t} {passage}" for t in clean[14:20]),
        "zq!#$ " * 50, "@@@@ %%%% ^^^^ ~~~~ " * 20, None, "", "one", "one", passage, prose(12_000),
    ]
    rows = [(i, t, [None, "en", "de"][i % 3], "s", len(t or ""), "clash", "clash") for i, t in enumerate(clean + planted)]
    rows += [rows[3], (None, clean[5] + " " + passage, "en", "s", 1, "clash", "clash"), (None, prose(70), None, None, None, None, None), (None, None, None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, mark string, row string"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(55)] + [(66, 0)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    first = corpus_pipeline.good_quality(spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    good = [tuple(x) for x in first.collect()]
    texts_left = {x[1] for x in good}
    assert not {None, "", "zq!#$ " * 50, "@@@@ %%%% ^^^^ ~~~~ " * 20} & texts_left and len(texts_left & set(clean)) >= 55
    want = after_quality(good, [passage, None])
    library = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    digest = lambda t: hashlib.sha256(array.array("I", library.encode(t, add_special_tokens=False).ids).tobytes()).hexdigest()
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    order = lambda rows: sorted(rows, key=repr)
    assert order((x.doc_id, x.ids_sha256) for x in got) == order((x[0], digest(x[1])) for x in want)
    assert 40 < len(got) < len(rows) - 20

    empty_dir = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty_dir}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty_dir)).count() == 0
