"""Every operator against brute force on a small table with nulls, empties, copies, odd texts and clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mktlens.llm import (bpe_words, components, language_mix, license_scan, quality_rules, shingle_join, source_mix,
                         token_counts, token_files, url_filters, vector_topk)
from mktlens.llm.common import scratch

JSON_VOCAB = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_words string, size int, rank int, token string, row string"
PROSE = "the cat sat on the mat and looked at the dog who was not amused by any of this at all today "
ODD = ["", None, " ", "a", "  two  blanks \n\n\tand tabs\x0b\x85 ", "it's we're they've I'll 'tis <|endoftext|> x<|endof",
       "naïve ÉTÉ 中文字符 🙂🙂 ١٢٣", "word " * 3000, "=" * 200 + "\r\n" + " " * 70 + "x", "MIT  LICENSE, the Apache-License!"]


def _rows():
    texts = ODD + [PROSE * 3, PROSE * 3, PROSE * 3 + "extra", "GNU General Public License " + PROSE * 4,
                   "Licensed under CC BY-NC 4.0. " + PROSE, "#### $$$ " * 40, "line one here\nline one here\n" * 30]
    out = [(i, t, ("en", "de", None)[i % 3], ("s1", None, "s0", "s2")[i % 4], "clash", i, 7, "t", "r") for i, t in enumerate(texts)]
    return out + [out[10], (None, PROSE, "en", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def _sorted(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_op1_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON_VOCAB)
    rows = sorted(((r[0], r[1] or "") for r in _rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [t.encode(x, add_special_tokens=False).ids + [2] for _, x in rows]
    path = scratch(spark, "test-tokens")
    token_files.write_tokens(docs, path, JSON_VOCAB, 2, block_ids=500)
    got = sorted(token_files.token_digests(spark, path).collect(), key=lambda r: r.start)
    start = 0
    for r, (doc_id, _), own in zip(got, rows, ids, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own)))
        start += len(own)
    ranks = {r.id: r.n for r in spark.read.parquet(f"{path}/ranks").collect()}
    assert ranks == Counter(i for own in ids for i in own)


def test_op1_chunks_sent_together_or_alone():
    chunks = [" word", "first", "\nline", " a<|endoftext|>b", " ", "  two", " \u00e9t\u00e9", "\n\n", " \u4f60\u597d", " x ", " <|endoftext|>",
              " don't", " word's", "\n#*$%", "tail"]
    library = token_files._Library(JSON_VOCAB)
    want = [library.tokenizer.encode(c, add_special_tokens=False).ids for c in chunks]

    def check():
        flat, lens = library.encode(chunks)
        ends = lens.cumsum()
        assert [flat[e - n:e].tolist() for e, n in zip(ends, lens, strict=True)] == want

    check()
    library.n_bytes = library.n_bytes + 1  # sums that don't meet the chunks' ends: one by one
    check()


def test_op1_ids_of_two_and_four_bytes_and_counts_without_ids(spark, docs):
    raw = token_files.id_blocks(docs, JSON_VOCAB, 70_000, block_ids=500)
    counts = {r.id: r.n for r in token_files.id_counts(raw.drop("ids")).collect()}
    for end_id in (2, 70_000):
        path = scratch(spark, "test-tokens")
        token_files.write_tokens(docs, path, JSON_VOCAB, end_id, block_ids=500)
        read = [list(struct.unpack(f"<{r.n_tokens}I", r.ids)) for r in token_files.read_tokens(spark, path).collect()]
        assert all(ids[-1] == end_id for ids in read)
        if end_id == 70_000:
            assert counts == Counter(i for ids in read for i in ids)
    sizes = {len(r.ids) // sum(r.lens) for e in (2, 70_000) for r in token_files.id_blocks(docs, JSON_VOCAB, e).collect()}
    assert sizes == {2, 4}


def test_chunk_table_with_hashes_that_collide(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from mktlens.llm import chunks

    def lengths(new):
        return np.array([len(c) for c in new.to_pylist()], dtype=np.int64), np.ones(len(new), dtype=np.int64)

    texts = pa.array(["one two three two", "", None, "two  four one", "three\nfive " * 3, "one two three two"])
    for hashes in (chunks.chunk_hashes, lambda c: np.zeros(len(c), dtype=np.uint64)):
        monkeypatch.setattr(chunks, "chunk_hashes", hashes)
        table = chunks.ChunkTable(lengths, np.int64, max_chunks=4)
        for _ in range(4):
            flat, starts = table.values(texts)
            want = [[len(c) for c in chunks.split_chunks(t or "")] for t in texts.to_pylist()]
            assert [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == want


def test_op1_empty_table(spark, none):
    path = scratch(spark, "test-tokens")
    token_files.write_tokens(none, path, JSON_VOCAB, 2)
    assert token_files.token_digests(spark, path).collect() == []


def test_op2_topk(spark):
    import random

    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(5)], "x") for i in range(300)]
    rows += [(400 + i, [0.5, 0.5, -0.25, 0.0, 1.0], "tie") for i in range(10)] + [(500, None, ""), (501, [], ""), (502, [1.0, None], ""),
             (503, [float("nan")] * 5, ""), (504, [float("inf")] * 5, ""), (None, [1.0] * 5, ""), (450, [1.0, -1.0], "short")]
    rows.append(rows[0])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    ok = [(r[0], [math.floor(256 * struct.unpack("f", struct.pack("f", x))[0]) for x in r[1]]) for r in rows
          if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    want = []
    for q in {i for i, _ in ok if i % 50 == 0}:  # row 0 comes twice, as a query and as a candidate
        scored = sorted((-sum(a * b for a, b in zip(u, v)), i) for j, u in ok if j == q for i, v in ok if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    got = vector_topk.top_k(table, F.col("vec_id") % 50 == 0, 5, block_rows=64, group_rows=3)
    assert _sorted(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert vector_topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0, 5).collect() == []


def test_op2_large_components_and_repeated_ids(spark):
    import random

    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows += [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in (0, 3, 3, 50, 51)]  # other vectors under the same ids
    rows += [(200, [40000.5, -1.25, 0.0, 3.0]), (201, [-32768.0, 0.5, 1.0, 1.0]), (202, [1.0, 2.0**17, 0.0]), (205, [0.0, 0.0, 2.0**45, 0.0]), (250, [0.0, 2.0**20 + 1, 0.5, 0.0]),
             (203, [0.0, 0.0, 0.0, 2.0**60]), (204, [0.0, 2.0**62, 0.0, 2.0**100])]
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i not in (203, 204)]
    want = []
    for q in {i for i, _ in v if i % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), c) for i, x in v if i == q for c, y in v if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_topk.top_k(table.filter("vec_id not in (203, 204)"), F.col("vec_id") % 50 == 0, 5, block_rows=64, group_rows=3)
    assert _sorted(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    with pytest.raises(Exception, match="fit 64 bits"):
        vector_topk.top_k(table.filter("vec_id >= 200"), F.col("vec_id") == 203, 5).collect()


def test_op3_licenses(docs, none):
    def lower(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    want = []
    for doc_id, text, *_ in _rows():
        w, places, labels = lower(text), [], set()
        for label, phrase in license_scan.BASE:
            k = phrase.split()
            found = [i for i in range(len(w)) if w[i:i + len(k)] == k]
            places += found
            labels |= {label} if found else set()
        want.append((doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = license_scan.scan_licenses(docs)
    assert _sorted(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[14].labels == "cc-by-nc" and by_id[14].score == 1.0 and by_id[9].labels == "apache,mit" and by_id[0].score == 0.0
    assert license_scan.scan_licenses(none).collect() == []


def test_op4_languages(spark, docs, none):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_mix.predict_languages(sf).join(sf.select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    # the answer does not change with the labels of held-out documents, or with sources and ids
    langs, model = language_mix.learn(sf)
    again = language_mix.learn(sf.withColumn("lang", F.when(language_mix.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))))
    assert again[0] == langs and (again[1] == model).all()
    two = " ".join(r.text for r in sf.filter("lang in ('de', 'fr') and n_chars between 1500 and 3000").orderBy("doc_id").limit(6).collect())
    mixed = language_mix.identify(spark.createDataFrame([(1, two)], "doc_id long, text string"), langs, model).first()
    assert set(mixed.langs.split(",")) >= {"de", "fr"} and mixed.score < 0.9
    odd = {r.doc_id: r for r in language_mix.identify(docs, langs, model).collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (0, 1, 2)) and odd[3].lang_pred in langs
    assert language_mix.predict_languages(none).collect() == []
    assert language_mix.identified(docs).columns == docs.columns


def test_op5_counts_of_every_prefix(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON_VOCAB)
    for r in token_counts.prefix_steps(docs, JSON_VOCAB, 20).collect():
        texts = [x[1] or "" for x in _rows() if x[0] == r.doc_id]
        whole = texts[0]
        assert (r.n_bytes, r.n_tokens) == (len(whole.encode()), len(t.encode(whole, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 20) and len(r.steps) == len(whole)
        cuts = range(len(whole) + 1) if len(whole) < 300 else range(0, len(whole), 997)
        counts = [len(t.encode(whole[:k], add_special_tokens=False).ids) for k in cuts]
        assert [token_counts.count_at(r.steps, k) for k in cuts] == counts
        if len(whole) < 300:
            assert r.fit_chars == max(k for k, c in zip(cuts, counts) if c <= 20)
    assert token_counts.prefix_steps(none, JSON_VOCAB, 20).collect() == []


def test_op3_finds_every_alignment_that_cover_admits():
    import itertools

    templates, postings = license_scan.rare_word_index({})
    for template in (t for t in templates if not t["base"]):
        words, key = template["words"], template["key"]
        may_miss = len(words) - math.ceil(license_scan.COVER * len(words))
        at = next(k for k in range(len(words)) if words[k:k + len(key)] == key)
        free = [k for k in range(len(words)) if not at <= k < at + len(key)]
        for gone in itertools.combinations(free, min(may_miss, len(free))):
            text = [b"zz" if k in gone else w for k, w in enumerate(words)]
            assert template["label"] in license_scan.scan_words(text, templates, postings, license_scan.COVER)[2]


def _components(rows, k, percent):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[find(i)].append(r[0])
    return sorted(((r[0], len(s), min((x for x in low[find(i)] if x is not None), default=None))
                   for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_op6_components(spark, docs, none, k, percent):
    import random

    rnd = random.Random(5)
    rows, n = list(_rows()), 100
    for size in (8, 40, 190, 230, 260, 600):  # groups of near copies on both sides of the size classes
        base = [f"w{rnd.randrange(2000)}" for _ in range(size)]
        for _ in range(14):
            text = [f"v{rnd.randrange(2000)}" if rnd.random() < rnd.choice((0, 0.01, 0.03)) else w for w in base]
            rows.append((n, "\n".join([" ".join(text), "the same line in all of them"]), *[None] * 7))
            n += 1
    table = spark.createDataFrame(rows, DOCS).repartition(3)
    got = shingle_join.components(table, k, percent, block_tokens=4000)
    assert _sorted(got, "doc_id", "n_shingles", "component_id") == _components(rows, k, percent)
    assert shingle_join.components(none, k, percent).collect() == []


def test_op4_as_many_languages_as_the_text_has(spark):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, model = language_mix.learn(sf)
    some = {r.lang: r.text for r in sf.filter("lang is not null and length(text) between 900 and 3000").orderBy("doc_id").collect()}
    mixes = [" ".join(some[lang] for lang in sorted(some)[:k]) for k in range(1, len(some) + 1)]
    rows = [(k, t) for k, t in enumerate(mixes)] + [(k + 10, t * 120) for k, t in enumerate(mixes)]  # also beyond 2**18 trigrams
    got = {r.doc_id: r.langs for r in language_mix.identify(spark.createDataFrame(rows, "doc_id long, text string"), langs, model).collect()}
    for k in range(len(some)):
        assert set(got[k].split(",")) == set(got[k + 10].split(",")) == set(sorted(some)[:k + 1])


def test_op6_one_of_each_with_repeated_and_null_ids(spark):
    base = [f"w{i}" for i in range(200)]
    near = lambda k: " ".join([*base[:-1], f"x{k}"])
    other = " ".join(f"y{i}" for i in range(90))
    rows = [(5, near(1), "a"), (5, near(2), "b"), (5, near(2), "b"), (None, near(3), "c"), (None, other, "d"), (None, other + " z", "e"),
            (5, "alone " * 3 + "in its group here", "f"), (7, "", "g"), (7, "", "g"), (8, None, "h"), (None, " ", "i"), (9, near(4), "j")]
    docs = spark.createDataFrame([(*r, "k", 1, "q") for r in rows],
                                 "doc_id long, text string, __kept string, sig string, n int, r string").repartition(3)
    left = shingle_join.one_of_each(docs)
    assert left.columns == docs.columns
    kept_rows = sorted((str(r.doc_id), r.text or "") for r in left.collect())
    first = min((near(1), near(2)), key=lambda t: shingle_join._digest(shingle_join.shingle_sets(__import__("pyarrow").array([t]), 5)[0]))
    second = min((other, other + " z"), key=lambda t: shingle_join._digest(shingle_join.shingle_sets(__import__("pyarrow").array([t]), 5)[0]))
    assert kept_rows == sorted([("5", first), ("None", second), ("5", rows[6][1]), ("7", ""), ("8", ""), ("None", " ")])
    assert shingle_join.one_of_each(docs.limit(0)).collect() == []


def test_op6_one_of_each_and_stars(spark, docs):
    left = shingle_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id in (10, 11, 12)) == [10]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert sorted(map(tuple, components.stars(chain).collect())) == [(i, 0) for i in range(1, 41)] + [(101, 100)]


def test_op6_one_of_each_shuffles_a_text_once(spark, docs):
    def texts(plan) -> int:
        """Texts that one row carries through the exchanges by set, along the longest way."""
        if plan.nodeName() == "AdaptiveSparkPlan":
            return texts(plan.initialPlan())
        below = max((texts(plan.children().apply(k)) for k in range(plan.children().size())), default=0)
        columns = plan.schema().simpleString()
        return below + (columns.count("text:string") if plan.nodeName() == "Exchange" and "sig:binary" in columns else 0)

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert texts(shingle_join.one_of_each(docs)._jdf.queryExecution().executedPlan()) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_op7_round_trip(docs, none):
    import tiktoken

    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_words.load_ranks(RANKS), special_tokens={})
    want = []
    for doc_id, text, *_ in _rows():
        ids = t.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    cols = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert _sorted(bpe_words.round_trip(docs, RANKS, public_tokenizers.PATTERN), *cols) == sorted(want, key=repr)
    small = bpe_words.decode(bpe_words.encode(docs, RANKS, public_tokenizers.PATTERN, block_pieces=50), RANKS)
    assert sorted(bytes(r.decoded) for r in small.collect()) == sorted((r[1] or "").encode() for r in _rows())
    assert bpe_words.round_trip(none, RANKS, public_tokenizers.PATTERN).collect() == []


def test_op8_mix(spark, docs, none):
    got = source_mix.taken_words(docs).collect()
    sizes = Counter()
    for _, text, _, source, *_ in _rows():
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, fixed = {}, {}
    while True:  # share, cut off, share the rest again
        rest = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        target = {**fixed, **{s: rest * weight[s] / sum(weight[x] for x in free) for s in free}}
        over = {s: 3 * sizes[s] for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    assert len(got) == len(_rows())
    by_size = {sizes[s]: target[s] for s in order}
    for r in got:
        assert r.target == pytest.approx(by_size[r.source_size]) and 0 <= r.taken <= 3 * r.size
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, source_mix.taken_words(docs.repartition(5)).collect()), key=repr)
    assert source_mix.mixed(docs).columns == docs.columns
    assert source_mix.taken_words(none).collect() == []


def test_op8_words_near_targets(spark):
    sf = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = source_mix.taken_words(sf).join(sf.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest"))
    for r in got.collect():
        assert abs(r.taken - r.target) <= r.largest + 0.02 * r.target


def test_op9_quality(spark, docs, none):
    labels = spark.createDataFrame([(10, 1), (10, 1), (13, 1), (15, 0), (None, 1)], "doc_id long, quality int")
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(docs, labels).collect()}
    for doc_id, text, *_ in _rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        times = Counter(windows)
        repeated = {i + j for i, x in enumerate(windows) if times[x] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[doc_id, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    # scores by hand: features, counts and ratios from the same hashes
    hashed = {r.doc_id: r.f for r in quality_rules._hashed(docs, F.col("doc_id")).select(
        "doc_id", quality_rules._features(F.col("__hash"), 64).alias("f")).collect()}
    all_f = [f for r in _rows() for f in hashed[r[0]]]
    good_f = [f for r in _rows() if r[0] in (10, 13) for f in hashed[r[0]]]
    raw, good = Counter(all_f), Counter(good_f)
    want = [math.log((good[b] + 1) / (len(good_f) + 64)) - math.log((raw[b] + 1) / (len(all_f) + 64)) for b in range(64)]
    assert quality_rules.log_ratios(docs, labels, buckets=64) == pytest.approx(want)
    assert quality_rules.judge(none, labels).collect() == []
    assert quality_rules.passing(docs, labels).columns == docs.columns


def test_op9_threshold_from_labels(spark):
    between = quality_rules.threshold_between
    assert between([0.1, -0.03], [-0.04, -0.5]) == pytest.approx(-0.035)
    assert between([-0.03, 0.1], [-0.06] * 100 + [-0.045]) == pytest.approx(-0.0525)  # 1 of 101 bad may stay
    assert between([-0.03, 0.1], [-0.06, 0.2]) == pytest.approx(-0.045)  # no good one of 2 may go
    assert between([-0.9] + [0.1] * 999, [-0.5, -0.04]) == pytest.approx(0.03)  # 1 of 1000 may
    assert between([0.0], []) == between([], [-0.3]) == quality_rules.THRESHOLD
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("not base_failed").join(labels, "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((0, True), 0) * 100 <= n[0, False] + n.get((0, True), 0)  # 71 of 291 were kept at -0.1
    assert n.get((1, False), 0) == 0


def test_op9_counts_all_labels(spark, monkeypatch):
    """Counts and threshold come from every labelled document, also where they are more than are broadcast."""
    n = 20_500  # more than the 20,000 labels that were chosen before
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.concat(F.lit("w"), F.col("id") % 11), 60)).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality_rules.log_ratios(docs, labels, buckets=64) == pytest.approx([0.0] * 64)
    rng = random.Random(5)
    rows = [(i, rng.choice([rng.gauss(0, 1), 0.25]), i % 10 == 3) for i in range(n)]
    scores = spark.createDataFrame(rows, "doc_id long, score double, base_failed boolean")
    known = spark.createDataFrame([(i, int(rng.random() < 0.6)) for i in range(n)], "doc_id long, quality int")
    good = dict(map(tuple, known.collect()))
    for shift in (0.0, 5.0):
        of = lambda q: [s + shift * q for i, s, failed in rows if not failed and good[i] == q]
        moved = scores.join(known, "doc_id").select("doc_id", (F.col("score") + shift * F.col("quality")).alias("score"), "base_failed")
        want = quality_rules.threshold_between(of(1), of(0))
        assert quality_rules.derived_threshold(moved, known) == want
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", 0)
    assert quality_rules.derived_threshold(moved, known) == want
    assert quality_rules.log_ratios(docs, labels, buckets=64) == pytest.approx([0.0] * 64)


def test_op10_urls(spark):
    urls = [None, "", "no scheme", "http://net", "http://a.net/", "http://A.Example.NET/en/x?y", "https://example.com/de/1", "http://org/fr/",
            "http://x.org/fr", "http://planet/", "http://e.net?x/en/", "http://casino.example.org/a", "http://WWW.x.org/CASINO/", "http://ads.x.org/",
            "http://blog.example.org/casino/", "ftp://h#://net/", "http://a.net/\n", "http://m.x.org/es/12/", "http://x.example.com/DE/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(4, urls[4], "x"), (None, urls[5], "")],
                                  "page_id long, url string, rule string")
    want = []
    for r in pages.collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fits = [(len(h + p), h + p, a) for a, h, p in url_filters.HOST_RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        low = re.sub("[A-Z]", lambda m: m[0].lower(), host + path)
        more = [(len(p), p, a) for a, p, _ in url_filters.PATTERN_RULES if re.search(p.replace(r"\z", r"\Z"), low)]
        best = max(fits) if fits else max(more) if more else (0, None, "allow")
        want.append((r.page_id, host, path, max(fits)[1] if fits else None, best[2]))
    assert _sorted(url_filters.judge_urls(pages), "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    assert url_filters.judge_urls(pages.limit(0)).collect() == []


def test_op10_rules_that_end_within_a_token(spark):
    urls = ["http://a.x/wp-login.php5"] + ["http://wp.x/login"] * 3 + ["http://a.x/1.php"]  # php is rarer than wp and login
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert _sorted(url_filters.judge_urls(pages), "page_id", "verdict") == [(0, "block"), *((i, "allow") for i in range(1, 5))]
    urls = ["http://b.x/english", "http://b.x/EN", "http://c.network/", "http://d/", "http://network/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filters.judge_urls(pages, [("block", "b.x", "/en"), ("block", "net", "")], [])
    assert _sorted(got, "page_id", "verdict") == [(0, "block"), (1, "allow"), (2, "block"), (3, "allow"), (4, "block")]


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixture", "tokens"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
    rows = corpus_pipeline.run(spark, sf).collect()
    texts = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    assert rows and all(texts[r.doc_id] == r.decoded_sha256 for r in rows)
