"""Operators of ``clausewise.llm`` against brute force, with their defined edge cases."""

import base64
import collections
import hashlib
import random
import re
import tempfile
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clausewise.llm import decontaminate, fingerprints, mixing, pii, quality, sharding, simhash, token_counts, url_filter, warc

SF = "/root/testdata/sf0.001"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns whose names the operators use inside.
CLASH = ("_id", "_key", "_row", "_score", "h", "fp", "spans", "copies", "_at")


def rows_of(spark, rows, schema="doc_id bigint, text string"):
    """Rows with clashing extra columns, over several partitions."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("extra") for c in CLASH}).repartition(3)


DOCS = [(1, "Alpha beta gamma delta"), (2, None), (3, ""), (3, ""), (4, "É été " * 50), (5, "x" * 200_000), (6, "word " * 30_000),
        (7, "Alpha beta gamma delta"), (7, "Alpha beta gamma delta"), (None, "no id at all"), (None, None), (8, "\t \n"), (9, "one")]


# ---------------------------------------------------------------- 1

def brute_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: r.rank, default=None)


def test_url_trie_is_the_longest_fitting_rule():
    draw = random.Random(5)
    part = lambda: draw.choice(["a", "b", "ab", "org", "com"])
    path = lambda: draw.choice(["", "/", "/a", "/a/", "/a/b", "//", "/ab/1", "/a/b/c"])
    for _ in range(300):
        rules = [url_filter.Rule(draw.choice(["allow", "block"]), ".".join(part() for _ in range(draw.randint(1, 3))), path()) for _ in range(8)]
        trie = url_filter.UrlTrie(rules)
        for _ in range(30):
            host = draw.choice(["", ".".join(part() for _ in range(draw.randint(1, 4)))])
            at = path()
            found, want = trie.find(host, at), brute_rule(host, at, rules)
            assert (found and found.rank) == (want and want.rank)


def test_url_judge_and_join_agree(spark):
    from clausewise.llm.queries import URL_RULES
    urls = [(1, "https://M.Example.ORG/en/12?x#y"), (2, None), (3, ""), (4, "no scheme"), (5, "http://a.com"), (6, "http://a.com?/fr/"),
            (7, "http://a.com/fr/x"), (8, "http://example.org/es/"), (9, "http://example.org/es"), (10, "a://b://c/d"), (1, "http://a.com/de/"),
            (11, "http://x.org/" + "s/" * 50_000)]
    df = rows_of(spark, urls, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    a = url_filter.judge(df, URL_RULES)
    b = url_filter.judge_by_join(df, spark.createDataFrame(URL_RULES, "action string, host string, path string"))
    cols = ["page_id", "host", "path", "rule", "verdict"]
    key = lambda r: tuple(map(str, r))
    got = sorted(map(tuple, a.select(cols).collect()), key=key)
    assert got == sorted(map(tuple, b.select(cols).collect()), key=key)
    assert got == sorted(map(tuple, url_filter.judge(df, spark.createDataFrame(URL_RULES, "action string, host string, path string")).select(cols).collect()), key=key)
    by = {(r[0], r[2][:8]): r for r in got}
    assert by[1, "/en/12"][1:] == ("m.example.org", "/en/12", "example.org/en/1", "block")
    assert by[2, ""][1:] == ("", "", None, "allow") == by[4, ""][1:]
    assert by[6, ""][1:] == ("a.com", "", None, "allow")
    assert by[7, "/fr/x"][3:] == ("com/fr/", "allow")
    assert by[9, "/es"][3:] == ("org/", "allow") and by[8, "/es/"][3:] == ("example.org/es/", "block")
    assert url_filter.judge(df.limit(0), URL_RULES).count() == 0


# ---------------------------------------------------------------- 2

def brute_contamination(text, items, n=10):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(A_Z))
    hit, found = set(), set()
    for item, body in items:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (body or "").translate(A_Z))
        k = min(n, len(w))
        for i in range(len(w) - k + 1) if k else ():
            for j in range(len(words) - k + 1):
                if words[j:j + k] == w[i:i + k]:
                    hit |= set(range(j, j + k))
                    found.add(item)
    return len(words), len(hit), sorted(str(x) for x in found if x is not None)


def test_contamination_is_brute_force(spark):
    draw = random.Random(2)
    some = lambda n: " ".join(draw.choice(["a", "B", "c,", "É", "ß!"]) for _ in range(n))
    items = [(i, some(draw.choice([0, 1, 3, 4, 5, 12, 14]) + 2)) for i in range(12)] + [(3, None), (None, some(7)), (20, ""), (2, "zz"), (21, "zz")]
    docs = DOCS + [(100 + i, some(draw.randint(0, 40)) + (" ZZ" if i % 5 == 0 else "")) for i in range(60)]
    got = decontaminate.contamination(rows_of(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = [(d, *brute_contamination(t, items)) for d, t in docs]
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == sorted((str(d), n, h, i) for d, n, h, i in want)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_decontaminate_drops_or_cuts(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "four five")], "item_id bigint, text string")
    docs = rows_of(spark, [(1, "x, One two - THREE! y"), (2, "clean"), (3, "four five"), (3, "clean too"), (None, "four five six"), (4, None)])
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == ["2", "3", "4"]
    cut = {(r.doc_id, r.text) for r in decontaminate.decontaminate(docs, items, mode="cut").collect()}
    assert cut == {(1, "x, y"), (2, "clean"), (3, ""), (3, "clean too"), (None, "six"), (4, None)}
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == 6
    # a table beyond the bound is broadcast in parts, with the same result
    far = decontaminate.contamination(docs, items, max_windows=1)
    assert sorted(r.n_hit for r in far.collect()) == [0, 0, 0, 2, 2, 3]


# ---------------------------------------------------------------- 3

def brute_shard(key, tree):
    node, path = tree, ""
    while node.children:
        def draw(c, path=path):
            h = 42
            for part in ([] if key is None else [str(key)]) + [f"{path}/{c.name}"]:
                h = xxhash.xxh64_intdigest(part.encode(), seed=h)
            return -np.log(((h >> 11) + 1) * 2.0 ** -53) / c.weight
        node = min(node.children, key=draw)
        path += f"/{node.name}"
    return node.shard


def test_shards_are_the_hash_tree(spark):
    docs = DOCS + [(i, f"text {i}") for i in range(100, 1500)]
    tree, grown = sharding.grid(24), sharding.grid(25)
    got = sharding.shard_rows(rows_of(spark, docs), tree, grown).collect()
    assert len(got) == len(docs)
    slots = collections.defaultdict(list)
    for r in got:
        assert r.shard == brute_shard(r.doc_id, tree)
        assert r.grown_shard == brute_shard(r.doc_id, grown)
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    assert 20 < sum(r.grown_shard == 24 for r in got) < 100
    assert sharding.shard_rows(rows_of(spark, docs).limit(0), tree, grown).count() == 0


def test_only_subtrees_with_new_weights_move(spark):
    before = sharding.grid(8, racks=2, per_rack=2)
    after = sharding.grid(8, racks=2, per_rack=2, weights=[1, 1, 1, 1, 3, 1, 1, 1])  # region 1 grows, in its first rack
    keys = spark.range(4000).select(F.col("id").alias("doc_id"))
    rows = sharding.descend(sharding.descend(keys, F.col("doc_id"), before, "a"), F.col("doc_id"), after, "b").collect()
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all(b >= 4 for _, b in moved)
    share = collections.Counter(r.b for r in rows)
    assert abs(share[4] / 4000 - 0.3) < 0.05 and abs(share[0] / 4000 - 0.1) < 0.03


# ---------------------------------------------------------------- 4

def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert {r.predicted for r in rows} == {0, 1}


def test_quality_learns_once_from_an_id(spark):
    texts = {i: ("good plain words of a page " * (3 + i) if i % 2 else "&& 1 9 9 !! ab ab ab " * (2 + i)) for i in range(40)}
    once = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id bigint, quality int")
    hot = next(i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2)
    many = [(hot, f"{n} other text !! " * 9) for n in range(200)] + [(hot, None)] * 50
    repeated = once.unionByName(spark.createDataFrame(many, once.schema)).repartition(4)
    least = repeated.filter(F.col("doc_id") == hot).orderBy(F.xxhash64("text")).first().text
    want = quality.fit(once.withColumn("text", F.when(F.col("doc_id") == hot, F.lit(least)).otherwise(F.col("text"))), labels)
    got = quality.fit(repeated, labels)
    assert np.allclose(got.mean, want.mean) and np.allclose(got.weights, want.weights) and np.isclose(got.threshold, want.threshold)


def test_quality_edges(spark):
    docs = rows_of(spark, DOCS)
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (9, None), (7, 0), (7, 1), (None, 0)], "doc_id bigint, quality int")
    scored = quality.classify(docs, labels).collect()
    assert len(scored) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    assert len({r.score for r in scored if not (r.text or "").strip()}) == 1
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    assert quality.keep_good(docs, labels.limit(0)).count() == len(DOCS)  # nothing learned, nothing rejected
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.classify(docs.limit(0), labels).count() == 0


# ---------------------------------------------------------------- 5

def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_components(prints, bits=3):
    root = {f: f for f in prints}
    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in root}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bucket", [2, 64])
def test_pairs_lose_no_link(spark, monkeypatch, bucket):
    """Dense clusters, with buckets that are cut again at once or hardly ever."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    draw = random.Random(bucket)
    prints = {0, (1 << 64) - 1, 7, 15}
    for _ in range(6):
        base = draw.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(draw.randint(0, 5)):
                x ^= 1 << draw.randrange(64)
            prints.add(x)
    got = {(r.a, r.b) for r in simhash.near_pairs(spark.createDataFrame([(signed(x),) for x in prints], "fp bigint")).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    assert got == want


def test_near_duplicates_are_brute_force(spark):
    draw = random.Random(9)
    base = [" ".join(draw.choice("abcdefghij") * draw.randint(1, 3) for _ in range(60)) for _ in range(8)]
    docs = list(DOCS)
    for i in range(60):
        w = draw.choice(base).split()
        for _ in range(draw.randint(0, 2)):
            w[draw.randrange(len(w))] = "new"
        docs.append((50 + i // 2, " ".join(w)))
    got = simhash.near_duplicates(rows_of(spark, docs)).collect()
    prints = [brute_fingerprint(t) for _, t in docs]
    root = brute_components(prints)
    least = {}
    for (d, _), f in zip(docs, prints, strict=True):
        least[root[f]] = min((x for x in (least.get(root[f]), d) if x is not None), default=None)
    want = [(str(d), signed(f), least[root[f]]) for (d, _), f in zip(docs, prints, strict=True)]
    assert sorted(map(str, ((str(r.doc_id), r.fingerprint, r.component_id) for r in got))) == sorted(map(str, want))
    kept = simhash.drop_near_duplicates(rows_of(spark, docs))
    assert kept.columns == rows_of(spark, docs).columns
    stay = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(stay) == len(set(root.values())) and {root[brute_fingerprint(t)] for _, t in stay} == set(root.values())
    assert all(d == least[root[brute_fingerprint(t)]] for d, t in stay)
    assert simhash.near_duplicates(rows_of(spark, docs).limit(0)).count() == 0


# ---------------------------------------------------------------- 6

def test_token_counts_are_the_librarys(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    file = public_tokenizers.path("word_bpe_49k.json")
    draw = random.Random(4)
    marks = ["a", "B", "'s", "'LL", " ", "\n", "\u00a0", "é", "e\u0301", "İ", "ı", "Σ", "ß", "²", "½", "_", "<|startoftext|>", "<|endoftext|>", "<|", "ſ",
             "日本", "🙂", "\x1c", "\x85", "’", "\u00ad", "!!", "12"]
    docs = DOCS + [(1000 + i, "".join(draw.choice(marks) for _ in range(draw.randint(0, 30)))) for i in range(400)]
    got = token_counts.token_counts(rows_of(spark, docs), file).collect()
    library = Tokenizer.from_file(file)
    want = sorted((str(d), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in docs)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    assert token_counts.token_counts(rows_of(spark, docs).limit(0), file).count() == 0


def test_token_cache_may_be_emptied(monkeypatch):
    import public_tokenizers
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    monkeypatch.setattr(token_counts, "CACHE", 3)
    counts = token_counts.Counts(spec, {})
    texts = [f"word{i} qzx{i}" for i in range(50)] + ["z" * 500]
    assert [counts.count([t])[0] for t in texts] == [counts.whole(t) for t in texts]
    assert len(counts.cache) < 10


# ---------------------------------------------------------------- 7

def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, ""), (4, "u", None), (5, "u", "É" * 300_000), (5, "u", "other"),
             (1, "http://a/", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, None, "alone"), (9, "h", "a\r\n\r\nb\n")]
    df = rows_of(spark, pages, "page_id bigint, url string, html string")
    path = tempfile.mkdtemp() + "/w"
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path).collect()
    least = {}
    for p, _, h in pages:
        least[h or ""] = min((x for x in (least.get(h or ""), p) if x is not None), default=None)
    want = []
    for p, _, h in pages:
        first = least[h or ""]
        body = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((str(p), len(body), digest, "response" if p == first else "revisit", str(None if p == first else first), body if p == first else None))
    read = [(str(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), r.payload and bytes(r.payload) or (b"" if r.record_type == "response" else None)) for r in got]
    assert sorted(map(str, read)) == sorted(map(str, want))
    few = warc.read_archives(spark, path, payload=False).filter("payload IS NOT NULL")
    assert few.count() == 0
    path = tempfile.mkdtemp() + "/w"
    warc.write_archives(df, path, min_bytes=9)
    assert {r.record_type for r in warc.read_archives(spark, path).collect()} == {"response"}
    path = tempfile.mkdtemp() + "/w"
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_warc_dictionary_and_damage():
    import zstandard
    samples = [f"<html><body><p>page {i} of the same kind</p></body></html>".encode() * 20 for i in range(200)]
    words = zstandard.train_dictionary(4096, samples).as_bytes()
    encoder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    record = warc.make_record("7", "http://x/", samples[0], None, False, "2020-01-01T00:00:00Z")
    lead = warc.struct.pack("<II", warc.DICTIONARY_MAGIC, len(words)) + words
    skip = warc.SEPARATOR.encode()
    big = warc.make_record("8", None, random.Random(1).randbytes(400_000), None, False, "2020-01-01T00:00:00Z")
    good = lead + skip + encoder.compress(record) + skip + encoder.compress(big) + skip
    assert [r["record_id"] for r in warc.read_archive(good)] == ["7", "8"]
    changed = record.replace(b"Content-Length: ", b"Content-Length: 1", 1)
    for bad in (good[:-30], lead + skip + b"\n" + good[len(lead):], skip + encoder.compress(record), lead + encoder.compress(changed),
                lead + encoder.compress(record.replace(b"same kind", b"SAME KIND", 1)), lead + encoder.compress(record.replace(b"WARC-Date", b"X-Date")),
                lead + encoder.compress(b"GARC/1.1\r\n\r\n"), lead + encoder.compress(record)[:-1] + b"?"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(bad))


# ---------------------------------------------------------------- 8

def test_rates_are_the_least_squares(spark):
    draw = np.random.default_rng(3)
    p = draw.dirichlet([0.4, 0.4, 0.4], size=300)
    n = draw.integers(0, 200, size=300)
    rows = [(1 + i % 2, int(k), *map(float, q)) for i, (k, q) in enumerate(zip(n, p, strict=True))]
    df = spark.createDataFrame(rows, "times bigint, n_tokens bigint, p0 double, p1 double, p2 double").repartition(3)
    w = np.array([r[0] * r[1] for r in rows])
    have = (w[:, None] * p).sum(axis=0)
    # reachable targets are met; with bounds, no feasible rates of a projected solver come closer
    rates = mixing.fit_rates(df, list(have * [0.5, 1.0, 1.7])).collect()
    got = sum(np.array([r.p0, r.p1, r.p2]) * r.times * r.n_tokens * r.rate for r in rates)
    assert np.allclose(got, have * [0.5, 1.0, 1.7], rtol=1e-3) and all(r.rate >= 0 for r in rates)
    target, low, high = have * [0.1, 1.0, 3.0], 0.5, 2.0
    rates = mixing.fit_rates(df, list(target), low, high).collect()
    got = sum(np.array([r.p0, r.p1, r.p2]) * r.times * r.n_tokens * r.rate for r in rates)
    h = np.linalg.pinv((w[:, None, None] * p[:, :, None] * p[:, None, :]).sum(axis=0))
    r = np.ones(300)
    for _ in range(3000):
        r = np.clip(r - p @ (h @ ((w * r)[:, None] * p).sum(axis=0) - h @ target), low, high)
    best = ((w * r)[:, None] * p).sum(axis=0)
    loss = lambda x: (x - target) @ h @ (x - target)
    assert loss(got) <= loss(best) * 1.001 + 1e-6


def test_mixing_meets_targets_and_edges(spark):
    from clausewise.llm import queries
    rows = queries.op8_mixing(spark, SF).collect()
    total = sum(r.n_tokens * r.rate for r in rows)
    for d, share in queries.MIX.items():
        assert abs(sum(r[f"p_{d}"] * r.n_tokens * r.rate for r in rows) / total - share) < 0.01
    assert all(r.rate >= 0 and int(r.rate) <= r.copies <= int(r.rate) + 1 for r in rows)
    docs = rows_of(spark, DOCS)
    labelled = spark.createDataFrame([("x", "alpha beta"), ("y", "word word"), (None, "q"), ("x", None)], "domain string, text string")
    kept = mixing.resample(docs, labelled, {"x": 1.0, "y": 1.0}, low=1.0)
    assert kept.columns == docs.columns
    ids = collections.Counter(str(r.doc_id) for r in kept.collect())
    assert set(ids) == {str(d) for d, _ in DOCS}
    rated, names = mixing.mix(docs, labelled.limit(0), {"x": 1.0})
    assert names == [None] and rated.agg(F.sum("times")).first()[0] == len(DOCS)
    assert mixing.resample(docs.limit(0), labelled, {"x": 1.0}).count() == 0


def test_a_rare_language_is_learned_and_an_unknown_one_reported(spark):
    from clausewise.llm import queries
    langs = ["en"] * 60 + ["fr"] * 3 + [None] * 4
    docs = spark.createDataFrame([(i, lang, f"{lang} words {i}") for i, lang in enumerate(langs)] + [(60, "fr", "again")] * 2,
                                 "doc_id bigint, lang string, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in [None, *range(-2000, 67)]], "doc_id bigint, quality int")
    rows = queries.labelled_domains(docs, labels, rows=10).collect()
    assert collections.Counter(r.domain for r in rows) == {"en": 10, "fr": 5}
    assert {(r.domain, r[mixing.ROWS_OF]) for r in rows} == {("en", 60), ("fr", 5)}
    model = mixing.fit(queries.labelled_domains(docs, labels, rows=10))
    assert model.domains == ["en", "fr"] and np.allclose(np.exp(model.prior), [60 / 65, 5 / 65])
    with pytest.warns(UserWarning, match="no labelled rows of de"):
        mixing.mix(docs, queries.labelled_domains(docs, labels), {"en": 0.7, "fr": 0.1, "de": 0.2})


# ---------------------------------------------------------------- 9

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    def holds(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in s.split(".")),
                "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
    return {k: [m.span() for m in re.finditer(p, text) if holds(k, m.group())] for k, p in PLAIN.items()}


def test_base_spans_are_the_patterns():
    draw = random.Random(8)
    marks = ["a", "B", "1", "22", "255", "256", ".", ".", "@", "@", "+", "-", "_", " ", "(", ")", "4111111111111111", "4111 1111 1111 1111", "é", "\n", "+1 (212) 555-0100"]
    for _ in range(30_000):
        s = "".join(draw.choice(marks) for _ in range(draw.randint(1, 14)))
        assert pii.base_spans(s) == brute_base(s), s


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_table())


def test_field_on_a_held_out_table(field):
    table = pii.labelled_table(400, seed=77)
    found = pii.find_spans([t for t, _ in table], field)
    assert not any(f for (_, s), f in zip(table, found, strict=True) if not s)
    marked = [(s[0], f) for (_, s), f in zip(table, found, strict=True) if s]
    assert sum(any(x[:3] == s for x in f) for s, f in marked) / len(marked) > 0.95
    assert any(not x[3] for _, f in marked for x in f)


def test_field_adds_national_numbers_and_plain_at_dot(field):
    want = {"call 212-555-0187 today": "212-555-0187", "ring 0151 23456789 or so": "0151 23456789", "phone: 212.555.0187": "212.555.0187",
            "write to jane at example dot com please": "jane at example dot com",
            "jane.doe at mail dot example dot org": "jane.doe at mail dot example dot org"}
    for text, found in zip(want, pii.find_spans(list(want), field), strict=True):
        assert [text[a:b] for _, a, b, _ in found] == [want[text]], text
    plain = ["ISBN 978-3-16-148410-0 in print", "in 2019 2020 2021 2022 we", "price 1 234 567 890 all", "I was at home dot com was down", "look at the dot here"]
    assert not any(pii.find_spans(plain, field))


def test_viterbi_is_the_best_path(field):
    import itertools
    draw = np.random.default_rng(1)
    small = pii.Field({str(i): i for i in range(6)}, draw.normal(size=(7, 9)) * 2, draw.normal(size=(9, 9)))
    small.emission[-1] = 0
    batch = [[[int(x) for x in draw.integers(0, 6, size=2)] for _ in range(n)] for n in (1, 3, 4)]
    for seq, got in zip(batch, small.decode(batch), strict=True):
        def score(path, seq=seq):
            if not pii._FIRST[path[0]] or not all(pii._ALLOWED[a, b] for a, b in itertools.pairwise(path)):
                return -1e9
            return sum(small.emission[f, y] for fs, y in zip(seq, path, strict=True) for f in fs) + sum(small.transition[a, b] for a, b in itertools.pairwise(path))
        assert tuple(got) == max(itertools.product(range(9), repeat=len(seq)), key=score)


def test_pii_on_spark(spark):
    docs = DOCS + [(50, "mail a.b@c.de, call (212) 555-0147 now"), (51, "License, Version 2.0."), (52, "1" * 300_000 + "@"), (53, "éreé. Des +1 (826) 555-4081 190.137.223.204 du le")]
    got = pii.with_spans(rows_of(spark, docs)).select("doc_id", "text", "spans", pii.joined(F.col("spans")).alias("s"))
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[50].s == "email:5:13,phone:20:34" and rows[51].s == "" == rows[2].s
    assert rows[53].s == "ip:28:43,phone:10:27"
    for d, t in docs:
        if d in (1, 2, 9, 50, 51, 53):  # the plain patterns are quadratic on 52
            assert [(s.kind, s.start, s.end) for s in rows[d].spans if s.base] == [(k, *s) for k, v in brute_base(t or "").items() for s in v]
    cut = {r.doc_id: r.text for r in pii.redact(got).collect()}
    assert cut[50] == "mail [email], call [phone] now" and cut[2] is None and cut[53] == "éreé. Des [phone] [ip] du le"
    assert pii.with_spans(rows_of(spark, docs).limit(0)).count() == 0


# ---------------------------------------------------------------- 10

def jaccard(a, b):
    a, b = (collections.Counter(re.findall(r"[^\x20\x09-\x0D]+", t.translate(A_Z))) for t in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_edits_and_likeness(spark):
    draw = random.Random(6)
    docs = [(i * 3, " ".join(draw.choice(["aa", "bb", "cc", "dd", "ee"]) + str(draw.randrange(40)) for _ in range(draw.randint(0, 120)))) for i in range(150)]
    docs += [(1, "É" * 41), (2, None), (4, "x"), (5, "")]
    got = {r.doc_id: r for r in fingerprints.edited_likeness(rows_of(spark, docs)).collect()}
    order = sorted(docs)
    off = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if t and after:
            off += [got[d].near_edited - jaccard(t, edited), got[d].near_next - jaccard(t, after)]
        if edited == t:
            assert got[d].near_edited == 1 and got[d].fingerprint == got[d].edited_fingerprint
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.12
    assert got[2].fingerprint == got[5].fingerprint == "0" * 4 * fingerprints.SAMPLES


def test_equal_texts_and_repeated_rows(spark):
    got = fingerprints.edited_likeness(rows_of(spark, DOCS)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in DOCS)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 7)}) == 1
    lone = fingerprints.edited_likeness(rows_of(spark, [(1, "a b c d e f")])).collect()[0]
    # a lone document is its own next one: 11 characters, of which the last two are replaced by the first two
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"a b c d ea ").hexdigest()
    assert fingerprints.edited_likeness(rows_of(spark, DOCS).limit(0)).count() == 0
