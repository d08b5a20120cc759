"""Corpus operators on small tables: brute force, round trips, held-out accuracy and odd rows."""

import hashlib
import itertools
import random
import re
import time
import tracemalloc
import zlib

import numpy as np

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixmill.llm import bpe, common, exact_dedup, license_scan, line_dedup, mixing, mpeg, ngram_join, quality, queries, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark, texts, first=1):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts, first)], DOCS)


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, more columns with names the operators use themselves."""
    long = " ".join(words(1, 30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (3, long, "en", "a", 1), (None, "Same text here", "en", None, 3), (4, "same TEXT here", "en", "b", 3), (4, "same TEXT here", "en", "b", 3), (5, "Ünïcode É text\nline\n\n", None, "b", 2), (6, " \t\n", "x", "", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in ("digest", "row", "key", "_key", "_nth", "size", "kept", "label", "node", "batch", "words")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- exact dedup --------------------------------------------------------------------------------------------------
def test_exact_dedup(spark, odd, empty):
    df = table(spark, ["Aa b", "aA B", "É", "é", "x", "AA B"])
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(df).collect()}
    assert [got[i].keep_id for i in range(1, 7)] == [6, 6, 3, 4, 5, 6] and [got[i].group_size for i in (1, 3)] == [3, 1]
    assert got[2].text_sha256 == hashlib.sha256(b"aa b").hexdigest() and {i for i in got if got[i].kept} == {3, 4, 5, 6}
    d = exact_dedup.exact_duplicates(odd).collect()
    assert len(d) == 10 and sum(r.kept for r in d) == 5
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 5
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_ids_at_both_ends_of_long(spark):
    """Batches follow the ids' order, however far apart and however skewed they are."""
    line = "a line that is certainly longer than forty letters"
    low, high = -(2**63), 2**63 - 1
    ids = [low, low + 1, -5, 0, 1, 2, 3, 4, high - 1, high, None]
    df = spark.createDataFrame([(i, f"{line}\nown {n % 4}", "en", "a", 1) for n, i in enumerate(ids)], DOCS)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(df, n_batches=3).collect()}
    for n, i in enumerate(ids):
        mates = [x for m, x in enumerate(ids) if m % 4 == n % 4]
        assert got[i] == (max(x for x in mates if x is not None), len(mates))
    kept = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(df).collect()}
    assert {i for i, t in kept.items() if line in t} == {high}
    spark_ids = [i for b in range(4) for i in [r.doc_id for r in df.where(common.descending_batch(df, 4) == b).collect()]]
    assert len(spark_ids) == len(ids) and [i for i in spark_ids if i is not None and i > 4] == [high - 1, high] or spark_ids[0] >= high - 1


def test_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    make = lambda ids: spark.createDataFrame([(f"d{i % 4}", i, i) for i in ids], "digest string, doc_id long, row long")
    index.add(make(range(3)))
    index.add(make(range(8)))
    assert sorted(r.doc_id for r in exact_dedup.DigestIndex(spark, index.name, index.path).table().collect()) == [0, 1, 2, 7]


def test_second_run_keeps_nothing_indexed(spark):
    index = exact_dedup.DigestIndex(spark, buckets=2)
    first = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(table(spark, ["a", "b", "A"]), index).collect()}
    second = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(table(spark, ["a", "c", "C"], 11), index).collect()}
    assert first == {1: (3, False), 2: (2, True), 3: (3, True)}
    assert second == {11: (3, False), 12: (13, False), 13: (13, True)}


def test_short_notices_need_their_name(spark):
    got = [r.labels for r in license_scan.scan_licenses(table(spark, ["Released under the BSD License.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC 4.0."])).orderBy("doc_id").collect()]
    assert got == ["", "", "cc-by-nc"]


# --- line dedup ---------------------------------------------------------------------------------------------------
def brute_lines(docs, min_chars=40, min_docs=5):
    held = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            held.setdefault(line.strip(" \t\n\x0b\x0c\r").translate(AZ), set()).add(d)
    common = {k: max(v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    return {d: "\n".join(x for x in (t or "").split("\n") if common.get(k := x.strip(" \t\n\x0b\x0c\r").translate(AZ), d) == d) for d, t in docs}


def test_line_dedup(spark, odd, empty):
    r = random.Random(2)
    pool = [" ".join(words(i, 12)) for i in range(12)]
    texts = ["\n".join(r.choice(pool).upper() if r.random() < 0.3 else "  " + r.choice(pool) for _ in range(r.randrange(6))) for _ in range(60)]
    got = {x.doc_id: x for x in line_dedup.dedup_lines(table(spark, texts)).collect()}
    want = brute_lines(list(enumerate(texts, 1)))
    assert {d: x.kept_text for d, x in got.items()} == want
    assert all(x.n_lines - x.n_dropped == (len(want[d].split("\n")) if x.n_lines > x.n_dropped else 0) for d, x in got.items())
    assert line_dedup.dedup_lines(odd).count() == 10 and line_dedup.dedup_lines(empty).count() == 0


def test_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(i, i, 1, b) for i in range(b, b + 4)], "h1 long, h2 long, n_docs long, max_doc long"))
    got = {r.h1: (r.n_docs, r.max_doc) for r in runs.totals().collect()}
    assert got == {i: (len(bs := [b for b in range(5) if b <= i < b + 4]), max(bs)) for i in range(8)}
    assert all(len(level) < 2 for level in runs.levels)


def test_line_runs_make_few_files(spark, monkeypatch):
    """No run is compacted after the last batch; few hashes share a bucket; the table of hashes has no folder a batch."""
    texts = ["\n".join(" ".join(words(i % n, 12)) for n in (3, 7, 40)) for i in range(40)]
    files = {}
    write, materialize = line_dedup.LineRuns._write, line_dedup.materialize

    def noted(df, name):
        files[name] = df.inputFiles()
        return df

    def write_noted(self, df):
        name = write(self, df)
        noted(self.spark.table(name), name)
        return name

    monkeypatch.setattr(line_dedup.LineRuns, "_write", write_noted)
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, *more: noted(materialize(df, name, *more), name))
    got = {x.doc_id: x.kept_text for x in line_dedup.dedup_lines(table(spark, texts)).collect()}
    assert got == brute_lines(list(enumerate(texts, 1)))
    runs = [f for n, f in files.items() if n.startswith("line_run_")]
    assert len(runs) == 5 and all(len(f) == 1 for f in runs)
    assert files["line-stats"] and not any("/batch=" in f for f in files["line-stats"])


# --- n-gram join --------------------------------------------------------------------------------------------------
def shingles(text, k):
    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", (text or "").translate(AZ)) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def components(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


@pytest.mark.parametrize(("k", "percent", "chunk", "part"), [(4, 85, 2048, 512), (5, 80, 6, 4)])
def test_ngram_join(spark, k, percent, chunk, part):
    r = random.Random(k)
    texts = []
    for g in range(12):
        base = words(100 + g, r.choice([3, 9, 40, 140, 400]))
        for _ in range(r.randrange(1, 14)):
            t = list(base)
            for _ in range(r.randrange(0, 1 + len(t) // 40)):
                t[r.randrange(len(t))] = f"n{r.random()}"
            texts.append(" ".join(t) + r.choice(["", " the end of it", "\n"]))
    texts += ["", None, "one", "ONE", "one two", "\t"]
    got = ngram_join.near_duplicates(table(spark, texts), k, percent, chunk=chunk, part=part).collect()
    want = components(list(enumerate(texts, 1)), k, percent)
    assert {x.doc_id: x.component_id for x in got} == want
    assert {x.doc_id: x.n_shingles for x in got} == {d: len(shingles(t, k)) for d, t in enumerate(texts, 1)}
    assert len(set(want.values())) < len(texts) - 5


def test_ngram_join_of_long_documents(spark):
    """Groups of long texts near the threshold, split into small trees, with a passage that all share."""
    r = random.Random(11)
    passage, texts = words(7, 60), []
    for g in range(3):
        base = words(200 + g, r.choice([2500, 4000, 6000])) + passage
        for n in range(9):
            t = list(base)
            for _ in range(len(t) * n // 250):
                t[r.randrange(len(t))] = f"n{r.random()}"
            texts.append(" ".join(t))
    got = ngram_join.near_duplicates(table(spark, texts), 4, 85, chunk=4, part=3).collect()
    want = components(list(enumerate(texts, 1)), 4, 85)
    assert {x.doc_id: x.component_id for x in got} == want and 3 < len(set(want.values())) < 27


def test_tree_memory_is_bounded():
    """One very large set among many small ones: fewer groups of counts, the same links."""
    r = np.random.default_rng(2)
    make = lambda n: np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
    sets = [make(200_000), *[make(40) for _ in range(1019)]]
    sets += [sets[5][:-2], sets[700][1:], sets[0][:-9000], sets[9]]
    tracemalloc.start()
    tree = ngram_join.CountTree(list(range(len(sets))), sets, list(range(len(sets))), 85)
    links = {tuple(sorted(x)) for x in tree.run()}
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert links == {(5, 1020), (700, 1021), (0, 1022), (9, 1023)}


def test_ngram_join_odd_rows(spark, odd, empty):
    assert ngram_join.near_duplicates(odd).count() == 10
    kept = ngram_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IN (3, 4)").count() == 2
    assert ngram_join.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (7, 7)], "src long, dst long")
    got = dict(map(tuple, common.connected_components(edges).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 55: 50, 60: 50}


# --- mixing -------------------------------------------------------------------------------------------------------
def test_targets():
    assert mixing.share_targets([10, 10, 80], [5, 2, 1]) == [30.0, 30.0, 40.0]
    assert mixing.share_targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.share_targets([0, 5], [5, 2]) == [0.0, 5.0] and mixing.share_targets([], []) == []


def test_flow_prefers_first_copies():
    flow = mixing.min_cost_flow([(10, [0]), (10, [0, 1]), (10, [1])], [20, 10])
    assert flow == [{0: 10}, {0: 10, 1: 0}, {1: 10}]
    flow = mixing.min_cost_flow([(10, [0]), (10, [0, 1])], [25, 10])
    assert sum(flow[0].values()) + sum(flow[1].values()) == 35 and flow[1][1] == 10 and max(map(sum, (f.values() for f in flow))) <= 30


def least_cost(patterns, quotas, layers):
    """By trying all flows: the most words, then the least cost."""
    edges = [(p, s) for p, (_, own) in enumerate(patterns) for s in own]
    best = (0, 0)
    for flow in itertools.product(*[range(layers * patterns[p][0] + 1) for p, _ in edges]):
        used, sent = [0] * len(patterns), [0] * len(quotas)
        for (p, s), f in zip(edges, flow):
            used[p] += f
            sent[s] += f
        if all(u <= layers * n for u, (n, _) in zip(used, patterns)) and all(x <= q for x, q in zip(sent, quotas)):
            best = min(best, (-sum(used), sum(k // patterns[p][0] + 1 for p, u in enumerate(used) for k in range(u))))
    return best


def test_flow_is_the_cheapest():
    r = random.Random(8)
    for _ in range(60):
        patterns = [(r.randrange(3), sorted(r.sample(range(3), r.randrange(1, 3)))) for _ in range(3)]
        quotas = [r.randrange(5) for _ in range(3)]
        flow = mixing.min_cost_flow(patterns, quotas, 2)
        used = [sum(f.values()) for f in flow]
        assert all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quotas)) and all(u <= 2 * n for u, (n, _) in zip(used, patterns))
        assert (-sum(used), sum(k // patterns[p][0] + 1 for p, u in enumerate(used) for k in range(u))) == least_cost(patterns, quotas, 2)


def test_flow_of_many_patterns_is_quick():
    r = random.Random(9)
    patterns = [(r.randrange(1, 1000), sorted(r.sample(range(40), r.randrange(1, 5)))) for _ in range(200_000)]
    total = sum(n for n, _ in patterns)
    began = time.process_time()
    flow = mixing.min_cost_flow(patterns, [total // 20 * (1 + s % 3) // 2 for s in range(40)])
    assert time.process_time() - began < 60
    assert sum(sum(f.values()) for f in flow) == sum(total // 20 * (1 + s % 3) // 2 for s in range(40))


def test_mix(spark, odd, empty):
    df = table(spark, [" ".join(words(i, 5 + i % 40)) for i in range(400)])
    a, b = (sorted(mixing.mix_sources(df).drop("sources").collect()) for _ in range(2))
    assert a == b
    total = {}
    for r in a:
        assert r.size == 0 or r.taken % r.size == 0 and r.taken <= 3 * r.size
        total.setdefault(r.target, []).append(r.taken)
    assert all(abs(sum(v) - t) <= 10 for t, v in total.items()) and sum(r.size for r in a) == pytest.approx(sum(total), abs=1)
    assert mixing.mix_sources(odd).count() == 10 and mixing.mix_sources(empty).count() == 0
    out = mixing.repeat_mixed(df)
    assert out.columns == df.columns
    n = dict(map(tuple, out.groupBy("doc_id").count().collect()))
    assert n == {r.doc_id: r.taken // r.size for r in a if r.taken}
    assert mixing.repeat_mixed(odd).columns == odd.columns


# --- license scan -------------------------------------------------------------------------------------------------
def test_license_scan(spark, odd, empty):
    df = table(spark, ["Under the MIT License. mit\nlicense, Mit-License", "the general public license!", "Released under MIT license", "no such thing", "permission to use copy modify and or distribute this software for any purpose with or without fee is granted", None])
    got = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (8, 3, 2, 6, "mit")
    assert got[2].base_labels == "gpl" and got[3].labels == "mit" and got[3].score == 1.0
    assert got[4].labels == "" and got[4].score == 0.0 and got[4].first_word is None
    assert got[5].base_labels == "" and got[5].labels == "isc" and 0.8 <= got[5].score <= 1.0 and got[6].n_words == 0
    assert license_scan.scan_licenses(odd).count() == 10 and license_scan.scan_licenses(empty).count() == 0


def best_windows(text):
    """The share of each template in the best window of words, where it is enough."""
    ws, out = [w for w in re.split(license_scan.NOT_WORD, text.translate(AZ)) if w], {}
    for k, (_, notice) in enumerate(license_scan.TEMPLATES):
        own, span = license_scan.template_words(notice), license_scan.window_words(notice, 0.8)
        n = max((len(set(ws[i : i + span]) & set(own)) for i in range(len(ws))), default=0)
        if n >= license_scan.words_needed(own, 0.8):
            out[k] = n / len(own)
    return out


def test_license_join_is_brute_force(spark):
    r = random.Random(4)
    pool = sorted({w for _, t in license_scan.TEMPLATES for w in license_scan.template_words(t)}) + ["other", "words"]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(r.randrange(4)):
            notice = license_scan.TEMPLATES[r.randrange(len(license_scan.TEMPLATES))][1].split()
            for _ in range(r.randrange(4)):  # words lost, put in, exchanged
                notice[(at := r.randrange(len(notice))) : at + r.randrange(2)] = r.choice([[], [r.choice(pool)]])
            parts += [*(r.choice(pool) for _ in range(r.randrange(60))), *notice]
        texts.append("".join(w + r.choice([" ", " ", "\n", ", ", "\n\n * "]) for w in parts))
    got = {}
    for x in license_scan.scan_licenses(table(spark, texts)).collect():
        for b in x.blocks or []:
            got[x.doc_id, b.template] = max(b.share, got.get((x.doc_id, b.template), 0))
    want = {(d, k): share for d, t in enumerate(texts, 1) for k, share in best_windows(t).items()}
    assert got == want and len({k for _, k in want}) == len(license_scan.TEMPLATES)


def test_wrapped_notices(spark):
    """Notices wrapped at any number of words, with marks before each line, and such as start or end inside long lines."""
    texts, want = [], []
    for label, notice in license_scan.TEMPLATES:
        ws = notice.split()
        for n in range(1, 21):
            texts.append("Some text.\n" + "\n".join(" * " + " ".join(ws[i : i + n]) for i in range(0, len(ws), n)))
            texts.append("long " * 30 + " ".join(ws[:n]) + "\n" + " ".join(ws[n:]) + " line" * 30)
            want += [label, label]
    texts += ["long " * 30 + "\nCC BY-NC\n4.0.", ("filler " * 9).join(license_scan.TEMPLATES[1][1].split())]
    got = [(r.labels, r.score) for r in license_scan.scan_licenses(table(spark, texts)).orderBy("doc_id").collect()]
    assert all(label in x.split(",") and score == 1.0 for label, (x, score) in zip(want, got[:-2], strict=True))
    assert got[-2:] == [("", 0.0), ("", 0.0)]


# --- archives -----------------------------------------------------------------------------------------------------
def test_archives(spark, empty):
    big, tricky = "x" * 1500, "WARC/1.1\r\n\r\n\r\n" + "é" * 700
    pages = [(1, "http://a", big), (2, None, big), (3, "http://c d", tricky), (9, "u", tricky), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (8, "u", big), (None, "u", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = {r.page_id: r for r in warc.pages_through_archives(df).collect()}
    assert len(got) == 9
    for p, _, h in pages:
        raw = (h or "").encode()
        assert (got[p].payload_bytes, got[p].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {p: got[p].refers_to for p in got} == {1: 8, 2: 8, 8: None, 3: 9, 9: None, 5: None, 6: None, 7: None, None: 8}
    assert {p for p in got if got[p].record_type == "revisit"} == {1, 2, 3, None}
    assert warc.pages_through_archives(df.where("false")).count() == 0


def test_records_of_two_gzip_members():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse_records(gzip.compress(one) + gzip.compress(one))] == [b"abc", b"abc"]


# --- media --------------------------------------------------------------------------------------------------------
def test_media_round_trip(spark, odd, empty):
    texts = ["", "a", "é" * 96, "é" * 97, "long " * 2000, None]
    got = {r.doc_id: r for r in mpeg.documents_as_media(table(spark, texts)).collect()}
    for d, t in enumerate(texts, 1):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert got[d].intact and got[d].duration_s == pytest.approx(-(-len(payload) // 384) * 1152 / 48000)
    assert mpeg.documents_as_media(odd).count() == 10 and mpeg.documents_as_media(empty).count() == 0


def test_damaged_media():
    media = mpeg.wrap_mpeg(bytes(range(192)) * 9)
    whole = mpeg.parse_mpeg(media)
    assert whole.payload == bytes(range(192)) * 9 and whole.vbr == "Xing" and whole.vbr_frames == len(whole.offsets) == 5 and whole.tags == ["id3v2.3"]
    assert [media[o] for o in whole.offsets] == [255] * 5 and len(whole.toc) == 100
    at = whole.offsets[2]
    lost = mpeg.parse_mpeg(media[:at] + b"\0\xff\x12" + media[at + 100 :] + b"TAG" + bytes(125))
    assert lost.skipped > 0 and lost.tags == ["id3v2.3", "id3v1"] and len(lost.offsets) == 4
    bad = bytearray(media)
    bad[whole.offsets[1] + 10] ^= 1
    assert mpeg.parse_mpeg(bytes(bad)).bad_crc == 1 and mpeg.parse_mpeg(b"no audio").offsets == []


def test_tag_letters_in_the_last_frame():
    for at in range(0, 189):
        payload = bytearray(b"z" * 192)
        payload[at : at + 3] = b"TAG"
        for more in (b"", b"y" * 576):
            s = mpeg.parse_mpeg(mpeg.wrap_mpeg(more + bytes(payload)))
            assert s.payload == more + bytes(payload) and s.tags == ["id3v2.3"] and s.skipped == 0


# --- BPE ----------------------------------------------------------------------------------------------------------
def test_bpe(spark, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["Hello, world! it's 2 o'clock", "<|endoftext|>x<|ENDOFTEXT|> <|startoftext|>", "ΣΑΣ Straße İi   é", "a\x1cb\x85c　d᠎e", "$$$ ###", "", None, "同じ 文章 🙂🙂", " ".join(words(3, 3000))]
    got = {r.doc_id: r for r in bpe.encode_documents(table(spark, texts), queries.tokenizer_path(), digests=True).collect()}
    for d, t in enumerate(texts, 1):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids), t
        assert got[d].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    plain = common.materialize(bpe.encode_documents(table(spark, texts), queries.tokenizer_path()), "encoded")
    for r in plain.collect():
        e = tok.encode(texts[r.doc_id - 1] or "", add_special_tokens=False)
        assert r.ids == e.ids and r.decoded == tok.decode(e.ids, skip_special_tokens=False)
    again = bpe.decode_ids(plain.select(F.col("doc_id").alias("row"), "ids"), queries.tokenizer_path())
    assert dict(map(tuple, again.collect())) == {r.doc_id: r.decoded for r in plain.collect()}
    assert bpe.encode_documents(odd, queries.tokenizer_path()).count() == 10 and bpe.encode_documents(empty, queries.tokenizer_path()).count() == 0


# --- classifiers --------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("run", "label", "least"), [(queries.op1_quality, "quality", 0.9), (queries.op9_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, run, label, least):
    sf = "/root/testdata/sf0.01"
    got = run(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")), F.count("*")).first()
    assert right >= least and n > 50


def test_classifiers_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for one in (none, spark.createDataFrame([(3, 1, 1), (None, 0, 0), (4, None, None)], none.schema)):
        q = quality.score_quality(odd, quality.train_quality(odd, one)).collect()
        t = toxicity.score_toxicity(odd, toxicity.train_toxicity(odd, one)).collect()
        assert len(q) == len(t) == 10 and all(0 <= r.score <= 1 for r in q + t)
    model = quality.train_quality(empty, none)
    assert quality.score_quality(empty, model).count() == 0 and quality.keep_good(odd, model).columns == odd.columns


@pytest.mark.parametrize(("run", "label"), [(queries.op1_quality, "quality"), (queries.op9_toxicity, "toxic")])
def test_held_out_classes(spark, run, label):
    """Both classes are found: a constant answer fails."""
    sf = "/root/testdata/sf0.01"
    got = run(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select(label, "predicted").collect()
    for y in (0, 1):
        mine = [r.predicted == y for r in got if r[0] == y]
        assert mine and sum(mine) / len(mine) >= 0.8


def test_one_long_word_is_quick():
    import time

    began = time.time()
    toxicity.dense_features("x" * 1_000_000, toxicity.Lexicon(frozenset(["bad"]), frozenset(["stup"])))
    assert time.time() - began < 5
    assert toxicity.HIDDEN.findall("ab1cd2ef s.t.u.p") == ["ab1cd", "s.t.u.p"]


def test_toxicity_scores_are_the_models(spark, odd):
    """Scores of a fitted model against its trees and curve evaluated one by one."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    docs = spark.createDataFrame([(i, f"you stupid idiot number {i} !!" if i % 3 == 0 else f"a kind word about {i} things") for i in range(1, 301)], "doc_id long, text string")
    model = toxicity.train_toxicity(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")), trees=3)
    both = docs.unionByName(odd.select("doc_id", "text"))
    bounds, values = np.array(model.curve.boundaries), np.array(model.curve.predictions)
    want = {}
    for r in both.collect():
        x = Vectors.dense(toxicity.dense_features(r.text or "", model.lexicon))
        margin = sum(w * t.predict(x) for t, w in zip(model.trees.trees, model.trees.treeWeights))
        want.setdefault(r.doc_id, []).append(float(np.interp(1 / (1 + np.exp(-2 * margin)), bounds, values)))
    got = toxicity.score_toxicity(both, model).collect()
    assert len(got) == 310 and all(min(abs(r.score - w) for w in want[r.doc_id]) < 1e-6 for r in got)


# --- pipeline -----------------------------------------------------------------------------------------------------
def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = common.materialize(corpus_pipeline.quality(spark, docs, sf), "t")
    model = {r.doc_id: r.predicted for r in queries.op1_quality(spark, sf).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, p in model.items() if p}
    once = common.materialize(corpus_pipeline.exact_dedup(spark, good, sf), "t")
    last = {}
    for r in good.collect():
        last[(r.text or "").translate(AZ)] = max(last.get((r.text or "").translate(AZ), -1), r.doc_id)
    assert {r.doc_id for r in once.collect()} == set(last.values())
    near = common.materialize(corpus_pipeline.near_dedup(spark, once, sf), "t")
    roots = components([(r.doc_id, r.text) for r in once.collect()], 5, 80)
    assert {r.doc_id for r in near.collect()} == set(roots.values())
    mixed = common.materialize(corpus_pipeline.mix(spark, near, sf), "t")
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix_sources(near).collect() if r.taken}
    assert dict(map(tuple, mixed.groupBy("doc_id").count().collect())) == taken
    assert corpus_pipeline.encode(spark, mixed, sf).count() == sum(taken.values())
    assert all(f(spark, docs, sf).columns == docs.columns for _, f in corpus_pipeline.STAGES[:2])
