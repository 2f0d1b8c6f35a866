"""The corpus operators against brute force, exact round trips and held-out labels."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, "a", "A b", " \t\n", "x " * 3000, "Ünï cödé ςΣ 你好 ½", "a b c a b c a b c", "\n\nsame\nsame\n \nsame", "you are  an idiot!!", "one\x1ctwo\x85three\xa0four", "| # $ % & < > *"]


def frame(spark, texts, extra=True):
    """Odd rows: nulls, repeats, ties, and columns whose names clash with results."""
    rows = [(k, t, "x", 0.5, 7) for k, t in enumerate(texts)]
    rows += [(3, texts[3], "x", 0.5, 7), (None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, kept int")
    return df if extra else df.select("doc_id", "text")


def empty(spark):
    return frame(spark, ODD).limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def path(name):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path(name)


# -- exact dedup ---------------------------------------------------------------------
@pytest.mark.parametrize("tracked", [2048, 8])
def test_exact_dedup(spark, docs, tracked):
    from tidewater.llm.exact_dedup import exact_dedup

    for df in (docs, frame(spark, ODD + ["dup"] * 40 + ["", "a"])):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        sizes, best = Counter(t for _, t in rows), {}
        for i, t in rows:
            best[t] = max(best.get(t, -1), -1 if i is None else i)
        got = exact_dedup(df, tracked=tracked).collect()
        assert len(got) == len(rows)
        want = Counter((i, None if best[t] == -1 else best[t], sizes[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = [r for r in got if r.kept]
        assert len(kept) == len(sizes) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_finds_heavy_digests(spark):
    from tidewater.llm.exact_dedup import heavy_digests

    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as text_sha256")
    assert heavy_digests(df, 64) == ["hot"]


def test_exact_dedup_finds_all_of_many_heavy_digests(spark):
    from tidewater.llm.exact_dedup import heavy_digests

    # 200 digests of a quarter of a percent each, half of all rows, in 40 partitions
    df = spark.range(0, 200_000, 1, 40).selectExpr("if(id % 2 = 0, concat('hot', id % 400), cast(id as string)) as text_sha256")
    assert set(heavy_digests(df)) == {f"hot{k}" for k in range(0, 400, 2)}


# -- SimHash -------------------------------------------------------------------------
def brute_fingerprint(text):
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    from tidewater.llm.simhash import simhash_groups

    rng, base = random.Random(5), "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [" ".join(rng.choice(base) for _ in range(400)) for _ in range(3)]
    near = []
    for t in texts:
        w = t.split()
        for k in range(25):
            w[rng.randrange(400)] = f"w{k}"
            near.append(" ".join(w))
    for df in (docs, frame(spark, ODD[:3] + ["p q r"] + texts + near, False)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        fps = [brute_fingerprint(t) for _, t in rows]
        got = simhash_groups(df).collect()
        assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{f:016x}") for (i, _), f in zip(rows, fps, strict=True))
        distinct = sorted(set(fps))
        links = [(a, b) for k, a in enumerate(distinct) for b in distinct[:k] if (a ^ b).bit_count() <= 2]
        roots, first = brute_components(distinct, links), {}
        for (i, _), f in zip(rows, fps, strict=True):
            if i is not None:
                first[roots[f]] = min(first.get(roots[f], i), i)
        assert {(r.fingerprint, r.component_id) for r in got} == {(f"{f:016x}", first.get(roots[f])) for f in fps}
    assert len(links) > 10
    assert simhash_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_connect_what_pairs_connect(spark, radius):
    from tidewater.llm.components import connected_components
    from tidewater.llm.simhash import links

    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(rng.randrange(6))}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute_components(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius])
    got = {r.node: r.root for r in connected_components(links(df, radius), "t").collect()}
    assert all(got.get(f, f) == want[f] for f in signed)


def test_components_of_chains_and_stars(spark):
    from tidewater.llm.components import connected_components

    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 80)] + [(7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {k: 0 for k in range(61)} | {100 + k: 100 for k in range(80)}


# -- near copies ---------------------------------------------------------------------
def brute_near_links(texts):
    """Pairs of five-word similarity >= 0.8: all that share a window are compared."""
    sets, holders, near = [], defaultdict(list), []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    rare = sorted(holders, key=lambda x: (len(holders[x]), x))
    rank = {x: n for n, x in enumerate(rare)}
    first = [set(sorted(s, key=rank.get)[: len(s) - -(-4 * len(s) // 5) + 1]) for s in sets]
    for k, s in enumerate(sets):  # sets this similar share one of their rarest windows
        for j in {j for x in first[k] for j in holders[x] if j < k and x in first[j]}:
            both = len(s & sets[j])
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                near.append((j, k))
    return near


def near_texts():
    """Copies of a few texts with more and more words changed, and one large group."""
    rng, out = random.Random(8), []
    for n in (6, 9, 14, 60, 300, 2000):
        base = [f"{rng.choice('abcdef')}{rng.randrange(10**6)}" for _ in range(n)]
        for changed in (0, 1, 2, n // 60, n // 50, n // 45, n // 40, n // 20):
            w = list(base)
            for k in rng.sample(range(n), min(n, changed)):
                w[k] = f"new{rng.randrange(10**6)}"
            out.append("  ".join(w).upper() if changed == 2 else " ".join(w))
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    for _ in range(120):
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(1, 7)):
            w[k] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_dedup_keeps_one_of_each_group_of_near_copies(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").dropDuplicates(["text"]).coalesce(4)
    for df, pairs in ((p.materialize(docs, "test-near"), 48), (frame(spark, ODD + near_texts(), False), None)):
        rows = sorted((r.doc_id, r.text) for r in df.collect() if r.doc_id is not None)
        near = brute_near_links([t for _, t in rows])
        assert len(near) == pairs if pairs else len(near) > 300
        roots = brute_components(range(len(rows)), near)
        want = {rows[k][0] for k in roots.values()}
        got = [r.doc_id for r in p.near_dedup(spark, df, "").collect() if r.doc_id is not None]
        assert len(want) < len({t for _, t in rows}) and sorted(got) == sorted(want)


# -- BPE -----------------------------------------------------------------------------
def odd_texts():
    rng = random.Random(11)
    letters = "abcdeXYZ' ’\t\n\x1c\x85\xa0\x00éßΣσςİ́你好²½٣_-.,!|<>019ǅﬁ​🎉"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(600)]
    return out + ["", "<|endoftext|>", "a<|startoftext|> b<|endoftext|>c<|", "   a   b\n\n c", "z" * 4000, "ab" * 2000 + "ba", "don't WE'LL i'd"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_library(docs, name):
    from tokenizers import Tokenizer

    from tidewater.llm.bpe import Bpe, RankBpe

    library = Tokenizer.from_file(path(name))
    texts = odd_texts() + [r.text or "" for r in docs.collect()]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for bpe in (Bpe(path(name)), RankBpe(path(name))):
        got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts)]
        assert got == want
        assert [bpe.decode(np.array(x, "<u4").tobytes()).decode() for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_memory_turns_over(docs, monkeypatch):
    from tidewater.llm import bpe

    monkeypatch.setattr(bpe, "CACHE_BOUND", 50)
    monkeypatch.setattr(bpe, "STEP", 500)
    small, texts = bpe.Bpe(path("word_bpe_49k.json")), [r.text or "" for r in docs.limit(60).collect()]
    monkeypatch.undo()
    assert list(small.encode(texts)) == list(bpe.Bpe(path("word_bpe_49k.json")).encode(texts))


def test_merge_equals_proposal_where_it_passes():
    from tidewater.llm.bpe import Bpe

    bpe, rng = Bpe(path("byte_bpe_50k.json")), random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randrange(1, 14))) for _ in range(2000)]
    assert bpe.encode_words(words) == [bpe.merge(w) for w in words]


def test_bpe_query_rows(spark):
    from tidewater.llm.bpe import bpe_roundtrip

    got = bpe_roundtrip(frame(spark, ODD), path("word_bpe_49k.json")).collect()
    assert len(got) == len(ODD) + 2
    blank = next(r for r in got if r.doc_id == 1)
    assert blank.n_tokens == 0 and blank.ids_sha256 == hashlib.sha256(b"").hexdigest() == blank.decoded_sha256
    assert bpe_roundtrip(empty(spark), path("word_bpe_49k.json")).count() == 0


# -- Huffman files -------------------------------------------------------------------
def test_code_lengths_are_optimal_and_limited():
    from tidewater.llm.huffman import code_lengths

    rng = np.random.default_rng(1)
    for counts in (rng.integers(0, 50, 300), (1.6 ** np.arange(40)).astype(int), np.array([0, 5, 0]), np.array([3, 3]), np.zeros(4, int)):
        got = code_lengths(np.asarray(counts), 16).astype(int)
        used = np.asarray(counts) > 0
        assert (got[used] > 0).all() and (got[~used] == 0).all() and got.max(initial=0) <= 16
        assert sum(2.0 ** -got[used]) <= 1 + 1e-12
    import heapq

    counts = rng.integers(1, 1000, 200)
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert int((code_lengths(counts, 16) * counts).sum()) == total


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000])
def test_code_round_trip(n):
    from tidewater.llm.huffman import Code, code_lengths

    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) * 7 % 65536, 65535)
    code = Code(code_lengths(np.bincount(ids, minlength=1 << 16)))
    bits, offsets = code.encode(ids)
    assert (code.decode(bits, offsets, n) == ids).all()


def test_huffman_files(spark, docs):
    from tokenizers import Tokenizer

    from tidewater.llm.huffman import huffman_roundtrip

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    for df in (docs, frame(spark, ODD)):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        at, want = 0, []
        for i, t in rows:
            ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        got = huffman_roundtrip(df, path("word_bpe_49k.json")).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert huffman_roundtrip(empty(spark), path("word_bpe_49k.json")).count() == 0


def test_huffman_files_of_equal_ids_and_wide_vocabularies(spark, docs, monkeypatch):
    from pyspark.errors import PythonException

    from tidewater.llm import huffman
    from tidewater.llm.common import fresh_path

    monkeypatch.setattr(huffman, "FILE", 2000)
    same = docs.limit(60).selectExpr("'one id' as doc_id", "text")
    folder = fresh_path(spark, "tokens")
    index = huffman.write_tokens(same, path("word_bpe_49k.json"), folder)
    got = huffman.read_tokens(spark, folder, "string").collect()
    assert index.select("name").distinct().count() > 2 and len(got) == 60 and {r.doc_id for r in got} == {"one id"}
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    with pytest.raises(PythonException, match="16 bits"):
        huffman.huffman_roundtrip(same, path("word_bpe_49k.json"), end_id=1 << 16).collect()


# -- WARC ----------------------------------------------------------------------------
def test_warc(spark):
    from tidewater.llm.warc import warc_roundtrip

    odd = [(7, "w", "<i>"), (7, "w", "<i>"), (7, "a", "<i>"), (7, None, "<i>"), (1, "http://a b\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 9000), (5, "u", "é" * 9000), (None, "u", "<p>x</p>"), (6, "v", "\r\n\r\nWARC/1.1")]
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for df in (pages, spark.createDataFrame(odd, "page_id long, url string, html string").selectExpr("*", "1 as offset", "'n' as name")):
        rows = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
        first = {}
        for i, p in rows:
            first[p] = min(first.get(p, (True, 1 << 40)), (i is not None, i or 0))
        got = [tuple(r) for r in warc_roundtrip(df).collect()]
        assert Counter(r[:3] for r in got) == Counter((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode()) for i, p in rows)
        assert Counter(r[2] for r in got if r[3] == "response") == {base64.b32encode(hashlib.sha1(p).digest()).decode(): 1 for p in first}
        for i, _, digest, kind, to in got:
            lead = next(f[1] if f[0] else None for p, f in first.items() if base64.b32encode(hashlib.sha1(p).digest()).decode() == digest)
            assert to is None if kind == "response" else to == lead
            assert kind == "revisit" or i == lead
    assert warc_roundtrip(pages.limit(0)).count() == 0


def test_warc_records_have_unique_ids_and_revisits_name_their_response(spark):
    import gzip
    import os

    from tidewater.llm.common import fresh_path
    from tidewater.llm.warc import read_records, write_archives

    rows = [("", "u", "same"), ("a", "u", "same"), ("a", "u", "same"), (None, "u", "other"), ("b", "v", "other"), ("c", "w", "")]
    pages, folder = spark.createDataFrame(rows, "page_id string, url string, html string"), fresh_path(spark, "warc")
    got = read_records(spark, folder, write_archives(pages, folder)).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows)
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {("a", ""), ("b", None)}
    at, heads = folder.removeprefix("file://"), []
    for name in os.listdir(at):
        if name.endswith(".warc.gz"):
            with gzip.open(f"{at}/{name}") as f:
                heads += [dict(x.split(": ", 1) for x in h.split("\r\n")[1:] if ": " in x) for h in f.read().decode().split("WARC/1.1") if h]
    ids = {h["WARC-Record-ID"]: h for h in heads}
    assert len(ids) == len(rows)
    for h in heads:
        if h["WARC-Type"] == "revisit":
            to = ids[h["WARC-Refers-To"]]
            assert to["WARC-Type"] == "response" and to["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]


def test_warc_reads_selected_records_by_range(spark):
    from tidewater.llm.common import fresh_path
    from tidewater.llm.warc import GAP, ranges, read_records, write_archives

    folder, pages = fresh_path(spark, "warc"), spark.read.parquet(f"{SF}/pages.parquet")
    index = write_archives(pages, folder)
    got = {r.page_id: r.payload.decode() for r in read_records(spark, folder, index.where("page_id % 7 = 0 and record_type = 'response'")).collect()}
    html = {r.page_id: r.html for r in pages.collect()}
    assert got and all(html[i] == p for i, p in got.items())
    assert list(ranges([(0, 10), (10, 5), (15 + GAP + 1, 4)])) == [(0, 15, 0, 2), (16 + GAP, 20 + GAP, 2, 3)]


# -- packing -------------------------------------------------------------------------
def check_packing(df, got, capacity=1024):
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(path("byte_bpe_50k.json")), []
    for r in df.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = list(range(len(ids) % capacity or capacity, len(ids) + 1, capacity))
        for k, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)):
            want.append((r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= capacity
    total = sum(r.length for r in got)
    assert len(bins) <= total / capacity * 1.02 + 2


def test_packing(spark, docs):
    from tidewater.llm.packing import pack_documents

    for df in (docs, frame(spark, ODD)):
        check_packing(df, pack_documents(df, path("byte_bpe_50k.json")).collect())
    assert pack_documents(empty(spark), path("byte_bpe_50k.json")).count() == 0


def test_fullest_is_the_best_sum():
    from tidewater.llm.packing import fullest, plan

    rng = random.Random(3)
    for _ in range(60):
        counts = np.zeros(33, int)
        for _ in range(rng.randrange(8)):
            counts[rng.randrange(1, 33)] += 1
        room, sums = rng.randrange(1, 33), {0}
        for k in np.repeat(np.arange(33), counts).tolist():
            sums |= {s + k for s in sums}
        got = fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room) and all(got.count(k) <= counts[k] for k in got)
    runs = plan(np.bincount([5, 5, 5, 3, 3, 8, 2], minlength=9), 8)
    assert sorted(r[0] for r in runs.tolist()) == [2, 3, 5, 5, 8] or runs[:, 0].max() == 8


# -- rules ---------------------------------------------------------------------------
def brute_base(text):
    text = text or ""
    words, lines = SPACE.findall(text), [x for x in text.split("\n") if SPACE.search(x)]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen, inside = Counter(grams), set()
    for k, g in enumerate(grams):
        if seen[g] > 1:
            inside |= {k, k + 1, k + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_rules_base_statistics(spark, docs, labels):
    from tidewater.llm.rules import BASE, quality_rules

    for df in (docs, frame(spark, ODD)):
        want = Counter((r.doc_id, *brute_base(r.text)) for r in df.collect())
        got = quality_rules(df, labels).collect()
        assert Counter((r.doc_id, *(r[k] for k in BASE)) for r in got) == want
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality_rules(empty(spark), labels).count() == 0
    assert quality_rules(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_rules_trim_blanks_and_no_letters(spark, labels):
    from tidewater.llm.rules import BASE, quality_rules

    df = frame(spark, ["f", "fluff of", "one two of one two of", "\x0cone two\x0c", "\x0b\x0cf f f f\x0c\r", "\x0c", "uncut u000b"])
    want = Counter((r.doc_id, *brute_base(r.text)) for r in df.collect())
    assert Counter((r.doc_id, *(r[k] for k in BASE)) for r in quality_rules(df, labels).collect()) == want


def test_rules_are_learned_and_pruned():
    from tidewater.llm.rules import _covers, learn

    rng, rows = random.Random(1), []
    for k in range(1000):
        a, b = rng.random(), rng.random()
        rows.append({"a": a, "b": b, "label": int(not (a > 0.8 and b < 0.5)), "fold": k % 10})
    rules = learn(rows, ["a", "b"])
    wrong = sum((not any(_covers(r, x) for r in rules)) != bool(x["label"]) for x in rows)
    assert 1 <= len(rules) <= 6 and wrong < 20
    assert learn([], ["a"]) == []


# -- classifiers ---------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, kind):
    from tidewater.llm.quality import score_quality
    from tidewater.llm.toxicity import score_toxicity

    score = score_quality if kind == "quality" else score_toxicity
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = score(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r[kind] for r in got) / len(got)
    assert right > 0.9 and all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert {r.doc_id for r in got} <= held
    odd = score(frame(spark, ODD), labels)
    assert odd.count() == len(ODD) + 2 and odd.columns.count("score") == 1 and "lang" in odd.columns
    assert score(empty(spark), labels).count() == 0
    none = {r.predicted for r in score(frame(spark, ODD), labels.limit(0)).collect()}
    assert none == {1 if kind == "quality" else 0}


def test_labels_of_held_out_rows_do_not_matter(spark, docs, labels):
    from pyspark.sql import functions as F

    from tidewater.llm.common import held_out
    from tidewater.llm.quality import score_quality

    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r.doc_id, round(r.score, 5)) for r in score_quality(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_quality_votes_equal_brute_force(spark, docs, labels):
    from tidewater.llm.common import labelled_sample
    from tidewater.llm.quality import Model, fit, score_quality, term_row

    sample = sorted(labelled_sample(docs, labels, "quality", 4000).collect(), key=lambda r: r.doc_id)
    model = fit(docs, labels)
    assert model.labels.tolist() == [r.label for r in sample] and len(model.vectors) == len(sample)
    got = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}

    def vector(text):  # one text at a time, straight from the definition
        x = term_row(text)
        x[:1024] *= model.idf
        for (a, b), w in (((0, 1024), 0.4), ((1024, 1280), 1.0), ((1280, 1288), 1.0)):
            x[a:b] *= w / max(np.linalg.norm(x[a:b]), 1e-9)
        x = (x - model.mean) @ model.project
        return x / max(np.linalg.norm(x), 1e-9)

    vectors = np.stack([vector(r.text) for r in sample])
    assert np.allclose(vectors, model.vectors, atol=1e-4)
    for r in docs.collect():
        near = np.sort(vectors @ vector(r.text or ""))
        cosine = vectors @ vector(r.text or "")
        votes = [(max(c, 0) ** 4 + 1e-6, y) for c, y in zip(cosine, model.labels, strict=True) if c >= near[-15] - 1e-6]
        if near[-15] - near[-16] > 1e-4:  # else rounding decides who votes
            assert abs(sum(w * y for w, y in votes) / sum(w for w, _ in votes) - got[r.doc_id]) < 2e-3
    tied = Model(np.array([term_row("a b c")] * 20 + [term_row("x y z w " * 40)] * 5), np.array([1, 0] * 10 + [0] * 5))
    assert tied.score(np.stack([term_row("a b c")]))[0] == pytest.approx(0.5)  # all 20 that tie vote


def test_toxicity_features_and_trees_equal_brute_force():
    from tidewater.llm.toxicity import FEATURES, Chunks, Trees, features

    memory = Chunks({"bad": 2.0, "awfu*": 1.5})
    x = dict(zip(FEATURES, features("You are BAD, bad and awfully b4d!!", memory), strict=True))
    assert x["word_count"] == 2 and x["word_kinds"] == 2 and x["word_density"] == 2 / 7 and x["word_top"] == 2.0 and x["word_weight"] == 4 / 7
    assert x["prefix_count"] == 1 and x["prefix_top"] == 1.5 and x["near_second"] == 2 / 7 and x["second_rate"] == 1 / 7
    assert x["shout_rate"] == 1 / 7 and x["obfuscated_rate"] == 1 / 7 and x["bang_rate"] == 2 / 34 and x["punctuation_rate"] == 3 / 34 and x["capital_rate"] == 4 / 34
    rng = np.random.default_rng(7)
    data = rng.random((400, 4))
    trees = Trees(data, (data[:, 0] > 0.4).astype(float), rounds=12)

    def walk(row):
        out = trees.start
        for feature, cut, value in trees.trees:
            k = 0
            while k < len(feature):
                k = 2 * k + 1 + (row[feature[k]] > cut[k])
            out += value[k - len(feature)]
        return out

    assert np.allclose(trees.margin(data), [walk(r) for r in data])


def test_whole_chunks_count():
    from tidewater.llm.quality import Terms
    from tidewater.llm.toxicity import Chunks, features

    long = "x-" * 60
    assert Terms()[long + "AA"] % 256 != Terms()[long + "7%%7"] % 256
    seen = features(long + "b4d", Chunks({}))
    assert seen != features(long + "bad", Chunks({}))


def test_samples_are_bounded_in_rows(spark):
    from tidewater.llm.common import labelled_sample

    docs = spark.range(300).selectExpr("cast(id as string) as doc_id", "concat('t', id % 7) as text", "explode(sequence(1, 50)) as n")
    labels = spark.range(300).selectExpr("cast(id as string) as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    got = labelled_sample(docs, labels, "quality", 100).collect()
    assert len(got) == 100 == len({r.doc_id for r in got})


def test_operators_take_any_ids_and_column_names(spark, labels):
    """Ids that are strings; columns named like the operators' own."""
    from tidewater.llm import quality, rules, toxicity

    rows = [(f"id{k}", t, 1.5, "a", "b", "c", True, 9) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _text double, _score string, _key string, _rid string, kept boolean, score int")
    for keep in (quality.keep_good, toxicity.keep_clean):
        got = keep(df, labels).collect()
        assert got and set(got) <= set(df.collect())
    assert quality.score_quality(df, labels).drop("held_out", "score", "predicted").exceptAll(df.drop("score")).count() == 0
    assert rules.quality_rules(df, labels).count() == len(rows)
    import corpus_pipeline as p

    for _, stage in p.STAGES[:-1]:
        got = stage(spark, df, "/root/testdata/sf0.01").collect()
        assert got and set(got) <= set(df.collect())


def test_near_dedup_of_rows_without_ids(spark):
    import corpus_pipeline as p

    text = " ".join(f"w{k}" for k in range(200))
    rows = [(None, text), (None, text + " x"), (None, text + " y"), (3, "other words here"), (3, "other words here"), (3, text + " z")]
    for part in (rows, rows[:3]):
        got = p.near_dedup(spark, spark.createDataFrame(part, "doc_id long, text string"), "").collect()
        assert len(got) == len({"w0" in t for _, t in part})


def test_rules_on_held_out_rows(spark):
    from tidewater.llm.common import held_out
    from tidewater.llm.rules import quality_rules

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules(docs, labels).join(labels, "doc_id").where(held_out() & ~F_col("base_failed")).collect()
    bad = [r for r in got if r.quality == 0]
    assert len(got) > 300 and len(bad) > 20
    assert sum(r.kept == bool(r.quality) for r in got) / len(got) > 0.97
    assert sum(not r.kept for r in bad) / len(bad) > 0.8


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_trees_and_calibration():
    from tidewater.llm.toxicity import Isotonic, Trees

    rng = np.random.default_rng(4)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    margin = Trees(x, y).margin(x)
    assert ((margin > 0) == y).mean() > 0.95
    iso = Isotonic(margin, y)
    assert (np.diff(iso.value) > 0).all() and abs(iso(margin).mean() - y.mean()) < 0.02


# -- licenses ------------------------------------------------------------------------
def test_license_scans(spark, docs):
    from tidewater.llm.licenses import TEMPLATES, scan_licenses

    mit = TEMPLATES["MIT"]
    changed = mit.replace("obtaining a copy", "obtaining one copy").replace("free of charge, ", "")
    texts = [*ODD, f"intro words\n{mit}\nmore", "pad " * 5000 + changed + " pad" * 50, "licensed under nothing", " ".join(mit.split()[:12]), mit + "\n" + TEMPLATES["Apache-2.0"]]
    got = scan_licenses(frame(spark, texts)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.license)
        span = texts[r.doc_id][r.start_char : r.end_char]
        assert r.coverage >= 0.8 and span[:10] == TEMPLATES[r.license][:10]
    n = len(ODD)
    assert by[n] == {"MIT"} and by[n + 1] == {"MIT"} and n + 2 not in by and n + 3 not in by and by[n + 4] == {"MIT", "Apache-2.0"}
    lines = {k: v for k, v in TEMPLATES.items() if k.endswith(("-notice", "-short"))}
    want = {(r.doc_id, k) for r in docs.collect() for k, v in lines.items() if v in (r.text or "")}
    assert want and want == {(r.doc_id, r.license) for r in scan_licenses(docs).collect()}
    assert scan_licenses(empty(spark)).count() == 0


def licenses_in(text):
    from tidewater.llm.licenses import TEMPLATES, Index, Numbers, matches

    index = Index(TEMPLATES)
    return [m[0] for m in matches(text, index, Numbers(index), 0.8)]


@pytest.mark.parametrize("text,want", [
    ("Licensed under CC BY-NC-ND 4.0.", ["CC-BY-NC-ND-4.0-short"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0-short"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0-short"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0-notice"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-notice"]), ("This work is licensed under the GNU General Public License, version 3.0.", ["GPL-3.0-notice"]),
    ("This work is licensed under the GNU Library General Public License, version 2.", []), ("This work is licensed under the GNU General Public License, version 4.", []),
    ("Licensed under the Apache Software License, Version 1.1.", ["Apache-1.1-notice"]), ("Licensed under the Apache License, Version 3.0.", []),
    ("Released under the BSD License.", ["BSD-notice"]), ("Released under the BSD 3-Clause License.", ["BSD-3-Clause-notice"]), ("Released under the Foo License.", []),
])
def test_siblings_are_told_apart(text, want):
    assert licenses_in(f"Some words before it. {text} Some words after it.") == want


def test_licenses_among_their_siblings():
    """Precision and recall over mutated templates: exact names, and no sibling's."""
    from tidewater.llm.licenses import NAMES, QUALIFIERS, TEMPLATES, words_of

    rng, right, found, all_of = random.Random(6), 0, 0, 0
    for name, text in sorted(TEMPLATES.items()):
        words = [w for w, _, _ in words_of(text)]
        for changes in (0, len(words) // 20, len(words) // 12):
            w = list(words)
            for k in rng.sample([k for k, x in enumerate(w) if x not in QUALIFIERS and x not in NAMES and not x[-1].isdigit()], changes):
                w[k] = f"other{k}"
            got = licenses_in("one two three " + " ".join(w) + " four five six")
            right, found, all_of = right + (name in got), found + len(got), all_of + 1
    assert right == all_of == found


def brute_align(text, template):
    """The best score of the whole template against any part of the text, without a band."""
    best = [0] * (len(text) + 1)
    for word in template:
        row = [best[0] - 1]
        for i, t in enumerate(text):
            row.append(max(best[i] + (1 if t == word else -1), best[i + 1] - 1, row[i] - 1))
        best = row
    return max(best)


def test_banded_alignment_equals_the_whole_table():
    from tidewater.llm.licenses import align

    rng = random.Random(9)
    for _ in range(300):
        template = [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(3, 60))]
        text = list(template)
        for _ in range(rng.randrange(5)):  # fewer than the band
            k, what = rng.randrange(len(text)), rng.randrange(3)
            text[k : k + (what != 1)] = ["new"] * (what != 2)
        before = [f"x{k}" for k in range(rng.randrange(8))]
        text = before + text + [f"y{k}" for k in range(rng.randrange(8))]
        score, pairs = align(text, template, len(before))
        assert score == brute_align(text, template)
        assert all(text[i] == template[j] for i, j in pairs) and pairs == sorted(set(pairs))
        assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


# -- pipeline ------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    got = p.run(spark, sf)
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, p.materialize(stage(spark, docs, sf), f"test-{name}")
        kept.append(docs.count())
        assert docs.columns == before.columns and docs.join(before, docs.columns, "left_anti").count() == 0
    assert 0 < kept[3] <= kept[2] <= kept[1] <= kept[0] < 1000
    assert docs.select("text").distinct().count() == docs.count()
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    check_packing(docs, got.collect())


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as p

    for df in (frame(spark, ODD), empty(spark)):
        for _, stage in p.STAGES:
            got = stage(spark, df, "/root/testdata/sf0.01")
            if "piece" not in got.columns:  # rows come back as they were
                assert got.count() <= df.count() and got.columns == df.columns and not set(got.collect()) - set(df.collect())
