"""Each operator against brute force or the library on a small table with nulls, copies and long texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _documents():
    r = random.Random(5)
    vocabulary = ["river", "the", "and", "Über", "stone,", "mit", "license", "a", "of", "public", "general", "###", "été", "line."]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    texts = [None, "", " \n ", "MIT License", "mit license\nmit license", "x" * 3000, "<|endoftext|> hi", passage, passage.upper()]
    for i in range(60):
        t = " ".join(r.choice(vocabulary) + str(r.randint(0, 40)) for _ in range(r.randint(1, 120)))
        texts.append(t + (" " + passage if i % 4 == 0 else ""))
    texts += [texts[12], texts[13] + " z", texts[12], texts[14].replace(" ", "\n")]
    texts.append('my token = "0123456789abcdef0123456789abcdef01234568" is here')
    texts.append(" ".join(f"w{r.randint(0, 9999)}" for _ in range(9000)))
    return [(i, t) for i, t in enumerate(texts)]


DOCS = _documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), 7) for i, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long, n_words int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def _path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def _low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_license_scan(docs, empty):
    from folioscope.llm.license_scan import license_scan

    got = {r.doc_id: r for r in license_scan(docs).collect()}
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for i, t in DOCS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _low(t))
        places = sorted((k, v) for k in range(len(w)) for p, v in phrases.items() if tuple(w[k : k + len(p)]) == p)
        assert (got[i].n_words, sorted((p.word, p.label) for p in got[i].places)) == (len(w), places)
    assert license_scan(empty).count() == 0


def test_license_templates(spark):
    from folioscope.llm.license_scan import license_scan
    from folioscope.llm.license_texts import TEMPLATES

    rows = list(enumerate(f"Some words before. {t} And after." for t in TEMPLATES.values()))
    got = {r.doc_id: {s.label: s.coverage for s in r.spans} for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(TEMPLATES):
        assert got[i][label] == 1.0


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(docs, empty, keep):
    from folioscope.llm.exact_dedup import exact_dedup

    groups = {}
    for i, t in DOCS:
        groups.setdefault(_low(t), []).append(i)
    want = {i: ((max if keep == "largest" else min)(groups[_low(t)]), len(groups[_low(t)]), hashlib.sha256(_low(t).encode()).hexdigest()) for i, t in DOCS}
    got = exact_dedup(docs, keep=keep).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert sorted(r.keep_id for r in got if r.kept) == sorted({w[0] for w in want.values()})
    assert exact_dedup(empty, keep=keep).count() == 0


def test_exact_dedup_hot_text(spark):
    from folioscope.llm.exact_dedup import exact_dedup

    rows = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Hot' ELSE concat('t', id % 700) END AS text")
    got = exact_dedup(rows, keep="largest").groupBy("keep_id", "group_size").count().collect()
    hot = [r for r in got if r.group_size == 2000]
    assert [(r.keep_id, r["count"]) for r in hot] == [(5997, 2000)] and all(r["count"] == r.group_size for r in got)


def test_warc(spark, docs, empty):
    from folioscope.llm import warc

    pages = docs.selectExpr("doc_id AS page_id", "concat('http://x/', doc_id) AS url", "text AS html")
    first = {}
    for i, t in DOCS:
        first.setdefault(t or "", i)
    got = {r.page_id: r for r in warc.archive_round_trip(pages, with_payload=True).collect()}
    for i, t in DOCS:
        f = first[t or ""]
        payload = (t or "").encode()
        assert (got[i].record_type, got[i].refers_to, got[i].payload_bytes, got[i].payload_digest) == ("response" if f == i else "revisit", None if f == i else f, len(payload), warc.payload_digest(payload))
        assert got[i].payload == (payload if f == i else None)
    assert len(got) == len(DOCS) and warc.archive_round_trip(empty.selectExpr("doc_id AS page_id", "text AS url", "text AS html")).count() == 0
    record = warc.build_record(1, "http://x", b"abc", None)
    for damaged in (record[:-1], record.replace(b"Content-Length: 3", b"Content-Length: 4"), record.replace(b"abc", b"abd"), record.replace(b"WARC-Date", b"Date")):
        with pytest.raises(ValueError):
            warc.parse_record(damaged)


def test_secret_scan(spark, docs, empty):
    from pyspark.sql import functions as F

    from folioscope.llm import secret_scan as S

    found = S.secret_scan(docs).collect()
    text = dict(DOCS)
    assert all(text[r.doc_id][r.start : r.start + r.length] == r.candidate for r in found)
    assert "0123456789abcdef0123456789abcdef01234568" in [r.candidate for r in found]
    kept = {r.doc_id: r.text for r in S.redact(docs).select("doc_id", "text").collect()}
    secret = {r.doc_id for r in found if r.is_secret}
    assert all((kept[i] == t) == (i not in secret) for i, t in DOCS) and S.secret_scan(empty).count() == 0
    held = spark.createDataFrame(S.labelled_findings(1000, 99), "candidate string, left string, right string, path string, label int")
    seen = F.array(*S.features(F.col("candidate"), F.col("left"), F.col("right"), F.col("path")).values())
    right = held.select(((S.score(S.fit_forest(spark), seen) >= S.THRESHOLD).cast("int") == F.col("label")).cast("int").alias("ok"))
    assert right.agg(F.avg("ok")).head()[0] >= 0.95


def test_substring_dedup(docs, empty):
    from folioscope.llm.substring_dedup import substring_dedup

    seen, want = set(), {}
    for i, t in DOCS:
        w = WORD.findall(t or "")
        gone = bytearray(len(w))
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone[j : j + 20] = b"\1" * 20
            seen.add(k)
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(docs).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0 and substring_dedup(empty).count() == 0


def test_token_count(docs, empty):
    import sentencepiece

    from folioscope.llm.token_count import token_counts

    sp = sentencepiece.SentencePieceProcessor(model_file=_path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, _path("piece_bpe_32k.model")).collect()}
    want = {i: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in DOCS}
    assert got == want and token_counts(empty, _path("piece_bpe_32k.model")).count() == 0


def test_bpe(docs):
    from tokenizers import Tokenizer

    from folioscope.llm.bpe import bpe_round_trip, codec

    tk, c = Tokenizer.from_file(_path("byte_bpe_50k.json")), codec(_path("byte_bpe_50k.json"))
    for r in bpe_round_trip(docs, _path("byte_bpe_50k.json")).collect():
        ids = tk.encode(dict(DOCS)[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == tk.decode(ids, skip_special_tokens=False)
    r = random.Random(2)
    for _ in range(200):
        t = "".join(r.choice("abcdeorst") for _ in range(r.randint(300, 3000)))
        assert np.frombuffer(c.encode(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids


def test_quality_rules(docs, empty):
    from folioscope.llm.quality_rules import quality_rules

    got = {r.doc_id: r for r in quality_rules(docs, out="q").select("doc_id", "q").collect()}
    for i, t in DOCS:
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n, twice = Counter(grams), set()
        for k, g in enumerate(grams):
            if n[g] > 1:
                twice |= set(range(k, k + 5))
        q = got[i].q
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(twice))
        assert q.base_failed == (len(w) < 10 or 100 * len(twice) > 20 * len(w)) and not (q.base_failed and q.kept)
    assert quality_rules(empty, out="q").count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    from folioscope.llm.packing import pack, token_pieces

    file = _path("word_bpe_49k.json")
    tk, want = Tokenizer.from_file(file), set()
    for i, t in DOCS:
        n = len(tk.encode(t or "", add_special_tokens=False).ids) + 1
        want |= {(i, k, 4096 * k, min(4096, n - 4096 * k)) for k in range(-(-n // 4096))}
    rows = pack(token_pieces(docs, file)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 4096 and pack(token_pieces(empty, file)).count() == 0


def test_local_search_empties_bins():
    from folioscope.llm.packing import best_fit, improve

    r = random.Random(3)
    for _ in range(30):
        lengths = [r.randint(1, 60) for _ in range(r.randint(2, 80))]
        start = best_fit(lengths, 100)
        bins = improve(start, lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and len(bins) <= len(start) and all(sum(lengths[i] for i in b) <= 100 for b in bins)


def test_simhash(docs, empty):
    from folioscope.llm.simhash import simhash_dedup

    prints = {}
    for i, t in DOCS:
        w = WORD.findall(_low(t))
        s = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    least = {i: i for i in prints}
    for _ in range(10):
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    least[i] = least[j] = min(least[i], least[j])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", least[i]) for i in prints} and simhash_dedup(empty).count() == 0


def test_trie_join_dense_and_crossed():
    from folioscope.llm.simhash import trie_join

    r = np.random.default_rng(1)
    keys = np.unique(np.concatenate([r.integers(0, 1 << 63, 300, dtype=np.uint64), *(np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64) ^ np.uint64(77),)]))
    n = len(keys)
    labels = trie_join(keys, [np.array([0]), np.array([n]), np.array([0]), np.array([n])])
    parent = list(range(n))
    for _ in range(6):
        for i in range(n):
            for j in np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= 4):
                parent[i] = parent[j] = min(parent[i], parent[j])
    assert all((labels[i] == labels[j]) == (parent[i] == parent[j]) for i in range(0, n, 7) for j in range(n))
