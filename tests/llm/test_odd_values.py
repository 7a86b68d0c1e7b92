"""Each operator's values on odd rows: nulls in every column, repeated ids with and without other texts, empty and very long texts, clashing names."""

import hashlib
import re

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from .test_pipeline import _fingerprint, _low, _redacted, _votes, odd, posteriors  # noqa: F401 - a fixture

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def _rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def _same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def test_counts_and_codes(odd):  # noqa: F811
    from folioscope.llm import bpe, license_scan, token_count

    rows = _rows(odd)
    sp, tk = sentencepiece.SentencePieceProcessor(model_file=_path("piece_bpe_32k.model")), Tokenizer.from_file(_path("byte_bpe_50k.json"))
    got = token_count.token_counts(odd, _path("piece_bpe_32k.model")).collect()
    _same([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got], [(i, len((t or "").encode()), (n := len(sp.encode(t or ""))), n > 4096) for i, t in rows])
    ids = lambda t: np.array(tk.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()
    _same([(r.doc_id, hashlib.sha1(r.ids).hexdigest(), r.decoded) for r in bpe.bpe_round_trip(odd, _path("byte_bpe_50k.json")).collect()], [(i, hashlib.sha1(ids(t)).hexdigest(), t or "") for i, t in rows])
    words = lambda t: len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _low(t)))
    _same([(r.doc_id, r.n_words, len(r.places), len(r.spans)) for r in license_scan.license_scan(odd).collect()], [(i, words(t), 0, 0) for i, t in rows])


def test_exact_and_near(odd):  # noqa: F811
    from folioscope.llm import exact_dedup, simhash

    rows, groups = _rows(odd), {}
    for i, t in rows:
        groups.setdefault(_low(t), []).append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = [(i, best[_low(t)], len(groups[_low(t)]), hashlib.sha256(_low(t).encode()).hexdigest()) for i, t in rows]
    for carry in (False, True):
        out = exact_dedup.exact_dedup(odd, keep="largest", carry=carry, out="fs_x").collect()
        got = [(r, r) if not carry else (r, r.fs_x) for r in out]
        _same([(r.doc_id, x.keep_id, x.group_size, x.text_sha256) for r, x in got], want)
        assert sum(x.kept for _, x in got) == len(groups)
    prints = [_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    least = lambda k: min((rows[i][0] for i in range(len(rows)) if group[i] == k and rows[i][0] is not None), default=None)
    _same([(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_dedup(odd).collect()], [(rows[i][0], f"{prints[i]:016x}", least(group[i])) for i in range(len(rows))])


def test_substrings(odd):  # noqa: F811
    from folioscope.llm.substring_dedup import substring_dedup

    rows = _rows(odd)
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 19):
            g = tuple(w[k : k + 20])
            first[g] = min(first.get(g, (float("inf"), float("inf"))), (key(i), k))
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = bytearray(len(w))
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] != (key(i), k):
                gone[k : k + 20] = b"\1" * 20
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    _same([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup(odd).collect()], want)


def test_quality_and_secrets(spark, odd):  # noqa: F811
    from folioscope.llm import quality_rules, secret_scan

    rows = _rows(odd)
    votes = [_votes(t) for _, t in rows]
    want = [(i, failed, not failed and p >= 0.5, round(p, 6)) for (i, _), (_, failed), p in zip(rows, votes, posteriors([v for v, _ in votes]), strict=True)]
    out = quality_rules.quality_rules(odd, out="quality_rules")
    assert out.columns.count("quality_rules") == 1 and set(odd.columns) == set(out.columns)
    _same([(r.doc_id, r.quality_rules.base_failed, r.quality_rules.kept, round(r.quality_rules.posterior, 6)) for r in out.collect()], want)
    forest = secret_scan.fit_forest(spark)
    redacted = secret_scan.redact(odd)
    assert redacted.columns == odd.columns
    _same([(r.doc_id, r.text, r["_fs_hit"]) for r in redacted.collect()], [(i, _redacted(t, None, forest) if t else t, "x") for i, t in rows])


def test_packing_and_archives(odd):  # noqa: F811
    from folioscope.llm import packing, warc

    rows = _rows(odd)
    tk, want = Tokenizer.from_file(_path("word_bpe_49k.json")), []
    for i, t in rows:
        n = len(tk.encode(t or "", add_special_tokens=False).ids) + 1
        want += [(i, k, 4096 * k, min(4096, n - 4096 * k)) for k in range(-(-n // 4096))]
    _same([(r.doc_id, r.piece, r.start, r.length) for r in packing.pack(packing.token_pieces(odd, _path("word_bpe_49k.json"))).collect()], want)
    first = {}
    for i, t in rows:
        first[t or ""] = min((x for x in (first.get(t or ""), i) if x is not None), default=None)
    pages = odd.drop("page_id").selectExpr("doc_id AS page_id", "source AS url", "text AS html", "kept", "length")
    want = [(i, "response" if first[t or ""] in (i, None) else "revisit", None if first[t or ""] in (i, None) else first[t or ""], len((t or "").encode()), warc.payload_digest((t or "").encode())) for i, t in rows]
    _same([(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.archive_round_trip(pages).collect()], want)
