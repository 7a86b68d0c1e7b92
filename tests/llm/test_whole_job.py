"""Cases in which operators once did less than the whole job."""

import random
from collections import Counter

import pytest


@pytest.mark.parametrize("partitions", ["3", "200"])
def test_packing_is_one_pool(spark, partitions):
    """As many sequences as best fit over the whole table at most, whatever the number of partitions."""
    from folioscope.llm.packing import best_fit, pack

    r = random.Random(7)
    rows = [(None if i % 50 == 0 else i // 2, i % 2, 0, r.choice((1300, 1301, r.randint(600, 3500))), i % 7) for i in range(60_000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = pack(pieces, 4096).collect()
        alone = pack(pieces, 4096).select("sequence_id").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter(tuple(x[:5]) for x in got) == Counter(rows)
    ends = {}
    for x in sorted(got, key=lambda x: x.offset):
        assert x.offset == ends.get(x.sequence_id, 0)
        ends[x.sequence_id] = x.offset + x.length
    assert alone == len(ends) and max(ends.values()) <= 4096 and len(ends) <= len(best_fit([x[3] for x in rows], 4096))


def test_secrets_without_digits_and_short_ones(spark):
    """Keys without a digit and short passwords are candidates, score as secrets and are redacted; ordinary words are not."""
    from folioscope.llm import secret_scan as S

    secret = {
        1: ("config has token = \"", "ghp_QwErTyUiOpAsDfGhJkLzXcVbNmQwErTyUiOp", "\" in it"), 2: ("then api_key: ", "QwErTyUiOpAsDfGhJkLz", " was set"),
        3: ("where password=\"", "hunter2secret", "\" is used"), 4: ("where password: ", "Tz7kQ4pm", " is used"), 5: ("where \"client_secret\":   \"", "mVqRtLpXsWzKbNdF", "\", is"), 6: ("the password is ", "dragon1987", " still"),
    }
    plain = {7: "the password is required here", 8: "see token: string and color: purple", 9: "Donaudampfschifffahrtsgesellschaft was there", 10: "-" * 40, 11: "a page at docs/reference/configuration/overview was found", 12: "Title: Introduction"}
    docs = spark.createDataFrame([(i, "".join(t), "src/app") for i, t in secret.items()] + [(i, t, "src/app") for i, t in plain.items()], "doc_id long, text string, source string")
    found = {(x.doc_id, x.candidate): (x.start, x.is_secret) for x in S.secret_scan(docs).collect()}
    assert {(i, t[1]): (len(t[0]), True) for i, t in secret.items()}.items() <= found.items()
    assert not any(hit for (i, _), (_, hit) in found.items() if i in plain)
    assert {x.doc_id: x.text for x in S.redact(docs).collect()} == {i: t[0] + S.PLACEHOLDER + t[2] for i, t in secret.items()} | plain


def test_training_rows_force_no_digit():
    from folioscope.llm.secret_scan import labelled_findings

    secrets = [c for c, *_, label in labelled_findings() if label]
    assert any(not any(x.isdigit() for x in c) for c in secrets) and any(len(c) < 16 for c in secrets)


def test_local_search_tries_pairs_of_all_items():
    """The only exchange is for the 41st and 42nd item of a bin."""
    from folioscope.llm.packing import improve

    lengths, bins = [10] * 40 + [33, 44], [list(range(42))]
    for _ in range(60):
        bins.append([len(lengths), len(lengths) + 1])
        lengths += [70, 921]
    got = improve(bins, lengths, 1000)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    assert [921, 44, 33] in [sorted((lengths[i] for i in b), reverse=True) for b in got]


def test_local_search_ends_only_when_stuck():
    """5000 bins without an exchange are emptier than the one that can be emptied."""
    from folioscope.llm.packing import improve

    lengths = [51] * 5000 + [65, 5, 70, 12]
    bins = [[i] for i in range(5000)] + [[5000, 5001], [5002, 5003]]
    got = [sorted(lengths[i] for i in b) for b in improve(bins, lengths, 100)]
    assert [5, 12, 70] in got and len(got) == len(bins)


def test_secrets_in_very_long_runs(spark):
    """Slugs of a million parts, runs of one character, long candidates, keys over 8192 characters and openings without an end."""
    from folioscope.llm import secret_scan as S

    r = random.Random(3)
    base64 = "".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(1_000_000))
    lines = "\n".join(base64[i : i + 64] for i in range(0, 13_000, 64))
    key = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,AB12\n\n{lines}\n-----END RSA PRIVATE KEY-----"
    plain = {0: "see " + "-".join(["ab"] * 1_000_000) + " end", 1: "a" * 2_000_000, 2: "-----BEGIN PRIVATE KEY-----\nabcdefgh ijk. " * 20_000, 3: "a-" * 1_000_000, 4: "=> " * 300_000 + "a"}
    secret = {5: ("it has ", key, " in it"), 6: ('token = "', base64, '" here')}
    docs = spark.createDataFrame([(i, t) for i, t in plain.items()] + [(i, "".join(t)) for i, t in secret.items()], "doc_id long, text string").repartition(7)
    assert {(x.doc_id, x.start, x.length) for x in S.secret_scan(docs).collect() if x.is_secret} == {(i, len(t[0]), len(t[1])) for i, t in secret.items()}
    assert {x.doc_id: x.text for x in S.redact(docs).collect()} == plain | {i: t[0] + S.PLACEHOLDER + t[2] for i, t in secret.items()}
