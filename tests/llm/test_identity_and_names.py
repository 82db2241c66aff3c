"""Row identity (null and repeated ids) and names of regular strings, held against brute force."""

import random

import numpy as np
import pytest

from pitpanel.llm import decontamination, line_dedup, ngram_jaccard, shared, suffix_dedup
from tests.llm.test_line_dedup import brute as lines_by_brute_force
from tests.llm.test_suffix_dedup import brute as spans_by_brute_force
from tests.llm.test_suffix_dedup import got as spans

#: The Thue-Morse word of 1,024 letters and its complement: their sums modulo 2**64 agree, whatever the letters' values are.
BITS = [bin(i).count("1") % 2 for i in range(1024)]
MORSE, COMPLEMENT = "".join("ab"[b] for b in BITS), "".join("ba"[b] for b in BITS)
SPACED, SPACED_COMPLEMENT = "".join("b_"[b] for b in BITS), "".join("_b"[b] for b in BITS)


def test_exact_names_of_regular_strings():
    start, end = np.array([0]), np.array([1024])
    x, y = (np.frombuffer(t.encode(), np.uint8) for t in (MORSE, COMPLEMENT))
    assert shared.span_names(x, start, end) != shared.span_names(y, start, end)
    assert shared.exact_names(shared.exact_sums(x), start, end) != shared.exact_names(shared.exact_sums(y), start, end)
    twice = np.concatenate([x, y, x])
    a = shared.exact_names(shared.exact_sums(twice), np.array([0, 1024, 2048]), np.array([1024, 2048, 3072]))
    assert a[0] == a[2] != a[1] and a[0] == shared.exact_names(shared.exact_sums(x), start, end)[0]


def test_exact_sums_equal_whole_number_arithmetic():
    raw, prime, at, power = np.random.default_rng(3).integers(0, 256, 3000).astype(np.uint8), shared._PRIME, 0, 1
    sums = shared.exact_sums(raw)
    for i, b in enumerate(raw.tolist()):
        at, power = (at + int(shared._EXACT_VALUES[b]) * power) % prime, power * shared._EXACT_BASE % prime
        assert int(sums[i + 1]) % prime == at


def test_span_names_tell_spans_apart():
    r = np.random.default_rng(1)
    words = [bytes(r.integers(97, 99, k).astype(np.uint8)) for k in r.integers(0, 60, 5000)]
    end = np.cumsum([len(w) for w in words])
    names = shared.span_names(np.frombuffer(b"".join(words), np.uint8), end - [len(w) for w in words], end)
    by_word = dict(zip(words, names.tolist(), strict=True))
    assert len(set(by_word.values())) == len(by_word) and [by_word[w] for w in words] == names.tolist()


def test_line_dedup_keeps_a_complement(spark):
    docs = spark.createDataFrame([(1, MORSE), (2, COMPLEMENT), (3, MORSE)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in line_dedup.dedup(docs).collect()) == [(1, 0), (2, 0), (3, 1)]


def test_complements_are_other_words_and_other_documents(spark):
    docs = spark.createDataFrame([(1, SPACED), (2, SPACED_COMPLEMENT), (3, SPACED)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_jaccard.join(docs).collect()} == {1: 1, 2: 2, 3: 1}
    docs = spark.createDataFrame([(1, MORSE), (2, COMPLEMENT)], "doc_id long, text string")
    items = spark.createDataFrame([(7, MORSE)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontamination.contamination(docs, items).collect()} == {1: 1, 2: 0}


def test_suffix_dedup_keeps_a_complement(spark):
    rows = [(1, MORSE), (2, COMPLEMENT + "."), (3, "x" + MORSE)]
    assert spans(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 700)) == spans_by_brute_force(rows, 700)


SAME_ID = [
    (None, "line one of the text without an id\nshared line of all\nthe last line of the first"),
    (None, "another text without an id, line one\nits second line is all its own\nshared line of all"),
    (5, "a text under id five, its first line\nshared line of all"),
    (5, "another text under id five, its line\nonly here, second line of it\nshared line of all"),
    (5, "a text under id five, its first line\nshared line of all"),
    (6, None),
    (6, "the last line of the first"),
]


def test_lines_go_from_their_own_document_only(spark):
    out = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup(spark.createDataFrame(SAME_ID, "doc_id long, text string")).collect()]
    kept = [x for _, t, _ in out if t for x in t.split("\n")]
    for _, text in SAME_ID:  # a line that one text has stays; one that several have stays once, and in equal rows as often as they stand there
        for x in (text or "").split("\n"):
            holders = {(d, t) for d, t in SAME_ID if t and x in t.split("\n")}
            if x and len(holders) == 1:
                assert kept.count(x) == SAME_ID.count(next(iter(holders)))
    assert kept.count("shared line of all") == 1 and sorted(x[2] for x in out) == [0, 0, 1, 1, 1, 1, 1]
    first = min(SAME_ID[:2], key=lambda r: [t for _, t, n in out].count(r[1]) == 0)
    assert first[1] in [t for _, t, _ in out]


def test_hits_stay_with_their_own_text(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(None, item), (None, "a clean text of nine words without an id"), (3, "x " + item), (3, "clean under the same id"), (3, "x " + item), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in decontamination.contamination(docs, items).collect())
    assert out == [(0, 9, 0, False), (0, 12, 12, True), (3, 5, 0, False), (3, 13, 12, True), (3, 13, 12, True), (4, 0, 0, False)]
    assert sorted(r.text or "" for r in decontamination.drop_contaminated(docs, items).collect()) == ["", "a clean text of nine words without an id", "clean under the same id"]


def test_one_document_of_each_group_stays(spark):
    a, b = "one text that several rows repeat in full", "some other words that make another document here"
    rows = [(None, a), (None, a), (4, a), (4, a), (3, b), (3, a), (None, b), (7, None), (8, "")]
    kept = ngram_jaccard.keep_one(spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, first string, n int"))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(3, a), (3, b), (7, ""), (8, "")]
    rows = [(None, a), (None, a), (None, b)]
    kept = ngram_jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept) == [a, b]


def test_lines_equal_brute_force_where_ids_are_unique(spark):
    r = random.Random(11)
    pool = ["".join(r.choices("abc ", k=24)) for _ in range(30)] + [MORSE, COMPLEMENT]
    rows = [(i, "\n".join(r.choices(pool, k=r.randint(0, 5)))) for i in range(50)]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((x.doc_id, x.text, x.n_lines, x.n_removed) for x in out.collect()), key=str) == lines_by_brute_force(rows)


@pytest.mark.parametrize("partitions", [2, 51])
def test_passages_below_at_and_above_the_length(spark, partitions):
    """Passages of over 50 words go where they have the length in bytes, and only there; long texts and copies stand beside them."""
    r = random.Random(partitions)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(3000)]
    words = lambda n: " ".join(r.choices(vocabulary, k=n))
    rows = [(i, words(r.randint(5, 150))) for i in range(300)]
    for k, size in enumerate([398, 399, 400, 401, 402, 430, 600, 1500] * 3):
        passage = words(300)[:size]
        for _ in range(2 + k % 3):
            i = r.randrange(len(rows))
            at = r.randint(0, len(rows[i][1]))
            rows[i] = (rows[i][0], rows[i][1][:at] + "|" + passage + "|" + rows[i][1][at:])
    long = words(30_000)
    rows += [(1000, long), (1001, long[:90_000] + "#" + long[90_000:]), (1002, "ab" * 20_000), (1003, rows[3][1]), (1004, rows[3][1] + "!")]
    r.shuffle(rows)
    out = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()}
    assert out == {d: tuple(x) for d, *x in spans_by_brute_force(rows, 400)}
    assert sum(x[1] > 0 for x in out.values()) > 30


def test_no_private_folder_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            shared.shared_folder(spark)
