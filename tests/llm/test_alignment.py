"""The alignment of two tokenizers against plain loops over bytes."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import alignment
from helixframe.llm.queries import public_vocabularies

TEXTS = [
    "A plain sentence of some words.", "A plain sentence of some other words, tokenization.", "", None, "  two  spaces  and\ttabs\nlines \n end ", "x", " ", "\n", "naïve Übergröße 漢字 🙂🙃 é",
    "literal ▁ mark", "<|endoftext|> and <s> </s> <unk>", "a" * 3000, "aaab" * 700 + " end", "nbsp here   there", "don't we'll 12345 3.14 !!!...", "word " * 500, "zero​width ​ space ﻿", "\x1c \x85 odd", "same same", "same same",
    "line one\nline two\n\nline four", "trailing ", " leading", "a\x00b",
]


def whole(coding, text):
    """(A ids, B ids) of the uncut text; none where the bytes differ."""
    if not text:
        return [], []
    a, b = coding.a.encode(" " + text, add_special_tokens=False).ids, coding.b.encode(text)
    raw = (" " + text).encode()
    good = b"".join(coding.bytes_a[i] for i in a) == raw and b"".join(coding.bytes_b[i] for i in b) == raw
    return (a, b) if good else ([], [])


def plain(coding, texts):
    spans = lambda ids, table: [(e - len(table[i]), e) for i, e in zip(ids, np.cumsum([len(table[i]) for i in ids]).tolist())]
    rows, counts = [], Counter()
    for text in texts:
        a, b = whole(coding, text)
        sa, sb = spans(a, coding.bytes_a), spans(b, coding.bytes_b)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(sa) for j, (u, v) in enumerate(sb) if s < v and u < e]
        counts.update(links)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [([x for x, (s, e) in zip(a, sa) if p < e <= q], [y for y, (s, e) in zip(b, sb) if p < e <= q]) for p, q in zip([0, *cuts[:-1]], cuts)]
        rows.append((a, b, groups, links))
    peak = {}
    for (_, y), n in counts.items():
        peak[y] = max(peak.get(y, 0), n)
    shown = lambda groups: ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    return [(len(a), len(b), len(g), len(k), sum(counts[p] == peak[p[1]] for p in k), sum(counts[p] for p in k), shown(g), sum(len(x) * len(y) for x, y in g)) for a, b, g, k in rows]


@pytest.fixture(scope="module")
def coding():
    return alignment.coder(*public_vocabularies())


def test_parts_encode_as_the_whole(coding):
    parts = alignment.Parts(coding)
    texts = [t for t in TEXTS if t]
    assert coding.cuts
    for text, numbers in zip(texts, parts.of(texts)):
        a, b = whole(coding, text)
        if not all(parts.valid[n] for n in numbers):
            assert not a
            continue
        groups = [g.split("|") for n in numbers for g in parts.groups[n].split(";")]
        assert ",".join(g[0] for g in groups) == ",".join(map(str, a)) and ",".join(g[1] for g in groups) == ",".join(map(str, b))


@pytest.mark.parametrize("batch_chars", [2000, 32_000_000])
def test_equals_plain_loops(spark, coding, monkeypatch, batch_chars):
    monkeypatch.setattr(alignment, "ENTRIES_PER_RANGE", 100)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumn("batch", F.lit("clash")).repartition(3)
    found = alignment.align(df, *public_vocabularies(), batch_chars=batch_chars)
    got = {r.id: r for r in alignment.weigh(found, coding.size_b).collect()}
    assert len(got) == len(TEXTS)
    for i, want in enumerate(plain(coding, TEXTS)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups, r.n_group_links) == want, TEXTS[i]


def test_empty_table_null_ids_and_texts_without_tokens(spark, coding):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.weigh(alignment.align(empty, *public_vocabularies()), coding.size_b).collect() == []
    df = spark.createDataFrame([(None, None), (None, ""), (3, None)], "doc_id long, text string")
    rows = alignment.weigh(alignment.align(df, *public_vocabularies()), coding.size_b).collect()
    assert [(r.n_a, r.n_links, r.count_sum, r.groups) for r in rows] == [(0, 0, 0, "")] * 3 and sorted(str(r.id) for r in rows) == ["3", "None", "None"]


def test_products_of_sparse_matrices():
    rng = np.random.default_rng(5)
    dense = [(rng.random(s) < 0.3).astype(int) for s in ((7, 11), (11, 5))]
    a, b = (alignment.incidence(np.nonzero(d)[1], d.sum(axis=1), d.shape[1]) for d in dense)
    out = alignment.product(a, b)
    back = np.zeros((7, 5), dtype=int)
    back[out.rows(), out.indices] = out.values
    assert (back == dense[0] @ dense[1]).all()
    turned = a.transposed()
    again = np.zeros((11, 7), dtype=int)
    again[turned.rows(), turned.indices] = 1
    assert (again == dense[0].T).all()


def test_shared_group_pairs(coding):
    met = alignment.aligned(np.array([1, 2, 3]), np.array([2, 2, 1]), np.array([7, 8, 9]), np.array([1, 3, 1]))
    assert met.overlaps.rows().tolist() == [0, 0, 1, 2] and met.overlaps.indices.tolist() == [0, 1, 1, 2] and met.overlaps.values.tolist() == [1, 1, 2, 1]
    shared = met.shared()
    assert list(zip(shared.rows().tolist(), shared.indices.tolist())) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]
    assert met.group_links.tolist() == [2, 2, 1]
