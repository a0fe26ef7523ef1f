"""Each stage of the pipeline on what the one before it kept, against brute force where there is one."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out, columns = [docs.collect()], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        out.append(docs.collect())
    return out


def _words(pattern, text):
    return re.findall(pattern, (text or "").translate(LOWER))


def test_classifier_drops_rows_only(spark, steps):
    before, after = steps[:2]
    assert not Counter(after) - Counter(before)
    kept = {r.doc_id for r in after}
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1 and r.toxic == 0]
    bad = [r.doc_id in kept for r in labels if r.quality == 0 or r.toxic == 1]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_line_dedup_only_takes_text_away(steps):
    before = {r.doc_id: r for r in steps[1]}
    for r in steps[2]:
        old = before[r.doc_id]
        rest = iter((old.text or "").split())
        assert all(w in rest for w in (r.text or "").split())
        assert r.n_chars == len(r.text or "") and (r.lang, r.source) == (old.lang, old.source)


def test_near_dedup_keeps_one_of_each_group(steps):
    before, after = steps[2], steps[3]
    sets = {}
    for r in before:
        w = _words(r"[^\x20\x09-\x0D]+", r.text)
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            label[high] = low
    assert Counter(after) == Counter(r for r in before if find(r.doc_id) == r.doc_id)


def test_decontamination_drops_the_contaminated(spark, steps):
    before, after = steps[3], steps[4]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for item in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = tuple(_words(pattern, item.text))
        size = min(13, len(w))
        windows[size] |= {w[k : k + size] for k in range(len(w) - size + 1)} if w else set()

    def contaminated(text):
        w = _words(pattern, text)
        if any(tuple(w[k : k + 13]) in windows[13] for k in range(len(w) - 12)):
            return True
        hit = {k + j for size, grams in windows.items() for k in range(len(w) - size + 1) if size and tuple(w[k : k + size]) in grams for j in range(size)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert Counter(after) == Counter(r for r in before if not contaminated(r.text))


def test_packing_places_every_id_once(steps):
    docs, pieces = steps[4], steps[5]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, p.length, p.doc_tokens))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert by_doc.keys() == {r.doc_id for r in docs}
    for parts in by_doc.values():
        at = 0
        for start, length, _ in sorted(parts):
            assert start == at and length > 0
            at += length
        assert {at} == {total for _, _, total in parts}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0, name
