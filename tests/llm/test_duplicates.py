import hashlib
import random

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.conftest import prose, texts_of
from transitloom.llm import exact_dedup, ngram_join, substring_dedup
from transitloom.llm.bloom import Bloom
from transitloom.llm.groups import components


def test_bloom_never_misses(spark):
    rows = [(i,) for i in range(3000)] + [(i,) for i in range(0, 3000, 10)]
    df = spark.createDataFrame(rows, "h long").repartition(5)
    again = Bloom(df, 3300, twice=True)
    hit = {r.h for r in df.where(again.test(df["h"])).collect()}
    assert set(range(0, 3000, 10)) <= hit and len(hit) < 1000
    tiny = Bloom(df, 3300, max_cells=1 << 18, twice=True)  # too small a filter only lets more through
    assert set(range(0, 3000, 10)) <= {r.h for r in df.where(tiny.test(df["h"])).collect()}


def test_exact_dedup(unique_docs):
    want = brute.exact(texts_of(unique_docs))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup_report(unique_docs).collect()}
    assert got == want
    kept = exact_dedup.drop_exact_duplicates(unique_docs)
    assert kept.columns == unique_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])


def test_exact_dedup_repeated_rows_and_empty(docs, unique_docs, empty):
    rows = exact_dedup.dedup_report(docs).collect()
    assert len(rows) == docs.count() and sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(docs).collect()) == sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(unique_docs).collect())
    assert exact_dedup.dedup_report(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = exact_dedup.dedup_report(df).collect()
    assert len(got) == 3 and sum(r.kept for r in got) == 2
    assert ngram_join.components_report(df).count() == 3
    assert substring_dedup.removal_report(df).count() == 3


def test_components_against_brute_force(unique_docs):
    want = brute.components(texts_of(unique_docs), 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components_report(unique_docs).collect()}
    assert got == want


def test_chains_and_prefix_ties(spark):
    """Chains of near copies link through their neighbours only; many share a prefix."""
    rng = random.Random(5)
    own = prose(rng, 120).split()
    texts = {}
    for i in range(40):
        own = list(own)
        own[rng.randrange(len(own))] = f"new{i}"
        if i % 3 == 0:
            own.append(f"end{i}")
        texts[i] = " ".join(own)
    for i in range(40, 60):
        texts[i] = texts[7] + f" tail{i}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for width, num, den in ((4, 85, 100), (5, 4, 5)):
        got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(df, width, num, den).collect()}
        assert got == brute.components(texts, width, num, den)


def test_keep_one(docs, unique_docs, empty):
    want = brute.components(texts_of(unique_docs), 5, 4, 5)
    kept = ngram_join.keep_one_per_component(unique_docs)
    assert kept.columns == unique_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    assert ngram_join.components_report(docs).count() == docs.count()
    assert ngram_join.components_report(empty).count() == 0


@pytest.fixture(scope="module")
def two_texts(spark):
    """Ids that stand on several texts: (id, text)."""
    rng = random.Random(3)
    a, b, c = (prose(rng, 150) for _ in range(3))
    return [(1, a), (5, a), (5, b), (9, b), (9, b + " more"), (7, c), (7, a + " tail")]


def test_ids_on_several_texts(spark, two_texts):
    for kind, name in ((int, "long"), (str, "string")):
        df = spark.createDataFrame([(kind(i), t) for i, t in two_texts], f"doc_id {name}, text string").repartition(3)
        a, b, c = two_texts[0][1], two_texts[2][1], two_texts[5][1]
        assert sorted((int(r.doc_id), r.text) for r in exact_dedup.drop_exact_duplicates(df).collect()) == sorted([(5, a), (9, b), (9, b + " more"), (7, c), (7, a + " tail")])
        got = sorted((int(r.id), int(r.component_id)) for r in ngram_join.jaccard_classes(df, 5, 4, 5).collect())
        assert got == [(1, 1), (5, 1), (5, 5), (7, 1), (7, 7), (9, 5), (9, 5)]
        kept = sorted((int(r.doc_id), r.text) for r in ngram_join.keep_one_per_component(df).collect())
        assert kept == sorted([(1, a), (5, b), (7, c)])
        for hot in (substring_dedup.HOT, 10):
            found = substring_dedup.Repeats(df.withColumnRenamed("doc_id", "id"), hot=hot)
            lost = {(int(r.id), r.words): r.removed for r in found.stripped().collect()}
            assert lost == {(5, 150): 150, (7, 151): 150, (9, 150): 150, (9, 151): 150}
        left = sorted((int(r.doc_id), r.text) for r in substring_dedup.remove_repeated_passages(df).collect())
        assert left == sorted([(1, a), (5, ""), (5, b), (9, ""), (9, "more"), (7, c), (7, "tail")])


def test_components_of_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(50)], "node long")
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(45, 44)], "a long, b long")
    got = {r.node: r.label for r in components(nodes, links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[45] == 44 and got[49] == 49
    assert components(nodes, links.limit(0)).where("label <> node").count() == 0


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 10])
def test_substring_dedup(unique_docs, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup.Repeats.__init__, "__defaults__", (50, 12, hot))
    want = brute.stripped(texts_of(unique_docs))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removal_report(unique_docs).collect()}
    assert got == {i: (len(own), len(gone), hashlib.sha256(kept).hexdigest()) for i, (own, gone, kept) in want.items()}


def test_removed_passages_leave_other_columns(docs, unique_docs, empty):
    want = brute.stripped(texts_of(unique_docs))
    before = {r.doc_id: r for r in unique_docs.collect()}
    got = substring_dedup.remove_repeated_passages(unique_docs)
    assert got.columns == unique_docs.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert rows.keys() == before.keys()
    for i, (_, gone, kept) in want.items():
        assert rows[i].text == (kept.decode() if gone else before[i].text)
        assert rows[i].n_chars == (len(kept.decode()) if gone else before[i].n_chars) and rows[i].kept == "y"
    assert substring_dedup.removal_report(docs).count() == docs.count()
    assert substring_dedup.removal_report(empty).count() == 0 and substring_dedup.remove_repeated_passages(empty).count() == 0


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 200)
    for k in (1, 2, 7, 39, 200):
        assert substring_dedup._sliding_min(x, k).tolist() == [x[i : i + k].min() for i in range(len(x) - k + 1)]
