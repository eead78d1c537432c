import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.conftest import texts_of
from transitloom.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def test_encoder_equals_library(library):
    rng = random.Random(4)
    letters = list("ab'sStTreveLlm d  \n\t\r.!?12é中\U0001f600　٣́\x1c\x85") + ["<|endoftext|>", "'ll", "'re"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["", "a" * 3000, " " * 500, "it's'll 've", "é" * 200]
    found = list(bpe.Encoder(bpe.Bpe(open(PATH, encoding="utf-8").read())).column(pa.array(texts)))
    assert [f.tolist() for f in found] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_transducer_finds_exactly_its_words(tmp_path):
    words = sorted({w.encode() for w in "tap taps top tops stop stops a ab abc".split()})
    path = str(tmp_path / "lexicon.bin")
    bpe.Transducer.build(words, [np.array([i, i + 100]) for i in range(len(words))], path)
    lexicon = bpe.Transducer(path)
    assert len(lexicon.final) < sum(map(len, words))  # suffixes are shared
    asked = [*words, b"ta", b"stopss", b"x", b"tapz"]
    at = np.concatenate([[0], np.cumsum([len(w) for w in asked])])
    got = lexicon.find(np.frombuffer(b"".join(asked), np.uint8), at[:-1], at[1:])
    assert got.tolist() == [*range(len(words)), -1, -1, -1, -1]
    bpe.Transducer.build([], [], path)
    assert bpe.Transducer(path).find(np.frombuffer(b"a", np.uint8), np.array([0]), np.array([1])).tolist() == [-1]


def test_roundtrip(spark, docs, unique_docs, empty, library):
    texts = texts_of(unique_docs)
    for r in bpe.roundtrip_report(docs, PATH).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.roundtrip_report(empty, PATH).count() == 0
    back = bpe.decode(bpe.encode(unique_docs, PATH), PATH)
    assert {r.id: r.text for r in back.collect()} == texts


def test_best_fill_is_optimal():
    rng = random.Random(2)
    for _ in range(30):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(4)}
        pool = [k for k, n in counts.items() for _ in range(n)]
        reach = {0}
        for p in pool:
            reach |= {r + p for r in reach if r + p <= 40}
        fill, used = packing.best_fill(counts, 40)
        assert fill == max(reach) == sum(k * n for k, n in used.items()) and all(n <= counts[k] for k, n in used.items())


def test_packing(spark, unique_docs, empty, library):
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in texts_of(unique_docs).items()}
    assert brute.check_packing(packing.packing_report(unique_docs, PATH).collect(), ids) == 0
    assert packing.packing_report(empty, PATH).count() == 0


def test_packing_where_nothing_fits_exactly(spark, library):
    """All rests have one length that does not divide the capacity."""
    text = "a" * 1
    n = len(library.encode(" the" * 599).ids)
    docs = spark.createDataFrame([(i, " the" * 599) for i in range(25)] + [(99, text)], "doc_id long, text string")
    ids = {r.doc_id: [*library.encode(r.text).ids, 0] for r in docs.collect()}
    assert n == 599
    assert brute.check_packing(packing.packing_report(docs, PATH).collect(), ids) == 0
    rows = packing.pack(docs, PATH).collect()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == ids[r.id][r.start : r.start + r.length] for r in rows)


def test_rollup_history(spark, docs, empty, library):
    import re

    want = {}

    def add(r, text, sign):
        for version, n in ((token_counts.WORDS, len(brute.words(text or ""))), ("bpe", len(library.encode(text or "", add_special_tokens=False).ids))):
            d, t = want.get((r.source, r.lang, version), (0, 0))
            want[(r.source, r.lang, version)] = (d + sign, t + sign * n)

    rows = docs.collect()
    first = {}
    for r in rows:
        add(r, r.text, 1)
        if r.text is not None:
            first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    for r in rows:
        clean = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<mail>", r.text) if r.text is not None else None
        if clean != r.text:
            add(r, r.text, -1)
            add(r, clean, 1)
        if r.text is not None and r.doc_id > first[r.text]:
            add(r, clean, -1)
    got = {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in token_counts.rollup_report(docs, PATH, "bpe").collect()}
    assert got == {k: v for k, v in want.items() if v != (0, 0)}
    assert token_counts.rollup_report(empty, PATH).count() == 0


def test_rollup_batches_are_idempotent(spark, tmp_path):
    kept = token_counts.Rollup(spark, str(tmp_path / "a"), PATH, "bpe")
    image = "struct<source:string,lang:string,text:string>"
    one = spark.createDataFrame([(None, ("s", "en", "a b c"))], f"before {image}, after {image}")
    two = spark.createDataFrame([(("s", "en", "a b c"), ("t", "en", "a b")), (("s", "en", "x"), None)], f"before {image}, after {image}")
    for batch, changes in (("1", one), ("2", two), ("1", one), ("2", two)):
        kept.commit(batch, changes)
    got = {(r.source, r.version): (r.documents, r.tokens) for r in kept.totals().collect()}
    assert got[("s", token_counts.WORDS)] == (-1, -1) and got[("t", token_counts.WORDS)] == (1, 2)
    folded = kept.compact(str(tmp_path / "b"))
    assert {(r.source, r.version): (r.documents, r.tokens) for r in folded.totals().collect()} == got


def test_rollup_batch_corrected_to_nothing(spark, tmp_path):
    image = "struct<source:string,lang:string,text:string>"
    schema = f"before {image}, after {image}"
    kept = token_counts.Rollup(spark, str(tmp_path / "a"), PATH, "bpe")
    kept.commit("one", spark.createDataFrame([(None, ("s", "en", "a b c"))], schema))
    assert {r.version: r.documents for r in kept.totals().collect()} == {token_counts.WORDS: 1, "bpe": 1}
    kept.commit("one", spark.createDataFrame([], schema))
    assert kept.totals().count() == 0 and kept.batches().count() == 1


def test_merging_looks_up_new_pairs_only(monkeypatch):
    """A merge makes at most two new pairs; the pair that is merged is known by its rank."""
    from transitloom.llm.queries import tokenizer_path

    tool = bpe.Bpe(open(tokenizer_path(), encoding="utf-8").read())
    words = [b"transportation", b"neighbourhood", b"xqzvkwjxqzvkwj", b"aaaaaaaaaaaaa"]
    asked, lookup = [], bpe._lookup
    monkeypatch.setattr(bpe, "_lookup", lambda keys, wanted: asked.append(wanted.size) or lookup(keys, wanted))
    ids = tool.merge(words)
    merges = sum(len(w) - len(x) for w, x in zip(words, ids))
    assert [tool.decode(x).encode() for x in ids] == words and merges > 20
    assert sum(asked) <= sum(len(w) - 1 for w in words) + 2 * merges
