import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import texts_of


def test_stages_against_brute_force(spark, unique_docs):
    docs = unique_docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "substring_dedup", "packing"]
    texts = texts_of(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut(stage(spark, docs, ""))
        if name == "packing":
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert brute.check_packing(out.collect(), {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in texts.items()}) == 0
            return
        assert out.columns == docs.columns
        got = texts_of(out)
        if name == "quality_classifier":
            assert got.items() <= texts.items()
        elif name == "exact_dedup":
            assert got == {i: texts[i] for i, w in brute.exact(texts).items() if w[2]}
        elif name == "ngram_jaccard_join":
            assert got == {i: texts[i] for i, (_, c) in brute.components(texts, 5, 4, 5).items() if c == i}
        else:
            assert got == {i: kept.decode() if gone else texts[i] for i, (_, gone, kept) in brute.stripped(texts).items()}
        docs, texts = out, got


def test_run_on_the_smallest_tables(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", ["exact_dedup", "packing"])
def test_empty_input(spark, empty, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, empty, "").count() == 0
