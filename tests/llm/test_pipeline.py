"""The pipeline against a brute-force version of its stages, and the registry."""

import collections
import re

import __spark_entry__
import corpus_pipeline
import pytest
from test_dedup import brute_components, brute_print, sha
from tessitura.llm import bpe, language, mixing, queries

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = language.train(docs)
    known = {r["doc_id"] for r in language.fuse(language.scored(language.of_documents(docs), model), model).collect() if r["kept"]}
    assert {i for i, r in rows.items() if re.search("[A-Za-zÀ-ÿ]", r["text"] or "")} - known == set()
    first = {}
    for i in sorted(known):
        first.setdefault(re.sub("[ \t-\r]+", " ", rows[i]["text"]), i)
    left = set(first.values())
    component = brute_components({i: brute_print(rows[i]["text"]) for i in left})
    left = {i for i in left if component[i] == i}
    copies = {r["doc_id"]: r["copies"] for r in mixing.op2_mixing(docs.filter(docs["doc_id"].isin(*left))).collect()}
    tokenizer = bpe.codec(bpe.default_tokenizer()).tokenizer
    got = corpus_pipeline.run(spark, DATA).collect()
    assert collections.Counter(r["doc_id"] for r in got) == {i: n for i, n in copies.items() if n}
    for r in got:
        ids = tokenizer.encode(rows[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == sha(tokenizer.decode(ids, skip_special_tokens=False))


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect() == []


@pytest.mark.parametrize("n", range(1, 11))
def test_registry(n):
    assert sum(q.startswith(f"op{n}_") for q in queries.queries()) == 1
    assert "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
