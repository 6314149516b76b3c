import random
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from sitewatch.llm import queries
import test_jaccard_join as near
import test_quality as rules


def tables(tmp_path, make, label):
    rnd = random.Random(8)
    rows, labels = rules.corpus(80)
    long = [(i, t) for i, t in rows if len(t.split()) >= 50]
    rows += [(200 + k, t) for k, (_, t) in enumerate(long[:10])]  # exact copies
    for k, (_, t) in enumerate(long[10:25]):  # near copies
        own = t.split(" ")
        own[rnd.randrange(len(own))] = "word0"
        rows.append((300 + k, " ".join(own)))
    rows += [(400, None), (401, ""), (402, "x " * 100_000)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    label(labels).write.parquet(f"{tmp_path}/labels.parquet")
    return rows, labels


def test_run_against_plain_python(spark, make, label, tmp_path):
    rows, labels = tables(tmp_path, make, label)
    kept = {r[0] for r in rules.brute(rows, labels) if r[-1]}
    staying = [(i, t) for i, t in rows if i in kept]
    last = {}
    for i, t in staying:
        last[t] = max(last.get(t, i), i)
    staying = [(i, t) for i, t in staying if last[t] == i]
    staying = [(i, t) for (i, t), (_, _, least) in zip(sorted(staying), near.brute(sorted(staying)), strict=True) if least == i]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "jaccard_join":
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i, _ in staying)
    out = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.TOKENIZER))
    texts = dict(staying)
    assert out and {r["doc_id"] for r in out} <= set(texts)
    for r in out:
        assert r["n_tokens"] == len(model.encode(texts[r["doc_id"]], add_bos=True, add_eos=True))
    clean = [i for i, t in staying if not re.search(r"[*$]", t)]
    assert len({r["doc_id"] for r in out} & set(clean)) > 0.9 * len(clean)


def test_stages_over_empty_tables(spark, make, label, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    label([]).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("number", range(1, 11))
def test_every_operator_has_one_query(number):
    assert len([n for n in queries.QUERIES if n.startswith(f"op{number}_")]) == 1
