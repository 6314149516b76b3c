import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece as library
from hypothesis import given, settings
from hypothesis import strategies as st

from sitewatch.llm import common, sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = library.SentencePieceProcessor(model_file=PATH)
BPE = sentencepiece.Pieces(PATH)


def same(texts):
    ids, starts = BPE.encode(texts)
    decoded = BPE.decode(ids, starts)
    for i, text in enumerate(texts):
        want = MODEL.encode(text, add_bos=True, add_eos=True)
        assert ids[starts[i] : starts[i + 1]].tolist() == want, text
        assert decoded[i] == MODEL.decode(want), text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
def test_any_text(texts):
    same(texts)


def test_spaces_lines_and_runs():
    same(["", " ", "\n", "▁", " ▁ ", *[" " * k + "a" for k in range(40)], *["a" * k for k in range(60)], "x\n\ny\t z"])
    same([" " * 2500, "ab" * 4000, "é" * 900, "<s> </s> <unk> <0x41>", "\x00a\r\n"])


def test_pieces_put_together():
    rnd = random.Random(5)
    pieces = [MODEL.id_to_piece(i) for i in range(259, 32000)]
    same(["".join(rnd.sample(pieces, rnd.randint(1, 12))) for _ in range(1500)])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=30))
def test_any_ids_decode_like_the_library(ids):
    assert BPE.decode(np.array(ids, np.int64), np.array([0, len(ids)])) == [MODEL.decode(ids)]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(sentencepiece, "REMEMBERED", 10)
    for k in range(5):
        same([f"word{k}{j} other" for j in range(20)])


def test_a_task_encodes_in_small_steps_and_leaves_no_words_behind(monkeypatch):
    steps, encode = [], sentencepiece.Pieces.encode

    def watched(self, texts):
        steps.append(sum(map(len, texts)))
        return encode(self, texts)

    monkeypatch.setattr(sentencepiece.Pieces, "encode", watched)
    texts = [f"w{k} x{k}y " * 2_000 for k in range(80)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(80)), "text": texts})
    out = list(sentencepiece._encoded(iter([batch]), PATH, "doc_id", "text", True))
    assert [t for part in out for t in part.column("decoded").to_pylist()] == [MODEL.decode(MODEL.encode(t)) for t in texts]
    assert max(steps) <= sentencepiece.STEP_BYTES < sum(steps) == sum(map(len, texts))
    assert not sentencepiece.pieces(PATH).words


def test_batches_of_long_rows_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    long = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) as text")
    told = common.map_arrow(long, sizes, "rows long, size long").collect()
    assert sum(r["rows"] for r in told) == 40
    assert max(r["size"] for r in told) < 2 * common.BATCH_BYTES


def test_tables(make, got):
    rows = [(1, "one two"), (2, None), (3, ""), (None, "x"), (1, "one two")]
    out = sentencepiece.round_trip(make(rows, extra=True)).collect()
    assert len(out) == 5
    for r in out:
        text = dict(rows)[r["doc_id"]] or ""
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == MODEL.encode(text, add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["decoded"] == text
    encoded = sentencepiece.encode(make(rows))
    assert got(sentencepiece.decode(encoded)) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert sentencepiece.round_trip(make([])).count() == 0


def test_a_model_whose_words_run_over_spaces_is_refused(monkeypatch):
    class Wrong(library.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 400 else super().id_to_piece(i)

    monkeypatch.setattr(library, "SentencePieceProcessor", Wrong)
    with pytest.raises(AssertionError, match="no cuts"):
        sentencepiece.Pieces(PATH)
