"""Byte-pair encoding and decoding as the sentencepiece library does it, in numpy rounds.

A text is cut where no merge can reach: at line ends and before every run of spaces.
The distinct pieces of a chunk lie one after another in one flat symbol array. Each round
looks up the rank of every adjacent pair, takes the smallest rank of each word (segmented
minimum), merges all its places at once from the left, and compacts the array. Words
without a pair left are taken out; rounds end when none remains.

Merging every place of the best pair at once equals the library's order (best score, then
leftmost) unless the merged symbol can at once be part of a pair that is as good or better.
The model's pieces for which this may happen are found beforehand; of those, and of pieces
that share a score, only the leftmost place of a word is merged in a round.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitewatch.llm.common import chunks, map_arrow, own_names

SPACE = "▁"
NO_PAIR = np.iinfo(np.int32).max
SHIFT = np.int64(1 << 20)
#: Encoded words that a worker remembers within a task; then it starts anew.
REMEMBERED = 150_000
#: Text that is encoded at once; its symbols, ids and surface take some 50 times that in flat arrays.
STEP_BYTES = 500_000
CUTS = re.compile(" *[^ \n]+| +|\n")


class Pieces:
    """The tables of one model file, and words that were encoded with them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.unknown = model.unk_id()
        self.bytes_at = np.full(256, self.unknown, np.int64)
        surface: list[bytes] = []
        plain: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_at[value] = i
                surface.append(bytes([value]))
            elif model.is_control(i):
                surface.append(b"")
            elif model.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                plain[piece] = i
                surface.append(piece.replace(SPACE, " ").encode())
        self.surface_from = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.silent = np.array([not s for s in surface])
        self.starts_with_space = np.array([s[:1] == b" " for s in surface]) & ~np.isin(
            np.arange(size), [self.unknown, *self.bytes_at]
        )
        self.size = size
        # Symbols: pieces by their id; characters that only occur inside pieces come after.
        symbol = dict(plain)
        for piece in plain:
            for char in piece:
                symbol.setdefault(char, size + len(symbol) - len(plain))
        self.symbol = symbol
        ranks = {score: rank for rank, score in enumerate(sorted({model.get_score(i) for i in plain.values()}, reverse=True))}
        rank_of = {piece: ranks[model.get_score(i)] for piece, i in plain.items()}
        shared = np.bincount(list(rank_of.values()))
        pairs, alone = {}, set()
        for piece, i in plain.items():
            if len(piece) > 1 and shared[rank_of[piece]] > 1:
                alone.add(i)
            for at in range(1, len(piece)):
                left, right = piece[:at], piece[at:]
                if left in symbol and right in symbol:
                    pairs[symbol[left] * int(SHIFT) + symbol[right]] = (rank_of[piece], i)
                    for part in (left, right):
                        if len(part) > 1 and rank_of[part] >= rank_of[piece]:
                            alone.add(plain[part])
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[int(k)][0] for k in self.pair_keys], np.int32)
        self.pair_made = np.array([pairs[int(k)][1] for k in self.pair_keys], np.int64)
        self.one_at_a_time = np.zeros(size, bool)
        self.one_at_a_time[list(alone)] = True
        for char in "\n":
            assert not any(char in piece and piece != char for piece in plain), "lines are no cuts in this model"
        assert not any(SPACE in piece.lstrip(SPACE) for piece in plain), "spaces are no cuts in this model"
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.word_ids = np.zeros(0, np.int64)
        self.word_from = np.zeros(1, np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word begins."""
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        letters, at = np.unique(points, return_inverse=True)
        known = np.array([self.symbol.get(chr(p), -1 - int(p)) for p in letters], np.int64)
        symbols = known[at]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_owner = [], []
        while len(symbols):
            same = owner[1:] == owner[:-1]
            keys = np.where(same & (symbols[:-1] >= 0) & (symbols[1:] >= 0), symbols[:-1] * SHIFT + symbols[1:], -1)
            found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            hit = self.pair_keys[found] == keys
            rank = np.append(np.where(hit, self.pair_ranks[found], NO_PAIR), NO_PAIR)
            first = np.flatnonzero(np.append(True, ~same))
            best = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(symbols)))
            best_here = np.repeat(best, length)
            over = best_here == NO_PAIR
            done_symbols.append(symbols[over])
            done_owner.append(owner[over])
            places = np.flatnonzero((rank == best_here) & ~over)
            if not len(places):
                break
            made = self.pair_made[found[places]]
            # From the left: every second place of a run of overlapping places, and of
            # symbols that are merged one at a time the first place of the word.
            joined = np.append(False, (np.diff(places) == 1) & (owner[places[1:]] == owner[places[:-1]]))
            run_start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(places))))
            take = (np.arange(len(places)) - run_start) % 2 == 0
            leading = np.append(True, owner[places[1:]] != owner[places[:-1]])
            alone = self.one_at_a_time[made]
            alone_word = np.logical_or.reduceat(alone, np.flatnonzero(leading))
            alone_word = np.repeat(alone_word, np.diff(np.append(np.flatnonzero(leading), len(places))))
            take &= leading | ~alone_word
            places, made = places[take], made[take]
            symbols = symbols.copy()
            symbols[places] = made
            stay = ~over
            stay[places + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return self._ids(symbols[order], owner[order], len(words))

    def _ids(self, symbols: np.ndarray, owner: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids; symbols that are no piece become the bytes of their character."""
        spelled = (symbols < 0) | (symbols >= self.size)
        if spelled.any():
            inside = {v: k for k, v in self.symbol.items() if v >= self.size}
            parts = [
                self.bytes_at[list((inside[s] if s >= 0 else chr(-1 - s)).encode())]
                for s in symbols[spelled].tolist()
            ]
            width = np.ones(len(symbols), np.int64)
            width[spelled] = [len(p) for p in parts]
            out = np.repeat(symbols, width)
            out[np.repeat(spelled, width)] = np.concatenate(parts)
            symbols, owner = out, np.repeat(owner, width)
        return symbols, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=words))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end, one after another, and where each begins."""
        cuts = [CUTS.findall(f" {t}".replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.words) > REMEMBERED:
            self.forget()
        words = self.words
        fresh = [w for w in dict.fromkeys(w for c in cuts for w in c) if w not in words]
        if fresh:
            ids, starts = self.merge([w.replace(" ", SPACE) for w in fresh])
            for w in fresh:
                words[w] = len(words)
            self.word_from = np.concatenate([self.word_from, starts[1:] + self.word_from[-1]])
            self.word_ids = np.concatenate([self.word_ids, ids])
        told = np.fromiter((words[w] for c in cuts for w in c), np.int64)
        size = self.word_from[told + 1] - self.word_from[told]
        ends = np.cumsum(size)
        ids = self.word_ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.word_from[told] - (ends - size), size)]
        ends = np.append(0, ends)[np.cumsum([0, *map(len, cuts)])]
        before = np.repeat(ends, 2)[1:-1]
        marked = np.insert(ids, before, np.tile([self.begin, self.end], len(texts)))
        return marked, ends + 2 * np.arange(len(texts) + 1)

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """Texts of the id lists; ids outside the model are an error, as in the library."""
        size = self.surface_from[ids + 1] - self.surface_from[ids]
        ends = np.append(0, np.cumsum(size))
        flat = self.surface[np.arange(ends[-1]) + np.repeat(self.surface_from[ids] - ends[:-1], size)].tobytes()
        heard = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
        first = heard[np.searchsorted(heard, starts[:-1])]
        texts = []
        for a, b, f in zip(starts[:-1].tolist(), starts[1:].tolist(), first.tolist(), strict=True):
            skip = 1 if f < b and self.starts_with_space[ids[f]] else 0
            texts.append(_utf8(flat[ends[a] + skip : ends[b]]))
        return texts


def _utf8(data: bytes) -> str:
    """Every byte that is part of no character becomes a replacement character."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return re.sub("[\udc80-\udcff]", "�", data.decode(errors="surrogateescape"))


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _with_model(path: str) -> Pieces:
    import public_tokenizers

    return pieces(path if "/" in path else public_tokenizers.path(path))


def _packed(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    data = ids.astype("<u4").tobytes()
    offsets = pa.py_buffer((starts * 4).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, offsets, pa.py_buffer(data)])


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lists = [np.frombuffer(b, "<u4") if b else np.zeros(0, np.uint32) for b in packed.to_pylist()]
    return np.concatenate([np.zeros(0, np.uint32), *lists]).astype(np.int64), np.cumsum([0, *map(len, lists)])


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids``: begin id, the text's ids, end id, as unsigned 32-bit
    little-endian integers in one binary value.

    ``model`` is a path, or the name of a public tokenizer's file. Null text counts as
    empty: begin and end only. Ids and repeated rows pass through unchanged; an empty
    table gives an empty result; further columns are ignored.
    """
    return _mapped(docs, model, doc_id, text, decoded=False)


def round_trip(docs: DataFrame, model: str = "piece_bpe_32k.model", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode``, with the text that the ids decode to as ``decoded``."""
    return _mapped(docs, model, doc_id, text, decoded=True)


def _mapped(docs: DataFrame, model: str, doc_id: str, text: str, decoded: bool) -> DataFrame:
    source = own_names(docs, doc_id, text)
    schema = f"`{doc_id}` {dict(source.dtypes)[doc_id]}, n_tokens long, ids binary" + ", decoded string" * decoded

    return map_arrow(source, lambda batches: _encoded(batches, model, doc_id, text, decoded), schema)


def _encoded(
    batches: Iterator[pa.RecordBatch], model: str, doc_id: str, text: str, decoded: bool
) -> Iterator[pa.RecordBatch]:
    bpe = _with_model(model)
    try:
        for batch in batches:
            for part in chunks(batch, text, STEP_BYTES):
                ids, starts = bpe.encode([t or "" for t in part.column(text).to_pylist()])
                columns = [part.column(doc_id), pa.array(np.diff(starts)), _packed(ids, starts)]
                if decoded:
                    columns.append(pa.array(bpe.decode(ids, starts), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [doc_id, "n_tokens", "ids", "decoded"][: len(columns)])
    finally:
        bpe.forget()  # the worker lives on, for tasks of any other stage


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text`` of packed ids; null or empty ids give an empty text."""
    source = own_names(encoded, doc_id, ids)
    schema = f"`{doc_id}` {dict(source.dtypes)[doc_id]}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _with_model(model)
        for batch in batches:
            for part in chunks(batch, ids, STEP_BYTES):
                texts = bpe.decode(*_unpacked(part.column(ids)))
                yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(texts, pa.string())], [doc_id, "text"])

    return map_arrow(source, run, schema)
