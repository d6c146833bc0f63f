"""SentencePiece agendas, Simple-8b files."""

import copy
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from prefmine.llm import packing, pieces
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def model(tokenizer_path):
    return tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def byte_level(tokenizer_path):
    return tokenizer_path("byte_bpe_50k.json")


def odd_texts():
    random.seed(5)
    parts = [*"  abcthe▁\t\nÉ😀0.-'\x00\x1c", "the ", "  ", "   ", "ing", ".\n", " <|endoftext|>", " ", " ", "漢字", "<s>", "<0x41>"]
    return [t or "" for _, t in ODD] + ["".join(random.choices(parts, k=random.randint(1, 70))) for _ in range(1500)] + ["1 " * 40, "=" * 500, " " * 90 + "x" + " " * 70]


def test_pieces_equal_the_library(model, rows):
    texts = [t for _, t in rows] + odd_texts()
    library = pieces.vocabulary(model)[0].library
    want = library.encode(texts, num_threads=1, add_bos=True, add_eos=True)
    got = pieces.encode_texts(pa.array(texts), model)
    assert [g.tolist() for g in got] == want
    assert [pieces.decode_ids(g, model) for g in got] == library.decode(want)


def test_vocabularies_of_many_scores(model, rows):
    """Ranks count as far as they go: the same order with ranks beyond 65 536 gives the same pieces."""
    v, _ = pieces.vocabulary(model)
    far = copy.copy(v)
    far.rank = v.rank.astype(np.int64) + (1 << 30)
    chunks = [w.encode() for _, t in rows[:20] for w in t.replace("\n", " ").split(" ") if w]
    for a, b in zip(pieces.merge_chunks(v, chunks), pieces.merge_chunks(far, chunks)):
        assert a.tolist() == b.tolist()


def test_decoding_of_any_ids(model):
    library = pieces.vocabulary(model)[0].library
    rng = np.random.default_rng(2)
    for n in range(1500):
        ids = rng.integers(0, 300 if n % 2 else 32_000, rng.integers(0, 12))
        assert pieces.decode_ids(ids, model) == library.decode(ids.tolist())


def test_piece_query(query, rows, model):
    library = pieces.vocabulary(model)[0].library
    got = {r["doc_id"]: r for r in query("op9_sentencepiece")}
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library.encode(text, add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True)
        assert tuple(got[i][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256", "library_agrees")) == want


def test_pieces_of_odd_rows(odd, none, model):
    got = pieces.with_ids(odd, model, digests=True, check=True).collect()
    assert len(got) == len(ODD) and all(r["library_agrees"] for r in got)
    assert [r["ids"] for r in got if not r["text"]][0] == [1, 2]
    assert pieces.with_ids(none, model, digests=True).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_words_hold_any_values(seed):
    rng = np.random.default_rng(seed)
    widths = rng.integers(0, 65, 3000)
    values = np.array([int(rng.integers(0, 1 << 62)) * 4 + 3 >> (64 - int(w)) if w else 0 for w in widths], np.uint64)
    values = np.concatenate([values, np.zeros(700, np.uint64), np.array([1], np.uint64), np.zeros(239, np.uint64), np.array([2**64 - 1, 2**60, 2**60 - 1], np.uint64)])
    assert (packing.decode_block(packing.encode_block(values)) == values).all()


def test_blocks_and_ranges():
    values = np.arange(200_003, dtype=np.uint64) % np.uint64(50_257)
    payload, offsets = packing.encode(values)
    assert len(offsets) == 4 and len(payload) < 3 * len(values)
    assert (packing.decode(payload, offsets) == values).all()
    for a, b in ((0, 1), (65_535, 65_537), (131_000, 199_999), (5, 5)):
        assert (packing.decode(payload, offsets, a, b) == values[a:b]).all()
    assert len(packing.encode(values[:0])[0]) == 0 and len(packing.decode(b"", [])) == 0


def test_token_ids_equal_the_library(byte_level, rows):
    from prefmine.llm.words import slices

    texts = [t for _, t in rows] + odd_texts()
    tokenizer = packing._byte_level(byte_level)[0]
    got = []
    for part in slices(pa.array(texts)):
        ids, bounds = packing.token_ids(part, byte_level)
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_file_query(query, rows, byte_level):
    tokenizer = packing._byte_level(byte_level)[0]
    got, at = {r["doc_id"]: r for r in query("op10_packed_ids")}, 0
    for i, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_files_of_odd_rows(odd, none, byte_level):
    got = sorted(packing.id_file(odd, byte_level).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert packing.id_file(none, byte_level).count() == 0


def test_chunk_table_is_emptied_when_full(byte_level):
    from prefmine.llm.chunks import ChunkTable
    from prefmine.llm.words import Slice

    encode = lambda chunks: (np.frombuffer(b"".join(chunks), np.uint8).astype(np.int32), np.array([len(c) for c in chunks]))
    table = ChunkTable(encode, limit=8)
    for start in range(0, 400, 40):
        raw = b"".join(b"%05d" % i for i in range(start, start + 40)) + b"y" * 90
        edges = np.append(np.arange(0, 201, 5), 290)
        ids, sizes = table.ids(Slice(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), edges[:-1], edges[1:])
        assert ids.astype(np.uint8).tobytes() == raw and sizes.tolist() == [5] * 40 + [90]
