"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps, for every chunk of text, the agenda of its adjacent symbol pairs: of all pairs that form
a piece the best-scored one, leftmost among equals, is merged, its two new neighbour pairs enter the
agenda, and so on until no pair forms a piece. Many chunks are worked on at once, one merge each per
round; a chunk of more than ``MANY`` symbols is worked on alone with a heap. Symbols that are no piece
become their UTF-8 bytes' pieces.

Spaces become U+2581 and one is put before a text. A text is cut before every run of spaces, which is
exact as long as no piece holds that mark behind another character; a vocabulary with such pieces, or
with another normalisation than the identity, is refused.

Null texts count as empty; an empty text has only the begin and end ids. Repeated rows are encoded each.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prefmine.llm.chunks import ChunkTable, cut, ids_per_document
from prefmine.llm.tables import with_columns
from prefmine.llm.words import Slice, slices, text_array

MARK = "▁"
MANY = 48
GROUP = 20_000


# every byte that is no part of a character becomes one replacement character
codecs.register_error("each-byte", lambda error: ("\ufffd" * (error.end - error.start), error.end))


class Vocabulary:
    """Pieces, scores, and the table of pairs that merge."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.size, self.begin, self.end, self.unknown = n, self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) for i in range(n)]
        byte = [self.library.is_byte(i) for i in range(n)]
        self.plain = {p: i for i, p in enumerate(pieces) if not special[i] and not byte[i]}
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.plain):
            raise ValueError("a piece holds a space behind another character")
        self.scores = np.array([self.library.get_score(i) for i in range(n)])
        self.bytes_ids = np.zeros(256, np.int64)
        for i in range(n):
            if byte[i]:
                self.bytes_ids[int(pieces[i][3:5], 16)] = i
        if not any(byte):
            raise ValueError("the vocabulary has no byte pieces")
        if self.library.normalize("ﬁ é") != MARK + "ﬁ" + MARK + "é":
            raise ValueError("the vocabulary normalises texts")
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, i in self.plain.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        # rank 0 merges first; equal scores have equal ranks
        self.rank = np.unique(-self.scores, return_inverse=True)[1].astype(np.int64)
        pairs: dict[int, int] = {}
        for p, i in self.plain.items():
            for at in range(1, len(p)):
                a, b = self.plain.get(p[:at]), self.plain.get(p[at:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pairs = pairs
        # open addressing, at most a quarter full
        self.bits = max(4, int(np.ceil(np.log2(4 * len(pairs) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.zeros(1 << self.bits, np.int64)
        keys, ids = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            placed = np.zeros(len(at), bool)
            placed[first] = True
            placed &= free
            self.keys[at[placed]], self.merged[at[placed]] = keys[placed], ids[placed]
            keys, ids, at = keys[~placed], ids[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)
        self.texts = [b"" if s else bytes([int(p[3:5], 16)]) if b else p.replace(MARK, " ").encode() for p, s, b in zip(pieces, special, byte)]
        self.texts[self.unknown] = self.library.decode([self.unknown]).encode()
        self.is_byte = np.array(byte)
        self.silent = np.array([not t for t in self.texts])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ids(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that each pair forms, -1 if none. Symbols that are no piece are negative."""
        keys = np.where((left < 0) | (right < 0), -2, left << 32 | right)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.merged[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0) & (keys >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


_vocabularies: dict[str, tuple[Vocabulary, ChunkTable]] = {}


def vocabulary(path: str) -> tuple[Vocabulary, ChunkTable]:
    if path not in _vocabularies:
        v = Vocabulary(path)
        _vocabularies[path] = (v, ChunkTable(lambda chunks: merge_chunks(v, chunks)))
    return _vocabularies[path]


def _merge_alone(v: Vocabulary, symbols: list[int]) -> list[int]:
    """The agenda of one long chunk as a heap; entries whose symbols have changed are passed over."""
    n = len(symbols)
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        made = v.pairs.get(symbols[i] << 32 | symbols[j]) if symbols[i] >= 0 and symbols[j] >= 0 else None
        if made is not None:
            agenda.append((int(v.rank[made]), i, symbols[i], j, made)) if not ready else heapq.heappush(agenda, (int(v.rank[made]), i, symbols[i], j, made))

    ready = False
    for i in range(n - 1):
        offer(i, i + 1)
    heapq.heapify(agenda)
    ready = True
    alive = [True] * n
    while agenda:
        _, i, left, j, made = heapq.heappop(agenda)
        if not alive[i] or j >= n or not alive[j] or symbols[i] != left or following[i] != j or v.pairs.get(left << 32 | symbols[j]) != made:
            continue
        symbols[i], alive[j] = made, False
        following[i] = following[j]
        if following[i] < n:
            previous[following[i]] = i
            offer(i, following[i])
        if previous[i] >= 0:
            offer(previous[i], i)
    return [s for s, a in zip(symbols, alive) if a]


def _merge_together(v: Vocabulary, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges the symbols of many chunks (``owner`` ascending) until no pair forms a piece."""
    done_symbols, done_owner = [], []
    none = np.int64(1) << 62  # beyond (rank << 24) + place for any vocabulary of 64-bit ids that fits in memory
    made = np.append(v.pair_ids(symbols[:-1], symbols[1:]), -1)
    made[:-1][owner[1:] != owner[:-1]] = -1
    while len(symbols):
        place = np.arange(len(symbols))
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        # rank first, then position: the least is the best pair, leftmost among equals
        keys = np.where(made >= 0, (v.rank[made].astype(np.int64) << 24) + place, none)
        best = np.minimum.reduceat(keys, starts)
        active = best < none
        sizes = np.diff(np.append(starts, len(symbols)))
        keep = np.repeat(active, sizes)
        if not active.all():
            done_symbols.append(symbols[~keep])
            done_owner.append(owner[~keep])
        if not active.any():
            break
        at = best[active] & ((1 << 24) - 1)
        symbols[at] = made[at]
        keep[at + 1] = False
        where = np.cumsum(keep) - 1
        at = where[at]
        symbols, owner, made = symbols[keep], owner[keep], made[keep]
        for left in (at - 1, at):  # the two pairs that are new
            ok = (left >= 0) & (left + 1 < len(symbols))
            ok[ok] = owner[left[ok]] == owner[left[ok] + 1]
            made[left[ok]] = v.pair_ids(symbols[left[ok]], symbols[left[ok] + 1])
        last = np.append(owner[1:] != owner[:-1], True)
        made[last] = -1
    symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return symbols[order], owner[order]


def merge_chunks(v: Vocabulary, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the chunks, and how many each has; spaces stand for the mark."""
    parts = [_merge_group(v, chunks[i : i + GROUP]) for i in range(0, len(chunks), GROUP)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _merge_group(v: Vocabulary, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(chunks), np.uint8)
    lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
    heads = np.flatnonzero((raw & 0xC0) != 0x80)  # first bytes of characters
    owner = np.repeat(np.arange(len(chunks)), lengths)[heads]
    codes = np.frombuffer(raw.tobytes().decode().replace(" ", MARK).encode("utf-32-le"), "<u4").astype(np.int64)
    symbols = v.char_ids[codes].astype(np.int64)
    symbols = np.where(symbols < 0, -1 - codes, symbols)  # no piece: the code point, kept for its bytes
    sizes = np.bincount(owner, minlength=len(chunks))
    long = np.flatnonzero(sizes > MANY)
    if len(long):
        stops = np.cumsum(sizes)
        alone = [np.array(_merge_alone(v, symbols[stops[k] - sizes[k] : stops[k]].tolist()), np.int64) for k in long]
        rest = sizes[owner] <= MANY
        symbols, owner = symbols[rest], owner[rest]
    if len(symbols):
        symbols, owner = _merge_together(v, symbols, owner)
    if len(long):
        symbols = np.concatenate([symbols, *alone])
        owner = np.concatenate([owner, np.repeat(long, [len(a) for a in alone])])
        order = np.argsort(owner, kind="stable")
        symbols, owner = symbols[order], owner[order]
    if (symbols < 0).any():
        symbols, owner = _with_bytes(v, symbols, owner)
    return symbols, np.bincount(owner, minlength=len(chunks))


def _with_bytes(v: Vocabulary, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts the byte pieces of its code point in place of every symbol that is no piece."""
    codes = -1 - symbols[symbols < 0]
    spelled = [v.bytes_ids[list(chr(c).encode())] for c in codes.tolist()]
    sizes = np.ones(len(symbols), np.int64)
    sizes[symbols < 0] = [len(x) for x in spelled]
    unknown = np.repeat(symbols < 0, sizes)
    out = np.repeat(symbols, sizes)
    out[unknown] = np.concatenate(spelled)
    return out, np.repeat(owner, sizes)


def encode_slice(part: Slice, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of the documents of a slice whose texts have a space put before them (empty: none)."""
    _, table = vocabulary(path)
    data = part.data
    space = data == 32
    here = space.copy()
    here[1:] &= ~space[:-1]
    if len(data) > 3:  # a mark in the text itself acts as a space: no cut behind it
        mark = MARK.encode()
        here[3:] &= ~((data[:-3] == mark[0]) & (data[1:-2] == mark[1]) & (data[2:-1] == mark[2]))
    doc, start, end = cut(part, here)
    ids, sizes = table.ids(part, start, end)
    return ids, ids_per_document(sizes, doc, len(part.offsets) - 1)


def encode_texts(texts: pa.Array, path: str) -> list[np.ndarray]:
    """Ids of each text with begin and end ids."""
    v, _ = vocabulary(path)
    plain = text_array(texts)
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    spaced = pc.if_else(pc.equal(plain, nothing), nothing, pc.binary_join_element_wise(space, plain, nothing))
    out = []
    for part in slices(spaced):
        ids, bounds = encode_slice(part, path)
        out += [np.concatenate([[v.begin], ids[a:b], [v.end]]).astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The text of ids: pieces joined, bytes put together, control ids skipped, the first space dropped."""
    v, _ = vocabulary(path)
    ids = np.asarray(ids, np.int64)
    shown = np.flatnonzero(~v.silent[ids])
    if not len(shown):
        return ""
    # control ids inside end a run of bytes
    runs = np.split(ids[shown], np.flatnonzero(np.diff(shown) > 1) + 1)
    raw = [b"".join(map(v.texts.__getitem__, run.tolist())) for run in runs]
    if not v.is_byte[runs[0][0]] and raw[0].startswith(b" ") and runs[0][0] != v.unknown:
        raw[0] = raw[0][1:]
    return "".join(r.decode("utf-8", "each-byte") for r in raw)


def with_ids(
    df: DataFrame, path: str, text: str = "text", ids: str | None = "ids", digests: bool = False, check: bool = False
) -> DataFrame:
    """Appends the ids of ``text`` (array of int), or with ``digests`` their number, the digests of ids and
    of the text decoded from them, and with ``check`` whether the library gives the same ids and text."""
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else []
    if digests:
        fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if check:
        fields += [T.StructField("library_agrees", T.BooleanType())]

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column(text)
        found = encode_texts(texts, path)
        out: dict[str, pa.Array] = {}
        if ids:
            out[ids] = pa.array(found, pa.list_(pa.int32()))
        decoded = [decode_ids(f, path) for f in found] if digests or check else []
        if digests:
            out["n_tokens"] = pa.array([len(f) for f in found], pa.int64())
            out["ids_sha256"] = pa.array([hashlib.sha256(f.astype("<u4").tobytes()).hexdigest() for f in found], pa.string())
            out["decoded_sha256"] = pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())
        if check:
            library = vocabulary(path)[0].library
            agrees = []
            for i in range(0, len(found), 200):
                plain = [t or "" for t in texts.slice(i, 200).to_pylist()]
                theirs = library.encode(plain, num_threads=1, add_bos=True, add_eos=True)
                back = library.decode(theirs, num_threads=1)
                agrees += [f.tolist() == t and d == b for f, t, d, b in zip(found[i : i + 200], theirs, decoded[i : i + 200], back)]
            out["library_agrees"] = pa.array(agrees, pa.bool_())
        return out

    return with_columns(df, make, fields)
