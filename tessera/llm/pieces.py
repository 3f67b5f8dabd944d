"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

A text is cut into units that no piece can span: before each run of blanks, and
around bytes that are in no piece. Over a unit's bytes, the pieces of the given
vocabulary form a lattice; single bytes are always an edge (byte pieces), so every
text has a segmentation. The forward pass gives each position the log of the
summed weight of all its segmentations; the backward pass draws, from the unit's
end, an edge in proportion to the weight of the segmentations through it. Thus a
segmentation comes up with its exact probability. The draws are hashes of
(seed, row key, byte position), so a row's sample is the same on every run and
in every partitioning.

Lattices are built once for each distinct unit of a slice, all units together in
numpy; draws are made for all occurrences together.

The vocabulary file is a BPE model, whose scores are merge ranks and not
probabilities. Pieces get the weight of Zipf's law over that rank, byte pieces the
weight of a rank far beyond the last; ``alpha`` sharpens (> 1) or flattens them.

Decoding joins the pieces' bytes. It is lossless: a blank is the piece mark '▁',
and a literal '▁' in a text is written as byte pieces. No text is normalised.

Rows: null text is encoded like the empty text, as no pieces; a null row key is a
key of its own; rows that repeat a key and a text get the same pieces; an empty
table gives an empty result; further columns pass through the stage and are not
read by the query. A text is one row, in memory at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 1.0, 6
ZIPF_SHIFT, BYTE_RANK = 10.0, 4_000_000.0
SLICE_BYTES = 1 << 18  # a lattice takes about 250 bytes for each byte of its distinct units
MARK = "▁"


@dataclass
class Vocabulary:
    """Bytes, log weight and id of every piece that may be an edge."""
    texts: list[bytes]
    weights: np.ndarray
    ids: np.ndarray
    n_ids: int

    def __post_init__(self) -> None:
        for t in self.texts:
            if b" " in t.lstrip(b" "):
                raise ValueError("a piece continues over a blank; units can't be cut there")


def load(path: str = MODEL) -> Vocabulary:
    """Read the vocabulary file on the driver; tasks get its pieces, not the path."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, weights, ids = [], [], []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            texts.append(bytes([int(piece[3:5], 16)]))
            weights.append(-np.log(BYTE_RANK))
        else:
            texts.append(piece.replace(MARK, " ").encode())
            weights.append(-np.log(-sp.get_score(i) + ZIPF_SHIFT))
        ids.append(i)
    return Vocabulary(texts, np.array(weights), np.array(ids, dtype=np.int64), sp.get_piece_size())


class Encoder:
    """Trie and tables of a vocabulary, made once in each task."""

    def __init__(self, vocab: Vocabulary, alpha: float = ALPHA, seed: int = SEED):
        self.vocab, self.seed = vocab, seed
        self.weight = vocab.weights * alpha
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, list[int]] = {}
        for k, t in enumerate(vocab.texts):
            at = 0
            for x in t:
                at = nodes.setdefault((at, x), len(nodes) + 1)
            ends.setdefault(at, []).append(k)
        self.child = np.zeros((len(nodes) + 1, 256), dtype=np.int32)
        for (a, x), b in nodes.items():
            self.child[a, x] = b
        # a node has one piece, or two where a letter is also a byte piece: keep the heavier
        self.piece = np.full(len(nodes) + 1, -1, dtype=np.int64)
        for node, ks in ends.items():
            self.piece[node] = max(ks, key=lambda k: self.weight[k])
        inner = np.zeros(256, dtype=bool)
        inner[list(b"".join(t for t in vocab.texts if len(t) > 1))] = True
        self.alone = ~inner  # bytes that are only ever a piece of their own
        size = [len(t) for t in vocab.texts]
        self.size = np.array(size, dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)])[:-1]
        self.bytes = np.frombuffer(b"".join(vocab.texts), dtype=np.uint8)
        self.by_id = np.full(vocab.n_ids, -1, dtype=np.int64)
        self.by_id[vocab.ids] = np.arange(len(vocab.ids))
        self.roll = C.Rolling(6)

    def units(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Starts of the units."""
        blank, alone = data == 32, self.alone[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[offs[:-1]] = True
        cut[1:len(data)] |= blank[1:] & ~blank[:-1]
        cut[:len(data)] |= alone
        cut[1:] |= alone
        return np.flatnonzero(cut[:len(data)])

    def lattice(self, data: np.ndarray, a: np.ndarray, b: np.ndarray):
        """Lattices of the units data[a:b], longest unit first. Row base[t] + u is the
        position after t bytes of unit u; of the piece of l bytes that ends there,
        ``piece[row, l - 1]`` is the number and ``upper[row, l - 1]`` the upper end of
        its share of the draws."""
        size = b - a
        longest = int(size[0])
        count = np.searchsorted(-size, -np.arange(longest + 2), side="right")  # units of t bytes or more
        base = np.concatenate([[0], np.cumsum(count)])
        step = np.repeat(np.arange(longest), count[1:longest + 1])
        unit = np.arange(len(step)) - np.repeat(base[1:longest + 1] - count[0], count[1:longest + 1])
        at, stop = a[unit] + step, b[unit]
        node = np.zeros(len(at), dtype=np.int32)
        found, n = [], 0
        while len(at):
            n += 1
            node = self.child[node, data[at + n - 1]]
            live = np.flatnonzero(node)
            at, stop, step, unit, node = at[live], stop[live], step[live], unit[live], node[live]
            piece = self.piece[node]
            hit = np.flatnonzero(piece >= 0)
            found.append((base[step[hit] + n] + unit[hit], piece[hit]))
            more = np.flatnonzero(at + n < stop)
            at, stop, step, unit, node = at[more], stop[more], step[more], unit[more], node[more]
        piece = np.full((base[longest + 1], n), -1, dtype=np.int32)
        upper = np.full((base[longest + 1], n), -np.inf)
        for k, (row, number) in enumerate(found):
            piece[row, k] = number
            upper[row, k] = self.weight[number]
        alpha = np.zeros(base[longest + 1])
        for t in range(1, longest + 1):
            rows, width = slice(base[t], base[t] + count[t]), min(t, n)
            score = upper[rows, :width]
            for k in range(width):
                score[:, k] += alpha[base[t - k - 1]:base[t - k - 1] + count[t]]
            top = score.max(axis=1)
            mass = np.cumsum(np.exp(score - top[:, None]), axis=1)
            alpha[rows] = top + np.log(mass[:, -1])
            upper[rows, :width] = mass / mass[:, -1:]
            upper[rows, width:] = 1.0
        return base, piece, upper

    def encode(self, data: np.ndarray, offs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, row offsets) of a sampled segmentation of every row."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        a = self.units(data, offs)
        b = np.r_[a[1:], len(data)]
        _, first, which = np.unique(self.roll.words(data, a, b), return_index=True, return_inverse=True)
        order = np.argsort(a[first] - b[first], kind="stable")
        base, piece, upper = self.lattice(data, a[first][order], b[first][order])
        place_of = np.empty(len(order), dtype=np.int64)
        place_of[order] = np.arange(len(order))
        row = np.searchsorted(offs, a, side="right") - 1
        stream = C.mix(C.mix(keys.astype(np.uint64)) + np.uint64(self.seed))
        place, left, unit = b.copy(), b - a, place_of[which]
        row_start, seed = offs[row], stream[row]
        out = np.full(len(data), -1, dtype=np.int64)
        while len(place):
            u = (C.mix(seed + (place - row_start).astype(np.uint64)) >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))
            at = base[left] + unit
            k = (upper[at] <= u[:, None]).sum(axis=1)
            out[place - 1] = piece[at, k]
            n = k + 1
            go = np.flatnonzero(left > n)
            place, left, unit, row_start, seed = (place - n)[go], (left - n)[go], unit[go], row_start[go], seed[go]
        used = out >= 0
        return self.vocab.ids[out[used]], np.concatenate([[0], np.cumsum(used)])[offs]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a sequence of pieces."""
        k = self.by_id[ids]
        if len(k) and k.min() < 0:
            raise ValueError("an id is no piece")
        n = self.size[k]
        return self.bytes[np.arange(n.sum()) + np.repeat(self.start[k] - (np.cumsum(n) - n), n)]


def _keys(col: pa.Array) -> np.ndarray:
    return col.cast(pa.int64()).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)


def encode(docs: DataFrame, vocab: Vocabulary, alpha: float = ALPHA, seed: int = SEED, ids: str = "piece_ids", count: str = "n_pieces") -> DataFrame:
    """docs with the sampled piece ids of every text and their number."""
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(count, T.LongType())])

    def run(batches):
        enc = Encoder(vocab, alpha, seed)
        for rows, data, offs in C.text_slices(batches, size=SLICE_BYTES):
            found, at = enc.encode(data, offs, _keys(rows.column("doc_id")))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*rows.columns, lists, pa.array(np.diff(at).astype(np.int64))], schema.names)
    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, vocab: Vocabulary, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """rows with the text that their piece ids stand for (null ids: null)."""
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        enc = Encoder(vocab)
        for b in batches:
            out = [None if x is None else enc.decode(np.array(x, dtype=np.int64)).tobytes().decode() for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], schema.names)
    return rows.mapInArrow(run, schema)


def encode_checked(docs: DataFrame, vocab: Vocabulary, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, piece_ids and whether they decode to the very text."""
    def run(batches):
        enc = Encoder(vocab, alpha, seed)
        for rows, data, offs in C.text_slices(batches, size=SLICE_BYTES):
            found, at = enc.encode(data, offs, _keys(rows.column("doc_id")))
            size = np.concatenate([[0], np.cumsum(enc.size[enc.by_id[found]])])[at]
            same = enc.decode(found)
            wrong = np.concatenate([[0], np.cumsum(same != data)]) if len(same) == len(data) else None
            ok = (size[1:] == offs[1:]) & (wrong[offs[1:]] == wrong[offs[:-1]]) if wrong is not None else np.zeros(rows.num_rows, bool)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), lists, pa.array(ok)],
                                             ["doc_id", "n_pieces", "piece_ids", "lossless"])
    return C.id_text(docs).mapInArrow(run, "doc_id long, n_pieces long, piece_ids array<int>, lossless boolean")


def op6_pieces(spark, sf_dir):
    return encode_checked(C.table(spark, sf_dir, "documents"), load())
