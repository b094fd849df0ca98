"""Encoding text into the pieces of a given SentencePiece model, and back.

Texts are cut at single spaces into marked words, which begin with the space.
The distinct words of a group of rows are sorted, which lays them out as a depth-first walk of their trie; the
Viterbi scores of a word's prefixes are those of its predecessor as far as
both agree, so only the new suffix is computed. A worker remembers the pieces
of its words between batches, up to a bound.

Scores are the model's. In a model of byte-pair merges they are merge ranks
and no log-probabilities; there the score of the piece of rank r is -log(r + 2), the
usual estimate for ranked words. A character outside the vocabulary becomes its bytes.
Equal scores prefer the longer last piece.

Decoding gives back every text exactly, all white space and literal marker
characters included. A null or empty text has no pieces and decodes to the empty text.
"""

from __future__ import annotations

import math
import os
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parcella.llm.common import arrow_map, importable, lists, row_groups, utf8

MODEL = os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Words whose pieces a worker remembers.
REMEMBERED = 300_000


@dataclass
class Vocabulary:
    key: str
    #: Id and score of every piece that may be chosen; the marker is a space.
    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    byte_score: float
    #: What each id decodes to.
    content: list[bytes]
    #: Id (as four bytes) and score of every end of a piece that is a piece itself, nothing for other ends.
    ends: dict[str, tuple[bytes, float] | None]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        plain = [i for i in range(n) if not special[i] and not model.is_byte(i) and model.get_score(i) > -1e8]
        scores = {i: model.get_score(i) for i in plain}
        if all(s <= 0 and s == int(s) for s in scores.values()) and len(set(scores.values())) == len(scores):
            scores = {i: -math.log(2 - s) for i, s in scores.items()}
        pieces, content = {}, [b""] * n
        for i in range(n):
            own = model.id_to_piece(i).replace(MARK, " ")
            if model.is_byte(i):
                content[i] = bytes([int(own[3:5], 16)])
            elif not special[i]:
                content[i] = own.encode()
        for i in plain:
            own = content[i].decode()
            if " " not in own[1:]:
                pieces[own] = (i, scores[i])
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        lowest = min(scores.values())
        ends = dict.fromkeys(own[k:] for own in pieces for k in range(len(own)))
        ends |= {own: (_packed(i), score) for own, (i, score) in pieces.items()}
        return cls(os.path.basename(path), pieces, byte_ids, lowest - 10, content, ends)


def _packed(*ids: int) -> bytes:
    return array("i", ids).tobytes()


def segmented(words: list[str], v: Vocabulary) -> dict[str, bytes]:
    """Ids (32-bit, concatenated) of the best pieces of every word.

    Going back from a place stops where no piece ends with what lies between.
    """
    found: dict[str, bytes] = {}
    get = v.ends.get
    # Best score of every beginning of a word, where its last piece begins and that piece's id.
    score, back, last, before = [0.0], [0], [b""], ""
    for word in sorted(words):
        n, common = min(len(word), len(before)), 0
        while common < n and word[common] == before[common]:
            common += 1
        del score[common + 1 :], back[common + 1 :], last[common + 1 :]
        for end in range(common + 1, len(word) + 1):
            at = end - 1
            piece = get(word[at])
            if piece:
                ids, best = piece[0], score[at] + piece[1]
            else:
                raw = word[at].encode()
                ids, best = _packed(*[v.byte_ids[b] for b in raw]), score[at] + v.byte_score * len(raw)
            for start in range(end - 2, -1, -1):
                piece = get(word[start:end], False)
                if piece:
                    total = score[start] + piece[1]
                    if total >= best:
                        ids, best, at = piece[0], total, start
                elif piece is False:
                    break
            score.append(best)
            back.append(at)
            last.append(ids)
        parts, at = [], len(word)
        while at:
            parts.append(last[at])
            at = back[at]
        found[word] = b"".join(parts[::-1])
        before = word
    return found


_memory: dict[str, dict[str, bytes]] = {}


def encode(documents: DataFrame, path: str = MODEL, output: str = "ids") -> DataFrame:
    """All columns and the ids of every text; a column of that name is replaced."""
    spark = importable(documents.sparkSession)
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(path))  # bounded by the model
    own = documents.select([c for c in documents.columns if c.lower() != output.lower()])
    text = own.columns.index("text")

    def run(batch):
        v = vocabulary.value
        known = _memory.setdefault(v.key, {})
        data, offsets = utf8(batch.column(text))
        for i, j in row_groups(offsets, 4_000_000):
            split = [t.as_py().split(" ") if t.as_py() else [] for t in batch.column(text).slice(i, j - i)]
            # The empty word is the bare marker.
            missing = set().union(*split).difference(known)
            if len(known) + len(missing) > REMEMBERED:
                known.clear()
                missing = set().union(*split)
            for word, ids in segmented([" " + w for w in missing], v).items():
                known[word[1:]] = ids
            rows = [b"".join(map(known.__getitem__, words)) for words in split]
            ends = np.cumsum([0] + [len(r) // 4 for r in rows])
            ids = lists(np.frombuffer(b"".join(rows), np.int32), ends, pa.int32())
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, output])

    return arrow_map(own, T.StructType([*own.schema.fields, T.StructField(output, T.ArrayType(T.IntegerType()))]), run)


def _texts(ids: np.ndarray, bounds: np.ndarray, content: pa.Array) -> pa.Array:
    """Texts of consecutive rows of ids; the last of ``content`` stands for ids that it does not hold."""
    unknown = len(content) - 1
    joined = content.take(pa.array(np.where((ids >= 0) & (ids < unknown), ids, unknown)))
    _, ends, data = joined.buffers()
    ends = np.frombuffer(ends, np.int64)[joined.offset : joined.offset + len(joined) + 1][bounds]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    # The leading space of a text goes.
    first = ends[:-1][np.diff(ends) > 0]
    spaces = first[data[first] == 32]
    data = np.delete(data[: ends[-1]], spaces)
    ends = ends - np.searchsorted(spaces, ends)
    texts = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    try:
        return texts.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # bytes that form no UTF-8
        return pa.array([t.as_py().decode(errors="replace") for t in texts], pa.string())


def decode(encoded: DataFrame, path: str = MODEL, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """All columns and the text that the ids stand for; a column of that name is replaced.

    A null list gives an empty text. A null id, or one that the vocabulary does not hold,
    stands for U+FFFD; so do bytes that form no UTF-8. One leading space goes, if there is one.
    """
    spark = importable(encoded.sparkSession)
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(path))
    own = encoded.select([c for c in encoded.columns if c.lower() != output.lower()])
    at = own.columns.index(ids)

    def run(batch):
        content = pa.array([*vocabulary.value.content, "\ufffd".encode()], pa.large_binary())
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            column = part.column(at)
            # A null list has no ids, whatever lies under it.
            bounds = np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy()))
            texts = _texts(column.flatten().fill_null(-1).to_numpy(), bounds, content)
            yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, output])

    return arrow_map(own, T.StructType([*own.schema.fields, T.StructField(output, T.StringType())]), run)
