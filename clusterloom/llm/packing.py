"""Packing documents into sequences by vector best-fit.

A sequence has up to three capacities: tokens, documents, and attention cost (the
sum of squared lengths). Pieces are placed from the largest down, each into the
open sequence that it fits under every capacity and whose remaining vector is
then the smallest, or whose remaining vector it covers best.

Texts are tokenized once, where they are read, and only piece lengths and
checksums travel. Pieces are dealt to shards of a fixed size by their place in
the stored table, so a shard is a fair sample of all lengths and no key can
crowd one; with some thousand pieces in each, best-fit leaves next to no room.
"""

from __future__ import annotations

import functools
import math
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.lineage import cut_lineage

CAPACITY = 2048
#: Documents and attention cost that a full sequence can have at most: with these, every
#: remainder has a part in the score, and no sequence more is needed.
MAX_DOCUMENTS, MAX_ATTENTION = CAPACITY, CAPACITY**2
END_ID = 0
PIECES_PER_SHARD = 8192
#: Words whose ids a task remembers, and their longest form in bytes.
CACHED_WORDS, CACHED_BYTES = 500_000, 48
#: A run of marks between an ASCII letter and white space: a piece of its own.
_MARKS = re.compile(rb"([a-z])([^\sa-z0-9'\x80-\xff]+)(?=\s)")


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return tokenizer, ends


class WordEncoder:
    """Ids of whole texts from the ids of their words.

    For a tokenizer whose pieces never cross white space (it drops white space
    and merges within words), the ids of a text are those of its words one after
    the other. ``ids`` returns them as little-endian unsigned 32-bit numbers.
    The tokenizer lower-cases, and parts letters from marks; doing so beforehand
    leaves fewer different words. A text that could hold a special token, which
    is matched as written, is left as it is.
    """

    def __init__(self, path: str):
        self.tokenizer, self.ends = _tokenizer(path)
        self.known: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in encoded]

    def _words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each word with its ids; words of letters go together, cut at word ends."""
        rest, joined = [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            (joined if text.isalpha() and text.lower().isalpha() else rest).append((w, text))
        groups = [joined[i : i + 512] for i in range(0, len(joined), 512)]
        for group, ids in zip(groups, self._encode([" ".join(t for _, t in g) for g in groups])):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):
                rest += group
                continue
            raw, at = ids.tobytes(), 0
            for (w, _), end in zip(group, (4 * cuts).tolist()):
                yield w, raw[at:end]
                at = end
        yield from zip((w for w, _ in rest), (ids.tobytes() for ids in self._encode([t for _, t in rest])))

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        split = [
            (t if b"<|" in t else _MARKS.sub(rb"\1 \2", t.lower())).split() for t in texts
        ]
        unseen = set().union(*split).difference(self.known)
        if len(self.known) + len(unseen) > CACHED_WORDS:
            self.known = {}
            unseen = set().union(*split)
        coded = dict(self._words(list(unseen)))
        long = {w: c for w, c in coded.items() if len(w) > CACHED_BYTES}
        self.known.update((w, c) for w, c in coded.items() if len(w) <= CACHED_BYTES)
        known = self.known
        for words in split:
            if long and not long.keys().isdisjoint(words):
                yield b"".join([long.get(w) or known[w] for w in words])
            else:
                yield b"".join([known[w] for w in words])


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           piece_tokens: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)`` of every whole text, end id included."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * piece_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                index, piece, length, crc = [], [], [], []
                for i, ids in enumerate(encoder.ids(batch.column(1).to_pylist())):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), width)):
                        part = ids[start : start + width]
                        index.append(i)
                        piece.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(index, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array([p * piece_tokens for p in piece], pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    kind = dict(rows.dtypes)[id_col]
    return rows.mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], score: str = "norm",
             weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and token offset of each piece.

    ``capacities`` are tokens, documents and attention cost; an infinite one does
    not bind and has no part in the score. ``norm`` takes the smallest weighted
    norm of what would remain, ``dot`` the largest weighted dot product of piece
    and remainder, over the remainder's squared norm. Ties go to the sequence
    opened first.
    """
    need = np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1).astype(np.float64)
    limit = np.array(capacities, dtype=np.float64)
    bound = np.isfinite(limit)
    need, limit, weight = need[:, bound], limit[bound], np.array(weights)[bound]
    order = np.argsort(-lengths, kind="stable")
    sequence = np.full(len(lengths), -1, dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    least = need.min(axis=0)[:, None] if len(need) else limit[:, None]
    share = weight / limit**2  # weights of shares of the capacities, for amounts as they are

    left = np.empty((len(limit), 1024))  # what open sequences have left, a row for each capacity
    name = np.empty(1024, dtype=np.int64)
    n_open = n_all = 0
    used = np.zeros(len(lengths), dtype=np.int64)
    needs = need[:, :, None]
    for i in order:
        v, free = needs[i], left[:, :n_open]
        fits = np.flatnonzero((free >= v).all(axis=0))
        if len(fits):
            r = free[:, fits]
            if score == "norm":
                r = r - v
                pick = fits[(share @ (r * r)).argmin()]
            else:
                pick = fits[((share @ (r * v)) / (share @ (r * r))).argmax()]
        else:
            if n_open == left.shape[1]:
                left, name = np.concatenate([left, left], axis=1), np.concatenate([name, name])
            pick = n_open
            left[:, pick], name[pick] = limit, n_all
            n_open, n_all = n_open + 1, n_all + 1
        s = name[pick]
        sequence[i], offset[i] = s, used[s]
        used[s] += lengths[i]
        left[:, pick] -= need[i]
        if (left[:, pick:pick + 1] < least).any():  # nothing fits any more
            left[:, pick : n_open - 1] = left[:, pick + 1 : n_open]
            name[pick : n_open - 1] = name[pick + 1 : n_open]
            n_open -= 1
    return sequence, offset


def _pack_shard(capacities, score, weights) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        sequence, offset = best_fit(shard["length"].to_numpy(), capacities, score, weights)
        # room for as many sequences as a shard can have pieces
        shard["sequence_id"] = shard["shard"] * 2**32 + sequence
        shard["offset"] = offset
        return shard.drop(columns=["shard", "row"])

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, max_documents: int | None = None,
                   max_attention: int | None = None, score: str = "norm",
                   weights: tuple[float, float, float] = (1.0, 1.0, 1.0), end_id: int = END_ID,
                   pieces_per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """One row for each piece: ``(id, piece, start, length, ids_crc32, sequence_id, offset)``.

    Only documents of more tokens than a sequence holds (or than the attention
    cost allows in one piece) are cut. A null or empty text is its end id alone.
    Repeated rows and null ids are rows like any other; an empty table gives none.
    """
    piece_tokens = capacity if max_attention is None else min(capacity, math.isqrt(max_attention))
    cut = cut_lineage(pieces(docs, tokenizer_path, id_col, text_col, piece_tokens, end_id))
    n_shards = max(1, -(-cut.count() // pieces_per_shard))
    placed = cut.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "shard", F.pmod(F.xxhash64("row"), F.lit(n_shards))
    )
    limits = tuple(math.inf if c is None else float(c) for c in (capacity, max_documents, max_attention))
    kind = dict(cut.dtypes)[id_col]
    schema = (
        f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long"
    )
    return placed.groupBy("shard").applyInPandas(_pack_shard(limits, score, weights), schema)
