"""Token-id files with Re-Pair grammar compression and random-access decoding.

A file row holds one block: up to ``BLOCK`` ids of consecutive documents in doc_id order. Re-Pair replaces
frequent pairs of neighbouring symbols by nonterminals, round after round, each round taking all pairs that
are frequent enough (most frequent first where they overlap); pairs never reach over a document's end.
The block stores the rules, each rule's expansion length, and where each document's symbols begin, so any
document, or any range of its ids, is expanded without touching the rest.

Layout of a block (little-endian): magic ``RPB2``; unsigned 32-bit first nonterminal, rules r, documents d, how
many of them (the last) have no doc_id, symbols s; unsigned 64-bit ids n; then r x (left, right) as unsigned 32-bit; r expansion lengths as
unsigned 32-bit; d doc_ids as signed 64-bit; d + 1 symbol offsets and d + 1 id offsets as unsigned 32-bit; the symbols, three bytes each.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, ragged, small, stored
from .encode import encoder
from .packing import run_of, runs

MAGIC, HEAD = b"RPB2", struct.Struct("<4sIIIIIQ")
#: Ids of a block; rounds of replacement at most (None: until no pair is left); times that a pair must occur to be
#: replaced. ``rounds=None, least=2`` goes on until no pair occurs twice.
BLOCK, ROUNDS, LEAST = 2_000_000, 6, 16
#: Pre-tokens that an encoding worker remembers.
MEMO = 1_000_000
LAST = np.iinfo(np.int64).max


_TABLE = 22


def _place(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE)


def repair(ids: np.ndarray, last: np.ndarray, base: int, rounds: int | None = ROUNDS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, which symbols end a document). ``last`` marks the ids that end one."""
    sym, rules, last = ids.astype(np.uint32), np.empty((0, 2), np.uint32), last.copy()
    done, none = 0, np.iinfo(np.int32).max
    # places whose pair may be frequent: one that was rare stays so, since only pairs with a new symbol come up
    live = ~last
    while done != rounds and len(sym) > 1:
        done += 1
        top = base + len(rules)
        live[-1] = False
        place = np.flatnonzero(live)
        key = sym.take(place).astype(np.uint64)
        key <<= np.uint64(24)
        key |= sym.take(place + 1)
        order = np.sort(key)
        cut = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1]))) if len(order) else np.empty(0, np.int64)
        count = np.diff(np.concatenate((cut, [len(order)])))
        often = count >= least
        pair, count = order[cut[often]], count[often]
        if not len(pair) or top + len(pair) >= 1 << 24:
            break
        # rank of each pair: 0 is the most frequent (ties: the smaller pair); none: a large number
        by_rank = np.lexsort((pair, -count))
        rank_of = np.empty(len(pair), np.int32)
        rank_of[by_rank] = np.arange(len(pair), dtype=np.int32)
        # pairs are looked up in a table by hash; of two pairs in one place the later stays, the other waits a round
        table = np.full(1 << _TABLE, -1, np.int32)
        table[_place(pair)] = np.arange(len(pair), dtype=np.int32)
        at = table.take(_place(key).view(np.int64))
        some = np.flatnonzero(at >= 0)
        hit, at, key = place.take(some), at.take(some), key.take(some)
        live[:] = False
        live[hit] = True
        same = np.flatnonzero(pair.take(at) == key)
        hit, mine = hit.take(same), rank_of.take(at.take(same))
        rank = np.full(len(sym) + 1, none, np.int32)
        rank[hit + 1] = mine  # rank[i + 1] is the pair at i; sentinels at both ends
        take = np.flatnonzero((mine < rank.take(hit)) & (mine <= rank.take(hit + 2)))
        where, mine = hit.take(take), mine.take(take)
        # of equal neighbours (a run of one symbol) the comparison takes the first; the next round sees the rest
        used = np.zeros(len(pair), bool)
        used[mine] = True
        chosen = pair[by_rank[used]]
        rules = np.vstack((rules, np.stack((chosen >> np.uint64(24), chosen & np.uint64(0xFFFFFF)), axis=1).astype(np.uint32)))
        sym[where] = (top - 1 + np.cumsum(used)).take(mine)
        last[where] = last[where + 1]
        live[where] = True
        live[where[where > 0] - 1] = True
        keep = np.ones(len(sym), bool)
        keep[where + 1] = False
        kept = np.flatnonzero(keep)
        sym, last, live = sym.take(kept), last.take(kept), live.take(kept)
        live &= ~last
    return sym, rules, last


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all expansions one after the other, start and length of each symbol's, ids below base first)."""
    length = np.ones(base + len(rules), np.int64)
    start = np.arange(base + len(rules), dtype=np.int64)
    flat, done = [np.arange(base, dtype=np.uint32)], 0
    size = base
    while done < len(rules):
        # the rules up to the first that names a symbol not yet expanded
        far = np.flatnonzero((rules[done:] >= base + done).any(axis=1))
        end = done + int(far[0]) if len(far) else len(rules)
        a, b = rules[done:end, 0], rules[done:end, 1]
        have = np.concatenate(flat)
        length[base + done : base + end] = length[a] + length[b]
        both = np.stack((a, b), axis=1).ravel()
        flat = [have, have[ragged(start[both], length[both])]]
        n = length[base + done : base + end]
        start[base + done : base + end] = size + np.cumsum(n) - n
        size += int(n.sum())
        done = end
    return np.concatenate(flat), start, length


def write_block(docs: list, ids: list[bytes], base: int, rounds: int | None = ROUNDS, least: int = LEAST) -> bytes:
    """A block of documents (doc_ids, None only at the end) from their ids as little-endian 16-bit bytes."""
    size = np.array([len(x) // 2 for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), "<u2")
    begin = np.concatenate(([0], np.cumsum(size)))
    last = np.zeros(len(flat), bool)
    last[begin[1:] - 1] = True
    sym, rules, ends = repair(flat, last, base, rounds, least)
    length = expansion_lengths(rules, base)
    offsets = np.concatenate(([0], np.flatnonzero(ends) + 1))
    head = HEAD.pack(MAGIC, base, len(rules), len(docs), docs.count(None), len(sym), len(flat))
    three = np.ascontiguousarray(sym.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3]
    return b"".join((head, rules.astype("<u4").tobytes(), length.astype("<u4").tobytes(), np.array([d or 0 for d in docs], "<i8").tobytes(), offsets.astype("<u4").tobytes(), begin.astype("<u4").tobytes(), three.tobytes()))


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    length = np.ones(base + len(rules), np.int64)
    done = 0
    while done < len(rules):
        far = np.flatnonzero((rules[done:] >= base + done).any(axis=1))
        end = done + int(far[0]) if len(far) else len(rules)
        length[base + done : base + end] = length[rules[done:end, 0]] + length[rules[done:end, 1]]
        done = end
    return length[base:]


class Block:
    """A block read back: ``ids(k)`` and ``ids(k, a, b)`` decode one document or a range of its ids."""

    def __init__(self, blob: bytes):
        magic, self.base, r, d, self.unnamed, s, self.n = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token-id block")
        at = HEAD.size

        def take(kind: str, n: int, width: int) -> np.ndarray:
            nonlocal at
            at += n * width
            return np.frombuffer(blob, kind, n, at - n * width)

        self.rules = take("<u4", 2 * r, 4).reshape(r, 2)
        self.lengths = np.concatenate((np.ones(self.base, np.int64), take("<u4", r, 4).astype(np.int64)))
        self.docs = take("<i8", d, 8)
        self.offsets, self.begin = take("<u4", d + 1, 4).astype(np.int64), take("<u4", d + 1, 4).astype(np.int64)
        three = np.frombuffer(blob, np.uint8, 3 * s, at).reshape(s, 3)
        self.symbols = three[:, 0].astype(np.uint32) | three[:, 1].astype(np.uint32) << 8 | three[:, 2].astype(np.uint32) << 16

    def all_ids(self) -> np.ndarray:
        flat, start, length = expansions(self.rules, self.base)
        return flat[ragged(start[self.symbols], length[self.symbols])]

    def ids(self, k: int, a: int = 0, b: int | None = None) -> np.ndarray:
        sym = self.symbols[self.offsets[k] : self.offsets[k + 1]]
        ends = np.cumsum(self.lengths[sym])
        b = int(ends[-1]) if b is None else min(b, int(ends[-1]))
        if a >= b:
            return np.empty(0, np.uint32)
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left"))
        skip, stack, out = a - int(ends[i] - self.lengths[sym[i]]), sym[i : j + 1][::-1].tolist(), []
        while stack:
            x = stack.pop()
            if x < self.base:
                out.append(x)
            else:
                stack += [int(self.rules[x - self.base, 1]), int(self.rules[x - self.base, 0])]
        return np.array(out[skip : skip + b - a], np.uint32)


def write(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 0, base: int = 1 << 16, rounds: int | None = ROUNDS, least: int = LEAST) -> DataFrame:
    """The documents (doc_id, text) as token-id files: a stored table with one row per block: run, part
    (blocks of a run in order), tokens, payload.

    Documents come in ascending doc_id (rows that share one, and those without one, which come last: by their
    ids). Null and empty texts are the end id alone. Other columns are ignored. ``rounds`` and ``least`` bound the
    grammar, see ``ROUNDS``.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    end = np.array([end_id], "<u2").tobytes()
    cuts = runs(docs)

    def encode(batches):
        enc = encoder(tokenizer, kind, MEMO)
        for b in pieces(batches):
            ids = [enc.encode(t) + end for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([run_of(pc.fill_null(b.column("doc_id"), LAST), cuts), b.column("doc_id"), pa.array(ids, pa.binary())], names=["run", "doc_id", "ids"])

    def blocks(batches):
        run, part, ids, held, names = None, 0, [], 0, []

        def flush():
            blob = write_block(names, ids, base, rounds, least)
            return pa.RecordBatch.from_pydict({"run": pa.array([run], pa.int32()), "part": pa.array([part], pa.int32()), "tokens": pa.array([held], pa.int64()), "payload": pa.array([blob], pa.binary())})

        for b in batches:
            for r, d, x in zip(b.column("run").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if ids and (r != run or held + len(x) // 2 > BLOCK):
                    yield flush()
                    part, ids, held, names = (part + 1 if r == run else 0), [], 0, []
                run = r
                ids.append(x)
                names.append(d)
                held += len(x) // 2
        if ids:
            yield flush()

    coded = docs.mapInArrow(encode, "run int, doc_id long, ids binary")
    placed = coded.repartitionById(len(cuts) + 1, "run").sortWithinPartitions("run", F.col("doc_id").asc_nulls_last(), "ids")
    return stored(placed.mapInArrow(blocks, "run int, part int, tokens long, payload binary"), "token-ids", compression="uncompressed")


def read(files: DataFrame) -> DataFrame:
    """The documents of token-id files: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32, each decoded from the files' blocks."""
    order = Window.orderBy("run", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("run", "part", F.coalesce(F.sum("tokens").over(order), F.lit(0)).cast("long").alias("first"))

    def run(batches):
        for b in batches:
            for blob, first in zip(b.column("payload"), b.column("first").to_pylist(), strict=True):
                block = Block(blob.as_buffer())
                flat = block.all_ids().astype("<u4").view(np.uint8)
                crc = [zlib.crc32(flat[4 * i : 4 * j]) for i, j in zip(block.begin[:-1].tolist(), block.begin[1:].tolist(), strict=True)]
                none = np.arange(len(block.docs)) >= len(block.docs) - block.unnamed
                yield pa.RecordBatch.from_arrays([pa.array(block.docs, mask=none), pa.array(block.begin[:-1] + first), pa.array(np.diff(block.begin)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(small(starts), ["run", "part"]).select("payload", "first")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
