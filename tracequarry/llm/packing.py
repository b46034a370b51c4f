"""Problem 9: documents into containers of fixed capacity, along a space-filling curve.

Each document's tokens are hashed into a vector, projected to three dimensions and put
on a Hilbert curve; the corpus is range-sorted by that key (ties, such as exact copies,
by doc_id, so a hot key is split). Every range is packed on its own: a window of
neighbours along the curve is placed largest first, each piece into the open container
where it leaves least space; open containers go on to the next window.

Defined results
* a text of more tokens than the capacity is divided into full pieces and a rest; no
  other text is divided;
* an empty text is one piece of 0 tokens; a null text is no item and is left out;
* containers are named by spec and their first piece, so names are unique in the corpus;
* specs with a null or non-positive capacity get no containers; repeated spec rows count once,
  and of several capacities of one spec the least counts, as its pieces then fit all of them;
* containers do not span ranges of the curve, so which pieces meet (but not which pieces
  there are) depends on the number of ranges; each range leaves its last containers part empty.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.tokens import TOKENIZERS, shipped, tokenizer
from tracequarry.session import cut_lineage

#: Hashed dimensions, curve dimensions, bits of each.
HASHED, DIMENSIONS, BITS = 64, 3, 10
#: Neighbours placed together, and containers that stay open between windows (the fullest are closed first).
WINDOW, OPEN = 4096, 512
#: Specs are configuration; more rows than this are refused.
MAX_SPECS = 1000
SCHEMA = "spec_id int, container_id string, doc_id bigint, piece_no int, start_token int, n_tokens int"


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, d), each coordinate below 2 ** bits."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ (a >> np.uint64(31))


def curve_points(token_lists: list[np.ndarray]) -> np.ndarray:
    """Token bags, hashed with signs, projected to DIMENSIONS and put on a grid."""
    signs = np.where(_mix(np.arange(HASHED * DIMENSIONS)) & np.uint64(1 << 40), 1.0, -1.0).reshape(HASHED, DIMENSIONS)
    vectors = np.zeros((len(token_lists), HASHED))
    for row, tokens in enumerate(token_lists):
        if len(tokens):
            h = _mix(tokens)
            slot = ((h >> np.uint64(20)) % np.uint64(HASHED)).astype(np.int64)
            vectors[row] = np.bincount(slot, np.where(h & np.uint64(1 << 50), 1.0, -1.0), HASHED)
            norm = np.linalg.norm(vectors[row])
            vectors[row] /= norm or 1.0
    flat = np.tanh(vectors @ signs / np.sqrt(DIMENSIONS))
    return np.clip(((flat + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def sized_documents(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens, curve) of every text that is not null."""
    path = shipped(documents.sparkSession, tokenizers)

    def size(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path)
        for batch in batches:
            ids = [np.asarray(own.encode(t), dtype=np.int64) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": np.array([len(x) for x in ids], dtype=np.int32), "curve": hilbert_keys(curve_points(ids)) if ids else np.zeros(0, np.int64)})

    return documents.where("text is not null").select("doc_id", "text").mapInPandas(size, "doc_id bigint, n_tokens int, curve bigint")


class Packer:
    """Best fit, largest first, over windows of neighbours; one spec, one range of the curve."""

    def __init__(self, spec_id: int, capacity: int):
        self.spec_id, self.capacity = spec_id, capacity
        self.space: list[tuple[int, str]] = []  # of the open containers, ascending

    def _name(self, doc_id: int, piece: int) -> str:
        return f"{self.spec_id}:{doc_id}:{piece}"

    def place(self, docs: np.ndarray, sizes: np.ndarray) -> list[tuple]:
        out, rest = [], []
        for doc, n in zip(docs.tolist(), sizes.tolist()):
            full = n // self.capacity if n > self.capacity else 0
            for k in range(full):
                out.append((self.spec_id, self._name(doc, k), doc, k, k * self.capacity, self.capacity))
            if n - full * self.capacity or not full:
                rest.append((n - full * self.capacity, doc, full))
        for n, doc, k in sorted(rest, key=lambda x: -x[0]):
            at = bisect.bisect_left(self.space, (n, ""))
            if at < len(self.space):
                left, name = self.space.pop(at)
            else:
                left, name = self.capacity, self._name(doc, k)
            out.append((self.spec_id, name, doc, k, k * self.capacity, n))
            if left > n:
                bisect.insort(self.space, (left - n, name))
        if len(self.space) > OPEN:
            self.space = self.space[-OPEN:]
        return out


def containers(documents: DataFrame, pack_spec: DataFrame, tokenizers: str = TOKENIZERS, window: int = WINDOW) -> DataFrame:
    """(spec_id, container_id, doc_id, piece_no, start_token, n_tokens): each piece and its container."""
    rows = pack_spec.where("spec_id is not null and capacity_tokens > 0").groupBy("spec_id").agg(F.min("capacity_tokens").alias("c")).orderBy("spec_id").limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} container specs")
    specs = [(int(r.spec_id), int(r.c)) for r in rows]
    # three small numbers a document; written once, as range partitioning reads its input twice
    sized = cut_lineage(sized_documents(documents, tokenizers))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packers = [Packer(*s) for s in specs]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def placed(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            docs = np.concatenate([b["doc_id"].to_numpy() for b in held])
            sizes = np.concatenate([b["n_tokens"].to_numpy() for b in held])
            for low in range(0, len(docs), window):
                for p in packers:
                    yield pd.DataFrame(p.place(docs[low : low + window], sizes[low : low + window]), columns=names)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= window:
                yield from placed(held)
                held, n = [], 0
        if held:
            yield from placed(held)

    ordered = sized.where("doc_id is not null").repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    return ordered.mapInPandas(pack, SCHEMA)


def container_fill(packed: DataFrame, pack_spec: DataFrame) -> DataFrame:
    """(spec_id, n_containers, n_pieces, used_tokens, unused_share) of each spec."""
    totals = packed.groupBy("spec_id").agg(F.count_distinct("container_id").alias("n_containers"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("used_tokens"))
    capacity = pack_spec.where("capacity_tokens > 0").groupBy("spec_id").agg(F.min("capacity_tokens").alias("c"))
    return totals.join(capacity, "spec_id").select("spec_id", "n_containers", "n_pieces", "used_tokens", (1 - F.col("used_tokens") / (F.col("n_containers") * F.col("c"))).alias("unused_share"))


def packing_faults(packed: DataFrame, pack_spec: DataFrame) -> DataFrame:
    """(spec_id, n_documents, n_overfull, n_divided): documents packed, containers beyond their capacity, and documents divided though they fit."""
    capacity = F.broadcast(pack_spec.where("capacity_tokens > 0").groupBy("spec_id").agg(F.min("capacity_tokens").alias("c")).limit(MAX_SPECS))  # their number is checked where they are packed
    over = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(capacity, "spec_id").groupBy("spec_id").agg(F.count_if(F.col("n") > F.col("c")).alias("n_overfull"))
    docs = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).join(capacity, "spec_id")
    return docs.groupBy("spec_id").agg(F.count("*").alias("n_documents"), F.count_if((F.col("k") > 1) & (F.col("n") <= F.col("c"))).alias("n_divided")).join(over, "spec_id").select("spec_id", "n_documents", "n_overfull", "n_divided")
