"""Alignment of two tokenizers' tokens over the same text by elementary byte intervals, and corpus-wide counts of linked ids.

The ends of both token sequences cut a text into elementary intervals. Each interval lies in one token of either side, which
is one overlap; where both sides end together a group closes, and the two tokens that end there are linked. All of this is done
for a chunk of texts at once, as texts end on both sides and so never share a group.

Texts are encoded once. What is stored is a row per chunk: the figures of its texts, its distinct linked id pairs with their
counts, and for each link the place of its pair. Pairs are summed over chunks, and totals go back as a row per chunk and
distinct pair, so what is shuffled grows with chunks and vocabulary, not with links.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.llm.common import stored, text_chunks

#: Bytes of text that are aligned and counted together; one longer text is a chunk of its own.
CHUNK = 1 << 20
#: What byte-level vocabularies split a text by before they merge bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Tokens:
    """A tokenizer as this module needs it: a batch of texts to arrays of ids, and the bytes of every id."""

    encode: object
    pieces: list[bytes]

    @functools.cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(p) for p in self.pieces], np.int64)


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies spell bytes that are no printable Latin-1 characters as characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def byte_level(path: str) -> Tokens:
    """A byte-level BPE file (.json, or .tiktoken ranks). Special tokens' strings are ordinary text.

    The merges of a .json file have to make ids in order, as ranks do; any other file is refused.
    """
    import tiktoken

    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    else:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special, letters = {t["id"] for t in model["added_tokens"] if t["special"]}, _byte_of_letter()
        vocab = {t: i for t, i in model["model"]["vocab"].items() if i not in special}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
        if merged != list(range(256, 256 + len(merged))) or model["pre_tokenizer"]["type"] != "ByteLevel" or model["normalizer"]:
            raise ValueError(f"{path}: ids do not follow the merges of a byte-level vocabulary")
    encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    return Tokens(lambda texts: [encoding.encode_to_numpy(" " + t).astype(np.int64) for t in texts], pieces)


@functools.lru_cache(maxsize=4)
def piece_level(path: str) -> Tokens:
    """A sentencepiece file; U+2581 is a space, <0xHH> a byte. It puts a space before a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return Tokens(lambda texts: [np.fromiter(ids, np.int64, len(ids)) for ids in model.encode(texts, num_threads=1)], pieces)


@dataclass
class Aligned:
    """Tokens of both sides, text after text, with offsets of the texts; overlaps and links as token places."""

    a: np.ndarray
    b: np.ndarray
    a_of: np.ndarray
    b_of: np.ndarray
    over_a: np.ndarray
    over_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    @functools.cached_property
    def link_of(self) -> np.ndarray:
        return np.searchsorted(self.link_a, self.a_of)

    @functools.cached_property
    def over_of(self) -> np.ndarray:
        return np.searchsorted(self.over_a, self.a_of)

    def products(self) -> np.ndarray:
        """Pairs of an A and a B token of one group, per text."""
        sizes = np.diff(self.link_a, prepend=-1) * np.diff(self.link_b, prepend=-1)
        total = np.concatenate(([0], np.cumsum(sizes)))
        return total[self.link_of[1:]] - total[self.link_of[:-1]]

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and of the B tokens where each group's A tokens come before its B tokens."""
        n_a, n_b = np.diff(self.link_a, prepend=-1), np.diff(self.link_b, prepend=-1)
        before_b, through_a = np.concatenate(([0], self.link_b[:-1] + 1)) if len(n_a) else n_a, self.link_a + 1
        return np.arange(len(self.a)) + np.repeat(before_b, n_a), np.arange(len(self.b)) + np.repeat(through_a, n_b)


def align(a: Tokens, b: Tokens, texts: list[str | None]) -> Aligned:
    """Texts that are null or empty, or whose tokens of either side don't spell a space and the text, have no tokens."""
    some = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = a.encode([texts[i] for i in some]), b.encode([texts[i] for i in some])
    n_a, n_b, kept_a, kept_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], []
    for i, x, y in zip(some, ids_a, ids_b, strict=True):
        raw = b" " + texts[i].encode()
        if b"".join(map(a.pieces.__getitem__, x.tolist())) == raw and b"".join(map(b.pieces.__getitem__, y.tolist())) == raw:
            n_a[i], n_b[i] = len(x), len(y)
            kept_a.append(x)
            kept_b.append(y)
    x, y = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (kept_a, kept_b))
    ends_a, ends_b = np.cumsum(a.sizes[x]), np.cumsum(b.sizes[y])
    ends = np.union1d(ends_a, ends_b)
    over_a, over_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    both = (ends_a[over_a] == ends) & (ends_b[over_b] == ends) if len(ends) else np.zeros(0, bool)
    offsets = [np.concatenate(([0], np.cumsum(n))) for n in (n_a, n_b)]
    return Aligned(x, y, *offsets, over_a, over_b, over_a[both], over_b[both])


@functools.lru_cache(maxsize=4)
def _spelled(n_a: int, n_b: int) -> list[bytes]:
    """Ids as text with what follows them: A within and at the end of its part of a group, B likewise."""
    return [b"%d%s" % (i, mark) for n, marks in ((n_a, (b",", b"|")), (n_b, (b",", b";"))) for mark in marks for i in range(n)]


def group_hashes(found: Aligned, n_a: int, n_b: int) -> list[str]:
    """sha256 of each text's groups as `a1,a2|b1;a3|b2,b3`; '' for a text without tokens."""
    codes = np.empty(len(found.a) + len(found.b), np.int64)
    code_a, code_b = found.a.copy(), found.b + 2 * n_a
    code_a[found.link_a] += n_a
    code_b[found.link_b] += n_b
    at_a, at_b = found.order()
    codes[at_a], codes[at_b] = code_a, code_b
    spell, of = _spelled(n_a, n_b).__getitem__, found.a_of + found.b_of
    return [hashlib.sha256(b"".join(map(spell, codes[s:e].tolist()))[:-1]).hexdigest() if e > s else "" for s, e in zip(of[:-1].tolist(), of[1:].tolist(), strict=True)]


#: What is known of a text before pairs are counted over the corpus.
_OWN = (("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("n_overlaps", "long"), ("n_products", "long"), ("groups_sha256", "string"))
_REPLIES = "totals array<struct<pair:bigint,total:bigint,best:boolean>>"


def _chunks(path_a: str, path_b: str, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b, made = byte_level(path_a), piece_level(path_b), 0
        for batch in batches:
            for lo, hi, _, _ in text_chunks(batch.column(keys), CHUNK):
                found = align(a, b, batch.column(keys).slice(lo, hi - lo).to_pylist())
                links = np.diff(found.link_of)
                own = [np.diff(found.a_of), np.diff(found.b_of), links, links, np.diff(found.over_of), found.products()]
                columns = [*(c.slice(lo, hi - lo) for c in batch.columns[:keys]), *(pa.array(x, pa.int64()) for x in own), pa.array(group_hashes(found, len(a.pieces), len(b.pieces)), pa.string())]
                docs = pa.StructArray.from_arrays(columns, [*(f"k{i}" for i in range(keys)), *(c for c, _ in _OWN)])
                pairs, place, times = np.unique(found.a[found.link_a] * len(b.pieces) + found.b[found.link_b], return_inverse=True, return_counts=True)
                wide = np.uint16 if len(pairs) <= 1 << 16 else np.uint32
                row = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(TaskContext.get().partitionId() << 32) + made]), row(docs), row(pa.array(pairs, pa.int64())), row(pa.array(times, pa.int64())), pa.array([place.astype(wide).tobytes()], pa.binary())],
                    names=["chunk", "docs", "pairs", "times", "links"],
                )
                made += 1

    return run


def _totals(keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs = batch.column("docs").slice(i, 1).flatten()
                told, links = batch.column("totals").slice(i, 1).flatten(), batch.column("links")[i].as_py()
                place = np.frombuffer(links, np.uint16 if len(told) <= 1 << 16 else np.uint32)
                of = np.concatenate(([0], np.cumsum(docs.field("n_links").to_numpy())))
                sums = []
                for values in (told.field("best").cast(pa.int64()), told.field("total")):
                    run_ = np.concatenate(([0], np.cumsum(values.to_numpy()[place]))) if len(place) else np.zeros(1, np.int64)
                    sums.append(pa.array(run_[of[1:]] - run_[of[:-1]], pa.int64()))
                names = [*(f"k{j}" for j in range(keys)), *(c for c, _ in _OWN)]
                yield pa.RecordBatch.from_arrays([*(docs.field(c) for c in names), *sums], names=[*names, "n_best", "count_sum"])

    return run


def pair_totals(chunks: DataFrame, n_b: int) -> DataFrame:
    """(pair, total, best): links of each id pair (a * n_b + b) over the corpus, and whether no pair of its B id has more."""
    counts = chunks.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("total"))
    most = F.max("total").over(W.partitionBy(F.col("pair") % n_b))  # as many rows as A has ids at most
    return counts.select("pair", "total", (F.col("total") == most).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, n_a, n_b, n_groups, n_links, n_overlaps, n_products, groups_sha256, n_best, count_sum) for every row of docs.

    A is a byte-level file, B a sentencepiece file, at paths that every executor has. Null, empty and unspellable texts have
    zeros and an empty hash. Null keys and repeated rows have a row each, and repeated rows count as often as they come. Very
    long texts are one chunk. No rows give no rows.
    """
    n_b = len(piece_level(path_b).pieces)
    kinds = [docs.schema[k].dataType.simpleString() for k in keys]
    shape = ",".join([*(f"k{i}:{kind}" for i, kind in enumerate(kinds)), *(f"{c}:{k}" for c, k in _OWN)])
    slim = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("text"))
    chunks = stored(slim.mapInArrow(_chunks(path_a, path_b, len(keys)), f"chunk long, docs array<struct<{shape}>>, pairs array<long>, times array<long>, links binary"))
    asked = chunks.select("chunk", F.explode("pairs").alias("pair"))
    told = asked.join(pair_totals(chunks, n_b), "pair").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("pair", "total", "best"))).alias("totals"))
    both = chunks.select("chunk", "docs", "links").join(told, "chunk", "left").select("docs", "links", F.coalesce("totals", F.array().cast(_REPLIES.split(" ", 1)[1])).alias("totals"))
    fields = ", ".join([*(f"k{i} {kind}" for i, kind in enumerate(kinds)), *(f"{c} {k}" for c, k in _OWN), "n_best long, count_sum long"])
    return both.mapInArrow(_totals(len(keys)), fields).withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})


def aligned_groups(docs: DataFrame, path_a: str, path_b: str, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, groups array<struct<a array<int>, b array<int>, end long>>): each text's groups with their end in bytes of space + text."""
    kinds = [docs.schema[k].dataType.simpleString() for k in keys]
    group = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), piece_level(path_b)
        for batch in batches:
            for lo, hi, _, _ in text_chunks(batch.column(len(keys)), CHUNK):
                found, out = align(a, b, batch.column(len(keys)).slice(lo, hi - lo).to_pylist()), []
                for d in range(hi - lo):
                    at_a, at_b, end, groups = found.a_of[d], found.b_of[d], 0, []
                    for i, j in zip(found.link_a[found.link_of[d] : found.link_of[d + 1]], found.link_b[found.link_of[d] : found.link_of[d + 1]], strict=True):
                        end += int(a.sizes[found.a[at_a : i + 1]].sum())
                        groups.append({"a": found.a[at_a : i + 1].tolist(), "b": found.b[at_b : j + 1].tolist(), "end": end})
                        at_a, at_b = i + 1, j + 1
                    out.append(groups)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[: len(keys)]), pa.array(out, group)], names=[*(f"k{i}" for i in range(len(keys))), "groups"])

    slim = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("text"))
    fields = ", ".join([*(f"k{i} {kind}" for i, kind in enumerate(kinds)), "groups array<struct<a:array<int>,b:array<int>,end:bigint>>"])
    return slim.mapInArrow(run, fields).withColumnsRenamed({f"k{i}": k for i, k in enumerate(keys)})
