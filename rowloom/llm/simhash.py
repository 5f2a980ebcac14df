"""SimHash near-duplicates with Golay-code keys.

Fingerprints (64 bits, majority vote of XXH64 shingle hashes) link at MOST_BITS or fewer differing bits. Candidate search
splits a fingerprint into three segments A, B, C of 22, 22 and 20 bits. Four errors over three segments leave either a
segment without an error, so its bits are a key, or two segments with exactly one error each. For those, one segment is
decoded in the binary Golay code (23,12,7): a word within one bit of another either has the same nearest codeword, or
both lie three bits from theirs and the other's codeword is one of the five next at distance four. The index of the
nearest codeword is the stored key, those of the up to six nearby codewords are the probes. The other segment is cut in
halves, one of which is free of error and completes the key. So no link is missed.

The stage that drops near-duplicates (five words, similarity 0.8) works on distinct shingles and four words of 64 bits, each
from other hashes. Texts of similarity 0.8 differ in about 15 of 100 bits, so links are WIDE_BITS of the 256 or fewer, and keys
have to stand more errors. Within a word each two segments are decoded to all codewords within four bits (one, or six), and
a key is the nearest codeword of one with any near codeword of the other. A pair needs one of twelve such keys in common.
README has the share of pairs found by their similarity.

Keys are dealt to tasks and sorted; within a key's rows candidates are compared as vectors, verified on all 64 bits, and
only links between fingerprints that earlier links have not joined yet go out, so a dense group of m fingerprints gives
fewer than m links, not m squared. Fingerprints of exact copies are merged before any of this.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import broadcast_if_small, connected_components, cut, lower_ascii, mix64, text_chunks, with_floor, words_of

MOST_BITS, SHINGLE, SEED = 4, 4, 42
#: Of the stage: words of a shingle, 64-bit words of a fingerprint, most differing bits of all of them. At similarity 0.8 pairs differ
#: in 39 bits with deviation 5.7, at 0.7 in 49.
WIDE_SHINGLE, WIDE_WORDS, WIDE_BITS = 5, 4, 48
WIDE = ["fp", "f1", "f2", "f3"]
#: (low bit, width) of the segments.
SEGMENTS = ((0, 22), (22, 22), (44, 20))
#: Pairs for two segments with one error each: (decoded segment, segment cut in halves).
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator polynomial of the (23,12) Golay code.
GENERATOR = 0b101011100011


def shingle_hashes(words: bytes, starts: list[int], ends: list[int], shingle: int = SHINGLE) -> np.ndarray:
    """Of single-spaced lower-case bytes and their words, one at least."""
    n = max(1, len(starts) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(words[s:e], SEED) for s, e in zip(starts[:n], ends[min(shingle, len(ends)) - 1 :], strict=True)], np.uint64)


def text_fingerprint(words: bytes, starts: list[int], ends: list[int]) -> int:
    """No word: 0."""
    return majority(shingle_hashes(words, starts, ends)) if starts else 0


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """A majority vote of the distinct hashes, mixed anew, for each word."""
    some = np.unique(hashes)
    return [majority(mix64(some + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) for k in range(WIDE_WORDS)]


def text_sketch(hashes: np.ndarray) -> int:
    """For an estimate of similarity beside the links: one bit of the least hash in each of 64 bins, of which (1 - similarity) / 2
    differ; an empty bin takes the next bin's that isn't."""
    ordered = np.sort(hashes)
    first = np.searchsorted(ordered >> np.uint64(58), np.arange(64, dtype=np.uint64))
    least = ordered[first % len(ordered)]  # past an empty bin comes the next one's, round the end
    bits = mix64(least ^ (np.arange(64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(63)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        votes += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((WIDE_WORDS if wide else 1, batch.num_rows), np.uint64)
            for lo, hi, raw, offsets in text_chunks(batch.column(batch.num_columns - 1)):
                raw = lower_ascii(raw)
                starts, ends, rows = words_of(raw, offsets)
                lengths = ends - starts
                # the words once more, one space after each, so that a shingle is one slice
                new = np.cumsum(lengths + 1) - (lengths + 1)
                joined = np.full(int(lengths.sum()) + len(starts), 0x20, np.uint8)
                place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                joined[np.repeat(new, lengths) + place] = raw[np.repeat(starts, lengths) + place]
                words, first = joined.tobytes(), np.searchsorted(rows, np.arange(hi - lo + 1))
                new, end = new.tolist(), (new + lengths).tolist()
                for r in range(hi - lo):
                    a, b = first[r], first[r + 1]
                    if a < b:
                        hashes = shingle_hashes(words, new[a:b], end[a:b], shingle)
                        out[:, lo + r] = wide_fingerprint(hashes) if wide else majority(hashes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x.view(np.int64)) for x in out)], [*batch.schema.names[:-1], *WIDE[: len(out)]])

    return run


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = SHINGLE, wide: bool = False) -> DataFrame:
    """The columns of keep and fp (the 64 bits as a long; if wide, four of other hashes) of every row, over whole texts; null counts as empty: 0."""
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    return slim.mapInArrow(_fingerprints(shingle, wide), ", ".join([*kinds, *(f"{c} bigint" for c in (WIDE if wide else WIDE[:1]))]))


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each syndrome (11 bits): the error pattern of its nearest codeword, and, where that has weight three, the five
    patterns of weight four (else repeats of the nearest); and the syndrome of each 23-bit word's byte-wise parts."""
    words = np.arange(1 << 23, dtype=np.uint32)
    syndromes = words.copy()
    for bit in range(22, 10, -1):
        high = (syndromes >> np.uint32(bit)) & np.uint32(1)
        syndromes ^= high * np.uint32(GENERATOR << (bit - 11))
    weights = np.bitwise_count(words)
    nearest = np.zeros(1 << 11, np.uint32)
    few = words[weights <= 3]
    nearest[syndromes[few]] = few
    others = np.repeat(nearest[:, None], 5, axis=1)
    four = words[weights == 4]
    four = four[np.argsort(syndromes[four], kind="stable")]
    keys = syndromes[four]
    place = np.arange(len(four)) - np.searchsorted(keys, keys)
    deep = np.bitwise_count(nearest[keys]) == 3
    others[keys[deep], place[deep]] = four[deep]
    return nearest, others, syndromes.astype(np.uint16)


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: index of the nearest codeword, and of the five next where it is three bits away (else its own again)."""
    nearest, others, syndromes = golay()
    words = words.astype(np.uint32)
    s = syndromes[words]
    return (words ^ nearest[s]) >> np.uint32(11), (words[:, None] ^ others[s]) >> np.uint32(11)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, key, stored): all keys of each fingerprint; a link has a key in common that one of the two stores."""
    fps = fps.view(np.uint64)
    parts = [(fps >> np.uint64(lo)) & np.uint64((1 << n) - 1) for lo, n in SEGMENTS]
    every = np.arange(len(fps))
    out = [(every, parts[i] | np.uint64(i << 40), np.ones(len(fps), bool)) for i in range(3)]
    kind = 3
    for fuzzy, halved in PAIRS:
        near, more = golay_keys(parts[fuzzy])
        half = SEGMENTS[halved][1] // 2
        for side in (parts[halved] & np.uint64((1 << half) - 1), parts[halved] >> np.uint64(half)):
            tag = (side << np.uint64(12)) | np.uint64(kind << 40)
            out.append((every, tag | near.astype(np.uint64), np.ones(len(fps), bool)))
            deep = np.flatnonzero(more[:, 0] != near)
            out.append((np.repeat(deep, 5), np.repeat(tag[deep], 5) | more[deep].reshape(-1).astype(np.uint64), np.zeros(5 * len(deep), bool)))
            kind += 1
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def wide_keys_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) of rows of four words: for each word and two of its segments, the codeword nearest to one with every codeword near
    the other."""
    out = []
    for w in range(words.shape[1]):
        near = []
        for lo, n in SEGMENTS:
            nearest, more = golay_keys((words[:, w].view(np.uint64) >> np.uint64(lo)) & np.uint64((1 << n) - 1))
            near.append((np.column_stack([nearest, more]).astype(np.uint64), more[:, 0] != nearest))
        for kind, (i, j) in enumerate(PAIRS):
            (a, many_a), (b, many_b) = near[i], near[j]
            tag = np.uint64((w * len(PAIRS) + kind) << 40)
            for x, y in [(0, y) for y in range(6)] + [(x, 0) for x in range(1, 6)]:
                rows = np.flatnonzero((many_a if x else True) & (many_b if y else True) & np.ones(len(words), bool))
                out.append((rows, (a[rows, x] << np.uint64(12)) | b[rows, y] | tag))
    return tuple(np.concatenate([x[k] for x in out]) for k in (0, 1))


def _columns(batch, names: list[str]) -> np.ndarray:
    """A row of 64-bit words for each row of an Arrow batch or table."""
    return np.column_stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy(), np.int64) for c in names])


def _explode_keys(wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = _columns(batch, batch.schema.names)
            for at in range(0, len(words), 1 << 13):
                part = words[at : at + (1 << 13)]
                rows, keys, *stored = wide_keys_of(part) if wide else keys_of(part[:, 0].copy())
                kept = [c.take(pa.array(rows + at)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *kept, *map(pa.array, stored)], ["key", *batch.schema.names, *["stored"] * len(stored)])

    return run


def node_of(words: np.ndarray) -> np.ndarray:
    """What stands for a text in the graph of links: its fingerprint of one word, or a hash of all four."""
    out = np.ascontiguousarray(words[:, 0]).view(np.uint64)
    for k in range(1, words.shape[1]):
        out = mix64(np.ascontiguousarray(words[:, k]).view(np.uint64) ^ mix64(out + np.uint64(k)))
    return out.view(np.int64)


def links_in_groups(keys: np.ndarray, fps: np.ndarray, stored: np.ndarray, most_bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal key (sorted by key) with a stored one at either end, without those that others imply. fps: a
    fingerprint, or a row of several words, for each."""
    words = np.ascontiguousarray(fps.reshape(len(keys), -1))
    distinct, nodes = np.unique(node_of(words), return_inverse=True)
    label = np.arange(len(distinct))
    parent = label.tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    bits, a_out, b_out = words.view(np.uint64), [], []

    def close(x: np.ndarray, y) -> np.ndarray:
        return np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int32) <= most_bits

    def link(x: int, y: int) -> None:
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            a_out.append(x)
            b_out.append(y)

    def settled() -> np.ndarray:
        up = np.array(parent)
        while ((higher := up[up]) != up).any():
            up = higher
        parent[:] = up.tolist()
        return up

    # rows against those 1, 2, ... places on in their group: all of a small group, and the nearest of a large one
    active = np.arange(len(keys) - 1)
    for step in range(1, NEAR_ROWS + 1):
        active = active[active + step < len(keys)]
        active = active[keys[active] == keys[active + step]]
        if not len(active):
            break
        near = (stored[active] | stored[active + step]) & (label[nodes[active]] != label[nodes[active + step]])
        i = active[near]
        i = i[close(i, i + step)]
        if len(i):
            for x, y in zip(nodes[i].tolist(), nodes[i + step].tolist(), strict=True):
                link(x, y)
            label = settled()
    # a large group has mostly one label by now: only rows of other labels still meet all rows
    for key in np.unique(keys[active]) if len(active) else ():
        lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
        own, lab = nodes[lo:hi], label[nodes[lo:hi]]
        names, sizes = np.unique(lab, return_counts=True)
        for x in np.flatnonzero(lab != names[sizes.argmax()]):
            other = (lab != lab[x]) & (stored[lo:hi] | stored[lo + x])
            hit = np.flatnonzero(other)
            hit = hit[close(lo + hit, lo + x)]
            if len(hit):
                for y in hit[np.unique(lab[hit], return_index=True)[1]].tolist():
                    link(int(own[x]), int(own[y]))
                met = np.append(lab[hit], lab[x])
                lab[np.isin(lab, met)] = met.min()
        label = settled()
    return distinct[np.array(a_out, np.int64)], distinct[np.array(b_out, np.int64)]


def _link(wide: bool):
    """Rows come sorted by key. Whole groups are handled about LINK_ROWS at a time; a group that goes on waits for its end."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        keys = rows.column("key").to_numpy()
        stored = np.ones(len(keys), bool) if wide else rows.column("stored").to_numpy()
        a, b = links_in_groups(keys, _columns(rows, WIDE if wide else WIDE[:1]), stored, WIDE_BITS if wide else MOST_BITS)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        waiting = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            waiting += batch.num_rows
            if waiting < LINK_ROWS:
                continue
            rows = pa.concat_tables(held).combine_chunks()
            keys = rows.column("key").to_numpy()
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield links(rows.slice(0, end))
            held, waiting = [rows.slice(end)], len(keys) - end
        if waiting:
            yield links(pa.concat_tables(held).combine_chunks())

    return run


LINK_ROWS = 1 << 18
#: Rows of a task that compares them.
TASK_ROWS = 1 << 21
#: Places on in a group that rows are compared with before what has one label by then is passed over.
NEAR_ROWS = 64


def fingerprint_links(distinct: DataFrame, wide: bool = False) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all within MOST_BITS of each other.

    wide: between distinct fingerprints of four words, named by node_of, that differ in WIDE_BITS or fewer and share a key.
    """
    words = WIDE if wide else WIDE[:1]
    keyed = distinct.select(*words).mapInArrow(_explode_keys(wide), ", ".join(["key bigint", *(f"{c} bigint" for c in words), *["stored boolean"] * (not wide)]))
    rows = distinct.count() * (120 if wide else 40)  # about as many keys have they
    dealt = keyed.repartition(with_floor(distinct, rows // TASK_ROWS + 1), "key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_link(wide), "a bigint, b bigint")


def fingerprint_components(distinct: DataFrame) -> DataFrame:
    """(fp, root) for fingerprints with a link: root is the smallest fingerprint of the component."""
    return connected_components(fingerprint_links(distinct)).select(F.col("node").alias("fp"), F.col("label").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable over links, its own included.

    Null and empty texts have fingerprint 0 and link like others. Null ids take no part in a minimum (a component of
    null ids only has a null one). Repeated rows each keep a row. An empty table gives an empty one.
    """
    marked = cut(fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), ["id"]))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    return _with_component(marked, distinct, "fp", fingerprint_components(distinct)).select(F.col("id").alias(id_col), "fp", "component_id")


def _with_component(marked: DataFrame, distinct: DataFrame, node: str, roots: DataFrame) -> DataFrame:
    """marked with component_id, the least id of the nodes that roots (node, root) puts together; others are by themselves."""
    linked = distinct.join(roots, node)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    members = linked.join(least, "root").select(node, "component_id")
    # a table of its own, so that the join of all rows is one of two plain exchanges, which Spark splits where a fingerprint is hot
    groups = cut(distinct.join(members, node, "left").select(node, F.coalesce("component_id", "least").alias("component_id")))
    return marked.join(groups, node, "left")


def _add_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node_of(_columns(batch, WIDE)))], [*batch.schema.names, "node"])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component kept: the one of the smallest id (of repeated ids, the one whose row hashes least).

    Texts are near-duplicates by their shingles of WIDE_SHINGLE words, as the module says. Rows without a word all share
    fingerprint 0, so one of them is kept. Null ids come after all others. Columns as in docs, whatever their names; an
    empty table stays empty.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.xxhash64(*columns)
    # an id and the hash of its row name a row up to exact repeats, of which one is kept
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), row.alias("row"), F.col(f"`{text_col}`").alias("text"))
    marked = cut(fingerprints(slim, ["id", "row"], shingle=WIDE_SHINGLE, wide=True))
    id_kind = docs.schema[id_col].dataType.simpleString()
    distinct = cut(marked.groupBy(*WIDE).agg(F.min("id").alias("least")).mapInArrow(_add_nodes, ", ".join([*(f"{c} bigint" for c in WIDE), f"least {id_kind}", "node bigint"])))
    roots = connected_components(fingerprint_links(distinct, wide=True)).select("node", F.col("label").alias("root"))
    grouped = _with_component(marked.join(distinct.select(*WIDE, "node"), WIDE), distinct, "node", roots)
    kept = grouped.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component_id", "row").agg(F.count("*").alias("n"))
    kept = cut(kept.groupBy("component_id").agg(F.min_by(F.struct("row", "n"), "row").alias("k")).select(F.col("component_id").alias("kept_id"), F.col("k.row").alias("kept_row"), F.col("k.n").alias("n")))
    tagged = docs.select(F.struct(*columns).alias("all"), F.col(f"`{id_col}`").alias("id"), row.alias("row"))
    chosen = broadcast_if_small(kept.select("kept_id", "kept_row"), F.octet_length(F.coalesce(F.col("kept_id").cast("string"), F.lit(""))) + 24)  # else texts move
    out = tagged.join(chosen, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("row") == F.col("kept_row")), "left_semi")
    if not kept.where("n > 1").isEmpty():
        out = out.dropDuplicates(["id", "row"])  # rows equal in all columns
    return out.select(*[F.col(f"all.`{c}`").alias(c) for c in docs.columns])
