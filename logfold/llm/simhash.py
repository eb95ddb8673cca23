"""SimHash near-duplicate detection with a bit-sliced comparison.

1. Each text gets a 64-bit fingerprint of its word shingles (Arrow batches, numpy).
2. Equal fingerprints fold into one row. Two fingerprints within ``radius`` bits agree on ``agree`` of ``blocks``
   blocks whenever ``blocks - radius >= agree``, so each fingerprint goes to one bucket per choice of blocks.
   This loses no link.
3. A bucket's fingerprints stand as vertical bit planes, 64 to a machine word. One fingerprint is compared with a
   whole word of others at a time: the XOR of each plane is added to carry-save counters, which start so that
   exceeding the radius overflows them; a block whose members all overflowed is abandoned.
   The fingerprints of a bucket over ``bucket_limit`` get finer keys from the bits left open, which loses no link either.
4. A bucket returns a star per linked set, not its pairs. Stars meet in a distributed contraction.

``similar_documents`` links at an exact Jaccard similarity. It compares the fingerprints of the shingle sets in the same way,
checks what they link by the sets themselves, and joins the sets by prefixes for the links that lie further apart in bits.

Defined results: null and empty texts (and those of white space) have fingerprint zero and are linked like any other;
rows that share a doc_id each return a row; a null doc_id never names a component unless all its members are null.
An empty table returns no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LOWER, UPPER, arrow_rows, cut, drop, release, row_key, schema_with, without

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: LOW[n] has the n lowest bits set.
_LOW = np.array([(1 << n) - 1 for n in range(65)], dtype=np.uint64)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: bytes, words_per_shingle: int, n_words: int = 1) -> bytes:
    """The fingerprint of one UTF-8 text: ``n_words`` times 64 bits, the lowest first.

    Further words come from further mixes of the shingles' hashes.
    """
    return _fingerprint(_hashes(text, words_per_shingle), n_words)


def _hashes(text: bytes, words_per_shingle: int) -> np.ndarray:
    """The hashes of one UTF-8 text's word shingles, repeats included.

    ``bytes.split`` parts at exactly the six ASCII white-space characters.
    """
    import xxhash

    words = text.translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    k = words_per_shingle
    grams = [b" ".join(words)] if len(words) <= k else list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(grams))


def _fingerprint(hashes: np.ndarray, n_words: int = 1) -> bytes:
    """The bits set in over half of the hashes; zero for none."""
    ones = np.zeros(64 * n_words, np.int64)
    for at in range(0, len(hashes), 4080):  # whole texts, a slice of memory
        mixed = np.stack([_mix(hashes[at : at + 4080], i) for i in range(n_words)], axis=1)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):  # sums of at most 255 ones fit a byte
            ones += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def _mix(hashes: np.ndarray, turn: int) -> np.ndarray:
    """The hashes themselves, or another 64 bits of each by multiplying and folding."""
    for _ in range(turn):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = hashes ^ (hashes >> np.uint64(29))
    return hashes


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 3, n_words: int = 1) -> DataFrame:
    """``doc_id, row, fp``, one row per input row. row: hash of id and text; fp: a signed long, or the bytes of several words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            out = [simhash(t.as_py() or b"", words_per_shingle, n_words) for t in texts]
            fps = pa.array(np.frombuffer(b"".join(out), np.int64)) if n_words == 1 else pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["doc_id", "row", "fp"])

    picked = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, schema_with(picked.select("doc_id", "row"), "fp long" if n_words == 1 else "fp binary"))


def block_masks(blocks: int, agree: int, positions: list[int] | None = None) -> list[int]:
    """The bits that each choice of ``agree`` of ``blocks`` near-equal blocks covers, of all 64 or of some positions."""
    positions = list(range(64)) if positions is None else positions
    whole = [sum(1 << p for p in positions[len(positions) * i // blocks : len(positions) * (i + 1) // blocks]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(whole, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(fps: np.ndarray, starts: np.ndarray, radius: int, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of the pairs within ``radius`` bits, among fingerprints of the same bucket.

    ``fps``: a 64-bit word each, or a row of several. ``starts``: where each bucket starts; a bucket is a run of neighbours.
    """
    n = len(fps)
    words = np.ascontiguousarray(fps).reshape(n, -1)
    width = 64 * words.shape[1]
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    tiles = (n + 63) // 64
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    planes = np.zeros((width, tiles * 8), np.uint8)
    planes[:, : (n + 7) // 8] = np.packbits(bits, axis=0, bitorder="little").T
    planes = planes.view(np.uint64)
    own = np.arange(n)
    spans = (ends - 1) // 64 - own // 64 + 1
    query = np.repeat(own, spans)
    tile = query // 64 + (np.arange(len(query)) - np.repeat(np.cumsum(spans) - spans, spans))
    low = np.clip(query + 1 - 64 * tile, 0, 64)
    high = np.clip(ends[query] - 64 * tile, 0, 64)
    wanted = _LOW[high] & ~_LOW[low]
    keep = wanted != 0
    query, tile, wanted = query[keep], tile[keep], wanted[keep]
    size = max(1, radius.bit_length())
    first = (1 << size) - 1 - radius
    found_i, found_j = [], []
    for at in range(0, len(query), chunk):
        q, t, dead = query[at : at + chunk], tile[at : at + chunk], ~wanted[at : at + chunk]
        mine = words[q]
        counters = [np.full(len(q), _ONES if first >> j & 1 else 0, np.uint64) for j in range(size)]
        for b in range(width):
            carry = planes[b][t] ^ (np.uint64(0) - (mine[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)))
            for c in counters:
                held = c & carry
                c ^= carry
                carry = held
            dead |= carry
            if b % 8 == 7:
                alive = dead != _ONES
                if not alive.any():
                    break
                if alive.mean() < 0.7:
                    q, t, dead, mine = q[alive], t[alive], dead[alive], mine[alive]
                    counters = [c[alive] for c in counters]
        else:
            hit = np.nonzero(dead != _ONES)[0]
            which, bit = np.nonzero(np.unpackbits((~dead[hit]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            found_i.append(q[hit][which])
            found_j.append(64 * t[hit][which] + bit)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found_i) if found_i else empty), (np.concatenate(found_j) if found_j else empty)


def stars(buckets: np.ndarray, fps: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by bucket: each linked node with a representative of its linked set in the bucket."""
    starts = np.nonzero(np.append(True, buckets[1:] != buckets[:-1]))[0]
    sizes = np.diff(np.append(starts, len(buckets)))
    many = np.repeat(sizes > 1, sizes)
    if not many.any():
        return nodes[:0], nodes[:0]
    buckets, fps, nodes = buckets[many], fps[many], nodes[many]
    i, j = linked(fps, np.nonzero(np.append(True, buckets[1:] != buckets[:-1]))[0], radius)
    label = np.arange(len(fps))
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    member = label != np.arange(len(fps))
    return nodes[member], nodes[label[member]]


def _compared(rows: DataFrame, radius: int, heads: bool = False) -> DataFrame:
    """``u, v``: stars of the linked nodes within the buckets of ``rows`` (bucket, node, fp: the words as bytes).

    With ``heads`` and a further column ``origin``, rows ``origin, node, fp`` of one node of each linked set as well,
    with u and v null.
    """
    names = ["u", "v", *(["origin", "node", "fp"] if heads else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(b, n, f, *origin):
            u, v = stars(b, f, n, radius)
            stay = ~np.isin(n, u) if heads else np.zeros(0, bool)
            k = int(stay.sum())
            none = lambda size, kind: pa.nulls(size, kind)
            columns = [pa.concat_arrays([pa.array(x), none(k, pa.int64())]) for x in (u, v)]
            if heads:
                own = [pa.array(origin[0][stay]), pa.array(n[stay]), pa.array([x.tobytes() for x in f[stay]], pa.binary())]
                columns += [pa.concat_arrays([none(len(u), x.type), x]) for x in own]
            return pa.RecordBatch.from_arrays(columns, names=names)

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            b, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            f = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(len(b), -1)
            new = [b, n, f, *([batch.column(3).to_numpy(zero_copy_only=False)] if heads else [])]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            done = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on in the next batch
            if done:
                yield out(*(x[:done] for x in held))
                held = [x[done:] for x in held]
        if held is not None:
            yield out(*held)

    ordered = rows.select("bucket", "node", "fp", *(["origin"] if heads else [])).repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, "u long, v long" + (", origin long, node long, fp binary" if heads else ""))


def _large(rows: DataFrame, limit: int) -> DataFrame:
    return cut(rows.groupBy("bucket").count().where(F.col("count") > limit), "buckets")


def links(distinct_fps: DataFrame, radius: int, blocks: int, agree: int, bucket_limit: int = 8192) -> DataFrame:
    """``u, v``: pairs of linked fingerprints (column ``fp``, a long) that connect all within ``radius`` bits of each other.

    The fingerprints of a bucket over the limit get finer keys: the bits that the bucket leaves open are cut into blocks
    again, of which any linked pair agrees on as many. So a frequent key is split without losing a link, until the open
    bits cannot tell more than the limit apart.
    """
    if blocks - radius < agree:
        raise ValueError("blocks - radius must be agree at least, or links would be lost")
    masks = [0]
    rows = distinct_fps.select("fp", F.lit(0).alias("path"))
    done: DataFrame | None = None
    while True:
        finer = [[_signed(m | k) for k in block_masks(blocks, agree, [b for b in range(64) if not m >> b & 1])] for m in masks]
        table = F.array(*(F.array(*map(F.lit, some)) for some in finer))
        width = len(finer[0])
        each = F.transform(F.element_at(table, F.col("path") + 1), lambda m, j: F.struct((F.col("path") * width + j).alias("path"), F.col("fp").bitwiseAND(m).alias("part")))
        rows = rows.select("fp", F.inline(each)).select("fp", "path", F.xxhash64("path", "part").alias("bucket"))
        masks = [m % (1 << 64) for some in finer for m in some]
        large = _large(rows, bucket_limit)
        open_bits = max(64 - m.bit_count() for m in masks)
        if large.isEmpty() or 1 << open_bits <= max(bucket_limit, 256):
            done = rows if done is None else done.unionByName(rows)
            break
        small = rows.join(large, "bucket", "left_anti").select("fp", "path", "bucket")
        done = small if done is None else done.unionByName(small)
        rows = rows.join(large, "bucket", "left_semi").select("fp", "path")
    # The bytes of a long come with the highest first; the distance does not mind.
    return _compared(done.select("bucket", F.col("fp").alias("node"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp")), radius)


def components(edges: DataFrame) -> DataFrame:
    """``node, rep``: the nodes of ``edges`` (u, v) with one representative for each connected component.

    Each round every node moves to its least neighbour in an order that the round's salt gives, edges are relabelled
    and loops dropped; a round shrinks what is left by a constant factor. All of it stays distributed, and each
    round is cut into shared tables. Hubs meet only partial aggregates and joins that Spark can split.
    """
    left = cut(edges.where("u <> v").distinct(), "edges")
    found = None
    turn = 0
    while not left.isEmpty():
        salt = F.lit(_signed((0x9E3779B97F4A7C15 * (turn + 1)) % (1 << 64)))
        both = left.union(left.select("v", "u"))
        step = cut(both.groupBy("u").agg(F.min(F.col("v").bitwiseXOR(salt)).alias("low")).select(F.col("u").alias("node"), F.least("low", F.col("u").bitwiseXOR(salt)).bitwiseXOR(salt).alias("to")), "step")
        if found is None:
            found = cut(step.withColumnRenamed("to", "rep"), "found")
        else:
            moved = found.join(step.withColumnRenamed("node", "rep"), "rep", "left")
            found, old = cut(moved.select("node", F.coalesce("to", "rep").alias("rep")), "found"), found
            drop(old)
        one = left.join(step.select(F.col("node").alias("u"), F.col("to").alias("mu")), "u")
        two = one.join(step.select(F.col("node").alias("v"), F.col("to").alias("mv")), "v")
        left, old = cut(two.where("mu <> mv").select(F.col("mu").alias("u"), F.col("mv").alias("v")).distinct(), "edges"), left
        drop(old, step)
        turn += 1
    return found if found is not None else left.select(F.col("u").alias("node"), F.col("v").alias("rep"))


def joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``found`` (node, rep) of some edges brought up to date with more of them: only those between its components are contracted."""
    for end in ("u", "v"):
        edges = edges.join(found.select(F.col("node").alias(end), F.col("rep").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    more = components(edges.select("u", "v"))
    moved = found.join(more.select(F.col("node").alias("rep"), F.col("rep").alias("to")), "rep", "left").select("node", F.coalesce("to", "rep").alias("rep"))
    out = cut(moved.unionByName(more.join(found, "node", "left_anti")), "found")
    drop(found, more)
    return out


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 3,
    radius: int = 2,
    blocks: int = 4,
    agree: int = 2,
    bucket_limit: int = 8192,
) -> DataFrame:
    """``doc_id, row, fp, component_id`` for each row of ``docs``: components of fingerprints linked within ``radius`` bits."""
    marked = cut(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    reached = components(links(distinct, radius, blocks, agree, bucket_limit))
    named = cut(reached.join(distinct.withColumnRenamed("fp", "node"), "node"), "reached")
    ids = named.groupBy("rep").agg(F.min("least").alias("component_id"))
    linked_ids = named.join(ids, "rep").select(F.col("node").alias("fp"), "component_id")
    # A table of its own, so that the join reads both sides from exchanges and Spark can split a frequent fingerprint.
    ids = cut(distinct.join(linked_ids, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "ids")
    return marked.join(ids, "fp").select("doc_id", "row", "fp", "component_id")


def shingles(text: bytes, words_per_shingle: int) -> np.ndarray:
    """The hashes of one UTF-8 text's word shingles, each once, in order."""
    return np.unique(_hashes(text, words_per_shingle))


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5) -> DataFrame:
    """``doc_id, row, node, at, set, size, bits, fold, fp``, one row per input row. node: hash of the shingle set; at, set, size, bits: a
    number of the row, the set's hashes as bytes, how many they are, and which of 2048 (fold: 512) values their highest bits take; fp: the
    set's fingerprint; all null where an earlier row of the same task has the same set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        at, seen = TaskContext.get().partitionId() << 36, set()
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            nodes, ats, sets, sizes, bits, fps = [], [], [], [], [], []
            for t in batch.column(2).cast(pa.binary()):
                hashes = shingles(t.as_py() or b"", words_per_shingle)
                own = hashes.tobytes()
                node = _signed(xxhash.xxh64_intdigest(own, seed=42))
                at += 1
                new = node not in seen
                seen.add(node)
                nodes.append(node)
                ats.append(at if new else None)
                sets.append(own if new else None)
                sizes.append(len(hashes) if new else None)
                bits.append(_taken(hashes) if new else None)
                fps.append(int.from_bytes(_fingerprint(hashes), "little", signed=True) if new else None)
            folds = iter(_folded([b for b in bits if b is not None]))
            fold = [None if b is None else next(folds) for b in bits]
            columns = [pa.array(nodes, pa.int64()), pa.array(ats, pa.int64()), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(fold, pa.binary()), pa.array(fps, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "row", "node", "at", "set", "size", "bits", "fold", "fp"])

    picked = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, schema_with(picked.select("doc_id", "row"), "node long, at long, set binary, size int, bits binary, fold binary, fp long"))


def _taken(hashes: np.ndarray) -> bytes:
    """Which of 2048 values the highest bits of hashes take."""
    taken = np.zeros(2048, np.uint8)
    taken[hashes >> np.uint64(53)] = 1
    return np.packbits(taken).tobytes()


def _folded(bits: list[bytes]) -> list[bytes]:
    """The same for 512 values: one for each four."""
    whole = np.frombuffer(b"".join(bits), np.uint8).reshape(-1, 256)
    return [x.tobytes() for x in np.packbits(np.stack([whole & 0xF0, whole & 0x0F], axis=2).reshape(-1, 512) != 0, axis=1)]


def _open(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of sizes a and b that take the values x and y can be this similar. A value that one of them takes alone
    stands for a hash that it has alone, so no pair of this similarity is closed."""
    both = np.minimum(a - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), b - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
    return both * (1 + similarity) >= (a + b) * similarity - 1e-6


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all sets of a column one after another, and the sets' sizes."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64), np.fromiter((len(r) // 8 for r in raw), np.int64, len(raw))


def _frequent(sets: DataFrame, sample: int, least: int = 5, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that ``least`` or more of a sample of the sets hold, in order, and how many hold them.

    They only set the order in which shingles are taken as keys; results do not depend on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_unpacked(batch.column(0))[0].view(np.int64))], names=["token"])

    share = min(1.0, sample / max(1, sets.count()))
    some = sets.where(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("set")
    counts = some.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= least).orderBy(F.desc("count"), "token").limit(most).toArrow()
    tokens, n = counts.column("token").to_numpy().view(np.uint64), counts.column("count").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first one, cut so that no value of it is in two cuts."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        first = int(np.searchsorted(new[0], new[0][-1]))  # the last bucket may go on in the next batch
        if first or held and held[-1][0][-1] != new[0][0]:
            if held and held[-1][0][-1] != new[0][0]:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            if first:
                yield [np.concatenate(x) for x in zip(*held, [c[:first] for c in new], strict=True)]
                held = []
        held.append([c[first:] for c in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def prefixes(sets: DataFrame, similarity: float, sample: int = 20_000) -> DataFrame:
    """``token, node, size, pos``: the shingles by which sets (``node, set``) of this similarity or more meet, without those of one set only.

    In any order of all shingles, two sets with Jaccard similarity s share one of the first ``n - ceil(s * n) + 1`` of their
    n shingles. The order here has shingles that are rare in a sample first, so a common passage is no key.
    """
    tokens, counts = _frequent(sets, sample)
    shared = sets.sparkSession.sparkContext.broadcast((tokens, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hashes, sizes = _unpacked(part.column(1))
                of = np.repeat(np.arange(len(sizes)), sizes)
                weight = np.zeros(len(hashes), np.int64)
                if len(tokens):
                    where = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
                    weight = np.where(tokens[where] == hashes, counts[where], 0)
                order = np.lexsort((hashes, weight, of))
                pos = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                ahead = pos < (sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1)[of]
                nodes = part.column(0).to_numpy()
                columns = [hashes[order][ahead].view(np.int64), nodes[of[ahead]], sizes[of[ahead]].astype(np.int32), pos[ahead].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "size", "pos"])

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_buckets(batches):
            token, node = columns[:2]
            new = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))  # a set may come from several tasks
            columns = [c[new] for c in columns]
            same = columns[0][1:] == columns[0][:-1]
            many = np.append(same, False) | np.append(False, same)
            yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in columns], names=["token", "node", "size", "pos"])

    kind = "token long, node long, size int, pos int"
    ordered = sets.select("node", "set").mapInArrow(run, kind).repartition("token").sortWithinPartitions("token", "node")
    return ordered.mapInArrow(shared_only, kind)


def _fits(a, b, i, j, similarity: float, least):
    """Whether sets of sizes a and b whose first common shingle is their i-th and j-th can be this similar."""
    return least(a - i, b - j) * (1 + similarity) >= (a + b) * similarity - 1e-6


def _cross_pairs(rows: DataFrame, marked: DataFrame, similarity: float, bucket_limit: int, tile: int) -> DataFrame:
    """``u, v``: all pairs of nodes with a common token and different ``rep`` that can be similar enough by their places and
    folded marks. Tokens of more rows than the limit are dealt out as pairs of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, node, size, pos, rep, fold in _whole_buckets(batches):
            fold = np.frombuffer(b"".join(fold), np.uint64).reshape(-1, 8)
            ends = np.searchsorted(bucket, bucket, "right")
            widest = int((ends - np.arange(len(bucket))).max())
            step = max(1, min(max(64, widest), (1 << 20) // (widest + 64)))  # step by step and a bucket at most
            for at in range(0, len(bucket), step):
                i = np.arange(at, min(at + step, len(bucket)))
                j = np.arange(at + 1, int(ends[i].max()))
                ok = (j[None, :] > i[:, None]) & (j[None, :] < ends[i][:, None]) & (rep[i][:, None] != rep[j][None, :])
                ok &= _fits(size[i][:, None].astype(np.int64), size[j][None, :].astype(np.int64), pos[i][:, None], pos[j][None, :], similarity, np.minimum)
                x, y = np.nonzero(ok)
                x, y = i[x], j[y]
                still = _open(size[x].astype(np.int64), size[y].astype(np.int64), fold[x], fold[y], similarity)
                x, y = x[still], y[still]
                if len(x):
                    a, b = node[x], node[y]
                    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    active = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("token", "n")
    tiles = F.when(F.col("n") > bucket_limit, F.ceil(F.col("n") / tile)).otherwise(1).cast("int")
    dealt = rows.join(active, "token").join(marked.select("node", "fold"), "node").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("node", "token"), F.col("tiles")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: (x != F.col("own")) | (F.col("tiles") == 1))
    dealt = dealt.withColumn("other", F.explode(others)).select(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node", "size", "pos", "rep", "fold")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long").distinct()


def _star_pairs(rows: DataFrame, similarity: float, turn: int) -> DataFrame:
    """``u, v``: of each token, one node with the others of a different ``rep`` that can be as similar."""
    head = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "size", "pos", "rep")).alias("c")
    heads = rows.groupBy("token").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), head).where("lo < hi").select("token", "c")
    met = rows.join(heads, "token").where(F.col("rep") != F.col("c.rep"))
    met = met.where(_fits(F.col("size"), F.col("c.size"), F.col("pos"), F.col("c.pos"), similarity, F.least))
    return met.select(F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v")).distinct()


def possible(pairs: DataFrame, marked: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u, v`` that the marks (``node, size, bits``) leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, 32) for k in (3, 5))
            a, b = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(_open(a, b, x, y, similarity)))

    one = pairs.join(marked.select(F.col("node").alias("u"), F.col("size").alias("a"), F.col("bits").alias("x")), "u")
    two = one.join(marked.select(F.col("node").alias("v"), F.col("size").alias("b"), F.col("bits").alias("y")), "v")
    return two.select("u", "v", "a", "x", "b", "y").mapInArrow(run, "u long, v long")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``u, v`` whose sets (``node, set``) have this Jaccard similarity or more, as a table of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    nodes = cut(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "nodes")
    # Only the sets of these nodes travel; a set that several tasks met counts once.
    few = nodes.hint("broadcast") if nodes.count() <= BROADCAST_ROWS else nodes
    some = cut(sets.join(few, "node", "left_semi").groupBy("node").agg(F.first("set").alias("set")), "some")
    one = pairs.join(some.select(F.col("node").alias("u"), F.col("set").alias("x")), "u")
    two = one.join(some.select(F.col("node").alias("v"), F.col("set").alias("y")), "v")
    found = cut(two.select("u", "v", "x", "y").mapInArrow(run, "u long, v long"), "confirmed")
    drop(nodes, some)
    return found


def fingerprint_pairs(prints: DataFrame, radius: int = 2, blocks: int = 4, agree: int = 2, bucket_limit: int = 8192) -> DataFrame:
    """``u, v``: pairs of nodes that connect all whose fingerprints (``node, fp``) lie within ``radius`` bits: see ``links``."""
    own = cut(prints.select("node", "fp").distinct(), "fingerprints")
    distinct = cut(own.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    same = own.join(distinct, "fp").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    near = links(distinct.select("fp"), radius, blocks, agree, bucket_limit)
    for end in ("u", "v"):
        near = near.join(distinct.select(F.col("fp").alias(end), F.col("least").alias(f"node_{end}")), end)
    found = cut(same.union(near.select(F.least("node_u", "node_v"), F.greatest("node_u", "node_v"))).distinct(), "pairs")
    drop(own, distinct)
    return found


def similar_components(rows: DataFrame, marked: DataFrame, sets: DataFrame, similarity: float, edges: DataFrame, bucket_limit: int = 8192, tile: int = 1024, rounds: int = 3) -> DataFrame:
    """``node, rep``: the connected components of all pairs of sets at this Jaccard similarity or more.

    ``rows`` are those of ``prefixes``, ``marked`` the sizes and bits of the sets, ``edges`` the pairs ``u, v`` that are known already. A few
    rounds compare one node of each token with the others, which brings groups
    of near copies together; then all pairs that meet and are not yet connected are compared. So no link is lost, and a
    group takes no square of pairs.
    """
    found = components(edges)
    for turn in range(rounds + 1):
        own = rows.join(found, "node", "left").withColumn("rep", F.coalesce("rep", "node"))
        met = cut(_star_pairs(own, similarity, turn) if turn < rounds else _cross_pairs(own, marked, similarity, bucket_limit, tile), "pairs")
        pairs = cut(possible(met, marked, similarity), "possible")
        drop(met)
        if pairs.isEmpty():
            continue
        new = confirmed(pairs, sets, similarity)
        drop(pairs)
        if new.isEmpty():
            continue
        found = joined(found, new)
        drop(new)
        release(rows.sparkSession)
    return found


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, similarity: float = 0.8, **options) -> DataFrame:
    """``doc_id, row, component_id``: components of texts whose shingle sets have a Jaccard similarity of ``similarity`` or more.

    Pairs come from the bit-sliced comparison of the sets' fingerprints first; the whole sets confirm them. Sets at 0.8 mostly
    differ in more bits than it spans, so all other pairs come from ``prefixes``: every pair of this similarity meets in a token
    there and is confirmed likewise. Texts of equal sets share a node. A component is named by its least id.
    """
    with arrow_rows(docs.sparkSession, 1024):
        whole = cut(shingle_sets(docs, id_col, text_col, words_per_shingle), "sets")
        marked = cut(whole.select("doc_id", "row", "node"), "nodes")
        distinct = cut(marked.groupBy("node").agg(F.min("doc_id").alias("least")), "distinct")
        sets = whole.where("at is not null")
        near = fingerprint_pairs(sets)
        edges = confirmed(near, sets.select("node", "set"), similarity)
        drop(near)
        release(docs.sparkSession)
        rows = cut(prefixes(sets, similarity), "prefixes")
        release(docs.sparkSession)
        marks = cut(sets.groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("fold").alias("fold")), "marks")
        reached = similar_components(rows, marks, sets.select("node", "set"), similarity, edges, **options)
        named = cut(reached.join(distinct, "node"), "reached")
        drop(rows, marks, whole)
    ids = named.groupBy("rep").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "rep").select("node", "component_id")
    ids = cut(distinct.join(of, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "ids")
    return marked.join(ids, "node").select("doc_id", "row", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose id is not the least of their component; rows without an id stay if all of the component lack one."""
    found = similar_documents(docs, id_col, text_col, **options)
    return without(docs, found.where("doc_id is null and component_id is not null or doc_id <> component_id"), id_col, text_col)


def fingerprint_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
