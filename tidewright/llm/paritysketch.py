"""Exact n-gram Jaccard self-join by parity sketches (operator 6).

A document is the set of its distinct shingles. Every shingle toggles one bit of a sketch (an XOR hash), so the
Hamming distance of two sketches is at most the symmetric difference of the sets. For Jaccard >= 3/4 and sizes
a <= b, b is at most 4a/3 and the difference at most D = (a + b) / 7.

Candidates come by the pigeonhole rule over a sparse sketch, one for each size band [2^j, 2^(j+1)): shingles fall into
2^j blocks by their hash, and a block is named by the XOR of its shingles. At most D blocks of a pair differ, so if each
document emits its first D + 1 blocks that are not empty, a linked pair shares one. A document at the low end of its
band also emits into the band below, where its smaller partners are.

Shingles that many documents share are left out of the blocks: leaving any fixed set out only lowers the difference,
so no pair is lost and the set steers cost alone. A document left with fewer than D + 1 blocks also emits
its first D + 1 shingles, the shared ones included; of two such documents one shares an emitted shingle.

Documents that share a block are not paired out. A document's group is led by the first document of a block it is in.
A group's documents are compared in memory, in pieces of bounded size, by sizes and by the Hamming distance of dense
sketches; only those with a partner within D get their sets of 64-bit shingle hashes, and these are intersected in
memory too: all pairs of a piece at once, by a product of the matrices of who holds which shingle. What leaves a piece
is a spanning forest of its links, at most one row a document, whether its pairs are links or near misses. Documents of equal sets are one
class throughout.

Null texts and texts without a word have no shingle and link with nothing. Rows of one id are each kept, with the
component of their own text. Rows without an id get no component, and join nothing. Extra columns are not carried.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.columns import map_sorted_groups, release_memory
from tidewright.llm.shared import attach, checkpoint, connected_components, row_mark, spanning_roots
from tidewright.llm.text import SPACE, U64, mix, words

WIDTH = 5
#: Jaccard threshold as a fraction.
OVER, UNDER = 3, 4
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], U64)
_SHORT = U64(0x5851F42D4C957F2D)
#: Block entries of a task that are held before they are written out by bucket.
FLUSH = 1_000_000
BUCKET_ENTRIES = 250_000
#: Documents whose shared shingles steer the blocks, and how many of them must share one.
COMMON_SAMPLE, COMMON_IN = 3000, 4
#: Members of a group whose sketches are compared with each other at a time.
BLOCK = 512
#: Members, and bytes of sets, of a piece whose sets are compared; rows and shingles of a product of matrices.
PIECE, PIECE_BYTES = 4096, 16 << 20
TILE, COLUMNS = 1024, 2048


def shingle_sets(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, the size of each row's shingle set, and the sets' hashes, ascending within a row."""
    with np.errstate(over="ignore"):
        for w in words(column, ~SPACE):
            hashes, counts = w.hashes(), w.counts
            row = w.row_of_word()
            n = len(hashes) - WIDTH + 1
            if n > 0:
                full = hashes[:n] * _PLACE[0]
                for j in range(1, WIDTH):
                    full += hashes[j : n + j] * _PLACE[j]
                inside = row[:n] == row[WIDTH - 1 :]
                full, owner = full[inside], row[:n][inside]
            else:
                full, owner = np.empty(0, U64), np.empty(0, np.int64)
            brief = np.flatnonzero((counts > 0) & (counts < WIDTH))
            one = np.zeros(len(brief), U64)
            for j in range(WIDTH - 1):
                more = counts[brief] > j
                one[more] += hashes[w.first[:-1][brief[more]] + j] * _PLACE[j]
            one += counts[brief].astype(U64) * _SHORT
            sets = np.concatenate([full, one])
            owner = np.concatenate([owner, brief])
            if len(brief):
                order = np.argsort(owner, kind="stable")
                sets, owner = sets[order], owner[order]
            sets = mix(sets)
            bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sets[s:e].sort()
            new = np.ones(len(sets), bool)
            new[1:] = (sets[1:] != sets[:-1]) | (owner[1:] != owner[:-1])
            yield w.rows, np.bincount(owner[new], minlength=len(counts)), sets[new]


def set_hashes(sizes: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """A hash of each row's whole set; equal sets are one class."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets ^ _SHORT), dtype=U64)])
        ends = np.cumsum(sizes)
        return mix(sums[ends] - sums[ends - sizes] + sizes.astype(U64) * _PLACE[1]).view(np.int64)


def largest_difference(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """The symmetric difference up to which two sets of these sizes are linked."""
    return (UNDER - OVER) * (small + large) // (UNDER + OVER)


def largest_partner(size: np.ndarray) -> np.ndarray:
    return size * UNDER // OVER


def first_of_rows(owner: np.ndarray) -> np.ndarray:
    """Each entry's place among the entries of its owner; owners ascend."""
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, int)
    return np.arange(len(owner)) - np.repeat(starts, np.diff(starts, append=len(owner)))


def blocks(sizes: np.ndarray, sets: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block names that each row emits: (row, 64-bit name)."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rare = common[np.minimum(np.searchsorted(common, sets), len(common) - 1)] != sets if len(common) else np.ones(len(sets), bool)
    band = np.frexp(sizes.astype(float))[1] - 1
    low = (1 << np.maximum(band, 0)) - 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for step, rows, most in (
        (0, sizes > 0, largest_difference(sizes, largest_partner(sizes))),
        (1, (band > 0) & (sizes <= largest_partner(low)), largest_difference(low, sizes)),
    ):
        level = np.maximum(band - step, 0)
        chosen = rare & rows[owner]
        who, what = owner[chosen], sets[chosen]
        block = (what >> U64(1)) >> (63 - level[who]).astype(U64)
        at = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (block[1:] != block[:-1])])) if len(who) else np.empty(0, int)
        name = np.bitwise_xor.reduceat(mix(what ^ _PLACE[2]), at) if len(at) else np.empty(0, U64)
        who, block = who[at], block[at]
        held = np.bincount(who, minlength=len(sizes))
        first = first_of_rows(who) <= most[who]
        with np.errstate(over="ignore"):
            tag = mix(name + (block + U64(1)) * _PLACE[3] + level[who].astype(U64) * _PLACE[4])
        out.append((who[first], tag[first]))
        poor = rows & (held <= most)
        if poor.any():
            chosen = poor[owner]
            who, what = owner[chosen], sets[chosen]
            first = first_of_rows(who) <= most[who]
            with np.errstate(over="ignore"):
                out.append((who[first], mix(what[first] + (level[who[first]].astype(U64) + U64(64)) * _PLACE[4])))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def dense_sketches(sizes: np.ndarray, sets: np.ndarray) -> list[bytes]:
    """Each row's parity bits, four or more a shingle: bit h mod m is toggled by every shingle of hash h."""
    out, at = [], 0
    for n in sizes.tolist():
        bits = 64 if n < 16 else 4 << (n.bit_length() - 1)
        toggled = np.bincount((sets[at : at + n] & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(toggled.astype(np.uint8), bitorder="little").tobytes())
        at += n
    return out


def hamming(sketches: list[np.ndarray]) -> np.ndarray:
    """Hamming distances of sketches of all sizes, the longer of two folded by XOR to the length of the shorter."""
    n = len(sketches)
    out = np.zeros((n, n), np.int64)
    lengths = sorted({len(s) for s in sketches})
    for length in lengths:
        own = np.array([i for i, s in enumerate(sketches) if len(s) >= length])
        folded = np.array([np.bitwise_xor.reduce(sketches[i].reshape(-1, length), axis=0) for i in own])
        for k, i in enumerate(own):
            if len(sketches[i]) == length:
                d = np.bitwise_count(folded ^ folded[k]).sum(1)
                out[i, own] = d
                out[own, i] = d
    return out


_MAP = "bucket int, unit long, entries binary, id long, its long, n long, class long, slot long, sketch binary"


def _emit(docs: DataFrame, buckets: int, common: np.ndarray) -> DataFrame:
    """One row for each document and, for each run of documents and bucket, the block entries packed in one row.

    An entry is 48 bits of the block's name and 16 bits for the class within the run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("entries", pa.binary()), ("id", pa.int64()), ("its", pa.int64()),
                            ("n", pa.int64()), ("class", pa.int64()), ("slot", pa.int64()), ("sketch", pa.binary())])
        unit = TaskContext.get().partitionId() << 20
        slots: dict[int, int] = {}
        dealt = 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            name = np.concatenate([a for a, _ in held])
            if not len(name):
                return
            bucket = (name % U64(buckets)).astype(np.int32)
            entry = (name >> U64(16)) << U64(16) | np.concatenate([b for _, b in held]).astype(U64)
            order = np.argsort(bucket, kind="stable")
            bucket, entry = bucket[order], entry[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            packed = [e.tobytes() for e in np.split(entry, at[1:])]
            yield _batch(schema, len(at), bucket=bucket[at], unit=np.full(len(at), unit), entries=packed)

        for batch in batches:
            ids = batch["id"].fill_null(0).to_numpy()
            known = batch["id"].is_valid().to_numpy(zero_copy_only=False)
            for rows, sizes, sets in shingle_sets(batch["text"]):
                if held and (len(slots) + len(sizes) > 1 << 16 or sum(len(a) for a, _ in held) > FLUSH):
                    yield from flush()
                    held.clear()
                    slots.clear()
                    unit += 1
                if len(sizes) > 1 << 16:
                    raise ValueError("a chunk of rows exceeds the slots of a unit")
                classes = set_hashes(sizes, sets)
                fresh, slot = np.zeros(len(sizes), bool), np.zeros(len(sizes), np.int64)
                able = known[rows]
                for i, c in enumerate(classes.tolist()):
                    if able[i] and sizes[i] and c not in slots:
                        fresh[i] = True
                        slot[i] = slots[c] = len(slots)
                own = fresh[np.repeat(np.arange(len(sizes)), sizes)]
                new_sizes, new_sets = np.where(fresh, sizes, 0), sets[own]
                who, name = blocks(new_sizes, new_sets, common)
                held.append((name, slot[who]))
                sketches = dense_sketches(new_sizes, new_sets)
                # Rows are dealt in turn: those of one class may be many.
                turn = (unit + dealt + np.arange(len(sizes))) % buckets
                dealt += len(sizes)
                yield _batch(
                    schema, len(sizes), bucket=turn.astype(np.int32),
                    id=pa.array(ids[rows], mask=~able), its=batch["its"].slice(rows.start, len(sizes)),
                    n=sizes, **{"class": classes}, slot=pa.array(unit << 16 | slot, mask=~fresh),
                    sketch=[s if f else None for s, f in zip(sketches, fresh, strict=True)],
                )
        if held:
            yield from flush()
        held.clear()
        release_memory()

    return docs.mapInArrow(run, _MAP)


def _batch(schema: pa.Schema, length: int, /, **columns) -> pa.RecordBatch:
    arrays = []
    for field in schema:
        x = columns.get(field.name)
        arrays.append(pa.nulls(length, field.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_ROWS = "key long, first long, slot long, id long, its long, n long, class long, sketch binary"
_ROW_SCHEMA = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("slot", pa.int64()), ("id", pa.int64()), ("its", pa.int64()),
                         ("n", pa.int64()), ("class", pa.int64()), ("sketch", pa.binary())])


def _shared_blocks(parts: list[tuple[int, bytes]]) -> pa.RecordBatch | None:
    """(key of a group, its first slot, slot) for each slot of a block that several share; equal groups once."""
    entry = np.concatenate([np.frombuffer(b, U64) for _, b in parts])
    unit = np.repeat(np.array([u for u, _ in parts], np.int64), [len(b) // 8 for _, b in parts])
    slot = unit << 16 | (entry & U64(0xFFFF)).astype(np.int64)
    name = entry >> U64(16)
    order = np.lexsort((slot, name))
    name, slot = name[order], slot[order]
    at = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    size = np.diff(at, append=len(name))
    slot, size = slot[np.repeat(size > 1, size)], size[size > 1]
    if not len(slot):
        return None
    at = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        key = mix(np.add.reduceat(mix(slot.view(U64)), at) + size.astype(U64)).view(np.int64)
    keep = np.zeros(len(size), bool)
    keep[np.unique(key, return_index=True)[1]] = True
    keep = np.repeat(keep, size)
    return _batch(_ROW_SCHEMA, keep.sum(), key=np.repeat(key, size)[keep], first=np.repeat(slot[at], size)[keep], slot=slot[keep])


def _groups(rows: DataFrame) -> DataFrame:
    """The documents' rows as they are, and those of the groups that share a block; rows come sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            packed = batch["entries"].is_valid()
            plain = batch.filter(pc.invert(packed))
            yield _batch(_ROW_SCHEMA, len(plain), **{k: plain[k] for k in ("id", "its", "n", "class", "slot", "sketch")})
            batch = batch.filter(packed)
            for bucket, unit, entries in zip(*(batch[k].to_pylist() for k in ("bucket", "unit", "entries")), strict=True):
                if bucket != current:
                    if parts and (found := _shared_blocks(parts)) is not None:
                        yield found
                    current, parts = bucket, []
                parts.append((unit, entries))
        if parts and (found := _shared_blocks(parts)) is not None:
            yield found
        release_memory()

    return rows.mapInArrow(run, _ROWS)


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes that several documents of a bounded sample share. They steer the blocks; the result does not depend on them."""
    n = docs.count()
    part = docs.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, COMMON_SAMPLE / max(1, n)) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sizes, sets in shingle_sets(batch["text"]):
                yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64))], ["h"])

    found = part.dropDuplicates(["id"]).mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON_IN)
    return np.sort(np.array([r["h"] for r in found.select("h").collect()], np.int64).view(U64))


def _sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(class, its sorted shingle hashes packed) of the classes whose documents ``reps`` (id, class) name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sizes, sets in shingle_sets(batch["text"]):
                packed = [x.tobytes() for x in np.split(sets, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(sizes, sets)), pa.array(packed, pa.binary())], ["class", "shingles"])

    found = docs.join(reps.select("id").distinct(), "id", "left_semi").select("text").mapInArrow(run, "class long, shingles binary")
    found = found.join(reps.select("class"), "class", "left_semi")
    return found.groupBy("class").agg(F.first("shingles").alias("shingles"))


def _pieced(members: DataFrame, pieces: Column) -> DataFrame:
    """Members of groups, once for each pair (p, q) of pieces of their group that theirs is one of."""
    members = members.withColumn("piece", F.pmod(F.xxhash64("class"), pieces).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return members.withColumn("p", F.least("piece", "other")).withColumn("q", F.greatest("piece", "other")).drop("other")


def near_members(groups: DataFrame, leads: DataFrame) -> DataFrame:
    """(head, class) of the members of groups that sizes and sketches do not rule out as a partner of some other."""
    sizes = checkpoint(groups.groupBy("head").agg(F.count("*").alias("copies")).where("copies > 1"))
    members = attach(groups, sizes, "head", groups.count()).join(leads, "class")
    members = _pieced(members, F.ceil(F.col("copies") / BLOCK).cast("int"))

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        n, piece, name = (group[k].to_numpy() for k in ("n", "piece", "class"))
        if len(name) < 2:
            return None
        far = hamming([np.frombuffer(x, np.uint8) for x in group["sketch"].to_pylist()])
        near = far <= largest_difference(n[:, None], n[None, :])
        near &= np.maximum(n[:, None], n[None, :]) * OVER <= np.minimum(n[:, None], n[None, :]) * UNDER
        if group["p"][0].as_py() != group["q"][0].as_py():
            near &= piece[:, None] != piece[None, :]
        else:
            np.fill_diagonal(near, False)
        some = name[near.any(1)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), group["head"][0].as_py())), pa.array(some)], ["head", "class"])

    members = members.select("head", "p", "q", "piece", "class", "n", "sketch")
    return map_sorted_groups(members, ["head", "p", "q"], compare, "head long, class long").distinct()


def intersections(sets: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray]]:
    """How many shingles each set has in common with each, for ``TILE`` sets at a time; ``COLUMNS`` shingles a product.

    Shingles of a single set are left out first.
    """
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    place, owner = (np.cumsum(count > 1) - 1)[place[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    cuts = np.searchsorted(place, np.arange(0, int((count > 1).sum()) + COLUMNS, COLUMNS))
    for start in range(0, len(sets), TILE):
        rows = slice(start, min(start + TILE, len(sets)))
        both = np.zeros((rows.stop - start, len(sets)), np.float32)
        for s, e in itertools.pairwise(cuts.tolist()):
            low = int(place[s])
            held = np.zeros((len(sets), int(place[e - 1]) - low + 1), np.float32)
            held[owner[s:e], place[s:e] - low] = 1
            both += held[rows] @ held.T
        yield rows, both.astype(np.int64)


def spanning_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of classes that join the members (head, class) of a group as all of its links do, from whole sets."""
    lengths = members.join(sets.select("class", F.octet_length("shingles").alias("length")), "class")
    sizes = checkpoint(lengths.groupBy("head").agg(F.count("*").alias("copies"), F.sum("length").alias("bytes")))
    members = attach(members, sizes, "head", members.count()).join(sets, "class")
    members = _pieced(members, F.ceil(F.greatest(F.col("copies") / PIECE, F.col("bytes") / PIECE_BYTES)).cast("int"))

    def compare(group: pa.Table) -> pa.RecordBatch | None:
        name, piece = group["class"].to_numpy(), group["piece"].to_numpy()
        if len(name) < 2:
            return None
        held = [np.frombuffer(x, U64) for x in group["shingles"].to_pylist()]
        n = np.array([len(x) for x in held], np.int64)
        across = group["p"][0].as_py() != group["q"][0].as_py()
        root = np.arange(len(name))
        for rows, both in intersections(held):
            linked = UNDER * both >= OVER * (n[rows, None] + n[None, :] - both)
            if across:
                linked &= piece[rows, None] != piece[None, :]
            i, j = np.nonzero(linked)
            root = spanning_roots(len(name), np.concatenate([i + rows.start, np.arange(len(name))]), np.concatenate([j, root]))
        moved = np.flatnonzero(root != np.arange(len(name)))
        return pa.RecordBatch.from_arrays([pa.array(name[moved]), pa.array(name[root[moved]])], ["a", "b"])

    members = members.select("head", "p", "q", "piece", "class", "shingles")
    return map_sorted_groups(members, ["head", "p", "q"], compare, "a long, b long")


def jaccard_classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", mark: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (id, its, n, class) and the facts of each class: (class, least id, copies, component, component_id).

    ``its`` is a long by which callers tell rows, of ``mark`` where given. Classes are of rows with an id and a shingle.
    """
    its = F.lit(None) if mark is None else mark
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"), its.cast("long").alias("its"))
    common = common_shingles(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(512, int(size / 12) // BUCKET_ENTRIES)
    emitted = _emit(docs, buckets, common)
    rows = checkpoint(_groups(emitted.repartition("bucket").sortWithinPartitions("bucket")))
    groups = rows.where("key IS NOT NULL").select("first", "slot").distinct()
    rows = rows.where("key IS NULL").select("id", "its", "n", "class", "slot", "sketch")
    leads = rows.where("slot IS NOT NULL")
    groups = checkpoint(
        groups.join(leads.select("slot", "class"), "slot")
        .join(leads.select(F.col("slot").alias("first"), F.col("class").alias("head")), "first")
        .select("head", "class").distinct()
    )
    leads = leads.join(groups.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    members = checkpoint(near_members(groups, leads))
    facts = rows.where("n > 0 AND id IS NOT NULL").groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    facts = checkpoint(facts)
    reps = facts.select("class", F.col("least").alias("id")).join(members.select("class").distinct(), "class", "left_semi")
    sets = checkpoint(_sets(docs, checkpoint(reps)))
    parts = connected_components(spanning_links(members, sets)).withColumnRenamed("node", "class")
    linked = checkpoint(parts.join(facts.select("class", "least"), "class"))
    whole = checkpoint(linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("copies")))
    linked = attach(linked, whole, "component", linked.count()).select("class", "component", "component_id")
    facts = facts.join(linked, "class", "left").withColumn("component", F.coalesce("component", "class"))
    facts = facts.withColumn("component_id", F.coalesce("component_id", "least"))
    return rows.select("id", "its", "n", "class"), checkpoint(facts)


def jaccard_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the component is its least id reachable by links."""
    rows, facts = jaccard_classes(docs, text, id_col)
    named = attach(rows.where("id IS NOT NULL AND n > 0"), facts, "class", rows.count()).select("id", "n", "component_id")
    alone = rows.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id"))
    return named.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each group of linked documents: of least id and, where that has several, of least mark.

    Decided by row: rows of one id may be in different groups, and rows equal in all columns are one group. Rows without
    an id and rows without a word link with nothing, so all of them stay.
    """
    mark = row_mark(*docs.columns)
    rows, facts = jaccard_classes(docs, text, id_col, mark)
    named = attach(rows.where("id IS NOT NULL AND n > 0"), facts, "class", rows.count()).select("id", "its", "component_id", "component")
    marks = named.groupBy("component", "id", "its").agg(F.count("*").alias("rows"))
    marks = checkpoint(marks)
    best = marks.groupBy("component").agg(F.min(F.struct("id", "its")).alias("best"), F.count("*").alias("copies"))
    told = attach(marks, checkpoint(best), "component", marks.count())
    told = told.select("its", "id", "rows", (F.struct("id", "its") == F.col("best")).alias("stays"))
    told = checkpoint(told.where("NOT stays OR rows > 1"))
    held = docs.select(F.struct(*docs.columns).alias("row"), mark.alias("its"), F.col(id_col).cast("long").alias("id"))
    out = held.join(told, ["its", "id"], "left_anti")
    equal = told.where("stays")
    if not equal.isEmpty():
        out = out.unionByName(held.join(equal, ["its", "id"], "left_semi").dropDuplicates(["its", "id"]))
    return out.select("row.*")
