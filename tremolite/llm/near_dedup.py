"""Near-duplicate documents: HyperMinHash registers, banding, corrected estimates, then links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, discard, slices, staged, text_bytes

#: 2 ** 8 registers of one byte: the leading-zero count (15 at most) and 4 mantissa bits of the least hash of a bucket.
BUCKET_BITS, MANTISSA_BITS, MOST_ZEROS = 8, 4, 15
REGISTERS = 1 << BUCKET_BITS
#: Two sets with a similarity of 0.8 share no band with a chance of (1 - 0.8 ** 6) ** 48 < 5e-7, if registers are independent.
#: They are less so in small sets, where shingles that meet in a bucket weigh; sets of up to TINY shingles are also linked exactly.
BANDS, BAND_ROWS = 48, 6
#: Bands that find most links; the others then look only at buckets that still hold several components.
FIRST_BANDS = 8
#: Candidates whose estimate is this far below the threshold aren't confirmed: 5 standard errors at 0.8.
#: Smaller sets are always confirmed: hashes that meet in a bucket may weigh more there than chance does.
MARGIN, SMALL = 0.125, 64
#: Buckets with more sets than this are compared by way of a reference set, in whose terms most pairs can be ruled out.
CROWDED = 32
#: 64-bit words of a bitmap of the shingles that the reference set doesn't have.
MASK_WORDS = 8
_PROBES = 48
#: Among sets of so many shingles and less, a similarity of 0.8 and more short of 1 leaves one shingle that the smaller set lacks.
TINY = 9

_u = np.uint64
_K1, _K2, _K3, _K4 = _u(0x9E3779B97F4A7C15), _u(0xC2B2AE3D27D4EB4F), _u(0x165667B19E3779F9), _u(0xD6E8FEB86659FD93)

SIGNATURE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("set_id", T.LongType()), T.StructField("registers", T.BinaryType()),
    T.StructField("smaller", T.ArrayType(T.LongType())),
])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all bits."""
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By byte: lower case of A-Z, white space; by byte: a random value; by band: its registers; by attempt and register: where to borrow; by register: the order of buckets after that."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    value = _mix(np.arange(1, 257, dtype=_u) * _K2)[lower]
    rng = np.random.default_rng(20)
    order = np.concatenate([rng.permutation(REGISTERS) for _ in range(-(-BANDS * BAND_ROWS // REGISTERS))])
    return lower, value, order[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS), rng.integers(0, REGISTERS, (_PROBES, REGISTERS)), rng.permuted(np.tile(np.arange(REGISTERS, dtype=np.uint8), (REGISTERS, 1)), axis=1)


def shingle_hashes(data: np.ndarray, offs: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within a text, and their n + 1 offsets.

    Words are runs of bytes that aren't ASCII white space, A-Z in lower case. A text with fewer words than
    ``width`` has one shingle, the whole sequence; a text without words has none.
    """
    n, size = len(offs) - 1, len(data)
    value = _tables()[1]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    begins, ends = word.copy(), word.copy()
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    first = offs[:-1][(offs[:-1] < size)]
    begins[first] = word[first]
    last = offs[1:][offs[1:] > offs[:-1]] - 1
    ends[last] = word[last]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # a byte and its place in its word are mixed before they are summed: a polynomial would collide on words made for it
    place = np.arange(size) - a[np.maximum(np.cumsum(begins) - 1, 0)] if len(a) else np.zeros(size, np.int64)
    total = np.zeros(size + 1, _u)
    np.cumsum(_mix(value[data] + place.astype(_u) * _K2), out=total[1:])
    words = _mix(total[b] - total[a] + (b - a).astype(_u) * _K3)
    doc = np.searchsorted(offs, a, "right") - 1
    count = np.bincount(doc, minlength=n)
    at = np.concatenate([[0], np.cumsum(count)])
    rolled = np.zeros(len(words), _u)
    for k in range(min(width, len(words))):  # fewer words than that hold no whole shingle
        rolled[: len(words) - k] = rolled[: len(words) - k] * _K4 + words[k:]
    whole = np.arange(len(words)) + width <= at[doc + 1]
    hashes = _mix(rolled)
    parts = []
    for i in range(n):
        if count[i] >= width:
            parts.append(np.unique(hashes[at[i] : at[i + 1]][whole[at[i] : at[i + 1]]]))
        elif count[i]:
            h = np.zeros(1, _u)
            for k in range(at[i], at[i + 1]):
                h = _mix(h * _K4 + words[k : k + 1] + _K1)
            parts.append(h)
        else:
            parts.append(np.zeros(0, _u))
    sizes = [len(p) for p in parts]
    return np.concatenate([*parts, np.zeros(0, _u)]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def registers_of(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, one row a set. Empty buckets of a set borrow from its others by a fixed random order."""
    n = len(at) - 1
    regs, full = np.zeros((n, REGISTERS), np.uint8), np.zeros((n, REGISTERS), bool)
    if not len(hashes):
        return regs
    doc = np.repeat(np.arange(n), np.diff(at))
    bucket = (hashes >> _u(64 - BUCKET_BITS)).astype(np.int64)
    key = doc * REGISTERS + bucket
    least = np.concatenate([[True], key[1:] != key[:-1]])  # hashes are sorted, so the first of a bucket is the least
    rest = ((hashes[least] << _u(BUCKET_BITS)) >> _u(11)).astype(np.float64)  # 53 bits: exact
    mantissa, exponent = np.frexp(rest)
    zeros = np.minimum(53 - exponent, MOST_ZEROS)
    regs.reshape(-1)[key[least]] = (zeros << MANTISSA_BITS) | np.maximum(0, (mantissa * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    full.reshape(-1)[key[least]] = True
    own, had = regs.copy(), full.copy()
    probes = _tables()[3]
    some = np.diff(at) > 0
    for t in range(_PROBES):
        r, c = np.nonzero(~full & some[:, None])
        if not len(r):
            return regs
        src = probes[t][c]
        ok = had[r, src]
        regs[r[ok], c[ok]] = own[r[ok], src[ok]]
        full[r[ok], c[ok]] = True
    for i in np.flatnonzero(~full.all(1) & some):  # small sets: the full bucket that comes first in the register's own order
        there, gap = np.flatnonzero(had[i]), np.flatnonzero(~full[i])
        regs[i, gap] = own[i, there[_tables()[4][np.ix_(gap, there)].argmin(1)]]
    return regs


def band_keys(regs: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each of the first bands of each row."""
    order = _tables()[2][:bands]
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_u) * _K1, (len(regs), bands)).copy()
    for k in range(BAND_ROWS):
        key = _mix(key ^ (regs[:, order[:, k]].astype(_u) + _u(1)) * _K2)
    return key.view(np.int64)


def collision_rate(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The chance that registers of disjoint sets of these sizes are equal: both least hashes in one (zeros, mantissa) cell."""
    load_a, load_b = np.maximum(1.0, n_a / REGISTERS), np.maximum(1.0, n_b / REGISTERS)
    total = np.zeros(len(load_a))
    for z in range(MOST_ZEROS + 1):
        lo, hi = 2.0 ** -(z + 1) if z < MOST_ZEROS else 0.0, 2.0**-z
        total += ((1 - lo) ** load_a - (1 - hi) ** load_a) * ((1 - lo) ** load_b - (1 - hi) ** load_b)
    return total / (1 << MANTISSA_BITS)


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity by the share of equal registers, less the share that collisions explain."""
    c = collision_rate(n_a, n_b)
    return ((regs_a == regs_b).mean(1) - c) / (1 - c)


def _less_one(mixed: np.ndarray, threshold: int) -> list[int] | None:
    """The set_ids of the sets that lack one shingle, where they reach the threshold; ``mixed`` holds a set's mixed hashes."""
    n = len(mixed)
    if not 1 < n <= TINY or 100 * (n - 1) < threshold * n:
        return None
    return _mix((mixed.sum(dtype=_u, keepdims=True) - mixed) ^ (np.array([n - 1], _u) * _K2)).view(np.int64).tolist()


def _sign(width: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(2))
            for i, j in slices(offs):
                hashes, at = shingle_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                sizes = np.diff(at)
                regs = registers_of(hashes, at)
                mixed = _mix(hashes ^ _K3)
                total = np.concatenate([[_u(0)], np.cumsum(mixed, dtype=_u)])
                smaller = pa.array([_less_one(mixed[at[k] : at[k + 1]], threshold) for k in range(j - i)], pa.list_(pa.int64()))
                set_id = _mix((total[at[1:]] - total[at[:-1]]) ^ (sizes.astype(_u) * _K2)).view(np.int64)
                yield pa.record_batch([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(sizes, pa.int64()), pa.array(set_id), _rows(regs), smaller], names=SIGNATURE.fieldNames())

    return run


def _rows(regs: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in regs], pa.binary())


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _buckets(bands: int):
    """(set_id, component, registers) to a row (key, set_id, component) for each of the first bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                ids, comps = (np.repeat(part.column(k).to_numpy(), bands) for k in (0, 1))
                yield pa.record_batch([pa.array(band_keys(_registers(part.column(2)), bands).reshape(-1)), pa.array(ids), pa.array(comps)], names=["key", "set_id", "component"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All keys of a set, in order of bands."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS), pa.array(band_keys(_registers(part.column(2))).reshape(-1)))
            yield pa.record_batch([part.column(0), part.column(1), keys], names=["set_id", "n", "bands"])


def _likely(threshold: int):
    """Pairs whose registers allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                a, b = _registers(part.column(2)), _registers(part.column(3))
                n_a, n_b = (part.column(k).to_numpy() for k in (4, 5))
                sizes = np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * threshold
                keep = pa.array(sizes & ((estimate(a, b, n_a, n_b) >= threshold / 100 - MARGIN) | (np.minimum(n_a, n_b) <= SMALL)))
                yield pa.record_batch([part.column(0), part.column(1)], names=["a", "b"]).filter(keep)

    return run


def _hash_sets(width: int):
    """The full set of each text: its sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            for i, j in slices(offs):
                hashes, at = shingle_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                full = pa.array([hashes[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary())
                yield pa.record_batch([batch.column(0)[i:j], full], names=["set_id", "full"])

    return run


def _confirm(threshold: int):
    """Pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), _u) for c in (2, 3))
                x, y = (x, y) if len(x) < len(y) else (y, x)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok[k] = 100 * both >= threshold * (len(x) + len(y) - both)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def _against_reference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set: how many shingles its reference has; a bitmap of the others; how many of those share a bit with one before."""
    for batch in batches:
        n = batch.num_rows
        inside, spare, masks = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, MASK_WORDS), _u)
        for k in range(n):
            x, r = (np.frombuffer(batch.column(c)[k].as_buffer(), _u) for c in (2, 3))
            shared = r[np.minimum(np.searchsorted(r, x), len(r) - 1)] == x
            inside[k] = shared.sum()
            bits = np.unique(x[~shared] % _u(64 * MASK_WORDS))
            spare[k] = len(x) - inside[k] - len(bits)
            np.bitwise_or.at(masks[k], (bits // _u(64)).astype(np.int64), _u(1) << (bits % _u(64)))
        mask = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * MASK_WORDS), pa.array(masks.reshape(-1).view(np.int64)))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(inside), pa.array(spare), mask], names=["set_id", "ref", "inside", "spare", "mask"])


def _shared_at_most() -> Column:
    """The most shingles that two sets with one reference can share: within it what the smaller part holds, outside it the
    bits of both, and once for each further shingle on a bit. Null where there is no reference."""
    both = sum((F.bit_count(F.get("mask", F.lit(i)).bitwiseAND(F.get("o_mask", F.lit(i)))) for i in range(MASK_WORDS)), F.lit(0))
    return F.when(F.col("mask").isNotNull() & F.col("o_mask").isNotNull(), F.least("inside", "o_inside") + both + F.least("spare", "o_spare"))


def _shingle_rows(width: int):
    """(set, shingle) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in slices(offs):
                hashes, at = shingle_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width)
                yield pa.record_batch([pa.array(np.repeat(ids[i:j], np.diff(at))), pa.array(hashes.view(np.int64))], names=["set_id", "shingle"])

    return run


def components(edges: DataFrame, used: list[DataFrame]) -> DataFrame:
    """(node, component): the least node that the links (a, b) lead to, for every node of a link.

    Rounds of two steps, each a join on keys: a node takes the least label among itself and its neighbours, then
    the label of its label, so that the rounds grow with the logarithm of the longest path. A round's labels are
    written to the shared folder; the last ones, which the result reads, join ``used``. The rounds end when no label changes.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    held = labels
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        hop = step.select(F.col("node").alias("via"), F.col("component").alias("further"))
        new = step.join(hop, step.component == hop.via).select("node", F.least("component", "further").alias("component"), "was")
        new = staged(new, "labels")
        discard(held)
        held, labels = new, new.select("node", "component")
        if not new.filter("component < was").limit(1).count():
            discard(both)
            used.append(held)
            return labels


def representatives(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``df`` that stay if each group of near duplicates keeps one document: all its columns.

    A group keeps the document of the least doc_id; of several texts under that doc_id, the one with the least hash,
    once. Rows without words or doc_id are linked with nothing, so all of them stay.
    """
    rows = df.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    alone = F.col(doc_id).isNull() | ~F.coalesce(F.col(text), F.lit("")).rlike(WORD)
    first = grouped_rows(df, doc_id, text, width, threshold).filter("doc_id = component_id AND text_hash = first_hash").select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias("__hash"))
    kept = rows.filter(~alone).join(first, [doc_id, "__hash"], "left_semi").dropDuplicates([doc_id, "__hash"])
    return rows.filter(alone).unionByName(kept.select(*rows.columns)).select(*df.columns)


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """One row for each row of ``df``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= ``threshold`` * union of their sets of ``width``-word
    shingles (by 64-bit hashes). component_id is the least doc_id that links lead to; kept: doc_id is that.

    Documents with equal sets count once from the start. For the rest:

    Sets of up to ``TINY`` shingles are linked to sets that lack one of them by the ids of those, with no bands.

    1. Each text gives ``REGISTERS`` HyperMinHash registers and ``BANDS`` keys, one Arrow slice at a time.
    2. The first bands link each set to the centre of its bucket; most groups of copies become one component here.
    3. All bands look for buckets that still hold several components, link the components' centres to the bucket's
       centre, and at last compare all sets of different components in a bucket. A large group of copies is one
       component by then, so its pairs are never listed. In a crowded bucket each set is first put in terms of one
       reference, the bucket's fullest: shingles shared with it, and a bitmap of the rest. That bounds the overlap of
       any two from above, so that sets just short of the threshold aren't paired with all of a group.
    4. Each candidate pair passes the corrected estimate, then the count of shingles on both whole texts.

    Null or blank text: an empty set, linked with nothing. Null doc_id: linked with nothing, component_id null and
    kept true. Rows that repeat a doc_id are each linked by their own text. An empty table gives an empty table.
    """
    return grouped_rows(df, doc_id, text, width, threshold).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def grouped_rows(df: DataFrame, doc_id: str, text: str, width: int, threshold: int) -> DataFrame:
    """``near_duplicates`` without kept, with each row's text_hash and its group's first_hash: the least hash among the texts of component_id."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    used: list[DataFrame] = []  # staged tables that the result doesn't read

    def stage(table: DataFrame, label: str) -> DataFrame:
        used.append(staged(table, label))
        return used[-1]

    signed = staged(docs.select("doc_id", "text_hash", "text").mapInArrow(_sign(width, threshold), SIGNATURE), "signatures")
    linked = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = stage(linked.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("d"), F.min("n_shingles").alias("n")).select("set_id", "d.*", "n"), "sets")
    # of the rows that share a set one keeps its registers
    chosen = linked.join(sets.select("set_id", "doc_id", "text_hash"), ["set_id", "doc_id", "text_hash"], "left_semi").select("set_id", F.col("n_shingles").alias("n"), "registers", "smaller")
    chosen = stage(chosen.dropDuplicates(["set_id"]), "chosen")

    def entries(labels: DataFrame | None, bands: int) -> DataFrame:
        """(key, set_id, component) for the first bands of each set."""
        of = chosen.select("set_id", "registers")
        own = of.withColumn("component", F.col("set_id")) if labels is None else of.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        return own.select("set_id", "component", "registers").mapInArrow(_buckets(bands), "key long, set_id long, component long")

    def whole_texts(ids: DataFrame) -> DataFrame:
        """(set_id, text), one text a set."""
        found = docs.join(sets.join(ids, "set_id", "left_semi").select("set_id", "doc_id", "text_hash"), ["doc_id", "text_hash"])
        return found.select("set_id", "text").dropDuplicates(["set_id"])

    def confirmed(pairs: DataFrame, label: str) -> DataFrame:
        """Of (a, b) with a < b, the pairs that reach the threshold."""
        side = lambda x: chosen.select(F.col("set_id").alias(x), F.col("registers").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
        pairs = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb")
        likely = stage(pairs.mapInArrow(_likely(threshold), "a long, b long"), f"{label}-likely")
        wanted = likely.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        whole = stage(whole_texts(wanted).mapInArrow(_hash_sets(width), "set_id long, full binary"), f"{label}-sets")
        full = lambda x: whole.select(F.col("set_id").alias(x), F.col("full").alias(f"f{x}"))
        pairs = likely.join(full("a"), "a").join(full("b"), "b").select("a", "b", "fa", "fb")
        links = stage(pairs.mapInArrow(_confirm(threshold), "a long, b long"), f"{label}-links")
        discard(likely, whole)
        return links

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    # First bands: each set against its bucket's centre, the set whose buckets are the fullest. Among copies of one
    # text that is the text itself or what is nearest to it, so most of the group links to it at once.
    # What is aggregated by a join's key is staged before that join: then both its sides come straight from a shuffle,
    # and AQE can split a bucket that outgrows a task.
    some = entries(None, FIRST_BANDS).select("key", "set_id")
    crowd = stage(some.join(stage(some.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "counts"), "key"), "crowd")
    score = stage(crowd.groupBy("set_id").agg(F.sum("c").alias("score")), "scores")
    crowd = crowd.join(score, "set_id")
    centre = stage(crowd.groupBy("key").agg(F.max_by("set_id", F.struct("score", "set_id")).alias("pivot")), "centres")
    found = confirmed(crowd.join(centre, "key").filter("set_id <> pivot").select(*pair("pivot", "set_id")), "first")
    # Small sets and what they are without one shingle: exact, whatever their registers.
    less = chosen.filter("smaller IS NOT NULL").select(F.col("set_id").alias("larger"), F.explode("smaller").alias("set_id"))
    found = stage(found.union(less.join(sets.select("set_id"), "set_id").select(*pair("set_id", "larger"))), "small")
    labels = components(found, used)

    # All bands: in buckets that hold several components, the centre of each against the centre of all.
    several = stage(entries(labels, BANDS).groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key"), "several")
    todo = stage(entries(labels, BANDS).join(several, "key").join(score, "set_id", "left").withColumn("score", F.coalesce("score", F.lit(0))), "mixed")
    heads = stage(todo.groupBy("key", "component").agg(F.max(F.struct("score", "set_id")).alias("p")).select("key", F.col("p.set_id").alias("set_id"), F.col("p.score").alias("score")), "heads")
    pivots = stage(heads.groupBy("key").agg(F.max_by("set_id", F.struct("score", "set_id")).alias("pivot")), "pivots")
    more = confirmed(heads.join(pivots, "key").filter("set_id <> pivot").select(*pair("pivot", "set_id")), "heads")
    found = stage(found.union(more), "links")
    labels = components(found, used)

    # What is left in buckets of three and more: all pairs of different components, each in the first bucket it shares.
    todo = todo.select("key", "set_id").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    still = stage(todo.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).filter("lo < hi AND c > 2").select("key"), "still")
    todo = stage(todo.join(still, "key"), "mixed")
    ids = todo.select("set_id").distinct()
    # A shingle that no other of these sets has can't be shared, which bounds the similarity of a pair from above.
    only = whole_texts(ids).mapInArrow(_shingle_rows(width), "set_id long, shingle long").groupBy("shingle").agg(F.min("set_id").alias("set_id"), F.count("*").alias("c")).filter("c = 1")
    only = only.groupBy("set_id").agg(F.count("*").alias("only"))
    about = chosen.join(ids, "set_id", "left_semi").select("set_id", "n", "registers").mapInArrow(_bands, "set_id long, n long, bands array<long>")
    about = about.join(only, "set_id", "left").withColumn("most", F.col("n") - F.coalesce("only", F.lit(0))).filter(F.col("most") * 100 >= F.col("n") * threshold).drop("only")
    todo = stage(todo.join(about, "set_id").join(score, "set_id", "left"), "mixed")
    refs = todo.groupBy("key").agg(F.max_by("set_id", F.struct(F.coalesce("score", F.lit(0)), "set_id")).alias("ref"), F.count("*").alias("c")).filter(F.col("c") > CROWDED).select("key", "ref")
    refs = stage(refs, "refs")
    crowded = stage(todo.select("key", "set_id").join(refs, "key"), "crowded")
    of_ref = crowded.select("set_id", "ref").distinct()
    whole = stage(whole_texts(of_ref.select(F.explode(F.array("set_id", "ref")).alias("set_id")).distinct()).mapInArrow(_hash_sets(width), "set_id long, full binary"), "crowded-sets")
    met = of_ref.join(whole, "set_id").join(whole.select(F.col("set_id").alias("ref"), F.col("full").alias("ref_full")), "ref").select("set_id", "ref", "full", "ref_full")
    met = met.mapInArrow(_against_reference, "set_id long, ref long, inside long, spare long, mask array<long>")
    todo = stage(todo.drop("score").join(crowded.join(met, ["set_id", "ref"]).drop("ref"), ["key", "set_id"], "left"), "mixed")
    other = todo.select("key", *(F.col(c).alias(f"o_{c}") for c in ("bands", "set_id", "n", "component", "most", "inside", "spare", "mask")))
    most = F.least("most", "o_most", _shared_at_most())
    may = (most * 100 >= (F.col("n") + F.col("o_n") - most) * threshold) & (F.least("n", "o_n") * 100 >= F.greatest("n", "o_n") * threshold)
    first = F.expr("get(bands, array_position(zip_with(bands, o_bands, (x, y) -> x = y), true) - 1) = key")
    across = todo.join(other, "key").filter((F.col("component") < F.col("o_component")) & may & first)
    links = confirmed(across.select(*pair("set_id", "o_set_id")), "across")
    labels = components(found.union(links), used)

    grouped = sets.select("set_id", "doc_id", "text_hash").join(labels.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    grouped = staged(grouped, "grouped")
    least = grouped.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("d")).select("component", F.col("d.doc_id").alias("component_id"), F.col("d.text_hash").alias("first_hash"))
    least = staged(least, "groups")
    discard(*used)
    of_set = grouped.select("set_id", "component").join(least, "component").select("set_id", "component_id", "first_hash")
    alone = F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").isNull()
    rows = signed.select("doc_id", "text_hash", "n_shingles", "set_id").join(of_set, "set_id", "left")
    rows = rows.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    return rows.select("doc_id", "n_shingles", "component_id", "text_hash", "first_hash")
