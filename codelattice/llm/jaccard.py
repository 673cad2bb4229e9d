"""Operator 6: near copies by the Jaccard similarity of shingle sets, over token-combination prefixes.

Tokens are shingles, in one global order: rarer first, by counters that shingles share by their
hashes. Of a set of n tokens at most n // 4 can be missing in a set that it links with. Its prefix
is extended until the signatures made from it can't all be lost to so many tokens: a rare token is a
signature by itself; frequent tokens fall into groups by their hash, the more the larger the set, and every two of
a group in the prefix make a signature, so a group's first token adds nothing to the count. Two sets that link
then share a signature (prefix filtering with k-token combinations; Wang et al., 2016). Sets of at
most SHORT tokens, whose frequent tokens may not suffice for that, are indexed a second way, by single tokens, with
all sets of a size that may link with them.

A rare token's group of sets is bounded by its counter; groups of frequent signatures are
pre-aggregated. Pairs aren't listed: in each round the first few sets of a group are compared with
those of its sets that aren't connected with them yet, so that a group of copies takes one
comparison for each. A pair is first held against a bound on its overlap from small parity bitmaps
(Sandes et al., 2020), which drops nearly all that only share a passage; the sets of the rest are
compared in full. All pairs that share a signature end up refuted, verified or connected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut, give_back, released, wide
from .components import connected
from .shingles import PLACES, mix, shingle_hashes, word_hashes

#: Counters of shingles; the table is sent to all tasks (a byte each), whatever the input's size.
COUNTER_BITS = 22
GROUPS, SHORT = 32, 44  # groups at least
#: About half as many sets as a group compares with all its others, by round; from then on ever more.
ROUND_HUBS = (8, 64, 512)
#: Bits of the table of wanted documents: at least 2**the first, about 16 for each document, at most 2**the second (64 MB sent to all tasks; beyond that more of the others pass it, and the join drops them).
BLOOM_BITS = 22, 29
#: Places in which the sets of a component meet its one row, and shares in which a group's first sets are found.
SALTS = 32
#: Of a shingle's hash; a rank of up to MOST, rare up to RARE, stands above it in one 64-bit number.
TOKEN_BITS, MOST, RARE = 52, 255, 100
CHUNK = 256
#: Rows sent to Python at once; all of this operator's Python runs before it returns.
ARROW_ROWS = 1_000
#: Documents to drop whose ids (8 bytes each) are sent to all tasks; more meet the texts by a shuffle.
BROADCAST_IDS = 400_000
#: Sets that link (16 bytes each) whose labels are sent to all tasks in a round; more meet the signatures by a shuffle.
BROADCAST_LABELS = 100_000


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Stretches of at most so many rows and bytes of text (but a row at least), as the arrays made of them are several times larger."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < batch.num_rows:
            before = int(ends[k - 1]) if k else 0
            n = max(1, min(rows, int(np.searchsorted(ends, before + size, "right")) - k))
            yield batch.slice(k, n)
            k += n
    batch = ends = None
    give_back()


def shingle_ranks(docs: DataFrame, frequent: int | None = None, bits: int = COUNTER_BITS) -> np.ndarray:
    """The place of shingles in the global order by 2**bits counters of their hashes: up to RARE for rare ones, above for frequent ones.

    Occurrences in all texts are counted, by a task up to 255 in each counter. Frequent is what stands
    out from the counters' mean, which grows with the input as shared passages do. The table has
    one byte for each counter, whatever the input's size.
    """
    pieces = 64
    size = (1 << bits) // pieces

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for part in _slices(batches, 1024):
            tokens, _ = shingle_hashes(*word_hashes(part.column(1)))
            np.add.at(total, (tokens >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        rows = [np.minimum(total[k * size : (k + 1) * size], 255).astype(np.uint8).tobytes() for k in range(pieces)]
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array(rows, pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(blob.as_buffer(), np.uint8).astype(np.uint32)
        rows = [x.astype("<u4").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([int(x.sum()) for x in sums.values()], pa.int64()), pa.array(rows, pa.binary())], ["piece", "total", "counts"])

    summed = cut(_texts(docs).mapInArrow(count, "piece int, counts binary").repartitionById(min(pieces, wide(docs.sparkSession)), F.col("piece")).mapInArrow(add, "piece int, total long, counts binary"))
    mean = (summed.agg(F.sum("total")).head()[0] or 0) / (1 << bits)
    limit = max(1, frequent if frequent is not None else int(3 * mean + 32))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.minimum(np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64) * np.uint64(RARE) // np.uint64(limit), MOST).astype(np.uint8).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], ["piece", "ranks"])

    out = np.zeros(1 << bits, np.uint8)
    found = summed.select("piece", "counts").mapInArrow(place, "piece int, ranks binary").toArrow()
    for piece, blob in zip(found.column("piece").to_pylist(), found.column("ranks")):
        out[piece * size : (piece + 1) * size] = np.frombuffer(blob.as_buffer(), np.uint8)
    return out


def distinct_keys(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each text in ascending order, and where each text's begin and the last's end."""
    keys = keys.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        keys[a:b].sort()
    kept = np.ones(len(keys), bool)
    kept[1:] = keys[1:] != keys[:-1]
    kept[bounds[:-1][bounds[:-1] < len(keys)]] = True
    return keys[kept], np.append(0, np.cumsum(kept))[bounds]


def prints_of(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each text's set, whatever the order of its distinct tokens; 0 for an empty set."""
    sizes, out = np.diff(bounds), []
    full = np.flatnonzero(sizes)
    for place in (1, 2):
        got = np.zeros(len(sizes), np.uint64)
        if len(full):
            got[full] = mix(np.add.reduceat(mix(tokens ^ PLACES[place]), bounds[:-1][full]) + sizes[full].astype(np.uint64))
        out.append(got.view(np.int64))
    return out[0], out[1]


def token_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of each text, ascending, and their bounds. A token is the upper TOKEN_BITS of a shingle's hash."""
    tokens, bounds = shingle_hashes(*word_hashes(texts))
    return distinct_keys(tokens >> np.uint64(64 - TOKEN_BITS), bounds)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, print, print2 of each row; prints are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            tokens, bounds = token_sets(part.column(1))
            sizes, (one, two) = np.diff(bounds), prints_of(tokens, bounds)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int64)), pa.array(one, mask=sizes == 0), pa.array(two, mask=sizes == 0)], ["doc_id", "n_shingles", "print", "print2"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, print long, print2 long")


def group_counts(n: int) -> list[int]:
    """Into how many groups a set of n tokens deals its frequent ones: a power of two that grows with the set, for each size that may link with it.

    Sizes that link differ by a factor of at most 4 / 3, so there are two numbers at most, and two sets that link share one.
    """
    return sorted({max(GROUPS, (1 << (m.bit_length() - 1)) // 8) for m in (-(-3 * n // 4), 4 * n // 3)})


def signatures_of(tokens: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set and whether each may have a large group. tokens: distinct, in the global order; often: which are frequent.

    Groups grow in number with the set, so a set of n frequent tokens has about n signatures, not n squared.
    """
    n = len(tokens)
    missing = n // 4
    parts, hot = [], []
    if n <= SHORT * 4 // 3 + 1:  # by single tokens, with the sizes that may link with a short set
        parts.append(mix(tokens[: missing + 1] ^ PLACES[3]))
        hot.append(often[: missing + 1])
    if n > SHORT:
        rare = int(n - often.sum())  # rare tokens come first
        single = tokens[: min(rare, missing + 1)]
        parts.append(mix(single ^ PLACES[4]))
        hot.append(np.zeros(len(single), bool))
        if rare < missing + 1:
            rest = tokens[rare:]
            for groups in group_counts(n):
                group = (rest % np.uint64(groups)).astype(np.int64)
                first = np.zeros(len(rest), bool)
                first[np.unique(group, return_index=True)[1]] = True
                upto = int(np.searchsorted(np.cumsum(~first), missing + 1 - rare)) + 1
                order = np.lexsort((rest[:upto], group[:upto]))
                own, of = rest[:upto][order], group[:upto][order]
                apart = 1
                while apart < len(own) and (same := of[apart:] == of[:-apart]).any():  # every two of a group, the smaller first
                    parts.append(mix(own[:-apart][same] * PLACES[0] + mix(own[apart:][same] ^ PLACES[1]) + np.uint64(groups)))
                    hot.append(np.ones(len(parts[-1]), bool))
                    apart += 1
    return np.concatenate(parts), np.concatenate(hot)


def signatures(docs: DataFrame, order: np.ndarray, bits: int = COUNTER_BITS) -> DataFrame:
    """sig, print, n, most, hot of every text; a task leaves out sets that it has just had. order: from shingle_ranks().

    most bounds the overlap of two sets that share no other signature. A set with frequent signatures
    has all its rare tokens as signatures too, so two such sets that share no rare one overlap in
    frequent tokens only, of which `most` is the number; for a rare signature it is the set's size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)
    low_bits = np.uint64((1 << TOKEN_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in _slices(batches):
            tokens, at = shingle_hashes(*word_hashes(part.column(1)))
            rank = shared.value[(tokens >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
            # the rank above the token: one number that sorts in the global order
            keys, at = distinct_keys(rank << np.uint64(TOKEN_BITS) | tokens >> np.uint64(64 - TOKEN_BITS), at)
            tokens, often, sizes = keys & low_bits, (keys >> np.uint64(TOKEN_BITS)) > RARE, np.diff(at)
            prints, _ = prints_of(tokens, at)
            fresh = np.zeros(len(sizes), bool)
            for k, one in enumerate(prints.tolist()):
                if sizes[k] and one not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(one)
                    fresh[k] = True
            length = sizes // 4 + 1
            last = np.minimum(at[:-1] + length, max(1, len(keys))) - 1
            plain = fresh & (sizes > SHORT * 4 // 3 + 1)
            if len(keys):
                plain &= ~often[last]
            rows = np.flatnonzero(plain)
            size = length[rows]
            index = np.repeat(at[:-1][rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
            frequent = np.diff(np.append(0, np.cumsum(often))[at])
            sigs, hots, owners = [mix(tokens[index] ^ PLACES[4])], [np.zeros(len(index), bool)], [np.repeat(rows, size)]
            for k in np.flatnonzero(fresh & ~plain):
                sig, hot = signatures_of(tokens[at[k] : at[k + 1]], often[at[k] : at[k + 1]])
                sigs.append(sig)
                hots.append(hot)
                owners.append(np.full(len(sig), k))
            owner, hot = np.concatenate(owners), np.concatenate(hots)
            most = np.where(hot, frequent[owner], sizes[owner]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(prints[owner]), pa.array(sizes[owner].astype(np.int32)), pa.array(most), pa.array(hot)], ["sig", "print", "n", "most", "hot"])

    return _texts(docs).mapInArrow(run, "sig long, print long, n int, most int, hot boolean")


def shared_signatures(found: DataFrame) -> DataFrame:
    """sig, print, n, most of the signatures that more than one set has; of those with the very same sets one stands for all.

    All signatures are shuffled once. Groups of rare ones are bounded and complete after that; they get
    a number made from their members in the place of the signature, so that equal groups become one.
    Groups of frequent ones are spread by a salt, and then reduced to the ends and a sum of their prints.
    """
    salt = F.when(F.col("hot"), F.pmod("print", F.lit(64))).otherwise(0)
    own = Window.partitionBy("sig", "hot", "salt")
    ends = found.withColumn("salt", salt).withColumns({"lo": F.min("print").over(own), "hi": F.max("print").over(own), "all": F.bit_xor(F.xxhash64("print")).over(own), "rows": F.count("*").over(own)})
    group = F.when(F.col("hot"), F.col("sig")).otherwise(F.xxhash64("lo", "hi", "all", "rows"))
    kept = released(cut(ends.where("hot or lo <> hi").select(group.alias("sig"), "print", "n", "most", "hot").distinct()))
    often = kept.where("hot").drop("hot")
    groups = often.groupBy("sig").agg(F.min("print").alias("lo"), F.max("print").alias("hi"), F.bit_xor(F.xxhash64("print")).alias("all"), F.count("*").alias("rows")).where("lo <> hi")
    shared = often.join(groups.select("sig", F.xxhash64(F.lit("frequent"), "lo", "hi", "all", "rows").alias("group")), "sig").select(F.col("group").alias("sig"), "print", "n", "most")
    return kept.where("not hot").drop("hot").unionByName(shared).distinct()


def central(shared: DataFrame, percent: int) -> DataFrame:
    """shared with far and light. far: less the more other sets a set meets in its groups, so that the first of a group is the likeliest to link.

    light: whether a set can be the lighter one of a pair. With r = n - most tokens that can't be
    shared, a pair of at most `most` shared tokens links only if r + r' is at most (100 - p) / p times
    those, so at least one of the two has 2 * p * r <= (100 - p) * most; pairs without one needn't be looked at.
    """
    sizes = shared.groupBy("sig").agg(F.count("*").alias("members"))
    far = shared.join(sizes, "sig").groupBy("print").agg((-F.sum("members")).alias("far"))
    light = 2 * percent * (F.col("n") - F.col("most")) <= (100 - percent) * F.col("most")
    return shared.join(far, "print").withColumn("light", light)


def _bloom(wanted: DataFrame) -> np.ndarray:
    """A bit table over rep; its size follows the number of rows, up to 2**BLOOM_BITS[1] bits."""
    low, high = BLOOM_BITS
    bits = min(high, max(low, (16 * wanted.count() - 1).bit_length()))
    place = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(1 << bits)).alias("place"))
    words = place.select(F.shiftright("place", 5).alias("word"), F.expr("shiftleft(1L, cast(place & 31 AS int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 32, np.uint32)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out


def packed(tokens: np.ndarray) -> bytes:
    """A sorted set as the gaps between its tokens, in as few bytes each as the largest needs."""
    gaps = np.diff(tokens, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(blob) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    width = int(raw[0])
    gaps = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    gaps[:, :width] = raw[1:].reshape(len(gaps), -1)
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def parity(tokens: np.ndarray) -> bytes:
    """A set's size and a bit for each place that an odd number of its tokens fall on, at least twice as many places as tokens."""
    n = len(tokens)
    places = max(64, min(1 << 18, 1 << (2 * n - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return n.to_bytes(4, "little") + np.packbits(odd.astype(bool)).tobytes()


def may_link(one: bytes, two: bytes, percent: int) -> bool:
    """Whether parities allow a link. Every odd place of the two together stems from a token that just one set has, so those bound the overlap.

    The longer parity is folded first: its place modulo the other's length is that of the other.
    """
    n, m = int.from_bytes(one[:4], "little"), int.from_bytes(two[:4], "little")
    a, b = (np.unpackbits(np.frombuffer(x, np.uint8, offset=4)) for x in (one, two))
    if len(a) < len(b):
        a, b = b, a
    a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    both = (n + m - int(np.count_nonzero(a != b))) // 2
    return 100 * both >= percent * (n + m - both)


def _payloads(docs: DataFrame, wanted: DataFrame, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    """print, payload made from the tokens of the sets in wanted (print, rep: the document to take it from), and of a few others.

    Texts aren't shuffled: a bit table leaves out nearly all other documents where they lie.
    """
    wanted = cut(wanted)
    table = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bits = table.value
        mask = 32 * len(bits) - 1
        for batch in batches:
            # the same hash as Spark's xxhash64 of a long: its bytes with seed 42
            places = [xxhash.xxh64_intdigest((x or 0).to_bytes(8, "little", signed=True), 42) & mask for x in batch.column(0).to_pylist()]
            found = [k for k, p in enumerate(places) if int(bits[p >> 5]) >> (p & 31) & 1]
            if not found:
                continue
            for part in _slices([batch.take(pa.array(found))]):
                tokens, bounds = token_sets(part.column(1))
                prints, _ = prints_of(tokens, bounds)
                full = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(prints[full]), pa.array([make(tokens[bounds[k] : bounds[k + 1]]) for k in full], pa.binary())], ["print", "payload"])

    return _texts(docs).mapInArrow(run, "print long, payload binary")


def linked(one: bytes, two: bytes, percent: int) -> bool:
    """Whether two packed sets link."""
    a, b = unpacked(one), unpacked(two)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def compare(pairs: DataFrame, payloads: DataFrame, test: Callable[[bytes, bytes, int], bool], percent: int) -> DataFrame:
    """The pairs (hub, print) whose payloads pass the test. A hub is sent once for every CHUNK of its pairs; each other once for each of its pairs."""
    spark = pairs.sparkSession
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    others = pairs.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"), "print")
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select("hub", "chunk", F.lit(0).alias("role"), F.col("hub").alias("print"))
    rows = others.unionByName(hubs).join(payloads, "print").select("hub", "chunk", "role", "print", "payload")
    rows = rows.repartition(wide(spark), "hub", "chunk").sortWithinPartitions("hub", "chunk", "role", "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, b""
        for batch in batches:
            a, b = [], []
            for h, role, p, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                payload = blob.as_py()
                if not role:
                    hub, own = h, payload
                    continue
                assert h == hub
                if test(own, payload, percent):
                    a.append(h)
                    b.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["hub", "print"])

    return rows.mapInArrow(run, "hub long, print long").distinct()


def _near(n: Column, most: Column, hub_n: Column, hub_most: Column, percent: int) -> Column:
    """Whether sizes and the bounds on shared tokens allow a link."""
    both = F.least(most, hub_most)
    return 100 * both >= percent * (n + hub_n - both)


def _linked(docs: DataFrame, reps: DataFrame, percent: int, frequent: int | None) -> DataFrame:
    """print, label: sets that link with others, by the least print of their component (which has no row).

    reps: print, rep (a doc_id with that set, 0 for null).
    """
    spark = docs.sparkSession
    work = released(cut(central(shared_signatures(signatures(docs, shingle_ranks(docs, frequent))), percent)))
    labels = spark.createDataFrame([], "print long, label long")
    if not work.take(1):
        return labels
    sent = labels
    links = tested = spark.createDataFrame([], "a long, b long")
    sketches = cut(_payloads(docs, work.select("print").distinct().join(reps, "print"), parity))
    def still_open() -> DataFrame:
        """Rows of the groups that hold sets of several labels and a light one, with the group's first set, light ones before others."""
        labelled = work.join(sent, "print", "left").select("sig", "print", "n", "most", "far", "light", F.coalesce("label", "print").alias("label"))
        first = F.min(F.struct((~F.col("light")).alias("heavy"), "far", "print", "n", "most", "label")).alias("first")
        # written, so that the join has a shuffle on both sides and Spark splits a group that many sets are in
        ends = cut(labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), first).where("lo <> hi and not first.heavy").drop("lo", "hi"))
        return labelled.join(ends, "sig")

    step = 0
    while True:
        if not step:  # each set only with the first of all firsts of its groups
            pairs = still_open().select("print", "n", "most", "label", F.col("first.far").alias("hub_far"), F.col("first.print").alias("hub"), F.col("first.n").alias("hub_n"), F.col("first.most").alias("hub_most"), F.col("first.label").alias("hub_label"))
            pairs = pairs.where(_near(F.col("n"), F.col("most"), F.col("hub_n"), F.col("hub_most"), percent) & (F.col("label") != F.col("hub_label")))
            pairs = pairs.groupBy("print").agg(F.min(F.struct("hub_far", "hub")).alias("h")).select("print", "h.hub")
        else:
            k = ROUND_HUBS[min(step - 1, len(ROUND_HUBS) - 1)] * 4 ** max(0, step - len(ROUND_HUBS))
            live = cut(still_open().drop("first"))
            if not live.take(1):
                break
            # each share of a group gives its first sets and, if it may have more, where they end; up to the least of these ends a group's first sets are known
            order = F.struct((~F.col("light")).alias("heavy"), "far", "print")
            most_of_share = 2 * k // SALTS + 4
            heads = live.withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(SALTS)))
            heads = heads.withColumn("place", F.row_number().over(Window.partitionBy("sig", "salt").orderBy(F.desc("light"), "far", "print"))).where(F.col("place") <= most_of_share)
            hubs = F.collect_list(F.when(F.col("light"), F.struct("far", "print", "n", "most", "label"))).alias("hubs")
            known = heads.groupBy("sig").agg(hubs, F.min(F.when(F.col("place") == most_of_share, order)).alias("last"))
            upto = F.filter("hubs", lambda h: F.col("last").isNull() | (F.struct(F.lit(False).alias("heavy"), h["far"].alias("far"), h["print"].alias("print")) <= F.col("last")))
            # written, so that the joins have a shuffle on both sides and Spark splits a group that many sets are in
            firsts = cut(known.select("sig", upto.alias("hubs"), "last"))

            def before(h: Column) -> Column:
                return ~F.col("light") | (h["far"] < F.col("far")) | ((h["far"] == F.col("far")) & (h["print"] < F.col("print")))

            # the hubs that a set may link with are gathered by set, so that a pair that shares many groups is made once
            fits = F.filter("hubs", lambda h: before(h) & (h["label"] != F.col("label")) & _near(F.col("n"), F.col("most"), h["n"], h["most"], percent))
            # one row for each of live, written, so that the join is made once: its hubs, and whether the next round has it too
            more = F.col("last").isNotNull() & F.coalesce(order > F.col("last"), F.lit(False))
            met = cut(live.join(firsts, "sig").select("sig", "print", "n", "most", "far", "light", F.transform(fits, lambda h: h["print"]).alias("hubs"), more.alias("more")))
            each = met.where(F.size("hubs") > 0)
            pairs = each.groupBy("print").agg(F.array_distinct(F.flatten(F.collect_list("hubs"))).alias("hubs")).select(F.explode("hubs").alias("hub"), "print")
            pairs = pairs.join(tested, (F.col("hub") == F.col("a")) & (F.col("print") == F.col("b")), "left_anti")
            work = met.where("more").drop("hubs", "more")
        pairs = cut(pairs.select("hub", "print"))
        step += 1
        if not pairs.take(1):
            continue
        # as many partitions as one round has, however many rounds there were
        tested = tested.unionByName(pairs.select(F.col("hub").alias("a"), F.col("print").alias("b"))).coalesce(wide(spark))
        likely = cut(compare(pairs, sketches, may_link, percent))
        ends = likely.select(F.explode(F.array("hub", "print")).alias("print")).distinct()
        found = compare(likely, _payloads(docs, ends.join(reps, "print"), packed), linked, percent)
        groups = released(connected(links.unionByName(found.select(F.col("hub").alias("a"), F.col("print").alias("b")))))
        labels = groups.select(F.col("node").alias("print"), F.col("component").alias("label"))
        sent = F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels
        links = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return labels


def near_copies(docs: DataFrame, percent: int = 75, frequent: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; component_id is the smallest doc_id reachable by links.

    A null, empty or blank text has no shingle and its own doc_id. A row with a null doc_id is kept; its component is
    the smallest doc_id linked with it, null if there is none. Rows that repeat a doc_id are linked like
    any others. An empty table gives an empty result. Other columns are dropped.
    """
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        prints = cut(fingerprints(docs))
        clash = prints.groupBy("print").agg(F.min("print2").alias("lo"), F.max("print2").alias("hi")).where("lo <> hi").take(1)
        if clash:
            raise RuntimeError("two different sets have the same 64-bit fingerprint")
        reps = cut(prints.where("print is not null").groupBy("print").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("rep")))
        labels = _linked(docs, reps, percent, frequent)
    # the least doc_id of each set, then of each component; a component's many sets meet its one row in SALTS places
    each = prints.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("least"))
    each = cut(each.join(labels, "print", "left").withColumn("label", F.coalesce("label", "print")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    whole = each.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("sets")).where("sets > 1").select("label", "component", salts.alias("salt"))
    each = each.withColumn("salt", F.pmod(F.xxhash64("print"), F.lit(SALTS)).cast("int")).join(whole, ["label", "salt"], "left")
    found = cut(each.select("print", F.coalesce("component", "least").alias("component")))  # written: copies of one text are a large group that Spark then splits
    return prints.join(found, "print", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; all without shingles stay. Columns as in docs.

    Rows that repeat that doc_id all stay, as nothing tells them apart.
    """
    gone = cut(near_copies(docs, percent).where("component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("j_doc_id")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["j_doc_id"], "left_anti")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
tokens AS (SELECT doc_id, hash(t) AS t FROM (SELECT doc_id, unnest(s) AS t FROM sets)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT s.a, s.b FROM shared s JOIN sets x ON x.doc_id = s.a JOIN sets y ON y.doc_id = s.b WHERE 100 * s.both >= 75 * (len(x.s) + len(y.s) - s.both)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT w.a, l.b FROM walk w JOIN ways l ON l.a = w.b),
low AS (SELECT a, min(b) AS component_id FROM walk GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, low.component_id FROM sets s JOIN low ON low.a = s.doc_id
"""
