"""Exact Jaccard self-join of word shingles by a token-group matrix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline.llm import words as W
from wickline.llm.components import components
from wickline.llm.scratch import batches_of, written

SHINGLE_BYTES = 1 << 20
RANGE = 1 << 14
SENT = 16
FILTER_WORDS = 1 << 16
STAR = 500
STARS = 3
COUNTER_BYTES = 128
LEAST_BITS, MOST_BITS = 16, 24


@dataclass(frozen=True)
class JaccardJoin:
    """Documents link when ``100 * intersection >= percent * union`` of their distinct
    ``width``-word shingles. ``table_bits``: 2 ** table_bits counters estimate how
    often shingles occur, by default one for ``COUNTER_BYTES`` of text within
    ``LEAST_BITS`` and ``MOST_BITS``; they only order the shingles, the result is the same
    for any number. ``group_size``: members of a group of the matrix."""

    width: int = 5
    percent: int = 80
    table_bits: int | None = None
    group_size: int = 64

    def sized(self, n_bytes: int) -> JaccardJoin:
        """The rule with counters in proportion to the text."""
        bits = self.table_bits or min(max((n_bytes // COUNTER_BYTES).bit_length(), LEAST_BITS), MOST_BITS)
        return replace(self, table_bits=bits)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n + (-self.percent * n // 100) + 1


# ---------------------------------------------------------------- sets of one batch


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of each text, sorted by both. A text with
    fewer words than ``width`` has its whole sequence as its one shingle."""
    words = W.words(pc.ascii_lower(texts))
    hashes = W.content_hashes(words.values)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    first, keys = W.windows(hashes, words.owner, width)
    owner = words.owner[first]
    count = words.per_text()
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        starts = np.concatenate([[0], np.cumsum(count)])[short]
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            more = count[short] > k
            whole[more] = W.mix(whole[more] * W.GOLDEN + hashes[starts[more] + k])
        owner, keys = np.concatenate([owner, short]), np.concatenate([keys, W.mix(whole + count[short].astype(np.uint64))])
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    return owner[new], keys[new]


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


# ------------------------------------------------------- how common a shingle may be


def _local_counts(width: int, bits: int):
    """A task's counters, in packed ranges, ``SENT`` at a time: they are packed, sent and
    given back one after the other and never beside each other whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, texts in W.pieces(batch, "text", SHINGLE_BYTES):
                found, n = np.unique(_bucket(shingle_sets(texts, width)[1], bits), return_counts=True)
                table[found] += n.astype(np.uint32)
        parts = table.reshape(-1, RANGE)
        for at in range(0, len(parts), SENT):
            some = {at + k: part for k, part in enumerate(parts[at : at + SENT]) if part.any()}
            if some:
                yield _ranges(0, some)
        W.give_back()

    return run


def _packed(counts: np.ndarray) -> bytes:
    """A range of counters: a bit for each that isn't 0, then those byte by byte."""
    found = counts > 0
    some = counts[found].astype("<u8")
    return np.packbits(found).tobytes() + np.ascontiguousarray(some.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    counts = np.zeros(RANGE, np.uint64)
    raw = np.frombuffer(packed, np.uint8)
    found = np.unpackbits(raw[: RANGE // 8]).view(bool)
    counts[found] = np.ascontiguousarray(raw[RANGE // 8 :].reshape(8, -1).T).view("<u8").ravel()
    return counts


def _ranges(salt: int, parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    blobs = [_packed(p) for p in parts.values()]
    columns = [pa.array([salt] * len(parts), pa.int32()), pa.array(list(parts), pa.int32()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["salt", "part", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by salt and part to one row each; holds one range at a time."""
    key, total = None, None
    for batch in batches:
        for salt, part, blob in zip(*(c.to_pylist() for c in batch.columns)):
            counts = _unpacked(blob)
            if (salt, part) != key:
                if key is not None:
                    yield _ranges(key[0], {key[1]: total})
                key, total = (salt, part), counts
            else:
                total += counts
    if key is not None:
        yield _ranges(key[0], {key[1]: total})


def count_classes(texts: DataFrame, rule: JaccardJoin) -> np.ndarray:
    """Per counter the bit length of its count over all documents. What tasks send is
    added up in two rounds, so no task adds up the ranges of all; the driver gets
    2 ** table_bits bytes at most."""
    schema = "salt int, part int, counts binary"
    local = texts.select("text").mapInArrow(_local_counts(rule.width, rule.table_bits), schema)
    salted = local.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(8)).cast("int"))
    for salt in (F.col("salt"), F.lit(0)):
        placed = salted.withColumn("salt", salt.cast("int")).repartition("salt", "part")
        salted = placed.sortWithinPartitions("salt", "part").mapInArrow(_add_up, schema)
    classes = np.zeros(1 << rule.table_bits, np.uint8)
    for row in salted.toLocalIterator():
        counts = _unpacked(row.counts)
        classes[row.part * RANGE : (row.part + 1) * RANGE] = np.ceil(np.log2(counts.astype(np.float64) + 1))
    return classes


# ------------------------------------------------------------------ sets and prefixes


def _profiler(rule: JaccardJoin, shared_classes):
    """Rows with set size, digest of the set, and the prefix: its rarest shingles, as
    many as can't all be missing from a set that links. Shingles whose counter says
    that no other document has them are left out of the prefix. ``common`` is the mean
    class of the whole prefix, in 256ths: it is highest for the middle of a group of
    near copies, as each edit brings rare shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared_classes.value
        for batch in batches:
            for part, texts in W.pieces(batch, "text", SHINGLE_BYTES):
                owner, keys = shingle_sets(texts, rule.width)
                n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])
                raw = keys.tobytes()
                digests = [
                    hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None
                    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())
                ]
                level = classes[_bucket(keys, rule.table_bits)]
                order = np.lexsort((keys, level, owner))
                place = np.arange(len(keys)) - ends[owner]
                within = place < rule.prefix(n)[owner]
                chosen = order[within & (level[order] > 1)]
                classed = np.bincount(owner, np.where(within, level[order], 0), minlength=len(texts))
                common = (256 * classed / np.maximum(rule.prefix(n), 1)).astype(np.int32)
                lengths = np.bincount(owner[chosen], minlength=len(texts))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(keys[chosen].view(np.int64))
                )
                kept = part.select(["row_id", "id", "id_key", "text_hash"])
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(n), pa.array(digests, pa.binary()), lists, pa.array(common)],
                    names=["row_id", "id", "id_key", "text_hash", "n", "digest", "prefix", "common"],
                )

    return run


def _blobs(width: int, short: bool):
    """The column ``text`` replaced by ``set``, the sorted shingles as bytes, and, if
    asked for, ``short``: their first 16 bits. Equal shingles have equal bits, so short
    forms share at least as many items as the sets do. One step for both, as each step
    of a task holds a Python worker of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in W.pieces(batch, "text", SHINGLE_BYTES):
                owner, keys = shingle_sets(texts, width)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]) * 8
                forms = {"set": (keys.tobytes(), ends)}
                if short:
                    forms["short"] = ((keys >> np.uint64(48)).astype(np.uint16).tobytes(), ends // 4)
                kept = part.drop_columns(["text"])
                blobs = [pa.array([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()) for raw, at in forms.values()]
                yield pa.RecordBatch.from_arrays([*kept.columns, *blobs], names=[*kept.schema.names, *forms])

    return run


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, a key of it that is never null, hash of the text, text."""
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(
        ident.alias("id"), F.coalesce(ident.cast("string"), F.lit("")).alias("id_key"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    )


def _marked(rows: DataFrame, asked: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows`` with ``near``, whether their ``keys`` may be in ``asked``, by a bit table
    of fixed size, broadcast. A table that fills up marks more rows. An inner join drops
    some of the others already."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(64 * FILTER_WORDS))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    table = asked.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("mask"))
    held = rows.withColumn("slot", slot).join(F.broadcast(table), F.shiftright("slot", 6) == F.col("word"), how)
    return held.select(*rows.columns, (F.coalesce("mask", F.lit(0)).bitwiseAND(bit) != 0).alias("near"))


def _nearly(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose ``keys`` may be in ``asked``; nearly all others are dropped where they
    are. The join that follows decides; more rows let through change nothing else."""
    return _marked(rows, asked, keys, "inner").filter("near").drop("near")


def _first_rows(profiles: DataFrame, same: DataFrame) -> DataFrame:
    """The row of each node in ``same``. Rows without copies are that already and stay
    where they are with their prefixes; only those that may have copies are joined."""
    marked = _marked(profiles.filter("n > 0"), same.filter("copies > 1"), ["digest"])
    first = marked.filter("near").join(same.select("node"), F.col("row_id") == F.col("node"), "left_semi")
    return marked.filter("NOT near").union(first).drop("near")


def _sets_of(rows: DataFrame, asked: DataFrame, rule: JaccardJoin, short: bool = False) -> DataFrame:
    """``asked`` (with ``id_key`` and ``text_hash``) with the shingles of their texts,
    which are read again, and their short forms. Repeated rows are one before they move, and the join is on
    the key of that step, so texts move once."""
    keys = ["id_key", "text_hash"]
    near = _nearly(rows.select(*keys, "text"), asked, keys).groupBy(*keys).agg(F.first("text").alias("text"))
    found = asked.join(near, keys).drop(*keys)
    schema = ", ".join(f"{c} {kind}" for c, kind in found.drop("text").dtypes) + ", set binary" + ", short binary" * short
    return found.mapInArrow(_blobs(rule.width, short), schema)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Items of two sorted arrays in common, repeated ones as often as in both."""
    if a.dtype == np.uint64:
        return len(np.intersect1d(a, b, assume_unique=True))
    items, n = np.unique(a, return_counts=True)
    others, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(items, others, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = _common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _pair_links(percent: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in W.slices(whole, ["u_set", "v_set"], SHINGLE_BYTES)):
            sets = [[np.frombuffer(x.as_buffer(), kind) for x in batch.column(k)] for k in (2, 3)]
            good = [_enough(a, b, percent) for a, b in zip(*sets)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _star_links(percent: int):
    """Rows sorted by star, its pivot first: the members that link with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, pivot = None, None
        for batch in (part for whole in batches for part in W.slices(whole, ["set"], SHINGLE_BYTES)):
            found: list[tuple[int, int]] = []
            for at, salt, node, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3)):
                shingles = np.frombuffer(blob.as_buffer(), np.uint64)
                if node == at:
                    star, pivot = (at, salt), shingles.copy()
                elif (at, salt) == star and _enough(pivot, shingles, percent):
                    found.append((at, node))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], []))], names=["u", "v"])

    return run


# ----------------------------------------------------------------------- the join


def _fit(percent: int, a: Column, b: Column) -> Column:
    """Whether sets of these sizes can link."""
    return (a * percent <= b * 100) & (b * percent <= a * 100)


def _needed(percent: int, a: Column, b: Column) -> Column:
    """Least number of shingles that the prefixes of two linked sets of these sizes
    share: what the overlap needs, less what may lie behind the prefix of the larger."""
    overlap = F.ceil(percent * (a + b) / (100 + percent))
    return overlap - F.ceil(percent * F.greatest(a, b) / 100) + 1


def _least_needed(percent: int, a: Column, lo: Column, hi: Column) -> Column:
    """Least of ``_needed`` over the sizes from ``lo`` to ``hi`` that fit ``a``, or less.
    It grows up to ``a``; behind it falls but for the rounding, which is left out there."""
    first, last = F.greatest(lo, F.ceil(percent * a / 100)), F.least(hi, F.floor(100 * a / percent))
    falling = percent * (a + last) / (100 + percent) - (percent * last + 99) / 100 + 1 - 1e-6
    return F.when(lo == hi, _needed(percent, a, lo)).when(last <= a, _needed(percent, a, first)).otherwise(
        F.least(falling, F.when(first <= a, _needed(percent, a, first)).otherwise(falling))
    )


def _star_step(shared: DataFrame, nodes: DataFrame, rows: DataFrame, rule: JaccardJoin) -> DataFrame:
    """Links of each node to a few others: in each of ``STARS`` orders of the nodes, to
    the first node of the shingles it shares most of its prefix through. The first
    order begins with the nodes of the most common prefixes, so a group of near copies
    meets in its middle; the others are random. Linear in the nodes whatever the size
    of a group of copies; large stars are split, with the pivot in every part. It loses
    links, the matrix finds them."""
    middle = F.shiftleft(F.col("common").cast("long"), 48) + F.shiftrightunsigned(F.xxhash64("node"), 16)
    orders = [F.max_by("node", middle), *(F.min_by("node", F.xxhash64(F.lit(r), "node")) for r in range(1, STARS))]
    pivots = shared.groupBy("token").agg(F.array(*orders).alias("pivots"))
    seen = shared.join(pivots, "token").select("node", "n", F.posexplode("pivots").alias("order", "pivot")).filter("node <> pivot")
    votes = seen.groupBy("node", "n", "order", "pivot").count()
    sizes = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"))
    enough = F.col("count") >= _needed(rule.percent, F.col("n"), F.col("pivot_n"))
    near = votes.join(sizes, "pivot").filter(_fit(rule.percent, F.col("n"), F.col("pivot_n")) & enough)
    best = near.groupBy("node", "order").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))
    best = written(best.select("node", "pivot").distinct(), "stars")
    parts = best.groupBy("pivot").agg(F.expr(f"cast(ceil(count(*) / {STAR}) as int)").alias("parts"))
    places = (
        best.join(parts, "pivot")
        .select("pivot", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("salt"), "node")
        .union(parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("pivot").alias("node")))
    )
    placed = _sets_of(rows, places.join(nodes, "node").select("pivot", "salt", "node", "id_key", "text_hash"), rule)
    return (
        placed.repartition("pivot", "salt")
        .sortWithinPartitions("pivot", "salt", F.col("node") != F.col("pivot"))
        .mapInArrow(_star_links(rule.percent), "u long, v long")
    )


def _matrix_step(shared: DataFrame, linked: DataFrame, rule: JaccardJoin) -> DataFrame:
    """Pairs of nodes of different components that may link, by the token-group matrix.

    All nodes rank their shingles in one order, those of most holders first. A link
    needs so many shingles in common that the rarest of them has, for both ends, at
    least that rank. So a row stays only if its rank is enough for some size among the
    holders of its shingle, and a node asks a group only through shingles whose ranks
    are enough on both sides: what a large group of copies has in common ranks low and
    makes no rows. The best rank also bounds what is shared with each member, so inside
    an opened group only the members that this still allows are paired."""
    percent = rule.percent
    sized = shared.join(linked, "node", "left").select(
        "token", "node", "n", F.coalesce("component", "node").alias("component")
    )
    ends = [F.min("component").alias("a"), F.max("component").alias("b"), F.min("n").alias("lo"), F.max("n").alias("hi")]
    split = sized.groupBy("token").agg(*ends, F.count("*").alias("holders")).filter("a <> b").drop("a", "b")
    order = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("holders"), F.desc("token")))
    ranked = sized.join(split, "token").withColumn("rank", order)
    ranked = ranked.filter(F.col("rank") >= _least_needed(percent, F.col("n"), F.col("lo"), F.col("hi")))
    sized = written(ranked.select("token", "node", "n", "component", "rank"), "open")
    members = sized.select("node", "n", "component").distinct()
    chunks = members.groupBy("component").agg(F.expr(f"cast(ceil(count(*) / {rule.group_size}) as int)").alias("chunks"))
    grouped = written(
        members.join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int")).drop("chunks"), "groups"
    )
    sizes = grouped.groupBy("component", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    matrix = (
        sized.select("token", "node", "rank")
        .join(grouped.select("node", "component", "chunk"), "node")
        .groupBy("token", "component", "chunk")
        .agg(F.max("rank").alias("rank"))
        .join(sizes, ["component", "chunk"])
    )
    asks = sized.select("token", F.col("node").alias("q"), F.col("n").alias("qn"), F.col("component").alias("qc"), F.col("rank").alias("q_rank"))
    fits = (F.col("lo") * percent <= F.col("qn") * 100) & (F.col("qn") * percent <= F.col("hi") * 100)
    least = _least_needed(percent, F.col("qn"), F.col("lo"), F.col("hi"))
    opened = (
        asks.join(matrix, "token")
        .filter((F.col("component") < F.col("qc")) & fits & (F.col("q_rank") >= least) & (F.col("rank") >= least))
        .groupBy("q", "qn", "component", "chunk")
        .agg(F.max(F.least("q_rank", "rank")).alias("most"))
    )
    allowed = _fit(percent, F.col("n"), F.col("qn")) & (F.col("most") >= _needed(percent, F.col("qn"), F.col("n")))
    pairs = opened.join(grouped, ["component", "chunk"]).filter(allowed)
    return pairs.select(F.col("q").alias("u"), F.col("node").alias("v"))


def _compare(pairs: DataFrame, sets: DataFrame, column: str, percent: int, kind: type) -> DataFrame:
    """The pairs whose sets, or the short forms in ``column``, overlap enough."""
    return (
        pairs.join(sets.select(F.col("node").alias("u"), F.col(column).alias("u_set")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col(column).alias("v_set")), "v")
        .select("u", "v", "u_set", "v_set")
        .mapInArrow(_pair_links(percent, kind), "u long, v long")
    )


def _settled(pairs: DataFrame, links: DataFrame, linked: DataFrame, nodes: DataFrame, rows: DataFrame, rule: JaccardJoin) -> DataFrame:
    """Components after all ``pairs`` are decided.

    Short forms of two bytes a shingle bound the overlap from above and drop pairs that
    can't link. Of the others each node compares a few with its full set, then those
    that its component has meanwhile met go, and so on with twice as many until no
    pair is left. So what is compared in full follows the nodes, not the pairs of a
    large group of near copies."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    asked = nodes.select("node", "id_key", "text_hash").join(wanted, "node", "left_semi")
    sets = written(_sets_of(rows, asked, rule, short=True), "sets")
    left, tries = written(_compare(pairs, sets, "short", rule.percent, np.uint16), "pairs"), 1
    while not left.isEmpty():
        order = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("v"), "v"))
        numbered = written(left.withColumn("at", order), "turns")
        found = _compare(numbered.filter(F.col("at") <= tries).drop("at"), sets, "set", rule.percent, np.uint64)
        links = written(links.union(found), "links")
        linked = written(components(links), "components")
        own = linked.toDF("of", "component")
        rest = numbered.filter(F.col("at") > tries).select("u", "v")
        rest = rest.join(own.toDF("u", "cu"), "u", "left").join(own.toDF("v", "cv"), "v", "left")
        left = written(rest.filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v"), "pairs")
        tries *= 2
    return linked


def _linked_nodes(rows: DataFrame, rule: JaccardJoin) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written tables of the join: profiles of the rows, nodes of equal sets, and the
    components of linked nodes."""
    spark = rows.sparkSession
    kind = rows.schema["id"].dataType.simpleString()
    rule = rule.sized(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    classes = spark.sparkContext.broadcast(count_classes(rows, rule))
    numbered = rows.select(F.monotonically_increasing_id().alias("row_id"), "*")
    schema = f"row_id long, id {kind}, id_key string, text_hash long, n long, digest binary, prefix array<long>, common int"
    profiles = written(numbered.mapInArrow(_profiler(rule, classes), schema), "sets")
    same = profiles.filter("n > 0").groupBy("digest").agg(F.min("row_id").alias("node"), F.min("id").alias("least_id"), F.count("*").alias("copies"))
    same = written(same, "nodes")
    first = _first_rows(profiles, same)
    nodes = first.select(F.col("row_id").alias("node"), "id_key", "text_hash", "n")
    tokens = first.select(F.explode("prefix").alias("token"), F.col("row_id").alias("node"), "n", "common")
    met = tokens.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    twice = written(met.filter("a <> b").select("token"), "twice")
    shared = written(_nearly(tokens, twice, ["token"]).join(twice, "token"), "shared")
    links = written(_star_step(shared, nodes, rows, rule), "links")
    linked = written(components(links), "components")
    pairs = written(_matrix_step(shared, linked, rule), "pairs")
    linked = _settled(pairs, links, linked, nodes, rows, rule)
    return profiles, same, linked


def jaccard_components(df: DataFrame, rule: JaccardJoin = JaccardJoin(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: ``id``, ``n_shingles`` and ``component_id``, the smallest id
    reachable by links (its own included); and for joins back to ``df`` the 64-bit hash
    of its text and ``component``, a number that is never null.

    Equal sets are one node. Each node sends the rarest shingles of its set, and only
    those that two nodes share go on. First every node is compared with one pivot;
    the components of those links are cut into groups of similar documents. Then each
    node asks the groups of other components: the matrix of groups and their members'
    shingles, with their ranks in one order, bounds the overlap, and only groups that
    can hold a link are opened and compared set by set. So every linked pair is either compared or
    already in one component: no link is lost, and copies don't make pairs.

    Words are runs without ASCII white space, A-Z lowered. Null, empty and blank texts
    have no shingles and are their own component. A null id is passed over by the
    minimum; a component of null ids only has a null id. Repeated rows are copies.
    An empty table gives an empty result.
    """
    rows = _rows(df, id_col, text_col)
    with batches_of(df.sparkSession):
        profiles, same, linked = _linked_nodes(rows, rule)
    placed = same.join(linked, "node", "left").select("digest", "least_id", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_set = placed.join(smallest, "component").select("digest", "component_id", "component")
    has = F.col("n") > 0
    return profiles.join(of_set, "digest", "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when(has, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        "text_hash",
        F.when(has, F.col("component")).otherwise(F.col("row_id")).alias("component"),
    )
