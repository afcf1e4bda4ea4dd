"""SimHash fingerprints of word shingles, and their near-duplicate groups by pigeonring filtering.

A fingerprint has four 16-bit segments in a ring. If two fingerprints differ in at most 3 bits, then by the
pigeonring principle some segment i begins a chain in which the first segment differs in at most
floor(3/4) = 0 bits, the first two in at most floor(6/4) = 1, the first three in at most floor(9/4) = 2, and
all four in at most 3. The first two conditions become an equi-join: for each i, the key is segment i
together with segment i + 1 whole (no difference) or with one of its 16 bits masked (one difference).
That is 68 keys of 31 or 32 bits a fingerprint, so that unrelated fingerprints hardly ever meet; the
chain's later budgets are checked on the pairs that do, before the full distance.

Copies are folded first: only distinct fingerprints are keyed. Fingerprints that share a key form a group:

* a group of two is one candidate pair;
* in a larger group every member is compared with the group's anchor (one row a member, however
  large the group). Members linked to the anchor need no comparison with each other: they are in one
  component already. Only members that aren't linked to it are compared with the whole group, in
  blocks of bounded size, again keeping one link per member and block instead of all pairs.

Every pair passes the budgets of the chain that begins at its key's segment before its full distance is taken. None is
lost by that: two fingerprints that are near have such a chain at some segment, and meet in the group of a key of it.

Links are closed by alternating large-star and small-star rounds over DataFrames until nothing changes.

Defined results: null and empty texts have fingerprint zero and link like any other; a text of fewer than
three words is one shingle; rows with a null id take part, and a component's id is its smallest id
(null if it has none); repeated rows stay; an empty table gives no rows; other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches, table, utf8

DISTANCE = 3
#: Members of a group that one comparison task holds at once, from either side.
BLOCK = 1024
#: Fingerprints joined to their components by broadcast: so many rows of 16 bytes.
HOT = 256
#: Words of the filter of keys with large groups.
FILTER_WORDS = 1 << 17

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint_of(text: bytes, words: int = 3) -> int:
    """The SimHash of one UTF-8 text."""
    return int(fingerprints_of([text], words)[0])


def fingerprints_of(texts: list[bytes], words: int = 3) -> np.ndarray:
    import xxhash

    hash64 = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        parts = text.translate(_LOWER).split()  # of bytes: ASCII white space only
        if not parts:
            continue
        joined = b" ".join(parts)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1) - 1
        if len(parts) <= words:
            hashes = [hash64(joined, 42)]
        else:
            begins = (ends - sizes)[: len(parts) - words + 1].tolist()
            hashes = [hash64(joined[a:b], 42) for a, b in zip(begins, ends[words - 1 :].tolist())]
        out[k] = _majority(np.array(hashes, "<u8"))
    return out


def _majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    n = len(hashes)
    raw = hashes.view(np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # sums of one-byte bits in bounded pieces
        counts += np.unpackbits(raw[at : at + 65_536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), one row per row of ``docs``."""

    def task(batches):
        for batch in sliced(batches):
            fp = fingerprints_of(utf8(batch.column(1)), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return small_batches(texts).mapInArrow(task, "doc_id long, fp long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _keys(fp: Column) -> Column:
    """array<struct<i, m, k>>: segment number, masked bit (16: none) and the 32 bits left."""
    out = []
    for i in range(4):
        turned = fp if i == 0 else F.shiftleft(fp, 16 * i).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * i))
        two = F.shiftrightunsigned(turned, 32).cast("long")  # segment i above segment i + 1
        out.append(F.struct(F.lit(17 * i + 16).alias("i"), two.alias("k")))
        for bit in range(16):
            out.append(F.struct(F.lit(17 * i + bit).alias("i"), two.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).alias("k")))
    return F.array(*out)


def _chain(a: Column, b: Column, i: Column) -> Column:
    """Whether the pair keeps the chain's budgets from the key's segment on: 0, 1, 2, 3 bits."""
    x = a.bitwiseXOR(b)
    seg = F.floor(i / 17).cast("int")
    fine = F.lit(False)
    for s in range(4):
        ring = [F.shiftrightunsigned(x, 16 * (3 - (s + j) % 4)).bitwiseAND(F.lit(0xFFFF)) for j in range(3)]
        bits = [F.bit_count(r) for r in ring]
        fine = fine | ((seg == s) & (bits[0] == 0) & (bits[0] + bits[1] <= 1) & (bits[0] + bits[1] + bits[2] <= 2))
    return fine & (F.bit_count(x) <= DISTANCE)


def links(fps: DataFrame) -> DataFrame:
    """a, b with a < b: enough links between the distinct ``fps`` (fp, w: how many rows have it) to connect all
    that are within 3 bits. The anchor of a group is its most frequent member.
    """
    # a table of few small files is read by few tasks: spread it before each row becomes 68
    spread = fps.repartition(_partitions(fps.sparkSession), "fp")
    keyed = spread.select("fp", "w", F.explode(_keys(F.col("fp"))).alias("key")).select("fp", "w", "key.i", "key.k")
    groups = keyed.groupBy("i", "k").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    groups = table(groups, "simhash-groups")
    lo, hi, fp, i = F.col("lo"), F.col("hi"), F.col("fp"), F.col("i")
    pairs = groups.where("n = 2").where(_chain(lo, hi, i)).select(lo.alias("a"), hi.alias("b"))

    large = groups.where("n > 2").select("i", "k", "n")
    members = table(_maybe_in(keyed, large).join(large, ["i", "k"]), "simhash-members")
    anchors = members.groupBy("i", "k").agg(F.max(F.struct("w", "fp"))["fp"].alias("anchor"))
    members = members.join(anchors, ["i", "k"])
    anchor = F.col("anchor")
    linked = _chain(anchor, fp, i)  # then the full distance
    anchored = members.where(linked & (anchor != fp)).select(F.least(anchor, fp).alias("a"), F.greatest(anchor, fp).alias("b"))
    return pairs.unionByName(anchored).unionByName(_blocks(members, members.where(~linked))).distinct()


def _maybe_in(keyed: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key may be among ``large``: all that are, and few others, without an exchange.

    A one-hash Bloom filter of ``FILTER_WORDS`` 64-bit words, made by OR; that is also the bound on the rows broadcast.
    """
    h = F.pmod(F.xxhash64("i", "k"), F.lit(64 * FILTER_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (h % 64).cast("int"))
    words = large.groupBy(F.floor(h / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    at = keyed.withColumn("word", F.floor(h / 64).cast("int")).withColumn("bit", bit)
    return at.join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("word", "bit", "bits")


def _block(n: Column) -> Column:
    return F.pmod(F.xxhash64("fp"), F.ceil(n / BLOCK)).cast("int")


def _blocks(members: DataFrame, apart: DataFrame) -> DataFrame:
    """Links of the members ``apart`` from their anchor with all members of their groups, block against block."""
    sizes = apart.groupBy("i", "k").agg(F.count("*").alias("m"))
    left = apart.join(sizes, ["i", "k"]).select("i", "k", "n", "fp", _block(F.col("m")).alias("p"))
    right = members.join(sizes, ["i", "k"]).select("i", "k", "m", "fp", _block(F.col("n")).alias("q"))
    # each row goes to every block of the other side: the pairs of blocks are the tasks, not the pairs of rows
    others = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / BLOCK) - 1).cast("int")))
    left = left.select("i", "k", "p", others("n").alias("q"), "fp", F.lit(True).alias("mine"))
    right = right.select("i", "k", others("m").alias("p"), "q", "fp", F.lit(False).alias("mine"))

    def task(group):
        mine = group.column("mine").to_numpy(zero_copy_only=False)
        fp = group.column("fp").to_numpy()
        own, all_ = np.unique(fp[mine]), np.unique(fp[~mine])
        turn = np.uint64(16 * (group.column("i")[0].as_py() // 17))
        a, b = [], []
        for x in own:  # one link of each pair of rows that are near: at most BLOCK² and folded below
            apart = np.bitwise_xor(all_, x).view(np.uint64)
            if turn:
                apart = (apart << turn) | (apart >> (np.uint64(64) - turn))
            fine = np.ones(len(all_), bool)
            for j in range(4):  # 0, 1, 2 and 3 bits in the first one, two, three and four segments
                fine[fine] = np.bitwise_count(apart[fine] >> np.uint64(48 - 16 * j)) <= j * DISTANCE // 3
            near = all_[fine & (all_ != x)]
            if len(near):
                a.append(np.minimum(near, x))
                b.append(np.maximum(near, x))
        if not a:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = _forest(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return left.unionByName(right).groupBy("i", "k", "p", "q").applyInArrow(task, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the same components: fewer than there are ends."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(ends[: len(a)].tolist(), ends[len(a) :].tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every end of ``edges`` (a, b with a < b).

    A large-star round links every node's larger neighbours to its smallest one, a small-star round its smaller
    ones; both keep the components, and all nodes hang from their roots after few rounds. Every round is written
    to the shared folder.
    """
    edges = table(edges.select("a", "b").distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        joined = _with_least(large, low, "b")
        # the node itself and its smaller neighbours hang from the smallest
        small = joined.select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct()
        new = table(small, "links")
        # finished when every b has one a, and no a is a b
        many = new.groupBy("b").count().where("count > 1")
        middle = new.select(F.col("a").alias("x")).join(new.select(F.col("b").alias("x")), "x", "left_semi")
        edges = new
        if many.isEmpty() and middle.isEmpty():
            break
    roots = edges.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)


def _with_least(edges: DataFrame, low: DataFrame, end: str) -> DataFrame:
    """``edges`` with the ``m`` of their ``end``: the ``HOT`` nodes with most edges, such as the centre of a giant star, by broadcast."""
    hot = F.broadcast(low.orderBy(F.desc("n"), end).limit(HOT).select(end, "m"))
    rest = edges.join(F.broadcast(hot.select(end)), end, "left_anti").join(low.select(end, "m"), end)
    return edges.join(hot, end).unionByName(rest)


def _partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that can be reached over links, its own included."""
    prints = table(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = table(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("w")), "distinct-fingerprints")
    nodes = components(links(distinct.select("fp", "w")))
    named = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "w", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = table(named.join(least, "root").select("fp", "w", "component_id"), "components")
    # a fingerprint that a third of all rows share must not meet its component in one task
    hot = of.orderBy(F.desc("w"), "fp").limit(HOT).select("fp", "component_id")
    rest = prints.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(of.select("fp", "component_id"), "fp")
    return prints.join(F.broadcast(hot), "fp").unionByName(rest).select("doc_id", "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies at a looser similarity: pigeonring links, MinHash candidates for what 3 bits don't reach, exact Jaccard

#: Rows of a band and bands: a pair at 0.8 shares no band with a probability of (1 - 0.8^5)^28, or 0.000015. SimHash segments
#: of a fixed width would have to be some hundreds for that, as the angle at 0.8 differs in 15 % of the bits.
ROWS, BANDS = 5, 28
_FACTORS, _TURNS = np.random.default_rng(0x5EED).integers(1 << 63, size=(2, ROWS * BANDS), dtype=np.uint64)
_FACTORS |= np.uint64(1)


def shingles_of(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's word shingles; all words are one shingle where there are fewer."""
    import xxhash

    hash64 = xxhash.xxh64_intdigest
    parts = text.translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([hash64(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begins = np.concatenate([[0], ends[: len(parts) - words] + 1]).tolist()
    return np.unique(np.array([hash64(joined[a:b], 42) for a, b in zip(begins, ends[words - 1 :].tolist())], np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key of each band: the hash of its rows' least values over the shingles."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, ((shingles[at : at + 256, None] ^ _TURNS) * _FACTORS).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-6


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id: groups of texts linked at a Jaccard similarity of their sets of word shingles.

    Texts of one set are folded first. SimHash fingerprints of the sets are linked by pigeonring filtering (``links``).
    A similarity that is lower than 3 bits reach is found by MinHash bands, whatever the number of rows. Pairs of either
    kind are judged once, by their exact similarity. Groups of a band's key are treated as above: two are a pair, of more
    each member meets the anchor, and those apart from it are compared in blocks. Sets are made again for candidates only.
    """
    import hashlib

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def task(batches):
        for batch in sliced(batches):
            sets = [shingles_of(t, words) for t in utf8(batch.column(1))]
            f = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            fp = np.array([_majority(x) for x in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.binary()), pa.array(fp), keys], ["doc_id", "f", "fp", "keys"])

    prints = table(small_batches(texts).mapInArrow(task, "doc_id long, f binary, fp long, keys array<long>"), "near-prints")
    parts = _partitions(docs.sparkSession)
    folded = prints.groupBy("f").agg(F.min("doc_id").alias("node"), F.count("*").alias("w"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"))
    nodes = table(folded.where("node is not null"), "near-nodes")
    keyed = nodes.repartition(parts, "node").select("node", "w", F.lit(0).alias("i"), F.explode("keys").alias("k"))
    groups = table(keyed.groupBy("i", "k").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1"), "near-keys")
    pairs = groups.where("n = 2 and lo <> hi").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    large = groups.where("n > 2").select("i", "k", "n")
    members = table(_maybe_in(keyed, large).join(large, ["i", "k"]), "near-members")
    anchors = members.groupBy("k").agg(F.max(F.struct("w", "node"))["node"].alias("anchor"))
    starred = members.join(anchors, "k").where("anchor <> node").select("k", F.least("anchor", "node").alias("a"), F.greatest("anchor", "node").alias("b"), "node")
    candidates = table(_ring(nodes).union(pairs).union(starred.select("a", "b")).distinct(), "near-candidates")
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def sets(batches):
        for batch in sliced(batches):
            s = [shingles_of(t, words).tobytes() for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.binary())], ["node", "s"])

    of_wanted = small_batches(texts.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi"))
    with_s = table(of_wanted.mapInArrow(sets, "node long, s binary").distinct(), "near-sets")  # several, if an id repeats

    def judge(batches):
        for batch in batches:
            sa, sb = ([np.frombuffer(x, np.uint64) for x in batch.column(batch.schema.get_field_index(c)).to_pylist()] for c in ("sa", "sb"))
            near = [alike(x, y, similarity) for x, y in zip(sa, sb)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in "ab"), pa.array(near, pa.bool_())], ["a", "b", "near"])

    of = candidates.join(with_s.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(with_s.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    judged = table(of.mapInArrow(judge, "a long, b long, near boolean").groupBy("a", "b").agg(F.max("near").alias("near")), "near-pairs")
    apart = starred.join(judged.where("not near"), ["a", "b"], "left_semi").select("k", "node").distinct()
    found = judged.where("near").select("a", "b").union(_near_blocks(members, apart, with_s, similarity)).distinct()
    roots = components(found)
    named = nodes.join(roots, "node", "left").select("f", "w", F.coalesce("root", "node").alias("component_id"))
    of_f = table(named.select("f", "w", "component_id"), "near-components")
    hot = of_f.orderBy(F.desc("w"), "f").limit(HOT).select("f", "component_id")
    rest = prints.join(F.broadcast(hot.select("f")), "f", "left_anti").join(of_f.select("f", "component_id"), "f", "left")
    return prints.join(F.broadcast(hot), "f").select("doc_id", "component_id").unionByName(rest.select("doc_id", "component_id"))


def _ring(nodes: DataFrame) -> DataFrame:
    """a, b with a < b: the ``nodes`` (node, fp) to compare for fingerprints within 3 bits, by pigeonring filtering.

    The smallest node of a fingerprint stands for it in links to others, and meets all other nodes of the fingerprint.
    """
    of_fp = table(nodes.groupBy("fp").agg(F.min("node").alias("lead"), F.count("*").alias("w")), "near-fingerprints")
    ends = [of_fp.select(F.col("fp").alias(end), F.col("lead").alias(f"lead_{end}")) for end in "ab"]
    between = links(of_fp.select("fp", "w")).join(ends[0], "a").join(ends[1], "b").select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b"))
    within = nodes.join(of_fp.where("w > 1").select("fp", "lead"), "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return between.union(within).where("a <> b").distinct()


def _near_blocks(members: DataFrame, apart: DataFrame, with_s: DataFrame, similarity: float) -> DataFrame:
    """Links of the members ``apart`` from their anchor with all of their groups, block against block."""
    size = 256
    sizes = apart.groupBy("k").agg(F.count("*").alias("m"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / size)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / size) - 1).cast("int")))
    every = members.select("k", "n", "node").distinct().join(sizes, "k").join(with_s, "node")
    left = apart.join(members.select("k", "n").distinct(), "k").join(sizes, "k").join(with_s, "node").select("k", block("m").alias("p"), others("n").alias("q"), "node", "s", F.lit(True).alias("mine"))
    right = every.select("k", others("m").alias("p"), block("n").alias("q"), "node", "s", F.lit(False).alias("mine"))

    def task(group):
        mine = group.column("mine").to_numpy(zero_copy_only=False)
        node = group.column("node").to_numpy()
        s = [np.frombuffer(x, np.uint64) for x in group.column("s").to_pylist()]
        rest = np.flatnonzero(~mine).tolist()
        near = [(node[x], node[y]) for x in np.flatnonzero(mine).tolist() for y in rest if node[x] != node[y] and alike(s[x], s[y], similarity)]
        a, b = np.sort(np.array(near, np.int64).reshape(-1, 2), axis=1).T
        if len(a):
            a, b = _forest(a, b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return left.unionByName(right).groupBy("k", "p", "q").applyInArrow(task, "a long, b long")


def stage(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest doc_id.

    Rows that share an id stand or fall together; exact repeats of a row collapse to one; rows with a null id stay.
    """
    found = table(near_groups(docs, words, similarity), "near-groups")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    kept = docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["gone_id"], "left_anti")
    repeated = not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    return kept.dropDuplicates() if repeated else kept
