"""N-gram Jaccard join: grouped prefix join on word shingles.

Documents with equal shingle sets collapse to one node.  Shingles are ordered
with the corpus's most repeated ones last; a node's prefix is the first part
that any partner must share.  Nodes with identical prefixes and size are one
group, groups are paired by shared prefix shingles under length and positional
filters, and members are verified on their whole sets.

Only links that can join two classes are looked for at first.  Stars come
before all else: a list's hub with the list, and a group's first member with
the group.  A posting list that then still holds several classes is open.
Short open lists are paired and verified.  Pairs are verified in rounds, so
that however many there are, the whole sets that lie on disk at once stay a
fixed part of the corpus.  The members of long open lists never
become rows of pairs: they are cut into blocks by size and hash, a task holds
the whole sets of two blocks, verifies them as a product of matrices, and gives
back a spanning forest of the links.  Numbers of links, if asked for, come from
the same blocks over the members of each class.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, release
from .words import FOLDED, U64, Words, lists, signed, slices

#: Most repeated shingles whose order is by count; it orders prefixes only, and any number gives the same links.
HEAVY = 1 << 20
#: One set in COUNTED (by digest) counts the shingles that may enter prefixes; REPEATED of them make a shingle a heavy one.
COUNTED, REPEATED = 4, 4
#: Members of an open posting list that are paired as rows; members of longer ones are compared in blocks.
SHORT_LIST = 64
#: Shingles and sets of one block; two blocks are compared at once.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 19, 512
#: Shingles of blocks that are shuffled at once, beyond twice those of the sets themselves.
ROUND_SHINGLES = 1 << 24
#: Of the shingles of all sets, the part whose pairs are verified at once (a set counts in each of its pairs), and so many besides.
VERIFIED, VERIFIED_SHINGLES = 1 / 4, 1 << 22
#: Rows of short lists' pairs that are shuffled at once, for each shingle of all sets, and so many besides.
PAIRED, PAIRED_ROWS = 1 / 8, 1 << 22
#: Document ids that are broadcast at most; a row of the broadcast table takes up to 300 bytes, 75 MB in all.
BROADCAST_IDS = 250_000
#: Bits of the filter on more ids: ID_BITS for each, MOST_BITS (16 MB) in all.
ID_BITS, MOST_BITS = 32, 1 << 27


def _sets(w: Words, n: int) -> list[np.ndarray]:
    """Each document's distinct shingles, sorted; with fewer words, the whole sequence as one."""
    h, ok = w.grams(n)
    out = []
    for d in range(len(w.count)):
        a, b = int(w.first[d]), int(w.first[d + 1])
        if b - a >= n:
            out.append(np.unique(h[a : b - n + 1]))
        elif b > a:
            out.append(np.array([w.whole(d)], U64))
        else:
            out.append(np.zeros(0, U64))
    return out


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _prefix_size(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1 if size else 0


def _summaries(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Rows (kind 0: id, size, digest of the set) and (kind 1: a slice's shingles that may enter prefixes, in how many counted sets).

    Frequent shingles have the longest lists, so they must be known at any size
    of the corpus; a slice does not show those that few of its documents have.
    Light shingles enter prefixes by hash, so the smallest hashes are counted.
    """

    def run(batches):
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), FOLDED)
            sets = _sets(w, n)
            size = np.array([len(s) for s in sets], np.int64)
            digest = [_digest(s) for s in sets]
            once = [s for g, s in {g: s for g, s in zip(digest, sets, strict=True)}.items() if g[0] % COUNTED == 0]
            u, c = np.unique(np.concatenate([np.zeros(0, U64), *(s[: 2 * _prefix_size(len(s), num, den) + 16] for s in once)]), return_counts=True)
            m = len(sets)
            cols = [
                pa.array([0] * m + [1], pa.int32()),
                pa.concat_arrays([batch.column("id"), pa.nulls(1, pa.int64())]),
                pa.array(np.r_[size, 0]),
                pa.array([*digest, None], pa.binary()),
                lists(signed(u), np.array([0] * m + [len(u)]), pa.int64()),
                lists(c, np.array([0] * m + [len(u)]), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["kind", "id", "n", "digest", "tok", "cnt"])

    return docs.mapInArrow(run, "kind int, id long, n long, digest binary, tok array<long>, cnt array<long>")


def _prefixes(docs: DataFrame, n: int, heavy: np.ndarray, place: np.ndarray, num: int, den: int) -> DataFrame:
    """(id, digest of the set, n, prefix, digest of the prefix): light shingles by hash, then heavy ones by rising count."""

    def run(batches):
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), FOLDED)
            pre, sizes, digest = [], [], []
            for s in _sets(w, n):
                digest.append(_digest(s))
                p = _prefix_size(len(s), num, den)
                if len(heavy) and len(s):
                    k = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    known = heavy[k] == s
                    rest = s[known][np.argsort(place[k[known]], kind="stable")]
                    s = np.concatenate([s[~known], rest])
                sizes.append(len(s))
                pre.append(s[:p])
            flat = np.concatenate(pre) if pre else np.zeros(0, U64)
            cols = [batch.column("id"), pa.array(digest, pa.binary()), pa.array(sizes, pa.int64()), lists(signed(flat), np.array([len(p) for p in pre]), pa.int64()), pa.array([_digest(p) for p in pre], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "digest", "n", "pre", "pd"])

    return docs.mapInArrow(run, "id long, digest binary, n long, pre array<long>, pd binary")


def _id_filter(nodes: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """(bits, bytes): a set bit for pmod(xxhash64(id), bits) of each id; other ids share a few of them."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(6, (ID_BITS * count - 1).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = nodes.select((at / 64).cast("long").alias("w"), F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(id), {bits}) % 64 AS INT))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return bits, out.astype("<i8").view(np.uint8)


def _whole_sets(texts: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, toks) of ``nodes`` (node, id, digest): a text of that id whose set has that digest."""
    count = nodes.count()
    few = count <= BROADCAST_IDS
    bitmap = None if few else _id_filter(nodes, count)[1]

    def run(batches):
        for batch in batches:
            if bitmap is not None:
                h = batch.column("h").to_numpy()
                batch = batch.filter(pa.array((bitmap[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1))
            for part in slices([batch], "text"):
                sets = _sets(Words(part.column("text"), FOLDED), n)
                flat = lists(signed(np.concatenate(sets)), np.array([len(s) for s in sets]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([_digest(s) for s in sets], pa.binary()), flat], names=["id", "digest", "toks"])

    if few:
        nodes = F.broadcast(nodes)
        wanted = texts.join(F.broadcast(nodes.select("id").distinct()), "id", "left_semi")
    else:  # texts are not shuffled: a filter leaves the ids wanted and a few others, whose sets find no node
        wanted = texts.where("id IS NOT NULL").withColumn("h", F.pmod(F.xxhash64("id"), F.lit(len(bitmap) * 8)))
    whole = wanted.mapInArrow(run, "id long, digest binary, toks array<long>")
    # Rows that repeat an id and its text would bring a set again; a node is an id and a digest, by which the join has dealt out the rows.
    return whole.join(nodes, ["id", "digest"]).dropDuplicates(["id", "digest"]).select("node", "toks")


def _gathered(parts: list[DataFrame], name: str) -> DataFrame:
    """The rows of materialized ``parts`` as one materialized table."""
    if len(parts) == 1:
        return parts[0]
    out = materialize(functools.reduce(DataFrame.unionByName, parts), name)
    release(*parts)
    return out


def _shared(entries: DataFrame) -> DataFrame:
    """The posting entries (tok, gid, n, pos) of shingles that several groups have."""
    several = entries.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return entries.join(several.select("tok"), "tok")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of every set of a with every set of b."""
    x, y = (np.unique(np.concatenate(s)) for s in (a, b))
    known = np.intersect1d(x, y, assume_unique=True)

    def places(sets):
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        k = np.searchsorted(known, flat)
        hit = known[np.minimum(k, len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool)
        by = np.argsort(k[hit], kind="stable")
        return k[hit][by], of[hit][by]

    (ka, ia), (kb, ib) = places(a), places(b)
    out = np.zeros((len(a), len(b)), np.float32)
    step = 2048
    for lo in range(0, len(known), step):
        m = np.zeros((len(a), step), np.float32), np.zeros((len(b), step), np.float32)
        for t, k, i in ((m[0], ka, ia), (m[1], kb, ib)):
            f, g = np.searchsorted(k, (lo, lo + step))
            t[i[f:g], k[f:g] - lo] = 1
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _by_blocks(members: DataFrame, whole: DataFrame, num: int, den: int, carry: str, f, kind: str, name: str) -> DataFrame:
    """What ``f`` gives for each pair of blocks of ``members`` that can hold links, materialized.

    A set goes to as many pairs as its group has blocks near it, so the pairs
    are dealt to rounds: what lies on disk grows with the sets, not with the
    square of a group.

    ``members``: (grp, node, n, carry).  A group that fits in a block is one
    block.  Others are cut by size, in steps so wide that linked sets lie in the
    same or in neighbouring ones, and each step by a hash of the node.
    """
    step = math.log(den / num) * (1 + 1e-9) + 1e-9 if num < den else 1e-9
    blocks = lambda: F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    total = members.groupBy("grp").agg(blocks().alias("all"), F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = members.join(total, "grp").withColumn("z", F.when(F.col("all") == 1, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / step)).cast("int"))
    rows = materialize(rows.select("grp", "node", "n", carry, "z"), "cut")
    k = materialize(rows.groupBy("grp", "z").agg(blocks().alias("k")), "cuts")
    rows_ = rows.join(k, ["grp", "z"])
    for beside, by in (("above", 1), ("below", -1)):
        rows_ = rows_.join(k.select("grp", (F.col("z") - by).alias("z"), F.col("k").alias(beside)), ["grp", "z"], "left")
    s = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    pair = lambda z1, s1, z2, s2, side: F.struct(z1.alias("z1"), s1.alias("s1"), z2.alias("z2"), s2.alias("s2"), side.alias("side"))
    none = F.array().cast("array<struct<z1:int,s1:int,z2:int,s2:int,side:int>>")
    z, at = F.col("z"), F.col("s")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = F.transform(upto("k"), lambda t: pair(z, F.least(at, t), z, F.greatest(at, t), F.when(at <= t, 0).otherwise(1)))
    up = F.when(F.col("above").isNull(), none).otherwise(F.transform(upto("above"), lambda t: pair(z, at, z + 1, t, F.lit(0))))
    down = F.when(F.col("below").isNull(), none).otherwise(F.transform(upto("below"), lambda t: pair(z - 1, t, z, at, F.lit(1))))
    placed = rows_.withColumn("s", s).select("grp", "node", "n", carry, F.concat(own, up, down).alias("places"))
    sides = materialize(placed.join(whole, "node"), "sides")
    release(rows, k)
    once, all_ = sides.agg(F.sum("n"), F.sum(F.col("n") * F.size("places"))).first()
    rounds = -(-(all_ or 0) // (2 * (once or 0) + ROUND_SHINGLES)) or 1
    parts = []
    for r in range(rounds):
        here = F.filter("places", lambda x: F.pmod(F.xxhash64("grp", x.z1, x.s1, x.z2, x.s2), F.lit(rounds)) == r)  # noqa: B023
        flat = sides.select("grp", F.explode(here).alias("x"), "node", carry, "toks").select("grp", "x.*", "node", carry, "toks")
        parts.append(materialize(flat.groupBy("grp", "z1", "s1", "z2", "s2").applyInArrow(f, kind), name))
    release(sides)
    return _gathered(parts, name)


def _compared(group: pa.Table, num: int, den: int, carry: str):
    """(nodes, carried values) of two blocks and which of them are linked; a block with itself once."""
    toks = group.column("toks").combine_chunks()
    toks = toks if isinstance(toks, pa.Array) else pa.concat_arrays(toks.chunks)
    side, node, what = (group.column(c).to_numpy() for c in ("side", "node", carry))
    flat, ends = toks.flatten().to_numpy(), np.asarray(toks.offsets) - toks.offsets[0].as_py()
    z1, s1, z2, s2 = (group.column(c)[0].as_py() for c in ("z1", "s1", "z2", "s2"))
    picked = [np.flatnonzero(side == k) for k in ((0, 0) if (z1, s1) == (z2, s2) else (0, 1))]
    a, b = ([flat[ends[i] : ends[i + 1]] for i in p] for p in picked)
    both = _overlaps(a, b) if a and b else np.zeros((len(a), len(b)), np.int64)
    na, nb = (np.array([len(x) for x in q], np.int64) for q in (a, b))
    linked = both * (num + den) >= (na[:, None] + nb[None, :]) * num
    if (z1, s1) == (z2, s2):
        np.fill_diagonal(linked, False)
    return [(node[p], what[p]) for p in picked], linked, (z1, s1) == (z2, s2)


def _link_counts(members: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """(node, n_links): documents of other sets of ``members`` (grp, node, n, copies) that are linked, pair by pair of blocks."""

    def count(group: pa.Table) -> pa.Table:
        ((a, ca), (b, cb)), linked, same = _compared(group, num, den, "copies")
        ids, v = [a], [linked @ cb]
        if not same:
            ids.append(b)
            v.append(linked.T @ ca)
        return pa.table({"node": pa.array(np.concatenate(ids), pa.int64()), "v": pa.array(np.concatenate(v), pa.int64())})

    return _by_blocks(members, whole, num, den, "copies", count, "node long, v long", "counts").groupBy("node").agg(F.sum("v").alias("n_links"))


def _joining(members: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that join the classes of ``members`` (grp, node, n, comp) as far as any do: a forest from each pair of blocks."""

    def forest(group: pa.Table) -> pa.Table:
        ((a, ca), (b, cb)), linked, _ = _compared(group, num, den, "comp")
        linked &= ca[:, None] != cb[None, :]
        x, y = np.nonzero(linked)
        _, one = np.unique(np.stack([np.minimum(ca[x], cb[y]), np.maximum(ca[x], cb[y])]), axis=1, return_index=True)
        parent: dict[int, int] = {}

        def find(c: int) -> int:
            while parent.setdefault(c, c) != c:
                parent[c] = c = parent[parent[c]]
            return c

        out = []
        for i, j in zip(x[one].tolist(), y[one].tolist(), strict=True):
            p, q = find(int(ca[i])), find(int(cb[j]))
            if p != q:
                parent[p] = q
                out.append((a[i], b[j]))
        return pa.table({"a": pa.array([min(p) for p in out], pa.int64()), "b": pa.array([max(p) for p in out], pa.int64())})

    return _by_blocks(members, whole, num, den, "comp", forest, "a long, b long", "links")


def jaccard_components(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """Classes of documents linked by shingle-set Jaccard of at least num/den.

    Returns doc_id, n_shingles and component_id (the smallest id reachable by
    links, its own included).  Words are split at ASCII white space and A-Z is
    folded; shingles are compared by 64-bit hashes with fixed seeds, not as
    words, so two different ones are taken as equal once in 2^64 pairs.

    Null, empty and wordless texts have no shingles and link with nothing.  Very
    long texts are compared whole.  Rows of null id are reported with a null
    component and link nothing.  Rows that repeat an id are reported each; with
    different texts they are different documents, each in the class of its own
    text.  Ties (which member is a hub) change no class.  An empty table gives
    no rows; other columns are ignored.  With ``links`` also n_links, the number
    of other documents (ids, for equal sets) that a document is linked with, null
    for null ids: all pairs of a class are then verified, not only those that
    make it one.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = materialize(_summaries(texts, n, num, den), "summaries")
    top = seen.where("kind = 1").select(F.explode(F.arrays_zip("tok", "cnt")).alias("x")).groupBy("x.tok").agg(F.sum("x.cnt").alias("c"))
    counted = materialize(top.where(F.col("c") >= REPEATED), "counted")
    top = counted.orderBy(F.desc("c"), "tok").limit(HEAVY).toArrow()  # HEAVY rows of 16 bytes at most
    tok, c = (top.column(k).to_numpy() for k in ("tok", "c"))
    tok = tok[np.lexsort((tok, c))].view(U64)
    order = np.argsort(tok)
    heavy, place = tok[order], order
    rows = materialize(seen.where("kind = 0").select("id", "n", "digest"), "sizes")
    release(seen, counted)

    # Equal sets collapse to a node with a number of its own; written once, numbers stay.
    sets = rows.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.countDistinct("id").alias("copies"), F.min("n").alias("n"))
    sets = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    nodes = sets.select("node", "id", "digest")
    pre = _prefixes(texts.where("id IS NOT NULL"), n, heavy, place, num, den)
    pre = materialize(pre.join(nodes, ["id", "digest"]).select("node", "n", "pre", "pd"), "prefixes")
    groups = pre.groupBy("n", "pd").agg(F.min(F.struct("node", "pre")).alias("x"), F.max("node").alias("hi"))
    groups = materialize(groups.select(F.col("x.node").alias("gid"), "n", "pd", F.col("x.pre").alias("pre"), (F.col("hi") > F.col("x.node")).alias("several")), "groups")
    member = pre.select("node", "n", "pd").join(groups.select("gid", "n", "pd", "several"), ["n", "pd"])
    member = materialize(member.select("node", "n", "gid", "several").distinct(), "members")
    release(pre)
    post = materialize(_shared(groups.select("gid", "n", F.posexplode("pre").alias("pos", "tok"))), "postings")
    release(groups)

    def near(a: str, b: str, na, nb, i, j):
        """Length and positional filters for a shared shingle at places i and j of the ordered sets."""
        least = F.ceil((na + nb) * num / F.lit(float(num + den)) - F.lit(1e-9))
        most = F.least(i, j) + 1 + F.least(na - i - 1, nb - j - 1)
        return (F.col(a) != F.col(b)) & (na * num <= nb * den) & (nb * num <= na * den) & (most >= least)

    def least_common(na, nb):
        """Shingles that the prefixes of a pair must share: what lies behind the one that ends first can't make up for more."""
        least = F.ceil((na + nb) * num / F.lit(float(num + den)) - F.lit(1e-9))
        behind = lambda x: F.ceil(x * num / F.lit(float(den)) - F.lit(1e-9)) - 1
        return F.greatest(F.lit(1), least - F.greatest(behind(na), behind(nb)))

    def often(pairs: DataFrame, part: int = 1) -> DataFrame:
        """Pairs (a, b, na, nb, w: shared prefix shingles) that share enough of them in all their rows, with m: the sizes of both sets."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("na", "nb").alias("na"), F.greatest("na", "nb").alias("nb"), "w")
        got = pairs.groupBy("a", "b").agg(F.sum("w").alias("c"), F.min("na").alias("na"), F.min("nb").alias("nb"))
        return got.where(F.col("c") * part >= least_common(F.col("na"), F.col("nb"))).select("a", "b", (F.col("na") + F.col("nb")).alias("m"))

    def needed(ids: DataFrame) -> DataFrame:
        """(node, toks) of the nodes in ``ids`` (node)."""
        wanted = materialize(nodes.join(ids, "node", "left_semi"), "wanted")
        out = materialize(_whole_sets(texts, wanted, n), "whole")
        release(wanted)
        return out

    corpus = sets.agg(F.sum("n")).first()[0] or 0

    def linked(pairs: DataFrame) -> DataFrame:
        whole = needed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        got = pairs.join(whole.select(F.col("node").alias("a"), F.col("toks").alias("ta")), "a")
        got = got.join(whole.select(F.col("node").alias("b"), F.col("toks").alias("tb")), "b")
        both = F.size(F.array_intersect("ta", "tb"))
        out = materialize(got.where(both * (num + den) >= (F.size("ta") + F.size("tb")) * num).select("a", "b"), "links")
        release(whole)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        """The linked ones of ``pairs`` (a, b, m: shingles of both); whole sets come to disk for one round of pairs at a time."""
        pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("m").alias("m"))
        pairs = materialize(pairs, "pairs")
        rounds = math.ceil((pairs.agg(F.sum("m")).first()[0] or 0) / (VERIFIED * corpus + VERIFIED_SHINGLES)) or 1
        at = F.pmod(F.xxhash64("a", "b"), F.lit(rounds))
        out = _gathered([linked(pairs.where(at == r).select("a", "b")) for r in range(rounds)], "links")
        release(pairs)
        return out

    # Stars: in each list a hub with the others, and in each group its first member with the others.
    hub = post.groupBy("tok").agg(F.min(F.struct("gid", "n", "pos")).alias("hub"))
    star = post.join(hub, "tok").where(near("gid", "hub.gid", F.col("n"), F.col("hub.n"), F.col("pos"), F.col("hub.pos")))
    # A hub need not be the hub of all that a pair shares: half will do here, as what is missed comes below.
    star = often(star.select(F.col("hub.gid").alias("a"), F.col("gid").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"), F.lit(1).alias("w")), 2).unionByName(member.where("node <> gid").select(F.col("gid").alias("a"), F.col("node").alias("b"), (F.col("n") * 2).alias("m")))
    first = verified(star)

    # Lists that still hold several classes, and the members of each group as a list of their own: they share the whole prefix.
    comp = components(first)
    posted = post.join(member.select("gid", "node"), "gid").select("tok", "node", "n", "pos", F.lit(1).alias("w"))
    posted = posted.unionByName(member.where("several").select(F.xxhash64("gid", F.lit("group")).alias("tok"), "node", "n", F.lit(0).alias("pos"), F.lit(1 << 20).alias("w")))
    known = posted.join(comp.select(F.col("id").alias("node"), "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    known = materialize(known, "known")
    release(post, comp)
    apart = known.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi")
    apart = materialize(apart.select("tok", "lo", "c"), "apart")
    open_ = materialize(known.join(apart, "tok"), "open")
    release(known)
    few = open_.where(F.col("c") <= SHORT_LIST)
    x, y = (few.select("tok", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "pos", "comp", "w"))) for s in "ab")
    pairs = x.join(y, "tok").where((F.col("a_node") < F.col("b_node")) & (F.col("a_comp") != F.col("b_comp")) & near("a_node", "b_node", F.col("a_n"), F.col("b_n"), F.col("a_pos"), F.col("b_pos")))
    pairs = pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_n").alias("na"), F.col("b_n").alias("nb"), F.col("a_w").alias("w"))
    # Lists grow with the corpus and their pairs with the square: all rows of a pair fall into one round.
    most, at_once = apart.where(F.col("c") <= SHORT_LIST).agg(F.sum(F.expr("c * (c - 1) div 2"))).first()[0] or 0, PAIRED * corpus + PAIRED_ROWS
    rounds = 1 if most <= at_once else math.ceil(pairs.count() / at_once) or 1
    at = F.pmod(F.xxhash64("a", "b"), F.lit(rounds))
    # Shingles that a pair shares in long lists are not counted, but then its members meet in blocks.
    pairs = _gathered([materialize(often(pairs.where(at == r)), "paired") for r in range(rounds)], "paired")
    second = verified(pairs)
    release(pairs, apart)
    joined = first.unionByName(second)
    many = open_.where(F.col("c") > SHORT_LIST)
    third = None
    if not many.isEmpty():
        # Classes that meet in long lists are one cluster, whose members are compared block by block.
        met = components(many.select(F.col("comp").alias("a"), F.col("lo").alias("b")))
        inside = many.select("node", "n", "comp").distinct().join(met.select(F.col("id").alias("comp"), F.col("comp").alias("grp")), "comp")
        inside = materialize(inside, "inside")
        whole = needed(inside.select("node"))
        third = _joining(inside, whole, num, den)
        release(met, inside, whole)
        joined = joined.unionByName(third)
    release(open_)
    comp = components(joined)
    release(member, first, second, *([third] if third is not None else []))
    named = sets.join(comp.select(F.col("id").alias("node"), "comp"), "node", "left").withColumn("grp", F.coalesce("comp", "node"))
    named = materialize(named.select("digest", "node", "id", "copies", "n", "grp"), "named")
    release(comp, sets)
    rep = named.groupBy("grp").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("m"))
    rep = named.join(rep, "grp").select("digest", "node", "class", "copies")
    out = [F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("component_id")]
    if not links:
        return rows.join(rep, "digest", "left").select(*out)
    several = named.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("grp")
    inside = materialize(named.join(several, "grp").select("grp", "node", "id", "digest", "n", "copies"), "inside")
    whole = materialize(_whole_sets(texts, inside.select("node", "id", "digest"), n), "whole")
    counts = _link_counts(inside, whole, num, den)
    release(whole, inside)
    rep = rep.join(counts, "node", "left").select("digest", "class", (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    return rows.join(rep, "digest", "left").select(*out, F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"))
