"""MinHash near-duplicates with sequential Bayesian verification.

Documents become sets of word shingles. Bands of a MinHash signature give candidates; signatures are compared in
batches, and a pair is dropped as soon as the posterior probability (uniform prior) that its similarity reaches the
threshold falls under `miss`. Survivors are checked exactly on the full sets.

No group is expanded into all its pairs. Documents with the same shingle set are one node; each node is first compared
with one bucket leader (the member of most company; of its leaders the one with which it shares most bands), by the
first bands alone, then by all bands where a bucket still spans components. Only members of such a bucket that are in
different components afterwards are compared with each other: in small buckets by a join, in large ones in block pairs
of bounded size, where signatures alone decide first who has a partner at all, and which only links leave. Large buckets
that the same component fills are compared as one, so a member goes out once and not once a bucket.

Joins on a key that many rows may share broadcast the few commonest keys (common.join_counted) or end in a write, where
adaptive execution splits the partition of such a key.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, discard, join_counted, materialise, slices, small_batches, words

BATCH = 32
FIRST_BANDS = 8
SMALL_BUCKET = 32
WIDE_BLOCK = 1024
BLOCK = 256


def banding(threshold: float, hashes: int, miss: float) -> tuple[int, int]:
    """Rows a band and bands: the longest bands of which none agrees with probability at most `miss` at the threshold."""
    for rows in range(hashes, 0, -1):
        if (1 - threshold**rows) ** (hashes // rows) <= miss:
            return rows, hashes // rows
    return 1, hashes


def least_matches(threshold: float, hashes: int, miss: float) -> list[tuple[int, int]]:
    """For each prefix of n hashes the fewest matches m with P(similarity >= threshold | m of n) >= miss.

    With a uniform prior that posterior is P(Binomial(n + 1, threshold) <= m).
    """
    out = []
    for n in sorted({*range(BATCH, hashes + 1, BATCH), hashes}):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _hash_family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 32, hashes, dtype=np.uint32), rng.integers(0, 1 << 31, hashes, dtype=np.uint32) * 2 + 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _shingles(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    codes, distinct, offsets = words(texts, lower=True)
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct)
    )
    flat = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    joined = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    for k in range(size):
        joined = _mixed(joined + flat[k : k + len(joined)] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
    out = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - start >= size:
            out.append(np.unique(joined[start : end - size + 1]))
        elif end > start:
            out.append(np.array([xxhash.xxh64_intdigest(flat[start:end].tobytes(), seed=end - start)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _features(size: int, hashes: int, rows: int, bands: int):
    def run(batches):
        xor, odd = _hash_family(hashes)
        weights = np.random.default_rng(7).integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in slices(batches, "text"):
            ids, n, prints, signatures, keys = batch.column("id"), [], [], [], []
            for known, s in zip(ids.is_valid().to_pylist(), _shingles(batch.column("text"), size), strict=True):
                n.append(len(s))
                if not len(s) or not known:
                    prints.append(None), signatures.append(None), keys.append(None)
                    continue
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
                low = np.full(hashes, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(x), 2048):
                    np.minimum(low, ((x[at : at + 2048, None] ^ xor) * odd).min(axis=0), out=low)
                signatures.append(low.astype(np.uint16).tobytes())
                wide = low[: bands * rows].reshape(bands, rows).astype(np.uint64)
                keys.append(_mixed((wide * weights).sum(axis=1)).view(np.int64))
            lengths = [0 if k is None else bands for k in keys]
            flat = np.concatenate([k for k in keys if k is not None] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()),
                    batch.column("h"),
                    pa.array(n, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(signatures, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat, pa.int64())),
                ],
                names=["id", "h", "n", "print", "sig", "keys"],
            )

    return run


def _plausible(a: np.ndarray, b: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature matrices stay over the posterior bound in every batch."""
    alive, seen, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in table:
        seen = seen + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        keep = seen >= least
        alive, seen, done = alive[keep], seen[keep], n
        if not len(alive):
            break
    out = np.full(len(a), -1, np.int64)
    out[alive] = seen
    return out


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, hashes)


class _Corpus:
    """Nodes (distinct shingle sets), the texts they stand for, and the tests a pair of them has to pass."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, size: int, percent: int, hashes: int, miss: float):
        self.nodes, self.texts, self.size, self.percent, self.hashes = nodes, texts, size, percent, hashes
        self.table = least_matches(percent / 100, hashes, miss)
        self.count = nodes.count()

    def members(self, found: DataFrame | None, bands: int | None = None) -> DataFrame:
        """(key, node, component, size): the members of all buckets that span components, by the first bands or all."""
        own = self.nodes.select("node", "keys" if bands is None else F.slice("keys", 1, bands).alias("keys"))
        if found is not None:
            own = own.join(found, "node", "left")
        own = own.select("node", (F.coalesce("component", "node") if found is not None else F.col("node")).alias("component"), F.explode("keys").alias("key"))
        sizes = own.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        return materialise(own.join(sizes.select("key", "size"), "key"))

    def leaders(self, members: DataFrame) -> DataFrame:
        """(a, b): each member b with the leader it shares most buckets with, of another component.

        A bucket's leader is the member of most company in all its buckets: the text that a group's copies come from
        agrees with the majority in every band, so it leads each of their buckets, whatever its id.
        """
        company = members.groupBy("node").agg(F.sum("size").alias("company"), F.collect_list(F.struct("key", "component")).alias("of"))
        spread = company.select("node", "company", F.inline("of"))
        lead = spread.groupBy("key").agg(F.max_by(F.struct("node", "component"), F.struct("company", -F.col("node"))).alias("lead"))
        met = members.join(lead, "key").where("component <> lead.component").groupBy(F.col("node").alias("b"), F.col("lead.node").alias("a")).agg(F.count("*").alias("n"))
        return materialise(met.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that pass the sequential test on signatures and then reach the threshold on full sets."""
        hashes, table = self.hashes, self.table

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    m = _plausible(_matrix(batch.column("sa"), hashes), _matrix(batch.column("sb"), hashes), table)
                    at = pa.array(np.flatnonzero(m >= 0))
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in names], names=names)

        names = ["a", "b", "ia", "ha", "ib", "hb"]
        left = self.nodes.select(F.col("node").alias("a"), F.col("id").alias("ia"), F.col("h").alias("ha"), F.col("sig").alias("sa"))
        right = self.nodes.select(F.col("node").alias("b"), F.col("id").alias("ib"), F.col("h").alias("hb"), F.col("sig").alias("sb"))
        open_ = materialise(pairs.join(left, "a").join(right, "b").select(*names, "sa", "sb").mapInArrow(run, ", ".join(f"{c} long" for c in names)))
        found = open_.count()
        if not found:
            return open_.select("a", "b")
        ends = F.array(F.struct(F.col("ia").alias("id"), F.col("ha").alias("h")), F.struct(F.col("ib").alias("id"), F.col("hb").alias("h")))
        texts = self.texts_of(open_.select(F.inline(ends)), 2 * found)
        x = texts.select(F.col("id").alias("ia"), F.col("h").alias("ha"), F.col("text").alias("ta"))
        y = texts.select(F.col("id").alias("ib"), F.col("h").alias("hb"), F.col("text").alias("tb"))
        both = open_.join(x, ["ia", "ha"]).join(y, ["ib", "hb"]).select("a", "b", "ta", "tb")
        return materialise(both.mapInArrow(_exact(self.size, self.percent), "a long, b long"))

    def texts_of(self, wanted: DataFrame, rows: int | None = None) -> DataFrame:
        """The texts of the wanted (id, h): few enough of those to be broadcast keep the others out of a shuffle. `rows`
        is the number of wanted rows with repeats, where it is known."""
        if rows is None or rows > BROADCAST_ROWS:
            wanted = materialise(wanted.distinct())
            rows = wanted.count()
        if rows <= BROADCAST_ROWS:
            return self.texts.join(F.broadcast(wanted), ["id", "h"], "left_semi")
        return self.texts

    def pairs(self, members: DataFrame) -> DataFrame:
        """The pairs across components in small buckets: at most SMALL_BUCKET for each member."""
        x = members.where(F.col("size") <= SMALL_BUCKET).select("key", F.col("node").alias("a"), F.col("component").alias("ca"))
        y = x.select("key", F.col("a").alias("b"), F.col("ca").alias("cb"))
        return x.join(y, "key").where("a < b and ca <> cb").select("a", "b").distinct()

    def units(self, members: DataFrame) -> DataFrame:
        """(unit, whole, node, component, bulk): the members of large buckets by the units in which they are compared.

        A group of near copies fills many buckets with much the same members, so all buckets of which one component, the
        bulk, has most members are one unit, each member in it once, and every pair that shares a bucket is its business
        (whole). Where a bulk holds so many members of different buckets that this would be more pairs than bucket by
        bucket, each bucket stays a unit of its own.
        """
        large = members.where(F.col("size") > SMALL_BUCKET).select("key", "node", "component")
        shares = large.groupBy("key", "component").agg(F.count("*").alias("n"))
        buckets = materialise(shares.groupBy("key").agg(F.sum("n").alias("size"), F.max_by("component", F.struct("n", -F.col("component"))).alias("bulk")))
        named = materialise(large.join(buckets.select("key", "bulk"), "key"))
        apart = buckets.groupBy("bulk").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
        together = named.select("bulk", "node").distinct().groupBy("bulk").agg(F.count("*").alias("n"))
        chosen = materialise(together.join(apart, "bulk").select("bulk", (F.col("n") * F.col("n") <= F.col("pairs")).alias("whole")))
        unit = F.when(F.col("whole"), F.col("bulk")).otherwise(F.col("key"))
        return materialise(named.join(chosen, "bulk").select(unit.alias("unit"), "whole", "node", "component", "bulk").distinct())

    def block_links(self, members: DataFrame) -> DataFrame:
        """The links across components in large buckets, one row a link that is needed to join two of them.

        Members meet in block pairs, where a pair passes the same tests as elsewhere: set sizes, the posterior bound on
        signatures, then the exact sets. In a unit of one bucket a pair is its business if no earlier one is shared.
        Signatures go first, in wide blocks without texts, and only members with a plausible partner go on with theirs.
        """
        kinds = self.nodes.select("node", "n", "sig", "keys")
        signed = _dealt(self.units(members), WIDE_BLOCK).join(kinds, "node")
        of = "unit long, whole boolean, node long, component long, bulk long"
        open_ = materialise(signed.groupBy("unit", "whole", "lo", "hi").applyInPandas(_partners(self.percent, self.hashes, self.table), of).distinct())
        named = self.nodes.join(open_.select("node").distinct(), "node", "left_semi").select("node", "id", "h")
        texts = named.join(self.texts_of(named.select("id", "h")), ["id", "h"]).select("node", "text")
        dealt = _dealt(open_, BLOCK).join(kinds, "node").join(texts, "node")
        return materialise(dealt.groupBy("unit", "whole", "lo", "hi").applyInPandas(_links(self.size, self.percent, self.hashes, self.table), "a long, b long"))


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """Members once for each pair of blocks (lo, hi) of their unit that theirs is one of and in which components meet:
    blocks of the bulk, which come first, meet those of other members only, so a bulk with few others goes out once."""
    of_bulk = F.col("component") == F.col("bulk")
    parts = lambda n: F.ceil(F.count_if(n) / block).cast("int")
    sizes = members.groupBy("unit", "whole").agg(parts(of_bulk).alias("bulks"), parts(~of_bulk).alias("rest"))
    within = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    return (
        members.join(sizes.where("rest > 0"), ["unit", "whole"])
        .withColumn("block", F.when(of_bulk, within(F.col("bulks"))).otherwise(F.col("bulks") + within(F.col("rest"))))
        .withColumn("other", F.explode(F.sequence(F.when(of_bulk, F.col("bulks")).otherwise(F.lit(0)), F.col("bulks") + F.col("rest") - 1)))
        .select("unit", "whole", "node", "component", "bulk", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    )


class _Group:
    """The members in one pair of blocks, and which later ones a member has to be compared with."""

    def __init__(self, group, percent: int, hashes: int, table: list[tuple[int, int]]):
        self.rows = group = group.sort_values("node")
        self.nodes, self.component, self.blocks, self.n = (group[c].to_numpy().copy() for c in ("node", "component", "block", "n"))
        self.sig = np.frombuffer(b"".join(group["sig"]), np.uint16).reshape(-1, hashes)
        self.keys = np.stack(group["keys"].to_numpy())
        self.unit, self.lo, self.hi = (int(group[c].iloc[0]) for c in ("unit", "lo", "hi"))
        self.whole = bool(group["whole"].iloc[0])
        self.percent, self.table = percent, table

    def partners(self, i: int) -> np.ndarray:
        """Later members of other components that pass the bound on signatures with i, most matches first."""
        # a pair belongs to the one block pair that both of its blocks name
        ok = (self.blocks[i + 1 :] != self.blocks[i]) | (self.lo == self.hi)
        ok &= self.component[i + 1 :] != self.component[i]
        ok &= 100 * np.minimum(self.n[i], self.n[i + 1 :]) >= self.percent * np.maximum(self.n[i], self.n[i + 1 :])
        at = i + 1 + np.flatnonzero(ok)
        if len(at):
            shared = self.keys[at] == self.keys[i]
            at = at[shared.any(axis=1) if self.whole else self.keys[i][shared.argmax(axis=1)] == self.unit]
        if not len(at):
            return at
        m = _plausible(np.broadcast_to(self.sig[i], (len(at), self.sig.shape[1])), self.sig[at], self.table)
        return at[np.argsort(-m, kind="stable")][: int((m >= 0).sum())]


def _partners(percent: int, hashes: int, table: list[tuple[int, int]]):
    def run(group):
        own = _Group(group, percent, hashes, table)
        some = np.zeros(len(own.nodes), bool)
        for i in range(len(own.nodes) - 1):
            at = own.partners(i)
            some[at] = True
            some[i] |= len(at) > 0
        return own.rows[["unit", "whole", "node", "component", "bulk"]][some]

    return run


def _links(size: int, percent: int, hashes: int, table: list[tuple[int, int]]):
    def run(group):
        import pandas as pd

        own = _Group(group, percent, hashes, table)
        texts = own.rows["text"].to_list()
        sets = _shingles(pa.array(texts), size)
        whole = lru_cache(8)(lambda i: shingle_set(texts[i], size))
        found = []
        for i in range(len(own.nodes) - 1):
            for j in own.partners(i):
                if own.component[i] != own.component[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    # hashes say which pairs to look at, the words themselves decide
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and _similar(whole(i), whole(j), percent):
                        found.append((own.nodes[i], own.nodes[j]))
                        own.component[own.component == own.component[j]] = own.component[i]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def shingle_set(text: str, size: int) -> frozenset:
    """The distinct shingles of a text as words; one that is shorter than a shingle is one shingle."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)])


def _similar(x: frozenset, y: frozenset, percent: int) -> bool:
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _exact(size: int, percent: int):
    """Which of the pairs (a, b) with texts ta and tb have full shingle sets that reach the threshold."""

    def run(batches):
        of = lru_cache(8)(lambda text: shingle_set(text, size))
        for batch in batches:
            cols = [batch.column(c) for c in ("a", "b", "ta", "tb")]
            keep = [i for i in range(batch.num_rows) if _similar(of(cols[2][i].as_py()), of(cols[3][i].as_py()), percent)]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([cols[0].take(at), cols[1].take(at)], names=["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = 5, percent: int = 80, hashes: int = 256, miss: float = 1e-5
) -> DataFrame:
    """Group documents whose shingle sets have 100 * intersection >= percent * union.

    Returns, for each row, (id, n_shingles, component_id, kept): the size of its set, the smallest id reachable by
    links (itself included) and whether that is its own id. Only A-Z are lower-cased; words are runs of other than
    ASCII white space; a text with fewer words than a shingle is one shingle; a null, empty or blank text has none
    and links with nothing. Rows that repeat an id are one document, which has the links of all its texts, and each
    keep a row with the set size of their own text; a row with a null id links with nothing, has a null component and
    is kept. Very long texts are read whole; other columns, whatever their names, are ignored; an empty table gives an
    empty result. `miss` bounds the probability of losing one pair at the threshold, once in the bands and once in the
    sequential test.
    """
    small_batches(docs.sparkSession)
    rows, bands = banding(percent / 100, hashes, miss)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    feats = materialise(
        base.mapInArrow(_features(words_per_shingle, hashes, rows, bands), "id long, h long, n long, print binary, sig binary, keys array<long>")
    )
    sets = feats.where("print is not null")
    nodes = sets.groupBy("print").agg(
        F.min(F.struct("id", "h")).alias("own"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys")
    )
    nodes = materialise(nodes.select("print", "own.id", "own.h", "copies", "n", "sig", "keys", F.monotonically_increasing_id().alias("node")))
    repeated = materialise(sets.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1"))
    texts = base.where("id is not null and text is not null")
    links = []
    if not repeated.isEmpty():
        # the texts of one id hang together, and each is read once
        texts = texts.dropDuplicates(["id", "h"])
        whose = sets.select("id", "print").join(repeated.select("id"), "id", "left_semi").distinct().join(nodes.select("print", "node"), "print")
        least = whose.groupBy("id").agg(F.min("node").alias("b"))
        links.append(materialise(whose.join(least, "id").select(F.col("node").alias("a"), "b").where("a <> b")))
    corpus = _Corpus(nodes, texts, words_per_shingle, percent, hashes, miss)
    found, tested = None, None
    for upto in (FIRST_BANDS, None):
        members = corpus.members(found, upto)
        if found is not None and members.isEmpty():
            break
        first = corpus.leaders(members)
        if tested is not None:
            first = materialise(first.join(tested, ["a", "b"], "left_anti"))
        links.append(corpus.verified(first))
        if found is None or not links[0].isEmpty():
            stars = [] if found is None else [found.select(F.col("node").alias("a"), F.col("component").alias("b"))]
            found = components(_union([*stars, *links]))
        discard(members, *links)
        tested, links = first if tested is None else tested.union(first), []
    members = corpus.members(found)
    if not members.isEmpty():
        ordered = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = [corpus.verified(materialise(corpus.pairs(members).join(ordered, ["a", "b"], "left_anti")))]
        if not members.where(F.col("size") > SMALL_BUCKET).isEmpty():
            more.append(corpus.block_links(members))
        if not all(m.isEmpty() for m in more):
            found = components(_union([found.select(F.col("node").alias("a"), F.col("component").alias("b")), *more]))
    # the smallest id of each component, for every node
    lows = materialise(found.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("root"), F.count("*").alias("size")))
    roots = join_counted(found, lows, "component", "size", corpus.count, lows.count()).select("node", "root")
    named = materialise(nodes.select("print", "node", "id", "copies").join(roots, "node", "left").select("print", F.coalesce("root", "id").alias("root"), "copies"))
    known = join_counted(sets.select("id", "n", "print"), named, "print", "copies", feats.count(), corpus.count).select("id", "n", "root")
    alone = feats.where("print is null").select("id", "n", F.col("id").alias("root"))
    return known.union(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.col("id").eqNullSafe(F.col("root")).alias("kept")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.select("a", "b").union(p.select("a", "b"))
    return out
