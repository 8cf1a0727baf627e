"""Near-duplicate records: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..runtime import cut, fingerprint

#: Share of the pairs just at the threshold that may share no band; more similar ones are missed far less.
MISS = 0.01
#: MinHash values of a band: as many as make the work least, within these.
LEAST_ROWS, MOST_ROWS = 2, 8
#: Sets from which the similarity of unrelated sets is told, and tokens of each that are looked at on average at most; neither decides what is found.
SAMPLE_SETS, SAMPLE_TOKENS = 600, 2048
#: What a band's row costs to shuffle and sort, against a pair that meets in a bucket.
ROW_COST = 20
#: Rows of a bucket that one cell of its grid holds; larger buckets are told from one record in PROBE.
BUCKET, PROBE = 1024, 64
#: MinHash values of a signature, of each of which some low bits are kept, and after how many a pair is judged.
SIGNATURE, STEPS = 192, (64, 128, 192)
SHORT_BITS = 4
#: The bigint columns that hold a signature.
SHORT = tuple(f"s{i}" for i in range(SIGNATURE * SHORT_BITS // 64))
#: A pair is dropped when its posterior probability of reaching the threshold is less.
TOLERANCE = 1e-4
#: Up to so many records of one and the same text, byte by byte, are linked pair by pair, more by their representative.
COPIES_IN_PAIRS = 64
SEED = 20_240_517
# Fixed value: CJK unified ideographs, which are cut into pairs, and the character after the last of them.
CJK, AFTER_CJK = r"一-鿿", "\ua000"


def token_hashes(content: Column) -> Column:
    """The sorted distinct tokens of a text, hashed: lower-cased runs of letters or digits, runs of ideographs as their adjacent pairs."""
    runs = F.regexp_extract_all(F.lower(content), F.lit(rf"([{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+)"), 1)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))
    # Strings compare by code point here, so a run of ideographs is one that lies between two bounds.
    cut_runs = F.transform(runs, lambda r: F.when((r >= CJK[0]) & (r < AFTER_CJK) & (F.length(r) > 1), pairs(r)).otherwise(F.array(r)))
    tokens = F.when(content.rlike(rf"[{CJK}]{{2}}"), F.flatten(cut_runs)).otherwise(runs)
    return F.sort_array(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))))


def least_matches(threshold: float, tolerance: float = TOLERANCE, steps: tuple[int, ...] = STEPS) -> list[tuple[int, int]]:
    """(n, m) per step: with fewer than m of the first n values equal, P(similarity >= threshold) < tolerance under a uniform prior."""
    found = []
    for n in steps:
        below = 0.0
        for m in range(n + 1):
            # The posterior is Beta(m + 1, n - m + 1); its tail is a binomial sum.
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                found.append((n, m))
                break
    return found


def band_count(rows: int, threshold: float, miss: float = MISS) -> int:
    """Bands of ``rows`` MinHash values of which a pair at the threshold shares none with probability ``miss``."""
    return ceil(log(miss) / log(1 - threshold**rows))


def _similarities(sets: list[np.ndarray]) -> np.ndarray:
    """Similarity of each two of some sets."""
    sizes = np.array([len(s) for s in sets], np.float64)
    names, owner = np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(len(sets)), sizes.astype(int))
    shared = np.zeros((len(sets), len(sets)))
    order = np.argsort(names, kind="stable")
    names, owner = names[order], owner[order]
    for low in range(0, int(names[-1]) + 1, 4096):
        at, to = np.searchsorted(names, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[at:to], names[at:to] - low] = 1
        shared += part @ part.T
    both = sizes[:, None] + sizes[None, :] - shared
    return (shared / np.maximum(both, 1))[np.triu_indices(len(sets), 1)]


def choose_rows(similarities: np.ndarray, n: int, threshold: float) -> int:
    """MinHash values of a band for which shuffled rows and meeting pairs of ``n`` sets cost least; the share found is the same for all."""
    costs = {}
    for rows in range(LEAST_ROWS, MOST_ROWS + 1):
        bands = band_count(rows, threshold)
        meet = float((1 - (1 - similarities**rows) ** bands).mean()) if len(similarities) else 0.0
        costs[rows] = n * bands * ROW_COST + n * (n - 1) / 2 * meet
    return min(costs, key=costs.get)


def _minima(values: np.ndarray, starts: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = np.empty((len(starts), len(by)), np.uint64)
    for k in range(0, len(by), 16):
        mixed = values[:, None] * by[None, k : k + 16]
        mixed ^= mixed >> np.uint64(29)
        out[:, k : k + 16] = np.minimum.reduceat(mixed, starts, axis=0)
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches that bound the memory of their MinHash values, with their tokens and where each set begins."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            lists = part.column("hashes")
            sizes = np.diff(np.asarray(lists.offsets))
            yield part, np.asarray(lists.flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def _signature(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    factors = np.random.default_rng(SEED).integers(1, 2**63, SIGNATURE, dtype=np.uint64) | np.uint64(1)
    return (_minima(values, starts, factors) >> np.uint64(40)).astype(np.uint8)


def _bands(rows: int, bands: int):
    """Arrow function (n, hashes) -> (n, bands, and the signature in SHORT); a band is a hash of its number and MinHash values."""
    rng = np.random.default_rng(SEED + 1)
    factors = rng.integers(1, 2**63, rows * bands, dtype=np.uint64) | np.uint64(1)
    mixers = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
    numbers = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def keys(least: np.ndarray) -> np.ndarray:
        of = least.reshape(len(least), bands, rows)
        mixed = np.broadcast_to(numbers, of.shape[:2]).copy()
        for r in range(rows):
            mixed = (mixed ^ of[:, :, r]) * mixers[r]
            mixed ^= mixed >> np.uint64(31)
        return mixed.view(np.int64)

    def short(signature: np.ndarray) -> np.ndarray:
        low = signature & np.uint8(2**SHORT_BITS - 1)
        return np.ascontiguousarray(low[:, ::2] << np.uint8(4) | low[:, 1::2]).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values, starts in _pieces(batches):
            flat = pa.array(keys(_minima(values, starts, factors)).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
            low = np.ascontiguousarray(short(_signature(values, starts)).T)
            yield pa.RecordBatch.from_arrays([part.column("n"), lists, *map(pa.array, low)], names=["n", "bands", *SHORT])

    return run


def _may_reach(threshold: float) -> Column:
    """Whether two signatures (x.SHORT, y.SHORT) leave a posterior of TOLERANCE after each step; the first step that doesn't ends the comparison.

    Unequal MinHash values have equal low bits once in 2 ** SHORT_BITS, which
    the limits allow for.
    """
    def unequal(columns: tuple[str, ...]) -> Column:
        """Of the values in four columns: any differing bit of a value moved to its lowest place, and one place further per column, so that one count tells all."""
        out = F.lit(0).cast("bigint")
        for i, c in enumerate(columns):
            d = F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))
            d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
            flags = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111))
            out = flags if i == 0 else out.bitwiseOR(F.shiftleft(flags, i))
        return F.bit_count(out)

    counts = [unequal(SHORT[i : i + SHORT_BITS]) for i in range(0, len(SHORT), SHORT_BITS)]
    out = F.lit(True)
    for i, (n, m) in enumerate(least_matches(threshold + (1 - threshold) * 0.5**SHORT_BITS)):
        out = out & (sum(counts[1 : i + 1], counts[0]) <= n - m)
    return out


def _pairs_within(rows: DataFrame, key: str, row: str, large: DataFrame | None, test: Column | None = None) -> DataFrame:
    """(a, b), a < b, of each two rows of one key that pass ``test`` on x and y.

    ``large`` has (key, n) of the keys with many rows: these are dealt into
    blocks of about ``BUCKET`` rows, and each two blocks are one cell of an
    equi-join, so no task holds a key.
    """
    test = F.lit(True) if test is None else test
    meet = lambda x, y, on: x.alias("x").join(y.alias("y"), on & test).select(F.least(f"x.{row}", f"y.{row}").alias("a"), F.greatest(f"x.{row}", f"y.{row}").alias("b"))
    same = F.col(f"x.{key}") == F.col(f"y.{key}")
    ordered = F.col(f"x.{row}") < F.col(f"y.{row}")
    if large is None:
        return meet(rows, rows, same & ordered)
    few = rows.join(large.select(key), key, "left_anti")
    blocks = large.select(key, F.ceil(F.col("n") / F.lit(BUCKET)).cast("int").alias("k"))
    many = rows.join(blocks, key).withColumn("block", F.pmod(F.xxhash64(F.lit(3), row), F.col("k")).cast("int"))
    left = many.withColumn("lo", F.col("block")).withColumn("hi", F.explode(F.sequence(F.col("block"), F.col("k") - 1)))
    right = many.withColumn("hi", F.col("block")).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("block"))))
    cell = same & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi")) & ((F.col("x.lo") < F.col("x.hi")) | ordered)
    return meet(few, few, same & ordered).unionByName(meet(left, right, cell))


def _banded(distinct: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the sets (n, hashes) that share a band and whose MinHash values agree well enough."""
    count, tokens = distinct.agg(F.count(F.lit(1)), F.avg(F.size("hashes"))).first()
    thin = 1 + int((tokens or 0) // SAMPLE_TOKENS)
    sample = distinct.orderBy(F.xxhash64("n")).limit(SAMPLE_SETS).select(F.filter("hashes", lambda h: F.pmod(h, F.lit(thin)) == 0).alias("h"))
    sets = [np.array(r.h, np.int64) for r in sample.collect() if r.h]
    rows = choose_rows(_similarities(sets) if len(sets) > 1 else np.empty(0), count, threshold)
    number = band_count(rows, threshold)
    schema = "n bigint, bands array<bigint>, " + ", ".join(f"{c} bigint" for c in SHORT)
    banded = lambda df: df.select("n", "hashes").mapInArrow(_bands(rows, number), schema)
    probe = distinct.where(F.pmod(F.xxhash64(F.lit(11), "n"), F.lit(PROBE)) == 0)
    large = cut(banded(probe).select(F.explode("bands").alias("band")).groupBy("band").count().where(F.col("count") * PROBE >= BUCKET).select("band", (F.col("count") * PROBE).alias("n")))
    # Columns that can't be null keep the join's generated code short enough to be compiled.
    bands = banded(distinct).select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", *SHORT)], F.explode("bands").alias("band"))
    return _pairs_within(bands, "band", "n", None if large.isEmpty() else large, _may_reach(threshold)).distinct()


def _prefixes(distinct: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(a, b) of the sets (n, hashes) that share one of their rarest tokens, which every pair at the threshold does.

    Of sets that share so much, the smaller's tokens beyond the greatest possible
    number of differing ones, rarest first, hold one that both have.
    """
    tokens = distinct.select("n", F.size("hashes").alias("size"), F.explode("hashes").alias("t"))
    counts = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(counts, "t").groupBy("n", "size").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("by"))
    # A set of this size shares at least size * threshold, rounded up, with any set similar to it.
    length = F.col("size") - F.ceil(F.col("size") * numerator / F.lit(denominator)).cast("int") + 1
    heads = ranked.select("n", "size", F.explode(F.slice("by", F.lit(1), length)).alias("x")).select("n", "size", F.col("x.t").alias("t"))
    near = (F.col("x.size") * denominator >= F.col("y.size") * numerator) & (F.col("y.size") * denominator >= F.col("x.size") * numerator)
    large = cut(heads.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BUCKET))
    return _pairs_within(heads, "t", "n", None if large.isEmpty() else large, near).distinct()


def similar_classes(df: DataFrame, row_id: str, content: str, numerator: int, denominator: int, tokens=token_hashes, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): each record's class of equal token sets, and the similar pairs of different classes.

    members: id, rep (the class's least id), text (a key of the exact text).
    links: a, b with a < b, both reps. Records with a null text or without any token have no set and are in
    neither; empty tables give empty results; ids must be unique, and columns
    other than the two named are not read. Similarity is shared tokens by all
    tokens of both, compared in integers with numerator/denominator.

    Equal sets are joined before anything else, so a class of any size is one
    row. Candidates share a band of MinHash values of their whole sets. How
    many values make a band follows from the number of sets and the similarity
    of unrelated ones, so that the work is least; the number of bands follows
    from that, so that a pair at the threshold is missed with probability
    ``MISS`` whatever the size of the collection. Bands carry a signature of
    further MinHash values. Where two records meet in a band, these are
    compared in ``STEPS``, and the pair is dropped once its posterior
    probability of reaching the threshold falls below ``TOLERANCE``; so only
    pairs that are likely leave the join, and these are verified exactly. With
    ``exact``, candidates share a token of their prefixes instead, and every
    similar pair is found; that takes far longer where tokens are few.
    """
    threshold = numerator / denominator
    base = df.select(F.col(row_id).alias("id"), fingerprint(F.col(content)).alias("text"), tokens(F.col(content)).alias("hashes")).where(F.size("hashes") > 0)
    key = F.struct(F.xxhash64("hashes").alias("a"), F.xxhash64(F.lit(5), F.reverse("hashes"), F.size("hashes")).alias("b"))
    sets = cut(base.select("id", "text", key.alias("key"), "hashes"))
    reps = sets.groupBy("key").agg(F.min("id").alias("rep"))
    members = sets.select("id", "text", "key").join(reps, "key").select("id", "rep", "text")
    distinct = cut(sets.groupBy("key").agg(F.min("id").alias("rep"), F.first("hashes").alias("hashes")).select(F.monotonically_increasing_id().alias("n"), "rep", "hashes"))
    candidates = _prefixes(distinct, numerator, denominator) if exact else _banded(distinct, threshold)
    side = lambda c: distinct.select(F.col("n").alias(c), F.col("rep").alias(f"r{c}"), F.col("hashes").alias(f"h{c}"))
    both = candidates.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    links = both.where(shared * denominator >= (F.size("ha") + F.size("hb") - shared) * numerator)
    return members, links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))


def similar_pairs(df: DataFrame, row_id: str, content: str, numerator: int, denominator: int, copies_in_pairs: int = COPIES_IN_PAIRS, exact: bool = False) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of similar records; see :func:`similar_classes` for what counts.

    Different texts are linked each with each, also those of one token set.
    Records of one and the same text are too, up to ``copies_in_pairs``; of
    more, each is linked with their representative, and other texts with the
    representative only, which together imply all other pairs.
    """
    members, links = similar_classes(df, row_id, content, numerator, denominator, exact=exact)
    members = cut(members)
    copies = members.groupBy("rep", "text").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where(F.col("n") > copies_in_pairs)
    known = members.join(copies, ["rep", "text"], "left")
    many = known.where("id <> first").select(F.col("first").alias("id_a"), F.col("id").alias("id_b"))
    # Members that are linked pair by pair: all but the further copies of a frequent text. A class's rep is always one.
    standing = cut(known.where("first is null or id = first").select("rep", "id"))
    large = cut(standing.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BUCKET))
    within = _pairs_within(standing, "rep", "id", None if large.isEmpty() else large).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    spread = links.join(standing.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(standing.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    between = spread.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return between.unionByName(within).unionByName(many)


def groups(df: DataFrame, row_id: str, content: str, numerator: int, denominator: int) -> DataFrame:
    """(id, rep, group_id, n_links) of every record with tokens: its class, its group of linked classes and its class's links to other texts."""
    members, found = similar_classes(df, row_id, content, numerator, denominator)
    links = cut(found)
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    labels = connected_components(links, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("group_id"))
    joined = members.join(labels, "rep", "left").join(ends, "rep", "left")
    return joined.select("id", "rep", F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
