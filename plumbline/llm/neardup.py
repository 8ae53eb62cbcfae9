"""Pairs of nearly equal texts: HyperMinHash sketches, banding, corrected estimate, verification on whole bags.

Steps, each a distributed stage:

1. `sketched`: one Arrow pass over the texts gives every record its class (hash of the word sequence, so copies share
   one) and its sketch; written once to the shared folder. Within a task only the first record of a class carries a
   sketch, so that a mass of copies doesn't reach the bands.
2. `candidates`: bands of registers as `layout` says, WAVE at a time. The keys of a batch go out packed, ENTRY bytes per class
   and band, to buckets that are partitions of their own; there are as many of a band as keep a bucket near BUCKET
   entries. Each bucket is sorted in NumPy and its runs of equal keys give pairs, of which sizes and filter bits rule out
   nearly all that are not similar before anything is written: these grow with the square of the rows.
3. `verified`: pairs whose corrected estimate is under FLOOR go (6 standard errors under the threshold); the rest meets
   its texts and is kept if the similarity of the whole bags reaches the threshold.
4. `multiplied`: pairs of classes become pairs of records, all of them. Beyond FULL pairs of two classes, records are dealt
   to blocks of some BLOCK and pairs of blocks are spread over the tasks. `expanded` is the short form: beyond FULL pairs,
   each copy is paired with the other class's least record, and `classes` holds the membership.

Nulls and texts of fewer than `least` words are left out. Tables of up to ALL classes are compared whole. Beyond, a pair
at the threshold shares no band in 1 of 1,000,000 cases by the binomial distribution of equal registers, less above it,
and falls under FLOOR in 2 of 1,000,000,000. Parities and sizes rule out no similar pair, register bits of two long texts 1 in 100,000,000.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.llm import sketch as S
from plumbline.scratch import bounded, counted, cut, forget

# Bands by their rows: as many as leave a pair at the threshold without a common one once in a million times.
LAYOUTS = {4: 83, 5: 152, 6: 279, 7: 534, 8: 1010}
ROWS = 4
BANDS = LAYOUTS[ROWS]
ALL, SAMPLE, SHIPPED = 20_000, 1_500, 700  # classes that are all compared; sketches sampled; pairs compared in the time an entry takes
WAVE = 16  # bands at a time: some 560 bytes a class on disk
BUCKET = 500_000  # entries: some MB a task, and few false pairs by the 32 bits of a key
PACK = 50_000  # sketches packed at once, so that blobs stay long where buckets are many
FLOOR, THRESHOLD, LEAST = 0.45, 0.7, 8
APART = (1 - THRESHOLD) / (1 + THRESHOLD)  # of the words of both texts, so many at most stand in one only
LONG, LONG_APART = 180, 44  # words; register bits that differ, of 128: 6 standard errors over those at the threshold
ENTRY, RUN = 35, 32
FULL = 10_000
BLOCK = 1_000  # records: two blocks give some million pairs
_LOW40 = np.uint64((1 << 40) - 1)


def _class(w: list[str], g: int, side: int) -> int:
    return (xxhash.xxh3_64_intdigest(" ".join(w), g) & ~1 | (side & 1)) - (1 << 63)


def sketched(df: DataFrame, least: int = LEAST) -> DataFrame:
    """(g, side, id, fp, sk) of `df` with (g int, side int, id bigint, text string): one row per record.

    fp is the class: a hash of group and word sequence whose last bit is replaced by `side & 1`, so that the same words on
    both sides differ in that bit alone. sk is null for further records of a class in the same batch of rows. Rows stored
    twice come out once per batch; `expanded` drops the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, bags, first, seen, g, side, ids, fps = [], [], [], set(), [], [], [], []
            for gi, si, i, t in zip(*(b.column(n).to_pylist() for n in ("g", "side", "id", "text"))):
                if i is None or len(w := S.words(t)) < least:
                    continue
                fp = _class(w, gi, si)
                if new := fp not in seen:
                    seen.add(fp)
                    bags.append(w)
                first.append(new)
                g.append(gi), side.append(si), ids.append(i), fps.append(fp)
            sk = iter(x.tobytes() for x in S.sketches(bags))
            yield pa.RecordBatch.from_arrays(
                [pa.array(g, pa.int32()), pa.array(side, pa.int32()), pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array([next(sk) if f else None for f in first], pa.binary())],
                ["g", "side", "id", "fp", "sk"],
            )

    return cut(df.select("g", "side", "id", "text").mapInArrow(run, "g int, side int, id bigint, fp bigint, sk binary"), "lz4")


def _fits(w: list[np.ndarray], ln: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether entries i and j can reach the threshold, by their sizes and filter bits; ln[i] <= ln[j]."""
    long, a, b = ln[i] >> 15, (ln[i] & 32767).astype(np.int64), (ln[j] & 32767).astype(np.int64)
    apart = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in w)
    return (long == ln[j] >> 15) & (a >= THRESHOLD * b - 1e-6) & np.where(long == 1, apart <= LONG_APART, (a <= LONG) & (apart <= APART * (a + b) + 1e-6))


def _run_pairs(x: np.ndarray, across: bool) -> Iterator[pa.RecordBatch]:
    """(a, b) of classes with equal keys in the entries of one bucket, as far as sizes and filter bits allow the threshold.

    What the bits rule out never leaves the task: unrelated texts that share a key grow with the square of the rows.
    """
    key = np.ascontiguousarray(x[:, :4]).view("<u4")[:, 0]
    wide = np.zeros((len(x), 8), np.uint8)
    wide[:, :5] = x[:, 4:9]
    fp, ln = wide.view("<u8")[:, 0], np.ascontiguousarray(x[:, 9:11]).view("<u2")[:, 0]
    order = np.argsort(key.astype(np.uint64) << np.uint64(32) | ln.astype(np.uint64) << np.uint64(16) | fp & np.uint64(0xFFFF))
    key, fp = key[order], fp[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
    key, fp, order = key[new], fp[new], order[new]
    ln, bits = ln[order], np.ascontiguousarray(x[order, 11:]).view("<u8")
    w = [np.ascontiguousarray(bits[:, c]) for c in range(bits.shape[1])]
    size = (ln & 32767).astype(np.float64)
    held, n = [], 0

    def batch() -> pa.RecordBatch:
        a, b = (np.concatenate(v) for v in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).astype(np.int64)), pa.array(np.maximum(a, b).astype(np.int64))], ["a", "b"])

    def keep(i: np.ndarray, j: np.ndarray) -> int:
        m = _fits(w, ln, i, j)
        a, b = fp[i[m]], fp[j[m]]
        d = a ^ b  # 1: the same words on two sides, which the hash of the record has found
        m = ((d & np.uint64(1)) == 1) & (d > 1) if across else d > 0
        held.append((a[m], b[m]))
        return int(m.sum())

    met, n_met = [], 0

    def keep_met() -> int:
        i, j = (np.concatenate(v) for v in zip(*met))
        return keep(i[i < j], j[i < j])

    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(key))
    wide_run = ends - starts > RUN
    # Short runs all at once: entries at distance `step`; what is left of a run shrinks by one each time.
    at, step = np.flatnonzero(np.repeat(~wide_run, ends - starts)), 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        for s in range(0, len(at), 200_000):
            n += keep(at[s : s + 200_000], at[s : s + 200_000] + step)
            if n > 200_000:
                yield batch()
                held, n = [], 0
    # Long ones in blocks, in the order of size: two words of bits for all pairs whose sizes allow it, then `_fits`.
    for s, e in zip(starts[wide_run], ends[wide_run]):
        for i in range(s, e, RUN):
            top = min(i + RUN, e) - 1
            stop = i + np.searchsorted(ln[i:e], min(65535, (int(ln[top]) & 32768) + int(size[top] / THRESHOLD + 1e-6)), "right")
            for j in range(i, stop, 4096):
                to = min(j + 4096, stop)
                most = np.where(ln[j:to] >> 15 == 1, LONG_APART, np.minimum(255, APART * (size[top] + size[j:to]) + 1e-6)).astype(np.uint8)
                apart = np.bitwise_count(w[0][i : top + 1, None] ^ w[0][j:to])
                apart += np.bitwise_count(w[1][i : top + 1, None] ^ w[1][j:to])
                hit = np.flatnonzero(apart <= most)
                if len(hit):
                    met.append((i + hit // (to - j), j + hit % (to - j)))
                    n_met += len(hit)
                if n_met > 100_000:
                    n += keep_met()
                    met, n_met = [], 0
                    if n > 200_000:
                        yield batch()
                        held, n = [], 0
    if met:
        n += keep_met()
    if n:
        yield batch()


def _entries(x: np.ndarray, fp: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sketches, groups, entries) of the sketches x: entries are uint8 [n, ENTRY] of 4 bytes for the key, 5 of the class,
    2 of the size and 24 of filter bits.

    Texts of up to LONG / THRESHOLD words have their parities; those of more than LONG words one bit of each register, as
    parities of many words differ half of the time; texts between have an entry of each kind. Kinds are groups of their
    own: of any pair over the threshold both are short, with one of up to LONG words, or both long.
    """
    n = x[:, S.SIZE_AT : S.PARITY_AT].copy().view("<u2")[:, 0]
    short, long = np.flatnonzero(n <= LONG / THRESHOLD + 1e-6), np.flatnonzero(n > LONG)
    out = np.zeros((len(short) + len(long), ENTRY), np.uint8)
    at = np.concatenate([short, long])
    out[:, 4:9] = fp[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    size = np.minimum(n[at], 32767).astype("<u2")
    size[len(short) :] |= 32768
    out[:, 9:11] = size.view(np.uint8).reshape(-1, 2)
    out[: len(short), 11:] = x[short, S.PARITY_AT :]
    out[len(short) :, 11 : 11 + S.REGISTERS // 8] = np.packbits(x[long, : S.REGISTERS] & 1, axis=1)
    return x[at], 2 * g[at].astype(np.int64) + (size >> 15), out


def layout(some: DataFrame, n: int) -> tuple[int, int]:
    """(rows, bands) for the n sketches of `some`: none and one, which is every pair, for up to ALL, else the cheapest of
    LAYOUTS by the share of a sample's pairs that would meet in a band. None of them finds less than another."""
    if n <= ALL:
        return 0, 1
    got = some.filter(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // SAMPLE))) == 0).select("g", "sk").limit(2 * SAMPLE).collect()
    sk = np.frombuffer(b"".join(r.sk for r in got), np.uint8).reshape(len(got), S.WIDTH)
    share = S.agreement(sk, np.array([r.g for r in got], np.int64))
    met = {k: n * float(share @ (np.arange(S.REGISTERS + 1) / S.REGISTERS) ** k) for k in LAYOUTS}
    rows = min(LAYOUTS, key=lambda k: LAYOUTS[k] * (SHIPPED + met[k]))
    return rows, LAYOUTS[rows]


def candidates(sk: DataFrame, across: bool) -> DataFrame:
    """Distinct (a, b), a < b: 40-bit ends of classes that share a band and may be similar. across: only of different
    sides and words.

    Bands go in waves of WAVE, one after the other, so that the keys of one wave only are on disk at a time.
    """
    some = sk.filter("sk is not null").select("g", "fp", "sk")
    n = some.count()
    parts = max(1, -(-n // BUCKET))
    rows, bands = layout(some, n)
    pick = S.picks(bands, rows)

    def pack(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for b in batches:
                held.append(b)
                n += b.num_rows
                if n >= PACK:
                    yield packed(held)
                    held, n = [], 0
            if n:
                yield packed(held)

        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = np.frombuffer(b"".join(t.column("sk").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            fp = t.column("fp").to_numpy().view(np.uint64) & _LOW40
            x, g, rest = _entries(x, fp, t.column("g").to_numpy())
            keys = S.band_keys(x, pick[first:last], g)
            buckets, blobs = [], []
            for band, k in enumerate(keys):
                part = (k % np.uint64(parts)).astype(np.uint16 if parts <= 65536 else np.int64)  # 16 bits sort faster
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                rest[:, :4] = (k >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(-1, 4)
                entries = rest[order]
                for p in np.flatnonzero(np.diff(cuts)):
                    buckets.append(band * parts + int(p))
                    blobs.append(entries[cuts[p] : cuts[p + 1]].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        return run

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition is one bucket: of some BUCKET entries, whatever the data, as a class has one entry a band.
        blobs = [x for b in batches for x in b.column("blob").to_pylist()]
        if blobs:
            yield from _run_pairs(np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, ENTRY), across)

    out = []
    for first in range(0, bands, WAVE):
        last = min(first + WAVE, bands)
        wave = some.mapInArrow(pack(first, last), "bucket int, blob binary").repartitionById((last - first) * parts, F.col("bucket"))
        out.append(cut(wave.mapInArrow(collide, "a bigint, b bigint").distinct()))
    pairs = cut(functools.reduce(DataFrame.unionByName, out).distinct())
    forget(*out)
    return pairs


def _low(fp: str) -> Column:
    return F.col(fp).bitwiseAND(F.lit((1 << 40) - 1))


@F.pandas_udf(T.DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series(S.estimate(x, y))


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([S.bag_similarity(S.words(x), S.words(y)) for x, y in zip(a, b)], dtype="float64")


def verified(sk: DataFrame, cand: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(fa, fb, similarity) of classes whose bags are similar by `threshold` or more, written; texts: (g, side, id, text).

    `cand` and what is made on the way are removed.
    """
    # Sketches of classes in a candidate pair only; the others move once and no further.
    met = bounded(cand.select(F.explode(F.array("a", "b")).alias("low")).distinct())
    one = sk.filter("sk is not null").withColumn("low", _low("fp")).join(met, "low", "left_semi")
    one = cut(one.groupBy("fp", "low").agg(F.first("sk").alias("sk"), F.min(F.struct("g", "side", "id")).alias("rep")), "lz4")
    left = one.select(F.col("low").alias("a"), F.col("fp").alias("fa"), F.col("sk").alias("ska"), F.col("rep").alias("ra"))
    right = one.select(F.col("low").alias("b"), F.col("fp").alias("fb"), F.col("sk").alias("skb"), F.col("rep").alias("rb"))
    close = cut(
        cand.join(left, "a").join(right, "b").filter(_estimate("ska", "skb") >= FLOOR)
        .select("fa", "fb", "ra", "rb")
    )
    forget(cand, met, one)
    wanted = bounded(close.select(F.explode(F.array("ra", "rb")).alias("r")).select("r.*").distinct())

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_class(S.words(t), g, s) for g, s, t in zip(*(b.column(n).to_pylist() for n in ("g", "side", "text")))]
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), b.column("text")], ["fp", "text"])

    # By class, not by id: rows of one id may have different texts. Texts of one class have the same words, any one does.
    text = texts.join(wanted, ["g", "side", "id"], "left_semi").select("g", "side", "text").mapInArrow(own, "fp bigint, text string")
    text = cut(text.groupBy("fp").agg(F.max("text").alias("text")))
    forget(wanted)
    out = cut(
        close.join(text.select(F.col("fp").alias("fa"), F.col("text").alias("ta")), "fa")
        .join(text.select(F.col("fp").alias("fb"), F.col("text").alias("tb")), "fb")
        .withColumn("similarity", _similarity("ta", "tb")).filter(F.col("similarity") >= threshold)
        .select("fa", "fb", "similarity")
    )
    forget(close, text)
    return out


def classes(sk: DataFrame) -> DataFrame:
    """(fp, g, id) without the rows stored twice."""
    return sk.select("fp", "g", "id").distinct()


def expanded(sk: DataFrame, pairs: DataFrame, within: bool = True, full: int = FULL) -> DataFrame:
    """Distinct (g, id_a, id_b), id_a < id_b, of pairs (fa, fb) of classes and, if `within`, of copies in one class.

    Up to `full` pairs per two classes (or one) all come out; beyond, each copy with the least record of the other
    class (or its own), which is linear in the copies and keeps everyone's link; `classes` names the members.
    """
    c = classes(sk)
    size = c.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lead"))
    sized = (
        pairs.select("fa", "fb").join(size.select(F.col("fp").alias("fa"), F.col("n").alias("na"), F.col("lead").alias("la")), "fa")
        .join(size.select(F.col("fp").alias("fb"), F.col("n").alias("nb"), F.col("lead").alias("lb")), "fb")
        .withColumn("all", F.col("na") * F.col("nb") <= full)
    )
    ma, mb = c.select(F.col("fp").alias("fa"), "g", F.col("id").alias("x")), c.select(F.col("fp").alias("fb"), F.col("id").alias("y"))
    out = [sized.filter("all").join(ma, "fa").join(mb, "fb").select("g", "x", "y")]
    big = sized.filter(~F.col("all"))
    out.append(big.join(ma, "fa").select("g", "x", F.col("lb").alias("y")))
    out.append(big.join(mb, "fb").join(c.select(F.col("fp").alias("fa"), "g", F.col("id").alias("la")), ["fa", "la"]).select("g", F.col("la").alias("x"), "y"))
    if within:
        many = c.join(size.filter("n > 1"), "fp")
        few = many.filter(F.col("n") * F.col("n") <= full)
        out.append(few.select("fp", "g", F.col("id").alias("x")).join(few.select("fp", F.col("id").alias("y")), "fp").filter("x < y").select("g", "x", "y"))
        out.append(many.filter((F.col("n") * F.col("n") > full) & (F.col("id") > F.col("lead"))).select("g", F.col("lead").alias("x"), F.col("id").alias("y")))
    u = out[0]
    for o in out[1:]:
        u = u.unionByName(o)
    return u.filter("x <> y").select("g", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def several(sk: DataFrame) -> DataFrame:
    """(g, id, fps) of the records with texts of more than one class."""
    return classes(sk).groupBy("g", "id").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)


def multiplied(sk: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct (g, id_a, id_b), id_a < id_b: every pair of records of two classes in (fa, fb) or of one class, however
    many copies there are.

    Class pairs of up to FULL record pairs meet by class. The records of others are dealt to blocks of some BLOCK by a hash;
    pairs of blocks go to tasks of their own, four at a time, and are multiplied out there, row by row. What they give is
    distinct as it comes, but for records in several classes: these pairs alone are compared with one another.
    """
    c = classes(sk)
    size = c.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    two = cut(
        pairs.select("fa", "fb").join(size.select(F.col("fp").alias("fa"), F.col("n").alias("na")), "fa")
        .join(size.select(F.col("fp").alias("fb"), F.col("n").alias("nb")), "fb").select("fa", "fb", "na", "nb")
        .unionByName(size.filter("n > 1").select(F.col("fp").alias("fa"), F.col("fp").alias("fb"), F.col("n").alias("na"), F.col("n").alias("nb")))
    )
    many = F.col("na") * F.col("nb") > FULL
    ends = lambda x, y: (F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b"))
    ma, mb = c.select(F.col("fp").alias("fa"), "g", F.col("id").alias("x")), c.select(F.col("fp").alias("fb"), F.col("id").alias("y"))
    few = two.filter(~many).join(ma, "fa").join(mb, "fb").filter("x <> y").select("g", *ends("x", "y"))
    hot = two.filter(many)
    if hot.isEmpty():
        return few.distinct()
    of = hot.select(F.col("fa").alias("fp"), F.col("na").alias("n")).unionByName(hot.select(F.col("fb").alias("fp"), F.col("nb").alias("n"))).distinct()
    n_blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    blocks = cut(
        c.join(of, "fp").join(bounded(several(sk).select("g", "id", F.lit(True).alias("also"))), ["g", "id"], "left")
        .groupBy("fp", "g", F.pmod(F.xxhash64("id"), n_blocks("n")).alias("block"), F.col("also").isNotNull().alias("also"))
        .agg(F.collect_list("id").alias("ids"))
    )
    left = blocks.select(F.col("fp").alias("fa"), "g", F.col("block").alias("ba"), F.col("also").alias("sa"), F.col("ids").alias("xs"))
    right = blocks.select(F.col("fp").alias("fb"), F.col("block").alias("bb"), F.col("also").alias("sb"), F.col("ids").alias("ys"))
    met, n = counted(
        hot.withColumn("ba", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks("na") - 1)))
        .withColumn("bb", F.explode(F.sequence(F.when(F.col("fa") == F.col("fb"), F.col("ba")).otherwise(F.lit(0).cast("bigint")), n_blocks("nb") - 1)))
        .join(left, ["fa", "ba"]).join(right, ["fb", "bb"])
    )
    # Their number is given, so that small partitions, of which each row makes a million, are not put together.
    met = met.repartition(min(20_000, -(-n // 4)), "fa", "ba", "fb", "bb")
    out = lambda which: (
        met.filter(which).select("*", F.explode("xs").alias("x")).select("*", F.explode("ys").alias("y"))
        .filter("x < y or x > y and (fa <> fb or ba <> bb)").select("g", *ends("x", "y"))
    )
    return out("not sa and not sb").unionByName(few.unionByName(out("sa or sb")).distinct())
