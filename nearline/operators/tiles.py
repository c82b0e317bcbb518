"""Best partner of every row among the members of its groups, compared in tiles
(:func:`best_partners` within one table, :func:`best_matches` between two).

A group (an LSH bucket, say) may hold any number of rows.  Its members are
dealt into chunks of about ``chunk`` rows, and every two chunks meet in one
task, as a block of a distance matrix.  A tile returns the best partner of
each of its rows, never its pairs, and one combinable aggregate per row joins
the tiles.  Nothing is left out, whatever the size of a group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .skew import salted_join

#: Scores are compared to so many digits, so that equal pairs tie whatever the block.
DIGITS = 9


def tiled(members: DataFrame, group: str, id_col: str, chunk: int) -> DataFrame:
    """``members`` once for every tile ``(group, ti, tk)`` of its group; a
    group of one chunk has one tile."""
    size = members.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("__n"), F.count(F.lit(1)).alias("__c")).where("__c > 1")
    own = F.pmod(F.xxhash64(id_col), F.col("__n")).cast("int")
    return (members.join(size.drop("__c"), group).withColumn("__own", own)
            .withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
            .withColumn("__ti", F.least("__own", "__other")).withColumn("__tk", F.greatest("__own", "__other"))
            .drop("__other", "__n"))


def by_groups(rows: DataFrame, keys: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema, target: int = 20_000) -> DataFrame:
    """``run(table, starts)`` on whole groups of ``rows``, as many in one call as
    come to ``target`` rows, or one larger group: groups are small as a rule, and
    a call for each would cost more than what is done in it."""
    def split(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            new[1:] |= pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    def calls(batches):
        held, size, least = [], 0, target
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= least:
                t = pa.Table.from_batches(held)
                starts = split(t)
                if len(starts) > 1:                          # the last group may go on in the next batch
                    yield from run(t.slice(0, starts[-1]), starts[:-1]).to_batches()
                    t = t.slice(starts[-1])
                held, size = t.to_batches(), t.num_rows
                least = max(target, 2 * size)
        if size:
            t = pa.Table.from_batches(held)
            yield from run(t, split(t)).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(calls, schema)


def best_partners(members: DataFrame, group: str, id_col: str, value_col: str, costs: Callable[[np.ndarray, np.ndarray], np.ndarray],
                  chunk: int = 1000) -> DataFrame:
    """``(id, partner, cost)``: the other member with the least cost over all
    groups of each row, ties to the smaller id.  ``costs`` gives the matrix
    between two blocks of values (rows of equal length); ids are longs."""
    def run(t: pa.Table) -> pa.Table:
        ids = t.column(id_col).to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, own = ids[order], t.column("__own").to_numpy()[order]
        values = matrix(t, value_col).astype(np.float64)[order]
        cross = own.min() != own.max()
        left, right = own == own.min(), own == own.max()     # two chunks, or one against itself
        mine, theirs, block = ids[left], ids[right], values[right]
        partner, cost = [], []
        back, least = np.zeros(len(theirs), np.int64), np.full(len(theirs), np.inf)
        asked = values[left]
        for a in range(0, len(mine), 256):
            m = np.round(costs(asked[a:a + 256], block), DIGITS)
            if cross:                                        # every pair once, for both of its rows
                k = m.argmin(axis=0)
                c = m[k, np.arange(len(k))]
                better = (c < least) | np.isnan(c)           # on ties the earlier: the smaller id
                back[better], least[better] = mine[a:a + 256][k[better]], c[better]
            else:
                m[mine[a:a + 256, None] == theirs[None, :]] = np.inf
            k = m.argmin(axis=1)                             # the first least: the smaller id
            partner.append(theirs[k])
            cost.append(m[np.arange(len(k)), k])
        if cross:
            ids = np.concatenate([mine, theirs])
            partner.append(back)
            cost.append(least)
        partner, cost = np.concatenate(partner), np.concatenate(cost)
        ok = np.isfinite(cost)
        return pa.table({id_col: pa.array(ids[ok]), "partner": pa.array(partner[ok]), "cost": pa.array(cost[ok])})

    rows = tiled(members.select(group, id_col, value_col), group, id_col, chunk)
    found = rows.groupBy(group, "__ti", "__tk").applyInArrow(run, f"{id_col} long, partner long, cost double")
    best = found.groupBy(id_col).agg(F.min(F.struct("cost", "partner")).alias("b"))
    return best.select(id_col, F.col("b.partner").alias("partner"), F.col("b.cost").alias("cost"))


def matrix(t: pa.Table, col: str) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    lists = t.column(col).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def number_columns(*blocks: np.ndarray) -> list[np.ndarray]:
    """Blocks of rows as columns of small numbers, equal where values of one column are."""
    rows = np.concatenate(blocks)
    small = np.uint16 if len(rows) <= 1 << 16 else np.uint32
    numbers = np.stack([np.unique(c, return_inverse=True)[1].astype(small) for c in rows.T])
    return np.split(numbers, np.cumsum([len(b) for b in blocks])[:-1], axis=1)


def equal_columns(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places every two rows of two blocks (given as columns) are equal."""
    out = np.zeros((a.shape[1], b.shape[1]), np.uint8 if len(a) < 255 else np.uint16)
    same = np.empty(out.shape, bool)
    for x, y in zip(a, b):
        np.equal(x[:, None], y[None, :], out=same)
        out += same.view(np.uint8)
    return out


def any_equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two blocks (given as columns) are equal in a place."""
    out, same = np.zeros((a.shape[1], b.shape[1]), bool), np.empty((a.shape[1], b.shape[1]), bool)
    for x, y in zip(a, b):
        np.equal(x[:, None], y[None, :], out=same)
        out |= same
    return out


def best_of_lists(asks: DataFrame, have: DataFrame, costs: Callable[[np.ndarray, np.ndarray], np.ndarray], chunk: int = 4000) -> DataFrame:
    """``(id, partner, cost)``: for every id of ``asks(g, id, v)`` the other id with
    the least cost among ``have(g, id, v)`` of the same lists ``g``, ties to the
    smaller id.  Both sides of a list are dealt into chunks, and every two
    chunks meet in a task; a tile returns one row per asking row."""
    asks, have = cut_lineage(asks, "list_asks"), cut_lineage(have, "list_rows")
    chunks = lambda df, n: df.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(n))
    size = chunks(asks, "na").join(chunks(have, "nh"), "g")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # One row per list, and lists are few: Spark sees how few and broadcasts them.
    left = asks.join(size, "g").select("g", "id", "v", place("na").alias("ta"), every("nh").alias("th"))
    right = have.join(size, "g").select("g", "id", "v", every("na").alias("ta"), place("nh").alias("th"))

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, partner, cost = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if mine.num_rows and theirs.num_rows:
            theirs = theirs.sort_by("id")
            own, other = mine.column("id").to_numpy(), theirs.column("id").to_numpy()
            a, b = matrix(mine, "v"), matrix(theirs, "v")
            for k in range(0, len(a), 256):
                m = np.round(costs(a[k:k + 256], b), DIGITS)
                m[own[k:k + 256, None] == other[None, :]] = np.inf
                j = m.argmin(axis=1)
                c = m[np.arange(len(j)), j]
                ok = np.isfinite(c)
                ids.append(own[k:k + 256][ok])
                partner.append(other[j[ok]])
                cost.append(c[ok])
        return pa.table({"id": pa.array(np.concatenate(ids)), "partner": pa.array(np.concatenate(partner)), "cost": pa.array(np.concatenate(cost))})

    found = left.groupBy("g", "ta", "th").cogroup(right.groupBy("g", "ta", "th")).applyInArrow(run, "id long, partner long, cost double")
    best = found.groupBy("id").agg(F.min(F.struct("cost", "partner")).alias("b"))
    return best.select("id", F.col("b.partner").alias("partner"), F.col("b.cost").alias("cost"))


def best_matches(new: DataFrame, old: DataFrame, new_bands: DataFrame, old_bands: DataFrame, similarity: Callable[[np.ndarray, np.ndarray], np.ndarray],
                 chunk: int = 32_768, exclude_same: bool = False) -> DataFrame:
    """``(key, match_id, similarity)``: for every row of ``new`` the most similar
    row of ``old`` among all that share a band with it, ties to the smaller id;
    rows without one have no row.

    ``new(key, signature, bands)`` and ``old(key, id, signature, bands)`` have
    one row per key; the band tables ``(bk, key)`` one per band.  All members of
    a bucket join the group of the bucket's smallest old key.  The new and the
    old members of a group are dealt into chunks, and every new chunk meets
    every old one in a tile, where ``similarity`` compares one
    signature with a block of them (where its ``equal_places`` says that it is
    the share of equal places, these are counted for two blocks at once) and
    only rows with a common band count.  A tile returns one row per new member.
    Rows go to as many tiles as the other side has chunks, so these are long.
    ``exclude_same``: a row is no match for the row of its own key.
    """
    heads = old_bands.groupBy("bk").agg(F.min("key").alias("head"))
    wanted = salted_join(new_bands, heads, ["bk"], "inner", salt_by=["key"])
    # Only buckets that are asked for; their hot ones are spread.
    have = salted_join(old_bands, wanted.select("bk", "head").distinct(), ["bk"], "inner", salt_by=["key"])
    have = cut_lineage(have.select("head", "key").distinct(), "match_members")
    asks = wanted.select("head", "key").distinct()
    if exclude_same:                                         # a row that is all of its group meets nobody there
        alone = have.groupBy("head").agg(F.count(F.lit(1)).alias("c")).where("c = 1").select("head", F.col("head").alias("key"))
        asks = asks.join(alone, ["head", "key"], "left_anti")
    asks = cut_lineage(asks, "match_asks")
    size = (asks.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("na"))
            .join(have.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("nh")), "head"))
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A row takes its signature once a group, and is repeated for its tiles after that.
    # Heads as numbers: two that are equal by chance would only share their tiles.
    head = F.xxhash64("head").alias("head")
    left = salted_join(asks, size, ["head"], "inner", salt_by=["key"]).select(head, "key", place("na").alias("ta"), "nh")
    right = salted_join(have, size, ["head"], "inner", salt_by=["key"]).select(head, "key", "na", place("nh").alias("th"))
    left = left.join(new.select("key", "signature", "bands"), "key").select(
        "head", "ta", every("nh").alias("th"), F.lit(True).alias("asks"), "key", F.lit(None).cast("string").alias("id"), "signature", "bands")
    right = right.join(old.select("key", "id", "signature", "bands"), "key").select(
        "head", every("na").alias("ta"), "th", F.lit(False).alias("asks"), "key", "id", "signature", "bands")

    places = getattr(similarity, "equal_places", False)

    def match(t: pa.Table, found: list, best: list) -> None:
        """One tile: ``(key, match_id)`` and the similarity of each asking row."""
        asks_ = t.column("asks").to_numpy()
        mine, theirs = t.filter(pa.array(asks_)), t.filter(pa.array(~asks_))
        if not mine.num_rows or not theirs.num_rows:
            return
        theirs = theirs.sort_by("id")                        # the first best: the smaller id
        ids, sig, bands = theirs.column("id").to_pylist(), matrix(theirs, "signature"), matrix(theirs, "bands")
        own = np.array(theirs.column("key").to_pylist(), object)
        keys = mine.column("key").to_pylist()
        if places and len(keys) * len(own) >= 64:
            number = {k: i for i, k in enumerate(dict.fromkeys([*keys, *own.tolist()]))}
            asked, stored = np.array([number[k] for k in keys]), np.array([number[k] for k in own])
            asked_bands, stored_bands = number_columns(matrix(mine, "bands"), bands)
            asked_sig, stored_sig = number_columns(matrix(mine, "signature"), sig)
            for a in range(0, len(keys), 64):
                some = slice(a, min(a + 64, len(keys)))
                most, at = np.zeros(some.stop - a, np.int64), np.zeros(some.stop - a, np.int64)
                for b in range(0, len(own), 4096):           # blocks that stay in the cache
                    near = any_equal(asked_bands[:, some], stored_bands[:, b:b + 4096])
                    if exclude_same:
                        near &= asked[some, None] != stored[None, b:b + 4096]
                    m = equal_columns(asked_sig[:, some], stored_sig[:, b:b + 4096])
                    m += 1
                    m *= near
                    j = m.argmax(axis=1)
                    c = m[np.arange(len(j)), j]
                    more = c > most
                    most[more], at[more] = c[more], b + j[more]
                for i in np.flatnonzero(most).tolist():
                    found.append((keys[a + i], ids[at[i]]))
                    best.append(float(np.round((int(most[i]) - 1) / sig.shape[1], DIGITS)))
            return
        for key, s, b in zip(keys, matrix(mine, "signature"), matrix(mine, "bands")):
            ok = (bands == b[None, :]).any(axis=1)
            if exclude_same:
                ok &= own != key
            js = np.flatnonzero(ok)
            if len(js):
                m = np.round(similarity(s, sig[js]), DIGITS)
                k = int(m.argmax())
                found.append((key, ids[js[k]]))
                best.append(float(m[k]))

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        found, best = [], []
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]):
            match(t.slice(a, z - a), found, best)
        return pa.table({"key": pa.array([k for k, _ in found], pa.string()), "match_id": pa.array([i for _, i in found], pa.string()),
                         "similarity": pa.array(best, pa.float64())})

    tiles = by_groups(left.unionByName(right), ["head", "ta", "th"], run, "key string, match_id string, similarity double")
    best = tiles.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("c"), F.col("match_id").alias("i"))).alias("b"))
    return best.select("key", F.col("b.i").alias("match_id"), (-F.col("b.c")).alias("similarity"))
