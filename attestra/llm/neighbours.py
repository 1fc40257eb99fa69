"""The most similar vectors of every vector.

A forest of random-projection trees is fitted on a bounded sample of the rows and sent to the tasks; every row is
indexed in one leaf of each tree. Each row looks into its own leaf of every tree and into the next best leaves of
one priority queue over all trees. Rows travel to leaves as compressed blocks; a leaf compares its queries
with its items by one matrix product, and the best candidates are ranked again by their exact cosine. What
the leaves found for a vector is merged, so a pair is found if either side finds it.

Equal vectors and equal directions are kept once in a block and in a leaf, with the few identifiers that can be among the
k most similar, so copies of one vector, however many, cost a leaf one row of its matrix.

Each level of a tree parts some close pairs, so the deeper the trees are the more of them the leaves miss. Where a forest has more than
one leaf the lists are therefore completed: vectors that are linked by their lists, over a few steps, form a group, and each group is
compared with itself. So a pair parted by every tree is found through the neighbours that both sides share.

The sample grows with the number of leaves up to a bound. A leaf that still has many more rows than planned is not compared
with itself as a whole: its task fits a forest of its own on a bounded sample of the leaf and searches that in the same way.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release
from .forest import Forest

#: Parameters of the index: rows of the fitting sample for each model, rows a leaf holds at most on average, trees,
#: further leaves a query looks into, most keys whose superseded rows are told to the tasks by broadcast.
SAMPLE_ROWS, LEAF_ROWS, TREES, PROBES, BROADCAST_KEYS = 16384, 4096, 2, 1, 1 << 20
#: Rows of the sample for each leaf, most rows of a sample, and the multiple of ``leaf_rows`` from which a leaf is split again.
SAMPLE_PER_LEAF, MOST_SAMPLE_ROWS, SPLIT_FROM = 16, 1 << 18, 4
#: Rows of a leaf where neighbours of any similarity are wanted: far ones are parted by a tree more often than close ones.
FAR_LEAF_ROWS = 8192
#: Completion: least cosine of a link, rounds in which the label of a group is passed on, vectors of a group from which it is cut into
#: parts, vectors compared in one call on average.
LINK_SIMILARITY, LINK_ROUNDS, GROUP_ROWS, CALL_ROWS = 0.7, 3, 16384, 4096


def current_vectors(df: DataFrame, key: str, model: str, vector: str, time: str) -> DataFrame:
    """model, key, h and n: of each (model, key) the hash of the vector with the latest time (null is earliest; at equal
    times the greatest hash counts) and the number of its rows. Reads no vector into a shuffle."""
    rows = df.filter(F.col(model).isNotNull() & F.col(key).isNotNull())
    best = rows.groupBy(model, key).agg(F.max(F.struct(F.col(time), F.xxhash64(vector).alias("h"))).alias("best"), F.count(F.lit(1)).alias("n"))
    return best.select(F.col(model).alias("model"), F.col(key).alias("key"), F.col("best.h").alias("h"), "n")


def _matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, vectors as rows) of the usable entries: ``dimension`` finite numbers, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dimension)
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    x = values.astype(np.float32, copy=False).reshape(-1, dimension)
    good = np.isfinite(x).all(1) & x.any(1)
    return at[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _sampled(dimension: int):
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _matrix(batch["vector"], dimension)
            rows = [row.tobytes() for row in _unit(x).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch["model"].take(pa.array(at)), pa.array(rows, pa.binary())], ["model", "row"])

    return take


def fit_forests(rows: DataFrame, counts: dict[str, int], dimension: int, sample_rows: int, leaf_rows: int, trees: int) -> dict[str, Forest]:
    """A forest for each model, fitted on about ``sample_rows`` of its rows or, with many leaves, SAMPLE_PER_LEAF for each, at
    most MOST_SAMPLE_ROWS over all models; chosen by a hash of their key."""
    wanted = {m: max(sample_rows, min(SAMPLE_PER_LEAF * (n // leaf_rows), MOST_SAMPLE_ROWS // len(counts))) for m, n in counts.items()}
    shares = F.create_map(*[F.lit(x) for m, n in counts.items() for x in (m, min(1.0, wanted[m] / max(1, n)))])
    draw = F.pmod(F.xxhash64("key", "model", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(draw < F.element_at(shares, F.col("model"))).select("model", "vector")
    drawn = sample.mapInArrow(_sampled(dimension), "model string, row binary").toArrow()
    out = {}
    names = np.array(drawn["model"].to_pylist(), dtype=object)
    data = drawn["row"].to_pylist()
    for name, n in sorted(counts.items()):
        x = [np.frombuffer(data[i], np.float16) for i in np.flatnonzero(names == name)]
        x = np.array(x, np.float32).reshape(-1, dimension)
        x = x[np.lexsort(x.T[:8])] if len(x) else x  # the fit doesn't depend on the order of arrival
        out[name] = Forest(x, -(-n // leaf_rows), trees)
    return out


def _pack(x: np.ndarray, directions: np.ndarray, of: np.ndarray, h: np.ndarray, item: np.ndarray, keys: list[str]) -> bytes:
    import zstandard

    half = x.astype(np.float16)
    exact = bool((half.astype(np.float32) == x).all())
    raw = np.ascontiguousarray(half if exact else x).view(np.uint8).reshape(len(x), x.shape[1], -1)
    planes = np.ascontiguousarray(raw.transpose(2, 0, 1)).tobytes()
    names = "\0".join(keys).encode()
    head = struct.pack("<?IIII", exact, len(x), x.shape[1], len(of), len(names))
    body = b"".join([head, planes, directions.tobytes(), of.astype("<u4").tobytes(), h.astype("<i8").tobytes(), item.astype(np.uint8).tobytes(), names])
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    exact, n, width, rows, length = struct.unpack_from("<?IIII", data)
    at = struct.calcsize("<?IIII")

    def read(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    size = 2 if exact else 4
    planes = read("u1", n * width * size).reshape(size, n, width)
    x = np.ascontiguousarray(planes.transpose(1, 2, 0)).view(np.float16 if exact else np.float32).reshape(n, width)
    directions, of, h, item = read("<i8", n), read("<u4", rows), read("<i8", rows), read("u1", rows)
    return x, directions, of, h, item, data[at : at + length].decode().split("\0")


def _keep_few(of: np.ndarray, h: np.ndarray, item: np.ndarray, keys: np.ndarray, least: int) -> np.ndarray:
    """Positions of the rows that matter among those of equal directions: the ``least`` smallest items of each
    direction, and one row of each vector."""
    order = np.lexsort((keys, ~item.astype(bool), of))
    start = np.r_[True, of[order][1:] != of[order][:-1]]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    keep = np.zeros(len(order), bool)
    keep[order] = (place < least) & item.astype(bool)[order]
    _, first = np.unique(h, return_index=True)
    keep[first] = True
    return np.flatnonzero(keep)


def _route(forests: dict[str, Forest], probes: int, dimension: int, least: int, stale_keys: np.ndarray, stale_h: np.ndarray):
    numbers = {name: i for i, name in enumerate(sorted(forests))}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _matrix(batch["vector"], dimension)
            id64, h = batch["id64"].to_numpy(zero_copy_only=False)[at], batch["h"].to_numpy(zero_copy_only=False)[at]
            if len(stale_keys) and len(at):
                place = np.minimum(np.searchsorted(stale_keys, id64), len(stale_keys) - 1)
                current = (stale_keys[place] != id64) | (stale_h[place] == h)
                at, x, h = at[current], x[current], h[current]
            keys = np.array(batch["key"].take(pa.array(at)).to_pylist(), dtype=object)
            models = np.array(batch["model"].take(pa.array(at)).to_pylist(), dtype=object)
            leaves_out, blocks_out = [], []
            for name in sorted(set(models.tolist())):
                forest = forests.get(name)
                if forest is None:
                    continue
                rows = np.flatnonzero(models == name)
                unit = _unit(x[rows])
                direction = np.array([xxhash.xxh3_64_intdigest(u.tobytes()) - (1 << 63) for u in unit], np.int64)
                leaves, trees = forest.search(unit.astype(np.float32), probes)
                flat = leaves.ravel()
                order = np.argsort(flat, kind="stable")
                order = order[flat[order] >= 0]
                cuts = np.flatnonzero(np.diff(flat[order])) + 1
                for part in np.split(order, cuts) if len(order) else []:
                    own, item = part // leaves.shape[1], part % leaves.shape[1] < trees
                    _, first, of = np.unique(direction[own], return_index=True, return_inverse=True)
                    few = _keep_few(of, h[rows[own]], item, keys[rows[own]], least)
                    if len(few) < len(of):
                        own, item = own[few], item[few]
                        _, first, of = np.unique(direction[own], return_index=True, return_inverse=True)
                    leaves_out.append((numbers[name] << 32) + int(flat[part[0]]))
                    blocks_out.append(_pack(x[rows[own[first]]], direction[own[first]], of, h[rows[own]], item, keys[rows[own]].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(leaves_out, pa.int64()), pa.array(blocks_out, pa.binary())], ["leaf", "block"])

    return route


_FOUND = pa.schema([("model", pa.string()), ("h", pa.int64()), ("near", pa.list_(pa.struct([("d", pa.float64()), ("key", pa.string())])))])


def _first(exact: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k greatest of each row within the mask ``near``, of equal ones the first."""
    width = exact.shape[1]
    if width <= k:
        return near
    exact = np.where(near, exact, -np.inf)
    last = np.partition(exact, width - k, axis=1)[:, width - k, None]
    above, tied = exact > last, near & (exact == last)
    return above | tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True))


def leaf_neighbours(x: np.ndarray, items: list[list[str]], k: int, least_similarity: float, rows: int = 1024) -> Iterator[list[tuple[float, str]]]:
    """For each row of the unit matrix ``x`` the k best of all items with at least that cosine, as (-cosine, key),
    best first; items[i]: the keys at direction i, ascending. The matrix product in single precision only leaves out what
    cannot be among the k best by the bound of its error; exact cosines decide. Columns ascend by their least key."""
    target = np.array(sorted((i for i, v in enumerate(items) if v), key=lambda i: items[i][0]), np.int64)
    single = x.astype(np.float32)
    goal = single[target].T.copy()
    width, slack = len(target), (x.shape[1] + 4) * 2.0**-23  # twice the bound: of the k-th best and of the candidate
    rows = max(1, min(rows, (1 << 22) // max(1, width)))
    for lo in range(0, len(x), rows):
        s = single[lo : lo + rows] @ goal
        near = s >= least_similarity - slack
        if width > k and (least_similarity <= -1 or np.count_nonzero(near) > 64 * len(s)):
            near &= s >= np.partition(s, width - k, axis=1)[:, width - k, None] - slack
        row, col = np.nonzero(near)
        if len(row) > (k + 64) * len(s):  # many nearly equal ones
            exact = np.round(x[lo : lo + rows] @ x[target].T, 12)
            row, col = np.nonzero(_first(exact, near & (exact >= least_similarity), k))
            exact = exact[row, col]
        else:
            exact = np.round(np.einsum("ij,ij->i", x[lo + row], x[target[col]]), 12)
        bounds = np.searchsorted(row, np.arange(len(s) + 1)).tolist()
        exact, col = exact.tolist(), target[col].tolist()
        for i in range(len(s)):
            near_keys = [(-exact[j], key) for j in range(bounds[i], bounds[i + 1]) if exact[j] >= least_similarity for key in items[col[j]]]
            near_keys.sort()
            yield near_keys[:k]


def split_neighbours(x: np.ndarray, items: list[list[str]], k: int, least_similarity: float, leaf_rows: int, trees: int, probes: int) -> list[list[tuple[float, str]]]:
    """What ``leaf_neighbours`` gives, for a leaf of many rows: by a forest over the leaf, so almost all of the k best."""
    single = x.astype(np.float32)
    sample = np.unique(np.linspace(0, len(x) - 1, min(len(x), SAMPLE_ROWS)).astype(np.int64))  # directions stand in the order of their hashes
    forest = Forest(single[sample], -(-len(x) // leaf_rows), trees)
    leaves, width = forest.search(single, probes)[0], trees + probes
    flat = leaves.ravel()
    order = np.argsort(flat, kind="stable")
    order = order[flat[order] >= 0]
    out: list[list[tuple[float, str]]] = [[] for _ in range(len(x))]
    for part in np.split(order, np.flatnonzero(np.diff(flat[order])) + 1):
        rows, item = part // width, part % width < trees
        found = leaf_neighbours(x[rows], [items[r] if own else [] for r, own in zip(rows.tolist(), item.tolist())], k, least_similarity)
        for r, near in zip(rows.tolist(), found):
            out[r] = sorted(set(out[r]).union(near))[:k] if out[r] else near
    return out


def _search_leaf(names: list[str], k: int, least_similarity: float, leaf_rows: int, trees: int, probes: int):
    def search(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_unpack(b.as_py()) for b in table["block"]]
        directions = np.concatenate([p[1] for p in parts])
        unique, first, where = np.unique(directions, return_index=True, return_inverse=True)
        x = _unit(np.concatenate([p[0].astype(np.float32) for p in parts])[first])
        offset = np.cumsum([0, *[len(p[1]) for p in parts]])
        items: list[set[str]] = [set() for _ in unique]
        queries: dict[int, int] = {}
        for start, (_, _, of, h, item, keys) in zip(offset, parts):
            own = where[start + of.astype(np.int64)].tolist()
            for d, vector, is_item, name in zip(own, h.tolist(), item.tolist(), keys):
                queries[vector] = d
                if is_item:
                    items[d].add(name)
        few = [sorted(v)[:k] for v in items]
        if len(x) > SPLIT_FROM * leaf_rows:
            near = split_neighbours(x, few, k, least_similarity, leaf_rows, trees, probes)
        else:
            near = list(leaf_neighbours(x, few, k, least_similarity))
        found = [(h, near[d]) for h, d in queries.items() if near[d]]
        model = names[key[0].as_py() >> 32]
        lists = [[{"d": d, "key": name} for d, name in v] for _, v in found]
        return pa.Table.from_arrays([pa.array([model] * len(found), pa.string()), pa.array([h for h, _ in found], pa.int64()), pa.array(lists, _FOUND.field("near").type)], schema=_FOUND)

    return search


def _links(merged: DataFrame) -> DataFrame:
    """vid, kid: hashes of each vector and of every close key in its list, where the list holds more than one."""
    close = merged.select("model", F.xxhash64("model", "h").alias("vid"), F.filter("near", lambda x: x["d"] <= -LINK_SIMILARITY).alias("near"))
    return close.filter(F.size("near") > 1).select("vid", F.explode(F.transform("near", lambda x: F.xxhash64(F.col("model"), x["key"]))).alias("kid"))


def linked_groups(links: DataFrame, rounds: int = LINK_ROUNDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """vid, group: vectors that reach the same least key within ``rounds`` steps over the links, in groups of two or more. What
    has more than ``group_rows`` vectors is dealt to parts by hash, so no group is larger than a task can hold."""
    labels = links.groupBy("vid").agg(F.min("kid").alias("label"))
    for _ in range(rounds):
        keys = links.join(labels, "vid").groupBy("kid").agg(F.min("label").alias("label"))
        labels = links.join(keys, "kid").groupBy("vid").agg(F.min("label").alias("label"))
    labels = materialize(labels)
    parts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("label", F.ceil(F.col("n") / group_rows).alias("parts"))
    return labels.join(parts, "label").select("vid", F.xxhash64("label", F.pmod(F.xxhash64("vid"), F.col("parts"))).alias("group"))


def _halved(dimension: int):
    """Usable vectors as bytes, in half precision where that is exact."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _matrix(batch["vector"], dimension)
            with np.errstate(over="ignore"):
                half = x.astype(np.float16)
            exact = (half.astype(np.float32) == x).all(1).tolist()
            data = [(half if e else x)[i].tobytes() for i, e in enumerate(exact)]
            rows = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch["id64"].take(rows), batch["h"].take(rows), pa.array(data, pa.binary())], ["id64", "h", "data"])

    return halve


def _search_groups(dimension: int, k: int, least_similarity: float, leaf_rows: int, trees: int, probes: int):
    def search(key: tuple, table: pa.Table) -> pa.Table:
        group, h = table["group"].to_numpy(), table["h"].to_numpy()
        order = np.lexsort((h, group))
        order = order[np.r_[True, (np.diff(group[order]) != 0) | (np.diff(h[order]) != 0)]]  # repeated rows once
        data, keys, models = table["data"], table["keys"], table["model"]
        out_model, out_h, out_near = [], [], []
        for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            raw = [data[int(i)].as_py() for i in rows]
            x = _unit(np.array([np.frombuffer(b, np.float16 if len(b) == 2 * dimension else np.float32) for b in raw], np.float32))
            items = [keys[int(i)].as_py() for i in rows]
            if len(x) > SPLIT_FROM * leaf_rows:
                near = split_neighbours(x, items, k, least_similarity, leaf_rows, trees, probes)
            else:
                near = list(leaf_neighbours(x, items, k, least_similarity))
            out_model += [models[int(rows[0])].as_py()] * len(rows)
            out_h += h[rows].tolist()
            out_near += [[{"d": d, "key": name} for d, name in v] for v in near]
        return pa.Table.from_arrays([pa.array(out_model, pa.string()), pa.array(out_h, pa.int64()), pa.array(out_near, _FOUND.field("near").type)], schema=_FOUND)

    return search


def most_similar(
    df: DataFrame, key: str, model: str, vector: str, time: str, k: int, dimension: int, least_similarity: float = -1.0,
    sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, trees: int = TREES, probes: int = PROBES, broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """model, key, place (1..k), other, similarity: for every usable vector its k most similar ones of the same model.

    Of several rows of one (model, key) the one with the latest ``time`` counts (null is earliest). A vector is usable if it
    has ``dimension`` finite entries that are not all zero; other vectors, null keys and null models take no part.
    Similarity is the cosine, at least ``least_similarity``; equal ones are decided by the smaller key. Fewer than k
    rows come out where there are no more such vectors. The search is approximate: forest and groups may miss a neighbour, but
    what they give is exact. Empty tables give an empty result; extra columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(model).cast("string").alias("model"), F.col(key).cast("string").alias("key"), F.col(vector).alias("vector"), F.col(time).alias("time"))
    rows = rows.filter(F.col("model").isNotNull() & F.col("key").isNotNull())
    current = materialize(current_vectors(rows, "key", "model", "vector", "time"))
    counts = {r["model"]: r["n"] for r in current.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    near_type = "model string, h bigint, near array<struct<d:double,key:string>>"
    out_type = "model string, key string, place int, other string, similarity double"
    if not counts:
        return spark.createDataFrame([], out_type)
    forests = fit_forests(rows, counts, dimension, sample_rows, leaf_rows, trees)

    id64 = F.xxhash64("model", "key")
    routed = rows.select("model", "key", "vector", id64.alias("id64"), F.xxhash64("vector").alias("h"))
    repeated = current.filter("n > 1")
    stale = repeated.select(id64.alias("id64"), "h").limit(broadcast_keys + 1).toArrow()
    if stale.num_rows <= broadcast_keys:
        order = np.argsort(stale["id64"].to_numpy())
        stale_keys, stale_h = stale["id64"].to_numpy()[order], stale["h"].to_numpy()[order]
    else:  # too many to tell every task: superseded rows are taken out by a join
        routed = routed.join(current.select("model", "key", F.col("h").alias("now")), ["model", "key"]).filter("h = now").drop("now")
        stale_keys = stale_h = np.zeros(0, np.int64)
    index = spark.sparkContext.broadcast((forests, stale_keys, stale_h))
    least = k + 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _route(index.value[0], probes, dimension, least, *index.value[1:])(batches)

    def searched() -> DataFrame:
        blocks = routed.mapInArrow(route, "leaf bigint, block binary")
        return blocks.groupBy("leaf").applyInArrow(_search_leaf(sorted(forests), least, least_similarity, leaf_rows, trees, probes), near_type)

    def joined(found: DataFrame) -> DataFrame:
        return found.groupBy("model", "h").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))

    if all(forest.n_leaves <= trees for forest in forests.values()):  # one leaf: nothing was parted
        merged = joined(searched())
    else:
        first = materialize(joined(searched()).withColumn("near", F.slice(F.array_distinct("near"), 1, least)))
        release(spark)  # the blocks of the leaves
        groups = linked_groups(materialize(_links(first)))
        named = current.withColumn("n", F.row_number().over(Window.partitionBy("model", "h").orderBy("key"))).filter(F.col("n") <= least)
        named = named.groupBy("model", "h").agg(F.sort_array(F.collect_list("key")).alias("keys")).withColumn("vid", F.xxhash64("model", "h"))
        members = named.join(groups, "vid").select(F.xxhash64("model", F.col("keys")[0]).alias("id64"), "h", "model", "keys", "group")
        packed = routed.select("id64", "h", "vector").mapInArrow(_halved(dimension), "id64 bigint, h bigint, data binary")
        calls = max(1, sum(counts.values()) // CALL_ROWS)
        rows_of = packed.join(members, ["id64", "h"]).withColumn("call", F.pmod(F.xxhash64("group"), F.lit(calls)))
        more = rows_of.groupBy("call").applyInArrow(_search_groups(dimension, least, least_similarity, leaf_rows, trees, probes), near_type)
        merged = joined(first.unionByName(more))
    lists = current.select("model", "key", "h").join(merged, ["model", "h"])
    names = F.transform("near", lambda x: x["key"])
    others = F.filter("near", lambda x, i: (x["key"] != F.col("key")) & (F.array_position(names, x["key"]) == i + 1))
    ranked = lists.select("model", "key", F.posexplode(F.slice(others, 1, k)).alias("place", "x"))
    return ranked.select("model", "key", (F.col("place") + 1).alias("place"), F.col("x.key").alias("other"), (-F.col("x.d")).alias("similarity"))


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """model, key_a < key_b: the pairs in which one is among the most similar of the other, once."""
    pairs = neighbours.select("model", F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b"))
    return pairs.distinct()
