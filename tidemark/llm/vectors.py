"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors of a label are dealt to overlapping cluster shards of bounded size; each shard builds a graph by robust pruning,
and the lists of a vector from all its shards are united into one flat graph. A vector and its list live in one home
shard, that of its nearest centre. A search is a round of visits: a query visits the home shards of its clusters, goes
greedily from the shard's medoid along lists, then expands through all that lies near the range until nothing more does.
Edges that lead out of the shard from vectors near the range make the next round's visits (query, shard, sources), a
join on the shard, until no query has a shard left to visit. Edges go both ways, so the shard that is visited knows itself
which of its members they lead to: a visit names the shards it comes from, and begins at all members that have edges to
them. So a search follows the united lists wherever they lead, and rows are made for visits, never for pairs of vectors.

Every link is verified by cosine in double precision, at the home of the vector that is found, hence once. A bounded
sample of queries is compared with all vectors of its labels after each attempt to audit recall; short of the target,
the shards are cut again with more overlap, and an error is raised if that is not enough.

Vectors that agree in label and all components are one node. A shard that clustering can't split (its members lie too
close) is dealt to blocks, all of which each of its queries visits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, stage, unstage

#: Members of a shard, and rows dealt to one task while shards are cut and visited.
SHARD, DEAL = 2048, 20_000
#: Queries of a shard that search at once, and places of their tables of shards to visit.
TOGETHER, PLACES = 1024, 1 << 22
#: Pairs whose vectors are gathered at once, and edges that are followed one by one at once.
PAIRS, EDGES = 20_000, 1 << 18
FOUND = "node long, at long, links long, peer long, to array<long>, via array<long>"
DEGREE, CANDIDATES, BEAM, SLACK = 16, 40, 20, 0.2
#: Rounds of visits; queries are seldom under way after the third.
MOST_ROUNDS = 20


def _matrix(rows) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square over- or underflows."""
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build(x: np.ndarray, rng: np.random.Generator, alpha: float = 1.2) -> list[np.ndarray]:
    """Neighbours of each row by robust pruning of its nearest and some random rows; links go both ways."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    s = (x @ x.T).astype(np.float32)
    np.fill_diagonal(s, -np.inf)
    k = min(CANDIDATES, n - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(-s, axis=1)[:, :k]
    cand = np.concatenate([near, rng.integers(0, n, (n, 8))], axis=1)
    own = cand == np.arange(n)[:, None]
    far = np.where(own, np.inf, 2 - 2 * np.take_along_axis(s, cand, 1))
    order = np.argsort(far, axis=1, kind="stable")
    cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
    alive = np.isfinite(far)
    pairs = []
    for _ in range(DEGREE):
        who = np.flatnonzero(alive.any(1))
        if not len(who):
            break
        first = alive[who].argmax(1)
        pick = cand[who, first]
        pairs.append(np.stack([who, pick]))
        between = 2 - 2 * s[pick[:, None], cand[who]]
        alive[who] &= (alpha**2 * between > far[who]) & (cand[who] != pick[:, None])
    p = np.concatenate(pairs, axis=1)
    p = np.unique(np.concatenate([p, p[::-1]], axis=1), axis=1)
    # no list is cut, however many rows chose one: a row that all its neighbours dropped could not be found
    return np.split(p[1], np.searchsorted(p[0], np.arange(1, n)))


def _along(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in `at`, edge) of all edges of the rows `at`; row i has the edges first[i] to first[i + 1]."""
    size = first[at + 1] - first[at]
    return np.repeat(np.arange(len(at)), size), np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _slices(size: np.ndarray, most: int) -> list[np.ndarray]:
    """Indices cut where their sizes add up to another `most`."""
    return np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1)


def search(x: np.ndarray, first: np.ndarray, nears: np.ndarray, y: np.ndarray, start: np.ndarray, near: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, cosine) of all members that searches come upon with cosine at `near` or more.

    x: members, with lists nears[first[i] : first[i + 1]], y: queries, start: whether a query (row) begins at a member
    (column). Where all lies near everything, each query finds all members, by all of their edges: memory is that of a few
    values a query and member, not of the edges or of gathered vectors.
    """
    n, m = len(y), len(x)
    seen = np.zeros((n, m), bool)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def measure(qq: np.ndarray, vv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unseen pairs, once each, with their cosines; those near the range are kept."""
        seen[qq, vv] = True
        s = np.empty(len(qq))
        for k in range(0, len(qq), PAIRS):
            s[k : k + PAIRS] = np.einsum("ij,ij->i", y[qq[k : k + PAIRS]], x[vv[k : k + PAIRS]])
        ok = s >= near
        found.append((qq[ok], vv[ok], s[ok]))
        return qq, vv, s

    def look(qq: np.ndarray, vv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for any pairs."""
        new = ~seen[qq, vv]
        pair = np.unique(qq[new] * m + vv[new])
        return measure(pair // m, pair % m)

    ids, val, done = np.full((n, beam), -1), np.full((n, beam), -np.inf), np.zeros((n, beam), bool)

    def merge(qq: np.ndarray, vv: np.ndarray, s: np.ndarray) -> None:
        """Put members into the beams of their queries."""
        nonlocal ids, val, done
        order = np.lexsort((-s, qq))
        qq, vv, s = qq[order], vv[order], s[order]
        rank = np.arange(len(qq)) - np.searchsorted(qq, qq, "left")
        take = rank < beam
        more_v, more_s = np.full((n, beam), -1), np.full((n, beam), -np.inf)
        more_v[qq[take], rank[take]], more_s[qq[take], rank[take]] = vv[take], s[take]
        all_v, all_s, all_d = np.concatenate([ids, more_v], 1), np.concatenate([val, more_s], 1), np.concatenate([done, np.zeros_like(done)], 1)
        top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        ids, val, done = (np.take_along_axis(a, top, 1) for a in (all_v, all_s, all_d))

    qq, vv = np.nonzero(start)
    for k in range(0, len(qq), EDGES):
        merge(*measure(qq[k : k + EDGES], vv[k : k + EDGES]))
    degree = np.diff(first)
    while True:
        open_ = np.where(done | (ids < 0), -np.inf, val)
        q = np.flatnonzero(np.isfinite(open_).any(1))
        if not len(q):
            break
        best = open_[q].argmax(1)
        done[q, best] = True
        at = ids[q, best]
        for some in _slices(degree[at], EDGES):
            of, edge = _along(first, at[some])
            merge(*look(q[some][of], nears[edge]))
    news = 0
    while news < len(found):
        qq, vv = (np.concatenate([f[c] for f in found[news:]]) for c in (0, 1))
        news = len(found)
        if degree[vv].sum() <= EDGES:
            of, edge = _along(first, vv)
            look(qq[of], nears[edge])
        else:  # member by member, each for all the queries that have come upon it
            reached = np.zeros((m, n), bool)
            order = np.argsort(vv, kind="stable")
            cut = np.searchsorted(vv[order], np.arange(m + 1))
            for v in np.flatnonzero(np.diff(cut)):
                who = np.zeros(n, bool)
                who[qq[order[cut[v] : cut[v + 1]]]] = True
                reached[nears[first[v] : first[v + 1]]] |= who
            measure(*np.nonzero(reached.T & ~seen))
        if not len(found[-1][0]):
            break
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _cut(rows: pd.DataFrame, centres: pd.DataFrame, overlap: int) -> pd.DataFrame:
    """Members with their nearest clusters: the nearest is the home of those at home so far, others get no more than one."""
    x, c = _matrix(rows["vec"]), _matrix(centres["vec"])
    top = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap]
    rank = np.broadcast_to(np.arange(top.shape[1]), top.shape)
    home = rows["home"].to_numpy()
    i, k = np.nonzero(home[:, None] | (rank == 0))
    vec = rows["vec"].to_numpy()
    return pd.DataFrame({"shard": centres["child"].to_numpy()[top[i, k]], "node": rows["node"].to_numpy()[i], "copies": rows["copies"].to_numpy()[i], "home": home[i] & (k == 0), "vec": [vec[j] for j in i]})


def _centres(pdf: pd.DataFrame) -> pd.DataFrame:
    """k-means over the sample of one shard (a few rounds)."""
    pdf = pdf.sort_values("node")
    x, k = _matrix(pdf["vec"]), int(pdf["k"].iloc[0])
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(6):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    shard = int(pdf["shard"].iloc[0])
    child = [int.from_bytes(np.random.default_rng([abs(shard), int(shard < 0), j]).bytes(7), "little") for j in range(len(c))]
    return pd.DataFrame({"shard": shard, "child": child, "vec": list(c)})


def _shards(nodes: DataFrame, overlap: int, levels: int = 3) -> tuple[DataFrame, DataFrame]:
    """Seats (shard, node, copies, home, vec) of at most SHARD members a shard, and the visits (shard, node) to begin with.

    A node has a seat in up to `overlap` shards and is at home in one.
    """
    done, todo, shape = [], nodes.withColumn("home", F.lit(True)), "shard long, node long, copies long, home boolean, vec array<double>"
    columns = ["shard", "node", "copies", "home", "vec"]
    for level in range(levels + 1):
        size = todo.groupBy("shard").agg(F.count("*").alias("m"))
        x = stage(todo.select(*columns).join(size, "shard"), "sized")
        done.append(x.where(F.col("m") <= SHARD).select(*columns))
        x = x.where(F.col("m") > SHARD)
        if level == levels or x.isEmpty():
            break
        k = F.least(F.ceil(overlap * F.col("m") * 4 / (3 * SHARD)), F.lit(256))
        some = x.withColumn("k", k).where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < F.col("k") * 12 / F.col("m") * (1 << 20))
        centres = stage(some.select("shard", "node", "vec", "k").groupBy("shard").applyInPandas(_centres, "shard long, child long, vec array<double>"), "centres")
        parts = F.ceil(F.col("m") / DEAL)
        dealt = x.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), parts))
        spread = centres.join(x.select("shard", parts.alias("p")).distinct(), "shard").withColumn("salt", F.explode(F.expr("sequence(0L, p - 1L)")))
        todo = dealt.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(lambda a, b: _cut(a, b, overlap), shape)
    tight = x.withColumn("n", F.ceil(F.col("m") / (SHARD // 2)))
    block = lambda i: F.xxhash64("shard", i)
    done.append(tight.withColumn("shard", block(F.pmod(F.xxhash64("node", F.lit(2)), "n"))).select(*columns))
    visits = [d.select("shard", "node") for d in done[:-1]]
    visits.append(tight.withColumn("j", F.explode(F.expr("sequence(0L, n - 1L)"))).select(block(F.col("j")).alias("shard"), "node"))
    return _union(done), _union(visits)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _build(threshold: float):
    """Lists of a shard's seats, with the neighbours' homes and the cosines of the edges. Those at home in the shard are
    linked among themselves once more, so that a visit needs no way round others.

    An edge out of a home is of use only where a search can follow it (see `_visit`): twice the angle of SLACK / 2 apart
    at most. Others are left out.
    """
    most = 2 * np.arccos(min(1.0, threshold - SLACK / 2))
    far = np.cos(most) if most < np.pi else -1.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node, at, x = pdf["node"].to_numpy(), pdf["at"].to_numpy(), _matrix(pdf["vec"])
        rng = np.random.default_rng(len(pdf))
        lists = build(x, rng)
        home = np.flatnonzero(pdf["home"].to_numpy())
        if 1 < len(home) < len(node):
            for i, j in zip(home, build(x[home], rng), strict=True):
                lists[i] = np.union1d(lists[i], home[j])
        near, homes, cosines = [], [], []
        for i, j in enumerate(lists):
            s = x[j] @ x[i]
            j, s = (v[(at[j] == at[i]) | (s >= far)] for v in (j, s))
            near.append(node[j])
            homes.append(at[j])
            cosines.append(s)
        return pd.DataFrame({"node": node, "near": near, "homes": homes, "cosines": pd.Series(cosines, dtype=object)})

    return run


def _ragged(lists) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element of a column of arrays."""
    size = np.fromiter((0 if v is None else len(v) for v in lists), np.int64, len(lists))
    values = np.concatenate([np.asarray(v) for v in lists if v is not None and len(v)]) if size.sum() else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(lists)), size), values


def _visit(threshold: float):
    widest = np.arccos(min(1.0, threshold - SLACK / 2)) + 1e-9

    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(queries):
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in ("node", "at", "links", "peer", "to", "via")})
        members, queries = members.sort_values("node"), queries.sort_values("node")
        shard = int(members["shard"].iloc[0])
        node, copies, x, y = members["node"].to_numpy(), members["copies"].to_numpy(), _matrix(members["vec"]), _matrix(queries["vec"])
        row, near = _ragged(members["near"])
        homes, cosines = (_ragged(members[c])[1] for c in ("homes", "cosines"))
        at = np.minimum(np.searchsorted(node, near), len(node) - 1)
        here = (homes == shard) & (node[at] == near)
        first, nears = np.searchsorted(row[here], np.arange(len(node) + 1)), at[here]
        # of the edges from a member to another shard the shortest counts: if one may lead near a query, it does
        away = np.flatnonzero(homes != shard)
        others, to_other = np.unique(homes[away], return_inverse=True)
        angle = np.arccos(np.clip(cosines[away], -1, 1))
        order = np.lexsort((near[away], angle, to_other, row[away]))
        away, to_other, angle = away[order], to_other[order], angle[order]
        once = np.flatnonzero(np.diff(row[away] * len(others) + to_other, prepend=-1))
        out_row, out_node, out_other, out_angle = row[away][once], near[away][once], to_other[once], angle[once]
        medoid = int((x @ x.mean(0)).argmax())
        who = queries["node"].to_numpy()
        sources, been = (queries[c] if c in queries else pd.Series([None] * len(queries)) for c in ("sources", "been"))
        root, rows = np.arange(len(node)), []
        together = max(1, min(TOGETHER, PLACES // max(1, len(others))))
        for k in range(0, len(who), together):
            some = queries.iloc[k : k + together]
            start = np.zeros((len(some), len(node)), bool)
            start[:, medoid] = True
            r, entry = _ragged(some["entries"])
            e = np.minimum(np.searchsorted(node, entry), len(node) - 1)
            there = node[e] == entry
            start[r[there], e[there]] = True
            r, source = _ragged(sources.iloc[k : k + together])
            for o in np.flatnonzero(np.isin(others, source)):
                start[np.ix_(r[source == others[o]], out_row[out_other == o])] = True
            q, v, s = search(x, first, nears, y[k : k + together], start, threshold - SLACK)
            linked = (s >= threshold) & (who[k + q] != node[v])
            lq, lv = q[linked], v[linked]
            links = np.bincount(lq, copies[lv], len(some)).astype(np.int64)
            peer = np.full(len(some), len(node))
            np.minimum.at(peer, lq, lv)
            while len(lq):  # members linked with one query are of one component
                low = np.full(len(some), len(node))
                np.minimum.at(low, lq, root[lv])
                new = root.copy()
                np.minimum.at(new, root[lv], low[lq])
                np.minimum.at(new, lv, low[lq])
                new = new[new]
                if (new == root).all():
                    break
                root = new
            # shards that edges lead to from what lies near the range, unless the angles say that their ends can't lie near it
            close = s >= threshold - SLACK / 2
            q, v, angle = q[close], v[close], np.arccos(np.clip(s[close], -1, 1))
            none = np.iinfo(np.int64).max
            ways = np.full(len(some) * len(others), none)
            new = np.ones((len(some), len(others)), bool)
            r, shards = _ragged(been.iloc[k : k + together])
            for o in np.flatnonzero(np.isin(others, shards)):
                new[r[shards == others[o]], o] = False
            use = np.flatnonzero(new.any(0)[out_other])
            first_use = np.searchsorted(out_row[use], np.arange(len(node) + 1))
            for part in _slices(first_use[v + 1] - first_use[v], EDGES):
                of, edge = _along(first_use, v[part])
                edge = use[edge]
                near_enough = out_angle[edge] <= angle[part][of] + widest
                of, edge = of[near_enough], edge[near_enough]
                np.minimum.at(ways, q[part][of] * len(others) + out_other[edge], out_node[edge])
            place = np.flatnonzero((ways < none) & new.ravel())
            cut = np.searchsorted(place, np.arange(1, len(some)) * len(others))
            to, via = np.split(others[place % max(1, len(others))], cut), np.split(ways[place], cut)
            rows.append(pd.DataFrame({"node": who[k : k + together], "at": shard, "links": links, "peer": np.where(peer < len(node), node[np.minimum(peer, len(node) - 1)], who[k : k + together]), "to": pd.Series(to, dtype=object), "via": pd.Series(via, dtype=object)}))
        joined = np.flatnonzero(root != np.arange(len(node)))
        rows.append(pd.DataFrame({"node": node[joined], "at": pd.Series([None] * len(joined), dtype="Int64"), "links": 0, "peer": node[root[joined]], "to": pd.Series([np.zeros(0, np.int64)] * len(joined), dtype=object), "via": pd.Series([np.zeros(0, np.int64)] * len(joined), dtype=object)}))
        return pd.concat([r.astype({"at": "Int64"}) for r in rows if len(r)])

    return run


def _search(members: DataFrame, vectors: DataFrame, visits: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links (node, links) and edges (node, peer) of components, from rounds of visits until none is left to make."""
    visits = visits.withColumns({c: F.array().cast("array<long>") for c in ("entries", "sources")})
    made, found = [], []
    for _ in range(MOST_ROUNDS):
        visits = stage(visits, "visits")
        if visits.isEmpty():
            break
        size = visits.groupBy("shard").agg(F.ceil(F.count("*") / DEAL).alias("parts"))
        asked = visits.join(size, "shard").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(4)), "parts")).drop("parts").join(vectors, "node")
        if made:  # only new shards are gone on to, of the first round's ones once more
            sent = _union([*made, visits.select("shard", "node")]).groupBy("node").agg(F.collect_set("shard").alias("been"))
            asked = asked.join(sent, "node")
        spread = members.join(size, "shard").withColumn("salt", F.explode(F.expr("sequence(0L, parts - 1L)"))).drop("parts")
        now = spread.groupBy("shard", "salt").cogroup(asked.groupBy("shard", "salt")).applyInPandas(_visit(threshold), FOUND)
        now = stage(now, "found")
        made.append(visits.select("shard", "node"))
        found.append(now)
        ways = now.select("node", "at", F.explode(F.arrays_zip("to", "via")).alias("w")).groupBy(F.col("w.to").alias("shard"), "node").agg(F.collect_set("w.via").alias("entries"), F.collect_set("at").alias("sources"))
        # a shard of the first round is searched once more from where lists lead into it; after that, only new ones
        visits = ways
        if len(made) > 1:
            visits = ways.join(_union(made).distinct(), ["shard", "node"], "left_anti")
    else:
        raise RuntimeError("searches did not come to an end")
    if not found:
        none = vectors.limit(0)
        return stage(none.select("node", F.lit(0).cast("long").alias("links")), "links"), stage(none.select("node", F.col("node").alias("peer")), "edges")
    every = _union([f.select("node", "at", "links", F.lit(r).alias("round")) for r, f in enumerate(found)]).where("at is not null")
    last = every.groupBy("node", "at").agg(F.max_by("links", "round").alias("links"))
    links = stage(last.groupBy("node").agg(F.sum("links").alias("links")).where("links > 0"), "links")
    edges = stage(_union([f.select("node", "peer") for f in found]).where("node <> peer"), "edges")
    for x in found:
        unstage(x)
    return links, edges


def _audit(rows: DataFrame, links: DataFrame, threshold: float, queries: int) -> tuple[float | None, int]:
    """(share of true links of a bounded sample of nodes that were found, true links met), by comparing the sample with all
    vectors. Half of it is drawn from all nodes, half from those that were found to have links, as links may be rare. The
    share is None if no link was met."""
    order, few = F.xxhash64("node", F.lit(5)), max(1, queries // 2)
    all_of = rows.select("shard", "node", "vec")
    linked = all_of.join(links.select("node").distinct(), "node", "left_semi").select("shard", "node", "vec")
    sample = pd.concat([x.orderBy(order).limit(few).toPandas() for x in (all_of, linked)]).drop_duplicates("node")
    if not len(sample):
        return None, 0
    asked = {label: (part["node"].to_numpy(), _matrix(part["vec"])) for label, part in sample.groupby("shard")}
    b = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for pdf in batches:
            for label, part in pdf.groupby("shard"):
                if label in b.value:
                    ids, x = b.value[label]
                    near = (x @ _matrix(part["vec"]).T >= threshold) & (ids[:, None] != part["node"].to_numpy()[None, :])
                    yield pd.DataFrame({"node": ids, "n": near @ part["copies"].to_numpy()})

    true = rows.select("shard", "node", "copies", "vec").mapInPandas(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    both = true.join(links.groupBy("node").agg(F.sum("links").alias("found")), "node", "left").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("found", F.lit(0)))).alias("found")).first()
    return (both["found"] / both["n"], both["n"]) if both["n"] else (None, 0)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.99, queries: int = 256, overlap: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall, audited_links) of each row of vectors(vec_id, embedding, label).

    Only vectors with one label, not null, are compared. A vector that is null or zero or holds null or non-finite
    components has no links and is its own component. Identical vectors are linked with each other. Repeated rows count
    as vectors of their own; rows with one vec_id share a component id if linked. Extra columns are not read; an empty
    table gives no rows. `kept` marks the smallest vec_id of each component. `audited_recall` is the share of true links
    of a sample of `queries` vectors that was found, null if the sample has none; `audited_links` is their number. Below
    `recall` the shards are cut anew with twice the overlap, and after the third such attempt an error is raised.
    Identical vectors are told by a hash, whose collision is an error.
    """
    size = F.size("embedding")
    real = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)")
    v = vectors.select("vec_id", "embedding", "label")
    good = F.coalesce(real & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    vec = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    base = v.where(good).select("vec_id", vec.alias("vec"), F.xxhash64("label", size).alias("shard"))
    base = stage(base.withColumn("key", F.xxhash64("shard", "vec", F.hash("vec"))), "vectors")
    nodes = stage(base.groupBy("shard", "key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.when(F.min("vec") == F.max("vec"), F.min("vec")).otherwise(F.raise_error(F.lit("two vectors have one hash"))).alias("vec")).withColumn("node", F.xxhash64("shard", "key")).drop("key"), "nodes")
    for attempt in range(3):
        seats, visits = _shards(nodes.select("shard", "node", "copies", "vec"), overlap)
        seats = stage(seats, "seats")
        homes = seats.where("home").select("node", F.col("shard").alias("at"))
        built = seats.join(homes, "node").groupBy("shard").applyInPandas(_build(threshold), "node long, near array<long>, homes array<long>, cosines array<double>")
        # one edge for each neighbour, whichever shards found it
        united = F.flatten(F.collect_list(F.arrays_zip("near", "homes", F.transform("cosines", lambda c: F.round(c, 12)).alias("cosines"))))
        lists = built.groupBy("node").agg(F.array_distinct(united).alias("e")).select("node", *[F.col(f"e.{c}").alias(c) for c in ("near", "homes", "cosines")])
        members = stage(seats.where("home").select("shard", "node", "copies", "vec").join(lists, "node"), "members")
        links, edges = _search(members, nodes.select("node", "vec"), visits, threshold)
        share, met = _audit(nodes, links, threshold, queries)
        if share is None or share >= recall:
            break
        if attempt == 2:
            raise RuntimeError(f"audited recall {share:.4f} is below {recall} also with {overlap} shards a vector")
        for x in (seats, members, links, edges):
            unstage(x)
        overlap *= 2
    whole = components(edges, "node", "peer")
    near = nodes.select("node", "low", "copies").join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = near.groupBy("component").agg(F.min("low").alias("component_id"))
    near = near.join(lows, "component").join(links, "node", "left")
    near = near.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    named = base.select("vec_id", F.xxhash64("shard", "key").alias("node")).join(near, "node").select("vec_id", "n_links", "component_id")
    rest = v.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    named = named.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumns({"audited_recall": F.lit(share).cast("double"), "audited_links": F.lit(met).cast("long")})
    out = stage(named, "named")
    for x in (base, nodes, seats, members, links, edges):
        unstage(x)
    return out
