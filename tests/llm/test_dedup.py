"""SimHash, suffix and difference-cover dedup, graph search: against brute force."""

import hashlib
import random

import numpy as np
import pytest
from llm_fixtures import AWKWARD, documents, passages, shared_folder  # noqa: F401

from shopcast.llm import components, cover, graph, simhash, suffix, tables

SF = "/root/testdata/sf0.001"


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("edges", [1 << 20, 40])
def test_components(spark, monkeypatch, edges):
    monkeypatch.setattr(components, "EDGES", edges)
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 460)]
    pairs += [(500, x) for x in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    real = [p for p in pairs if None not in p and p[0] != p[1]]
    want = roots(600, real)
    low = {}
    for x in sorted({x for p in real for x in p}):
        low.setdefault(want[x], x)
    assert got == {x: low[want[x]] for p in real for x in p}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def near_fingerprints(seed=2, n=300):
    rng = np.random.default_rng(seed)
    fps = rng.integers(0, 2 ** 64, n, dtype=np.uint64)
    out = [fps]
    for flips in (1, 2, 3, 4, 5, 6):
        masks = np.array([sum(1 << int(b) for b in rng.choice(64, flips, replace=False)) for _ in range(n)], np.uint64)
        out.append(fps ^ masks)
    return np.unique(np.concatenate(out))


def brute_components(fps):
    pairs = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4) if j > i]
    return roots(len(fps), pairs)


@pytest.mark.parametrize("cell", [None, 8])
def test_anchor_links_lose_nothing(spark, monkeypatch, cell):
    """Also with crowded anchors cut into cells (the limits come with the functions that workers get)."""
    fps = near_fingerprints()
    centre = fps[0]     # a crowd: many fingerprints within a few bits of one
    crowd = np.array([int(centre) ^ (1 << i) ^ (1 << j) for i in range(0, 40) for j in range(i)], np.uint64)
    fps = np.unique(np.concatenate((fps, crowd)))
    if cell:
        keys, values = simhash.anchored(fps)
        part = simhash._Part()
        monkeypatch.setattr(simhash, "CELL", cell)
        assert not list(part.add(keys, values))
        out = part.leave()
        anchor = keys & np.uint32(simhash.HOME - 1)
        u, n = np.unique(anchor, return_counts=True)
        assert sorted(np.unique(out[0] & np.uint32(simhash.HOME - 1)).tolist()) == sorted(u[n > cell].tolist())
        edges = part.edges()
        for a in u[n > cell]:        # the grid of cells of a crowded anchor
            rows = values[anchor == a]
            home = (keys[anchor == a] & np.uint32(simhash.HOME)) != 0
            for i in range(2):
                for j in range(3):
                    h, c = rows[home][i::2], rows[j::3]
                    edges.append(simhash.forest(h, np.unique(np.concatenate((h, c)))))
        pairs = [(a, b) for e in edges for a, b in zip(*e, strict=True)]
    else:
        df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
        pairs = [(np.int64(r.a).view(np.uint64), np.int64(r.b).view(np.uint64)) for r in simhash.links(df).collect()]
        assert len(pairs) < 60 * len(fps)
    at = {x: i for i, x in enumerate(fps.tolist())}
    mine, want = roots(len(fps), [(at[int(a)], at[int(b)]) for a, b in pairs]), brute_components(fps)
    assert len({*zip(mine, want, strict=True)}) == len(set(mine)) == len(set(want))


def brute_fingerprint(t):
    import xxhash
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
    sh = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_of_awkward_rows(spark):
    got = simhash.near_duplicates(documents(spark, extra=True)).collect()
    assert len(got) == len(AWKWARD)
    texts = {i: t or "" for i, t in AWKWARD}
    assert all(r.fingerprint == "%016x" % brute_fingerprint(texts[r.doc_id]) for r in got)
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[0] == by[5] == 0 and by[9] == 9
    kept = simhash.one_of_each(documents(spark, extra=True))
    assert kept.columns == documents(spark, extra=True).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["None", "0", "1", "4", "6", "7", "8", "9", "10", "11"])
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_one_row_of_each_component_stays(spark):
    """Null ids and an id of two texts: near copies go, whatever their ids; one text of each group is left."""
    line = "one two three four five six seven eight nine ten eleven twelve " * 3
    far = ["other words of another text " + c * 9 for c in "qz"]
    near = [line, line + "\n", line + " \t"]      # the same words, so the same fingerprint
    nulls = [(None, t) for t in near] + [(None, t + " ") for t in near] + [(None, far[0]), (None, None), (None, "")]
    got = [tuple(r)[:2] for r in simhash.one_of_each(documents(spark, nulls)).collect()]
    assert len(got) == 3 and sum(bool(t) and t.startswith("one") for _, t in got) == 1
    mixed = [(None, near[0]), (7, near[1]), (7, near[2]), (9, near[0]), (9, far[0]), (8, far[0] + " "), (9, far[1]), (9, far[1])]
    got = [tuple(r)[:2] for r in simhash.one_of_each(documents(spark, mixed)).collect()]
    assert sorted(i for i, _ in got) == [7, 8, 9] and (8, far[0] + " ") in got and (9, far[1]) in got


def brute_suffix(rows):
    texts, count, out = [(t or "").encode() for _, t in rows], {}, []
    for b in texts:
        for j in range(len(b) - 399):
            count[b[j:j + 400]] = count.get(b[j:j + 400], 0) + 1
    for (i, _), b in zip(rows, texts, strict=True):
        g = np.zeros(len(b), bool)
        for j in range(len(b) - 399):
            if count[b[j:j + 400]] > 1:
                g[j:j + 400] = True
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()
        out.append((i, len(b), int(g.sum()), int((g[1:] & ~g[:-1]).sum() + g[:1].sum()), kept))
    return out


def brute_cover(rows):
    words, low, out = [(t or "").encode().split() for _, t in rows], {}, []
    key = [i if i is not None else float("inf") for i, _ in rows]
    for k, w in zip(key, words, strict=True):
        for j in range(len(w) - 12):
            low[tuple(w[j:j + 13])] = min(low.get(tuple(w[j:j + 13]), float("inf")), k)
    for (i, _), k, w in zip(rows, key, words, strict=True):
        g = [False] * len(w)
        for j in range(len(w) - 12):
            if low[tuple(w[j:j + 13])] < k:
                g[j:j + 13] = [True] * 13
        kept = b" ".join(x for x, gone in zip(w, g, strict=True) if not gone)
        out.append((i, len(w), sum(g), hashlib.sha256(kept).hexdigest()))
    return out


CASES = [passages(1), passages(2, 60), AWKWARD, [], [(3, "a b " * 300), (1, "a b " * 300), (2, None)]]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_suffix_dedup(spark, case):
    got = [tuple(r) for r in suffix.repeated_bytes_removed(documents(spark, CASES[case], extra=True)).collect()]
    assert sorted(got, key=str) == sorted(brute_suffix(CASES[case]), key=str)


@pytest.mark.parametrize("case", range(len(CASES)))
def test_substring_dedup(spark, case):
    got = [tuple(r) for r in cover.repeated_windows_removed(documents(spark, CASES[case], extra=True)).collect()]
    assert sorted(got, key=str) == sorted(brute_cover(CASES[case]), key=str)


def test_cover_is_a_difference_cover():
    p = cover.PERIOD
    assert all(any((i + s) % p in cover.COVER and (j + s) % p in cover.COVER for s in range(p)) for i in range(p) for j in range(p))


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(4)
    for n in (1, 2, 5, 9):
        runs, every = [], []
        for _ in range(n):
            words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(1, 30))})
            h = suffix._common(words)
            rest = b"".join(s[k:] for s, k in zip(words, h.tolist(), strict=True))
            import pyarrow as pa
            cols = [h.tobytes(), np.array([len(s) for s in words], np.uint16).tobytes(),
                    pa.compress(rest, "zstd", asbytes=True) if rest else b"", bytes(len(words)), bytes(len(words)),
                    bytes(len(words)), bytes(8 * len(words))]
            runs.append((words, suffix._Run([np.frombuffer(c, np.uint8) for c in cols])))
            every += words
        got = [(runs[r][0][i], k) for r, i, k in suffix.merged([r for _, r in runs])]
        assert [s for s, _ in got] == sorted(every)
        assert all(k == suffix.common(a, b, 0) for (a, _), (b, k) in zip(got, got[1:], strict=False))


def test_crowds_are_looked_at_whole(monkeypatch):
    """A group longer than CROWD marks all its members, so that its strings are all compared."""
    monkeypatch.setattr(suffix, "CROWD", 3)
    import pyarrow as pa
    words = [b"x" * 400] * 1
    cols = [np.zeros(1, np.uint16).tobytes(), np.array([400], np.uint16).tobytes(), pa.compress(words[0], "zstd", asbytes=True)]
    rows = [[np.frombuffer(c, np.uint8) for c in [*cols, bytes([i]), bytes([0]), bytes([0]), np.uint64(i).tobytes()]] for i in range(8)]
    assert all(int(r[0]) & suffix.LOOK for r in suffix._answer_runs(rows))


def one_phrase(n=16):
    """Texts in pairs whose anchors nearly all lie at one phrase, 32 bytes or more before its end."""
    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    for _ in range(2000):
        phrase = word(56)
        rows = [(2 * i + j, t) for i in range(n) for t in ["".join(phrase + word(40) for _ in range(12))] for j in (0, 1)]
        raw = rows[0][1].encode()
        at = suffix.anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1]
        if np.mean([raw[a:a + 32] in phrase.encode() for a in at]) > 0.9:
            return rows
    raise AssertionError("no phrase")


def test_suffixes_of_one_phrase_are_divided(spark):
    """Different passages after a common phrase of 32 bytes do not land in one part."""
    from shopcast.llm import chunks as C
    rows = one_phrase()
    packed = C.pack(documents(spark, rows))
    certain = C.exchange(packed, lambda c, d: suffix._send_certain(c, d, 4), suffix._answer_certain, 2, 4)
    first = tables.written(C.with_replies(packed, certain, "test-certain").mapInArrow(suffix._filter, suffix._SCHEMA), "test-first")
    parts, suffixes = np.zeros(8, np.int64), 0
    for r in first.where("data IS NOT NULL").select("data").toArrow()["data"]:
        suffixes += len(suffix._Open(r).run(8)[2])
        for batch in suffix._send_run(0, r, 8):
            np.add.at(parts, batch.column("part").to_numpy(), [len(v.as_py()) // 2 for v in batch.column("v0")])
    assert parts.sum() == suffixes and parts.max() < 0.4 * parts.sum()
    got = [tuple(r) for r in suffix.repeated_bytes_removed(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute_suffix(rows), key=str)


def test_graph_recall(spark):
    from pyspark.sql import functions as F
    vectors = tables.table(spark, SF, "embeddings").withColumn("node", F.lit("clash"))
    same = vectors.where("vec_id = 0").selectExpr("explode(sequence(1000L, 1300L)) AS vec_id", "embedding", "label", "node")
    bad = spark.createDataFrame([(2000, None), (2100, []), (2200, [0.0] * 64), (2300, [float("nan")] * 64), (2400, [None] + [1.0] * 63),
                                 (2500, [float("inf")] * 64), (2600, [1.0, 2.0])], "vec_id long, embedding array<float>")
    every = vectors.unionByName(same).unionByName(bad, allowMissingColumns=True)
    got = graph.nearest(every).toPandas()
    rows = every.where("vec_id < 2000").select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_list()).astype(float)
    hits = total = 0
    assert set(got.query_id) == {i for i in ids.tolist() if i % 100 == 0}
    for q, g in got.groupby("query_id"):
        at = np.flatnonzero(ids == q)[0]
        d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        d[at] = np.inf
        best = ids[np.lexsort((ids, d))[:10]].tolist()
        g = g.sort_values("rank")
        hits, total = hits + len(set(best) & set(g.vec_id)), total + 10
        assert g["rank"].tolist() == list(range(1, 11))
        assert np.allclose(g.score, d[[np.flatnonzero(ids == v)[0] for v in g.vec_id]], rtol=0, atol=1e-12)
        assert list(zip(g.score, g.vec_id, strict=True)) == sorted(zip(g.score, g.vec_id, strict=True))
    assert hits / total >= 0.9
    far = spark.createDataFrame([(i, [scale * (1 + 1e-9 * i) if j else float(i) for j in range(4)]) for scale in (1e200, 1.0, 1e-200)
                                 for i in range(0, 5)][:5], "vec_id long, embedding array<double>")
    scores = {r.vec_id: r.score for r in graph.nearest(far).collect()}
    assert len(scores) == 4 and all(scores[i] == pytest.approx(np.sqrt(3) * 1e200 * 1e-9 * i) for i in scores)
    close = spark.createDataFrame([(i, [1.0 + 1e-12 * i, 2.0]) for i in range(6)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in graph.nearest(close).orderBy("rank").collect()] == [1, 2, 3, 4, 5]     # float could not tell them apart
    assert graph.nearest(vectors.where("vec_id = 0")).count() == 0 and graph.nearest(vectors.limit(0)).count() == 0
    assert graph.nearest(vectors.where("vec_id < 4")).count() == 3
