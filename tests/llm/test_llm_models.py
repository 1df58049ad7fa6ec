"""Toxicity, quality, mixing and the pipeline: held-out accuracy, brute force and DuckDB."""

import duckdb
import numpy as np
import pytest
from llm_fixtures import AWKWARD, documents, shared_folder  # noqa: F401

from shopcast.llm import mixing, pii, quality, queries, simhash, tables, toxicity

SF = "/root/testdata/sf0.01"


def no_labels(spark):
    return spark.createDataFrame([(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def toxic(spark):
    return toxicity.scored(tables.table(spark, SF, "documents"), tables.table(spark, SF, "labels")).toPandas()


def test_toxicity_held_out(spark, toxic):
    import zlib
    labels = tables.table(spark, SF, "labels").toPandas()
    m = toxic.merge(labels, on="doc_id")
    assert len(toxic) == 1000 and toxic.score.between(0, 1).all()
    assert (toxic.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in toxic.doc_id]).all()
    assert ((toxic.score >= 0.5) == (toxic.predicted == 1)).all()
    h = m[m.held_out]
    r, n = h.score.rank(), (h.toxic == 1).sum()
    assert (r[h.toxic == 1].sum() - n * (n + 1) / 2) / n / (len(h) - n) > 0.9
    assert (h.predicted == h.toxic).mean() > 0.93


def plain_kneser_ney(rows):
    """(scores of all grams, lower and class distributions) by dictionaries.  ``rows``: gram, toxic count, ordinary count."""
    grams = {g: (t, o) for g, t, o in rows}
    orders = {}

    def lower(context, byte):
        """P(byte | context) of the shared orders below the top one."""
        size = len(context) + 1
        if not size:
            return 1 / 256
        if size not in orders:
            above = {g[-size - 1:] for g in grams}
            counts = {}
            for x in above:
                counts[x[1:]] = counts.get(x[1:], 0) + 1
            orders[size] = counts
        mine = {x: c for x, c in orders[size].items() if x[:-1] == context}
        below = 1 / 256 if size == 1 else lower(context[1:], byte)
        if not mine:
            return below
        total = sum(mine.values())
        return max(mine.get(context + byte, 0) - 0.75, 0) / total + 0.75 * len(mine) / total * below

    def discount(cls):
        c = [max(1, sum(v[cls] == i for v in grams.values())) for i in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1])
        return [0.0] + [min(max(i - (i + 1) * y * c[i] / c[i - 1], 0.1), i - 0.01) for i in (1, 2, 3)]
    ds = discount(0), discount(1)

    def top(cls, context, byte):
        mine = {g: v[cls] for g, v in grams.items() if g[:-1] == context}
        total, d = sum(mine.values()), ds[cls]
        if not total:
            return lower(context[1:], byte)
        n = mine.get(context + byte, 0)
        return (n - d[min(n, 3)] + sum(d[min(v, 3)] for v in mine.values()) * lower(context[1:], byte)) / total
    return {g: np.log(top(0, g[:-1], g[-1:])) - np.log(top(1, g[:-1], g[-1:])) for g in grams}, lower, top


def test_kneser_ney_equals_dictionaries_and_sums_to_one(spark):
    import pyarrow as pa
    texts = ["abc abd abe xyz abcab", "abc xyz abc", "abz qrs", "bad badly bad", "Abd xy z", None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    rows = [tuple(int(v) for v in r) for b in toxicity._count(iter([batch]), {0: 1, 1: 0, 3: 1, 4: 0})
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    counts = spark.createDataFrame(rows, "g long, n long, toxic long, ordinary long")
    want, lower, top = plain_kneser_ney([(g.to_bytes(toxicity.ORDER, "big"), t, o) for g, _, t, o in rows])
    got = {r.g.to_bytes(toxicity.ORDER, "big"): r.score for r in toxicity.gram_scores(counts).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=1e-12) for g in got)
    every = [bytes([b]) for b in range(256)]
    for context in {g[:-1] for g in got}:
        for cut in range(1, len(context) + 1):
            assert sum(lower(context[cut:], b) for b in every) == pytest.approx(1)
        for cls in (0, 1):
            assert sum(top(cls, context, b) for b in every) == pytest.approx(1)


def test_grams_of_one_hash_keep_their_own_scores(spark):
    """A rare toxic gram beside a frequent one of score 0 whose mixed hash has the same 22 low bits."""
    from shopcast.llm import text as T
    letters = np.random.default_rng(1).integers(97, 123, (20_000, 5))
    g = np.unique(letters @ (1 << np.array([32, 24, 16, 8, 0])))
    low = (T.mix(g.astype(np.uint64)) & np.uint64((1 << 22) - 1)).astype(np.int64)
    order = np.argsort(low, kind="stable")
    hit = np.flatnonzero(np.diff(low[order]) == 0)[0]
    rare, often = (int(x) for x in g[order[hit:hit + 2]])
    scores = spark.createDataFrame([(rare, 1, 3.0), (often, 99, 0.0)], "g long, n long, score double")
    table = toxicity.score_table(scores)
    raw = rare.to_bytes(5, "big") + often.to_bytes(5, "big")
    got = toxicity.features(np.frombuffer(raw, np.uint8), np.array([0, 5, 10]), table)
    one = [3 / 5] + [3.0] * len(toxicity.STRETCHES) + [0.0] * len(toxicity.RANKS) + [np.log(2)]
    assert got.tolist() == [pytest.approx(one), [0.0] * (toxicity.FEATURES - 1) + [pytest.approx(np.log(2))]]


def test_every_gram_of_a_fitted_context_is_in_the_table(spark):
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["abc abd abe xyz", "abc xyz", "abz qrs"]})
    counts = spark.createDataFrame([tuple(int(v) for v in r) for b in toxicity._count(iter([batch]), {1: 1, 2: 0})
                                    for r in zip(*(c.to_pylist() for c in b.columns), strict=True)],
                                   "g long, n long, toxic long, ordinary long")
    rows = toxicity.gram_scores(counts).collect()
    table = toxicity.score_table(toxicity.gram_scores(counts))
    got = toxicity.scores_of(np.array([r.g for r in rows]), table)
    assert got.tolist() == pytest.approx([r.score for r in rows])
    seen = {r.g >> 8 for r in counts.collect() if r.toxic + r.ordinary}
    assert all(r.score == 0 for r in rows if r.g >> 8 not in seen) and any(r.g >> 8 not in seen for r in rows)


def test_toxicity_of_awkward_rows(spark):
    docs = documents(spark, extra=True)
    labels = spark.createDataFrame([(i, 0, i % 2) for i, _ in AWKWARD if i is not None] + [(4, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, labels).toPandas()
    assert len(got) == len(AWKWARD) and got.score.between(0, 1).all()
    assert toxicity.clean(docs, labels).schema == docs.schema
    assert (toxicity.scored(docs, no_labels(spark)).toPandas().score == 0.0).all()
    assert toxicity.clean(docs, no_labels(spark)).count() == len(AWKWARD)
    assert toxicity.scored(documents(spark, []), labels).count() == 0


def test_quality_held_out(spark):
    got = quality.scored(tables.table(spark, SF, "documents"), tables.table(spark, SF, "labels")).toPandas()
    h = got.merge(tables.table(spark, SF, "labels").toPandas(), on="doc_id")
    h = h[h.held_out]
    r, n = h.score.rank(), (h.quality == 1).sum()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (r[h.quality == 1].sum() - n * (n + 1) / 2) / n / (len(h) - n) > 0.97 and (h.predicted == h.quality).mean() > 0.95


def test_isotonic_is_the_least_squares_fit():
    x, rate = quality.isotonic(np.arange(6.0), np.array([1, 1, 2, 1, 1, 4]), np.array([0, 1, 0, 1, 0, 4]))
    assert (np.diff(rate) >= 0).all() and rate[0] == 0 and rate[-1] == 1 and 1 / 3 in rate and 1 / 2 in rate


def test_normal_equations_equal_one_machine(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 5)).astype(np.float32), rng.integers(0, 2, 200)
    rows = spark.createDataFrame([(v.tolist(), int(t), i % 2) for i, (v, t) in enumerate(zip(x, y, strict=True))],
                                 "x array<float>, y int, half long").repartition(5)
    eq = quality._equations(rows, np.zeros(5), np.ones(5))
    for h in (0, 1):
        z = quality.cosines(x[h::2].astype(float), np.zeros(5), np.ones(5))
        assert np.allclose(eq[h][0], z.T @ z) and np.allclose(eq[h][1], z.T @ y[h::2])


def test_quality_of_awkward_rows(spark):
    docs = documents(spark, extra=True)
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in AWKWARD if i is not None], "doc_id long, quality int, toxic int")
    assert quality.scored(docs, labels).toPandas().score.between(0, 1).all()
    assert (quality.scored(docs, no_labels(spark)).toPandas().score == 0.5).all()
    assert quality.scored(documents(spark, []), labels).count() == 0


def reshared(size, weight):
    """Shares of 1.5 times all sizes by weight, the excess over 2 sizes shared again and again."""
    capped, total = set(), 1.5 * sum(size)
    while True:
        rest = [i for i in range(len(size)) if i not in capped]
        left = total - sum(2 * size[i] for i in capped)
        w = sum(weight[i] for i in rest)
        target = [2.0 * size[i] if i in capped else left * weight[i] / w for i in range(len(size))]
        over = {i for i in rest if target[i] > 2 * size[i]}
        if not over:
            return target
        capped |= over


def test_mixing_equals_sql_and_the_rules(spark):
    docs = tables.table(spark, SF, "documents")
    got = mixing.allotted(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(mixing.SQL).df().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-12, equal_nan=True), c
    by = got.merge(docs.select("doc_id", "source").toPandas(), on="doc_id").groupby("source").agg(
        size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert np.allclose(by.target, reshared(by["size"].tolist(), [(3, 1, 2)[i % 3] for i in range(len(by))]))
    assert (by.target - by.taken).abs().max() <= 0.5 and (got.taken <= 2 * got["size"]).all()


def test_mixing_of_awkward_rows(spark):
    got = mixing.allotted(documents(spark, extra=True)).toPandas()
    assert len(got) == len(AWKWARD) and (got.taken <= 2 * got["size"]).all()
    assert got.drop_duplicates("source_size").target.sum() == pytest.approx(1.5 * got["size"].sum())
    docs = documents(spark, extra=True)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert sum(len((r.text or "").encode().split()) for r in rows) == got.taken.sum()
    assert all(r.n_chars == len(r.text) for r in rows)
    assert mixing.allotted(documents(spark, [])).count() == 0 and mixing.mixed(documents(spark, [])).count() == 0


def test_curriculum_positions_invert_the_demand(spark):
    rows = [(i, "w " * (1 + i % 17)) for i in range(900)]
    docs = documents(spark, rows)
    got = mixing.allotted(docs).join(docs.select("doc_id", "source"), "doc_id").where("taken > 0").toPandas()
    for slope, source in zip(mixing.SLOPES, ("s0", "s1", "s2"), strict=True):
        g = got[got.source == source].sort_values("position")
        first = np.minimum(g.taken, g["size"])
        u = (np.cumsum(first) - first / 2) / g.target
        t = g.position
        assert np.allclose(t + slope * (t * t - t), u)


def test_pipeline_equals_its_stages_by_hand(spark):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "tokens"]
    docs = tables.table(spark, SF, "documents")
    bad = set(toxicity.scored(docs, tables.table(spark, SF, "labels")).where("predicted = 1").toPandas().doc_id)
    raw = docs.where(~docs.doc_id.isin([int(i) for i in bad]))
    groups = simhash.near_duplicates(raw).toPandas()
    keep = set(groups[groups.doc_id == groups.component_id].doc_id)
    field = pii.train(pii.labelled_table())
    left = [(r.doc_id, r.text, r.lang, r.source) for r in raw.collect() if r.doc_id in keep]
    texts = [pii.mask(t, b + a) for (_, t, _, _), (b, a) in zip(left, pii._search([r[1] for r in left], field), strict=True)]
    masked = spark.createDataFrame([(i, t, l, s, len(t)) for (i, _, l, s), t in zip(left, texts, strict=True)], docs.schema)
    taken = mixing.allotted(masked).toPandas()
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) == set(taken[taken.taken > 0].doc_id)
    whole = taken[taken.taken == 2 * taken["size"]]
    assert (got[got.doc_id.isin(set(whole[whole["size"] > 0].doc_id))].groupby("doc_id").size() == 2).all()


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    """Null and repeated ids, null and empty texts: every word the mix takes of what the stages keep is encoded."""
    import corpus_pipeline
    for name, rows in (("awkward", AWKWARD), ("empty", [])):
        folder = str(tmp_path / name)
        documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
        no_labels(spark).write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder)
        left = {f.rsplit("/", 2)[1].rsplit("-", 1)[0] for f in got.inputFiles()}
        assert left == {"pipeline-mixing"} or not rows
        got = got.toPandas()
        assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
        if not rows:
            assert got.empty
            continue
        kept = simhash.one_of_each(documents(spark, rows))
        taken = mixing.allotted(kept).where("taken > 0").toPandas()
        known = lambda df: {None if np.isnan(float("nan") if i is None else i) else int(i) for i in df.doc_id}
        assert known(got) == known(taken) and (got.n_tokens > 0).all()


def test_texts_beyond_a_slice(spark):
    """Two copies of a text of 2.3 MB among short ones, in different partitions."""
    import hashlib
    import random

    import public_tokenizers
    import tiktoken

    from shopcast.llm import bpe, minhash
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(350_000))
    assert len(long.encode()) > 2 << 20
    rows = [(0, long), (1, "a few words here"), (2, ""), (3, long), (4, "some more of them")]
    docs = documents(spark, rows)
    prints = minhash.edited_pairs(docs).toPandas().set_index("doc_id")
    edited = long[:len(long) - len(long) // 2] + "a few words here"
    assert prints.edited_sha256[0] == hashlib.sha256(edited.encode()).hexdigest() and prints.fingerprint[0] == prints.fingerprint[3]
    near = simhash.near_duplicates(docs).toPandas().set_index("doc_id")
    assert near.component_id[3] == 0 and near.fingerprint[0] == near.fingerprint[3] != near.fingerprint[1]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        plain = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    ids = np.array(plain.encode_ordinary(long), "<u4")
    codes = bpe.encoded(docs, path, public_tokenizers.PATTERN).toPandas().set_index("doc_id")
    for i in (0, 3):
        assert codes.n_tokens[i] == len(ids) and codes.ids_sha256[i] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert codes.decoded_sha256[i] == hashlib.sha256(long.encode()).hexdigest()
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)], "doc_id long, quality int, toxic int")
    for score in (quality.scored, toxicity.scored):
        got = score(docs, labels).toPandas().set_index("doc_id").score
        assert got.between(0, 1).all() and got[0] == got[3]


def test_every_query_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)
