import brute
import numpy as np

from countwatch.llm import embeddings


def check(spark, vectors, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, node int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, **options).collect()}
    x = np.array([np.array(v, dtype=np.float32).astype(float) for _, v in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= embeddings.LEAST
    links = near.sum(axis=1) - 1
    roots = brute.components(len(x), zip(*np.nonzero(near), strict=True))
    found = sum(r.n_links for r in got.values())
    assert found >= 0.9 * links.sum()
    for k, (i, _) in enumerate(vectors):
        assert got[i].n_links <= links[k]
    if found == links.sum():
        assert [got[i].component_id for i, _ in vectors] == [vectors[r][0] for r in roots]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    return found, links.sum()


def clusters(rng, n, dim, spread):
    centres = rng.standard_normal((n, dim))
    return [(c + spread * rng.standard_normal(dim)).tolist() for c in centres for _ in range(rng.integers(1, 8))]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = list(enumerate(clusters(rng, 120, 32, 0.1)))
    found, true = check(spark, vectors)
    assert found >= 0.99 * true > 0


def test_large_cells_are_dealt_out_in_blocks(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    vectors = list(enumerate([(centre + 0.15 * rng.standard_normal(16)).tolist() for _ in range(90)] + clusters(rng, 20, 16, 0.05)))
    found, true = check(spark, vectors, block=8)
    assert found >= 0.98 * true


def test_copies_bad_vectors_and_lengths(spark):
    rows = [
        (4, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [2.0, 0.001]), (5, [0.0, 0.0]), (6, None), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (3, [1.0, 0.0, 0.0]),
        (None, [0.0, 1.0]), (10, [float("inf"), 1.0]), (11, []), (12, [1e-30, 0.0]), (12, [1e-30, 0.0]),
    ]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows)
    assert {(4, 4, 2, False), (2, 4, 2, True), (9, 4, 2, False), (12, 4, 2, False)} <= got
    assert {(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (3, 0, 3, True), (10, 0, 10, True), (11, 0, 11, True)} <= got
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert embeddings.near_duplicates(empty).count() == 0


def test_the_count_is_calibrated():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((2000, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = embeddings.LEAST * x + np.sqrt(1 - embeddings.LEAST**2) * y
    p = embeddings.directions(64, embeddings.PROJECTIONS, 1)
    hits = (np.abs(x @ p - near @ p) <= embeddings.WINDOW).sum(axis=1)
    assert (hits >= embeddings.least_count()).mean() > 0.99
    assert ((np.abs(x @ p - y @ p) <= embeddings.WINDOW).sum(axis=1) >= embeddings.least_count()).mean() < 0.05


def test_windows_count_like_all_pairs():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 7, 30, 2])
    cells = np.repeat(np.arange(4), sizes)
    p = rng.standard_normal((40, 5))
    a, b = embeddings.colliding(p, cells, sizes, 0.6, 2)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if cells[i] == cells[j] and (np.abs(p[i] - p[j]) <= 0.6).sum() >= 2}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
