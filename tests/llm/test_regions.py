"""Searches whose queries go from region to region: what is stored on the way, and results over several regions and shares."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyframe.llm import vectors


def made(spark, n, copies):
    v = np.random.default_rng(6).normal(size=(n, 16)).astype(np.float32)
    v[:copies] = v[0]
    return v.astype(np.float64), spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")


def brute(v, every, k):
    want = []
    for q in range(0, len(v), every):
        exact = (v * v[q]).sum(1)
        top = [i for i in np.lexsort((np.arange(len(v)), -exact))[: k + 1].tolist() if i != q][:k]
        want += [(q, n + 1, i, float(exact[i])) for n, i in enumerate(top)]
    return want


def test_what_is_stored_does_not_grow_with_blocks_of_both_sides(spark, monkeypatch):
    stored, write = {}, vectors.materialize

    def kept(df, name, *args, **how):
        stored[name] = (out := write(df, name, *args, **how)).inputFiles()
        return out

    monkeypatch.setattr(vectors, "materialize", kept)
    v, frame = made(spark, 4000, 0)
    got = [tuple(r) for r in vectors.nearest(frame, k=5, every=4, block_rows=40).collect()]  # 100 blocks, of candidates and of queries
    assert sorted(got) == brute(v, 4, 5)
    files = {name: [pq.ParquetFile(f.removeprefix("file://")).metadata for f in paths] for name, paths in stored.items()}
    groups = {name: [m.row_group(i) for m in metas for i in range(m.num_row_groups)] for name, metas in files.items()}
    assert max(g.num_rows for name, found in groups.items() if name != "cells" for g in found) <= 16  # a reader holds a row group's rows at once, or 4,096
    assert sum(g.total_byte_size for name, found in groups.items() if name != "indexes" for g in found) < 4 * v.nbytes


@pytest.mark.parametrize("region, share", [(1, 64), (3, 1), (16, 2)])
def test_results_over_regions_and_shares(spark, monkeypatch, region, share):
    monkeypatch.setattr(vectors, "REGION", region)
    monkeypatch.setattr(vectors, "SHARE", share)
    monkeypatch.setattr(vectors, "TASKS", 1, raising=False)
    v, frame = made(spark, 1500, 300)
    got = [tuple(r) for r in vectors.nearest(frame, rerank=30, block_rows=60, query_rows=20).collect()]
    assert sorted(got) == brute(v, 20, 20)
    scaled = np.floor(256 * v)
    got = [tuple(r) for r in vectors.exact_top_k(frame, block_rows=60, query_rows=20).collect()]
    assert sorted(got) == [(q, n, i, int(s)) for q, n, i, s in brute(scaled, 50, 5)]


@pytest.mark.parametrize("powers", [(0, 0), (-30, 30), (-170, 150), (-60, -45)])
def test_no_pair_that_comes_to_the_bound_is_ruled_out(powers):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(3000, 16)) * 10.0 ** rng.uniform(*powers, (3000, 1))
    v[5:400] = v[5] * (1 + 1e-3 * rng.normal(size=(395, 16)))
    books, extra = vectors.fit_books(v[::4])
    codes = vectors.choose(v, books, extra).astype(np.uint8)
    coded = books[np.arange(len(books)), codes].reshape(v.shape)
    index = {"vectors": v, "codes": np.ascontiguousarray((codes[:, 0::2] << 4 | codes[:, 1::2]).T), **vectors.angles(v, coded)}
    asking = v[::100]
    size = np.linalg.norm(asking, axis=1)
    product = np.stack([(v * x).sum(1) for x in asking], 1)
    bounds = np.sort(product, axis=0)[-20]
    rows, columns = vectors.possible(index, books, asking / size[:, None], size, bounds)
    got = np.zeros(product.shape, bool)
    got[rows, columns] = True
    assert got[product >= bounds].all()
    if powers == (0, 0):
        assert got.mean() < 0.1
