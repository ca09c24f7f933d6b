"""The kNN index holds the cells of full agreement only; others are indexed for the queries that reach them."""

from ledgerlens.operators import knn


def test_index_has_a_row_per_reference_and_far_cells_are_still_found(spark):
    refs = [("g", i, "L", float(i % 40), "a" if i < 40 else "b", "u") for i in range(80)]
    rdf = spark.createDataFrame(refs, "g string, id long, y string, x double, c1 string, c2 string")
    how = {"keys": ["g"], "num": ["x"], "cat": ["c1", "c2"]}
    index = knn.build_index(rdf, t_id="id", t_label="y", keep=3, **how)
    assert index.rows.count() == 80  # before: one for each of four subsets
    qs = [("g", 100, 7.2, "a", "u"), ("g", 101, 39.0, "b", "v"), ("g", 102, 60.0, "z", "u")]
    qdf = spark.createDataFrame(qs, "g string, id long, x double, c1 string, c2 string")
    got = {}
    for r in sorted(knn.knn_probe(index, qdf, q_id="id", k=2, **how).collect(), key=lambda r: (r.q_id, r.rank)):
        got.setdefault(r.q_id, []).append(r.t_id)
    want = {i: [t for _, t in sorted(((x - rx) ** 2 + 2.0 * (c1 != r1) + 2.0 * (c2 != r2), t) for _, t, _, rx, r1, r2 in refs)[:2]] for _, i, x, c1, c2 in qs}
    assert got == want
