"""Scalars on literals, invariants of the index, the life cycle on disk, and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import SMALL
from tessera.functions import papers, text
from tessera.functions import vectors as V
from tessera.operators import index, lifecycle, search
from tessera.plans.vectors import open_index
from tests.oracle import DATA


@pytest.fixture(scope="module")
def ix(spark):
    return open_index(spark, f"{DATA}/sf0.001")


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def vec(values):
    return F.array(*[F.lit(v) for v in values])


def test_scalars(spark):
    ones, minus = vec([1] * 64), vec([-1] * 64)
    q = vec([5, -5] * 32)
    r = one(
        spark,
        far=V.hamming(V.binary_code(ones, 64), V.binary_code(minus, 64)),
        near=V.hamming(V.binary_code(ones, 64), V.binary_code(ones, 64)),
        up=V.adc(q, ones),
        down=V.adc(q, minus),
        dot=V.dot(vec([1, 2, 3]), vec([4, 5, 6])),
        cut=V.quantize_int8(vec([0.999, -0.999, 2.0, -2.0])),
        zero=V.cosine(F.lit(5), F.lit(0.0)),
    )
    assert (r.far, r.near, r.up, r.down, r.dot, r.cut, r.zero) == (64, 0, 0, 0, 32, [126, -126, 127, -128], 0.0)


def test_planes_are_unit_and_apart():
    p = V.halton_planes(64).astype(float) / V.SCALE
    assert np.allclose(np.linalg.norm(p, axis=1), 1, atol=1e-6)
    cosines = np.abs(p @ p.T) - np.eye(len(p))
    assert cosines.max() < 0.98


def test_bound_holds_and_probing_all_is_exact(spark, ix):
    records, directory = ix.records, ix.directory
    scores = ix.queries.crossJoin(records).select("query_id", "segment_id", "extent_no", V.dot("q", "v").alias("score"))
    broken = scores.join(search.extent_bounds(ix.queries, ix.plan(SMALL.segments), directory), ["query_id", "segment_id", "extent_no"]).filter("score > bound + 1e-4")
    assert broken.count() == 0
    exact = search.exact_knn(ix.queries, ix.vectors, 5).select("query_id", "vec_id", "score", "rank")
    every = ix.plan(SMALL.segments)
    assert search.probe_topk(ix.queries, every, records, 5).select("query_id", "vec_id", "score", "rank").exceptAll(exact).count() == 0
    bounded, visited = search.bounded_topk(ix.queries, every, records, directory, 2)
    top2 = exact.filter("rank <= 2")
    assert bounded.select("query_id", "vec_id", "score", "rank").exceptAll(top2).count() == 0
    assert visited.filter("NOT is_scored").count() > 0


def test_exact_knn_in_blocks_of_queries(ix):
    a = search.exact_knn(ix.queries, ix.vectors, 3)
    b = search.exact_knn(ix.queries, ix.vectors, 3, query_block=4)
    assert a.exceptAll(b).count() == 0 and b.count() == a.count()


def test_plans_prune(ix):
    plan = search.probe_topk(ix.queries, ix.plan(), ix.records, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_sync_and_snapshots(spark):
    c = spark.createDataFrame([(1, "paper1.pdf", 102400, 1700000000, False), (2, "paper2.pdf", 204800, 1700000000, False), (3, "gone.pdf", 307200, 1700000000, False)], "doc_id long, filename string, file_size long, last_write_time long, is_deleted boolean")
    disk = spark.createDataFrame([("paper1.pdf", 102400, 1700000000), ("paper2.pdf", 204800, 1700005000), ("paper3.pdf", 512000, 1700000000)], "filename string, file_size long, last_write_time long")
    d = {r.filename: r for r in lifecycle.sync_diff(c, disk).collect()}
    assert sorted(k for k, r in d.items() if r.pending) == ["paper2.pdf", "paper3.pdf"]
    assert sorted(r.doc_id for r in d.values() if r.tombstoned) == [2, 3]


def test_sync_by_path_or_base_name(spark):
    c = spark.createDataFrame([(1, "a/x.pdf", 1, 1, False), (2, "b/x.pdf", 1, 1, False), (3, "y.pdf", 1, 1, False), (4, "z.pdf", 1, 1, False), (5, "old.pdf", 1, 1, True)], "doc_id long, filename string, file_size long, last_write_time long, is_deleted boolean")
    disk = spark.createDataFrame([("a/x.pdf", 1, 1), ("b/x.pdf", 2, 1), ("sub/y.pdf", 1, 1), ("p/z.pdf", 1, 1), ("q/z.pdf", 1, 1), ("old.pdf", 1, 1)], "filename string, file_size long, last_write_time long")
    got = {(r.filename, r.doc_id, r.status) for r in lifecycle.sync_diff(c, disk).collect()}
    assert got == {("a/x.pdf", 1, "unchanged"), ("b/x.pdf", 2, "modified"), ("sub/y.pdf", 3, "unchanged"), ("z.pdf", 4, "deleted"), ("p/z.pdf", None, "new"), ("q/z.pdf", None, "new"), ("old.pdf", None, "new")}


def test_centre_moves_routing(spark):
    """Signature and margins are those of the vectors less the centre."""
    rng = np.random.default_rng(3)
    x, centre, planes = rng.integers(-90, 90, (40, 8)), rng.integers(-30, 30, 8), V.halton_planes(8)
    frame = spark.createDataFrame([(i, [int(e) for e in v]) for i, v in enumerate(x)], "query_id long, q array<int>")
    side = (x - centre) @ planes.T
    got = {r.query_id: r.s for r in frame.select("query_id", V.signature(planes, centre)("q").alias("s")).collect()}
    assert got == {i: sum(1 << p for p in range(32) if side[i][p] >= 0) for i in range(40)}
    lengths = np.sqrt((planes.astype(float) ** 2).sum(1))
    for r in search.probe_margins(frame, planes, centre).collect():
        assert r.bit == (side[r.query_id][r.plane] >= 0) and r.margin == pytest.approx(abs(side[r.query_id][r.plane]) / lengths[r.plane])


def test_calibrated_planes_balance_bits_and_search(spark, tmp_path):
    from tessera.operators.calibrate import moments

    plain, fitted = open_index(spark, f"{DATA}/sf0.01"), open_index(spark, f"{DATA}/sf0.01", calibrated=True)
    x = np.stack([r.v for r in plain.vectors.collect()]).astype(np.int64)
    n, total, outer = moments(plain.vectors.repartition(7), plain.dimension)
    assert n == len(x) and (total == x.sum(0)).all() and (outer == x.T @ x).all()
    skew = lambda ix: np.mean([abs(r.s - 0.5) for r in ix.routed.selectExpr("explode(sequence(0, 31)) AS b", "signature").selectExpr("b", "shiftright(signature, b) & 1 AS o").groupBy("b").agg(F.avg("o").alias("s")).collect()])
    assert skew(fitted) < 0.1
    exact = search.exact_knn(fitted.queries, fitted.vectors, 5).select("query_id", "vec_id")
    got = search.Engine(fitted, SMALL, probes=SMALL.segments)
    for strategy in ("exact", "probe", "bounded"):
        assert got.search(fitted.queries, 5, strategy).select("query_id", "vec_id").exceptAll(exact).count() == 0
    assert got.stats().first().records == len(x)
    index.write_planes(spark, fitted.planes, fitted.centre, f"{tmp_path}/planes")
    planes, centre = index.read_planes(spark, f"{tmp_path}/planes")
    assert (planes == fitted.planes).all() and (centre == fitted.centre).all()


def test_best_keeps_ties_by_key():
    rng = np.random.default_rng(1)
    for k in (1, 3, 7):
        kept, rows = search.Best(6, k), []
        for _ in range(5):
            scores, keys = rng.integers(0, 4, (6, rng.integers(1, 9))), None
            keys = rng.permutation(1000)[: scores.shape[1]] + 1000 * len(rows)
            rows.append((scores, keys))
            kept.score, kept.key = kept.add(slice(0, 6), scores, keys)
        for q in range(6):
            every = sorted((-s[q][i], key) for s, keys in rows for i, key in enumerate(keys))[:k]
            assert [(-a, b) for a, b in zip(kept.score[q], kept.key[q])] == every


def test_recall_scores_nothing_again(spark):
    """Recall from the segments of the exact result equals that of the searches themselves."""
    from tessera.plans import vectors

    for calibrated in (False, True):
        found = open_index(spark, f"{DATA}/sf0.001", calibrated)
        got = vectors.recall_of(found, spark)
        shape = got._jdf.queryExecution().executedPlan().toString()
        assert "zip_with" not in shape and "BroadcastHashJoin" not in shape  # plans grow with the queries
        truth = search.exact_knn(found.queries, found.vectors, 5).select("query_id", "vec_id")
        for r in got.collect():
            hits = search.probe_topk(found.queries, found.plan(r.probes), found.records, 5)
            assert r.recall == round(hits.join(truth, ["query_id", "vec_id"], "left_semi").count() / truth.count(), 6)


def test_strategies_look_at_the_exact_result_only(spark):
    """Of all strategies only the codes are ranked; what the others find is read from the segments."""
    from tessera.plans import registry

    shape = registry.queries()["strategy_compare"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in shape and shape.count("WindowGroupLimit") <= 2


def test_best_of_equal_scores_stays_small():
    """Where all scores are equal only k of each query are looked at, not every tie."""
    import tracemalloc

    kept, keys = search.Best(500, 5), np.arange(4096)
    tracemalloc.start()
    for n in range(3):
        kept.score, kept.key = kept.add(slice(0, 500), np.full((500, 4096), 7.0, np.float32), keys[::-1] + (2 - n) * 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (kept.key == np.arange(5)).all() and (kept.score == 7).all()
    assert peak < 48 << 20  # the pairs of 2,000,000 ties take more than 100 MB


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for top in (127, 1 << 20):
        q, x = rng.integers(-top, top, (9, 64)), rng.integers(-top, top, (11, 64))
        a, b = search.products(q, x)
        assert a.dtype == (np.float32 if top == 127 else np.float64)
        assert ((a @ b.T).astype(np.int64) == q @ x.T).all()


def test_cells_hold_every_pair_once(spark):
    """Queries and items of a segment meet once each, in cells of bounded size."""
    import pyarrow as pa

    reach = spark.range(60).selectExpr("id AS query_id", "CAST(id % 2 AS INT) AS segment_id")
    items = spark.range(500).selectExpr("id AS vec_id", "CAST(IF(id < 450, 0, 1) AS INT) AS segment_id")

    def work(asked, held):
        a, b = asked["query_id"].to_numpy(), held["vec_id"].to_numpy()
        size = np.full(len(a) * len(b), len(a) * len(b))
        return pa.table({"query_id": np.repeat(a, len(b)), "vec_id": np.tile(b, len(a)), "size": size})

    found = search.in_cells(reach, items, "vec_id", work, "query_id long, vec_id long, size long", 10, 50)
    every = reach.join(items, "segment_id").select("query_id", "vec_id")
    assert found.count() == every.count() and found.select("query_id", "vec_id").exceptAll(every).count() == 0
    assert found.agg(F.max("size")).first()[0] < 4 * 10 * 50


def test_probe_search_scores_in_cells(spark, ix):
    """No row of a query and a record is made: cells send on k rows a query."""
    plan = search.probe_topk(ix.queries, ix.plan(), ix.records, 5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan


def test_bounds_are_counted_in_cells(spark, ix):
    """Counts of the visited extents equal those of a row for each, and no such row is made for them."""
    plan = ix.plan(32)
    reach = search.floors(ix.queries, plan, ix.records, 2)
    counts = search.visit_counts(reach, ix.directory)
    top, visited = search.bounded_topk(ix.queries, plan, ix.records, ix.directory, 2)
    scored = F.col("is_scored")
    rows = visited.groupBy("query_id").agg(F.sum("record_count").alias("candidates"), F.sum(F.when(scored, F.col("record_count")).otherwise(0)).alias("scored"), F.sum((~scored).cast("long")).alias("bypassed_extents"))
    assert counts.exceptAll(rows).count() == 0 and counts.count() == rows.count() == ix.queries.count()
    plain = search.probe_topk(ix.queries, plan, ix.records, 2).select("query_id", "vec_id", "score", "rank")
    assert top.select(*plain.columns).exceptAll(plain).count() == 0 and top.count() == plain.count()
    for frame in (counts, top):
        shape = frame._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in shape and "zip_with" not in shape


def test_telemetry_adds_up_in_cells(spark):
    from tessera.plans import registry

    for name in ("probe_telemetry", "bypass_rate"):
        shape = registry.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in shape and "is_scored" not in shape and "zip_with" not in shape, name


def test_funnel_adds_up_in_cells(spark):
    from tessera.plans import registry

    shape = registry.queries()["pruning_funnel"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "is_scored" not in shape and "zip_with" not in shape


def test_plans_have_no_all_pairs(spark, ix):
    from tessera.plans import registry

    for name in ("dot_product", "adc_score", "signature_hamming", "hamming_knn", "adc_rank", "adc_recall_rank", "extent_bounds"):
        plan = registry.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Inner, (bit_count", ""), name


def test_generations_and_damage(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    c = spark.createDataFrame([(1, False), (2, True)], "doc_id long, is_deleted boolean")
    data = spark.range(5)
    assert lifecycle.current(spark, root) == 0
    assert lifecycle.commit(spark, root, {"t": data}, c, 3, 1700000000000000000) == 1
    assert lifecycle.commit(spark, root, {"t": data.limit(2)}, c, 3, 1700000000000000001) == 2
    assert lifecycle.open_table(spark, root, "t").count() == 2
    bad = list(lifecycle.manifest_row(3, 5, 1, 1, 1))
    bad[-1] ^= 1
    spark.createDataFrame([tuple(bad)], lifecycle.MANIFEST).write.mode("append").parquet(f"{root}/manifest")
    assert lifecycle.current(spark, root) == 2


def test_compacting_twice_is_once(spark, ix):
    first = index.assign_extents(ix.routed, SMALL).select("vec_id", "signature", "segment_id", "extent_no")
    again = index.assign_extents(first.drop("extent_no"), SMALL).select("vec_id", "signature", "segment_id", "extent_no")
    assert first.exceptAll(again).count() == 0


def test_watcher_keeps_state_on_failure(spark, tmp_path):
    from tessera.streaming import watch

    state = f"file://{tmp_path}/state"
    shot = lambda size: spark.sql(f"SELECT 'a.pdf' AS path, timestamp'2024-01-01' AS mtime, CAST({size} AS BIGINT) AS size")
    seen = []
    assert watch.poll(spark, shot(100), state, lambda d: seen.append(d.collect()[0].change)) == 1

    def fail(_):
        raise RuntimeError("build failed")

    with pytest.raises(RuntimeError):
        watch.poll(spark, shot(200), state, fail)
    assert watch.last_snapshot(spark, state)[1].first().size == 100
    assert watch.poll(spark, shot(200), state, lambda d: seen.append(d.collect()[0].change)) == 1
    assert watch.poll(spark, shot(200), state, fail) == 0
    assert seen == ["added", "modified"]


def test_streamed_ingest(spark, tmp_path):
    from tessera.streaming import watch

    source = f"{tmp_path}/in"
    spark.range(10).withColumn("v", F.col("id") * 2).write.parquet(source)
    stream = spark.readStream.schema("id long, v long").parquet(source)
    q = watch.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/cp", lambda b: b.filter("v > 5"))
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7


def test_file_sources(spark, tmp_path):
    from tessera.sources import files

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.PDF").write_bytes(b"one\fTwo\f  ")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    (tmp_path / "c.txt").write_text("x")
    found = files.scan_files(spark, str(tmp_path), content=True)
    assert found.count() == 2
    pages = files.pages_of(found, lambda b: b.decode().split("\f")).collect()
    assert sorted((p.page_num, p.text) for p in pages) == [(0, "one"), (1, "Two")]
    told = files.pages_of(found, lambda b: b.decode().split("\f"), with_errors=True).filter("error IS NOT NULL").collect()
    assert [(r.path.endswith("b.pdf"), r.page_num) for r in told] == [(True, -1)] and "UnicodeDecodeError" in told[0].error
    assert files.text_files(spark, str(tmp_path / "c.txt")).first().text == "x"


def test_embedding_holds_few_words_at_a_time(spark, monkeypatch):
    """Long texts of one batch become Python strings piece by piece, with the same vectors."""
    import tracemalloc

    import pyarrow as pa

    lists = pa.array([[f"w{i * 7 + j}" for j in range(400)] for i in range(500)] + [None, []])
    runs = list(text.pieces(lists, 1000))
    assert [r.start for r in runs] == [0, *[r.stop for r in runs[:-1]]] and runs[-1].stop == len(lists)
    assert all(sum(len(x or []) for x in lists[r.start : r.stop].to_pylist()) <= 1000 for r in runs)
    assert list(text.pieces(pa.array([["a"] * 9, ["b"], ["c"]]), 2)) == [slice(0, 1), slice(1, 3)]
    work = text.hash_embedding(8).func
    tracemalloc.start()
    got = work(lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(lists) and got[-1].as_py() == got[-2].as_py() == [0] * 8
    assert peak < 8 << 20  # all 200,000 words at once take more than 10 MB


def test_paper_functions(spark):
    r = one(spark, name=papers.safe_filename(F.lit('a: b?  "c"')), year=papers.extract_year(F.lit("x 12345 2019, 2020")), none=papers.extract_year(F.lit("no")), pid=papers.paper_id(F.lit(""), F.lit("  A  B ")))
    assert (r.name, r.year, r.none, r.pid) == ("a_b_c", 2019, None, "a b")


def test_empty_texts(spark):
    pages = spark.createDataFrame([(1, 0, None), (1, 1, ""), (2, 0, "short")], "d long, p int, t string")
    assert text.windows_of(text.carried_pages(pages, "d", "p", "t"), ["d", "p"]).count() == 0


def test_build_job(spark, tmp_path):
    """Files to generations: first build, nothing to do, append, modify, delete, compact and rebuild."""
    from tessera.functions import text as T
    from tessera.operators.build import build
    from tessera.sources import files

    root, folder = f"file://{tmp_path}/index", tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    page = lambda seed, n=300: " ".join(f"{seed}word{k * 37 % 101}" for k in range(n))
    for name, seed in (("a.pdf", "a"), ("b.pdf", "b"), ("sub/a.pdf", "c"), ("blank.pdf", "")):
        (folder / name).write_text(f"{page(seed)}\f{page(seed + 'x', 40)}" if seed else " ")
    planes, centre = V.halton_planes(16), np.zeros(16, np.int64)

    def listing():
        found = files.scan_files(spark, str(folder))
        return found.select(F.regexp_replace("path", f"^file:/*{str(folder).lstrip('/')}/", "").alias("filename"), F.col("size").alias("file_size"), F.unix_seconds("mtime").alias("last_write_time"))

    def read_pages(rows):
        found = files.scan_files(spark, str(folder), content=True)
        named = found.withColumn("filename", F.regexp_replace("path", f"^file:/*{str(folder).lstrip('/')}/", "")).join(rows.select("filename"), "filename", "left_semi")
        pages = files.pages_of(named.drop("path").withColumnRenamed("filename", "path"), lambda b: b.decode().split("\f"))
        return pages.withColumnRenamed("path", "filename")

    embed = lambda c: T.hash_embedding(16)(F.regexp_extract_all(F.lower(c), F.lit(T.WORD), F.lit(0)))
    run = lambda **options: build(spark, root, listing(), read_pages, embed, planes, centre, 1700000000000000000, SMALL, **options)
    open_ = lambda name: lifecycle.open_table(spark, root, name)
    catalog = lambda: {(r.filename, r.is_deleted) for r in open_("catalog").collect()}

    def sound():
        r, d = open_("records"), open_("directory")
        assert r.count() == d.agg(F.sum("record_count")).first()[0] == open_("texts").count() == r.select("chunk_id").distinct().count()
        assert d.agg(F.max("record_count")).first()[0] <= SMALL.extent_capacity
        live = {c.doc_id: c.chunk_count for c in open_("catalog").filter("NOT is_deleted").collect()}
        assert {c.doc_id: c["count"] for c in r.groupBy("doc_id").count().collect()} == live

    assert run() == 1
    assert catalog() == {("a.pdf", False), ("b.pdf", False), ("sub/a.pdf", False)}
    sound()
    (folder / "blank.pdf").unlink()
    assert run() == 1
    (folder / "new.pdf").write_text(page("n"))
    assert run() == 2 and ("new.pdf", False) in catalog()
    sound()
    (folder / "b.pdf").write_text(page("b", 200))
    (folder / "a.pdf").unlink()
    assert run() == 3 and catalog() == {("a.pdf", True), ("b.pdf", True), ("b.pdf", False), ("sub/a.pdf", False), ("new.pdf", False)}
    sound()
    before = open_("records").count()
    assert run(compact=True) == 4 and open_("records").count() == before
    sound()
    assert run(rebuild=True) == 5 and catalog() == {("b.pdf", False), ("sub/a.pdf", False), ("new.pdf", False)}
    sound()
    first = open_("catalog").filter("filename = 'new.pdf'").first().doc_id
    (folder / "new.pdf").unlink()
    assert run(delete=[first]) == 6 and ("new.pdf", True) in catalog()
    sound()
    again = open_("records")
    fresh = index.assign_extents(again.drop("extent_no"), SMALL, "chunk_id")
    assert again.select("chunk_id", "extent_no").exceptAll(fresh.select("chunk_id", "extent_no")).count() == 0


def test_numbers_are_consecutive(spark):
    from tessera.operators.build import numbered
    from tessera.session import Scratch

    got = numbered(spark.range(100, numPartitions=7).filter("id % 3 = 0"), Scratch(spark, "test-numbers"), 5)
    assert sorted(r.doc_id for r in got.collect()) == list(range(5, 39))


def test_state_and_telemetry(spark, tmp_path):
    from tessera.sources import state

    place, kind = f"{tmp_path}/papers", "id long, names array<string>"
    assert state.read_json(spark, place, kind).count() == 0
    state.replace_json(spark.createDataFrame([(1, ["a", "b"]), (2, None)], kind), place)
    state.replace_json(state.read_json(spark, place, kind).filter("id = 1"), place)
    assert [(r.id, r.names) for r in state.read_json(spark, place, kind).collect()] == [(1, ["a", "b"])]
    assert [p.name for p in tmp_path.iterdir()] == ["papers"]
    (tmp_path / "done.txt").write_text("one\n two \n\none\n")
    assert sorted(r.query for r in state.processed(spark, f"{tmp_path}/done.txt").collect()) == ["one", "two"]
    assert state.processed(spark, f"{tmp_path}/none.txt").count() == 0
    for n in range(4):
        state.write_run({"tally": spark.range(3).coalesce(1), "radii": spark.range(2).coalesce(1)}, f"{tmp_path}/runs", f"run_{n}")
    (tmp_path / "runs" / "run_0" / "run_meta").rename(tmp_path / "gone")
    (tmp_path / "runs" / "other").mkdir()
    least = state.run_files(spark, f"{tmp_path}/runs").filter("run = 'run_1'").first().files
    assert state.drop_runs(spark, f"{tmp_path}/runs", least, 2) == ["run_0", "run_1"]
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["other", "run_2", "run_3"]
    assert spark.read.json(f"{tmp_path}/runs/run_3/tally").count() == 3
    lines = spark.createDataFrame([("# x=1",), ("KEY = 'abcdefghijklmnopqrst'",), ("short=abc",), ("none",), ("short=a=b",)], "value string").coalesce(1)
    got = {r.name: (r.value, r.masked) for r in state.settings(lines).withColumn("masked", state.mask_secret(F.col("value"))).collect()}
    assert got == {"KEY": ("abcdefghijklmnopqrst", "abcdef...qrst"), "short": ("a=b", "***")}
