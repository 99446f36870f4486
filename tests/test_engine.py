"""Ingest, catalog, storage and streaming on small fixtures; every registered query against DuckDB."""

from __future__ import annotations

import gzip
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from spindrift.functions.filters import matches
from spindrift.functions.lines import day, owner, selected_labels
from spindrift.operators import catalog, folds, retention, search, skipping
from spindrift.plans import catalogue
from spindrift.sources import push, runtime
from spindrift.sources.follow import FollowSource
from spindrift.streaming import ingest
from spindrift.streaming.tail import Bus, Subscriber

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations pages labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = duck.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    want = sorted((tuple(norm(r[cols.index(c)]) for c in order) for r in got.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_cri_lines(spark):
    cases = {
        "2023-03-04T05:06:07.123456789Z stdout P:q first half": (123456789, False, True, "first half"),
        "2023-03-04T05:06:07.25Z stderr F": (25 * 10**7, True, False, ""),
        "2023-03-04T07:06:07+02:00 stdout F  spaced  out ": (0, False, False, " spaced  out "),
        "2023-03-04T05:06:07Z stdout X any tag": (0, False, False, "any tag"),
        "2023-03-04T05:06:07Z  Pq no stream": (0, False, True, "no stream"),
        "2023-03-04T05:06:07.1234567891Z weird F m": (123456789, False, False, "m"),
        "2023-03-04T05:06:07Z stdout  no tag": None,
        "2023-03-04T05:06:07Z stdout": None,
        "2023-13-04T05:06:07Z stdout F bad month": None,
        "nonsense": None,
        "": None,
    }
    at = 1677906367 * 10**9
    df = spark.createDataFrame([(c,) for c in cases], "value string")
    got = [tuple(r.l) if r.l else None for r in df.select(runtime.line_fields(F.col("value")).alias("l")).collect()]
    assert got == [w and (at + w[0], *w[1:]) for w in cases.values()]
    whole = {r.value: (r.ts_ns - at, r.stderr, r.partial, r.msg) for r in runtime.parsed_lines(df).collect()}
    assert whole == {c: w for c, w in cases.items() if w}
    plan = runtime.parsed_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1
    j = spark.createDataFrame([('{"log":"say \\"hi\\"\\n","stream":"stderr","time":"2023-03-04T05:06:07.000000042Z"}',), ("{half",)], "v string")
    first, second = (r[0] for r in j.select(runtime.line_fields(F.col("v"))).collect())
    assert (first.msg, first.stderr, first.partial, first.ts_ns) == ('say "hi"', True, False, at + 42) and second is None


def _write_logs(root, lines: dict[str, list[str]]) -> None:
    for name, texts in lines.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with gzip.open(path, "wt") if name.endswith(".gz") else path.open("w") as f:
            f.writelines(t + "\n" for t in texts)


def test_log_directory(spark, tmp_path):
    line = "2024-02-03T04:05:0{}Z stdout F said {}"
    _write_logs(tmp_path / "logs", {
        "shop_cart-9_id7/web/1.log": [line.format(6, "c"), line.format(7, "dd")], "shop_cart-9_id7/web/1.log.20240203-040506": [line.format(5, "b")],
        "shop_cart-9_id7/web/1.log.20240202-040506.gz": [line.format(4, "a")], "other/z.log": [line.format(1, "none")],
    })
    got = runtime.read_logs(spark, str(tmp_path / "logs")).orderBy(runtime.file_order(F.col("rotated")), "ts_ns").collect()
    assert [(r.ns, r.pod, r.uid, r.ctr, r.restart, r.gzip, r.msg) for r in got] == [("shop", "cart-9", "id7", "web", 1, z, f"said {m}") for z, m in ((True, "a"), (False, "b"), (False, "c"), (False, "dd"))]
    placed = {r.msg: (r.off_start, r.off_end) for r in runtime.read_logs_at(spark, str(tmp_path / "logs")).collect()}
    n = len(line.format(6, "c")) + 1
    assert placed == {"said a": (0, n), "said b": (0, n), "said c": (0, n), "said dd": (n, 2 * n + 1)}


def test_push_bodies(spark):
    body = '{"t":0,"s":"o","m":"lost"}\n{"k":"pay/api/u/app","f":"f1","o":[0,100],"r":2,"l":{"a":"b"}}\n{"t":1,"s":"e","m":"x"}\n\n{"t":2,"s":"o","m":"y"}\n{"k":"bad/key","f":"f","o":[0,1]}\n{"t":3,"s":"o","m":"z"}'
    got = push.entries(spark.createDataFrame([("b", body)], "body string, text string")).orderBy("pos").collect()
    assert [(r.ns, r.file, r.off_end, r.restart, r.labels, r.ts_ns, r.stderr, r.msg) for r in got] == [("pay", "f1", 100, 2, {"a": "b"}, 1, True, "x"), ("pay", "f1", 100, 2, {"a": "b"}, 2, False, "y")]
    sections = spark.sql("select 'b' as body, 0 as section, 'n/p/u/c' as k, 'f' as f, array(0L, 9L) as o, 0 as r, false as end, map('a', 'b') as l, array(named_struct('t', 1L, 's', 'o', 'm', 'q\"')) as entries")
    again = push.entries(push.encode(sections)).first()
    assert (again.pod, again.msg, again.off_end) == ("p", 'q"', 9)


def test_partial_merge(spark):
    piece = "ab" * 5000
    df = spark.createDataFrame([(1, 0, True, piece), (1, 1, True, piece), (1, 2, True, "mid"), (1, 3, False, "end"), (1, 4, False, "alone"), (1, 5, True, "open"), (2, 0, False, "")], "file int, off int, partial boolean, msg string")
    df = df.withColumns({"ts_ns": F.col("off"), "stderr": F.lit(False)})
    key = lambda d: sorted((r.file, r.off, r.n, len(r.msg)) for r in d.collect())
    assert key(folds.merge_partial(df)) == [(1, 0, 4, 20006), (1, 4, 1, 5), (1, 5, 1, 4), (2, 0, 1, 0)]
    assert key(folds.merge_partial(df, max_bytes=100)) == [(1, 0, 2, 20000), (1, 2, 2, 6), (1, 4, 1, 5), (1, 5, 1, 4), (2, 0, 1, 0)]


def test_multiline(spark):
    rows = ["\tlead", "2026 boom", "\tat a", "\tat b", "2026 next", "\tc", "\td", "\te"]
    df = spark.createDataFrame([("f", i, m) for i, m in enumerate(rows)], "file string, off int, msg string")
    got = folds.join_multiline(df, F.col("msg").rlike("^2026"), max_lines=3).orderBy("off").collect()
    assert [r.msg for r in got] == ["\tlead", "2026 boom\n\tat a\n\tat b", "2026 next\n\tc\n\td", "\te"]


def test_owner_and_labels(spark):
    df = spark.createDataFrame([({"app": "a", "x": "1"}, {"app": "noted"})], "l map<string,string>, a map<string,string>")
    pod = owner(F.lit("proxy-e7"), F.lit("Node"), F.lit("e7"))
    assert df.select(selected_labels(F.col("l"), F.col("a"), ["app", "x", "none"], ["app"], pod)).first()[0] == {"_owner": "Pod/proxy", "app": "noted", "x": "1"}
    assert df.select(selected_labels(F.lit(None).cast("map<string,string>"), F.col("a"), ["app"], [], pod)).first()[0] == {"_owner": "Pod/proxy"}


def test_cursor_dedup(spark):
    rows = [(1, "f", 0, 100), (1, "f", 1, 100), (1, "f", 2, 200), (1, "f", 3, 150), (1, "g", 4, 50), (2, "f", 5, 0)]
    df = spark.createDataFrame(rows, "sid int, file string, seq int, off_end int")
    assert sorted(r.seq for r in folds.accepted_sections(df).collect()) == [0, 2, 4]


def test_streams_and_tree(spark):
    cols = "cluster string, ns string, pod string, uid string, ctr string, node string, restart int, min_ts long, max_ts long, ended boolean, labels map<string,string>, seq int"
    rows = [("c", "n", "p", "u", "a", "n1", 2, 10, 50, False, {"k": "1"}, 1), ("c", "n", "p", "u", "a", "", 1, 0, 40, True, None, 2), ("c", "n", "p", "u", "b", "n2", 0, 0, 60, False, {}, 3)]
    s = catalog.streams_of(spark.createDataFrame(rows, cols))
    a, b = s.orderBy("ctr").collect()
    assert (a.restarts, a.first_ts, a.last_ts, a.ended, a.node, a.labels) == (2, 10, 50, True, "n1", {"k": "1"})
    assert (b.first_ts, b.ended) == (0, False)
    t = catalog.pod_tree(s).first()
    assert (t.restarts, t.last_ts, t.live, t.node, t.labels, t.containers) == (2, 60, False, "n2", {"k": "1"}, ["a", "b"])
    assert catalog.tree(s).first().namespaces[0].pods[0].pod == "p"


def test_paging_loses_nothing(spark):
    df = spark.createDataFrame([(i, 100 + i // 7, f"m{i}") for i in range(50)], "seq int, ts_ns long, msg string")
    seen, rest = [], df
    while True:
        p = search.page(rest, 6)
        seen += [r.seq for r in p.rows]
        if not p.truncated:
            break
        assert p.next_end == p.rows[-1].ts_ns - 1
        rest = search.before(df, *p.cursor)
    assert seen == list(range(49, -1, -1))
    assert not search.page(df, 50).truncated


def test_store_prunes_days_and_reruns_in_place(spark, tmp_path):
    lines = spark.range(200).select(
        F.col("id").alias("seq"), (F.col("id") * 3600 * 10**9).alias("ts_ns"), F.lit("c").alias("cluster"), F.lit("n").alias("ns"), F.lit("p").alias("pod"), F.lit("u").alias("uid"), F.lit("a").alias("ctr"), F.lit("m").alias("msg")
    ).withColumn("day", day(F.col("ts_ns")))
    root = str(tmp_path / "store")
    for _ in range(2):
        ingest.store_batch(lines, 0, root)
    ingest.store_batch(lines.withColumn("seq", F.col("seq") + 1000), 1, root)
    back = spark.read.parquet(root)
    assert back.count() == 400
    found = search.in_range(back.withColumn("day", F.col("day").cast("string")), 0, 3600 * 10**9)
    assert found.count() == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [(cast(day" in plan
    assert retention.drop_partitions(spark, root, [{"day": "19700101"}, {"day": "20990101"}]) == 1
    assert spark.read.parquet(root).count() == 352
    files = lambda: sum(len(n) for _, _, n in os.walk(root))
    before, said = files(), sorted((r.seq, r.ts_ns) for r in spark.read.parquet(root).collect())
    for d in ("19700102", "19700103"):
        ingest.compact_day(spark, root, d)
    assert sorted((r.seq, r.ts_ns) for r in spark.read.parquet(root).collect()) == said and files() < before


def test_skipping_is_sound(spark, tmp_path):
    rows = [("f1", "upstream timeout after 900ms"), ("f1", "ÜBER weit"), ("f2", "healthz ok a_b9"), ("f3", "x y"), ("f3", None)]
    df = spark.createDataFrame(rows, "file string, msg string")
    table = skipping.trigram_table(df)
    kept = lambda q: {r.file for r in skipping.candidates(table, q).collect()}
    assert kept("TIMEOUT") == {"f1"} and kept("über") == {"f1"} and kept("a_b9 health") == {"f2"} and kept("timeout healthz") == set()
    assert kept("x") == {"f1", "f2"} and kept("/timeout/") == {"f1", "f2"}  # nothing decided: all files of the table
    for q in ("out", "900m", "weit", '"ok a_b9"', "stream time"):
        assert {r.file for r in df.filter(matches("msg", q)).collect()} <= kept(q)
    df.filter("file = 'f1'").write.parquet(str(tmp_path / "f1"))
    at = skipping.trigram_table(df.withColumn("file", F.concat(F.lit(f"{tmp_path}/"), "file")))
    assert skipping.read_candidates(spark, at, "timeout", df.schema).count() == 2
    assert skipping.read_candidates(spark, at, "qqqzzz", df.schema).count() == 0


def _run(spark, stream, tmp_path, name):
    return ingest.collect_stream(stream, str(tmp_path / name), str(tmp_path / f"{name}-log"))


def test_follow_grows_rotates_and_resumes(spark, tmp_path):
    spark.dataSource.register(FollowSource)
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\npend")
    run = lambda: sorted((r.off_start, r.value) for r in _run(spark, spark.readStream.format("follow").option("path", f"{tmp_path}/*.log").load(), tmp_path, "follow").collect())
    assert run() == [(0, "one"), (4, "two")]
    with log.open("a") as f:
        f.write("ing\nthree\n")
    assert run() == [(0, "one"), (4, "two"), (8, "pending"), (16, "three")]
    log.write_text("fresh\n")
    assert run()[:2] == [(0, "fresh"), (0, "one")]


def test_follow_reads_the_rest_of_a_rotated_file(spark, tmp_path):
    spark.dataSource.register(FollowSource)
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\n")
    source = lambda: spark.readStream.format("follow").option("path", f"{tmp_path}/*.log").option("maxbytes", 5).load()
    run = lambda: sorted((os.path.basename(r.path), r.off_start, r.value) for r in _run(spark, source(), tmp_path, "rest").collect())
    assert run() == [("a.log", 0, "one"), ("a.log", 4, "two")]
    with log.open("a") as f:
        f.write("a third line that is long\n4\n")
    log.rename(tmp_path / "a.log.20260930-101500")
    once = [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 8, "a third line that is long"), ("a.log", 34, "4")]
    assert run() == once
    log.write_text("new\n")
    assert run() == sorted([*once, ("a.log", 0, "new")])


def test_search_does_not_open_what_trigrams_rule_out(spark, tmp_path):
    rows = [(d, f"c{c}", "n", 0, 10**18 + i, i, f"line with {'needle' if (d, c) == ('20010909', 1) else 'straw'} {i}") for i, (d, c) in enumerate((d, c) for d in ("20010909", "20010910") for c in range(3) for _ in range(4))]
    rows += [("20010909", "c9", None, 0, 10**18, 99, "an unnamed needle"), ("20010909", "c8", "n", 1, 10**18, 100, "a needle the table lacks")]
    lines = spark.createDataFrame(rows, "day string, cluster string, ns string, batch int, ts_ns long, seq long, msg string")
    lines.write.partitionBy(*search.STORE_UNIT).option("compression", "zstd").parquet(str(tmp_path / "store"))
    store = spark.read.schema(lines.schema).parquet(str(tmp_path / "store"))
    skip = skipping.trigram_table(store.filter("batch = 0 and ns is not null"), search.STORE_UNIT)
    found = lambda q, s: sorted(r.seq for r in search.search(store, search.Selector(), 10**18, 10**18 + 10**12, q, skip=s).collect())
    for q in ("needle", "straw", "!needle", "", "ne", "absent"):
        assert found(q, skip) == found(q, None), q
    assert len(found("needle", skip)) == 6
    out = {(r.day, r.cluster) for r in skipping.ruled_out(skip, "needle", search.STORE_UNIT).collect()}
    assert len(out) == 5 and ("20010909", "c1") not in out
    plan = search.search(store, search.Selector(), 10**18, 10**18 + 10**12, "needle", skip=skip)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert skipping.ruled_out(skip, "ne", search.STORE_UNIT) is None


def test_page_within_a_scan_budget(spark):
    rows = [("20010909", 1, 10**18 + i, i, "old") for i in range(5)] + [("20010910", 1, 10**18 + 86_400 * 10**9 + i, 5 + i, "new") for i in range(5)]
    lines = spark.createDataFrame(rows, "day string, sid long, ts_ns long, seq long, msg string").withColumn("restart", F.lit(0))
    days = lambda most: catalog.days_in_budget(catalog.chunks_of(lines), 0, 2 * 10**18, most)
    page = lambda n, most: search.page_within(lines.select("day", "ts_ns", "seq"), days(most), n)
    seqs = lambda p: [r.seq for r in p.rows]
    assert (seqs(p := page(5, 1)), p.truncated) == ([9, 8, 7, 6, 5], False)
    assert (seqs(p := page(7, 1)), p.truncated) == ([9, 8, 7, 6, 5], True)
    assert (seqs(p := page(7, 10**6)), p.truncated) == ([9, 8, 7, 6, 5, 4, 3], True)
    assert (seqs(p := page(10, 10**6)), p.truncated) == ([9, 8, 7, 6, 5, 4, 3, 2, 1, 0], False)
    assert page(3, 10**6).truncated and days(0).filter("scanned").count() == 1


def test_stream_restarts_exactly_once(spark, tmp_path):
    """Resent files after a restart add nothing; new ones add what is new."""
    schema = "sid long, file string, seq long, off_start long, off_end long"
    src = tmp_path / "in"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / name))
    run = lambda: sorted(r.seq for r in _run(spark, ingest.exactly_once(spark.readStream.schema(schema).parquet(f"{src}/*")), tmp_path, "once").collect())
    put("a", [(1, "f", 0, 0, 100), (1, "f", 1, 100, 200), (2, "f", 2, 0, 10)])
    assert run() == [0, 1, 2]
    put("b", [(1, "f", 3, 0, 100), (1, "f", 4, 150, 250), (1, "g", 5, 0, 5)])
    assert run() == [0, 1, 2, 4, 5]


def test_ingest_of_files_end_to_end(spark, tmp_path):
    """Partial pieces, multi-line events, a second run with what is new, and a rotated file; nothing twice, nothing lost."""
    from spindrift.operators.ingest_files import ingest_files

    at = "2024-02-03T04:05:{:02d}Z stdout {} {}"
    app = "shop_cart-9_id7/web/0.log"
    root, store = tmp_path / "logs", str(tmp_path / "store")
    first = [at.format(1, "F", "* start"), at.format(2, "P", "  one "), at.format(3, "F", "line"), at.format(4, "F", "* next"), "broken"]
    _write_logs(root, {app: first})
    run = lambda n: ingest_files(spark, f"{root}", store, n, r"^\*", cluster="c")
    said = lambda: sorted((r.off_start, r.n, r.msg) for r in spark.read.parquet(store).collect())
    run(0)
    assert [(n, m) for _, n, m in said()] == [(2, "* start\n  one line"), (1, "* next")]
    once = said()
    run(1)
    assert said() == once
    _write_logs(root, {app: first + [at.format(5, "F", "* third"), at.format(6, "F", " more")], "shop_cart-9_id7/web/0.log.20240101-000000": [at.format(0, "F", "* old")]})
    run(2)
    assert sorted(m for _, _, m in said()) == ["* next", "* old", "* start\n  one line", "* third\n more"]


def test_files_are_written_by_the_tasks(spark, tmp_path):
    """Whole files in order, none on the driver; rows without a file or a value are no line, and no hidden file stays."""
    rows = [(f"a_p{k}_u/app/0.log", i, f"{k} {i} é") for i in range(9, -1, -1) for k in range(50)] + [("a_p0_u/app/0.log", 4, None), (None, 1, "x")]
    runtime.write_files(spark.createDataFrame(rows, "file string, i int, value string").repartition(4), f"file://{tmp_path}/logs", "i")
    files = [p for p in (tmp_path / "logs").rglob("*") if p.is_file()]
    assert sorted(str(p.relative_to(tmp_path / "logs")) for p in files) == sorted(f"a_p{k}_u/app/0.log" for k in range(50))
    assert (tmp_path / "logs/a_p7_u/app/0.log").read_text() == "".join(f"7 {i} é\n" for i in range(10))


def test_ingest_lists_many_folders_in_few_tasks_and_folds_once(spark, tmp_path):
    """200 folders: a few listing tasks, one scan and no join of the folds; settings as before; a run without news opens no file."""
    from spindrift.operators import ingest_files as ing

    at = "2024-02-03T04:05:06Z stdout F "
    _write_logs(tmp_path / "logs", {f"shop_p{i}_u/app/0.log": [f"{at}* {i}", f"{at}  more"] for i in range(200)})
    keys = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes")
    before, tracker, store = [spark.conf.get(k) for k in keys], spark.sparkContext.statusTracker(), str(tmp_path / "store")
    spark.sparkContext.setJobGroup("many", "many")
    ing.ingest_files(spark, str(tmp_path / "logs"), store, 0, r"^\*", cluster="c")
    stages = {s for j in tracker.getJobIdsForGroup("many") for s in tracker.getJobInfo(j).stageIds}
    assert max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) <= 4 * spark.sparkContext.defaultParallelism
    plan = ing.events_of(runtime.read_logs_at(spark, str(tmp_path / "logs")), r"^\*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Join" not in plan
    assert [spark.conf.get(k) for k in keys] == before
    assert spark.read.parquet(store).filter("n = 2").count() == 200
    assert ing._with_news(spark, str(tmp_path / "logs"), ing.cursors(spark, store)) == []
    (tmp_path / "logs/shop_p3_u/app/0.log").open("a").write(f"{at}* late\n")
    (news,) = ing._with_news(spark, str(tmp_path / "logs"), ing.cursors(spark, store))
    assert news.endswith("/shop_p3_u/app/0.log")
    ing.ingest_files(spark, str(tmp_path / "logs"), store, 1, r"^\*", cluster="c")
    assert spark.read.parquet(store).count() == 201


def test_open_groups_are_let_go_at_the_end(spark, tmp_path):
    rows = [("f", 0, "* a"), ("f", 1, "b"), ("f", 2, "* c"), ("f", 3, "d"), ("g", 0, "x")]
    spark.createDataFrame(rows, "file string, off long, msg string").coalesce(1).write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("file string, off long, msg string").parquet(str(tmp_path / "in"))
    out = ingest.collect_stream(ingest.multiline_events(lines, r"^\*", quiet_ms=None), str(tmp_path / "o"), str(tmp_path / "l"), with_open=True)
    assert sorted((r.file, r.off, r.n, r.msg) for r in out.collect()) == [("f", 0, 2, "* a\nb"), ("f", 2, 2, "* c\nd"), ("g", 0, 1, "x")]


def test_token_bucket(spark, tmp_path):
    schema = "cluster string, ts_ns long, seq long, bytes long"
    rows = [("c", 0, 0, 150), ("c", 0, 1, 10), ("c", 10**9, 2, 10), ("c", 60 * 10**9, 3, 10), ("d", 0, 4, 1)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = _run(spark, ingest.limited(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 100), tmp_path, "bucket")
    assert {r.seq: r.allowed for r in got.collect()} == {0: True, 1: False, 2: True, 3: True, 4: True}


def test_tail_drops_and_counts(spark):
    df = spark.createDataFrame([(i, i, f"m{i}") for i in range(20)], "seq long, ts_ns long, msg string")
    bus = Bus(most=2)
    small = bus.subscribe(Subscriber(search.Selector(), "m", capacity=5, per_batch=8))
    none = bus.subscribe(Subscriber(search.Selector(), "!m"))
    with pytest.raises(RuntimeError):
        bus.subscribe(Subscriber(search.Selector()))
    bus.publish(df)
    rows, dropped = small.drain()
    assert [r.seq for r in rows] == [15, 16, 17, 18, 19] and dropped == 15
    assert none.drain() == ([], 0) and small.drain() == ([], 0)


def test_top_k_is_planned_without_a_sort(spark):
    plan = catalogue.flagship(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "Python" not in plan
    assert "props" not in plan.split("ReadSchema")[-1]
