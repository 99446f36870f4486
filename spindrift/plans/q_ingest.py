"""Queries on ingest: parsers, ordered folds, dedup, limits, and their streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import timeexpr
from spindrift.functions.lines import owner, selected_labels, stream_key, workload_guess
from spindrift.operators import folds
from spindrift.operators.search import Selector
from spindrift.plans.views import LINES, log_lines, table
from spindrift.sources import push, runtime
from spindrift.streaming import ingest, scratch
from spindrift.streaming.tail import Bus, Subscriber

NOW = 1_700_000_000 * 10**9


def _raw(spark, d):
    """Runtime lines made of events, every 50th malformed."""
    n = F.col("event_id")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((n * 7919 % 1_000_000_000).cast("string"), 9, "0"), F.when(n % 4 == 0, "+02:00").otherwise("Z"))
    tag = F.when(n % 3 == 0, "P").when(n % 3 == 1, "F").otherwise("P:x:y")
    line = F.concat(stamp, F.when(n % 2 == 0, " stdout ").otherwise(" stderr "), tag, F.when(n % 10 == 0, "").otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit("  two words "), n.cast("string"))))
    return table(spark, d, "events").select(n.alias("seq"), F.when(n % 50 == 0, "garbage line").otherwise(line).alias("value"))


def cri_parse(spark, d):
    return runtime.parsed_lines(_raw(spark, d)).drop("value")


def cri_odd_tags(spark, d):
    """Tags of any letter, an empty stream, an empty tag (malformed) and none at all."""
    n = F.col("event_id")
    tag = F.when(n % 6 == 0, "X").when(n % 6 == 1, "P").when(n % 6 == 2, "Px:y").when(n % 6 == 3, "").when(n % 6 == 4, "fP").otherwise("F")
    stream = F.when(n % 4 == 0, "").when(n % 4 == 1, "stderr").otherwise("stdout")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), stream, F.when(n % 11 == 0, "").otherwise(F.concat(F.lit(" "), tag, F.lit(" m "), n.cast("string"))))
    return runtime.parsed_lines(table(spark, d, "events").select(n.alias("seq"), line.alias("value"))).drop("value")


def docker_json_parse(spark, d):
    n = F.col("event_id")
    log = F.concat(F.col("event_type"), F.lit(' "q" '), n.cast("string"), F.when(n % 3 == 0, "").otherwise("\n"))
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".5Z"))
    raw = table(spark, d, "events").select(n.alias("seq"), F.to_json(F.struct(log.alias("log"), F.when(n % 2 == 0, "stdout").otherwise("stderr").alias("stream"), time.alias("time"))).alias("value"))
    return raw.select("seq", runtime.line_fields(F.col("value")).alias("l")).filter("l is not null").select("seq", "l.*")


def path_parse(spark, d):
    n = F.col("event_id")
    end = F.when(n % 4 == 0, "").when(n % 4 == 1, ".20260930-101500").when(n % 4 == 2, ".20260930-101500.gz").otherwise(".txt")
    path = F.concat(F.lit("/var/log/pods/ns"), n % 3, F.when(n % 9 == 0, "/").otherwise("_"), F.lit("api-"), n % 5, F.lit("_uid"), n % 7, F.lit("/app/"), n % 4, F.lit(".log"), end)
    return table(spark, d, "events").select(n.alias("seq"), runtime.path_fields(path).alias("p")).filter("p is not null").select("seq", "p.*")


def collection_filter(spark, d):
    return runtime.collected(log_lines(spark, d), include_ns=["payments", "db"], exclude_ns=["db"], exclude_ctr=["sidecar"]).select("seq")


def section_carry_forward(spark, d):
    """Bodies of 40 events each, every 8th line a header, the first two before any."""
    n = F.col("event_id")
    head = F.concat(F.lit('{"k":"ns'), n % 2, F.lit("/pod/uid-"), n % 3, F.lit('/app","f":"f'), n % 5, F.lit('","o":['), n, F.lit(","), n + 8, F.lit('],"r":1}'))
    entry = F.concat(F.lit('{"t":'), n, F.lit(',"s":"'), F.when(n % 2 == 0, "o").otherwise("e"), F.lit('","m":"m'), n, F.lit('"}'))
    line = F.when(n % 8 == 2, head).when(n % 20 == 7, "").otherwise(entry)
    e = table(spark, d, "events").select(F.floor(n / 40).alias("body"), n.alias("n"), line.alias("line"))
    bodies = e.groupBy("body").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return push.entries(bodies).select("body", "pos", "ns", "uid", "file", "off_start", "off_end", "restart", "ended", "ts_ns", "stderr", "msg")


def _pieces(spark, d):
    """Lines of documents as pieces: odd ones and a document's last are whole."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.split("text", "\n").alias("l"))
    p = lines.select("file", F.size("l").alias("k"), F.posexplode("l").alias("off", "msg"))
    return p.select("file", F.col("off").cast("long").alias("off"), ((F.col("off") % 2 == 0) & (F.col("off") < F.col("k") - 1)).alias("partial"), F.col("off").cast("long").alias("ts_ns"), F.lit(False).alias("stderr"), "msg")


def partial_merge(spark, d):
    return folds.merge_partial(_pieces(spark, d)).select("file", "off", "n", F.md5(F.col("msg").cast("binary")).alias("md5"))


def partial_merge_limit(spark, d):
    """With a limit that every second piece passes, a partial pair is a line."""
    runs = _pieces(spark, d).withColumn("partial", F.lit(True))
    return folds.merge_partial(runs, max_bytes=1).select("file", "off", "n", F.md5(F.col("msg").cast("binary")).alias("md5"))


def _turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("off"), "role", F.coalesce("text", F.lit("")).alias("msg"))


def multiline_join(spark, d):
    return folds.join_multiline(_turns(spark, d), F.col("role") == "user").select("file", "off", "n", F.md5(F.col("msg").cast("binary")).alias("md5"))


def multiline_maxlines(spark, d):
    return folds.join_multiline(_turns(spark, d), F.col("role") == "system", max_lines=2).select("file", "off", "n", F.md5(F.col("msg").cast("binary")).alias("md5"))


def _cursors(spark, d):
    end = F.floor(F.col("value") * 10)
    return table(spark, d, "events").select(F.col("user_id").alias("sid"), F.lit("f").alias("file"), F.col("event_id").alias("seq"), F.greatest(end - 100, F.lit(0)).alias("off_start"), end.alias("off_end"))


def dedup_cursor(spark, d):
    return folds.accepted_sections(_cursors(spark, d)).select("sid", "seq", "off_end")


def running_cursor(spark, d):
    return _cursors(spark, d).groupBy("sid", "file").agg(F.max("off_end").alias("cursor"))


def dedup_distinct(spark, d):
    e = _cursors(spark, d)
    return e.unionByName(e.filter("seq % 3 = 0")).select("sid", "file", "off_start", "off_end").dropDuplicates(["sid", "file", "off_end"])


def restart_boundary(spark, d):
    lines = log_lines(spark, d).withColumn("restart", F.floor(F.col("seq") / 500).cast("int"))
    return folds.restart_boundaries(lines).select("sid", "seq", "before", "restart")


def rate_limit_markers(spark, d):
    lines = log_lines(spark, d).select(F.col("sid").alias("file"), "seq", (F.floor(F.col("seq") / 400) * 1_000_000_000).alias("ts_ns"))
    return folds.rate_limited(lines, 2).select("file", "seq", "dropped_before", "marker")


# Literal pods: name, owner kind, owner name.
PODS = [
    ("api-7d4b9c6f5-abcde", "ReplicaSet", "api-7d4b9c6f5"), ("job-28912345-xyz", "Job", "job-28912345"), ("once-1", "Job", "once"), ("proxy-east7", "Node", "east7"),
    ("web-0", "StatefulSet", "web"), ("agent-x", "DaemonSet", "agent"), ("bare", None, None), ("odd", "ReplicaSet", "my-app"),
]


def owner_label(spark, d):
    pods = spark.createDataFrame(PODS, "pod string, kind string, name string")
    return pods.select("pod", owner(F.col("pod"), F.col("kind"), F.col("name")).alias("owner"), workload_guess(F.col("pod")).alias("guess"))


def enrich_labels(spark, d):
    """Lines of a pod with its labels, as a left join on the pod's uid."""
    pods = spark.createDataFrame([(f"uid-{i}", {"app": f"a{i}", "team": "x", "other": "o"}, {"team": "noted"} if i % 2 else None) for i in range(8)], "uid string, l map<string,string>, a map<string,string>")
    dim = pods.select("uid", selected_labels(F.col("l"), F.col("a"), ["app", "team"], ["team"], F.lit("Pod/x")).alias("m"))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return log_lines(spark, d).select("seq", "uid").join(dim.withColumn("labels", text).drop("m"), "uid", "left")


TIMES = ["-15m", "-1h30m", "-7d", "-1.5d", "-2w", "now", "1700000000", "1700000000123", "1700000000123456", "1700000000123456789", "2026-10-04T10:00:00Z", "2026-10-04T10:00:00.5+02:00", "", "-7x", "-d", "yesterday", "--1h", "-5"]


def time_expressions(spark, d):
    return spark.createDataFrame([(t, timeexpr.parse_time(t, -1, NOW)) for t in TIMES], "text string, ns long")


def stream_key_split(spark, d):
    lines = log_lines(spark, d)
    key = F.concat_ws("/", *[F.col(c) for c in ("ns", "pod", "uid", "ctr")])
    key = F.when(F.col("seq") % 10 == 0, F.concat_ws("/", "ns", "pod", "uid")).when(F.col("seq") % 10 == 1, F.concat(key, F.lit("/more"))).otherwise(key)
    return lines.select("seq", stream_key(key).alias("k")).filter("k is not null").select("seq", "k.*")


def cluster_names(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "a/b").when(F.col("event_id") % 3 == 1, "").otherwise("prod").alias("c"))
    return e.select("event_id", push.valid_cluster(F.col("c")).alias("ok"))


def stream_dedup(spark, d):
    """The cursor dedup as a stream with state; in order of seq, as its batch twin."""
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    end = F.floor(F.col("value") * 10)
    s = e.select(F.col("user_id").alias("sid"), F.lit("f").alias("file"), F.col("event_id").alias("seq"), end.alias("off_end"))
    return ingest.collect_stream(ingest.exactly_once(s), scratch.fresh(spark, "dedup"), scratch.fresh(spark, "dedup-log")).select("sid", "seq", "off_end")


def stream_partial(spark, d):
    """Pairs of events of a user as pieces of a line: every odd one is whole."""
    lines = log_lines(spark, d, streaming=True).select(F.col("sid").cast("string").alias("file"), F.col("seq").alias("off"), (F.col("seq") % 3 != 0).alias("partial"), "msg")
    out = ingest.collect_stream(ingest.whole_lines(lines), scratch.fresh(spark, "whole"), scratch.fresh(spark, "whole-log"), with_open=True)
    return out.select("file", "off", "n", F.md5(F.col("msg").cast("binary")).alias("md5"))


def stream_multiline(spark, d):
    """Events that begin at a signup; those still open at the end are let go with it."""
    lines = log_lines(spark, d, streaming=True).select(F.col("sid").cast("string").alias("file"), F.col("seq").alias("off"), "msg")
    out = ingest.collect_stream(ingest.multiline_events(lines, '"level":"signup"', max_lines=5, quiet_ms=None), scratch.fresh(spark, "multi"), scratch.fresh(spark, "multi-log"), with_open=True)
    return out.select("file", "off", "n", F.md5(F.col("msg").cast("binary")).alias("md5"))


def stream_tail(spark, d):
    """What a subscriber gets of a stream, within its buffer."""
    bus = Bus()
    s = bus.subscribe(Subscriber(Selector(cluster="prod"), "purchase", capacity=300, per_batch=500))
    bus.start(log_lines(spark, d, streaming=True), scratch.fresh(spark, "tail-log"), once=True).awaitTermination()
    rows, _ = s.drain()
    return spark.createDataFrame([(r.seq, r.ts_ns) for r in rows], "seq long, ts_ns long")


def ingest_end_to_end(spark, d):
    """Events as lines of log files (one a user, every third line in two pieces), ingested twice: files to store, nothing twice, nothing lost."""
    from spindrift.operators.ingest_files import ingest_files

    root, store = scratch.fresh(spark, "logs"), scratch.fresh(spark, "ingested")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z stdout "))
    text = F.concat(F.when(F.col("event_type") == "signup", "* ").otherwise("  "), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"))
    piece = F.when(F.col("event_id") % 3 == 0, F.array(F.concat(stamp, F.lit("P "), text), F.concat(stamp, F.lit("F  end")))).otherwise(F.array(F.concat(stamp, F.lit("F "), text)))
    pod = F.concat(F.lit("n_p"), F.col("user_id").cast("string"), F.lit("_u"))
    e = table(spark, d, "events").select(pod.alias("pod"), "event_id", F.posexplode(piece).alias("k", "value"))
    runtime.write_files(e.select(F.concat("pod", F.lit("/app/0.log")).alias("file"), "value", "event_id", "k"), root, "event_id", "k")
    for batch in (0, 1):
        ingest_files(spark, root, store, batch, r"^\* ", cluster="c", max_lines=50)
    back = spark.read.parquet(store)
    return back.select(F.substring("pod", 2, 20).cast("long").alias("user_id"), "n", F.md5(F.col("msg").cast("binary")).alias("md5"), "ts_ns")


def stream_store(spark, d):
    """Lines through the streaming store and back: a count and bounds for each day."""
    from spindrift.functions.lines import day

    root = scratch.fresh(spark, "store")
    lines = log_lines(spark, d, streaming=True).withColumn("day", day(F.col("ts_ns"))).drop("labels")
    ingest.run_to_store(lines, root, scratch.fresh(spark, "store-log")).awaitTermination()
    back = spark.read.option("basePath", root).schema("batch long, day string, cluster string, ns string, seq long, ts_ns long, msg string").parquet(root)
    return back.groupBy("day", "cluster", "ns").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("min_ts"), F.max("seq").alias("max_seq"))


QUERIES = {
    f.__name__: f
    for f in (
        cri_parse, cri_odd_tags, docker_json_parse, path_parse, collection_filter, section_carry_forward, partial_merge, partial_merge_limit, multiline_join, multiline_maxlines, dedup_cursor, running_cursor,
        dedup_distinct, restart_boundary, rate_limit_markers, owner_label, enrich_labels, time_expressions, stream_key_split, cluster_names, ingest_end_to_end, stream_dedup, stream_partial, stream_multiline,
        stream_tail, stream_store,
    )
}

_STAMP = "epoch_us(date_trunc('second', ts)) * 1000"
_TURNS = "t as (select conv_id as file, turn as off, role, coalesce(text, '') as msg, row_number() over (partition by conv_id order by turn) as k from conversations)"
_GROUPED = "md5(string_agg(msg, chr(10) order by off)) as md5"
_CURSOR = "c as (select user_id as sid, 'f' as file, event_id as seq, floor(value * 10)::bigint as off_end from events)"

SQL = {
    "cri_parse": f"""select event_id as seq, {_STAMP} + event_id * 7919 % 1000000000 - case when event_id % 4 = 0 then 7200000000000 else 0 end as ts_ns, event_id % 2 = 1 as stderr, event_id % 3 <> 1 as partial,
        case when event_id % 10 = 0 then '' else event_type || '  two words ' || event_id end as msg from events where event_id % 50 <> 0""",
    "cri_odd_tags": f"""select event_id as seq, {_STAMP} as ts_ns, event_id % 4 = 1 as stderr, event_id % 6 in (1, 2) as partial, 'm ' || event_id as msg from events where event_id % 6 <> 3 and event_id % 11 <> 0""",
    "docker_json_parse": f"""select event_id as seq, {_STAMP} + 500000000 as ts_ns, event_id % 2 = 1 as stderr, event_id % 3 = 0 as partial, event_type || ' "q" ' || event_id as msg from events""",
    "path_parse": """select event_id as seq, 'ns' || (event_id % 3) as ns, 'api-' || (event_id % 5) as pod, 'uid' || (event_id % 7) as uid, 'app' as ctr, (event_id % 4)::int as restart,
        case when event_id % 4 = 0 then '' else '20260930-101500' end as rotated, event_id % 4 = 2 as gzip from events where event_id % 4 <> 3 and event_id % 9 <> 0""",
    "collection_filter": f"with {LINES} select seq from lines where ns = 'payments' and ctr <> 'sidecar'",
    "section_carry_forward": """with l as (select event_id as n, event_id // 40 as body, row_number() over (partition by event_id // 40 order by event_id) - 1 as pos, event_id % 8 = 2 as head, event_id % 20 = 7 and event_id % 8 <> 2 as blank from events),
        c as (select *, max(case when head then n end) over (partition by body order by n) as h from l)
        select body, pos::int as pos, 'ns' || (h % 2) as ns, 'uid-' || (h % 3) as uid, 'f' || (h % 5) as file, h as off_start, h + 8 as off_end, 1 as restart, false as ended, n as ts_ns, n % 2 = 1 as stderr, 'm' || n as msg
        from c where not head and not blank and h is not null""",
    "partial_merge": """with p as (select doc_id as file, unnest(string_split(text, chr(10))) as msg, generate_subscripts(string_split(text, chr(10)), 1) - 1 as off from documents)
        select file, (off // 2) * 2 as off, count(*)::int as n, md5(string_agg(msg, '' order by off)) as md5 from p group by file, off // 2""",
    "multiline_join": f"""with {_TURNS}, g as (select *, sum((role = 'user')::int) over (partition by file order by off) as g from t)
        select file, min(off) as off, count(*)::int as n, {_GROUPED} from g group by file, g""",
    "multiline_maxlines": f"""with {_TURNS}, g as (select *, sum((role = 'system')::int) over (partition by file order by off) as g from t),
        s as (select *, (row_number() over (partition by file, g order by off) - 1) // 2 as s from g)
        select file, min(off) as off, count(*)::int as n, {_GROUPED} from s group by file, g, s""",
    "dedup_cursor": f"with {_CURSOR} select sid, seq, off_end from (select *, coalesce(max(off_end) over (partition by sid order by seq rows between unbounded preceding and 1 preceding), 0) as b from c) where off_end > b",
    "running_cursor": f"with {_CURSOR} select sid, file, max(off_end) as cursor from c group by sid, file",
    "dedup_distinct": f"with {_CURSOR} select distinct sid, file, greatest(off_end - 100, 0) as off_start, off_end from c",
    "restart_boundary": f"""with {LINES}, r as (select sid, seq, ts_ns, (seq // 500)::int as restart from lines)
        select sid, seq, before, restart from (select *, lag(restart) over (partition by sid order by ts_ns, seq) as before from r) where before <> restart""",
    "rate_limit_markers": f"""with {LINES}, l as (select sid as file, seq, seq // 400 as s from lines), r as (select *, row_number() over (partition by file, s order by seq) <= 2 as ok from l),
        d as (select *, sum((not ok)::int) over (partition by file order by s, seq) as d from r),
        x as (select file, seq, (d - coalesce(lag(d) over (partition by file order by s, seq), 0))::bigint as dropped_before from d where ok)
        select file, seq, dropped_before, case when dropped_before > 0 then 'dropped ' || dropped_before || ' lines (rate limit)' end as marker from x""",
    "owner_label": """select * from (values ('api-7d4b9c6f5-abcde', 'Deployment/api', 'api-7d4b9c6f5-abcde'), ('job-28912345-xyz', 'CronJob/job', 'job-28912345-xyz'), ('once-1', 'Job/once', 'once'), ('proxy-east7', 'Pod/proxy', 'proxy-east7'),
        ('web-0', 'StatefulSet/web', 'web'), ('agent-x', 'DaemonSet/agent', 'agent-x'), ('bare', 'Pod/bare', 'bare'), ('odd', 'Deployment/my-app', 'odd')) as v(pod, owner, guess)""",
    "enrich_labels": f"""with {LINES} select seq, uid, case when right(uid, 1)::int < 8 then '_owner=Pod/x,app=a' || right(uid, 1) || ',team=' || case when right(uid, 1)::int % 2 = 1 then 'noted' else 'x' end end as labels from lines""",
    "time_expressions": f"""select * from (values ('-15m', {NOW} - 900000000000), ('-1h30m', {NOW} - 5400000000000), ('-7d', {NOW} - 604800000000000), ('-1.5d', {NOW} - 129600000000000), ('-2w', {NOW} - 1209600000000000), ('now', {NOW}),
        ('1700000000', 1700000000000000000), ('1700000000123', 1700000000123000000), ('1700000000123456', 1700000000123456000), ('1700000000123456789', 1700000000123456789), ('2026-10-04T10:00:00Z', 1791108000000000000),
        ('2026-10-04T10:00:00.5+02:00', 1791100800500000000), ('', -1), ('-7x', -1), ('-d', -1), ('yesterday', -1), ('--1h', -1), ('-5', -5000000000)) as v(text, ns)""",
    "stream_key_split": f"with {LINES} select seq, ns, pod, uid, ctr || case when seq % 10 = 1 then '/more' else '' end as ctr from lines where seq % 10 <> 0",
    "cluster_names": "select event_id, event_id % 3 = 2 as ok from events",
    "stream_partial": f"""with {LINES}, g as (select *, coalesce(sum((seq % 3 = 0)::int) over (partition by sid order by seq rows between unbounded preceding and 1 preceding), 0) as g from lines)
        select sid::varchar as file, min(seq) as off, count(*) as n, md5(string_agg(msg, '' order by seq)) as md5 from g group by sid, g""",
    "stream_multiline": f"""with {LINES}, g as (select *, sum(contains(msg, '"level":"signup"')::int) over (partition by sid order by seq) as g from lines),
        s as (select *, (row_number() over (partition by sid, g order by seq) - 1) // 5 as s from g), e as (select sid, g, s, min(seq) as off, count(*) as n, md5(string_agg(msg, chr(10) order by seq)) as md5 from s group by 1, 2, 3)
        select sid::varchar as file, off, n, md5 from e""",
    "ingest_end_to_end": """with l as (select user_id, event_id, epoch_us(date_trunc('second', ts)) * 1000 as ts_ns, event_type = 'signup' as start,
          case when event_type = 'signup' then '* ' else '  ' end || event_type || ' ' || event_id || case when event_id % 3 = 0 then ' end' else '' end as msg from events),
        g as (select *, sum(start::int) over (partition by user_id order by event_id) as g from l), s as (select *, (row_number() over (partition by user_id, g order by event_id) - 1) // 50 as s from g)
        select user_id, count(*) as n, md5(string_agg(msg, chr(10) order by event_id)) as md5, arg_min(ts_ns, event_id) as ts_ns from s group by user_id, g, s""",
    "stream_tail": f"with {LINES} select seq, ts_ns from lines where cluster = 'prod' and contains(lower(msg), 'purchase') order by ts_ns desc, seq desc limit 300",
    "stream_store": f"with {LINES} select strftime(make_timestamp(ts_ns // 1000), '%Y%m%d') as day, cluster, ns, count(*) as n, min(ts_ns) as min_ts, max(seq) as max_seq from lines group by all",
}
SQL["partial_merge_limit"] = SQL["partial_merge"]
SQL["stream_dedup"] = SQL["dedup_cursor"]
