"""Queries on lines: filters, selectors, ranges, top-k, paging, export, federation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions.filters import matches
from spindrift.functions.lines import day, rfc3339, truncated
from spindrift.operators import search as S
from spindrift.operators import skipping
from spindrift.plans.views import LINES, log_lines, table

NS = 10**9
START, END = 1704412800 * NS, 1705276800 * NS  # 2024-01-05 to 2024-01-15, UTC
NAME = "concat_ws('/', cluster, ns, pod, ctr)"
RFC = "strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S') || case when ts_ns % 1000000000 = 0 then '' else '.' || rtrim(lpad((ts_ns % 1000000000)::varchar, 9, '0'), '0') end || 'Z'"

# name -> (filter text, the same predicate in SQL)
FILTERS = {
    "filter_word": ("PURCHASE", "contains(lower(msg), 'purchase')"),
    "filter_not_word": ("!purchase", "not contains(lower(msg), 'purchase')"),
    "filter_phrase": ('"view on /v1"', "contains(lower(msg), 'view on /v1')"),
    "filter_regex": (r"/cents\":1\d{2,3},.*(click|view)/", r"""regexp_matches(msg, '(?i)cents":1\d{2,3},.*(click|view)')"""),
    "filter_regex_end": (r"/[[:alpha:]]+\"\}$/", r"""regexp_matches(msg, '(?i)[[:alpha:]]+"\}$')"""),
    "filter_regex_invalid_noop": ("/(unclosed/ error", "contains(lower(msg), 'error')"),
    "filter_kv": ("level=ERROR", "lower(json_extract_string(msg, '$.level')) = 'error'"),
    "filter_not_kv": ("!level=error", "not coalesce(lower(json_extract_string(msg, '$.level')) = 'error', false)"),
    "filter_kv_number": ("user=42", "json_extract_string(msg, '$.user') = '42'"),
    "filter_kv_missing": ("absent=1", "false"),
    "filter_conjunction": (
        r'error !healthz level=error "on /v1" /v1.error/',
        r"""contains(lower(msg), 'error') and not contains(lower(msg), 'healthz') and json_extract_string(msg, '$.level') = 'error'
            and contains(lower(msg), 'on /v1') and regexp_matches(msg, '(?i)v1.error')""",
    ),
    "filter_path_as_regex": ("/v1/click", "regexp_matches(msg, '(?i)v1') and contains(lower(msg), 'click')"),
    "filter_empty": ("", "true"),
}

ROLE = S.Role(clusters=["prod", "edge-*"], namespaces=["pay*"])
# name -> (selector, the same predicate in SQL)
SELECTORS = {
    "sel_exact": (S.Selector(cluster="prod", ns="payments"), "cluster = 'prod' and ns = 'payments'"),
    "sel_exact_case": (S.Selector(cluster="PROD"), "cluster = 'PROD'"),
    "sel_glob": (S.Selector(pod="API-*", ns="*a*"), "pod ilike 'api-%' and ns ilike '%a%'"),
    "sel_glob_literal": (S.Selector(pod="api_*"), r"pod ilike 'api\_%' escape '\'"),
    "sel_uid": (S.Selector(uid="uid-3"), "uid = 'uid-3'"),
    "sel_sids": (S.Selector(sids=["7", "x", "42"]), "sid in (7, 42)"),
    "sel_sids_none": (S.Selector(sids=["notanumber"]), "false"),
    "sel_label": (S.Selector(labels=["app=api", "team:pay"]), "paid"),
    "sel_role_scope": (S.Selector(role=ROLE), "(cluster like 'prod' or cluster like 'edge-%') and ns like 'pay%'"),
}


def flagship(spark, sf_dir):
    """Newest 100 lines of the production API pods in ten days that match a filter."""
    sel = S.Selector(cluster="prod", pod="api-*")
    found = S.search(log_lines(spark, sf_dir), sel, START, END, "error !healthz level=error")
    return S.newest(found, 100).select("seq", "ts_ns", "cluster", "ns", "pod", "ctr", "stderr", "restart", "msg")


def _filter(q, exact=False):
    return lambda spark, d: log_lines(spark, d).filter(matches("msg", q, exact)).select("seq", "msg")


def _selector(sel):
    return lambda spark, d: (lambda t: t.filter(sel.column(t.columns)).select("seq", "cluster", "ns", "pod", "uid"))(log_lines(spark, d))


def unicode_filter(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(matches("text", "ÉE !zzz")).select("doc_id")


def document_filter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return docs.filter(matches("line", r'the !of /\bth[a-z]+\b/')).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def time_range(spark, d):
    return S.in_range(log_lines(spark, d), START, END).select("seq", "ts_ns")


def day_partition(spark, d):
    return log_lines(spark, d).groupBy(day(F.col("ts_ns")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def rfc3339_format(spark, d):
    odd = log_lines(spark, d).select("seq", (F.col("ts_ns") + F.when(F.col("seq") % 3 == 0, F.col("seq") % 1000).otherwise(0)).alias("ts_ns"))
    return odd.select("seq", rfc3339(F.col("ts_ns")).alias("t"))


def query_topk(spark, d):
    found = S.search(log_lines(spark, d), S.Selector(cluster="prod"), START, END, "click")
    return S.newest(found, 50).select("seq", "ts_ns", "msg")


def query_page2(spark, d):
    found = S.search(log_lines(spark, d), S.Selector(cluster="prod"), START, END, "click")
    last = S.page(found, 50).cursor  # one page's cursor: a row
    return S.newest(S.before(found, *last) if last else found.limit(0), 50).select("seq", "ts_ns", "msg")


def query_truncated_probe(spark, d):
    """For a few limits: does the page say that there is more?"""
    found = S.search(log_lines(spark, d), S.Selector(cluster="prod", ns="db"), START, END, "error")
    rows = [(n, S.page(found, n).truncated) for n in (1, 10, 100_000)]
    return spark.createDataFrame(rows, "n int, truncated boolean")


def query_by_day(spark, d):
    lines = log_lines(spark, d).withColumn("day", day(F.col("ts_ns")))
    return S.newest_by_day(lines.filter(matches("msg", "signup")), None, 40).select("seq", "ts_ns")


def search_skipping(spark, d):
    """A search that does not read the files (log lines by day and kind) that the trigrams rule out; days of even date are not in the table."""
    lines = log_lines(spark, d).withColumns({"day": day(F.col("ts_ns")), "file": F.regexp_extract("msg", r"/v1/(\w+)", 1)})
    skip = skipping.trigram_table(lines.filter("right(day, 1) in ('1', '3', '5', '7', '9')"), ("day", "file"))
    return S.search(lines, S.Selector(ns="shop"), START, END, "purchase", skip=skip, unit=("day", "file")).select("seq", "ts_ns")


def export_asc(spark, d):
    found = S.search(log_lines(spark, d), S.Selector(ns="shop"), START, END, "view")
    return S.export_text(found, S.stream_name())


def export_ndjson(spark, d):
    found = S.search(log_lines(spark, d), S.Selector(ns="shop"), START, END, "view")
    return S.export_ndjson(found, S.stream_name())


def api_lines(spark, d):
    return S.api_line(S.search(log_lines(spark, d), S.Selector(ns="db"), START, END, "error"))


def export_named(spark, d):
    """Lines with names from the catalog; the streams of one namespace are unknown to it."""
    lines = log_lines(spark, d)
    streams = lines.filter("ns <> 'db'").select("sid", "cluster", "ns", "pod").withColumn("ctr", F.lit("app")).distinct()
    return S.named(lines.select("seq", "sid"), streams).select("seq", "stream")


def _odd_json(spark, d):
    """Numbers as they may be written, and lines that are more, or less, than an object."""
    n = F.col("event_id")
    number = F.when(n % 5 == 0, "1.10").when(n % 5 == 1, "1.1").when(n % 5 == 2, "1e3").when(n % 5 == 3, "1000").otherwise("-0")
    text = F.concat(F.lit('{"a":'), number, F.lit(',"b":"'), F.col("event_type"), F.lit('"}'))
    text = F.when(n % 7 == 0, F.concat(text, F.lit(" tail"))).when(n % 7 == 1, F.concat(text, F.lit("}"))).when(n % 7 == 2, F.concat(text, F.lit(" "))).otherwise(text)
    return table(spark, d, "events").select(n.alias("seq"), text.alias("msg"))


def filter_kv_raw_number(spark, d):
    """Which of four queries each line passes."""
    return _odd_json(spark, d).select("seq", *[matches("msg", f"a={v}").alias(f"q{i}") for i, v in enumerate(("1.10", "1e3", "1000", "-0"))])


def filter_kv_tail(spark, d):
    return _odd_json(spark, d).filter(matches("msg", "b=click")).select("seq", "msg")


def line_truncate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(truncated(F.col("text"), 500), 256).alias("sha"), F.octet_length(truncated(F.col("text"), 500)).alias("bytes"))


def _peers(spark, d):
    lines = log_lines(spark, d)
    return S.federated({"": lines.filter("cluster = 'prod'"), "a": lines.filter("cluster <> 'prod' and sid % 3 = 0"), "b": lines.filter("cluster <> 'prod' and sid % 3 <> 0")})


def union_federated(spark, d):
    return _peers(spark, d).select("seq", "sid")


def federated_topk(spark, d):
    return S.newest(_peers(spark, d).filter(matches("msg", "purchase")), 60).select("seq", "sid", "ts_ns")


def sid_routing(spark, d):
    return S.routed(_peers(spark, d).select("sid").distinct())


def federated_status(spark, d):
    parts = _peers(spark, d).groupBy(F.when(F.contains("sid", F.lit("/")), F.substring_index("sid", "/", 1)).otherwise("").alias("peer")).agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if("stderr").alias("skipped"), F.countDistinct("sid").alias("chunks")
    )
    parts = parts.withColumn("truncated", F.col("peer") == "b").withColumn("errors", F.when(F.col("peer") == "a", F.array(F.lit("a: slow"))).otherwise(F.array().cast("array<string>")))
    return S.merged_status(parts).withColumn("errors", F.array_join("errors", ","))


_FED = LINES + ", fed as (select *, case when cluster = 'prod' then sid::varchar when sid % 3 = 0 then 'a/' || sid else 'b/' || sid end as fsid from lines)"
_IN = f"ts_ns between {START} and {END}"

QUERIES = {
    **{k: _filter(q) for k, (q, _) in FILTERS.items()},
    "filter_kv_exact": _filter("user=42 level=click", exact=True),
    **{k: _selector(s) for k, (s, _) in SELECTORS.items()},
    "filter_unicode": unicode_filter,
    "filter_documents": document_filter,
    "time_range": time_range,
    "day_partition": day_partition,
    "rfc3339_format": rfc3339_format,
    "query_flagship": flagship,
    "query_topk": query_topk,
    "query_page2": query_page2,
    "query_truncated_probe": query_truncated_probe,
    "query_by_day": query_by_day,
    "search_skipping": search_skipping,
    "export_asc": export_asc,
    "export_ndjson": export_ndjson,
    "export_named": export_named,
    "api_lines": api_lines,
    "filter_kv_raw_number": filter_kv_raw_number,
    "filter_kv_tail": filter_kv_tail,
    "line_truncate": line_truncate,
    "union_federated": union_federated,
    "federated_topk": federated_topk,
    "federated_status": federated_status,
    "sid_routing": sid_routing,
}

_ODD = """odd as (select event_id as seq, case event_id % 5 when 0 then '1.10' when 1 then '1.1' when 2 then '1e3' when 3 then '1000' else '-0' end as raw, event_type as kind, event_id % 7 > 1 as fine,
    '{"a":' || case event_id % 5 when 0 then '1.10' when 1 then '1.1' when 2 then '1e3' when 3 then '1000' else '-0' end || ',"b":"' || event_type || '"}'
    || case event_id % 7 when 0 then ' tail' when 1 then '}' when 2 then ' ' else '' end as msg from events)"""
_TOPK = f"with {LINES} select seq, ts_ns, msg from lines where cluster = 'prod' and {_IN} and contains(lower(msg), 'click') order by ts_ns desc, seq desc limit 50"
_SHOP = f"from lines where ns = 'shop' and {_IN} and contains(lower(msg), 'view')"

SQL = {
    **{k: f"with {LINES} select seq, msg from lines where {p}" for k, (_, p) in FILTERS.items()},
    "filter_kv_exact": f"with {LINES} select seq, msg from lines where json_extract_string(msg, '$.user') = '42' and json_extract_string(msg, '$.level') = 'click'",
    **{k: f"with {LINES} select seq, cluster, ns, pod, uid from lines where {p}" for k, (_, p) in SELECTORS.items()},
    "filter_kv_raw_number": f"with {_ODD} select seq, fine and raw = '1.10' as q0, fine and raw = '1e3' as q1, fine and raw = '1000' as q2, fine and raw = '-0' as q3 from odd",
    "filter_kv_tail": f"with {_ODD} select seq, msg from odd where fine and kind = 'click'",
    "filter_unicode": "select doc_id from documents where contains(lower(text), lower('ÉE')) and not contains(lower(text), 'zzz')",
    "filter_documents": r"""select doc_id, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
        where contains(lower(line), 'the') and not contains(lower(line), 'of') and regexp_matches(line, '(?i)\bth[a-z]+\b') group by doc_id""",
    "time_range": f"with {LINES} select seq, ts_ns from lines where {_IN}",
    "day_partition": f"with {LINES} select strftime(make_timestamp(ts_ns // 1000), '%Y%m%d') as day, count(*) as n from lines group by 1",
    "rfc3339_format": f"with {LINES}, odd as (select seq, ts_ns + case when seq % 3 = 0 then seq % 1000 else 0 end as ts_ns from lines) select seq, {RFC} as t from odd",
    "query_flagship": f"""with {LINES} select seq, ts_ns, cluster, ns, pod, ctr, stderr, restart, msg from lines where cluster = 'prod' and pod ilike 'api-%' and {_IN}
        and contains(lower(msg), 'error') and not contains(lower(msg), 'healthz') and json_extract_string(msg, '$.level') = 'error' order by ts_ns desc, seq desc limit 100""",
    "query_topk": _TOPK,
    "query_page2": f"{_TOPK} offset 50",
    "query_truncated_probe": f"""with {LINES}, c as (select count(*) as c from lines where cluster = 'prod' and ns = 'db' and {_IN} and contains(lower(msg), 'error'))
        select n, c > n as truncated from c, (values (1), (10), (100000)) as v(n)""",
    "query_by_day": f"with {LINES} select seq, ts_ns from lines where contains(lower(msg), 'signup') order by ts_ns desc, seq desc limit 40",
    "search_skipping": f"with {LINES} select seq, ts_ns from lines where ns = 'shop' and {_IN} and contains(lower(msg), 'purchase')",
    "export_asc": f"with {LINES} select {RFC} || ' ' || {NAME} || ' ' || msg as line {_SHOP}",
    "export_ndjson": f"""with {LINES} select '{{"t":' || ts_ns || ',"stream":"' || {NAME} || '","stderr":' || stderr || ',"restart":' || restart || ',"m":"' || replace(msg, '"', '\\"') || '"}}' as line {_SHOP}""",
    "export_named": f"with {LINES} select seq, case when ns = 'db' then '' else cluster || '/' || ns || '/' || pod || '/app' end as stream from lines",
    "api_lines": f"""with {LINES} select '{{"sid":"' || sid || '","t":' || ts_ns || ',"e":true,"m":"' || replace(msg, '"', '\\"') || '"' || case when restart > 0 then ',"r":' || restart else '' end || '}}' as line
        from lines where ns = 'db' and {_IN} and contains(lower(msg), 'error')""",
    # a cut at 500 bytes falls back to a whole character, at most 4 bytes long; what is left of a cut one becomes a replacement mark
    "line_truncate": r"""with b as (select doc_id, text, left(text, 500) as l from documents),
        k as (select doc_id, text, l, list_max(list_filter(range(0, 501), lambda i: strlen(left(l, i)) <= 500)) as k from b)
        select doc_id, sha256(t) as sha, strlen(t)::int as bytes from (
          select doc_id, case when strlen(text) > 500 then left(l, k) || case when strlen(left(l, k)) < 500 then '�' else '' end || '…[truncated]' else text end as t from k)""",
    "union_federated": f"with {_FED} select seq, fsid as sid from fed",
    "federated_topk": f"with {_FED} select seq, fsid as sid, ts_ns from fed where contains(lower(msg), 'purchase') order by ts_ns desc, seq desc limit 60",
    "federated_status": f"""with {_FED} select count(*)::bigint as scanned, count(*) filter (stderr)::bigint as skipped, count(distinct fsid)::bigint as chunks, true as truncated, 'a: slow' as errors from fed""",
    "sid_routing": f"with {_FED} select distinct fsid as sid, case when contains(fsid, '/') then split_part(fsid, '/', 1) else '' end as peer, case when contains(fsid, '/') then split_part(fsid, '/', 2) else fsid end as local from fed",
}
