"""Queries of events, the index, look-ups, hand-offs, traversal, search and display over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import fingerprint as fp
from spanloom.functions.scalar import confidence_tier, in_dates, is_uuid, rfc3339
from spanloom.operators import dispatch, events, graph, index, joins, lookup, windows
from spanloom.operators.hierarchy import dispatch_parents
from spanloom.operators.running import day_bucket
from spanloom.queries import sqltext as S
from spanloom.runtime import materialize, new_path, table
from spanloom.sources.stores import Store

NEEDLE = "budget_heap"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return events.redelivered_once(table(spark, d, "clawline_sample"))


def _raw(df: DataFrame) -> DataFrame:
    """Lines of the log as text: all texts of an event."""
    text = F.concat_ws("\n", "content", "args", "stdout", "stderr", "text", "before_text", "after_text", "note")
    return df.select("tape_id", F.col("event_offset").alias("line_no"), text.alias("raw"), "k", "t")


def _anchored(spark, d):
    rows, _ = materialize(index.with_anchors(_log(spark, d)), "anchored")
    return index.valid_tapes_only(rows)


def typed_events(spark, d):
    return events.typed(_log(spark, d)).groupBy("k", "kind").agg(F.count("*").alias("n"), F.count("payload").alias("n_payload"))


def textual_payload(spark, d):
    return events.typed(_log(spark, d)).where("payload is not null").select("row_id", F.md5("payload").alias("payload_md5"))


def first_meta(spark, d):
    return events.first_meta(_log(spark, d)).select("tape_id", "t", "model", "repo_head", "label")


def conformance(spark, d):
    return events.conformance(_log(spark, d)).select("tape_id", "line", "detail")


def message_turns(spark, d):
    return events.message_turns(_log(spark, d)).where("k = 'code.edit'").select("tape_id", "event_offset", "turn")


def evidence_build(spark, d):
    return index.evidence(_anchored(spark, d))


def edge_build(spark, d):
    return index.with_class(index.edges(_anchored(spark, d))).withColumn("confidence", F.round(F.col("confidence").cast("double"), 5))


def tombstone_build(spark, d):
    return index.tombstones(_anchored(spark, d))


def deletion_build(spark, d):
    """Tombstones of the log if every edit had deleted what it changed."""
    log = _log(spark, d).withColumn("after_text", F.lit("")).withColumn("after_anchor_hashes", F.lit(None).cast("array<string>"))
    return index.tombstones(index.valid_tapes_only(index.with_anchors(log)))


def store_evidence(spark, d):
    """Evidence as read back from a store, in which it was committed in two parts after one commit that was never marked."""
    facts = {"evidence": evidence_build(spark, d), "tapes": tape_ledger(spark, d)}
    store = Store(spark, new_path(spark, "store")).create()
    store.files.delete(f"commits/{store.commit(facts)}.json")
    half = F.crc32("tape_id") % 2
    for k in range(2):
        store.commit({n: rows.where(half == k) for n, rows in facts.items()})
    return store.read("evidence").join(store.read("tapes"), "tape_id", "left_semi").select("anchor", "tape_id", "event_offset", "kind", "file_path", "timestamp")


def lineage_reach(spark, d):
    """Least distance, in either direction, of all anchors within ten edges of every anchor whose hash is divisible by 20."""
    e = table(spark, d, "edges").where("from_anchor is not null and to_anchor is not null").select("from_anchor", "to_anchor")
    seeds = e.select(F.explode(F.array("from_anchor", "to_anchor")).alias("anchor")).where(F.conv(F.substring(F.md5("anchor"), 1, 4), 16, 10).cast("int") % 20 == 0)
    return graph.reach(e, seeds)


def composite_hits(spark, d):
    """Hits of the composite anchors of what was read, by file."""
    reads = _log(spark, d).where("k = 'code.read' and file is not null and text is not null").select("tape_id", "event_offset", F.col("file").alias("file_path"), "text")
    rows = fp.with_features(fp.with_windows(reads, "text"), "window_text", "features").where("size(features) > 0")
    return index.composite_stats(rows.select("file_path", fp.anchor_of(F.col("features")).alias("anchor"))).select("file_path", F.md5("anchor").alias("anchor_md5"), "hits")


def tape_ledger(spark, d):
    return _anchored(spark, d).select("tape_id").distinct()


def referenced_tapes(spark, d):
    rows = _anchored(spark, d)
    return index.referenced_tapes(index.evidence(rows), index.tombstones(rows))


def unindexed_tapes(spark, d):
    """Tapes of the log that the ledger lacks."""
    return _log(spark, d).select("tape_id").distinct().join(tape_ledger(spark, d), "tape_id", "left_anti")


def composite_stats(spark, d):
    rows = _log(spark, d).where("k = 'code.read' and file is not null").select(F.col("file").alias("file_path"), F.explode("anchor_hashes").alias("anchor"))
    return index.composite_stats(rows)


def session_build(spark, d):
    return lookup.sessions(lookup.touches_of(evidence_build(spark, d)))


def files_touched(spark, d):
    return lookup.files_touched(lookup.touches_of(evidence_build(spark, d)), _log(spark, d))


def time_range(spark, d):
    return lookup.time_range(lookup.sessions(lookup.touches_of(evidence_build(spark, d))))


def edges_in_out(spark, d):
    """Visible edges at each anchor of the edge table, by side."""
    e = table(spark, d, "edges").where("from_anchor is not null and to_anchor is not null and agent_link is not null and confidence is not null").distinct()
    near = graph.neighbours(graph.visible(e), e.select(F.col("from_anchor").alias("anchor")))
    return near.groupBy("anchor").agg(F.count_if("inbound").alias("n_in"), F.count_if(~F.col("inbound")).alias("n_out"), F.round(F.max("confidence").cast("double"), 5).alias("best"))


def edge_tiers(spark, d):
    e = graph.EDGE_KEY
    rows = index.with_class(table(spark, d, "edges").where("agent_link is not null and confidence is not null").select(*e))
    tier = confidence_tier(F.col("confidence"), F.coalesce(F.col("location_delta") == "moved", F.lit(False)), F.col("stored_class") == "location_only")
    return rows.withColumn("tier", tier).groupBy("tier", "stored_class").agg(F.count("*").alias("n"))


def fanout_topk(spark, d):
    """The three most confident visible edges out of each anchor."""
    from pyspark.sql import Window as W

    e = graph.visible(table(spark, d, "edges").where("from_anchor is not null and to_anchor is not null and agent_link is not null and confidence is not null").select("from_anchor", "to_anchor", "confidence", "agent_link").distinct())
    order = W.partitionBy("from_anchor").orderBy(F.desc("confidence"), "to_anchor", "agent_link")
    return e.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("from_anchor", "to_anchor", F.round(F.col("confidence").cast("double"), 5).alias("confidence"), "rank")


def lineage_bfs(spark, d):
    """Bounded traversal of the edge table from its most connected anchor."""
    e, _ = materialize(table(spark, d, "edges").where("from_anchor is not null and to_anchor is not null and agent_link is not null and confidence is not null").select(*graph.EDGE_KEY).fillna("", ["note", "location_delta", "cardinality"]).distinct(), "edges")
    top = e.groupBy("from_anchor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_anchor").limit(1).collect()
    taken = graph.bounded_bfs(e, [r["from_anchor"] for r in top])
    rows = [(i, *[x[c] for c in graph.EDGE_KEY]) for i, x in enumerate(taken)]
    return spark.createDataFrame(rows, "position INT, from_anchor STRING, to_anchor STRING, confidence FLOAT, location_delta STRING, cardinality STRING, agent_link BOOLEAN, note STRING")


def dispatch_ref_counts(spark, d):
    return dispatch.reference_counts(table(spark, d, "dispatch_links").where("uuid is not null").select("tape_id", F.lower(F.trim("uuid")).alias("uuid"), "direction").distinct())


def _links(spark, d):
    rows = table(spark, d, "dispatch_links").select("tape_id", F.lower(F.trim("uuid")).alias("uuid"), "first_turn_index", "direction").where(is_uuid(F.col("uuid")))
    return rows.groupBy("tape_id", "uuid", "direction").agg(F.min("first_turn_index").alias("first_turn_index"))


def dispatch_latest_received(spark, d):
    """For each edit the last marker its session had received before it."""
    edits = message_turns(spark, d)
    return dispatch.latest_received(edits, _links(spark, d)).select("tape_id", "event_offset", "turn", "uuid", "received_turn")


def dispatch_climb(spark, d):
    edits = message_turns(spark, d).select("tape_id", "turn")
    return dispatch.climb(edits, _links(spark, d)).groupBy("tape_id", "turn", "uuid", "received_turn", "parent_tape", "sent_turn").agg(F.min("hop").alias("hop"))


def session_chains(spark, d):
    """Chains of tapes by hand-offs."""
    links = dispatch_parents(table(spark, d, "dispatch_links")).withColumn("position", F.lit(0))
    tapes = links.select(F.col("child").alias("session_id")).union(links.select("parent")).distinct()
    c = graph.chains(tapes, links)
    return c.select("session_id", "parent", "root", "depth", "chain_length", F.col("n_children").cast("int").alias("n_children"))


def chain_metadata(spark, d):
    from pyspark.sql import Window as W

    c = session_chains(spark, d).withColumn("position", F.row_number().over(W.partitionBy("root").orderBy("session_id")))
    return graph.chain_metadata(c).select("root", "session_id", "place", "first_position")


def grep_stats(spark, d):
    return lookup.grep_stats(_raw(_log(spark, d)), NEEDLE)


def grep_top(spark, d):
    s = lookup.grep_stats(_raw(_log(spark, d)), NEEDLE)
    return lookup.page(s, lookup.grep_order()).select("tape_id", "match_count", "provenance_match_count", "provenance_event_count", "timestamp")


def date_filter(spark, d):
    rows = _log(spark, d).where(in_dates(F.col("t"), "2025-06-01", "2025-06-30"))
    return rows.groupBy("tape_id").agg(F.count("*").alias("n"), F.count(F.when(rfc3339(F.col("t")).isNull(), 1)).alias("n_unread"))


def event_neighbourhood(spark, d):
    """Events up to two positions around each edit."""
    log = _log(spark, d)
    touches = log.where("k = 'code.edit'").select("tape_id", F.col("event_offset").alias("touch_offset"))
    return windows.neighbourhood(_raw(log), touches).select("tape_id", "touch_offset", "position", "line_no")


def peek_windows(spark, d):
    """The display window of each tape around its first edit."""
    rows = _raw(_log(spark, d))
    at = rows.groupBy("tape_id").agg(F.coalesce(F.min(F.when(F.col("k") == "code.edit", F.col("line_no"))), F.lit(0)).alias("a"), (F.max("line_no") + 1).alias("total"))
    w = at.select("tape_id", windows.display_window(F.col("a") + 1, F.col("total")).alias("w")).select("tape_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    shown = windows.slice_lines(rows, w)
    return shown.groupBy("tape_id").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n_lines"))


def grep_context(spark, d):
    rows = _raw(_log(spark, d))
    hits = windows.matches(rows, NEEDLE).select("tape_id", (F.col("line_no") + 1).alias("line"))
    totals = rows.groupBy("tape_id").agg((F.max("line_no") + 1).alias("total"))
    return windows.merged_context(hits, totals)


def asof_click(spark, d):
    """Each purchase with the user's last click strictly before it."""
    e = table(spark, d, "events")
    click = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    buy = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof_backward(buy, click, ["user_id"], "ts", "click_ts", ["click_ts", "click_id"], ties=F.col("click_id"), bucket=day_bucket).select("event_id", "user_id", "click_id")


def call_result_pairing(spark, d):
    """Each tool result with the latest call of its id in its tape."""
    log = _log(spark, d).where("call_id is not null").select("tape_id", "call_id", "event_offset", "k")
    return joins.pair_latest(log.where("k = 'tool.call'"), log.where("k = 'tool.result'"), ["tape_id", "call_id"], "event_offset").select("tape_id", "call_id", "event_offset", "call_at")


def prefix_join(spark, d):
    """Files of the log that lie in, or above, the folders in which commands ran."""
    log = _log(spark, d)
    files = log.where("file is not null").select(F.concat(F.lit("/work/"), F.col("file")).alias("path")).distinct()
    dirs = log.where("cwd is not null").select(F.col("cwd").alias("path")).union(log.where("k = 'code.edit' and file is not null").select(F.concat(F.lit("/work/"), F.regexp_replace("file", "/[^/]*$", "")).alias("path"))).distinct()
    return lookup.prefix_related(files, dirs).select("path")


def explain_documents(spark, d):
    """The ten sessions that share most of the anchors of each document whose id is divisible by 20; all documents are sessions."""
    from pyspark.sql import Window as W

    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    held, _ = materialize(fp.computed_once(docs, a=fp.token_anchors(F.col("text"))).where("size(a) > 0").select("doc_id", "a"), "evidence")
    ev = held.select("doc_id", F.explode("a").alias("anchor"))
    asked = held.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.explode(fp.sample_anchors(F.col("a"))).alias("anchor"))
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = lookup.salted_join(asked, ev, "anchor", "doc_id").groupBy("query_id", "doc_id").agg(F.count("*").alias("hit"))
    scored = hits.join(sizes, "query_id").select("query_id", "doc_id", F.round(F.col("hit") / F.col("n"), 6).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= 10")


QUERIES = {
    f.__name__: f
    for f in (
        explain_documents, typed_events, textual_payload, first_meta, conformance, message_turns, evidence_build, edge_build, tombstone_build, deletion_build, store_evidence, lineage_reach, composite_hits, tape_ledger, referenced_tapes, unindexed_tapes, composite_stats,
        session_build, files_touched, time_range, edges_in_out, edge_tiers, fanout_topk, lineage_bfs, dispatch_ref_counts, dispatch_latest_received, dispatch_climb, session_chains, chain_metadata,
        grep_stats, grep_top, date_filter, event_neighbourhood, peek_windows, grep_context, asof_click, call_result_pairing, prefix_join,
    )
}

_LOG = """ claw as (select * from clawline_sample where tape_id is not null and event_offset is not null qualify row_number() over (partition by tape_id, event_offset order by row_id) = 1)"""
_TYPED = f"""{_LOG},
 typ as (select *, case when k in ('meta', 'msg.in', 'msg.out', 'tool.call', 'tool.result') then k when k = 'code.read' and file is not null and range is not null then k
   when k = 'code.edit' and file is not null then k when k = 'span.link' and from_file is not null and from_range is not null and to_file is not null and to_range is not null then k else 'other' end as kind,
   case when k in ('msg.in', 'msg.out') then content when k = 'tool.call' then args when k = 'tool.result' and (stdout is not null or stderr is not null) then concat_ws(chr(10), stdout, stderr) end as payload from claw)"""
_EXPANDED = "case when starts_with(x, 'winnow:') then list_transform(list_filter(string_split(substr(x, 8), ','), lambda y: y <> ''), lambda y: 'winnow:' || y) else [x] end"
_INDEX = f"""{_TYPED},
 src as (select tape_id, event_offset, 0 as side, payload as tx from typ where kind in ('msg.in', 'msg.out', 'tool.call', 'tool.result') and payload is not null
   union all select tape_id, event_offset, 1, text from typ where kind = 'code.read' and text is not null
   union all select tape_id, event_offset, 2, before_text from typ where kind = 'code.edit' and before_text is not null
   union all select tape_id, event_offset, 3, after_text from typ where kind = 'code.edit' and after_text is not null),
{S.windows("src", "tape_id, event_offset, side", "tx")},
 tk1 as (select tape_id, event_offset, side, w * 1000000 + generate_subscripts(f, 1) as p, 'winnow:' || unnest(f) as a from fw),
 tok as (select tape_id, event_offset, side, a, min(p) as p from tk1 group by all),
 leg1 as (select tape_id, event_offset, 1 as side, anchor_hashes as hs from typ where kind = 'code.read' and text is null
   union all select t.tape_id, t.event_offset, 2, before_anchor_hashes from typ t where kind = 'code.edit' and not exists (select 1 from tok where tok.tape_id = t.tape_id and tok.event_offset = t.event_offset and side = 2)
   union all select t.tape_id, t.event_offset, 3, after_anchor_hashes from typ t where kind = 'code.edit' and not exists (select 1 from tok where tok.tape_id = t.tape_id and tok.event_offset = t.event_offset and side = 3)),
 leg2 as (select tape_id, event_offset, side, unnest(hs) as x, generate_subscripts(hs, 1) as i from leg1),
 leg3 as (select tape_id, event_offset, side, i * 1000000 + generate_subscripts({_EXPANDED}, 1) as p, unnest({_EXPANDED}) as a from leg2),
 anc as (select * from tok union all select tape_id, event_offset, side, a, min(p) as p from leg3 group by all),
 sid as (select tape_id, event_offset, side, list(a order by p) as l from anc group by all),
 wt1 as (select tape_id, event_offset, similarity, {S.tokens("before_text")} as tb, {S.tokens("after_text")} as ta from typ where kind = 'code.edit'),
 wt2 as (select tape_id, event_offset, similarity, {S.grams("tb")} as gb, {S.grams("ta")} as ga from wt1),
 wt3 as (select tape_id, event_offset, similarity, list_distinct({S.winnow("gb")}) as fb, list_distinct({S.winnow("ga")}) as fa from wt2),
 con as (select tape_id, event_offset, coalesce(case when len(fb) > 0 and len(fa) > 0 then (len(list_intersect(fb, fa)) / len(list_distinct(list_concat(fb, fa))))::float end, similarity, 0::float) as confidence from wt3),
 par as (select b.tape_id, b.event_offset, b.l as bl, a.l as al, confidence from sid b join sid a on a.tape_id = b.tape_id and a.event_offset = b.event_offset and b.side = 2 and a.side = 3
   join con on con.tape_id = b.tape_id and con.event_offset = b.event_offset),
 badt as (select tape_id from anc where a = '' or a is null union select tape_id from par where isnan(confidence) or confidence < 0 or confidence > 1),
 evi as (select distinct a as anchor, tape_id, event_offset, case kind when 'code.read' then 'read' when 'code.edit' then 'edit' when 'msg.in' then 'message' when 'msg.out' then 'message' else 'tool' end as kind,
   case when kind in ('code.read', 'code.edit') then file else '' end as file_path, t as timestamp from anc join typ using (tape_id, event_offset) where tape_id not in (select tape_id from badt)),
 tmb as (select distinct anc.a as anchor, anc.tape_id, anc.event_offset, file as file_path, coalesce(before_range, after_range, [0, 0])[1] as range_start, coalesce(before_range, after_range, [0, 0])[2] as range_end, t as timestamp
   from anc join typ using (tape_id, event_offset) where side = 2 and not exists (select 1 from anc z where z.tape_id = anc.tape_id and z.event_offset = anc.event_offset and z.side = 3) and tape_id not in (select tape_id from badt)),
 led as (select distinct tape_id from claw where tape_id not in (select tape_id from badt)),
 ses as (select tape_id, count(*) as touch_count, count(distinct nullif(file_path, '')) as n_files, coalesce(max(timestamp), '') as timestamp, min(event_offset) as first_touch
   from (select distinct tape_id, event_offset, kind, file_path, timestamp from evi) group by tape_id)"""
_EDGE_OK = "from_anchor is not null and to_anchor is not null and agent_link is not null and confidence is not null"
_VIS = "(agent_link or (confidence >= 0.3::float and confidence >= 0.5::float))"
_TURN = f"""{_LOG}, trn as (select tape_id, event_offset, k, coalesce(sum((k in ('msg.in', 'msg.out'))::int) over (partition by tape_id order by event_offset rows between unbounded preceding and 1 preceding), 0)::bigint as turn from claw)"""
_LNK = r"""lnk as (select tape_id, lower(trim(uuid)) as uuid, direction, min(first_turn_index) as first_turn_index from dispatch_links where regexp_full_match(lower(trim(uuid)), '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') group by all)"""
_RAW = f"""{_LOG}, raw as (select tape_id, event_offset as line_no, concat_ws(chr(10), content, args, stdout, stderr, text, before_text, after_text, note) as raw, k, t from claw)"""
_GREP = f"""{_RAW}, gs as (select tape_id, count(*) filter (hit) as match_count, min(line_no) filter (hit) as first_match, count(*) filter (hit and prov) as provenance_match_count, min(line_no) filter (hit and prov) as first_provenance_match,
   count(*) filter (prov) as provenance_event_count, coalesce(max(t), '') as timestamp from (select *, contains(raw, '{NEEDLE}') as hit, coalesce(k in ('code.edit', 'code.read', 'span.link'), false) as prov from raw) group by tape_id having count(*) filter (hit) > 0)"""
_CHAIN = r"""s as (select distinct lower(trim(uuid)) as u, tape_id from dispatch_links where direction = 'sent' and trim(uuid) <> ''), r as (select distinct lower(trim(uuid)) as u, tape_id from dispatch_links where direction = 'received' and trim(uuid) <> ''),
 l as (select r.tape_id as child, min(s.tape_id) as parent from r join s using (u) group by 1), n as (select child as id from l union select parent from l),
 kids as (select s.tape_id as id, count(*) as n_children from r join s using (u) group by 1),
 up as (select id, id as root, 0 as depth from n where id not in (select child from l) union all select l.child, up.root, up.depth + 1 from up join l on l.parent = up.id),
 ch as (select n.id as session_id, l.parent, coalesce(up.root, n.id) as root, coalesce(up.depth, 0)::int as depth, coalesce(n_children, 0)::int as n_children from n left join l on l.child = n.id left join up on up.id = n.id left join kids on kids.id = n.id),
 sz as (select root, count(*) as chain_length from ch group by 1)"""

SQL = {
    "typed_events": f"with {_TYPED} select k, kind, count(*) as n, count(payload) as n_payload from typ group by all",
    "textual_payload": f"with {_TYPED} select row_id, md5(payload) as payload_md5 from typ where payload is not null",
    "first_meta": f"with {_LOG} select tape_id, t, model, repo_head, label from claw where k = 'meta' qualify row_number() over (partition by tape_id order by event_offset) = 1",
    "conformance": f"""with {_LOG}, d as (select tape_id, event_offset + 1 as line, unnest(list_filter([case when t is null then 'lacks t' end, case when k is null then 'lacks k' end, case when k = 'tool.call' and tool is null then 'tool.call lacks tool' end,
      case when k = 'tool.result' and tool is null then 'tool.result lacks tool' end, case when k = 'code.read' and file is null then 'code.read lacks file' end, case when k = 'code.read' and range is null then 'code.read lacks range' end,
      case when k = 'code.edit' and file is null then 'code.edit lacks file' end, case when k = 'span.link' and from_file is null then 'span.link lacks from_file' end, case when k = 'span.link' and from_range is null then 'span.link lacks from_range' end,
      case when k = 'span.link' and to_file is null then 'span.link lacks to_file' end, case when k = 'span.link' and to_range is null then 'span.link lacks to_range' end,
      case when similarity < 0 or similarity > 1 then 'similarity out of range' end], lambda x: x is not null)) as detail from claw) select * from d""",
    "message_turns": f"with {_TURN} select tape_id, event_offset, turn from trn where k = 'code.edit'",
    "evidence_build": f"with {_INDEX} select * from evi",
    "edge_build": f"""with {_INDEX}, prs as (select bl, al, confidence, greatest(len(bl), len(al)) as m, unnest(range(0, greatest(len(bl), len(al)))) as i from par where tape_id not in (select tape_id from badt)),
      eds as (select distinct bl[(i * len(bl) // m) + 1] as from_anchor, al[(i * len(al) // m) + 1] as to_anchor, confidence, 'same' as location_delta, '1:1' as cardinality, false as agent_link, '' as note from prs
        union select 'span:' || from_file || ':' || from_range[1] || '-' || from_range[2], 'span:' || to_file || ':' || to_range[1] || '-' || to_range[2], 1::float, 'moved', '1:1', true, coalesce(note, '') from typ where kind = 'span.link' and tape_id not in (select tape_id from badt))
      select from_anchor, to_anchor, round(confidence::double, 5) as confidence, location_delta, cardinality, agent_link, note, case when not agent_link and confidence < 0.3::float then 'location_only' else 'lineage' end as stored_class from eds""",
    "tombstone_build": f"with {_INDEX} select * from tmb",
    "deletion_build": f"with {_INDEX} select * from tmb".replace("select * from clawline_sample", "select * replace ('' as after_text, null::varchar[] as after_anchor_hashes) from clawline_sample"),
    "store_evidence": f"with {_INDEX} select * from evi",
    "lineage_reach": """with recursive b as (select distinct from_anchor as x, to_anchor as y from edges where from_anchor is not null and to_anchor is not null union select to_anchor, from_anchor from edges where from_anchor is not null and to_anchor is not null),
      s as (select distinct x as seed from b where ('0x' || substr(md5(x), 1, 4))::int % 20 = 0), r as (select seed, seed as anchor, 0 as depth from s union select r.seed, b.y, r.depth + 1 from r join b on b.x = r.anchor where r.depth < 10 and b.x <> b.y)
      select seed, anchor, min(depth)::int as depth from r group by all""",
    "composite_hits": f"""with {_LOG}, rd as (select tape_id, event_offset, file as file_path, text as tx0 from claw where k = 'code.read' and file is not null and text is not null),
      {S.windows("rd", "tape_id, event_offset, file_path", "tx0")}, o as (select tape_id, event_offset, file_path, w, h, min(p) as p from (select tape_id, event_offset, file_path, w, unnest(f) as h, generate_subscripts(f, 1) as p from fw) group by all),
      a as (select file_path, 'winnow:' || string_agg(h, ',' order by p) as anchor from o group by tape_id, event_offset, file_path, w) select file_path, md5(anchor) as anchor_md5, count(*) as hits from a where contains(anchor, ',') group by all""",
    "tape_ledger": f"with {_INDEX} select * from led",
    "referenced_tapes": f"with {_INDEX} select tape_id from evi union select tape_id from tmb",
    "unindexed_tapes": f"with {_INDEX} select distinct tape_id from claw where tape_id not in (select tape_id from led)",
    "composite_stats": f"with {_LOG} select file_path, anchor, count(*) as hits from (select file as file_path, unnest(anchor_hashes) as anchor from claw where k = 'code.read' and file is not null) where contains(anchor, ',') group by all",
    "session_build": f"with {_INDEX} select * from ses",
    "files_touched": f"""with {_INDEX}, allf as (select distinct tape_id, f from (select tape_id, unnest([file, from_file, to_file]) as f from claw) where f <> '')
      select distinct tape_id, file_path as file from evi where file_path <> '' union all select tape_id, f from allf join ses using (tape_id) where n_files = 0""",
    "time_range": f'with {_INDEX} select min(nullif(timestamp, \'\')) as "start", max(nullif(timestamp, \'\')) as "end" from ses',
    "edges_in_out": f"""with e as (select distinct * from edges where {_EDGE_OK}), v as (select * from e where {_VIS}), a as (select distinct from_anchor as anchor from e),
      b as (select anchor, true as inbound, confidence from a join v on anchor = to_anchor union all select anchor, false, confidence from a join v on anchor = from_anchor)
      select anchor, count(*) filter (inbound) as n_in, count(*) filter (not inbound) as n_out, round(max(confidence)::double, 5) as best from b group by 1""",
    "edge_tiers": """with e as (select *, case when not agent_link and confidence < 0.3::float then 'location_only' else 'lineage' end as stored_class, coalesce(location_delta = 'moved', false) as moved from edges where agent_link is not null and confidence is not null)
      select case when stored_class = 'location_only' then 'forensics_only' when confidence >= 0.9::float and not moved then 'edit' when confidence >= 0.85::float and moved then 'move' when confidence >= 0.5::float then 'related' else 'hidden' end as tier, stored_class, count(*) as n from e group by all""",
    "fanout_topk": f"""with e as (select distinct from_anchor, to_anchor, confidence, agent_link from edges where {_EDGE_OK} and {_VIS}), r as (select *, row_number() over (partition by from_anchor order by confidence desc, to_anchor, agent_link) as rank from e)
      select from_anchor, to_anchor, round(confidence::double, 5) as confidence, rank::int as rank from r where rank <= 3""",
    "dispatch_ref_counts": "select tape_id, count(*) filter (direction = 'received') as refs_up, count(*) filter (direction = 'sent') as refs_down from (select distinct tape_id, lower(trim(uuid)) as uuid, direction from dispatch_links where uuid is not null) group by 1",
    "dispatch_latest_received": f"""with {_TURN}, {_LNK}, e as (select tape_id, event_offset, turn from trn where k = 'code.edit'), c as (select e.*, l.uuid, l.first_turn_index as received_turn, row_number() over (partition by e.tape_id, e.event_offset order by l.first_turn_index desc, l.uuid) as rn
      from e left join lnk l on l.tape_id = e.tape_id and l.direction = 'received' and l.first_turn_index < e.turn) select tape_id, event_offset, turn, uuid, received_turn from c where rn = 1""",
    "dispatch_climb": f"""with recursive {_TURN}, {_LNK},
      up as (select uuid, max_by(tape_id, (first_turn_index, -1)) as x, max(first_turn_index) as sent_turn from lnk where direction = 'sent' group by 1), snd as (select up.uuid, up.sent_turn, min(l.tape_id) as parent_tape from up join lnk l on l.uuid = up.uuid and l.direction = 'sent' and l.first_turn_index = up.sent_turn group by all),
      rc as (select tape_id, first_turn_index as rt, min(uuid) as uuid from lnk where direction = 'received' group by all),
      rn as (select tape_id, rt, uuid, lead(rt) over (partition by tape_id order by rt) as nxt from rc),
      hop as (select distinct e.tape_id, e.turn, r.uuid, r.rt as received_turn, s.parent_tape, s.sent_turn, 0 as h from (select distinct tape_id, turn from trn where k = 'code.edit') e join rn r on r.tape_id = e.tape_id and r.rt < e.turn and (r.nxt is null or r.nxt >= e.turn) left join snd s on s.uuid = r.uuid
        union all select h.parent_tape, h.sent_turn, r.uuid, r.rt, s.parent_tape, s.sent_turn, h.h + 1 from (select distinct parent_tape, sent_turn, h from hop where parent_tape is not null and h < 40) h join rn r on r.tape_id = h.parent_tape and r.rt < h.sent_turn and (r.nxt is null or r.nxt >= h.sent_turn) left join snd s on s.uuid = r.uuid)
      select tape_id, turn, uuid, received_turn, parent_tape, sent_turn, min(h)::int as hop from hop group by all""",
    "session_chains": f"with recursive {_CHAIN} select session_id, parent, root, depth, chain_length, n_children from ch join sz using (root)",
    "chain_metadata": f"""with recursive {_CHAIN} select root, session_id, row_number() over (partition by root order by depth, session_id) as place, 1 as first_position from ch""",
    "grep_stats": f"with {_GREP} select *, coalesce(first_provenance_match, first_match) as anchor_offset from gs",
    "grep_top": f"with {_GREP} select tape_id, match_count, provenance_match_count, provenance_event_count, timestamp from gs order by provenance_match_count desc, match_count desc, provenance_event_count desc, timestamp desc, tape_id limit 10",
    "date_filter": rf"""with {_LOG}, a as (select tape_id, case when regexp_matches(t, '^\d{{4}}-\d{{2}}-\d{{2}}[Tt ]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?([Zz]|[+-]\d{{2}}:\d{{2}})$') then try_cast(upper(t) as timestamptz) end as x from claw)
      select tape_id, count(*) as n, count(*) filter (x is null) as n_unread from a where x is null or (x >= '2025-06-01T00:00:00Z'::timestamptz and x <= '2025-06-30T23:59:59Z'::timestamptz) group by 1""",
    "event_neighbourhood": f"""with {_RAW}, pos as (select *, row_number() over (partition by tape_id order by line_no) - 1 as position from raw where trim(raw) <> '')
      select a.tape_id, a.line_no as touch_offset, b.position::int as position, b.line_no from pos a join pos b on a.tape_id = b.tape_id and abs(a.position - b.position) <= 2 where a.k = 'code.edit'""",
    "peek_windows": f"""with {_RAW}, a as (select tape_id, coalesce(min(line_no) filter (k = 'code.edit'), 0) + 1 as al, max(line_no) + 1 as total from raw group by 1), w as (select tape_id, greatest(al - 22, 1) as s, total from a)
      select tape_id, min(line_no + 1) as first_line, max(line_no + 1) as last_line, count(*) as n_lines from raw join w using (tape_id) where line_no + 1 between s and least(total, s + 29) group by 1""",
    "grep_context": f"""with {_RAW}, h as (select tape_id, line_no + 1 as line from raw where contains(raw, '{NEEDLE}')), t as (select tape_id, max(line_no) + 1 as total from raw group by 1),
      l as (select distinct tape_id, unnest(range(greatest(line - 5, 1), least(line + 5, total) + 1)) as x from h join t using (tape_id)), g as (select tape_id, x, x - row_number() over (partition by tape_id order by x) as isl from l)
      select tape_id, min(x) as "start", max(x) as "end" from g group by tape_id, isl""",
    "asof_click": """with c as (select user_id, ts as click_ts, max(event_id) as click_id from events where event_type = 'click' group by all), p as (select event_id, user_id, ts from events where event_type = 'purchase')
      select p.event_id, p.user_id, c.click_id from p asof left join c on p.user_id = c.user_id and p.ts > c.click_ts""",
    "call_result_pairing": f"""with {_LOG}, c as (select tape_id, call_id, event_offset from claw where k = 'tool.call' and call_id is not null), r as (select tape_id, call_id, event_offset from claw where k = 'tool.result' and call_id is not null)
      select r.tape_id, r.call_id, r.event_offset, c.event_offset as call_at from r asof left join c on r.tape_id = c.tape_id and r.call_id = c.call_id and r.event_offset > c.event_offset""",
    "prefix_join": f"""with {_LOG}, f as (select distinct '/work/' || file as path from claw where file is not null), d as (select cwd as path from claw where cwd is not null union select '/work/' || regexp_replace(file, '/[^/]*$', '') from claw where k = 'code.edit' and file is not null)
      select path from f where exists (select 1 from d where d.path = f.path or starts_with(f.path, d.path || '/') or starts_with(d.path, f.path || '/'))""",
    "explain_documents": f"""with {S.windows("documents", "doc_id", "text")}, o as (select doc_id, h, min(p) as p from (select doc_id, w * 1000000 + generate_subscripts(f, 1) as p, unnest(f) as h from fw) group by all),
      r as (select doc_id, h, row_number() over (partition by doc_id order by p) - 1 as i, count(*) over (partition by doc_id) as n from o where doc_id % 20 = 0),
      q as (select doc_id as query_id, h, least(n, 16) as m from r where n <= 16 or exists (select 1 from range(0, 16) t(k) where floor(k * (n - 1) / 15) = i)),
      m as (select query_id, count(*) as n from q group by 1), s as (select query_id, o.doc_id, round(count(*) / any_value(m.n), 6) as score from q join o on o.h = q.h join m using (query_id) group by all)
      select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s qualify rank <= 10""",
}
