"""Catalogue, integrity, recovery, statistics, sync and formatting operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, formatting, text
from ..functions.ranks import nearest_rank
from ..operators import cas, catalogue, index, integrity, recovery, statistics
from ..operators.search import exists_by_key
from ..sources import segments, synthetic
from ..streaming import events as event_windows
from ..streaming import feed, sync
from ..session import kept, scratch_folder, table
from .registry import query

_DIGEST = "sha256(o_orderkey::varchar)"


def catalogue_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as catalogue rows: segments of 256 orders, frames of 64 bytes and more."""
    orders = table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("<"), F.col("o_orderkey").cast("string"), F.lit("@orders>")).alias("message_id"),
        F.format_string("segment-%06d.arc", F.expr("o_orderkey div 256")).alias("segment"), (F.col("o_orderkey") % 256 * 1024).alias("archive_offset"), (64 + F.col("o_custkey") % 900).alias("frame_bytes"),
        F.unhex(F.sha2(F.col("o_orderkey").cast("string"), 256)).alias("raw_digest"), F.col("o_orderpriority").alias("folder"),
    )


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames for these rows with faults: every 7th is missing, every 11th holds another id, every 13th another digest,
    every 17th is corrupt; every 19th key has an orphan beside it, and every 23rd an incomplete tail."""
    rows = catalogue_rows(spark, folder)
    k = F.col("doc_id")
    status = F.when(k % 17 == 0, "corrupt").otherwise("valid")
    held = rows.filter(k % 7 != 0).select(
        "segment", F.col("archive_offset").alias("offset"), "frame_bytes", F.when(k % 11 == 0, k + 1).otherwise(k).cast("decimal(20,0)").alias("doc_id"),
        F.when(k % 13 == 0, F.unhex(F.sha2(F.lit("other"), 256))).otherwise(F.col("raw_digest")).alias("raw_digest"), status.alias("status"), F.when(status == "corrupt", "frame checksum mismatch").alias("reason"),
    )
    beside = lambda n, status, reason: rows.filter(k % n == 0).select("segment", (F.col("archive_offset") + 1000).alias("offset"), F.lit(24).cast("long").alias("frame_bytes"), (-k).cast("decimal(20,0)").alias("doc_id"), "raw_digest", F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    return held.unionByName(beside(19, "valid", None)).unionByName(beside(23, "tail", "incomplete frame header"))


def segment_table(spark: SparkSession, folder: str) -> DataFrame:
    """All segments but every 29th, 256 KiB each."""
    number = F.regexp_extract("segment", r"(\d+)", 1).cast("int")
    return catalogue_rows(spark, folder).select("segment").distinct().filter(number % 29 != 28).withColumn("bytes", F.lit(262_144).cast("long"))


ROWS = """
rows_ as (
  select o_orderkey as doc_id, printf('segment-%06d.arc', o_orderkey // 256) as segment, o_orderkey % 256 * 1024 as archive_offset, 64 + o_custkey % 900 as frame_bytes,
    sha256(o_orderkey::varchar) as digest, o_orderkey // 256 % 29 <> 28 as stored
  from orders
),
frames_ as (
  select segment, archive_offset as "offset", frame_bytes, case when doc_id % 11 = 0 then doc_id + 1 else doc_id end as doc_id,
    case when doc_id % 13 = 0 then sha256('other') else digest end as digest, case when doc_id % 17 = 0 then 'corrupt' else 'valid' end as status
  from rows_ where doc_id % 7 <> 0
  union all select segment, archive_offset + 1000, 24, -doc_id, digest, 'valid' from rows_ where doc_id % 19 = 0
  union all select segment, archive_offset + 1000, 24, -doc_id, digest, 'tail' from rows_ where doc_id % 23 = 0
),
records_ as (
  select r.doc_id, r.segment, r.archive_offset, r.frame_bytes,
    case when not stored then 'missing' when r.doc_id % 7 = 0 or r.doc_id % 17 = 0 or r.doc_id % 11 = 0 or r.doc_id % 13 = 0 then 'inconsistent' else 'available' end as status,
    case when not stored then '' when r.doc_id % 7 = 0 then 'no frame at the catalogue coordinate' when r.doc_id % 17 = 0 then 'frame checksum mismatch'
      when r.doc_id % 11 = 0 then 'catalog/frame id mismatch: frame contains ' || (r.doc_id + 1)::varchar when r.doc_id % 13 = 0 then 'catalogue/RAW digest linkage mismatch' else '' end as reason
  from rows_ r
),
states_ as (
  select f.*, case when status <> 'valid' then status
      when exists (select 1 from rows_ r where r.segment = f.segment and r.archive_offset = f."offset" and r.doc_id = f.doc_id and r.frame_bytes = f.frame_bytes and r.digest = f.digest) then 'validated'
      when exists (select 1 from rows_ r where r.segment = f.segment and r.archive_offset = f."offset") then 'inconsistent' else 'orphan' end as state
  from frames_ f
)
"""


@query(f"with {ROWS.strip()} select doc_id, status, reason from records_")
def record_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.record_inventory(catalogue_rows(spark, folder), frames(spark, folder), segment_table(spark, folder))


@query(f'with {ROWS.strip()} select segment, "offset", doc_id, state from states_')
def claim_orphan_classification(spark: SparkSession, folder: str) -> DataFrame:
    found = integrity.classify_frames(frames(spark, folder), catalogue_rows(spark, folder))
    return found.select("segment", "offset", F.col("doc_id").cast("long").alias("doc_id"), "state")


@query(f"""
with {ROWS.strip()}
select count(*) filter (state = 'validated') as validated, count(*) filter (state = 'inconsistent') as inconsistent, count(*) filter (state = 'orphan') as orphan,
  count(*) filter (state = 'corrupt') as corrupt, count(*) filter (state = 'tail') as tail, (select count(*) from records_ where status = 'missing') as missing from states_
""")
def inventory_counters(spark: SparkSession, folder: str) -> DataFrame:
    held = frames(spark, folder)
    rows = catalogue_rows(spark, folder)
    return integrity.inventory_counters(integrity.classify_frames(held, rows), integrity.record_inventory(rows, held, segment_table(spark, folder)))


def evidence_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All of ``lineitem`` as occurrences: odd line numbers of one source, even ones of the other."""
    lines = table(spark, folder, "lineitem")
    state = F.when(F.col("l_returnflag") == "N", "present").when(F.col("l_returnflag") == "R", "deleted").otherwise("unknown").alias("source_state")
    key = F.col("l_orderkey").alias("doc_id")
    gmail = lines.filter("l_linenumber % 2 = 1").select(key, F.lit("gmail:a").alias("source_account"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("gmail_message_id"), state)
    uid = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uid")
    imap = lines.filter("l_linenumber % 2 = 0").select(key, F.lit("imap:u@h:993").alias("source_account"), F.lit("INBOX").alias("mailbox"), F.lit(1).cast("long").alias("uid_validity"), uid, state)
    return gmail, imap


@query(f"""
with {ROWS.strip()},
evidence as (
  select l_orderkey as doc_id, count(*) filter (l_returnflag = 'N') as refetchable, count(*) filter (l_returnflag = 'R') as deleted, count(*) filter (l_returnflag = 'A') as invalid from lineitem group by 1
),
wild_ as (
  select 10000000000 + doc_id as doc_id, segment, archive_offset + 500 as archive_offset, 4611686018427387904::hugeint as frame_bytes, stored, 'missing' as status from rows_ where doc_id % 31 = 0
  union all select 20000000000 + doc_id, segment, 4611686018427387909, 4611686018427387904::hugeint, stored, case when stored then 'inconsistent' else 'missing' end from rows_ where doc_id % 37 = 0
),
claims_ as (select segment, archive_offset, frame_bytes::hugeint as frame_bytes from rows_ union all select segment, archive_offset, frame_bytes from wild_),
bad_ as (select doc_id, segment, archive_offset, status from records_ where status <> 'available' union all select doc_id, segment, archive_offset, status from wild_),
items as (
  select 'doc ' || doc_id as subject, 'CataloguedInconsistent' as status, 'unsafe-automatic-repair' as disposition, 'diagnose the physical/catalogue contradiction; do not re-link' as proposed_action from bad_ r
  where status = 'missing' and exists (select 1 from states_ s where s.segment = r.segment and s."offset" = r.archive_offset and state = 'inconsistent')
  union all
  select 'doc ' || doc_id, 'PhysicallyMissing', case when coalesce(invalid, 0) > 0 or coalesce(refetchable, 0) > 1 or coalesce(deleted, 0) > 0 and coalesce(refetchable, 0) > 0 then 'unsafe-automatic-repair'
    when refetchable = 1 then 'source' when deleted > 0 then 'user-choice' else 'unrecoverable-locally' end,
    case when coalesce(invalid, 0) > 0 or coalesce(refetchable, 0) > 1 or coalesce(deleted, 0) > 0 and coalesce(refetchable, 0) > 0 then 'resolve source identity before any re-fetch'
    when refetchable = 1 then 'RefetchGmailMessage or RefetchImapMessage (explicit future action)' when deleted > 0 then 'confirm whether an explicit source recovery is still desired' else 'preserve the missing claim and report it' end
  from bad_ r left join evidence using (doc_id)
  where status = 'missing' and not exists (select 1 from states_ s where s.segment = r.segment and s."offset" = r.archive_offset and state = 'inconsistent')
  union all select 'doc ' || doc_id, 'CataloguedInconsistent', 'unsafe-automatic-repair', 'diagnose and present a candidate only; do not re-link' from bad_ where status = 'inconsistent'
  union all select segment || ' @ ' || "offset", 'OrphanValidated', 'salvage', 'retain in place and optionally export byte-exactly/manifest it' from states_ where state = 'orphan'
  union all select segment || ' @ ' || "offset", 'PhysicalCorruption', 'unsafe-automatic-repair', 'preserve evidence; recover only from a verified source or backup' from states_ where state = 'corrupt'
  union all
  select segment || ' @ ' || "offset", 'IncompleteTail', case when exists (
      select 1 from claims_ r where r.segment = s.segment and s."offset" < r.archive_offset + r.frame_bytes and r.archive_offset < s."offset" + s.frame_bytes) then 'unsafe-automatic-repair' else 'cleanup-candidate' end,
    'consider future terminal-tail cleanup only after explicit safety proof'
  from states_ s where state = 'tail'
)
select subject, status, disposition, proposed_action, count(*) as n from items group by all
""")
def recovery_plan(spark: SparkSession, folder: str) -> DataFrame:
    """With claims of 2**62 bytes, and of ends beyond 64 bits, among the catalogue's rows."""
    sound, held = catalogue_rows(spark, folder), frames(spark, folder)
    huge = F.lit(2**62)
    long = sound.filter("doc_id % 31 = 0").withColumns({"doc_id": F.col("doc_id") + 10_000_000_000, "archive_offset": F.col("archive_offset") + 500, "frame_bytes": huge})
    beyond = sound.filter("doc_id % 37 = 0").withColumns({"doc_id": F.col("doc_id") + 20_000_000_000, "archive_offset": huge + 5, "frame_bytes": huge})
    rows = sound.unionByName(long).unionByName(beyond)
    records = kept(integrity.record_inventory(rows, held, segment_table(spark, folder), ("segment", "archive_offset")), "records")
    classified = kept(integrity.classify_frames(held, rows), "classified")
    plan = recovery.plan_items(records, rows, classified, recovery.source_evidence(*evidence_rows(spark, folder)))
    return plan.groupBy("subject", "status", "disposition", "proposed_action").agg(F.count("*").alias("n"))


@query("""
with g as (select l_orderkey as doc_id, count(*) filter (l_returnflag = 'N') as refetchable, count(*) filter (l_returnflag = 'R') as deleted, count(*) filter (l_returnflag = 'A') as invalid, count(*) as n_identities from lineitem group by 1)
select doc_id, refetchable, deleted, invalid, n_identities, case when invalid > 0 or refetchable > 1 or deleted > 0 and refetchable > 0 then 'unsafe-automatic-repair'
  when refetchable = 1 then 'source' when deleted > 0 then 'user-choice' else 'unrecoverable-locally' end as disposition from g
""")
def recovery_evidence(spark: SparkSession, folder: str) -> DataFrame:
    found = recovery.source_evidence(*evidence_rows(spark, folder))
    return found.select("doc_id", "refetchable", "deleted", "invalid", F.size("identities").cast("long").alias("n_identities"), recovery.missing_disposition().alias("disposition"))


@query("select o_orderkey as doc_id, o_orderstatus as source_state, case when o_orderkey % 2 = 0 then '[\"' || o_orderpriority || '\"]' else '[]' end as label_ids, case when o_orderkey % 2 = 0 then epoch_ms(o_orderdate) else 0 end as timestamp_ms from orders")
def catalogue_union_join(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    key, state = F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("source_state")
    gmail = orders.filter("o_orderkey % 2 = 0").select(key, F.lit("gmail:a").alias("source_account"), state, F.to_json(F.array("o_orderpriority")).alias("label_ids"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("internal_date_ms"), F.lit("1").alias("message_history_id"))
    imap = orders.filter("o_orderkey % 2 = 1").select(key, F.lit("imap:a").alias("source_account"), state, F.lit(None).cast("long").alias("internal_date_ms"))
    return catalogue.union_rows(gmail, imap, catalogue_rows(spark, folder)).select("doc_id", "source_state", "label_ids", "timestamp_ms")


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as known from customer")
def exists_key(spark: SparkSession, folder: str) -> DataFrame:
    held = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return exists_by_key(table(spark, folder, "customer").select("c_custkey"), held, ["c_custkey"])


@query("""
select o_orderkey as doc_id from orders o where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'A')
""")
def guard_exists_not_exists(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_returnflag")
    wanted = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return catalogue.guarded(wanted, lines.filter("l_returnflag = 'R'"), ["doc_id"], lines.filter("l_returnflag = 'A'"), ["doc_id"])


@query("""
with a as (select l_orderkey, l_linenumber, l_suppkey, epoch_ms(l_shipdate) // 86400000 as d from lineitem),
b as (select c_custkey % 1000 as l_suppkey, o_custkey, epoch_ms(o_orderdate) // 86400000 as d from orders join customer on c_custkey = o_custkey)
select l_orderkey, l_linenumber from a where exists (select 1 from b where b.l_suppkey = a.l_suppkey and a.d < b.d + 30 and b.d < a.d + 20)
""")
def interval_overlap_semi(spark: SparkSession, folder: str) -> DataFrame:
    """Shipments of 20 days that meet an order of 30 days with the same number."""
    days = lambda c: F.unix_date(F.col(c).cast("date")).cast("long").alias("d")
    a = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", days("l_shipdate")).withColumn("e", F.col("d") + 20)
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") % 1000).alias("l_suppkey"))
    b = table(spark, folder, "orders").select("o_custkey", days("o_orderdate")).join(customers, "o_custkey").select("l_suppkey", "d", (F.col("d") + 30).alias("e"))
    return integrity.overlapping(a, b, "l_suppkey", ("d", "e"), ("d", "e")).select("l_orderkey", "l_linenumber")


_DIFF = """
with now as (select o_orderkey as doc_id, case when o_orderstatus = 'P' then 'deleted' else 'present' end as s, o_orderpriority as p from orders where o_orderkey % 5 <> 0),
before as (select o_orderkey as doc_id, case when o_orderkey % 6 = 0 or o_orderstatus = 'P' and o_orderkey % 2 = 0 then 'deleted' else 'present' end as s, case when o_orderkey % 7 = 0 then 'old' else o_orderpriority end as p from orders where o_orderkey % 3 <> 0)
select doc_id, case when n.s = 'present' then case when {same} then 'recheck' else 'index' end
  when b.doc_id is not null and (n.doc_id is null or not (n.s = b.s and n.p = b.p)) then 'remove' else 'skip' end as action
from now n full join before b using (doc_id)
"""


def _diff_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders")
    row = lambda s, p: [F.col("o_orderkey").alias("doc_id"), s.alias("source_state"), p.alias("label_ids"), F.lit(0).cast("long").alias("timestamp_ms"), F.lit("1").alias("message_history_id"), F.lit(None).cast("binary").alias("raw_digest")]
    p = F.col("o_orderstatus") == "P"
    now = orders.filter("o_orderkey % 5 <> 0").select(row(F.when(p, "deleted").otherwise("present"), F.col("o_orderpriority")))
    old = F.when((F.col("o_orderkey") % 6 == 0) | p & (F.col("o_orderkey") % 2 == 0), "deleted").otherwise("present")
    before = orders.filter("o_orderkey % 3 <> 0").select(row(old, F.when(F.col("o_orderkey") % 7 == 0, "old").otherwise(F.col("o_orderpriority"))))
    return now, before


@query(_DIFF.replace("{same}", "n.s = b.s and n.p = b.p"))
def snapshot_diff_actions(spark: SparkSession, folder: str) -> DataFrame:
    return index.diff(*_diff_tables(spark, folder))


@query(_DIFF.replace("{same}", "false"))
def snapshot_diff_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    return index.diff(*_diff_tables(spark, folder), rebuild=True)


@query("select o_orderkey, case when o_orderstatus = 'O' and o_custkey % 3 <> 0 then 'deleted' when o_orderstatus = 'O' then 'present' else 'deleted' end as source_state from orders")
def tombstone_missing(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "O", "present").otherwise("deleted").alias("source_state"))
    return catalogue.tombstone_missing(orders, orders.filter("o_custkey % 3 = 0"), ["o_orderkey"]).select("o_orderkey", "source_state")


@query("""
with old as (select o_custkey as k, min(o_orderkey) as v from orders group by 1), new as (select user_id as k, max(event_id) as v from events group by 1)
select k, case when n.v is not null then greatest(n.v, coalesce(o.v, n.v)) else o.v end as v from old o full join new n using (k)
""")
def upsert_frontier(spark: SparkSession, folder: str) -> DataFrame:
    old = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("v"))
    new = table(spark, folder, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("event_id").alias("v"))
    return catalogue.merge(old, new, ["k"], {"v": F.greatest("old.v", "new.v")})


_RANK = "min(case when upto > floor((total - 1) * {f} + 0.5) then v end) as {n}"


@query("""
with c as (select l_returnflag, l_quantity as v, count(*) as k from lineitem group by all),
r as (select *, sum(k) over (partition by l_returnflag order by v) as upto, sum(k) over (partition by l_returnflag) as total from c)
select l_returnflag, """ + ", ".join(_RANK.format(f=f, n=n) for n, f in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + " from r group by 1")
def nearest_rank_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_rank(table(spark, folder, "lineitem"), "l_quantity", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ["l_returnflag"])


@query("""
with s as (select list_sort(list(n_chars)) as v, count(*) as n, sum(n_chars)::bigint as bytes, min(n_chars) as lo, max(n_chars) as hi, sum(n_chars - doc_id % 50)::bigint as tx from documents)
select n as messages, bytes, lo as min_bytes, hi as max_bytes, bytes // n as mean_bytes, tx as mime_text_bytes, v[(floor((n - 1) * 0.9 + 0.5))::int + 1] as p90_bytes, v[(floor((n - 1) * 0.99 + 0.5))::int + 1] as p99_bytes, v[(n // 2) + 1] as median_bytes from s
""")
def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("attached", F.col("doc_id") % 50)
    return statistics.corpus_stats(docs, "n_chars", "attached")


def _attachments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.col("n_chars").alias("bytes"))


@query("""
with h as (select sha256(text) as h, count(*) as n, min(n_chars) as size, sum(n_chars) as total from documents group by 1)
select sum(n)::bigint as attachments, sum(total)::bigint as attachment_bytes, count(*) as unique_hashes, sum(size)::bigint as unique_bytes, (sum(n) - count(*))::bigint as duplicate_objects, (sum(total) - sum(size))::bigint as duplicate_bytes from h
""")
def dedup_economics(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.dedup_economics(_attachments(spark, folder))


@query("select size, sum(n - 1)::bigint as n from (select min(n_chars) as size, count(*) as n from documents group by sha256(text)) where n > 1 group by size")
def duplicate_size_multiset(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.duplicate_sizes(_attachments(spark, folder))


@query("""
with d as (select list_sort(flatten(list(list_resize([size], n - 1, size)))) as v from (select min(n_chars) as size, count(*) as n from documents group by sha256(text)) where n > 1)
select v[(floor((len(v) - 1) * 0.5 + 0.5))::int + 1] as p50, v[(floor((len(v) - 1) * 0.9 + 0.5))::int + 1] as p90 from d
""")
def duplicate_size_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.duplicate_size_ranks(_attachments(spark, folder), {"p50": 0.5, "p90": 0.9})


@query("""
select category, count(*) as n, sum(p_size)::bigint as bytes from (
  select p_size, case p_partkey % 7 when 0 then 'image' when 1 then 'pdf' when 2 then 'zip' when 3 then 'office' when 4 then 'other_application' end as category from part) where category is not null group by 1
""")
def mime_category_rollup(spark: SparkSession, folder: str) -> DataFrame:
    kinds = ("IMAGE/png", "application/pdf", "application/x-zip-compressed", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/octet-stream", "text/plain", "audio/ogg")
    mime = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 7 + 1).cast("int"))
    parts = table(spark, folder, "part").select(mime.alias("mime"), F.col("p_size").cast("long").alias("decoded_bytes"))
    return statistics.category_rollup(parts)


_REPORT_GROUPS = {"attachment": "leaf and d = 'attachment'", "inline": "leaf and d = 'inline'", "named": "leaf and f", "candidate": "leaf and (d = 'attachment' or f)", "content_id": "leaf and c", "large_candidate": "leaf and (d = 'attachment' or f) and enc >= 65536"}


@query("""
with p as (select l_linenumber <> 7 as leaf, case when l_returnflag = 'R' then 'attachment' else 'inline' end as d, l_linestatus = 'O' as f, l_linenumber = 3 as c, l_partkey * 20 as enc, l_partkey * 15 as dec, l_partkey as h from lineitem)
select count(*) as parts, count(*) filter (leaf) as leaves, """ + ", ".join(f"count(*) filter ({w}) as {n}_n, coalesce(sum(enc) filter ({w}), 0)::bigint as {n}_encoded, coalesce(sum(dec) filter ({w}), 0)::bigint as {n}_decoded" for n, w in _REPORT_GROUPS.items()) + """,
  count(distinct h) filter (leaf and (d = 'attachment' or f)) as unique_objects, (select sum(h * 15)::bigint from (select distinct h from p where leaf and (d = 'attachment' or f))) as unique_bytes from p
""")
def mime_report(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    parts = lines.select(
        (F.col("l_linenumber") != 7).alias("leaf"), F.when(F.col("l_returnflag") == "R", "attachment").otherwise("inline").alias("disposition"), F.when(F.col("l_linestatus") == "O", "name").alias("filename"),
        F.when(F.col("l_linenumber") == 3, "cid").alias("content_id"), (F.col("l_partkey") * 20).alias("encoded_bytes"), (F.col("l_partkey") * 15).alias("decoded_bytes"), F.col("l_partkey").alias("digest"),
    )
    return statistics.mime_report(parts)


@query("select max(o_orderkey) + 1 as next_id from orders")
def next_id(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.next_doc_id(table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id")))


@query("select o_orderkey, 1000 + row_number() over (order by o_orderdate, o_orderkey) - 1 as doc_id from orders")
def contiguous_ids(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue.allocate_ids(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 1000).select("o_orderkey", "doc_id")


@query("""
with recursive s as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as k from documents),
w as (
  select source, doc_id, n_chars, k, 0 as segment_number, 0::bigint as "offset" from s where k = 1
  union all
  select s.source, s.doc_id, s.n_chars, s.k, case when w."offset" + w.n_chars > 0 and w."offset" + w.n_chars + s.n_chars > 20000 then w.segment_number + 1 else w.segment_number end,
    case when w."offset" + w.n_chars > 0 and w."offset" + w.n_chars + s.n_chars > 20000 then 0 else w."offset" + w.n_chars end
  from w join s on s.source = w.source and s.k = w.k + 1
)
select source, doc_id, segment_number, "offset" from w
""")
def segment_bins(spark: SparkSession, folder: str) -> DataFrame:
    return segments.assign_segments(table(spark, folder, "documents"), "doc_id", "n_chars", "source", 20_000).select("source", "doc_id", "segment_number", "offset")


_EVENTS = """
with e as (select event_id, user_id as message_id, event_type = 'error' as negative, strftime(ts, '%Y-%m-%d %H') as record from events),
i as (select *, case when lag(record) over (partition by message_id order by event_id) is not distinct from record then 0 else 1 end as s from e),
r as (select *, sum(s) over (partition by message_id order by event_id)::integer as run from i),
g as (select message_id, run, min(record) as record, bool_or(not negative) as positive, bool_or(negative) as neg from r group by all)
"""


def _feed(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "deleted").otherwise("labels")
    return table(spark, folder, "events").select("event_id", F.col("user_id").alias("message_id"), kind.alias("kind"), F.date_format("ts", "yyyy-MM-dd HH").alias("record"))


@query(_EVENTS + "select message_id, run, record, positive, neg as negative from g")
def feed_run_islands(spark: SparkSession, folder: str) -> DataFrame:
    return sync.runs(_feed(spark, folder), ["event_id"])


@query(_EVENTS + "select distinct message_id from g where positive and neg")
def feed_ambiguous_runs(spark: SparkSession, folder: str) -> DataFrame:
    return sync.ambiguous(sync.runs(_feed(spark, folder), ["event_id"]))


_FOLD = _EVENTS + """,
st as (
  select message_id, run, record, case when positive and neg then message_id % 2 = 0 else positive end as present, positive and neg and message_id % 2 <> 0 as cleared from g
),
last_ as (select message_id, arg_max(present, run) as present, arg_max(record, run) as record, coalesce(max(run) filter (present), 0) > coalesce(max(run) filter (cleared), 0) as needed from st group by 1)
select message_id, case when present and message_id % 3 = 0 then 'repair' when present then 'import' when message_id % 3 = 0 then 'tombstone' when needed then 'import-then-tombstone' else 'ignore' end as action,
  case when present then '' else record end as delete_history
from last_
"""


@query(_FOLD)
def feed_last_run_wins(spark: SparkSession, folder: str) -> DataFrame:
    runs = sync.runs(_feed(spark, folder), ["event_id"])
    ids = table(spark, folder, "events").select(F.col("user_id").alias("message_id")).distinct()
    found = sync.fold(runs, ids.filter("message_id % 3 = 0"), ids.withColumn("found", F.col("message_id") % 2 == 0))
    return found.select("message_id", "action", F.coalesce("delete_history", F.lit("")).alias("delete_history"))


@query(_FOLD)
def feed_stateful(spark: SparkSession, folder: str) -> DataFrame:
    """The same fold as a stream: three pages of the feed and one of answers, each a run of its own from the checkpoint."""
    rows = _feed(spark, folder).select(F.col("message_id").cast("string").alias("message_id"), "record", F.col("event_id").alias("position"), "kind")
    last = rows.agg(F.coalesce(F.max("position"), F.lit(0))).first()[0]
    pages, state = scratch_folder(spark), scratch_folder(spark)
    for lo, hi in ((-1, last // 3), (last // 3, last // 2), (last // 2, last)):
        feed.write_page(rows.filter(F.col("position").between(lo + 1, hi)), pages, lo + 1, hi)
        feed.Feed(spark, pages, state).run()
    known = rows.filter("message_id % 3 = 0")
    asked = feed.Feed(spark, pages, state).rows().filter("ask")
    answer = F.when(F.col("message_id") % 2 == 0, feed.FOUND).otherwise(feed.GONE)
    feed.write_page(asked.select("message_id", F.lit(None).cast("string").alias("record"), F.lit(last + 1).alias("position"), answer.alias("kind")), pages, last + 1, last + 1)
    feed.Feed(spark, pages, state).run()
    found = feed.actions(feed.Feed(spark, pages, state).rows(), known)
    return found.select(F.col("message_id").cast("long").alias("message_id"), "action", F.coalesce("delete_history", F.lit("")).alias("delete_history"))


_HTML = r"""regexp_replace(regexp_replace(regexp_replace(html, '<\s*(?:script|style)[^>]*>.*?(?:<\s*/(?:script|style)[^>]*>|$)', '', 'gis'), '<\s*(?:br|/p|/div)[^>]*>', chr(10), 'gi'), '<[^>]*(?:>|$)', '', 'g')"""
_PLAIN = f"replace(replace(replace(replace({_HTML}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"


@query(rf"""
select page_id, array_to_string(list_transform(list_filter(regexp_split_to_array({_PLAIN}, '\s+'), lambda w: w <> ''), lambda w: case when starts_with(w, 'http://') or starts_with(w, 'https://') or starts_with(w, 'www.') then '[lien externe]' else w end), ' ') as body from pages
""")
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", text.html_text("html").alias("body"))


@query(r"select page_id, array_to_string(list_transform(list_filter(regexp_split_to_array(url || ' seen at ' || url, '\s+'), lambda w: w <> ''), lambda w: case when regexp_matches(w, '^(https?://|www\.)') then '[lien externe]' else w end), ' ') as hidden from pages")
def html_url_hide(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", text.hide_urls(F.concat("url", F.lit(" seen at "), "url")).alias("hidden"))


@query("select doc_id, strlen(text)::bigint as raw_bytes, sha256(text) as digest from documents")
def cas_reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    raw = docs.select("doc_id", F.encode(F.col("text"), "UTF-8").alias("raw"))
    marked = raw.select("doc_id", F.concat("raw", F.encode(F.lit("\r\n--attachment; filename=a\r\n"), "UTF-8"), "raw").alias("raw"))
    cut = cas.externalise(marked, 100)
    whole = cas.reconstruct(cas.references(cut), cas.blobs(cut)).join(raw.withColumnRenamed("raw", "plain"), "doc_id")
    tail = F.expr("substring(raw, octet_length(plain) + 29)")
    return whole.select("doc_id", F.octet_length("plain").cast("long").alias("raw_bytes"), F.sha2(tail, 256).alias("digest"))


@query("""
with h as (select 7919 * i + 104729 as x, i from (select doc_id as i from documents)), r as (select i, x % 1000003 as h from h),
p as (
  select i as doc_id, h, h % 100 as a, (h // 11) % 100 as m, (h // 7) % 100 as z, (h // 3) % 100 as t from r
)
select doc_id, case when a < 22 then 0 when a < 34 then 1 when a < 43 then 2 else 3 + h % 997 end as sender_rank,
  (case when a < 55 then 'INBOX' else 'ARCHIVE' end) || (case when a < 18 then ',SENT' else '' end) || (case when a < 30 then ',WORK' else '' end) || (case when a < 8 then ',STARRED' else '' end) || (case when h % 13 = 0 then ',IMPORTANT' else '' end) as labels,
  case when m < 35 then 'image/jpeg' when m < 60 then 'application/pdf' when m < 75 then 'text/csv' when m < 85 then 'application/zip' else 'application/octet-stream' end as mime,
  case when z < 80 then 40000 else 900000 end::bigint as size,
  1767225600000 - 86400000 * case when t < 45 then h % 730 when t < 75 then 730 + h % 1095 when t < 90 then 1825 + h % 1095 else 2920 + h % 1095 end as timestamp_ms
from p
""")
def synthetic_population(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "documents").count()
    return synthetic.population(spark, n).withColumn("labels", F.array_join("labels", ","))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') as shown, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def format_date(spark: SparkSession, folder: str) -> DataFrame:
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    day = dates.civil_date(F.floor(ms / F.lit(dates.DAY_MS))).cast("string")
    return table(spark, folder, "orders").select("o_orderkey", dates.format_ms(ms).alias("shown"), day.alias("day"))


@query("""
with b as (select o_orderkey, o_orderkey * o_orderkey * 37 as v from orders),
s as (select *, case when v >= 1099511627776 then 4 when v >= 1073741824 then 3 when v >= 1048576 then 2 when v >= 1024 then 1 else 0 end as k from b),
t as (select *, floor(v * 10 / pow(1024, k) + 0.5)::bigint as d from s)
select o_orderkey, case when k = 0 then v || ' B' else (d // 10) || '.' || (d % 10) || ' ' || ['KiB', 'MiB', 'GiB', 'TiB'][k] end as shown from t
""")
def format_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", formatting.human_bytes(F.col("o_orderkey") * F.col("o_orderkey") * 37).alias("shown"))


@query(r"""
select doc_id, regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(source || ' ' || text, '[\x00-\x1f\x7f<>:"/\\|?*]', '_', 'g'), '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 96), '[ .]+$', '') || '.eml' as name from documents
""")
def eml_filename(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", formatting.eml_filename(F.col("source"), F.col("text"), F.col("doc_id")).alias("name"))


@query("select c_custkey, case when k = 1 then n else regexp_replace(n, '\\.[^.]*$', '') || '-' || k || '.txt' end as destination from (select c_custkey, c_mktsegment || '.txt' as n, row_number() over (partition by c_mktsegment order by c_custkey) as k from customer)")
def collision_free_names(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit(".txt")).alias("name"))
    return formatting.collision_free(named, "name", "c_custkey").select("c_custkey", "destination")


@query("select date_trunc('day', ts) as day, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def stream_daily_window(spark: SparkSession, folder: str) -> DataFrame:
    return event_windows.daily_counts(table(spark, folder, "events")).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as s from events),
n as (select *, sum(s) over (partition by user_id order by ts, s desc rows unbounded preceding) as k from g)
select user_id, min(ts) as start, max(ts) + interval '6 hours' as "end", count(*) as n from n group by user_id, k
""")
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    found = event_windows.sessions(table(spark, folder, "events"), "6 hours")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("select distinct event_id, user_id, event_type from events")
def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    return event_windows.distinct_events(rows.unionByName(rows)).select("event_id", "user_id", "event_type")
