"""Segments, batches, providers, sync and exact repair over the driver's tables: what is written first and then read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import formatting, hashes
from ..operators import catalogue, index, integrity, mime, reconcile, recovery, statistics
from ..operators.search import SearchRequest, filters
from ..operators.stored_index import NothingIndexed, StoredIndex
from ..schemas import CATALOGUE, INDEXED_DOCS, SEARCH_DOCS, SchemaError, validate
from ..session import kept, scratch_folder, spread, table
from ..sources import config, export, providers, segments
from ..streaming import publish, sync
from .engine_queries import evidence_rows
from .parsing_queries import multipart
from .registry import query
from .views import MESSAGES, START_MS, messages, tokens_sql

LIMIT = 1 << 20
#: Segments that a query reads by a filter each.
FILTERED = 8


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents")).select("doc_id", F.encode("text", "UTF-8").alias("raw"))


def _archive(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """A folder of segments of ``documents``, and their catalogue rows."""
    path = f"{scratch_folder(spark)}/raw"
    placed = segments.write_segments(_records(spark, folder), path, LIMIT)
    digests = _records(spark, folder).select("doc_id", F.unhex(F.sha2("raw", 256)).alias("raw_digest"))
    rows = placed.withColumnRenamed("offset", "archive_offset").join(digests, "doc_id")
    return path, rows.withColumn("message_id", F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit(">"))).withColumn("folder", F.lit(""))


# segments (SRC-1..12, SRC-40, INT-4..6)


@query("select doc_id, 32 + strlen(text)::bigint as frame_bytes, sha256(text) as digest, 'valid' as status from documents")
def segment_scan(spark: SparkSession, folder: str) -> DataFrame:
    path, _ = _archive(spark, folder)
    found = segments.read_frames(spark, path)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "frame_bytes", F.lower(F.hex("raw_digest")).alias("digest"), "status")


@query("select doc_id, sha256(text) as digest from documents where doc_id % 7 = 0")
def segment_point_reads(spark: SparkSession, folder: str) -> DataFrame:
    path, rows = _archive(spark, folder)
    wanted = rows.filter("doc_id % 7 = 0")
    found = segments.seek_frames(spark, path, wanted.select("segment", F.col("archive_offset").alias("offset")))
    return integrity.validated_raw(found, wanted).select("doc_id", F.sha2("raw", 256).alias("digest"))


@query("select doc_id, md5(text) as digest from documents where doc_id >= 20 and doc_id < 90 order by doc_id")
def segment_range_read(spark: SparkSession, folder: str) -> DataFrame:
    path, rows = _archive(spark, folder)
    return segments.read_range(spark, path, rows, 20, 90).select(F.col("claimed_id").alias("doc_id"), F.md5("raw").alias("digest"))


@query(f"""
select count(*) as frames, sum(32 + strlen(text))::bigint as bytes, true as ordered, true as gapless, true as within_limit, true as fresh, sum(32 + strlen(text))::bigint as directory_bytes from documents
-- a frame larger than {LIMIT} bytes stands alone
""")
def segment_sink(spark: SparkSession, folder: str) -> DataFrame:
    """What the sink promises, checked on its receipt: ids ascend within a segment, frames follow each other, new segments are new."""
    path, rows = _archive(spark, folder)
    size = segments.directory_bytes(spark, path).first()[0]  # before more is written
    per = rows.groupBy("segment").agg(
        F.count("*").alias("n"), F.sum("frame_bytes").alias("bytes"), F.max(F.col("archive_offset") + F.col("frame_bytes")).alias("end"),
        F.array_sort(F.collect_list(F.struct("archive_offset", "doc_id"))).alias("held"),
    )
    ids = F.transform("held", lambda x: x["doc_id"])
    sums = per.agg(
        F.sum("n").alias("frames"), F.sum("bytes").alias("bytes"), F.bool_and(ids == F.array_sort(ids)).alias("ordered"), F.bool_and(F.col("bytes") == F.col("end")).alias("gapless"),
        F.bool_and((F.col("bytes") <= LIMIT) | (F.col("n") == 1)).alias("within_limit"),
    )
    names = [r["segment"] for r in segments.segment_sizes(spark, path).select("segment").collect()]
    first = segments.next_segment(names, names)
    more = segments.write_segments(_records(spark, folder), path, LIMIT, first=first).select("segment").distinct()
    fresh = more.agg((F.count_if(F.col("segment").isin(names)) == 0).alias("fresh"))
    return sums.crossJoin(fresh).withColumn("directory_bytes", F.lit(size).cast("long"))  # one row each


_FNV = "list_reduce(list_prepend({start}::uhugeint, list_transform(range(1, strlen({text}) + 1), lambda i: ascii(substr({text}, i::bigint, 1))::uhugeint)), lambda v, b: (xor(v, b) * {prime}::uhugeint) % 18446744073709551616::uhugeint)"


@query(f"select c_custkey, printf('%016x', {_FNV.format(start=hashes.FNV_OFFSET, text='c_name', prime=hashes.SEGMENT_PRIME)}::ubigint) as checksum from customer")
def frame_checksums(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", hashes.fnv64_hex(F.encode("c_name", "UTF-8")).alias("checksum"))


@query("select 'doc ' || doc_id as subject, case when doc_id % 5 = 0 then 'PhysicallyMissing' else 'CataloguedInconsistent' end as status from documents where doc_id % 5 < 2")
def archive_faults(spark: SparkSession, folder: str) -> DataFrame:
    """A plan over real segments: rows that claim a segment that isn't there, and rows with another digest."""
    path, rows = _archive(spark, folder)
    k = F.col("doc_id")
    rows = rows.withColumn("segment", F.when(k % 5 == 0, "segment-999999.arc").otherwise(F.col("segment"))).withColumn("raw_digest", F.when(k % 5 == 1, F.unhex(F.sha2(F.lit("other"), 256))).otherwise(F.col("raw_digest")))
    frames = kept(segments.read_frames(spark, path).drop("raw"), "frames")
    records = integrity.record_inventory(rows, frames, segments.segment_sizes(spark, path))
    none = spark.createDataFrame([], "doc_id long, refetchable long, deleted long, invalid long, identities array<string>")
    return recovery.plan_items(records, rows, integrity.classify_frames(frames, rows), none).filter("subject like 'doc %'").select("subject", "status")


# batches (SRC-10, STR-6, STR-7, STR-20..23)


@query("select doc_id, md5(text) as digest from documents where doc_id % 3 < 2")
def published_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches, one written twice and one without a marker: what readers see."""
    path, docs = scratch_folder(spark), table(spark, folder, "documents").select("doc_id", F.md5("text").alias("digest"))
    for batch in (0, 1, 1):
        publish.publish_batch({"messages": docs.filter(F.col("doc_id") % 3 == batch)}, path, batch)
    docs.filter("doc_id % 3 = 2").write.parquet(f"{path}/messages/batch=2")
    return publish.published(spark, path, "messages")


@query("""
with recursive s as (select o_orderkey as doc_id, o_custkey % 64 as writer, (o_totalprice * 10)::bigint as size, row_number() over (partition by o_custkey % 64 order by o_orderkey) as i from orders),
w as (
  select writer, doc_id, i, 0 as batch, 1 as n, size as held from s where i = 1
  union all
  select s.writer, s.doc_id, s.i, case when w.n >= 64 or w.held >= 8388608 then w.batch + 1 else w.batch end, case when w.n >= 64 or w.held >= 8388608 then 1 else w.n + 1 end,
    case when w.n >= 64 or w.held >= 8388608 then s.size else w.held + s.size end
  from w join s on s.writer = w.writer and s.i = w.i + 1
)
select writer, doc_id, batch from w
""")
def batch_numbers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 64).alias("writer"), F.round(F.col("o_totalprice") * 10).cast("long").alias("size"))
    return sync.batch_numbers(rows, "doc_id", "size", "writer").select("writer", "doc_id", "batch")


@query("select (select count(*) from orders where o_orderkey % 4 = 0) as missing, (select count(*) from orders where o_orderkey % 9 = 0 and o_orderkey % 4 <> 0) as extra, false as bytes_match")
def batch_coverage(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") + 32).alias("frame_bytes"))
    return sync.covers(rows.filter("doc_id % 4 <> 0"), rows.filter("doc_id % 9 <> 0 or doc_id % 4 = 0"), ["doc_id"])


# providers (SRC-23..35, STR-26, STR-27, UDX-1, UDX-2)


def _transport(spark: SparkSession, folder: str) -> providers.TableTransport:
    """``orders`` as exported provider files: RAW messages, history pages of a hundred records, a profile."""
    path, orders = scratch_folder(spark), table(spark, folder, "orders")
    key = F.col("o_orderkey")
    text = F.concat(F.lit("Subject: order "), key.cast("string"), F.lit("\r\n\r\n"), F.col("o_orderpriority"))
    raw = F.regexp_replace(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), "[=\r\n]", "")
    orders.select(
        key.cast("string").alias("id"), F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("threadId"), F.array(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("labelIds"), (key + 1).cast("string").alias("historyId"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string").alias("internalDate"), raw.alias("raw"),
    ).write.json(f"{path}/raw")
    ref = F.struct(F.struct(key.cast("string").alias("id"), F.lit("t").alias("threadId")).alias("message"))
    none = F.array().cast("array<struct<message: struct<id: string, threadId: string>>>")
    record = F.struct(key.cast("string").alias("id"), F.when(key % 3 == 0, F.array(ref)).otherwise(none).alias("messagesAdded"), F.when(key % 3 == 1, F.array(ref)).otherwise(none).alias("messagesDeleted"))
    pages = orders.groupBy(F.expr("o_orderkey div 100").alias("page")).agg(F.array_sort(F.collect_list(record)).alias("history"), F.max("o_orderkey").cast("string").alias("historyId"))
    pages.write.json(f"{path}/history")
    spark.createDataFrame([("archive@mail.example", "77")], "emailAddress string, historyId string").write.json(f"{path}/profile")
    return providers.TableTransport(spark, path)


@query("select o_orderkey::varchar as id, 't' || o_custkey as thread, o_orderpriority || ',' || o_orderstatus as labels, (o_orderkey + 1)::varchar as history from orders where o_orderstatus = 'F'")
def provider_listing(spark: SparkSession, folder: str) -> DataFrame:
    rows = _transport(spark, folder).listing(query="label:F")
    return rows.select("id", F.col("threadId").alias("thread"), F.array_join("labelIds", ",").alias("labels"), F.col("historyId").alias("history"))


@query("select o_orderkey::varchar as id, epoch_ms(o_orderdate) as internal_date_ms, md5('Subject: order ' || o_orderkey || chr(13) || chr(10) || chr(13) || chr(10) || o_orderpriority) as digest from orders where o_orderkey % 4 = 0")
def provider_raw(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").cast("string").alias("id"))
    rows = providers.decoded_messages(_transport(spark, folder).raw(ids))
    return rows.select("id", "internal_date_ms", F.md5("raw").alias("digest"))


@query("select 'archive@mail.example' as email, '77' as history, 'gmail:' || sha256('archive@mail.example') as account")
def provider_profile(spark: SparkSession, folder: str) -> DataFrame:
    email, history = _transport(spark, folder).profile()
    return spark.createDataFrame([(email, history, providers.account_of(f" {email.upper()} "))], "email string, history string, account string")


@query("select o_orderkey::varchar as record, case o_orderkey % 3 when 0 then 'added' else 'deleted' end as kind, o_orderkey::varchar as message_id from orders where o_orderkey % 3 < 2 and o_orderkey > 50")
def provider_history(spark: SparkSession, folder: str) -> DataFrame:
    return sync.flatten_history(_transport(spark, folder).history("50")).select("record", "kind", "message_id")


@query("""
select n_name as mailbox, '/' as delimiter, case n_nationkey % 3 when 0 then '["sent"]' when 1 then '["trash","flagged"]' else '[]' end as special_use, (n_nationkey % 3 <> 2)::integer as selectable from nation
""")
def mailbox_listing(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("n_nationkey") % 3
    attributes = F.when(kind == 0, F.array(F.lit("\\Sent"), F.lit("\\HasNoChildren"))).when(kind == 1, F.array(F.lit("\\Trash"), F.lit("\\Flagged"))).otherwise(F.array(F.lit("\\Noselect")))
    listed = table(spark, folder, "nation").select(F.col("n_name").alias("name"), F.lit("/").alias("delimiter"), attributes.alias("attributes"))
    return providers.mailboxes(listed).drop("attributes")


@query("select distinct 'imap:u@h:993' as source_account, 'INBOX' as mailbox, 1::bigint as uid_validity, o_orderkey as uid from orders where o_orderkey between 101 and 1100 and o_orderkey % 5 <> 0")
def uid_range(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.lit("imap:u@h:993").alias("source_account"), F.lit("INBOX").alias("mailbox"), F.lit(1).cast("long").alias("uid_validity"), F.col("o_orderkey").alias("uid"))
    return sync.new_uids(rows.unionByName(rows), rows.filter("uid % 5 = 0"), 100, 1000, 1 << 40)


@query("""
select o_orderkey as uid, case when o_orderkey % 2 = 0 then '["\\\\Flagged","\\\\Seen"]' else '[]' end as flags, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as internal_date, epoch_ms(o_orderdate) as internal_date_ms, strlen(o_orderpriority)::bigint as rfc822_size from orders
""")
def fetched_rows(spark: SparkSession, folder: str) -> DataFrame:
    flags = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("\\Seen"), F.lit("\\Flagged"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("uid"), flags.alias("flags"), F.col("o_orderdate").cast("timestamp").alias("internal_date"), F.encode("o_orderpriority", "UTF-8").alias("raw"))
    return providers.fetched_rows(rows).drop("raw")


@query("""
select name, outcome from (values ('none', 'unavailable'), ('one', 'found'), ('other', 'wrong uid'), ('two', 'ambiguous'), ('nameless', 'ambiguous'), ('empty', 'ambiguous')) as t(name, outcome)
""")
def exact_fetch(spark: SparkSession, folder: str) -> DataFrame:
    one = table(spark, folder, "region").filter("r_regionkey = 1").select(F.lit(7).cast("long").alias("uid"), F.encode("r_name", "UTF-8").alias("raw"))
    cases = {
        "none": one.limit(0), "one": one, "other": one.withColumn("uid", F.lit(8).cast("long")), "two": one.union(one), "nameless": one.withColumn("uid", F.lit(None).cast("long")), "empty": one.withColumn("raw", F.lit(None).cast("binary")),
    }
    found = [providers.resolve_exact(df, 7).select(F.lit(name).alias("name"), "outcome") for name, df in cases.items()]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("select c_custkey, c_custkey % 4 in (0, 3) as canonical from customer")
def account_names(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    host = F.concat(F.lit("h"), k.cast("string"))
    name = F.when(k % 4 == 0, F.concat(F.lit("imap:u@"), host, F.lit(":993"))).when(k % 4 == 1, F.concat(F.lit("imap:u@"), host, F.lit(":70000"))).when(k % 4 == 2, F.concat(F.lit("imap:u@"), host)).otherwise(F.concat(F.lit("imap:a.b@"), host, F.lit(":65535")))
    return table(spark, folder, "customer").select("c_custkey", providers.canonical_imap_account(name).alias("canonical"))


# exports and settings (SRC-36..41, FMT-9)


@query("select count(*) as written, 0::bigint as failed, sum(strlen(text))::bigint as bytes from documents")
def eml_export(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_folder(spark)
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("subject"), (F.lit(START_MS) + F.col("doc_id") * 1000).alias("timestamp_ms"), F.encode("text", "UTF-8").alias("raw"))
    results = kept(export.write_eml(export.named_eml(docs), path), "results")
    size = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path).agg(F.sum("length").alias("bytes"))
    return export.batch_summary(results).crossJoin(size)  # one row each


@query("select 'doc_id' as name, '4' as value union all select 'offset', '0' union all select 'segment', 'segment-000007.arc' union all select 'sha256', sha256(text) from documents where doc_id = 4")
def orphan_salvage(spark: SparkSession, folder: str) -> DataFrame:
    path, out = f"{scratch_folder(spark)}/raw", scratch_folder(spark)
    segments.write_segments(_records(spark, folder).filter("doc_id = 4"), path, first=7)
    rows = spark.createDataFrame([], "doc_id long, segment string, archive_offset long, frame_bytes long, raw_digest binary")
    export.write_eml(spark.createDataFrame([], "doc_id long, destination string, raw binary"), out).count()
    spark.range(1).write.parquet(out)  # the folder of the salvaged file
    manifest = export.export_orphan(integrity.classify_frames(segments.read_frames(spark, path), rows), "segment-000007.arc", 0, f"{out}/orphan.eml", path)
    return spark.createDataFrame(sorted(manifest.items()), "name string, value string")


@query("select n_regionkey, string_agg(n_name || '=' || n_nationkey, chr(10) order by n_name) as lines from nation group by 1")
def manifest_lines(spark: SparkSession, folder: str) -> DataFrame:
    entries = F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string"))))
    return table(spark, folder, "nation").groupBy("n_regionkey").agg(formatting.key_lines(entries).alias("lines"))


@query("select r_name as archive, (row_number() over (order by r_regionkey desc) - 1)::integer as position from region")
def recent_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The settings' recent archives, newest first, after each region's was opened twice."""
    names = [r["r_name"] for r in table(spark, folder, "region").orderBy("r_regionkey").collect()]  # five rows
    settings = config.Config()
    for name in (*names, *names):
        settings.remember(name)
    return spark.createDataFrame([(n, i) for i, n in enumerate(settings.archives)], "archive string, position int")


# sync (STR-1..3, STR-11, STR-12, STR-24, STR-25)

OCCURRENCES = CATALOGUE["gmail_messages"]


def _occurrences(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Known occurrences (keys not divisible by 5) and what the source lists now (keys not divisible by 4)."""
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    row = lambda state, labels, history, now: [
        F.lit("gmail:a").alias("source_account"), F.concat(F.lit("m"), key.cast("string")).alias("gmail_message_id"), key.alias("doc_id"), F.lit("t").alias("thread_id"), labels.alias("label_ids"), F.lit(5).cast("long").alias("internal_date_ms"),
        F.lit(history).alias("message_history_id"), state.alias("source_state"), F.lit(now).cast("long").alias("first_seen_unix"), F.lit(now).cast("long").alias("last_seen_unix"),
    ]
    known = orders.filter("o_orderkey % 5 <> 0").select(row(F.when(key % 7 == 0, "deleted").otherwise("present"), F.lit("[]"), "1", 1))
    listed = orders.filter("o_orderkey % 4 <> 0").select(row(F.lit("present"), F.to_json(F.array("o_orderpriority")), "9", 9)).withColumn("now", F.lit(9).cast("long"))
    return known, listed


@query("""
with k as (select o_orderkey as doc_id, o_orderpriority as p from orders where o_orderkey % 5 <> 0)
select doc_id, case when doc_id % 4 <> 0 then 'present' else 'deleted' end as source_state, case when doc_id % 4 <> 0 then '["' || p || '"]' else '[]' end as label_ids, case when doc_id % 4 <> 0 then '9' else '1' end as message_history_id, false as imported from k
union all select o_orderkey, 'present', '["' || o_orderpriority || '"]', '9', true from orders where o_orderkey % 5 = 0 and o_orderkey % 4 <> 0
""")
def sync_full(spark: SparkSession, folder: str) -> DataFrame:
    known, listed = _occurrences(spark, folder)
    assert sync.choose_sync(sync.frontier(spark.createDataFrame([], CATALOGUE["gmail_state"]), "gmail:a"), bounded=False) == "full"
    after, new = sync.apply_full(known, listed, bounded=False)
    columns = ["doc_id", "source_state", "label_ids", "message_history_id"]
    return after.select(*columns, F.lit(False).alias("imported")).unionByName(new.select(*columns, F.lit(True).alias("imported")))


@query("""
with k as (select o_orderkey as doc_id, o_orderpriority as p, o_orderkey % 5 <> 0 as known, o_orderkey % 6 as e from orders)
select doc_id, case when e = 1 then 'deleted' when e in (2, 3) then 'present' else case when doc_id % 7 = 0 then 'deleted' else 'present' end end as source_state,
  case when e in (2, 3) and doc_id % 4 <> 0 then '["' || p || '"]' else '[]' end as label_ids, case when e = 1 then doc_id::varchar when e in (2, 3) and doc_id % 4 <> 0 then '9' else '1' end as message_history_id
from k where known and not (e in (2, 3) and doc_id % 4 = 0)
union all select doc_id, case when doc_id % 7 = 0 then 'deleted' else 'present' end, '[]', '1' from k where known and e in (2, 3) and doc_id % 4 = 0
union all select doc_id, 'present', '["' || p || '"]', '9' from k where not known and e in (2, 3) and doc_id % 4 <> 0
""")
def sync_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """A feed of deletions (keys 1 modulo 6), label changes (2) and additions (3), folded and applied."""
    known, listed = _occurrences(spark, folder)
    e = F.col("o_orderkey") % 6
    kind = F.when(e == 1, "deleted").when(e == 2, "labels").when(e == 3, "added")
    feed = table(spark, folder, "orders").select(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("message_id"), kind.alias("kind"), F.col("o_orderkey").cast("string").alias("record"), F.lit(0).alias("page")).filter("kind is not null")
    state = sync.with_frontier(spark.createDataFrame([], CATALOGUE["gmail_state"]), "gmail:a", "50")
    assert sync.choose_sync(sync.frontier(state, "gmail:a"), bounded=False) == "incremental"
    folded = sync.fold(sync.runs(feed, ["page", "record"]), known.select(F.col("gmail_message_id").alias("message_id")), spark.createDataFrame([], "message_id string, found boolean"))
    return sync.apply_incremental(known, "gmail:a", folded, listed).select("doc_id", "source_state", "label_ids", "message_history_id")


@query("select r_name as mailbox, case when r_regionkey = 2 then 0 else n end as imported, case when r_regionkey = 2 then 'no such mailbox' else '' end as error from region join (select n_regionkey as r_regionkey, count(*) as n from nation group by 1) using (r_regionkey)")
def mailbox_sync(spark: SparkSession, folder: str) -> DataFrame:
    """Each region's mailbox is synced on its own; one fails."""
    names = {r["r_name"]: r["r_regionkey"] for r in table(spark, folder, "region").collect()}  # five rows

    def one(name: str) -> int:
        if names[name] == 2:
            raise ValueError("no such mailbox")
        return table(spark, folder, "nation").filter(F.col("n_regionkey") == names[name]).count()

    return publish.sync_mailboxes(spark, sorted(names), one).select("mailbox", "imported", F.coalesce("error", F.lit("")).alias("error"))


@query("""
with s as (select o_custkey % 8 as m, max(o_orderkey) as through from orders group by 1)
select 'box' || m as mailbox, 1::bigint as uid_validity, through as scanned_through_uid, through + 1 as last_uid_next from s
""")
def mailbox_frontiers(spark: SparkSession, folder: str) -> DataFrame:
    """Scan states of two scans, the second one of half the mailboxes."""
    scan = lambda rows, now: rows.groupBy((F.col("o_custkey") % 8).alias("m")).agg(F.max("o_orderkey").alias("t")).select(F.lit("imap:u@h:993").alias("source_account"), F.concat(F.lit("box"), F.col("m").cast("string")).alias("mailbox"), F.lit(1).cast("long").alias("uid_validity"), F.col("t").alias("scanned_through_uid"), (F.col("t") + 1).alias("last_uid_next"), F.lit(now).cast("long").alias("updated_unix"))
    orders = table(spark, folder, "orders")
    first = scan(orders.filter("o_custkey % 8 < 4 or o_orderkey < 1000000000"), 1).withColumn("scanned_through_uid", F.when(F.col("mailbox").isin("box0", "box1"), 3).otherwise(F.col("scanned_through_uid")))
    after = publish.with_scan_state(first, scan(orders.filter("o_custkey % 8 < 4"), 2))
    return after.select("mailbox", "uid_validity", "scanned_through_uid", "last_uid_next")


# repair (JOIN-10, REC-6..10)


@query("""
with g as (
  select l_orderkey as doc_id, count(*) as n, count(*) filter (l_returnflag = 'N') as present, any_value(l_linenumber % 2 = 0) as imap from lineitem group by 1
),
m as (select o_orderkey as doc_id, coalesce(n, 0) = 1 and coalesce(present, 0) = 1 as one, imap from orders left join g on doc_id = o_orderkey)
select doc_id, case when not one then 'refused: not one present identity' when doc_id % 5 = 0 then 'unavailable' when doc_id % 5 = 1 then 'refused: another identity' when doc_id % 5 = 2 then 'refused: digest differs' else 'repaired' end as outcome,
  coalesce(imap, false) and one and doc_id % 5 > 2 as from_mailbox from m
""")
def recovery_repair(spark: SparkSession, folder: str) -> DataFrame:
    """All orders as missing records, against what their one source returned."""
    gmail, imap = evidence_rows(spark, folder)
    evidence = kept(recovery.source_evidence(gmail, imap), "evidence")
    raw = F.encode(F.concat(F.lit("raw "), F.col("doc_id").cast("string")), "UTF-8")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"))
    held = orders.select("doc_id", F.unhex(F.sha2(raw, 256)).alias("raw_digest"))
    one = evidence.select("doc_id", F.col("identities")[0].alias("known")).filter("doc_id % 5 > 0")
    k = F.col("doc_id") % 5
    fetched = one.select("doc_id", "known.source_account", F.when(k == 1, "other").otherwise(F.col("known.identity")).alias("identity"), F.when(k == 2, F.encode(F.lit("x"), "UTF-8")).otherwise(raw).alias("raw"))
    found = recovery.repair(orders, evidence, held, fetched).join(one.select("doc_id", "known.kind"), "doc_id", "left")
    return found.select("doc_id", "outcome", (F.coalesce(F.col("kind") == "imap", F.lit(False)) & (F.col("outcome") == "repaired")).alias("from_mailbox"))


@query("""
with o as (select o_orderkey as doc_id, o_orderkey % 6 as k from orders where o_orderkey % 3 < 2)
select doc_id, case when k in (0, 1) then 'published' else 'conflict' end as outcome,
  coalesce(case k when 3 then 'the catalogue row changed' when 4 then 'not one present identity' end, case when k not in (0, 1, 3, 4) then 'odd' end, '') as reason,
  case when k in (0, 1) then 'validated' else 'orphan' end as state, case when k in (0, 1) then 1 when k = 3 then 5 else 0 end as moved
from o union all
select o_orderkey, 'conflict', case when o_orderkey % 6 = 2 then '2 catalogue rows' else '0 catalogue rows' end, 'orphan', 0 from orders where o_orderkey % 3 = 2
""")
def recovery_publish(spark: SparkSession, folder: str) -> DataFrame:
    """Exact repairs against a catalogue that changed meanwhile: rows that moved, doubled or went, identities that were deleted."""
    k = F.col("doc_id") % 6
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"))
    raw = F.encode(F.concat(F.lit("raw "), F.col("doc_id").cast("string")), "UTF-8")
    held = orders.select("doc_id", F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit(">")).alias("message_id"), F.lit("segment-999999.arc").alias("segment"), F.lit(0).cast("long").alias("archive_offset"), F.lit(1).cast("long").alias("frame_bytes"), F.unhex(F.sha2(raw, 256)).alias("raw_digest"))
    expected = kept(recovery.expected_rows(held, orders), "expected")
    path = f"{scratch_folder(spark)}/raw"
    placed = segments.write_segments(orders.withColumn("raw", raw), path, LIMIT)
    now = held.filter(k != 5).withColumn("archive_offset", F.when(k == 3, 5).otherwise(F.col("archive_offset")).cast("long"))
    now = kept(now.unionByName(held.filter(k == 2)), "now")
    state = F.when(k == 4, "deleted").otherwise("present").alias("source_state")
    gmail = orders.select("doc_id", F.lit("gmail:a").alias("source_account"), F.col("doc_id").cast("string").alias("gmail_message_id"), state)
    none = gmail.limit(0).select("doc_id", "source_account", F.lit("").alias("mailbox"), F.lit(1).cast("long").alias("uid_validity"), F.lit(1).cast("long").alias("uid"), "source_state")
    chosen = orders.select("doc_id", F.lit("gmail").alias("kind"), F.lit("gmail:a").alias("source_account"), F.col("doc_id").cast("string").alias("identity"))
    after, outcomes = recovery.publish(now, expected, recovery.source_evidence(gmail, none), chosen, placed)
    after = kept(after, "after")
    states = integrity.classify_frames(kept(segments.read_frames(spark, path).drop("raw"), "frames"), after).select(F.col("doc_id").cast("long").alias("doc_id"), "state")
    moved = after.groupBy("doc_id").agg(F.max(F.when(F.col("segment") != "segment-999999.arc", 1).otherwise(F.col("archive_offset"))).cast("int").alias("moved"))
    found = outcomes.select("doc_id", "outcome", F.coalesce("reason", F.lit("")).alias("reason"))
    return found.join(states, "doc_id").join(moved, "doc_id", "left").select("doc_id", "outcome", "reason", "state", F.coalesce("moved", F.lit(0)).alias("moved"))


def _pass_sql(i: int, name: str, key: str) -> str:
    a, b = f"a{i}", f"b{i}"
    return f"""
k{a} as (select *, {key} as k from {a}), k{b} as (select *, {key} as k from {b}),
both{i} as (select * from (select k, count(*) as n_a, min(id) as a_one from k{a} where k is not null group by k) join (select k, count(*) as n_b, min(id) as b_one from k{b} where k is not null group by k) using (k)),
out{i} as (
  select '{name}' as pass, case when n_b = 1 then 'one-to-one' else 'one-to-many' end as kind, a_one as a_id, id as b_id from k{b} join both{i} using (k) where n_a = 1
  union all select '{name}', 'many-to-one', id, b_one from k{a} join both{i} using (k) where n_a > 1 and n_b = 1
),
a{i + 1} as (select x.* exclude (k, met), case when met is not null then met when n_a is not null then '{name}' end as met from k{a} x left join both{i} using (k) where not coalesce(n_a = 1 or n_b = 1, false)),
b{i + 1} as (select x.* exclude (k, met), case when met is not null then met when n_a is not null then '{name}' end as met from k{b} x left join both{i} using (k) where not coalesce(n_a = 1 or n_b = 1, false))"""


@query(f"""
with seen as (select o_orderkey as key, md5(o_orderkey::varchar || o_orderstatus) as digest, '<' || o_orderkey || '@x>' as message_id, epoch_ms(o_orderdate) as date_ms, o_custkey as size from orders),
a0 as (select key as id, case when key % 50 = 7 then 'same' else digest end as digest, message_id, date_ms, size, null::varchar as met from seen where key % 11 <> 3),
b0 as (
  select key * 10 + copy as id, case when key % 50 = 7 then 'same' when key % 5 = 0 then md5(digest) else digest end as digest, case when key % 10 = 0 then null when key % 50 = 7 then '<swapped>' else message_id end as message_id, date_ms, size, null::varchar as met
  from seen, (select unnest([0, 1]) as copy) where key % 13 <> 5 and (copy = 0 or key % 17 = 0)
),{_pass_sql(0, "digest", "digest")},{_pass_sql(1, "message-id", "message_id")},{_pass_sql(2, "date-size", "case when date_ms is not null and size is not null then date_ms::varchar || ' ' || size::varchar end")}
select * from out0 union all select * from out1 union all select * from out2
union all select met, case when met is null then 'only-a' else 'ambiguous' end, id, null from a3 union all select met, case when met is null then 'only-b' else 'ambiguous' end, null, id from b3
""")
def reconcile_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Two views of one mailbox: rewritten bytes, lost and swapped Message-IDs, messages in two mailboxes, messages of one side."""
    key, digest = F.col("o_orderkey"), F.md5(F.concat(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")))
    message_id = F.concat(F.lit("<"), key.cast("string"), F.lit("@x>"))
    fixed = [F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("date_ms"), F.col("o_custkey").alias("size")]
    orders = table(spark, folder, "orders")
    a = orders.filter(key % 11 != 3).select(key.alias("id"), F.when(key % 50 == 7, "same").otherwise(digest).alias("digest"), message_id.alias("message_id"), *fixed)
    copies = orders.filter(key % 13 != 5).withColumn("copy", F.explode(F.when(key % 17 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    other = F.when(key % 50 == 7, "same").when(key % 5 == 0, F.md5(digest)).otherwise(digest)
    b = copies.select((key * 10 + F.col("copy")).alias("id"), other.alias("digest"), F.when(key % 10 == 0, None).when(key % 50 == 7, "<swapped>").otherwise(message_id).alias("message_id"), *fixed)
    return reconcile.reconcile(a, b)


@query("select doc_id, md5(text) as digest from documents union all select -1, md5(text) from documents where doc_id % 50 = 3")
def segment_pushdown(spark: SparkSession, folder: str) -> DataFrame:
    """All frames by the source; and, below -1, some again: of a few segments by filters that it takes, of all others by seeks.

    Each filter needs a source of its own, which Spark plans in Python, so their number may not grow with the archive.
    """
    path, rows = _archive(spark, folder)
    source = lambda: segments.read_segments(spark, path).filter("status = 'valid'")
    again = lambda frames: frames.select(F.lit(-1).cast("long").alias("doc_id"), F.md5("raw").alias("digest"))
    wanted = rows.filter("doc_id % 50 = 3").select("segment", F.col("archive_offset").alias("offset"))
    names = [r["segment"] for r in wanted.select("segment").distinct().orderBy("segment").limit(FILTERED).collect()]
    few = wanted.filter(F.col("segment").isin(names)).groupBy("segment").agg(F.collect_list("offset").alias("offsets")).collect()  # a segment has a bounded number of frames
    some = [again(source().filter((F.col("segment") == r["segment"]) & F.col("offset").isin(r["offsets"]))) for r in few]
    some.append(again(segments.seek_frames(spark, path, wanted.filter(~F.col("segment").isin(names))).filter("status = 'valid'")))
    return reduce(lambda x, y: x.unionByName(y), some, source().select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("raw").alias("digest")))


@query("select distinct l_orderkey * 10 + l_linenumber as uid from lineitem where l_linenumber % 2 = 0 and l_returnflag = 'N' and l_orderkey not in (select l_orderkey from lineitem where l_linenumber % 2 = 1)")
def guard_mailbox_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Mailbox rows that are still as expected and whose message no other source claims."""
    gmail, imap = evidence_rows(spark, folder)
    wanted = imap.select("doc_id", "mailbox", "uid_validity", "uid").distinct()
    return catalogue.guarded(wanted, imap.filter("source_state = 'present'"), ["mailbox", "uid_validity", "uid"], gmail, ["doc_id"]).select("uid")


# the stored index: maintenance, workloads, schema (IDX-1..8, AGG-14..17, IDX-15..17, FLT-2)

_CHANGED = f"""
with {MESSAGES.strip()},
now as (select doc_id, case when doc_id % 10 = 1 then 'erth ' || text else text end as body from documents where doc_id % 10 <> 2),
tok as (select doc_id, {tokens_sql("body")} as toks from now),
stats as (select count(*) as n, sum(len(toks)) / count(*) as avgdl from tok), tf as (select doc_id, len(toks) as dl, len(list_filter(toks, lambda x: x = 'erth')) as tf from tok), df as (select count(*) as df from tf where tf > 0)
select doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) as score from tf, stats, df where tf > 0 order by score desc, doc_id limit 50
"""


@query(_CHANGED)
def stored_index_update(spark: SparkSession, folder: str) -> DataFrame:
    """An index of all messages after an update that changes a tenth of them and removes another tenth."""
    docs = messages(spark, folder, all_cores=True)
    built = StoredIndex.write(docs, scratch_folder(spark))
    changed = docs.filter("doc_id % 10 = 1").withColumn("body", F.concat(F.lit("erth "), F.coalesce("body", F.lit(""))))
    after = built.update(changed, docs.filter("doc_id % 10 = 2").select("doc_id"))
    return after.search(SearchRequest(text="body:erth")).select("doc_id", "score")


@query("""
select 'built' as run, (select count(*) from documents) as indexed, 0::bigint as skipped, 0::bigint as removed, (select count(*) from documents) as found
union all select 'again', (select count(*) from documents where doc_id % 6 = 0 and doc_id % 4 <> 0), (select count(*) from documents where doc_id % 6 <> 0 and doc_id % 4 <> 0), (select count(*) from documents where doc_id % 4 = 0), (select count(*) from documents where doc_id % 4 <> 0)
""")
def stored_index_maintenance(spark: SparkSession, folder: str) -> DataFrame:
    """The maintenance run on an index on disk: everything first, then only what changed or went."""
    raw = multipart(spark, folder)  # made from documents as it is read: a copy on disk would be larger than they are
    digest = F.unhex(F.sha2("raw", 256))
    rows = raw.select(
        "doc_id", F.lit("gmail:a").alias("source_account"), F.lit("present").alias("source_state"), F.lit('["L"]').alias("label_ids"), F.lit(5).cast("long").alias("timestamp_ms"), F.lit("h").alias("message_history_id"),
        digest.alias("raw_digest"), F.lit("m").alias("message_id"), F.lit("").alias("folder"),
    )
    rows = kept(rows, "catalogue")
    records = rows.select("doc_id", F.lit("available").alias("status"))
    empty = StoredIndex.write(spark.createDataFrame([], SEARCH_DOCS), scratch_folder(spark))
    out = None
    held, marks = empty, spark.createDataFrame([], INDEXED_DOCS)
    for run, now in (("built", rows), ("again", rows.withColumn("label_ids", F.when(F.col("doc_id") % 6 == 0, '["M"]').otherwise(F.col("label_ids"))).filter("doc_id % 4 <> 0"))):
        held, marks, counts = index.maintain_stored(held, marks, now, records, raw)
        marks = kept(marks, "marks")
        row = counts.select(F.lit(run).alias("run"), "indexed", "skipped", "removed").crossJoin(held.scored("subject:note").agg(F.count("*").alias("found")))  # one row each
        out = kept(row, run) if out is None else out.unionByName(kept(row, run))
    return out


_DAY = 86_400_000
WINDOW = {"date_from": START_MS + 100 * _DAY, "date_to": START_MS + 300 * _DAY}
#: The sixteen workloads of the published baseline.
WORKLOADS = {
    "text_frequent": SearchRequest(text="body:the"), "text_rare": SearchRequest(text="body:apache"), "date_selective": SearchRequest(**WINDOW), "attachment": SearchRequest(attachment="with"),
    "without_attachment": SearchRequest(attachment="without"), "mime_image": SearchRequest(mime="image/*"), "mime_pdf": SearchRequest(mime="application/pdf"), "label_starred": SearchRequest(labels=("STARRED",)),
    "label_work": SearchRequest(labels=("fr",)), "sender_frequent": SearchRequest(sender="src0@mail.example"), "sender_fragment": SearchRequest(sender="mail"), "text_date": SearchRequest(text="body:the", **WINDOW),
    "text_attachment": SearchRequest(text="body:the", attachment="with"), "text_mime": SearchRequest(text="body:the", mime="application/pdf"), "text_label": SearchRequest(text="body:the", labels=("STARRED",)), "no_result": SearchRequest(text="body:zzzzneverthere"),
}
_IN_WINDOW = f"timestamp_ms >= {WINDOW['date_from']} and timestamp_ms < {WINDOW['date_to']}"
_WHERE = {
    "text_frequent": "the > 0", "text_rare": "apache > 0", "date_selective": _IN_WINDOW, "attachment": "mime is not null", "without_attachment": "mime is null", "mime_image": "starts_with(mime, 'image/')",
    "mime_pdf": "mime = 'application/pdf'", "label_starred": "list_contains(labels, 'STARRED')", "label_work": "list_contains(labels, 'fr')", "sender_frequent": "account = 'src0'", "sender_fragment": "true", "text_date": f"the > 0 and {_IN_WINDOW}",
    "text_attachment": "the > 0 and mime is not null", "text_mime": "the > 0 and mime = 'application/pdf'", "text_label": "the > 0 and list_contains(labels, 'STARRED')", "no_result": "false",
}
_SCORE = {name: "apache" if name == "text_rare" else "the" if name.startswith("text_") else None for name in _WHERE}


def _ranked_sql(name: str, where: str) -> str:
    """The first 50 of a workload: by score, or newest first."""
    score = f"round(ln(1 + (n - d_{w} + 0.5) / (d_{w} + 0.5)) * {w} * 2.2 / ({w} + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6)" if (w := _SCORE[name]) else "0.0::double"
    order = "score desc, doc_id" if w else "timestamp_ms desc, doc_id"
    return f"select * from (select '{name}' as workload, row_number() over (order by {order})::integer as place, doc_id, score from (select *, {score} as score from t, stats where {where})) where place <= 50"


@query(f"""
with {MESSAGES.strip()}, tok as (select *, {tokens_sql('body')} as toks from messages),
t as (select * exclude (toks), len(toks) as dl, len(list_filter(toks, lambda x: x = 'the')) as the, len(list_filter(toks, lambda x: x = 'apache')) as apache from tok),
stats as (select count(*) as n, sum(dl) / count(*) as avgdl, count(*) filter (the > 0) as d_the, count(*) filter (apache > 0) as d_apache from t)
""" + " union all ".join(_ranked_sql(name, where) for name, where in _WHERE.items()))
def benchmark_workloads(spark: SparkSession, folder: str) -> DataFrame:
    """The hits of all sixteen workloads against a stored index, in their order, as one job."""
    held = StoredIndex.write(messages(spark, folder, all_cores=True), scratch_folder(spark))
    found = held.search_all(WORKLOADS)
    order = W.partitionBy("request").orderBy(F.when(F.col("request").startswith("text_"), -F.col("score")).otherwise(-F.col("timestamp_ms")), "doc_id")  # at most 50 rows each
    return found.select(F.col("request").alias("workload"), F.row_number().over(order).alias("place"), "doc_id", "score")


def _filters_sql(name: str, where: str) -> str:
    """How many messages a workload's filters leave, whatever its text."""
    left = where.replace("the > 0 and ", "") if name.startswith("text_") and " and " in where else "true" if name.startswith("text_") or name == "no_result" else where
    return f"select '{name}' as workload, {str(WORKLOADS[name].has_filters()).lower()} as has_filters, count(*) filter ({left}) as passing from messages"


@query(f"with {MESSAGES.strip()} " + " union all ".join(_filters_sql(name, where) for name, where in _WHERE.items()))
def workload_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a workload filters, and the messages that its filters leave: one pass for all of them."""
    counts = [F.struct(F.lit(name).alias("workload"), F.lit(r.has_filters()).alias("has_filters"), F.count_if(filters(r)).alias("passing")) for name, r in WORKLOADS.items()]
    return messages(spark, folder).agg(F.array(*counts).alias("rows")).select(F.inline("rows"))


@query("""
select * from (values ('built', (select count(*) from documents where text is not null)), ('opened', (select count(*) from documents where text is not null)), ('another schema', 0), ('nothing readable', -1)) as t(step, messages)
""")
def index_open_or_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """An index that is built as it is opened, one that is there, a projection that can't be used, an archive of which nothing can be read."""
    docs = messages(spark, folder, all_cores=True)
    place, failed = scratch_folder(spark), docs.filter("body is null").count()
    steps = [("built", StoredIndex.open(spark, place, lambda: (docs.filter("body is not null"), failed)).messages.count()), ("opened", StoredIndex.open(spark, place, lambda: (docs.limit(0), 1)).messages.count())]
    odd = docs.withColumn("timestamp_ms", F.col("timestamp_ms").cast("string"))
    steps.append(("another schema", odd.count() if index.has_schema(odd) else 0))
    try:
        steps.append(("nothing readable", StoredIndex.open(spark, scratch_folder(spark), lambda: (docs.limit(0), docs.count())).n))
    except NothingIndexed:
        steps.append(("nothing readable", -1))
    return spark.createDataFrame(steps, "step string, messages long")


# schemas, callbacks, compression (INT-7, INT-8, UDX-3, AGG-5)


@query("select * from (values ('sound', ''), ('null', 'gmail_state: a required column is null'), ('repeated', 'gmail_state: [''source_account''] is not unique')) as t(name, fault)")
def schema_faults(spark: SparkSession, folder: str) -> DataFrame:
    sound = table(spark, folder, "customer").select(F.col("c_name").alias("source_account"), F.col("c_custkey").cast("string").alias("history_id"), F.lit(1).alias("complete")).dropDuplicates(["source_account"])
    cases = {"sound": sound, "null": sound.withColumn("history_id", F.lit(None).cast("string")), "repeated": sound.union(sound)}
    out = []
    for name, df in cases.items():
        try:
            validate("gmail_state", df)
            out.append((name, ""))
        except SchemaError as error:
            out.append((name, str(error)))
    return spark.createDataFrame(out, "name string, fault string")


@query("select doc_id, 'note ' || doc_id as subject, 4::bigint as parts from documents")
def message_callback(spark: SparkSession, folder: str) -> DataFrame:
    """A user's function over each parsed message."""
    count = lambda row, message: [(row["doc_id"], message["Subject"], len(list(mime.leaves(message))))]
    return mime.map_messages(multipart(spark, folder), count, "doc_id long, subject string, parts long")


@query("select (select count(*) from documents) as messages, true as smaller, true as same_bytes")
def compressed_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Compressed sizes of texts with themselves attached; sizes of compressors are beyond SQL, what they keep to is not."""
    raw = F.encode(F.concat(F.repeat("text", 20), F.lit("\r\n--attachment; filename=a\r\n"), F.repeat("text", 20)), "UTF-8")
    rows = table(spark, folder, "documents").select(raw.alias("raw"))
    sums = statistics.compression_stats(rows).crossJoin(rows.agg(F.count("*").alias("messages"), F.sum(F.octet_length("raw")).alias("bytes")))  # one row each
    whole = F.col("text_gzip") + F.col("attachment_gzip"), F.col("text_zstd") + F.col("attachment_zstd")
    return sums.select("messages", ((whole[0] < F.col("bytes")) & (whole[1] < F.col("bytes"))).alias("smaller"), ((F.col("text_gzip") > 0) & (F.col("attachment_zstd") > 0)).alias("same_bytes"))


# SQL over the same tables: windows and set operations (WIN-6, SET-6)


@query("""
select doc_id, source, n_chars, rank() over w as place, dense_rank() over w as dense, ntile(4) over w as quarter, lag(doc_id) over w as before, first_value(doc_id) over w as first, sum(n_chars) over (partition by source order by n_chars, doc_id rows between 2 preceding and current row)::bigint as last_three
from documents window w as (partition by source order by n_chars, doc_id)
""")
def sql_windows(spark: SparkSession, folder: str) -> DataFrame:
    spark.read.parquet(f"{folder}/documents.parquet").createOrReplaceTempView("lm_documents")
    return spark.sql("""
      select doc_id, source, n_chars, cast(rank() over w as long) as place, cast(dense_rank() over w as long) as dense, cast(ntile(4) over w as long) as quarter, lag(doc_id) over w as before, first_value(doc_id) over w as first,
        sum(n_chars) over (partition by source order by n_chars, doc_id rows between 2 preceding and current row) as last_three
      from lm_documents window w as (partition by source order by n_chars, doc_id)""")


@query("""
select 'both' as kind, k from (select o_custkey as k from orders intersect select c_custkey from customer) union all select 'without', k from (select c_custkey as k from customer except select o_custkey from orders)
union all select 'either', k from (select o_custkey as k from orders union select c_custkey from customer)
""")
def sql_set_operations(spark: SparkSession, folder: str) -> DataFrame:
    orders, customers = table(spark, folder, "orders").select(F.col("o_custkey").alias("k")), table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    named = lambda kind, df: df.select(F.lit(kind).alias("kind"), "k")
    return named("both", orders.intersect(customers)).unionByName(named("without", customers.exceptAll(orders.intersect(customers)))).unionByName(named("either", orders.union(customers).distinct()))
