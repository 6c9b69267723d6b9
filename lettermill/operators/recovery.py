"""Evidence-based recovery: a read-only plan, and exact repair of missing records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept
from .integrity import overlapping

# The dispositions' stable labels.
NO_ACTION, REFETCH, CHOICE, SALVAGE = "no-action", "source", "user-choice", "salvage"
LOST, UNSAFE, CLEANUP = "unrecoverable-locally", "unsafe-automatic-repair", "cleanup-candidate"
DISPOSITIONS = (NO_ACTION, REFETCH, CHOICE, SALVAGE, LOST, UNSAFE, CLEANUP)
# The proposed actions.
RESOLVE = "resolve source identity before any re-fetch"
FETCH = "RefetchGmailMessage or RefetchImapMessage (explicit future action)"
CONFIRM = "confirm whether an explicit source recovery is still desired"
PRESERVE = "preserve the missing claim and report it"
CONTRADICTION = "diagnose the physical/catalogue contradiction; do not re-link"
CANDIDATE = "diagnose and present a candidate only; do not re-link"
DIAGNOSE = "diagnose without re-linking"
RETAIN = "retain in place and optionally export byte-exactly/manifest it"
VERIFIED = "preserve evidence; recover only from a verified source or backup"
TAIL = "consider future terminal-tail cleanup only after explicit safety proof"
NO_CATALOGUE = "inspect any validated RAW frames; do not recreate provenance"
BAD_CATALOGUE = "preserve the database and obtain a verified backup/schema decision"
NO_ARCHIVE = "restore the original archive from a verified copy"


def source_evidence(gmail: DataFrame, imap: DataFrame) -> DataFrame:
    """``doc_id, refetchable, deleted, invalid, identities``: what both sources know of each record."""
    first = gmail.select(
        "doc_id", F.lit("gmail").alias("kind"), "source_account", F.col("gmail_message_id").alias("identity"), "source_state",
        (F.col("source_account").startswith("gmail:") & (F.col("gmail_message_id") != "")).alias("valid"),
    )
    account = F.col("source_account").rlike(r"^imap:[^@\s]+@[^:\s]+:[1-9]\d{0,4}$")
    second = imap.select(
        "doc_id", F.lit("imap").alias("kind"), "source_account", F.concat_ws(":", "mailbox", "uid_validity", "uid").alias("identity"), "source_state",
        (account & (F.col("mailbox") != "") & (F.col("uid_validity") > 0) & (F.col("uid") > 0)).alias("valid"),
    )
    rows = first.union(second)
    present, deleted = F.col("source_state") == "present", F.col("source_state") == "deleted"
    return rows.groupBy("doc_id").agg(
        F.count_if(F.col("valid") & present).alias("refetchable"),
        F.count_if(F.col("valid") & deleted).alias("deleted"),
        F.count_if(~F.col("valid") | ~(present | deleted)).alias("invalid"),
        F.array_sort(F.collect_list(F.struct("kind", "source_account", "identity", "source_state", "valid"))).alias("identities"),
    )


def missing_disposition() -> Column:
    """For a missing record with evidence columns: how it can be recovered."""
    many, gone = F.col("refetchable") > 1, F.col("deleted") > 0
    unsafe = (F.col("invalid") > 0) | many | (gone & (F.col("refetchable") > 0))
    return F.when(unsafe, UNSAFE).when(F.col("refetchable") == 1, REFETCH).when(gone, CHOICE).otherwise(LOST)


def _missing_action() -> Column:
    disposition = missing_disposition()
    return F.when(disposition == UNSAFE, RESOLVE).when(disposition == REFETCH, FETCH).when(disposition == CHOICE, CONFIRM).otherwise(PRESERVE)


def _items(rows: DataFrame, subject: Column, cases: list[tuple[Column, str, Column | str, Column | str, Column]]) -> DataFrame:
    """An item for each row: the first case that holds gives status, disposition, action and facts."""
    item, text = F.lit(None), lambda x: F.lit(x) if isinstance(x, str) else x
    for holds, status, disposition, action, facts in reversed(cases):
        made = F.struct(F.lit(status).alias("status"), text(disposition).alias("disposition"), text(action).alias("action"), facts.alias("facts"))
        item = F.when(holds, made).otherwise(item)
    found = rows.select(subject.alias("subject"), item.alias("i")).filter("i is not null")
    return found.select("subject", "i.status", "i.disposition", F.lit(False).alias("automatic"), F.col("i.action").alias("proposed_action"), "i.facts")


def plan(records: DataFrame, messages: DataFrame, classified: DataFrame, evidence: DataFrame, archive: bool = True) -> DataFrame:
    """``plan_items`` by subject and status."""
    return plan_items(records, messages, classified, evidence, archive).orderBy("subject", "status")


def plan_items(records: DataFrame, messages: DataFrame, classified: DataFrame, evidence: DataFrame, archive: bool = True) -> DataFrame:
    """``subject, status, disposition, automatic, proposed_action, facts``, in no order; what is sound has no item.

    ``records`` as from ``record_inventory``, with ``segment`` and ``archive_offset`` or to be joined with ``messages`` for
    them; ``classified`` as from ``classify_frames``. Without an ``archive``, only records have items. Nothing is ever
    automatic. Coordinates of any size and sign are compared without overflow.
    """
    bad = records.filter("status <> 'available'")
    if "segment" not in records.columns:
        bad = bad.join(messages.select("doc_id", "segment", "archive_offset"), "doc_id")
    contradicting = classified.filter("state = 'inconsistent'").select("segment", F.col("offset").alias("archive_offset")).distinct().withColumn("contradicted", F.lit(True))
    rows = bad.join(contradicting, ["segment", "archive_offset"], "left").join(evidence.drop("identities"), "doc_id", "left").fillna(0, ["refetchable", "deleted", "invalid"])
    counts = F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("refetchable", "deleted", "invalid")])
    why = F.array(F.coalesce("reason", F.lit("")))
    missing = F.col("status") == "missing"
    of_records = _items(rows, F.concat(F.lit("doc "), F.col("doc_id").cast("string")), [
        (missing & F.col("contradicted"), "CataloguedInconsistent", UNSAFE, CONTRADICTION, F.array(F.lit("another frame is at the claimed coordinate"))),
        (missing, "PhysicallyMissing", missing_disposition(), _missing_action(), counts),
        (F.lit(True), "CataloguedInconsistent", UNSAFE, CANDIDATE if archive else DIAGNOSE, why),
    ])
    if not archive:
        return of_records
    frame = F.concat(F.col("segment"), F.lit(" @ "), F.col("offset").cast("string"))
    state = F.col("state")
    of_frames = _items(classified.filter(state.isin("orphan", "corrupt")), frame, [
        (state == "orphan", "OrphanValidated", SALVAGE, RETAIN, F.array(F.concat(F.lit("doc_id="), F.col("doc_id").cast("string")))),
        (F.col("claimed"), "PhysicalCorruption", UNSAFE, VERIFIED, why),
        (F.lit(True), "PhysicalCorruption", LOST, VERIFIED, why),
    ])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    ranges = messages.filter("archive_offset >= 0 and frame_bytes >= 0").select("segment", wide("archive_offset").alias("start"), (wide("archive_offset") + wide("frame_bytes")).alias("end"))
    tails = classified.filter("state = 'tail'").select("segment", "offset", "reason", wide("offset").alias("start"), (wide("offset") + wide("frame_bytes")).alias("end"))
    in_play = ranges.join(tails.select("segment").distinct(), "segment", "left_semi")
    met = overlapping(tails, in_play, "segment", ("start", "end"), ("start", "end")).select("segment", "offset").distinct().withColumn("met", F.lit(True))
    of_tails = _items(tails.join(met, ["segment", "offset"], "left"), frame, [
        (F.col("met"), "IncompleteTail", UNSAFE, TAIL, why),
        (F.lit(True), "IncompleteTail", CLEANUP, TAIL, why),
    ])
    return of_records.unionByName(of_frames).unionByName(of_tails)


def archive_plan(spark: SparkSession, catalogue: str, archive: bool) -> DataFrame:
    """Items for a catalogue that is ``absent`` or ``invalid``, as far as the archive exists; no rows for ``valid``."""
    rows = {
        "absent": [("catalogue", "CatalogueLost", CHOICE, NO_CATALOGUE)],
        "invalid": [("catalogue", "CatalogueInvalidOrUnreadable", UNSAFE, BAD_CATALOGUE)] + ([] if archive else [("archive", "ArchiveRawAbsent", LOST, NO_ARCHIVE)]),
    }.get(catalogue, [])
    return spark.createDataFrame(rows, "subject string, status string, disposition string, proposed_action string")


def repair(missing: DataFrame, evidence: DataFrame, messages: DataFrame, fetched: DataFrame) -> DataFrame:
    """``doc_id, raw, outcome``: missing records against what their one source returned.

    ``fetched(doc_id, source_account, identity, raw)``. Only a single present identity of a record without other
    identities is repaired, and only if its account, identity and the digest of its bytes are the catalogue's.
    """
    one = evidence.filter("refetchable = 1 and deleted = 0 and invalid = 0 and size(identities) = 1").select("doc_id", F.col("identities")[0].alias("known"))
    rows = missing.select("doc_id").join(one, "doc_id", "left").join(messages.select("doc_id", "raw_digest"), "doc_id").join(fetched, "doc_id", "left")
    same = (F.col("source_account") == F.col("known.source_account")) & (F.col("identity") == F.col("known.identity"))
    digest = F.unhex(F.sha2("raw", 256)) == F.col("raw_digest")
    outcome = F.when(F.col("known").isNull(), "refused: not one present identity").when(F.col("raw").isNull(), "unavailable").when(~F.coalesce(same, F.lit(False)), "refused: another identity").when(~digest, "refused: digest differs").otherwise("repaired")
    return rows.select("doc_id", F.when(outcome == "repaired", F.col("raw")).alias("raw"), outcome.alias("outcome"))


PUBLISHED, CONFLICT = "published", "conflict"


def expected_rows(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, expected``: the catalogue rows of ``wanted(doc_id)`` as they are when a recovery begins."""
    return messages.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.struct(*[F.col(c) for c in messages.columns]).alias("expected"))


def publish(messages: DataFrame, expected: DataFrame, evidence: DataFrame, chosen: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalogue after exact repairs, and ``doc_id, outcome, reason, segment, offset`` of each.

    ``expected`` as from ``expected_rows`` before the bytes were fetched; ``evidence`` as from ``source_evidence`` now;
    ``chosen(doc_id, kind, source_account, identity)`` the identity that was fetched; ``placed(doc_id, segment, offset,
    frame_bytes)`` the new frame, which is durable. A record's coordinate is replaced only if exactly one row of the catalogue
    has its id, that row equals the expected one in every column, and the source's identity is still there and the only one.
    Otherwise nothing of the catalogue changes, and the frame stays where it is as an orphan.
    """
    old = placed.select("doc_id", "segment", "offset", "frame_bytes").join(expected, "doc_id", "left")
    now = messages.join(placed.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("rows"), F.first(F.struct(*[F.col(c) for c in messages.columns])).alias("now"))
    sole = evidence.filter("refetchable = 1 and deleted = 0 and invalid = 0 and size(identities) = 1").select("doc_id", F.col("identities")[0].alias("held"))
    rows = old.join(now, "doc_id", "left").join(sole, "doc_id", "left").join(chosen.select("doc_id", "kind", "source_account", "identity"), "doc_id", "left")
    same = reduce(lambda a, b: a & b, [F.col(f"held.{c}").eqNullSafe(F.col(c)) for c in ("kind", "source_account", "identity")], F.lit(True))
    changed = ~reduce(lambda a, b: a & b, [F.col(f"now.{c}").eqNullSafe(F.col(f"expected.{c}")) for c in messages.columns], F.lit(True))
    reason = (
        F.when(F.coalesce("rows", F.lit(0)) != 1, F.concat(F.coalesce("rows", F.lit(0)).cast("string"), F.lit(" catalogue rows")))
        .when(F.col("expected").isNull() | changed, "the catalogue row changed").when(F.col("held").isNull(), "not one present identity").when(~same, "another identity")
    )
    outcome = F.when(reason.isNull(), PUBLISHED).otherwise(CONFLICT)
    judged = kept(rows.select("doc_id", outcome.alias("outcome"), reason.alias("reason"), "segment", "offset", "frame_bytes"), "judged")
    new = judged.filter(F.col("outcome") == PUBLISHED).select("doc_id", F.struct("segment", "offset", "frame_bytes").alias("_new"))
    to = {"segment": "segment", "archive_offset": "offset", "frame_bytes": "frame_bytes"}
    values = [F.coalesce(F.col(f"_new.{to[c]}"), F.col(c)).alias(c) if c in to else F.col(c) for c in messages.columns]
    return messages.join(new, "doc_id", "left").select(*values), judged.drop("frame_bytes")
