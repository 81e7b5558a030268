"""Searches, pages and look-ups over stored tables that read what they need, held against SQL over the whole tables."""

from __future__ import annotations

import datetime
import hashlib

from pyspark.sql import functions as F

from ..operators.buckets import Buckets
from ..operators.grams import Grams
from ..operators.pages import Pages
from ..session import dealt
from ..sources.skipping import Skipping
from .slate import slate
from .slate_stored import _folder

TERMS = ("-77", "8812", "₹41", "chq-123", "7")


@slate("SELECT DISTINCT term, id FROM (SELECT id, cheque_identifier AS v FROM documents_ UNION ALL SELECT cheque_id, normalized_value FROM fields_) CROSS JOIN (VALUES "
    + ", ".join(f"('{t}')" for t in TERMS) + ") t(term) WHERE contains(lower(v), lower(term))")
def search_by_grams(documents_, fields_):
    """Documents by identifier or any field's value, in two batches of rows; the last term is too short for the postings."""
    spark = documents_.sparkSession
    stored = Buckets(spark, _folder(spark, "texts"), "kind string, row_id long, id long, value string", ["kind", "row_id"], 16)
    grams = Grams(spark, _folder(spark, "grams"), 16)
    identifiers = documents_.select(F.lit("document").alias("kind"), F.col("id").alias("row_id"), "id", F.col("cheque_identifier").alias("value"))
    values = fields_.select(F.lit("field").alias("kind"), F.col("id").alias("row_id"), F.col("cheque_id").alias("id"), F.col("normalized_value").alias("value"))
    for batch, rows in enumerate((identifiers, values), 1):
        stored.merge(rows, batch, order="id")
        grams.add(stored.stored().where(F.col("kind") == ("document" if batch == 1 else "field")), ["value"], batch)
    found = [grams.search(stored.stored(), ["value"], t).select(F.lit(t).alias("term"), "id") for t in TERMS]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return dealt(out, ["term", "id"], stored.rows().count()).distinct()


PLACE = datetime.datetime(1996, 6, 1)
NEWEST = "ORDER BY created_at DESC, id DESC"


@slate(f"""SELECT 'deep' AS page, id, status FROM (SELECT * FROM documents_ {NEWEST} LIMIT 50 OFFSET 1200)
    UNION ALL SELECT 'filtered', id, status FROM (SELECT * FROM documents_ WHERE status = 'VERIFIED' AND review_required {NEWEST} LIMIT 40 OFFSET 130)
    UNION ALL SELECT 'end', id, status FROM (SELECT * FROM documents_ {NEWEST} LIMIT 60 OFFSET (SELECT count(*) - 20 FROM documents_))
    UNION ALL SELECT 'seek', id, status FROM (SELECT * FROM documents_ WHERE status = 'PROCESSED' AND (created_at < TIMESTAMP '{PLACE}' OR created_at = TIMESTAMP '{PLACE}' AND id < 5000) {NEWEST} LIMIT 70)""")
def deep_pages(documents_):
    """Pages by offset, with and without filters, one that the end cuts short, and one behind a place."""
    spark = documents_.sparkSession
    pages = Pages(spark, _folder(spark, "pages"))
    pages.store(documents_.select("id", F.col("created_at").cast("timestamp").alias("created_at"), "status", "review_required"), 1000)
    told = {
        "deep": pages.page(1200, 50), "filtered": pages.page(130, 40, status="VERIFIED", review_required=True),
        "end": pages.page(pages.total() - 20, 60), "seek": pages.after(PLACE, 5000, 70, status="PROCESSED"),
    }
    parts = [rows.select(F.lit(name).alias("page"), "id", "status") for name, rows in told.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


HASHED = "sha256('CHQ-' || CAST({} AS VARCHAR))"


@slate(f"""WITH h AS (SELECT id, sha256(cheque_identifier) AS image_hash FROM documents_), b AS (SELECT event_id, {HASHED.format('event_id * 3')} AS image_hash FROM events)
    SELECT CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.image_hash = b.image_hash) THEN 'known' ELSE 'new' END AS what, event_id AS id FROM b
    UNION ALL SELECT 'looked up', id FROM h WHERE image_hash = {HASHED.format(7)}
    UNION ALL SELECT 'absent', id FROM h WHERE image_hash = sha256('none')""")
def lookups_by_files(documents_, events):
    """A batch of uploads held against all documents' hashes, a look-up of a hash that is there and one of a hash that is not."""
    spark = documents_.sparkSession
    kept = Skipping(spark, _folder(spark, "hashes"), "image_hash")
    kept.store(documents_.select("id", F.sha2("cheque_identifier", 256).alias("image_hash")), 5000)
    batch = events.select("event_id", F.sha2(F.concat(F.lit("CHQ-"), (F.col("event_id") * 3).cast("string")), 256).alias("image_hash"))
    one = lambda text: kept.lookup(hashlib.sha256(text.encode()).hexdigest())
    told = kept.told(batch).select(F.when(F.col("known"), "known").otherwise("new").alias("what"), F.col("event_id").alias("id"))
    looked_up = {"looked up": one("CHQ-7"), "absent": one("none")}
    parts = [rows.select(F.lit(name).alias("what"), "id") for name, rows in looked_up.items()]
    return told.union(parts[0]).union(parts[1])
