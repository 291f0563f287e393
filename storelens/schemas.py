"""Record schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed vocabularies of the data model.
EVIDENCE_KINDS = ("observation", "system_record", "human_confirmation", "manager_decision")
EVENT_TYPES = (
    "receiving", "stock_movement", "damage", "expiry", "attendance",
    "sale", "purchase", "return", "stock_count",
)
TASK_STATUSES = ("open", "answered", "approved", "rejected", "closed")
AUTHORITY_LEVELS = (
    "observe", "local_work", "external_reversible", "system_change", "official_record", "prohibited",
)
# Roles whose answered tasks count as operational confirmations in proofs.
CONFIRMATION_ROLES = ("data_entry_operator", "deo", "godown_staff", "godown_incharge", "shelfer", "receiver")

ANSWER_FIELDS = ("confirmed", "verified", "matches_record", "received", "completed", "evidence_id", "actor", "other")
ANSWER = T.StructType([T.StructField(f, T.StringType()) for f in ANSWER_FIELDS])

FACT_TYPES = {
    "mapping_verified": T.BooleanType(),
    "product_id": T.StringType(),
    "cartons": T.DoubleType(),
    "pack_size": T.DoubleType(),
    "destination_id": T.StringType(),
    "destination_type": T.StringType(),
    "receiver_confirmed": T.BooleanType(),
    "from_location": T.StringType(),
    "to_location": T.StringType(),
    "sent_quantity": T.DoubleType(),
    "received_quantity": T.DoubleType(),
    "quantity": T.DoubleType(),
    "human_confirmed": T.BooleanType(),
    "staff_id": T.StringType(),
    "badge_id": T.StringType(),
    "source": T.StringType(),
    "stock_after": T.DoubleType(),
    "approved": T.BooleanType(),
    "expected_quantity": T.DoubleType(),
    "counted_quantity": T.DoubleType(),
    "source_record_hash": T.StringType(),
}
FACTS = T.StructType([T.StructField(k, v) for k, v in FACT_TYPES.items()])

EVIDENCE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("store_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("occurred_at", T.StringType()),
    T.StructField("payload", T.StringType()),
])

OP_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("store_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("occurred_at", T.StringType()),
    T.StructField("evidence_ids", T.ArrayType(T.StringType())),
    T.StructField("facts", FACTS),
])

POLL_ITEM = T.StructType([
    T.StructField("store_id", T.StringType()),
    T.StructField("connector", T.StringType()),
    T.StructField("external_id", T.StringType()),
    T.StructField("occurred_at", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("payload", T.StringType()),
])
