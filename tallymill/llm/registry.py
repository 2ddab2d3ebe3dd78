"""Queries of the training-data problems (3, 6, 7 and 8) and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymill.llm import leakage, packing, seen_before, sentences
from tallymill.sources.tables import table


def _history(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, "stored_events"), table(spark, sf_dir, "usage_events")]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose key was stored, delivered or requested before."""
    return seen_before.seen_before(table(spark, sf_dir, "ingest_requests"), _history(spark, sf_dir))


def p3_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the sets and their rate of wrong answers, in theory and audited."""
    return seen_before.error_rates(table(spark, sf_dir, "ingest_requests"), _history(spark, sf_dir))


def p3_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers, given batch by batch from a history that grows."""
    return seen_before.seen_in_batches(table(spark, sf_dir, "ingest_requests"), _history(spark, sf_dir))


def p3_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys asked for, keys never seen before, and keys that the sets have missed."""
    return seen_before.audit(table(spark, sf_dir, "ingest_requests"), _history(spark, sf_dir))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_targets"), spark.conf.get("spark.tallymill.tokenizer", packing.TOKENIZER))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in a container of every capacity."""
    return _packed(spark, sf_dir)


def p6_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.utilisation(_packed(spark, sf_dir))


def p6_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: documents placed, and what must not be."""
    return packing.violations(_packed(spark, sf_dir))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items that leak into them."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_longest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest verbatim run of each leak and where it stands."""
    return _leaks(spark, sf_dir)


def p7_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay when those with leaks are removed."""
    return leakage.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every message's own prose."""
    return sentences.split_sentences(table(spark, sf_dir, "documents"))


def p8_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points the documents themselves, the corpus and mere form have decided."""
    return sentences.decisions(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_in_batches, p3_audit, p3_error_rates, p6_containers, p6_utilisation, p6_violations, p7_found, p7_longest_matches, p7_clean_documents, p8_found, p8_decisions)}

_SEEN = """with r as (select request_id, tenant_id, idempotency_key, row_number() over (partition by tenant_id, idempotency_key order by request_id) as copy from ingest_requests where idempotency_key <> ''),
      e as (select tenant_id, idempotency_key from stored_events union select tenant_id, idempotency_key from usage_events),
      j as (select *, exists (select 1 from e where e.tenant_id is not distinct from r.tenant_id and e.idempotency_key = r.idempotency_key) as held from r)"""

ORACLE = {
    "p3_found": f"{_SEEN} select request_id from j where copy > 1 or held",
    "p3_in_batches": f"{_SEEN} select request_id from j where copy > 1 or held",
    "p3_audit": f"{_SEEN} select count(*) as probes, count(*) filter (not held) as absent, 0 as false_negatives from j where copy = 1",
    "p6_violations": "select target_id, capacity_tokens, n as documents, 0 as needless_splits, 0 as broken_texts, 0 as over_capacity from pack_targets, (select count(*) as n from documents)",
}
