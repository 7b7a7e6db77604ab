"""Fixed schemas of the stored tables and of the input files."""

from __future__ import annotations

from pyspark.sql import types as T

FACT_EVENTS = (
    "event_id string, corroboration_key string, device_id string, point_id decimal(20,0), "
    "event_type string, value string, value_cluster string, seq bigint, client_sequence bigint, "
    "modality string, thumbnail_url string, client_timestamp_ns bigint, received_at_ns bigint, "
    "device_trust_at_report double, resolver_id string"
)

FACTS = (
    "point_id decimal(20,0), device_id string, shard string, value string, corroboration_key string, "
    "zone string, entity string, status string, modality string, model string, model_version string, "
    "reporter_device_id string, client_timestamp_ns bigint, location struct<lat:double,lon:double>, "
    "thumbnail_url string, thumbnail_bytes bigint, tier string, vectors map<string,array<float>>, "
    "consensus_state string, confidence double, value_cluster string, tombstoned int, superseded int, "
    "redacted int, has_conflict int, conflict_with array<string>, "
    "sync_meta struct<synced:int,syncable:int,verdict:string,sync_priority:string,"
    "client_sequence:bigint,novelty:double,urgency:double>"
)

SPACE_STAMPS = "slot string, name string, modality string, dim int, probe array<double>, space_id string"
CONFLICT_FIXTURE = (
    "scenario_id string, shape string, corroboration_key string, correct_value string, decoy_value string"
)
RECALL_QUERIES = "query string, relevant_ids array<bigint>, shape string"
RECALL_CORPUS = "doc_id bigint, text string"
TEXT_SCENARIOS = (
    "scenario_id string, corroboration_key string, zone string, ground_truth string, "
    "reports array<struct<device_id:string,value:string,device_ts:string>>"
)
IMAGE_SCENARIOS = (
    "scenario_id string, corroboration_key string, zone string, ground_truth string, "
    "reports array<struct<device_id:string,image_id:string,label:string>>"
)
IMAGE_MANIFEST = (
    "image_id string, file string, label string, zone string, device_id string, "
    "corroboration_key string, caption string, client_timestamp_ns bigint"
)


def struct_type(ddl: str) -> T.StructType:
    """Parse one of the strings above."""
    return T.StructType.fromDDL(ddl)
