"""Types, constants and table schemas of the graph."""

from __future__ import annotations

# Node, edge and source types, traversal directions, curve and rule constants.
CI_TYPES = (
    "cloud_account", "region", "vpc", "subnet", "security_group", "ec2_instance", "elb", "dns_name", "rds", "eks_cluster", "iam_role",
    "iam_user", "s3_bucket", "internet", "k8s_cluster", "k8s_node", "k8s_namespace", "k8s_workload", "k8s_service", "k8s_pod", "azure_subscription",
    "azure_resource_group", "azure_vnet", "azure_subnet", "azure_nsg", "azure_vm", "gcp_project", "gcp_network", "gcp_subnetwork", "gcp_firewall",
    "gcp_instance", "db_instance", "db_database", "db_schema", "db_table", "saas_app", "saas_account", "saas_resource",
)
EDGE_TYPES = ("CONTAINS", "RUNS_ON", "CONNECTS_TO", "DEPENDS_ON", "ROUTES_TO", "HAS_ACCESS_TO", "OWNS", "EXPOSES", "MEMBER_OF", "RESOLVES_TO")
DECLARED, INFERRED = "declared", "inferred"

#: Edge types that each query walks along an edge, and against it.
WALKS = {
    "impact": (("CONTAINS",), ("DEPENDS_ON", "RUNS_ON", "ROUTES_TO", "EXPOSES")),
    "reach": ((), ("CONNECTS_TO", "ROUTES_TO", "HAS_ACCESS_TO", "EXPOSES")),
    "upstream": (("DEPENDS_ON", "RUNS_ON", "ROUTES_TO", "EXPOSES"), ("CONTAINS",)),
}
BASELINE_CONFIDENCE, CONFIDENCE_RATIO, CONFIDENCE_CEILING = 0.6, 0.5, 1 - 1e-15
CONFIDENCE_FLOOR, DECAY_PER_DAY, FRESH_DAYS, TTL_DAYS = 0.2, 0.05, 7, 30
CONFIDENCE_EPSILON = 1e-6
COUNT_MARKER, EVIDENCE_KEPT = "aws-flowlogs-count", 20
CANDIDATE_THRESHOLD, ALIAS_CAP, IP_SCORE = 0.5, 0.8, 0.9
KIND_WEIGHTS = {"removed": 3.0, "updated": 2.0, "created": 1.0}
ACCESS_BREADTH, DATABASE_TYPES, STALE_SECONDS, MONTHLY_QUOTA = 10, ("rds", "db_instance"), 86_400, 100_000

EVIDENCE = "array<struct<source:string,observed_at:timestamp,detail:string>>"
CI = "id string, tenant_id string, type string, external_id string, name string, attributes string, confidence double, first_seen timestamp, last_seen timestamp, valid_from timestamp, valid_to timestamp"
EDGE = f"id string, tenant_id string, type string, from_id string, to_id string, edge_key string, source string, confidence double, evidence {EVIDENCE}, valid_from timestamp, valid_to timestamp"
FINDING = "id string, tenant_id string, rule_id string, severity string, subject_ci_id string, title string, description string, evidence string, status string, detected_at timestamp, valid_from timestamp, valid_to timestamp"
DISCOVERED_CI = "type string, external_id string, name string, attributes string, confidence double, alias_keys array<string>"
DISCOVERED_EDGE = f"type string, from_type string, from_ext string, to_type string, to_ext string, source string, confidence double, evidence {EVIDENCE}, edge_key string"
SOURCE_KEYS = "tenant_id string, source string, native_id string, ci_id string, observed_at timestamp"
ALIAS_KEYS = "tenant_id string, alias_key string, ci_id string, ci_type string, source string, observed_at timestamp"
CANDIDATE = "candidate_id string, tenant_id string, ci_id_a string, ci_id_b string, type string, score double, evidence string, status string, resolved_merge_id string, generated_at timestamp, resolved_at timestamp"
MERGE = "merge_id string, tenant_id string, canonical_ci_id string, merged_ci_id string, merged_source string, merged_external_id string, matched_alias_key string, evidence string, merged_at timestamp"
UNMERGE = "unmerge_id string, tenant_id string, original_merge_id string, canonical_ci_id string, restored_ci_id string, restored_source string, restored_external_id string, evidence string, unmerged_at timestamp"
