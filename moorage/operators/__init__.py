"""Plain DataFrame -> DataFrame operators."""

from .arrivals import assign_new_roles, high_marks
from .chain import reconcile_chain
from .config import (
    apply_defaults,
    cloud_defaults,
    declared_defaults,
    error_counts,
    validate_config,
)
from .documents import compact_json, ini_documents, ini_rows, overlay_config
from .endpoints import normalize_endpoints, redact_endpoints
from .fingerprints import fingerprint_rows
from .images import latest_image, latest_ready_image, undated_images
from .inventory import (
    discovered_instances,
    labels_to_tags,
    lookup_instance,
    malformed_documents,
    project_addresses,
    purge_by_owner,
    registration_json,
    registration_requests,
    select_by_labels,
    service_inventory,
)
from .paging import follow_pages, page_chains
from .readiness import ready_since
from .reconcile import (
    expected_resources,
    group_resource_ids,
    orphaned_resources,
    parse_resource_names,
    reconcile_resources,
)
from .selectors import match_selectors
from .telemetry import reportable, telemetry_documents, telemetry_metrics
from .topology import (
    assign_roles,
    cluster_readiness,
    config_status,
    instance_config,
    manager_config,
    peer_lists,
)
from .versions import package_index, resolve_versions, version_keys

__all__ = [
    "apply_defaults",
    "assign_new_roles",
    "assign_roles",
    "cloud_defaults",
    "cluster_readiness",
    "compact_json",
    "config_status",
    "declared_defaults",
    "discovered_instances",
    "error_counts",
    "expected_resources",
    "fingerprint_rows",
    "follow_pages",
    "group_resource_ids",
    "high_marks",
    "ini_documents",
    "ini_rows",
    "instance_config",
    "labels_to_tags",
    "latest_image",
    "latest_ready_image",
    "lookup_instance",
    "malformed_documents",
    "manager_config",
    "match_selectors",
    "normalize_endpoints",
    "orphaned_resources",
    "overlay_config",
    "package_index",
    "page_chains",
    "parse_resource_names",
    "peer_lists",
    "project_addresses",
    "purge_by_owner",
    "ready_since",
    "reconcile_chain",
    "reconcile_resources",
    "redact_endpoints",
    "registration_json",
    "registration_requests",
    "reportable",
    "resolve_versions",
    "select_by_labels",
    "service_inventory",
    "telemetry_documents",
    "telemetry_metrics",
    "undated_images",
    "validate_config",
    "version_keys",
]
