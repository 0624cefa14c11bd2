"""Record layouts of the catalog: DDL strings for tables, and the value domains of their enumerations."""

from __future__ import annotations

#: Names of enumeration members and the integers that stand for them in storage.
FILE_KINDS = {"file": 0, "directory": 1, "symlink": 2, "special": 3, "other": 4}
AVAILABILITY = {"online": 0, "offline": 1, "unknown": 2}
VOLUME_STATES = {"online": 0, "offline": 1, "needs_reconciliation": 2}
MATCH_CLASSES = {"exact": 0, "prefix": 1, "token": 2, "substring": 3, "path": 4}
SCOPES = ("all", "files", "folders")
EVENTS = ("object_observed", "link_observed", "link_removed", "object_removed", "reconciliation_required")

#: Ids are 16 bytes; any type that orders and compares works in the operators.
VOLUMES = "volume_id string, display_name string, mount_points array<string>, filesystem string, removable boolean, local boolean, state string, reconciliation_reason string, generation bigint"
OBJECTS = "volume_id string, file_id string, kind string, size bigint, created_at_unix_ms bigint, modified_at_unix_ms bigint, hidden boolean, availability string, tombstoned boolean, observation_generation bigint"
LINKS = "file_link_id string, volume_id string, file_id string, parent_volume_id string, parent_file_id string, name string, traversal_boundary boolean, observation_generation bigint"
#: One wide row for each event; the columns that its kind doesn't use are null.
EVENT_ROWS = "sequence bigint, event string, volume_id string, file_id string, file_link_id string, parent_volume_id string, parent_file_id string, name string, traversal_boundary boolean, kind string, size bigint, created_at_unix_ms bigint, modified_at_unix_ms bigint, hidden boolean, availability string, reason string"
DOCUMENTS = "document_id string, volume_id string, file_id string, file_link_id string, document_version bigint, name string, resolved_path string, extension string, kind string, size bigint, created_at_unix_ms bigint, modified_at_unix_ms bigint, hidden boolean, availability string, fingerprint string"
OUTBOX = "sequence bigint, document_id string, document_version bigint, mutation string, payload string"
CONSUMERS = "consumer_id string, last_sequence bigint, index_generation bigint"
SESSIONS = "volume_id string, scan_generation bigint, phase int, final_provider_id string, final_format_version int, final_checkpoint binary"
