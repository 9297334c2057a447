"""Event registry and model settings.

A second event type is one more ``EventSpec`` entry; nothing else changes.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Field:
    """A typed field read out of the semi-structured payload."""

    name: str
    path: str
    type: str = "string"


@dataclass(frozen=True)
class EventSpec:
    name: str
    # Contract: keys that must be present, non-null and not "" (in this order).
    required: tuple[str, ...] = ("event_id", "account_id", "event_timestamp", "user_id")
    # Keys promoted to RAW columns (best effort, missing -> NULL).
    key_field: str = "event_id"
    account_field: str = "account_id"
    timestamp_field: str = "event_timestamp"
    # Typed staging projection (late typing of payload paths).
    staging_fields: tuple[Field, ...] = ()
    # Keys the registered payload contract knows about (drift report).
    contract_keys: tuple[str, ...] = ()
    # Landing location template; {env} is the lower-case environment.
    landing_template: str = "{root}/{env}/product_events/{name}"
    # Default lookback of the steady-state run.
    lookback_hours: int = 48

    def landing_root(self, root: str, env: str) -> str:
        return self.landing_template.format(root=root.rstrip("/"), env=env.lower(), name=self.name)


_PAGE_VIEW_FIELDS = (
    Field("event_id", "$.event_id"),
    Field("user_id", "$.user_id"),
    Field("account_id", "$.account_id"),
    Field("page_name", "$.page_name"),
    Field("session_id", "$.session_id"),
    Field("event_timestamp", "$.event_timestamp", "timestamp_ntz"),
    Field("browser", "$.properties.browser"),
    Field("module", "$.properties.module"),
    Field("duration_ms", "$.properties.duration_ms", "int"),
)

# The driver `events` table landed in the same contract shape; its open
# properties carry k (int) and value (double).
_PRODUCT_EVENT_FIELDS = (
    Field("event_id", "$.event_id"),
    Field("user_id", "$.user_id"),
    Field("account_id", "$.account_id"),
    Field("page_name", "$.page_name"),
    Field("session_id", "$.session_id"),
    Field("event_timestamp", "$.event_timestamp", "timestamp_ntz"),
    Field("prop_k", "$.properties.k", "int"),
    Field("prop_value", "$.properties.value", "double"),
)

EVENTS: dict[str, EventSpec] = {
    "page_views": EventSpec(
        name="page_views",
        staging_fields=_PAGE_VIEW_FIELDS,
        contract_keys=("event_id", "user_id", "account_id", "page_name",
                       "event_timestamp", "session_id", "properties"),
    ),
    "product_events": EventSpec(
        name="product_events",
        staging_fields=_PRODUCT_EVENT_FIELDS,
        contract_keys=("event_id", "user_id", "account_id", "page_name",
                       "event_timestamp", "session_id", "properties"),
    ),
}


@dataclass(frozen=True)
class Target:
    """Where models are written: real layer folders, or one sandbox folder
    with ``<layer>__<model>`` names (developer builds)."""

    root: str
    sandbox: str | None = None
    layers: dict = field(default_factory=lambda: {"staging": "staging", "marts": "marts_revops"})

    def path(self, layer: str, model: str) -> str:
        if self.sandbox:
            return f"{self.root}/{self.sandbox}/{self.layers.get(layer, layer)}__{model}"
        return f"{self.root}/{self.layers.get(layer, layer)}/{model}"
