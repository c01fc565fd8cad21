"""Fixed vocabulary: tag keys, severity ladders and payload formats."""

from __future__ import annotations

from dataclasses import dataclass

JSON = "json"
PROTOBUF = "protobuf"

TRACES, METRICS, LOGS, ANALYTICS, ERRORS = "traces", "metrics", "logs", "analytics", "errors"

# Semantic-convention attribute keys.
SERVICE_NAME = "service.name"
SERVICE_VERSION = "service.version"
SERVICE_NAMESPACE = "service.namespace"
SERVICE_INSTANCE_ID = "service.instance.id"
DEPLOYMENT_ENVIRONMENT = "deployment.environment"
EXCEPTION_TYPE = "exception.type"
EXCEPTION_MESSAGE = "exception.message"
EXCEPTION_STACKTRACE = "exception.stacktrace"
EXCEPTION_KEYS = (EXCEPTION_TYPE, EXCEPTION_MESSAGE, EXCEPTION_STACKTRACE)
TENANT_ID = "tenant_id"

# The ordered five-level severity enum.
SEVERITY_NAMES = ("Debug", "Info", "Warning", "Error", "Fatal")
SEVERITY_DEBUG, SEVERITY_INFO, SEVERITY_WARNING, SEVERITY_ERROR, SEVERITY_FATAL = range(5)

# Log level name -> lowest OTLP severity number it admits.
LEVEL_MIN_SEVERITY = {
    "Trace": 1,
    "Debug": 5,
    "Information": 9,
    "Warning": 13,
    "Error": 17,
    "Critical": 21,
    "None": 2147483647,
}

ERROR_SEVERITY_NUMBER = 17
ERROR_SEVERITY_TEXTS = ("ERROR", "FATAL", "CRITICAL")

# Assumed bytes per item where a payload is not decoded.
BYTES_PER_ITEM = {TRACES: 300, METRICS: 100, LOGS: 150}

TAG_KEY_LENGTH = 32
INTERNAL_TENANT = "0" * 26
DEFAULT_SERVICE = "unknown-service"

# Ingestion status enum.
STATUS_SUCCESS, STATUS_PARTIAL, STATUS_FAILED, STATUS_SKIPPED = (
    "Success", "PartialSuccess", "Failed", "Skipped")
CONTRACT_VERSION = 1

# Processing error types; metric names below the collector's prefix.
PROCESSING_ERROR_TYPES = {
    TRACES: "trace_processing",
    METRICS: "metric_processing",
    LOGS: "log_processing",
    ANALYTICS: "analytics_processing",
    ERRORS: "sentry_routing",
}
TRANSPORT_PUBLISH = "transport_publish"
INGEST_METRICS = {
    TRACES: "traces.ingested",
    METRICS: "metrics.ingested",
    LOGS: "logs.ingested",
    ANALYTICS: "analytics_events.ingested",
}
ERRORS_METRIC = "errors"
FORWARDED_METRIC = "errors.forwarded"
DURATION_METRIC = "processing.duration"


@dataclass(frozen=True)
class TagKeys:
    """Context tag keys. Both prefixes are the deployment's own choice."""

    namespace: str = "telemetry"
    collector: str = "collector"

    def of(self, name: str) -> str:
        """``tenant_id`` is written bare; every other id carries the namespace."""
        return TENANT_ID if name == TENANT_ID else f"{self.namespace}.{name}"

    def metric(self, name: str) -> str:
        return f"{self.collector}.{name}"

    @property
    def ingested_at(self) -> str:
        return f"{self.collector}.ingested_at"

    @property
    def sink_failures(self) -> str:
        return f"{self.collector}.sink_failures"


KEYS = TagKeys()
