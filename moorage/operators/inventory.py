"""Discovered databases, monitored services, labels and addresses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .documents import compact_json_column
from .groups import GROUP_ROWS, first_by, lookup

# Names of the labels that tie a machine or service to its owner and role.
OWNER_LABEL = "resource_id"
ROLE_LABEL = "instance_type"

# Document schemas, service kinds in walking order, engines, constants.
DISCOVERY_SCHEMA = (
    "rds_instances array<struct<region:string,az:string,instance_id:string,"
    "node_model:string,address:string,port:bigint,engine:string,engine_version:string>>"
)
SERVICE_KINDS = ("mysql", "mongodb", "postgresql", "proxysql", "haproxy", "external")
_NAMED = "service_id:string,service_name:string,node_id:string"
_PLACED = "address:string,port:int,socket:string"
_GROUPED = (
    "environment:string,cluster:string,replication_set:string,custom_labels:map<string,string>"
)
_SERVICE_FIELDS = {
    "mysql": f"{_NAMED},{_PLACED},{_GROUPED}",
    "mongodb": f"{_NAMED},{_PLACED},{_GROUPED}",
    "postgresql": f"{_NAMED},database_name:string,{_PLACED},{_GROUPED}",
    "proxysql": f"{_NAMED},{_PLACED},{_GROUPED}",
    "haproxy": f"{_NAMED},{_GROUPED}",
    "external": f"{_NAMED},{_GROUPED},group:string",
}
SERVICES_SCHEMA = ", ".join(
    f"{kind} array<struct<{_SERVICE_FIELDS[kind]}>>" for kind in SERVICE_KINDS
)
_COMMON_FIELDS = f"{_NAMED},{_PLACED},database_name:string,group:string,{_GROUPED}"
_COMMON_SERVICES_SCHEMA = ", ".join(
    f"{kind} array<struct<{_COMMON_FIELDS}>>" for kind in SERVICE_KINDS
)
SUPPORTED_ENGINES = ("DISCOVER_RDS_MYSQL", "DISCOVER_RDS_POSTGRESQL")
MONITORING_USER = "pmm"
REQUEST_CONSTANTS: dict[str, object] = {
    "rds_exporter": True,
    "qan_mysql_perfschema": True,
    "skip_connection_check": False,
    "tls": False,
    "tls_skip_verify": False,
    "tablestats_group_table_limit": -1,
    "metrics_mode": 1,
    "qan_postgresql_pgstatements": True,
}
# Request fields in document order; the four secret ones are never columns.
REQUEST_FIELDS: tuple[tuple[str, str], ...] = (
    ("region", "string"),
    ("az", "string"),
    ("instance_id", "string"),
    ("node_model", "string"),
    ("address", "string"),
    ("port", "bigint"),
    ("engine", "string"),
    ("node_name", "string"),
    ("service_name", "string"),
    ("environment", "string"),
    ("cluster", "string"),
    ("replication_set", "string"),
    ("username", "string"),
    ("rds_exporter", "boolean"),
    ("qan_mysql_perfschema", "boolean"),
    ("custom_labels", "map<string,string>"),
    ("skip_connection_check", "boolean"),
    ("tls", "boolean"),
    ("tls_skip_verify", "boolean"),
    ("disable_query_examples", "boolean"),
    ("tablestats_group_table_limit", "int"),
    ("disable_basic_metrics", "boolean"),
    ("disable_enhanced_metrics", "boolean"),
    ("metrics_mode", "int"),
    ("qan_postgresql_pgstatements", "boolean"),
)

_CORRUPT = "_corrupt"


def _service_columns() -> dict[str, list[str]]:
    """Service field to the service kinds that have it."""
    fields = T.StructType.fromDDL(f"common struct<{_COMMON_FIELDS}>")["common"].dataType.names
    own = T.StructType.fromDDL(SERVICES_SCHEMA)
    return {
        name: [k for k in SERVICE_KINDS if name in own[k].dataType.elementType.names]
        for name in fields
    }


def _decoded(docs: DataFrame, json: str, ddl: str) -> DataFrame:
    schema = T.StructType.fromDDL(f"{ddl}, {_CORRUPT} string")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    return docs.withColumn("_doc", F.from_json(F.col(json), schema, options))


def malformed_documents(docs: DataFrame, ddl: str, *, json: str = "json") -> DataFrame:
    """The documents that are not JSON of the given schema, unchanged."""
    return (
        _decoded(docs, json, ddl)
        .where(F.col(f"_doc.{_CORRUPT}").isNotNull() | F.col("_doc").isNull())
        .drop("_doc")
    )


def discovered_instances(
    docs: DataFrame, *, json: str = "json", keep: Sequence[str] = ()
) -> DataFrame:
    """(keep..., the eight instance fields): one row per instance of a discovery response."""
    decoded = _decoded(docs, json, DISCOVERY_SCHEMA).where(F.col(f"_doc.{_CORRUPT}").isNull())
    return decoded.select(*keep, F.inline("_doc.rds_instances"))


def service_inventory(
    docs: DataFrame, *, json: str = "json", keep: Sequence[str] = ()
) -> DataFrame:
    """(keep..., service_type, service fields): six typed lists walked as one.

    All lists are decoded with the fields of any of them and become one array inside
    the row, so that the documents are scanned once. Fields a type does not have are
    NULL, also where a document gives them.
    """
    decoded = _decoded(docs, json, _COMMON_SERVICES_SCHEMA).where(
        F.col(f"_doc.{_CORRUPT}").isNull()
    )
    empty = F.array().cast(f"array<struct<{_COMMON_FIELDS}>>")

    def typed(kind: str) -> Column:
        services = F.coalesce(F.col(f"_doc.{kind}"), empty)
        return F.transform(
            services,
            lambda item: F.struct(F.lit(kind).alias("service_type"), item.alias("service")),
        )

    walked = decoded.select(*keep, F.inline(F.concat(*[typed(kind) for kind in SERVICE_KINDS])))
    columns = []
    for name, kinds in _service_columns().items():
        value = F.col(f"service.{name}")
        if len(kinds) < len(SERVICE_KINDS):
            value = F.when(F.col("service_type").isin(*kinds), value)
        columns.append(value.alias(name))
    return walked.select(*keep, "service_type", *columns)


def select_by_labels(
    df: DataFrame,
    selector: Mapping[str, str],
    *,
    labels: str = "labels",
    owner: str | None = None,
    owner_label: str = OWNER_LABEL,
) -> DataFrame:
    """Rows whose labels hold every pair of the selector; the owner pair overrides it."""
    wanted = dict(selector)
    if owner is not None:
        wanted[owner_label] = owner
    condition = F.lit(True)
    for key, value in wanted.items():
        condition = condition & (F.try_element_at(F.col(labels), F.lit(key)) == F.lit(value))
    return df.where(condition)


def labels_to_tags(df: DataFrame, *, labels: str = "labels") -> DataFrame:
    """Add ``tags``, the labels as an array of (key, value); NULL without labels."""
    entries = F.sort_array(F.map_entries(F.col(labels)))
    return df.withColumn("tags", F.when(F.size(entries) > 0, entries))


def project_addresses(df: DataFrame, *, interfaces: str = "network_interfaces") -> DataFrame:
    """Add (public_ip, private_ip) of the first interface; NULL where there is none."""
    first = F.get(F.col(interfaces), F.lit(0))
    return df.withColumns(
        {
            "public_ip": F.get(first["access_configs"], F.lit(0))["nat_ip"],
            "private_ip": first["network_ip"],
        }
    )


def registration_requests(
    instances: DataFrame,
    owner: str,
    *,
    owner_label: str = OWNER_LABEL,
    user: str = MONITORING_USER,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): requests for supported engines, the others with a ``reason``.

    Secrets are not part of the request rows.
    """
    engine = F.col("engine")
    supported = F.coalesce(engine.isin(*SUPPORTED_ENGINES), F.lit(False))
    values = {name: F.lit(value) for name, value in REQUEST_CONSTANTS.items()}
    values["service_name"] = F.col("instance_id")
    values["username"] = F.lit(user)
    values["custom_labels"] = F.create_map(F.lit(owner_label), F.lit(owner))
    copied = {"region", "az", "instance_id", "node_model", "address", "port", "engine"}
    columns = []
    for name, data_type in REQUEST_FIELDS:
        value = values.get(name, F.lit(None))
        if name in copied and name in instances.columns:
            value = F.col(name)
        columns.append(value.cast(data_type).alias(name))
    accepted = instances.where(supported).select(*keep, *columns)
    reason = F.concat(
        F.lit("engine "), F.coalesce(engine, F.lit("")), F.lit(" is not supported")
    )
    rejected = instances.where(~supported).withColumn("reason", reason)
    return accepted, rejected


def registration_json(accepted: DataFrame, *, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., json): the request documents, zero-valued fields left out."""
    names = [name for name, _ in REQUEST_FIELDS]
    return accepted.select(*keep, compact_json_column(accepted, names).alias("json"))


def lookup_instance(
    requests: DataFrame,
    instances: DataFrame,
    *,
    request_id: str = "request_id",
    wanted: str = "wanted_id",
    instance_id: str = "instance_id",
    order: str = "ord",
    columns: Sequence[str] = ("region", "address", "port", "engine"),
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Add the first listed instance of the wanted id and ``status`` found or not_found."""
    first = first_by(instances, [instance_id], order, order, *columns)
    right = first.select(
        F.col(instance_id).alias(wanted), F.col(order).alias("_found"), *columns
    )
    status = F.when(F.col("_found").isNotNull(), "found").otherwise("not_found")
    return (
        lookup(requests, right, [wanted], [request_id], limit)
        .withColumn("status", status)
        .drop("_found")
    )


def purge_by_owner(
    services: DataFrame,
    owners: DataFrame,
    *,
    service_id: str = "service_id",
    labels: str = "custom_labels",
    owner_label: str = OWNER_LABEL,
    owner: str = "owner",
    limit: int = GROUP_ROWS,
) -> DataFrame:
    """Add ``action``: remove where the owner label is one of ``owners``, else keep.

    Services without the label are always kept. Filter on ``action`` for either set.
    """
    gone = owners.select(F.col(owner).alias("_owner"), F.lit(True).alias("_gone")).where(
        F.col("_owner").isNotNull()
    )
    labelled = services.withColumn(
        "_owner", F.try_element_at(F.col(labels), F.lit(owner_label))
    )
    marked = lookup(labelled, gone.distinct(), ["_owner"], [service_id], limit)
    action = F.when(F.col("_gone"), "remove").otherwise("keep")
    return marked.withColumn("action", action).drop("_owner", "_gone")
