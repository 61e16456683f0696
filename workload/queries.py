"""Every operator as a registered query: (spark, folder) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import moorage as m
from moorage.operators.versions import CLUSTER_PREFIX, SERVER_PREFIX
from moorage.plans import (
    cluster_files,
    read_document_store,
    register_databases,
    report_telemetry,
    upsert_documents,
    write_document_store,
)
from moorage.sources import shared_folder
from moorage.streaming import Delivery, config_stream, files_receiver, run_to_files, telemetry_stream

from .derived import DERIVED, derived, query, table

Query = Callable[[SparkSession, str], DataFrame]

# A group above this many rows takes the heavy-group route in these queries.
SMALL_LIMIT = 7

_QUERIES: dict[str, Query] = {}


def registered(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _joined(array: str, separator: str = ",") -> Column:
    return F.array_join(array, separator)


# Telemetry and configuration.


@registered
def telemetry_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return m.telemetry_metrics(derived(spark, folder, "cfg"))


def _sent_configs(spark: SparkSession, folder: str) -> DataFrame:
    sent = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("config_id") * 1_234_560)
    return derived(spark, folder, "configs").withColumn("sent_at", sent)


@registered
def telemetry_documents(spark: SparkSession, folder: str) -> DataFrame:
    return m.telemetry_documents(_sent_configs(spark, folder), version="1.0")


@registered
def report_telemetry_documents(spark: SparkSession, folder: str) -> DataFrame:
    return report_telemetry(_sent_configs(spark, folder), version="1.0")


@registered
def telemetry_of_events(spark: SparkSession, folder: str) -> DataFrame:
    """One telemetry document per event row, with the event's own time."""
    events = query(
        spark,
        folder,
        "select event_id as config_id, 'pmm' as resource, event_type as instance_type, "
        "user_id as volume_size, ts as sent_at from events",
    )
    return m.telemetry_documents(events, version="1.0")


@registered
def telemetry_stream_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The stream over the customer files, run to the end and read back."""
    customers = config_stream(
        spark,
        folder,
        schema=table(spark, folder, "customer").schema,
        file_format="parquet",
        files="customer.parquet",
    )
    text = DERIVED["configs"].replace("from customer", "from {customer}")
    metrics = telemetry_stream(spark.sql(text, customer=customers))
    path = shared_folder(spark, "telemetry")
    run_to_files(metrics, path, shared_folder(spark, "telemetry-checkpoint")).awaitTermination()
    return spark.read.schema(metrics.schema).parquet(path)


@registered
def telemetry_delivery(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of documents with dead letters, delivered twice from two checkpoints.

    The second run repeats every batch of the first, and the result has each record once.
    """
    path = shared_folder(spark, "delivery")
    for _ in range(2):
        customers = config_stream(
            spark, folder, schema=table(spark, folder, "customer").schema, file_format="parquet", files="customer.parquet"
        )
        configs = spark.sql(DERIVED["configs"].replace("from customer", "from {customer}"), customer=customers)
        sent = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("config_id") * 1_234_560)
        configs = configs.withColumns(
            {
                "sent_at": F.when(F.col("config_id") % 13 != 0, sent),
                "resource": F.when(F.col("config_id") % 17 == 0, "vm").otherwise(F.col("resource")),
            }
        )
        delivery = Delivery(path, configs.schema["config_id"], receiver=files_receiver(f"{path}/received"), version="1.0")
        delivery.start(configs, shared_folder(spark, "delivery-checkpoint")).awaitTermination()
    return delivery.outcomes(spark).drop("batch_id")


@registered
def validate_config(spark: SparkSession, folder: str) -> DataFrame:
    checked = m.validate_config(derived(spark, folder, "configs"), strict=True)
    errors = _joined("errors").alias("errors")
    return checked.select("config_id", F.size("errors").alias("n"), errors)


@registered
def error_counts(spark: SparkSession, folder: str) -> DataFrame:
    return m.error_counts(m.validate_config(derived(spark, folder, "configs")))


@registered
def apply_defaults(spark: SparkSession, folder: str) -> DataFrame:
    return m.apply_defaults(derived(spark, folder, "cfg")).drop("password")


@registered
def compact_json(spark: SparkSession, folder: str) -> DataFrame:
    tags = F.create_map(F.lit("net"), F.col("vpc_name"))
    cfg = derived(spark, folder, "configs").withColumns(
        {
            "disk": F.struct("volume_type", "volume_iops"),
            "tags": F.map_filter(tags, lambda _, value: F.col("cloud") == "aws"),
            "sizes": F.filter(F.array("volume_size"), lambda v: v > 9),
        }
    )
    columns = ["version", "volume_size", "disable_telemetry", "disk", "tags", "sizes"]
    return m.compact_json(cfg, columns, keep=["config_id"])


# Versions.


def _listings(spark: SparkSession, folder: str) -> DataFrame:
    """A listing text per part: a header, the part's line, a note, a trailing newline."""
    lines = derived(spark, folder, "pkg_text")
    text = F.concat(
        F.lit("Package: "), F.col("package"), F.lit("\n"), F.col("line"),
        F.lit("\nX-Version-Note: "), F.col("ord").cast("string"), F.lit("\n"),
    )
    name = F.concat_ws("/", "package", F.col("ord").cast("string"))
    return lines.select(name.alias("package"), text.alias("text"))


@registered
def package_index(spark: SparkSession, folder: str) -> DataFrame:
    return m.package_index(_listings(spark, folder), prefix=SERVER_PREFIX)


@registered
def package_index_epoch(spark: SparkSession, folder: str) -> DataFrame:
    return m.package_index(_listings(spark, folder), prefix=CLUSTER_PREFIX)


def _long_listings(spark: SparkSession, folder: str) -> DataFrame:
    """About twenty lines to a listing, in order."""
    lines = derived(spark, folder, "pkg_text").withColumn("part", F.expr("ord div 20"))
    text = F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    return lines.groupBy("package", "part").agg(F.array_join(text, "\n").alias("text")).select(
        F.concat_ws("/", "package", F.col("part").cast("string")).alias("package"), "text"
    )


@registered
def package_index_of_listings(spark: SparkSession, folder: str) -> DataFrame:
    return m.package_index(_long_listings(spark, folder), prefix=SERVER_PREFIX)


@registered
def versions_of_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Listing texts to the version chosen where none is asked for, listing by listing."""
    listings = _long_listings(spark, folder)
    requests = listings.select("package", F.col("package").alias("request_id"), F.lit("").alias("wanted"))
    return m.resolve_versions(requests, m.package_index(listings), by=["package"])


@registered
def version_keys(spark: SparkSession, folder: str) -> DataFrame:
    return m.version_keys(derived(spark, folder, "pkg_index"))


@registered
def resolve_versions(spark: SparkSession, folder: str) -> DataFrame:
    return m.resolve_versions(
        derived(spark, folder, "ver_requests"), derived(spark, folder, "pkg_index")
    )


# Documents.


@registered
def ini_rows(spark: SparkSession, folder: str) -> DataFrame:
    return m.ini_rows(derived(spark, folder, "ini_docs"))


@registered
def ini_documents(spark: SparkSession, folder: str) -> DataFrame:
    return m.ini_documents(m.ini_rows(derived(spark, folder, "ini_docs")))


def _layers(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame]]:
    return [
        ("base", m.ini_rows(derived(spark, folder, "ini_docs"))),
        ("layer", derived(spark, folder, "ini_layer")),
    ]


@registered
def overlay_config(spark: SparkSession, folder: str) -> DataFrame:
    rows = m.overlay_config(_layers(spark, folder))
    return rows.select("doc_id", "section", "key", "value", "source")


@registered
def overlaid_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Edited documents, with the comments they had."""
    return m.ini_documents(m.overlay_config(_layers(spark, folder)))


@registered
def upserted_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A stored table of documents after some were edited and some came in new."""
    path = shared_folder(spark, "documents")
    docs = derived(spark, folder, "ini_docs")
    write_document_store(docs, path, text="doc", buckets=16)
    upsert_documents(spark, path, derived(spark, folder, "ini_edits"), buckets=16)
    return read_document_store(spark, path).select("doc_id", "text")


# Inventory.


def _discovery(spark: SparkSession, folder: str) -> DataFrame:
    """A discovery response per row: some empty, some malformed, the rest of two instances."""
    found = F.struct("region", "instance_id", "address", "port", "engine")
    bare = F.struct(F.concat(F.lit("bare-"), F.col("ord").cast("string")).alias("instance_id"))
    pair = F.concat(
        F.lit('{"rds_instances":['), F.to_json(found), F.lit(","), F.to_json(bare), F.lit("]}")
    )
    json = (
        F.when(F.col("ord") % 7 == 0, "{}")
        .when(F.col("ord") % 7 == 1, "{bad")
        .when(F.col("ord") % 7 == 2, '{"rds_instances":[]}')
        .otherwise(pair)
    )
    return derived(spark, folder, "discovered").select("ord", json.alias("json"))


@registered
def discovered_instances(spark: SparkSession, folder: str) -> DataFrame:
    return m.discovered_instances(_discovery(spark, folder), keep=["ord"])


def _listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Response pages of none, one or two instances each, behind continuation tokens."""
    each = F.slice(F.array(F.lit(0), F.lit(1)), F.lit(1), (F.col("ord") % 3).cast("int"))

    def instance(at: Column) -> Column:
        return F.struct(
            F.concat(F.lit("db-"), "ord", F.lit("-"), at).alias("instance_id"), (at + 3306).alias("port")
        )

    body = F.to_json(F.struct(F.transform(each, instance).alias("rds_instances")))
    return derived(spark, folder, "listing_pages").withColumn("json", body)


@registered
def paged_instances(spark: SparkSession, folder: str) -> DataFrame:
    """The instances of whole listings, page after page."""
    pages = m.follow_pages(_listing_pages(spark, folder), keep=["json"])
    found = m.discovered_instances(pages, keep=["listing", "page_no"])
    return found.select("listing", "page_no", "instance_id", "port")


@registered
def page_chains(spark: SparkSession, folder: str) -> DataFrame:
    return m.page_chains(_listing_pages(spark, folder))


@registered
def malformed_documents(spark: SparkSession, folder: str) -> DataFrame:
    from moorage.operators.inventory import DISCOVERY_SCHEMA

    return m.malformed_documents(_discovery(spark, folder), DISCOVERY_SCHEMA)


def _labels() -> Column:
    both = F.create_map(
        F.lit("resource_id"), F.col("owner"), F.lit("instance_type"), F.col("role")
    )
    return F.map_filter(both, lambda _, value: value.isNotNull())


def _service_documents(
    spark: SparkSession, folder: str, further: Sequence[str] = ()
) -> DataFrame:
    number = F.regexp_extract("service_id", "([0-9]+)$", 1).cast("bigint")
    services = derived(spark, folder, "services").withColumn("doc", F.floor(number / 12))
    service = F.struct(
        "service_id",
        F.concat(F.lit("name-"), F.col("service_id")).alias("service_name"),
        F.when(F.col("service_type") == "postgresql", F.lit("db")).alias("database_name"),
        F.when(~F.col("service_type").isin("haproxy", "external"), F.lit(3306)).alias("port"),
        F.when(F.col("service_type") == "external", F.lit("grp")).alias("group"),
        _labels().alias("custom_labels"),
    )
    lists = [
        F.when(F.col("service_type") == kind, F.array(service)).alias(kind)
        for kind in ("mysql", "mongodb", "postgresql", "proxysql", "haproxy", "external")
    ]
    return services.select(*further, F.to_json(F.struct(*lists)).alias("json"))


@registered
def service_inventory(spark: SparkSession, folder: str) -> DataFrame:
    rows = m.service_inventory(_service_documents(spark, folder))
    label = F.col("custom_labels")
    return rows.select(
        "service_type",
        "service_id",
        "service_name",
        "address",
        "port",
        "database_name",
        "group",
        F.try_element_at(label, F.lit("resource_id")).alias("owner"),
        F.try_element_at(label, F.lit("instance_type")).alias("role"),
    )


@registered
def service_inventory_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of about twelve services in all six lists."""
    one = _service_documents(spark, folder, further=["doc"])
    kinds = ("mysql", "mongodb", "postgresql", "proxysql", "haproxy", "external")
    every = F.from_json(
        "json",
        "struct<" + ", ".join(
            f"{kind}: array<struct<service_id: string, service_name: string, database_name: string, "
            "port: int, group: string, custom_labels: map<string, string>>>" for kind in kinds
        ) + ">",
    )
    lists = [F.flatten(F.collect_list(f"every.{kind}")).alias(kind) for kind in kinds]
    documents = one.withColumn("every", every).groupBy("doc").agg(*lists)
    rows = m.service_inventory(
        documents.select("doc", F.to_json(F.struct(*kinds)).alias("json")), keep=["doc"]
    )
    owner = F.try_element_at("custom_labels", F.lit("resource_id"))
    return rows.select(
        "doc", "service_type", "service_id", "service_name", "port", "database_name", "group",
        owner.alias("owner"),
    )


@registered
def select_by_labels(spark: SparkSession, folder: str) -> DataFrame:
    services = derived(spark, folder, "services").withColumn("labels", _labels())
    chosen = m.select_by_labels(services, {"instance_type": "machinery"}, owner="own3")
    return chosen.drop("labels")


def _map_of(columns: Sequence[str]) -> Column:
    entries = [part for c in columns for part in (F.lit(c), F.col(c))]
    return F.map_filter(F.create_map(*entries), lambda _, value: value.isNotNull())


@registered
def match_selectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every selector against every machine: by role, tier and zone, and by owner if it has one."""
    machines = derived(spark, folder, "machines").withColumnRenamed("owner", "resource_id")
    labelled = machines.select("machine_id", _map_of(["resource_id", "role", "tier", "zone"]).alias("labels"))
    selectors = derived(spark, folder, "selectors")
    wanted = selectors.select("selector_id", "owner", _map_of(["role", "tier", "zone"]).alias("wanted"))
    return m.match_selectors(labelled, wanted, owner="owner")


@registered
def labels_to_tags(spark: SparkSession, folder: str) -> DataFrame:
    services = derived(spark, folder, "services").withColumn("labels", _labels())
    tagged = m.labels_to_tags(services)
    return tagged.select("service_id", F.to_json("tags").alias("tags"))


@registered
def project_addresses(spark: SparkSession, folder: str) -> DataFrame:
    access = F.when(
        F.col("public_ip") != "", F.array(F.struct(F.col("public_ip").alias("nat_ip")))
    ).otherwise(F.array().cast("array<struct<nat_ip:string>>"))
    nic = F.struct(F.col("private_ip").alias("network_ip"), access.alias("access_configs"))
    interfaces = F.when(F.col("launch_ord") % 13 == 0, F.array().cast(
        "array<struct<network_ip:string,access_configs:array<struct<nat_ip:string>>>>"
    )).otherwise(F.array(nic))
    machines = derived(spark, folder, "members").select(
        "launch_ord", interfaces.alias("network_interfaces")
    )
    return m.project_addresses(machines).drop("network_interfaces")


@registered
def registration_requests(spark: SparkSession, folder: str) -> DataFrame:
    accepted, rejected = m.registration_requests(
        derived(spark, folder, "discovered"), "owner-1", keep=["ord"]
    )
    documents = m.registration_json(accepted, keep=["ord"])
    none = F.lit(None).cast("string")
    return documents.withColumn("reason", none).unionByName(
        rejected.select("ord", none.alias("json"), "reason")
    )


@registered
def lookup_instance(spark: SparkSession, folder: str) -> DataFrame:
    return m.lookup_instance(
        derived(spark, folder, "lookups"), derived(spark, folder, "discovered")
    )


@registered
def lookup_instance_split(spark: SparkSession, folder: str) -> DataFrame:
    """The same with every wanted id treated as a heavy key."""
    return m.lookup_instance(
        derived(spark, folder, "lookups"), derived(spark, folder, "discovered"), limit=SMALL_LIMIT
    )


@registered
def purge_by_owner(spark: SparkSession, folder: str) -> DataFrame:
    services = derived(spark, folder, "services").withColumn("custom_labels", _labels())
    owners = derived(spark, folder, "owners")
    return m.purge_by_owner(services, owners).drop("custom_labels")


@registered
def register_discovered(spark: SparkSession, folder: str) -> DataFrame:
    accepted, rejected = register_databases(
        _discovery(spark, folder),
        derived(spark, folder, "lookups"),
        "owner-1",
    )
    none = F.lit(None).cast("string")
    return accepted.withColumn("reason", none).unionByName(
        rejected.withColumn("json", none)
    )


# Cloud resources.


@registered
def parse_resource_names(spark: SparkSession, folder: str) -> DataFrame:
    return m.parse_resource_names(derived(spark, folder, "arns"))


@registered
def group_resource_ids(spark: SparkSession, folder: str) -> DataFrame:
    parsed = m.parse_resource_names(derived(spark, folder, "arns"))
    return m.group_resource_ids(parsed).withColumn("ids", _joined("ids"))


@registered
def group_resource_ids_split(spark: SparkSession, folder: str) -> DataFrame:
    """The same in small batches, with every type treated as a heavy group."""
    parsed = m.parse_resource_names(derived(spark, folder, "arns"))
    return m.group_resource_ids(parsed, batch=25, limit=100).withColumn("ids", _joined("ids"))


def _reconciled(spark: SparkSession, folder: str) -> DataFrame:
    return m.reconcile_resources(
        derived(spark, folder, "desired"), derived(spark, folder, "actual"), compare="content"
    )


@registered
def reconcile_resources(spark: SparkSession, folder: str) -> DataFrame:
    return _reconciled(spark, folder)


@registered
def orphaned_resources(spark: SparkSession, folder: str) -> DataFrame:
    return m.orphaned_resources(derived(spark, folder, "actual"), _reconciled(spark, folder))


@registered
def expected_resources(spark: SparkSession, folder: str) -> DataFrame:
    networks = derived(spark, folder, "desired").select(
        "desired_id",
        F.concat(F.lit("vpc-"), F.col("desired_id").cast("string")).alias("vpc_id"),
        F.when(F.col("desired_id") % 9 == 0, "default")
        .otherwise(F.col("want_name"))
        .alias("vpc_name"),
        F.when(F.col("desired_id") % 2 == 0, "aws").otherwise("gcp").alias("cloud"),
    )
    return m.expected_resources(networks, keep=("desired_id",))


@registered
def reconcile_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Network, gateway, subnet, route table and group of every request, got or created."""
    return m.reconcile_chain(
        derived(spark, folder, "chain_requests"),
        derived(spark, folder, "chain_networks"),
        derived(spark, folder, "chain_resources"),
    )


@registered
def latest_image(spark: SparkSession, folder: str) -> DataFrame:
    return m.latest_image(derived(spark, folder, "images"))


@registered
def latest_image_of_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Creation times as text, with ties and some that do not parse; the link comes along."""
    return m.latest_image(derived(spark, folder, "dated_images"), keep=["link"])


@registered
def latest_ready_image(spark: SparkSession, folder: str) -> DataFrame:
    return m.latest_ready_image(derived(spark, folder, "images"))


# Topology.


@registered
def assign_roles(spark: SparkSession, folder: str) -> DataFrame:
    return m.assign_roles(derived(spark, folder, "members"))


@registered
def assign_roles_split(spark: SparkSession, folder: str) -> DataFrame:
    """The same with every cluster above two members numbered slice by slice."""
    return m.assign_roles(derived(spark, folder, "members"), limit=2)


@registered
def assign_new_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Two loads: the second brings the first one's members again, and further ones among them.

    Between the loads the last member of each cluster leaves; its number is not given again.
    """
    members = derived(spark, folder, "members")
    first = m.assign_roles(members.where("launch_ord % 3 <> 0"))
    marks = m.high_marks(first)
    last = marks.withColumnRenamed("high", "server_id")
    left = first.join(last, ["cluster_id", "server_id"], "left_anti")
    gone = first.join(last, ["cluster_id", "server_id"], "left_semi").select("launch_ord")
    return m.assign_new_roles(members.join(gone, "launch_ord", "left_anti"), left, marks=marks)


@registered
def peer_lists(spark: SparkSession, folder: str) -> DataFrame:
    return m.peer_lists(derived(spark, folder, "members")).withColumn("nodes", _joined("nodes"))


@registered
def cluster_readiness(spark: SparkSession, folder: str) -> DataFrame:
    return m.cluster_readiness(
        derived(spark, folder, "members"), derived(spark, folder, "clusters")
    )


@registered
def ready_since(spark: SparkSession, folder: str) -> DataFrame:
    """Since when all members of a cluster answer, from a month of probes."""
    return m.ready_since(derived(spark, folder, "probes"), at="seen_at")


@registered
def instance_config(spark: SparkSession, folder: str) -> DataFrame:
    """Every member with the lists of its cluster, over clusters of a few members."""
    return m.instance_config(
        derived(spark, folder, "small_members"), derived(spark, folder, "small_clusters"), lists="inline"
    )


@registered
def instance_config_shared(spark: SparkSession, folder: str) -> DataFrame:
    """The lists once per cluster, over clusters that grow with the table."""
    return m.instance_config(
        derived(spark, folder, "members"), derived(spark, folder, "clusters")
    )


@registered
def config_status(spark: SparkSession, folder: str) -> DataFrame:
    return m.config_status(derived(spark, folder, "members"), derived(spark, folder, "clusters"))


@registered
def manager_config(spark: SparkSession, folder: str) -> DataFrame:
    return m.manager_config(derived(spark, folder, "small_members"))


@registered
def cluster_config_files(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_files(
        derived(spark, folder, "small_members"),
        derived(spark, folder, "small_clusters"),
        base={"user": "mysql", "port": "3306", "userstat": "OFF"},
    )


# Endpoints and fingerprints.


@registered
def normalize_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return m.normalize_endpoints(pages, "url")


@registered
def normalize_endpoints_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Some urls with user info, a port, no scheme or another; path and user info taken out."""
    pages = query(
        spark,
        folder,
        "select page_id, case page_id % 5 when 0 then replace(url, '://', '://u:p@') "
        "when 1 then replace(url, '://', '://h:8080/') when 2 then replace(url, '://', '/') "
        "when 3 then concat('ftp:', split_part(url, ':', 2)) else url end as address from pages",
    )
    return m.normalize_endpoints(pages, "address", redact=True, clear_path=True).drop("address")


@registered
def fingerprint_rows(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    one = m.fingerprint_rows(customers, ["c_name"], "fnv1a_64")
    two = m.fingerprint_rows(one, ["c_name"], "fnv_64")
    both = m.fingerprint_rows(two, ["c_custkey", "c_mktsegment"], "fnv1a_64", into="row_hash",
                              separator="|")
    return both.select("c_custkey", "fnv1a_64", "fnv_64", "row_hash")


@registered
def fingerprint_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole document texts, any language, by their UTF-8 bytes."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return m.fingerprint_rows(documents, ["text"], "fnv1a_64").select("doc_id", "fnv1a_64")


@registered
def murmur_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return m.fingerprint_rows(orders, ["o_orderkey", "o_orderpriority"], "murmur").select(
        "o_orderkey", "murmur"
    )
