"""Fleet tables derived from the given tables.

The given tables hold no clusters, versions or documents, so the queries derive them.
Each text runs unchanged in Spark and in the checking engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

DERIVED: dict[str, str] = {
    "cfg": """
        select
            c_custkey as config_id,
            case c_custkey % 3 when 0 then 'ps' when 1 then 'pxc' else 'pmm' end as
                resource,
            case when c_custkey % 2 = 0 then 'aws' else 'gcp' end as cloud,
            lower(c_mktsegment) as instance_type,
            case when c_nationkey % 4 = 0 then '' else 'gp3' end as volume_type,
            c_nationkey as volume_size,
            case when c_custkey % 5 = 0 then 0 else 3000 end as volume_iops,
            case c_custkey % 6 when 0 then '' when 1 then '8' when 2 then '8.0' when 3 then
                '8.0.28' when 4 then '8.0.28-19-1.focal' else '08.x' end as version,
            case c_custkey % 4 when 1 then 'group-replication' when 2 then 'semi' else
                'async' end as replication_type,
            c_custkey % 7 - 1 as orchestrator_size,
            case when c_custkey % 9 = 0 then 'default' else concat('net', c_nationkey) end
                as vpc_name,
            'not-a-secret' as password
        from customer
    """,
    "pkg_index": """
        select
            p_partkey as ord,
            concat(5 + p_partkey % 4, '.', p_partkey % 3, '.', p_size, case p_partkey % 5
                when 0 then '' when 1 then '-19-1.focal' when 2 then '-2' when 3 then '+b1'
                else '.1' end) as version
        from part
    """,
    "ver_requests": """
        select
            o_orderkey as request_id,
            case o_orderkey % 6 when 0 then null when 1 then concat(5 + o_orderkey % 5, '')
                when 2 then concat(5 + o_orderkey % 4, '.', o_orderkey % 3) when 3 then
                concat(5 + o_orderkey % 4, '.', o_orderkey % 3, '.', o_orderkey % 50) when 4
                then concat(5 + o_orderkey % 4, '.', o_orderkey % 3, '.', o_orderkey % 50,
                '-2') else 'x' end as wanted
        from orders
    """,
    "pkg_text": """
        select
            p_brand as package,
            p_partkey as ord,
            case when p_partkey % 4 = 0 then concat('Description: ', p_name) when p_partkey
                % 4 = 1 then concat('Version: 1:', p_size, '.0') else concat('Version: ',
                p_size, '.1') end as line
        from part
    """,
    "members": """
        select
            s_nationkey as cluster_id,
            s_suppkey as launch_ord,
            concat('10.', s_nationkey, '.0.', s_suppkey % 250) as private_ip,
            case when s_suppkey % 17 = 0 then '' else concat('34.', s_nationkey, '.0.',
                s_suppkey % 250) end as public_ip,
            s_acctbal > 500 as reachable
        from supplier
    """,
    "small_members": """
        select
            cast(floor(s_suppkey / 5) as bigint) as cluster_id,
            s_suppkey as launch_ord,
            concat('10.', s_nationkey, '.0.', s_suppkey % 250) as private_ip
        from supplier
    """,
    "small_clusters": """
        select
            cast(floor(s_suppkey / 5) as bigint) as cluster_id,
            case floor(s_suppkey / 5) % 3 when 0 then 'async' when 1 then
                'group-replication' else 'xtradb' end as kind
        from supplier
        where s_suppkey % 5 = 0
    """,
    "clusters": """
        select
            n_nationkey as cluster_id,
            case n_regionkey % 3 when 0 then 'async' when 1 then 'group-replication' else
                'xtradb' end as kind
        from nation
        union all select 99 as cluster_id,
            'async' as kind
    """,
    "services": """
        select
            concat('svc-', c_custkey) as service_id,
            case c_custkey % 6 when 0 then 'mysql' when 1 then 'mongodb' when 2 then
                'postgresql' when 3 then 'proxysql' when 4 then 'haproxy' else 'external'
                end as service_type,
            case when c_custkey % 4 = 0 then null else concat('own', c_nationkey) end as
                owner,
            lower(c_mktsegment) as role
        from customer
    """,
    "owners": """
        select
            concat('own', n_nationkey) as owner
        from nation
        where n_regionkey = 0
    """,
    "discovered": """
        select
            s_suppkey as ord,
            concat('db-', s_suppkey % 80) as instance_id,
            concat('region-', s_nationkey) as region,
            concat('host', s_suppkey) as address,
            3306 + s_suppkey % 3 as port,
            case s_suppkey % 5 when 0 then 'DISCOVER_RDS_INVALID' when 1 then
                'DISCOVER_RDS_POSTGRESQL' else 'DISCOVER_RDS_MYSQL' end as engine
        from supplier
    """,
    "listing_answers": """
        select
            listing,
            ord,
            case when place > 1 then concat('t', ord) when listing <> 49 then '' end as token,
            case when listing % 10 = 4 and next_ord % 97 = 0 then concat('x', next_ord)
                when next_ord is not null then concat('t', next_ord)
                when listing % 10 = 3 then concat('t', last_ord) end as next_token
        from (
            select
                o_custkey % 50 as listing,
                o_orderkey as ord,
                row_number() over (partition by o_custkey % 50 order by o_orderkey % 7, o_orderkey) as place,
                lag(o_orderkey) over (partition by o_custkey % 50 order by o_orderkey % 7, o_orderkey)
                    as last_ord,
                lead(o_orderkey) over (partition by o_custkey % 50 order by o_orderkey % 7, o_orderkey)
                    as next_ord
            from orders
        ) ordered
    """,
    "listing_pages": """
        select listing, ord, case when listing = 49 and token is null then 'lost' else token end as token,
            next_token
        from listing_answers
        union all select listing, ord + 10000000000 as ord, token, null as next_token
        from listing_answers
        where ord % 13 = 0 and token <> ''
    """,
    "lookups": """
        select
            c_custkey as request_id,
            concat('db-', c_custkey % 120) as wanted_id
        from customer
    """,
    "arns": """
        select
            o_orderkey as ord,
            case o_orderkey % 10 when 0 then 'not-an-arn' when 1 then
                'arn:aws:ec2:eu-north-1:1:vpc' when 2 then
                concat('arn:aws:ec2:eu-north-1:1:vpc/v-', o_orderkey) when 3 then
                concat('arn:aws:ec2:eu-north-1:1:subnet/s-', o_orderkey) else
                concat('arn:aws:ec2:eu-north-1:1:instance/i-', o_orderkey) end as arn
        from orders
    """,
    "images": """
        select
            o_custkey as family,
            o_orderkey as ord,
            o_orderdate as created,
            concat('img-v', o_orderkey % 1000) as name,
            case when o_orderstatus = 'F' then 'READY' else 'PENDING' end as status
        from orders
    """,
    "dated_images": """
        select
            o_custkey as family,
            o_orderkey as ord,
            case when o_orderkey % 11 = 0 then 'soon' else
                concat(cast(cast(o_orderdate as date) as string), 'T0', o_orderkey % 3,
                ':30:00.000Z') end as created,
            concat('img-v', o_orderkey % 1000) as name,
            concat('link/', o_orderkey) as link
        from orders
    """,
    "desired": """
        select
            c_custkey as desired_id,
            case when c_custkey % 2 = 0 then concat('vpc-', c_custkey) else '' end as
                want_id,
            case when c_custkey % 10 = 0 then '' else concat('net', c_custkey % 500) end as
                want_name,
            concat('k', c_custkey % 11) as content
        from customer
    """,
    "actual": """
        select
            c_custkey as ord,
            concat('vpc-', c_custkey * 3) as act_id,
            concat('net', c_custkey % 700) as act_name,
            concat('k', c_custkey % 13) as content
        from customer
        where c_custkey % 4 <> 0
    """,
    "chain_requests": """
        select
            c_custkey as request_id,
            c_custkey * 7 % 100003 * 1000000 + c_custkey as request_ord,
            case when c_custkey % 3 = 0 then concat('vpc-', c_custkey % 900) else '' end as
                want_id,
            case when c_custkey % 10 = 0 then '' else concat('net', c_custkey % 700) end as
                want_name
        from customer
    """,
    "chain_networks": """
        select
            c_custkey as ord,
            concat('vpc-', c_custkey) as act_id,
            case when c_custkey % 11 = 0 then '' else concat('net', c_custkey % 400) end as
                act_name
        from customer
        where c_custkey % 4 <> 0
    """,
    "chain_resources": """
        select
            o_orderkey as ord,
            case o_orderkey % 4 when 0 then 'internet-gateway' when 1 then 'security-group'
                when 2 then 'subnet' else 'route-table' end as kind,
            concat('res-', o_orderkey) as act_id,
            case when o_orderkey % 5 = 0 then '' else concat('net', o_custkey % 400,
                case o_orderkey % 4 when 0 then '-igw' when 1 then '-sg' when 2 then
                '-subnet' else '-rtb' end) end as act_name,
            concat('vpc-', o_custkey) as network_id,
            o_orderkey % 3 <> 0 as default_route
        from orders
    """,
    "machines": """
        select
            c_custkey as machine_id,
            case when c_custkey % 4 = 0 then null else concat('own', c_nationkey) end as
                owner,
            lower(c_mktsegment) as role,
            case c_custkey % 3 when 0 then 'prod' when 1 then 'test' else null end as tier,
            concat('zone-', c_custkey % 40) as zone
        from customer
    """,
    "selectors": """
        select
            s_suppkey as selector_id,
            case when s_suppkey % 3 = 0 then null else concat('own', s_nationkey) end as
                owner,
            case s_suppkey % 8 when 0 then 'machinery' when 1 then 'building' when 2 then
                'nothing' else null end as role,
            case when s_suppkey % 2 = 0 then 'prod' else null end as tier,
            case when s_suppkey % 5 < 3 then concat('zone-', s_suppkey % 41) else null end
                as zone
        from supplier
    """,
    "probes": """
        select
            user_id % 15 as cluster_id,
            user_id as member,
            ts as seen_at,
            event_id as ord,
            case event_type when 'error' then 'silent' when 'signup' then 'gone' else
                'answers' end as state
        from events
    """,
    "ini_edits": """
        select
            p_partkey as doc_id,
            'mysqld' as section,
            case when p_partkey % 3 = 0 then 'port' else 'userstat' end as key,
            concat('v', p_size) as value
        from part
        where p_partkey % 97 = 1
        union all select
            -p_partkey as doc_id,
            'client' as section,
            'host' as key,
            p_type as value
        from part
        where p_partkey % 97 = 2
    """,
    "ini_docs": """
        select
            p_partkey as doc_id,
            concat('[mysqld]', chr(10), 'port=', 3306 + p_size, chr(10),
                'skip-name-resolve', chr(10), '; ', p_name, chr(10), '[client]', chr(10),
                'user = ', p_type, case when p_partkey % 2 = 0 then concat(chr(10),
                '# again', chr(10), 'host = h', p_size, chr(10), 'user = b', p_size) else ''
                end) as doc
        from part
    """,
    "ini_layer": """
        select
            p_partkey as doc_id,
            'mysqld' as section,
            case when p_partkey % 2 = 0 then 'port' else 'userstat' end as key,
            case when p_partkey % 2 = 0 then '3307' else 'ON' end as value
        from part
        where p_partkey % 3 <> 0
    """,
}

# The same config records with what a registered machine also has.
DERIVED["configs"] = f"""
        select
            c.*,
            case when config_id % 8 = 0 then '' else concat('kp', config_id % 3) end
                as key_pair_name,
            config_id % 11 = 0 as disable_telemetry
        from ({DERIVED["cfg"]}) c
"""


# Schemas of the given tables, so that reading one starts no job.
SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}


DERIVED["listing_pages"] = DERIVED["listing_pages"].replace(
    "from listing_answers", f"from ({DERIVED['listing_answers']}) answers"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def query(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run ``sql`` with the given tables' names standing for their files in ``folder``."""
    names = sorted(set(re.findall(rf"\bfrom ({'|'.join(TABLES)})\b", sql)))
    text = re.sub(rf"\bfrom ({'|'.join(TABLES)})\b", r"from {\1}", sql)
    return spark.sql(text, **{name: table(spark, folder, name) for name in names})


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return query(spark, folder, DERIVED[name])
