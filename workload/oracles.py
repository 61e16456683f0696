"""The same results in plain SQL, to check the registered queries against."""

from __future__ import annotations

from .derived import DERIVED

_ORACLES: dict[str, str] = {}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _add(name: str, body: str, *needs: str, **views: str) -> None:
    """Register ``body`` with the derived tables it needs and further named views before it."""
    parts = [f"{n} as ({DERIVED[n]})" for n in needs]
    parts += [f"{n} as ({sql})" for n, sql in views.items()]
    head = f"with {', '.join(parts)} " if parts else ""
    _ORACLES[name] = head + body


# Telemetry and configuration.

_REPORTED = {
    "key_pair_name": ("('ps', 'pxc', 'pmm')", "key_pair_name <> ''"),
    "instance_type": ("('ps', 'pxc', 'pmm')", "instance_type <> ''"),
    "volume_type": ("('ps', 'pxc', 'pmm')", "volume_type <> ''"),
    "volume_size": ("('ps', 'pxc', 'pmm')", "volume_size <> 0"),
    "volume_iops": ("('ps', 'pxc', 'pmm')", "volume_iops <> 0"),
    "vpc_name": ("('ps', 'pxc', 'pmm')", "vpc_name <> ''"),
    "version": ("('ps', 'pxc')", "version <> ''"),
    "replication_type": ("('ps')", "replication_type <> ''"),
    "orchestrator_size": ("('ps')", "orchestrator_size <> 0"),
}


def _metric_rows(source: str, fields: dict[str, tuple[str, str]]) -> str:
    rows = [
        f"select config_id, 'product' as key, 'terraform-provider' as value from {source}",
        f"select config_id, 'resource' as key, resource as value from {source}",
    ]
    rows += [
        f"select config_id, '{name}' as key, cast({name} as varchar) as value from {source} "
        f"where resource in {kinds} and {is_set}"
        for name, (kinds, is_set) in fields.items()
    ]
    return " union all ".join(rows)


def _metric_json(fields: dict[str, tuple[str, str]]) -> str:
    """JSON text of the metrics of one record, as an SQL expression."""
    pieces = [
        """'{"key":"product","value":"terraform-provider"},{"key":"resource","value":"'"""
        """ || resource || '"}'"""
    ]
    for name, (kinds, is_set) in fields.items():
        pieces.append(
            f"case when resource in {kinds} and {is_set} "
            f"""then ',{{"key":"{name}","value":"' || cast({name} as varchar) || '"}}' else '' end"""
        )
    return " || ".join(pieces)


def _document(fields: dict[str, tuple[str, str]], time: str) -> str:
    # Only the fraction may lose zeros, so it is trimmed apart from the seconds.
    utc = (
        f"strftime({time}, '%Y-%m-%dT%H:%M:%S') || "
        f"rtrim(rtrim('.' || strftime({time}, '%f'), '0'), '.')"
    )
    return (
        """'{"metrics":{"id":"' || cast(config_id as varchar) || '","time":"' || """
        + utc
        + """ || 'Z","pmmServerTelemetryId":"xxxxxxxxxxxxxxxxxxxxxx","pmmServerVersion":"1.0",'"""
        """ || '"upDuration":"0.673692200s","distributionMethod":"DOCKER","metrics":[' || """
        + _metric_json(fields)
        + """ || ']}}'"""
    )


_CFG_FIELDS = {k: v for k, v in _REPORTED.items() if k != "key_pair_name"}
_SENT = "select *, make_timestamp(1700000000000000 + config_id * 1234560) as sent_at from configs"

_add("telemetry_metrics", _metric_rows("cfg", _CFG_FIELDS), "cfg")
# Documents list the metrics in catalog order.
_add(
    "telemetry_documents",
    f"select config_id, {_document(_REPORTED, 'sent_at')} as json from sent",
    "configs",
    sent=_SENT,
)
_add(
    "report_telemetry_documents",
    f"select config_id, {_document(_REPORTED, 'sent_at')} as json from filled",
    "configs",
    sent=_SENT,
    filled="""
        select * replace (
            case when volume_size = 0 and resource in ('ps', 'pxc', 'pmm') then 20
                else volume_size end as volume_size,
            case when replication_type = '' and resource = 'ps' then 'async'
                else replication_type end as replication_type)
        from sent where not disable_telemetry
    """,
)
_add(
    "telemetry_delivery",
    f"""
    select config_id, case when reason is null then {_document(_REPORTED, 'sent_at')} end as json, reason
    from (
        select * replace (case when config_id % 17 = 0 then 'vm' else resource end as resource),
            case when config_id % 17 = 0 then 'unknown_resource' when config_id % 13 = 0 then 'no_time' end as reason
        from sent where not disable_telemetry
    )
    """,
    "configs",
    sent=_SENT,
)
_EVENT_FIELDS = {
    "instance_type": ("('pmm')", "coalesce(instance_type, '') <> ''"),
    "volume_size": ("('pmm')", "coalesce(volume_size, 0) <> 0"),
}
_add(
    "telemetry_of_events",
    f"select config_id, {_document(_EVENT_FIELDS, 'sent_at')} as json from records",
    records="""
        select event_id as config_id, 'pmm' as resource, event_type as instance_type,
            user_id as volume_size, ts as sent_at
        from events
    """,
)
_add(
    "telemetry_stream_metrics",
    _metric_rows("sent", _REPORTED),
    "configs",
    sent="select * from configs where not disable_telemetry",
)

_VALID_VERSION = (
    "^(0|[1-9][0-9]*)([.](0|[1-9][0-9]*)([.](0|[1-9][0-9]*)"
    "(-(0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
    "([.](0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*)?"
    "([+][0-9A-Za-z-]+([.][0-9A-Za-z-]+)*)?)?)?$"
)
_BROKEN = f"""
    select config_id, 1 as rule, 'missing_key_pair_name' as error from configs
    where key_pair_name = ''
    union all select config_id, 2, 'version_empty' from configs
    where resource in ('ps', 'pxc') and version = ''
    union all select config_id, 3, 'version_invalid' from configs
    where resource in ('ps', 'pxc') and version <> ''
        and not regexp_matches(version, '{_VALID_VERSION}')
    union all select config_id, 4, 'replication_type_unsupported' from configs
    where resource = 'ps' and replication_type not in ('async', 'group-replication')
    union all select config_id, 5, 'orchestrator_size_too_small' from configs
    where resource = 'ps' and orchestrator_size in (1, 2)
"""
_NEGATIVE = """
    union all select config_id, 6, 'orchestrator_size_negative' from configs
    where resource = 'ps' and orchestrator_size < 0
"""
_add(
    "validate_config",
    """
    select c.config_id, cast(count(b.error) as integer) as n,
        coalesce(string_agg(b.error, ',' order by b.rule), '') as errors
    from configs c left join broken b on b.config_id = c.config_id
    group by c.config_id
    """,
    "configs",
    broken=_BROKEN + _NEGATIVE,
)
_add(
    "error_counts",
    "select error, count(*) as records from broken group by error",
    "configs",
    broken=_BROKEN,
)
_add(
    "apply_defaults",
    """
    select config_id, resource, cloud, instance_type,
        case when volume_type <> '' then volume_type when cloud = 'aws' then 'gp2'
            else 'pd-balanced' end as volume_type,
        case when volume_size = 0 then 20 else volume_size end as volume_size,
        nullif(volume_iops, 0) as volume_iops,
        version, replication_type, orchestrator_size, vpc_name,
        case when cloud = 'gcp' then case when vpc_name = 'default' then 'default'
            else vpc_name || '-sub' end end as subnetwork
    from cfg
    """,
    "cfg",
)
_add(
    "compact_json",
    """
    select config_id, '{' || array_to_string(list_filter([
        case when version <> '' then '"version":"' || version || '"' end,
        case when volume_size <> 0 then '"volume_size":' || volume_size end,
        case when disable_telemetry then '"disable_telemetry":true' end,
        '"disk":{' || array_to_string(list_filter([
            case when volume_type <> '' then '"volume_type":"' || volume_type || '"' end,
            case when volume_iops <> 0 then '"volume_iops":' || volume_iops end
        ], lambda x: x is not null), ',') || '}',
        case when cloud = 'aws' then '"tags":{"net":"' || vpc_name || '"}' end,
        case when volume_size > 9 then '"sizes":[' || volume_size || ']' end
    ], lambda x: x is not null), ',') || '}' as json
    from configs
    """,
    "configs",
)

# Versions.

_LISTED = """
    select concat(package, '/', ord) as package, 0 as ord, concat('Package: ', package) as line
    from pkg_text
    union all select concat(package, '/', ord), 1, line from pkg_text
    union all select concat(package, '/', ord), 2, concat('X-Version-Note: ', ord) from pkg_text
"""
for _name, _prefix in (("package_index", "Version: "), ("package_index_epoch", "Version: 1:")):
    _add(
        _name,
        f"""
        select package, ord, case when instr(line, '{_prefix}') > 0
            then substr(line, 1, instr(line, '{_prefix}') - 1)
                || substr(line, instr(line, '{_prefix}') + {len(_prefix)})
            else line end as version
        from listed where contains(line, 'Version')
        """,
        "pkg_text",
        listed=_LISTED,
    )

_SPLIT_VERSIONS = f"""
    select ord, version, split_part(version, '-', 1) as cut,
        regexp_matches(version, '{_VALID_VERSION}') as valid,
        regexp_matches(split_part(version, '-', 1), '{_VALID_VERSION}') as cut_valid,
        string_split(split_part(split_part(version, '-', 1), '+', 1), '.') as nums
    from pkg_index
"""
_ENTRIES = """
    select 'default' as kind, '' as key, version, ord from versions
    union all select 'major', nums[1], version, ord from versions where valid
    union all select 'minor', nums[1] || '.' || coalesce(nums[2], '0'), version, ord
    from versions where valid
    union all select 'text', version, version, ord from versions
    union all select 'canonical',
        nums[1] || '.' || coalesce(nums[2], '0') || '.' || coalesce(nums[3], '0'), version, ord
    from versions where cut_valid
"""
_add(
    "version_keys",
    "select kind, key, arg_min(version, ord) as version, min(ord) as ord "
    "from entries group by kind, key",
    "pkg_index",
    versions=_SPLIT_VERSIONS,
    entries=_ENTRIES,
)
_add(
    "resolve_versions",
    f"""
    select r.request_id, arg_min(e.version, e.ord) as version,
        case when count(e.ord) > 0 and r.asked = '' then 'default'
            when count(e.ord) > 0 then 'found'
            when r.asked = '' or regexp_matches(r.asked, '{_VALID_VERSION}') then 'not_found'
            else 'invalid' end as status
    from asked r left join keyed e on e.key = r.key and e.kind = r.kind
    group by r.request_id, r.asked
    """,
    "pkg_index",
    "ver_requests",
    versions=_SPLIT_VERSIONS,
    entries=_ENTRIES,
    keyed="select kind, key, arg_min(version, ord) as version, min(ord) as ord "
    "from entries group by kind, key",
    requests="select request_id, coalesce(wanted, '') as asked from ver_requests",
    asked=f"""
    select request_id, asked, 'default' as kind, '' as key from requests where asked = ''
    union all select request_id, asked, 'major', asked from requests
    where regexp_matches(asked, '^(0|[1-9][0-9]*)$')
    union all select request_id, asked, 'minor', asked from requests
    where regexp_matches(asked, '^(0|[1-9][0-9]*)[.](0|[1-9][0-9]*)$')
    union all select request_id, asked, 'text', asked from requests
    where asked <> '' and not regexp_matches(asked, '^(0|[1-9][0-9]*)([.](0|[1-9][0-9]*))?$')
    union all select request_id, asked, 'canonical', split_part(asked, '+', 1) from requests
    where regexp_matches(asked, '{_VALID_VERSION}')
        and not regexp_matches(asked, '^(0|[1-9][0-9]*)([.](0|[1-9][0-9]*))?$')
    """,
)

# Documents.

_INI_PARSED = """
    select doc_id, i, line, line like '[%' as is_header,
        case when above like ';%' or above like '#%' then above end as comment,
        cast(sum(case when line like '[%' and i > 1 then 1 else 0 end)
            over (partition by doc_id order by i) as bigint) as block
    from (
        select *, lag(line) over (partition by doc_id order by i) as above
        from (
            select doc_id, unnest(string_split(doc, chr(10))) as line,
                generate_subscripts(string_split(doc, chr(10)), 1) as i
            from ini_docs
        )
    )
"""
_INI_ROWS = """
    select doc_id,
        block * 4294967296 + (i - first_i) - comments as ord,
        section,
        case when contains(line, '=') then trim(split_part(line, '=', 1)) else trim(line) end
            as key,
        case when contains(line, '=') then trim(substr(line, instr(line, '=') + 1))
            else 'true' end as value,
        not contains(line, '=') as valueless, comment, section_comment
    from (
        select *, min(i) over (partition by doc_id, block) as first_i,
            cast(sum(case when line like ';%' or line like '#%' then 1 else 0 end)
                over (partition by doc_id, block order by i) as bigint) as comments,
            max(case when is_header then comment end) over (partition by doc_id, block)
                as section_comment,
            max(case when is_header then trim(line, '[]') end)
                over (partition by doc_id, block) as section
        from parsed
    )
    where not is_header and line <> '' and line not like ';%' and line not like '#%'
"""
_add("ini_rows", "select * from rows_", "ini_docs", parsed=_INI_PARSED, rows_=_INI_ROWS)

# A key keeps its first place and the comments there, and takes the last value.
_PLACE = "layer * 1000000000000 + ord"


def _once(rows: str) -> str:
    return f"""
    select doc_id, section, key, arg_max(value, {_PLACE}) as value,
        arg_max(source, {_PLACE}) as source, arg_max(valueless, {_PLACE}) as valueless,
        nullif(arg_min(coalesce(comment, ''), {_PLACE}), '') as comment,
        nullif(arg_min(coalesce(section_comment, ''), {_PLACE}), '') as section_comment,
        arg_min(layer, {_PLACE}) as layer, arg_min(ord, {_PLACE}) as ord
    from {rows} group by doc_id, section, key
    """


def _rendered(rows: str) -> str:
    """Rows (doc_id, section, layer, ord, key, value, ...) as INI text per document."""
    return f"""
    select doc_id, cast(0 as bigint) as part,
        string_agg(body, chr(10) order by first_place) as text
    from (
        select doc_id, section, min({_PLACE}) as first_place,
            coalesce(nullif(arg_min(coalesce(section_comment, ''), {_PLACE}), '') || chr(10), '')
            || '[' || section || ']' || chr(10) || string_agg(
                coalesce(comment || chr(10), '')
                || case when valueless then key else key || ' = ' || value end,
                chr(10) order by layer, ord, key) || chr(10) as body
        from {rows} group by doc_id, section
    ) group by doc_id
    """


_add(
    "ini_documents",
    _rendered("once"),
    "ini_docs",
    parsed=_INI_PARSED,
    rows_=_INI_ROWS,
    once=_once("(select *, 0 as layer, '' as source from rows_)"),
)
_OVERLAID = _once("""(
        select doc_id, section, key, value, valueless, 'base' as source, 0 as layer, ord, comment,
            section_comment from rows_
        union all
        select doc_id, section, key, value, false, 'layer', 1, 0, null, null from ini_layer
    )""")
_add(
    "overlay_config",
    "select doc_id, section, key, value, source from overlaid",
    "ini_docs",
    "ini_layer",
    parsed=_INI_PARSED,
    rows_=_INI_ROWS,
    overlaid=_OVERLAID,
)
_add(
    "overlaid_documents",
    _rendered("overlaid"),
    "ini_docs",
    "ini_layer",
    parsed=_INI_PARSED,
    rows_=_INI_ROWS,
    overlaid=_OVERLAID,
)

_add(
    "upserted_documents",
    f"""
    select doc_id, doc as text from ini_docs where doc_id not in (select doc_id from ini_edits)
    union all
    select doc_id, text from ({_rendered("edited")}) where doc_id in (select doc_id from ini_edits)
    """,
    "ini_docs",
    "ini_edits",
    parsed=_INI_PARSED,
    rows_=_INI_ROWS,
    edited=_once("""(
        select doc_id, section, key, value, valueless, 'base' as source, 0 as layer, ord, comment,
            section_comment from rows_
        union all
        select doc_id, section, key, value, false, 'edits', 1, 0, null, null from ini_edits
    )"""),
)

# Inventory.

_add(
    "discovered_instances",
    """
    select ord, region, cast(null as varchar) as az, instance_id,
        cast(null as varchar) as node_model, address, cast(port as bigint) as port, engine,
        cast(null as varchar) as engine_version
    from discovered where ord % 7 > 2
    union all
    select ord, null, null, concat('bare-', ord), null, null, null, null, null
    from discovered where ord % 7 > 2
    """,
    "discovered",
)
_add(
    "malformed_documents",
    "select ord, '{bad' as json from discovered where ord % 7 = 1",
    "discovered",
)
_add(
    "service_inventory",
    """
    select service_type, service_id, concat('name-', service_id) as service_name,
        cast(null as varchar) as address,
        case when service_type in ('haproxy', 'external') then null else 3306 end as port,
        case when service_type = 'postgresql' then 'db' end as database_name,
        case when service_type = 'external' then 'grp' end as "group",
        owner, role
    from services
    """,
    "services",
)
_add(
    "service_inventory_of_documents",
    """
    select cast(split_part(service_id, '-', 2) as bigint) // 12 as doc, service_type, service_id,
        concat('name-', service_id) as service_name,
        case when service_type in ('haproxy', 'external') then null else 3306 end as port,
        case when service_type = 'postgresql' then 'db' end as database_name,
        case when service_type = 'external' then 'grp' end as "group",
        owner
    from services
    """,
    "services",
)
_LONG_LISTINGS = """
    select package || '/' || (p // 20) as package, line,
        cast(row_number() over (partition by package, p // 20 order by p) - 1 as integer) as ord
    from (select *, ord as p from pkg_text)
"""
_LONG_INDEX = """
    select package, ord, replace(line, 'Version: ', '') as version from listed
    where contains(line, 'Version')
"""
_add(
    "package_index_of_listings", "select * from indexed", "pkg_text",
    listed=_LONG_LISTINGS, indexed=_LONG_INDEX,
)
_add(
    "versions_of_listings",
    """
    select l.package, l.package as request_id, version,
        case when version is null then 'not_found' else 'default' end as status
    from (select distinct package from listed) l
    left join (select package, arg_min(version, ord) as version from indexed group by package) i
        on i.package = l.package
    """,
    "pkg_text",
    listed=_LONG_LISTINGS,
    indexed=_LONG_INDEX,
)
_add(
    "select_by_labels",
    "select * from services where role = 'machinery' and owner = 'own3'",
    "services",
)
_add(
    "match_selectors",
    """
    select selector_id, machine_id from selectors s join machines m
      on (s.owner is null or m.owner = s.owner) and (s.role is null or m.role = s.role)
      and (s.tier is null or m.tier = s.tier) and (s.zone is null or m.zone = s.zone)
    where coalesce(s.owner, s.role, s.tier, s.zone) is not null
    """,
    "selectors",
    "machines",
)
# One step of a chain after the other, as many as its listing has answers.
_FOLLOWED = """
    select listing, token, next_token, ord, 0::bigint as page_no from answered where token = ''
    union all
    select a.listing, a.token, a.next_token, a.ord, f.page_no + 1
    from followed f join answered a on a.listing = f.listing and a.token = f.next_token
    where f.page_no < (select max(n) from (select count(*) as n from answered group by listing))
"""
_PAGE_VIEWS = {
    "answered": """
        select listing, coalesce(token, '') as token, arg_min({'n': next_token}, ord).n as next_token, min(ord) as ord
        from listing_pages group by 1, 2
    """,
    "followed": _FOLLOWED,
    "places": "select listing, token, ord, min(page_no) as page_no from followed group by 1, 2, 3",
}


def _add_paged(name: str, body: str) -> None:
    _add(name, body, "listing_pages", **_PAGE_VIEWS)
    _ORACLES[name] = _ORACLES[name].replace("with ", "with recursive ", 1)


_add_paged(
    "paged_instances",
    """
    select listing, page_no, 'db-' || ord || '-' || i as instance_id, 3306 + i as port
    from (select listing, page_no, ord, unnest(range(ord % 3)) as i from places)
    """,
)
_add_paged(
    "page_chains",
    """
    select a.listing, count(p.page_no) as pages, count(*) - count(p.page_no) as unread,
        case when count(p.page_no) = 0 then 'headless'
            when bool_or(p.page_no is not null and a.next_token is null) then 'complete'
            when bool_or(p.page_no is not null and b.token is null) then 'broken'
            else 'cyclic' end as status
    from answered a left join places p on a.listing = p.listing and a.token = p.token
        left join answered b on a.listing = b.listing and a.next_token = b.token
    group by a.listing
    """,
)
_add(
    "labels_to_tags",
    """
    select service_id, '[{"key":"instance_type","value":"' || role || '"}'
        || coalesce(',{"key":"resource_id","value":"' || owner || '"}', '') || ']' as tags
    from services
    """,
    "services",
)
_add(
    "project_addresses",
    """
    select launch_ord,
        case when launch_ord % 13 <> 0 then nullif(public_ip, '') end as public_ip,
        case when launch_ord % 13 <> 0 then private_ip end as private_ip
    from members
    """,
    "members",
)


def _request_json(region: str = "region") -> str:
    return f"""'{{"region":"' || {region} || '","instance_id":"' || instance_id
        || '","address":"' || address || '","port":' || port || ',"engine":"' || engine
        || '","service_name":"' || instance_id || '","username":"pmm","rds_exporter":true,'
        || '"qan_mysql_perfschema":true,"custom_labels":{{"resource_id":"owner-1"}},'
        || '"tablestats_group_table_limit":-1,"metrics_mode":1,'
        || '"qan_postgresql_pgstatements":true}}'"""


_add(
    "registration_requests",
    f"""
    select ord, case when engine <> 'DISCOVER_RDS_INVALID' then {_request_json()} end as json,
        case when engine = 'DISCOVER_RDS_INVALID'
            then 'engine DISCOVER_RDS_INVALID is not supported' end as reason
    from discovered
    """,
    "discovered",
)
_LOOKED_UP = """
    select l.request_id, l.wanted_id, f.region, f.address, f.port, f.engine,
        case when f.instance_id is null then 'not_found' else 'found' end as status
    from lookups l left join firsts f on f.instance_id = l.wanted_id
"""
_FIRSTS = """
    select * from discovered
    qualify row_number() over (partition by instance_id order by ord) = 1
"""
for _name in ("lookup_instance", "lookup_instance_split"):
    _add(_name, _LOOKED_UP, "lookups", "discovered", firsts=_FIRSTS)
_add(
    "purge_by_owner",
    """
    select *, case when owner in (select owner from owners) then 'remove' else 'keep' end as action
    from services
    """,
    "services",
    "owners",
)
_add(
    "register_discovered",
    f"""
    select request_id, wanted_id as instance_id,
        case when engine <> 'DISCOVER_RDS_INVALID' and address is not null
            then {_request_json()} end as json,
        case when status = 'not_found' then 'not_found'
            when engine = 'DISCOVER_RDS_INVALID' then 'engine DISCOVER_RDS_INVALID is not supported'
        end as reason
    from (select *, wanted_id as instance_id from looked_up)
    """,
    "lookups",
    "discovered",
    firsts="""
        select * from discovered where ord % 7 > 2
        qualify row_number() over (partition by instance_id order by ord) = 1
    """,
    looked_up=_LOOKED_UP,
)

# Cloud resources.

_PARSED_ARNS = """
    select ord, arn,
        case when reason is null then split_part(resource, '/', 1) end as type,
        case when reason is null then split_part(resource, '/', 2) end as id,
        reason
    from (
        select ord, arn, split_part(arn, ':', 6) as resource,
            case when arn not like 'arn:%:%:%:%:%' then 'not_an_arn'
                when not contains(split_part(arn, ':', 6), '/') then 'no_id' end as reason
        from arns
    )
"""
_add("parse_resource_names", "select * from parsed", "arns", parsed=_PARSED_ARNS)
for _name, _batch in (("group_resource_ids", 1000), ("group_resource_ids_split", 25)):
    _add(
        _name,
        """
        select type, case type when 'instance' then 1 when 'subnet' then 3 when 'vpc' then 6 end
            as delete_rank, batch, string_agg(id, ',' order by pos) as ids,
            cast(count(*) as integer) as n
        from placed group by type, batch
        """,
        "arns",
        parsed=_PARSED_ARNS,
        placed=f"""
            select *, (pos - 1) // {_batch} as batch from (
                select *, row_number() over (partition by type order by ord) as pos
                from parsed where reason is null
            )
        """,
    )
_RECONCILED = """
    select d.*, coalesce(i.ord, n.ord) as match_ord, coalesce(i.act_id, n.act_id) as match_id,
        coalesce(i.act_name, n.act_name) as match_name,
        case when i.ord is not null then 'id' when n.ord is not null then 'name' end as matched_by,
        case when i.ord is null and n.ord is null then 'create'
            when d.content <> coalesce(i.content, n.content) then 'conflict'
            else 'reuse' end as action
    from desired d
    left join by_id i on i.act_id = d.want_id and d.want_id <> ''
    left join by_name n on n.act_name = d.want_name and d.want_name <> '' and i.ord is null
"""
_FIRST_ACTUAL = {
    "by_id": "select * from actual "
    "qualify row_number() over (partition by act_id order by ord) = 1",
    "by_name": "select * from actual "
    "qualify row_number() over (partition by act_name order by ord) = 1",
}
_add("reconcile_resources", _RECONCILED, "desired", "actual", **_FIRST_ACTUAL)
_add(
    "orphaned_resources",
    """
    select * from actual
    where ord not in (select match_ord from reconciled where match_ord is not null)
    """,
    "desired",
    "actual",
    **_FIRST_ACTUAL,
    reconciled=_RECONCILED,
)
_add(
    "reconcile_chain",
    """
    select request_id, 'vpc' as kind, network_name as name,
        case when existing is not null then 'reuse' when creator = request_id then 'create'
            else 'reuse_created' end as action,
        existing as act_id, creator as created_by
    from placed
    union all
    select request_id, c.kind, c.name,
        case when act_id is not null then 'reuse' when c.created_by = request_id then 'create'
            else 'reuse_created' end, act_id, c.created_by
    from placed p join children c on p.existing is not distinct from c.existing
      and p.creator is not distinct from c.creator
    """,
    "chain_requests",
    "chain_networks",
    "chain_resources",
    by_id="""
        select act_id, arg_min(act_name, ord) as act_name from chain_networks group by act_id
    """,
    by_name="""
        select act_name, arg_min(act_id, ord) as act_id from chain_networks
        where act_name <> '' group by act_name
    """,
    matched="""
        select r.*, coalesce(i.act_id, n.act_id) as existing,
            case when i.act_id is not null then i.act_name when n.act_id is not null then n.act_name
                else want_name end as found_name
        from chain_requests r left join by_id i on r.want_id = i.act_id
        left join by_name n on r.want_name = n.act_name
    """,
    placed="""
        select request_id, request_ord, existing, nullif(found_name, '') as network_name,
            case when existing is null and want_name <> '' then arg_min(request_id, request_ord)
                over (partition by existing is null, want_name)
            when existing is null then request_id end as creator
        from matched
    """,
    in_use="""
        select existing, creator, any_value(network_name) as network_name, min(request_ord) as first_ord,
            arg_min(request_id, request_ord) as first_id
        from placed group by existing, creator
    """,
    asked="""
        select u.*, kind, case when kind = 'security-group' then coalesce(network_name, existing)
            else network_name end || suffix as name
        from in_use u, (values ('internet-gateway', '-igw'), ('security-group', '-sg'),
            ('subnet', '-subnet'), ('route-table', '-rtb')) as k(kind, suffix)
    """,
    found="""
        select a.existing, a.creator, a.kind, any_value(name) as name, any_value(first_ord) as first_ord,
            any_value(first_id) as first_id, arg_min(r.act_id, r.ord) as act_id
        from asked a left join chain_resources r on a.kind = r.kind and case
            when a.kind = 'security-group' then r.act_name = a.name and r.act_name <> ''
            else r.network_id = a.existing and (a.name is null or r.act_name = a.name)
                and (a.kind <> 'route-table' or r.default_route) end
        group by a.existing, a.creator, a.kind
    """,
    children="""
        select existing, creator, kind, name, act_id,
            case when act_id is null and kind = 'security-group' and name is not null
                then arg_min(first_id, first_ord) over (partition by kind, name, act_id is null)
            when act_id is null then first_id end as created_by
        from found
    """,
)
_add(
    "expected_resources",
    """
    select desired_id, vpc_id as network, 'internet-gateway' as kind, vpc_name || '-igw' as name
    from networks where cloud = 'aws'
    union all select desired_id, vpc_id, 'security-group', coalesce(vpc_name, vpc_id) || '-sg'
    from networks where cloud = 'aws'
    union all select desired_id, vpc_id, 'subnet', vpc_name || '-subnet'
    from networks where cloud = 'aws'
    union all select desired_id, vpc_id, 'route-table', vpc_name || '-rtb'
    from networks where cloud = 'aws'
    union all select desired_id, gcp_name, 'network', gcp_name from networks where cloud = 'gcp'
    union all select desired_id, gcp_name, 'subnetwork',
        case when gcp_name = 'default' then 'default' else gcp_name || '-sub' end
    from networks where cloud = 'gcp'
    union all select desired_id, gcp_name, 'firewall', gcp_name || '-allow-all'
    from networks where cloud = 'gcp'
    """,
    "desired",
    networks="""
        select *, coalesce(vpc_name, 'default') as gcp_name from (
            select desired_id, concat('vpc-', desired_id) as vpc_id,
                case when desired_id % 9 = 0 then 'default' else nullif(want_name, '') end
                    as vpc_name,
                case when desired_id % 2 = 0 then 'aws' else 'gcp' end as cloud
            from desired
        )
    """,
)
_add(
    "latest_image",
    """
    select family, ord, name, created from images
    qualify row_number() over (partition by family order by created desc, ord) = 1
    """,
    "images",
)
_add(
    "latest_image_of_texts",
    """
    select family, ord, name, created, link from dated_images where created <> 'soon'
    qualify row_number() over (partition by family order by created desc, ord) = 1
    """,
    "dated_images",
)
_add(
    "latest_ready_image",
    """
    select family, ord, name from images where status = 'READY'
    qualify row_number() over (partition by family order by name desc, ord) = 1
    """,
    "images",
)

# Topology.

for _name in ("assign_roles", "assign_roles_split"):
    _add(
        _name,
        """
        select *, server_id > 1 as is_replica, server_id = 1 as bootstrap,
            'http://' || public_ip || ':3000/orchestrator' as manager_url
        from (
            select *, row_number() over (partition by cluster_id order by launch_ord) as server_id
            from members
        )
        """,
        "members",
    )
_add(
    "assign_new_roles",
    """
    select cluster_id, launch_ord, private_ip, public_ip, reachable, server_id, server_id > 1 as is_replica,
        server_id = 1 as bootstrap, 'http://' || public_ip || ':3000/orchestrator' as manager_url
    from (
        select m.*, coalesce(f.server_id, coalesce(f.high, h.high, 0) + row_number() over (
            partition by m.cluster_id, f.server_id is null order by m.launch_ord)) as server_id
        from members m left join first_load f using (cluster_id, launch_ord)
        left join (select distinct cluster_id, high from first_load) h using (cluster_id)
        where f.server_id is null or f.server_id < f.high)
    """,
    "members",
    first_load="""
        select cluster_id, launch_ord,
            row_number() over (partition by cluster_id order by launch_ord) as server_id,
            count(*) over (partition by cluster_id) as high
        from members where launch_ord % 3 <> 0
    """,
)
_add(
    "ready_since",
    """
    select cluster_id, arg_max(members, seen_at) as n_members, arg_max(silents, seen_at) as n_silent,
        arg_max(ready, seen_at) as ready, min(seen_at) filter (ready) as first_ready,
        min(seen_at) filter (seen_at > coalesce(last_unready, '0001-01-01'::timestamp)) as ready_since
    from judged group by cluster_id
    """,
    "probes",
    changes="""
        select cluster_id, seen_at, state, lag(state) over (partition by cluster_id, member order by seen_at) as before
        from probes
    """,
    deltas="""
        select cluster_id, seen_at,
            sum((state <> 'gone')::bigint - coalesce(before <> 'gone', false)::bigint) as members,
            sum((state = 'silent')::bigint - coalesce(before = 'silent', false)::bigint) as silents
        from changes group by cluster_id, seen_at
    """,
    swept="""
        select cluster_id, seen_at, (sum(members) over w)::bigint as members, (sum(silents) over w)::bigint as silents
        from deltas window w as (partition by cluster_id order by seen_at)
    """,
    judged="""
        select *, members > 0 and silents = 0 as ready,
            max(case when not (members > 0 and silents = 0) then seen_at end) over (partition by cluster_id) as last_unready
        from swept
    """,
)
_add(
    "peer_lists",
    """
    select cluster_id, part, cast(count(*) as integer) as n,
        string_agg(private_ip, ',' order by launch_ord) as nodes,
        string_agg(private_ip, ',' order by launch_ord) as allow_list,
        string_agg(private_ip || ':33061', ',' order by launch_ord) as seeds,
        case when part = 0 then 'gcomm://' else '' end
            || string_agg(private_ip || ':4567', ',' order by launch_ord) as cluster_address,
        string_agg('http://' || private_ip || ':3000/orchestrator', ' ' order by launch_ord)
            as manager_urls
    from (
        select *, (row_number() over (partition by cluster_id order by launch_ord) - 1) // 1000
            as part
        from members
    ) group by cluster_id, part
    """,
    "members",
)
_add(
    "cluster_readiness",
    """
    select c.cluster_id, count(m.cluster_id) as members,
        count(m.cluster_id) > 0 and coalesce(bool_and(m.public_ip <> '' and m.reachable), false)
            as ready
    from clusters c left join members m on m.cluster_id = c.cluster_id
    group by c.cluster_id
    """,
    "members",
    "clusters",
)

_PLACED = """
    select m.cluster_id, m.private_ip as ip, c.kind,
        row_number() over (partition by m.cluster_id order by launch_ord) as server_id,
        count(*) over (partition by m.cluster_id) as n
    from members m join clusters c on c.cluster_id = m.cluster_id
    where c.kind in ('async', 'group-replication', 'xtradb')
"""
# Members in one part of a list, as in the operator.
_PART = 1000
_PEER_PARTS = f"""
    select cluster_id, part, string_agg(private_ip, ',' order by launch_ord) as bare,
        string_agg(private_ip || ':33061', ',' order by launch_ord) as seeds,
        case when part = 0 then 'gcomm://' else '' end
            || string_agg(private_ip || ':4567', ',' order by launch_ord) as gcomm
    from (
        select *, (row_number() over (partition by cluster_id order by launch_ord) - 1) // {_PART}
            as part
        from members
    ) group by cluster_id, part
"""
_PEERS = """
    select cluster_id, string_agg(private_ip, ',' order by launch_ord) as bare,
        string_agg(private_ip || ':33061', ',' order by launch_ord) as seeds,
        'gcomm://' || string_agg(private_ip || ':4567', ',' order by launch_ord) as gcomm
    from members group by cluster_id
"""
_COMMON = (
    ("log_bin", "'/var/log/mysql/mysql-bin.log'"),
    ("relay-log", "'/var/log/mysql/mysql-relay-bin.log'"),
    ("gtid-mode", "'ON'"),
    ("enforce-gtid-consistency", "'ON'"),
    ("server_id", "cast(server_id as varchar)"),
)
_UUID = "md5(cast(p.cluster_id as varchar))"
_UUID = "||'-'||".join(
    f"substr({_UUID}, {start}, {length})"
    for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
)
_KIND_KEYS = {
    "async": (*_COMMON,),
    "group-replication": (
        *_COMMON,
        ("disabled_storage_engines", "'MyISAM,BLACKHOLE,FEDERATED,ARCHIVE,MEMORY'"),
        ("plugin_load_add", "'group_replication.so'"),
        ("group_replication_group_name", _UUID),
        ("group_replication_start_on_boot", "'off'"),
        ("group_replication_local_address", "ip || ':33061'"),
        ("group_replication_bootstrap_group", "'off'"),
    ),
    "xtradb": (
        ("port", "'3306'"),
        ("wsrep_node_name", "ip"),
        ("wsrep_node_address", "ip || ':4567'"),
        ("wsrep_provider_options", "'base_port=4567'"),
        ("pxc-encrypt-cluster-traffic", "'OFF'"),
    ),
}
_PEER_KEYS = {
    "group-replication": (
        ("group_replication_group_seeds", "seeds"),
        ("group_replication_ip_allowlist", "bare"),
    ),
    "xtradb": (("wsrep_cluster_address", "gcomm"),),
}


def _settings_sql(shared: bool) -> str:
    rows = [
        "select cluster_id, ip as instance, server_id, cast(0 as bigint) as part, "
        "'bind-address' as key, ip || ',localhost' as value from placed "
        "where kind = 'async' and n > 1 and server_id = 1"
    ]
    for kind, keys in _KIND_KEYS.items():
        for key, value in keys:
            rows.append(
                f"select p.cluster_id, ip, server_id, 0, '{key}', {value} from placed p "
                f"where kind = '{kind}'" + (" and n > 1" if kind == "async" else "")
            )
    for kind, keys in _PEER_KEYS.items():
        for key, value in keys:
            whose = "null, null, part" if shared else "ip, server_id, 0"
            first = f"and server_id = part * {_PART} + 1" if shared else ""
            rows.append(
                f"select p.cluster_id, {whose}, '{key}', {value} from placed p "
                f"join peers l on l.cluster_id = p.cluster_id where kind = '{kind}' {first}"
            )
    return " union all ".join(rows)


_add("instance_config", _settings_sql(False), small_members=DERIVED["small_members"],
     members="select * from small_members", clusters=DERIVED["small_clusters"],
     placed=_PLACED, peers=_PEERS)
_add("instance_config_shared", _settings_sql(True), "members", "clusters",
     placed=_PLACED, peers=_PEER_PARTS)
_add(
    "config_status",
    """
    select c.cluster_id, c.kind, count(m.cluster_id) as members,
        case when c.kind not in ('async', 'group-replication', 'xtradb') then 'unknown_kind'
            when count(m.cluster_id) = 0 then 'no_members'
            when c.kind = 'async' and count(m.cluster_id) = 1 then 'single_member'
            else 'configured' end as status
    from clusters c left join members m on m.cluster_id = c.cluster_id
    group by c.cluster_id, c.kind
    """,
    "members",
    "clusters",
)
_add(
    "manager_config",
    """
    select m.cluster_id, private_ip as instance,
        '{"Debug":true,"ListenAddress":":3000",'
        || '"MySQLTopologyCredentialsConfigFile":"/etc/mysql/orchestrator-topology.cnf",'
        || '"BackendDB":"sqlite","SQLite3DataFile":"/var/lib/orchestrator/orchestrator.db",'
        || '"RaftEnabled":true,"RaftBind":"' || private_ip
        || '","RaftDataDir":"/var/lib/orchestrator","DefaultRaftPort":10008,'
        || '"RaftNodes":[' || nodes || '],'
        || '"InstancePollSeconds":5,"InstanceFlushIntervalMilliseconds":100,'
        || '"HostnameResolveMethod":"none","MySQLHostnameResolveMethod":"@@hostname",'
        || '"URLPrefix":"/orchestrator"}' as json
    from small_members m join listed l on l.cluster_id = m.cluster_id
    """,
    "small_members",
    listed="""
        select cluster_id,
            string_agg('"' || private_ip || '"', ',' order by launch_ord) as nodes
        from small_members group by cluster_id
    """,
)
_add(
    "cluster_config_files",
    """
    select doc_id, any_value(address) as address, cast(0 as bigint) as part,
        '[mysqld]' || chr(10) || string_agg(key || ' = ' || value, chr(10) order by layer, ord, key)
        || chr(10) as text
    from (
        select doc_id, any_value(address) as address, key, arg_max(value, layer) as value, min(layer) as layer,
            arg_min(ord, layer) as ord
        from layered group by doc_id, key
    ) group by doc_id
    """,
    small_members=DERIVED["small_members"],
    members="select * from small_members",
    clusters=DERIVED["small_clusters"],
    placed=_PLACED,
    peers=_PEERS,
    settings=_settings_sql(False),
    given="""
        select * from (values (0, 0, 'user', 'mysql'), (0, 1, 'port', '3306'),
            (0, 2, 'userstat', 'OFF'),
            (1, 0, 'slow_query_log', 'ON'), (1, 1, 'log_output', 'FILE'),
            (1, 2, 'long_query_time', '0'), (1, 3, 'log_slow_admin_statements', 'ON'),
            (1, 4, 'log_slow_slave_statements', 'ON'), (1, 5, 'log_slow_rate_limit', '100'),
            (1, 6, 'log_slow_rate_type', 'query'), (1, 7, 'slow_query_log_always_write_time', '1'),
            (1, 8, 'log_slow_verbosity', 'full'),
            (1, 9, 'slow_query_log_use_global_control', 'all'),
            (1, 10, 'performance_schema', 'OFF'), (1, 11, 'userstat', 'ON'))
            as t(layer, ord, key, value)
    """,
    layered="""
        select cluster_id || '/' || launch_ord as doc_id, private_ip as address, layer, ord, key, value
        from members cross join given
        union all
        select m.cluster_id || '/' || launch_ord, private_ip, 2, 0, key, value
        from settings s join (
            select *, row_number() over (partition by cluster_id order by launch_ord) as server_id
            from members
        ) m on m.cluster_id = s.cluster_id and m.server_id = s.server_id
    """,
)

# Endpoints and fingerprints.


def _port(url: str) -> str:
    return (
        f"regexp_replace({url}, '^(https?)://([^/?#]*).*$', "
        f"case when {url} like 'https:%' then '\\1://\\2:443' else '\\1://\\2:80' end) "
        f"|| regexp_extract({url}, '^https?://[^/?#]*(.*)$', 1)"
    )


_add(
    "normalize_endpoints",
    f"select page_id, url, {_port('url')} as endpoint, false as has_userinfo, "
    "cast(null as varchar) as reason from pages",
)
_add(
    "normalize_endpoints_redacted",
    """
    select page_id,
        case when page_id % 5 = 2 then null
            when page_id % 5 = 3 then 'ftp://' || host || query
            when page_id % 5 = 1 then scheme || '://h:8080' || query
            else scheme || '://' || host || case when scheme = 'http' then ':80' else ':443' end
                || query end as endpoint,
        page_id % 5 = 0 as has_userinfo,
        case when page_id % 5 = 2 then 'no_scheme' end as reason
    from (
        select page_id, split_part(url, ':', 1) as scheme,
            regexp_extract(url, '^https?://([^/?#]*)', 1) as host,
            regexp_extract(url, '([?#].*)$', 1) as query
        from pages
    )
    """,
)


def _signed_hash(bytes_list: str, first_multiply: bool) -> str:
    """64-bit FNV over a list of byte numbers, reduced in 128 bits, as a signed number."""
    start = "list_prepend(cast(14695981039346656037 as hugeint), {})".format(bytes_list)
    xored = "xor({}, b)"
    times = "(({}) * 1099511628211) % 18446744073709551616"
    step = xored.format(times.format("h")) if first_multiply else times.format(xored.format("h"))
    total = f"list_reduce({start}, lambda h, b: {step})"
    return (
        f"cast(case when {total} >= 9223372036854775808 "
        f"then {total} - 18446744073709551616 else {total} end as bigint)"
    )


def _ascii_bytes(text: str) -> str:
    return (
        f"list_transform(string_split({text}, ''), lambda c: cast(ascii(c) as hugeint))"
    )


_add(
    "fingerprint_rows",
    f"""
    select c_custkey, {_signed_hash("name_bytes", False)} as fnv1a_64,
        {_signed_hash("name_bytes", True)} as fnv_64,
        {_signed_hash("row_bytes", False)} as row_hash
    from (
        select c_custkey, {_ascii_bytes("c_name")} as name_bytes,
            {_ascii_bytes("c_custkey || '|' || c_mktsegment")} as row_bytes
        from customer
    )
    """,
)
_add(
    "fingerprint_texts",
    f"""
    select doc_id, {_signed_hash("text_bytes", False)} as fnv1a_64
    from (
        select doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'),
            lambda h: cast('0x' || h as hugeint)) as text_bytes
        from documents
    )
    """,
)


# Murmur3, 32 bits, as Spark chains it: the number, then the text with its hash as seed.


def _u32(number: str) -> str:
    return f"(({number}) % 4294967296)"


def _rotated(number: str, bits: int) -> str:
    return f"(({_u32(f'({number}) * {1 << bits}')}) + (({number}) // {1 << (32 - bits)}))"


def _mixed(state: str, block: str) -> str:
    """One four-byte block into the state."""
    key = _u32(f"{_rotated(_u32(f'({block}) * 3432918353'), 15)} * 461845907")
    return _u32(f"{_rotated(f'xor({state}, {key})', 13)} * 5 + 3864292196")


def _finished(state: str, size: str) -> str:
    return (
        f"list_reduce([xor({state}, {size})::hugeint, 16, 2246822507, 13, 3266489909, 16, 1], "
        # By turns a shift to fold in and a factor; the last factor is one.
        f"lambda h, x: case when x < 32 and x > 1 then xor(h, h // (1::hugeint << x::integer)) "
        f"else (h * x) % 4294967296 end)"
    )


_SIGNED = "cast(case when h >= 2147483648 then h - 4294967296 else h end as integer)"
_add(
    "murmur_rows",
    f"""
    select o_orderkey, {_SIGNED} as murmur
    from (
        select o_orderkey, {_finished("mixed", "size")} as h
        from (
            select o_orderkey, size,
                list_reduce(list_prepend(seed, blocks), lambda s, b: {_mixed("s", "b")}) as mixed
            from (
                select o_orderkey, len(o_orderpriority)::hugeint as size,
                    {_finished("number", "8::hugeint")} as seed,
                    list_concat(
                        list_transform(range(len(o_orderpriority) // 4), lambda i:
                            (ascii(o_orderpriority[4 * i + 1]) + 256 * ascii(o_orderpriority[4 * i + 2])
                            + 65536 * ascii(o_orderpriority[4 * i + 3])
                            + 16777216 * ascii(o_orderpriority[4 * i + 4])::hugeint)::hugeint),
                        list_transform(range(len(o_orderpriority) // 4 * 4, len(o_orderpriority)),
                            lambda i: ascii(o_orderpriority[i + 1])::hugeint)) as blocks
                from (
                    select o_orderkey, o_orderpriority,
                        {_mixed(_mixed("42::hugeint", "(o_orderkey % 4294967296)::hugeint"),
                                "(o_orderkey // 4294967296)::hugeint")} as number
                    from orders
                )
            )
        )
    )
    """,
)
