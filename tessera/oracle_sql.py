"""DuckDB oracle SQL for each registered query.

Each text runs on the given tables (registered as views) and recomputes
the query independently with plain SQL: the derived listings are written
out in a ``WITH`` clause, the rules as a ``VALUES`` list.
"""

from __future__ import annotations

WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

RUNS = """
select concat('/data/run_', lpad(cast(l_orderkey % 16 as string), 2, '0')) as folder_path,
       concat('sample', l_orderkey, '_S', l_orderkey % 96, '_L', lpad(cast(l_linenumber as string), 3, '0'),
              '_R', rd, '_001.fastq.gz') as name,
       cast(floor(q) as bigint) * 100 + rd as size
from (select l_orderkey, l_linenumber, min(l_quantity) as q from lineitem group by l_orderkey, l_linenumber) li
cross join (values (1), (2)) v(rd)
where not (rd = 2 and (l_orderkey + l_linenumber) % 7 = 0)
"""

MESSY = """
select concat('/messy/f', k % 4) as folder_path,
       case m when 0 then concat('sample', k, '_S', k % 9, '_L001_R1_001.fastq.gz')
              when 1 then concat('sample', k, '_S', k % 9, '_L001_R2_001.fastq.gz')
              when 2 then concat('sample', k, 'x_S', k % 9, '_L001_R1.fastq.gz')
              when 3 then concat('sample', k, 'y_S', k % 9, '_L001_R2_001.fastq')
              when 4 then concat('sample', k, 'z_S', k % 9, '_L001_001.fastq.gz')
              when 5 then concat('__sample', k, '..S', k % 9, '_ L001 R1__001.fastq.gz')
              when 6 then concat('notes_', k, '.csv.gz')
              else concat('sample', k, '.S', k % 9, '.L001.R1.001.fastq.gz') end as name,
       k % 1000 as size
from (select cast(floor(o_orderkey / 7) as bigint) as k, o_orderkey % 7 as m from orders
      union all
      select cast(floor(o_orderkey / 7) as bigint) as k, 7 as m from orders where o_orderkey % 35 = 0) o
"""

DOCS_OLD = """
select case when doc_id % 89 = 0 then concat('/corpus/old/', lang) else concat('/corpus/', source, '/', lang) end as folder_path,
       concat('doc_', doc_id, '.txt') as name, n_chars as size, TIMESTAMP '2020-01-01' + to_minutes(doc_id % 500000) as created_time
from documents where doc_id % 10 <> 3
"""

DOCS_ALL = """
select case when doc_id % 89 = 0 then concat('/corpus/old/', lang) when doc_id % 97 = 0 then concat('/corpus/new/', lang)
            else concat('/corpus/', source, '/', lang) end as folder_path,
       concat('doc_', doc_id, '.txt') as name, n_chars as size, TIMESTAMP '2020-01-01' + to_minutes(doc_id % 500000) as created_time
from documents
"""

DOCS_NEW = """
select case when doc_id % 97 = 0 then concat('/corpus/new/', lang) else concat('/corpus/', source, '/', lang) end as folder_path,
       concat('doc_', doc_id, '.txt') as name, n_chars + case when doc_id % 5 = 0 then 1 else 0 end as size,
       TIMESTAMP '2020-01-01' + to_minutes(doc_id % 500000) as created_time
from documents where doc_id % 10 <> 7
"""

EVENTS = """
select concat('/events/g', user_id % 8) as folder_path,
       concat('u', user_id, '_d', day(ts), '_', event_type, '.log') as name, count(*) as size
from events group by user_id, day(ts), event_type
"""

RULES = """
select * from (values
  ('/data', '1.0.1', ['_', '.'], ['R1', 'R2'], [0, 1, 2, 4, 5, 6], [3], 100, 1048576),
  ('/messy', '1.0.1', ['_', '.'], ['R1', 'R2'], [0, 1, 2, 4, 5, 6], [3], 100, 1048576),
  ('/events', '1.0.0', ['_', '.'], ['click', 'error', 'purchase', 'signup', 'view'], [0, 1], [2], 0, 0),
  ('/corpus', '1.0.0', ['_', '.'], ['txt'], [1], [2], 0, 0),
  ('/corpus/old', '0.9.0', ['_', '.'], ['txt'], [0, 1], [1], 0, 0),
  ('/corpus/new', '0.9.1', ['_', '.'], ['txt'], [0, 0], [1], 0, 0)
) r(folder_prefix, version, delimiter, header, row_parts, col_parts, min_size, max_size)
"""

# messy listing after the default file exclusions (*.json, invalid_files, *.csv, *.pb)
MESSY_KEPT = """
select * from messy
where not (contains(name, '.json') or name = 'invalid_files' or contains(name, '.csv') or contains(name, '.pb'))
"""

CATALOG = "select * from runs union all select * from messy_kept union all select * from events_l"

# nearest-ancestor rule per folder, with the rule check (no part index used
# twice, none negative, no empty delimiter)
FOLDER_RULES = """
select folder_path, folder_prefix, version, delimiter, header, row_parts, col_parts, min_size, max_size,
       len(list_distinct(list_concat(row_parts, col_parts))) = len(list_concat(row_parts, col_parts))
       and len(list_filter(list_concat(row_parts, col_parts), lambda i: i < 0)) = 0
       and len(list_filter(delimiter, lambda d: d = '')) = 0 as ok
from (
  select c.folder_path, r.*, row_number() over (partition by c.folder_path order by c.depth desc) as rk
  from (select folder_path, unnest(pfx) as folder_prefix, generate_subscripts(pfx, 1) as depth
        from (select folder_path,
                     list_filter(list_transform(range(1, len(string_split(folder_path, '/')) + 1),
                                 lambda k: array_to_string(string_split(folder_path, '/')[1:k], '/')),
                                 lambda p: p <> '') as pfx
              from (select distinct folder_path from {src}))) c
  join rules r on r.folder_prefix = c.folder_prefix) where rk = 1
"""

KEYED = """
select folder_path, name, size,
       array_to_string(list_filter(list_transform(row_parts, lambda i: case when i >= 0 then parts[i + 1] end),
                                   lambda x: x is not null), '_') as row_key,
       array_to_string(list_filter(list_transform(col_parts, lambda i: case when i >= 0 then parts[i + 1] end),
                                   lambda x: x is not null), '_') as col_key,
       len(coalesce(header, [])) as expected, parts, folder_prefix, version, header, min_size, max_size
from (select l.folder_path, l.name, l.size, fr.folder_prefix, fr.version, fr.header, fr.row_parts, fr.col_parts,
             fr.min_size, fr.max_size,
             list_filter(regexp_split_to_array(list_reduce(fr.delimiter, lambda acc, d: replace(acc, d, ' '), l.name),
                                               '""" + WS + """+'), lambda x: x <> '') as parts
      from {src} l join fr_{src} fr on l.folder_path = fr.folder_path {okfilter})
"""

CSV_FIELD = ("case when {v} = '' then '' when regexp_matches({v}, '[,\"\\r\\n]') or regexp_matches({v}, '^" + WS
             + "') or {v} = '\\.' then concat('\"', replace({v}, '\"', '\"\"'), '\"') else {v} end")


def csv_field(v: str) -> str:
    return CSV_FIELD.replace("{v}", v)


def snapshot_ctes(name: str, listing: str) -> list[str]:
    """Folders and files of a listing's first snapshot, and its folders with
    the totals as an earlier run stored them (some off by one)."""
    return [
        f"""{name}_folders as (select row_number() over (order by folder_path) as id, folder_path as path,
             total_size, file_count, created_time from (select folder_path, cast(sum(size) as bigint) as total_size,
             count(*) as file_count, min(created_time) as created_time from {listing} group by folder_path))""",
        f"""{name}_files as (select row_number() over (order by d.folder_path, d.name) as id, f.id as folder_id,
             d.folder_path, d.name, d.size, d.created_time from {listing} d join {name}_folders f on f.path = d.folder_path)""",
        f"""{name}_stored as (select id, path,
             cast(total_size + case when length(path) % 3 = 0 then 1 else 0 end as bigint) as total_size,
             file_count, created_time from {name}_folders)""",
    ]


SNAP_ALL = snapshot_ctes("all", "docs_all")

SNAPSHOT = [
    *snapshot_ctes("snap", "docs_old"),
    "stored_folders as (select * from snap_stored)",
    """new_stats as (select folder_path, cast(sum(size) as bigint) as total_size, count(*) as file_count,
         min(created_time) as created_time from docs_new group by folder_path)""",
    """fdiff as (select coalesce(s.id, 0) as folder_id, n.folder_path as path,
         n.total_size as disk_total_size, coalesce(s.total_size, 0) as db_total_size,
         n.file_count as disk_file_count, coalesce(s.file_count, 0) as db_file_count
         from new_stats n left join stored_folders s on s.path = n.folder_path
         where s.id is null or n.total_size <> s.total_size or n.file_count <> s.file_count)""",
    """fchanges as (select case when o.name is null then 'added' when n.name is null then 'removed'
              else 'modified' end as change_type,
         coalesce(o.id, 0) as file_id, coalesce(o.folder_id, 0) as folder_id,
         coalesce(n.folder_path, o.folder_path) as folder_path, coalesce(n.name, o.name) as name,
         coalesce(n.size, 0) as disk_size, coalesce(o.size, 0) as db_size
         from docs_new n full outer join
              (select * from snap_files where folder_path in (select folder_path from docs_new)) o
           on n.folder_path = o.folder_path and n.name = o.name
         where o.name is null or n.name is null or n.size <> o.size)""",
    """upserted as (select s.id, s.path, coalesce(d.disk_total_size, s.total_size) as total_size,
              coalesce(d.disk_file_count, s.file_count) as file_count, s.created_time
         from stored_folders s left join (select * from fdiff where folder_id <> 0) d on d.folder_id = s.id
         union all
         select (select max(id) from stored_folders) + row_number() over (order by path) as id, path,
                disk_total_size as total_size, disk_file_count as file_count,
                (select n.created_time from new_stats n where n.folder_path = fdiff.path) as created_time
         from fdiff where folder_id = 0 and path not in (select path from stored_folders))""",
    """applied_files as (select f.id, f.folder_id, f.folder_path, f.name,
              case when c.change_type = 'modified' then c.disk_size else f.size end as size,
              f.created_time
         from snap_files f left join (select * from fchanges where change_type <> 'added') c
           on c.folder_path = f.folder_path and c.name = f.name
         where c.change_type is null or c.change_type <> 'removed'
         union all
         select (select max(id) from snap_files) + row_number() over (order by a.folder_path, a.name) as id,
                u.id as folder_id, a.folder_path, a.name, a.disk_size as size, n.created_time
         from (select * from fchanges where change_type = 'added') a left join upserted u on u.path = a.folder_path
         join docs_new n on n.folder_path = a.folder_path and n.name = a.name)""",
]


def base_ctes(*extra: str) -> str:
    ctes = [
        f"runs as ({RUNS})",
        f"messy as ({MESSY})",
        f"messy_kept as ({MESSY_KEPT})",
        f"events_l as ({EVENTS})",
        f"docs_old as ({DOCS_OLD})",
        f"docs_new as ({DOCS_NEW})",
        f"docs_all as ({DOCS_ALL})",
        f"rules as ({RULES})",
        f"catalog as ({CATALOG})",
        "all_l as (select * from catalog union all select folder_path, name, size from docs_all)",
        "blk as (select * from all_l)",
    ]
    return "with " + ",\n".join(ctes + list(extra)) + "\n"


def keyed_ctes(src: str, only_valid: bool = False) -> list[str]:
    okf = "where fr.ok" if only_valid else ""
    return [f"fr_{src} as ({FOLDER_RULES.replace('{src}', src)})",
            f"keyed_{src} as ({KEYED.replace('{src}', src).replace('{okfilter}', okf)})"]


def grouping_ctes(src: str = "catalog", only_valid: bool = False) -> list[str]:
    k = f"keyed_{src}"
    return keyed_ctes(src, only_valid) + [
        f"""cells_{src} as (select folder_path, row_key, col_key, expected, max(name) as name,
                 min(name) as first_ord, count(*) as n_names from {k}
                 group by folder_path, row_key, col_key, expected)""",
        f"""rows_{src} as (select folder_path, row_key, expected, count(*) as n_cols,
                 min(first_ord) as first_seen from cells_{src} group by folder_path, row_key, expected)""",
        f"""valid_{src} as (select *, cast(row_number() over (partition by folder_path order by first_seen) - 1 as bigint)
                 as row_number from rows_{src} where n_cols = expected)""",
        f"""vcells_{src} as (select c.*, v.row_number from cells_{src} c join valid_{src} v
                 using (folder_path, row_key, expected))""",
    ]


def heads_cte(src: str) -> str:
    """Block heads of a source built with valid rules only."""
    return f"""heads_{src} as (select fr.folder_path as block_id, fr.header as column_headers,
         coalesce(n.n_rows, 0) as n_rows, fr.version as rule_version,
         concat(regexp_extract(fr.folder_path, '([^/]+)/*$', 1), 'files.pb') as block_file
         from fr_{src} fr left join (select folder_path, count(*) as n_rows from valid_{src} group by folder_path) n
           on n.folder_path = fr.folder_path
         where fr.ok)"""


def q(body: str, *extra: str) -> str:
    return base_ctes(*extra) + body


BASE_NAME = "regexp_extract(folder_path, '([^/]+)/*$', 1)"
JOIN_PATH = "concat(regexp_replace(folder_path, '/+$', ''), '/', name)"
PUBLISHED_AT = "TIMESTAMP '2024-01-15 12:00:00'"

ORACLE: dict[str, str] = {}

# ------------------------------------------------------------------ scans
ORACLE["folder_scan"] = q(f"""
select folder_path, folder_name from (select distinct folder_path, {BASE_NAME} as folder_name from all_l)
where folder_name not in ('f3', 'g7', 'run_15')
""")
ORACLE["file_scan"] = q(f"select folder_path, name, size, {JOIN_PATH} as path from messy_kept")
ORACLE["name_scan"] = q("""
select folder_path, name from messy
where not (name = 'rule.json' or name = 'invalid_files' or name = 'fileblock.csv' or contains(name, '.pb'))
""")
ORACLE["glob_search"] = q(f"""
select folder_path, name, {JOIN_PATH} as path from messy
where regexp_full_match(name, '[^/]*_R1_[^/]*\\.fastq\\.gz')
""")
ORACLE["folders_missing_file"] = q("""
select d.folder_path, coalesce(p.has, false) as has_file
from (select distinct folder_path from docs_all) d
left join (select distinct folder_path, true as has from docs_all where name = 'doc_10.txt') p
  on p.folder_path = d.folder_path
""")
ORACLE["rules_by_folder"] = q("""
select d.folder_path, fr.folder_prefix, fr.version, cast(len(coalesce(fr.header, [])) as integer) as n_header
from (select distinct folder_path from all_l) d left join fr_all_l fr on fr.folder_path = d.folder_path
""", *keyed_ctes("all_l")[:1])
ORACLE["snapshot_folders"] = q("select * from all_folders", *SNAP_ALL)
ORACLE["snapshot_files"] = q("select * from all_files", *SNAP_ALL)
ORACLE["runs_snapshot"] = q("""
select row_number() over (order by r.folder_path, r.name) as id, f.id as folder_id, r.folder_path, r.name, r.size
from runs r join (select row_number() over (order by folder_path) as id, folder_path
                  from (select distinct folder_path from runs)) f on f.folder_path = r.folder_path
""")
ORACLE["files_for_folder"] = q("""
select f.id, f.folder_id, f.name, f.size, f.created_time from all_files f
where f.folder_id = (select id from all_folders order by file_count desc, path limit 1)
""", *SNAP_ALL)
ORACLE["folder_id_lookup"] = q("""
select c.change_type, c.folder_path, c.name, u.id as folder_id,
       case when u.id is null then 'no stored folder' end as reject
from fchanges c left join stored_folders u on u.path = c.folder_path
""", *SNAPSHOT)
ORACLE["datablock_read"] = q("""
select folder_path as block_id, row_number, col_key, name from vcells_catalog
""", *grouping_ctes("catalog", True))
ORACLE["fileblock_read"] = q("""
select folder_path as block_id, row_number, col_key, name from vcells_runs where folder_path = '/data/run_03'
""", *grouping_ctes("runs", True))
ORACLE["listed_names"] = q("""
select folder_path, cast(generate_subscripts(arr, 1) - 1 as integer) as ord, unnest(arr) as name
from (select concat('/docs/', doc_id) as folder_path, string_split(text, chr(10)) as arr from documents)
""")

# ------------------------------------------------------------- predicates
ORACLE["exclude_files"] = q("""
select folder_path, name,
       (contains(name, '.json') or name = 'invalid_files' or contains(name, '.csv') or contains(name, '.pb')) as excluded
from messy
""")
ORACLE["exclude_folders"] = q(f"""
select folder_path, {BASE_NAME} as folder_name, {BASE_NAME} in ('f3', 'g7', 'run_15') as excluded
from (select distinct folder_path from all_l)
""")
ORACLE["size_rule_filter"] = q("""
select folder_path, name, size from keyed_messy_kept
where size >= min_size and (max_size <= 0 or size <= max_size)
""", *keyed_ctes("messy_kept"))

# ------------------------------------------------------- scalar functions
ORACLE["split_names"] = q("""
select folder_path, name, cast(len(parts) as integer) as n_parts, array_to_string(parts, '|') as parts
from keyed_messy_kept
""", *keyed_ctes("messy_kept"))
ORACLE["row_col_keys"] = q("select folder_path, name, row_key, col_key from keyed_catalog",
                           *keyed_ctes("catalog"))
ORACLE["block_names"] = q(f"""
select folder_path, concat({BASE_NAME}, 'files.pb') as block_file from (select distinct folder_path from all_l)
""")
ORACLE["generate_rows"] = q("""
select row_number, 'type' as header, event_type as cell from
  (select row_number() over (order by event_id) as row_number, event_type from events)
union all
select row_number, 'user' as header, cell from
  (select row_number() over (order by event_id) as row_number, cast(user_id as varchar) as cell
   from events)
""")

# ------------------------------------------------------------------ joins
ORACLE["folder_diff"] = q("select * from fdiff", *SNAPSHOT)
ORACLE["file_changes"] = q("select * from fchanges", *SNAPSHOT)
ORACLE["cascade_delete"] = q("""
select id, folder_id, name, size from snap_files
where folder_id in (select id from stored_folders where path in (select folder_path from docs_new))
""", *SNAPSHOT)
ORACLE["rule_join"] = q("""
select folder_path, name, folder_prefix, version, cast(len(header) as integer) as n_header from keyed_catalog
""", *keyed_ctes("catalog"))

# ----------------------------------------------------------- aggregations
ORACLE["folder_stats"] = q("""
select folder_path, cast(sum(size) as bigint) as total_size, count(*) as file_count from all_l group by folder_path
""")
FILE_TOTALS = """(select folder_id, cast(sum(size) as bigint) as current_size, count(*) as current_count
                  from all_files group by folder_id)"""
ORACLE["folder_stats_refresh"] = q(f"""
select s.id, s.path, coalesce(t.current_size, 0) as total_size, coalesce(t.current_count, 0) as file_count, s.created_time
from all_stored s left join {FILE_TOTALS} t on t.folder_id = s.id
""", *SNAP_ALL)
ORACLE["folder_totals_incremental"] = q("""
select folder_path as path, total_size, file_count from new_stats
union all
select path, total_size, file_count from snap_folders where path not in (select folder_path from docs_new)
""", *SNAPSHOT)
ORACLE["stat_drift"] = q(f"""
select * from (
  select s.path, s.total_size, s.file_count, coalesce(t.current_size, 0) as current_size,
         coalesce(t.current_count, 0) as current_count
  from all_stored s left join {FILE_TOTALS} t on t.folder_id = s.id)
where total_size <> current_size or file_count <> current_count
""", *SNAP_ALL)
ORACLE["group_files_long"] = q("select folder_path, row_key, col_key, name, n_names from cells_catalog",
                               *grouping_ctes("catalog"))
ORACLE["group_files"] = q("""
select folder_path, cast(row_number() over (partition by folder_path order by first_seen) - 1 as bigint) as row_index,
       row_key, n_cols, first_seen as first_name
from rows_catalog
""", *grouping_ctes("catalog"))
ORACLE["column_keys"] = q("""
select folder_path, col_key, cast(row_number() over (partition by folder_path order by col_key) - 1 as bigint) as key_pos
from (select distinct folder_path, col_key from vcells_catalog)
""", *grouping_ctes("catalog"))
ORACLE["rule_conflicts"] = q("""
select folder_path, folder_prefix, ok as valid,
       array_to_string(list_transform(list_sort(list_distinct(list_filter(idx,
           lambda i: len(list_filter(idx, lambda j: j = i)) > 1))), lambda x: cast(x as varchar)), ',') as conflict_parts
from (select *, list_concat(row_parts, col_parts) as idx from fr_all_l)
""", *keyed_ctes("all_l")[:1])
ORACLE["change_summary"] = q("""
select k.kind, coalesce(c.n, 0) as n
from (values ('folder_new'), ('folder_changed'), ('folder_removed'), ('added'), ('modified'), ('removed')) k(kind)
left join (select kind, count(*) as n from (
             select case when folder_id = 0 then 'folder_new' else 'folder_changed' end as kind from fdiff
             union all select change_type as kind from fchanges) group by kind) c on c.kind = k.kind
""", *SNAPSHOT)

# ---------------------------------------------------- window-shaped logic
ORACLE["valid_groups"] = q("""
select folder_path, row_number, row_key, min(first_ord) as first_name, count(*) as n_cols,
       string_agg(col_key, ',' order by col_key, name) as col_keys,
       string_agg(name, ',' order by col_key, name) as names
from vcells_catalog group by folder_path, row_number, row_key
""", *grouping_ctes("catalog"))
ORACLE["cell_collisions"] = q("""
select k.folder_path, k.row_key, k.col_key, k.name, c.name as winner
from keyed_catalog k join cells_catalog c
  on k.folder_path = c.folder_path and k.row_key = c.row_key and k.col_key = c.col_key and k.expected = c.expected
where c.n_names > 1 and k.name <> c.name
""", *grouping_ctes("catalog"))

# ----------------------------------------------------------------- set ops
ORACLE["invalid_files"] = q("""
select c.folder_path, c.name from cells_catalog c
where not exists (select 1 from valid_catalog v where v.folder_path = c.folder_path and v.row_key = c.row_key
                  and v.expected = c.expected)
""", *grouping_ctes("catalog"))
ORACLE["insert_if_absent"] = q("""
select folder_path, name, size from docs_old
union all
select n.folder_path, n.name, n.size from docs_new n where not exists (select 1 from docs_old o where o.folder_path = n.folder_path
                                                                          and o.name = n.name)
""")

# ------------------------------------------------------------------ blocks
BLK = grouping_ctes("blk", True) + [heads_cte("blk")]
ORACLE["fileblock_rows"] = q("select folder_path as block_id, row_number, col_key, name from vcells_blk", *BLK)
ORACLE["fileblock"] = q("""
select block_id, array_to_string(column_headers, ',') as column_headers, n_rows, rule_version, block_file
from heads_blk
""", *BLK)
ORACLE["block_rejects"] = q("""
select d.folder_path, case when fr.folder_prefix is null then 'missing rule' else 'invalid rule' end as reason
from (select distinct folder_path from blk) d left join fr_blk fr on fr.folder_path = d.folder_path
where fr.folder_prefix is null or not fr.ok
""", *BLK)
ORACLE["block_header_override"] = q("select block_id, 'left,right' as column_headers, n_rows from heads_blk", *BLK)
ORACLE["datablock"] = q(f"select block_id, n_rows, rule_version, {PUBLISHED_AT} as updated_at from heads_blk", *BLK)
ORACLE["incremental_blocks"] = q("""
select folder_path as block_id, row_number, col_key, name from vcells_docs_new
""", *grouping_ctes("docs_new", True))

# ------------------------------------------------------------ snapshot DML
ORACLE["initial_snapshot"] = q("select * from all_files", *SNAP_ALL)
ORACLE["apply_folder_diffs"] = q("select * from upserted", *SNAPSHOT)
ORACLE["apply_file_changes"] = q("select * from applied_files", *SNAPSHOT)
ORACLE["snapshot_apply"] = q("select * from applied_files", *SNAPSHOT)
ORACLE["clear_snapshot"] = q("""
select 'folders' as table_name, count(*) as rows_before, cast(0 as bigint) as rows_after from all_folders
union all
select 'files', count(*), 0 from all_files
union all
select 'block_heads', count(*), 0 from heads_docs_all
union all
select 'block_rows', count(*), 0 from valid_docs_all
""", *SNAP_ALL, *grouping_ctes("docs_all", True), heads_cte("docs_all"))

# ------------------------------------------------------------------- sinks
CAT_BLOCKS = grouping_ctes("catalog", True) + [heads_cte("catalog")]
def csv_sql(listing: str) -> str:
    return f"""
select block_id as folder_path, cast(0 as bigint) as line_no,
       array_to_string(list_concat(['Row'], list_transform(column_headers, lambda h: {csv_field('h')})), ',') as line
from heads_{listing}
union all
select r.folder_path, cast(r.row_number + 1 as bigint) as line_no,
       concat('Row', r.row_number, ',',
              string_agg({csv_field("coalesce(c.name, '')")}, ',' order by k.key_pos)) as line
from valid_{listing} r
join (select folder_path, col_key, row_number() over (partition by folder_path order by col_key) as key_pos
      from (select distinct folder_path, col_key from vcells_{listing})) k on k.folder_path = r.folder_path
left join vcells_{listing} c on c.folder_path = r.folder_path and c.row_key = r.row_key and c.col_key = k.col_key
group by r.folder_path, r.row_number
"""


ORACLE["csv_layout"] = q(csv_sql("catalog"), *CAT_BLOCKS)
# of a user's and day's logs, those with two types make a row
ORACLE["header_mismatch"] = """
with e as (select distinct user_id, day(ts) as d, event_type from events),
r as (select user_id, d from e group by user_id, d having count(*) = 2)
select concat('/events/g', user_id % 8) as folder_path, cast(2 as bigint) as n_header, count(distinct event_type) as n_keys
from e join r using (user_id, d) group by 1 having count(distinct event_type) <> 2
"""
ORACLE["folder_files"] = q(f"""
select 'csv' as kind, folder_path, line from ({csv_sql('edited')})
union all
select 'invalid', c.folder_path, c.name from cells_edited c
where not exists (select 1 from valid_edited v where v.folder_path = c.folder_path and v.row_key = c.row_key and v.expected = c.expected)
""", "edited as (select * from messy_kept where folder_path <> '/messy/f1' or not contains(name, 'notes'))",
    *grouping_ctes("edited", True), heads_cte("edited"))
ORACLE["scan_with_times"] = q("""
select folder_path, name, size, strftime(created_time, '%Y-%m-%d %H:%M:%S') as created_time from docs_all where name <> 'doc_10.txt'
union all
select folder_path, null, 0, strftime(max(created_time), '%Y-%m-%d %H:%M:%S') from docs_all group by folder_path
""")

# ----------------------------------------------------- versioning and jobs
ORACLE["version_gate"] = """
with clients as (select user_id, max(ts) as stamp from events group by user_id
                 union all select max(user_id) + 1, null from events),
server as (select stamp as published from clients order by user_id limit 1)
select user_id as client_id, stamp as client_updated_at,
       case when stamp is null or stamp < published then 'send' when stamp = published then 'no_update' else 'error' end as status,
       coalesce(stamp = published, false) as no_update
from clients, server
"""
ORACLE["diff_all"] = q("""
select 'folder' as kind, case when folder_id = 0 then 'new' else 'changed' end as change_type,
       path as folder_path, cast(null as varchar) as name, disk_total_size as disk_size, db_total_size as db_size
from fdiff
union all
select 'file' as kind, change_type, folder_path, name, disk_size, db_size from fchanges
""", *SNAPSHOT)

# dump lines as JSON (same text in both engines: no spaces, struct fields and
# map entries in order)
DUMP = """
select block_id, cast(0 as bigint) as line_no, cast(to_json({{'block_id': block_id, 'column_headers': column_headers}}) as varchar) as json
from heads_runs where {which}
union all
select block_id, row_number + 1, cast(to_json({{'row_number': row_number, 'cell_columns': cells}}) as varchar)
from (select folder_path as block_id, row_number, map_from_entries(list({{'k': col_key, 'v': name}} order by col_key, name)) as cells
      from vcells_runs group by folder_path, row_number)
where {which}
"""
RUN_BLOCKS = grouping_ctes("runs", True) + [heads_cte("runs")]
ORACLE["datablock_dump"] = q(DUMP.format(which="true"), *RUN_BLOCKS)
ORACLE["dump_files"] = q("select json from (" + DUMP.format(which="true") + ")", *RUN_BLOCKS)
ORACLE["fileblock_dump"] = q(DUMP.format(which="block_id = '/data/run_03'"), *RUN_BLOCKS)

# the new corpus's blocks replace the old one's
ORACLE["merged_blocks"] = q(f"""
select block_id, row_number, col_key, name, {PUBLISHED_AT} as updated_at from (
  select folder_path as block_id, row_number, col_key, name from vcells_catalog
  union all select folder_path, row_number, col_key, name from vcells_docs_new
  union all select folder_path, row_number, col_key, name from vcells_docs_old
  where folder_path not in (select folder_path from fr_docs_new where ok))
""", *grouping_ctes("catalog", True), *grouping_ctes("docs_new", True), *grouping_ctes("docs_old", True))

ORACLE["folder_names"] = q("""
select folder_path, row_number() over (partition by folder_path order by name) - 1 as ord, name from docs_new
""")


def read_back(folders: str, files: str, cells: str) -> str:
    """What a synced store holds: folder totals, files and block cells."""
    return f"""
select 'folder' as kind, path as folder_path, cast(null as varchar) as name, total_size, file_count from {folders}
union all select 'file', folder_path, name, size, null from {files}
union all select 'block', folder_path, name, row_number, null from {cells}
"""


ORACLE["sync_emptied_folder"] = q(read_back("""(
  select a.path, cast(coalesce(sum(l.size), 0) as bigint) as total_size, count(l.name) as file_count
  from all_folders a left join left_l l on l.folder_path = a.path group by a.path)""", "left_l", "vcells_left_l"),
    *SNAP_ALL, "left_l as (select * from docs_all where folder_path not like '%/en')", *grouping_ctes("left_l", True))

# vanished folders stay as they were, or go with files and blocks
STAYED = read_back("all_folders", "all_files", "vcells_docs_all")
LEFT = read_back("(select * from all_folders where path not like '%/en')", "(select * from all_files where folder_path not like '%/en')",
                 "(select * from vcells_docs_all where folder_path not like '%/en')")
ORACLE["sync_vanished_folder"] = q(f"""
select 'default' as run, x.* from ({STAYED}) x
union all select 'detect_removed', x.* from ({LEFT}) x
union all select 'default', 'status', null, 'false', 0, 0
union all select 'detect_removed', 'status', null, 'true', (select count(*) from all_folders where path like '%/en'),
                 (select count(*) from all_files where folder_path like '%/en')
""", *SNAP_ALL, *grouping_ctes("docs_all", True))

ORACLE["sync_rule_edit"] = q(read_back("all_folders", "all_files", "(select * from vcells_docs_all where false)") + """
union all select 'head', folder_path, 'txt,csv', 0, null from fr_docs_all where ok
""", *SNAP_ALL, *grouping_ctes("docs_all", True))

ORACLE["sync_excluded"] = q(read_back("""(
  select folder_path as path, cast(coalesce(sum(size), 0) as bigint) as total_size, count(name) as file_count
  from (select n.folder_path, s.name, s.size from (select distinct folder_path from docs_new where folder_path not like '%/en') n
        left join seen_l s using (folder_path)) group by folder_path)""", "seen_l", "vcells_seen_l"),
    "seen_l as (select * from docs_new where folder_path not like '%/en' and name <> 'doc_10.txt')", *grouping_ctes("seen_l", True))

ORACLE["sync_forced"] = q("""
select true as updated, v as version, cast(0 as bigint) as folder_diffs, cast(0 as bigint) as file_changes,
       (select count(*) from fr_docs_all where ok) as blocks, TIMESTAMP '2024-01-15 12:00:00' + to_days(cast(v as integer)) as updated_at
from (values (cast(0 as bigint)), (cast(1 as bigint))) x(v)
""", *keyed_ctes("docs_all")[:1])

# three syncs: first load of the old corpus, the new corpus, the new corpus
# again (nothing changed: not updated, current version and stamp). Folders that
# vanished keep their blocks
ORACLE["sync"] = q("""
select true as updated, cast(0 as bigint) as version, cast(0 as bigint) as folder_diffs,
       cast(0 as bigint) as file_changes, (select count(*) from fr_docs_old where ok) as blocks,
       TIMESTAMP '2024-01-15 12:00:00' as updated_at
union all
select true, cast(1 as bigint),
       (select count(*) from new_stats n left join snap_folders s on s.path = n.folder_path
        where s.id is null or n.total_size <> s.total_size or n.file_count <> s.file_count),
       (select count(*) from fchanges),
       (select count(*) from fr_docs_new where ok) + (select count(*) from fr_docs_old where ok and folder_path not in (select folder_path from docs_new)),
       TIMESTAMP '2024-01-16 12:00:00'
union all
select false, cast(1 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint),
       TIMESTAMP '2024-01-16 12:00:00'
""", *SNAPSHOT, *keyed_ctes("docs_old")[:1], *keyed_ctes("docs_new")[:1])
